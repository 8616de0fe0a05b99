"""Oracle SQL (DuckDB dialect) for the correctness check.

`ADAPTER_SQL` is the SQL twin of `shelfspark.sources.adapter`: CTEs named
after the retail tables, over the driver's pre-registered views. Each
query's oracle is written from the semantics on top of these CTEs and
wrapped in an outer SELECT that casts every column to the type the Spark
side produces (see `with_types`).

Exact rounding: PostgreSQL computes ROUND(AVG(numeric), 2) exactly; DuckDB's
AVG(decimal) is a DOUBLE. `avg2` and `ratio2` spell out the exact integer
rounding (half away from zero) with HUGEINT, matching
`shelfspark.functions.money`.
"""

from __future__ import annotations

AS_OF_SQL = "DATE '2001-08-02'"


def avg2(x: str) -> str:
    """ROUND(AVG(x), 2) exactly, x a scale-2 decimal."""
    n = f"CAST(sum(CAST(({x}) * 100 AS HUGEINT)) AS HUGEINT)"
    d = f"CAST(count({x}) AS HUGEINT)"
    return (
        f"(CASE WHEN count({x}) = 0 THEN NULL ELSE CAST(CAST(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) "
        f"AS DECIMAL(38,0)) * 0.01 AS DECIMAL(18,2)) END)"
    )


def ratio2(num: str, den: str) -> str:
    """ROUND(num / den, 2) exactly for integral num and den > 0."""
    n = f"(CAST({num} AS HUGEINT) * 100)"
    d = f"CAST({den} AS HUGEINT)"
    return (
        f"(CASE WHEN {d} > 0 THEN CAST(CAST(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) "
        f"AS DECIMAL(38,0)) * 0.01 AS DECIMAL(18,2)) END)"
    )


def pct2(part_cents: str, total_cents: str) -> str:
    """ROUND(part * 100.0 / total, 2) exactly, from integer cents."""
    n = f"(CAST({part_cents} AS HUGEINT) * 10000)"
    d = f"CAST({total_cents} AS HUGEINT)"
    return (
        f"(CASE WHEN {d} > 0 THEN CAST(CAST(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) "
        f"AS DECIMAL(38,0)) * 0.01 AS DECIMAL(18,2)) END)"
    )


_SELLING = "CAST(CAST(round(p_retailprice * 100) AS BIGINT) * 0.01 AS DECIMAL(10,2))"
_COST = f"CAST(round({_SELLING} * 0.6, 2) AS DECIMAL(10,2))"

ADAPTER_SQL = f"""
suppliers AS (
  SELECT s_suppkey AS supplier_id,
         printf('SUP%03d', s_suppkey + 1) AS supplier_code,
         s_name AS supplier_name,
         CASE WHEN s_suppkey % 4 <> 0 THEN 'Contact ' || CAST(s_suppkey AS VARCHAR) END AS contact_person,
         printf('+%02d-%07d', s_nationkey, s_suppkey) AS phone,
         CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS address,
         CAST(NULL AS VARCHAR) AS payment_terms, CAST(NULL AS VARCHAR) AS notes
  FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier
        UNION ALL SELECT s_suppkey + 1000000000000, 'Dormant ' || s_name, s_nationkey FROM supplier
        WHERE s_suppkey % 9 = 0) every_supplier
),
inventory AS (
  SELECT p_partkey AS item_id,
         printf('ITM%03d', p_partkey + 1) AS item_code,
         CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'Bags'
              WHEN starts_with(p_type, 'LARGE') THEN 'Shoes'
              WHEN starts_with(p_type, 'MEDIUM') THEN 'Wallets'
              WHEN starts_with(p_type, 'PROMO') THEN 'Belts'
              WHEN starts_with(p_type, 'SMALL') THEN 'Accessories'
              ELSE 'Other' END AS category,
         p_name AS item_name,
         concat_ws(' ', p_brand, lower(p_type), p_name) AS description,
         printf('SKU-%06d', p_partkey) AS sku,
         CAST((p_partkey * 37) % 61 AS INTEGER) AS quantity_in_stock,
         CAST(p_size % 11 + 5 AS INTEGER) AS min_stock_level,
         {_COST} AS cost_price,
         {_SELLING} AS selling_price,
         CAST({_SELLING} - {_COST} AS DECIMAL(10,2)) AS profit_margin,
         CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 7) % (SELECT count(*) FROM supplier) END AS supplier_id,
         CAST(DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS DATE) AS date_added,
         CAST(DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) + CAST(p_partkey % 97 AS INTEGER) AS DATE)
           AS last_restocked
  FROM (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
        UNION ALL SELECT p_partkey + 1000000000000, 'Unsold ' || p_name, p_brand, p_type, p_size, p_retailprice
        FROM part WHERE p_partkey % 13 = 0) every_part
),
sales_log AS (
  SELECT l_orderkey AS transaction_id,
         printf('TXN%08d-%02d', l_orderkey, l_linenumber) AS transaction_code,
         CAST(o_orderdate AS DATE) AS sale_date,
         printf('%02d:%02d:%02d', l_orderkey % 12 + 8, (l_orderkey * 7 + l_linenumber) % 60,
                (l_linenumber * 13) % 60) AS sale_time,
         l_partkey AS item_id,
         CAST(l_quantity AS INTEGER) AS quantity_sold,
         CAST(CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) * 0.01 AS DECIMAL(10,2))
           AS unit_price,
         CAST(CAST(l_quantity AS INTEGER)
              * CAST(CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) * 0.01 AS DECIMAL(10,2))
              AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN starts_with(o_orderpriority, '1') THEN 'Cash'
              WHEN starts_with(o_orderpriority, '2') THEN 'Card'
              WHEN starts_with(o_orderpriority, '3') THEN 'Bank Transfer'
              ELSE 'Other' END AS payment_method,
         CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS sold_by,
         CAST(NULL AS VARCHAR) AS notes,
         l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
restock_orders AS (
  SELECT l_orderkey * 100 + l_linenumber AS order_id,
         printf('PO%08d-%02d', l_orderkey, l_linenumber) AS order_code,
         CAST(o_orderdate AS DATE) AS date_ordered,
         l_suppkey AS supplier_id,
         l_partkey AS item_id,
         CAST(l_quantity AS INTEGER) AS quantity_ordered,
         {_COST} AS cost_per_unit,
         CAST(CAST(l_quantity AS INTEGER) * {_COST} AS DECIMAL(12,2)) AS total_cost,
         CAST(CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) AS DATE) AS expected_delivery,
         CASE WHEN l_returnflag = 'R' THEN 'Cancelled' WHEN l_linestatus = 'O' THEN 'Pending'
              ELSE 'Received' END AS status,
         CASE WHEN l_returnflag <> 'R' AND l_linestatus <> 'O'
              THEN CAST(CAST(o_orderdate AS DATE) + CAST(l_quantity AS INTEGER) AS DATE) END AS date_received,
         CAST(NULL AS VARCHAR) AS notes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
users AS (
  SELECT c_custkey AS user_id,
         printf('USR%03d', c_custkey + 1) AS user_code,
         c_name AS username,
         'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         'pending_migration' AS password_hash,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Admin' ELSE 'Staff' END AS role,
         CASE WHEN c_custkey % 20 = 0 THEN 'Suspended' WHEN c_custkey % 33 = 0 THEN 'Locked'
              ELSE 'Active' END AS account_status,
         CASE WHEN c_custkey % 50 <> 0 THEN c_custkey - c_custkey % 50 END AS created_by,
         CAST(NULL AS TIMESTAMP) AS last_login,
         0 AS failed_login_attempts,
         CAST(NULL AS VARCHAR) AS notes
  FROM customer
),
activity_log AS (
  SELECT event_id AS log_id, user_id,
         CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'error' THEN 'LOGIN_FAILED'
              WHEN 'purchase' THEN 'RECORD_SALE' WHEN 'click' THEN 'RESTOCK'
              WHEN 'view' THEN 'VIEW_REPORT' ELSE 'OTHER' END AS action,
         CASE event_type
              WHEN 'purchase' THEN printf('Sold %d of %s', CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1,
                                          printf('ITM%03d', (event_id * 7) % (SELECT count(*) FROM part) + 1))
              WHEN 'click' THEN printf('Restocked %d units of %s',
                                       CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1,
                                       printf('ITM%03d', (event_id * 7) % (SELECT count(*) FROM part) + 1))
              WHEN 'signup' THEN 'User logged in'
              WHEN 'error' THEN 'Invalid username or password'
              ELSE 'Viewed report' END AS details,
         CAST(NULL AS VARCHAR) AS ip_address, CAST(NULL AS VARCHAR) AS user_agent,
         ts AS created_at
  FROM events
),
login_attempts AS (
  SELECT event_id AS attempt_id, ts, user_id, c_name AS username, event_type = 'signup' AS success
  FROM events JOIN customer ON user_id = c_custkey
  WHERE event_type IN ('signup', 'error')
)
"""


def with_types(body: str, columns: list[tuple[str, str]], extra_ctes: str = "") -> str:
    """WITH <adapter> [, extra] SELECT CAST(col AS type) ... FROM (body).

    Extra CTEs may be recursive (a fold written as WITH RECURSIVE)."""
    casts = ",\n  ".join(f"CAST(q.{c} AS {t}) AS {c}" for c, t in columns)
    ctes = ADAPTER_SQL.strip()
    head = "WITH"
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
        if "RECURSIVE" in extra_ctes.split("\n", 1)[0].upper() or "UNION ALL" in extra_ctes.upper():
            head = "WITH RECURSIVE"
    return f"{head} {ctes}\nSELECT\n  {casts}\nFROM (\n{body}\n) AS q"


def _date_text(d: str, k: str) -> str:
    return (f"CASE WHEN {d} IS NULL THEN '' WHEN {k} % 3 = 0 THEN strftime({d}, '%-m/%-d/%Y') "
            f"WHEN {k} % 3 = 1 THEN strftime({d}, '%-d-%b-%Y') ELSE strftime({d}, '%Y-%m-%d') END")


# Twin of shelfspark.sources.raw (raw legacy text frames).
RAW_SQL = f"""
raw_suppliers AS (
  SELECT supplier_code AS Supplier_ID, supplier_name AS Supplier_Name,
         COALESCE(contact_person, '') AS Contact_Person, COALESCE(phone, '') AS Phone,
         COALESCE(email, '') AS Email, COALESCE(address, '') AS Address,
         COALESCE(payment_terms, '') AS Payment_Terms, COALESCE(notes, '') AS Notes
  FROM suppliers
),
raw_inventory AS (
  SELECT i.item_code AS Item_ID, i.category AS Category, i.item_name AS Item_Name, i.description AS Description,
         CASE WHEN i.item_id % 29 = 0 THEN 'N/A'
              WHEN i.item_id % 23 = 0 THEN CAST(i.quantity_in_stock AS VARCHAR) || '.0'
              ELSE CAST(i.quantity_in_stock AS VARCHAR) END AS Quantity_In_Stock,
         CASE WHEN i.item_id % 19 = 0 THEN ''
              WHEN i.item_id % 7 = 0 THEN '$' || CAST(i.cost_price AS VARCHAR)
              ELSE CAST(i.cost_price AS VARCHAR) END AS Cost_Price,
         CASE WHEN i.item_id % 11 = 0 THEN '฿' || CAST(i.selling_price AS VARCHAR)
              ELSE CAST(i.selling_price AS VARCHAR) END AS Selling_Price,
         CASE WHEN s.supplier_name IS NOT NULL THEN s.supplier_name
              WHEN i.item_id % 20 = 0 THEN 'Walk-in Vendor ' || CAST(i.item_id % 7 AS VARCHAR)
              ELSE '' END AS Supplier_Name,
         {_date_text('i.date_added', 'i.item_id')} AS Date_Added,
         CASE WHEN i.item_id % 5 = 0 THEN '' ELSE strftime(i.last_restocked, '%Y-%m-%d') END AS Last_Restocked,
         CAST(i.min_stock_level AS VARCHAR) AS Min_Stock_Level,
         i.sku AS SKU
  FROM inventory i LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id
),
raw_users AS (
  SELECT user_code AS User_ID, username AS Username, email AS Email, password_hash AS Password_Hash,
         role AS Role, '' AS Created_Date, '' AS Last_Login, account_status AS Account_Status,
         CASE WHEN created_by IS NULL THEN '' ELSE printf('USR%03d', created_by + 1) END AS Created_By,
         CASE WHEN user_id % 7 = 0 THEN 'night shift' ELSE '' END AS Notes
  FROM users
),
raw_sales AS (
  SELECT CASE WHEN (s.transaction_id + s.line_no) % 5 = 0 THEN strftime(s.sale_date, '%-m/%-d/%Y')
              ELSE strftime(s.sale_date, '%Y-%m-%d') END AS Date,
         s.sale_time AS Time,
         CASE WHEN (s.transaction_id + s.line_no) % 31 = 0 THEN '' ELSE COALESCE(i.item_code, '') END AS Item_ID,
         COALESCE(i.item_name, '') AS Item_Name,
         CASE WHEN (s.transaction_id + s.line_no) % 13 = 0 THEN CAST(s.quantity_sold AS VARCHAR) || '.0'
              ELSE CAST(s.quantity_sold AS VARCHAR) END AS Quantity_Sold,
         CASE WHEN (s.transaction_id + s.line_no) % 7 = 0 THEN '$' || CAST(s.unit_price AS VARCHAR)
              ELSE CAST(s.unit_price AS VARCHAR) END AS Unit_Price,
         CASE WHEN (s.transaction_id + s.line_no) % 17 = 0 THEN '' ELSE CAST(s.total_amount AS VARCHAR) END
           AS Total_Amount,
         CASE WHEN (s.transaction_id + s.line_no) % 19 = 0 THEN '' ELSE s.payment_method END AS Payment_Method,
         CASE WHEN s.sold_by IS NULL THEN '' ELSE printf('USR%03d', s.sold_by + 1) END AS Sold_By,
         s.transaction_code AS Transaction_ID
  FROM sales_log s LEFT JOIN inventory i ON s.item_id = i.item_id
),
raw_orders AS (
  SELECT o.order_code AS Order_ID, {_date_text('o.date_ordered', 'o.order_id')} AS Date_Ordered,
         COALESCE(s.supplier_name, '') AS Supplier_Name, COALESCE(i.item_code, '') AS Item_ID,
         COALESCE(i.item_name, '') AS Item_Name, CAST(o.quantity_ordered AS VARCHAR) AS Quantity_Ordered,
         CAST(o.cost_per_unit AS VARCHAR) AS Cost_Per_Unit, strftime(o.expected_delivery, '%Y-%m-%d') AS Expected_Delivery,
         o.status AS Status,
         CASE WHEN o.date_received IS NULL THEN '' ELSE strftime(o.date_received, '%Y-%m-%d') END AS Date_Received
  FROM restock_orders o LEFT JOIN inventory i ON o.item_id = i.item_id
  LEFT JOIN suppliers s ON o.supplier_id = s.supplier_id
)
"""


def clean_int_sql(x: str) -> str:
    d = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return f"(CASE WHEN isfinite({d}) AND abs({d}) < 2147483648 THEN CAST(trunc({d}) AS INTEGER) ELSE 0 END)"


def clean_money_sql(x: str, dtype: str = "DECIMAL(10,2)") -> str:
    s = f"trim(regexp_replace({x}, '[$฿,]', '', 'g'))"
    return (f"COALESCE(CASE WHEN isfinite(TRY_CAST({s} AS DOUBLE)) THEN "
            f"TRY_CAST(TRY_CAST({s} AS DECIMAL(20,4)) AS {dtype}) END, CAST(0 AS {dtype}))")


def clean_date_sql(x: str) -> str:
    pats = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%b-%Y"]
    tries = ", ".join(f"TRY_STRPTIME({x}, '{p}')" for p in pats)
    return f"(CASE WHEN {x} IS NULL OR {x} = '' OR {x} = 'N/A' THEN NULL ELSE CAST(COALESCE({tries}) AS DATE) END)"
