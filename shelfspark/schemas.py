"""Typed and raw schemas of the retail model, plus the fixed values the
operators must agree on (domains, defaults, header names)."""

from __future__ import annotations

import re

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# qty * price and sums of money: wide enough not to overflow per group.
MONEY_WIDE = T.DecimalType(18, 2)
MONEY_SUM = T.DecimalType(38, 2)


_SIMPLE = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "boolean": T.BooleanType(), "double": T.DoubleType(),
}


def _struct(spec: str) -> T.StructType:
    """'name type, ...' -> StructType (types used here only; no session needed)."""
    fields = []
    for name, typ, p, s in re.findall(r"(\w+) (\w+)(?:\((\d+),(\d+)\))?", spec):
        dtype = T.DecimalType(int(p), int(s)) if typ == "decimal" else _SIMPLE[typ]
        fields.append(T.StructField(name, dtype, True))
    return T.StructType(fields)


# Typed layer. Keys are long in the adapter (they come from integer keys of
# the driver tables); in a UUID deployment they are strings and nothing
# below depends on the key type.
SUPPLIERS = _struct(
    "supplier_id bigint, supplier_code string, supplier_name string, contact_person string, "
    "phone string, email string, address string, payment_terms string, notes string"
)
INVENTORY = _struct(
    "item_id bigint, item_code string, category string, item_name string, description string, "
    "sku string, quantity_in_stock int, min_stock_level int, cost_price decimal(10,2), "
    "selling_price decimal(10,2), profit_margin decimal(10,2), supplier_id bigint, "
    "date_added date, last_restocked date"
)
USERS = _struct(
    "user_id bigint, user_code string, username string, email string, password_hash string, "
    "role string, account_status string, created_by bigint, last_login timestamp, "
    "failed_login_attempts int, notes string"
)
SALES_LOG = _struct(
    "transaction_id bigint, transaction_code string, sale_date date, sale_time string, "
    "item_id bigint, quantity_sold int, unit_price decimal(10,2), total_amount decimal(12,2), "
    "payment_method string, sold_by bigint, notes string, line_no int"
)
RESTOCK_ORDERS = _struct(
    "order_id bigint, order_code string, date_ordered date, supplier_id bigint, item_id bigint, "
    "quantity_ordered int, cost_per_unit decimal(10,2), total_cost decimal(12,2), "
    "expected_delivery date, status string, date_received date, notes string"
)
ACTIVITY_LOG = _struct(
    "log_id bigint, user_id bigint, action string, details string, ip_address string, "
    "user_agent string, created_at timestamp"
)

TYPED = {
    "suppliers": SUPPLIERS,
    "inventory": INVENTORY,
    "users": USERS,
    "sales_log": SALES_LOG,
    "restock_orders": RESTOCK_ORDERS,
    "activity_log": ACTIVITY_LOG,
}

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (domains, headers, defaults).
# ---------------------------------------------------------------------------
CATEGORIES = ["Bags", "Shoes", "Wallets", "Belts", "Accessories", "Other"]
ROLES = ["Admin", "Staff"]
ACCOUNT_STATUSES = ["Active", "Suspended", "Locked"]
PAYMENT_METHODS = ["Cash", "Card", "Bank Transfer", "Other"]
ORDER_STATUSES = ["Pending", "Received", "Cancelled"]

DEFAULT_MIN_STOCK = 5
LOW_STOCK_CRITICAL = 2  # qty at or below this is the red marker

# Raw (legacy worksheet / CSV) headers; every field is text.
RAW_HEADERS = {
    "INVENTORY": [
        "Item_ID", "Category", "Item_Name", "Description", "Quantity_In_Stock", "Cost_Price",
        "Selling_Price", "Supplier_Name", "Date_Added", "Last_Restocked", "Min_Stock_Level", "SKU",
    ],
    "SALES_LOG": [
        "Date", "Time", "Item_ID", "Item_Name", "Quantity_Sold", "Unit_Price", "Total_Amount",
        "Payment_Method", "Sold_By", "Transaction_ID",
    ],
    "SUPPLIERS": [
        "Supplier_ID", "Supplier_Name", "Contact_Person", "Phone", "Email", "Address",
        "Payment_Terms", "Notes",
    ],
    "RESTOCK_ORDERS": [
        "Order_ID", "Date_Ordered", "Supplier_Name", "Item_ID", "Item_Name", "Quantity_Ordered",
        "Cost_Per_Unit", "Expected_Delivery", "Status", "Date_Received",
    ],
    "USERS": [
        "User_ID", "Username", "Email", "Password_Hash", "Role", "Created_Date", "Last_Login",
        "Account_Status", "Created_By", "Notes",
    ],
    "ACTIVITY_LOG": ["Log_ID", "User_ID", "Action", "Timestamp", "Details"],
}

# Database column -> legacy header. Columns not listed keep their name.
LEGACY_NAMES = {
    "item_code": "Item_ID",
    "user_code": "User_ID",
    "transaction_code": "Transaction_ID",
    "order_code": "Order_ID",
    "supplier_code": "Supplier_ID",
    "item_id": "_uuid",
    "user_id": "_user_uuid",
    "category": "Category",
    "item_name": "Item_Name",
    "description": "Description",
    "sku": "SKU",
    "quantity_in_stock": "Quantity_In_Stock",
    "min_stock_level": "Min_Stock_Level",
    "cost_price": "Cost_Price",
    "selling_price": "Selling_Price",
    "profit_margin": "Profit_Margin",
    "date_added": "Date_Added",
    "last_restocked": "Last_Restocked",
    "username": "Username",
    "email": "Email",
    "password_hash": "Password_Hash",
    "role": "Role",
    "created_at": "Created_Date",
    "last_login": "Last_Login",
    "account_status": "Account_Status",
    "notes": "Notes",
}

# Role -> permitted actions.
PERMISSIONS = {
    "Admin": ["add_item", "edit_item", "delete_item", "restock", "manage_users", "view_reports"],
    "Staff": ["add_item", "edit_item", "restock", "view_reports"],
}

# Code prefixes of generated keys.
CODE_PREFIX = {"suppliers": "SUP", "inventory": "ITM", "users": "USR", "sales_log": "TXN", "restock_orders": "PO"}

# Accepted raw date layouts, tried in this order (first match wins).
DATE_PATTERNS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-MMM-yyyy"]


def raw_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType(), True) for h in RAW_HEADERS[table]])
