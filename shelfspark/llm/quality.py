"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets exact word, symbol, line and repetition counts. Ratios of
these counts go into quantile sketches, one per (language, source) and metric.
A sketch is a log-linear histogram of an integer metric: values below 128 are
kept, larger ones keep their top seven bits, so a quantile is off by less than
1/64 of its value. Two sketches merge by adding the counts of equal bins, hence
map-side partial aggregation, no order dependence and a bounded size per group
(at most 128 + 64 * 57 bins). Groups of fewer than ``min_docs`` documents fall
back to the merged sketch of their language, then of all documents.

The fences taken from the sketches (see ``FENCES``) replace fixed cutoffs; a
join on (language, source) applies them. The fence table has one row per
(language, source), so the join strategy is left to Spark (AQE broadcasts it
when its measured size allows, and otherwise splits a hot source).

Defined results: a null text is the empty text (no words: fails the base
rule); null language or source form a group of their own; repeated rows each
get their row; an empty table gives no rows; other columns pass through
``filter_documents`` untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.common import SPACE_CLASS, SPACES, let, text_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 100

# metric -> (lower quantile %, upper quantile %, spreads beyond it, least distance beyond it, sides)
# Metrics are integers: per mille of the words or lines, word length in hundredths of a character.
FENCES: dict[str, tuple[int, int, int, int, str]] = {
    "symbols": (25, 75, 3, 100, "high"),
    "dup_lines": (25, 75, 3, 450, "high"),
    "repeats": (25, 75, 3, 450, "high"),
    "word_length": (25, 75, 6, 200, "both"),
}


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more in the text."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        repeated = let(
            ordered,
            lambda s: F.transform(
                F.filter(s, lambda x, k: F.get(s, k - 1)["w"].eqNullSafe(x["w"]) | F.get(s, k + 1)["w"].eqNullSafe(x["w"])),
                lambda x: x["i"],
            ),
        )
        starts = F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))
        return F.size(F.array_distinct(F.flatten(starts)))

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    windows = F.slice(
        F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of_windows))


def measures(text: Column) -> Column:
    """Struct of the exact counts of one text (a null text counts as empty)."""

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(words_of(text), of_words)


def metrics(m: Column) -> dict[str, Column]:
    """The integer metrics that the sketches hold (null without words)."""

    def ratio(num: Column, den: Column, scale: int) -> Column:
        return F.when(den > 0, F.floor(num * scale / den)).cast("long")

    return {
        "symbols": ratio(m["n_symbols"], m["n_words"], 1000),
        "dup_lines": ratio(m["n_dup_lines"], m["n_lines"], 1000),
        "repeats": ratio(m["n_repeat_words"], m["n_words"], 1000),
        "word_length": ratio(m["word_chars"], m["n_words"], 100),
    }


def sketch_bin(value: Column) -> Column:
    """Bin of a non-negative integer: its top seven bits, the rest zero."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def quantile_sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merged sketches: (keys, metric, bin, n), for rows with a column per metric."""
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in FENCES
    ])).alias("_m")).select(*keys, "_m.metric", sketch_bin(F.col("_m.value")).alias("bin"))
    return long.where("bin IS NOT NULL").groupBy(*keys, "metric", "bin").agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the counts of equal bins added up."""
    return sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: documents seen (``n_docs``), ``<metric>_low`` and ``<metric>_high``."""
    by_bin = Window.partitionBy(*keys, "metric").orderBy("bin")
    everything = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumns({"upto": F.sum("n").over(by_bin), "total": F.sum("n").over(everything)})
    out = [F.max("total").alias("n_docs")]
    for name, (low, high, spreads, least, sides) in FENCES.items():
        mine = F.col("metric") == name
        q_low = F.min(F.when(mine & (F.col("upto") * 100 >= F.col("total") * low), F.col("bin")))
        q_high = F.min(F.when(mine & (F.col("upto") * 100 >= F.col("total") * high), F.col("bin")))
        reach = F.greatest((q_high - q_low) * spreads, F.lit(least))
        out.append((q_high + reach).alias(f"{name}_high"))
        if sides == "both":
            out.append((q_low - reach).alias(f"{name}_low"))
    return ranked.groupBy(*keys).agg(*out)


def group_fences(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences per (_lang, _source), taken from the finest group with ``min_docs`` documents."""
    fine = quantile_sketches(rows, ["_lang", "_source"])
    by_lang = merge_sketches(fine, ["_lang"])
    every = merge_sketches(by_lang.withColumn("_all", F.lit(1)), ["_all"])
    limits = [f"{n}_high" for n in FENCES] + [f"{n}_low" for n, f in FENCES.items() if f[4] == "both"]

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{tag}_{c}" for c in ["n_docs", *limits]})

    s = named(fences(fine, ["_lang", "_source"]), "s")
    g = named(fences(by_lang, ["_lang"]), "l").withColumnRenamed("_lang", "_l")
    a = named(fences(every, ["_all"]), "a")
    joined = s.withColumn("_all", F.lit(1)).join(g, F.col("_lang").eqNullSafe(F.col("_l")), "left").join(a, "_all")
    pick = [
        F.when(F.col("s_n_docs") >= min_docs, F.col(f"s_{c}"))
        .when(F.col("l_n_docs") >= min_docs, F.col(f"l_{c}"))
        .otherwise(F.col(f"a_{c}")).alias(c)
        for c in limits
    ]
    return joined.select("_lang", "_source", *pick)


def judge(docs: DataFrame, carry: list[Column], min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` beside the carried columns.

    ``docs`` has text, lang and source. The counts are written once to the
    shared folder, as both the sketches and the filter read them.
    """
    measured = docs.select(*carry, F.col("lang").cast("string").alias("_lang"),
                           F.col("source").cast("string").alias("_source"), measures(text_of()).alias("_m"))
    measured = measured.withColumns(metrics(F.col("_m")))
    rows = written(measured, "quality")
    limits = group_fences(rows, min_docs).withColumnsRenamed({"_lang": "_fl", "_source": "_fs"})
    m = F.col("_m")
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    passes = F.lit(True)
    for name, spec in FENCES.items():
        passes &= F.coalesce(F.col(name) <= F.col(f"{name}_high"), F.lit(True))
        if spec[4] == "both":
            passes &= F.coalesce(F.col(name) >= F.col(f"{name}_low"), F.lit(True))
    on = F.col("_lang").eqNullSafe(F.col("_fl")) & F.col("_source").eqNullSafe(F.col("_fs"))
    return rows.join(limits, on, "left").withColumns({"base_failed": base_failed, "kept": ~base_failed & passes})


def filter_documents(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    packed = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    return judge(packed, [F.col("_row")], min_docs).where("kept").select("_row.*")


def quality_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts and verdict per document."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(docs, [F.col("doc_id")], min_docs).select(
        "doc_id", *[F.col("_m")[c].alias(c) for c in counts], "base_failed", "kept")


def report_sql(min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL for ``quality_report`` over the documents table."""
    metric = {"symbols": "n_symbols * 1000 // n_words", "dup_lines": "n_dup_lines * 1000 // n_lines",
              "repeats": "n_repeat_words * 1000 // n_words", "word_length": "word_chars * 100 // n_words"}
    limits = [f"{n}_high" for n in FENCES] + [f"{n}_low" for n, f in FENCES.items() if f[4] == "both"]

    def level(name: str, keys: str) -> str:
        group, also = (f"{keys}, ", f"PARTITION BY {keys}, metric") if keys else ("", "PARTITION BY metric")
        columns = []
        for n, (low, high, spreads, least, sides) in FENCES.items():
            q = [f"min(bin) FILTER (WHERE metric = '{n}' AND upto * 100 >= total * {p})" for p in (low, high)]
            reach = f"greatest(({q[1]} - {q[0]}) * {spreads}, {least})"
            columns.append(f"{q[1]} + {reach} AS {n}_high")
            if sides == "both":
                columns.append(f"{q[0]} - {reach} AS {n}_low")
        tail = f"GROUP BY {keys}" if keys else ""
        return f"""{name} AS (SELECT {group}max(total) AS n_docs, {", ".join(columns)} FROM (
          SELECT {group}metric, bin, sum(n) OVER ({also} ORDER BY bin) AS upto, sum(n) OVER ({also}) AS total
          FROM (SELECT {group}metric, bin, sum(n) AS n FROM sketch GROUP BY {group}metric, bin)) {tail})"""

    picks = ", ".join(f"CASE WHEN f.n_docs >= {min_docs} THEN f.{c} WHEN g.n_docs >= {min_docs} THEN g.{c} "
                      f"ELSE (SELECT {c} FROM by_all) END AS {c}" for c in limits)
    rules = " AND ".join([f"coalesce({n} <= {n}_high, true)" for n in FENCES]
                         + [f"coalesce({n} >= {n}_low, true)" for n, f in FENCES.items() if f[4] == "both"])
    values = ", ".join(f"CASE WHEN {'n_lines' if n == 'dup_lines' else 'n_words'} > 0 THEN {e} END AS {n}" for n, e in metric.items())
    longs = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS metric, {n} AS v FROM valued" for n in metric)
    space = r"[\x20\x09-\x0D]+"
    return f"""
    WITH split AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS lines
      FROM documents),
    places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3),
    windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, concat_ws(' ', w[i], w[i + 1], w[i + 2])) AS c FROM places),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY rid),
    counted AS (SELECT rid, doc_id, lang, source, len(w) AS n_words,
        length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
        coalesce(covered.n, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (rid)),
    valued AS (SELECT *, {values} FROM counted),
    longs AS ({longs}),
    sketch AS (SELECT lang, source, metric, bin, count(*) AS n FROM (
        SELECT lang, source, metric, (v >> s) << s AS bin FROM (
          SELECT *, greatest(length(bin(v)) - 7, 0)::BIGINT AS s FROM longs WHERE v IS NOT NULL)) GROUP BY ALL),
    {level("by_source", "lang, source")}, {level("by_lang", "lang")}, {level("by_all", "")},
    limits AS (SELECT f.lang, f.source, {picks} FROM by_source f LEFT JOIN by_lang g ON f.lang IS NOT DISTINCT FROM g.lang),
    judged AS (SELECT v.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        {rules} AS passes FROM valued v LEFT JOIN limits l
        ON v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
        NOT base_failed AND passes AS kept FROM judged"""
