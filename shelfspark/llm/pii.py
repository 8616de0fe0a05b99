"""Personal data by weak supervision (DataFrame functions only).

Candidates are the spans of the four base patterns and of wider ones (spelled-out
e-mail addresses, numbers without a country code, fifteen-digit cards). Labelers of
three sorts vote on each, yes, no or abstain: regular expressions (strict
pattern, inner format, clean boundaries), gazetteers (top-level domains, calling
codes, issuer digits, reserved ranges) and context (cue words before the span).

Candidates are counted by kind and votes: at most 4 * 3^5 patterns, whatever the
input. On this table expectation-maximisation estimates each labeler's
reliability (its chances of yes, no and abstaining on true and on false spans)
and a posterior per pattern; a logistic regression on votes and kind, trained on the posteriors,
is the final span classifier. It is applied as a column
expression. Base spans always stay; other candidates are added where the
classifier says so and they overlap no base span.

The regular expressions are those of the contract with possessive quantifiers
where backtracking could not change the match, and may not start inside a run
that the search has already tried, so very long runs take linear time.

Defined results: a null text is empty and has no spans; repeated rows each get
their spans; an empty table gives no rows; positions count code points, ends are
exclusive; other columns pass through ``redact`` untouched whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import let, text_of, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# Base patterns (fixed values, by kind).
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap conditions without which a pattern cannot match.
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDER = {
    "email": rf"(?i)(?<![{LOCAL}])[{LOCAL}]++\x20?[(\[{{]at[)\]}}]\x20?[A-Za-z0-9-]++"
             r"(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDER_MAY = {"email": r"(?i)[(\[{]at[)\]}]", "card": "3[47][0-9]{2}", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"}
# Cue words (English, German, French, Spanish) found shortly before a span of the kind.
CUES = {
    "email": r"e-?mail|mail|contact|kontakt|contacto|correo|courriel|write|adresse",
    "ip": r"\bip\b|address|adresse|server|host|from|login",
    "card": r"card|karte|carte|tarjeta|visa|master|credit|kredit|pay",
    "phone": r"phone|tel\b|tel[:.]|telefon|t[ée]l[ée]phone|tel[ée]fono|call|mobile|fax|whatsapp",
}
COUNTER_CUES = r"version|release|\bv\.?\s*$|isbn|issn|order|invoice|serial|section|\bno\.?\s*$|#\s*$"
TOP_DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl|be|pl|us|ca|mx|ar|co|example|test)$"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
CONTEXT = 40
VOTES = ("strict", "format", "boundary", "gazetteer", "context")
SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>>"


def find_spans(text: Column, pattern: str, may: str) -> Column:
    """array<struct<start, m>> of the leftmost non-overlapping matches; starts count code points.

    The gaps of ``split`` and the matches of ``regexp_extract_all`` come from the
    same search, so their lengths add up to the starts.
    """
    empty = F.array().cast("array<struct<start:int,m:string>>")

    def walk(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("m")))
        return F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + F.length(s["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), s["m"].alias("m")))).alias("out")),
            lambda acc: acc["out"])

    # A look-behind at a match's start sees the text before it, not only from the last match on.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = let(F.split(text, pattern, -1), lambda gaps: let(found, lambda m: walk(gaps, m)))
    return F.when(text.rlike(may), hits).otherwise(empty)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""

    def add(acc: Column, x: Column) -> Column:
        doubled = x["d"] * 2
        return acc + F.when(x["i"] % 2 == 0, x["d"]).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(
        (F.ascii(c) - 48).alias("d"), i.alias("i")))
    return F.aggregate(F.filter(each, lambda x: x["d"] >= 0), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: let(
            F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(digits_of(m), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits_of(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base pattern; failing matches are dropped without a retry."""
    return F.filter(find_spans(text, BASE[kind], MAY[kind]), lambda s: _valid(kind, s["m"]))


def _yes_no(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _votes(text: Column, kind: str, s: Column, base: bool) -> Column:
    """Votes of the labelers in the order of VOTES: 1 yes, 0 no, -1 abstains."""
    m, digits = s["m"], digits_of(s["m"])
    before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
    last, after = F.substring(text, s["start"], 1), F.substring(text, s["start"] + F.length(m) + 1, 1)
    shape = {
        "email": m.rlike(r"\.[A-Za-z]{2,24}$|dot[)\]}]\x20?[A-Za-z]{2,24}$") & ~m.rlike(r"\.\.|^[.]"),
        "ip": ~m.rlike(r"(^|\.)0[0-9]"),
        "card": m.rlike(r"^[0-9]+$|^([0-9]{4}[\x20-]){3}[0-9]{4}|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$"),
        "phone": F.length(digits).between(10, 13),
    }[kind]
    known = {
        "email": F.when(F.lower(m).rlike(TOP_DOMAINS), 1).otherwise(-1),
        "ip": _yes_no(~m.rlike(r"^(0|22[4-9]|2[3-5][0-9])\.")),
        "card": _yes_no(digits.rlike("^[3-6]")),
        "phone": F.when(m.startswith("+"), _yes_no(m.rlike(CALLING_CODES))).otherwise(-1),
    }[kind]
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(COUNTER_CUES), 0).otherwise(-1)
    boundary = _yes_no(((s["start"] == 0) | ~last.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]"))
    return F.array(F.lit(1 if base else 0 if kind == "email" else -1), _yes_no(shape), boundary, known, context)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes."""

    def spans(found: Column, kind: str, base: bool) -> Column:
        return F.transform(found, lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"),
            (s["start"] + F.length(s["m"])).alias("end"), F.lit(base).alias("base"),
            _votes(text, kind, s, base).alias("votes")))

    strict = F.concat(*[spans(base_spans(text, k), k, True) for k in KINDS])
    found = {k: find_spans(text, WIDER[k], WIDER_MAY[k]) for k in WIDER}
    found["card"] = F.filter(found["card"], lambda s: luhn(digits_of(s["m"])))
    wider = F.concat(*[spans(x, k, False) for k, x in found.items()])

    def joined(b: Column, w: Column) -> Column:
        free = F.filter(w, lambda x: ~F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
        return F.concat(b, free)

    return let(strict, lambda b: let(wider, lambda w: joined(b, w)))


# --------------------------------------------------- models on the vote table

def label_model(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> list[float]:
    """Posterior of each pattern (kind, votes, count) by expectation-maximisation.

    A labeler's chances of each outcome given the truth are estimated with two
    pseudo-candidates' worth of belief that it is right more often than not; the share of true
    spans is estimated per kind.
    """
    outcomes = (-1, 0, 1)
    belief = {True: {-1: 0.6, 0: 0.2, 1: 1.2}, False: {-1: 0.6, 0: 1.2, 1: 0.2}}
    chance = {truth: [{o: belief[truth][o] / 2 for o in outcomes} for _ in VOTES] for truth in (True, False)}
    prior = {k: 0.8 for k in range(len(KINDS))}
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for n, (kind, votes, _) in enumerate(patterns):
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(votes):
                yes += math.log(chance[True][j][v])
                no += math.log(chance[False][j][v])
            posterior[n] = 1 / (1 + math.exp(min(700.0, no - yes)))
        weight = {truth: [dict(belief[truth]) for _ in VOTES] for truth in (True, False)}
        share = {k: [8.0, 2.0] for k in range(len(KINDS))}
        for p, (kind, votes, count) in zip(posterior, patterns):
            share[kind][0] += p * count
            share[kind][1] += (1 - p) * count
            for j, v in enumerate(votes):
                weight[True][j][v] += p * count
                weight[False][j][v] += (1 - p) * count
        chance = {t: [{o: w[o] / sum(w.values()) for o in outcomes} for w in weight[t]] for t in weight}
        prior = {k: a / (a + b) for k, (a, b) in share.items()}
    return posterior


def features(kind: int, votes: tuple[int, ...]) -> list[float]:
    """Bias, one per kind, yes and no of each labeler."""
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == o) for v in votes for o in (1, 0))]


def span_classifier(patterns: list[tuple[int, tuple[int, ...], int]], posterior: list[float],
                    rounds: int = 400, ridge: float = 0.01) -> list[float]:
    """Logistic regression on the patterns, weighted by their share, with posteriors as soft labels."""
    rows = [features(kind, votes) for kind, votes, _ in patterns]
    total = sum(c for _, _, c in patterns)
    size = 1 + len(KINDS) + 2 * len(VOTES)
    # Start from the labelers' plain majority, which decides what the data says nothing about.
    w = [0.0] * (1 + len(KINDS)) + [1.0, -1.0] * len(VOTES)
    start = list(w)
    for _ in range(rounds):
        grad = [ridge * (a - b) for a, b in zip(w, start)]
        for x, p, (_, _, count) in zip(rows, posterior, patterns):
            z = sum(a * b for a, b in zip(w, x))
            error = (1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) - p) * count / total
            for j in range(size):
                grad[j] += error * x[j]
        w = [a - 0.5 * g for a, g in zip(w, grad)]
    return w


def fit(rows: DataFrame) -> list[float]:
    """Weights of the final classifier for rows with ``_spans`` (candidates)."""
    table = rows.select(F.explode("_spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n"))
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in table.collect())  # at most 4 * 3^5 rows
    if not patterns:
        return span_classifier([], [], rounds=0)
    return span_classifier(patterns, label_model(patterns))


def accepted(spans: Column, w: list[float]) -> Column:
    """Base spans and those the classifier accepts, by kind and start."""

    def score(s: Column) -> Column:
        z = F.lit(w[0])
        for k in range(len(KINDS)):
            z += F.when(s["kind"] == k, w[1 + k]).otherwise(0.0)
        for j in range(len(VOTES)):
            at = 1 + len(KINDS) + 2 * j
            z += F.when(s["votes"][j] == 1, w[at]).when(s["votes"][j] == 0, w[at + 1]).otherwise(0.0)
        return z

    return F.sort_array(F.transform(F.filter(spans, lambda s: s["base"] | (score(s) > 0)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans per document (doc_id, text)."""
    rows = written(docs.select("doc_id", candidates(text_of()).alias("_spans")), "pii")
    w = fit(rows)
    base = F.filter("_spans", lambda s: s["base"])
    plain = F.sort_array(F.transform(base, lambda s: F.struct(s["kind"], s["start"], s["end"])))

    def count(i: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return rows.select("doc_id", *[count(i) for i in range(len(KINDS))], F.sha2(_joined(plain), 256).alias("base_sha256"),
                       _joined(accepted(F.col("_spans"), w)).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    folded = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(
                F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])))).alias("out")),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(folded)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in their texts; ``n_chars`` follows where present."""
    rows = written(docs.select(F.struct("*").alias("_row"), candidates(text_of()).alias("_spans")), "pii")
    w = fit(rows)
    row, spans = F.col("_row"), F.col("_found")
    changed = row.withField("text", _redacted(text_of(row["text"]), spans))
    if "n_chars" in docs.columns:
        changed = let(changed, lambda r: r.withField("n_chars", F.length(r["text"]).cast(docs.schema["n_chars"].dataType)))
    found = rows.select("_row", accepted(F.col("_spans"), w).alias("_found"))
    return found.select(F.when(F.size(spans) == 0, row).otherwise(changed).alias("_row")).select("_row.*")
