"""Stems against the published sample, and the index against a plain scan."""

import os
import tempfile

from pyspark.sql import functions as F

from shelfspark.functions.stems import STOP_WORDS, stem
from shelfspark.operators import search as S

# Word and stem pairs of the algorithm's published sample, and its special cases.
SAMPLE = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead
kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news inning inning proceed proceed succeeding succeed generate generat generally general
communism communism by by say say cry cri cries cri ties tie gas gas this this kiwis kiwi gaps gap hopping hop hoping hope
luxuriated luxuri relational relat rationalize ration hopefulness hope agreed agre feed feed boxes box polished polish
polishing polish anodized anod yellow yellow youth youth
""".split()


def folder():
    return tempfile.mkdtemp(prefix="shelfspark-search-")


def test_stems_of_the_published_sample(spark):
    pairs = list(zip(SAMPLE[::2], SAMPLE[1::2]))
    df = spark.createDataFrame(pairs, "token string, want string").withColumn("stem", stem(F.col("token")))
    assert [(r.token, r.stem) for r in df.collect() if r.stem != r.want] == []
    odd = spark.createDataFrame([(None,), ("",), ("x",), ("as",), ("5ing",), ("naïvely",), ("a" * 5000 + "ing",)], "token string")
    got = [r.stem for r in odd.select(stem(F.col("token")).alias("stem")).collect()]
    assert got == [None, "", "x", "as", "5ing", "naïvely", "a" * 5000]
    assert len(STOP_WORDS) == 127


def items(spark):
    return spark.createDataFrame(
        [(1, "Polished boxes", "The finest box, polishing included"), (2, "BOX", None), (3, None, "polish only"),
         (4, "", ""), (5, None, None), (None, "boxing", "polishes"), (6, "the and of", "x"), (7, "box", "a"), (7, "polish", "b")],
        "item_id long, item_name string, description string")


def test_search_finds_forms_of_words(spark):
    df, path = items(spark), folder()
    S.write_index(df, path, buckets=4)

    def ask(query, match_all=True):
        rows = S.search(df, path, query, match_all, buckets=4).collect()
        return sorted(((r.item_id, r.n_words) for r in rows), key=str)

    assert ask("box polishing") == [(1, 4), (7, 2), (7, 2), (None, 2)]  # both rows of a repeated id
    assert ask("the Boxes, box!") == [(1, 2), (2, 1), (7, 1), (7, 1), (None, 1)]
    assert ask("polish box", match_all=False) == [(1, 4), (2, 1), (3, 1), (7, 2), (7, 2), (None, 2)]
    assert ask("the of") == [] and ask("") == [] and ask("missing") == [] and ask("box missing") == []


def test_search_of_an_empty_table_and_one_stem_reads_its_bucket_only(spark):
    df, path = items(spark), folder()
    S.write_index(df.limit(0), path, buckets=4)
    assert S.search(df, path, "box", buckets=4).count() == 0
    S.write_index(df, path, buckets=16)
    want = S.search(df, path, "box", buckets=16).count()
    at = spark.createDataFrame([("box",)], "stem string").select(S._bucket(16)).first()[0]
    others = [f for f in os.listdir(path) if f.startswith("bucket=") and f != f"bucket={at}"]
    assert others
    for f in others:
        for part in os.listdir(os.path.join(path, f)):
            open(os.path.join(path, f, part), "wb").close()  # no Parquet any more: reading it would fail
    assert S.search(df, path, "box", buckets=16).count() == want == 5
    plan = S.postings(spark, path, ["box"], buckets=16)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "stem" in plan


def test_index_equals_a_plain_scan(spark):
    words = ["steel", "box", "boxes", "polished", "polish", "brushing", "brush", "the"]
    text = F.concat_ws(" ", *[F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3)) == 0, F.lit(w)) for i, w in enumerate(words)])
    df = spark.range(600).select(F.col("id").alias("item_id"), text.alias("item_name"), F.lit(None).cast("string").alias("description"))
    path = S.write_index(df, folder())
    got = {r.item_id for r in S.search(df, path, "boxed brushes").collect()}
    want = {r.item_id for r in df.collect() if {"box", "boxes"} & set(r.item_name.split()) and {"brush", "brushing"} & set(r.item_name.split())}
    assert got == want and 0 < len(want) < 600
