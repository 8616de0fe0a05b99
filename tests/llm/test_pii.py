import hashlib
import re

from shelfspark.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

TRICKY = [
    "mail a.b@c.de and x@y", "a@b.c_d@e.f", "a@b..c a@b.c.", "é@b.com ñu.x@dom.com", "1.2.3.4.5.6.7.8 and 999.1.1.1 0255.1.1.001",
    "4111 1111 1111 1111", "4111-1111-1111-1111-4", "card 4111 1111 1111 1112 no", "+1 (409) 555-8231", "+1+2 345-6789 12",
    "+1 2 ((( 3", "4995154084748072x", "10.0.0.1 4111111111111111 +49 30 1234567", "😀 a@b.co 😀 1.2.3.4 😀",
    "@@a@b.c@d.e", "1.2.3", "1..2.3.4.5", "+", "+12345678", "+1234567", "0" * 5000, "a" * 5000, "a@" * 1000, "1." * 2000,
    "x@" + "a." * 1500 + "b", "write to ann (at) example (dot) com now", "call 409-555-8231 please", "3782 822463 10005 amex card",
    "version 1.2.3.4 10.1.1.1", "+" + "1 " * 900, "1-" * 3000 + "1", "A1@B2.C3 a@b.c",
]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def base(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS]


def frame_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_match_plain_patterns(spark):
    rows = {r.doc_id: r for r in pii.find_personal_data(frame_of(spark, TRICKY)).collect()}
    for i, text in enumerate(TRICKY):
        want = base(text)
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want], text[:60]
        assert r.base_sha256 == hashlib.sha256(",".join(s for x in want for s in x).encode()).hexdigest(), text[:60]
        assert {s for x in want for s in x} <= set(r.spans.split(",")) | {""}


def test_wider_spans_are_added_and_clean_text_left_alone(spark):
    texts = [f"please write an e-mail to ann{i} (at) example (dot) com today" for i in range(5)]
    texts += [f"mail a{i}@example.com or call +1 (409) 555-82{i:02}" for i in range(30)] + ["nothing here at all"] * 5
    rows = {r.doc_id: r for r in pii.find_personal_data(frame_of(spark, texts)).collect()}
    assert all(rows[i].n_email == 0 and rows[i].spans.startswith("email:26:") for i in range(5))
    assert all(rows[i].spans == "" for i in range(35, 40))


def test_label_model_tells_good_from_bad():
    good, bad = (0, (1, 1, 1, 1, 1)), (0, (0, 0, 0, -1, 0))
    post = pii.label_model([(*good, 80), (*bad, 20)])
    assert post[0] > 0.9 and post[1] < 0.1
    w = pii.span_classifier([(*good, 80), (*bad, 20)], post)
    score = [sum(a * b for a, b in zip(w, pii.features(*x))) for x in (good, bad)]
    assert score[0] > 0 > score[1]


def test_redaction(spark, docs, empty):
    frame = spark.createDataFrame([(1, "mail a.b@c.de now 😀 1.2.3.4", 27, 9)], "doc_id long, text string, n_chars long, _spans int")
    r = pii.redact(frame).first()
    assert r.text == "mail <EMAIL> now 😀 <IP>" and r.n_chars == len(r.text) and r._spans == 9
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.find_personal_data(empty).count() == 0 and pii.redact(empty).count() == 0
    null = [r for r in pii.find_personal_data(docs).collect() if r.doc_id == 0][0]
    assert null.spans == "" and null.n_email == 0
