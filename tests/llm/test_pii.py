"""Personal data (7): base spans against plain patterns, discovered spans, edge cases."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from typeloom.llm import pii

SCHEMA = "doc_id long, text string, email string, key string, more string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PLAIN.items()}


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])


def check(rows, got):
    by = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        base, r = spans(text), by[doc_id]
        assert [r[f"n_{k}"] for k in PLAIN] == [len(base[k]) for k in PLAIN], text
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        own = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{a}:{b}" for k in PLAIN for a, b in base[k]} <= set(own)
        assert own == sorted(own, key=lambda s: (list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])))


HARD = [
    "a@b.c%d@e.f a@b-c_d@e.f x@y a@@b.c .@-.-", "999.1.1.1.1 1.2.3.4.5.6.7.8 01.002.0255.0 256.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-11111 4111  1111 1111 1111 4111111111111111", "+1 (555) 123-4567 +41 49 ++49 123 456 789 +1(2.3 +123456789012345678",
    "\x01 x@y.zé \U0001f600 q@r.st \x02+49 123 456 789\x01", "", None, "4" * 40, "1 " * 300, "+1" * 50, "a" * 100_000 + "@b.co", "1" * 50_000, "a@b." * 200, ("12-" * 9 + "x ") * 50,
]


def test_hard_texts(spark):
    rows = list(enumerate(HARD))
    check(rows, pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@given(st.lists(st.text(alphabet="0123456789.@+- ()ab\n", max_size=60), min_size=30, max_size=30))
@settings(max_examples=3, deadline=None)
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    check(rows, pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], pii.personal_data(docs).collect())


def test_contexts_find_more(spark):
    """Phone numbers without a plus are found after the word that numbers with one follow; others are left alone."""
    rows = [(i, f"hello there phone: +49 30 1234{i:03d} bye") for i in range(20)]
    rows += [(100, "my phone: 030/1234567 and the order 99887766 too"), (101, "the value 123456789 is fine"), (102, "call 030/1234567 now")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["spans"] == "phone:10:21" and got[100]["n_phone"] == 0 and got[101]["spans"] == ""
    assert got[102]["spans"] == "phone:5:16"  # the instance is known by then


def test_groups_of_digits_long_cues_and_secrets(spark):
    rows = [(i, f"telefon: +49 30 1234{i:03d} bye") for i in range(20)] + [(50, "telefon: 0171 555 0199, please"), (51, "0171 555 0177 is a number")]
    word = "x" * 200
    rows += [(100 + i, f"a {word}\t+49 40 9876{i:03d} b") for i in range(5)] + [(110, f"a {word} 040-9876543 b"), (111, f"a y{word} 040-9876599 b")]
    key = "0123456789abcdef" * 2
    rows += [(200 + i, f'token = "{key}{i:02x}" rest') for i in range(5)] + [(210, f"{key.upper()} {'a' * 40} {'7' * 40}"), (211, "token = A1b2C3d4E5f6G7 and A9b8C7d6E5")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50]["spans"] == "phone:9:22" and got[51]["spans"] == "" and got[50]["n_spans"] == 1
    assert got[110]["spans"] == "phone:203:214" and got[111]["spans"] == ""
    assert all(got[200 + i]["secret_spans"] == "secret:9:43" and got[200 + i]["spans"] == "" and got[200 + i]["n_secret"] == 1 and got[200 + i]["n_card"] == 0 for i in range(5))
    assert got[210]["n_spans"] == 0 and got[211]["secret_spans"] == "secret:8:22" and got[211]["spans"] == ""


def test_chains_go_on_until_nothing_is_added(spark):
    """Each word leads to numbers that the next word stands before."""
    rows, i = [(k, f"cuea +49 30 555{k:04d} x") for k in range(5)], 100
    for step in range(6):
        for k in range(3):
            rows += [(i, f"cue{chr(97 + step)} {k}{step}/4445566 x"), (i + 1, f"cue{chr(98 + step)} {k}{step}/4445566 x")]
            i += 2
    rows.append((i, "cueg 99/1112223 x"))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[i] == "phone:5:15"


def test_edges(spark):
    rows = [(1, None, "e", "k", "m"), (2, "", "e", "k", "m"), (3, "a@b.c", "e", "k", "m"), (3, "a@b.c", "e", "k", "m"), (None, "1.2.3.4", "e", "k", "m")]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", ""), ("2", ""), ("3", "email:0:5"), ("3", "email:0:5"), ("None", "ip:0:7")]
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.base_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_added_spans_end_where_the_value_ends(spark):
    rows = [(i, f"phone: +49 30 1234{i:03d} bye") for i in range(20)]
    rows += [(100, 'phone: "030/1234567"!! bye'), (101, "phone: (030/1234568), bye"), (102, "phone: (030) 1234569. bye"), (103, "phone: '<0301234570>;' bye"), (104, 'phone: """!!! 123'), (105, "phone: \U0001f600 é ['030-1234571']?")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = {100: "030/1234567", 101: "030/1234568", 102: "(030) 1234569", 103: "0301234570", 104: ""}
    for i, value in wanted.items():
        at = rows[20 + i - 100][1].find(value)
        assert got[i]["spans"] == (f"phone:{at}:{at + len(value)}" if value else ""), i
    assert got[105]["spans"] == ""  # the word before is another one
