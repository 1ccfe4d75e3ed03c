import hashlib
import random
import re
from collections import Counter

import pytest

from shardloom.llm.pii import KINDS, mask_spans, op2

# The patterns as they are asked for.
ASKED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(ASKED[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "a@b.com_x@c.org", "a@b.com_x@c", "x" * 50 + "@y.z", "1.2.3.4.5.6.7.8", "0001.002.3.4 256.1.1.1 1.1.1.0000255 99999999999.1.1.1", "4539 1488 0343 6467 5  12", "4539-1488-0343-6467.",
    "+1 (988) 555-2485) +49(0)", "+123", "é😀 a@b.co 10.0.0.1", None, "", "   ", "@@@a@b@c.d.e", "1 2 3 4", "+1 2345 6789--", "%@-.-", "5 " * 40, "a@b.c." + "d." * 2000 + "e", "9" * 5000, "@" * 3000, "a.b-" * 4000,
]


def check(df, texts):
    got = df.collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        counts = Counter(k for k, *_ in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id][:100]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_base_spans(spark, tmp_path):
    r = random.Random(5)
    alphabet = list("01259 .-+@ab()_%é") + ["4539148803436467", " ", "10.1.", "@x.y"]
    texts = ODD + ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    check(op2(spark.read.parquet(f"{tmp_path}/t")), [t or "" for t in texts])


def test_patterns_find_unseen_identifiers(spark, tmp_path):
    r = random.Random(9)
    rows = [f"filler {r.random()} words call me at +1 555 {r.randrange(100, 999)} {r.randrange(1000, 9999)} tomorrow or never" for _ in range(200)]
    rows += [f"please call me at 555-{1000 + i} tomorrow" for i in range(5)]  # no base phone: too short, no plus
    rows += ["the year 1999-2000 was fine", "version 3.14159 at last"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    got = {x.doc_id: x for x in op2(spark.read.parquet(f"{tmp_path}/t")).collect()}
    for i in range(200, 205):
        at = rows[i].index("555-")
        assert got[i].spans == f"phone:{at}:{at + 8}" and got[i].n_phone == 0
    assert got[205].spans == got[206].spans == ""


def test_a_pattern_of_one_document_adds_nothing(spark, tmp_path):
    """Many instances in one text are no support for places in other texts."""
    listed = " ; ".join(f"reach us at +1 555 {100 + i} {1000 + i} anytime soon" for i in range(80))
    rows = [listed, "the record kept at reach us at 555-1234 anytime soon", "plain words only"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = {x.doc_id: x for x in op2(df).collect()}
    assert got[0].n_phone == 80 and got[1].spans == ""
    assert {x.doc_id: x.text for x in mask_spans(df).collect()}[1] == rows[1]


@pytest.mark.parametrize("which", ["documents", "nothing"])
def test_odd_rows(which, request, rows):
    df = request.getfixturevalue(which)
    out = op2(df)
    assert out.count() == df.count()
    masked = mask_spans(df)
    assert masked.columns == df.columns and masked.count() == df.count()


def test_mask(spark, tmp_path):
    spark.createDataFrame([(1, "é a@b.co, 10.0.0.1!", "k"), (2, None, "k"), (3, "plain", None), (3, "plain", None)], "doc_id long, text string, kind string").write.parquet(f"{tmp_path}/t")
    out = mask_spans(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert sorted(((r.doc_id, r.text, r["kind"]) for r in out), key=str) == sorted([(1, "é <EMAIL>, <IP>!", "k"), (2, None, "k"), (3, "plain", None), (3, "plain", None)], key=str)


def test_secrets_and_what_stands_where_they_do(spark, tmp_path):
    r = random.Random(3)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    rows = [f"{' ' * (i % 3)}word{i} api_token = \"{hexes(40)}\" more" for i in range(60)]
    rows += [f"api_token  =\n\"{'AKIA' + hexes(16).upper()}9\"!! more" for _ in range(3)]  # no seed: upper case
    rows += ["api_token = 12 more", f"digest {hexes(31)}", "x" * 300 + " api_token = Zz9" + "y" * 300]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = {x.doc_id: x.spans for x in op2(df).collect()}
    masked = {x.doc_id: x.text for x in mask_spans(df).collect()}
    for i in range(60):
        at = rows[i].index('"') + 1
        assert got[i] == f"secret:{at}:{at + 40}" and masked[i].endswith('api_token = "<SECRET>" more')
    for i in range(60, 63):
        at = rows[i].index("AKIA")
        assert got[i] == f"secret:{at}:{at + 21}"
    assert got[63] == got[64] == "" and got[65] == f"secret:{rows[65].index('Zz9')}:{len(rows[65])}"


def test_a_token_of_two_kinds_seeds_both(spark, tmp_path):
    """The same digits are a card and part of a phone number: neither kind hides the other."""
    rows = [f"call +1 555 {100 + i} {2000 + i} now" for i in range(30)] + [f"pay 4539148803436467 with +4539148803436467{i} now" for i in range(10)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    check(op2(spark.read.parquet(f"{tmp_path}/t")), rows)
    assert op2(spark.read.parquet(f"{tmp_path}/t")).count() == len(rows)


def test_masking_survives_other_splits(spark, tmp_path):
    """The second scan of the texts may be cut into other tasks than the first."""
    rows = [(i % 50, f"text {i} of a{i}@b.co and 10.0.0.{i % 250}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = mask_spans(spark.read.parquet(f"{tmp_path}/t"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = sorted((r.doc_id, r.text) for r in out.select("*").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((i % 50, f"text {i} of <EMAIL> and <IP>") for i in range(400))
