import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from legajo.llm import copies as c


def canon(x):
    m = re.split(r"([^\W\d_]+)[\"»']?\s*[:=]", x.lower())
    clean = lambda s: "".join(ch for ch in s if ch.isalnum())
    if len(m) > 1 and not clean(m[0]):
        return "\x1e".join(sorted(m[i] + "\x1f" + clean(m[i + 1]) for i in range(1, len(m), 2)))
    return clean(x.lower())


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        if t and canon(t):
            groups[canon(t)].append(k)
    return {(min(g), k) for g in groups.values() for k in g if k != min(g)}, {(min(g), len(g)) for g in groups.values()}


def test_against_brute_force_with_recursion_and_heavy_texts(spark):
    rng = random.Random(3)
    base = ["folio: 12; caja: ab", "[caja: ab]  [folio: 12]", "FOLIO=12 | CAJA=AB", '{"caja": "ab", "folio": "12"}', "Cosa uno", "cosa, uno", "uno cosa", "cósa uno", "", None, " … ", "x" * 200, "x" * 200 + "!", "hot", "HOT."]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(1000 + i, "hot") for i in range(200)] + [(2000 + i, f"registro {i % 40:05d} fin") for i in range(160)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "key long, text string, canon string")
    want, counts = brute(rows)
    for size in (25, 50_000):
        assert {tuple(r) for r in c.copies(df, "key", "text", size).collect()} == want
        assert {tuple(r) for r in c.collapsed(df, "key", "text", size).collect()} == counts


def test_buckets_stay_small_where_prefixes_are_few(spark, monkeypatch):
    monkeypatch.setattr(c, "MOST_SPLIT", 3)
    rng = random.Random(4)
    rows = [(i, f"registro {rng.randrange(900)}") for i in range(2000)] + [(5000 + i, "hot") for i in range(900)]
    df = spark.createDataFrame(rows, "key long, text string")
    want, counts = brute(rows)
    assert {tuple(r) for r in c.copies(df, "key", "text", 25).collect()} == want
    assert {tuple(r) for r in c.collapsed(df, "key", "text", 25).collect()} == counts
    at = c.partition(c._records(df, "key", "text"), 25).spread
    texts = at.groupBy("bucket", "share").agg(F.count_distinct("canon").alias("n"))  # one text is one path of a trie
    assert texts.agg(F.max("n")).first()[0] <= 50


def test_empty(spark):
    df = spark.createDataFrame([], "key long, text string")
    assert c.copies(df, "key", "text").count() == 0 and c.collapsed(df, "key", "text").count() == 0


def test_no_pair_is_left_out(spark):
    many = "a:1 " * 1_000_000
    df = spark.createDataFrame([(1, many + "b:1"), (2, many + "b:2"), (3, "b:1 " + many), (4, "uno"), (5, None)], "k long, text string")
    canon = {r["k"]: r["c"] for r in df.select("k", F.md5(c.canonical(F.col("text")).cast("binary")).alias("c")).collect()}
    assert canon[1] == canon[3] != canon[2] and canon[4] and canon[5] is None
