import os

import pytest
from pyspark.sql import functions as F

from legajo.llm import mixture as m
from legajo.llm import tokens as t

pytestmark = pytest.mark.skipif(not os.path.isdir(t.TOKENIZERS), reason="no vocabulary files")
TEXTS = ["", "a" * 3000, "ab" * 2000 + " " * 700 + "x", "  \n\n  a", "ñandú 漢字 😀😀", "don't I'll 123abc  ", "<|endoftext|>", "​" * 40, "-" * 400, "Según lo acordado, el informe.", "   ", "\x1c\x85 　x"]


def reference(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(os.path.join(t.TOKENIZERS, "byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library(spark):
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(99, None, "clash"), (3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted((r["doc_id"], list(r["ids"])) for r in t.encode(df).collect())
    want = sorted([*enumerate(reference(TEXTS)), (99, []), (3, reference(TEXTS)[3])])
    assert out == want
    counted = {r["doc_id"]: r["n_tokens"] for r in t.count_tokens(df).collect()}
    assert counted == {d: len(ids) for d, ids in want}
    assert t.encode(df.where("false")).count() == 0


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr(t, "STORE", 3)
    model = t.BytePairs()
    for text, want in zip(TEXTS, reference(TEXTS)):
        ids, n = model.encode([text])
        assert ids.tolist() == want and n.tolist() == [len(want)]


def test_mix_matches_thresholds_by_sorting(spark):
    rows = [(i, "palabra " * (1 + i % 13), "abc"[i % 3] if i % 7 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed, plans = m.mix(df, targets, total=3000.0)
    got = {r["doc_id"]: r["repeats"] for r in mixed.collect()}
    sized = m.sized_documents(df, targets, 17).collect()
    by = {p.source: p for p in plans.collect()}
    for s in "abc":
        own = sorted((r["h"], r["doc_id"], r["n_tokens"]) for r in sized if r["source"] == s)
        p = by[s]
        budget = min(p.target_share * 3000, p.max_repeats * p.available)
        used = sum(n * got.get(d, 0) for _, d, n in own)
        assert abs(used - budget) <= 30 and max(got.get(d, 0) for _, d, _ in own) <= p.max_repeats
        extra = [got.get(d, 0) > p.copies for _, d, _ in own]
        assert extra == sorted(extra, reverse=True)  # exactly a prefix in hash order
    assert by["gone"].available == 0 and all(r["source"] is not None for r in mixed.collect())
    small, _ = m.mix(df, targets, total=600.0)
    assert {r["doc_id"] for r in small.collect()} <= set(got)  # nested


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert m.mix(df, targets)[0].count() == 0


@pytest.mark.parametrize("most", [5, 20_000])
def test_many_sources(spark, monkeypatch, most):
    monkeypatch.setattr(m, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([(i, "palabra " * (1 + i % 5), f"s{i % 1200}") for i in range(3600)], "doc_id long, text string, source string")
    many = spark.range(1300).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1 / 1300).alias("target_share"), F.lit(1).alias("max_repeats"))
    mixed, plan = m.mix(df, many)
    assert plan.count() == 1300 and plan.where("available > 0 and abs(budget - 3) < 12").count() == 1200
    assert 0 < mixed.count() <= 3600 and mixed.where("repeats > 1").count() == 0
