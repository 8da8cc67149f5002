import math
import random

import numpy as np
import pytest

from legajo.llm import durations
from legajo.llm import rank_summary as r

SCHEMA = "k string, x double, n string, v string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, x, "clash", "clash") for k, x in rows], SCHEMA).repartition(parts)


def test_exact_small_groups_and_odd_values(spark):
    rows = [("a", float(i)) for i in range(1, 11)] + [("a", None), ("a", math.nan), ("a", -1.0), (None, 5.0), ("b", 7.0), ("c", math.nan)]
    out = {x["k"]: x for x in r.percentiles(frame(spark, rows), ["k"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (out["a"]["n"], out["a"]["p50"], out["a"]["p95"]) == (11, 5.0, pytest.approx(9.5))
    below = r.percentiles(frame(spark, [("a", float(x)) for x in range(-50, 51)]), ["k"], "x", {"p50": 0.5}).first()
    assert (below["n"], below["p50"]) == (101, 0.0)
    assert out["b"]["p50"] == 7.0 and out[None]["n"] == 1 and "c" not in out


def test_bounds_hold_and_errors_stay_small(spark, monkeypatch):
    monkeypatch.setattr(r, "PIECE_ROWS", 500)
    rng = random.Random(1)
    values = [round(rng.lognormvariate(0, 2), 2) for _ in range(20_000)] + [3.0] * 5000
    bounds = r.quantile_bounds(r.summarise(frame(spark, [("a", v) for v in values], 8), ["k"], "x", 0.005), ["k"], {"p50": 0.5, "p95": 0.95}, 0.005).first()
    s = np.sort(values)
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        exact = float(np.quantile(s, p))
        assert bounds[f"{name}_lo"] <= exact <= bounds[f"{name}_hi"]
        lo, hi = np.searchsorted(s, [bounds[f"{name}_lo"], bounds[f"{name}_hi"]])
        assert hi - lo <= 0.04 * len(s) + 5000 * (name == "p50")


@pytest.mark.parametrize("buffer", [300, 1000, 5000])
def test_the_error_of_a_hot_key_is_bounded(spark, monkeypatch, buffer):
    """However often its pieces outgrow the buffer of a merging task."""
    monkeypatch.setattr(r, "PIECE_ROWS", 100)
    monkeypatch.setattr(r, "MERGE_TUPLES", buffer)
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.gauss(0, 9)) for i in range(60_000)]
    eps = 0.02
    one = {x["k"]: x for x in r.merge_summaries(r.summarise(frame(spark, rows, 5), ["k"], "x", eps / 4), ["k"], eps / 4).collect()}
    assert one["hot"]["n"] == 40_000 and one["hot"]["u"] <= eps * 40_000 and len(one) == 51
    out = {x["k"]: x["p"] for x in r.percentiles(frame(spark, rows, 5), ["k"], "x", {"p": 0.9}, eps).collect()}
    own = np.sort([x for k, x in rows if k == "hot"])
    assert abs(np.searchsorted(own, out["hot"]) - 36_000) <= eps * 40_000


def test_ratio_is_exact_in_the_end(spark):
    """Repeated values on either side of a percentile leave every bound open."""
    rows = [(f"g{g}", v) for g, high in enumerate((3.9, 4.0, 4.1, 8.0)) for v in [1.0] * 3000 + [high] * (158 + g % 2)] + [("neg", -4.0)] * 50
    got = {x["k"] for x in r.ratio_exceeds(frame(spark, rows), ["k"], "x", 0.95, 0.5, 4.0, 0.5, rounds=0).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert got == {k for k, v in by.items() if np.quantile(v, 0.95) > 4 * np.quantile(v, 0.5)}


def test_days_combine(spark):
    rows = [("a", float(i % 97)) for i in range(4000)]
    df = frame(spark, rows).selectExpr("k", "x", "cast(x % 3 as int) as day")
    days = r.merge_summaries(r.summarise(df, ["k", "day"], "x", 0.002), ["k", "day"], 0.002)
    whole = r.quantile_bounds(days, ["k"], {"m": 0.5}, 0.002).first()
    exact = float(np.quantile([x for _, x in rows], 0.5))
    assert whole["n"] == 4000 and whole["m_lo"] <= exact <= whole["m_hi"]


@pytest.mark.parametrize("eps", [0.005, 0.6])
def test_ratio_with_and_without_refinement(spark, eps):
    rng = random.Random(2)
    rows = [(f"g{g}", rng.lognormvariate(0, 0.4 + g * 0.1)) for g in range(4) for _ in range(200)] + [(None, 1.0)]
    got = {x["k"] for x in r.ratio_exceeds(frame(spark, rows), ["k"], "x", 0.95, 0.5, 4.0, eps, rounds=2).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert got == {k for k, v in by.items() if k and np.quantile(v, 0.95) > 4 * np.quantile(v, 0.5)}


def test_empty(spark):
    empty = frame(spark, [("a", 1.0)]).where("false")
    assert r.percentiles(empty, ["k"], "x", {"m": 0.5}).count() == 0
    assert r.ratio_exceeds(empty, ["k"], "x", 0.95, 0.5, 4.0).count() == 0


def test_the_whole_counts_rows_without_a_day(spark, tmp_path):
    for name, value, at in (("case_results", "duration_ms", "generated_at"), ("matrix_rows", "ocr_duration_ms", "measured_at"), ("pipeline_summaries", "p95_ms", "generated_at")):
        rows = [("r", "2026-01-01 10:00:00", 1.0), ("r", "2026-01-02 10:00:00", 2.0), ("r", None, 9.0), ("r", None, 9.0), ("r", None, None)]
        spark.createDataFrame(rows, f"run_id string, at string, {value} double").selectExpr("run_id", f"to_timestamp(at) as {at}", value).write.parquet(f"{tmp_path}/{name}.parquet")
    out = [r for r in durations.p1_daily_percentiles(spark, str(tmp_path)).collect() if r["field"] == "duration_ms"]
    assert {str(r["day"]): r["n"] for r in out} == {"2026-01-01": 1, "2026-01-02": 1, "None": 4} and len(out) == 3
    whole = next(r for r in out if r["day"] is None)
    assert whole["p95_lo"] <= 9.0 <= whole["p95_hi"]
