"""Mixing sources to target shares of tokens, by hash thresholds.

Every document has a fixed 63-bit hash.  A source whose budget is ``q`` whole
copies of itself plus a rest uses each document ``q`` times and those with a
hash under the source's threshold once more.  The threshold is found without
sorting: tokens are summed per source and leading hash bits, the bucket in
which the rest is used up is split by further bits, and so on until it holds a
single document.  Thresholds of smaller budgets come from the same sums, so
the documents of a smaller mix are among those of a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.llm.tokens import TOKENIZERS, count_tokens
from legajo.tables import cut, table

#: Bits that one pass of the histogram resolves, and of the whole hash.
STEP, BITS = 12, 60
#: Rows of a plan up to which it is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 20_000


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a few numbers per source) broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def wanted(targets: DataFrame) -> DataFrame:
    """One row (source, target_share, max_repeats) per source that is to
    contribute; null sources and shares or caps of nothing are left out."""
    kept = targets.where("source is not null and target_share > 0 and max_repeats > 0")
    return kept.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def plan_mix(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, copies, threshold)
    of each source of ``targets`` (see ``wanted``).

    ``sized``: source, n_tokens, h.  ``total``: tokens of the mix; by default
    the largest at which every source that has tokens reaches its share.  A
    larger ``total`` leaves scarce sources at their cap, and the reported
    shares show it.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    base = cut(targets.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))))
    able = F.col("available") > 0
    if total is None:
        total = base.where(able).agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share"))).first()[0] or 0.0
    base = base.withColumn("budget", F.when(able, F.least(F.col("target_share") * F.lit(float(total)), (F.col("max_repeats") * F.col("available")).cast("double"))).otherwise(0.0))
    base = base.withColumn("copies", F.when(able, F.floor(F.col("budget") / F.col("available"))).otherwise(0))
    base = base.withColumn("rest", F.col("budget") - F.col("copies") * F.col("available"))
    # the search: the source's boundary bucket so far, and the tokens still to take in it
    state = base.where(able & (F.col("rest") >= 0.5)).select("source", F.lit(0).cast("long").alias("prefix"), "rest")
    found: DataFrame | None = None
    for bits in range(0, BITS, STEP):
        last = bits + STEP >= BITS
        inside = sized.join(_small(state), "source").where(F.shiftright("h", BITS - bits) == F.col("prefix"))
        hist = inside.groupBy("source", "rest", F.shiftright("h", BITS - bits - STEP).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
        run = F.sum("t").over(Window.partitionBy("source").orderBy("b"))  # at most 2 ** STEP rows of a source
        at = hist.withColumn("run", run).groupBy("source").agg(F.min(F.when(F.col("run") >= F.col("rest"), F.struct("b", "t", "n", (F.col("rest") - F.col("run") + F.col("t")).alias("left")))).alias("m"), F.max("b").alias("end"))
        at = cut(at.select("source", "end", "m.*"))
        settled = F.col("b").isNull() | (F.col("n") == 1) | F.lit(last)
        edge = F.when(F.col("b").isNull(), F.col("end") + 1).otherwise(F.col("b") + (2 * F.col("left") > F.col("t")).cast("long"))
        done = at.where(settled).select("source", F.shiftleft(edge, BITS - bits - STEP).alias("threshold"))
        found = done if found is None else found.unionByName(done)
        state = at.where(~settled).select("source", F.col("b").alias("prefix"), F.col("left").alias("rest"))
        if last or not state.limit(1).count():
            break
    plan = base.join(found, "source", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))
    return cut(plan.select("source", "target_share", "max_repeats", "available", "budget", "copies", "threshold"))


def sized_documents(df: DataFrame, sources: DataFrame, seed: int, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, n_tokens, h of the documents of ``sources``; written to
    the shared folder, as every pass of the histogram reads it again."""
    kept = df.join(_small(sources.select("source").distinct()), "source", "left_semi")
    counted = count_tokens(kept, keep=("doc_id", "source"), folder=folder)
    return cut(counted.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - BITS)))


def mix(df: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, repeats) and its plan.

    Documents of null sources or of sources without target belong to no mix.
    Empty and null texts have no tokens and follow their source's threshold.
    """
    targets = wanted(targets)
    sized = sized_documents(df, targets, seed, folder)
    plan = plan_mix(sized, targets, total)
    repeats = F.col("copies") + (F.col("h") < F.col("threshold")).cast("int")
    mixed = sized.join(_small(plan.select("source", "copies", "threshold")), "source").select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"))
    return mixed.where("repeats > 0"), plan


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mix with the times it is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share aimed at and the share of the mix's tokens really
    reached, with documents and tokens used."""
    mixed, plan = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    rows = plan.join(used, "source", "left").withColumn("mixed_tokens", F.coalesce("t", F.lit(0)))
    whole = rows.agg(F.sum("mixed_tokens").alias("whole"))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(F.broadcast(whole)).select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), zero("documents"), zero("most_repeats"), "mixed_tokens", F.coalesce(F.try_divide("mixed_tokens", "whole"), F.lit(0.0)).alias("actual_share"))
