"""Reading order, lines and blocks of positioned words.

Words are rows (doc, page, block, paragraph, line, word_no, text, confidence,
left, top, width, height).  A page is the unit that a task must hold together;
pages are small whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.quality import field_like, heading_like

LINE = ("doc", "page", "block", "paragraph", "line")


def word_lines(words: DataFrame) -> DataFrame:
    """One row per line: words joined from left to right (ties by word number),
    with the box that encloses them and their mean confidence (-1 included)."""
    box = [F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height")]
    ordered = F.array_sort(F.collect_list(F.struct("left", "word_no", "text")))
    return words.groupBy(*LINE).agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), *box, F.avg("confidence").alias("mean_confidence"), F.count("*").alias("words"))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines numbered by page, top, left, block, paragraph, line."""
    order = Window.partitionBy("doc", "page").orderBy("top", "left", "block", "paragraph", "line")
    return lines.withColumn("reading_no", F.row_number().over(order))


def layout_blocks(lines: DataFrame) -> DataFrame:
    """Lines with ``layout_block``: a new block begins after a vertical gap, a
    shift to the left or right between lines of unlike width, beside headings
    and fields, and where the recogniser's block or paragraph changes.  The
    line before is always the one just before, so ``lag`` decides.  Distances
    are in upper medians (``sorted[n // 2]``) of the heights of all lines of the
    document, at least 1."""
    order = Window.partitionBy("doc", "page").orderBy("reading_no")
    heights = F.array_sort(F.collect_list("height").over(Window.partitionBy("doc")))
    median = F.greatest(F.lit(1.0), F.element_at(heights, F.floor(F.size(heights) / 2).cast("int") + 1))
    special = (heading_like(F.col("text")) & (F.col("width") > 0)) | field_like(F.col("text"))
    staged = reading_order(lines.withColumns({"median_height": median, "special": special}))
    prev = F.lag(F.struct("left", "top", "width", "height", "special", "block", "paragraph")).over(order)
    staged = staged.withColumn("p", prev)
    gap = F.col("top") - (F.col("p.top") + F.col("p.height")) > 1.1 * F.col("median_height")
    shifted = (F.abs(F.col("left") - F.col("p.left")) > 2.5 * F.col("median_height")) & (F.least("width", "p.width") < 0.85 * F.greatest("width", "p.width"))
    new = F.col("p").isNull() | gap | shifted | F.col("special") | F.col("p.special") | (F.col("block") != F.col("p.block")) | (F.col("paragraph") != F.col("p.paragraph"))
    staged = staged.withColumn("new", new.cast("int"))
    return staged.withColumn("layout_block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("p", "new")


def block_rows(lines: DataFrame) -> DataFrame:
    """One row per block: its text in reading order, its box and the mean
    confidence over its words."""
    own = layout_blocks(lines).groupBy("doc", "page", "layout_block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_no", "text"))), lambda x: x["text"]), "\n")
    return own.agg(text.alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"), (F.sum(F.col("mean_confidence") * F.col("words")) / F.sum("words")).alias("mean_confidence"), F.count("*").alias("lines"))


def region_groups(regions: DataFrame) -> DataFrame:
    """Detected regions (doc, region_no, left, top, width, height) grouped into
    text lines: (doc, region_no, group_no).

    Regions are taken by centre from top to bottom; each joins the nearest
    group whose running mean centre is no further than the tolerance
    ``max(20, 0.45 * median of the positive heights)`` (the first of equally near
    ones), else founds one.  The mean moves with
    every member, so the rule is sequential within a document: a grouped map.
    """
    import pandas as pd

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cy=pdf.top + pdf.height / 2, cx=pdf.left + pdf.width / 2).sort_values(["cy", "cx", "region_no"])
        heights = pdf.height[pdf.height > 0]
        tolerance = max(20.0, 0.45 * float(heights.median())) if len(heights) else 20.0
        means: list[float] = []
        sizes: list[int] = []
        own = []
        for cy in pdf.cy:
            gaps = [abs(cy - m) for m in means]
            at = min(range(len(gaps)), key=gaps.__getitem__, default=-1)
            if at < 0 or gaps[at] > tolerance:
                means.append(cy)
                sizes.append(1)
                at = len(means) - 1
            else:
                sizes[at] += 1
                means[at] += (cy - means[at]) / sizes[at]
            own.append(at)
        place = {g: n + 1 for n, g in enumerate(sorted(range(len(means)), key=lambda g: means[g]))}
        return pd.DataFrame({"doc": pdf.doc, "region_no": pdf.region_no, "group_no": [place[g] for g in own]})

    return regions.groupBy("doc").applyInPandas(group, "doc long, region_no long, group_no long")


def ink_bands(rows: DataFrame, keys: list[str], window: Column, least: Column, max_gap: Column, min_run: int, min_ink: float, min_width: float, min_height: int) -> DataFrame:
    """Bands of text (keys.., y0, y1 exclusive, ink, width) in the ink of image
    rows (keys.., row_no, ink, x0, x1; a row per number).

    Rows count whose moving average over ``window`` rows (3, 5 or 7) is at least
    ``least``; of their runs those of ``min_run`` rows stay; runs no more than
    ``max_gap`` apart are one band; bands of little ink, width or height go.
    ``window``, ``least`` and ``max_gap`` may be columns, so that a whole grid of
    parameters is searched at once, as further keys."""
    order = Window.partitionBy(*keys).orderBy("row_no")
    mean = lambda k: F.sum("ink").over(order.rangeBetween(-k, k)) / (2 * k + 1)
    smooth = F.when(window == 3, mean(1)).when(window == 5, mean(2)).otherwise(mean(3))
    active = rows.withColumn("__s", smooth).where(F.col("__s") >= least).withColumn("__run", F.col("row_no") - F.row_number().over(order))
    carried = [F.first(max_gap).alias("__gap")]
    runs = active.groupBy(*keys, "__run").agg(F.min("row_no").alias("y0"), (F.max("row_no") + 1).alias("y1"), *carried).where(F.col("y1") - F.col("y0") >= min_run)
    by_place = Window.partitionBy(*keys).orderBy("y0")
    apart = F.coalesce(F.col("y0") - F.lag("y1").over(by_place) > F.col("__gap"), F.lit(True))
    bands = runs.withColumn("__new", apart.cast("int")).withColumn("__band", F.sum("__new").over(by_place)).groupBy(*keys, "__band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    inside = bands.alias("b").join(rows.alias("r"), [F.col(f"b.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("r.row_no") >= F.col("b.y0"), F.col("r.row_no") < F.col("b.y1"), F.col("r.ink") > 0])
    sized = inside.groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1")).agg(F.sum("r.ink").alias("ink"), (F.max("r.x1") - F.min("r.x0")).alias("width"))
    return sized.where((F.col("ink") >= min_ink) & (F.col("width") >= min_width) & (F.col("y1") - F.col("y0") >= min_height))


def best_parameters(bands: DataFrame, key: str, grid: list[str], expected: DataFrame) -> DataFrame:
    """(key, grid.., score) of the parameters that give the expected number of
    bands (key, expected) with the most even heights, the sum of their distances
    from the averaging median; the first of the grid wins ties."""
    heights = F.collect_list((F.col("y1") - F.col("y0")).cast("double"))
    own = bands.groupBy(key, *grid).agg(heights.alias("h"), F.median(F.col("y1") - F.col("y0")).alias("m"))
    scored = own.withColumn("score", F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("m")))).withColumn("n", F.size("h"))
    fitting = scored.join(expected, key).where(F.col("n") == F.col("expected"))
    return fitting.groupBy(key).agg(F.min(F.struct("score", *grid)).alias("b")).select(key, *[f"b.{g}" for g in grid], "b.score")
