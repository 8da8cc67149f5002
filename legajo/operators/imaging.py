"""Page images as rows of grey values, and the skew search over ink tables.

Decoding is left to an adapter: an image is (doc, width, height, pixels) with
one byte per pixel.  The filters run in Arrow batches, one image at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.sources.files import MAX_PIXELS


def _normalise(a):
    import numpy as np

    lo, hi = np.percentile(a, 1), np.percentile(a, 99)
    return np.clip((a - lo) * 255.0 / max(hi - lo, 1), 0, 255)


def _neighbours(a):
    import numpy as np

    p = np.pad(a, 1, mode="edge")
    return np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)])


def _median(a):
    import numpy as np

    return np.median(_neighbours(a), axis=0)


def _sharpen(a):
    import numpy as np

    return np.clip(a + (a - _neighbours(a).mean(axis=0)), 0, 255)


def _threshold(limit):
    return lambda a: (a >= limit) * 255.0


#: Named chains of filters.
STRATEGIES = {
    "none": [], "grayscale": [], "grayscale-normalize": [_normalise], "threshold-180": [_threshold(180)], "threshold-200": [_threshold(200)], "median": [_median], "sharpen": [_sharpen],
    "normalize-sharpen": [_normalise, _sharpen], "median-normalize": [_median, _normalise], "normalize-threshold-180": [_normalise, _threshold(180)],
}


def preprocess(images: DataFrame, strategy: str) -> DataFrame:
    """``images`` after the named chain; the size is unchanged.  Images without
    pixels, of no size or of more than ``MAX_PIXELS`` are left out."""
    chain = STRATEGIES[strategy]
    good = images.where(f"width > 0 and height > 0 and width * height <= {MAX_PIXELS} and length(pixels) = width * height").select("doc", "width", "height", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out = []
            for w, h, px in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                a = np.frombuffer(px, dtype=np.uint8).reshape(h, w).astype(float)
                for f in chain:
                    a = f(a)
                out.append(np.rint(a).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["doc", "width", "height", "pixels"])

    return good.mapInArrow(run, good.schema)


def row_ink(images: DataFrame) -> DataFrame:
    """(doc, row_no, ink): dark pixels of each image row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for d, w, h, px in zip(*(c.to_pylist() for c in b.columns)):
                ink = (np.frombuffer(px, dtype=np.uint8).reshape(h, w) < 128).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([d] * h, pa.int64()), pa.array(range(h), pa.int32()), pa.array(ink, pa.int64())], names=["doc", "row_no", "ink"])

    return images.select("doc", "width", "height", "pixels").mapInArrow(run, "doc long, row_no int, ink long")


def best_angle(ink: DataFrame) -> DataFrame:
    """(doc, angle, variance) of the angle whose row ink varies most; the
    smaller angle wins ties.  ``ink``: doc, angle, row_no, ink."""
    each = ink.groupBy("doc", "angle").agg(F.round(F.var_pop("ink"), 6).alias("variance"))
    top = each.groupBy("doc").agg(F.max(F.struct("variance", (-F.col("angle")).alias("n"))).alias("m"))
    return top.select("doc", (-F.col("m.n")).alias("angle"), F.col("m.variance").alias("variance"))


#: Generator of the noise, share of pixels it hits, the values it sets.
SEED, FACTOR, STEP, HIT, DARK, LIGHT = 0x1A2B3C4D, 1664525, 1013904223, 0.018, 35, 220


def _draws(n: int, seed: int):
    """The first ``n`` numbers of the linear congruential generator, in [0, 1]:
    powers of the factor by wrapping products, so no loop runs over pixels."""
    import numpy as np

    power = np.cumprod(np.full(n, FACTOR, dtype=np.uint32), dtype=np.uint32)
    shift = np.cumsum(np.r_[np.uint32(1), power[:-1]], dtype=np.uint32) * np.uint32(STEP)
    return (power * np.uint32(seed) + shift).astype(np.float64) / 0xFFFFFFFF


def noisy(pixels, seed: int = SEED, hit: float = HIT):
    """Grey values with the same salt and pepper every time.  A pixel takes one
    draw, and a second one where it is hit."""
    import numpy as np

    out = pixels.copy().ravel()
    u = _draws(2 * len(out) + 2, seed) if len(out) else np.zeros(0)
    draw = pixel = 0
    for h in np.flatnonzero(u < hit):
        if h < draw:
            continue  # used up as the second draw of the hit before
        pixel += int(h) - draw
        if pixel >= len(out):
            break
        out[pixel] = DARK if u[h + 1] < 0.5 else LIGHT
        pixel, draw = pixel + 1, int(h) + 2
    return out.reshape(pixels.shape)


#: Widest image analysed, range and steps of the search in degrees,
#: what is left alone, what must be confirmed and how closely.
ANALYSED, RANGE, COARSE, FINE, LEAST, EXTREME, AGREE = 700, 10.0, 1.0, 0.25, 0.5, 9.5, 2.0


def _variance(ys, xs, ink, angle: float) -> float:
    """Variance of the ink of image rows after turning by ``angle``: only dark
    pixels are moved."""
    import numpy as np

    turn = np.deg2rad(angle)
    row = np.rint(xs * np.sin(turn) + ys * np.cos(turn)).astype(int)
    return float(np.bincount(row - row.min(), weights=ink).var()) if len(row) else 0.0


def _search(a) -> float:
    import numpy as np

    step = max(1, -(-a.shape[1] // ANALYSED))
    a = a[::step, ::step]
    ys, xs = np.nonzero(a < 255)
    ink = 255.0 - a[ys, xs]
    score = lambda angle: _variance(ys, xs, ink, angle)
    coarse = max(np.arange(-RANGE, RANGE + COARSE / 2, COARSE), key=score)  # the first of equals
    fine = [x for x in np.arange(coarse - COARSE, coarse + COARSE + FINE / 2, FINE) if abs(x) <= RANGE]
    return float(max(fine, key=score))


def skew(a) -> tuple[float, str]:
    """(angle, verdict) of one grey image: ``none`` under half a degree,
    ``rejected`` where the edges do not confirm an extreme angle, else ``turn``."""
    import numpy as np

    if a.size == 0 or (a == 255).all():
        return 0.0, "none"
    angle = _search(a)
    if abs(angle) >= EXTREME:
        p = np.pad(a, 1, mode="edge")
        low, high = p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:], p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]
        edges = 255.0 - np.clip(high - low, 0, 255)
        if (edges == 255).all() or abs(_search(edges) - angle) > AGREE:
            return angle, "rejected"
    return (angle, "turn") if abs(angle) >= LEAST else (angle, "none")


def skew_angles(images: DataFrame) -> DataFrame:
    """(doc, angle, verdict) of each image (doc, width, height, pixels); images
    without pixels or of no size are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            found = [skew(np.frombuffer(px, dtype=np.uint8).reshape(h, w).astype(float)) for w, h, px in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([v for _, v in found], pa.string())], names=["doc", "angle", "verdict"])

    good = images.where(f"width > 0 and height > 0 and width * height <= {MAX_PIXELS} and length(pixels) = width * height").select(F.col("doc").cast("long").alias("doc"), "width", "height", "pixels")
    return good.mapInArrow(run, "doc long, angle double, verdict string")
