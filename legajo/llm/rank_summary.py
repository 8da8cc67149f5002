"""Percentiles of very large numeric columns with a bounded rank error.

A summary of a multiset is a list of tuples ``(v, g, d)`` ordered by ``v``.
With ``rmin(i) = g_1 + .. + g_i`` and ``rmax(i) = rmin(i) + d_i`` the rank of
``v_i`` lies in ``[rmin, rmax]``.  A piece that was never compressed holds each
value once with ``g = 1, d = 0`` and is exact.  Pieces are built per partition,
merged in two levels (first by key and salt, then by key), and after each merge
adjacent tuples are joined as far as the permitted uncertainty of that level
allows.  ``u``, the widest rank interval of a piece, is carried along, so the
accumulated error is known and never assumed.

A key whose pieces exceed a task's buffer is merged as a tree: two pieces of
one level make one of the next, and level ``i`` may widen intervals only by the
``1 / (2 i (i + 1))``-th part of the stage's uncertainty, so that all levels
together stay within half of it, however many there are, and the closing merge
within the other half.

Pieces are ordinary rows (keys, n, u, lists), so those of separate days or
files can be stored and combined later with ``merge_summaries``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from legajo.tables import cut

#: Rows gathered in a task before a piece is made of them.
PIECE_ROWS = 1 << 20
#: Tuples gathered in a merging task before they are merged.
MERGE_TUPLES = 1 << 20
#: Groups of the first merging level per key.
SALTS = 16

_PIECE = [
    StructField("n", LongType()),
    StructField("u", LongType()),
    StructField("v", ArrayType(DoubleType())),
    StructField("g", ArrayType(LongType())),
    StructField("d", ArrayType(LongType())),
]


def _codes(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each row, first row of each group); nulls form a group."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        column = table.column(k).combine_chunks()
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (int(own.max(initial=0)) + 1) + own
        _, code = np.unique(code, return_inverse=True)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse, first


def _starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)


def compress(k, v, g, d, eps: float):
    """Join neighbouring tuples of each key (sorted by key, value) whose joint
    rank range stays within ``eps * n``.  First and last tuples are kept."""
    if not len(k):
        return k, v, g, d
    s = _starts(k)
    length = np.diff(np.r_[s, len(k)])
    total = np.add.reduceat(g, s)
    width = np.maximum(1, np.floor(eps * total)).astype(np.int64)
    width[length <= 2 / eps] = 1
    run = np.cumsum(g)
    rmin = run - np.repeat(run[s] - g[s], length)
    bucket = (rmin - 1) // np.repeat(width, length)
    last = np.r_[(bucket[1:] != bucket[:-1]) | (k[1:] != k[:-1]), True]
    last |= np.repeat(width == 1, length)
    last[s] = True
    at = np.flatnonzero(last)
    kept = rmin[at]
    new = _starts(k[at])
    g2 = np.diff(np.r_[0, kept])
    g2[new] = kept[new]
    return k[at], v[at], g2, d[at]


def merge(k, piece, v, g, d, u_piece):
    """Merge the pieces of each key: tuples sorted by key and value, each
    tuple's ``d`` widened by the uncertainty of the key's other pieces.

    ``piece`` numbers the piece of each tuple, ``u_piece`` its width."""
    if not len(k):
        return k, v, g, d
    key_of = np.zeros(len(u_piece), dtype=np.int64)
    key_of[piece] = k
    u_key = np.bincount(key_of, weights=u_piece, minlength=int(k.max()) + 1).astype(np.int64)
    wide = d + u_key[k] - u_piece[piece]
    order = np.lexsort((v, k))
    return k[order], v[order], g[order], wide[order]


def _emit(head: pa.Table, k, v, g, d, schema: pa.Schema) -> pa.RecordBatch:
    """One row per key; ``head`` has the key columns of keys 0..len-1."""
    s = _starts(k)
    n = np.add.reduceat(g, s) if len(s) else np.zeros(0, dtype=np.int64)
    u = np.maximum.reduceat(g + d - 1, s) if len(s) else n
    off = pa.array(np.r_[s, len(k)].astype(np.int32))
    exact = u == 0
    # exact pieces carry no g and d
    keep = ~np.repeat(exact, np.diff(np.r_[s, len(k)]))
    short = np.where(exact, 0, np.diff(np.r_[s, len(k)]))
    off2 = pa.array(np.r_[0, np.cumsum(short)].astype(np.int32))
    arrays = [head.column(c).combine_chunks() for c in head.column_names] + [
        pa.array(n), pa.array(u),
        pa.ListArray.from_arrays(off, pa.array(v)),
        pa.ListArray.from_arrays(off2, pa.array(g[keep])),
        pa.ListArray.from_arrays(off2, pa.array(d[keep])),
    ]
    return pa.Table.from_arrays(arrays, names=schema.names).cast(schema).combine_chunks().to_batches()


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def summarise(df: DataFrame, keys: Sequence[str], value: str, eps: float) -> DataFrame:
    """Pieces of ``value`` per ``keys``, made where the rows lie (no shuffle).

    Null and NaN values don't count; a null key is a key like any
    other; an empty input gives no rows.  Other columns are ignored.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    schema = StructType([rows.schema[k] for k in keys] + _PIECE)
    target = _arrow_schema(schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            t = pa.Table.from_batches(held)
            k, first = _codes(t, keys)
            v = t.column("__x").to_numpy()
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            one = np.ones(len(v), dtype=np.int64)
            yield from _emit(t.select(list(keys)).take(pa.array(first)), *compress(k, v, one, one - 1, eps), target)

        held, count = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= PIECE_ROWS:
                yield from flush(held)
                held, count = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(pieces, schema)


def _merge_stage(pieces: DataFrame, keys: Sequence[str], eps: float, finish=None, finished: StructType | None = None) -> DataFrame:
    """Merge pieces that lie together and are sorted by ``keys``.  A key whose
    pieces exceed the buffer is merged and compressed on the way."""
    schema = StructType([pieces.schema[k] for k in keys] + _PIECE)
    target = _arrow_schema(schema)
    result = finished or schema

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(held: list[pa.Table], own: float = eps / 2):
            t = pa.concat_tables(held)
            k_row, first = _codes(t, keys)
            lists = [t.column(c).combine_chunks() for c in ("v", "g", "d")]
            length = np.diff(lists[0].offsets.to_numpy())
            v = lists[0].flatten().to_numpy()
            u = t.column("u").to_numpy().astype(np.int64)
            exact = np.repeat(u == 0, length)
            g, d = np.ones(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
            g[~exact], d[~exact] = lists[1].flatten().to_numpy(), lists[2].flatten().to_numpy()
            piece = np.repeat(np.arange(t.num_rows), length)
            k, v, g, d = merge(k_row[piece], piece, v, g, d, u)
            return t.select(list(keys)).take(pa.array(first)), compress(k, v, g, d, own)

        def out(head, tuples):
            if finish is None:
                yield from _emit(head, *tuples, target)
            else:
                yield from finish(head, *tuples)

        held: list[pa.Table] = []
        tree: list[tuple[int, pa.Table]] = []  # (level, piece) of the key that goes on, levels falling
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(schema.names).cast(target)
            held.append(t)
            count += len(t.column("v").combine_chunks().flatten())
            if count < MERGE_TUPLES:
                continue
            t = pa.concat_tables([*(x for _, x in tree), *held]).combine_chunks()
            code, _ = _codes(t, keys)
            cut_at = len(code) - int(np.argmax((code != code[-1])[::-1])) if (code != code[-1]).any() else 0
            if cut_at:  # the key of the tree is among those that are complete
                yield from out(*join([t.slice(0, cut_at)]))
                tree, held = [], [t.slice(cut_at)]
            level, piece = 1, pa.concat_tables(held)
            while True:
                head, tuples = join([piece], eps / (2 * level * (level + 1)))
                piece = pa.Table.from_batches(_emit(head, *tuples, target))
                if not tree or tree[-1][0] != level:
                    break
                piece = pa.concat_tables([tree.pop()[1], piece])
                level += 1
            tree.append((level, piece))
            held, count = [], 0
        if held or tree:
            yield from out(*join([*(x for _, x in tree), *held]))

    return pieces.mapInArrow(merged, result)


def merge_summaries(pieces: DataFrame, keys: Sequence[str], eps: float, finish=None, finished: StructType | None = None) -> DataFrame:
    """One piece per key from any number of pieces, of any days or files, each
    of the two levels adding an uncertainty of at most ``eps * n``.

    Keys not in ``keys`` are dropped, so daily pieces combine to those of the
    whole.  Level one spreads the pieces of a hot key over ``SALTS`` tasks.
    """
    named = [F.col(k) for k in keys]
    salted = (
        pieces.select(*keys, "n", "u", "v", "g", "d", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__salt"))
        .repartition(*named, "__salt").sortWithinPartitions(*keys, "__salt")
    )
    level = _merge_stage(salted, [*keys, "__salt"], eps)
    together = level.drop("__salt").repartition(*named).sortWithinPartitions(*keys)
    return _merge_stage(together, keys, eps, finish, finished)


def _finisher(schema: StructType, probs: Sequence[float]):
    target = _arrow_schema(schema)

    def finish(head: pa.Table, k, v, g, d):
        s = _starts(k)
        e = np.r_[s[1:], len(k)]
        rows = []
        for a, b in zip(s, e):
            rmin = np.cumsum(g[a:b])
            rmax, vs, n = rmin + d[a:b], v[a:b], int(rmin[-1])
            rmax_up = np.maximum.accumulate(rmax)
            row = [n]
            for p in probs:
                h = (n - 1) * p
                r = int(np.floor(h)) + 1
                w = h - (r - 1)
                low, high = [], []
                for x in (r, min(n, r + 1)):
                    i = int(np.searchsorted(rmin, x))
                    j = int(np.searchsorted(rmax_up, x, side="right")) - 1
                    high.append(vs[i])
                    low.append(vs[max(j, 0)])
                lo, hi = low[0] + w * (low[1] - low[0]), high[0] + w * (high[1] - high[0])
                row += [lo, hi, low[0], high[1], r]
            rows.append(row)
        columns = list(zip(*rows)) if rows else [[] for _ in range(1 + 5 * len(probs))]
        arrays = [head.column(c).combine_chunks() for c in head.column_names] + [pa.array(c) for c in columns]
        yield from pa.Table.from_arrays(arrays, names=target.names).cast(target).combine_chunks().to_batches()

    return finish


def quantile_bounds(pieces: DataFrame, keys: Sequence[str], probs: dict[str, float], eps: float) -> DataFrame:
    """Per key ``n`` and, for each named probability, ``<name>_lo`` and
    ``<name>_hi`` between which the linearly interpolated percentile certainly
    lies (equal where the summary is exact), and the values ``_from``/``_to``
    and rank ``_rank`` that a refining pass needs."""
    fields = [StructField("n", LongType())]
    for name in probs:
        fields += [StructField(f"{name}_{x}", DoubleType()) for x in ("lo", "hi", "from", "to")] + [StructField(f"{name}_rank", LongType())]
    schema = StructType([pieces.schema[k] for k in keys] + fields)
    return merge_summaries(pieces, keys, eps, _finisher(schema, list(probs.values())), schema)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], eps: float = 0.005) -> DataFrame:
    """Estimated percentiles per key: columns ``keys``, ``n``, and per name the
    midpoint of its certain bounds.  Null and NaN values don't count, negative
    ones do.  The rank error is at most ``eps * n``: a quarter of it each for the
    pieces and the two merging levels."""
    bounds = quantile_bounds(summarise(df, keys, value, eps / 4), keys, probs, eps / 4)
    return bounds.select(*keys, "n", *[((F.col(f"{p}_lo") + F.col(f"{p}_hi")) / 2).alias(p) for p in probs])


def _refine(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], open_: DataFrame, eps: float) -> DataFrame:
    """Bounds of the keys in ``open_`` again, from only the rows inside them.

    The rows below a bound are counted, those inside summarised anew, so each
    pass narrows the rank interval by the factor ``eps``.
    """
    small = open_.count() <= 20_000  # rows of a few numbers each
    key = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    state = F.broadcast(open_) if small else open_
    x = F.col(f"a.{value}").cast("double")
    rows = df.alias("a").join(state.alias("b"), key("a", "b")).where(x.isNotNull() & ~F.isnan(x))
    result = open_.select(*keys, "n").alias("r")
    for p, q in probs.items():
        own = rows.select(*[F.col(f"a.{k}") for k in keys], x.alias("__v"), F.col(f"b.{p}_from").alias("__from"), F.col(f"b.{p}_to").alias("__to"))
        below = own.where("__v < __from").groupBy(*keys).agg(F.count("*").alias("__below"))
        inside = summarise(own.where("__v between __from and __to"), keys, "__v", eps)
        at = open_.select(*keys, F.col("n").alias("__n"), f"{p}_rank").join(below, list(keys), "left").select(*keys, "__n", F.col(f"{p}_rank").alias("__rank"), F.coalesce("__below", F.lit(0)).alias("__below"))
        schema = StructType([df.schema[k] for k in keys] + [StructField("v", ArrayType(DoubleType())), StructField("rmin", ArrayType(LongType())), StructField("rmax", ArrayType(LongType()))])
        target = _arrow_schema(schema)

        def ranks(head, k, v, g, d, target=target):
            s = _starts(k)
            off = pa.array(np.r_[s, len(k)].astype(np.int32))
            run = np.cumsum(g)
            rmin = run - np.repeat(run[s] - g[s], np.diff(np.r_[s, len(k)])) if len(s) else run
            arrays = [head.column(c).combine_chunks() for c in head.column_names] + [pa.ListArray.from_arrays(off, pa.array(y)) for y in (v, rmin, rmin + d)]
            yield from pa.Table.from_arrays(arrays, names=target.names).cast(target).combine_chunks().to_batches()

        merged = merge_summaries(inside, keys, eps, ranks, schema).join(at, list(keys))
        local = lambda up: f"least(__n, __rank + {up}) - __below"
        high = lambda up: f"element_at(filter(v, (x, i) -> rmin[i] >= {local(up)}), 1)"
        low = lambda up: f"coalesce(array_max(filter(v, (x, i) -> rmax[i] <= {local(up)})), v[0])"
        w = F.expr(f"(__n - 1) * {q}D - floor((__n - 1) * {q}D)")
        part = merged.select(
            *[F.col(k).alias(f"__{k}") for k in keys],
            (F.expr(low(0)) + w * (F.expr(low(1)) - F.expr(low(0)))).alias(f"{p}_lo"),
            (F.expr(high(0)) + w * (F.expr(high(1)) - F.expr(high(0)))).alias(f"{p}_hi"),
            F.expr(low(0)).alias(f"{p}_from"), F.expr(high(1)).alias(f"{p}_to"), F.col("__rank").alias(f"{p}_rank"),
        )
        result = result.join(part, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    return result


def _exact(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], open_: DataFrame) -> DataFrame:
    """Exact percentiles of the keys in ``open_`` (all four bounds equal), by
    counting each distinct value inside their bounds; after some refining passes
    those are few, however many rows repeat them."""
    both = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    x = F.col(f"a.{value}").cast("double")
    result = open_.select(*keys, "n")
    for p, q in probs.items():
        rows = df.alias("a").join(open_.alias("b"), both).where(x.isNotNull() & ~F.isnan(x) & (x <= F.col(f"b.{p}_to")))
        clamped = F.when(x >= F.col(f"b.{p}_from"), x)  # null stands for all below
        counts = rows.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("b.n").alias("n"), F.col(f"b.{p}_rank").alias("rank"), clamped.alias("v")).agg(F.count("*").alias("c"))
        run = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")))
        at = counts.withColumn("run", run).groupBy(*keys).agg(*[F.min(F.when((F.col("run") >= r) & F.col("v").isNotNull(), F.col("v"))).alias(c) for c, r in (("v0", F.col("rank")), ("v1", F.least(F.col("n"), F.col("rank") + 1)))], F.max((F.col("n") - 1) * q % 1).alias("w"))
        exact = F.col("v0") + F.col("w") * (F.col("v1") - F.col("v0"))
        part = at.select(*[F.col(k).alias(f"__{k}") for k in keys], exact.alias(f"{p}_lo"), exact.alias(f"{p}_hi"))
        result = result.join(part, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    return result


def ratio_exceeds(df: DataFrame, keys: Sequence[str], value: str, upper: float, lower: float, factor: float, eps: float = 0.005, rounds: int = 3) -> DataFrame:
    """The keys whose ``upper`` percentile is more than ``factor`` times the
    ``lower`` one (linear interpolation).  Null and NaN values don't count.

    Decided from the bounds of the summaries; only keys whose bounds leave it
    open are read again, by rows within the bounds, each pass narrowing them
    by ``eps``.  What is open after ``rounds`` passes is counted exactly.  Null
    keys belong to no group and are left out.
    """
    df = df.select(*keys, value).dropna(subset=list(keys))
    probs = {"hi": upper, "lo": lower}
    bounds = cut(quantile_bounds(summarise(df, keys, value, eps / 4), keys, probs, eps / 4))
    yes = f"hi_lo > {factor}D * lo_hi"
    still = f"hi_hi > {factor}D * lo_lo and not ({yes})"
    found = bounds.where(yes).select(*keys)
    open_ = bounds.where(still)
    for _ in range(rounds):
        if not open_.limit(1).count():
            return found
        bounds = cut(_refine(df, keys, value, probs, open_, eps / 4))
        found = found.unionByName(bounds.where(yes).select(*keys))
        open_ = bounds.where(still)
    if not open_.limit(1).count():
        return found
    return found.unionByName(_exact(df, keys, value, probs, open_).where(yes).select(*keys))
