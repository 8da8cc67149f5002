"""Records that repeat with other formatting, collapsed by radix partitioning.

A record's canonical text holds its letters and digits in order, in lower
case; labelled fields are ordered by label and value.  Records are spread by a
prefix of the canonical bytes.  Prefixes that hold more than a bucket's rows
are split by further bytes, again and again, until each bucket fits; a single
canonical text that alone exceeds a bucket cannot be split and is counted by a
partial aggregation instead, its rows staying where they are.  Each other
bucket is counted in a trie of byte chunks with a counter at every terminal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from legajo.tables import cut, table

#: Rows of a bucket, and most prefixes ever split in a pass.  Beyond their
#: product (10^9 rows) prefixes are split down to rows / MOST_SPLIT, and what is
#: left in them by bytes of a hash of the text, so that buckets stay this small.
BUCKET_ROWS, MOST_SPLIT = 50_000, 20_000
#: First depth in bytes; each further pass doubles it.
DEPTH = 8
#: Bytes of an edge of the trie.
EDGE = 8


def canonical(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case, null if it has none.

    A text that begins with a label (a word followed by ``:`` or ``=``) is made
    of label/value pairs; they are sorted, so their order doesn't count."""
    marked = F.regexp_replace(F.lower(text), "([\\p{L}]+)[\"»']?\\s*[:=]", "\x1e$1\x1f")
    kept = "[^\\p{L}\\p{N}\\p{M}]"
    parts = F.split(marked, "\x1e")
    labelled = (F.size(parts) > 1) & (F.regexp_replace(parts[0], kept, "") == "")
    pairs = F.array_join(F.array_sort(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.regexp_replace(x, "[^\\p{L}\\p{N}\\p{M}\\x1f]", ""))), "\x1e")
    plain = F.regexp_replace(marked, kept, "")
    return F.when(F.regexp_replace(text, "[^\\p{L}\\p{N}]", "") == "", F.lit(None)).otherwise(F.when(labelled, pairs).otherwise(plain))


@dataclass
class Buckets:
    """The rows with their bucket, and those of texts beyond any bucket by a
    digest of the text."""

    spread: DataFrame
    heavy: DataFrame


def partition(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Buckets:
    """``records``: key BIGINT, canon BINARY (checkpointed, as each pass reads it).

    A pass counts the prefixes of one depth within the prefixes still too
    large and keeps those that are too large again; there are at most
    ``rows / bucket size`` of them, so at most ``MOST_SPLIT``."""
    rows = records.count()
    size = max(bucket_rows, -(-rows // MOST_SPLIT))
    depth, todo = DEPTH, records
    split: dict[int, frozenset[bytes]] = {}
    while True:
        prefix = F.substring("canon", 1, depth)
        large = todo.groupBy(prefix.alias("prefix")).count().where(F.col("count") > size).select("prefix").collect()
        if not large:
            break
        split[depth] = frozenset(bytes(r["prefix"]) for r in large)
        # a prefix that was split had all its shorter ones split, so one level of them decides
        again = F.broadcast(records.sparkSession.createDataFrame([(p,) for p in sorted(split[depth])], "again binary"))
        todo = records.where(F.length("canon") >= depth).join(again, prefix == F.col("again"), "left_semi")
        depth *= 2
    schema = StructType([*records.select("key", "canon").schema.fields, StructField("bucket", BinaryType()), StructField("depth", IntegerType()), StructField("heavy", BooleanType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, at, heavy = [], [], []
            for canon in b.column(1).to_pylist():
                depth = DEPTH
                while canon[:depth] in split.get(depth, ()) and len(canon) >= depth:
                    depth *= 2
                bucket.append(canon[:depth])
                at.append(depth)
                heavy.append(len(canon) < depth and canon in split.get(depth, ()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bucket, pa.binary()), pa.array(at, pa.int32()), pa.array(heavy, pa.bool_())], names=schema.names)

    marked = records.select("key", "canon").mapInArrow(place, schema)
    share = F.pmod(F.xxhash64("canon"), F.lit(-(-size // bucket_rows))).cast("int")
    return Buckets(marked.where("not heavy").drop("heavy").withColumn("share", share), marked.where("heavy").select("key", F.sha2("canon", 256).alias("digest")))


def _tries(buckets: DataFrame, name: str, each_copy: bool) -> DataFrame:
    """Walk each bucket's trie: (keep_id, copy_id) of every further copy, or
    (keep_id, n_copies) of every terminal."""
    schema = StructType([StructField("keep_id", LongType()), StructField(name, LongType())])
    ordered = buckets.repartition("bucket", "share").sortWithinPartitions("bucket", "share", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, root, terminals = None, {}, []
        keep, other = [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(other, pa.int64())], names=["keep_id", name])

        def close():
            if not each_copy:
                for first, n in terminals:
                    keep.append(first)
                    other.append(n)

        for b in batches:
            keys, canons, buckets_, depths, shares = (b.column(i).to_pylist() for i in range(5))
            for key, canon, owner, depth in zip(keys, canons, zip(buckets_, shares), depths):
                if owner != current:
                    close()
                    current, root, terminals = owner, {}, []
                node = root
                for at in range(min(depth, len(canon)), len(canon), EDGE):
                    edge = canon[at : at + EDGE]
                    node = node.get(edge) or node.setdefault(edge, {})
                terminal = node.get(None)
                if terminal is None:
                    node[None] = terminal = [key, 1]
                    terminals.append(terminal)
                    continue
                terminal[1] += 1
                if each_copy and terminal[0] != key:
                    keep.append(terminal[0])
                    other.append(key)
            if len(keep) >= 50_000:
                yield out()
                keep, other = [], []
        close()
        yield out()

    return ordered.select("key", "canon", "bucket", "depth", "share").mapInArrow(run, schema)


def _records(df: DataFrame, key: str, text: str) -> DataFrame:
    ready = df.select(F.col(key).cast("long").alias("key"), canonical(F.col(text)).cast("binary").alias("canon"))
    return cut(ready.where("canon is not null and key is not null"))


def copies(df: DataFrame, key: str, text: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, copy_id): each further record of a set of copies with the
    smallest key of its set.  Texts without letter or digit and null texts or
    keys are no records; equal keys count as one record."""
    at = partition(_records(df, key, text), bucket_rows)
    light = _tries(at.spread, "copy_id", each_copy=True)
    first = F.broadcast(at.heavy.groupBy("digest").agg(F.min("key").alias("keep_id")))  # at most MOST_SPLIT digests, 64 characters each
    heavy = at.heavy.join(first, "digest").where("key != keep_id").select("keep_id", F.col("key").alias("copy_id"))
    return light.unionByName(heavy)


def collapsed(df: DataFrame, key: str, text: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, n_copies): one row per set, with the number of its records."""
    at = partition(_records(df, key, text), bucket_rows)
    light = _tries(at.spread, "n_copies", each_copy=False)
    heavy = at.heavy.groupBy("digest").agg(F.min("key").alias("keep_id"), F.count("*").alias("n_copies"))
    return light.unionByName(heavy.select("keep_id", "n_copies"))


TABLES = (("semantic_anomalies", "anomaly_id", "original_text"), ("word_context_items", "item_id", "text"))


def _both(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    parts = [operator(table(spark, sf_dir, t), key, text).select(F.lit(t).alias("table_name"), "*") for t, key, text in TABLES]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of both tables: table_name, keep_id, copy_id."""
    return _both(spark, sf_dir, copies)


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each set and its number of records, per table."""
    return _both(spark, sf_dir, collapsed)


_CANONICAL_SQL = """
WITH t AS (
  SELECT 'semantic_anomalies' AS table_name, anomaly_id AS id, original_text AS x FROM semantic_anomalies
  UNION ALL SELECT 'word_context_items', item_id, text FROM word_context_items),
m AS (SELECT table_name, id, x, regexp_replace(lower(x), '(\\p{L}+)["»'']?\\s*[:=]', chr(30) || '\\1' || chr(31), 'g') AS y FROM t
  WHERE regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g') <> ''),
s AS (SELECT *, string_split(y, chr(30)) AS p FROM m),
c AS (SELECT table_name, id, CASE WHEN len(p) > 1 AND regexp_replace(p[1], '[^\\p{L}\\p{N}\\p{M}]', '', 'g') = ''
  THEN array_to_string(list_sort(list_transform(p[2:], lambda q: regexp_replace(q, '[^\\p{L}\\p{N}\\p{M}' || chr(31) || ']', '', 'g'))), chr(30))
  ELSE regexp_replace(y, '[^\\p{L}\\p{N}\\p{M}]', '', 'g') END AS canon FROM s),
k AS (SELECT *, min(id) OVER w AS keep_id, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY table_name, canon))
"""
FOUND_SQL = _CANONICAL_SQL + "SELECT table_name, keep_id, id AS copy_id FROM k WHERE id <> keep_id"
COLLAPSED_SQL = _CANONICAL_SQL + "SELECT table_name, keep_id, n AS n_copies FROM k WHERE id = keep_id"
