"""Encoding of texts with a public byte-level BPE vocabulary, in numpy.

Texts are split by the vocabulary's pattern; equal pieces are encoded once per
task.  New pieces go into padded matrices of token ids, one matrix per length
class.  Each round finds every row's leftmost pair of minimum rank through a
hash table of pairs, merges it and closes the gap; rows without a known pair
leave the matrix.  Rows longer than ``LONG`` merge all non-overlapping
occurrences of their minimum pair in a round, which gives the same ids (a pair
made by a merge always ranks behind it) in far fewer rounds.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.tables import table

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("LEGAJO_TOKENIZERS", "/opt/tokenizers")
#: Split pattern of the vocabulary (fixed value of its public description).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept per task; beyond it the store starts anew.
STORE = 1 << 19
#: Characters of text handled at once in a task.
CHUNK = 1 << 21
#: Cells of one matrix.
CELLS = 1 << 20
LONG = 128
NO_RANK = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that the vocabulary file writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary of ``<folder>/<name>.json``: byte ids and the pair table."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        import regex

        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for symbol, byte in _byte_symbols().items():
            self.byte_ids[byte] = vocab[symbol]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._hash((left << np.uint64(32)) | right, np.arange(len(pairs), dtype=np.int32), made)
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def _hash(self, keys, ranks, made) -> None:
        self.bits = 2 + int(len(keys)).bit_length()
        size = 1 << self.bits
        self.mask = np.uint64(size - 1)
        self.slot_key = np.full(size, 2**64 - 1, dtype=np.uint64)
        self.slot_rank = np.full(size, NO_RANK, dtype=np.int32)
        self.slot_made = np.zeros(size, dtype=np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = self.slot_key[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            lucky = first[free[first]]
            self.slot_key[at[lucky]] = keys[todo[lucky]]
            self.slot_rank[at[lucky]], self.slot_made[at[lucky]] = ranks[todo[lucky]], made[todo[lucky]]
            left = np.ones(len(todo), dtype=bool)
            left[lucky] = False
            todo, at = todo[left], (at[left] + np.uint64(1)) & self.mask
            self.probes += 1

    def _slot(self, keys):
        return (keys * _MULTIPLIER) >> np.uint64(64 - self.bits)

    def lookup(self, left, right):
        """(rank, merged id) of pairs of ids; NO_RANK where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        found = self.slot_key[at]
        rank, made = np.where(found == key, self.slot_rank[at], NO_RANK), self.slot_made[at]
        open_ = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            made[open_[hit]] = self.slot_made[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return rank, made

    def forget(self) -> None:
        self.known = _Numbering()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)  # begin[i] .. begin[i + 1] are the ids of piece i

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each piece)."""
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        start = np.cumsum(length) - length
        out_len = length.copy()
        out = np.empty(len(buffer), dtype=np.int32)
        order = np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order):
            width = max(2, 1 << int(max(int(length[order[lo]]) - 1, 0)).bit_length())
            hi = int(np.searchsorted(length[order], width, side="right"))
            hi = min(hi, lo + max(1, CELLS // width))
            rows = order[lo:hi]
            matrix = np.full((len(rows), width), -1, dtype=np.int32)
            cell = np.arange(width) < length[rows][:, None]
            source = (start[rows][:, None] + np.arange(width))[cell]
            matrix[cell] = self.byte_ids[buffer[source]]
            (self._long if width > LONG else self._rounds)(matrix, length[rows], rows, start, out, out_len)
            lo = hi
        keep = np.arange(len(out)) - np.repeat(start, length) < np.repeat(out_len, length)
        return out[keep], out_len

    def _store(self, matrix, count, rows, start, out, out_len) -> None:
        cell = np.arange(matrix.shape[1]) < count[:, None]
        out[(start[rows][:, None] + np.arange(matrix.shape[1]))[cell]] = matrix[cell]
        out_len[rows] = count

    def _rounds(self, matrix, count, rows, start, out, out_len) -> None:
        rank, made = self._pairs(matrix, count)
        while True:
            at = np.argmin(rank, axis=1) if rank.shape[1] else np.zeros(len(rows), dtype=np.int64)
            line = np.arange(len(rows))
            go = rank[line, at] < NO_RANK if rank.shape[1] else np.zeros(len(rows), dtype=bool)
            if not go.all():
                self._store(matrix[~go], count[~go], rows[~go], start, out, out_len)
                matrix, rank, made, count, rows, at = matrix[go], rank[go], made[go], count[go], rows[go], at[go]
                if not len(rows):
                    return
                line = np.arange(len(rows))
            new = made[line, at]
            width = int(count.max())
            matrix, rank, made = matrix[:, :width], rank[:, : width - 1], made[:, : width - 1]
            column = np.arange(width - 1)
            shift = column + (column > at[:, None])
            matrix = np.take_along_axis(matrix, shift, axis=1)
            matrix[line, at] = new
            count = count - 1
            width -= 1
            column = np.arange(max(width - 1, 0))
            shift = column + (column >= at[:, None])
            rank, made = np.take_along_axis(rank, shift, axis=1), np.take_along_axis(made, shift, axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side + 1 < count))
                if len(ok):
                    rank[ok, side[ok]], made[ok, side[ok]] = self.lookup(matrix[ok, side[ok]], matrix[ok, side[ok] + 1])
                end = np.flatnonzero((side >= 0) & (side + 1 >= count) & (side < rank.shape[1]))
                rank[end, side[end]] = NO_RANK

    def _pairs(self, matrix, count):
        rank = np.full((matrix.shape[0], matrix.shape[1] - 1), NO_RANK, dtype=np.int32)
        made = np.zeros_like(rank)
        cell = np.arange(1, matrix.shape[1]) < count[:, None]
        rank[cell], made[cell] = self.lookup(matrix[:, :-1][cell], matrix[:, 1:][cell])
        return rank, made

    def _long(self, matrix, count, rows, start, out, out_len) -> None:
        for i, row in enumerate(rows):
            ids = matrix[i, : count[i]]
            while len(ids) > 1:
                rank, made = self.lookup(ids[:-1], ids[1:])
                least = rank.min()
                if least == NO_RANK:
                    break
                hit = np.flatnonzero(rank == least)
                run = np.r_[True, np.diff(hit) > 1]  # overlapping hits: every other one, from the left
                hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
                ids = ids.copy()
                ids[hit] = made[hit]
                ids = np.delete(ids, hit + 1)
            out[start[row] : start[row] + len(ids)] = ids
            out_len[row] = len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, number of ids of each); none for null or empty."""
        if len(self.known) > STORE:
            self.forget()
        index: list[int] = []
        count = np.zeros(len(texts), dtype=np.int64)
        number, split = self.known.__getitem__, self.split
        for i, text in enumerate(texts):
            if text:
                before = len(index)
                index.extend(map(number, split(text)))
                count[i] = len(index) - before
        if self.known.fresh:
            flat, length = self.encode_pieces([p.encode("utf-8") for p in self.known.fresh])
            end = int(self.begin[-1])
            if end + len(flat) > len(self.flat):
                self.flat = np.r_[self.flat[:end], np.zeros(end + len(flat), dtype=np.int32)]
            self.flat[end : end + len(flat)] = flat
            self.begin = np.r_[self.begin, end + np.cumsum(length)]
            self.known.fresh.clear()
        at = np.fromiter(index, dtype=np.int64, count=len(index))
        first, length = self.begin[at], self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(first - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edge = np.r_[0, ends][np.cumsum(np.r_[0, count])]
        return ids, np.diff(edge)


class _Numbering(dict):
    """Numbers pieces in order of appearance; ``fresh`` are those not encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.fresh.append(piece)
        return at


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)




def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``ids ARRAY<INT>``, one row per input row.

    Empty and null texts both get the empty list, never null.  Rows keep their
    partition; nothing is shuffled.  Other columns are ignored.
    """
    source = df.select(*keep, F.col(text).alias("__text"))
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([df.schema[k] for k in keep] + [StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or _model(folder, name)
            column = b.column(b.num_columns - 1)
            texts = column.to_pylist()
            for lo, hi in _chunks(texts):
                ids, length = model.encode(texts[lo:hi])
                offsets = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
                arrays = [b.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "ids"])

    return source.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``n_tokens BIGINT`` (0 for empty and null texts)."""
    source = df.select(*keep, F.col(text).alias("__text"))
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([df.schema[k] for k in keep] + [StructField("n_tokens", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or _model(folder, name)
            texts = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in _chunks(texts):
                _, length = model.encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [pa.array(length)], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, schema)


_MODELS: dict[tuple[str, str], BytePairs] = {}


def _model(folder: str, name: str) -> BytePairs:
    """One vocabulary per worker process."""
    if (folder, name) not in _MODELS:
        _MODELS[folder, name] = BytePairs(folder, name)
    return _MODELS[folder, name]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encode(table(spark, sf_dir, "documents"))
