"""Contracts for recognisers and language models that live outside the core.

A recogniser is a factory called once per worker process; the function it
returns reads one image.  A model call is any function of a prompt.  No model
ships with this package; tests use canned ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Failures that open the breaker, and seconds it stays open.
FAILURES, PAUSE_S = 3, 30.0


def recognise(images: DataFrame, content: str, factory: Callable[[], Callable[[bytes], tuple[str, float | None]]]) -> DataFrame:
    """``images`` without ``content``, with ``text``, ``confidence``,
    ``duration_ms`` and ``status``.  The factory runs once per partition; a row
    that fails gets the empty text and ``ERROR:<type>``."""
    kept = [f for f in images.schema.fields if f.name not in (content, "text", "confidence", "duration_ms", "status")]
    schema = StructType([*kept, StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("duration_ms", DoubleType()), StructField("status", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for b in batches:
            engine = engine or factory()
            text, confidence, took, status = [], [], [], []
            for value in b.column(b.schema.get_field_index(content)).to_pylist():
                began = time.perf_counter()
                try:
                    t, c = engine(value)
                    text.append(t)
                    confidence.append(c)
                    status.append("OK")
                except Exception as e:  # noqa: BLE001
                    text.append("")
                    confidence.append(None)
                    status.append(f"ERROR:{type(e).__name__}")
                took.append((time.perf_counter() - began) * 1000)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(text, pa.string()), pa.array(confidence, pa.float64()), pa.array(took, pa.float64()), pa.array(status, pa.string())], names=schema.names)

    return images.mapInArrow(run, schema)


class Breaker:
    """Calls a function unless it failed ``FAILURES`` times in a row within the
    last ``PAUSE_S`` seconds; one success closes it."""

    def __init__(self, function: Callable, clock: Callable[[], float] = time.monotonic):
        self.function, self.clock = function, clock
        self.failed, self.since = 0, 0.0

    def __call__(self, *args):
        if self.failed >= FAILURES and self.clock() - self.since < PAUSE_S:
            raise RuntimeError("circuit open")
        try:
            out = self.function(*args)
        except Exception:
            self.failed += 1
            self.since = self.clock()
            raise
        self.failed = 0
        return out
