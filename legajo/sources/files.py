"""Files as they are admitted: signature, kind, reasons for rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file at most, and pixels of an image.
MAX_BYTES, MAX_PIXELS = 20 * 1024 * 1024, 40_000_000
#: Leading bytes of the formats read, and their MIME types.
SIGNATURES = {"application/pdf": "255044462D", "image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A"}
KINDS = {"application/pdf": "pdf", "image/jpeg": "image", "image/png": "image"}


def sniff(content: Column) -> Column:
    """MIME type by the leading bytes; null where none is known."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None)
    for mime, magic in SIGNATURES.items():
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return out


def kind_of(mime: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[mime]


def source_of(value: Column) -> Column:
    """``camera`` only where that is said, else ``file``."""
    return F.when(value == "camera", "camera").otherwise("file")


def mode_of(value: Column) -> Column:
    """``printed`` unless ``handwritten`` is asked for; anything else raises."""
    return F.when(F.coalesce(value, F.lit("")).isin("", "printed"), "printed").when(value == "handwritten", "handwritten").otherwise(F.raise_error(F.concat(F.lit("unknown mode "), value)).cast("string"))


def rejection(content: Column, mime: Column, source: Column) -> Column:
    """Why a file isn't admitted, null where it is; the first reason counts."""
    size, found = F.coalesce(F.length(content), F.lit(0)), sniff(content)
    return (
        F.when(size == 0, "EMPTY_FILE").when(size > MAX_BYTES, "FILE_TOO_LARGE").when(found.isNull(), "UNKNOWN_SIGNATURE")
        .when(~F.coalesce(mime.isin(*SIGNATURES), F.lit(False)), "MIME_NOT_ALLOWED").when(mime != found, "MIME_MISMATCH").when((source == "camera") & (found == "application/pdf"), "CAMERA_PDF")
    )


def error_code(reason: Column) -> Column:
    """Answer code of a rejected file."""
    return F.when(reason == "FILE_TOO_LARGE", 413).when(reason.isNotNull(), 400).otherwise(200)


def read_files(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Files of a folder with their bytes, size and detected type; those over
    ``most`` bytes are left out by their size, unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)
    return files.withColumn("mime", sniff(F.col("content"))).withColumn("kind", kind_of(F.col("mime")))


def image_size(content: Column) -> Column:
    """Struct (width, height) from the header of a PNG file, null for others."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when((sniff(content) == "image/png") & (F.length(content) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def size_allowed(width: Column, height: Column) -> Column:
    """Whether an image may be read: it has a size, of at most ``MAX_PIXELS``."""
    return F.coalesce((width > 0) & (height > 0) & (width * height <= MAX_PIXELS), F.lit(False))


def pages_of(df: DataFrame, pages: str, most: int = 3) -> DataFrame:
    """A row per page to be read (``page_number`` from 1) of files with ``pages``
    pages, at most ``most`` of each; files of no page have none."""
    return df.where(F.col(pages) > 0).withColumn("page_number", F.explode(F.sequence(F.lit(1), F.least(F.col(pages).cast("int"), F.lit(most)))))


def requests(df: DataFrame, id_: str, path: str) -> DataFrame:
    """One line of JSON per row for a worker that reads requests line by line."""
    return df.select(F.to_json(F.struct(F.col(id_).cast("string").alias("id"), F.col(path).alias("detectionPath"))).alias("value"))


def responses(lines: DataFrame, result: str) -> DataFrame:
    """id, ok, result (a struct of the given schema), error of a worker's lines;
    lines that are no JSON or no answer are left out, nulls too."""
    schema = f"type string, id string, ok boolean, result struct<{result}>, error string"
    return lines.select(F.from_json("value", schema).alias("r")).where("r.type = 'result' and r.id is not null").select("r.id", F.coalesce("r.ok", F.lit(False)).alias("ok"), "r.result", "r.error")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON artifacts (one document per file) under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their names."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; one file per partition."""
    df.write.mode("overwrite").json(path)


def write_text_report(df: DataFrame, line: Column, path: str) -> None:
    """One line of text per row."""
    df.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def isolated(df: DataFrame, column: str, function, into: str = "text") -> DataFrame:
    """``into`` and ``status`` from a Python function of one value that may fail:
    an error gives the empty text and ``ERROR:<type>``, other rows go on."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [f for f in df.schema.fields if f.name not in (into, "status")]
    schema = StructType([*kept, StructField(into, StringType()), StructField("status", StringType())])

    def one(value):
        try:
            return function(value), "OK"
        except Exception as e:  # noqa: BLE001
            return "", f"ERROR:{type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(v) for v in b.column(b.schema.get_field_index(column)).to_pylist()]
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=schema.names)

    source = df if column not in (into, "status") else df
    return source.mapInArrow(run, schema)
