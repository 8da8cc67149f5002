"""Tokens that look misread: first occurrences, diversified top-k, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.quality import anomaly_score, noise_line
from legajo.functions.text import strip, token_key, tokens
from legajo.operators.normalise import normalise


def scored_tokens(lines: DataFrame) -> DataFrame:
    """(doc, line_no, pos, token, key, score, line_key) of the tokens of each
    line that isn't noise; tokens without two letters or digits are left out."""
    text = strip(F.col("line"))
    kept = lines.where(~noise_line(F.col("line"))).select("doc", "line_no", text.alias("line"), F.posexplode(tokens(text)).alias("pos", "token"))
    solid = F.length(F.regexp_replace("token", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return kept.where(solid >= 2).select("doc", "line_no", "pos", "token", token_key(F.col("token")).alias("key"), anomaly_score(F.col("token")).alias("score"), F.substring("line", 1, 40).alias("line_key"))


def first_occurrences(scored: DataFrame) -> DataFrame:
    """The first row of each document and key: a minimum of structs, so that it
    is partially aggregated before the shuffle."""
    rest = [c for c in scored.columns if c not in ("doc", "key", "line_no", "pos")]
    first = scored.groupBy("doc", "key").agg(F.min(F.struct("line_no", "pos", *rest)).alias("f"))
    return first.select("doc", "key", "f.*")


def diversified_top(candidates: DataFrame, k: int, per_line: int = 2) -> DataFrame:
    """The ``k`` best candidates of each document, at most ``per_line`` from one
    line where there are more than ``k``; ties by place in the text."""
    best = [F.desc("score"), F.asc("line_no"), F.asc("pos")]
    sized = candidates.withColumns({"__n": F.count("*").over(Window.partitionBy("doc")), "__in_line": F.row_number().over(Window.partitionBy("doc", "line_key").orderBy(*best))})
    kept = sized.where((F.col("__n") <= k) | (F.col("__in_line") <= per_line))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(*best))).where(F.col("place") <= k).drop("__n", "__in_line")


#: Labels whose lines hold contract data.
PROTECTED_LABEL = r"(?i)(?<![A-Za-z0-9_])(?:nit|c[oóÓ]digo|fecha|monto|bs|total|c\.i|ci)(?![A-Za-z0-9_])"
#: Kinds of field whose normalisation may explain a change of protected data.
NORMALISERS = ("NIT", "TV_CORRELATIVO", "DATE", "AMOUNT")


def validate(df: DataFrame) -> DataFrame:
    """Suggestions (original, suggested, context, document, decision, candidate)
    with ``char_distance``, ``status`` and ``rejection``; the first rule that
    applies decides.  ``document`` is the whole text that was read, ``candidate``
    the text of the candidate that the suggestion's id names, null where no
    candidate has that id.

    Missing from the document; a decision that isn't a correction; no change;
    protected data that no normalisation explains; too many edits (two up to
    six characters, three beyond, never over 45 %); an unknown candidate;
    another word than the candidate's; else SUGGESTED.  Null originals or
    suggestions count as empty."""
    o, s = F.coalesce(strip(F.col("original")), F.lit("")), F.coalesce(strip(F.col("suggested")), F.lit(""))
    staged = df.select(F.struct("*").alias("__row"), o.alias("__o"), s.alias("__s"))
    o, s, row = F.col("__o"), F.col("__s"), F.col("__row")
    explained = F.lit(False)
    for kind in NORMALISERS:
        staged = normalise(staged, F.lit(kind), o).withColumn(f"__{kind}", F.coalesce((F.col("status") == "NORMALIZED") & (F.col("value") == s), F.lit(False))).drop("input", "value", "status", "reason")
        explained = explained | F.col(f"__{kind}")
    staged = staged.withColumn("__d", F.levenshtein(o, s))
    guarded = o.rlike("[0-9]") | s.rlike("[0-9]") | F.coalesce(row["context"].rlike(PROTECTED_LABEL), F.lit(False))
    d = F.col("__d")
    rejection = (
        F.when(~F.contains(row["document"], o) | row["document"].isNull(), "ORIGINAL_TEXT_NOT_FOUND_IN_OCR")
        .when(row["decision"] == "NOISE", "NOISE_ARTIFACT_PRESERVED")
        .when(row["decision"] == "VERIFIED_CORRECT", "VERIFIED_CORRECT_NO_MODIFICATION_NEEDED")
        .when(row["decision"] == "NO_CORRECTION_DETERMINABLE", "NO_CORRECTION_DETERMINABLE")
        .when(F.lower(o) == F.lower(s), "NO_OP_CORRECTION")
        .when(guarded & ~explained, "PROTECTED_FIELD_RESTRICTED_MANUAL_REVIEW_ONLY")
        .when((d > F.when(F.length(o) <= 6, 2).otherwise(3)) | (d > 0.45 * F.greatest(F.lit(1), F.length(o))), "EDIT_DISTANCE_THRESHOLD_EXCEEDED")
        .when(row["candidate"].isNull(), "UNKNOWN_CANDIDATE_ID")
        .when(token_key(row["candidate"]) != token_key(o), "CANDIDATE_TEXT_MISMATCH")
    )
    out = staged.withColumn("rejection", rejection)
    distance = F.when(F.col("rejection") == "ORIGINAL_TEXT_NOT_FOUND_IN_OCR", 999).when(F.col("rejection").isin("NOISE_ARTIFACT_PRESERVED", "VERIFIED_CORRECT_NO_MODIFICATION_NEEDED", "NO_CORRECTION_DETERMINABLE", "NO_OP_CORRECTION"), 0).otherwise(d)
    verdict = {"char_distance": distance, "status": F.when(F.col("rejection").isNull(), "SUGGESTED").otherwise("REJECTED"), "rejection": F.col("rejection")}
    return out.select(*[row[c].alias(c) for c in df.columns if c not in verdict], *[v.alias(c) for c, v in verdict.items()])


def whole_word_in(value: Column, text: Column) -> Column:
    """Whether ``value`` stands in ``text`` with no letter or digit beside it."""
    around = F.split(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(-1))
    pairs = F.zip_with(F.slice(around, F.lit(1), F.greatest(F.size(around) - 1, F.lit(0))), F.slice(around, F.lit(2), F.greatest(F.size(around) - 1, F.lit(0))), lambda a, b: ~a.rlike(r"[\p{L}\p{N}]$") & ~b.rlike(r"^[\p{L}\p{N}]"))
    return F.exists(pairs, lambda x: x)
