"""Verdicts on recognised pages, characters, lines and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.functions.text import squeeze, strip, strip_edges, tokens

#: Order of page verdicts from best to worst.
RANKS = ("ACCEPTABLE", "REVIEW", "INSUFFICIENT")


def page_quality(text: Column, confidence: Column) -> Column:
    """Struct (status, reason) of a page; a missing confidence asks for review
    and is never taken for zero."""
    blank = F.coalesce(squeeze(text), F.lit("")) == ""
    status = F.when(blank, "INSUFFICIENT").when(confidence.isNull(), "REVIEW").when(confidence < 70, "INSUFFICIENT").when(confidence < 90, "REVIEW").otherwise("ACCEPTABLE")
    reason = F.when(blank, "EMPTY_TEXT").when(confidence.isNull(), "CONFIDENCE_UNAVAILABLE").when(confidence < 70, "LOW_CONFIDENCE").when(confidence < 90, "MODERATE_CONFIDENCE")
    return F.struct(status.alias("status"), reason.alias("reason"))


def rank(status: Column) -> Column:
    return F.when(status == "INSUFFICIENT", 2).when(status == "REVIEW", 1).otherwise(0)


def character_action(confidence: Column) -> Column:
    """FALLBACK under 0.70, else REVIEW; values outside [0, 1] are ``invalid``
    (the strict form raises, see ``character_action_strict``)."""
    bad = confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    return F.when(bad, "invalid").when(confidence < 0.70, "FALLBACK").otherwise("REVIEW")


def character_action_strict(confidence: Column) -> Column:
    action = character_action(confidence)
    return F.when(action == "invalid", F.raise_error(F.lit("confidence outside [0, 1]")).cast("string")).otherwise(action)


def low_confidence(confidence: Column) -> Column:
    """Words worth a second look: at least 0 and under 50 (-1 marks no value)."""
    return (confidence >= 0) & (confidence < 50)


def needs_verification(angle: Column, kind: Column) -> Column:
    """Whether a detected skew is so large that another reading must confirm it;
    pages of files are never turned."""
    return F.coalesce((kind != "pdf") & angle.isNotNull() & ~F.isnan(angle) & (F.abs(angle) >= 9.5) & (F.abs(angle) < float("inf")), F.lit(False))


def heading_like(line: Column) -> Column:
    """Few words, mostly capitals."""
    letters, upper = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))
    return (letters >= 4) & (F.size(tokens(line)) <= 9) & (upper >= 0.88 * letters)


def field_like(line: Column) -> Column:
    """A short label before the first colon."""
    text = squeeze(line)
    colon = F.instr(text, ":") - 1
    label = F.trim(F.substring_index(text, ":", 1))
    n = F.size(tokens(label))
    return (colon > 0) & n.between(1, 5) & (F.length(label) <= 48) & label.rlike(r"^[\p{L} ._-]+$") & (colon < 0.55 * F.length(text)) & (F.size(tokens(text)) <= 18)


def noise_line(line: Column) -> Column:
    """Scanner dust rather than content: blank; symbols prevail over at most six
    letters and digits; or four and more tokens, three quarters of them of at
    most two characters and none of four.  Null counts as blank."""
    text = F.coalesce(strip(line), F.lit(""))
    solid, signs = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]"))
    parts = tokens(text)
    sizes = F.transform(parts, lambda t: F.length(strip_edges(t)))
    n = F.size(parts)
    scattered = (n >= 4) & (F.size(F.filter(sizes, lambda s: s <= 2)) >= 0.75 * n) & ~F.exists(sizes, lambda s: s >= 4)
    return (text == "") | (solid.between(1, 6) & (signs > 0.45 * (solid + signs))) | scattered


def anomaly_score(token: Column, confidence: Column | None = None) -> Column:
    """How much a token looks misread; negative for what isn't worth asking."""
    clean = F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    n = F.length(clean)
    base = F.lit(35.0) if confidence is None else F.coalesce(F.greatest(F.lit(0.0), 100 - confidence) * 0.8, F.lit(35.0))
    plus = lambda condition, points: F.when(condition, float(points)).otherwise(0.0)
    score = (
        base + plus(clean.rlike(r"\p{L}") & clean.rlike("[0-9]"), 40) + plus(token.rlike(r"[~`|\\_§©®¢]"), 30) + plus(clean.rlike(r"\p{Ll}\p{Lu}"), 20)
        + plus(token.rlike(r"\p{L}[.,;:]\p{L}"), 25) + plus(F.lower(clean).rlike("[bcdfghjklmnñpqrstvwxyz]{3,}"), 20)
        + F.when(n.between(3, 18), 10.0).when(n > 25, -15.0).otherwise(0.0)
    )
    return F.when(n < 2, -100.0).when(clean.rlike("^[0-9]+$"), -50.0).otherwise(score)
