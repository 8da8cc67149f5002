"""Labels of fields and the letters that digits are misread as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.functions.text import SPACE, strip

#: Letters misread for digits in numeric contexts, and the digits.
CONFUSED, DIGITS = "OoIilLSsBZz", "00111155822"

#: Labels read for each kind of field, misreadings included.
LABELS = {
    "NIT": "nit|vit|nιt|νιt",
    "TV_CORRELATIVO": "código|códio|cóhigoν|códlgo|cádig0|códig",
    "DATE": "fecha|tiecha|techa",
    "AMOUNT": "monto|monts|monte|mont|moło",
}


def digits(text: Column) -> Column:
    """Letters that digits are misread as, read as digits."""
    return F.translate(text, CONFUSED, DIGITS)


def label_pattern(kind: str) -> str:
    """Pattern whose first group is the value behind a label of this kind."""
    return rf"(?iu)^(?:{LABELS[kind]})(?:[{SPACE}]*:[{SPACE}]*|[{SPACE}]+)(.+)$"


def labelled_value(line: Column, kind: str) -> Column:
    """The value that a line holds behind a label, null if it has none."""
    value = strip(F.regexp_extract(line, label_pattern(kind), 1))
    return F.when(value != "", value)
