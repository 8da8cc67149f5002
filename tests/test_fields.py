import pytest
from pyspark.sql import functions as F

from legajo.operators.normalise import normalise
from legajo.plans.fields import extracted

VECTORS = [
    ("NIT", "1020304050", "1020304050", "UNCHANGED", "NO_CHANGE"),
    ("NIT", "1O2O3O4O5O", "1020304050", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("NIT", "I020304050", "1020304050", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("NIT", "10Z0304050", "1020304050", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("NIT", "1020-304050", None, "INVALID", "INVALID_FORMAT"),
    ("NIT", "1" * 21, None, "INVALID", "INVALID_FORMAT"),
    ("NIT", None, None, "INVALID", "INVALID_FORMAT"),
    ("TV_CORRELATIVO", "TV-OO1-2026", "TV-001-2026", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("TV_CORRELATIVO", "TV-I000-2O26", "TV-1000-2026", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("TV_CORRELATIVO", "Tv- 125 -2026", "TV-125-2026", "NORMALIZED", "FORMAT_NORMALIZATION"),
    ("TV_CORRELATIVO", "7V-001-2026", None, "INVALID", "INVALID_FORMAT"),
    ("TV_CORRELATIVO", "TV-01-2026", None, "INVALID", "INVALID_FORMAT"),
    ("DATE", "1S/09/2O26", "15/09/2026", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("DATE", "06 / 10 / 2026", "06/10/2026", "NORMALIZED", "FORMAT_NORMALIZATION"),
    ("DATE", "06/10/26", None, "AMBIGUOUS", "SHORT_YEAR"),
    ("DATE", "31/02/2026", None, "INVALID", "INVALID_DATE"),
    ("DATE", "06-10-2026", None, "INVALID", "INVALID_DATE"),
    ("DATE", "01/01/0050", None, "INVALID", "INVALID_DATE"),
    ("AMOUNT", "Bs. 8. S05, 10", "Bs 8.505,10", "NORMALIZED", "NUMERIC_CONTEXT"),
    ("AMOUNT", "bs. 3.850,50", "Bs 3.850,50", "NORMALIZED", "FORMAT_NORMALIZATION"),
    ("AMOUNT", "Bs 850,10", "Bs 850,10", "UNCHANGED", "NO_CHANGE"),
    ("AMOUNT", "3.850,50", None, "INVALID", "INVALID_FORMAT"),
    ("AMOUNT", "Bs 38.50,50", None, "INVALID", "INVALID_FORMAT"),
    ("OTHER", "x", None, "INVALID", "INVALID_FORMAT"),
]


def test_normalise(spark):
    rows = [(i, k, r, "clash") for i, (k, r, *_) in enumerate(VECTORS)]
    out = normalise(spark.createDataFrame(rows, "i int, kind string, raw string, value string"), F.col("kind"), F.col("raw")).collect()
    got = {r["i"]: (r["value"], r["status"], r["reason"]) for r in out}
    for i, v in enumerate(VECTORS[:-1]):
        assert got[i] == v[2:], v


@pytest.mark.parametrize(
    "line, kind, raw",
    [
        ("VIT: 1020304050", "NIT", "1020304050"), ("Nιt: 4587123019", "NIT", "4587123019"), ("νιt: 4587123019", "NIT", "4587123019"), ("N: 4587123019", None, None),
        ("Códio: TV-125-2026", "TV_CORRELATIVO", "TV-125-2026"), ("Códlgo TV-12S-2026", "TV_CORRELATIVO", "TV-12S-2026"), ("Monts: Bs. 8. 50, 10", "AMOUNT", "Bs. 8. 50, 10"),
        ("Moło Bs. 3,880, 50", "AMOUNT", "Bs. 3,880, 50"), ("Tiecha: 06/10/26", "DATE", "06/10/26"), ("Techa : 06 /20/25", "DATE", "06 /20/25"), (" NIT: 1", None, None), ("NIT:   ", None, None),
    ],
)
def test_labels(spark, line, kind, raw):
    out = extracted(spark.createDataFrame([(1, 1, line)], "doc int, line_no int, line string")).collect()
    assert [(r["field_type"], r["raw"]) for r in out] == ([(kind, raw)] if kind else [])
