from legajo.operators.anomalies import validate
from legajo.plans import anomalies, restoration

DOCUMENT = "El solicitante presentó la revlsión del cobro.\nFecha: 1S/09/2026\nMonto Bs 8.S05,10\nNIT 1O20304050, TV-1O5-2026, cl1ente"
COLUMNS = "n int, original string, suggested string, context string, document string, decision string, candidate string, status string"


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, *r[:2], r[2], DOCUMENT if r[3] else None, r[4], r[5], "old") for i, r in enumerate(rows)], COLUMNS)
    out = validate(df)
    assert sorted(out.columns) == sorted([*df.columns, "char_distance", "rejection"])
    return [(r["rejection"] or r["status"], r["char_distance"]) for r in out.orderBy("n").collect()]


def test_each_rule_of_validation(spark):
    line = "la revlsión del cobro"
    rows = [
        ("revlsión", "revisión", line, True, None, "revlsión,"),
        ("ausente", "ausencia", "lo ausente", True, "CORRECTION", "ausente"),
        ("revlsión", "revisión", line, False, "CORRECTION", "revlsión"),
        ("cobro", "x", line, True, "NOISE", "cobro"),
        ("cobro", "x", line, True, "VERIFIED_CORRECT", "cobro"),
        ("cobro", "x", line, True, "NO_CORRECTION_DETERMINABLE", "cobro"),
        ("cobro", "COBRO ", line, True, "CORRECTION", "cobro"),
        ("revlsión", "revisión", "TOTAL de la revlsión", True, "CORRECTION", "revlsión"),
        ("revlsión", "revisión", "CÓDIGO: revlsión", True, "CORRECTION", "revlsión"),
        ("cl1ente", "cliente", line, True, "CORRECTION", "cl1ente"),
        ("cobro", "reestructuración", line, True, "CORRECTION", "cobro"),
        ("revlsión", "revisión", line, True, "CORRECTION", None),
        ("revlsión", "revisión", line, True, "CORRECTION", "cobro"),
    ]
    guarded = "PROTECTED_FIELD_RESTRICTED_MANUAL_REVIEW_ONLY"
    assert verdicts(spark, rows) == [
        ("SUGGESTED", 1), ("ORIGINAL_TEXT_NOT_FOUND_IN_OCR", 999), ("ORIGINAL_TEXT_NOT_FOUND_IN_OCR", 999), ("NOISE_ARTIFACT_PRESERVED", 0), ("VERIFIED_CORRECT_NO_MODIFICATION_NEEDED", 0), ("NO_CORRECTION_DETERMINABLE", 0),
        ("NO_OP_CORRECTION", 0), (guarded, 1), (guarded, 1), (guarded, 1), ("EDIT_DISTANCE_THRESHOLD_EXCEEDED", 14), ("UNKNOWN_CANDIDATE_ID", 1), ("CANDIDATE_TEXT_MISMATCH", 1),
    ]


def test_each_normaliser_explains_its_change(spark):
    rows = [(a, b, "x", True, "CORRECTION", a) for a, b in (("1O20304050", "1020304050"), ("TV-1O5-2026", "TV-105-2026"), ("1S/09/2026", "15/09/2026"), ("Bs 8.S05,10", "Bs 8.505,10"), ("1S/09/2026", "16/09/2026"))]
    assert [v for v, _ in verdicts(spark, rows)] == ["SUGGESTED"] * 4 + ["PROTECTED_FIELD_RESTRICTED_MANUAL_REVIEW_ONLY"]


def stored(spark, at, rows):
    columns = "anomaly_id long, recognition_id long, id string, original_text string, suggested_alternative string, line_context string, decision string, status string, is_protected_field boolean"
    spark.createDataFrame(rows, columns).write.parquet(f"{at}/semantic_anomalies.parquet")


def test_stored_suggestions_meet_their_document(spark, tmp_path):
    spark.createDataFrame([(1, "la revlsión"), (2, "otra cosa"), (3, None)], "recognition_id long, text string").write.parquet(f"{tmp_path}/recognitions.parquet")
    spark.createDataFrame([("a", "revlsión"), ("a", "carta"), ("b", "carta"), ("c", None)], "id string, text string").write.parquet(f"{tmp_path}/word_context_items.parquet")
    stored(spark, tmp_path, [(i, r, c, "revlsión", "revisión", "la revlsión", "CORRECTION", "SUGGESTED", False) for i, (r, c) in enumerate([(1, "a"), (1, "b"), (1, "z"), (1, None), (2, "a"), (3, "a"), (9, "a"), (1, "c")])])
    got = {r["anomaly_id"]: r["rejection"] or r["status"] for r in anomalies.validate_suggestions(spark, str(tmp_path)).collect()}
    assert got == {0: "SUGGESTED", 1: "CANDIDATE_TEXT_MISMATCH", 2: "UNKNOWN_CANDIDATE_ID", 3: "UNKNOWN_CANDIDATE_ID", **dict.fromkeys((4, 5, 6), "ORIGINAL_TEXT_NOT_FOUND_IN_OCR"), 7: "CANDIDATE_TEXT_MISMATCH"}


def test_safe_suggestions_change_the_bare_line(spark, tmp_path):
    line, safe = "La revlsión de Carta", ("CORRECTION", "SUGGESTED", False)
    cases = [
        (line, "revlsión", *safe, "La revisión de Carta"), (line, "ausente", *safe, line), ("revlsión y revlsión", "revlsión", *safe, "revlsión y revlsión"), ("La Revlsión", "Revlsión", *safe, "La Revlsión"),
        (line, "revlsión", "NOISE", "SUGGESTED", False, line), (line, "revlsión", "CORRECTION", "REJECTED", False, line), (line, "revlsión", "CORRECTION", "SUGGESTED", True, line),
    ]
    stored(spark, tmp_path, [(i, 1, "a", o, o.replace("lsi", "isi"), x, d, s, p) for i, (x, o, d, s, p, _) in enumerate(cases)])
    got = {r["anomaly_id"]: r["applied"] for r in restoration.safe_apply(spark, str(tmp_path)).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}
