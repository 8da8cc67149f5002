import pytest
from pyspark.sql import functions as F

from legajo import api
from legajo.operators import adapters, imaging
from legajo.operators.layout import block_rows, ink_bands, region_groups, word_lines
from legajo.sources import files
from legajo.sources.tsv import parse_words


def test_signatures(spark):
    rows = [(b"%PDF-1.4",), (b"\xff\xd8\xff\xe0",), (b"\x89PNG\r\n\x1a\n",), (b"GIF89a",), (b"",), (None,)]
    df = spark.createDataFrame(rows, "c binary")
    assert [r["m"] for r in df.select(files.sniff(F.col("c")).alias("m")).collect()] == ["application/pdf", "image/jpeg", "image/png", None, None, None]
    reason = df.select(files.rejection(F.col("c"), F.lit("application/pdf"), F.lit("camera")).alias("r")).collect()
    assert [r["r"] for r in reason] == ["CAMERA_PDF", "MIME_MISMATCH", "MIME_MISMATCH", "UNKNOWN_SIGNATURE", "EMPTY_FILE", "EMPTY_FILE"]


def test_tsv(spark):
    good = "5\t1\t1\t1\t1\t1\t0\t0\t10\t12\t22\tHola\ta\n5\t1\t1\t1\t1\t2\t20\t0\t10\t12\t95\t \n4\t1\t1\t1\t1\t0\t0\t0\t10\t12\t-1\t"
    df = spark.createDataFrame([(1, good), (2, ""), (3, None)], "doc int, tsv string")
    out = parse_words(df, "tsv").collect()
    assert [(r["doc"], r["text"], r["confidence"]) for r in out] == [(1, "Hola\ta", 22.0)]
    bad = spark.createDataFrame([(1, "5\t1\t1\t1\t1\t1\t-4\t0\t10\t12\t22\tx")], "doc int, tsv string")
    assert parse_words(bad, "tsv", strict=False).count() == 0
    with pytest.raises(Exception, match="malformed"):
        parse_words(bad, "tsv").collect()


def test_tsv_columns_by_name(spark):
    head = "text level page_num block_num par_num line_num word_num left top width height conf".split()
    rows = ["\t".join(head), "\t".join(["Hola", "5", "1", "1", "1", "1", "1", "0", "0", "10", "12", "22"]), "\t".join(["x", "4", "1", "1", "1", "1", "0", "0", "0", "10", "12", "-1"])]
    moved = "level\t" + "\t".join(h for h in head if h not in ("level", "text")) + "\ttext\n" + "5\t1\t1\t1\t1\t1\t0\t0\t10\t12\t22\tHola\ta"
    df = spark.createDataFrame([(1, moved)], "doc int, tsv string")
    assert [r["text"] for r in parse_words(df, "tsv").collect()] == ["Hola\ta"]
    swapped = "level\ttext\t" + "\t".join(h for h in head if h not in ("level", "text")) + "\n5\tHola\t1\t1\t1\t1\t1\t0\t0\t10\t12\t22"
    assert [(r["text"], r["confidence"]) for r in parse_words(spark.createDataFrame([(1, swapped)], "doc int, tsv string"), "tsv").collect()] == [("Hola", 22.0)]
    lacking = spark.createDataFrame([(1, "level\tpage_num\ttext\n5\t1\tHola")], "doc int, tsv string")
    assert parse_words(lacking, "tsv", strict=False).count() == 0 and rows
    with pytest.raises(Exception, match="without block_num, par_num"):
        parse_words(lacking, "tsv").collect()


def test_tsv_cost_of_a_line(spark):
    """A page's header is sought and each line is cut once, whatever reads the cells."""
    head = "level page_num block_num par_num line_num word_num left top width height conf text".split()
    rows = [f"5\t1\t1\t1\t{i}\t1\t0\t{20 * i}\t10\t12\t{i % 101}\tw{i}" for i in range(1, 301)]
    df = spark.createDataFrame([(1, "\n".join(["\t".join(head), *rows])), (2, "\r\n".join(rows))], "doc int, tsv string")
    out = parse_words(df, "tsv")
    assert sorted((r["doc"], r["line"], r["text"], r["top"], r["confidence"]) for r in out.collect()) == [(d, i, f"w{i}", 20.0 * i, float(i % 101)) for d in (1, 2) for i in range(1, 301)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") == 1 and plan.count("split(") == 3 and plan.count("try_cast(") == 11


def test_tsv_stays_with_its_page(spark, tmp_path):
    """A page's TSV is written where the page was read: no words are moved or grouped."""
    from legajo.plans.layout import tsv_words

    spark.createDataFrame([(1, "Hola  mundo\r\n\n x"), (2, " \n"), (3, None)], "page_id long, text string").write.parquet(f"{tmp_path}/quality_inputs.parquet")
    out = tsv_words(spark, str(tmp_path))
    assert sorted((r["doc"], r["line"], r["word_no"], r["text"], r["left"]) for r in out.collect()) == [(1, 1, 1, "Hola", 30.0), (1, 1, 2, "mundo", 80.0), (1, 3, 1, "x", 0.0)]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_blocks(spark):
    def word(line, no, left, top, text, block=1, paragraph=1):
        return (1, 1, block, paragraph, line, no, text, 90.0, float(left), float(top), 30.0, 12.0)

    schema = "doc long, page int, block int, paragraph int, line int, word_no int, text string, confidence double, left double, top double, width double, height double"
    rows = [word(1, 1, 10, 10, "DATOS"), word(1, 2, 50, 10, "DEL"), word(2, 2, 100, 26, "mundo"), word(2, 1, 10, 26, "Hola"), word(3, 1, 10, 42, "continuación"), word(4, 1, 10, 90, "lejos")]
    lines = word_lines(spark.createDataFrame(rows, schema))
    assert {r["text"] for r in lines.collect()} == {"DATOS DEL", "Hola mundo", "continuación", "lejos"}
    out = block_rows(lines).orderBy("layout_block").collect()
    assert [r["text"] for r in out] == ["DATOS DEL", "Hola mundo\ncontinuación", "lejos"]


def test_regions(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 20.0), (1, 2, 50.0, 5.0, 10.0, 20.0), (1, 3, 0.0, 100.0, 10.0, 20.0)], "doc long, region_no long, left double, top double, width double, height double")
    assert {(r["region_no"], r["group_no"]) for r in region_groups(df).collect()} == {(1, 1), (2, 1), (3, 2)}
    # a distance of just the tolerance joins; heights of nothing don't count for it
    edge = [(2, 1, 0.0, 0.0, 9.0, 20.0), (2, 2, 0.0, 20.0, 9.0, 20.0), (2, 3, 0.0, 51.0, 9.0, 20.0), (3, 1, 0.0, 0.0, 9.0, 100.0), (3, 2, 0.0, 95.0, 9.0, 0.0), (3, 3, 0.0, 0.0, 9.0, 0.0), (3, 4, 0.0, 500.0, 9.0, 0.0)]
    out = {(r["doc"], r["region_no"]): r["group_no"] for r in region_groups(spark.createDataFrame(edge, df.schema)).collect()}
    assert [out[2, i] for i in (1, 2, 3)] == [1, 1, 2] and [out[3, i] for i in (1, 2, 3, 4)] == [2, 2, 1, 3]


def test_recogniser_and_breaker(spark):
    def factory():
        def read(b):
            if b is None:
                raise ValueError
            return b.decode(), 90.0

        return read

    out = adapters.recognise(spark.createDataFrame([(1, b"a"), (2, None)], "i int, c binary"), "c", factory).orderBy("i").collect()
    assert [(r["text"], r["status"]) for r in out] == [("a", "OK"), ("", "ERROR:ValueError")]
    now = [0.0]
    breaker = adapters.Breaker(lambda: 1 / 0, clock=lambda: now[0])
    for _ in range(3):
        with pytest.raises(ZeroDivisionError):
            breaker()
    with pytest.raises(RuntimeError):
        breaker()
    now[0] = 31.0
    with pytest.raises(ZeroDivisionError):
        breaker()


def test_images(spark):
    df = spark.createDataFrame([(1, 3, 3, bytes([0, 200, 0, 200, 200, 200, 0, 200, 0]))], "doc long, width int, height int, pixels binary")
    assert bytes(imaging.preprocess(df, "threshold-180").first()["pixels"]) == bytes([0, 255, 0, 255, 255, 255, 0, 255, 0])
    assert bytes(imaging.preprocess(df, "median").first()["pixels"])[4] == 200
    assert [r["ink"] for r in imaging.row_ink(df).orderBy("row_no").collect()] == [2, 0, 2]
    assert imaging.preprocess(df.where("false"), "sharpen").count() == 0


def test_api(spark):
    pages = spark.createDataFrame([(1, "Nit: 5\n\n\nrevlsión del trámite\n", 95.0), (2, None, None), (3, "", 10.0)], "doc long, text string, confidence double")
    out = api.process_documents(pages, "assisted")
    assert {r["doc"]: r["status"] for r in out["quality"].collect()} == {1: "ACCEPTABLE", 2: "INSUFFICIENT", 3: "INSUFFICIENT"}
    assert {r["doc"]: r["restored"] for r in out["restored"].collect()}[1] == "NIT: 5\n\nrevlsión del trámite"
    assert {r["value"] for r in out["fields"].collect()} == {"5"}
    got = api.analyze_semantics(pages, lambda t: ("CORRECTION", t.replace("lsi", "isi"))).collect()
    assert ("revlsión", "SUGGESTED") in {(r["original"], r["status"]) for r in got}
    boxes = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (-1.0, 0.0, 5.0, 5.0)], "left double, top double, width double, height double")
    assert api.review_regions(boxes, 100.0, 100.0).count() == 1


def test_ink_bands(spark):
    ink = [0, 9, 9, 9, 0, 9, 9, 0, 0, 0, 0, 9, 9, 9, 9, 0, 0, 0, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, i, float(x), 0.0, 50.0) for i, x in enumerate(ink)], "doc int, row_no int, ink double, x0 double, x1 double")
    bands = lambda gap, low: sorted((r["y0"], r["y1"]) for r in ink_bands(df, ["doc"], F.lit(3), F.lit(6.0), F.lit(gap), 2, low, 40, 2).collect())
    assert bands(1, 5) == [(1, 7), (11, 15)] and bands(5, 5) == [(1, 15)] and bands(1, 40) == [(1, 7)]
    assert ink_bands(df.where("false"), ["doc"], F.lit(3), F.lit(6.0), F.lit(1), 2, 5, 40, 2).count() == 0


def test_noise_is_the_generator_s():
    import numpy as np

    def slow(n, hit):
        state, out = imaging.SEED, [100] * n

        def draw():
            nonlocal state
            state = (state * imaging.FACTOR + imaging.STEP) % 2**32
            return state / 0xFFFFFFFF

        for i in range(n):
            if draw() < hit:
                out[i] = imaging.DARK if draw() < 0.5 else imaging.LIGHT
        return out

    for hit in (0.018, 0.6):
        assert imaging.noisy(np.full((40, 50), 100, dtype=np.uint8), hit=hit).ravel().tolist() == slow(2000, hit)
    assert imaging.noisy(np.zeros((0, 5), dtype=np.uint8)).shape == (0, 5)


def test_skew(spark):
    import numpy as np

    def page(angle):
        y, x = np.mgrid[0:300, 0:400]
        t = np.deg2rad(angle)
        rows = np.rint(x * np.sin(t) + y * np.cos(t)).astype(int)
        return np.where((rows % 30 < 6) & (x > 40) & (x < 360) & (y > 40) & (y < 260), 0, 255).astype(np.uint8)

    pages = {0: 0.0, 1: 3.0, 2: -4.5, 3: 0.25}
    df = spark.createDataFrame([(i, 400, 300, bytearray(page(a).tobytes())) for i, a in pages.items()] + [(9, 0, 0, bytearray()), (8, 2, 2, bytearray(b"\xff" * 4)), (7, 2, 2, None)], "doc long, width int, height int, pixels binary")
    out = {r["doc"]: (r["angle"], r["verdict"]) for r in imaging.skew_angles(df).collect()}
    assert set(out) == {0, 1, 2, 3, 8} and out[8] == (0.0, "none")
    assert all(abs(out[i][0] - a) <= 0.5 for i, a in pages.items()) and [out[i][1] for i in (0, 1, 2)] == ["none", "turn", "turn"]


def test_files_and_reports(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    for name, data in (("a.png", head), ("b.pdf", b"%PDF-1.4"), ("big.bin", b"x" * 5000), ("empty", b"")):
        (folder / name).write_bytes(data)
    found = files.read_files(spark, str(folder), most=1000).withColumn("size", files.image_size(F.col("content")))
    got = {r["path"].rsplit("/", 1)[1]: (r["mime"], r["kind"], r["size"] and tuple(r["size"])) for r in found.collect()}
    assert got == {"a.png": ("image/png", "image", (640, 480)), "b.pdf": ("application/pdf", "pdf", None)}  # empty files are never listed
    sizes = spark.createDataFrame([(640, 480), (0, 4), (10_000, 10_000), (None, 1)], "w long, h long").select(files.size_allowed(F.col("w"), F.col("h")).alias("ok")).collect()
    assert [r["ok"] for r in sizes] == [True, False, False, False]
    pages = files.pages_of(spark.createDataFrame([(1, 5), (2, 1), (3, 0), (4, None)], "doc int, n int"), "n")
    assert sorted((r["doc"], r["page_number"]) for r in pages.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, path string")
    assert [r["value"] for r in files.requests(df, "id", "path").orderBy("value").collect()] == ['{"id":"1","detectionPath":"x"}', '{"id":"2"}']
    lines = spark.createDataFrame([('{"type":"result","id":"1","ok":true,"result":{"n":2}}',), ("no json",), ('{"type":"ready"}',), (None,), ('{"type":"result","id":"2","error":"E"}',)], "value string")
    assert sorted((r["id"], r["ok"], r["result"] and r["result"]["n"], r["error"]) for r in files.responses(lines, "n int").collect()) == [("1", True, 2, None), ("2", False, None, "E")]
    files.write_text_report(df, F.col("id"), f"{tmp_path}/report")
    assert sorted(r["text"] for r in files.read_texts(spark, f"{tmp_path}/report/part-*").collect() if r["text"]) in (["1\n", "2\n"], ["1\n2\n"])


def test_strict_join(spark):
    from legajo.operators.errors import joined_strict

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (2, "w")], "k int, w string")
    assert joined_strict(a, b, ["k"]).count() == 2
    with pytest.raises(Exception, match="no partner for 2"):
        joined_strict(a, b.where("k = 1"), ["k"]).collect()


def test_synthesis_and_annotation(spark):
    from legajo.operators.restoration import annotate, synthesise

    lines = spark.createDataFrame([(1, 1, "Nit: 5"), (1, 2, "e y j XA A YN / N ON /"), (1, 3, ""), (1, 4, "El mensajcro llega; la carpeta espera"), (1, 5, "carpeta")], "doc long, line_no int, line string")
    fields = spark.createDataFrame([(1, "l5", "15"), (1, "Nit: 5", "NIT: 5"), (1, "l5", "15")], "doc long, original string, replacement string")
    row = lambda ref, a, b, context="El mensajcro llega; la carpeta espera", **k: (1, ref, a, b, context, k.get("status", "SUGGESTED"), k.get("decision", "CORRECTION"), k.get("protected"), k.get("rejection"))
    given = [row(1, "mensajcro", "mensajero"), row(2, "carpeta", "carpetas"), row(3, "espera", "esperan", protected=True), row(4, "llega", "llegue", status="REJECTED", rejection="PROTECTED_FIELD_RESTRICTED_MANUAL_REVIEW_ONLY"), row(5, "espera", "espero", context="otra"), row(6, "llega", "llego", decision="NOISE"), row(7, "mensajero", "mensajera")]
    df = spark.createDataFrame(given, "doc long, ref long, original string, suggested string, context string, status string, decision string, protected boolean, rejection string")
    plain, whole = synthesise(lines, fields).first(), synthesise(lines, fields, df).first()
    assert plain["final_text"] == "NIT: 5\nEl mensajcro llega; la carpeta espera\ncarpeta"
    assert [plain[c] for c in ("field_changes", "rule_changes", "noise_removed", "shields", "applied")] == [2, 0, 1, 0, 0]
    assert whole["final_text"] == "NIT: 5\nEl mensajero llega; la carpeta espera\ncarpeta" and (whole["shields"], whole["applied"]) == (2, 1)  # 'carpeta' occurs twice; 'mensajero' is not in the context
    marks = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("title")) for w, t in (("la casa", 'x"><b>'), ("casa", "$1 \\"), ("mark", "m"), ("a", "no"), ("<i>", "i"))])
    html = spark.createDataFrame([('La casa, la casa & casas: <i> "casa" mark a',)], "t string").select(annotate(F.col("t"), marks).alias("h")).first()["h"]
    assert html == 'La <mark title="$1 \\">casa</mark>, <mark title="x&quot;&gt;&lt;b&gt;">la casa</mark> &amp; casas: <mark title="i">&lt;i&gt;</mark> &quot;casa&quot; <mark title="m">mark</mark> a'


def test_sampled(spark):
    from legajo.tables import sampled

    df = spark.range(20_000).withColumn("x", F.lit("y"))
    some = sampled(df, "id", 1000)
    ids = {r["id"] for r in some.collect()}
    assert 850 < len(ids) < 1150 and ids == {r["id"] for r in sampled(df.repartition(7), "id", 1000).collect()}
    assert sampled(df, "id", 50_000).count() == 20_000 and sampled(df.where("false"), "id", 5).count() == 0
