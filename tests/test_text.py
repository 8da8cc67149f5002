import random

from pyspark.sql import functions as F

from legajo.functions import quality as q
from legajo.functions import text as t
from legajo.operators.errors import micro_rates
from legajo.operators.restoration import alignment, edit_script, grapheme_tokens, replaced_spans, scored_alignment, changes, collapse_blanks, restored_lines, word_changes


def brute(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_rates(spark):
    rows = [("ABC123", "ABC128"), ("uno dos tres", "uno dos cuatro"), ("", ""), ("", "x"), ("ñandú", "nandu"), (None, "x"), ("a  b\n", "a b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    a, b = t.squeeze(F.col("a")), t.squeeze(F.col("b"))
    out = {r["i"]: r for r in df.select("i", t.char_error_rate(a, b).alias("c"), t.word_distance(a, b).alias("w")).collect()}
    assert out[0]["c"] == 1 / 6 and out[1]["w"] == 1 and out[2]["c"] == 0 and out[3]["c"] == 1 and out[4]["c"] == 2 / 5 and out[5]["c"] is None and out[6]["c"] == 0


def test_bit_vectors_give_the_edit_distance(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abñé𝒳") for _ in range(rng.randint(0, 90))), "".join(rng.choice("abñé𝒳") for _ in range(rng.randint(0, 90)))) for _ in range(120)] + [("", ""), ("", "xyz"), ("abc", "abc"), ("xabcx", "xabx")]
    assert all(t.bit_distance(a, b) == brute(a, b) for a, b in pairs)
    long = "palabra " * 12_000
    df = spark.createDataFrame([*pairs, (None, "x"), ("x", None), (long, long.replace("bra p", "bro p", 7))], "a string, b string")
    out = [r["d"] for r in df.select(t.text_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert out == [brute(a, b) for a, b in pairs] + [None, None, 7]


def test_many_distinct_words(spark):
    a = " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame([(a + " fin", a + " fim")], "a string, b string")
    words = F.array_distinct(F.concat(t.tokens(F.col("a")), t.tokens(F.col("b"))))
    last = df.select(t.words_as_chars(F.array(F.lit("w39999"), F.lit("w55")), words).alias("c")).first()["c"]
    assert len(last) == 2 and len(set(last)) == 2 and ord(last[0]) > 0x10000


def test_micro_rates(spark):
    rows = [(1, 1, 10, 5, 100.0), (2, 1, 20, 10, 300.0), (0, 0, 0, 0, float("nan")), (None, None, None, None, -5.0)]
    df = spark.createDataFrame(rows, "character_distance long, word_distance long, reference_characters long, reference_words long, d double")
    r = micro_rates(df, [], "d").first()
    assert (r["cer"], r["wer"], r["total_duration_ms"], r["mean_duration_ms"]) == (0.1, round(2 / 15, 6), 400.0, 200.0)
    assert micro_rates(df.where("false"), [], "d").first()["cer"] == 0.0


def test_verdicts(spark):
    rows = [("a", 90.0), ("a", 70.0), ("a", 69.99), ("a", None), (" \n ", 99.0), (None, 99.0)]
    out = spark.createDataFrame(rows, "t string, c double").select(q.page_quality(F.col("t"), F.col("c"))["status"].alias("s")).collect()
    assert [r["s"] for r in out] == ["ACCEPTABLE", "REVIEW", "INSUFFICIENT", "REVIEW", "INSUFFICIENT", "INSUFFICIENT"]
    noise = spark.createDataFrame([("e y j XA A YN / N ON /",), ("/ - - RDA — o];",), ("-----",), ("La Paz, 25 de agosto",), ("",), (None,)], "x string").select(q.noise_line(F.col("x")).alias("n"))
    assert [r["n"] for r in noise.collect()] == [True, True, False, False, True, True]
    score = {r["x"]: r["s"] for r in spark.createDataFrame([("revlsión",), ("oficial",), ("f1ebre",), ("limpio",), ("123",), ("a",)], "x string").select("x", q.anomaly_score(F.col("x")).alias("s")).collect()}
    assert score["revlsión"] > score["oficial"] and score["f1ebre"] > score["limpio"] and score["123"] == -50 and score["a"] == -100


def test_restoration(spark):
    lines = ["documentacioń", "Nit: 5", "Códiо: x", "Monto Bs. 8. S05, 10", "Fecha: 1S/09/26", "Con CI. N.e 13497224 el miercoles", "6 Atentamente,", "/ - - RDA — o];", "", "", None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, line_no int, line string")
    out = {r["line_no"]: r for r in restored_lines(df).collect()}
    want = ["documentación", "NIT: 5", "Código: x", "Monto Bs. 8.505,10", "Fecha: 15/09/26", "Con C.I. N° 13497224 el miércoles", "Atentamente,"]
    assert [out[i]["s8"] for i in range(7)] == want and out[7]["noise"] and not out[8]["noise"]
    assert changes(df).where("step = 'noise'").count() == 1
    kept = collapse_blanks(df.withColumn("line", F.coalesce("line", F.lit(""))), "line").orderBy("line_no").collect()
    assert [r["line_no"] for r in kept] == list(range(8))


def test_alignment_is_minimal(spark):
    rng = random.Random(4)
    pairs = [("", ""), ("abc", ""), ("", "abc"), (None, "x"), ("aaaa", "aa")] + [("".join(rng.choice("abñ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abñ") for _ in range(rng.randint(0, 9)))) for _ in range(40)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rows = alignment(df, ["i"], "a", "b").orderBy("i", "step").collect()
    for i, (a, b) in enumerate(pairs):
        own = [r for r in rows if r["i"] == i]
        assert sum(r["kind"] != "match" for r in own) == brute(a or "", b or "")
        assert "".join(r["reference"] for r in own) == (a or "") and "".join(r["prediction"] for r in own) == (b or "")


def test_word_changes(spark):
    df = spark.createDataFrame([(1, "uno vcripicar dos\ntres", "uno verificar dos\ntres"), (2, None, "x"), (3, "a b c", "a x y c"), (4, "a b", "a b extra")], "k int, a string, b string")
    out = {(r["k"], r["original"], r["corrected"]) for r in word_changes(df, "k", "a", "b").collect()}
    assert out == {(1, "vcripicar", "verificar"), (3, "b", "x y")}


def test_replaced_spans():
    split = lambda x: x.split()
    assert replaced_spans(split("a b c d"), split("a x y d")) == [("b", "x"), ("c", "y")]
    assert replaced_spans(split("a b d"), split("a x y d")) == [("b", "x y")]
    assert replaced_spans(split("a b"), split("b a")) == [] and replaced_spans([], split("a")) == [] and replaced_spans(split("a"), []) == []
    assert list(edit_script(split("a b"), split("b a"))) == [("-", "a"), ("=", "b"), ("+", "a")]  # of equals the original goes first
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("uvwx") for _ in range(rng.randint(0, 9))] for _ in range(2))
        script = list(edit_script(a, b))
        assert [w for o, w in script if o in "=-"] == a and [w for o, w in script if o in "=+"] == b
        best = {(len(a), j): 0 for j in range(len(b) + 1)} | {(i, len(b)): 0 for i in range(len(a) + 1)}
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        assert sum(o == "=" for o, _ in script) == best[0, 0]
    long = [f"w{i % 50}" for i in range(4000)]
    assert replaced_spans(long, [*long[:2000], "otro", *long[2001:]]) == [("w0", "otro")]


def test_grapheme_tokens():
    one = lambda x, p=0.9: [(c, p) for c in x]
    assert grapheme_tokens([]) == [] and grapheme_tokens([[]]) == [] and grapheme_tokens([one("  ")]) == []
    assert grapheme_tokens([[("e", 0.9), ("\u0301", 0.4)]]) == [("é", 0.4, False)]
    assert grapheme_tokens([one("a"), one("b")]) == [("a", 0.9, False), (" ", None, True), ("b", 0.9, False)]
    assert grapheme_tokens([[("a", 0.9), (" ", 0.3)], one("b")])[1] == (" ", 0.3, False)
    assert grapheme_tokens([[(" ", 0.1), ("a", 0.9), ("\u00a0", 0.5), (" ", 0.6), ("b", 0.8), (" ", 0.2)]]) == [("a", 0.9, False), (" ", 0.5, False), ("b", 0.8, False)]


def test_scored_alignment(spark):
    chars = lambda x: [[(c, 0.5 + 0.01 * i) for i, c in enumerate(line)] for line in x]
    rows = [(1, "canción", chars(["cancio\u0301m"])), (2, "uno dos", chars(["uno", "dos"])), (3, None, None), (4, "abc", []), (5, "abcd", chars(["xabcd"]))]
    df = spark.createDataFrame(rows, "k int, t string, l array<array<struct<ch: string, confidence: double>>>")
    out = {}
    for r in scored_alignment(df, ["k"], "t", "l").orderBy("k", "step").collect():
        out.setdefault(r["k"], []).append((r["kind"][0], r["confidence"], r["synthetic"]))
    assert [k for k, _, _ in out[1]] == list("mmmmmms") and out[1][5][1] == 0.55 and out[2][3] == ("m", None, True) and 3 not in out
    assert out[4] == [("d", None, False)] * 3 and [k for k, _, _ in out[5]] == list("immmm")  # one inserted character is one error
