import unicodedata

import pytest

from legajo.llm import personal as p
from legajo.llm import same_look as s
from legajo.llm import text_kind as k


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None), ("", ""), ("plain ñandú", "plain ñandú"), ("ｌｏ ２０２６", "lo 2026"), ("El dí​a", "El día"), (unicodedata.normalize("NFD", "canción"), "canción"), ("mensajerο", "mensajero"),
        ("ѕе vа", "se va"), ("привет λόγος Ω β", "привет λόγος Ω β"), ("ﬁn", "fin"), ("3.º 2.ª ½ 25 °C €", "3.º 2.ª ½ 25 °C €"), ("“a” — • «b»", "“a” — • «b»"), ("a\tb\r\n\fc", "a\tb\r\n\fc"), ("о́", "ó"), ("́a", "́a"),
        ("Он был у реки", "Он был у реки"), ("красивая роса", "красивая роса"), ("сорок ухо оса", "сорок ухо оса"), ("ο λόγος", "ο λόγος"), ("Ω а casa", "Ω a casa"), ("El сasa ο", "El casa o"), ("ΝΙΤ: 86", "NIT: 86"),
        ("1З5 y ЗAPATO", "135 y ЗAPATO"), ("\u1112\u1161\u11ab", "\ud55c"), ("\u0995\u09c7\u09be", "\u0995\u09cb"), ("\u0d46\u0d3e", "\u0d4a"), ("x\u200b\u0301", "x\u0301"),
    ],
)
def test_consistent_form(text, want):
    assert s.canonical(text) == want
    assert s.canonical(want) == want and (want is None or unicodedata.is_normalized("NFC", want))


def test_canonicalise_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ｌｏ", "x"), (2, None, "y")], "i int, text string, other string")
    assert [tuple(r) for r in s.canonicalise(df, "text", "text").select("i", "other", "text").orderBy("i").collect()] == [(1, "x", "lo"), (2, "y", None)]
    assert s.canonicalise(df.where("false"), "text", "t").count() == 0


TEXT = """El Sr. Juan Carlos Rojas de Paz, con C.I. N° 1234567-1A, vive en Av. Las Palmas No. 120, zona Norte.
Escribir a ana.rojas+x@correo.example o +591-5-123 4567. Llamó Rojas Paz, Elena al 00591-7123-4567 int. 12.
El monto asciende a Bs 8.505,10 según el comprobante 62734464. Ver folio 735262 y memorándum N° 71412/2026.
La plaza Juan Rojas, frente a la oficina. Reunión en la calle Tres Lomas. Código TV-125-2026."""


def test_personal_spans():
    got = {(x.kind, p.mention(TEXT, x)) for x in p.find(TEXT)}
    assert got == {
        ("name", "Juan Carlos Rojas de Paz"), ("identity_number", "1234567-1A"), ("street_address", "Av. Las Palmas No. 120"), ("email", "ana.rojas+x@correo.example"),
        ("phone", "+591-5-123 4567"), ("name", "Rojas Paz, Elena"), ("phone", "00591-7123-4567"),
    }
    assert p.redact("Sr. Juan Rojas\nPaz, tel. 7123 4567") == "Sr. [NAME], tel. [PHONE]"
    assert p.mention("Juan\nRojas", p.find("Juan\nRojas")[0]) == "Juan Rojas"
    assert p.find(None) == [] and p.find("") == [] and p.redact(None) is None
    assert p.find("x" * 200_000) == []


def test_lower_case_names_need_context():
    found = lambda x: [p.mention(x, s) for s in p.find(x) if s.kind == "name"]
    assert found("Entregado a v. rojas paz para su conocimiento.") == ["v. rojas"] or found("Entregado a v. rojas pazos para su conocimiento.") == ["v. rojas pazos"]
    assert found("a. surco reciente;") == [] and found("b. base de datos suficiente;") == []


def test_validators():
    assert p.luhn("4539578763621486") and not p.luhn("4539578763621487")
    assert p.mod97("GB82WEST12345698765432") and not p.mod97("GB82WEST12345698765431")
    assert p.redact("pago con 4539 5787 6362 1486") == "pago con [CARD_NUMBER]"


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("El señor Xavier Quispe Mamani pide turno.", "name", "Xavier Quispe Mamani"), ("Sra. Wendy Apaza", "name", "Wendy Apaza"), ("Comunicarse con Omar Flores", "name", "Omar Flores"),
        ("SR. XAVIER QUISPE DE LA PAZ,", "name", "XAVIER QUISPE DE LA PAZ"), ("El señor Director General", "name", None), ("Sr. Juez Segundo", "name", None), ("señor Xavier", "name", None),
        ("Tel. (555) 123-4567", "phone", "(555) 123-4567"), ("SSN 123-45-6789", "identity_number", "123-45-6789"), ("vive en 123 Main Street", "street_address", "123 Main Street"),
        ("tarjeta 3782 822463 10005", "card_number", "3782 822463 10005"), ("tarjeta 3782 822463 10006", "card_number", None), ("DNI 12345678Z", "identity_number", "12345678Z"), ("12.345.678-Z", "identity_number", "12.345.678-Z"),
        ("CPF 529.982.247-25", "identity_number", "529.982.247-25"), ("factura 529.982.247-26", "identity_number", None), ("escribir a jperez (arroba) correo.example", "email", "jperez (arroba) correo.example"),
    ],
)
def test_forms_beyond_the_lists(text, kind, want):
    assert [p.mention(text, x) for x in p.find(text) if x.kind == kind] == ([want] if want else [])


def test_confirmed_rows(spark):
    rows = [("t", 1, 0, "", "tarjeta 4111 1111 1111 1111 y 4111 1111 1111 1112, DNI 12345678Z"), ("t", 2, 0, "", None), ("t", 3, 0, "", ""), ("t", 4, 0, "", "IBAN GB82 WEST 1234 5698 7654 32")]
    df = spark.createDataFrame(rows, "field string, rec_id long, item_no int, hint string, text string")
    assert {(r["rec_id"], r["pii_type"], r["found"], r["confirmed_by"]) for r in p.confirmed(df).collect()} == {
        (1, "card_number", "4111 1111 1111 1111", "luhn"), (1, "identity_number", "12345678Z", "mod23"), (4, "account_number", "GB82 WEST 1234 5698 7654 32", "mod97"),
    }


def test_found_rows(spark):
    df = spark.createDataFrame([("text", 1, 0, "", TEXT), ("text", 1, 0, "", TEXT), ("raw", 2, 1, "identity_number", "46O2448260"), ("raw", 3, 1, "", None), ("raw", 4, 1, "", "")], "field string, rec_id long, item_no int, hint string, text string")
    rows = p.found(df).collect()
    assert ("raw", 2, 1, "identity_number", "46O2448260") in {tuple(r) for r in rows} and len([r for r in rows if r["rec_id"] == 1]) == 14
    assert p.found(df.where("false")).count() == 0 and p.redacted(df).count() == 5


def test_found_reads_what_redaction_reads(spark):
    texts = ["wyufuelana(at)oficina.example", "chirnuelin_hernan [arroba] mesa-partes.test", "hzanivin (arroba) tramites.test", "uno[at]dos.test", "la encargada, por g. zañondte zañeskovia", "nada que ver"]
    df = spark.createDataFrame([("value", i, 0, "", t) for i, t in enumerate(texts)], "field string, rec_id long, item_no int, hint string, text string")
    found = {(r["rec_id"], r["pii_type"], r["found"]) for r in p.found(df).collect()}
    assert found == {(i, s.kind, p.mention(t, s)) for i, t in enumerate(texts) for s in p.find(t)}
    assert {(0, "email", texts[0]), (1, "email", texts[1]), (4, "name", "g. zañondte zañeskovia")} <= found
    changed = {r["rec_id"] for r in p.redacted(df).collect() if r["text"] != texts[r["rec_id"]]}
    assert changed == {r for r, _, _ in found} == {0, 1, 2, 3, 4}


PROSE = [
    "El río creció durante la noche y los vecinos cruzaron el puente con linternas. Nadie supo decir quién dio la voz de alarma, pero todos la oyeron. Al amanecer quedaban charcos en la plaza.",
    "La biblioteca abrió sus puertas a las nueve, como todos los lunes. Una maestra pidió tres mapas antiguos y un cuaderno de notas. El encargado los buscó entre los estantes del fondo.",
    "No hay receta que resuelva el problema sin esfuerzo. Cuando el motor se calienta, conviene esperar que baje la temperatura; después se mide el aceite y se anota el resultado.",
    "The ferry left the harbour before the storm was announced. Nobody on board was worried, although the captain had read the forecast. They reached the island in time for lunch.",
    "O trem parou na estação por causa da chuva. Os passageiros desceram com calma e foram até o mercado, onde havia café quente e pão de milho.",
]


@pytest.fixture(scope="module")
def case(spark):
    rows = k.labelled_texts(PROSE, 3000)
    stats = k.with_statistics(spark.createDataFrame(rows, "kind string, text string")).select("kind", *k.RULE_STATS).toPandas()
    return k.case_sql(k.best_of(stats[k.RULE_STATS].to_numpy(float), stats["kind"].to_numpy(), k.RULE_STATS, 3))


def test_text_kinds_on_held_out_texts(spark, case):
    held = k.labelled_texts(PROSE, 400, seed=77)
    df = spark.createDataFrame([(i, kind, t, 0.5) for i, (kind, t) in enumerate(held)], "i int, label string, text string, digit_ratio double")
    out = k.classified(df, case).select("label", "text_kind").collect()
    assert sum(r["label"] == r["text_kind"] for r in out) >= 0.95 * len(held)
    blank = spark.createDataFrame([(None,), ("",), (" \n ",)], "text string")
    assert k.classified(blank, case).count() == 0
    stats = k.with_statistics(spark.createDataFrame([(None,), ("",), ("Hola mundo.\n- x",)], "text string")).collect()
    assert stats[0]["n_words"] is None and stats[1]["common_words"] == 0 and stats[2]["n_lines"] == 2 and stats[2]["punctuated_lines"] == 0.5
    long = k.with_statistics(spark.createDataFrame([("palabra " * 50_000,)], "text string")).first()
    assert long["n_words"] == 50_000


def test_splits_without_a_kind():
    import numpy as np

    x, kinds = np.arange(40.0).reshape(-1, 1), np.array(["prose"] * 37 + ["list"] * 3)
    for seed in range(40):  # some splits leave no list to grow from
        rules = k.induce(x, kinds, ["a"], seed=seed)
        assert all(r.kind == "list" for r in rules)
    assert k.induce(x[:0], kinds[:0], ["a"]) == [] and k.induce(x[:37], kinds[:37], ["a"]) == []


def test_rules_are_simple():
    rule = k.Rule("list", [("a", ">=", 1.0), ("b", "<=", 5.0), ("a", ">=", 2.0), ("b", "<=", 7.0)]).simplified()
    assert rule.conditions == [("a", ">=", 2.0), ("b", "<=", 5.0)] and rule.sql() == "a >= 2D AND b <= 5D"
    assert k.labelled_texts([], 40) and k.labelled_texts(["", " "], 40)
