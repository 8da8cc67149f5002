import pickle
import random

import pytest

from legajo.llm import page_repair as r
from legajo.llm import subjects as s
from legajo.llm.char_editor import Editor, align, applied, operations

WORDS = "informe carpeta oficina semana mañana consulta respuesta observación documento trabajo ciudad escuela puente factura sentencia médico camino cuaderno registro director vecino pregunta noticia ventana".split()
TOPICS = {"law": "sentencia demanda juzgado tutela".split(), "health": "médico vacuna síntoma farmacia".split()}


def pair(rng):
    """A correct text and one with noise, and the noisy lines."""
    sentences = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 9))).capitalize() + "." for _ in range(10)]
    correct = " ".join(sentences)
    lines, line = [], ""
    for w in correct.split():
        if len(line) + len(w) > 48:
            if rng.random() < 0.4 and len(w) > 6 and w.isalpha():
                line, w = f"{line} {w[:4]}-", w[4:]
            lines.append(line.strip())
            line = w
        else:
            line = f"{line} {w}"
    lines.append(line.strip())
    out, truth = [], set()
    head = f"UNIDAD DE {rng.choice(['ARCHIVO', 'ENTREGA'])} {rng.randint(100, 999)}"
    for page in range(0, len(lines), 6):
        out.append(head if page == 0 else "\f" + head)
        truth.add((len(out), "header"))
        for x in lines[page : page + 6]:
            bad = next((w for w in x.split() if "o" in w[1:-1] and len(w) > 5 and w.isalpha()), None) if rng.random() < 0.2 else None
            if bad:
                x = x.replace(bad, bad[0] + bad[1:].replace("o", "0", 1), 1)
            out.append(x)
            if bad:
                truth.add((len(out), "misread"))
            if x.endswith("-"):
                truth.add((len(out), "hyphen"))
        out.append(f"Página {page // 6 + 1}")
        truth.add((len(out), "page_number"))
    return correct, "\n".join(out), truth


@pytest.fixture(scope="module")
def repairer():
    rng = random.Random(8)
    pairs = [pair(rng) for _ in range(120)]
    words = r.Words({w: 500 for w in WORDS}, {w: 900 for w in WORDS})
    return r.train([(noisy, correct) for correct, noisy, _ in pairs], words), pairs, rng


def test_page_repair(repairer):
    model, _, rng = repairer
    right = wrong = missed = 0
    for _ in range(40):
        correct, noisy, truth = pair(rng)
        got = set(model.noises(noisy))
        right, wrong, missed = right + len(got & truth), wrong + len(got - truth), missed + len(truth - got)
    assert right >= 0.95 * (right + wrong) and right >= 0.95 * (right + missed)
    assert model.noises("") == [] and model.paragraphs(None) is None and model.paragraphs("") == ""
    assert len(model.paragraphs("Informe carpeta oficina. " * 20_000)) > 400_000


def test_every_counted_word_is_looked_up(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abñé") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"sentencia", "vacuna-dosis", "ñandú"})
    frame = lambda times: spark.createDataFrame([(" ".join([w] * (i % times + 1)),) for i, w in enumerate(names)], "text string")
    correct, recognised = frame(5), frame(7)
    full = r.count_words(correct, recognised)
    assert type(full.clean) is dict and full.clean["sentencia"] == names.index("sentencia") % 5 + 1 and len(full.seen) == len(names)
    for keep in (0, 1, 20):
        few = pickle.loads(pickle.dumps(r.count_words(correct, recognised, keep)))
        assert dict.__len__(few.clean) <= keep
        for w in [*names, "", "a", "zzz", "sentenci", "sentenciaa", "ñ"]:
            assert (few.clean.get(w, 0), few.seen.get(w, 0), w in few.clean, few.known(w)) == (full.clean.get(w, 0), full.seen.get(w, 0), w in full.clean, full.known(w))
        assert dict(few.clean.items()) == full.clean and dict(few.seen.items()) == full.seen
        for w in ("scntencia", "sentcncia", "ñanbú", "sentenxia"):
            learned = {"c": ["e"], "b": ["d"]}
            assert Editor(few, learned=learned).options(w) == Editor(full, learned=learned).options(w)
        assert ("sentencia", ((1, "c", "e"),)) in Editor(few, learned=learned).options("scntencia")
    none = r.count_words(correct.where("false"), recognised.where("false"))
    assert none.clean == {} and none.seen == {}


def test_operations_are_read_off_pairs():
    assert align("mcnsajero", "mensajero") == [(1, "c", "e")]
    assert align("documcrito", "documento") == [(5, "c", "e"), (6, "ri", "n")]
    assert align("Descle", "Desde") == [(3, "cl", "d")] and align("segiiirá", "seguirá") == [(3, "ii", "u")]
    assert align("feha", "fecha") == [(2, "", "c")] and align("fecha", "fecha") == [] and align("", "") == []
    assert list(operations("Descle", ((3, "cl", "d"),))) == [(3, "Rd"), (4, "D")]
    assert list(operations("mes", ((0, "m", "rn"),))) == [(0, "Rr"), (0, "In")]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcñ") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert applied(a, tuple(align(a, b))) == b


def test_a_misreading_never_seen_is_repaired(repairer):
    model, _, _ = repairer
    assert set(model.editor.learned) == {"0"}  # nothing else stands in the pairs
    for wrong, right in (("respvesta", "respuesta"), ("carpxta", "carpeta"), ("sentencja", "sentencia"), ("documeento", "documento"), ("obseración", "observación")):
        assert model.fix(wrong)[0] == right
    assert model.fix("informe") is None and model.fix("Xqzw") is None
    assert [n for n in model.noises("La carpxta respuesta del informe") if n[1] == "misread"] == [(1, "misread")]


def test_bad_lines_are_read_too(repairer):
    model, _, _ = repairer
    assert model.sound("informe zzzk qqwx pprt".split()) == 1 and model.sound("zzzk qqwx".split()) == 0 and model.sound([]) == 2
    _, _, _, misread, fixed = model.read("zzzk inf0rme qqwx pprt carpeta vvnm")
    assert misread == {0} and "informe" in fixed[0]


def test_models_are_kept_in_a_file(repairer, tmp_path):
    model, pairs, _ = repairer
    model.save(tmp_path / "models")
    again = r.Repairer.load(tmp_path / "models")
    assert all(again.noises(noisy) == model.noises(noisy) for _, noisy, _ in pairs[:5])


def test_verdicts_do_not_change_with_the_table(repairer):
    model = repairer[0]
    clean, seen = {"documento": 60_000, "quía": 1}, {"documento": 1_336_000, "nlt": 30, "fccha": 9, "hospitaI": 1, "guía": 350, "quía": 4, "recibo": 2, "sello": 12, "entregado": 300}
    tables = [r.Words({w: n * k for w, n in clean.items()}, {w: n * k for w, n in seen.items()}) for k in (1, 10, 100)]
    lines = (["nlt", "fccha"], ["nlt", "documento"], ["entregado", "guía", "nlt"])
    assert [[r.Repairer(t, model.tagger, model.editor).sound(x) for x in lines] for t in tables] == [[0, 2, 2]] * 3
    learned = {"c": ["e"], "1": ["l"], "i": ["l"], "q": ["g"]}
    for word in ("guía", "scllo", "sc1lo", "rccibo", "fecha", "entrcgado", "documcnto", "documxnto"):
        assert len({tuple(Editor(t, learned=learned).options(word)) for t in tables}) == 1, word
    assert Editor(tables[2], learned=learned).options("guía") == [("guía", ())]  # nothing rarer is proposed


def test_paragraphs(repairer):
    model, pairs, _ = repairer
    correct, noisy, _ = pairs[0]
    words = model.paragraphs(noisy).split()
    assert sum(a == b for a, b in zip(words, correct.split())) >= 0.9 * len(correct.split())


def test_repair_frames(spark, repairer):
    model, pairs, _ = repairer
    df = spark.createDataFrame([("a", 1, pairs[1][1], "clash"), ("a", 1, pairs[1][1], "clash"), ("a", 2, None, "clash"), ("a", 3, "", "clash")], "field string, rec_id long, text string, noise string")
    one = [tuple(x) for x in r.noise_lines(df, model).collect()]
    assert {x[1] for x in one} == {1} and len(one) == 2 * len(model.noises(pairs[1][1]))
    assert {x["rec_id"]: x["text"] for x in r.repaired(df, model).collect()}[2] is None
    assert r.noise_lines(df.where("false"), model).count() == 0


def test_counts_cover_all_texts(spark):
    df = spark.createDataFrame([("Uno dos dos",), (None,), ("",), ("dos",)], "text string")
    words = r.count_words(df, df)
    assert words.clean == {"dos": 3, "uno": 1} and words.seen == {"dos": 3, "uno": 1}


def documents(rng, n):
    out, labels = [], {}
    general = "el informe de la oficina no está en la carpeta con la respuesta del director".split()
    for d in range(n):
        topics = rng.sample(list(TOPICS), rng.choice([1, 1, 2])) if d % 5 else []
        text = []
        for i in range(12):
            words = rng.sample(general, 8)
            if topics and i % 3 == 0:
                words[3:3] = rng.sample(TOPICS[topics[i // 3 % len(topics)]], 2)
            elif i == 7 and d % 3 == 0:  # a passing mention
                words[3:3] = rng.sample(rng.choice([x for t, x in TOPICS.items() if t not in topics] or [["vez"]]), 1)
            text.append(" ".join(words).capitalize() + ".")
        out.append((d, " ".join(text), "s"))
        if topics:
            labels[d] = set(topics)
    return out, labels


def test_subjects(spark):
    rng = random.Random(9)
    docs, labels = documents(rng, 900)
    model = s.fit([(d, t) for d, t, _ in docs[:200] if d in labels], labels, sorted(TOPICS))
    s.learn(model, model.votes([t for _, t, _ in docs], [x for _, _, x in docs]))
    df = spark.createDataFrame([*docs[200:], (990, None, "s"), (991, "", None), (992, "¬¬ ~~", "s")], "doc_id long, text string, source string").selectExpr("*", "'clash' as subject")
    got = {(x["doc_id"], x["subject"]) for x in s.assign(df, model).collect()}
    want = {(d, t) for d, names in labels.items() if d >= 200 for t in names}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert s.assign(df.where("false"), model).count() == 0
    passing, _ = documents(rng, 1)
    assert not (model.posterior([passing[0][1] + " La sentencia."], ["s"]) > 0.5).any()
    assert model.posterior([], []).shape == (0, 2)
    # the accuracies were learned without labels; labels only confirm them
    v = model.votes([t for _, t, _ in docs[200:]], ["s"] * 700)
    truth = [[n in labels.get(d, ()) for n in sorted(TOPICS)] for d, _, _ in docs[200:]]
    right = [(a == 2) == y for row, own in zip(v.section, truth) for a, y in zip(row, own) if a]
    assert abs(model.accuracies()["section"] - sum(right) / len(right)) < 0.1


def test_fitted_from_frames(spark):
    rng = random.Random(12)
    docs, labels = documents(rng, 500)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    names = spark.createDataFrame([(t,) for t in TOPICS] + [(None,)], "subject string")
    rows = spark.createDataFrame([(d, t) for d in labels for t in labels[d] if d < 150], "doc_id long, subject string")
    model = s.fitted(spark, df, rows, names)
    got = {(x["doc_id"], x["subject"]) for x in s.assign(df, model).collect()}
    want = {(d, t) for d, own in labels.items() for t in own}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    empty = s.fitted(spark, df.where("false"), rows.where("false"), names)
    assert s.assign(df, empty).count() == 0


def test_fitted_on_every_document(spark):
    rng = random.Random(3)
    docs, labels = documents(rng, 6400)
    docs = [(d, ". ".join(t.split(". ")[:4]), x) for d, t, x in docs]
    general = "el informe de la oficina no está en la carpeta con la respuesta del director".split()
    for d in range(6400, 6403):  # the only documents of their subject and source are long ones
        docs.append((d, " ".join(" ".join([*rng.sample(general, 8), *(["impuesto", "recaudo"] if i % 3 == 0 else [])]) + "." for i in range(200)), "t"))
        labels[d] = {"taxes"}
    assert sum(d in labels for d, _, _ in docs) > 4000 and min(len(t) for _, t, _ in docs[6400:]) > 8000
    names = sorted([*TOPICS, "taxes"])
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((docs, "doc_id long, text string, source string"), ([(d, t) for d in labels for t in labels[d]] + [(None, "law")], "doc_id int, subject string"), ([(t,) for t in names], "subject string"))]
    model = s.fitted(spark, frames[0].repartition(5), *frames[1:])
    whole = s.fit([(d, t) for d, t, _ in docs if d in labels], labels, names)
    s.learn(whole, whole.votes([t for _, t, _ in docs], [x for _, _, x in docs]))
    assert model.lexicon["es"]["impuesto"] == names.index("taxes") and model.lexicon == whole.lexicon
    assert set(model.source) == {"s", "t"}
    assert all((getattr(model, k) == getattr(whole, k)).all() for k in ("prior", "band", "section", "address"))
    assert all((model.source[x] == whole.source[x]).all() for x in "st")
    assert {(x["doc_id"], x["subject"]) for x in s.assign(frames[0].where("doc_id >= 6400"), model).collect()} == {(d, "taxes") for d in range(6400, 6403)}
    none = s.fitted(spark, frames[0].limit(50), frames[1], frames[2].where("false"))
    assert s.assign(frames[0].limit(50), none).count() == 0


def test_fit_without_labels():
    model = s.fit([], {}, ["law"])
    s.learn(model, model.votes(["El juzgado dictó sentencia."], [None]))
    assert not (model.posterior(["El juzgado dictó sentencia."], [None]) > 0.5).any()
