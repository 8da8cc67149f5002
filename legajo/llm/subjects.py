"""Subject areas of each document, from labelling functions whose accuracy is learned.

A lexicon comes from all labelled documents: a latent model
gives every sentence one hidden topic, general content or one of its document's
subjects; expectation maximisation finds the words of each topic, per language,
and those that belong to one subject nearly always become its lexicon.  Four
labelling functions then vote on each document and subject:

* lexicon: the share of the document's sentences that hold a lexicon word,
* section: whether the opening section is about the subject,
* address: whether an addressee line or mail domain names the subject,
* source: the source the document came from.

What the votes are worth is learned without labels.  Every document and subject
has a hidden state (absent, mentioned in passing, treated beside others or alone);
expectation maximisation over the votes on all documents estimates how
each function votes in each state, from how the functions agree.  Documents get
the subjects that they treat with a probability over one half.

No document is left out of either fit.  Both work on counts that are added up where
the rows are: of words and topics, round by round, and of combinations of votes,
once.  The driver holds a row per word and a row per combination and source; the
votes themselves are cast once and kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StringType, StructField, StructType

from legajo.llm.personal import streets
from legajo.llm.same_look import canonical
from legajo.tables import cut, table

#: Bits of the filter that finds labelled documents before they are joined; only the speed depends on it.
FILTER_BITS = 1 << 24
#: Labelled documents whose sentences are weighed at once, and the unit that
#: probabilities are added up in: whole numbers have the same sum in any order.
TOGETHER, UNIT = 1000, 1 << 30
ROUNDS = 10
#: Function words by which a document's language is told.
LANGUAGES = {
    "es": "el la los las de del en con por que una un se no al su quedó está es y".split(),
    "pt": "o a os as do da dos das em com não uma um no na ao à foi está é pela pelo e".split(),
    "en": "the of and to in was is with for that an has under there does be".split(),
}
_of_language = {k: frozenset(v) for k, v in LANGUAGES.items()}
#: Upper edges of the bands of the sentence share: nothing, then equal steps.
BANDS = np.r_[1e-9, np.arange(1, 25) / 48.7]
#: How many times lower than the peaks beside it a valley must be.
CLEAR = 5.0
#: Hidden states of a document and subject.
STATES = ("absent", "mentioned", "treated beside others", "treated alone")

_joint = re.compile("[-¬­=] ?\\n[ \\t]*")
_end = re.compile(r"(?<=[.?!])[\"»)”]*\s+|\n\s*\n|\f")
_word = re.compile(r"[^\W\d_]+")
_addressee = re.compile(r"(?im)^[ \t]*(?:señor(?:es|a)?|sr|sra|a[ ]la|al|atención|at|attn|to|para|prezad[oa]s?)\b[^\n.]{0,60}")
_mail = re.compile(r"[\w.+-]+@[\w.-]+")


def sentences(text: str) -> list[set[str]]:
    """The words of each sentence in lower case; cut words are rejoined, street
    addresses left out, headings and greetings count as sentences."""
    plain = _joint.sub("", canonical(text))
    for m in reversed(streets(plain)):
        plain = f"{plain[: m.start()]} {plain[m.end() :]}"
    return [set(w) for w in (_word.findall(s) for s in _end.split(plain.lower())) if w]


def language(split: list[set[str]]) -> str:
    counts = {k: sum(len(own & s) for s in split) for k, own in _of_language.items()}
    return max(counts, key=counts.get)


@dataclass
class Votes:
    """The votes on some documents: a row per document, a column per subject."""

    share: np.ndarray
    section: np.ndarray  # 0 no opening section, 1 it is about others, 2 about this one
    address: np.ndarray  # 0 no one named, 1 others are, 2 this one is
    source: list[str | None]


@dataclass
class Model:
    subjects: list[str]
    #: language -> word -> number of its subject
    lexicon: dict[str, dict[str, int]]
    #: log probabilities: of the states per subject; of each vote in each state (votes x states)
    prior: np.ndarray | None = None
    band: np.ndarray | None = None
    section: np.ndarray | None = None
    address: np.ndarray | None = None
    #: source -> subjects x states
    source: dict[str | None, np.ndarray] | None = None

    def votes(self, texts: list[str], sources: list[str | None]) -> Votes:
        k = len(self.subjects)
        out = Votes(np.zeros((len(texts), k)), np.zeros((len(texts), k), dtype=int), np.zeros((len(texts), k), dtype=int), sources)
        for d, text in enumerate(texts):
            split = sentences(text)
            words = self.lexicon.get(language(split), {})
            known = words.keys()
            opening, hits = out.section[d], out.share[d]
            for i, s in enumerate(split):
                for subject in {words[w] for w in known & s}:
                    hits[subject] += 1
                    if i < max(3, len(split) // 6):
                        opening[subject] = 2
            if opening.any():
                opening[opening == 0] = 1  # the opening is about something else
            hits /= max(len(split), 1)
            for m in [*_addressee.finditer(text), *(_mail.finditer(text) if "@" in text else ())]:
                named = {words[w] for w in _word.findall(m.group().lower()) if w in words}
                if named:
                    own = out.address[d]
                    own[own == 0] = 1
                    own[list(named)] = 2
        return out

    def states(self, code: np.ndarray, sources: list[str | None]) -> np.ndarray:
        """Probability of each state (documents x subjects x states) for coded votes."""
        none = np.zeros_like(self.prior)
        origin = np.stack([self.source.get(s, none) for s in sources]) if sources else np.zeros((0, *none.shape))
        return _normal(self.prior + self.band[code // 9] + self.section[code // 3 % 3] + self.address[code % 3] + origin)

    def posterior(self, texts: list[str], sources: list[str | None]) -> np.ndarray:
        """Probability that each text treats each subject."""
        return self.states(_coded(self.votes(texts, sources)), sources)[:, :, 2:].sum(2)

    def accuracies(self) -> dict[str, float]:
        """Per function that can say yes or no, the learned probability that it is
        right about a subject being treated when it votes."""
        p = np.exp(self.prior).mean(0)
        out = {}
        for name in ("section", "address"):
            joint = np.exp(getattr(self, name)) * p
            out[name] = float((joint[2, 2:].sum() + joint[1, :2].sum()) / joint[1:].sum())
        joint = np.exp(self.band) * p
        out["lexicon"] = float(np.maximum(joint[:, 2:].sum(1), joint[:, :2].sum(1)).sum())
        return out


def _band(share: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, share, side="right")


def _coded(v: Votes) -> np.ndarray:
    """Band, section and address vote of each document and subject as one number."""
    return _band(v.share) * 9 + v.section * 3 + v.address


def _beside(code: np.ndarray) -> np.ndarray:
    """The band of each document's second subject, by which it is known how many lie above a valley."""
    return np.sort(code // 9, 1)[:, -2] if code.shape[1] > 1 else np.zeros(len(code), dtype=int)


def _normal(like: np.ndarray) -> np.ndarray:
    like = np.exp(like - like.max(-1, keepdims=True))
    return like / like.sum(-1, keepdims=True)


def _smooth(count: np.ndarray) -> np.ndarray:
    """A quarter of each band to either neighbour."""
    padded = np.concatenate([count[:1], count, count[-1:]])
    return 0.5 * padded[1:-1] + 0.25 * (padded[:-2] + padded[2:])


def learn(model: Model, v: Votes) -> None:
    """Learn from the votes on documents that are at hand."""
    code = _coded(v)
    d, k = code.shape
    cells = pa.table({"source": pa.array(v.source, pa.string()).take(pa.array(np.repeat(np.arange(d), k))), "subject": np.tile(np.arange(k), d), "code": code.ravel(), "beside": np.repeat(_beside(code), k)})
    learn_counts(model, cells.group_by(["source", "subject", "code", "beside"]).aggregate([([], "count_all")]).rename_columns(["source", "subject", "code", "beside", "n"]))


def learn_counts(model: Model, cells: pa.Table) -> None:
    """Expectation maximisation over the votes: how each function votes in each
    hidden state, from their agreement alone.  ``cells`` holds how many (n)
    documents of a source have a combination of votes on a subject.

    It starts from two cuts of the lexicon's votes that the data choose: none at
    all, and the lowest clear valley in the bands of the others, where the count
    falls far below the peaks on either side: passing mentions form the lowest
    peak.  Above it, documents
    with one subject are told from those with several.  Votes count 0.5 more
    than seen, and bands lend a quarter to either neighbour."""
    k = len(model.subjects)
    named = cells.column("source").to_pylist()
    names = sorted(set(named), key=lambda s: (s is not None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    of_source = np.array([at[s] for s in named], dtype=int)
    subject, code, beside, n = (cells.column(c).to_numpy().astype(int) for c in ("subject", "code", "beside", "n"))
    order = np.lexsort((beside, code, subject, of_source))  # the same order whatever the partitions
    of_source, subject, code, beside, n = of_source[order], subject[order], code[order], beside[order], n[order]
    band, section, address = code // 9, code // 3 % 3, code % 3
    count = _smooth(np.bincount(band, weights=n, minlength=len(BANDS) + 1)[1:])
    peaks = np.minimum(np.maximum.accumulate(count), np.maximum.accumulate(count[::-1])[::-1])
    depth = (peaks + 1) / (count + 1)
    clear = np.flatnonzero(depth >= CLEAR)
    run = clear[: int((np.diff(clear, prepend=clear[:1]) <= 1).cumprod().sum())]  # the lowest clear valley
    valley = 1 + int(run[depth[run].argmax()]) if len(run) else 0
    state = np.eye(len(STATES))[np.where(band == 0, 0, np.where(band <= valley, 1, np.where(beside > valley, 2, 3)))]

    def counted(votes: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(votes, weights=n * state[:, z], minlength=size) for z in range(len(STATES))], 1).astype(float)

    def emissions(votes: np.ndarray, size: int, smooth: bool) -> np.ndarray:
        count = counted(votes, size)
        if smooth:
            count[1:] = _smooth(count[1:])
        count += 0.5
        return np.log(count / count.sum(0))

    for _ in range(ROUNDS):
        total = counted(subject, k) + 0.5
        share = total / total.sum(1, keepdims=True)
        model.prior = np.log(share)
        model.band, model.section, model.address = emissions(band, len(BANDS) + 1, True), emissions(section, 3, False), emissions(address, 3, False)
        # against the expected, so that small sources say little
        own = counted(of_source * k + subject, len(names) * k).reshape(len(names), k, len(STATES)) + 20 * share
        origin = np.log(own / own.sum(2, keepdims=True)) - np.log(share)
        state = _normal(model.prior[subject] + model.band[band] + model.section[section] + model.address[address] + origin[of_source, subject])
    model.source = dict(zip(names, origin))


#: A pass over the split documents, and what adds up its counts (word, topic, n); words are strings or numbers.
Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
Gather = Callable[[Pass, str], pa.Table]


def _split(subjects: list[str]) -> Pass:
    """Texts and their subjects' names -> language; a line per sentence of its
    words, sorted, each behind its language; the subjects' numbers."""
    at = {s: i for i, s in enumerate(subjects)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, lines = [], []
            for text in b.column(0).to_pylist():
                split = sentences(text)
                langs.append(lang := language(split))
                lines.append("\n".join(" ".join(sorted(lang + w for w in s if len(w) > 2)) for s in split))
            mine = [sorted({at[s] for s in names if s in at}) for names in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(lines, pa.string()), pa.array(mine, pa.list_(pa.int32()))], names=["lang", "lines", "subjects"])

    return run


def _counted(word: pa.Array, topic: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([word, pa.array(topic, pa.int32()), pa.array(n, pa.int64())], names=["word", "topic", "n"])


def _in_documents(k: int) -> Pass:
    """Documents of each subject that a word stands in, all documents as topic
    ``k``; the bare language stands in every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[tuple[str, int]] = Counter()
            for lang, lines, mine in zip(*(c.to_pylist() for c in b.columns)):
                words = {lang, *lines.split()}
                for t in (k, *mine):
                    found.update((w, t) for w in words)
            yield _counted(pa.array([w for w, _ in found], pa.string()), np.array([t for _, t in found], dtype=int), np.array(list(found.values()), dtype=int))

    return run


def _of_topics(vocab: pa.Array, k: int, telling: np.ndarray, phi: np.ndarray | None) -> Pass:
    """How much of each word belongs to each topic, in units: by the telling
    words of its sentence at first, then by the words' log probabilities ``phi``."""

    def weighed(b: pa.RecordBatch) -> pa.RecordBatch:
        split = pc.split_pattern(b.column(1), "\n")
        of_doc, words = pc.list_parent_indices(split).to_numpy(), pc.split_pattern(pc.list_flatten(split), " ")
        sent = pc.list_parent_indices(words).to_numpy()
        word = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=vocab), -1).to_numpy()
        sent, word = sent[word >= 0], word[word >= 0]  # a sentence of short words only is one empty word
        mine = np.zeros((b.num_rows, k))
        mine[pc.list_parent_indices(b.column(2)).to_numpy(), pc.list_flatten(b.column(2)).to_numpy()] = 1
        allowed = np.c_[np.where(mine > 0, 0.5 / np.maximum(mine.sum(1, keepdims=True), 1), 0.001), np.full(b.num_rows, 0.5)][of_doc]
        size = len(of_doc)
        if phi is None:
            told = telling[word] >= 0
            s, t = sent[told], telling[word[told]]
            resp = np.bincount(s * (k + 1) + t, weights=allowed[s, t], minlength=size * (k + 1)).reshape(size, k + 1).astype(float)
            resp[~resp.any(1), k] = 1
            resp /= resp.sum(1, keepdims=True)
        else:
            like = np.log(allowed)
            for t in range(k + 1):
                like[:, t] += np.bincount(sent, weights=phi[word, t], minlength=size)
            resp = _normal(like)
        units = np.rint(resp * UNIT)
        own, word = np.unique(word, return_inverse=True)
        count = np.stack([np.bincount(word, weights=units[sent, t], minlength=len(own)) for t in range(k + 1)], 1).astype(int)
        i, t = np.nonzero(count)
        return _counted(pa.array(own[i], pa.int32()), t, count[i, t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                yield weighed(b.slice(at, TOGETHER))

    return run


def _lexicon(gather: Gather, k: int) -> dict[str, dict[str, int]]:
    """Words of each subject by expectation maximisation, language by language."""
    found = gather(_in_documents(k), "string")
    if not found.num_rows or not k:
        return {}
    code = found.column("word").combine_chunks().dictionary_encode()
    every = code.dictionary.to_pylist()
    in_docs = np.zeros((len(every), k + 1), dtype=int)
    in_docs[code.indices.to_numpy(), found.column("topic").to_numpy()] = found.column("n").to_numpy()
    order = sorted(range(len(every)), key=every.__getitem__)
    in_docs, langs = in_docs[order], sorted(LANGUAGES)
    whole = np.zeros((len(langs), k + 1))  # documents per language
    bare = np.array([every[i] in LANGUAGES for i in order])
    for i, at in zip(np.array(order)[bare], np.flatnonzero(bare)):
        whole[langs.index(every[i])] = in_docs[at]
    words, in_docs = [every[i] for i, b in zip(order, bare) if not b], in_docs[~bare]
    if not words:
        return {}
    lang = np.array([langs.index(w[:2]) for w in words])
    total, rows = in_docs[:, k], np.arange(len(words))
    # start: sentences with a word that nearly only one subject's documents have
    first = (in_docs[:, :k] / total[:, None]).argmax(1)
    usual = whole[lang, first] / whole[lang, k]
    telling = np.where((total >= 2) & (in_docs[rows, first] / total >= np.maximum(0.6, 2.5 * usual)), first, -1)
    vocab, phi = pa.array(words, pa.string()), None
    size = np.bincount(lang, minlength=len(langs))
    for _ in range(ROUNDS):
        got = gather(_of_topics(vocab, k, telling, phi), "int")
        count = np.zeros((len(words), k + 1))
        count[got.column("word").to_numpy(), got.column("topic").to_numpy()] = got.column("n").to_numpy() / UNIT
        of_lang = np.stack([count[lang == i].sum(0) for i in range(len(langs))])
        phi = np.log((count + 0.01) / (of_lang + 0.01 * size[:, None])[lang])
    tot, best = np.rint(count.sum(1)), count[:, :k].argmax(1)  # each sentence holds a word once
    sure = (tot >= 3) & (count[rows, best] > 0.8 * tot)
    # a word of one subject must also rarely stand in documents without it
    sure &= in_docs[rows, best] > 0.6 * total
    out: dict[str, dict[str, int]] = {}
    for i in np.flatnonzero(sure):
        out.setdefault(words[i][:2], {})[words[i][2:]] = int(best[i])
    return out


def fit(labelled: list[tuple[int, str]], labels: dict[int, set[str]], subjects: list[str]) -> Model:
    """The lexicon of ``labelled`` (doc_id, text); the votes are yet to be learned."""
    texts = pa.RecordBatch.from_arrays([pa.array([t for _, t in labelled], pa.string()), pa.array([sorted(labels.get(d, ())) for d, _ in labelled], pa.list_(pa.string()))], names=["text", "subjects"])
    split = list(_split(subjects)(iter([texts])))
    schema = lambda kind: pa.schema([("word", kind), ("topic", pa.int32()), ("n", pa.int64())])

    def gather(step: Pass, kind: str) -> pa.Table:
        found = pa.Table.from_batches(step(iter(split)), schema(pa.string() if kind == "string" else pa.int32()))
        return found.group_by(["word", "topic"]).aggregate([("n", "sum")]).rename_columns(["word", "topic", "n"])

    return Model(subjects, _lexicon(gather, len(subjects)))


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Text and subjects of every labelled document.

    The labels grow with the corpus, so they are not broadcast; a filter of
    hashed ids is, and only the documents that pass it are moved and joined."""
    known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    spot = F.expr(f"pmod(xxhash64(cast(doc_id as string)), {FILTER_BITS}L)").alias("__spot")
    bits = known.select(spot).groupBy(F.expr("__spot div 64").alias("__at")).agg(F.expr("bit_or(shiftleft(1L, cast(__spot % 64 as int)))").alias("__bits"))
    near = documents.where("text is not null").select("doc_id", "text", spot).withColumn("__at", F.expr("__spot div 64")).join(F.broadcast(bits), "__at")
    return near.where("getbit(__bits, cast(__spot % 64 as int)) = 1").select("doc_id", "text").join(known, "doc_id").select("text", "subjects")


def lexicon_fitted(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    """The lexicon of all labelled documents; the votes are yet to be learned."""
    names = [r[0] for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").collect()]  # the subjects are a parameter
    split = cut(labelled_texts(documents, labels).mapInArrow(_split(names), "lang string, lines string, subjects array<int>"))

    def gather(step: Pass, kind: str) -> pa.Table:
        return split.mapInArrow(step, f"word {kind}, topic int, n long").groupBy("word", "topic").agg(F.sum("n").alias("n")).toArrow()

    return Model(names, _lexicon(gather, len(names)))


def fitted(spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    """The lexicon of all labelled documents, and what the votes on all
    documents, labelled or not, teach."""
    model = lexicon_fitted(documents, labels, subjects)
    learn_counts(model, counted_votes(voted(documents, model, ())))
    return model


def voted(documents: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, source and coded votes of every text that isn't blank.
    Rows keep their partition; columns not in ``keep`` are dropped."""
    schema = StructType([documents.schema[k] for k in keep] + [StructField("__source", StringType()), StructField("__votes", ArrayType(ShortType())), StructField("__beside", ShortType())])
    k = len(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _coded(model.votes(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * k, pa.int32()), pa.array(code.ravel(), pa.int16()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), b.column(len(keep) + 1), lists, pa.array(_beside(code), pa.int16())], names=schema.names)

    return documents.where("text rlike '\\\\S'").select(*keep, F.col("text").alias("__text"), F.col("source").alias("__source")).mapInArrow(run, schema)


def counted_votes(votes: DataFrame) -> pa.Table:
    """How many documents of a source have each combination of votes on a subject."""
    cells = votes.select(F.col("__source").alias("source"), F.col("__beside").alias("beside"), F.posexplode("__votes").alias("subject", "code"))
    return cells.groupBy("source", "subject", "code", "beside").agg(F.count("*").alias("n")).toArrow()


def decided(votes: DataFrame, model: Model, least: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``subject`` for every posterior over ``least``, from ``voted`` rows."""
    schema = StructType([votes.schema[k] for k in keep] + [StructField("subject", StringType())])
    k = len(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(len(keep) + 1).flatten().to_numpy().astype(int).reshape(b.num_rows, k)
            rows, subject = np.nonzero(model.states(code, b.column(len(keep)).to_pylist())[:, :, 2:].sum(2) > least)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), pa.array([model.subjects[s] for s in subject], pa.string())], names=[*keep, "subject"])

    return votes.mapInArrow(run, schema)


def assign(documents: DataFrame, model: Model, least: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``subject`` for every posterior over ``least``.

    Null, blank and junk texts have no subject.  Rows keep their partition,
    nothing is shuffled; columns not in ``keep`` are dropped."""
    return decided(voted(documents, model, keep), model, least, keep)


_FITTED: dict[tuple[str, str], Model] = {}


def _assigned(spark: SparkSession, sf_dir: str, keep: tuple[str, ...]) -> DataFrame:
    """The subjects of a folder's documents.  The model is fitted once per
    application; the votes it is fitted on are kept, and decided on."""
    at, documents = (spark.sparkContext.applicationId, sf_dir), table(spark, sf_dir, "documents")
    if at in _FITTED:
        return assign(documents, _FITTED[at], keep=keep)
    model = lexicon_fitted(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))
    votes = cut(voted(documents, model, keep))
    learn_counts(model, counted_votes(votes))
    _FITTED.clear()
    _FITTED[at] = model
    return decided(votes, model, keep=keep)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject that a document is about."""
    return _assigned(spark, sf_dir, ("doc_id",))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and subject."""
    return _assigned(spark, sf_dir, ("source",)).groupBy("source", "subject").agg(F.count("*").alias("documents"))
