"""Statistics of each text, and from them its kind: prose, list, table or junk.

The statistics are native expressions.  An ordered rule list over them is
induced by incremental reduced-error pruning: for each class in turn rules are
grown by information gain on two thirds of the labelled texts, pruned on the
last third, and kept while they are right more often than not.  The rules and
their learned thresholds are exported as one SQL CASE expression, which runs
inside the scan; no Python touches the corpus.

No labels come with the tables, so the labelled documents are made of real
ones: the correct texts of the case results, known to be prose, in the layouts
that pages have; lists and tables of words and phrases cut from them; and junk
by character statistics.  No wording is written down here.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.tables import sampled, table

#: Frequent function words of Spanish, Portuguese and English.
COMMON = """
a al ante antes así aunque bajo cada como con conforme cuando cuál de del desde después donde dos e el ella en entre era es esta
este está existe fue ha hace hasta hay hubo la las le lo los más me menos mi muy ni no nos o otro otros para pero por pues que quien
quién se ser si sin sobre son su sus también tal tanto todo todos tras un una unos ya y
ao aos as com da das do dos em foi mas na não nas nem nos num os ou para pela pelo pois quando seu sua um uma à às
all an and are at be but by do does for from has have if in is it its of on or than that the there this to under was which will with would
""".split()  # fmt: skip

_ITEM = r"^\s*(?:[-*•·▪–—+o>]\s+\S|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+\S)"
_CELLS = r"(?:\S(?:\t+| {2,}| \| |\||;)(?=\S).*){2}|\S(?:\t+| {2,}| \| )(?=\S)"
_NUMERIC = r"(?<!\S)(?:[-–]|(?:[A-Z]{1,3}\.?\s?)?[\d.,/:%$€-]*\d[\d.,/:%$€-]*)(?=\s|;|\||$)"


STATS = [
    "n_lines", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_words",
    "item_lines", "cell_lines", "numeric_cells", "vowel_ratio", "single_letters", "words_per_line", "odd_signs", "repeated",
]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns ``STATS`` of its column ``text``.

    Null texts get null statistics, blank ones zeros.  Columns of ``df`` that
    have a statistic's name are replaced."""
    t = F.col(text)
    base = df.drop(*[s for s in STATS if s != text])
    count = lambda p: F.regexp_count(t, F.lit(p))
    first = base.withColumns({
        "__lines": F.filter(F.split(t, "[\\n\\r\\f]+"), lambda x: F.trim(x) != ""),
        "__words": F.regexp_extract_all(F.lower(t), F.lit(r"(\p{L}+)"), F.lit(1)), "__letters": count(r"\p{L}"), "__visible": count(r"\S"), "__digits": count(r"\d"),
        "__symbols": count(r"[^\s\p{L}\p{N}.,;:!?¿¡()\"'«»\-]"), "__vowels": count("(?i)[aeiouáéíóúüãõâêôàAEIOU]"),
        "__single": count(r"(?<![\p{L}\p{N}])(?i)[\p{L}&&[^aeoyuà]](?![\p{L}\p{N}])"), "__odd": count("[¤¦§¬±¶©®Ã³¢£¥~^\\\\|_=<>{}#*]"),
        "__repeat": F.length(t) - F.length(F.regexp_replace(t, r"(\S)\1{3,}", "$1")), "__numeric": count(_NUMERIC), "__cells": count(r"\S+"),
    })
    first = first.withColumns({"n_words": F.size("__words"), "__common": F.size(F.filter("__words", lambda w: w.isin(*COMMON)))})
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.when(t.isNotNull(), F.lit(0.0)))
    lines = lambda p: F.size(F.filter("__lines", lambda x: x.rlike(p)))
    n = F.when(t.isNotNull(), F.size("__lines"))
    out = first.withColumns({
        "n_lines": n, "mean_word_length": share(F.col("__letters"), F.col("n_words")), "symbol_ratio": share(F.col("__symbols"), F.col("__visible")),
        "digit_ratio": share(F.col("__digits"), F.col("__visible")), "punctuated_lines": share(lines(r"[.!?…:][\"'»)]*\s*$"), n),
        "common_words": share(F.col("__common"), F.col("n_words")), "item_lines": share(lines(_ITEM), n), "cell_lines": share(lines(_CELLS), n),
        "numeric_cells": share(F.col("__numeric"), F.col("__cells")), "vowel_ratio": share(F.col("__vowels"), F.col("__letters")),
        "single_letters": share(F.col("__single"), F.col("n_words")), "words_per_line": share(F.col("n_words"), n), "odd_signs": share(F.col("__odd"), F.col("__visible")),
        "repeated": share(F.col("__repeat"), F.col("__visible")),
    })
    return out.select(*base.columns, *STATS)


# --- labelled texts -------------------------------------------------------------

#: Texts known to be prose that are collected, about, and characters of one among them.
PROSE, PROSE_CHARS = 1500, 20_000
#: Labelled texts made of them.
LABELLED = 12_000
_common_words = frozenset(COMMON)
_SIGNS = "|/;:.,_~^*#+-=]}[{)(§°»«'"
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"


class Maker:
    """Writes labelled texts from texts known to be prose."""

    def __init__(self, prose: list[str], seed: int):
        self.r = random.Random(seed)
        self.prose = [t for t in prose if t.strip()] or [" ".join(COMMON)]
        self.bags = [b for t in self.prose if (b := [w.strip(".,;:?¿()") for w in t.split()])]

    def phrase(self, longest: int = 3) -> str:
        """One to ``longest`` words that stand together and begin with a telling one."""
        for _ in range(8):
            bag = self.r.choice(self.bags)
            at = self.r.randrange(len(bag))
            if len(bag[at]) > 3 and bag[at].isalpha() and bag[at].lower() not in _common_words:
                words = bag[at : at + self.r.randint(1, longest)]
                while words[-1].lower() in _common_words and len(words) > 1:
                    words.pop()
                return " ".join(words).lower()
        return self.bags[0][0].lower()

    def text_prose(self) -> str:
        r = self.r
        text = r.choice(self.prose)
        sentences = [x.strip() for x in text.replace("\n", " ").split(". ") if x.strip()]
        if r.random() < 0.5 and len(sentences) > 1:
            at = r.randrange(len(sentences))
            text = ". ".join(sentences[at : at + r.randint(1, 6)]).rstrip(".") + "."
        style = r.random()
        if style < 0.4:
            width, lines, line = r.randint(38, 90), [], ""
            for w in text.split():
                if len(line) + len(w) > width:
                    lines.append(line)
                    line = w
                else:
                    line = f"{line} {w}".strip()
            text = "\n".join([*lines, line])
        elif style < 0.55:
            text = " ".join(text.split()).replace(". ", ".\n")
        elif style < 0.65:
            text = text.replace(".", "")
        if r.random() < 0.2:
            text = f"{r.randint(1, 9)}. {self.phrase().capitalize()}\n{text}"
        if r.random() < 0.15:
            text += f"\n{self.phrase(1).capitalize()}: {r.randint(1, 99)}.{r.randint(100, 999)},{r.randint(10, 99)}\n{self.phrase(1).capitalize()}: {r.randint(10, 28)}/{r.randint(10, 12)}/2026"
        return text.upper() if r.random() < 0.1 else text

    def text_list(self) -> str:
        r = self.r
        mark, end = r.choice(["- ", "* ", "• ", "{n}) ", "{n}. ", "{a}. ", "{a}) ", "— ", ""]), r.choice(["", "", ",", ";", "."])
        rows = []
        for i in range(r.randint(3, 18)):
            item = self.phrase(3 if r.random() < 0.9 else 6) + r.choice(["", "", "", f" ({r.randint(1, 40)})", f" x {r.randint(1, 9)}", f" nº {r.randint(1, 9)}"])
            rows.append(mark.format(n=i + 1, a="abcdefghijklmnopqrstuvwxyz"[i]) + (item if mark else item.capitalize()) + end)
        head = self.phrase()
        return "\n".join(([r.choice([head.capitalize(), head.upper(), head.capitalize() + ":"])] if r.random() < 0.35 else []) + rows)

    def cell(self) -> str:
        r = self.r
        return r.choice([str(r.randint(0, 400)), "0", "-", f"{r.randint(0, 99)}%", f"{r.randint(10, 28)}/{r.randint(10, 12)}/26", f"{r.randint(1, 99)}.{r.randint(100, 999)},{r.randint(10, 99)}"])

    def text_table(self) -> str:
        r = self.r
        sep, width = r.choice(["    ", "  ", "\t", " | ", ";", "   "]), r.randint(2, 6)
        rows = [sep.join([str(i + 1), self.phrase() if r.random() < 0.9 else "-"] + [self.cell() for _ in range(width - 1)]) for i in range(r.randint(3, 14))]
        head = [sep.join(self.phrase(1)[: r.randint(3, 9)].capitalize() for _ in range(width))] if r.random() < 0.6 else []
        return "\n".join(head + rows)

    def text_junk(self) -> str:
        r = self.r
        lines = lambda a, b, one: "\n".join(one() for _ in range(r.randint(a, b)))
        tokens = lambda a, b, one: " ".join(one() for _ in range(r.randint(a, b)))
        some = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
        kind = r.randrange(5)
        if kind == 0:
            return lines(2, 9, lambda: tokens(3, 9, lambda: some(_CONSONANTS, 1, 9)))
        if kind == 1:
            return lines(2, 10, lambda: r.choice("=-_.*x~#") * r.randint(8, 60))
        if kind == 2:  # vowels lost to signs, letters to wrong encodings
            swap = str.maketrans(dict(zip("aeiour", r.sample("¤¬§¶±¦©®¢£", 6))) | {"í": "Ã\xad", "ó": "Ã³"})
            sentences = [x for x in r.choice(self.prose).replace("\n", " ").split(". ") if x]
            return "\n".join(x.translate(swap) + "." for x in sentences[:7])
        if kind == 3:
            return lines(1, 8, lambda: tokens(3, 12, lambda: some(_SIGNS + "xXvYN10oej", 1, 4)))
        letters = "".join(r.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 8)) + r.choice("eioly") * 3
        return lines(1, 9, lambda: tokens(4, 14, lambda: some(letters, 1, 2) if r.random() < 0.7 else r.choice(_SIGNS)))


KINDS = ("prose", "list", "table", "junk")


def labelled_texts(prose: list[str], n: int = LABELLED, seed: int = 5) -> list[tuple[str, str]]:
    """``n`` texts with their kind; a fifth join two kinds of which the first,
    in lines and words the larger by far, is the label."""
    maker = Maker(prose, seed)
    r, out = maker.r, []
    write = {k: getattr(maker, f"text_{k}") for k in KINDS}
    for i in range(n):
        kind = ("prose", "prose", "list", "table", "junk")[i % 5]
        text = write[kind]()
        if r.random() < 0.2:
            other = r.choice([k for k in KINDS if k != kind])
            extra = "\n".join(write[other]().split("\n")[: max(1, text.count("\n") // 4)])[: max(12, len(text) // 5)]
            text = f"{text}\n\n{extra}" if r.random() < 0.5 else f"{extra}\n\n{text}"
        out.append((kind, text))
    return out


# --- rule induction ----------------------------------------------------------------


#: Rules of a kind that may fail on their pruning texts before the kind is done.
PATIENCE = 8
#: Rule lists induced, of which the best on held-out texts is taken.
TRIES = 6


@dataclass
class Rule:
    kind: str
    #: (statistic, ">=" or "<=", threshold)
    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for name, sign, t in self.conditions:
            column = x[:, names.index(name)]
            hit &= column >= t if sign == ">=" else column <= t
        return hit

    def simplified(self) -> Rule:
        """The same rule with one condition per statistic and sign."""
        tight: dict[tuple[str, str], float] = {}
        for name, sign, t in self.conditions:
            old = tight.get((name, sign), t)
            tight[name, sign] = max(old, t) if sign == ">=" else min(old, t)
        return Rule(self.kind, [(name, sign, t) for (name, sign), t in tight.items()])

    def sql(self) -> str:
        return " AND ".join(f"{n} {s} {t:.6g}D" for n, s, t in self.conditions)


def _grow(x, y, names, kind) -> Rule:
    rule, hit = Rule(kind), np.ones(len(x), dtype=bool)
    while (hit & ~y).any() and (hit & y).any() and len(rule.conditions) < 6:
        p0, n0 = int((hit & y).sum()), int((hit & ~y).sum())
        best = (1e-9, None)
        for j, name in enumerate(names):
            own = x[hit, j]
            cuts = np.unique(np.quantile(own, np.linspace(0.02, 0.98, 49)).round(4))
            label = y[hit]
            for sign in (">=", "<="):
                m = own[:, None] >= cuts if sign == ">=" else own[:, None] <= cuts
                p, n = (m & label[:, None]).sum(0), (m & ~label[:, None]).sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1.0)
                i = int(gain.argmax())
                if gain[i] > best[0] and p[i] + n[i] < p0 + n0:
                    best = (float(gain[i]), (name, sign, float(cuts[i])))
        if best[1] is None:
            break
        name, sign, t = best[1]
        # half-way to the nearest text of another kind, so that the rule holds beyond the sample
        other = x[hit & ~y, names.index(name)]
        beyond = other[other < t] if sign == ">=" else other[other > t]
        if len(beyond):
            t = round(float(t + (beyond.max() if sign == ">=" else beyond.min())) / 2, 4)
        rule.conditions.append((name, sign, t))
        hit = rule.covers(x, names)
    return rule


def _worth(rule: Rule, x, y, names) -> float:
    hit = rule.covers(x, names)
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: np.ndarray, kinds: np.ndarray, names: list[str], order=("junk", "table", "list"), default: str = "prose", seed: int = 3) -> list[Rule]:
    """The ordered rule list; texts no rule covers are of kind ``default``."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), dtype=bool)
    for kind in order:
        failed = 0  # a rule that fails on its pruning texts is grown again on another split
        while (left & (kinds == kind)).sum() >= 3 and failed < PATIENCE:
            at = rng.permutation(np.flatnonzero(left))
            grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
            rule = _grow(x[grow], kinds[grow] == kind, names, kind)
            while len(rule.conditions) > 1:
                shorter = Rule(kind, rule.conditions[:-1])
                if _worth(shorter, x[prune], kinds[prune] == kind, names) < _worth(rule, x[prune], kinds[prune] == kind, names):
                    break
                rule = shorter
            rule = rule.simplified()
            hit = rule.covers(x, names) & left
            right = (kinds[prune] == kind)[rule.covers(x[prune], names)]
            if not rule.conditions or not hit.any() or len(right) == 0 or right.mean() <= 0.5:
                failed += 1
                continue
            rules.append(rule)
            left &= ~hit
    return rules


def kinds_of(rules: list[Rule], x: np.ndarray, names: list[str], default: str = "prose") -> np.ndarray:
    """What the ordered rules say of each row."""
    out, left = np.full(len(x), default, dtype=object), np.ones(len(x), dtype=bool)
    for rule in rules:
        hit = rule.covers(x, names) & left
        out[hit] = rule.kind
        left &= ~hit
    return out


def best_of(x: np.ndarray, kinds: np.ndarray, names: list[str], tries: int = TRIES) -> list[Rule]:
    """The list that is right most often on every third text, which no list saw,
    of ``tries`` lists induced from the others; the shorter one of equals."""
    held = np.arange(len(x)) % 3 == 2
    lists = [induce(x[~held], kinds[~held], names, seed=s) for s in range(tries)]
    return max(lists, key=lambda rules: ((kinds_of(rules, x[held], names) == kinds[held]).mean(), -len(rules)))


def case_sql(rules: list[Rule], default: str = "prose") -> str:
    """The rule list as one SQL expression over the statistics."""
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.kind}'" for r in rules) + f" ELSE '{default}' END"


#: Statistics that rules may use.
RULE_STATS = [s for s in STATS if s not in ("n_lines", "n_words")]
_LEARNED: dict[tuple[str, str, int], str] = {}


def known_prose(spark: SparkSession, sf_dir: str, most: int = PROSE) -> list[str]:
    """Correct texts of case results, about ``most``, chosen by a hash."""
    case = sampled(table(spark, sf_dir, "case_results"), "result_id", most).where("expected rlike '\\\\S'").where(F.length("expected") <= PROSE_CHARS)
    return [r["expected"] for r in case.select("result_id", "expected").orderBy("result_id").collect()]


def learned_case(spark: SparkSession, sf_dir: str, n: int = LABELLED) -> str:
    """The CASE expression learned from ``n`` labelled texts (a bounded sample),
    once per application and folder."""
    at = (spark.sparkContext.applicationId, sf_dir, n)
    if at not in _LEARNED:
        rows = [(i, *row) for i, row in enumerate(labelled_texts(known_prose(spark, sf_dir), n))]
        stats = with_statistics(spark.createDataFrame(rows, "i int, kind string, text string").repartition(8)).select("i", "kind", *RULE_STATS).toPandas()
        stats = stats.sort_values("i")  # the same order whatever the partitions
        _LEARNED[at] = case_sql(best_of(stats[RULE_STATS].to_numpy(float), stats["kind"].to_numpy(), RULE_STATS))
    return _LEARNED[at]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, rec_id, text of quality_inputs and runtime recognitions."""
    pages = table(spark, sf_dir, "quality_inputs").select(F.lit("quality_inputs").alias("table_name"), F.col("page_id").alias("rec_id"), "text")
    runs = table(spark, sf_dir, "recognitions").where("strategy = 'runtime'").select(F.lit("recognitions").alias("table_name"), F.col("recognition_id").alias("rec_id"), "text")
    return pages.unionByName(runs)


def classified(df: DataFrame, case: str) -> DataFrame:
    """``df`` with its statistics and ``text_kind`` by the rules ``case``; null
    and blank texts have none."""
    with_stats = with_statistics(df.where("text rlike '\\\\S'"))
    return with_stats.withColumn("text_kind", F.expr(case))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't prose for the most part, with their kind."""
    return classified(texts(spark, sf_dir), learned_case(spark, sf_dir)).where("text_kind != 'prose'").select("table_name", "rec_id", "text_kind")


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every text (null for null texts), rounded to 6 digits."""
    stats = with_statistics(texts(spark, sf_dir))
    return stats.select("table_name", "rec_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_words").cast("long").alias("n_words"), *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")])


_COMMON_LIST = ", ".join(f"'{w}'" for w in COMMON)
STATISTICS_SQL = f"""
WITH t AS (
  SELECT 'quality_inputs' AS table_name, page_id AS rec_id, text FROM quality_inputs
  UNION ALL SELECT 'recognitions', recognition_id, text FROM recognitions WHERE strategy = 'runtime'),
a AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\n\\r\\f]+'), lambda x: trim(x) <> '') AS lines,
  regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM t),
b AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(words) AS BIGINT) AS n_words,
  len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '[^\\s\\p{{L}}\\p{{N}}.,;:!?¿¡()"''«»-]')) AS symbols, len(regexp_extract_all(text, '\\S')) AS visible,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:]["''»)]*\\s*$'))) AS ends,
  len(list_filter(words, lambda w: w IN ({_COMMON_LIST}))) AS common FROM a)
SELECT table_name, rec_id, n_lines, n_words,
  round(CASE WHEN text IS NOT NULL THEN coalesce(letters / nullif(n_words, 0), 0) END, 6) AS mean_word_length,
  round(CASE WHEN text IS NOT NULL THEN coalesce(symbols / nullif(visible, 0), 0) END, 6) AS symbol_ratio,
  round(CASE WHEN text IS NOT NULL THEN coalesce(ends / nullif(n_lines, 0), 0) END, 6) AS punctuated_lines,
  round(CASE WHEN text IS NOT NULL THEN coalesce(common / nullif(n_words, 0), 0) END, 6) AS common_words
FROM b
"""
