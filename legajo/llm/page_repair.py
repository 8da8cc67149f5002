"""Scanned page texts repaired into continuous paragraphs.

A line tagger, an averaged perceptron, tells running headers and page numbers
from text by the line's place on its page, its shape and how often it recurs.
The character editor (``char_editor``) repairs words and joins those cut at a
line's end.  Both are trained on a bounded sample of pairs of recognised and
correct text; word counts that serve as features come from all texts.  A word
seen before in a task is looked up, not edited again.
"""

from __future__ import annotations

import difflib
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm.char_editor import LABELS, SOUND, Counts, Editor, Packed, Perceptron, Words, _bucket, _is_number
from legajo.llm.same_look import canonical
from legajo.tables import sampled, table

#: Pairs of recognised and correct text used for training, about, and characters of a text among them.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Words that are looked up in a hash map, the most frequent ones; all others in a
#: packed table.  This decides the speed, never the result.
VOCABULARY = 80_000
#: Words remembered per task.
REMEMBERED = 200_000
EPOCHS = 8

_EDGE_LEFT, _EDGE_RIGHT = "¿¡(«\"'“‘[{", ".,;:!?)»\"'”’]}…"
_code = re.compile(r"^(?:[A-Z]{1,4}-?\d+[A-Z]?(?:-\d+)*|\d{1,3}[A-Z]|\d+-\d+[A-Z]?|\W*)$|[@\w]+\.[A-Za-z]{2,}$")
_cut = re.compile(r"^(.*[^\W\d_])([-¬­=])$")
_pageish = re.compile(r"(?i)^[\s\W]*(?:(?:p\s*[áa]\s*g(?:\s*i\s*n\s*a)?|h\s*o\s*j\s*a|folio|page|sheet)?[\s.:nº°-]*)?(?:\d{1,4}|[ivxl]{1,6})(?:\s*(?:de|/|of)\s*\d{1,4})?[\s\W]*$")
_worth = re.compile(r"\d|[A-ZÁÉÍÓÚÑ]{3}|^[\s\W]*[ivxlIVXL]{0,6}[\s\W]*$")
_label_line = re.compile(r"^\s*([^\W\d_][^\s:]{1,6}[^\s:.]?\.?)\s*[:\s]\s*(?=\d|[Bb][Ss]\b|T[VU])")


# --- lines ------------------------------------------------------------------------


def split_lines(text: str) -> list[str]:
    """Lines as numbered: split at line feeds; other characters in one form."""
    return canonical(text).split("\n")


def _key(line: str) -> str:
    """What recurs of a running line: letters, misread or not, without numbers."""
    plain = line.lower().translate(str.maketrans("01568@(", "oiosbac"))
    plain = re.sub(r"\b[ivxl]{1,5}\b|\d", "", plain)
    return re.sub(r"[^a-zñáéíóú]", "", plain).replace("l", "i").replace("rn", "m").replace("f", "e").replace("c", "e").replace("t", "e")


def line_features(lines: list[str], words: Words) -> list[list[str] | None]:
    """Features of each line; None for blank lines, an empty list for plain ones:
    without digit, capitals, page pattern or recurrence a line is text."""
    n = len(lines)
    filled = [i for i, x in enumerate(lines) if x.strip()]
    keys = [_key(x) if _worth.search(x) else x.strip().lower() for x in lines]
    often = Counter(k for k in keys if k)
    breaks = [i for i, x in enumerate(lines) if "\f" in x]
    page_first, page_last = set(), set()
    for a, b in zip([0, *breaks], [*breaks, n]):
        own = [i for i in filled if a <= i < b]
        if own:
            page_first.add(own[0])
            page_last.add(own[-1])
    out: list[list[str] | None] = [None] * n
    for j, i in enumerate(filled):
        x = lines[i]
        s = x.strip()
        if often[keys[i]] < 2 and not _worth.search(s):
            out[i] = []
            continue
        before, after = (lines[filled[j - 1]].strip() if j else ""), (lines[filled[j + 1]].strip() if j + 1 < len(filled) else "")
        letters = sum(c.isalpha() for c in s)
        upper = sum(c.isupper() for c in s)
        digits = any(c.isdigit() for c in s)
        pageish = bool(_pageish.match(s))
        tokens = s.split()
        caps = sum(len(t) > 2 and sum(c.isupper() for c in t) * 2 > len(t) for t in tokens)
        recurs = min(often[keys[i]], 3) if keys[i] else 0
        known = sum(t.strip(_EDGE_LEFT + _EDGE_RIGHT).lower() in words.clean for t in tokens)
        f = [
            "bias", f"page={pageish}", f"first={i in page_first}", f"last={i in page_last}", f"recurs={recurs}", f"caps={min(caps, 3)}", f"digits={digits}",
            f"len={_bucket(len(s))}", f"words={min(len(tokens), 9)}", f"end={s[-1] if not s[-1].isalnum() else 'w'}", f"start={'U' if s[0].isupper() else 'l' if s[0].islower() else s[0] if not s[0].isdigit() else '9'}",
            f"indent={x.lstrip(chr(12))[:2] == '  '}", f"wide={'  ' in s}", f"sep={'—' in s or '·' in s or '/' in s}", f"upper={upper * 4 // max(letters, 1)}", f"numberend={s[-1].isdigit()}",
            f"prevopen={before[-1:].isalnum() or before[-1:] in ',-'}", f"nextlow={after[:1].islower()}", f"solo={j == 0 or not lines[i - 1].strip()}{i + 1 >= n or not lines[i + 1].strip()}",
            f"label={bool(_label_line.match(x))}", f"mail={'@' in s}", f"break={'f' if chr(12) in x else ''}{'n' if i + 1 < n and chr(12) in lines[i + 1] else ''}", f"known={known * 4 // max(len(tokens), 1)}", f"mark={bool(_cut.match(tokens[-1]))}",
        ]
        plain = f"label={bool(_label_line.match(x))},mail={'@' in s}"
        f += [f"{f[4]},{plain}", f"{f[4]},{f[5]},{f[13]},{plain}", f"{f[5]},{f[6]},{f[8]},{plain}", f"{f[9]},{f[10]},{f[5]}"]
        f += [f"{f[5]},{f[6]},{f[4]}", f"{f[1]},{f[2]},{f[3]}", f"{f[1]},{f[18]}", f"{f[1]},{f[9]}", f"{f[5]},{f[13]},{f[15]}", f"{f[5]},{f[9]}", f"{f[4]},{f[9]},{f[5]}", f"{f[1]},{f[8]}", f"{f[1]},{f[6]}"]
        out[i] = f
    return out


KINDS = ("text", "header", "page_number")


def tag_lines(lines: list[str], words: Words, model: Perceptron) -> list[str]:
    """``text``, ``header``, ``page_number`` or '' (blank) for each line."""
    out = []
    for f in line_features(lines, words):
        # only a line of nothing but a number and its page word can be a page number
        able = KINDS if f and f[1] == "page=True" else KINDS[:2]
        out.append("" if f is None else max(able, key=lambda k: model.score([f"{k}|{x}" for x in f])) if f else "text")
    return out


# --- words --------------------------------------------------------------------------


def end_of(m: re.Match, following: str) -> tuple[str, str, str]:
    """(left part, mark, right part) of a marked line end and the next token."""
    right = following.rstrip(_EDGE_RIGHT)
    word = re.match(r"[^\W_]+|.+", right)
    return re.split(r"[-/]", m[1].lstrip(_EDGE_LEFT))[-1], m[2], word.group() if word else right


def soundness(tokens: list[str], words: Words) -> int:
    own = [w for t in tokens if (w := t.strip(_EDGE_LEFT + _EDGE_RIGHT + "-¬=").lower()) and any(c.isalpha() for c in w)]
    good = sum(len(w) > 1 and (words.known(w) or words.holds(words.seen.get(w, 0), SOUND)) or w in ("a", "y", "o", "e", "u") for w in own)
    return 2 if 2 * good >= len(own) else 1 if 4 * good >= len(own) else 0


@dataclass
class Repairer:
    """The trained models; ``read`` analyses a text."""

    words: Words
    tagger: Perceptron
    editor: Editor
    memory: dict = field(default_factory=dict)
    fine: set = field(default_factory=set)

    def save(self, path: str | Path) -> None:
        """Keep the models and counts in a file, for ``load``."""
        Path(path).write_bytes(pickle.dumps((self.words, self.tagger, self.editor)))

    @classmethod
    def load(cls, path: str | Path) -> Repairer:
        return cls(*pickle.loads(Path(path).read_bytes()))

    def fix(self, word: str, label: bool = False, sound: int = 2):
        """(result, first position of an edit) or None where nothing is wrong."""
        if label is False and self.words.known(word.lower()):
            return None
        result, runs = self.editor.best(word, label, sound)
        return (result, min(r[0] for r in runs)) if runs else None

    def token(self, token: str, label: bool = False, sound: int = 2):
        """Check one token: (repaired token, position of the first edit) or None."""
        at = (token, label, sound)
        if at not in self.memory:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            self.memory[at] = self._token(token, label, sound)
        return self.memory[at]

    def _token(self, token: str, label: bool, sound: int):
        core = token.strip(_EDGE_LEFT + _EDGE_RIGHT)
        if not core or _code.search(core):
            return None
        at = token.index(core)
        if at and token[at - 1] in "(!" and not self.words.known(core.lower()) and not token.endswith(")"):
            got = self.fix(token[at - 1 : at + len(core)], False, sound)
            if got:
                return token[: at - 1] + got[0] + token[at + len(core) :], at - 1 + got[1]
        if "-" in core[1:-1] and core.replace("-", "").isalpha() and not self.words.known(core.lower()):
            out, where, offset = [], None, at
            for part in core.split("-"):
                got = self.fix(part, False, sound) if len(part) > 1 else None
                out.append(got[0] if got else part)
                if got and where is None:
                    where = offset + got[1]
                offset += len(part) + 1
            return (token[:at] + "-".join(out) + token[at + len(core) :], where) if where is not None else None
        if len(core) == 1:
            return None
        got = self.fix(core, label, sound)
        return (token[:at] + got[0] + token[at + len(core) :], at + got[1]) if got else None

    def read(self, text: str):
        """(lines, kinds, cut lines, misread lines, repaired tokens per line).

        A cut word is checked whole; its error belongs to the line it stands in.
        How much of a line is known is a feature of the editor, no condition."""
        lines = split_lines(text)
        kinds = tag_lines(lines, self.words, self.tagger)
        body = [i for i, k in enumerate(kinds) if k == "text"]
        tokens = {i: lines[i].split() for i in body}
        cut, misread = set(), set()
        fixed = {i: list(t) for i, t in tokens.items()}
        skip: set[tuple[int, int]] = set()
        for j, i in enumerate(body[:-1]):
            nxt = body[j + 1]
            m = _cut.match(tokens[i][-1])
            if not m or not self.editor.joins(*end_of(m, tokens[nxt][0]), lines[i].rstrip("\r")[-1:] == " "):
                continue
            cut.add(i)
            whole = m[1] + tokens[nxt][0]
            got = self.token(whole)
            if got:
                got = self.token(whole, False, self.sound(tokens[i][:-1]))
            if got:
                misread.add(i if got[1] < len(m[1]) else nxt)
                whole = got[0]
            skip |= {(i, len(tokens[i]) - 1), (nxt, 0)}
            fixed[i][-1], fixed[nxt][0] = whole, ""
        if len(self.fine) > REMEMBERED:
            self.fine.clear()
        for i in body:
            label = bool(_label_line.match(lines[i]))
            errors = self._errors(i, tokens[i], label, skip, 2)
            sound = 2 if label or not errors else self.sound([t for k, t in enumerate(tokens[i]) if k not in errors])
            if sound < 2:
                errors = self._errors(i, tokens[i], label, skip, sound)
            if errors:
                misread.add(i)
                for k, t in errors.items():
                    fixed[i][k] = t
        return lines, kinds, cut, misread, fixed

    def _errors(self, i: int, tokens: list[str], label: bool, skip: set, sound: int) -> dict[int, str]:
        """Position -> repaired token of the misread tokens of a line."""
        out, fine = {}, self.fine
        for k, t in enumerate(tokens):
            own = label and k == 0
            if (t in fine and not own) or (i, k) in skip or (k + 1 < len(tokens) and tokens[k + 1][:2] in ("@", "[a", "(a")):
                continue
            bare = t.rstrip(":") if own else t
            got = self.token(bare, own, sound)
            if got is None and not own and sound == 2:
                fine.add(t)
            if got:
                out[k] = got[0] + t[len(bare) :]
        return out

    def sound(self, tokens: list[str]) -> int:
        """How much of a line's words is known: 2 from a half on, 1 from a
        quarter on, else 0; lines without words count as known."""
        return soundness(tokens, self.words)

    def noises(self, text: str) -> list[tuple[int, str]]:
        """(line number from 1, noise) of a text, in order."""
        _, kinds, cut, misread, _ = self.read(text)
        out = [(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_number")]
        return sorted(out + [(i + 1, "hyphen") for i in cut] + [(i + 1, "misread") for i in misread])

    def paragraphs(self, text: str | None) -> str | None:
        """Continuous paragraphs: page furniture left out, cut words joined,
        misread ones repaired, lines joined; blank lines between text separate
        paragraphs.  Null stays null."""
        if text is None:
            return None
        lines, kinds, _, _, fixed = self.read(text)
        out: list[list[str]] = [[]]
        for i, kind in enumerate(kinds):
            if kind == "text":
                if _label_line.match(lines[i]) or re.match(r"\s*(?:[-*•]|\w{1,2}[.)])\s", lines[i]):
                    out.append([])
                out[-1] += [t for t in fixed[i] if t]
            elif not kind and out[-1] and not (out[-1][-1][-1:].isalnum() and self._goes_on(lines, kinds, i)):
                out.append([])
        return "\n\n".join(" ".join(p) for p in out if p)

    @staticmethod
    def _goes_on(lines: list[str], kinds: list[str], i: int) -> bool:
        """Whether the text line after a gap carries on the sentence before it."""
        for j in range(i, len(lines)):
            if kinds[j] == "text":
                return lines[j].lstrip()[:1].islower()
        return False


# --- training -----------------------------------------------------------------------


def gold(recognised: str, correct: str):
    """(kinds, cut truth, pairs) of a recognised text from its correct form.

    kinds: of each line, '' where unsure; cut truth: line -> whether its marked
    end is a cut word; pairs: (token, right token, line)."""
    lines = split_lines(recognised)
    right = canonical(correct).split()
    flat, where = [], []
    cut: dict[int, bool] = {}
    known = set(right)
    i = 0
    filled = [j for j, x in enumerate(lines) if x.strip()]
    follow = {a: b for a, b in zip(filled, filled[1:])}
    dropped: set[int] = set()
    while i < len(lines):
        tokens = lines[i].split()
        for k, t in enumerate(tokens):
            if i in dropped and k == 0:
                continue
            m = _cut.match(t) if k == len(tokens) - 1 else None
            if m:
                # the word may go on past header and page-number lines
                nxt = follow.get(i)
                while nxt is not None:
                    first = lines[nxt].split()[0]
                    if m[1] + first in known or f"{m[1]}-{first}" in known:
                        break
                    nxt = follow.get(nxt)
                if nxt is not None:
                    cut[i] = m[1] + first in known
                    t = m[1] + first if cut[i] else f"{m[1]}-{first}"
                    dropped.add(nxt)
            flat.append(t)
            where.append(i)
        i += 1
    match = difflib.SequenceMatcher(None, right, flat, autojunk=False)
    touched, pairs = Counter(), []
    for tag, a0, a1, b0, b1 in match.get_opcodes():
        if tag == "equal" or (tag == "replace" and a1 - a0 == b1 - b0):
            for a, b in zip(range(a0, a1), range(b0, b1)):
                touched[where[b]] += 1
                pairs.append((flat[b], right[a], where[b]))
    size = Counter(where)
    kinds = []
    for i, line in enumerate(lines):
        if not line.strip():
            kinds.append("")
        elif size[i] == 0 or touched[i] * 2 >= size[i]:
            kinds.append("text")
        elif touched[i] == 0:
            kinds.append("page_number" if _pageish.match(line.strip()) else "header")
        else:
            kinds.append("")
    return lines, kinds, cut, pairs


def varied_lines(line: str, rng: random.Random) -> list[str]:
    """Text lines that pairs are short of, made of the words of ``line``: with
    capitals, numbers, an address of mail, or behind a field's label."""
    words = line.split() or ["a"]
    number = lambda a, b: "".join(rng.choice("0123456789") for _ in range(rng.randint(a, b)))
    parts = lambda: rng.choice(["", " ", ".", "-", "/"]).join(number(1, 4) for _ in range(rng.randint(1, 3)))
    at, to = sorted((rng.randrange(len(words) + 1), rng.randrange(len(words) + 1)))
    label = rng.choice(sorted(LABELS))
    label = rng.choice([label.capitalize(), label.upper()])
    return [
        " ".join([*words[:at], *(w.upper() for w in words[at:to]), *words[to:]]),
        " ".join([*words[:at], parts() + rng.choice(["", ".", ","]), *words[at:to]]),
        " ".join(w.upper() for w in [*words[:at], number(2, 5)]),
        " ".join([*words[:at], f"{words[0]}{number(0, 2)}@{words[-1].strip('.,')}.example".lower(), *words[at:to]]),
        f"{label}{rng.choice([': ', ' : ', ' '])}{rng.choice(['', '', 'Bs ', 'TV-', 'TV- '])}{parts()}",
    ]


def junk_line(words: list[str], rng: random.Random) -> list[str]:
    """Tokens of a line that nothing can be made of: the letters of known words
    in another order, vowels replaced by signs, fragments."""
    out = []
    for w in rng.choices(words, k=rng.randint(3, 9)):
        how = rng.randrange(3)
        if how == 0:
            out.append("".join(rng.sample(w, len(w))))
        elif how == 1:
            swap = {c: rng.choice("|/;:_~^*#+=§°0158@$¤") for c in "aeiou"}
            out.append("".join(swap.get(c, c) for c in w))
        else:
            out.append(w[: rng.randint(1, 3)])
    return out


def train(pairs: list[tuple[str, str]], words: Words, seed: int = 11) -> Repairer:
    """Models from (recognised, correct) texts; the same pairs in the same
    order give the same models."""
    rng = random.Random(seed)
    tagger, editor = Perceptron(), Editor(words)
    lines_x, joins, edits = [], [], []
    for n, (recognised, correct) in enumerate(pairs):
        if n % 4 == 0:
            body = rng.choice([x for x in correct.split("\n") if x.strip()] or [""])
            extra = "\n".join(rng.sample(varied_lines(body, rng), rng.randint(2, 4)))
            recognised, correct = f"{recognised}\n\n{extra}", f"{correct}\n\n{extra}"
        lines, kinds, cut, aligned = gold(recognised, correct)
        for f, k in zip(line_features(lines, words), kinds):
            if f and k:  # plain lines need no model
                lines_x.append((f, k))
        for i, is_cut in cut.items():
            m = _cut.match(lines[i].split()[-1])
            after = next((x for x in lines[i + 1 :] if x.strip()), "").split()
            if m and after:
                joins.append((editor.join_features(*end_of(m, after[0]), lines[i].rstrip("\r")[-1:] == " "), is_cut))
        for wrong, right, at in aligned:
            w, r = wrong.strip(_EDGE_RIGHT), right.strip(_EDGE_RIGHT)
            if w == r:
                w = r = w.strip(_EDGE_LEFT)
                if len(w) > 1 and not _code.search(w) and (not words.known(w.lower()) or rng.random() < 0.02):
                    edits.append((w, r, False, 2))
            elif len(w) > 1 and abs(len(w) - len(r)) <= 3:
                others = [t for t in lines[at].split() if t != wrong]
                edits.append((w, r.strip(_EDGE_LEFT) if w[0] not in _EDGE_LEFT else r, False, soundness(others, words)))
    editor.learn([(w, r) for w, r, _, _ in edits if w != r])
    for code in ("SAC", "TV", "RA", "ISO", "Sac", "TV-125", "B", "H", "n"):  # hyphens of codes are part of them
        for _ in range(12):
            joins.append((editor.join_features(code, "-", str(rng.randint(10, 999_999)), rng.random() < 0.3), False))
    meant = {}  # what may have been read where a run of characters was meant
    for x, ys in editor.learned.items():
        for y in ys:
            meant.setdefault(y, []).append(x)

    def misreadings(w: str) -> list[str]:
        return [w[:i] + x + w[i + len(y) :] for i in range(len(w)) for y, xs in meant.items() if y and w.startswith(y, i) for x in xs]

    clean = sorted(w for w, n in words.clean.items() if n >= 3 and w.isalpha() and len(w) > 3)
    for w in rng.sample(clean, min(len(clean), 800)):  # errors too rare for the sample
        wrong = misreadings(w)
        if wrong:
            edits.append((rng.choice(wrong), w, False, 2))
        i = rng.randrange(1, len(w))
        edits.append((w[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i + 1 :], w, False, 2))  # an error never seen
    for _ in range(300 if clean else 0):
        junk = junk_line(clean, rng)
        edits += [(t, t, False, soundness([x for x in junk if x is not t], words)) for t in junk if len(t) > 1 and not _code.search(t)]
    for _ in range(300):  # numbers with letters read into them, and sound ones
        number = "".join(rng.choice("0123456789") for _ in range(rng.randint(7, 12)))
        at = [i for i, c in enumerate(number) if c in "01582" and i]
        if at:
            i = rng.choice(at)
            edits.append((number[:i] + {"0": "O", "1": "l", "5": "S", "8": "B", "2": "Z"}[number[i]] + number[i + 1 :], number, False, 2))
    for label in sorted(LABELS):
        for shape in (label.capitalize(), label.upper()):
            edits += [(shape, shape, True, 2)] * 10
            edits += [(shape[0] + w[1:] if shape != label.upper() else w.upper(), shape, True, 2) for w in misreadings(label)]
    ready, of = [], {}
    for w, r, label, sound in edits:
        options = of.get((w, label)) or of.setdefault((w, label), editor.options(w, label))
        right = next((k for k, o in enumerate(options) if o[0] == r), None)
        if right is None and w != r:
            right = next((k for k, o in enumerate(options) if o[1] and o[0].lower() == r.lower()), None)
        if right is not None and len(options) > 1:
            ready.append(([editor.features(w, *o, label, sound) for o in options], right))
    score = editor.model.score
    for _ in range(EPOCHS):
        rng.shuffle(lines_x)
        for f, k in lines_x:
            guess = max(KINDS, key=lambda c: tagger.score([f"{c}|{x}" for x in f]))
            if guess != k:
                tagger.update([f"{k}|{x}" for x in f], [f"{guess}|{x}" for x in f])
            tagger.step()
        rng.shuffle(joins)
        for f, is_cut in joins:
            if (score(f) > 0) != is_cut:
                editor.model.update(f if is_cut else [], [] if is_cut else f)
            editor.model.step()
        rng.shuffle(ready)
        for features, right in ready:
            got = max(range(len(features)), key=lambda k: (score(features[k]), -k))
            if got != right:
                editor.model.update(features[right], features[got])
            editor.model.step()
    tagger.average()
    editor.model.average()
    return Repairer(words, tagger, editor)


# --- tables -------------------------------------------------------------------------

_WORD = r"(\p{L}[\p{L}\p{M}]*(?:-\p{L}+)*)"


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, rec_id, text of the three kinds of page text."""
    case = table(spark, sf_dir, "case_results").select(F.lit("obtained").alias("field"), F.col("result_id").alias("rec_id"), F.col("obtained").alias("text"))
    rec = table(spark, sf_dir, "recognitions")
    text = rec.where("strategy = 'rgb-original'").select(F.lit("text").alias("field"), F.col("recognition_id").alias("rec_id"), "text")
    raw = rec.select(F.lit("raw_text").alias("field"), F.col("recognition_id").alias("rec_id"), F.col("structured_fields.raw_text").alias("text"))
    return case.unionByName(text).unionByName(raw).where("text is not null")


def count_words(correct: DataFrame, recognised: DataFrame, keep: int = VOCABULARY) -> Words:
    """Counts of every word of all texts of the column ``text`` (words seen once
    tell nothing); the ``keep`` most frequent go into hash maps, the rest into a
    packed table."""

    def tokens(df: DataFrame, clean: bool) -> DataFrame:
        word: Column = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(1)))
        return df.select(word.alias("word"), F.lit(clean).alias("clean"))

    counts = (
        tokens(correct, True).unionByName(tokens(recognised, False)).groupBy("word").agg(F.count_if("clean").alias("c"), F.count_if(~F.col("clean")).alias("s"))
        .where("c + s > 1 and length(word) <= 40")
    ).toArrow()
    counts = counts.sort_by([("word", "ascending")])
    word, c, s = counts["word"].combine_chunks(), counts["c"].to_numpy(), counts["s"].to_numpy()
    order = np.argsort(-(c + s), kind="stable")
    often = np.sort(order[:keep])
    clean, seen = ({w: int(n) for w, n in zip(word.take(often).to_pylist(), x[often]) if n} for x in (c, s))
    rest = np.sort(order[keep:])
    if len(rest):
        packed = Packed(word.take(rest), c[rest], s[rest])
        clean, seen = Counts(clean, packed, "clean"), Counts(seen, packed, "seen")
    return Words(clean, seen)


_TRAINED: dict[tuple[str, str, int], Repairer] = {}


def trained(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> Repairer:
    """Word counts of all texts and models trained on ``sample`` case pairs; the
    same application reads and trains once for a folder."""
    at = (spark.sparkContext.applicationId, sf_dir, sample)
    if at not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[at] = _train_on(spark, sf_dir, sample)
    return _TRAINED[at]


def _train_on(spark: SparkSession, sf_dir: str, sample: int) -> Repairer:
    case = table(spark, sf_dir, "case_results")
    words = count_words(case.select(F.col("expected").alias("text")), page_texts(spark, sf_dir).select("text"))
    some = sampled(case, "result_id", sample).where("expected is not null and obtained rlike '\\\\S'").where(F.greatest(F.length("expected"), F.length("obtained")) <= SAMPLE_CHARS)
    pairs = some.select("result_id", "obtained", "expected").orderBy(F.xxhash64("result_id"), "result_id").collect()
    return train([(r["obtained"], r["expected"]) for r in pairs], words)


def noise_lines(df: DataFrame, repairer: Repairer) -> DataFrame:
    """(field, rec_id, line_no, noise) of ``df`` (field, rec_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for name, rec, text in zip(*(c.to_pylist() for c in b.columns)):
                if text:
                    for line, noise in shared.value.noises(text):
                        for column, x in zip(rows, (name, rec, line, noise)):
                            column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["field", "rec_id", "line_no", "noise"])

    return df.select("field", "rec_id", "text").mapInArrow(run, "field string, rec_id bigint, line_no int, noise string")


def repaired(df: DataFrame, repairer: Repairer) -> DataFrame:
    """(field, rec_id, text) with every text as continuous paragraphs."""
    shared = df.sparkSession.sparkContext.broadcast(repairer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([shared.value.paragraphs(t) for t in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], names=["field", "rec_id", "text"])

    return df.select("field", "rec_id", "text").mapInArrow(run, "field string, rec_id bigint, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every noisy line of the page texts."""
    return noise_lines(page_texts(spark, sf_dir), trained(spark, sf_dir))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page text as continuous readable paragraphs."""
    return repaired(page_texts(spark, sf_dir), trained(spark, sf_dir))
