"""A character editor: keep, replace, delete, insert and join operations.

Every character of a word gets one operation.  ``K`` keeps it and is the
reference, so the scores of the others are odds against keeping; ``R`` replaces
it; ``D`` deletes it and ``I`` inserts one behind it, both only beside a
replacement or where no learned operation helps; ``J`` joins a word cut at a
line's end with its rest.  Which character is replaced by which is not listed
anywhere: the operations are read off aligned pairs of recognised and correct
words, and an averaged perceptron learns their scores from the characters
around them and from what is known of the word they lead to.  Where the learned
operations lead nowhere, every letter is tried at every place (``open``
operations), so that a misreading never seen in training can be repaired.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Shares of all recognised words, so that a table's size does not change them: from SOUND on
#: a word counts as good without a correct text that holds it; from LIKELY (one run of edits) and
#: SURELY (two runs, or an open operation) on a word is proposed.  LEAST sightings are needed for
#: a share to mean anything.
SOUND, LIKELY, SURELY, LEAST = 37.4e-6, 2.24e-6, 15e-6, 3
#: How many times as frequent as the word read a word reached by an open operation must be, and
#: the letters it must have at least.
OPEN_RATIO, OPEN_LETTERS = 40, 6

#: Letters that digits are misread as.
NUMERIC = str.maketrans("OoIlSBZ", "0011582")
#: Labels of the fields that are read from a page.
LABELS = frozenset("fecha monto nit código codigo n.i.t".split())

_number_like = re.compile(r"^[\dOoIlSBZ][\dOoIlSBZ.,/]*[\dOoIlSBZ]$")
ALPHABET = "abcdefghijklmnopqrstuvwxyzáéíóúüñ"

#: (first position, characters read, characters meant)
Run = tuple[int, str, str]


class Perceptron:
    """Averaged perceptron over sparse features; ``score`` of a feature list."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self._total: dict[str, float] = defaultdict(float)
        self._when: dict[str, int] = defaultdict(int)
        self._steps = 0

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def update(self, right: list[str], wrong: list[str]) -> None:
        for features, by in ((right, 1.0), (wrong, -1.0)):
            for f in features:
                old = self.weights.get(f, 0.0)
                self._total[f] += (self._steps - self._when[f]) * old
                self._when[f] = self._steps
                self.weights[f] = old + by

    def step(self) -> None:
        self._steps += 1

    def average(self) -> Perceptron:
        n = max(self._steps, 1)
        for f, w in self.weights.items():
            self._total[f] += (n - self._when[f]) * w
        self.weights = {f: t / n for f, t in self._total.items() if t}
        self._total, self._when = defaultdict(float), defaultdict(int)
        return self


def _bucket(n: int) -> int:
    return n.bit_length()


class Packed:
    """Words in the order of their bytes with two counts each, as plain buffers:
    some 30 bytes a word where a hash map takes 200."""

    def __init__(self, words: pa.Array, clean: np.ndarray, seen: np.ndarray):
        words = pa.concat_arrays([words.cast(pa.large_string())])
        _, offsets, data = words.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].copy() if len(words) else np.zeros(1, np.int64)
        self.data, self.offsets = (data.to_pybytes() if data else b"")[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        self.counts = {"clean": clean, "seen": seen}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def count(self, word: str, column: str) -> int:
        key, data, offsets = word.encode(), self.data, self.offsets
        low, high = 0, len(self)
        while low < high:
            mid = (low + high) // 2
            if data[offsets[mid] : offsets[mid + 1]] < key:
                low = mid + 1
            else:
                high = mid
        return int(self.counts[column][low]) if low < len(self) and data[offsets[low] : offsets[low + 1]] == key else 0

    def items(self, column: str) -> Iterator[tuple[str, int]]:
        for i, n in enumerate(self.counts[column]):
            if n:
                yield self.data[self.offsets[i] : self.offsets[i + 1]].decode(), int(n)


class Counts(dict):
    """The counts of the most frequent words, and in ``rest`` those of all others."""

    def __init__(self, often: dict[str, int], rest: Packed, column: str):
        super().__init__(often)
        self.rest, self.column = rest, column

    def get(self, word: str, default: int = 0) -> int:
        return super().get(word) or self.rest.count(word, self.column) or default

    def __contains__(self, word: object) -> bool:
        return self.get(word) > 0

    def items(self) -> Iterator[tuple[str, int]]:
        yield from super().items()
        yield from self.rest.items(self.column)

    def __reduce__(self):
        return Counts, (dict(super().items()), self.rest, self.column)


@dataclass
class Words:
    """Counts of words in correct and in recognised texts."""

    clean: dict[str, int] = field(default_factory=dict)
    seen: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.total = sum(n for _, n in self.seen.items())

    def holds(self, count: int, share: float) -> bool:
        """Whether a count is at least this share of all recognised words."""
        return count >= max(LEAST, share * self.total)

    def known(self, word: str) -> bool:
        return self.clean.get(word, 0) >= LEAST

    def weight(self, word: str) -> int:
        """Sightings of a word, those in correct texts counted twice."""
        word = word.lower()
        return 2 * self.clean.get(word, 0) + self.seen.get(word, 0)


def align(read: str, right: str) -> list[Run]:
    """The runs of operations that make ``right`` of ``read``, fewest first.

    A run is one replacement with the deletions or insertions right behind it."""
    n, m = len(read), len(right)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            d[i][j] = m - j if i == n else n - i if j == m else min(d[i + 1][j + 1] + (read[i] != right[j]), d[i + 1][j] + 1, d[i][j + 1] + 1)
    out: list[Run] = []
    i = j = 0
    open_ = False  # whether the operation before may be carried on
    while i < n or j < m:
        here = d[i][j]
        if i < n and j < m and read[i] != right[j] and here == d[i + 1][j + 1] + 1:
            out.append((i, read[i], right[j]))
            i, j, open_ = i + 1, j + 1, True
        elif open_ and i < n and here == d[i + 1][j] + 1:
            at, x, y = out[-1]
            out[-1] = (at, x + read[i], y)
            i += 1
        elif open_ and j < m and here == d[i][j + 1] + 1:
            at, x, y = out[-1]
            out[-1] = (at, x, y + right[j])
            j += 1
        elif i < n and j < m and read[i] == right[j] and here == d[i + 1][j + 1]:
            i, j, open_ = i + 1, j + 1, False
        elif i < n and here == d[i + 1][j] + 1:
            out.append((i, read[i], ""))
            i, open_ = i + 1, True
        else:
            out.append((i, "", right[j]))
            j, open_ = j + 1, True
    return out


def applied(word: str, runs: tuple[Run, ...]) -> str:
    """``word`` after ``runs``, which are in the order of their places."""
    for i, wrong, right in reversed(runs):
        word = word[:i] + right + word[i + len(wrong) :]
    return word


def operations(word: str, runs: tuple[Run, ...]) -> Iterator[tuple[int, str]]:
    """(position, operation) of every character that isn't kept."""
    for i, wrong, right in runs:
        for k in range(max(len(wrong), len(right))):
            if k < len(wrong) and k < len(right):
                yield i + k, f"R{right[k]}"
            elif k < len(wrong):
                yield i + k, "D"
            else:
                yield min(i + len(wrong), len(word)) - 1, f"I{right[k]}"


def _shape(c: str) -> str:
    return c if c in "^$" else "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "."


def _odd(word: str) -> bool:
    """Whether a sign or digit stands among lower-case letters."""
    return bool(re.search(r"[^\W\d_][\d@(!|$€]+(?:[a-zñáéíóú]|$)|^[\d@(!|$€]+[a-zñáéíóú]{2}", word))


def _is_number(word: str) -> bool:
    return bool(_number_like.match(word)) and sum(c.isdigit() for c in word) >= 3


@dataclass
class Editor:
    """Learned operations and their scores."""

    words: Words
    model: Perceptron = field(default_factory=Perceptron)
    #: what was read -> what was meant, the most frequent first
    learned: dict[str, list[str]] = field(default_factory=dict)

    def learn(self, pairs: list[tuple[str, str]]) -> None:
        """Take the runs of operations from aligned (read, meant) words."""
        seen = Counter((x, y) for a, b in pairs for _, x, y in align(a, b) if x and len(x) <= 3 and len(y) <= 3)
        self.learned = {}
        for (x, y), _ in sorted(seen.items(), key=lambda t: (-t[1], t[0])):
            self.learned.setdefault(x, []).append(y)

    def runs(self, word: str) -> Iterator[Run]:
        """The learned runs that may be applied to ``word``; in words of capitals
        the capitals of what was learned apply as well."""
        longest = max(map(len, self.learned), default=0)
        upper, lower = word.isupper() and len(word) > 1, word[1:].islower()
        for i in range(len(word)):
            for size in range(1, longest + 1):
                wrong = word[i : i + size]
                if len(wrong) == size:
                    for right in self.learned.get(wrong, ()):
                        if upper and right.islower():
                            right = right.upper()
                        if not (lower and i and right[:1].isupper()):
                            yield i, wrong, right
                    if upper and wrong.isalpha():
                        for right in self.learned.get(wrong.lower(), ()):
                            yield i, wrong, right.upper()

    def _open(self, word: str, good) -> Iterator[tuple[str, Run]]:
        """(result, run) of every single replacement, deletion and insertion that
        leads to a word, in lower case, of which ``good`` holds."""
        low, cased = word.lower(), str.upper if word.isupper() else str
        if len(low) != len(word):
            return
        for i, c in enumerate(word):
            left, after, first = low[:i], low[i + 1 :], not i and c.isupper()
            if not first and good(left + after):
                yield word[:i] + word[i + 1 :], (i, c, "")
            for x in ALPHABET:
                if x != low[i] and not first and good(left + x + after):
                    yield word[:i] + cased(x) + word[i + 1 :], (i, c, cased(x))
                if good(low[: i + 1] + x + after):
                    yield word[: i + 1] + cased(x) + word[i + 1 :], (i, c, c + cased(x))

    def options(self, word: str, label: bool = False) -> list[tuple[str, tuple[Run, ...]]]:
        """The word as it is, and every word that operations make of it and that
        is better known than it: one run, else two, else an open operation;
        words with a sign or digit among their letters may lead to unknown ones."""
        out = [(word, ())]
        if _is_number(word) and not word.isdigit():
            runs = tuple((i, c, c.translate(NUMERIC)) for i, c in enumerate(word) if c.isalpha())
            return [*out, (applied(word, runs), runs)] if runs else out
        words = self.words
        own = words.weight(word)  # a misreading is rarer than what it stands for
        single = list(dict.fromkeys(self.runs(word)))
        hits: dict[str, tuple[Run, ...]] = {}
        for r in single:
            result = applied(word, (r,))
            n = words.weight(result)
            if n > own and (words.holds(n, LIKELY) or words.clean.get(result.lower(), 0) >= 1):
                hits.setdefault(result, (r,))
        if not hits and len(word) >= 5:
            for j, a in enumerate(single):
                for b in single[j + 1 :]:
                    if b[0] >= a[0] + len(a[1]):
                        result = applied(word, (a, b))
                        n = words.weight(result)
                        if n > own and (words.clean.get(result.lower(), 0) >= 2 or words.holds(n, SURELY)):
                            hits.setdefault(result, (a, b))
        if not hits and len(word) >= OPEN_LETTERS and word.isalpha() and (word.islower() or word.isupper() or word[1:].islower()):
            for result, r in self._open(word, words.known):
                n = words.weight(result)
                if n >= OPEN_RATIO * max(own, 1) and words.holds(n, SURELY):
                    hits.setdefault(result, (r,))
        if not hits and _odd(word) and sum(c.isalpha() for c in word) >= 3:
            runs = self._by_characters(word)
            if runs:
                hits.setdefault(applied(word, runs), runs)
        if label and word.lower().rstrip(".") not in LABELS:
            for result, r in [*((applied(word, (r,)), r) for r in single), *self._open(word, lambda w: w.rstrip(".") in LABELS)]:
                if result.lower().rstrip(".") in LABELS:
                    hits.setdefault(result, (r,))
        return out + list(hits.items())

    def _by_characters(self, word: str) -> tuple[Run, ...]:
        """The best operation of each sign or digit by the characters around it
        alone, for words that lead to no known one."""
        out = []
        for i, c in enumerate(word):
            if not c.isalpha() and self.learned.get(c):
                best = max(self.learned[c], key=lambda y: self.model.score(self._around(word, (i, c, y))))
                out.append((i, c, best))
        return tuple(out)

    @staticmethod
    def _around(word: str, run: Run) -> list[str]:
        f = []
        for i, op in operations(word, (run,)):
            c, left, after = word[i], word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
            f += [op, f"{op[0]} {_shape(left)}{_shape(c)}{_shape(after)}", f"{op} {c}", f"{op} {left}{c}", f"{op} {c}{after}"]
        return f

    def features(self, word: str, result: str, runs: tuple[Run, ...], label: bool, sound: int) -> list[str]:
        """Features of an operation sequence: of each operation the characters
        around it; of the whole what is known of the words before and after, and
        how much of the line is known (``sound``, 0 to 2)."""
        words = self.words
        a, b = word.lower(), result.lower()
        ca, sa, cb, sb = words.clean.get(a, 0), words.seen.get(a, 0), words.clean.get(b, 0), words.seen.get(b, 0)
        odd, many = _odd(word), _is_number(word)
        if not runs:
            return ["K", f"K,clean={min(_bucket(ca), 5)}", f"K,rate={self._rate(sa)}", f"K,odd={odd}", f"K,number={many}", f"K,len={min(len(a), 8)}", f"K,label={label and a in LABELS}", f"K,clean={ca > 0},odd={odd}"]
        ratio = min(_bucket((cb + sb) // (ca + sa + 1)), 12)
        learned = all(y in self.learned.get(x, ()) or y.lower() in self.learned.get(x.lower(), ()) for _, x, y in runs)
        f = ["E", f"E,n={len(runs)}", f"E,clean={min(_bucket(cb), 8)}", f"E,rate={self._rate(sb)}", f"E,ratio={ratio}", f"E,was={min(_bucket(ca), 5)}", f"E,odd={odd}", f"E,number={many}", f"E,len={min(len(a), 8)}", f"E,label={label and b in LABELS and a not in LABELS}", f"E,ratio={ratio},was={ca > 0}", f"E,clean={cb > 0},was={ca > 0},len={min(len(a), 4)}", f"E,learned={learned}", f"E,sound={sound}", f"E,sound={sound},odd={odd}"]
        for run in runs:
            f += self._around(word, run)
            f.append(f"run {run[1]}>{run[2]}")
        return f

    def _rate(self, n: int) -> int:
        """A count as a share of all words, in powers of two per ten million."""
        return _bucket(int(n * 10_000_000 / max(self.words.total, 1))) if n else -1

    def best(self, word: str, label: bool = False, sound: int = 2) -> tuple[str, tuple[Run, ...]]:
        """(result, runs) of the highest score; the word itself wins ties."""
        options = self.options(word, label)
        if len(options) == 1:
            return options[0]
        return max(options, key=lambda o: (self.model.score(self.features(word, o[0], o[1], label, sound)), not o[1]))

    # --- line ends

    def join_features(self, left: str, mark: str, right: str, spaced: bool) -> list[str]:
        """Features of joining (J) at the mark that ends ``left``."""
        words = self.words
        a, b = left.lower(), right.lower()
        whole, compound = words.clean.get(a + b, 0) + words.seen.get(a + b, 0), words.clean.get(f"{a}-{b}", 0)
        f = [
            "bias", f"mark={mark}", f"spaced={spaced}", f"whole={min(_bucket(whole), 6)}", f"compound={min(_bucket(compound), 3)}", f"left={words.known(a)}", f"right={words.known(b)}",
            f"lower={right[:1].islower()}", f"digits={right[:1].isdigit()}", f"caps={left.isupper() and len(left) > 1},{right[:1].isdigit()}", f"whole={whole > 0},compound={compound > 0}", f"whole={whole > 0},left={words.known(a)},right={words.known(b)},{mark}",
        ]
        return [f"J,{x}" for x in f]

    def joins(self, left: str, mark: str, right: str, spaced: bool) -> bool:
        return self.model.score(self.join_features(left, mark, right, spaced)) > 0
