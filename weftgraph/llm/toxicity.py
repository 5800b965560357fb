"""Toxicity: a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

The kernel of two strings sums, over all subsequences of LENGTH characters they share, DECAY to the power
of the stretch they take in both; normalised, it is 1 for equal strings and stays high when characters
are inserted or gaps opened ("id.iot", "i d i o t"). Landmarks are the pieces of words that tell toxic from
clean training documents best; a unit has with a landmark the highest kernel of its windows, so that stems show in longer words. The Nystroem map
of a string is its kernel with the landmarks times the inverse square root of their own kernel matrix.

A sentence stands for its unit (a word, or a run of single characters) that is most like a landmark; a
linear machine is trained on labelled sentences: those of clean documents, and of toxic documents the one
with the highest margin (chosen anew each round), each also with inserted characters and gaps. A document
has the margins of its three worst units, turned into a probability by a logistic fit on training
documents that the machine has not seen.

All windows of one to two times a landmark's length are looked at. A kernel below the least that two characters
inserted anywhere in the landmark leave counts as 0; all others are exact, whichever letters a window lacks. Long
units are read in overlapping parts. Upper bounds of the kernel (letters that a unit has, then what its triples of
characters come to) tell which units need windows for which landmarks.

The model is fitted on at most 2 * PER_CLASS labelled rows (whole texts) outside the held-out fold and is
small whatever the size of the corpus. Scoring is one pass without a shuffle.

Defined results: null and empty texts have the margin of a sentence unlike all landmarks; without usable
rows of both labels every score is the share of label 1 (0.0 if there is no label); rows are independent;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_arrow, rows
from .labelled import training_rows

MODULUS, HELD_OUT, PER_CLASS = 4, 2, 2000
LENGTH, DECAY, LANDMARKS = 3, 0.6, 32
#: Lengths of landmarks; parts that long units are read in, and their overlap (the widest window).
SHORT, LONG, LONGEST, OVERLAP = 4, 7, 40, 14
#: Parts whose kernels are taken at a time; kernels below what so many inserted characters leave count as 0.
CHUNK, INSERTED = 10_000, 2
#: Parts with more characters of a landmark than these get windows without the bound from triples.
BOUNDED = 12
REMEMBERED, SCORED = 400_000, 1_000_000
#: Units whose margins make a document's score.
WORST = 3
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
THREE = re.compile(r"\s\S[ \t]+\S[ \t]+\S(?!\S)")
DOTTED = re.compile(r"(?:\w\W){2,}\w$")
EDGES = ".,;:!?\"'()[]{}"


def dotted(words: list[str]) -> list[str]:
    """Dotted runs of single characters among words, put together."""
    return [re.sub(r"\W", "", x) for x in words if len(x) > 4 and not x.isalnum() and DOTTED.match(x)]


def spaced(low: str) -> list[str]:
    """Spaced runs of single characters, put together."""
    return [re.sub(r"\s+", "", m) for m in SINGLES.findall(low)] if THREE.search(" " + low) else []


def units(sentence: str) -> list[str]:
    """Lowered words without punctuation at their edges; runs of single characters, spaced or dotted, are put together."""
    low = sentence.lower()
    found = [x.strip(EDGES) for x in low.split()]
    return found + dotted(found) + spaced(low)


def codes(strings: list[str], width: int) -> np.ndarray:
    """Code points, -1 past the end."""
    out = np.array(strings, f"U{width}").view(np.int32).reshape(len(strings), width)
    out[np.arange(width) >= np.fromiter(map(len, strings), np.int64, len(strings))[:, None]] = -1
    return out


def kernel(s: np.ndarray, t: np.ndarray, length: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Gapped subsequence kernel of row pairs (strings as rows of code points, -1 past the end)."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    same = [[(s[:, i] == t[:, j]) & (s[:, i] >= 0) for j in range(lt)] for i in range(ls)]
    live_s = s >= 0
    rows_before = np.ones((ls + 1, lt + 1, n))  # the kernel of each pair of prefixes, for one length less
    for _ in range(1, length):
        now = np.zeros((ls + 1, lt + 1, n))
        for i in range(ls):
            run = np.zeros(n)
            for j in range(lt):
                run = decay * run + np.where(same[i][j], decay * decay * rows_before[i, j], 0)
                now[i + 1, j + 1] = np.where(live_s[:, i], decay * now[i, j + 1] + run, now[i, j + 1])
        rows_before = now
    total = np.zeros(n)
    for i in range(ls):
        for j in range(lt):
            total += np.where(same[i][j], decay * decay * rows_before[i, j], 0)
    return total


def own_kernels(s: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Kernel (LENGTH 3) of every prefix of each row with itself: element w - 1 for the first w characters."""
    n, width = s.shape
    same = [[(s[:, i] == s[:, j]) & (s[:, i] >= 0) for j in range(i + 1)] for i in range(width)]
    before = [[np.ones(n)] * (i + 1) for i in range(width + 1)]  # the kernels of pairs of prefixes, j <= i, for one length less
    for _ in range(1, LENGTH):
        now = [[np.zeros(n)] * (i + 1) for i in range(width + 1)]
        for i in range(width):
            run = np.zeros(n)
            for j in range(i + 1):
                run = decay * run + same[i][j] * (decay * decay * before[i][j])
                now[i + 1][j + 1] = decay * (now[i][j + 1] if j < i else now[i + 1][i]) + run
        before = now
    total, out = np.zeros(n), np.zeros((n, width))
    for i in range(width):
        for j in range(i + 1):
            total = total + same[i][j] * ((1 if i == j else 2) * decay * decay * before[i][j])
        out[:, i] = total
    return out


#: The square root of the own kernel of n characters that all differ.
DISTINCT = np.sqrt(own_kernels(np.arange(2 * LONG, dtype=np.int32)[None, :])[0, np.maximum(np.arange(2 * LONG + 1) - 1, 0)])


def least_kernel(landmark: str) -> float:
    """The lowest kernel of a landmark with itself after INSERTED other characters (alike or not) were put in, wherever they stand."""
    n = len(landmark) + INSERTED
    rows_ = []
    for places, alike in product(combinations(range(1, n - 1), INSERTED), (False, True)):
        row, rest = np.full(n, -2, np.int32), iter(landmark)
        row[list(places)] = 0x110000 if alike else range(0x110000, 0x110000 + INSERTED)
        row[row == -2] = [ord(c) for c in rest]
        rows_.append(row)
    s, t = np.array(rows_), codes([landmark] * len(rows_), len(landmark))
    return float((kernel(s, t) / np.sqrt(kernel(s, s) * kernel(t, t))).min()) - 1e-9


@dataclass
class Model:
    landmarks: list[str]
    own: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float


def marked(unit: str) -> str:
    """A unit between its end marks, at most LONGEST characters (longer ones are read in parts)."""
    return f"^{unit}$"


def parts(unit: str) -> list[str]:
    whole = marked(unit)
    return [whole] if len(whole) <= LONGEST else [whole[i : i + LONGEST] for i in range(0, len(whole) - OVERLAP, LONGEST - OVERLAP)]


class Machine(dict):
    """unit -> highest normalised kernel of a window of the unit with each landmark (None where all are below the least).

    A window has as many characters as the landmark at least and twice as many at most; a shorter string is one
    window. The kernel is summed from the triples of characters that some landmark has; all others add nothing.
    """

    def __init__(self, landmarks: list[str], own: np.ndarray | None = None):
        super().__init__()
        self.landmarks = landmarks
        self.codes = codes(landmarks, max(map(len, landmarks)))
        self.own = own if own is not None else np.sqrt(kernel(self.codes, self.codes))
        self.lengths = np.array([len(x) for x in landmarks])
        self.span = 2 * int(self.lengths.max())
        self.letters = np.unique(self.codes[self.codes >= 0])
        self.base = len(self.letters) + 1
        weights: dict[int, np.ndarray] = {}
        for k, x in enumerate(landmarks):
            small = (np.searchsorted(self.letters, [ord(c) for c in x]) + 1).tolist()
            for i, j, e in combinations(range(len(x)), LENGTH):
                key = (small[i] * self.base + small[j]) * self.base + small[e]
                weights.setdefault(key, np.zeros(len(landmarks)))[k] += DECAY ** (e - i + 1)
        self.place = np.zeros(self.base**LENGTH, np.int32)
        self.place[list(weights)] = np.arange(1, len(weights) + 1)
        self.triples = np.vstack([np.zeros(len(landmarks)), *weights.values()])
        # Second and third characters of the subsequences that start at a place, by the place of the third.
        self.second, self.third = (np.array(x) for x in zip(*[(j, e) for e in range(2, self.span) for j in range(1, e)], strict=True))
        self.least = np.array([least_kernel(x) for x in landmarks])
        # A string's own kernel is least when its characters differ: below these sums no window reaches the least value.
        self.bound = (self.least * self.own)[:, None] * DISTINCT * (1 - 1e-9)
        # Of a landmark's own kernel, the part of the triples made of a set of its letters bounds what strings of these letters reach.
        self.enough = []
        # A landmark's letters numbered from 1 (others 0), and the weights of its triples by these numbers.
        self.local, self.weight = np.zeros((len(landmarks), self.base), np.int16), np.zeros((len(landmarks), (LONG + 1) ** LENGTH))
        for k in range(len(landmarks)):
            keys = {key: w[k] for key, w in weights.items() if w[k] > 0}
            letters = sorted({c for key in keys for c in self._letters_of(key)})
            share = [sum(v * v for key, v in keys.items() if all(m >> letters.index(c) & 1 for c in self._letters_of(key))) for m in range(1 << len(letters))]
            self.enough.append((np.array(letters), np.sqrt(share) >= self.least[k] * self.own[k] * (1 - 1e-9)))
            self.local[k, letters] = np.arange(1, len(letters) + 1)
            for key, v in keys.items():
                x, y, z = self.local[k, list(self._letters_of(key))].tolist()
                self.weight[k, (x * (LONG + 1) + y) * (LONG + 1) + z] = v

    def _letters_of(self, key: int) -> tuple[int, int, int]:
        return key // self.base**2, key // self.base % self.base, key % self.base

    def learn(self, new: set[str]) -> None:
        """Kernel rows of units not seen so far, all in one go."""
        if len(self) + len(new) > REMEMBERED:
            self.clear()
        self.update(dict.fromkeys(new))
        names = sorted(((u, p) for u in new for p in parts(u)), key=lambda x: -len(x[1]))
        for a in range(0, len(names), CHUNK):
            some = names[a : a + CHUNK]
            text = codes([p for _, p in some], len(some[0][1]))
            at = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
            small = np.where(self.letters[at] == text, at + 1, 0)
            size = (text >= 0).sum(axis=1)
            row, kind = self.near(small, size)
            for b in range(0, len(row), CHUNK):
                r, k = row[b : b + CHUNK], kind[b : b + CHUNK]
                value = self.highest(text[r], small[r], size[r], k)
                for i in np.flatnonzero(value).tolist():
                    u = some[r[i]][0]
                    if self[u] is None:
                        self[u] = np.zeros(len(self.landmarks))
                    self[u][k[i]] = max(self[u][k[i]], value[i])

    def near(self, small: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and landmarks whose kernel may reach the least value, by row: by Cauchy-Schwarz over the letters, then by the triples."""
        has = np.zeros((self.base, len(small)), bool)
        for column in small.T:
            has[column, np.arange(len(small))] = True
        found = []
        for k, (letters, enough) in enumerate(self.enough):
            at = np.flatnonzero(enough[np.packbits(has[letters], axis=0, bitorder="little")[0]])
            if len(at):
                at = at[self.most(small[at], k) >= self.bound[k, np.clip(size[at], LENGTH, self.lengths[k])]]
            found.append(at)
        row = np.concatenate(found)
        order = np.argsort(row, kind="stable")
        return row[order], np.repeat(np.arange(len(found)), [len(x) for x in found])[order]

    def most(self, small: np.ndarray, k: int) -> np.ndarray:
        """At least the kernel of any window of each row with a landmark: the sum over all triples no wider than a window."""
        local = self.local[k][small]
        row, col = np.nonzero(local)
        count = np.bincount(row, minlength=len(small))
        of, letter = count[row], local[row, col]
        fall = DECAY ** (np.arange(small.shape[1]) + 1.0) * (np.arange(small.shape[1]) < 2 * self.lengths[k])
        out = np.where(count > BOUNDED, np.inf, 0.0)
        for n in np.unique(count[(count >= LENGTH) & (count <= BOUNDED)]).tolist():
            x, place = letter[of == n].reshape(-1, n), col[of == n].reshape(-1, n)
            i, j, e = np.array(list(combinations(range(n), LENGTH))).T
            out[count == n] = (self.weight[k][(x[:, i] * (LONG + 1) + x[:, j]) * (LONG + 1) + x[:, e]] * fall[place[:, e] - place[:, i]]).sum(axis=1)
        return out

    def highest(self, text: np.ndarray, small: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Highest normalised kernel of a window of each row, longest rows first, with the row's landmark."""
        n, width = text.shape
        small = np.pad(small, ((0, 0), (0, self.span)))
        text = np.pad(text, ((0, 0), (0, self.span)), constant_values=-1)
        length = self.lengths[kind]
        bound = self.bound[kind, np.clip(size, LENGTH, length)]
        best, both = np.zeros(n), np.zeros((n, self.span))
        for start in range(width - LENGTH, -1, -1):
            live = int((size >= start + LENGTH).sum())
            if not live:
                continue
            left = size[:live] - start
            w = min(self.span, int(left[0]))
            # both: the kernels of the windows from here on by their width; they hold those from the next place on.
            both[:live, 1:w] = both[:live, : w - 1].copy()
            pairs = int(np.searchsorted(self.third, w))
            begun = np.flatnonzero(self.local[kind[:live], small[:live, start]])
            key = (small[begun, start, None] * self.base + small[begun[:, None], start + self.second[:pairs]]) * self.base + small[begun[:, None], start + self.third[:pairs]]
            value = self.triples[self.place[key], kind[begun, None]]
            row, pair = np.nonzero(value)
            if len(row):
                end = self.third[pair]
                added = np.bincount(row * w + end, value[row, pair] * DECAY ** (end + 1.0), len(begun) * w).reshape(len(begun), w)
                both[begun, :w] += np.cumsum(added, axis=1)
            found = np.flatnonzero((both[:live, w - 1] >= bound[:live]) & ((left >= length[:live]) | (start == 0)))
            if not len(found):
                continue
            own = np.sqrt(own_kernels(text[found, start : start + w]))
            chars = np.arange(1, w + 1)
            value = both[found, :w] * np.where(chars <= left[found, None], 1 / np.maximum(own, 1e-12), 0.0)
            fits = (chars >= length[found, None]) & (chars <= 2 * length[found, None])
            best[found] = np.maximum(best[found], np.where(fits, value, 0.0).max(axis=1))
            if start == 0:
                short = length[found] > size[found]
                best[found] = np.maximum(best[found], value[np.arange(len(found)), np.minimum(size[found], w) - 1] * short)
        best /= self.own[kind]
        return np.where(best >= self.least[kind], best, 0.0)

    def of_sentences(self, sentences: list[list[str]]) -> np.ndarray:
        """The kernel row of each sentence's unit that is most like a landmark."""
        self.learn({u for s in sentences for u in s if u not in self})
        out = np.zeros((len(sentences), len(self.landmarks)))
        top = {u: float(r.max()) for u, r in self.items() if r is not None}
        for i, s in enumerate(sentences):
            found = [u for u in s if u in top]
            if found:
                out[i] = self[max(found, key=top.__getitem__)]
        return out


def substrings(unit: str) -> set[str]:
    whole = marked(unit)
    return {whole[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(whole) - n + 1)}


def choose_landmarks(samples: list[tuple[int, str, int]]) -> list[str]:
    """Pieces of words that together cover the toxic rows and hardly occur in clean ones.

    Candidates are substrings (with end marks) of words that only toxic rows have. One after another, the
    one is taken that covers most toxic rows (rows count half for each landmark that they have), less what it
    would cost in clean rows.
    """
    clean: Counter = Counter()
    for _, text, label in samples:
        if label == 0:
            clean.update(set(units(text)))
    toxic = [{u for u in units(text) if 3 <= len(u) <= 30 and u not in clean} for _, text, label in samples if label == 1]
    covers: dict[str, set[int]] = {}
    for i, us in enumerate(toxic):
        for u in us:
            for x in substrings(u):
                covers.setdefault(x, set()).add(i)
    covers = {x: c for x, c in covers.items() if len(c) >= 3}
    against: Counter = Counter()
    for u, n in clean.items():
        for x in substrings(u):
            if x in covers:
                against[x] += n
    share = max(1, len(samples) - len(toxic)) / max(1, len(toxic))
    times, chosen = Counter(), []
    pool = sorted(covers, key=lambda x: (-(len(covers[x]) - 3 * against[x] / share), -len(x), x))[:3000]
    while pool and len(chosen) < LANDMARKS:
        gain = lambda x: sum(2.0 ** -times[i] if times[i] < 4 else 0.0 for i in covers[x]) - 3 * against[x] / share
        best = max(pool, key=lambda x: (gain(x), len(x), x))
        if gain(best) < 1.5:
            break
        chosen.append(best)
        times.update(covers[best])
        pool.remove(best)
    return chosen


def disguises(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a character inserted, with dots between all of its characters, and with one character doubled."""
    i, j = int(rng.integers(1, len(word))), int(rng.integers(1, len(word)))
    return [word[:i] + str(rng.choice(list("*.-_x1"))) + word[i:], str(rng.choice(list(".*-_"))).join(word), word[:j] + word[j - 1] + word[j:]]


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear machine with hinge loss, by dual coordinate descent; the bias is a constant feature."""
    z = np.hstack([x, np.ones((len(x), 1))])
    alpha, w, norm = np.zeros(len(z)), np.zeros(z.shape[1]), (z * z).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(z)).tolist():
            g = y[i] * (z[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c * weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(samples: list[tuple[int, str, int]], share: float, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    cut = len(samples) // 4
    train, tune = [samples[i] for i in order[cut:]], [samples[i] for i in order[:cut]]
    landmarks = choose_landmarks(train)
    if not landmarks:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), math.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.array([1.0] + [0.0] * (WORST - 1)), 0.0)
    machine = Machine(landmarks)
    gram = kernel(np.repeat(machine.codes, len(landmarks), axis=0), np.tile(machine.codes, (len(landmarks), 1))).reshape(len(landmarks), -1) / np.outer(machine.own, machine.own)
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    def docs_of(part: list) -> tuple[np.ndarray, np.ndarray]:
        """Sentence rows and the document of each."""
        sentences, owner = [], []
        for i, (_, text, _) in enumerate(part):
            for s in SENTENCE.split(text):
                sentences.append(units(s))
                owner.append(i)
        return machine.of_sentences(sentences), np.array(owner, np.int64)

    rows_, owner = docs_of(train)
    label = np.array([s[2] for s in train])[owner]
    top = rows_.max(axis=1)
    # Clean sentences: the ones unlike every landmark are all alike; a few stand for them.
    clean = np.flatnonzero((label == 0) & (top > 0))
    clean = clean[np.argsort(-top[clean], kind="stable")]
    clean = np.concatenate([clean[:4000], rng.permutation(clean[4000:])[:2000], np.flatnonzero((label == 0) & (top == 0))[:200]])
    # The words that hold a landmark, disguised.
    held = sorted({u for _, text, label in train if label for u in units(text) if 4 <= len(u) <= 14 and any(x in marked(u) for x in landmarks)})
    held = [held[i] for i in rng.permutation(len(held))[:200]]
    extra = machine.of_sentences([[d] for w in held for d in disguises(w, rng)])
    toxic_at = [np.flatnonzero(owner == i) for i in range(len(train)) if train[i][2] == 1]
    margin = top
    for _ in range(3):
        worst = np.array([at[margin[at].argmax()] for at in toxic_at if len(at)])
        worst = worst[top[worst] > 0]
        x = np.vstack([rows_[clean], rows_[worst], extra[extra.max(axis=1) > 0]]) @ root
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(x) - len(clean))])
        weights, bias = train_svm(x, y, np.where(y > 0, len(clean) / max(1, len(y) - len(clean)), 1.0).clip(0.2, 5))
        margin = rows_ @ root @ weights + bias
    model = Model(landmarks, machine.own, root, weights, bias, np.zeros(WORST), 0.0)
    z = Scorer(model).margins([s[1] for s in tune])
    y = np.array([s[2] for s in tune])
    w = np.where(y > 0, share / max(1e-6, y.mean()), (1 - share) / max(1e-6, 1 - y.mean()))
    model.slopes, model.offset = logistic(z, y, w / w.sum())
    return model


def logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic fit by Newton steps; slopes are not negative (a worse sentence never lowers a score)."""
    x, a = np.hstack([z, np.ones((len(z), 1))]), np.zeros(z.shape[1] + 1)
    ridge = np.diag([penalty] * z.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ a)
        a = a - np.clip(step, -2, 2)
        a[:-1] = np.maximum(a[:-1], 0)
    return a[:-1], float(a[-1])


class Scorer:
    """Margins of documents in batches; each distinct word is judged once. A spaced run is kept with a space before it, which no word has."""

    def __init__(self, model: Model):
        self.model = model
        self.machine = Machine(model.landmarks, model.own) if model.landmarks else None
        self.seen: set[str] = set()
        #: Of the words with a unit above the bias, the margins of these units.
        self.hits: dict[str, dict[str, float]] = {}
        self.hit: set[str] = set()

    def judge(self, words: set[str]) -> None:
        """Keep the words and the margins of their units."""
        m, of = self.model, {}
        for x in words:
            u = x[1:] if x[0] == " " else x.strip(EDGES)
            of[x] = (u, *dotted([u])) if x[0] != " " and len(u) > 4 and not u.isalnum() else (u,)
        self.machine.clear()
        self.machine.learn({u for us in of.values() for u in us})
        near = [u for u, row in self.machine.items() if row is not None]
        above = {}
        if near:
            margin = np.stack([self.machine[u] for u in near]) @ m.root @ m.weights + m.bias
            above = {u: x for u, x in zip(near, margin.tolist(), strict=True) if x > m.bias}
        self.seen |= words
        self.hits |= {x: got for x, us in of.items() if (got := {u: above[u] for u in us if u in above})}
        self.hit = set(self.hits)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The margins of the WORST worst distinct units of each text."""
        m = self.model
        if self.machine is None:
            return np.full((len(texts), WORST), m.bias)
        found = []
        for t in texts:
            low = (t or "").lower()
            found.append(set(low.split()).union(" " + x for x in spaced(low)))
        new = set().union(*found) - self.seen
        if len(self.seen) + len(new) > SCORED:
            self.seen, self.hits = set(), {}
            new = set().union(*found)
        self.judge(new)
        out = np.full((len(texts), WORST), m.bias)
        for i, f in enumerate(found):
            above: dict[str, float] = {}
            for x in f & self.hit:
                above |= self.hits[x]
            top = sorted(above.values(), reverse=True)[:WORST]
            out[i, : len(top)] = top
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.margins(texts) @ self.model.slopes + self.model.offset
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model | float:
    """The model, or the share of label 1 where one label is missing."""
    samples = training_rows(docs, labels, label, MODULUS, HELD_OUT, per_class)
    counts = {r["v"]: r["n"] for r in labels.where(crc_bucket(F.col("doc_id"), MODULUS) != HELD_OUT).where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(samples, share) if {s[2] for s in samples} == {0, 1} else float(share)


_scorers: dict[bytes, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = model.weights.tobytes() + repr(model.landmarks).encode()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score_batch(model: Model | float, texts: list[str | None]) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else _scorer(model).scores(texts)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    def run(batches):
        for ids, texts, held in rows(batches, "doc_id", "text", "held_out"):
            score = score_batch(model.value, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_bucket(F.col("doc_id").cast("long"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return map_arrow(rows_in, run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class=per_class))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = score_batch(model.value, batch.column(at).to_pylist()) < threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
