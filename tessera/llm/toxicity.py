"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel counts common character subsequences of three letters, gaps
allowed, each weighted by a decay per letter spanned, so ``id*iot`` and
``idxiot`` stay close to ``idiot``. A Nystroem map over landmark words turns it
into a linear problem, and a squared-hinge SVM is trained on labelled
sentences: a sentence is a bag of words, a toxic one holds at least one
insulting word (the witness, chosen anew each round), a clean one holds none.
A text scores by its ``TOP`` worst words together and by how many words it
has: a single chance likeness among thousands of words says little, several say
much.

The span of a subsequence is limited, so its feature vector is explicit.
Letters are code points, each its own. The kernel expansion over the landmarks
collapses into one weight per subsequence that occurs in a landmark, and
scoring a word costs a gather and a sum.

The kernel compares words: an insult that is only one as a phrase of harmless
words is out of its reach.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, DECAY = 7, 0.75
LONG = 32  # letters beyond which a word is read through windows as well
WIDTHS = (8, 12, 16, 24, 48, 96)
TOP = 4  # worst words of a text that decide together
TRIPLES = [(i, i + a, i + a + b) for i in range(1) for a in range(1, SPAN) for b in range(1, SPAN - a)]

_spelled = re.compile(r"(?:(?<=\s)|^)[^\W\d_](?:[\s.*_-]{1,3}[^\W\d_]){3,}(?=\s|$|[.,!?])")
_not_letter = re.compile(r"[\W\d_]+")
_sentence = re.compile(r"[.!?\n]+")


def windows(word: str) -> Iterator[str]:
    """``word`` up to the longest width, and if it is long its windows of several widths, each overlapping the next by three quarters.

    Any run of at most three quarters of a width lies whole in a window of that
    width, so a short run is not lost among the letters around it.
    """
    if len(word) <= WIDTHS[-1]:
        yield word
    if len(word) > LONG:
        for width in WIDTHS:
            if width < len(word):
                yield from (word[a : a + width] for a in range(0, len(word) - width * 3 // 4, width // 4))


def units(token: str) -> Iterator[str]:
    """What a token is scored by: its letters without the marks between them, and its pieces between marks."""
    word = _not_letter.sub("", token)
    yield from windows(word)
    pieces = [p for p in _not_letter.split(token) if p]
    if len(pieces) > 1:
        for piece in pieces:
            if len(piece) > 3:
                yield from windows(piece)


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text, spelled-out words (``i d i o t``) joined as well."""
    low = text.lower()
    found = set(low.split())
    found.update(_not_letter.sub("", x) for x in _spelled.findall(low))
    return found


class Space:
    """The subsequences that occur in given words, numbered; all others share the number after the last."""

    DENSE = 1 << 22  # entries of a table by letters; beyond it numbers are found by search

    def __init__(self, words: list[str]):
        letters = sorted(set(map(ord, "".join(words))))
        self.letters = np.zeros(0x110000, dtype=np.int32)
        self.letters[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        self.keys, self.table = np.empty(0, dtype=np.int64), None
        found = [np.unique(k[w > 0]) for _, part in by_length(words) for k, w in [self._features(part)]]
        self.keys = np.unique(np.concatenate([*found, self.keys]))
        self.size = len(self.keys)
        if self.base**3 <= self.DENSE:
            self.table = np.full(self.base**3, self.size, dtype=np.int32)
            self.table[self.keys] = np.arange(self.size)

    def _number(self, key: np.ndarray) -> np.ndarray:
        """Number of each subsequence given by its three letters; -1 holds a letter that no word of the space has."""
        if self.table is not None:
            return np.where(key < 0, self.size, self.table[key])
        at = np.searchsorted(self.keys, key)
        return np.where((key >= 0) & (self.keys[np.minimum(at, self.size - 1)] == key), at, self.size)

    def _features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters as one key, weight) of every 3-letter subsequence; equal ones summed into one place, rows of unit length."""
        width = max([SPAN, *map(len, words)])
        raw = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
        c = self.letters[raw]
        strange = (c == 0) & (raw > 0)
        other = np.unique(raw[strange]) if strange.any() else ()
        if len(other):  # letters the space lacks are told apart all the same
            c[strange] = self.base + np.searchsorted(other, raw[strange])
        base = self.base + len(other)
        c = np.pad(c.astype(np.int32 if base < 1290 else np.int64), ((0, 0), (0, SPAN)))
        feats, weights = [], []
        for _, j, k in TRIPLES:
            a, b, d = c[:, :width], c[:, j : j + width], c[:, k : k + width]
            feats.append((a * base + b) * base + d)
            weights.append(np.where(d > 0, DECAY ** (k + 1), 0.0))
        f, w = np.concatenate(feats, axis=1), np.concatenate(weights, axis=1)
        order = np.argsort(np.where(w > 0, f, f.dtype.type(base**3 - 1)), axis=1, kind="stable")
        f, w = np.take_along_axis(f, order, 1), np.take_along_axis(w, order, 1)
        same = np.zeros_like(w, dtype=bool)
        same[:, 1:] = (f[:, 1:] == f[:, :-1]) & (w[:, 1:] > 0) & (w[:, :-1] > 0)
        start = np.flatnonzero(~same.ravel())
        total = np.zeros(w.size)
        total[start] = np.add.reduceat(w.ravel(), start)
        w = total.reshape(w.shape)
        norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
        if len(other):
            a, b, d = f // (base * base), f // base % base, f % base
            f = np.where((a < self.base) & (b < self.base) & (d < self.base), (a.astype(np.int64) * self.base + b) * self.base + d, -1)
        return f, w / np.where(norm > 0, norm, 1)

    def subsequences(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number, weight) of every subsequence, one row per word; weight 0 pads."""
        f, w = self._features(words)
        return self._number(f), w

    def dense(self, words: list[str]) -> np.ndarray:
        """One row per word over the numbered subsequences; the last column is all others."""
        out = np.zeros((len(words), self.size + 1), dtype=np.float32)
        for places, part in by_length(words):
            f, w = self.subsequences(part)
            for row, ff, ww in zip(places, f, w, strict=True):
                np.add.at(out[row], ff, ww)
        out[:, self.size] = 0
        return out

    def kernel(self, words: list[str], landmarks: np.ndarray) -> np.ndarray:
        """Kernel between words and landmarks given as (landmark, subsequence) rows."""
        flat, out = np.ascontiguousarray(landmarks.T), np.zeros((len(words), len(landmarks)), dtype=np.float32)
        for places, part in by_length(words):
            for a in range(0, len(part), 500):
                f, w = self.subsequences(part[a : a + 500])
                out[places[a : a + 500]] = np.einsum("nt,ntm->nm", w.astype(np.float32), flat[f])
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words in blocks of similar length: (places, words)."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[-(-len(w) // 4)].append(i)
    for size, places in groups.items():
        block = min(20_000, 80_000 // max(size, 1))
        for a in range(0, len(places), block):
            part = places[a : a + block]
            yield np.array(part), [words[i] for i in part]


@dataclass
class Model:
    """Weight of each subsequence, bias, and the calibration of a text's worst words and length."""

    space: Space
    weights: np.ndarray
    bias: float
    slopes: np.ndarray

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for places, part in by_length(words):
            f, w = self.space.subsequences(part)
            out[places] += (self.weights[f] * w).sum(axis=1)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return _logistic(evidence @ self.slopes[:-1] + self.slopes[-1])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _constant(offset: float) -> Model:
    """A model that says the same of every text."""
    space = Space(["abc"])
    return Model(space, np.zeros(space.size + 1), -1.0, np.array([0.0] * (TOP + 1) + [offset]))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-2, steps: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xs = x[on] * weight[on, None]
        grad = ridge * w - xs.T @ (y[on] * gap[on])
        step = np.linalg.solve(xs.T @ x[on] + np.diag(ridge + 1e-9), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _suspicion(bags: list[tuple[str, ...]], toxic: np.ndarray) -> dict[str, float]:
    """Log odds of each word's most telling 4 letters, by documents that hold them."""
    grams = lambda w: {w[i : i + 4] for i in range(max(1, len(w) - 3))} | {w}
    pos, neg = Counter(), Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (pos if t else neg).update({g for w in bag for g in grams(w)})
    n_pos, n_neg = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    neg = {g: neg[g] for g in pos}
    odds = {g: np.log((k + 0.5) / (n_pos + 1)) - np.log((neg[g] + 0.5) / (n_neg + 1)) + 0.5 * np.log(k) for g, k in pos.items()}
    return {w: max(odds.get(g, -9.0) for g in grams(w)) for w, t in ((w, t) for b, t in zip(bags, toxic, strict=True) if t for w in b) if t}


def _harmless(bags: list[tuple[str, ...]], toxic: np.ndarray, odds: float = 20.0) -> set[str]:
    """Words of clean texts, but for those ``odds`` times as frequent in toxic ones, one more clean text assumed.

    A single clean text that quotes an insult, or is wrongly labelled, does not clear it.
    """
    pos, neg = Counter(), Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (pos if t else neg).update(bag)
    ratio = odds * max(int(toxic.sum()), 1) / max(int((~toxic).sum()), 1)
    return {w for w, k in neg.items() if pos[w] < ratio * (k + 1)}


def train(texts: list[str], labels: list[int], *, landmarks: int = 128, negatives: int = 8_000, rounds: int = 3, seed: int = 7) -> Model:
    """Fits the SVM on sentences of labelled texts; one class alone gives a constant model."""
    toxic = np.array([bool(x) for x in labels], dtype=bool)
    if not toxic.any() or toxic.all():
        return _constant(2.0 if toxic.any() else -2.0)
    rng = np.random.default_rng(seed)
    # Sentences of toxic texts are bags whose witness is sought; those of clean texts are all negative.
    same: dict[str, str] = {}  # one string per distinct word
    words_in = lambda part: tuple({same.setdefault(u, u) for t in tokens(part) for u in units(t) if len(u) > 2})
    bags = [[s for s in map(words_in, _sentence.split(text)) if s] for text in texts]
    whole = [tuple({w for s in b for w in s}) for b in bags]
    del same
    rated = _suspicion(whole, toxic)
    harmless = _harmless(whole, toxic)
    clean = sorted(harmless)
    pick = [clean[i] for i in rng.permutation(len(clean))[:negatives]]
    model = None
    for turn in range(rounds):
        witness = Counter()
        for b, t in zip(bags, toxic, strict=True):
            if not t:
                continue
            score = {s: rated.get(s, -9.0) for sent in b for s in sent if s not in harmless}
            top = max(score.values(), default=-9.0)
            for sent in b:
                best = max((w for w in sent if w in score), key=lambda w: (score[w], w), default=None)
                if best is not None and score[best] >= top - 0.35 * abs(top) and score[best] > 0:
                    witness[best] += 1
        positive = [w for w, _ in witness.most_common(4_000)]
        if not positive:
            break
        if turn == 0:
            seen, chosen = Counter(), []
            for w in positive:  # spread the landmarks over families of words
                if seen[w[:3]] < 6 and len(chosen) < landmarks * 2 // 3:
                    chosen.append(w)
                    seen[w[:3]] += 1
            named = chosen + pick[: landmarks - len(chosen)]
            space = Space(named)
            marks = space.dense(named)
            values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
            root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        # Disguised copies of the witnesses: one letter more, somewhere inside.
        disguised = [w[:k] + chr(97 + int(rng.integers(26))) + w[k:] for w in positive[:600] for k in rng.integers(1, len(w), 3)]
        words = positive + disguised + pick
        x = np.hstack([space.kernel(words, marks) @ root, np.ones((len(words), 1))])
        y = np.concatenate([np.ones(len(positive) + len(disguised)), -np.ones(len(pick))])
        often = np.array([witness[w] for w in positive], dtype=float)
        again = np.repeat(often[:600], 3)
        weight = np.concatenate([often / often.sum(), 0.5 * again / again.sum(), np.full(len(pick), 2.0 / max(len(pick), 1))]) * 100
        w = _svm(x, y, weight)
        model = Model(space, (root @ w[:-1]) @ marks, float(w[-1]), np.zeros(TOP + 2))
        # Next round: the model's own witnesses, and the clean words it finds worst.
        words = sorted(rated)
        rated = dict(zip(words, (model.decide(words) + 1).tolist(), strict=True))
        found = model.decide(clean)
        pick = sorted(set(pick) | {clean[i] for i in np.argsort(-found)[: negatives // 4]})
    if model is None:
        return _constant(-2.0)
    known: dict[str, float] = {}
    found = np.concatenate([evidence(model, [tokens(t) for t in texts[a : a + 200]], known) for a in range(0, len(texts), 200)])
    return Model(model.space, model.weights, model.bias, _calibrated(found, toxic))


def _calibrated(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression with classes weighted alike; Newton steps with a small ridge."""
    y = toxic.astype(float)
    weight = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = _logistic(x @ b)
        grad = x.T @ (weight * (p - y)) + 1e-2 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def evidence(model: Model, bags: list[set[str]], known: dict[str, float], limit: int = 300_000) -> np.ndarray:
    """Per bag the ``TOP`` largest decision values and the logarithm of its size; ``known`` keeps values of tokens seen before."""
    floor = min(model.bias, -1.0)
    out = np.full((len(bags), TOP + 1), floor)
    for a in range(0, len(bags), 200):
        part = bags[a : a + 200]
        if len(known) > limit:
            known.clear()
        fresh = list({t for bag in part for t in bag if t not in known})
        if fresh:
            each = ((t, u) for t in fresh for u in units(t))
            while block := list(islice(each, 100_000)):
                for (t, _), v in zip(block, model.decide([u for _, u in block]).tolist(), strict=True):
                    known[t] = max(known.get(t, v), v)
        for i, bag in enumerate(part, a):
            worst = nlargest(TOP, map(known.__getitem__, bag))
            out[i, : len(worst)] = worst
            out[i, TOP] = np.log1p(len(bag))
    return out


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        texts, scores = batch.column(batch.num_columns - 1), []
        for a in range(0, len(texts), 200):
            bags = [tokens(t or "") for t in texts.slice(a, 200).to_pylist()]
            scores.append(model.probability(evidence(model, bags, known)))
        flat = np.concatenate(scores) if scores else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flat, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, per_class: int = 1_500, longest: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains on a bounded sample: ``per_class`` labelled texts of each class, at most ``longest`` characters each.

    The sample is the rows with the smallest hash of their id, so it does not
    depend on order or partitioning. Labels other than 0 and 1, null ids and
    null texts are left out.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "toxic")
    text = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text").between(1, longest))
    got = []
    for label in (0, 1):
        ids = rows.where(F.col("toxic") == label).select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        got += [(r["_text"], label) for r in text.join(F.broadcast(ids), "_id").orderBy("_id", "_text").limit(per_class).collect()]
    return train([t for t, _ in got], [x for _, x in got])


def score_toxicity(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per input row, from the whole text alone, whatever its length.

    Null, empty and letter-free texts score as a text without any suspicious
    word. Null ids and repeated rows pass through; other columns are not read.
    """
    # Broadcasts are pickled by reference: bytes carry the class along to executors without the package.
    sent = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scored(it, cloudpickle.loads(sent.value)), f"doc_id {kind}, score double")
