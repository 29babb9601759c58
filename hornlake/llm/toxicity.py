r"""Toxicity by gradient-boosted trees over dense features (operator 3).

Features of a text: densities of learned word and word-beginning lexicons and
of a fixed insult list (after undoing digit and symbol obfuscation), how close
such words stand to second-person words, shares of capitals and punctuation,
and obfuscation rates. Trees are boosted on the logistic loss over feature
histograms; an isotonic fit of out-of-fold margins calibrates the scores.

All of the model is fitted on at most ``SAMPLE`` labelled rows (those whose ids
have the smallest hashes), wherever they lie in the table. Lexicons hold all words
and beginnings that are clearly likelier in toxic rows of the sample (``ODDS`` and
``DEVIATIONS``); for the trees, each half of the sample gets its features from the
other half's lexicon.

Cases: null and empty texts get the score of their (all zero) features; a
label must be 0 or 1, a row with several counts as toxic if one is; without
labels of both kinds every score is the share of toxic labels (0 without any);
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

SAMPLE = 20_000
LEAST_ROWS, ODDS, DEVIATIONS = 3, 1.5, 3.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 48, 5
CUT = 0.3
_WORD = re.compile(r"\w+(?:[*@$!.'-]+\w+)*")
_PUNCTUATION = re.compile(r"[^\w\s]")
#: Classes of the characters below 2^16: letter, upper case, neither word character nor space.
_CLASSES = np.array([[chr(c).isalpha(), chr(c).isupper(), bool(_PUNCTUATION.match(chr(c)))] for c in range(1 << 16)])
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
_STRIP = re.compile(r"[\W_]+")
_STRETCHED = re.compile(r"(.)\1\1", re.DOTALL)
# fixed values: insults and second-person words
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers trash scum clown pathetic worthless disgusting fool jerk ugly hate shut".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
NAMES = ["log_words", "word_hits", "word_density", "word_weight", "start_hits", "start_density", "start_weight", "insults", "insult_density", "second_person", "proximity", "nearness", "capitals", "shouted", "punctuation", "exclamation", "obfuscated", "stretched", "distinct_hits"]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(word: str) -> str:
    """A word without obfuscation by digits and symbols."""
    return _STRIP.sub("", word.translate(_PLAIN))


def keys_of(word: str) -> list[str]:
    """Lexicon keys: the word, and its beginnings of four to six letters with a dash."""
    return [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) > k)]


def char_counts(text: str) -> np.ndarray:
    """Letters, capitals and punctuation marks of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = _CLASSES[codes[codes < 1 << 16]].sum(axis=0)
    for c in map(chr, codes[codes >= 1 << 16].tolist()):
        counts += (c.isalpha(), c.isupper(), bool(_PUNCTUATION.match(c)))
    return counts


class Lexicon(dict):
    """word -> its row in ``rows`` (word weight, weight of its best beginning, insult, second person, obfuscated, stretched), up to ``BOUND`` words."""

    BOUND = 100_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.rows = np.empty((1024, 6))

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def values_of(self, word: str) -> tuple[float, ...]:
        bare = plain(word)
        odd = bare != word and any(c.isalpha() for c in word) and not word.replace("'", "").replace("-", "").replace(".", "").isalpha()
        w = max(self.weights.get(word, 0.0), self.weights.get(bare, 0.0) if odd else 0.0)
        start = max([0.0, *(self.weights.get(k, 0.0) for k in keys_of(word)[1:])])
        return w, start, float(bare in INSULTS), float(word in SECOND), float(odd), float(bool(_STRETCHED.search(word)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[at] = self.values_of(word)
        self[word] = at
        return at

    def table(self, words: list[str]) -> np.ndarray:
        if len(self) >= self.BOUND:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))  # may replace the rows
        return self.rows[at]

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(NAMES))
        words = tokens(text) if text else []
        if not words:
            return out
        n = len(words)
        table = self.table(words)
        bad = (table[:, :3] > 0).any(axis=1)
        at, second = np.nonzero(bad)[0], np.nonzero(table[:, 3])[0]
        near, nearness = 0, 0.0
        if len(at) and len(second):
            k = np.searchsorted(second, at)
            gap = np.minimum(np.abs(at - second[np.minimum(k, len(second) - 1)]), np.abs(at - second[np.maximum(k - 1, 0)]))
            near, nearness = int((gap <= 5).sum()), 1.0 / (1 + gap.min())
        letters, upper, marks = char_counts(text).tolist()
        shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if upper > 2 else 0
        hits, starts, _ = (table[:, :3] > 0).sum(axis=0).tolist()
        weight, start_weight, insults, seconds, odd, stretched = table.sum(axis=0).tolist()
        out[:] = [
            math.log1p(n), math.log1p(hits), hits / n, weight / math.sqrt(n), math.log1p(starts), starts / n, start_weight / math.sqrt(n),
            math.log1p(insults), insults / n, seconds / n, math.log1p(near), nearness, upper / (letters or 1), shouted / n,
            marks / len(text), text.count("!") / len(text), odd / n, stretched / n, math.log1p(len({words[i] for i in at.tolist()})),
        ]
        return out


def lexicon_weights(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of keys held by at least ``LEAST_ROWS`` toxic rows, where they are clearly likelier there. counts: (key, toxic, clean)."""
    found = {}
    for key, a, b in counts:
        if a < LEAST_ROWS:
            continue
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds >= ODDS and odds / error >= DEVIATIONS:
            found[key] = odds
    return found


class Trees:
    """Boosted trees of one depth over histograms of feature bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.start = math.log(share / (1 - share))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._leaf(tree, binned)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """(feature, bin, value) by node of a full tree; feature -1 sends all left."""
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
        node = np.zeros(len(g), dtype=int)
        for k in range(size):
            own = np.nonzero(node == k)[0]
            total_g, total_h = g[own].sum(), h[own].sum()
            value[k] = RATE * total_g / (total_h + 1.0)
            if k >= size // 2 or len(own) < 2 * LEAST_LEAF:
                node[own] = np.minimum(2 * k + 1, size - 1) if k < size // 2 else k
                if k < size // 2:
                    feature[k] = -1
                continue
            best = (1e-6, -1, 0)
            for f in range(binned.shape[1]):
                b = binned[own, f]
                bins = len(self.edges[f]) + 1
                if bins < 2:
                    continue
                cg, ch, cn = (np.cumsum(np.bincount(b, weights=w, minlength=bins))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                gain = cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - total_g**2 / (total_h + 1.0)
                gain[(cn < LEAST_LEAF) | (len(own) - cn < LEAST_LEAF)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
            feature[k], cut[k] = best[1], best[2]
            right = binned[own, best[1]] > best[2] if best[1] >= 0 else np.zeros(len(own), dtype=bool)
            node[own] = 2 * k + 1 + right
        return feature, cut, value

    def _leaf(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), dtype=int)
        rows = np.arange(len(binned))
        for _ in range(DEPTH):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (binned[rows, f] > cut[node]))
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.start + sum((self._leaf(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising function of ``x``."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
            pools[-1][3] = last
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in ((p[0] + 0.1) / (p[1] + 0.2 if p[1] > 5 else p[1] + 1.0),) * 2])
    return xs, np.maximum.accumulate(np.clip(ys, 0.0, 1.0))


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.stack([self.lexicon.features(t) for t in texts]) if texts else np.empty((0, len(NAMES)))
        margin = self.trees.margin(x)
        # a small part of the trees' own probability keeps order inside flat pieces
        return 0.98 * np.interp(margin, *self.knots) + 0.02 / (1 + np.exp(-margin))


def _half(ids) -> np.ndarray:
    """Which half of the sample a row is in."""
    return np.array([(i * 0x9E3779B97F4A7C15 % 2**64) >> 63 for i in ids], dtype=int)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    rows = labels.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("toxic")).limit(sample).collect()
    known: dict[int, int] = {}
    for r in rows:
        known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
    share = sum(known.values()) / len(known) if known else 0.0
    if share in (0.0, 1.0):
        return Model(Lexicon({}), None, None, share)
    halves = _half(list(known)).tolist()
    told = F.broadcast(spark.createDataFrame([(d, t, h) for (d, t), h in zip(known.items(), halves, strict=True)], "doc_id long, toxic int, half int"))  # at most ``sample`` rows
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(told, "doc_id").select("doc_id", "toxic", "half", "text")

    def count():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts: dict[str, list[int]] = {}
            for toxic, half, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                for key in {k for w in set(tokens(text or "")) for k in keys_of(w)}:
                    counts.setdefault(key, [0, 0, 0, 0])[2 * half + toxic] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][j] for k in keys], pa.int64()) for j in range(4))], ["key", "c0", "t0", "c1", "t1"])

        return step

    counted = map_arrow(labelled, count, "key string, c0 long, t0 long, c1 long, t1 long", text=3).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    tox, cln = sum(known.values()), len(known) - sum(known.values())
    # a key that passes as a whole or in a half has that many rows there; there are at most as many keys as the sample's toxic rows hold
    apart = lambda t, c, n, m: (t >= LEAST_ROWS) & ((t + 0.5) / (n + 1) >= math.exp(ODDS) * (c + 0.5) / (m + 1) * 0.999)
    sizes = np.zeros((2, 2))
    for t, h in zip(known.values(), halves, strict=True):
        sizes[h, t] += 1
    parts = [(F.col("t0"), F.col("c0"), sizes[0]), (F.col("t1"), F.col("c1"), sizes[1]), (F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), (cln, tox))]
    passes = [apart(t, c, float(n[1]), float(n[0])) for t, c, n in parts]
    counts = counted.filter(passes[0] | passes[1] | passes[2]).collect()
    other = [lexicon_weights([(r["key"], r[f"t{1 - h}"], r[f"c{1 - h}"]) for r in counts], int(sizes[1 - h, 1]), int(sizes[1 - h, 0])) for h in (0, 1)]
    whole = lexicon_weights([(r["key"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in counts], tox, cln)

    def measure():
        by_half = [Lexicon(w) for w in other]

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            values = [by_half[h].features(t).tolist() for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

        return step

    table = sorted(map(tuple, map_arrow(labelled, measure, "doc_id long, toxic int, x array<double>", text=3).collect()))
    if not table:
        return Model(Lexicon({}), None, None, share)
    x, y = np.array([r[2] for r in table]), np.array([r[1] for r in table], dtype=float)
    if y.min() == y.max():
        return Model(Lexicon({}), None, None, float(y.mean()))
    fold = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):
        if y[fold != k].min() < y[fold != k].max() and (fold == k).any():
            margin[fold == k] = Trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(Lexicon(whole), Trees(x, y), isotonic(margin, y), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            s = np.clip(model.score(batch.column(1).to_pylist()), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, score double, predicted int", text=1)
