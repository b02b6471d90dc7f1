"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of two lexicons (a short built-in one and one learned from the labelled rows: words and
word beginnings that mark the label), how near their hits stand to second-person words, shares of capitals, punctuation,
digits and symbols inside words (obfuscation), hits once disguised letters are restored, repetition, and length. No label,
language, source or id is an input of a score.

Fitting takes a bounded sample of labelled rows (``MAX_ROWS`` by hash of the id). Their whole texts stay with the executors,
which count the words and compute the features; the driver gets only those. Lexicon, trees and calibration curve together
are a few hundred kB and travel to the executors in the task closure.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, texts, written

#: The bound on labelled rows used for fitting.
MAX_ROWS = 6_000
THRESHOLD = 0.7
BASE = frozenset("idiot idiots stupid moron moronic dumb scum trash garbage loser losers pathetic worthless disgusting clown fool ugly hate jerk".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer ihr ihre usted ustedes tus tuyo su sus vosotros".split())
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?=[\w@$!*]*[^\W\d_])(?=[\w@$!*]*[\d@$!*])[\w@$!*]{3,}")
PLAIN = str.maketrans("0134578@$!*", "oieastbasi ")
SPACED = re.compile(r"\b(?:\w[ .\-_*]){3,}\w\b")
NAMES = ["base_density", "learned_density", "learned_weight", "learned_hits", "base_hits", "weight_max", "weight_mean", "distinct_hits", "second_density", "second_near", "capital_share", "shouted_share", "punct_share", "exclaim_share", "digit_share", "symbol_share", "disguised_share", "disguised_hits", "spaced_hits", "repeat_share", "type_ratio", "log_words", "mean_word"]
STEM = (5, 6, 7)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def marks(text: str) -> set[str]:
    """The distinct words of a text and their beginnings, these marked by a trailing *."""
    seen = set(words_of(text))
    ws = list(seen)
    for k in STEM:
        seen |= {w[:k] + "*" for w in ws if len(w) > k}
    return seen


def presence(rows: DataFrame, at: dict[int, tuple[int, int]], folds: int, least: int) -> dict[str, np.ndarray]:
    """In how many of the rows (_id, _t) of each label and fold a word or word beginning occurs; ``at`` has label and fold of an id.

    Only those in at least ``least`` rows of label 1 are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("_id").to_pylist(), b.column("_t").to_pylist(), strict=True):
                if ws := list(marks(t)):
                    y, k = at[i]
                    yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([y * folds + k] * len(ws), pa.int32())], ["w", "c"])

    cells = [F.count(F.when(F.col("c") == c, 1)) for c in range(2 * folds)]
    found = rows.select("_id", "_t").mapInArrow(run, "w string, c int").groupBy("w").agg(F.array(*cells).alias("n"), F.count(F.when(F.col("c") >= folds, 1)).alias("ones"))
    return {r.w: np.array(r.n, "i8").reshape(2, folds) for r in found.where(F.col("ones") >= least).select("w", "n").collect()}


def feature_rows(rows: DataFrame, at: dict[int, tuple[int, int]], lexicons: list[dict[str, float]]) -> dict[int, list[float]]:
    """The features of the rows (_id, _t) by id, each with the lexicon of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexed = [Lexed(x, 60_000) for x in lexicons]
        for b in batches:
            x = [features(t, lexed[at[i][1]]) for i, t in zip(b.column("_id").to_pylist(), b.column("_t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(x, pa.list_(pa.float64()))], ["_id", "x"])

    return {r["_id"]: r.x for r in rows.select("_id", "_t").mapInArrow(run, "_id long, x array<double>").collect()}


def learn_lexicon(kept: dict[str, np.ndarray], size: np.ndarray, without: int | None = None, least: int = 4, most: int = 3000) -> dict[str, float]:
    """Weights (smoothed log odds of presence) of the words and word beginnings most tied to label 1, leaving out a fold."""
    use = [k for k in range(size.shape[1]) if k != without]
    n0, n1 = size[:, use].sum(axis=1).tolist()
    scored = []
    for w, c in kept.items():
        b, a = c[:, use].sum(axis=1).tolist()
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        if a >= least and odds > 1.2 and odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 2.5:
            scored.append((odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), w, odds))
    return {w: o for _, w, o in sorted(scored, reverse=True)[:most]}


class Lexed:
    """What a white-space token adds to the sums behind the features, remembered for the tokens seen last."""

    WIDTH = 12  # words, hits, weight, base, second, shouted, disguised, restored, letters, one character, largest weight, marked

    def __init__(self, lexicon: dict[str, float], limit: int = 250_000) -> None:
        self.lexicon, self.limit = lexicon, limit
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.WIDTH), "f4")

    def weight(self, w: str) -> float:
        get, k = self.lexicon.get, len(w)
        return max(get(w, 0.0), *(get(w[:s] + "*", 0.0) for s in STEM if k > s)) if k > STEM[0] else get(w, 0.0)

    def rows(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        at = list(map(known.get, tokens))
        if None in at:
            new = [t for t, i in zip(tokens, at, strict=True) if i is None]
            if len(known) + len(new) > self.limit:
                known.clear()
                new = tokens
            while len(known) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(known) : len(known) + len(new)] = [self.parse(t) for t in new]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            at = list(map(known.__getitem__, tokens))
        return self.table[at]

    def parse(self, token: str) -> tuple:
        core = token.strip(EDGES)
        if core.isalpha():
            w = core.lower()
            x, k = self.lexicon.get(w, 0.0), len(w)
            for s in STEM:
                if k > s and (y := self.lexicon.get(w[:s] + "*", 0.0)) > x:
                    x = y
            base = w in BASE
            return 1, x > 0, x, base, w in SECOND, k > 2 and core.isupper(), 0, 0, k, len(token) == 1, x, base or x > 0
        ws = WORD.findall(token.lower())
        weights = [self.weight(w) for w in ws]
        base, second = sum(w in BASE for w in ws), sum(w in SECOND for w in ws)
        odd = restored = 0
        if len(token) > 2 and not token.isalpha():
            for w in DISGUISED.findall(token):
                odd += 1
                p = w.lower().translate(PLAIN).strip()
                restored += p in BASE or p in self.lexicon
        hits = sum(x > 0 for x in weights)
        return len(ws), hits, sum(weights), base, second, len(token) > 2 and token.isupper(), odd, restored, sum(map(len, ws)), len(token) == 1, max(weights, default=0.0), base + hits > 0


def features(text: str, lexed: Lexed) -> list[float]:
    """The dense features of one text; all zero for the empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    tokens = text.split()
    tally = Counter(tokens)
    keys = list(tally)
    count = np.fromiter(tally.values(), "f8", len(keys))
    rows = lexed.rows(keys)
    words, hits, total, base, second, shouted, odd, restored, letters, single = (count @ rows[:, :10]).tolist() if keys else [0.0] * 10
    m = words or 1
    near = 0
    if second and (hits or base):
        ws = words_of(text)
        at = np.array([i for i, w in enumerate(ws) if w in SECOND])
        for i in (i for i, w in enumerate(ws) if w in BASE or lexed.weight(w)):
            j = int(np.searchsorted(at, i))
            near += (j < len(at) and at[j] - i <= 5) or (j > 0 and i - at[j - 1] <= 5)
    spaced = 0
    if single >= 4 or odd:
        spaced = sum(1 for w in SPACED.findall(text) if (p := re.sub(r"[^\w]|_", "", w).lower()) in BASE or p in lexed.lexicon)
    raw = text.encode()
    upper, digits, symbols, punct = (len(raw) - len(raw.translate(None, x)) for x in (UPPER, DIGITS, SYMBOLS, PUNCT))
    return [
        base / m, hits / m, total / m, min(hits, 100), min(base, 100), float(rows[:, 10].max()) if keys else 0.0, total / hits if hits else 0.0, min(float(rows[:, 11].sum()), 50) if keys else 0.0,
        second / m, near / m, upper / n, shouted / m, punct / n, raw.count(b"!") / n, digits / n, symbols / n, odd / m, min(restored, 50), min(spaced, 50),
        float(count.max()) / m if keys else 0.0, len(keys) / m, math.log1p(words), letters / m,
    ]


EDGES = ".,;:!?()\"'"
UPPER, DIGITS, SYMBOLS, PUNCT = bytes(range(65, 91)), b"0123456789", b"@#$%^&*_~|<>\\", b".,;:!?'\"()-"


class Boosted:
    """Boosted regression trees on binned features, logistic loss, fitted with numpy."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: float = 12.0, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(x) else [np.array([]) for _ in range(x.shape[1])]
        b = self.binned(x)
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds if len(set(y.tolist())) > 1 else 0):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - q, q * (1 - q))
            self.trees.append(tree)
            f += self._leaf(tree, b)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, "i8")

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, "i8"), np.zeros(size)
        at = {0: np.arange(len(g))}
        k = self.bins + 1
        for node in range(size):
            rows = at.pop(node, None)
            if rows is None:
                continue
            G, H = g[rows].sum(), h[rows].sum()
            value[node] = self.rate * G / (H + self.ridge)
            if node >= size // 2 or len(rows) < 2 * self.least:
                continue
            best = (1e-3, -1, 0)
            wide = b.shape[1]
            c = (b[rows] + np.arange(wide) * k).ravel()
            gl, hl, nl = (np.cumsum(np.bincount(c, weights=w, minlength=k * wide).reshape(wide, k), axis=1)[:, :-1] for w in (np.repeat(g[rows], wide), np.repeat(h[rows], wide), None))
            gain = gl**2 / (hl + self.ridge) + (G - gl) ** 2 / (H - hl + self.ridge) - G**2 / (H + self.ridge)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
            j, i = divmod(int(gain.argmax()), k - 1)
            if gain[j, i] > best[0]:
                best = (float(gain[j, i]), j, i)
            if best[1] >= 0:
                feature[node], cut[node] = best[1:]
                left = b[rows, best[1]] <= best[2]
                at[2 * node + 1], at[2 * node + 2] = rows[left], rows[~left]
        return feature, cut, value

    def _leaf(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), "i8"), np.arange(len(b))
        for _ in range(self.depth):
            j = feature[at]
            go = j >= 0
            at = np.where(go, 2 * at + 1 + (b[rows, np.maximum(j, 0)] > cut[at]), at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += self._leaf(t, b)
        return out


class Isotonic:
    """Pool-adjacent-violators fit, linear between the pooled points."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []
        for a, t in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([t, 1.0, a, a])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                t2, w2, _, hi = pools.pop()
                t1, w1, lo, _ = pools[-1]
                pools[-1] = [(t1 * w1 + t2 * w2) / (w1 + w2), w1 + w2, lo, hi]
        # one pseudo row at the mean keeps pools of one row off 0 and 1
        mean = float(y.mean()) if len(y) else 0.5
        self.x = np.array([v for p in pools for v in (p[2], p[3])] or [0.0])
        self.y = np.maximum.accumulate(np.array([v for p in pools for v in [(p[0] * p[1] + mean) / (p[1] + 1)] * 2] or [mean]))
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0.0, 1.0)


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` takes texts."""

    def fit(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, **options) -> ToxicityModel:
        """Features ``x`` are out of fold, and so are the scores here: lexicon weights and calibration score of a row never come from its own label."""
        self.lexicon = lexicon
        self.trees = Boosted(**options).fit(x, y)
        out = np.zeros(len(y))
        for k in range(2):
            half = np.arange(len(y)) % 2 == k
            if len(y) >= 20:
                out[half] = Boosted(**options).fit(x[~half], y[~half]).raw(x[half])
        self.curve = Isotonic().fit(out, y)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lexed"}

    def score(self, items: list[str]) -> np.ndarray:
        if not items:
            return np.zeros(0)
        if getattr(self, "lexed", None) is None:
            self.lexed = Lexed(self.lexicon)
        raw = self.trees.raw(np.array([features(t, self.lexed) for t in items]))
        # the raw order breaks ties inside a calibrated step
        return np.clip(self.curve.apply(raw) * 0.998 + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 4) -> ToxicityModel:
    """Fits on the whole texts of labelled rows outside the held-out third, at most ``max_rows`` (by hash of doc_id).

    Rows with a null id, label or text are left out; a doc_id labelled twice counts with its largest label. Without any
    labelled row every score is 0.5 or so.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_y"))
    own = own.where("crc32(cast(_id as string)) % 3 != 1").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(own.withColumn("_id", F.col("_id").cast("long"))), "_id")  # the limit bounds it
    rows = written(rows.groupBy("_id", "_y").agg(F.min("_t").alias("_t")), "fit")
    labelled = sorted((r["_id"], int(r["_y"] > 0)) for r in rows.select("_id", "_y").collect())
    at = {i: (y, k % folds) for k, (i, y) in enumerate(labelled)}
    size = np.zeros((2, folds), "i8")
    for y, k in at.values():
        size[y, k] += 1
    kept = presence(rows, at, folds, 4)
    x = feature_rows(rows, at, [learn_lexicon(kept, size, k) for k in range(folds)])
    return ToxicityModel().fit(learn_lexicon(kept, size), np.array([x[i] for i, _ in labelled]).reshape(len(labelled), len(NAMES)), np.array([y for _, y in labelled], "f8"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted, from each whole text; null text counts as empty.

    Columns of those names in ``docs`` are replaced. A null doc_id is not held out. One narrow pass, no shuffle.
    """
    base = docs.drop("held_out", "score", "predicted")

    @F.pandas_udf("double")
    def scored(items):
        import pandas as pd

        forget()
        return pd.Series(model.score([t or "" for t in items]), dtype="float64")

    scored = scored.asNondeterministic()  # else a filter on the score would run it again beside the projection
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    out = base.select("*", held.alias("held_out"), scored(F.coalesce("text", F.lit(""))).alias("score"))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (false for a null id), score, predicted only: the texts don't come back from Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts in texts(batches, "doc_id", "text"):
            s = model.score(ts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(d) for d in ids], pa.bool_()), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype("i4"), pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
