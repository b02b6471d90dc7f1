"""Soft-membership mixing of documents to target domain weights.

A multinomial logistic classifier, fitted on a bounded sample of the labelled table, gives every document a posterior over
domains. Its features are counts and the hits of two lexicons learned from the same rows (words tied to each label). Rates are then
fitted so that the expected tokens of each domain, sum of rate x tokens x posterior, meet the targets: nonnegative least squares by
accelerated projected gradients.

The objective is half the sum over domains of the squared miss over the domain's tokens at rate 1. In the metric that weighs a
document's rate by its tokens, the gradient of a rate is the posterior's mean of the domains' misses, and projection on rates of
at least ``floor`` is a plain maximum, so a step of one over the largest eigenvalue of the domains' scaled Gram matrix descends.
A step that raises the objective is taken back and the momentum dropped. A rate depends on its posterior only and is recomputed from the gradients so
far (a few numbers an iteration) instead of being stored: an iteration is one narrow aggregate, the driver holds one number a
domain, and a lost executor costs nothing but its tasks. Targets that no rates can meet are reported, not hidden.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity
from .common import texts, written

DOMAINS = ("clean", "low", "toxic")
#: Labelled rows used for fitting, by hash of the id.
MAX_ROWS = 6_000
COUNTED = (b".", b",", b"!", b"|", b"#$%&*@", b"0123456789", bytes(range(65, 91)), b"\n")


STRIP = b".,;:!?()\"'"
#: Folds of the labelled rows: a row's lexicon features come from the other folds' labels.
FOLDS = 4


def counts(text: str, lexicons: list[dict[bytes, float]]) -> list[float]:
    """Rates of punctuation kinds, digits, capitals and lines, repetition, word length, text length; hits and weights in each lexicon."""
    raw = text.encode()
    n = len(raw) or 1
    ws = raw.split()
    m = len(ws) or 1
    distinct = set(ws)
    same = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    out = [*((len(raw) - len(raw.translate(None, c))) / n for c in COUNTED), len(distinct) / m, same / m, sum(map(len, ws)) / m / 10, np.log1p(len(ws)) / 10, float(not ws)]
    seen = set(raw.lower().translate(None, STRIP).split())
    for lexicon in lexicons:
        hits = seen & lexicon.keys()
        weights = [lexicon[w] for w in hits]
        out += [len(hits) / (len(seen) or 1), np.log1p(len(hits)), max(weights, default=0.0), float(len(hits) > 0)]
    return out


WIDTH = len(counts("", [{}, {}]))


class Posterior:
    """Softmax regression on standardised features, full-batch gradient steps with momentum."""

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, lexicons: list[dict[bytes, float]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Posterior:
        self.lexicons = lexicons
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._design(x)
        w = np.zeros((z.shape[1], classes))
        v = np.zeros_like(w)
        want = np.eye(classes)[y] if len(y) else np.zeros((0, classes))
        for _ in range(steps if len(y) else 0):
            v = 0.9 * v - rate / 4 * (z.T @ (self._soft(z @ w) - want) / len(y) + ridge * w)
            w += v
        self.w = w
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], axis=1)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, items: list[str]) -> np.ndarray:
        x = np.array([counts(t, self.lexicons) for t in items]).reshape(len(items), -1)
        return self._soft(self._design(x) @ self.w) if len(items) else np.zeros((0, self.w.shape[1]))


def domain_label(quality: int | None, toxic: int | None) -> int:
    return 2 if toxic else 1 if quality == 0 else 0


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Posterior:
    """Fits on at most ``max_rows`` labelled documents (by hash of doc_id), from their whole texts.

    Null ids, texts or labels are left out; an id labelled twice counts with its worse labels, an id of several texts with the
    smallest text. Executors count words and compute features; the driver gets those, one row a labelled id.
    """
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("_q"), F.max("toxic").cast("int").alias("_t"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_t0")).join(F.broadcast(own), "_id")  # the limit bounds it
    rows = written(rows.groupBy("_id", "_q", "_t").agg(F.min("_t0").alias("_t0")), "fit").select("_id", F.col("_t0").alias("_t"), "_q", F.col("_t").alias("_y"))
    labelled = sorted((r["_id"], domain_label(r["_q"], r["_y"])) for r in rows.select("_id", "_q", "_y").collect())
    fold = {i: k % FOLDS for k, (i, _) in enumerate(labelled)}
    lexicons: list[list[dict[bytes, float]]] = [[] for _ in range(FOLDS + 1)]
    for kind in (1, 2):  # low, toxic: each against all others
        at = {i: (int(y == kind), fold[i]) for i, y in labelled}
        size = np.zeros((2, FOLDS), "i8")
        for y, k in at.values():
            size[y, k] += 1
        kept = {w: n for w, n in toxicity.presence(rows, at, FOLDS, 4).items() if not w.endswith("*")}
        for k in range(FOLDS + 1):
            found = toxicity.learn_lexicon(kept, size, k if k < FOLDS else None)
            lexicons[k].append({w.encode(): x for w, x in found.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [counts(t, lexicons[fold[i]]) for i, t in zip(b.column("_id").to_pylist(), b.column("_t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(x, pa.list_(pa.float64()))], ["_id", "x"])

    got = {r["_id"]: r.x for r in rows.select("_id", "_t").mapInArrow(run, "_id long, x array<double>").collect()}
    x = np.array([got[i] for i, _ in labelled]).reshape(len(labelled), WIDTH)
    return Posterior().fit(x, np.array([y for _, y in labelled], "i8"), len(DOMAINS), lexicons[FOLDS])


def posteriors(docs: DataFrame, model: Posterior) -> DataFrame:
    """doc_id, version (hash of the text), tokens (white-space words) and p (array, one a domain) of every row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts in texts(batches, "doc_id", "text"):
            p = model.predict(ts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in ts], pa.int64()), pa.array([len(t.split()) for t in ts], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "version", "tokens", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, version long, tokens long, p array<double>")


class Rates:
    """The projected steps so far; ``of`` replays them on posteriors.

    A step is (gradient by domain, momentum): the rates move on by momentum times their last change, down the gradient found
    there, and are projected.
    """

    def __init__(self, floor: float) -> None:
        self.floor, self.steps, self.ahead = floor, [], None

    def of(self, p: np.ndarray, ahead: float | None = None) -> np.ndarray:
        """Rates of posteriors; with ``ahead`` the point that much further on the last change, where the next gradient is taken."""
        r = last = np.full(len(p), max(1.0, self.floor))  # the start
        for g, momentum in self.steps:
            r, last = np.maximum(self.floor, r + momentum * (r - last) - p @ g), r
        return r if ahead is None else r + ahead * (r - last)


def fit_rates(rows: DataFrame, targets: np.ndarray, budget: float | None = None, floor: float = 0.0, rounds: int = 80, tolerance: float = 2e-3) -> tuple[Rates, dict]:
    """Rates whose expected domain token totals are ``targets`` (weights, scaled to sum 1) times the budget, and a report.

    ``budget``: tokens in all. None: as many as there are, or with a floor above 0 a tenth more than the targets need
    with no rate below it. A domain without any tokens is left out of the targets, one without a target goes free. Ends at a
    largest relative miss of ``tolerance``, or where the objective no longer falls: the report has the miss, expected and wanted
    tokens, rounds and whether the targets are met.
    """
    k = len(targets)

    def totals(rates: Rates, ahead: float | None = None, gram: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain, and the Gram matrix: the sum of tokens x posterior x posterior."""
        width = k + k * k * gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for b in batches:
                if b.num_rows:
                    p = b.column("p").flatten().to_numpy().reshape(-1, k)
                    t = b.column("tokens").to_numpy().astype("f8")
                    out[:k] += (rates.of(p, ahead) * t) @ p
                    if gram:
                        out[k:] += ((t[:, None] * p).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        part = rows.select("p", "tokens").mapInArrow(run, "s array<double>")
        row = part.agg(*(F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(width))).first()
        s = np.array(list(row))
        return s[:k], s[k:].reshape(k, k) if gram else np.zeros((k, k))

    rates = Rates(floor)
    have, gram = totals(Rates(0.0), gram=True)  # rate 1
    weight = np.where(have > 0, targets, 0.0)
    report = {"tokens": have.tolist(), "rounds": 0, "miss": 0.0, "met": True, "expected": have.tolist(), "wanted": have.tolist()}
    if weight.sum() <= 0:
        return rates, report
    weight = weight / weight.sum()
    if budget is None:
        budget = have.sum() if floor <= 0 else 1.1 * floor * float(np.max(have[weight > 0] / weight[weight > 0]))
    want = weight * budget
    aimed = want > 0
    scale = np.where(aimed, 1 / np.sqrt(np.maximum(have, 1e-300)), 0.0)
    step = 1 / max(float(np.linalg.eigvalsh(scale[:, None] * gram * scale)[-1]), 1e-300)
    got, _ = totals(rates)

    def worth() -> float:
        return 0.5 * float((((got - want) * scale) ** 2).sum())

    def largest() -> float:
        return float((np.abs(got - want) / np.where(aimed, want, 1.0) * aimed).max())

    best, kept, pace = worth(), (0, got), 1.0
    for _ in range(rounds):
        if largest() <= tolerance:
            break
        nxt = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / nxt
        at = got if momentum == 0 else totals(rates, momentum)[0]
        rates.steps.append((step * (at - want) * scale**2, momentum))
        got, pace = totals(rates)[0], nxt
        if worth() < best * (1 - 1e-9):
            best, kept = worth(), (len(rates.steps), got)
            continue
        del rates.steps[kept[0] :]  # back to the best point
        if momentum == 0:  # a plain step must descend, so this is the least value
            break
        got, pace = kept[1], 1.0
    del rates.steps[kept[0] :]
    got, miss = kept[1], float((np.abs(kept[1] - want) / np.where(aimed, want, 1.0) * aimed).max())
    return rates, report | {"rounds": len(rates.steps), "miss": miss, "met": miss <= tolerance, "expected": got.tolist(), "wanted": want.tolist()}


def with_rates(rows: DataFrame, rates: Rates) -> DataFrame:
    """Adds ``rate`` and ``copies``: its whole part, and one more with the probability of the rest, by hash of id and text."""

    @F.pandas_udf("double")
    def rate(p):
        return pd.Series(rates.of(np.array(p.tolist()).reshape(len(p), -1)) if len(p) else [], dtype="float64")

    rate = rate.asNondeterministic()
    return rows.withColumn("rate", rate("p")).withColumn("copies", copies())


def copies():
    """The rate's whole part, and one more with the probability of the rest."""
    chance = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "version", F.lit(20)), F.lit(1 << 40)) / float(1 << 40)).cast("double")
    return F.floor(F.col("rate") + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], floor: float = 0.0, model: Posterior | None = None, strict: bool = False, **options) -> DataFrame:
    """doc_id, version, tokens, one posterior a domain, rate, copies and target_miss (the largest relative miss, alike in all rows) of every row.

    Null texts are empty: no tokens, their rate follows from the posterior of the empty text. Repeated rows are equal rows. Other
    columns are ignored. ``strict`` raises if the targets can't be met.
    """
    model = model or fit_domains(docs, labels)
    rows = written(posteriors(docs, model), "posteriors")
    rates, report = fitted(rows, targets, floor, strict, options)
    return with_rates(rows, rates).select("doc_id", "version", "tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies", F.lit(report["miss"]).alias("target_miss"))


def fitted(rows: DataFrame, targets: dict[str, float], floor: float, strict: bool, options: dict) -> tuple[Rates, dict]:
    rates, report = fit_rates(rows, np.array([targets.get(d, 0.0) for d in DOMAINS], "f8"), floor=floor, **options)
    if not report["met"]:
        said = f"targets missed by up to {report['miss']:.1%}: expected {report['expected']}, wanted {report['wanted']}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)
    return rates, report


def repeat_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float], floor: float = 1.0, strict: bool = False, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the fitted rates say; floor 1 keeps every row at least once.

    Posteriors are computed again beside the text instead of being joined to it, so the text isn't shuffled. Columns keep their
    names, whatever they are. Targets that can't be met are warned of, or raised with ``strict``.
    """
    model = fit_domains(docs, labels)
    rows = written(posteriors(docs, model), "posteriors")
    rates, _ = fitted(rows, targets, floor, strict, options)

    @F.pandas_udf("rate double, version long")
    def again(t):
        import xxhash

        items = [x or "" for x in t]
        return pd.DataFrame({"rate": rates.of(model.predict(items)), "version": [xxhash.xxh3_64_intdigest(x) >> 1 for x in items]})

    again = again.asNondeterministic()  # computed once, not once a use
    names = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id"), again("text").alias("again"))
    counted = own.select("row", "doc_id", "again.rate", "again.version").withColumn("copies", copies()).where("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in names))
