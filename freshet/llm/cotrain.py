"""Quality by co-training: a content and a metadata classifier teach each other.

The content view sees the text alone (shares of character classes, repetition,
word shapes, hashed word endings); the metadata view sees lang, source and
length alone. Both start from labelled rows; in each round every view labels the
unlabelled rows that it is surest of, and the other view learns from them too.
Each view is then calibrated on labelled rows held back from training, and one
calibrated combination scores every document.

Labels are a bounded sample, ``max_labelled`` ids with the smallest seeded
hashes. Every other step covers every row and every whole text: all rows without
a label are scored in each round, a share of them is exchanged, and the content
view is fitted by Newton steps whose gradients and Hessians tasks sum up, of
labelled rows too. The metadata view has few distinct rows; their counts are its
data. The driver holds weights and such sums, and three numbers for each labelled
row that calibrates; neither texts nor features reach it.

Defined results: a null or empty text has zero features and is scored like any
other, a very long one by its whole text; null lang or source is a value of its
own; documents that repeat an id are each scored, and train as one of them;
labels that repeat an id count by their mean, null labels not at all; ties of the
score fall the same way. Without labels of both classes the score is 1 and every row is accepted;
where too few labels leave one class to training or to calibration, all serve both.
An empty table gives an empty result. Extra columns are passed on by
``with_quality``, but for those of the four names it adds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scratch import Scratch

SHAPES, ENDINGS = 18, 128
LENGTHS, LANGS, SOURCES = 24, 16, 128
#: Rows are ranked by places: steps of a logit, each split by a hash so that equal rows can be told apart.
_STEPS, _SPREAD = 16, 64


def content_features(text: str | None) -> np.ndarray:
    """The content view of a whole text: bounded numbers only."""
    out = np.zeros(SHAPES + ENDINGS, np.float32)
    if not text:
        return out
    data = text.encode()
    words = data.split()
    n, m = len(data), max(1, len(words))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = data.split(b"\n")
    lower, upper, digit = c[97:123].sum(), c[65:91].sum(), c[48:58].sum()
    symbol = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    comma = c[ord(",")] + c[ord(".")]
    shape = [
        1.0, lower, upper, digit, c[128:].sum(), c[32], c[10], comma, symbol - comma, c[ord("|")],
        len(distinct) / m, max(distinct.values(), default=0) / m, min(n / m, 40) / 10,
        len(set(lines)) / len(lines), min(m / len(lines), 200) / 50, math.log1p(m) / 10,
        sum(v for w, v in distinct.items() if not w[-1:].isalnum() and w[-1] < 128) / m,
        sum(v for w, v in distinct.items() if len(w) == 1) / m,
    ]
    out[:SHAPES] = shape
    for w, v in distinct.items():
        out[SHAPES + xxhash.xxh32_intdigest(w[-3:]) % ENDINGS] += v
    out[SHAPES:] /= m
    return out


def metadata_indices(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """The metadata view as the places of its ones."""
    length = LENGTHS - 1 if n_chars is None else min(int(math.log2(max(n_chars, 0) + 1) * 1.3), LENGTHS - 2)
    spot = lambda s, n: 0 if s is None else 1 + xxhash.xxh32_intdigest(s.encode()) % (n - 1)
    return [0, 1 + length, 1 + LENGTHS + spot(lang, LANGS), 1 + LENGTHS + LANGS + spot(source, SOURCES)]


def dense_metadata(indices: np.ndarray) -> np.ndarray:
    out = np.zeros((len(indices), 1 + LENGTHS + LANGS + SOURCES), np.float32)
    out[np.arange(len(indices))[:, None], indices] = 1
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, content array<float>, metadata array<int>."""
    import pyarrow as pa

    def make(batches):
        for b in batches:
            ids, texts, langs, sources, sizes = b.columns
            x = [content_features(t.as_py()) for t in texts]
            flat = pa.array(np.concatenate(x) if x else np.empty(0, np.float32), pa.float32())
            content = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (SHAPES + ENDINGS)), flat)
            meta = [metadata_indices(*v) for v in zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist(), strict=True)]
            cols = [ids, content, pa.array(meta, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "content", "metadata"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(make, "doc_id long, content array<float>, metadata array<int>")


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, n=1.0) -> np.ndarray:
    """Rows: the gradient, and the Hessian, of the log loss at ``w``; the loss itself is the last item of one more row."""
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    out = np.zeros((len(w) + 2, len(w)))
    out[0] = x.T @ ((p - y) * n)
    out[1:-1] = (x * ((p * (1 - p) + 1e-6) * n)[:, None]).T @ x
    out[-1, -1] = np.sum((np.logaddexp(0, z) - y * z) * n)
    return out


@dataclass
class Logistic:
    """Logistic regression with an L2 penalty, fitted by Newton steps."""

    w: np.ndarray

    @classmethod
    def newton(cls, size: int, sums, penalty: float = 1.0, steps: int = 25, start=None, close: float = 1e-6) -> Logistic:
        """``sums`` of weights: what ``newton_sums`` gives over the rows. A step that raises the loss is halved."""
        w = np.zeros(size) if start is None else start.copy()
        step, best, scale = np.zeros(size), np.inf, 1.0
        for _ in range(steps):
            total = sums(w)
            loss = total[-1, -1] + penalty / 2 * (w @ w)
            if loss > best + 1e-9 * abs(best):
                scale /= 2
                w = w + scale * step  # half way back
            else:
                best, scale = loss, 1.0
                step = np.linalg.solve(total[1:-1] + penalty * np.eye(size), total[0] + penalty * w)
                w = w - step
            if scale * np.abs(step).max() < close:
                break
        return cls(w)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, n=1.0) -> Logistic:
        """Rows in memory; ``n``: how often each counts."""
        x = np.asarray(x, np.float64)
        return cls.newton(x.shape[1], lambda w: newton_sums(x, y, w, n), penalty)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.asarray(x, np.float64) @ self.w, -30, 30)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


@dataclass
class CoTrained:
    """Both views, their calibrations (scale, offset) and the combination of calibrated logits."""

    content: Logistic
    metadata: Logistic
    calibrations: list[Logistic]
    combination: Logistic

    def scores(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: calibrated content, calibrated metadata, combined."""
        raw = [self.content.logit(c), self.metadata.logit(m)]
        both = [k.logit(np.stack([np.ones(len(z)), z], 1)) for k, z in zip(self.calibrations, raw, strict=True)]
        last = self.combination.logit(np.stack([np.ones(len(c)), *both], 1))
        return sigmoid(np.stack([*both, last], 1))


def _views(batch) -> list[np.ndarray]:
    """Both views of an Arrow batch of features."""
    content, metadata = (batch.column(c).flatten().to_numpy() for c in ("content", "metadata"))
    return [content.reshape(batch.num_rows, -1), dense_metadata(metadata.reshape(batch.num_rows, -1))]


def _places(z: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return (np.abs(z) * _STEPS).astype(np.int64) * _SPREAD + spread


class Pool:
    """All rows without a label: which of them the views label, and sums over those."""

    def __init__(self, features: DataFrame, seed: int, sure: float):
        """``features``: doc_id, content, metadata."""
        self.scratch = Scratch(features.sparkSession, "co-training")
        spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_SPREAD))
        self.rows = self.scratch.keep(features.select("content", "metadata", spread.alias("spread")), "pool")
        self.size, self.least = self.rows.count(), math.log(sure / (1 - sure))
        self.taken: list[DataFrame] = []
        self.past: list[tuple] = []

    def clear(self) -> None:
        self.scratch.clear()

    def choose(self, models: list[Logistic], quotas: tuple[float, float]) -> int:
        """Each view takes the rows it is surest of, about ``quotas`` of class 0 and 1; the rows taken."""
        cuts: list[tuple] = []
        for v in (0, 1):
            found = self._hold(models, cuts, v).groupBy("good", "place").agg(F.sum("n").alias("n")).collect()  # places are bounded
            at = []
            for good in (0, 1):
                here = sorted(((r["place"], r["n"]) for r in found if r["good"] == good), reverse=True)
                cut, got = 1 << 40, 0
                for place, n in here:
                    if got >= max(1, int(quotas[good])):
                        break
                    cut, got = place, got + n
                at.append(cut)
            cuts.append(tuple(at))
        now = self.scratch.keep(self._take(models, cuts), f"taken{len(self.past)}")
        self.past.append((models, cuts))
        self.taken.append(now)
        return now.count()

    @staticmethod
    def _apply(batch, past, models, cuts, least):
        """Whether each row is free of earlier rounds, which view takes it (-1: none), and both views' logits."""
        views, spread = _views(batch), batch.column("spread").to_numpy()
        free = np.ones(batch.num_rows, bool)
        for used, ends in [*past, (models, cuts)]:
            z = [m.logit(x) for m, x in zip(used, views, strict=True)]
            by = np.full(batch.num_rows, -1)
            for v, (bad, good) in enumerate(ends):
                by[free & (by < 0) & (np.abs(z[v]) >= least) & (_places(z[v], spread) >= np.where(z[v] >= 0, good, bad))] = v
            if used is not models:
                free &= by < 0
        return free, by, z, spread

    def _hold(self, models, cuts, v) -> DataFrame:
        import pyarrow as pa

        least, apply, past, cuts = self.least, self._apply, list(self.past), list(cuts)

        def count(batches):
            total: dict[tuple, int] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                free, by, z, spread = apply(b, past, models, cuts, least)
                at = free & (by < 0) & (np.abs(z[v]) >= least)
                keys, n = np.unique(_places(z[v], spread)[at] * 2 + (z[v][at] >= 0), return_counts=True)
                for k, m in zip(keys.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + m
            keys = np.fromiter(total.keys(), np.int64, len(total))
            cols = [pa.array(keys % 2), pa.array(keys // 2), pa.array(np.fromiter(total.values(), np.int64, len(total)))]
            yield pa.RecordBatch.from_arrays(cols, names=["good", "place", "n"])

        return self.rows.mapInArrow(count, "good long, place long, n long")

    def _take(self, models, cuts) -> DataFrame:
        """The rows taken now with ``target``, the view that learns from them, and their label."""
        import pyarrow as pa

        least, apply, past = self.least, self._apply, list(self.past)

        def take(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                _, by, z, _ = apply(b, past, models, cuts, least)
                at = np.flatnonzero(by >= 0)
                y = (np.where(by == 1, z[1], z[0]) >= 0).astype(np.int32)
                cols = [b.column(c).take(pa.array(at)) for c in ("content", "metadata")]
                cols += [pa.array((1 - by[at]).astype(np.int32)), pa.array(y[at])]
                yield pa.RecordBatch.from_arrays(cols, names=["content", "metadata", "target", "y"])

        return self.rows.mapInArrow(take, "content array<float>, metadata array<int>, target int, y int")

    def learnt(self, view: int) -> DataFrame | None:
        """The rows that a view (0 content, 1 metadata) learns from so far."""
        if not self.taken:
            return None
        return reduce(DataFrame.unionByName, self.taken).where(F.col("target") == view).select("content", "metadata", "y")


def content_sums(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """``newton_sums`` of the content view over ``rows`` (content, y): summed in tasks, then in a few of them."""
    import pyarrow as pa

    shape = (len(w) + 2, len(w))

    def packed(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def part(batches):
        total = np.zeros(shape)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x, y = (b.column(i).slice(at, 2000) for i in (0, 1))
                total += newton_sums(x.flatten().to_numpy().reshape(len(y), -1).astype(np.float64), y.to_numpy(), w)
        yield packed(total)

    def merge(batches):
        total = np.zeros(shape)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py()).reshape(shape)
        yield packed(total)

    sums = rows.select("content", "y").mapInArrow(part, "sums binary")
    if sums.rdd.getNumPartitions() > 64:
        sums = sums.repartition(16).mapInArrow(merge, "sums binary")
    return sum(np.frombuffer(r["sums"]).reshape(shape) for r in sums.collect())


def fit_views(content: DataFrame, metadata: DataFrame, start: np.ndarray | None = None) -> list[Logistic]:
    """Both views from their rows (content, metadata, y)."""
    first = Logistic.newton(SHAPES + ENDINGS, lambda w: content_sums(content, w), start=start, close=1e-3)
    got = metadata.groupBy("metadata", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("metadata", "y").collect()  # few distinct rows
    m = dense_metadata(np.array([r["metadata"] for r in got], int).reshape(len(got), 4))
    return [first, Logistic.fit(m, np.array([r["y"] for r in got], float), n=np.array([r["n"] for r in got], float))]


def logits(rows: DataFrame, models: list[Logistic]) -> DataFrame:
    """content, metadata (both views' logits) and y."""
    import pyarrow as pa

    def make(batches):
        for b in batches:
            if b.num_rows:
                z = [pa.array(m.logit(x)) for m, x in zip(models, _views(b), strict=True)]
                yield pa.RecordBatch.from_arrays([*z, b.column("y")], names=["content", "metadata", "y"])

    return rows.select("content", "metadata", "y").mapInArrow(make, "content double, metadata double, y int")


def co_train(labelled: DataFrame, pool: Pool, rounds: int = 4, grow: float = 0.05) -> CoTrained | None:
    """``labelled``: content, metadata, y, hold. Rows to hold calibrate; the rest and the exchanged pseudo-labels train."""
    n = {(r["hold"], r["y"]): r["n"] for r in labelled.groupBy("hold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {y for _, y in n} != {0, 1}:
        return None
    apart = len(n) == 4
    train, held = (labelled.where("not hold"), labelled.where("hold")) if apart else (labelled, labelled)
    train = train.select("content", "metadata", "y")
    good = sum(v for (_, y), v in n.items() if y) / sum(n.values())
    models = fit_views(train, train)
    for _ in range(rounds if pool.size else 0):
        each = grow * pool.size
        # as many of each class as the labels have, so that the surer class does not take over
        if not pool.choose(models, (each * (1 - good), each * good)):
            break
        models = fit_views(*[train.unionByName(pool.learnt(v)) for v in (0, 1)], start=models[0].w)
    rows = logits(held, models).collect()  # three numbers a row, of the labelled sample
    raw, y = [np.array([r[v] for r in rows]) for v in ("content", "metadata")], np.array([r["y"] for r in rows], float)
    ones = np.ones(len(y))
    calibrations = [Logistic.fit(np.stack([ones, z], 1), y, 1e-3) for z in raw]
    both = [k.logit(np.stack([ones, z], 1)) for k, z in zip(calibrations, raw, strict=True)]
    return CoTrained(*models, calibrations, Logistic.fit(np.stack([ones, *both], 1), y))


def labelled_rows(features: DataFrame, known: DataFrame, seed: int, most: int, scratch: Scratch) -> DataFrame:
    """content, metadata, y, hold of the ids of ``known`` (doc_id, label) with the ``most`` smallest hashes; every fifth or so is to hold."""
    draw = F.xxhash64(F.lit(seed), "doc_id")
    there = known.join(features.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = scratch.keep(there.orderBy(draw, "doc_id").limit(most), "ids")  # at most so many rows of two numbers
    found = features.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    once = found.groupBy("doc_id").agg(F.min(F.struct("content", "metadata")).alias("view"))
    hold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0
    once = once.join(F.broadcast(ids), "doc_id").select("view.content", "view.metadata", F.col("label").alias("y"), hold.alias("hold"))
    return scratch.keep(once.coalesce(4), "labelled")


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, sure: float = 0.9, seed: int = 5) -> CoTrained | None:
    """Both classifiers from a bounded sample of labels and all rows without one; None without labels of both classes."""
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.keep(feature_rows(docs), "features")
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    labelled = labelled_rows(features, known, seed, max_labelled, scratch)
    if labelled.agg(F.count_distinct("y").alias("n")).first()["n"] < 2:
        return None
    pool = Pool(features.join(known, "doc_id", "left_anti"), seed, sure)
    scratch.drop("features")
    model = co_train(labelled, pool)
    pool.clear()
    scratch.clear()
    return model


def with_quality(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with content_prob, metadata_prob, score and accepted (score >= threshold)."""
    import pyarrow as pa

    names = ["content_prob", "metadata_prob", "score"]
    docs = docs.drop(*names, "accepted")
    if model is None:
        return docs.withColumns({n: F.lit(1.0) for n in names} | {"accepted": F.lit(True)})
    place = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts, langs, sources, sizes = (b.column(i) for i in place)
            c = np.stack([content_features(t.as_py()) for t in texts])
            m = np.array([metadata_indices(*v) for v in zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist(), strict=True)])
            p = model.scores(c, dense_metadata(m))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(p[:, k]) for k in range(3)]], names=[*b.schema.names, *names])

    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return docs.mapInArrow(score, schema).withColumn("accepted", F.col("score") >= threshold)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", "content_prob", "metadata_prob", "score", "accepted")
