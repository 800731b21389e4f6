"""Boosted classifiers of all classes at once, each against the rest: one Spark job a level grows a tree of every class.

As Spark's gradient-boosted trees: the logistic loss of -1 and 1, a first tree of the labels, then
trees of the residuals at a rate, with the weighted mean in the leaves. Rows are binned once. Words
belong to a text, so a task with few texts adds gradients up by (node, text) first and by word after
that; a cut of a word is whether a text has it so often. Sums are of whole multiples of a unit, exact in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.files import dropped, stored
from .boosting import BINS, BYTES, KEEP, _alone, _checkpointed, _cleared, _together, _value, numbers, quantile_bins

#: Buckets of words; a word more often in a text counts as so often.
WORDS, OFTEN = 1 << 12, 31
_NAMES = ("y", "w", "x", "text", "at", "test")
_BLOCK = ", ".join(f"{c} binary" for c in _NAMES)


def worded(df: DataFrame, columns, *more) -> DataFrame:
    """text, the words' buckets and numbers, the columns as an array, and more columns."""
    d = Pipeline(stages=[RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=WORDS)]).fit(df.limit(0).withColumn("_text", F.col("text")))
    v = F.unwrap_udt("_hashed")
    d = d.transform(df.withColumn("_text", F.coalesce("text", F.lit(""))))
    return d.select(F.col("_text").alias("text"), v["indices"].alias("_i"), v["values"].alias("_n"), F.array(*[_value(c) for c in columns]).alias("_v"), *more)


class _Blocks:
    """Batches of worded() to (bins of the columns, each row's text, (text, word) pairs by word) and the batch."""

    def __init__(self, edges: list, tests) -> None:
        self.edges, self.tests = edges, tests

    def __call__(self, batches):
        for batch in _together(batches):
            coded = batch.column(0).dictionary_encode()
            text = coded.indices.to_numpy().astype(np.int32)
            v = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, len(self.edges)).T
            x = np.array([np.searchsorted(e, c) for e, c in zip(self.edges, v)], np.uint8).reshape(len(self.edges), batch.num_rows)
            _, one = np.unique(text, return_index=True)  # a row of each text has its words
            words = batch.column(1).take(pa.array(one))
            at = np.repeat(np.arange(len(one)), np.diff(words.offsets.to_numpy()))
            which = words.flatten().to_numpy().astype(np.int64)
            often = np.minimum(batch.column(2).take(pa.array(one)).flatten().to_numpy(), OFTEN).astype(np.int64)
            many = np.repeat(np.arange(len(often)), often)  # a pair for each number up to a text's
            nth = np.arange(len(many)) - np.repeat(np.cumsum(often) - often, often) + 1
            key = which[many] * (OFTEN + 1) + nth
            place = np.searchsorted(self.tests, key)
            known = (place < len(self.tests)) & (self.tests[np.minimum(place, len(self.tests) - 1)] == key) if len(self.tests) else np.zeros(len(key), bool)
            at, place = at[many][known].astype(np.int32), place[known].astype(np.int32)
            order = np.argsort(place, kind="stable")
            yield x, text, at[order], place[order], batch


class _Packed(_Blocks):
    def __init__(self, edges, tests, index: dict) -> None:
        super().__init__(edges, tests)
        self.index = index

    def __call__(self, batches):
        for x, text, at, place, batch in super().__call__(batches):
            y = np.array([self.index[v] for v in batch.column(4).to_pylist()], np.int16)
            block = y, batch.column(5).to_numpy(), x, text, at, place
            yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(_NAMES, block)})


def _unpacked(row, columns: int):
    y = np.frombuffer(row["y"], np.int16)
    return y, np.frombuffer(row["w"]), np.frombuffer(row["x"], np.uint8).reshape(columns, len(y)), *(np.frombuffer(row[c], np.int32) for c in ("text", "at", "test"))


def _walked(x, text, has, feature, cut, depth: int):
    """The node of each row in a tree; has(test) tells which texts have a word so often."""
    columns, rows = len(x), x.shape[1]
    node = np.zeros(rows, np.int64)
    for level in range(depth):
        for n in range((1 << level) - 1, (2 << level) - 1):
            f = feature[n]
            if f >= 0:
                on = np.flatnonzero(node == n) if level else slice(None)
                node[on] = 2 * n + 1 + (x[f, on] > cut[n] if f < columns else has(f - columns)[text[on]])
    return node


def _having(at, place, texts: int):
    bounds: dict = {}

    def has(test: int):
        if test not in bounds:
            out = np.zeros(texts, bool)
            out[at[np.searchsorted(place, test) : np.searchsorted(place, test, "right")]] = True
            bounds[test] = out
        return bounds[test]

    return has


class _Moved:
    """(block, scores by class) to the scores moved by a tree a class."""

    def __init__(self, trees, depth: int) -> None:
        self.trees, self.depth = trees, depth

    def __call__(self, both):
        (_, _, x, text, at, place), score = both
        has, score = _having(at, place, int(text.max()) + 1), score.copy()
        for c, (feature, cut, value) in enumerate(zip(*self.trees)):
            score[c] += value[_walked(x, text, has, feature, cut, self.depth)].astype(np.float32)
        return score


class _Sums:
    """(block, scores) to the sums of weighted residuals and weights by (class and node of a level, column and bin, then word), in parts."""

    def __init__(self, growing, level: int, live, tests: int, unit: float, parts: int, first: bool) -> None:
        self.growing, self.level, self.live, self.tests, self.unit, self.parts, self.first = growing, level, live, tests, unit, parts, first

    def __call__(self, pairs):
        width, first, sums = 1 << self.level, (1 << self.level) - 1, {}
        for (y, w, x, text, at, place), score in pairs:
            k, texts = len(x), int(text.max()) + 1
            has, tests = _having(at, place, texts), np.flatnonzero(np.diff(place, prepend=-1))
            many = np.bincount(at, minlength=texts)
            if width * len(at) > many[text].sum():  # fewer words of rows than of texts by node
                by, ends = place[np.argsort(at, kind="stable")], np.cumsum(many[text])
                row = np.repeat(np.arange(len(text)), many[text])
                word = by[np.arange(len(row)) - (ends - many[text])[row] + (np.cumsum(many) - many)[text[row]]]
            else:
                row = None
            for c in np.flatnonzero(self.live):
                sign = np.where(y == c, 1.0, -1.0)
                residual = sign if self.first else 4 * sign / (1 + np.exp(2 * sign * score[c].astype(float)))
                g, h = np.rint(w * residual * self.unit), np.rint(w * self.unit)
                node = _walked(x, text, has, *(v[c] for v in self.growing[:2]), self.level) - first
                off = node < 0  # in a leaf above
                node[off], g[off], h[off] = 0, 0.0, 0.0
                out = np.zeros((2, width, k * BINS + self.tests))
                for f in range(k):
                    slot = node * BINS + x[f]
                    for i, v in enumerate((g, h)):
                        out[i, :, f * BINS : (f + 1) * BINS] = np.bincount(slot, v, width * BINS).reshape(width, BINS)
                if row is not None:
                    slot = (node * self.tests)[row] + word
                    for i, v in enumerate((g, h)):
                        out[i, :, k * BINS :] = np.bincount(slot, v[row], width * self.tests).reshape(width, self.tests)
                elif len(tests):
                    slot = node * texts + text
                    for i, v in enumerate((g, h)):
                        by_text = np.bincount(slot, v, width * texts).reshape(width, texts)
                        out[i][:, k * BINS + place[tests]] = np.add.reduceat(by_text[:, at], tests, axis=1)
                for n in np.flatnonzero(out[1, :, :BINS].any(axis=1)):
                    s = int(c) * width + int(n)
                    sums[s] = sums[s] + out[:, n] if s in sums else out[:, n].copy()
        for s, v in sums.items():
            yield s % self.parts, (s, v)


class _Cuts:
    """Sums of a partition, whose classes and nodes are whole, to the best cut of each; of equal ones the first."""

    def __init__(self, columns: int, unit: float) -> None:
        self.columns, self.unit = columns, unit

    def __call__(self, parts):
        sums: dict = {}
        for _, (s, v) in parts:
            sums[s] = sums[s] + v if s in sums else v
        for s, (g, h) in sums.items():
            end = self.columns * BINS
            total, n = g[:BINS].sum() / self.unit, h[:BINS].sum() / self.unit
            gl, hl = (np.concatenate((np.cumsum(v[:end].reshape(-1, BINS), axis=1).ravel(), v[:BINS].sum() - v[end:])) / self.unit for v in (g, h))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl**2 / hl + (total - gl) ** 2 / (n - hl) - total**2 / n
            gain[(hl <= 0) | (n - hl <= 0)] = -1.0
            b = int(np.argmax(gain))
            f = b // BINS if b < end else self.columns + b - end
            yield s, {"f": f, "bin": b % BINS if b < end else 0, "gain": float(gain[b]), "left": float(gl[b] / hl[b]) if hl[b] else 0.0, "right": float((total - gl[b]) / (n - hl[b])) if n > hl[b] else 0.0, "mean": float(total / n)}


class BoostedClasses:
    """Fitted trees of every class; labels by number of rows, the most frequent first."""

    def __init__(self, columns, labels, edges, tests, trees, depth: int) -> None:
        self.columns, self.labels, self.edges, self.tests, self.trees, self.depth = list(columns), labels, edges, tests, trees, depth
        self.rounds = len(trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """text, label and yhat, the label of the largest score; of equal ones the first."""
        blocks, labels, trees, depth = _Blocks(self.edges, self.tests), np.array(self.labels or [None], object), self.trees, self.depth

        def predicted(batches):
            for x, text, at, place, batch in blocks(batches):
                has, score = _having(at, place, int(text.max()) + 1), np.zeros((len(labels), batch.num_rows))
                for tree in trees:
                    for c, (feature, cut, value) in enumerate(zip(*tree)):
                        score[c] += value[_walked(x, text, has, feature, cut, depth)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(labels[score.argmax(axis=0)], pa.string())], ["text", "label", "yhat"])

        return worded(df, self.columns, F.col("label").cast("string").alias("label")).mapInArrow(predicted, StructType([StructField(n, StringType()) for n in ("text", "label", "yhat")]))


def fit(df: DataFrame, columns, rounds: int = 100, depth: int = 6, rate: float = 0.1) -> BoostedClasses:
    """A boosted model of each label of (text, label, weight, columns...) against the rest. Labels are a small set; rows without one don't count."""
    spark, columns = df.sparkSession, list(columns)
    d = df.where("label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
    known = sorted(d.groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect(), key=lambda r: (-r["n"], r["label"]))
    labels = [r["label"] for r in known]
    if not labels:
        return BoostedClasses(columns, labels, [], np.zeros(0, np.int64), [], depth)
    edges = quantile_bins(numbers(d, None, "weight", columns), len(columns))[1][""]
    words = worded(d.select("text").distinct(), []).select(F.explode(F.arrays_zip("_i", "_n")).alias("x")).groupBy("x._i").agg(F.max("x._n").alias("most")).collect()
    tests = np.array(sorted(r["_i"] * (OFTEN + 1) + n for r in words for n in range(1, min(OFTEN, int(r["most"])) + 1)), np.int64)
    packed = _Packed(edges, tests, {label: i for i, label in enumerate(labels)})
    written = stored(worded(d, columns, "label", F.col("weight").cast("double").alias("weight")).mapInArrow(packed, _BLOCK), "classes")
    k, classes = len(columns), len(labels)
    blocks = _alone(written.rdd.map(lambda row: _unpacked(row, k))).persist(StorageLevel.MEMORY_AND_DISK)
    _checkpointed(spark)
    scores, kept, marked = _alone(blocks.map(lambda block: np.zeros((classes, len(block[0])), np.float32))), [], []
    unit, tasks = 2.0**20 / max(4 * r["w"] for r in known), blocks.getNumPartitions()
    nodes, live, trees = (2 << depth) - 1, np.ones(classes, bool), []
    for i in range(rounds):
        feature, cut, value = np.full((classes, nodes), -1, np.int64), np.zeros((classes, nodes), np.uint8), np.zeros((classes, nodes))
        for level in range(depth):
            size = (classes << level) * (k * BINS + len(tests)) * 16 * tasks
            few, cuts = max(1, min(classes << level, tasks, -(-size // BYTES))), _Cuts(k, unit)
            sums = blocks.zip(scores).mapPartitions(_Sums((feature, cut), level, live, len(tests), unit, few, not i))
            found = [*cuts(sums.collect())] if few == 1 else sums.partitionBy(few, int).mapPartitions(cuts).collect()
            if not level:
                while len(kept) > 1:  # the scores of this round are there
                    kept.pop(0).unpersist()
                _cleared(spark, marked[:-1])
                marked = marked[-1:]
            grown, step = False, rate if i else 1.0
            for slot, r in sorted(found, key=lambda f: f[0]):
                c, node = slot >> level, (1 << level) - 1 + (slot & (1 << level) - 1)
                if not level:
                    value[c, 0] = step * r["mean"]
                if r["gain"] > 0:
                    grown, feature[c, node], cut[c, node] = True, r["f"], r["bin"]
                    value[c, 2 * node + 1], value[c, 2 * node + 2] = step * r["left"], step * r["right"]
            if not grown:
                break
        trees.append((feature, cut, value))
        scores = _alone(blocks.zip(scores).map(_Moved(trees[-1], depth))).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % KEEP == 0:
            scores.checkpoint()
            marked.append(scores)
        kept.append(scores)
    for rdd in (*kept, blocks):
        rdd.unpersist()
    _cleared(spark, marked)
    dropped(written)
    return BoostedClasses(columns, labels, edges, tests, trees, depth)
