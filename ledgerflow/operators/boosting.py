"""Boosted regression trees of many groups at once: one Spark job a level grows a tree of every group.

Rows are binned once; rows of a group that are alike in every bin go the same way through every tree,
so they are one cell with their number, sum and sum of squares, which tasks add up before anything is
shuffled. Cells are kept as blocks of arrays in an RDD, and beside them the cells' scores, which each
round moves by its own tree and KEEP rounds write, so that lost ones are not worked out from the
first round. A job adds gradients up by (group and node, column, bin) in each task; these histograms
are shuffled by (group, node) to find each one's best cut, so that the driver sees a row a (group,
node), or go to the driver where all tasks' are BYTES at most. A histogram's size doesn't depend on the number of rows. Gradients are whole multiples of a unit, so that sums are exact in any order
and, given the bins, reruns and repeated tasks agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import dropped, stored, work_dir

#: Bins of a column in a group; rounds between two writes of the scores; groups that one fit takes; cells of a task.
BINS, KEEP, GROUPS, PART = 64, 10, 1000, 2_000_000
#: Groups with more rows hold a tenth of them out and stop after PATIENCE rounds without a smaller loss there.
HELD_OUT, PATIENCE = 10_000, 10
#: Rows that a task takes together; bytes of histograms that a task, or the driver, adds up.
ROWS, BYTES = 1 << 19, 32 << 20

_NAMES = ("t", "x", "n", "y", "q", "held", "score")
_BLOCK = ", ".join(f"{c} binary" for c in _NAMES)
_BINNED = "t short, held boolean, x binary, n long, y long, q long"


def _together(batches):
    """Rows of many batches as one, about ROWS rows at a time."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def numbers(df: DataFrame, group, target: str, columns: list[str]) -> DataFrame:
    """Rows with a target as (group, hash, numbers: the target and the columns): Spark hands an array over in half the time of as many columns."""
    y = F.col(target).cast("double")
    d = df.where(y.isNotNull() & ~F.isnan(y)).select(_group(group).alias("_g"), y.alias("_y"), *[_value(c).alias(f"_{i}") for i, c in enumerate(columns)])
    return d.select("_g", F.pmod(F.xxhash64(*d.columns), F.lit(10)).cast("byte").alias("_fold"), F.array(*d.columns[1:]).alias("_v"))


def _columns(batches):
    """(each row's place in the groups, the groups, hash, target, columns) of numbers()."""
    for batch in _together(batches):
        coded = batch.column(0).dictionary_encode()
        v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).T
        yield coded.indices.to_numpy(), coded.dictionary.to_pylist(), batch.column(1).to_numpy(), v[0], v[1:]


def quantile_bins(d: DataFrame, columns: int):
    """({group: (rows, mean, largest target)}, {group: [edges of each column]}) of numbers(). Edges are the column's quantiles in the group."""
    marks = [(i + 1) / BINS for i in range(BINS - 1)]
    y, *values = (F.col("_v")[i] for i in range(columns + 1))
    found = d.groupBy("_g").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.max(F.abs(y)).alias("top"), *[F.percentile_approx(v, marks, 10_000).alias(f"_{i}") for i, v in enumerate(values)]).limit(GROUPS + 1).collect()
    if len(found) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    return {r["_g"]: (r["n"], r["mean"], r["top"]) for r in found}, {r["_g"]: [np.unique(r[f"_{i}"]) for i in range(columns)] for r in found}


def _walk(t, x, feature, cut, depth):
    """The node of each row in its group's tree; nodes are numbered as in a heap."""
    rows, node = np.arange(len(t)), np.zeros(len(t), np.int64)
    for _ in range(depth):
        f = feature[t, node]
        node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[t, node]), node)
    return node


def _packed(*block):
    return pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(_NAMES, block)})


def _unpacked(row, columns: int):
    """A block's arrays; bins are a row a column."""
    t = np.frombuffer(row["t"], np.int16)
    x = np.ascontiguousarray(np.frombuffer(row["x"], np.uint8).reshape(len(t), columns).T)
    return t, x, *(np.frombuffer(row[c]) for c in "nyq"), np.frombuffer(row["held"], bool), np.frombuffer(row["score"])


class _Binned:
    """numbers() to cells: group, fold, bins, number, target in units and its square; rows of groups without a model go.

    by_target: a cell's rows are also alike in their target.
    """

    def __init__(self, index: dict, edges: list, big, unit: float, by_target: bool = False) -> None:
        self.index, self.edges, self.big, self.unit, self.by_target = index, edges, big, unit, by_target

    def __call__(self, batches):
        for codes, names, fold, y, values in _columns(batches):
            t = np.array([self.index.get(g, -1) for g in names], np.int64)[codes]
            order = np.argsort(t, kind="stable")
            order = order[np.searchsorted(t[order], 0) :]
            if not len(order):
                continue
            t, bounds = t[order], np.searchsorted(t[order], np.arange(len(self.edges) + 1))
            x = np.zeros((len(t), len(values)), np.uint8)
            for f, v in enumerate(values):
                v = v[order]
                for i in range(len(self.edges)):
                    at = slice(bounds[i], bounds[i + 1])
                    x[at, f] = np.searchsorted(self.edges[i][f], v[at])
            y = y[order] * self.unit
            held = (fold[order] == 0) & self.big[t]
            y, q = (np.rint(v).astype(np.int64) for v in (y, (y / 1024) ** 2))
            words = [t * 2 + held]
            for f in range(0, len(values), 9):  # nine bins and a sign are a word
                words.append(np.zeros(len(t), np.int64))
                for j in range(f, min(f + 9, len(values))):
                    words[-1] = words[-1] * BINS + x[:, j]
            if len(words) == 2 and len(self.edges) <= 128:
                words = [words[0] << 54 | words[1]]
            words += [y] if self.by_target else []
            order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words)
            first = np.flatnonzero(np.concatenate(([True], np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0))))
            own = order[first]
            n = np.diff(first, append=len(t))
            y = y[own] if self.by_target else np.add.reduceat(y[order], first)
            bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(values)), len(own), [None, pa.py_buffer(x[own].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_pydict(dict(zip(("t", "held", "x", "n", "y", "q"), (t[own].astype(np.int16), held[own], bins, n, y, np.add.reduceat(q[order], first)))))


class _Cells:
    """Batches of cells (group, fold, bins, number, sum, sum of squares) to blocks that begin with the groups' means."""

    def __init__(self, base) -> None:
        self.base = base

    def __call__(self, batches):
        for batch in _together(batches):
            t, held, x, *sums = batch.columns
            t = t.to_numpy().astype(np.int16)
            sums = [v.to_numpy().astype(float) for v in sums]
            yield _packed(t, np.frombuffer(b"".join(x.to_pylist()), np.uint8), *sums, held.to_numpy(zero_copy_only=False), self.base[t])


def _nodes(t, x, feature, cut, depth):
    """_walk() of bins that are a row a column."""
    node, flat = np.zeros(len(t), np.int64), np.arange(len(t))
    for _ in range(depth):
        f = feature[t, node]
        node = np.where(f >= 0, 2 * node + 1 + (x[np.maximum(f, 0), flat] > cut[t, node]), node)
    return node


class _Moved:
    """(block, scores) to the scores moved by a tree."""

    def __init__(self, tree, depth: int) -> None:
        self.tree, self.depth = tree, depth

    def __call__(self, both):
        (t, x, *_), score = both
        feature, cut, value = self.tree
        return score + value[t, _nodes(t, x, feature, cut, self.depth)]


class _Histograms:
    """(block, scores) to sums of gradients and counts by (group and node of a level, column), in parts, and on level 0 held-out losses by group."""

    def __init__(self, columns, growing, level: int, live, unit: float, parts: int) -> None:
        self.columns, self.growing, self.level, self.live, self.unit, self.parts = columns, growing, level, live, unit, parts

    def __call__(self, pairs):
        width, first, k = 1 << self.level, (1 << self.level) - 1, self.columns
        slots = len(self.live) * width
        g, h = np.zeros((k, slots * BINS)), np.zeros((k, slots * BINS))
        loss = np.zeros(len(self.live))
        for (t, x, n, y, q, held, _), score in pairs:
            score = score * self.unit
            if self.level == 0:
                out = held & self.live[t]
                s = score[out] / 1024
                loss += np.bincount(t[out], np.rint(n[out] * s**2 - 2 * s * (y[out] / 1024) + q[out]), len(loss))
            node = _nodes(t, x, *self.growing[:2], self.level)
            on = np.flatnonzero(~held & self.live[t] & (node >= first) & (node < first + width))
            slot = (t[on].astype(np.int64) * width + node[on] - first) * BINS
            gradient, number = np.rint(n[on] * score[on]) - y[on], n[on]
            for f in range(k):
                at = slot + x[f, on]
                g[f] += np.bincount(at, gradient, slots * BINS)
                h[f] += np.bincount(at, number, slots * BINS)
        g, h = (v.reshape(k, slots, BINS).swapaxes(0, 1) for v in (g, h))
        seen = np.flatnonzero(h[:, 0].any(axis=1))
        for p in range(self.parts):
            mine = seen[seen % self.parts == p]
            if len(mine):
                yield p, (mine, g[mine], h[mine])
        if loss.any():
            yield 0, (None, loss, None)


class _Cuts:
    """Histograms of a partition, whose groups and nodes are whole, to the best cut of each; a slot of -1 has the held-out losses."""

    def __init__(self, unit: float, l2: float, leaf_rows: int) -> None:
        self.unit, self.l2, self.leaf_rows = unit, l2, leaf_rows

    def __call__(self, parts):
        sums, loss = {}, 0.0
        for _, (slots, g, h) in parts:
            if slots is None:
                loss = loss + g
                continue
            for i, s in enumerate(slots.tolist()):
                known = sums.get(s)
                sums[s] = (g[i], h[i]) if known is None else (known[0] + g[i], known[1] + h[i])
        if not np.isscalar(loss):
            yield -1, loss
        for s, (g, h) in sums.items():
            yield s, self.best(g, h)

    def best(self, g, h):
        """(column, gain, bin, sums left of the cut, sums) of the best cut of a node's columns; of equal ones the first."""
        g = g / self.unit
        gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
        total, n = gl[:, -1:], hl[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):  # empty sides without l2, which are no cuts
            gain = gl**2 / (hl + self.l2) + (total - gl) ** 2 / (n - hl + self.l2) - total**2 / (n + self.l2)
        gain[(hl < self.leaf_rows) | (n - hl < self.leaf_rows)] = -1.0
        b = np.argmax(gain, axis=1)
        f = int(np.argmax(gain[np.arange(len(b)), b]))
        b = int(b[f])
        return {"f": f, "gain": float(gain[f, b]), "bin": b, "gl": float(gl[f, b]), "hl": float(hl[f, b]), "g": float(total[f, 0]), "h": float(n[f, 0])}


class _ColumnCuts:
    """Rows of (slot, column, sums) of a partition, whose keys are whole, to the best cut of each."""

    def __init__(self, unit: float, l2: float, leaf_rows: int) -> None:
        self.cuts = _Cuts(unit, l2, leaf_rows)

    def __call__(self, batches):
        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                g, h = np.frombuffer(row["g"]), np.frombuffer(row["h"])
                known = sums.get((row["slot"], row["f"]))
                sums[row["slot"], row["f"]] = (g, h) if known is None else (known[0] + g, known[1] + h)
        rows = [(*key, *(v for k, v in self.cuts.best(g[None], h[None]).items() if k != "f")) for key, (g, h) in sorted(sums.items())]
        if rows:
            names = ["slot", "f", "gain", "bin", "gl", "hl", "g", "h"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("slot", "f", "bin") else pa.float64()) for n, c in zip(names, zip(*rows))], names)


class Boosted:
    """Fitted trees of every group, and the mean of groups with too few rows."""

    def __init__(self, columns, group, index, means, base, trees, edges, gains) -> None:
        self.columns, self.group, self.index, self.means, self.base, self.gains = list(columns), group, index, means, base, gains
        self.rounds, self.depth = len(trees), 0 if not trees else (trees[0][0].shape[1] + 1).bit_length() - 2
        bounds = np.full((max(1, len(base)), len(columns), BINS), np.inf)
        for i, per in enumerate(edges):
            for f, e in enumerate(per):
                bounds[i, f, : len(e)] = e
        self.trees = [(feature, bounds[np.arange(len(base))[:, None], np.maximum(feature, 0), cut], value) for feature, cut, value in trees]

    def importances(self) -> list[tuple[str, float]]:
        """Each column's share of all gains."""
        return [(c, float(v / (self.gains.sum() or 1.0))) for c, v in zip(self.columns, self.gains)]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction; a group that the fit had not seen gets 0."""
        index, means, base, trees, depth = self.index, self.means, self.base, self.trees, self.depth

        @F.pandas_udf("double")
        def predicted(group: pd.Series, values: pd.DataFrame) -> pd.Series:
            t = group.map(index).fillna(-1).to_numpy(np.int64)
            out, on = group.map(means).fillna(0.0).to_numpy(float).copy(), np.flatnonzero(t >= 0)
            if len(on):
                t, x = t[on], values.to_numpy(float)[on]
                score = base[t]
                for feature, bound, value in trees:
                    score = score + value[t, _walk(t, x, feature, bound, depth)]
                out[on] = score
            return pd.Series(out)

        return df.withColumn("prediction", predicted(_group(self.group), F.struct(*[_value(c).alias(c) for c in self.columns])))


def _group(group):
    return F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")


def _value(c: str):
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def _alone(rdd):
    """rdd with an element a message, so that two of them zip without being written anew."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _checkpointed(spark) -> None:
    """Sets a folder for written scores where the session has none."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(work_dir(spark, "scores"))


def _cleared(spark, rdds) -> None:
    """Removes what checkpoint() wrote of them."""
    for name in filter(None, (rdd.getCheckpointFile() for rdd in rdds)):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fit(df: DataFrame, columns, target: str = "target", group: str | None = None, rounds: int = 300, depth: int = 4, rate: float = 0.06, l2: float = 1.0, least: int = 40, leaf_rows: int = 20) -> Boosted:
    """Trees of the squared loss for each value of group, or for all rows.

    Nulls and NaN in columns are 0, a null group is ''; rows with a null target don't count. A group
    with fewer than `least` rows is its mean. Bins are each group's own quantiles. Groups are a
    small set, such as categories: more than GROUPS of them fail. Repeated rows are held out together.
    """
    columns = list(columns)
    spark = df.sparkSession
    d = numbers(df, group, target, columns)
    known, bins = quantile_bins(d, len(columns))
    unit = 2.0**20 / (2 * max((top for _, _, top in known.values()), default=0.0) or 1.0)
    means = {g: round(mean * unit * 1024) / unit / 1024 for g, (_, mean, _) in known.items()}  # the last digits of a mean depend on the order of rows
    names = sorted(g for g, (n, _, _) in known.items() if n >= least)
    index, base = {g: i for i, g in enumerate(names)}, np.array([means[g] for g in names])
    edges = [bins[g] for g in names]
    gains = np.zeros(len(columns))
    if not names:
        return Boosted(columns, group, index, means, base, [], edges, gains)
    big = np.array([known[g][0] > HELD_OUT for g in names])
    binned = d.mapInArrow(_Binned(index, edges, big, unit), _BINNED)
    cells = stored(binned.groupBy("t", "held", "x").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("q").alias("q")), "boosting-cells")
    parts = max(spark.sparkContext.defaultParallelism, cells.count() // PART)
    written = stored(cells.repartition(parts).mapInArrow(_Cells(base), _BLOCK), "boosting")
    k = len(columns)
    blocks = _alone(written.rdd.map(lambda row: _unpacked(row, k))).persist(StorageLevel.MEMORY_AND_DISK)
    _checkpointed(spark)
    scores, kept, marked = _alone(blocks.map(lambda block: block[-1])), [], []
    nodes, live = (1 << depth + 1) - 1, np.ones(len(base), bool)
    lowest, since = np.full(len(base), np.inf), np.zeros(len(base), int)
    trees, tasks = [], blocks.getNumPartitions()
    for _ in range(rounds):
        feature, cut, value = np.full((len(base), nodes), -1, np.int16), np.zeros((len(base), nodes), np.uint8), np.zeros((len(base), nodes))
        for level in range(depth):
            size = (len(base) << level) * k * BINS * 16 * tasks
            few, cuts = max(1, min(len(base) << level, tasks, -(-size // BYTES))), _Cuts(unit, l2, leaf_rows)
            sums = blocks.zip(scores).mapPartitions(_Histograms(k, (feature, cut), level, live, unit, few))
            found = [*cuts(sums.collect())] if few == 1 else sums.partitionBy(few, int).mapPartitions(cuts).collect()
            if level == 0:
                while len(kept) > 1:  # the scores of this round are there
                    kept.pop(0).unpersist()
                _cleared(spark, marked[:-1])
                marked = marked[-1:]
                for t, loss in ((t, v) for s, all_ in found if s < 0 for t, v in enumerate(all_) if v):
                    since[t] = 0 if loss < lowest[t] else since[t] + 1
                    lowest[t] = min(lowest[t], loss)
                live = live & (since < PATIENCE)
            grown = False
            for slot, r in sorted((f for f in found if f[0] >= 0), key=lambda f: f[0]):
                t, node = slot >> level, (1 << level) - 1 + (slot & (1 << level) - 1)
                if not live[t] or r["gain"] <= 0:
                    continue
                grown, feature[t, node], cut[t, node] = True, r["f"], r["bin"]
                value[t, 2 * node + 1] = -rate * r["gl"] / (r["hl"] + l2)
                value[t, 2 * node + 2] = -rate * (r["g"] - r["gl"]) / (r["h"] - r["hl"] + l2)
                gains[r["f"]] += r["gain"]
            if not grown:
                break
        live = live & (feature[:, 0] >= 0)  # a tree without a cut will not have one later
        if not live.any():
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
    dropped(cells)
    dropped(written)
    return Boosted(columns, group, index, means, base, trees, edges, gains)
