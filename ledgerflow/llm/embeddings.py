"""Near-duplicate embeddings by a pigeonhole join over low-dimensional blocks of rotated vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, materialize, mix64, table
from .components import connected_components

#: Rotated coordinates are rounded to this unit, so that every task sees the same whole numbers.
UNIT = 1 << 20
#: Rows of a cell that one task compares; larger cells are split, and each pair of parts is a task.
PART = 4096
#: Rows of small cells that one task gets together.
TASK = 20_000
#: Pairs looked at together within a task: bounds its memory.
PAIRS = 1 << 18


class CosineLinks:
    """Links vectors of one label whose cosine is `least` or more.

    For unit vectors that means a squared distance of 2 - 2 * least at most. A rotation spreads it
    over the blocks, and in one block at least the pair is within the block's share. In each block,
    vectors lie in a grid whose cells are four radii wide, and those near a side also visit the
    cell beyond it, of two cells only the one with the smaller key the other. A pair that is close
    in several blocks counts in the first of them.
    """

    def __init__(self, least: float = 0.98, block: int = 8, seed: int = 11) -> None:
        self.least, self.block, self.seed = least, block, seed

    def _rotation(self, dim: int) -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    def _blocks(self, dim: int) -> list[slice]:
        n = max(1, dim // self.block)
        edges = [dim * k // n for k in range(n + 1)]
        return [slice(a, b) for a, b in zip(edges, edges[1:])]

    def _share(self, dim: int) -> int:
        """A block's part of the squared distance in whole units, with room for rounding."""
        return int((2 - 2 * self.least + 1e-4) / len(self._blocks(dim)) * UNIT**2)

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.rint(unit @ self._rotation(vectors.shape[1]) * UNIT).astype(np.int64)

    def cells(self, vectors: np.ndarray):
        """(block, rows, keys, home) of each block: where vectors live, and which cells they visit."""
        z = self.rotated(vectors)
        share = self._share(vectors.shape[1])
        radius = math.isqrt(share) + 1
        side = 4 * radius
        for k, part in enumerate(self._blocks(vectors.shape[1])):
            x = z[:, part] + side // 2  # the middle of a cell is at zero
            cell = x // side
            within = x - cell * side
            up = within >= side // 2
            gap = np.where(up, side - within, within + 1).astype(np.float64)
            step = np.where(up, 1, -1)
            d = x.shape[1]
            subsets = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(np.float64)
            home = self._key(cell, k)
            for a in range(0, len(x), 2048):
                reach = (gap[a : a + 2048] ** 2) @ subsets.T <= share * (1 + 1e-9)
                row, subset = np.nonzero(reach)
                row += a
                key = self._key(cell[row] + step[row] * subsets[subset].astype(np.int64), k)
                lives = subset == 0
                use = lives | (key > home[row])
                yield k, row[use], key[use], lives[use]

    @staticmethod
    def _key(cell: np.ndarray, k: int) -> np.ndarray:
        key = np.full(len(cell), k + 1, np.uint64)
        for c in cell.T:
            key = mix64(key * np.uint64(BASE) + c.astype(np.uint64))
        return key.view(np.int64)

    def compare(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Rows of whole cells: (a, null, links of a found here) and connecting links (a, b, null)."""
        batch = batch.sort_values(["key", "lives"], ascending=[True, False], kind="stable", ignore_index=True)
        key, lives = batch.key.to_numpy(), batch.lives.to_numpy()
        node, copies, block = batch.node.to_numpy(), batch.copies.to_numpy(), batch.block.to_numpy()
        part = batch.part.to_numpy()
        vectors = np.stack([np.frombuffer(v, np.float64) for v in batch.vector])
        z = self.rotated(vectors)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        blocks, share = self._blocks(vectors.shape[1]), self._share(vectors.shape[1])
        n = len(batch)
        _, begin, size = np.unique(key, return_index=True, return_counts=True)
        first = np.repeat(begin, size)
        homes = np.repeat(np.add.reduceat(lives.astype(np.int64), begin), size)
        partners = np.where(lives, np.arange(n) - first, homes)
        split = len(np.unique(part)) > 1
        links = np.zeros(n, np.int64)
        label, edges = np.arange(n), []
        upto = np.concatenate(([0], np.cumsum(partners)))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1)
            counts = partners[a:b]
            left = np.repeat(np.arange(a, b), counts)
            right = np.repeat(first[a:b], counts) + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
            if split:
                different = part[left] != part[right]
                left, right = left[different], right[different]
            for k, s in enumerate(blocks):
                here = np.flatnonzero(block[left] == k)
                if not len(here):
                    continue
                i, j = left[here], right[here]
                close = ((z[i, s] - z[j, s]) ** 2).sum(axis=1) <= share
                i, j = i[close], j[close]
                for earlier in blocks[:k]:
                    if len(i):
                        new = ((z[i, earlier] - z[j, earlier]) ** 2).sum(axis=1) > share
                        i, j = i[new], j[new]
                near = (unit[i] * unit[j]).sum(axis=1) >= self.least
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                while len(i):
                    i, j = i[label[i] != label[j]], j[label[i] != label[j]]
                    if len(i):
                        edges.append((node[i[0]], node[j[0]]))
                        label[label == label[j[0]]] = label[i[0]]
            a = b
        found = np.flatnonzero(links)
        out = pd.DataFrame({"a": node[found], "b": pd.array([None] * len(found), "Int64"), "n": pd.array(links[found], "Int64")})
        if edges:
            more = pd.DataFrame(edges, columns=["a", "b"]).astype("Int64")
            out = pd.concat([out.astype("Int64"), more.assign(n=pd.array([None] * len(more), "Int64"))])
        return out

    def links(self, unique: DataFrame) -> DataFrame:
        """(a, b, n) over all cells of unique (node, label, dim, vector, copies)."""

        def place(batches):
            for batch in batches:
                for _, group in batch.groupby("dim"):
                    vectors = np.stack([np.frombuffer(v, np.float64) for v in group.vector])
                    for k, row, key, lives in self.cells(vectors):
                        yield pd.DataFrame({"node": group.node.to_numpy()[row], "dim": group.dim.to_numpy()[row], "label": group.label.to_numpy()[row], "block": k, "key": key, "lives": lives})

        cells = unique.select("node", "dim", F.col("label").cast("string").alias("label"), "vector").mapInPandas(place, "node long, dim int, label string, block int, key long, lives boolean")
        cells = materialize(cells.withColumn("key", F.xxhash64("key", "label", "dim")), "embedding-cells")
        sizes = cells.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.col("lives").cast("int")).alias("homes")).where("rows > 1 AND homes > 0")
        sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("rows") / PART).cast("int")), "embedding-sizes")
        total = sizes.agg(F.sum("rows")).first()[0] or 0
        tasks = max(1, math.ceil(total / TASK))
        d = cells.join(sizes.select("key", "parts"), "key")
        d = d.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.struct(F.col("key").alias("t"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        small = F.struct(F.pmod("key", F.lit(tasks)).alias("t"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
        d = d.withColumn("task", F.when(F.col("parts") == 1, small).otherwise(pair)).drop("other", "parts", "label")
        d = d.join(unique.select("node", "dim", F.col("label").alias("_label"), "vector", "copies"), ["node", "dim"])
        return d.select("node", "copies", "vector", "block", "key", "lives", "part", "task", "dim").groupBy("task", "dim").applyInPandas(lambda batch: self.compare(batch), "a long, b long, n long")

    def classes(self, table_: DataFrame) -> DataFrame:
        """A row a vector: vec_id, n_links, component_id, kept.

        Vectors that are null, zero, or hold null or non-finite components, and those with a null
        label or id, link with nothing and are their own component. Vectors of different lengths
        link with nothing of another length. Equal vectors of one label count as one with copies.
        Rows that share an id but not the vector share a component. An empty table gives no rows;
        columns other than vec_id, label and embedding are not read.
        """
        e = F.col("embedding")
        finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))
        key = F.when(usable, F.md5(F.concat_ws("|", F.col("label").cast("string"), e.cast("string"))))
        rows = table_.select(F.col("vec_id").cast("long"), "label", "embedding", key.alias("same"))
        rows = materialize(rows, "embedding-rows")

        def pack(batches):
            for batch in batches:
                yield batch[["node", "label", "dim", "copies"]].assign(vector=[np.asarray(v, np.float64).tobytes() for v in batch.embedding])

        kind = dict(rows.dtypes)["label"]
        unique = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("vec_id").alias("node"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
        unique = unique.withColumn("dim", F.size("embedding"))
        # a node's number: ids may repeat with other vectors, so vectors are numbered by themselves
        unique = materialize(unique.withColumn("vec", F.col("node")).withColumn("node", F.monotonically_increasing_id()), "embedding-unique")
        packed = unique.select("node", "label", "dim", "copies", "embedding").mapInPandas(pack, f"node long, label {kind}, dim int, copies long, vector binary")
        found = materialize(self.links(materialize(packed, "embedding-packed")), "embedding-links")
        sums = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        ids = unique.select("node", "vec")
        edges = found.where("b IS NOT NULL").join(ids.toDF("a", "va"), "a").join(ids.toDF("b", "vb"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
        parts = connected_components(edges).select(F.col("node").alias("vec"), "component")
        per = unique.select("same", "node", "vec", "copies").join(sums, "node", "left").join(parts, "vec", "left")
        per = per.select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
        d = rows.select("vec_id", "same").join(per, "same", "left")
        d = d.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return d.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embeddings(spark, sf_dir):
    return CosineLinks().classes(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
