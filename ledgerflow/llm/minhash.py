"""Near-duplicate documents by HyperMinHash: compressed registers, banding, exact verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, materialize, mix64, slabs, table, word_hashes
from .components import connected_components

#: Of a register's 16 bits these hold the binary digits after the leading one; the rest its place.
MANTISSA = 10
#: Expected chance matches a bucket of two registers with that mantissa (Yu and Weber, HyperMinHash).
CHANCE = 0.169919487159739 / 2**MANTISSA
#: Documents of a candidate group that a task compares with each other. Larger groups are split into
#: parts; what a first look at one hub leaves over is then held against every part.
PART = 1024


@dataclass(frozen=True)
class NearDuplicates:
    """Links sets of `width`-word shingles with similarity of percent / 100 or more.

    32 bands of 6 registers find a pair with 0.85 in common with probability 1 - 3e-7; pairs of
    short texts differ in fewer bands than there are, and are always found.
    """

    width: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 6

    @property
    def buckets(self) -> int:
        return self.bands * self.rows

    def shingle_sets(self, texts: list[str]) -> list[np.ndarray]:
        """The distinct shingles of each text as sorted 64-bit hashes."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[np.ndarray] = []
        for a, b in slabs([len(t) for t in raw]):
            hashes, begins = word_hashes(raw[a:b])
            n = len(hashes) - self.width + 1
            grams = np.zeros(max(n, 0), np.uint64)
            for k in range(self.width):
                grams = (grams + hashes[k : k + max(n, 0)]) * np.uint64(BASE)
            grams = mix64(grams)
            for i, j in zip(begins, begins[1:]):
                if j - i >= self.width:
                    out.append(np.unique(grams[i : j - self.width + 1]))
                elif j > i:
                    whole = np.full(1, j - i, np.uint64)
                    for h in hashes[i:j]:
                        whole = (whole ^ h) * np.uint64(BASE)
                    out.append(mix64(whole))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """A 16-bit register a bucket: the smallest hash there, as leading zeros and mantissa; 0: none."""
        width = (1 << 64) // self.buckets
        begin = np.arange(self.buckets, dtype=np.uint64) * np.uint64(width)
        at = np.searchsorted(shingles, begin)
        end = np.append(at[1:], len(shingles))
        out = np.zeros(self.buckets, np.uint16)
        full = np.flatnonzero(end > at)
        least = shingles[at[full]] - begin[full]
        _, digits = np.frexp((least >> np.uint64(4)).astype(np.float64))  # binary digits of a number below 2**53
        digits = np.maximum(digits, MANTISSA + 1)
        mantissa = (least >> np.uint64(4) >> (digits - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
        out[full] = ((digits - MANTISSA).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
        return out

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """A 64-bit key a band; bands without a register are left out."""
        r = registers.reshape(self.bands, self.rows)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            keys = mix64(keys * np.uint64(BASE) + r[:, k].astype(np.uint64))
        return keys[r.any(axis=1)]

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        small, large = sorted((len(x), len(y)))
        if 100 * small < self.percent * large:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def plausible(self, regs: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Which rows of regs may be linked with `one`: the estimate, corrected for chance matches,
        lies less than six standard errors below the bound."""
        bound = self.percent / 100
        used = (one != 0) | (regs != 0)
        count = np.maximum(used.sum(axis=-1), 1)
        same = ((regs == one) & used).sum(axis=-1)
        estimate = (same - CHANCE * count) / (count * (1 - CHANCE))
        return estimate >= bound - 6 * np.sqrt(bound * (1 - bound) / count)

    def forest(self, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect whatever any links would, between items of different labels, and sides if there are two.

        Pairs that aren't plausible are not verified, nor are pairs that are connected already.
        Items that resemble many come first.
        """
        n, label = len(sets), label.copy()
        regs = np.array([self.registers(s) for s in sets])
        sizes = np.array([len(s) for s in sets])
        cross = len(np.unique(side)) > 1
        maybe = np.zeros((n, n), bool)
        for i in range(n):
            maybe[i] = (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= self.percent * np.maximum(sizes, sizes[i]))
            if cross:
                maybe[i] &= side != side[i]
            some = np.flatnonzero(maybe[i])
            maybe[i, some] = self.plausible(regs[some], regs[i])
        edges = []
        for i in np.argsort(-maybe.sum(1), kind="stable"):
            for j in np.flatnonzero(maybe[i] & (label != label[i])):
                if label[j] != label[i] and self.linked(sets[i], sets[j]):
                    edges.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
        return edges

    def signatures(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, a 128-bit digest of the set in d1 and d2, and its registers."""

        def sign(batches):
            import hashlib

            for batch in batches:
                rows = []
                for doc_id, s in zip(batch.doc_id, self.shingle_sets(batch.text.fillna("").tolist())):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    rows.append((doc_id, len(s), d[0], d[1], self.registers(s).tobytes() if len(s) else b""))
                out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "d1", "d2", "registers"])
                out["doc_id"] = out.doc_id.astype("Int64")
                yield out

        schema = "doc_id long, n_shingles long, d1 long, d2 long, registers binary"
        return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(sign, schema)

    def keys(self, unique: DataFrame) -> DataFrame:
        """(node, key): a row for each band of (node, registers)."""

        def band(batches):
            for batch in batches:
                each = [self.band_keys(np.frombuffer(r, np.uint16)) for r in batch.registers]
                if each:
                    yield pd.DataFrame({"node": np.repeat(batch.node.to_numpy(), [len(k) for k in each]), "key": np.concatenate(each).view(np.int64)})

        return unique.select("node", "registers").mapInPandas(band, "node long, key long")

    def plausible_stars(self, stars: DataFrame, registers: DataFrame) -> DataFrame:
        """(hub, node, near) for distinct (hub, node): whether they may be linked."""

        def judge(batches):
            for batch in batches:
                x = np.frombuffer(b"".join(batch.rx), np.uint16).reshape(-1, self.buckets)
                y = np.frombuffer(b"".join(batch.ry), np.uint16).reshape(-1, self.buckets)
                yield batch[["hub", "node"]].assign(near=self.plausible(x, y))

        d = stars.join(registers.select("node", F.col("registers").alias("rx")), "node")
        d = d.join(registers.select(F.col("node").alias("hub"), F.col("registers").alias("ry")), "hub")
        return d.select("hub", "node", "rx", "ry").mapInPandas(judge, "hub long, node long, near boolean")

    def facing(self, rows: DataFrame, key: str) -> DataFrame:
        """rows (key, node, rest and more) dealt into tasks, with side: what is rest is held against all of its key.

        Small keys share tasks. A larger key's rows are in parts, and so is its rest; each part of
        the rest meets each part of all rows. Rows are copied once a part of the rest, which is
        small where a hub has settled most of them.
        """
        sizes = materialize(rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if("rest").alias("left")).where("n > 1 AND left > 0"), "minhash-sizes")
        total = sizes.where(f"n <= {PART}").agg(F.sum("n")).first()[0] or 0
        parts = sizes.select(key, F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.ceil(F.col("left") / PART).cast("int").alias("rests"))
        d = rows.join(parts.hint("merge"), key)
        sequence = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
        alone = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side")))
        every = F.transform(sequence("rests"), lambda i: F.struct(i.alias("i"), place("parts", 0).alias("j"), F.lit(1).alias("side")))
        rest = F.transform(sequence("parts"), lambda j: F.struct(place("rests", 1).alias("i"), j.alias("j"), F.lit(0).alias("side")))
        where = F.when(F.col("parts") == 1, alone).when(F.col("rest"), F.concat(every, rest)).otherwise(every)
        d = d.withColumn("_t", F.explode(where)).withColumn("side", F.col("_t.side"))
        bundle = F.when(F.col("parts") == 1, F.pmod(F.xxhash64(key), F.lit(1 + total // PART))).otherwise(F.col(key))
        return d.withColumn("task", F.struct(bundle.alias("key"), F.col("_t.i").alias("i"), F.col("_t.j").alias("j"))).drop("_t", "parts", "rests")

    def crowds(self, rows: DataFrame, registers: DataFrame) -> DataFrame:
        """Edges (a, b) that connect what plausible links would, among the nodes of each key of (key, node, hub, rest).

        Nodes that aren't rest are connected with the hub already.
        """
        d = self.facing(rows, "key").join(registers, "node").withColumn("label", F.when(F.col("rest"), F.col("node")).otherwise(F.col("hub")))

        def connect(batch: pd.DataFrame) -> pd.DataFrame:
            edges = []
            for _, group in batch.groupby("key", sort=True):
                group = group.sort_values(["node", "side"], kind="stable")
                nodes, side, label = group.node.to_numpy(), group.side.to_numpy(), group.label.to_numpy().copy()
                regs = np.frombuffer(b"".join(group.registers), np.uint16).reshape(-1, self.buckets)
                cross = len(np.unique(side)) > 1
                for i in np.flatnonzero(group.rest.to_numpy() & (side == 0)):
                    some = np.flatnonzero((label != label[i]) & ((side != side[i]) if cross else True))
                    near = some[self.plausible(regs[some], regs[i])]
                    _, others = np.unique(label[near], return_index=True)
                    edges += [(nodes[i], nodes[j]) for j in near[others]]
                    label[np.isin(label, label[near])] = label[i]
            return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

        return d.select("task", "key", "node", "side", "rest", "label", "registers").groupBy("task").applyInPandas(connect, "a long, b long")

    def blobs(self, unique: DataFrame) -> DataFrame:
        """(node, blob) for nodes that may have links: any two that do are in one blob.

        Where a band's key is equal, each node is held against the smallest one. If all may be
        linked with that, it connects them; else those that may not are held against all nodes of
        the key, in parts. So texts that only share a passage don't grow together.
        """
        registers = unique.select("node", "registers")
        keys = self.keys(unique)
        hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
        members = materialize(keys.join(hubs, "key").select("key", "hub", "node"), "minhash-keys")
        stars = members.where("node <> hub").select("hub", "node").distinct()
        judged = materialize(self.plausible_stars(stars, registers), "minhash-stars")
        told = members.join(judged, ["hub", "node"], "left").select("key", "hub", "node", (~F.coalesce("near", F.lit(True))).alias("rest"))
        crowd = self.crowds(materialize(told, "minhash-told"), registers)
        edges = judged.where("near").select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(crowd)
        return connected_components(edges).select("node", F.col("component").alias("blob"))

    def tasks(self, members: DataFrame) -> DataFrame:
        """members (node, d1, d2, blob) with the part of its blob that each is in, and of how many."""
        sizes = members.groupBy("blob").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        d = members.join(sizes, "blob")
        return d.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def member_sets(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """The sets of members, made again from the texts of documents with those ids."""

        def make(batches):
            import hashlib

            for batch in batches:
                keep, sets = [], []
                for d1, d2, s in zip(batch.d1, batch.d2, self.shingle_sets(batch.text.fillna("").tolist())):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    keep.append(bool(d[0] == d1 and d[1] == d2))
                    if keep[-1]:
                        sets.append(s.tobytes())
                yield batch.loc[keep, ["node", "blob", "part", "parts"]].assign(shingles=sets)

        # members grow with the documents, so this is a shuffle join at every size
        joined = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(members.hint("merge"), "node")
        joined = joined.select("node", "blob", "part", "parts", "d1", "d2", "text")
        return joined.mapInPandas(make, "node long, blob long, part int, parts int, shingles binary")

    def links(self, sets: DataFrame, members: int) -> DataFrame:
        """Edges (a, b) that connect each blob's documents as all its links would.

        First each part of a blob is connected within itself and with the blob's first document. Where
        that leaves a blob in pieces, what isn't connected with the first document is held against all.
        """
        tasks = max(1, math.ceil(members / PART))
        first = sets.groupBy("blob").agg(F.min("node").alias("hub"))
        d = sets.join(first.hint("merge"), "blob")
        there = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
        small = F.struct(F.pmod(F.xxhash64("blob"), F.lit(tasks)).alias("key"), F.lit(-1).alias("part"))
        d = d.withColumn("at", F.explode(there)).withColumn("task", F.when(F.col("parts") == 1, small).otherwise(F.struct(F.col("blob").alias("key"), F.col("at").alias("part"))))

        def verify(batch: pd.DataFrame) -> pd.DataFrame:
            edges = []
            batch = batch.sort_values(["blob", "node", "side"], kind="stable").drop_duplicates(["node", "side", "shingles"])
            for _, group in batch.groupby("blob", sort=False):
                nodes = group.node.to_numpy()
                found = [np.frombuffer(s, np.uint64) for s in group.shingles]
                edges += [(nodes[i], nodes[j]) for i, j in self.forest(found, group.side.to_numpy(), group.label.to_numpy())]
            return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

        columns = ["node", "blob", "shingles", "side", "label", "task"]
        within = d.withColumns({"side": F.lit(0), "label": F.col("node")}).select(columns).groupBy("task").applyInPandas(verify, "a long, b long")
        within = materialize(within, "minhash-within")
        large = sets.where("parts > 1")
        if not large.limit(1).count():
            return within
        labels = connected_components(within).withColumnRenamed("component", "label")
        d = large.select("node", "blob").distinct().join(first.hint("merge"), "blob").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        d = materialize(d.select("node", "blob", "label", (F.col("label") != F.col("hub")).alias("rest")), "minhash-pieces")
        across = self.facing(d, "blob").join(sets.select("node", "shingles").hint("merge"), "node")
        return within.unionByName(across.select(columns).groupBy("task").applyInPandas(verify, "a long, b long"))

    def classes(self, docs: DataFrame) -> DataFrame:
        """A row a document: doc_id, n_shingles, component_id, kept.

        Null and empty texts have no shingle and link with nothing; so does a row with a null id,
        which has a null component and is kept. Rows that share an id share a component, and
        repeated rows are all kept or all not. An empty table gives no rows; columns other than
        doc_id and text are not read. Equal sets count as one; the others meet where a band's key
        is equal, each what may be linked there by its registers is verified on full sets.
        """
        signed = materialize(self.signatures(docs), "minhash-signatures")
        usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        unique = materialize(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("registers").alias("registers")), "minhash-unique")
        blobs = materialize(self.blobs(unique), "minhash-blobs")
        members = materialize(self.tasks(unique.select("node", "d1", "d2").join(blobs, "node")), "minhash-members")
        sets = materialize(self.member_sets(docs, members), "minhash-sets")
        parts = connected_components(materialize(self.links(sets, members.count()), "minhash-links"))
        found = unique.select("d1", "d2", "node").join(parts, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("found"))
        d = signed.drop("registers").join(found, ["d1", "d2"], "left")
        alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
        component = F.when(alone, F.col("doc_id")).otherwise(F.col("found"))
        d = d.select("doc_id", "n_shingles", component.alias("component_id"))
        return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, method: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of docs but for near copies: of each group the row with the smallest id stays."""
    gone = method.classes(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op6_minhash(spark, sf_dir):
    return NearDuplicates().classes(table(spark, sf_dir, "documents"))
