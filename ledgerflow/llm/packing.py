"""Best-fit packing of tokenized documents, each partition certified by a lower bound on its bins."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import VOCABULARY, Encoder

#: Pieces a partition packs together: enough that best-fit decreasing leaves hardly a gap.
GROUP = 20_000
ROUNDS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, offset long, fill long, bins long, bound long, grp long"


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row a piece: each document's ids and end_id; longer ones cut so that only the first piece is short."""

    def tokenize(batches):
        encoder = Encoder.of(vocabulary)
        end = np.array([end_id], np.int32)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.doc_id, encoder.encode(batch.text.fillna("").tolist())):
                ids = np.concatenate([ids, end]).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tokenize, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions: no packing has fewer bins.

    The plain sum; sizes above capacity - e counted whole and those below e not at all, for every
    e; and sizes rounded to multiples of 1/k where k + 1 of them would not fit.
    """
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    count, total = np.cumsum(n), np.cumsum(n * size)
    for e in range(1, capacity // 2 + 1):
        large = count[-1] - count[capacity - e]
        middle = total[capacity - e] - total[e - 1]
        best = max(best, int(large) - (-int(middle) // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity): exact multiples keep their size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, which come in falling order; the fullest bin that fits is used."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes, n = 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = free_sizes >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                free_sizes &= ~(1 << free)
        else:
            free, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            open_bins[left].append(b)
            free_sizes |= 1 << left
    return bins, offsets


def _pack_groups(rows: DataFrame, items: int, capacity: int) -> DataFrame:
    """Packs each of ceil(items / GROUP) groups of rows; rows go to groups by place, not by value."""
    groups = max(1, math.ceil(items / GROUP))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = batch["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return batch.assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=lower_bound(lengths, capacity))[[c.split()[0] for c in PLACED.split(", ")]]

    placed = rows.select(*[c.split()[0] for c in PIECES.split(", ")]).withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return placed.groupBy("grp").applyInPandas(pack, PLACED)


def _counts(placed: DataFrame, *more) -> dict:
    per_group = placed.groupBy("grp").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    return per_group.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first().asDict()


def pack_documents(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty, and so is its end id alone; repeated rows are packed one by one; a
    null id stays null; an empty table gives no rows; columns other than doc_id and text are not read.

    Full pieces are sequences of their own. The others are packed in groups; where a group has more
    bins than its certified bound, the documents of its bins that aren't full are exchanged among
    all such groups and packed anew, as long as that saves bins.
    """
    cut = materialize(pieces(docs, capacity, **options), "packing-pieces")
    names = [c.split()[0] for c in PIECES.split(", ")]
    full = cut.where(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity)
    placed = materialize(_pack_groups(rest, rest.count(), capacity), "packing-0")
    number = lambda round_: ((F.lit(round_ << 20) + F.col("grp")) * (1 << 32) + F.col("bin")) * 2
    out = full
    for round_ in range(ROUNDS):
        loose = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        exchanged = placed.where(loose)
        had = exchanged.agg(F.count("*").alias("items"), F.countDistinct("grp", "bin").alias("bins")).first()
        if round_ == ROUNDS - 1 or had["bins"] < 2:
            break
        again = materialize(_pack_groups(exchanged, had["items"], capacity), f"packing-{round_ + 1}")
        if _counts(again)["bins"] >= had["bins"]:
            break
        out = out.unionByName(placed.where(~loose).select(*names, number(round_).alias("sequence_id"), "offset"))
        placed = again
    return out.unionByName(placed.select(*names, number(round_).alias("sequence_id"), "offset"))


def op5_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
