"""Exact repeated byte strings by a suffix sort whose comparisons are made on prefix hashes.

A string of `length` bytes that occurs twice holds the same least k-gram (its anchor) at the same
place both times. So suffixes are sorted only around anchors that occur more than once: the
contexts of an anchor, that is the bytes within which such a string can hold it, are sorted by what
follows the anchor and by what precedes it (backwards). Common extensions are found by binary
search on prefix polynomial hashes and verified on the bytes.
"""

from __future__ import annotations

import hashlib
import math
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_VALUES, discard, materialize, mix64, prefix_hashes, range_hashes, slabs, table

#: Length of anchors: the longer, the fewer contexts; the shorter, the fewer anchors.
GRAM = 64
#: Distinct contexts of an anchor that are sorted together; more are first dealt out by more bytes.
GROUP = 20_000
#: Contexts a task works on, in many anchors.
TASK = 20_000


def anchors(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the anchors of all strings of `length` bytes that don't cross begins."""
    grams = len(data) - GRAM + 1
    if grams <= length - GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hashes(_BYTE_VALUES[data])
    place = np.arange(grams)
    hashes = mix64(range_hashes(prefix, place, place + GRAM))
    # sliding minimum over length - GRAM + 1 grams, the leftmost of equals; a slab has less than 2**32 places
    key = (hashes & ~np.uint64((1 << 32) - 1)) | place.astype(np.uint64)
    span, width = length - GRAM + 1, 1
    least = key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.ones(len(least), bool)
    for b in begins[1:]:
        inside[max(0, b - length + 1) : b] = False
    at = (least[inside] & np.uint64((1 << 32) - 1)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at  # they only move on
    return at, hashes[at]


def common_prefix(prefix: np.ndarray, text: bytes, i: int, j: int, most: int) -> int:
    """Length of the longest common prefix, up to most, of text from i and from j; checked on the bytes."""
    down = _DOWN
    lo, hi = 0, most
    a, b = prefix[i], prefix[j]
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        # equal strings have equal hashes once both are moved to place 0
        if (prefix[i + mid] - a) * down[i] & _ALL == (prefix[j + mid] - b) * down[j] & _ALL:
            lo = mid
        else:
            hi = mid - 1
    while lo and text[i : i + lo] != text[j : j + lo]:  # a collision: step back to where the bytes agree
        lo -= 1
    return lo


_ALL = (1 << 64) - 1
_DOWN: list[int] = [1]


def _prefix_list(text: bytes) -> list[int]:
    from .common import POWERS

    out = prefix_hashes(_BYTE_VALUES[np.frombuffer(text, np.uint8)]).tolist()
    if len(_DOWN) < len(out):
        _DOWN[:] = POWERS.get(len(out))[1].tolist()
    return out


def sorted_suffixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it in that order.

    Merge sort (Python's) with comparisons in logarithmic time by common_prefix.
    """
    text, at = b"".join(strings), [0]
    for s in strings:
        at.append(at[-1] + len(s))
    prefix = _prefix_list(text)

    def extension(x: int, y: int) -> int:
        return common_prefix(prefix, text, at[x], at[y], min(at[x + 1] - at[x], at[y + 1] - at[y]))

    def compare(x: int, y: int) -> int:
        n = extension(x, y)
        endx, endy = at[x] + n == at[x + 1], at[y] + n == at[y + 1]
        if endx or endy:
            return (not endx) - (not endy) or x - y
        return -1 if text[at[x] + n] < text[at[y] + n] else 1

    order = sorted(range(len(strings)), key=cmp_to_key(compare))
    return order, [0] + [extension(x, y) for x, y in zip(order, order[1:])]


def repeated_starts(left: list[bytes], right: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For contexts of one anchor: ranges (lo, hi) of how far before it a repeated string starts.

    left: what precedes the anchor, backwards; right: the anchor and what follows. A string that
    starts l before the anchor is shared with another context iff they agree on l bytes before it
    and length - l from it. Contexts that agree on d bytes before it lie together in the order of
    left; in such a range, neighbours in the order of right have the longest agreement after it.
    """
    n = len(left)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        before, after = (sorted_suffixes(x)[1][1] for x in (left, right))
        if length - after <= before:
            found[0] = found[1] = [(max(0, length - after), before)]
        return found
    order_l, common_l = sorted_suffixes(left)
    order_r, common_r = sorted_suffixes(right)
    rank = [0] * n
    for k, x in enumerate(order_r):
        rank[x] = k
    stack = [(0, n, 0)]
    while stack:
        lo, hi, _ = stack.pop()
        if hi - lo < 2:
            continue
        inner = common_l[lo + 1 : hi]
        depth = min(inner)
        ranked = sorted(rank[x] for x in order_l[lo:hi])
        least = [min(common_r[a + 1 : b + 1]) for a, b in zip(ranked, ranked[1:])]
        for k, r in enumerate(ranked):
            after = max(least[k - 1] if k else 0, least[k] if k < len(least) else 0)
            if length - after <= depth:
                found[order_r[r]].append((max(0, length - after), depth))
        begin = lo
        for k, c in enumerate(inner, lo + 1):
            if c == depth:
                stack.append((begin, k, depth))
                begin = k
        stack.append((begin, hi, depth))
    return found


def spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class RepeatedStrings:
    """Marks every byte in a string of `length` bytes that also starts anywhere else in the table."""

    def __init__(self, length: int = 200) -> None:
        self.length = length
        self.margin = length - GRAM  # how far before an anchor a string with it can start

    def find_anchors(self, docs: DataFrame) -> DataFrame:
        """anchor, short, at: the anchors of each text of (short, text), text in bytes."""

        def find(batches):
            for batch in batches:
                raw = batch.text.tolist()
                for a, b in slabs([len(t) for t in raw]):
                    begins = np.cumsum([0, *map(len, raw[a : b - 1])])
                    at, hashes = anchors(np.frombuffer(b"".join(raw[a:b]), np.uint8), begins, self.length)
                    doc = np.searchsorted(begins, at, side="right") - 1
                    yield pd.DataFrame({"anchor": hashes.view(np.int64), "short": batch.short.to_numpy()[a + doc], "at": (at - begins[doc]).astype(np.int32)})

        return docs.select("short", "text").mapInPandas(find, "anchor long, short long, at int")

    def contexts(self, texts: DataFrame) -> DataFrame:
        """anchor, row, at, digest: of the bytes around each anchor of (row, text, x of (at, anchor)).

        64 bits of a digest, which only tell contexts of one anchor apart.
        """

        def cut(batches):
            for batch in batches:
                rows, digests = [], []
                for row, raw, found in zip(batch["row"], batch.text, batch.x):
                    for f in found:
                        at = f["at"]
                        begin = max(0, at - self.margin)
                        rows.append((f["anchor"], row, at))
                        digests.append(hashlib.md5(b"%d|" % (at - begin) + raw[begin : at + self.length]).digest()[:8])
                out = pd.DataFrame(rows, columns=["anchor", "row", "at"])
                out["digest"] = np.frombuffer(b"".join(digests), np.int64)
                for k in range(0, len(out), 50_000):
                    yield out[k : k + 50_000]

        return texts.select("row", "text", "x").mapInPandas(cut, "anchor long, row long, at int, digest long")

    def with_bytes(self, contexts: DataFrame, texts: DataFrame) -> DataFrame:
        """contexts (row, at and more) with their bytes as context, and left: how many precede the anchor."""
        d = contexts.join(texts.select("row", "text"), "row").withColumn("left", F.least("at", F.lit(self.margin)))
        return d.withColumn("context", F.expr(f"substring(text, at - left + 1, left + {self.length})")).drop("text", "row", "at")

    def sort_contexts(self, distinct: DataFrame) -> DataFrame:
        """anchor, digest, lo, hi from (key, anchor, digest, context, left): strings that contexts of one key share."""

        def sort(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, group in batch.sort_values(["key", "anchor", "digest"]).groupby("key", sort=False):
                if len(group) < 2:
                    continue
                both = list(zip(group.context, group["left"]))
                left = [c[:k][::-1] for c, k in both]
                right = [c[k:] for c, k in both]
                for anchor, digest, ranges in zip(group.anchor, group.digest, repeated_starts(left, right, self.length)):
                    out += [(anchor, digest, lo, hi) for lo, hi in spans([(lo, hi + 1) for lo, hi in ranges])]
            return pd.DataFrame(out, columns=["anchor", "digest", "lo", "hi"])

        return distinct.groupBy("task").applyInPandas(sort, "anchor long, digest long, lo int, hi int")

    def dealt(self, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For anchors with too many contexts: (key, anchor, digest, context, left) in groups that can be sorted; and ranges.

        A string around an anchor has half of its other bytes, or more, before it or behind it. So
        contexts with the same such half go together, once for each side; where they are still too
        many, the next half of what is left of the string parts them, until nothing is left: then
        they hold the same string, and ranges says where.
        """
        rest, groups = self.margin, None
        rows = contexts.withColumns({"key": F.col("anchor"), "before": F.lit(0), "behind": F.lit(0)})
        while True:
            rows = materialize(rows, "suffix-dealt")
            sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "suffix-sizes")
            some = rows.join(sizes.where(f"n <= {GROUP}").select("key").hint("merge"), "key").select("key", "anchor", "digest", "context", "left")
            groups = some if groups is None else groups.unionByName(some)
            rows = rows.join(sizes.where(f"n > {GROUP}").select("key").hint("merge"), "key", "left_semi")
            if not rest or not rows.limit(1).count():
                break
            half = -(-rest // 2)
            rest -= half
            onward = F.expr(f"substring(context, left + {GRAM} + behind + 1, {half})")
            onward = rows.where(f"length(context) - left - {GRAM} - behind >= {half}").withColumn("key", F.xxhash64("key", F.lit("behind"), onward)).withColumn("behind", F.col("behind") + half)
            back = F.expr(f"substring(context, left - before - {half} + 1, {half})")
            back = rows.where(f"left - before >= {half}").withColumn("key", F.xxhash64("key", F.lit("before"), back)).withColumn("before", F.col("before") + half)
            rows = onward.unionByName(back)
        rows = rows.withColumn("string", F.expr(f"substring(context, left - before + 1, {self.length})")).select("key", "string", "anchor", "digest", "before")
        rows = materialize(rows, "suffix-strings")
        shared = materialize(rows.groupBy("key", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-shared")
        same = rows.join(shared.hint("merge"), ["key", "string"]).select("anchor", "digest", F.col("before").alias("lo"), (F.col("before") + 1).alias("hi"))
        return groups, same

    def removed(self, docs: DataFrame) -> DataFrame:
        """(key, text, whole, marks) of (key, short, text), for texts with anything to remove.

        whole: all of it, as another row has the same text; marks: of its contexts, with the ranges
        in which strings start before the anchor, or null for all that fit.

        key is 128 bits of the text's digest; short, with fewer bits, only narrows the first pass.
        """
        found = materialize(self.find_anchors(docs), "suffix-anchors")
        # written, so that the join sees two shuffles and can split a frequent anchor
        often = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-often")
        by_text = found.join(often.hint("merge"), "anchor").groupBy("short").agg(F.collect_set(F.struct("at", "anchor")).alias("x"))
        texts = docs.groupBy("short", "key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        likely = texts.join(by_text, "short").drop("short").withColumn("row", F.monotonically_increasing_id())
        likely = materialize(likely, "suffix-likely")
        discard(found)
        discard(often)

        around = materialize(self.contexts(likely), "suffix-contexts")
        distinct = around.groupBy("anchor", "digest").agg(F.first(F.struct("row", "at")).alias("one"), F.count("*").alias("n"))
        distinct = materialize(distinct.select("anchor", "digest", "one.*", "n"), "suffix-distinct")
        sizes = distinct.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("fewest"))
        sizes = materialize(sizes.where("contexts > 1 AND fewest = 1"), "suffix-sizes")
        usual, hot = sizes.where(F.col("contexts") <= GROUP), sizes.where(F.col("contexts") > GROUP)
        tasks = math.ceil((usual.agg(F.sum("contexts")).first()[0] or 0) / TASK)
        tasks = max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        few = self.with_bytes(distinct.join(usual.select("anchor"), "anchor"), likely).withColumn("key", F.col("anchor"))
        columns = ["key", "anchor", "digest", "context", "left"]
        few, same = few.select(columns), None
        if hot.limit(1).count():
            many, same = self.dealt(self.with_bytes(distinct.join(hot.select("anchor"), "anchor"), likely).select(columns[1:]))
            few = few.unionByName(many)
        ranges = self.sort_contexts(few.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))))
        ranges = ranges if same is None else ranges.unionByName(same)
        ranges = ranges.groupBy("anchor", "digest").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
        ranges = materialize(ranges, "suffix-ranges")
        once = distinct.where("n = 1").select("anchor", "digest").join(ranges, ["anchor", "digest"])
        # a context that occurs again is repeated wherever a whole string fits in it
        again = distinct.where("n > 1").select("anchor", "digest", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("ranges"))
        said = materialize(again.unionByName(once), "suffix-said")
        each = around.join(said.hint("merge"), ["anchor", "digest"]).groupBy("row").agg(F.collect_list(F.struct("at", "ranges")).alias("marks"))
        each = materialize(each, "suffix-marks")
        whole = (F.col("n") > 1) & (F.length("text") >= self.length)
        return likely.join(each, "row", "left").select("key", "text", whole.alias("whole"), "marks").where("marks IS NOT NULL OR whole")

    def covered(self, raw: bytes, marks) -> list[tuple[int, int]]:
        """What strings that start b before an anchor, lo <= b < hi, cover together."""
        out = []
        for m in marks:
            at = m["at"]
            left = min(at, self.margin)
            if m["ranges"] is not None:
                out += [(at - r["hi"] + 1, at - r["lo"] + self.length) for r in m["ranges"]]
            elif (lo := max(0, at + self.length - len(raw))) <= left:
                out.append((at - left, at - lo + self.length))
        return out

    def clean(self, docs: DataFrame) -> DataFrame:
        """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

        Null text counts as empty; texts shorter than the length lose nothing; repeated rows are
        repeats of each other; a null id stays null; an empty table gives no rows; columns other
        than doc_id and text are not read.
        """
        text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
        key = F.unhex(F.md5(text))

        def cut(batches):
            for batch in batches:
                rows = []
                for key, raw, whole, marks in zip(batch.key, batch.text, batch.whole, batch.marks):
                    gone = [(0, len(raw))] if whole is True else spans(self.covered(raw, marks))
                    ends = [0, *(e for _, e in gone)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends, [*(b for b, _ in gone), len(raw)]))
                    rows.append((key, len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "kept"])

        marked = self.removed(docs.select(key.alias("key"), F.xxhash64(text).alias("short"), text.alias("text")))
        done = marked.select("key", "text", "whole", "marks").mapInPandas(cut, "key binary, n_removed long, n_spans long, kept string")
        all_of_them = docs.select("doc_id", key.alias("key"), F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"))
        none = F.lit(0).cast("long")
        return all_of_them.join(done, "key", "left").select(
            "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256")
        )


def op9_suffix_array(spark, sf_dir):
    return RepeatedStrings().clean(table(spark, sf_dir, "documents"))
