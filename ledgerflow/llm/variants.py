"""Spelling variants: words one edit apart, by a bit-sliced index of their letters, and the form that each stands for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, discard, materialize, table

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A task hands its counts on at so many words, so that its memory is bounded.
ENTRIES = 400_000
#: Groups of one key are indexed together up to so many words; larger ones are split by longer keys.
GROUP = 4096
#: Small groups share an index of about so many words; states of so many 64-bit words are worked on at once.
PACK, STATES = 1024, 1 << 18
#: Hot keys beyond so many are joined by shuffle.
HOT_KEYS = 100_000


class _Counter:
    """Counts of lower-cased runs over batches of documents, for mapInArrow."""

    def __init__(self, min_length: int, every: int):
        self.min_length, self.every = min_length, every

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = re.compile(f"[a-zÀ-ÿ]{{{self.min_length},}}").findall
        every, total = self.every, Counter()

        def flush():
            found = {w: n for w, n in total.items() if n and len(w) >= self.min_length}
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                runs = runs_of(text.encode().translate(_LOWER).decode())
                total.update(runs)
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                hit = [r for r in set(runs) if crc32(r.encode(), start) % every == 0]
                if hit:
                    n = Counter(runs)
                    for run in hit:
                        at = crc32(run.encode(), start) % len(run)
                        total[run] -= n[run]
                        total[run[:at] + run[at + 1 :]] += n[run]
                if len(total) >= ENTRIES:
                    yield flush()
                    total.clear()
        yield flush()


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    """Columns of flags (members x letters) as rows of a bitset over the members."""
    packed = np.packbits(flags, axis=0, bitorder="little").T
    out = np.zeros((packed.shape[0], words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def near_pairs(words: list[str], group: np.ndarray, c: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (i, j) of near words of one group whose first difference lies in [lo, hi).

    Words have c or c + 1 letters; those of c are looked up, the others only found. For each
    position and letter a bitset has the members with that letter there. Three sets of members are
    carried along a word: those equal so far, those with one letter replaced, and those with one
    letter more, which are read one position further on. One word's step serves 64 members at once.
    """
    size = len(words)
    width = -(-size // 64)
    letters = np.array(words, f"U{c + 1}").view(np.uint32).reshape(size, c + 1)
    known, codes = np.unique(letters, return_inverse=True)
    codes = codes.reshape(size, c + 1)
    long = letters[:, c] != 0
    alphabet = np.arange(len(known))
    index = lambda i: _bits(codes[:, i, None] == alphabet, width)
    of_length = _bits(np.stack([~long, long], 1), width)
    names, member = np.unique(group, return_inverse=True)
    same = _bits(member[:, None] == np.arange(len(names)), width) if len(names) > 1 else np.full((1, width), ~np.uint64(0))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    asked = np.flatnonzero(~long)
    step = max(1, STATES // width)
    for at in range(0, len(asked), step):
        q = asked[at : at + step]
        equal = same[member[q]]
        replaced, longer = np.zeros_like(equal), np.zeros_like(equal)
        before = after = None
        here = index(0)
        for i in range(c):
            if i == lo:
                before = equal
            if i == hi:
                after = equal
            ahead, x = index(i + 1), codes[q, i]
            hit = here[x]
            replaced = (replaced & hit) | (equal & ~hit)
            longer = (longer | equal) & ahead[x]
            equal = equal & hit
            here = ahead
        found = ((replaced & of_length[0]) | ((longer | equal) & of_length[1])) & before
        if after is not None:
            found &= ~after
        row, word = np.nonzero(found)
        k, bit = np.nonzero(np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = q[row[k]], word[k] * 64 + bit
        more = long[b]
        pairs += [(a, b), (b[more], a[more])]
    return (np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])) if pairs else (np.zeros(0, np.int64),) * 2


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _pack(part: dict[str, np.ndarray]) -> pa.RecordBatch:
    words = part["word"].tolist()
    a, b = near_pairs(words, part["key"], *(int(part[k][0]) for k in ("c", "lo", "hi")))
    n_near = np.bincount(a, minlength=len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, a, b)  # members of a group come with the largest n first
    some = np.flatnonzero(n_near)
    return pa.RecordBatch.from_arrays([pa.array(part["word"][some], pa.string()), pa.array(n_near[some], pa.int64()), pa.array(part["word"][best[some]], pa.string()), pa.array(part["n"][best[some]], pa.int64())], schema=_NEAR)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (c, lo, hi, key, n descending, word), worked on in packs of whole groups."""
    names = ["c", "lo", "hi", "key", "word", "n"]
    held: dict[str, np.ndarray] | None = None

    def packs(rows: dict[str, np.ndarray]):
        size = len(rows["key"])
        new = np.ones(size, bool)
        new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["c"][1:] != rows["c"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1])
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, size))
        rows = {k: v[np.repeat(sizes > 1, sizes)] for k, v in rows.items()}  # a word alone has no near ones
        sizes = sizes[sizes > 1]
        ends = np.cumsum(sizes)
        kind = np.stack([rows[k][ends - sizes] for k in ("c", "lo", "hi")]) if len(ends) else np.zeros((3, 0))
        i = 0
        while i < len(ends):
            j, first = i + 1, ends[i] - sizes[i]
            while j < len(ends) and ends[j] - first <= PACK and (kind[:, j] == kind[:, i]).all():
                j += 1
            yield {k: v[first : ends[j - 1]] for k, v in rows.items()}
            i = j

    for batch in batches:
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        if held is not None:
            rows = {k: np.concatenate([held[k], rows[k]]) for k in names}
        if not len(rows["key"]):
            continue
        last = (rows["key"] == rows["key"][-1]) & (rows["c"] == rows["c"][-1]) & (rows["lo"] == rows["lo"][-1])
        whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        held = {k: v[whole:] for k, v in rows.items()}
        for part in packs({k: v[:whole] for k, v in rows.items()}):
            yield _pack(part)
    if held is not None:
        for part in packs(held):
            yield _pack(part)


class SpellingVariants:
    """Words, the words one edit away, and the form that each word is a variant of.

    Words are runs of ASCII and Latin-1 letters, of which only A-Z are lower-cased. A null or empty
    text has none; a null doc_id counts as ''; repeated rows count each; runs of any length are
    whole words; equal counts are decided by code-point order; an empty table gives no rows; other
    columns are not read.
    """

    def __init__(self, min_length: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199):
        self.min_length, self.min_count, self.ratio, self.every = min_length, min_count, ratio, every

    def vocabulary(self, docs: DataFrame) -> DataFrame:
        """(word, n): words of min_length letters that occur min_count times. Of one (document, run) in `every`, a letter is dropped first."""
        counts = docs.select("doc_id", "text").mapInArrow(_Counter(self.min_length, self.every), "word string, n long")
        return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_count)

    def keyed(self, words: DataFrame) -> DataFrame:
        """Words under keys such that each near pair shares exactly one key with its first difference in the key's [lo, hi).

        Of a pair whose shorter word has c letters, the letters before lo and the last c - hi are
        equal if the first difference lies in [lo, hi). Keys are those letters, for the halves of
        c; where too many words share one, its span is halved again, down to one position.
        """
        size = F.char_length("word")
        d = words.withColumn("c", F.explode(F.array_compact(F.array(size, F.when(size > self.min_length, size - 1)))))
        half = F.expr("c div 2").cast("int")
        span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
        key = F.expr("xxhash64(c, lo, hi, left(word, lo), right(word, c - hi))").alias("key")
        with_key = lambda d, spans: d.withColumn("s", F.explode(F.array(*spans))).select("word", "n", "c", "s.lo", "s.hi").select("*", key)
        d, parts = with_key(d, [span(F.lit(0), half), span(half, F.col("c"))]), []
        while True:
            hot = materialize(d.groupBy("key").agg(F.count("*").alias("members"), F.max(F.col("hi") - F.col("lo")).alias("span")).where(f"members > {GROUP} AND span > 1").select("key"), "variants-hot")
            if not hot.limit(1).count():
                return d if not parts else _union([*parts, d])
            hot = broadcast_up_to(hot, HOT_KEYS)
            parts.append(d.join(hot, "key", "left_anti").select(*d.columns))
            middle = F.expr("(lo + hi) div 2")
            d = materialize(with_key(d.join(hot, "key", "left_semi").drop("key"), [span(F.col("lo"), middle), span(middle, F.col("hi"))]), "variants-keys")

    def near(self, words: DataFrame) -> DataFrame:
        """(word, n_near, best, best_n) of the words that have near ones; best is the commonest, then smallest, of these."""
        dealt = self.keyed(words).repartition("key").sortWithinPartitions("c", "lo", "hi", "key", F.col("n").desc(), "word")
        found = dealt.select("c", "lo", "hi", "key", "word", "n").mapInArrow(_near, "word string, n_near long, best string, best_n long")
        top = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top")
        return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", "top.best", (-F.col("top.minus")).alias("best_n"))

    def variants(self, docs: DataFrame) -> DataFrame:
        """(word, form, root, n, n_near, form_n), a row a word."""
        words = materialize(self.vocabulary(docs), "variants-words")
        d = words.join(self.near(words), "word", "left").withColumn("is_variant", F.coalesce(F.col("best_n") >= self.ratio * F.col("n"), F.lit(False)))
        d = d.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is_variant"), F.col(c)).alias(to) for c, to in (("best", "form"), ("best_n", "form_n"))])
        d = materialize(d, "variants-forms")
        roots = self.roots(d.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        return d.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    def roots(self, links: DataFrame) -> DataFrame:
        """Follows links (word, root) to their ends: each round doubles how far, and a form is `ratio` times as common as its variant."""
        now = materialize(links, "variants-roots")
        while True:
            to = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
            step = materialize(now.join(to, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
            discard(now)
            now = step.select("word", "root")
            if not step.where("moved").limit(1).count():
                return now


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op13_variants(spark, sf_dir):
    return SpellingVariants().variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
shifted(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifted WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM shifted WHERE k = 8),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
      lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195, unicode(ch)::BIGINT - 64] END))),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM distinct_runs, crc_table),
changed AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, NULL AS hole FROM vocabulary),
holed AS (SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) AS rest FROM holes),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holed a JOIN holed b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holed a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holed a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.next = f.word)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON f.word = w.word AND w.next IS NULL
"""
