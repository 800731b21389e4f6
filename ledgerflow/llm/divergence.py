"""How far the sources of a language differ in their words: joint count tables by one-hot products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_up_to, materialize, table

#: Terms are runs of ASCII letters and characters outside ASCII; only A-Z are lower-cased.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task hands its counts on at so many entries, so that its memory is bounded.
ENTRIES = 400_000
#: A block of terms has about so many (term, source) counts; a product is summed up every so many cells.
BLOCK, CELLS = 200_000, 4_000_000
#: Groups have a row a source; beyond so many rows they are joined by shuffle.
GROUP_ROWS = 50_000
#: Probabilities are whole billionths.
UNIT = 1_000_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (words, docs) in held.items():
            terms = pa.array(list(words), pa.binary()).cast(pa.string())
            same = lambda v: pa.array([v], pa.string()).take(pa.array(np.zeros(len(words), np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(list(words.values()), pa.int64()), pa.array([docs[w] for w in words], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            words = text.encode().translate(_TERM).split()
            if words:
                total, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(total)
                total.update(words)
                docs.update(set(words))
                size += len(total)
            if size >= ENTRIES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def term_counts(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in min_docs of their language's documents.

    n counts occurrences in the source, lang_n in the language; first marks one row of a term.
    """
    raw = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    by_group = raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    d = by_group.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term), "least": F.min("source").over(of_term)})
    return d.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).alias("first"))


def probability(n: str, total: str, terms: str) -> Column:
    """Smoothed share of a term in billionths, 1 at least; exact, as the product exceeds 64 bits in large corpora."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) DIV CAST({total} + 2 * {terms} AS DECIMAL(21,0))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (lang, source) with its total, p0 (what a term that it lacks gets), the language's total, terms and counts."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("terms"), F.count("*").alias("entries"))
    g = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["total", "terms", "entries"])
    lang = W.partitionBy("lang")
    g = g.withColumns({"terms": F.sum("terms").over(lang), "entries": F.sum("entries").over(lang), "lang_total": F.sum("total").over(lang)})
    return g.withColumn("p0", F.when(F.col("terms") > 0, probability("0L", "total", "terms")))


def _cells(block: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """The block's product X'X, where X has a row a term and a column a (source, level), as sources, levels and counts of its cells.

    A row of X holds a one for each source that has its term. Ordered by row, the ones of a row that
    lie k columns apart make the k-th part of the product, so that its zeros are never touched.
    Sources come as codes, a before b.
    """
    term = pd.factorize(block["term"])[0]
    source = block["code"].to_numpy()
    order = np.lexsort((source, term))
    term, source = term[order], source[order]
    key = source << 31 | block["p"].to_numpy()[order]
    columns, at = np.unique(key, return_inverse=True)
    held: list[np.ndarray] = []

    def summed():
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        a, b = columns[cell // len(columns)], columns[cell % len(columns)]
        return a >> 31, b >> 31, a & 0x7FFFFFFF, b & 0x7FFFFFFF, n

    for k in range(1, int(np.bincount(term).max())):
        same = np.flatnonzero(term[k:] == term[:-k])
        held.append(at[same] * len(columns) + at[same + k])
        if sum(map(len, held)) > CELLS:
            yield summed()
            held = []
    if held:
        yield summed()


def _coded(block: pd.DataFrame) -> np.ndarray:
    names, code = np.unique(block["source"].to_numpy(object), return_inverse=True)
    block["code"] = code.astype(np.int64)
    return names


def _tables(block: pd.DataFrame) -> pd.DataFrame:
    names = _coded(block)
    parts = [pd.DataFrame({"lang": block["lang"].iloc[0], "a": names[a], "b": names[b], "p": p, "q": q, "n": n}) for a, b, p, q, n in _cells(block)]
    return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("lang", "a", "b", "p", "q", "n")})


def _priced(block: pd.DataFrame) -> pd.DataFrame:
    """By pair of sources: what the block's terms that both have add to the sums that take one of them as absent."""
    names = _coded(block)
    p0 = np.zeros(len(names), np.int64)
    p0[block["code"]] = block["p0"]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    total: dict[int, int] = {}
    for a, b, p, q, n in _cells(block):
        extra = n * (f(p, q) - f(p, p0[b]) - f(p0[a], q) + f(p0[a], p0[b]))
        pair, at = np.unique(a * len(names) + b, return_inverse=True)
        sums = np.zeros(len(pair), np.int64)
        np.add.at(sums, at, extra)
        for k, v in zip(pair.tolist(), sums.tolist()):
            total[k] = total.get(k, 0) + v
    pair = np.array(list(total), np.int64)
    return pd.DataFrame({"lang": block["lang"].iloc[0], "a": names[pair // len(names)], "b": names[pair % len(names)], "value": np.array(list(total.values()), np.int64)})


class SourceDivergence:
    """Distances of a language's sources, in whole billionths: the triangular discrimination of their smoothed word shares.

    Rows with null text, lang or source count as ''. Repeated rows count each. A source without
    terms is one whose counts are all 0; a language without kept terms has distances of 0. An empty
    table gives no rows; other columns are not read.
    """

    def __init__(self, min_docs: int = 10, top: int = 10):
        self.min_docs, self.top = min_docs, top

    def prepared(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Written counts with their shares p (source), p0 and q (language), and the groups."""
        d = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        counts = materialize(term_counts(d, self.min_docs), "divergence-counts")
        g = materialize(groups(d, counts), "divergence-groups")
        c = counts.join(broadcast_up_to(g, GROUP_ROWS), ["lang", "source"])
        return c.withColumns({"p": probability("n", "total", "terms"), "q": probability("lang_n", "lang_total", "terms")}), g

    def blocks(self, counts: DataFrame):
        block = F.expr(f"pmod(xxhash64(term), entries DIV {BLOCK} + 1)").alias("block")
        return counts.select("lang", block, "term", "source", "p", "p0").groupBy("lang", "block")

    def joint_tables(self, docs: DataFrame) -> DataFrame:
        """(lang, a, b, p, q, n): terms that a has with share p and b with share q, sources a before b, both present."""
        cells = self.blocks(self.prepared(docs)[0]).applyInPandas(_tables, "lang string, a string, b string, p long, q long, n long")
        return cells.groupBy("lang", "a", "b", "p", "q").agg(F.sum("n").alias("n"))

    def pairs(self, counts: DataFrame, g: DataFrame) -> DataFrame:
        """(lang, source, item, value) of all pairs of a language's sources, in both orders.

        A joint table's row and column of absent terms follow from each source's own levels: with
        all terms absent on both sides first, then each side's levels against absence, then what
        the cells of the one-hot product change.
        """
        other = broadcast_up_to(g.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), GROUP_ROWS)
        none = g.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("terms") * distance("p0", "q0"), F.lit(0)).alias("value"))
        levels = counts.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
        side = levels.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (distance("p", "q0") - distance("p0", "q0"))).alias("value"))
        both = self.blocks(counts).applyInPandas(_priced, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        turned = lambda df, a, b: df.select("lang", F.expr(f"explode(array(struct({a} AS source, {b} AS item), struct({b} AS source, {a} AS item)))").alias("x"), "value").select("lang", "x.source", "x.item", "value")
        parts = none.unionByName(turned(side, "source", "item")).unionByName(turned(both, "a", "b"))
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def audit(self, docs: DataFrame) -> DataFrame:
        """(lang, source, part, item, value, rank): all other sources by distance, and the terms that a source overuses most."""
        counts, g = self.prepared(docs)
        rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
        terms = counts.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value")).withColumn("rank", rank).where(F.col("rank") <= self.top)
        parts = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, d in (("pair", self.pairs(counts, g).withColumn("rank", rank)), ("term", terms))]
        return parts[0].unionByName(parts[1])


def op11_divergence(spark, sf_dir):
    return SourceDivergence().audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, l.v, l.lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS BIGINT) AS q FROM filled),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
