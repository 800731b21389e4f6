"""Quality rules whose thresholds come from mergeable quantile sketches; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, broadcast_up_to, materialize, table

#: What a sketch watches, in whole units: mean word length in hundredths of a character; symbols a
#: thousand word characters; repeated lines a thousand lines; repeated words a thousand words.
FEATURES = ("word_length", "symbols", "dup_lines", "repeat_words")
#: The fences lie at the quartiles plus or minus so many times their distance...
SPREAD = 3
#: ...but this far from them at least, so that a uniform group doesn't reject its usual documents.
MARGINS = {"word_length": 300, "symbols": 100, "dup_lines": 250, "repeat_words": 250}
#: Groups with fewer documents take the merged sketch of their language, and then of everything.
LEAST = 100
#: Thresholds have a row a group; beyond so many rows they are joined by shuffle.
GROUP_ROWS = 20_000


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Whole texts; null text counts as empty. Repeated three-word windows are found by sorting a
    text's windows by a 64-bit hash of their words, and counting the words that they cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, text.alias("_text"))
    d = d.withColumn("_words", F.expr(f"filter(split(_text, '[{SPACE}]+'), w -> w <> '')".replace("\\", "\\\\")))
    d = d.withColumn("_lines", F.expr(f"filter(split(_text, '\\n', -1), l -> l rlike '[^{SPACE}]')".replace("\\", "\\\\")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    grams = "if(n_words < 4, array(), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
    d = d.withColumn("_grams", F.expr(grams).cast("array<bigint>"))
    placed = "if(size(array_distinct(_grams)) = size(_grams), array(), sort_array(transform(_grams, (g, i) -> struct(g AS g, i AS i))))"
    d = d.withColumn("_sorted", F.expr(placed).cast("array<struct<g:bigint,i:int>>"))
    found = "filter(_sorted, (x, k) -> coalesce(get(_sorted, k - 1).g = x.g, false) or coalesce(get(_sorted, k + 1).g = x.g, false))"
    d = d.withColumn("_at", F.expr(f"sort_array(transform({found}, x -> x.i))"))
    covered = "aggregate(transform(_at, (v, k) -> least(3, coalesce(get(_at, k + 1), v + 3) - v)), 0L, (a, x) -> a + x)"
    return d.select(
        *keep,
        "n_words",
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(measured: DataFrame) -> DataFrame:
    per = lambda a, b, unit: f"CASE WHEN {b} > 0 THEN {unit} * {a} DIV {b} ELSE 0 END"
    return measured.withColumns({
        "base_failed": base_failed(),
        "word_length": F.expr(per("word_chars", "n_words", 100)),
        "symbols": F.expr(per("n_symbols", "word_chars", 1000)),
        "dup_lines": F.expr(per("n_dup_lines", "n_lines", 1000)),
        "repeat_words": F.expr(per("n_repeat_words", "n_words", 1000)),
    })


def sketch(featured: DataFrame) -> DataFrame:
    """Quantile sketches as counts by (lang, source, feature, bin), over all documents within the base rules.

    A bin holds the values with the same ten leading binary digits, so its lower end is within 0.2%
    of each of them. Sketches of disjoint parts merge by adding counts, in any order, with one result.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x")
    long = featured.where(~F.col("base_failed")).select("lang", "source", pairs).select("lang", "source", "x.feature", "x.value")
    long = long.withColumn("shift", F.expr("greatest(length(bin(value)) - 10, 0)"))
    return long.withColumn("bin", F.expr("shiftleft(shiftright(value, shift), shift)")).groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, *by: str) -> DataFrame:
    """n, q1 and q3 by group and feature from merged sketches; a group's bins are bounded in number."""
    merged = sketches.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*by, "feature")
    d = merged.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin")))
    return d.groupBy(*by, "feature").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(featured: DataFrame) -> DataFrame:
    """A row for each (lang, source) with the lower and upper fence of each feature."""
    s = materialize(sketch(featured), "quality-sketch")
    levels = {"g": quartiles(s, "lang", "source"), "l": quartiles(s, "lang"), "a": quartiles(s)}
    d = levels["g"].alias("g").join(levels["l"].alias("l"), F.expr("g.lang <=> l.lang AND g.feature = l.feature"))
    d = d.join(levels["a"].alias("a"), F.expr("g.feature = a.feature"))
    pick = lambda q: F.expr(f"CASE WHEN g.n >= {LEAST} THEN g.{q} WHEN l.n >= {LEAST} THEN l.{q} ELSE a.{q} END")
    d = d.select("g.lang", "g.source", "g.feature", pick("q1").alias("q1"), pick("q3").alias("q3"))
    margin = F.element_at(F.create_map(*[F.lit(x) for f in FEATURES for x in (f, MARGINS[f])]), F.col("feature"))
    reach = F.greatest(SPREAD * (F.col("q3") - F.col("q1")), margin)
    d = d.withColumn("low", F.col("q1") - reach).withColumn("high", F.col("q3") + reach)
    ends = [F.max(F.when(F.col("feature") == f, F.col(e))).alias(f"{f}_{e}") for f in FEATURES for e in ("low", "high")]
    return materialize(d.groupBy("lang", "source").agg(*ends), "quality-thresholds")


def verdict() -> Column:
    """Kept: within the base rules and the fences; a group without a sketch has none to exceed."""
    ok = ~F.col("base_failed")
    for f in FEATURES:
        ok = ok & F.coalesce(F.col(f) <= F.col(f"{f}_high"), F.lit(True))
    return ok & F.coalesce(F.col("word_length") >= F.col("word_length_low"), F.lit(True))


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, the measures, base_failed and kept.

    Null text counts as empty, and so fails; null lang or source is a group of its own; repeated
    rows each get a row; an empty table gives no rows; other columns are not read.
    """
    f = materialize(features(measures(docs, "doc_id", "lang", "source")), "quality-features")
    t = broadcast_up_to(thresholds(f), GROUP_ROWS)
    d = f.alias("d").join(t.alias("t"), F.expr("d.lang <=> t.lang AND d.source <=> t.source"), "left")
    return d.select("d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict().alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    # stored once, or the filter would be pushed below the measures and work them out again
    f = materialize(features(measures(docs.select("text", "lang", "source", whole), "_doc", "lang", "source")), "quality-features")
    t = broadcast_up_to(thresholds(f), GROUP_ROWS)
    d = f.alias("d").join(t.alias("t"), F.expr("d.lang <=> t.lang AND d.source <=> t.source"), "left")
    return d.where(verdict()).select("d._doc").select("_doc.*")


def op7_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def _quartiles_sql(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""
{name}_upto AS (
  SELECT {keys}feature, bin, sum(sum(n)) OVER (PARTITION BY {keys}feature ORDER BY bin) AS upto, sum(sum(n)) OVER (PARTITION BY {keys}feature) AS total
  FROM sketch GROUP BY {keys}feature, bin),
{name} AS (
  SELECT {keys}feature, max(total) AS n, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3
  FROM {name}_upto GROUP BY {keys}feature)"""


OP7_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM texts),
grams AS (SELECT r, unnest(CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g,
  unnest(CASE WHEN len(w) < 3 THEN [] ELSE range(1, len(w) - 1) END) AS i FROM split),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
covered AS (SELECT r, CAST(sum(least(3, coalesce(next - i, 3))) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM counted WHERE n > 1) GROUP BY r),
measured AS (
  SELECT s.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines FROM split s LEFT JOIN covered c ON s.r = c.r),
featured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_words FROM measured),
long AS (UNPIVOT (SELECT lang, source, word_length, symbols, dup_lines, repeat_words FROM featured WHERE NOT base_failed)
  ON word_length, symbols, dup_lines, repeat_words INTO NAME feature VALUE v),
shifted AS (SELECT *, greatest(length(bin(v)) - 10, 0) AS shift FROM long),
sketch AS (SELECT lang, source, feature, (v >> shift) << shift AS bin, count(*) AS n FROM shifted GROUP BY ALL),
{_quartiles_sql("g", "lang, source")},{_quartiles_sql("l", "lang")},{_quartiles_sql("a", "")},
picked AS (
  SELECT g.lang, g.source, g.feature, CASE WHEN g.n >= {LEAST} THEN g.q1 WHEN l.n >= {LEAST} THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN g.n >= {LEAST} THEN g.q3 WHEN l.n >= {LEAST} THEN l.q3 ELSE a.q3 END AS q3
  FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.feature = l.feature JOIN a ON g.feature = a.feature),
fences AS (
  SELECT lang, source, feature, q1 - greatest({SPREAD} * (q3 - q1), m) AS low, q3 + greatest({SPREAD} * (q3 - q1), m) AS high
  FROM (SELECT *, CASE feature {" ".join(f"WHEN '{f}' THEN {MARGINS[f]}" for f in FEATURES)} END AS m FROM picked)),
thresholds AS (
  SELECT lang, source, {", ".join(f"max({e}) FILTER (feature = '{f}') AS {f}_{e}" for f in FEATURES for e in ("low", "high"))}
  FROM fences GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({f} <= {f}_high, true)" for f in FEATURES)} AND coalesce(word_length >= word_length_low, true) AS kept
FROM featured d LEFT JOIN thresholds t ON d.lang IS NOT DISTINCT FROM t.lang AND d.source IS NOT DISTINCT FROM t.source
"""
