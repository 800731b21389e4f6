"""URL verdicts: rules by host and path, and beyond them naive Bayes over segmented hosts and paths."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, materialize, table

#: (rule, verdict): a host, and a path from its first slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Host words that count as this many blocked addresses each, whatever the labels say.
SEEDS = ("adult", "casino", "malware", "phishing", "porn", "spam", "xxx")
SEED_WEIGHT = 20
#: The token model is broadcast up to so many rows, and joined by shuffle beyond.
MODEL_ROWS = 100_000
#: Scores are whole millionths of a log-odds unit, so that their sums don't depend on order.
MILLION = 1_000_000


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of (page_id, url)."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select("page_id", F.coalesce(F.translate(host, upper, lower), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def longest_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n over the whole visible text and titles of all pages: letters only, in lower case."""
    shown = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    words = F.split(F.lower(shown), r"[^\p{L}]+")
    return pages.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, words: dict[str, int], total: int) -> list[str]:
    """The most probable split of name; an unknown word is ten times less probable a letter.

    Of equal ones that with the longest last word. An unknown word costs the same for each letter, so
    the best place where one may begin is kept instead of looked for.
    """
    lengths = sorted({len(w) for w in words}, reverse=True)
    start, letter = math.log(10.0 / total), math.log(10.0)
    best, since, run = [(0.0, 0)], 0, 0.0
    for end in range(1, len(name) + 1):
        if best[end - 1][0] + (end - 1) * letter > run:
            since, run = end - 1, best[end - 1][0] + (end - 1) * letter
        options = [(best[since][0] + start - (end - since) * letter, -since)]
        for k in lengths:
            if k <= end and (n := words.get(name[end - k : end])):
                options.append((best[end - k][0] + math.log(n / total), k - end))
        p, begin = max(options)
        best.append((p, -begin))
    out: list[str] = []
    end = len(name)
    while end:
        begin = best[end][1]
        out.append(name[begin:end])
        end = begin
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words for distinct names: each with the counts of its own substrings, which a join brings.

    Substrings are made a start at a time, and of lengths only that words have, so that no row grows
    with the square of a name; a name stands for itself by its digest until its words are known.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    lengths = F.array(*[F.lit(r[0]) for r in counts.select(F.length("word").alias("k")).distinct().orderBy("k").collect()]).cast("array<int>")  # whole numbers, as many as words differ in length
    keyed = names.select("name", F.md5("name").alias("key"))
    starts = keyed.where("length(name) > 0").select("key", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("b"), lengths.alias("lengths"))
    parts = starts.select("key", F.explode(F.expr("transform(filter(lengths, k -> k <= length(name) - b + 1), k -> substring(name, b, k))")).alias("word"))
    found = parts.join(counts, "word").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))
    both = keyed.join(found, "key", "left")

    def split(batches):
        for batch in batches:
            words = [viterbi(n, dict(k) if k is not None else {}, total) for n, k in zip(batch["name"], batch["known"])]
            yield pd.DataFrame({"name": batch["name"], "words": words})

    return both.select("name", "known").mapInPandas(split, "name string, words array<string>")


class HostModel:
    """Multinomial naive Bayes over `h:` tokens (host words) and `p:` tokens (path pieces)."""

    def __init__(self, rules=RULES, seeds=SEEDS) -> None:
        self.rules, self.seeds = rules, seeds

    def tokens(self, addresses: DataFrame, counts: DataFrame) -> DataFrame:
        """host, path, token: a row a token, from distinct (host, path)."""
        names = addresses.select("host").distinct().select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("at", "name")).where("name <> ''")
        names = materialize(names, "url-names")
        words = segmented(names.select("name").distinct(), counts)
        of_host = names.join(words, "name").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
        path = F.filter(F.split(F.regexp_replace("path", r"\d+", "0"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        d = addresses.join(of_host, "host", "left")
        every = F.concat(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.transform(path, lambda w: F.concat(F.lit("p:"), w)))
        return d.select("host", "path", F.explode(every).alias("token"))

    def fit(self, tokens: DataFrame, labelled: DataFrame) -> tuple[DataFrame, int, int]:
        """(token, score), the score of an unknown token, and the prior, from all labelled addresses.

        Labels are the rules' own verdicts; counts have one added for each token and class.
        """
        spark = tokens.sparkSession
        seen = tokens.join(labelled, ["host", "path"])
        seen = seen.groupBy("token").agg(*[F.sum(F.when(F.col("label") == c, F.col("pages")).otherwise(0)).alias(c) for c in ("block", "allow")])
        seeds = spark.createDataFrame([(f"h:{w}", SEED_WEIGHT, 0) for w in self.seeds], "token string, block long, allow long")
        seen = materialize(seen.unionByName(seeds).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "url-model")
        block, allow, size = (x or 0 for x in seen.agg(F.sum("block"), F.sum("allow"), F.count("*")).first())
        odds = F.log((F.col("block") + 1) / (block + size + 1)) - F.log((F.col("allow") + 1) / (allow + size + 1))
        unknown = round(MILLION * (math.log(1 / (block + size + 1)) - math.log(1 / (allow + size + 1))))
        n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.sum("pages").alias("n")).collect()}
        prior = round(MILLION * math.log((n.get("block", 0) + 1) / (n.get("allow", 0) + 1)))
        return seen.select("token", F.round(odds * MILLION).cast("long").alias("score")), unknown, prior

    def judge(self, pages: DataFrame) -> DataFrame:
        """A row a page: page_id, host, path, rule, verdict, score (null where a rule decides).

        A null url, and one without ://, has an empty host and path and is judged by the prior
        alone; ties are allowed. Null ids and repeated rows keep their rows; null html adds no words;
        an empty table gives no rows; columns other than page_id, url and html are not read.
        """
        d = materialize(parsed(pages), "url-parsed")
        rule, says = longest_rule(self.rules)
        d = d.withColumn("rule", rule).withColumn("label", says)
        addresses = materialize(d.groupBy("host", "path", "label").agg(F.count("*").alias("pages")), "url-addresses")
        counts = materialize(unigrams(pages), "url-unigrams")
        tokens = materialize(self.tokens(addresses.select("host", "path"), counts), "url-tokens")
        scores, unknown, prior = self.fit(tokens, addresses.where("label IS NOT NULL"))
        asked = tokens.join(addresses.where("label IS NULL").select("host", "path"), ["host", "path"])
        summed = asked.join(broadcast_up_to(scores, MODEL_ROWS), "token", "left").groupBy("host", "path").agg(F.sum(F.coalesce("score", F.lit(unknown))).alias("sum"))
        scored = addresses.where("label IS NULL").select("host", "path").join(summed, ["host", "path"], "left")
        scored = scored.select("host", "path", (F.coalesce("sum", F.lit(0)) + F.lit(prior)).cast("long").alias("score"))
        out = d.join(scored, ["host", "path"], "left")
        verdict = F.coalesce("label", F.when(F.col("score") > 0, "block").otherwise("allow"))
        return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op8_urls(spark, sf_dir):
    return HostModel().judge(table(spark, sf_dir, "pages"))
