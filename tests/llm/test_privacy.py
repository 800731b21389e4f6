"""Surrogates: they end, they survive long texts, and they keep forms, persons and distinctness."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerflow.llm import privacy

SCHEMA = "doc_id long, text string, n_entities string, surface string"


def replaced(spark, texts):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in privacy.replace_private(d).collect()}
    assert sorted(rows) == list(range(len(texts))) and all(r.surface == "y" for r in rows.values())
    return [rows[i].text for i in range(len(texts))]


def test_few_forms_end(spark):
    """More entities than their form has values, and values that hide nothing."""
    nothing = ["Password: ________", "token = --------", "api_key: ********"]
    code = ["std::vector a::b c::d", *[f"{a}::{b}" for a in "abcdef" for b in "abcdef"]]
    small = [f"::{i}" for i in range(10)] + [f"Mr. {a}{b} left" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "aeiou"] + [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"pwd=1{d}##" for d in range(10)]
    out = replaced(spark, nothing + code + small)
    assert out[: len(nothing) + len(code)] == nothing + code
    new = out[len(nothing) + len(code) :]
    assert all(a != b for a, b in zip(small, new)) and len(set(new)) == len(small)
    assert not {n for n in new} & set(small)


def test_a_megabyte_of_each_pattern(spark):
    runs = ["a-" * 500_000, "Mr. " + "Ab " * 300_000, "Mr. " + "A. " * 300_000, "x@" + "ab." * 300_000 + "org", "password" + "_password" * 100_000 + "=abc12345x", "a:" * 500_000, "1-" * 500_000,
        "Ms " + "O'" * 300_000 + "Ab", "Mr. " + "von " * 200_000 + "Ab", "token: " + "a!" * 500_000, "My name is " + "Ab-" * 300_000, "1.2." * 250_000, "GB12 " + "ABCD " * 200_000]
    assert not any("bob@site.org" in t for t in replaced(spark, [t + " mail bob@site.org." for t in runs]))


def test_what_is_found(spark):
    secrets = ["Password: P@ssw0rd!x", "pwd=short1", "token: abcdefgh!!secret", 'config {"api_key": "Zz9#Zz9#"}', "DB_PASSWORD='hunter2hunter2'", "MY-TOKEN=ghp_" + "a1" * 20]
    names = ["Mr. JOHN SMITH was here", "My name is Peter Parker.", "Contact: Anna Kowalska <x>"]
    out = replaced(spark, secrets + names)
    for hidden, text in zip(["P@ssw0rd", "short1", "secret", "Zz9#Zz9#", "hunter2", "a1a1a1"], out):
        assert hidden not in text
    assert re.fullmatch(r"Mr\. [A-Z]+ [A-Z]+ was here", out[6]) and "JOHN" not in out[6] and "SMITH" not in out[6]
    assert re.fullmatch(r"My name is [A-Z][a-z]+ [A-Z][a-z]+\.", out[7]) and "Peter" not in out[7] and "Parker" not in out[7]
    assert out[8].startswith("Contact: ") and out[8].endswith(" <x>") and "Kowalska" not in out[8]


def test_one_person_under_any_title(spark):
    out = replaced(spark, ["Ms Jane Roe spoke.", "Dr. Jane Roe wrote.", "Prof. Roe, that is Jane Roe, agreed.", "Mr. Tom Hill met Dr. Alex Hill."])
    given, family = out[0].split()[1:3]
    assert out[1] == f"Dr. {given} {family} wrote." and given.endswith(tuple("aeiou"))
    assert out[2].startswith(f"Prof. {family}, that is ") and f"{family}, agreed" in out[2]
    a, b = re.fullmatch(r"Mr\. \w+ (\w+) met Dr\. \w+ (\w+)\.", out[3]).groups()
    assert a == b


def test_common_words_stay(spark):
    text = "Mr. Will Young will come. Will you? Young people. We saw Young, and Will Young."
    out = replaced(spark, [text, "Ms Maria Rose came. Rose is red"])
    assert " will come. Will you? Young people. We saw " in out[0] and out[0].count("Young") == 1 and out[0].count("Will") == 1
    assert out[1].endswith("Rose is red")


def test_surrogates_are_distinct_over_a_corpus(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    after = {r.doc_id: r.text for r in privacy.replace_private(d).select("doc_id", "text").collect()}
    mail = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
    pairs = Counter()
    for i, text in before.items():
        old, new = mail.findall(text or ""), mail.findall(after[i] or "")
        assert len(old) == len(new)
        pairs.update({(a.lower(), b.lower()): 1 for a, b in zip(old, new)})
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert not {a for a, _ in pairs} & {b for _, b in pairs}
    plain = [i for i, t in before.items() if t and not re.search(r"[@0-9:=]|\b(?:M[rsx]|Dr|Prof|Frau|Herr|Miss|Sir|Don)\b", t) and after[i] != t]
    assert len(plain) <= len(before) // 50


def test_empty_table(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert privacy.replace_private(d).collect() == [] and privacy.replace_private(d.withColumn("n", F.lit(1))).columns == ["doc_id", "text", "surface", "n", "n_entities"]
