"""The pipeline from documents to packed pieces, against plain expectations."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerflow.llm.tokens import VOCABULARY

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing"]) + str(rng.randint(0, 9)) for _ in range(n))
    texts = [prose(rng.randint(100, 140)) for _ in range(40)]
    near = texts[3].split()
    near[50] = "changed"
    texts += [texts[0], texts[0], texts[1], " ".join(near), "too short", None, prose(110) + " write to bob@site.org"]
    rows = [(i, t, "en", "ab"[i % 2], len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, key string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen[name] = docs.collect()
    ids = {name: sorted(r.doc_id for r in part) for name, part in seen.items()}
    assert ids["quality rules"] == [i for i in range(len(texts)) if i not in (44, 45)]
    assert ids["near-duplicates"] == ids["surrogates"] == [*range(40), 46]
    private = {r.doc_id: r for r in seen["surrogates"]}
    assert "bob@site.org" not in private[46].text and private[46].n_chars == len(private[46].text) and all(private[i].text == texts[i] for i in range(40))
    mixed: dict = {}
    for r in seen["mixing"]:
        mixed.setdefault(r.doc_id, []).append(r.text)
    assert set(mixed) <= set(private) and all(len(t) <= 2 for t in mixed.values())
    t = Tokenizer.from_file(str(public_tokenizers.path(VOCABULARY)))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    assert sum(r.length for r in seen["packing"]) == want and max(r.offset + r.length for r in seen["packing"]) <= 1024


def test_no_documents_and_only_rejected_ones(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, n_entities string"
    for name, rows in (("none", []), ("rejected", [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (2, "short", "en", "a", 5, "x")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect() == []
