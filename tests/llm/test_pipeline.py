import glob
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speechframe.llm import bpe, near_duplicates, pseudonyms, quality
from tests.llm import test_decontaminate, test_near_duplicates

SF = "/root/testdata/sf0.001"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_columns(stages):
    assert all(df.columns == DOCUMENT for df in stages[:-1])


def test_quality_stage_follows_the_scores(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    assert {d for d, _ in rows(stages[0])} == keep and len(keep) > 0.5 * docs.count()


def test_near_duplicate_stage_equals_brute_force(stages):
    docs = rows(stages[0])
    want = sorted((d for d, c, _ in test_near_duplicates.brute(docs) if d == c))
    assert sorted(d for d, _ in rows(stages[1])) == want


def test_decontamination_stage_equals_brute_force(stages):
    items = duckdb.sql(f"SELECT item_id, text FROM '{glob.glob(SF + '/benchmark.parquet')[0]}'").fetchall()
    hit = {r[0] for r in test_decontaminate.brute(rows(stages[1]), items) if r[-1]}
    assert rows(stages[2]) == [r for r in rows(stages[1]) if r[0] not in hit] and hit


def test_private_values_are_gone(stages):
    before, after = dict(rows(stages[2])), dict(rows(stages[3]))
    assert before.keys() == after.keys() and any(before[d] != after[d] for d in before)
    for d, text in before.items():
        for mail in re.findall(r"[\w.]+@[\w.]+\w", text):
            assert mail not in after[d]
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_last_stage_round_trips(stages):
    decoder = bpe.BpeDecoder(bpe.load_ranks(bpe.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    texts = dict(rows(stages[3]))
    out = stages[4].collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.same_text and r.n_tokens == len(np.frombuffer(r.token_ids, "<u4")) and decoder.decode(r.token_ids)[0].decode() == texts[r.doc_id]


def test_run_is_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, bytes(r.token_ids)) for r in df.collect())
    assert key(got) == key(stages[4])


def test_stages_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (1, text, "en", "s", 5), (1, "another text of five words", "en", "s", 1), (2, text, None, None, None), (None, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("row", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0).drop("row"), SF).count() == 0
    kept = near_duplicates.representatives(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (1, "another text of five words"), (None, text), (3, None), (4, "")], key=str)
    assert kept.columns == docs.columns
    plain = docs.drop("row")
    for k in (0, 2, 3):
        out = corpus_pipeline.STAGES[k][1](spark, plain, SF)
        assert out.columns == plain.columns and out.count() <= 7
    assert pseudonyms.pseudonymise(plain, "a key").count() == 7
