import random

import public_tokenizers
import pytest
import sentencepiece

from speechframe.llm import token_counts
from speechframe.llm.queries import op9_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_counts_as_the_library(counter, library):
    rng = random.Random(3)
    alphabet = ["a", "e", "th", "in", "er", " ", "  ", "    ", "\n", "\t", "\r", "é", "ß", "日", "本", "🎉", "'s", "!!", "1", "23", " ", "▁", "ท", "้", "<s>", "</s>", "<unk>", "<0x0A>", "　", "ﬁ", "\x00x"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
        if "\x00" in text:
            text = text.replace("\x00", "\x01")
        assert counter.count(text) == len(library.encode(text)), text
    for text in ("a" * 4000, "日本" * 900, " " * 999, "\n" * 500, "the " * 800, None, ""):
        assert counter.count(text) == len(library.encode(text or ""))


def test_proven_pieces_are_one_token(counter, library):
    for piece in random.Random(1).sample(sorted(counter.single), 500):
        if piece.startswith("▁"):
            assert len(library.encode(piece[1:].replace("▁", " "))) == 1


def test_operator_handles_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hi there", None), (3, "hi there", None), (None, "é", "q")], "doc_id long, text string, n_tokens string")
    rows = sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect())
    assert rows == [(0, 0), (0, 0), (2, 1), (8, 2), (8, 2)]
    assert token_counts.over_limit(df, limit=1).where("over_limit").count() == 2
    assert token_counts.over_limit(df.limit(0)).count() == 0


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), want, want > 4096)
