import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from speechframe.llm import token_files
from speechframe.llm.queries import op12_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", "Hello, WORLD's 'tis don't", "x<|endoftext|>y", "<|ENDOFTEXT|> <|", "é É ́ ́a", "日本語 テスト", "İstanbul ǅ ﬁ ß ẞ", "a b\x85c\x1cd\te\r\nf", "1234 ½ ² ³x", "≠ ≮", "🎉🎉 x🎉", "µ ª º ÷ ×", "가 ᆨ", "'S 'LL ’s", "no​space", "Σ Σας ΑΣ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return token_files.PieceEncoder(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_the_library(encoder, library):
    assert encoder.cut
    rng = np.random.default_rng(3)
    alphabet = ["a", "B", "é", "É", "'", "s", "'s", "T", " ", "\n", "\t", "\xa0", "\x85", "\x1f", ".", "<", "|", ">", "<|", "1", "²", "ß", "Ÿ", "ÿ", "́", "日", "ﬁ", "İ", "-", "’", "🎉", "̀", "ng", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)] + ["a" * 5000, "!" * 5000, "é " * 3000, "日" * 2000]
    texts += ["".join(rng.choice(alphabet[:23], rng.integers(0, 40))) for _ in range(3000)] + [chr(i) + "x" + chr(i) for i in range(256)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == ids_of(library, text), repr(text)


def test_other_tokenizers_encode_whole_texts():
    other = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.cut
    for text in ODD:
        assert np.frombuffer(other.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def written(spark, tmp_path, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS source", "1 AS ids", "2 AS at", "3 AS file", "4 AS start")
    path = str(tmp_path / "out")
    token_files.write_tokens(df, path, keep=("source", "ids", "nothing"), **how)
    return path


def stream_of(library, rows, end=2):
    """Rows in the files' order (ids of equal rows are equal) with their places."""
    out, at = [], 0
    for i, text in rows:
        ids = [*ids_of(library, text), end]
        out.append((i, at, len(ids), ids))
        at += len(ids)
    return out


def test_round_trip(spark, tmp_path, library):
    rows = [(i, ODD[i % len(ODD)] + f" n{i}") for i in range(300, 0, -1)] + [(1000, None), (1001, "long text " * 40_000), (1002, "w" * 100_000)]
    path = written(spark, tmp_path, rows)
    got = sorted((r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in token_files.read_documents(spark, path).collect())
    want = stream_of(library, sorted(rows))
    assert got == want
    assert {r.source for r in token_files.read_documents(spark, path).select("source").collect()} == {"q"}
    stream = [x for r in want for x in r[3]]
    for first, last in ((0, 1), (0, len(stream)), (17, 940), (5, 5), (len(stream) - 3, len(stream) + 9)):
        parts = sorted((r.start, list(r.ids)) for r in token_files.read_span(spark, path, first, last).collect())
        assert [x for _, ids in parts for x in ids] == stream[first:last]
        assert not parts or parts[0][0] == first


def test_repeated_and_null_ids(spark, tmp_path, library):
    rows = [(None, "b"), (None, None), (5, "x y"), (5, "x y"), (5, "z"), (4, ""), (6, "é")]
    got = sorted((tuple(r) for r in token_files.read_documents(spark, written(spark, tmp_path, rows)).select("start", "doc_id", "n_tokens").collect()))
    assert [r[1] for r in got] == [None, None, 4, 5, 5, 5, 6]
    assert [r[0] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert sum(r[2] for r in got) == sum(len(ids_of(library, t)) + 1 for _, t in rows)


def test_empty_table(spark, tmp_path):
    assert token_files.read_documents(spark, written(spark, tmp_path, [])).count() == 0
    assert token_files.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_format_of_the_files(spark, tmp_path):
    rows = [(i, f"some words number {i} " * 20) for i in range(4000)]
    path = written(spark, tmp_path, rows, row_group_bytes=100_000, page_bytes=4096, page_rows=50)
    groups = 0
    for file in glob.glob(f"{path}/tokens/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for column in (meta.row_group(g).column(c) for g in range(meta.num_row_groups) for c in range(meta.num_columns)):
            assert column.has_offset_index and column.has_column_index
            if column.path_in_schema.startswith("ids"):
                assert column.has_dictionary_page and any("DICTIONARY" in e for e in column.encodings)
            elif column.path_in_schema in ("doc_id", "at", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in column.encodings and not column.has_dictionary_page
    assert groups > len(glob.glob(f"{path}/tokens/*.parquet"))
    narrow = token_files.read_documents(spark, path).select("doc_id", "start")
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    one = token_files.read_documents(spark, path).where("doc_id = 77")
    assert "EqualTo(doc_id,77)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_query_equals_the_library(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = [(i, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, n, ids in stream_of(library, docs)]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op12_token_files(spark, SF).collect()) == want
