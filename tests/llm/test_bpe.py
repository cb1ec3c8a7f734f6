import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from speechframe.llm import bpe
from speechframe.llm.queries import op2_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_same_ids_as_the_library(ranks, library):
    rng = random.Random(5)
    alphabet = ["a", "b", "e", "th", "in", " ", "  ", "\n", "\t", "é", "ß", "日本", "語", "🎉", "'s", "!!", "1", "23", "\x00", " ", "ท", "้", "<|endoftext|>"]
    encoder = bpe.BpeEncoder(ranks, public_tokenizers.PATTERN)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert ids(encoder.encode(text)) == library.encode_ordinary(text), text
    for text in ("a" * 5000, "ab" * 3000, "\n" * 999, "日" * 777, "x", ""):
        assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_results_do_not_depend_on_the_cache(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    encoder = bpe.BpeEncoder(ranks, public_tokenizers.PATTERN)
    for text in ["Unzertrennlichkeiten sind überall", "la cancion de los ñandúes", "the quick brown foxes"] * 3:
        assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_stream_cuts_between_characters(ranks):
    text = "naïve 日本語 🎉 ok"
    decoder = bpe.BpeDecoder(ranks)
    packed = bpe.BpeEncoder(ranks, public_tokenizers.PATTERN).encode(text)
    single = b"".join(np.array([ranks[bytes([b])]], "<u4").tobytes() for b in text.encode())
    for data in (packed, single):
        chunks = [data[i : i + 4] for i in range(0, len(data), 4)]
        out = list(decoder.stream(chunks))
        assert "".join(out) == text and not any("�" in c for c in out)
        assert decoder.decode(data) == (text.encode(), True)
    assert decoder.decode(single[:-12])[1] is True
    cut = b"".join(np.array([ranks[bytes([b])]], "<u4").tobytes() for b in "é".encode()[:1])
    assert decoder.decode(cut) == ("é".encode()[:1], False)
    assert "".join(decoder.stream([cut])) == "�"
    for bad in (b"\xed\xa0\x80", b"\xc0\x80", b"\xf5", b"a\xe2b", b"\xf0\x80\x80\x80"):
        stream = bpe.Utf8Stream()
        got = stream.feed(bad) + stream.close()
        assert "�" in got


def test_operator_handles_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hi there", None), (3, "hi there", None), (None, "z", "q")], "doc_id long, text string, n_tokens string")
    rows = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.n_tokens, bytes(r.decoded)) for r in rows) == [(0, b""), (0, b""), (1, b"z"), (2, b"hi there"), (2, b"hi there")]
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = library.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(want) and r.same_text
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_pieces_join_to_the_bytes_however_ids_are_cut(ranks, monkeypatch):
    rng = random.Random(17)
    decoder = bpe.BpeDecoder(ranks)
    single = [ranks[bytes([b])] for b in range(256)]
    texts = ["日本語 é 😀 plain text", "", "x" * 50, "😀" * 30]
    for text in [*texts, *(bytes(rng.randrange(256) for _ in range(40)) for _ in range(60)), "ab".encode() + b"\xf0\x9f", b"\x80a"]:
        data = text if isinstance(text, bytes) else text.encode()
        packed = np.array([single[b] for b in data], dtype="<u4").tobytes()
        try:
            data.decode()
            whole = True
        except UnicodeDecodeError:
            whole = False
        for size in (1, 2, 3, 7, 4096):
            monkeypatch.setattr(bpe, "DECODE_IDS", size)
            assert decoder.decode(packed) == (data, whole), (data, size)
            chunks = [packed[a : a + 4 * size] for a in range(0, len(packed), 4 * size)]
            run = bpe.DecodeRun(decoder)
            pieces = [run.feed(np.frombuffer(c, "<u4")) for c in chunks]
            if whole:
                assert all(p.decode() is not None for p in pieces) and b"".join(pieces) == data
                assert "".join(decoder.stream(chunks)) == data.decode()
            else:
                assert "".join(decoder.stream(chunks)) == data.decode(errors="replace")
