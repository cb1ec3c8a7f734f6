"""Byte-level BPE as a lazily determinised transducer, and an incremental UTF-8 decoder.

A BPE encoding is valid exactly if every pair of neighbouring tokens is the encoding of its own
concatenation. Reading left to right, that makes a non-deterministic transducer whose configurations
are (last token, place in the token trie of the open one). Subsets of configurations are determinised
on demand. An arc's output is the token that ends with its byte: exactly one does, as each prefix of a
piece has one encoding. Which of these tokens belong to the piece shows as soon as all open tokens go
back to the same boundary, so a token is emitted after a lookahead bounded by the longest tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.llm.common import extended, small_batches, without

#: States that a worker holds before it starts afresh, pieces in each of its two generations of memoised pieces, and
#: rows it turns into Python objects at a time; the results do not depend on them.
MAX_STATES = 60_000
MAX_PIECES = 200_000
MEMO_CHARS = 48
SLICE_ROWS = 256
#: Bytes of a long piece after which the settled tokens are emitted.
SETTLE_BYTES = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BpeTransducer:
    """Encodes one piece at a time; transitions are compiled when first taken."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        # the tokens as a trie: child node by (node, byte), then each node's token and whether longer ones go on
        self.child: dict[int, int] = {}
        self.rank_at, self.longer, self.depth = [-1], [True], [0]
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                self.longer[node] = True
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.rank_at)
                    self.rank_at.append(-1)
                    self.longer.append(False)
                    self.depth.append(depth)
                node = to
            self.rank_at[node] = rank
        self.size = {rank: len(token) for rank, token in self.token.items()}
        # by left + 1 and right, packed in one number
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: the configuration that stands between two tokens, then those inside one
        self.configs: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.arcs: dict[int, tuple[int, int]] = {}
        self._state(((-1, 0),))

    def _state(self, configs: tuple) -> int:
        at = self.ids.get(configs)
        if at is None:
            at = self.ids[configs] = len(self.configs)
            self.configs.append(configs)
        return at

    def _merged(self, data: bytes) -> list[int]:
        """The ranks that merging, lowest rank and leftmost first, leaves of a short string."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [(ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _follows(self, left: int, right: int) -> bool:
        """Whether right may stand after left (-1: at the start)."""
        if left < 0:
            ok = self._merged(self.token[right]) == [right]
        else:
            ok = self._merged(self.token[left] + self.token[right]) == [left, right]
        self.pairs[left + 1 << 32 | right] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        child, rank_at, longer, pairs = self.child, self.rank_at, self.longer, self.pairs
        inside, ended = [], -1
        for last, node in self.configs[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if longer[node]:
                inside.append((last, node))
            rank = rank_at[node]
            if rank >= 0 and ended < 0:  # at most one token can end here
                ok = pairs.get(last + 1 << 32 | rank)
                if self._follows(last, rank) if ok is None else ok:
                    ended = rank
        arc = self.arcs[state << 8 | byte] = (self._state(((ended, 0), *inside)), ended)
        return arc

    def _traced(self, ends: list[int], at: int) -> list[int]:
        """The tokens that lead to a boundary, last first."""
        out, size = [], self.size
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        return out

    def _settled(self, ends: list[int], state: int) -> list[int]:
        """The tokens that all open ones have before them, first first."""
        starts = [len(ends) - self.depth[node] for _, node in self.configs[state]]
        chains = [self._traced(ends, start)[::-1] for start in starts]
        n = 0
        while all(len(c) > n and c[n] == chains[0][n] for c in chains):
            n += 1
        return chains[0][:n]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.configs) > MAX_STATES:
            self.reset()
            if len(self.pairs) > 8 * MAX_STATES:
                self.pairs.clear()
        out: list[int] = []
        ends: list[int] = []
        state, arcs = 0, self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte) or self._step(state, byte)
            state = arc[0]
            ends.append(arc[1])
            if len(ends) >= SETTLE_BYTES:
                settled = self._settled(ends, state)
                out += settled
                del ends[: sum(self.size[t] for t in settled)]
        out += self._traced(ends, len(ends))[::-1]
        return out


class BpeEncoder:
    """Whole texts to packed ids: pieces by the pattern, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = BpeTransducer(ranks)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if len(self.memo) > MAX_PIECES:
            self.memo, self.older = {}, self.memo
        memo, older, out = self.memo, self.older, []
        for piece in self.split(text):
            packed = memo.get(piece)
            if packed is None:
                packed = older.get(piece) or self._piece(piece)
                if len(piece) <= MEMO_CHARS:
                    memo[piece] = packed
            out.append(packed)
        return b"".join(out)


def _utf8_arcs() -> np.ndarray:
    """arcs[state, byte] of the UTF-8 machine. State 0: between characters; 1 to 3: that many continuation bytes are due;
    4 to 7: after E0, ED, F0, F4, whose next byte has a narrower range; 8: malformed."""
    arcs = np.full((9, 256), 8, dtype=np.int8)
    arcs[0, :0x80] = 0
    arcs[0, 0xC2:0xE0], arcs[0, 0xE0:0xF0], arcs[0, 0xF0:0xF5] = 1, 2, 3
    arcs[0, 0xE0], arcs[0, 0xED], arcs[0, 0xF0], arcs[0, 0xF4] = 4, 5, 6, 7
    for state, then in ((1, 0), (2, 1), (3, 2)):
        arcs[state, 0x80:0xC0] = then
    arcs[4, 0xA0:0xC0], arcs[5, 0x80:0xA0], arcs[6, 0x90:0xC0], arcs[7, 0x80:0x90] = 1, 1, 2, 2
    return arcs


class Utf8Stream:
    """Incremental UTF-8: feed() bytes as they come, get the characters that are complete."""

    ARCS = _utf8_arcs().tolist()

    def __init__(self):
        self.state, self.held = 0, bytearray()

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            then = self.ARCS[self.state][byte]
            if then == 8:  # replace what was held; the byte itself may open a character
                if self.held:
                    out.append("�")
                    self.held.clear()
                then = self.ARCS[0][byte]
                if then == 8:
                    out.append("�")
                    self.state = 0
                    continue
            self.held.append(byte)
            if then == 0:
                out.append(self.held.decode())
                self.held.clear()
            self.state = then
        return "".join(out)

    def close(self) -> str:
        rest = "�" if self.held else ""
        self.state = 0
        self.held.clear()
        return rest


#: Ids that are decoded at a time.
DECODE_IDS = 4096


class BpeDecoder:
    """Packed ids to bytes, with the UTF-8 machine run over the tokens that split characters."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        self.token: list[bytes | None] = [None] * n
        for token, rank in ranks.items():
            self.token[rank] = token
        self.whole = np.zeros(n, dtype=bool)
        for token, rank in ranks.items():
            try:
                token.decode()
                self.whole[rank] = True
            except UnicodeDecodeError:
                pass
        self.moves: dict[tuple[int, int], int] = {}

    def _move(self, state: int, rank: int) -> int:
        to = self.moves.get((state, rank))
        if to is None:
            to = state
            for byte in self.token[rank]:
                to = Utf8Stream.ARCS[to][byte]
            self.moves[state, rank] = to
        return to

    def decode(self, packed: bytes) -> tuple[bytes, bool]:
        """The bytes, and whether they are whole UTF-8 characters from first to last: decoded incrementally, DECODE_IDS at a
        time, each piece cut between characters."""
        ids, run = np.frombuffer(packed, dtype="<u4"), DecodeRun(self)
        pieces = [run.feed(ids[at : at + DECODE_IDS]) for at in range(0, len(ids), DECODE_IDS)]
        pieces.append(run.close())
        return b"".join(pieces), run.whole

    def stream(self, packed_chunks: Iterable[bytes]) -> Iterator[str]:
        """The text of a stream of packed ids, chunk by chunk, cut only between characters."""
        run, utf8 = DecodeRun(self), Utf8Stream()
        for chunk in packed_chunks:
            data = run.feed(np.frombuffer(chunk, dtype="<u4"))
            yield data.decode() if run.whole else utf8.feed(data)
        yield utf8.feed(run.close()) + utf8.close()


class DecodeRun:
    """The UTF-8 machine over a stream of ids: feed() gives the bytes of the tokens up to the last one that ends a character;
    once no continuation can be well-formed (whole is False) it gives all there is."""

    def __init__(self, decoder: BpeDecoder):
        self.decoder, self.state, self.whole, self.held = decoder, 0, True, b""

    def feed(self, ids: np.ndarray) -> bytes:
        decoder, token = self.decoder, self.decoder.token
        tokens, cut, seen = [token[i] for i in ids.tolist()], len(ids), -1
        # only tokens that split characters move the machine; others need it at rest
        open_from = 0 if self.state else len(ids)
        for at in np.flatnonzero(~decoder.whole[ids]).tolist() if self.whole else ():
            if self.state and at != seen + 1:
                break
            if not self.state:
                open_from = at
            self.state, seen = decoder._move(self.state, int(ids[at])), at
            if self.state == 8:
                break
        if self.state == 8 or self.state and seen + 1 < len(ids):
            self.whole, self.state = False, 0
        if self.whole and self.state:
            cut = open_from
        held, self.held = self.held, b""
        if self.whole and self.state and cut == 0:
            self.held = held + b"".join(tokens)
            return b""
        self.held = b"".join(tokens[cut:])
        return held + b"".join(tokens[:cut])

    def close(self) -> bytes:
        if self.held:
            self.whole = False
        held, self.held = self.held, b""
        return held


_encoders: dict[tuple[str, str], BpeEncoder] = {}
_decoders: dict[str, BpeDecoder] = {}


def _encoder(path: str, pattern: str) -> BpeEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BpeEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def _decoder(path: str) -> BpeDecoder:
    if path not in _decoders:
        _decoders[path] = BpeDecoder(load_ranks(path))
    return _decoders[path]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _encoded(packed: list[bytes]) -> dict[str, pa.Array]:
    return {"token_ids": pa.array(packed, pa.binary()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}


def _decoded(packed: list[bytes | None], path: str) -> dict[str, pa.Array]:
    decoder = _decoder(path)
    out = [decoder.decode(p or b"") for p in packed]
    return {"decoded": pa.array([data for data, _ in out], pa.binary()), "decoded_whole": pa.array([whole for _, whole in out], pa.bool_())}


ENCODED = [("token_ids", T.BinaryType()), ("n_tokens", T.LongType())]
DECODED = [("decoded", T.BinaryType()), ("decoded_whole", T.BooleanType())]


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, check: bool = False) -> DataFrame:
    """Adds token_ids (binary: little-endian unsigned 32-bit ids) and n_tokens (long) to every row.

    With check, decodes the ids at once and adds the columns of decode(). A map over rows: no
    shuffle, any text length, memory bounded by a batch. Null texts count as empty (no ids); repeated
    rows are each encoded; an empty table stays empty; input columns with the names of added ones are
    replaced. ranks_path must be readable on every executor.
    """
    small_batches(df.sparkSession)
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    fields = [*ENCODED, *(DECODED if check else [])]
    df = without(df, [name for name, _ in fields])
    at = df.columns.index(text_col)

    def run(batches):
        encoder = _encoder(path, pattern)
        for batch in _slices(batches):
            packed = [encoder.encode(text) for text in batch.column(at).to_pylist()]
            yield _appended(batch, _encoded(packed) | (_decoded(packed, path) if check else {}))

    return df.mapInArrow(run, extended(df, fields))


def decode(df: DataFrame, ids_col: str = "token_ids", ranks_path: str | None = None) -> DataFrame:
    """Adds decoded (binary) and decoded_whole (boolean: well-formed UTF-8) for packed ids.

    A map over rows. Null ids decode to empty bytes; input columns named decoded or decoded_whole
    are replaced; an id outside the vocabulary fails the task.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = without(df, [name for name, _ in DECODED])
    at = df.columns.index(ids_col)

    def run(batches):
        for batch in _slices(batches):
            yield _appended(batch, _decoded(batch.column(at).to_pylist(), path))

    return df.mapInArrow(run, extended(df, DECODED))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, digests of the packed ids and of the decoded bytes, and whether those are the text's."""
    coded = encode(df.select(id_col, text_col), text_col, ranks_path, pattern, check=True)
    return coded.select(
        id_col,
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded_whole") & (F.col("decoded") == F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))).alias("same_text"),
    )
