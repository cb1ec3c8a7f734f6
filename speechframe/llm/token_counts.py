"""Token counts of a sentencepiece BPE model: whole-token shortcut first, merges for the rest.

Offline, the vocabulary proves two things. Merging never joins two neighbouring characters that are
neighbours in no piece, so a text may be cut there. And a piece whose own merging ends in that piece
alone is one token wherever it stands between two such cuts. Counting then looks pre-tokens up among
the proven pieces; only the others are merged.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.llm.common import extended, small_batches, without

SPACE = "▁"
#: Counts of merged pre-tokens that a worker holds before it starts afresh, and the longest it keeps.
MAX_MEMO = 400_000
MEMO_CHARS = 64


class PieceCounter:
    """Counts tokens with the pieces and merge order of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._assumed(model)
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.joined = {a + b for piece in self.score for a, b in zip(piece, piece[1:], strict=False)}
        self.single = self._proven()
        self.cut = self._cutter()
        self.memo: dict[str, int] = {}

    @staticmethod
    def _assumed(model) -> None:
        """The normalisation that counting relies on: none, a leading space added, spaces kept."""
        for text, want in (("a  b", [SPACE + "a", SPACE * 2 + "b"]), (" ", [SPACE * 2]), ("ﬁ", [SPACE + "ﬁ"])):
            got = "".join(model.encode(text, out_type=str))
            if got != "".join(want):
                raise ValueError(f"{model}: unexpected normalisation of {text!r}")
        if model.encode(""):
            raise ValueError(f"{model}: adds tokens to an empty text")

    def _proven(self) -> set[str]:
        """The pieces that, standing alone, merge into one token."""
        return {piece for piece in self.score if self._merge(piece) == 1}

    def _cutter(self):
        """A pattern for pre-tokens: spaces start one, and characters that no piece joins to another stand alone."""
        loners = "\n\t\r"
        alone = "".join(c for c in loners if not any(c in pair for pair in self.joined))
        if any(left != SPACE and pair[1] == SPACE for pair in self.joined if (left := pair[0])):
            return re.compile(r"(?s).+").findall
        each = f"[{re.escape(alone)}]|" if alone else ""
        return re.compile(f"{each}{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+").findall

    def _merge(self, text: str) -> int:
        """Tokens of a pre-token: highest score first, leftmost on ties; characters outside the vocabulary count their bytes."""
        score, n = self.score, len(text)
        sym, prev, nxt = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-score[pair], i, pair) for i in range(n - 1) if (pair := text[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = nxt[i] if sym[i] is not None else -1
            if j < 0 or sym[i] + sym[j] != pair:
                continue
            sym[i], sym[j] = pair, None
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                if (right := pair + sym[nxt[i]]) in score:
                    heapq.heappush(heap, (-score[right], i, right))
            if prev[i] >= 0 and (left := sym[prev[i]] + pair) in score:
                heapq.heappush(heap, (-score[left], prev[i], left))
        return sum(1 if s in score else len(s.encode()) for s in sym if s is not None)

    def _rest(self, pre_token: str) -> int:
        """Merged tokens of a pre-token that is not proven whole, cut once more where no piece joins two characters."""
        n = self.memo.get(pre_token)
        if n is None:
            n, start, single = 0, 0, self.single
            for i in range(1, len(pre_token) + 1):
                if i == len(pre_token) or pre_token[i - 1 : i + 1] not in self.joined:
                    part = pre_token[start:i]
                    n += 1 if part in single else self._merge(part)
                    start = i
            if len(pre_token) <= MEMO_CHARS:
                if len(self.memo) > MAX_MEMO:
                    self.memo.clear()
                self.memo[pre_token] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        single, rest, total = self.single, self._rest, 0
        for pre_token, times in Counter(self.cut(SPACE + text.replace(" ", SPACE))).items():
            total += times if pre_token in single else times * rest(pre_token)
        return total


_counters: dict[str, PieceCounter] = {}


def count_tokens(df: DataFrame, text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens (both long) to every row.

    A map over rows: no shuffle, whole texts of any length, memory bounded by a batch. Null texts
    count as empty (0 bytes, 0 tokens); repeated rows are each counted; an empty table stays empty;
    input columns named n_bytes or n_tokens are replaced. model_path must be readable on every executor.
    """
    small_batches(df.sparkSession)
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    df = without(df, ["n_bytes", "n_tokens"])
    at = df.columns.index(text_col)

    def run(batches):
        if path not in _counters:
            _counters[path] = PieceCounter(path)
        counter = _counters[path]
        for batch in batches:
            texts = batch.column(at)
            sizes = texts.cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(b or b"") for b in sizes], pa.int64()), pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())],
                names=[*batch.schema.names, "n_bytes", "n_tokens"],
            )

    return df.mapInArrow(run, extended(df, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]))


def over_limit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model_path: str | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and whether the tokens exceed a context limit."""
    counted = count_tokens(df.select(id_col, text_col), text_col, model_path)
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
