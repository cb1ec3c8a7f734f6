"""Words as JVM expressions: A-Z lower-cased, runs of digits, letters and anything beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import WORD

#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Size of the bitmaps that pre-select words: 2^20 bits at any size of the word list.
BITMAP_LONGS = 1 << 14


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() alone would change É as well."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).otherwise(F.transform(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), lower_ascii))


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITMAP_LONGS * 64))


class WordBitmap:
    """A fixed-size bitmap of the words of a DataFrame column: no false negatives, and a join behind it settles the rest."""

    def __init__(self, df: DataFrame, word_col: str):
        bit = _bit(F.col(word_col))
        rows = df.groupBy(F.shiftright(bit, 6).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).collect()
        longs = [0] * BITMAP_LONGS
        for row in rows:
            longs[row.i] = row.bits
        self.longs = longs

    def has(self, word: Column) -> Column:
        bit = _bit(word)
        held = F.get(F.lit(self.longs).cast("array<bigint>"), F.shiftright(bit, 6).cast("int"))
        return F.call_function("getbit", held, (bit % 64).cast("int")) == 1

