"""Leaves of untrusted JSON, read only where they have the declared type, and privacy projections over them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe import schema as S
from speechframe.functions.text import blank_to_null

_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def leaf(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def as_str(v: Column) -> Column:
    """The value of a variant if it is a string, else null: numbers don't become text."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_number(v: Column) -> Column:
    """The value if it is a number and no boolean, else null."""
    return F.when(_kind(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double"))


def as_bool(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def is_numeric_vector(v: Column) -> Column:
    """Whether the value is a list, not empty, of numbers alone."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(_kind(x).rlike(_NUMBER), F.lit(False))), F.lit(False))


def is_usable_embedding(vector: Column) -> Column:
    """Not empty, finite throughout, and of a squared norm that is a normal finite double."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    norm = F.aggregate(F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x * x)
    return F.coalesce((F.size(vector) > 0) & finite & norm.between(2.2250738585072014e-308, 1.7976931348623157e308), F.lit(False))


def embedding_model(stamp: Column) -> Column:
    """The stripped stamp, or null where blank."""
    return blank_to_null(stamp)


def render_param(v: Column) -> Column:
    """Text of a scalar, cut to PARAM_CHARS; null for lists and objects."""
    number = as_number(v)
    as_text = F.when(number == F.floor(number), F.try_variant_get(v, "$", "string")).otherwise(number.cast("string"))
    text = F.coalesce(as_bool(v).cast("string"), as_str(v), F.when(_kind(v).rlike(_NUMBER), as_text))
    return F.left(text, F.lit(S.PARAM_CHARS))


def _scalar(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _pruned(x):
    """x without the lists of numbers anywhere below it; None stands for such a list itself."""
    if isinstance(x, dict):
        return {k: y for k, v in x.items() if not (isinstance(v, list) and v and all(map(_scalar, v))) for y in [_pruned(v)]}
    if isinstance(x, list):
        return None if x and all(map(_scalar, x)) else [_pruned(v) for v in x if not (isinstance(v, list) and v and all(map(_scalar, v)))]
    return x


@F.pandas_udf(T.StringType())
def drop_numeric_vectors(text: pd.Series) -> pd.Series:
    """JSON text without the vectors at any depth; null for text that isn't JSON. Its schema is unknown, which no built-in function walks."""

    def one(t):
        try:
            return None if t is None else json.dumps(_pruned(json.loads(t)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first JSON object that starts at any brace of the text, whatever surrounds it; null without one."""
    decoder = json.JSONDecoder()

    def one(t):
        at = -1 if t is None else t.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(t, at)[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                at = t.find("{", at + 1)
        return None

    return text.map(one)


def public_sample(v: Column) -> Column:
    """Of a sample line, its text and times alone."""
    return F.struct(as_str(leaf(v, "$.text")).alias("text"), as_number(leaf(v, "$.start")).alias("start"), as_number(leaf(v, "$.end")).alias("end"))


def public_guess(v: Column) -> Column:
    return F.when(_kind(v).startswith("OBJECT"), F.struct(as_str(leaf(v, "$.name")).alias("name"), as_str(leaf(v, "$.evidence")).alias("evidence")))


def public_suggested(v: Column) -> Column:
    return F.when(_kind(v).startswith("OBJECT"), F.struct(as_str(leaf(v, "$.name")).alias("name")))


def public_speaker(v: Column) -> Column:
    """Of a queue entry, the fields that a client may see; vectors never pass."""
    samples = F.coalesce(F.try_variant_get(v, "$.samples", "array<variant>"), F.array().cast("array<variant>"))
    return F.struct(
        as_str(leaf(v, "$.label")).alias("label"),
        public_guess(leaf(v, "$.guess")).alias("guess"),
        F.transform(F.filter(samples, lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))), public_sample).alias("samples"),
        public_suggested(leaf(v, "$.suggested")).alias("suggested"),
        as_number(leaf(v, "$.speaking_seconds")).alias("speaking_seconds"),
    )


def public_meeting(v: Column) -> Column:
    speakers = F.coalesce(F.try_variant_get(v, "$.speakers", "array<variant>"), F.array().cast("array<variant>"))
    return F.struct(as_str(leaf(v, "$.meeting_dir")).alias("meeting_dir"), F.transform(F.filter(speakers, lambda x: F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))), public_speaker).alias("speakers"))


def confirmed_missing(exists: Column, error: Column) -> Column:
    """True only where absence is certain: a failed look-up counts as present."""
    return F.coalesce(~exists & error.isNull(), F.lit(False))
