"""Plug points for models: callables in, tables out. No model comes with the engine.

A factory is called once in each task and returns the model's function, so that a model is loaded once
for all the rows of a task. Errors become values: a row that fails carries its error and stops nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe import schema as S
from speechframe.functions.text import estimate_tokens, time_range
from speechframe.functions.typed import first_json_object, is_usable_embedding
from speechframe.operators.intervals import clean_intervals, select_intervals
from speechframe.operators.voices import average_unit_vectors


def retrying(call: Callable, tries: int = 3, delay: float = 1.0, retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call with up to so many tries, waiting twice as long before each next one."""

    def wrapped(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception as error:
                if n + 1 == tries or not retryable(error):
                    raise
                sleep(delay * 2**n)

    return wrapped


def transcribe(audio: DataFrame, factory: Callable[[], Callable[[str], list[tuple[float, float, str]]]]) -> DataFrame:
    """meeting_id, seq, start, end, text of recordings (meeting_id, path) by a speech model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            rows = [(r.meeting_id, n, *seg) for r in batch.itertuples() for n, seg in enumerate(model(r.path))]
            yield pd.DataFrame(rows, columns=["meeting_id", "seq", "start", "end", "text"])

    return audio.select("meeting_id", "path").mapInPandas(run, S.SEGMENTS)


def diarize(audio: DataFrame, factory: Callable[[], Callable[[str], list[tuple[float, float, str]]]]) -> DataFrame:
    """meeting_id, turn_idx, start, end, speaker of recordings by a diarizer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            rows = [(r.meeting_id, n, *turn) for r in batch.itertuples() for n, turn in enumerate(model(r.path))]
            yield pd.DataFrame(rows, columns=["meeting_id", "turn_idx", "start", "end", "speaker"])

    return audio.select("meeting_id", "path").mapInPandas(run, S.TURNS)


def embed(intervals: DataFrame, factory: Callable[[], Callable[[str, float, float], list[float] | None]]) -> DataFrame:
    """The intervals (meeting_id, speaker, path, start, end) with their vectors; null where the model fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    v = model(r.path, r.start, r.end)
                except Exception:
                    v = None
                out.append(None if v is None else [float(x) for x in v])
            yield batch.assign(embedding=pd.Series(out, index=batch.index, dtype=object))

    d = intervals.select("meeting_id", "speaker", "path", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return d.mapInPandas(run, "meeting_id string, speaker string, path string, start double, end double, embedding array<double>")


def extract_voiceprints(turns: DataFrame, audio: DataFrame, factory: Callable) -> DataFrame:
    """meeting_id, speaker, embedding, seconds, segment_count from each speaker's clean stretches, cut to the recording (meeting_id, path, duration)."""
    chosen = select_intervals(clean_intervals(turns)).join(audio.select("meeting_id", "path", "duration"), "meeting_id")
    inside = chosen.withColumn("end", F.least("end", "duration")).where(F.col("end") - F.col("start") >= S.MIN_INTERVAL_SECONDS)
    vectors = embed(inside, factory).where(is_usable_embedding(F.col("embedding"))).withColumn("ord", F.col("start"))
    mean = average_unit_vectors(vectors, ["meeting_id", "speaker"]).drop("n")
    used = vectors.groupBy("meeting_id", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 1).alias("seconds"), F.count("*").cast("int").alias("segment_count"))
    return mean.join(used, ["meeting_id", "speaker"])


def complete(prompts: DataFrame, factory: Callable[[], Callable[[str, int], tuple[str, bool]]], max_tokens: int, notice: str = "\n\n[truncated]") -> DataFrame:
    """prompts with value and error: the text model's answer. A cut answer is asked for again once with twice the tokens, and then kept under a notice."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = retrying(factory())
        for batch in batches:
            values, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    text, cut = model(prompt, max_tokens)
                    if cut:
                        text, cut = model(prompt, 2 * max_tokens)
                    values.append(text + notice if cut else text)
                    errors.append(None)
                except Exception as error:
                    values.append(None)
                    errors.append(str(error))
            yield batch.assign(value=pd.Series(values, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    return prompts.mapInPandas(run, schema)


def guess_names(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """meeting_id, label, name, evidence of model answers (meeting_id, answer): the entries for asked labels whose name is a string and not blank."""
    v = answers.select("meeting_id", F.try_parse_json(first_json_object("answer")).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = v.select("meeting_id", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("label", "e"))
    text = lambda n: F.when(F.schema_of_variant(F.try_variant_get("e", n, "variant")) == "STRING", F.trim(F.try_variant_get("e", n, "string")))
    typed = each.where(F.schema_of_variant("e").startswith("OBJECT")).select("meeting_id", "label", text("$.name").alias("name"), F.coalesce(text("$.evidence"), F.lit("")).alias("evidence"))
    return typed.where("name <> ''").join(labels.select("meeting_id", "label"), ["meeting_id", "label"], "left_semi")


def summary_plan(transcripts: DataFrame, threshold: int = S.SINGLE_CALL_THRESHOLD) -> DataFrame:
    """meeting_id, tokens, plan: one call where the transcript fits the threshold, else map and reduce."""
    return transcripts.select("meeting_id", estimate_tokens(F.col("md")).alias("tokens")).withColumn("plan", F.when(F.col("tokens") <= threshold, "single").otherwise("map_reduce"))


def reduce_input(parts: DataFrame, notice: str = "\n\n[truncated]") -> DataFrame:
    """meeting_id, text: the successful answers (chunk, value, error) in order, without the notice of a cut one; meetings of which all failed carry an error."""
    ok = F.when(F.col("error").isNull(), F.replace("value", F.lit(notice), F.lit("")))
    g = parts.withColumn("__v", ok).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("chunk", "__v")))).alias("p"))
    return g.select("meeting_id", F.array_join(F.transform("p", lambda x: x["__v"]), "\n\n").alias("text"), F.when(F.size("p") == 0, F.lit("every part failed")).alias("error"))


def timeline(parts: DataFrame, placeholder: str = "(this part could not be summarised)") -> DataFrame:
    """meeting_id, md: a heading with the time range and the answer of every chunk (chunk, start_seconds, end_seconds, value), failed ones under a placeholder."""
    block = F.concat(F.lit("### "), time_range(F.col("start_seconds"), F.col("end_seconds")), F.lit("\n\n"), F.coalesce("value", F.lit(placeholder)))
    g = parts.withColumn("__b", block).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "__b"))).alias("p"))
    return g.select("meeting_id", F.array_join(F.transform("p", lambda x: x["__b"]), "\n\n").alias("md"))


def first_sentences(prompt: str, max_tokens: int) -> tuple[str, bool]:
    """Stand-in for a text model in tests: the first line of each block, within the budget."""
    lines = [b.strip().split("\n")[0] for b in prompt.split("\n\n") if b.strip()]
    text = "\n".join(lines)
    most = int(max_tokens * S.CHARS_PER_TOKEN)
    return text[:most], len(text) > most
