"""Many literal forms found in texts at once: an Aho-Corasick automaton in each task, Arrow batches through it.

The time of a text doesn't depend on how many forms there are. The forms are dealt into shards of a bounded
size, so a dictionary of any size can be searched: a shard's automaton is in a worker at a time, and the
places that a shard finds travel with the text to the next. What to do with the places is decided at the end.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.sources.sinks import stored

#: Characters of forms in one automaton, which takes some hundred bytes for each.
SHARD_CHARS = 2_000_000
#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 128
#: Automata that a worker keeps: one query may search two layers of a dictionary.
KEPT_AUTOMATA = 2

_automata: dict[str, ahocorasick.Automaton] = {}


class Forms:
    """Distinct non-empty forms (wrong) and, where given, what stands for them (correct), in shards for workers."""

    def __init__(self, forms: DataFrame):
        size = forms.agg(F.coalesce(F.sum(F.char_length("wrong")), F.lit(0))).first()[0]
        n = max(1, math.ceil(size / SHARD_CHARS))
        self.spark = forms.sparkSession
        self.with_correct = "correct" in forms.columns
        self._source = stored(forms, "forms") if n > 1 else forms
        self.shards = [self._shard(F.pmod(F.xxhash64("wrong"), F.lit(n)) == k if n > 1 else F.lit(True)) for k in range(n)]
        self.empty = size == 0

    def _shard(self, mine: Column) -> tuple:
        """A name and the broadcast forms; a shard, not the dictionary, is what the driver holds at a time."""
        rows = self._source.where(mine).select("wrong", *(["correct"] if self.with_correct else [])).collect()
        return uuid.uuid4().hex, self.spark.sparkContext.broadcast([tuple(r) if self.with_correct else (r[0], r[0]) for r in rows])


def _automaton(shard: tuple) -> ahocorasick.Automaton:
    """The shard's automaton in this worker, which keeps the last few; None where the shard has no forms."""
    name, forms = shard
    if name not in _automata:
        while len(_automata) >= KEPT_AUTOMATA:
            del _automata[next(iter(_automata))]
        automaton = ahocorasick.Automaton()
        for wrong, correct in forms.value:
            automaton.add_word(wrong, (len(wrong), wrong, correct))
        automaton.make_automaton()
        _automata[name] = automaton if len(automaton) else None
    return _automata[name]


def longest_at(shard: tuple, text: str) -> dict[int, tuple[int, str]]:
    """By start: length and correct term of the shard's longest form there."""
    automaton, found = _automaton(shard), {}
    for end, (size, _, correct) in automaton.iter(text) if automaton else ():
        start = end - size + 1
        if start not in found or found[start][0] < size:
            found[start] = (size, correct)
    return found


def leftmost(text: str, found: dict[int, tuple[int, str]], skip: re.Pattern | None) -> Iterator[tuple[int, int, str]]:
    """(start, length, correct) from left to right without overlap; what skip matches is passed over, and before any form that starts with it."""
    head, at = skip.search(text) if skip else None, 0
    for start in sorted(found):
        while head and head.start() <= start:
            if head.start() >= at:
                at = head.end()
            head = skip.search(text, max(at, head.start() + 1))
        if start >= at:
            size, correct = found[start]
            yield start, size, correct
            at = start + size


def each_form(shard: tuple, text: str) -> dict[str, list[int]]:
    """By form: its places in a text, each form on its own and without overlapping itself."""
    automaton, places, free = _automaton(shard), {}, {}
    for end, (size, wrong, _) in automaton.iter(text) if automaton else ():
        start = end - size + 1
        if start >= free.get(wrong, 0):
            places.setdefault(wrong, []).append(start)
            free[wrong] = end + 1
    return places


def _mapped(function: Callable, returns: str) -> Callable:
    """function of one row's values as an Arrow UDF: a batch at a time crosses over, other columns stay in the JVM."""

    def run(*columns: pa.Array) -> pa.Array:
        # a few rows at a time as Python objects, which take many times the room of an Arrow batch
        some = ([c.slice(i, SLICE_ROWS).to_pylist() for c in columns] for i in range(0, len(columns[0]), SLICE_ROWS))
        return pa.concat_arrays([pa.array([], type=kind), *(pa.array([function(*row) for row in zip(*part, strict=True)], type=kind) for part in some)])

    kind = _ARROW[returns]
    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


_CANDIDATES = "array<struct<at:int,size:int,correct:string>>"
_REWRITTEN = "struct<text:string,hits:array<struct<term:string,n:bigint>>>"
_PLACES = "array<struct<wrong:string,at:array<int>>>"
_COUNTS = "array<struct<wrong:string,n:int>>"
_ARROW = {
    _CANDIDATES: pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("correct", pa.string())])),
    _REWRITTEN: pa.struct([("text", pa.string()), ("hits", pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))]),
    _COUNTS: pa.list_(pa.struct([("wrong", pa.string()), ("n", pa.int32())])),
    _PLACES: pa.list_(pa.struct([("wrong", pa.string()), ("at", pa.list_(pa.int32()))])),
}


def _resolved(text: str, found: dict[int, tuple[int, str]], skip: re.Pattern | None) -> dict:
    parts, hits, at = [], {}, 0
    for start, size, correct in leftmost(text, found, skip):
        if correct is not None:  # a form without a term stays as it is
            parts += (text[at:start], correct)
            hits[correct] = hits.get(correct, 0) + 1
            at = start + size
    return {"text": "".join([*parts, text[at:]]), "hits": [{"term": t, "n": n} for t, n in hits.items()]}


def rewritten(docs: DataFrame, forms: Forms, text: str, skip: str | None, into: str) -> DataFrame:
    """docs with into, a struct of the text with its leftmost longest forms replaced and of how often each correct term came in; null texts give null."""
    pattern = re.compile(skip, re.ASCII) if skip else None
    if len(forms.shards) == 1:
        shard = forms.shards[0]
        return docs.withColumn(into, _mapped(lambda t: None if t is None else _resolved(t, longest_at(shard, t), pattern), _REWRITTEN)(F.col(text)))
    docs = docs.withColumn("__found", F.array().cast(_CANDIDATES))
    for shard in forms.shards:

        def search(t, shard=shard):
            return [] if t is None else [{"at": a, "size": n, "correct": c} for a, (n, c) in longest_at(shard, t).items()]

        docs = stored(docs.withColumn("__found", F.concat("__found", _mapped(search, _CANDIDATES)(F.col(text)))), "found")

    def resolve(t, found):
        longest = {}
        for c in found:
            if c["at"] not in longest or longest[c["at"]][0] < c["size"]:
                longest[c["at"]] = (c["size"], c["correct"])
        return None if t is None else _resolved(t, longest, pattern)

    return docs.withColumn(into, _mapped(resolve, _REWRITTEN)(F.col(text), F.col("__found"))).drop("__found")


def _each_found(docs: DataFrame, forms: Forms, text: str, kind: str, name: str, value: Callable) -> DataFrame:
    out = None
    for shard in forms.shards:

        def search(t, shard=shard):
            return [] if t is None else [{"wrong": w, name: value(a)} for w, a in each_form(shard, t).items()]

        part = docs.select("*", F.explode(_mapped(search, kind)(F.col(text))).alias("__p")).select("*", "__p.wrong", f"__p.{name}").drop("__p")
        out = part if out is None else out.unionByName(part)
    return out


def places(docs: DataFrame, forms: Forms, text: str) -> DataFrame:
    """docs, a row for each form that a text holds: wrong and at, its places from 0 in order. Each form is looked for on its own."""
    return _each_found(docs, forms, text, _PLACES, "at", lambda at: at)


def tallied(docs: DataFrame, forms: Forms, text: str) -> DataFrame:
    """As places(), with n, the number of places, for at: the places themselves stay in the text's task."""
    return _each_found(docs, forms, text, _COUNTS, "n", len)
