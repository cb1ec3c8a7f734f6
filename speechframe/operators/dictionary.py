"""Term dictionaries: parsing, rewriting with counts, audits and the word lists made of them.

A dictionary is a table (section, correct, correct_ord, wrong, wrong_ord, line) of any size. Its forms are
found in a single pass over each text, however many there are (matching.py); headers of transcript blocks
are matched before any form and pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import blank_to_null, has_markup, split_forms, strip, strip_comment
from speechframe.operators.matching import Forms, places, rewritten, tallied


def _sections(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value) under their section, without blank lines, headings and comments."""
    heading = r"(?U)^##\s+([\w-]+)\s*$"
    text = lines.select("file", "line", strip(F.col("value")).alias("value")).where("value <> ''")
    w = W.partitionBy("file").orderBy("line")
    named = text.withColumn("section", F.last(F.when(F.col("value").rlike(heading), F.regexp_extract("value", heading, 1)), ignorenulls=True).over(w))
    return named.where(~F.startswith("value", F.lit("#"))).withColumn("value", strip_comment(F.col("value"))).where("value <> ''")


def _keyed(df: DataFrame, value: Column) -> DataFrame:
    """key and parts of 'key: a, b' lines; malformed ones drop out."""
    at = F.instr(value, ":")
    d = df.where(at > 0).withColumn("key", strip(F.left(value, at - 1))).withColumn("parts", split_forms(F.substr(value, at + 1)))
    return d.where((F.col("key") != "") & (F.size("parts") > 0))


def parse_glossary(lines: DataFrame) -> DataFrame:
    """Dictionary rows of glossary lines (file, line, value); a term declared again adds its new forms to the first declaration."""
    rows = _keyed(_sections(lines).where(F.col("section").isin(*S.DICTIONARY_SECTIONS)), F.col("value"))
    rows = rows.where(~has_markup(F.col("key")) & ~F.exists("parts", has_markup))
    each = rows.select("file", "section", F.col("key").alias("correct"), "line", F.posexplode("parts").alias("pos", "wrong"))
    w = W.partitionBy("file", "section", "correct", "wrong").orderBy("line", "pos")
    first = F.min("line").over(W.partitionBy("file", "section", "correct"))
    kept = each.withColumn("correct_ord", first).withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) | (F.col("line") == F.col("correct_ord")))
    return kept.withColumn("wrong_ord", F.row_number().over(W.partitionBy("file", "section", "correct").orderBy("line", "pos"))).select("file", "section", "correct", "correct_ord", "wrong", "wrong_ord", "line")


def duplicate_keys(lines: DataFrame) -> DataFrame:
    """section, term, lines: terms that a section declares more than once."""
    rows = _keyed(_sections(lines).where(F.col("section").isin(*S.DICTIONARY_SECTIONS)), F.col("value"))
    rows = rows.where(~has_markup(F.col("key")) & ~F.exists("parts", has_markup))
    return rows.groupBy("section", F.col("key").alias("term")).agg(F.array_sort(F.collect_list("line")).alias("lines")).where(F.size("lines") > 1)


def format_duplicates(duplicates: DataFrame) -> DataFrame:
    return duplicates.select(F.concat(F.lit("["), "section", F.lit('] "'), "term", F.lit('" is declared on lines '), F.array_join(F.col("lines").cast("array<string>"), ", ")).alias("message"))


def parse_ambiguous(lines: DataFrame) -> DataFrame:
    """term, meanings (team to meaning), line of 'term | team = meaning | ...' lines; the later of repeated teams wins."""
    parts = F.transform(F.split("value", r"\|", -1), strip)
    rows = _sections(lines).where("section = 'ambiguous'").withColumn("p", parts).where("p[0] <> '' AND size(p) > 1")
    each = rows.select("file", "line", F.col("p")[0].alias("term"), F.posexplode(F.slice("p", 2, 1 << 20)).alias("pos", "m"))
    at = F.instr("m", "=")
    each = each.withColumn("team", F.when(at > 0, blank_to_null(F.left(F.col("m"), at - 1)))).withColumn("meaning", F.when(at > 0, blank_to_null(F.substr(F.col("m"), at + 1))))
    whole = each.groupBy("file", "line", "term", "team").agg(F.max_by("meaning", "pos").alias("meaning"), F.min("pos").alias("pos"), F.bool_and(F.col("team").isNotNull() & F.col("meaning").isNotNull()).alias("ok"))
    g = whole.groupBy("file", "line", "term").agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "team", "meaning"))).alias("m"))
    return g.where("ok").select("file", "line", "term", F.map_from_entries(F.transform("m", lambda x: F.struct(x["team"], x["meaning"]))).alias("meanings"))


def parse_teams(lines: DataFrame) -> DataFrame:
    """team, names, line of 'team: a, b' lines; a team declared again replaces the first."""
    text = lines.select("file", "line", strip(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    rows = _keyed(text.withColumn("value", strip_comment(F.col("value"))), F.col("value"))
    return rows.groupBy("file", F.col("key").alias("team")).agg(F.max_by("parts", "line").alias("names"), F.min("line").alias("line"))


class Rewriter:
    """The forms of some sections, replaced from left to right, the longest first; headers of blocks pass unchanged.

    A form of several terms stands for the one declared last. Dictionaries of any size are taken.
    """

    def __init__(self, dictionary: DataFrame, sections: tuple[str, ...]):
        d = dictionary.where(F.col("section").isin(*sections) & (F.col("wrong") != ""))
        self.forms = Forms(d.groupBy("wrong").agg(F.max_by("correct", F.struct("correct_ord", "wrong_ord")).alias("correct")))

    def scanned(self, docs: DataFrame, text: str, into: str = "__r") -> DataFrame:
        """docs with a struct of the corrected text and hits, how often each correct term came in."""
        return rewritten(docs, self.forms, text, S.HEADER, into)

    def counted(self, docs: DataFrame, text: str, key: str) -> DataFrame:
        """key, term, n: hits of each document by their correct term."""
        hits = self.scanned(docs.select(key, text), text).select(key, F.explode("__r.hits").alias("h"))
        return hits.groupBy(key, F.col("h.term").alias("term")).agg(F.sum("h.n").alias("n"))


def apply_exact(docs: DataFrame, dictionary: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with their text corrected, counts (key, term, n)): exact forms first, aliases on what that leaves."""
    exact, aliases = Rewriter(dictionary, ("exact",)), Rewriter(dictionary, ("aliases",))
    once = exact.scanned(docs, text, "__once").withColumn(text, F.col("__once.text"))
    twice = aliases.scanned(once, text, "__twice")
    hits = twice.select(key, F.explode(F.concat("__once.hits", "__twice.hits")).alias("h"))
    counts = hits.groupBy(key, F.col("h.term").alias("term")).agg(F.sum("h.n").alias("n"))
    return twice.withColumn(text, F.col("__twice.text")).drop("__once", "__twice"), counts


def count_only(docs: DataFrame, dictionary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts of the forms that a model is to interpret; nothing is rewritten."""
    return Rewriter(dictionary, ("fuzzy", "project-names")).counted(docs, text, key)


def busiest_first(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "term")


def hotwords(dictionary: DataFrame, limit: int = S.HOTWORD_CHARS) -> DataFrame:
    """ord, term: distinct correct terms, those without a rewrite first, until the next one would pass the limit with its separator.

    The running length needs one order over the whole dictionary, which is a bounded dimension.
    """
    rank = F.create_map(*[F.lit(x) for pair in (("fuzzy", 0), ("project-names", 1), ("exact", 2)) for x in pair])
    d = dictionary.where(F.col("section").isin("fuzzy", "project-names", "exact"))
    terms = d.groupBy(F.col("correct").alias("term")).agg(F.min(F.struct(rank[F.col("section")].alias("s"), F.col("correct_ord").alias("o"))).alias("k"))
    w = W.orderBy("k", "term")
    sized = terms.withColumn("__len", F.sum(F.char_length("term") + 2).over(w) - 2).withColumn("ord", F.row_number().over(w))
    return sized.where(F.col("__len") <= limit).select("ord", "term")


def hotwords_text(dictionary: DataFrame, limit: int = S.HOTWORD_CHARS) -> DataFrame:
    return hotwords(dictionary, limit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]), ", ").alias("hotwords"))


def prompt_blocks(dictionary: DataFrame, heads: dict[str, str]) -> DataFrame:
    """section, block: for each section named in heads, a heading and a line 'correct ← forms' for each term."""
    d = dictionary.where(F.col("section").isin(*heads))
    terms = d.groupBy("section", "correct").agg(F.min("correct_ord").alias("o"), F.array_sort(F.collect_list(F.struct("wrong_ord", "wrong"))).alias("f"))
    line = F.concat(F.lit("- "), "correct", F.lit(" ← "), F.array_join(F.transform("f", lambda x: x["wrong"]), ", "))
    g = terms.withColumn("line", line).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("o", "correct", "line"))).alias("l"))
    head = F.create_map(*[F.lit(x) for pair in heads.items() for x in pair])
    return g.select("section", F.concat(head[F.col("section")], F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("block"))


def find_collisions(dictionary: DataFrame) -> DataFrame:
    """kind, severity, section, wrong, correct, other: replacing forms that would do harm.

    inside_correct (heavy): the form lies inside another correct term; inside_wrong (light): inside a
    form of another term; short (light): fewer than MIN_SAFE_LENGTH characters; self (light): it maps to
    itself. The terms are searched for all forms at once, and what is found is joined by the form.
    """
    forms = dictionary.where(F.col("section").isin(*S.REPLACING_SECTIONS)).select("section", "wrong", "correct").where("wrong <> ''").distinct()
    index = Forms(forms.select("wrong").distinct())

    def within(terms: DataFrame) -> DataFrame:
        return places(terms, index, "other").drop("at").join(forms, "wrong")

    def rows(found: DataFrame, kind: str, severity: str, other: Column) -> DataFrame:
        return found.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "section", "wrong", "correct", other.alias("other"))

    terms = dictionary.select(F.col("correct").alias("other")).distinct()
    heavy = rows(within(terms).where("wrong <> other"), "inside_correct", "heavy", F.col("other"))
    others = forms.select(F.col("wrong").alias("other"), F.col("correct").alias("__oc")).distinct()
    light = rows(within(others).where("wrong <> other AND correct <> __oc"), "inside_wrong", "light", F.col("other")).distinct()
    none = F.lit(None).cast("string")
    short = rows(forms.where(F.char_length(strip(F.col("wrong"))) < S.MIN_SAFE_LENGTH), "short", "light", none)
    return heavy.unionByName(light).unionByName(short).unionByName(rows(forms.where("wrong = correct"), "self", "light", none))


def _forms(dictionary: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    return dictionary.where(F.col("section").isin(*sections) & (F.col("wrong") != "")).select("wrong").distinct()


def count_in_transcripts(dictionary: DataFrame, docs: DataFrame) -> DataFrame:
    """wrong, hits, meetings: how often each form occurs and in how many documents (text), with zeros. Texts pass once and combine before the shuffle."""
    forms = _forms(dictionary, S.DICTIONARY_SECTIONS)
    found = tallied(docs.select("text"), Forms(forms), "text").groupBy("wrong").agg(F.sum("n").alias("hits"), F.count("*").alias("meetings"))
    return forms.join(found, "wrong", "left").select("wrong", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"), F.coalesce("meetings", F.lit(0)).cast("bigint").alias("meetings"))


def sample_context(dictionary: DataFrame, docs: DataFrame, key: str, count: int = S.EXAMPLES_PER_TERM, around: int = S.CONTEXT_CHARS) -> DataFrame:
    """wrong, example, key, pos, snippet: the first places of each replacing form by key and place, with the text around.

    A document hands on its first places only, and a task the first of its documents, before rows are shuffled by form.
    """
    found = places(docs.select(key, "text"), Forms(_forms(dictionary, S.REPLACING_SECTIONS)), "text")

    def cut(pos: Column) -> Column:
        start = F.greatest(F.lit(0), pos - around)
        return F.struct(pos.alias("pos"), F.translate(F.substr(F.col("text"), start + 1, pos - start + F.char_length("wrong") + around), "\n", " ").alias("snippet"))

    each = found.select("wrong", key, F.explode(F.transform(F.slice("at", 1, count), cut)).alias("c")).select("wrong", key, "c.pos", "c.snippet")
    w = W.partitionBy("wrong").orderBy(key, "pos", "snippet")
    return each.withColumn("example", F.row_number().over(w)).where(F.col("example") <= count).select("wrong", "example", key, "pos", "snippet")


def audit(dictionary: DataFrame, docs: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """The report of a dictionary: collisions, the top forms in use, and the forms that never occur."""
    tally = count_in_transcripts(dictionary, docs)
    return {"collisions": find_collisions(dictionary), "alive": tally.where("hits > 0").orderBy(F.desc("hits"), "wrong").limit(top), "dead": tally.where("hits = 0")}

