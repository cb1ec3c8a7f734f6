"""Column functions over strings: measures, clocks, names, paths and Markdown lines. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechframe import schema as S

_EDGES = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends; trim() would take off spaces alone."""
    return F.regexp_replace(text, _EDGES, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def lines(text: Column) -> Column:
    """Lines at any line boundary of Unicode."""
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)


def estimate_tokens(text: Column) -> Column:
    """Tokens by a fixed number of characters each, rounded up."""
    return F.ceil(F.char_length(text) / F.lit(S.CHARS_PER_TOKEN))


def parse_timestamp(clock: Column) -> Column:
    """Seconds of MM:SS; minutes may have any number of digits. Null for anything else."""
    return F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("int")


def format_timestamp(seconds: Column) -> Column:
    """MM:SS of the whole seconds; minutes never roll over into hours."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d", F.call_function("div", s, F.lit(60)), s % 60)


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.call_function("div", s, F.lit(3600)), F.call_function("div", s, F.lit(60)) % 60, s % 60)


def format_spoken(seconds: Column) -> Column:
    """'M min S sec', or 'S sec' under a minute."""
    s = F.round(seconds).cast("bigint")
    return F.when(s >= 60, F.format_string("%d min %d sec", F.call_function("div", s, F.lit(60)), s % 60)).otherwise(F.format_string("%d sec", s))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(format_timestamp(start), F.lit("–"), format_timestamp(end))


def demote_headings(markdown: Column, floor: int = 4) -> Column:
    """Headings of fewer than floor hashes get floor hashes; other lines stay."""
    def demoted(line: Column) -> Column:
        hashes = F.regexp_extract(line, r"^(#{1,6})[ \t]+", 1)
        return F.when(hashes == "", line).otherwise(F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(floor), F.length(hashes))), F.lit(" "), F.regexp_replace(line, r"^#{1,6}[ \t]+", "")))

    return F.array_join(F.transform(F.split(markdown, "\n", -1), demoted), "\n")


def clean_name(name: Column) -> Column:
    """One line of at most NAME_LENGTH characters, free of the marks that transcripts use."""
    spaced = F.regexp_replace(name, r"(?U)\s+", " ")
    return F.left(strip(F.translate(spaced, "*[]`", "")), F.lit(S.NAME_LENGTH))


def split_forms(raw: Column) -> Column:
    """The parts between commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(raw, ",", -1), strip), lambda x: x != "")


def strip_comment(line: Column) -> Column:
    """Without a trailing comment; the hash must follow white space, so 'C#' stays."""
    return strip(F.regexp_replace(line, r"(?U)\s+#.*$", ""))


def has_markup(term: Column) -> Column:
    return term.rlike(r"[*\[\]]")


def is_safe_name(name: Column) -> Column:
    """Whether a name is a plain file name: not empty, no dots alone, no separators."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\]"), F.lit(False))


def safe_child(root: Column, name: Column) -> Column:
    """root/name where name stays below root and isn't root itself, else null."""
    return F.when(is_safe_name(name), F.concat(root, F.lit("/"), name))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension, for both kinds of slashes."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def job_path(audio_path: Column) -> Column:
    return F.concat(F.regexp_replace(audio_path, r"\.[^./\\]*$", ""), F.lit(".job.json"))


def suggested_name(file_name: Column) -> Column:
    return clean_name(stem(file_name))


def safe_stem(name: Column) -> Column:
    return strip(F.translate(name, '<>:"/\\|?*', "_________"))


def concat_quoted(path: Column) -> Column:
    """A path inside single quotes of a concat list: each quote ends the string, stands escaped and opens it again."""
    return F.replace(path, F.lit("'"), F.lit("'\\''"))


def concat_line(path: Column) -> Column:
    return F.concat(F.lit("file '"), concat_quoted(path), F.lit("'"))


def part_filename(index: Column) -> Column:
    return F.format_string("part%04d.wav", index)


def session_dir(inbox: Column, stem_: Column) -> Column:
    return F.concat(inbox, F.lit("/.session-"), stem_)


def recording_filename(name: Column, at: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.date_format(at, "-HH-mm-ss"), F.lit(".ogg"))).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd_HH-mm-ss"), F.lit(".ogg")))


_UNNAMED = r"^(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-\d{2}$"
_NAMED = r"^(.+)-(\d{2})-(\d{2})-\d{2}$"


def recording_day(name: Column, finished_at: Column) -> Column:
    """Day of a recording: the date in its stem; else the finishing day, or the day before where the stem's time is later than the finish."""
    started = F.try_to_timestamp(F.concat(F.date_format(finished_at, "yyyy-MM-dd "), F.regexp_extract(name, _NAMED, 2), F.lit(":"), F.regexp_extract(name, _NAMED, 3)), F.lit("yyyy-MM-dd HH:mm"))
    day = finished_at.cast("date")
    return (
        F.when(name.rlike(_UNNAMED), F.regexp_extract(name, _UNNAMED, 1).try_cast("date"))
        .when(name.rlike(_NAMED), F.when(started > finished_at.cast("timestamp"), F.date_sub(day, 1)).otherwise(day))
        .otherwise(day)
    )


def folder_name(name: Column, day: Column) -> Column:
    """'YYYY-MM-DD_HH-MM', with '-topic' where the stem has one; 'day_stem' for other stems."""
    date = F.date_format(day, "yyyy-MM-dd")
    return (
        F.when(name.rlike(_UNNAMED), F.concat(F.regexp_extract(name, _UNNAMED, 1), F.lit("_"), F.regexp_extract(name, _UNNAMED, 2), F.lit("-"), F.regexp_extract(name, _UNNAMED, 3)))
        .when(name.rlike(_NAMED), F.concat(date, F.lit("_"), F.regexp_extract(name, _NAMED, 2), F.lit("-"), F.regexp_extract(name, _NAMED, 3), F.lit("-"), F.regexp_extract(name, _NAMED, 1)))
        .otherwise(F.concat(date, F.lit("_"), name))
    )


def fingerprint(name: Column, size: Column, mtime: Column, model: Column) -> Column:
    """Cache key of 16 hex digits over name, size, whole seconds of the modification time and model."""
    return F.left(F.sha2(F.concat_ws("|", name, size.cast("string"), mtime.cast("bigint").cast("string"), model), 256), F.lit(16))


def response_detail(body: Column, limit: int = 400) -> Column:
    """The error message of a JSON answer, or the answer, cut to limit characters."""
    return F.left(F.coalesce(F.get_json_object(body, "$.error.message"), body), F.lit(limit))


def read_bool(value: Column, default: bool) -> Column:
    word = F.lower(strip(value))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def read_overlap(value: Column) -> Column:
    n = strip(value).try_cast("int")
    return F.when(n.between(0, S.CHUNK_MAX_TOKENS - 1), n).otherwise(F.lit(S.CHUNK_OVERLAP_TOKENS))


def read_float(value: Column, default: float) -> Column:
    return F.coalesce(strip(value).try_cast("double"), F.lit(default))


def read_command(value: Column) -> Column:
    """A JSON list of strings alone; an empty array for anything else."""
    v = F.try_parse_json(value)
    plain = F.schema_of_variant(v) == "ARRAY<STRING>"
    return F.when(plain, F.try_variant_get(v, "$", "array<string>")).otherwise(F.array().cast("array<string>"))


def peak_dbfs(peak: Column) -> Column:
    return F.when(peak > 0, 20 * F.log10(peak)).otherwise(F.lit(float("-inf")))


def format_db(db: Column, silent: str = "silent") -> Column:
    return F.when(db == float("-inf"), F.lit(silent)).otherwise(F.format_string("%.1f dBFS", db))


def mic_level(db: Column) -> Column:
    return F.when(db >= S.MIC_OK_DB, "ok").when(db >= S.MIC_WARN_DB, "warn").otherwise("fail")


def loopback_level(db: Column) -> Column:
    return F.when(db >= S.LOOPBACK_OK_DB, "ok").otherwise("warn")


def samplerate_level(mic: Column, loopback: Column) -> Column:
    return F.when(mic.eqNullSafe(loopback), "ok").otherwise("fail")


def is_retryable(status: Column, error: Column) -> Column:
    """Unusable answers and missing settings never; no status, 408, 409, 429 and from 500 on: yes."""
    again = F.coalesce(status.isin(408, 409, 429) | (status >= 500), F.lit(True))
    return again & ~F.coalesce(error.isin("UnusableAnswer", "MissingSetting"), F.lit(False))


def enroll_chip(state: Column, status: Column) -> Column:
    return F.when(state == "idle", "idle").when(state == "queued", "queued").when(status == "ok", "ok").otherwise("bad")


def fill_template(template: Column, params: Column) -> Column:
    """Each {key} of a template by its value; the raw template where a key has none."""
    filled = F.aggregate(F.map_entries(params), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    wanted = F.transform(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)), lambda k: F.map_contains_key(params, k))
    return F.when(F.coalesce(F.forall(wanted, lambda x: x), F.lit(False)), filled).otherwise(template)


def fill_prompt(base: Column, glossary: Column, carryover: Column, rules: Column) -> Column:
    out = F.replace(base, F.lit("{glossary}"), strip(F.coalesce(glossary, F.lit(""))))
    out = F.replace(out, F.lit("{carryover}"), strip(F.coalesce(carryover, F.lit(""))))
    return strip(F.replace(out, F.lit("{profile_rules}"), strip(F.coalesce(rules, F.lit("")))))


def known_profile(profile: Column) -> Column:
    return F.when(profile.isin(*S.PROFILES), profile).otherwise(F.lit(S.DEFAULT_PROFILE))


def profile_of(text: Column) -> Column:
    """Value of the first profile line; null where there is none or it is blank."""
    found = F.filter(F.transform(lines(text), strip), lambda x: F.startswith(x, F.lit(S.PROFILE_PREFIX)))
    return blank_to_null(F.substr(F.get(found, F.lit(0)), F.lit(len(S.PROFILE_PREFIX) + 1)))


def profile_of_meeting(meta: Column, summary: Column) -> Column:
    """The meta text decides alone where it exists, even if it names no profile."""
    return F.when(meta.isNotNull(), profile_of(meta)).otherwise(profile_of(summary))


def section_body(text: Column, heading: str) -> Column:
    """The '- ' lines under a heading up to the next '## ' or '---'; empty where the heading is missing."""
    stripped = F.transform(lines(text), strip)
    at = F.array_position(stripped, heading)
    rest = F.slice(stripped, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(stripped))
    stop = F.array_position(F.transform(rest, lambda x: F.startswith(x, F.lit("## ")) | (x == "---")), True)
    body = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop, F.lit(1)).cast("int") - 1)).otherwise(rest)
    return F.when(at > 0, F.array_join(F.filter(body, lambda x: F.startswith(x, F.lit("- "))), "\n")).otherwise(F.lit(""))


def quoted_pattern(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quoted_replacement(text: Column) -> Column:
    """A replacement that stands for the text itself."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def rename_label(markdown: Column, old: Column, new: Column) -> Column:
    """The old label at the heads of blocks becomes the new one; the same label inside sentences stays."""
    pattern = F.concat(F.lit(r"(?m)^\*\*"), quoted_pattern(old), F.lit(r"\*\* \["))
    return F.regexp_replace(markdown, pattern, F.concat(F.lit("**"), quoted_replacement(new), F.lit("** [")))


def replace_participants(summary: Column, line: Column) -> Column:
    """The summary without its participants lines, under the given line where that isn't empty."""
    kept = F.filter(lines(summary), lambda x: ~F.startswith(strip(x), F.lit(S.PARTICIPANTS_PREFIX)))
    return F.array_join(F.filter(F.array(F.coalesce(line, F.lit("")), strip(F.array_join(kept, "\n"))), lambda x: x != ""), "\n\n")


def count_occurrences(text: Column, term: Column) -> Column:
    """Times the term occurs in the text without overlap."""
    return F.call_function("div", F.char_length(text) - F.char_length(F.replace(text, term)), F.char_length(term))


def wrap_open_items(items: Column, head: str, tail: str) -> Column:
    return F.when(F.coalesce(strip(items), F.lit("")) != "", F.concat(F.lit(head), strip(items), F.lit(tail))).otherwise(F.lit(""))
