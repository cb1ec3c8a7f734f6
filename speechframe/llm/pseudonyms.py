"""Format-preserving pseudonyms: validated values are permuted, under a key, within their own format.

Each format is a domain of the form Z_a x Z_b (halves of a digit string, of an address, of the days of
400 years). A Feistel network over it, alternately left += F(right) mod a and right += F(left) mod b,
is a permutation of the domain: equal values get equal pseudonyms in all documents, different ones
different pseudonyms, and every pseudonym is a valid value of the same format. F is SHA-256 under the key.
Where a value holds letters and digits, each kind is permuted under what the other holds, so letters stay
letters, upper case stays upper case, and a part of one character is no mere shift.
Everything is a DataFrame expression; texts without a candidate pass through untouched.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days in 400 years, as a * b; domains of dates begin at 1600-01-01 and every 400 years from there.
DATE_A, DATE_B, DATE_BASE = 189, 773, "1600-01-01"
#: Areas 001 to 899 without 666; groups 01 to 99 times serials 0001 to 9999.
SSN_A, SSN_B = 898, 99 * 9999

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = "(?i:password|passwd|pwd|secret|token|api_?key)"
#: Kind to pattern, in order of precedence. Quantifiers are bounded or possessive, so long runs cost linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "access key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "service token": r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abp]-[A-Za-z0-9\-]{10,}+)",
    "password": rf"(?<![A-Za-z0-9]){_WORD}[\"']?(?:[=:][\"']?| ?[=:] ?[\"']| ?[=:] ?(?=[^\s\"'0-9!@#$%^&*]*+[0-9!@#$%^&*]))[^\s\"']{{6,}}+",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./\-][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+\-(])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9.\-])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9]|[.\-][0-9])",
}
PATTERN = "|".join(PATTERNS.values())
#: By kind what each of its values needs: all but these need a digit.
NEEDED = {"email": "@", "secret": "[a-f]{32}|[A-F]{32}", "access key": "AKIA[A-Z]", "service token": "gh[opsur]_|sk_|xox", "password": rf"{_WORD}[\"']? ?[=:]"}
#: Holds in every text in which PATTERN does.
COULD = "[0-9]|" + "|".join(NEEDED.values())


#: Distinct characters that a hexadecimal secret holds at least; runs of fewer are padding.
SECRET_CHARS = 4
#: The session's setting that holds the key, and the key of runs over the given test tables, which keeps nothing secret.
KEY_SETTING, TEST_KEY = "speechframe.pseudonym.key", "test tables only: set speechframe.pseudonym.key"
_LETTERS, _BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def session_key(spark: SparkSession) -> str:
    """The key that the session sets; TEST_KEY, with a warning, where it sets none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms can be reversed", stacklevel=2)
    return key or TEST_KEY


def _prf(key: str, kind: str | Column, turn: Column, value: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), turn.cast("string"), size.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: str | Column, left: Column, right: Column, a: Column, b: Column, finish) -> Column:
    """finish(struct of l and r) after the network over Z_a x Z_b; the bounds are part of what F sees."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        l = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(_prf(key, kind, i, s["r"], s["a"]), s["a"]), s["a"])).otherwise(s["l"])  # noqa: E741
        r = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(_prf(key, kind, i, s["l"], s["b"]), s["b"]), s["b"])).otherwise(s["r"])
        return F.struct(l.alias("l"), r.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, finish)


def _part(key: str, kind: str | Column, text: Column, radix: int) -> Column:
    """A string of at most 18 digits of the radix (16 beyond 10), permuted among the strings of its length."""
    n = F.length(text)
    h = F.floor(n / 2).cast("int")
    number = lambda s: F.coalesce(F.conv(s, radix, 10), F.lit("0")).cast("long")
    digits = lambda v, size: F.when(size > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, radix)), size, "0")).otherwise("")
    bound = lambda size: F.rint(F.pow(F.lit(float(radix)), size)).cast("long")
    return _feistel(key, kind, number(F.substring(text, F.lit(1), h)), number(F.substring(text, h + 1, n)), bound(h), bound(n - h), lambda s: F.concat(digits(s["l"], h), digits(s["r"], n - h)))


def _permuted(key: str, kind: str | Column, text: Column, radix: int) -> Column:
    """A string of digits of the radix of any length, in parts that are permuted each."""
    step = 18 if radix == 10 else 16
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.array_join(F.transform(starts, lambda i: _part(key, kind, F.substring(text, i, F.lit(step)), radix)), "")


def _chunked(text: Column, use) -> Column:
    """use() of each 64 characters, joined: what is quadratic in a value's length stays linear."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(".{1,64}"), F.lit(0)), use), "")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often use mentions it; null for null."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), use(v))), 0)


def _filled(shape: Column, held: str, symbols: Column) -> Column:
    """shape with its characters of the class held replaced by the given ones, in order and in its case; null without symbols."""
    before = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{held}]", ""))

    def each(symbols: Column, i: Column) -> Column:
        char, symbol = F.substring(shape, i, F.lit(1)), F.substring(symbols, before(i), F.lit(1))
        return F.when(char.rlike(f"[{held}]"), F.when(char.rlike("[A-Z]"), F.upper(symbol)).otherwise(symbol)).otherwise(char)

    return _once(symbols, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: each(s, i)), ""))


def _mixed(key: str, kind: str, value: Column, other: Column) -> Column:
    """A value of letters, digits and signs: letters permuted under its digits and other, then digits under the new letters."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    letters = F.translate(F.lower(F.regexp_replace(value, "[^A-Za-z]", "")), _LETTERS, _BASE26)

    def with_letters(new: Column) -> Column:
        spelled = F.translate(new, _BASE26, _LETTERS)
        shape = F.when(F.length(new) > 0, _filled(value, "A-Za-z", spelled)).otherwise(value)
        moved = _permuted(key, F.concat_ws(":", F.lit(kind + " digits"), new, other), digits, 10)
        return F.when(F.length(digits) > 0, _once(shape, lambda s: _filled(s, "0-9", moved))).otherwise(shape)

    return _once(F.when(F.length(letters) > 0, _permuted(key, F.concat_ws(":", F.lit(kind), digits, other), letters, 26)).otherwise(F.lit("")), with_letters)


def _luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """The Luhn sum; doubled_from_end 1 doubles every second digit from the one before the last, 0 from the last."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == doubled_from_end, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda acc, x: acc + x)


def _card(key: str, digits: Column) -> Column:
    """All but the last digit permuted, then the check digit that makes the number valid."""
    body = _permuted(key, "card", F.substring(digits, F.lit(1), F.length(digits) - 1), 10)
    return _once(body, lambda s: F.concat(s, F.pmod(F.lit(10) - _luhn_sum(s, 0) % 10, F.lit(10)).cast("string")))


def _moved_day(key: str, day: Column) -> Column:
    """A date permuted within its 400 years."""
    offset = F.datediff(day, F.lit(DATE_BASE).cast("date"))
    span = DATE_A * DATE_B
    inside = F.pmod(offset, F.lit(span))
    return _feistel(key, "date", F.floor(inside / DATE_B), inside % DATE_B, F.lit(DATE_A), F.lit(DATE_B), lambda s: F.date_add(F.lit(DATE_BASE).cast("date"), (offset - inside + s["l"] * DATE_B + s["r"]).cast("int")))


def _date(key: str, hit: Column) -> Column:
    """The date in the hit's own format, or null where it is none."""
    out = F.lit(None).cast("string")
    for shape, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy")):
        day = F.try_to_date(hit, form)
        # years before 1600 keep four digits as well: only those from 0001 to 9999 parse
        out = F.when(hit.rlike(shape), F.when(F.year(day).between(1600, 9599), F.date_format(_moved_day(key, day), form))).otherwise(out)
    return out


def _ssn(key: str, digits: Column) -> Column:
    area, group, serial = (F.substring(digits, i, n).cast("int") for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = F.when(area > 666, area - 2).otherwise(area - 1)
    right = (group - 1) * 9999 + serial - 1

    def finish(s: Column) -> Column:
        new = F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1)
        return F.concat(F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _feistel(key, "ssn", left, right, F.lit(SSN_A), F.lit(SSN_B), finish))


def _ip(key: str, hit: Column) -> Column:
    octet = lambda i: F.split_part(hit, F.lit("."), F.lit(i)).cast("long")
    dotted = lambda s: F.concat_ws(".", *[(F.floor(s[half] / d) % 256).cast("string") for half in ("l", "r") for d in (256, 1)])
    return _feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), dotted)


def pseudonym(hit: Column, key: str) -> Column:
    """struct(kind, value): the pseudonym of a candidate, or nulls where validation fails."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    code = F.when(hit.startswith("+"), F.length(F.regexp_extract(hit, r"^\+([0-9]{1,3})[ .\-(]", 1))).otherwise(0)
    local, domain = F.split_part(hit, F.lit("@"), F.lit(1)), F.split_part(hit, F.lit("@"), F.lit(2))
    host, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    email = _once(_chunked(local, lambda w: _mixed(key, "email", w, F.lower(host))), lambda new: F.concat(new, F.lit("@"), _chunked(host, lambda w: _mixed(key, "host", w, F.lower(new))), top))
    hexed = _permuted(key, "secret", F.lower(hit), 16)
    sign = F.regexp_extract(hit, r"^([^=:]*[=:] ?[\"']?)", 1)
    word = F.regexp_replace(hit, r"^[^=:]*[=:] ?[\"']?", "")
    issuer = F.regexp_extract(hit, "^(gh[opsur]_|sk_live_|sk_test_|xox[abp]-)", 1)
    options = {
        "email": (hit.contains("@") & ~hit.rlike("[=:]"), email),
        "secret": (hit.rlike("^[0-9A-Fa-f]{32,}$"), F.when(F.size(F.array_distinct(F.regexp_extract_all(hit, F.lit("."), F.lit(0)))) >= SECRET_CHARS, F.when(hit.rlike("[A-F]"), F.upper(hexed)).otherwise(hexed))),
        "access key": (hit.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), F.upper(_permuted(key, "access key", F.lower(F.substring(hit, 5, 16)), 36)))),
        "service token": (issuer != "", F.concat(issuer, _chunked(F.substring(hit, F.length(issuer) + 1, F.length(hit)), lambda w: _mixed(key, "service token", w, F.lit(""))))),
        "password": (hit.rlike(r"^[A-Za-z_]+[\"']? ?[=:]"), F.concat(sign, _chunked(word, lambda w: _mixed(key, "password", w, F.lit(""))))),
        "ip": (hit.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _ip(key, hit)),
        "date": (hit.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), _date(key, hit)),
        "ssn": (hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), _filled(hit, "0-9", _ssn(key, digits))),
        "phone": (hit.rlike(r"^\+|^\(?\d{3}\)?[ .\-]\d{3}[.\-]\d{4}$"), _filled(hit, "0-9", F.concat(F.substring(digits, F.lit(1), code), _permuted(key, "phone", F.substring(digits, code + 1, F.length(digits)), 10)))),
        "card": (F.length(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0), _filled(hit, "0-9", _card(key, digits))),
    }
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (applies, new) in reversed(options.items()):
        kind, value = F.when(applies, F.lit(name)).otherwise(kind), F.when(applies, new).otherwise(value)
    return F.get(F.transform(F.array(value), lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value"))), 0)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with the private values of text_col replaced, and private_kinds (array<string>: the kind of each replaced value,
    in order of place) added. Whoever knows the key can reverse the pseudonyms, so there is no default.

    Replaced are e-mail addresses, access keys, service tokens, passwords in assignments (up to white space
    or a quote; after a space only words with a digit or sign), IPv4 addresses, phone numbers, and, if they are valid, hexadecimal secrets (SECRET_CHARS distinct characters), dates, social
    security numbers and card numbers (Luhn). What fails validation stays as it is. Case is kept in its
    places, so values that differ in case alone get pseudonyms that do.
    A map over rows: no shuffle, whole texts, very long ones in linear time. Null texts stay null, with no kinds; repeated
    rows are each replaced alike; an empty table stays empty; an input column named private_kinds is replaced.
    """
    if not key:
        raise ValueError("the key is empty")
    df = df.drop("private_kinds")
    text = F.col(text_col)
    could = text.rlike(COULD)
    hits = F.when(could, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = df.withColumn("__hits", F.transform(hits, lambda h: F.struct(h.alias("old"), pseudonym(h, key).alias("new"))))
    pieces = F.split(text, PATTERN, -1)
    value = lambda i: F.coalesce(F.get("__hits", i)["new"]["value"], F.get("__hits", i)["old"], F.lit(""))
    rebuilt = F.array_join(F.transform(pieces, lambda piece, i: F.concat(piece, value(i))), "")
    kinds = F.array_compact(F.transform("__hits", lambda h: h["new"]["kind"]))
    return found.withColumns({text_col: F.when(F.size("__hits") > 0, rebuilt).otherwise(text), "private_kinds": F.coalesce(kinds, F.array().cast("array<string>"))}).drop("__hits")


def digest(docs: DataFrame, key: str) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"), key).select("doc_id", "text", F.size("private_kinds").cast("long").alias("n_private"), F.array_join(F.array_sort(F.array_distinct("private_kinds")), ",").alias("kinds"))
