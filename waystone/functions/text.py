"""Names, numbers, dates and digests as column expressions."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rail abbreviations and what they stand for.
ABBREVIATIONS = {"jcn": "junction", "jn": "junction", "nth": "north", "sth": "south", "stn": "station"}
#: The generic end of a station's public name, and qualifiers that a weaker key leaves out.
STATION_SUFFIX = r"\b(?:railway\s+station|rail\s+station|train\s+station|station|stn)\z"
QUALIFIER = r"\b(?:for|via)\b.*\z"


@lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of characters in ASCII: single characters as two strings for translate(), and
    those that become several."""
    one, plain, many = [], [], {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]):
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(left) == 1:
            one.append(c)
            plain.append(left)
        elif left:
            many[c] = left
    return "".join(one), "".join(plain), many


def ascii_fold(text: Column) -> Column:
    """Text by compatibility decomposition (NFKD) in ASCII; what has no ASCII part is left out. JVM functions only. Text in ASCII
    stays as it is, and of other text only characters beyond ASCII are looked up."""
    one, plain, many = _folds()
    beyond = "[^\\x00-\\x7F]"
    single = F.translate(text, one, plain)
    parts = F.regexp_extract_all(single, F.lit("(?s)([\\x00-\\x7F]+|.)"), 1)
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    several = F.array_join(F.transform(parts, lambda c: F.when(c.rlike(beyond), F.coalesce(F.try_element_at(table, c), F.lit(""))).otherwise(c)), "")
    return F.when(text.rlike(beyond), several).otherwise(text)



def name_key(name: Column) -> Column:
    """The exact key of a timing location: folded to ASCII and lower case, & as and, other signs as spaces, rail abbreviations
    written out, one generic station suffix removed. Nothing geographic goes."""
    words = F.regexp_extract_all(F.replace(F.lower(ascii_fold(name)), F.lit("&"), F.lit(" and ")), F.lit("([a-z0-9]+)"), 1)

    def written_out(word: Column) -> Column:
        out = word
        for short, long in ABBREVIATIONS.items():
            out = F.when(word == short, long).otherwise(out)
        return out

    return F.trim(F.regexp_replace(F.array_join(F.transform(words, written_out), " "), STATION_SUFFIX, ""))


def relaxed_name_key(name: Column) -> Column:
    """The weaker key, whose finds need a review: without what stands in parentheses, or from `for` or `via` on."""
    return F.trim(F.regexp_replace(name_key(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " ")), QUALIFIER, ""))


def station_key(name: Column) -> Column:
    """The key of a station's name: lower case, & as and, without the word station (and railway or rail before it)."""
    plain = F.replace(F.lower(name), F.lit("&"), F.lit(" and "))
    bare = F.regexp_replace(F.regexp_replace(plain, r"\b(?:railway|rail)\s+station\b", " "), r"\bstation\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def level_key(level: Column) -> Column:
    """Canonical decimal of a level: blank is 0, numbers lose trailing zeros, anything else stays as it is."""
    text = F.trim(F.coalesce(level, F.lit("")))
    whole = F.regexp_extract(text, r"^[+-]?0*([0-9]*)\.?[0-9]*$", 1)
    part = F.regexp_extract(text, r"^[+-]?[0-9]*\.([0-9]*?)0*$", 1)
    sign = F.when(F.substring(text, 1, 1) == "-", "-").otherwise("")
    size = F.when(whole == "", "0").otherwise(whole)
    plain = F.concat(size, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    is_number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(text == "", "0").when(is_number & (plain == "0"), "0").when(is_number, F.concat(sign, plain)).otherwise(text)


def rank_number(display: Column) -> Column:
    """The number of a rank as displayed: `4=` and `=4` are 4; anything but digits beside the signs, and 0, is none."""
    digits = F.replace(display, F.lit("="), F.lit(""))
    n = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    return F.when(n >= 1, n)


def is_tied(display: Column) -> Column:
    return F.contains(display, F.lit("="))


def lap_ms(text: Column) -> Column:
    """Milliseconds of m:ss.mmm; null on any other form."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]+):([0-5][0-9])\.([0-9]{3})$", i)
    return F.when(text.rlike(r"^[0-9]+:[0-5][0-9]\.[0-9]{3}$"), part(1).try_cast("int") * 60000 + part(2).try_cast("int") * 1000 + part(3).try_cast("int"))


def hole_number(value: Column, suffix: str | None = None, course_token: str | None = None) -> Column:
    """The hole, 1 to 18, that a reference is: one or two digits and the suffix letter of its course, if that has one. With a
    course token the reference is `N - token`. Anything else is null."""
    if course_token is not None:
        quoted = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", course_token)
        pattern, fits = rf"^\s*([0-9]{{1,2}})\s*-\s*{quoted}\s*$", F.lit(True)
    else:
        pattern = r"^\s*([0-9]{1,2})([A-Za-z]?)\s*$"
        fits = F.upper(F.regexp_extract(value, pattern, 2)) == (suffix or "").upper()
    n = F.regexp_extract(value, pattern, 1).try_cast("int")
    return F.when(n.between(1, 18) & fits, n)


def two_digit_year(yy: Column) -> Column:
    """60 and above are of the last century."""
    return F.when(yy >= 60, yy + 1900).otherwise(yy + 2000)


def yymmdd(text: Column) -> Column:
    """Date of yymmdd; null if it is none."""
    year = two_digit_year(F.substring(text, 1, 2).try_cast("int"))
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(year.cast("string"), F.substring(text, 3, 4)), "yyyyMMdd"))


def ddmmyy(text: Column) -> Column:
    return yymmdd(F.concat(F.substring(text, 5, 2), F.substring(text, 3, 2), F.substring(text, 1, 2)))


def half_minutes(text: Column) -> Column:
    """Half minutes after midnight of HHMM or HHMMH (H: and a half); null on any other form."""
    ok = text.rlike("^([01][0-9]|2[0-3])[0-5][0-9][H ]?$")
    return F.when(ok, F.substring(text, 1, 2).try_cast("int") * 120 + F.substring(text, 3, 2).try_cast("int") * 2 + F.when(F.substring(text, 5, 1) == "H", 1).otherwise(0))


def public_time(text: Column) -> Column:
    """As half_minutes, but 0000 says that there is no public time."""
    return F.when(text != "0000", half_minutes(text))


def activity_codes(text: Column) -> Column:
    """The non-blank two-character codes of an activity field, in order."""
    return F.filter(F.transform(F.regexp_extract_all(F.rpad(text, 12, " "), F.lit("(..)"), 1), lambda c: F.trim(c)), lambda c: c != "")


def source_roots(refs: Column) -> Column:
    """Distinct type/id roots of `;`-joined references such as way/12/3, in order of first occurrence."""
    each = F.filter(F.transform(F.split(F.coalesce(refs, F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")
    return F.array_distinct(F.transform(each, lambda r: F.when(r.rlike("^(way|relation)/[^/]+/"), F.regexp_extract(r, "^((way|relation)/[^/]+)", 1)).otherwise(r)))


def record_digest(*columns: Column) -> Column:
    """SHA-256 of a record's values in a fixed order, nulls marked."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]), 256)


def finite(text: Column) -> Column:
    """A number, or null where there is none or it isn't finite."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
