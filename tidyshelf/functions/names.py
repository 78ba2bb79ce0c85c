"""Names as columns: cleaning, numbers in names, and the keys by which names are compared.

Everything is built from Spark functions but Unicode decomposition, an Arrow UDF over whole batches. Tokens that are rewritten one
by one are split out, rewritten as an array and joined again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def strip(c: Column) -> Column:
    return F.regexp_replace(c, P.EDGE_SPACE, "")


def without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def chosen_rules(raw: str | None) -> frozenset[str]:
    """A comma-separated list of rules; empty means all, unknown names are ignored."""
    asked = {x.strip().lower() for x in (raw or "").split(",") if x.strip()}
    return P.RULES & asked if asked else P.RULES


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of c, where c is worked out once however often fn names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def rewritten(c: Column, pattern: str, fn: Callable[..., Column], groups: tuple[int, ...] = (0,)) -> Column:
    """c with each match of pattern replaced by fn(its groups, ...): split at the matches, rewritten, joined again."""

    def replaced(text: Column) -> Column:
        parts = F.array(F.split(text, pattern, -1), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups))
        joined = lambda p: F.concat(F.get(p[0], F.lit(0)), F.array_join(F.transform(p[1], lambda _, i: F.concat(fn(*(F.get(p[k + 1], i) for k in range(len(groups)))), F.get(p[0], i + 1))), ""))
        return F.when(text.rlike(pattern), bound(parts, joined)).otherwise(text)

    return bound(c, replaced)


#: An entity as HTML readers see it: a number, or a name of up to 32 characters.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


#: Numbers that stand for characters of an old code page, as pages were written with it.
WINDOWS = {13: "\r"} | {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}


def of_code(n: Column) -> Column:
    """The character of a code point, after the rules for numbers in HTML."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    cp1252 = F.create_map(*(F.lit(x) for k, v in WINDOWS.items() for x in (k, v)))
    nothing = (n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    odd = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(odd, "\ufffd").when(cp1252[n.cast("int")].isNotNull(), cp1252[n.cast("int")]).when(nothing, "").otherwise(char)


def entity(s: Column) -> Column:
    """An entity's characters: by number, by its name, or by the longest of the old names that need no semicolon; else itself."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    name = s.substr(F.lit(2), F.length(s))
    short = F.regexp_extract(name, f"^(?:{old})", 0)
    code = F.when(s.rlike("^&#[xX]"), F.conv(F.regexp_extract(s, "^&#[xX]0*([0-9a-fA-F]{1,8})(?![0-9a-fA-F])", 1), 16, 10)).otherwise(F.regexp_extract(s, "^&#0*([0-9]{1,12})(?![0-9])", 1))
    zero = s.rlike("^&#[xX]?0+;?$")
    number = F.when(zero, F.lit(0).cast("long")).otherwise(F.nullif(code, F.lit("")).cast("long"))
    return (
        F.when(s.startswith("&#"), of_code(number))
        .otherwise(F.coalesce(F.try_element_at(names, name), F.when(short != "", F.concat(F.try_element_at(names, short), name.substr(F.length(short) + 1, F.length(name)))), s))
    )


def unescape(c: Column, full: bool = True) -> Column:
    """Entities as characters: all of them, or only the five of XML."""
    if full:
        return rewritten(c, ENTITY, entity)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def sanitize(c: Column, rules: frozenset[str] = P.RULES, full_entities: bool = True) -> Column:
    c = unescape(c, full_entities)
    if "url" in rules:
        c = without(c, P.URL)
    if "scan_groups" in rules:
        c = without(c, P.SCAN_GROUP)
    c = without(without(c, P.TRAILING_SLASH), P.G_CODE)
    if "non_latin" in rules:
        c = without(c, P.NOT_ALLOWED)
    if "brackets" in rules:
        c = without(without(c, P.BRACKETS), P.STRAY_BRACKETS)
    return strip(F.regexp_replace(F.translate(c, "_", " "), P.SPACES, " "))


def suffix(name: Column) -> Column:
    """From the last dot on, unless that is the first or last character."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.when(suffix(name) == "", name).otherwise(name.substr(F.lit(1), F.length(name) - F.length(suffix(name))))


def clean_filename(name: Column, rules: frozenset[str] = P.RULES, full_entities: bool = True) -> Column:
    return F.concat(sanitize(stem(name), rules, full_entities), suffix(name))


def clean_directory(name: Column, strict: bool = False, full_entities: bool = True) -> Column:
    """strict: a dangling part/v/ch goes only after a separator."""
    c = without(sanitize(name, full_entities=full_entities), P.LEADING_HASH)
    c = strip(without(c, P.TRAILING_HASH))
    return strip(without(c, P.TRAILING_STUB_STRICT if strict else P.TRAILING_STUB))


def is_generic(c: Column, profile: str = "batch") -> Column:
    return c.rlike(P.GENERIC[profile])


def is_gibberish(c: Column) -> Column:
    return c.rlike(P.GIBBERISH)


def is_generic_stem(c: Column) -> Column:
    return strip(c).rlike(P.GENERIC_STEM)


def bare_title(c: Column, rules: frozenset[str] = P.RULES, profile: str = "batch") -> Column:
    if "leading_nums" in rules:
        c = strip(without(c, P.LEADING_NUMBER[profile]))
    return strip(without(c, P.TRAILING_JUNK)) if "trailing_junk" in rules and profile == "batch" else c


# ---- numbers


def format_number(n: Column) -> Column:
    """Whole numbers without a fraction; others as plain decimals, never with an exponent."""
    plain = F.regexp_replace(F.regexp_replace(n.cast("decimal(30,10)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(plain)


def to_number(c: Column) -> Column:
    """Null for what is no number, such as 1.2.3."""
    return c.try_cast("double")


def chapter(c: Column) -> Column:
    return to_number(first_group(c, P.CHAPTER))


def chapter_text(c: Column) -> Column:
    return format_number(chapter(c))


def volume(c: Column) -> Column:
    return to_number(first_group(c, P.VOLUME))


def volume_text(c: Column) -> Column:
    return format_number(volume(c))


def issue_number(c: Column) -> Column:
    """For gaps: chapter, issue or #, else up to four digits at the end; whichever match comes first."""
    return to_number(F.coalesce(*(first_group(c, P.GAP_NUMBER, i) for i in range(1, 5))))


def number_range(c: Column) -> tuple[Column, Column]:
    return to_number(first_group(c, P.RANGE, 1)), to_number(first_group(c, P.RANGE, 2))


def range_text(start: Column, end: Column) -> Column:
    return F.concat(format_number(start), F.lit("-"), format_number(end))


def renamed_for_range(c: Column, start: Column, end: Column) -> Column:
    """The first chapter token's number becomes the range; without such a token the range is appended."""
    text, head = range_text(start, end), F.regexp_extract(c, P.CHAPTER_TOKEN_ONCE, 1)
    rest = c.substr(F.length(F.regexp_extract(c, P.CHAPTER_TOKEN_ONCE, 0)) + 1, F.length(c))
    return F.when(head == "", F.concat(c, F.lit(" "), text)).otherwise(F.concat(head, text, rest))


#: Digits of other scripts, in the order of their values.
DIGITS = "".join(chr(z + i) for z in (0x660, 0x6F0, 0x966, 0xFF10) for i in range(10))


def plain_number(text: Column) -> Column:
    """A number without needless zeros: 005 as 5, 1.50 as 1.5, 2.0 as 2; null for what is no number, such as 1.2.3."""
    text = F.translate(text, DIGITS, "0123456789" * 4)
    bare = F.regexp_replace(F.regexp_replace(text, r"^0+(?=\d)", ""), r"\.0*$|(?<=\.\d{0,30}[1-9])0+$", "")
    return F.when(text.rlike(r"^[0-9]+(?:\.[0-9]*)?$"), bare)


def number_tokens(c: Column) -> Column:
    """ch. 005 as ch. 5, 1.50 as 1.5; what is no number stays."""
    return rewritten(c, P.NUMBER_TOKEN, lambda all_, label, number: F.coalesce(F.concat(label, plain_number(number)), all_), (0, 1, 2))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \-_]+|[ \-_]+$", "")


def normal_stem(c: Column, directory: Column, profile: str = "live") -> Column:
    """A stem that says nothing takes its directory's name, with the number where there is one.

    The batch profile has no branch for a bare chapter number: such stems are generic there.
    """
    out = F.when(is_gibberish(c), directory)
    numbered = F.concat(directory, F.lit(" Ch. "), F.regexp_extract(c, P.NUMBERED_CHAPTER, 1))

    def with_tail(pattern: str, word: str, number: Column) -> Column:
        tail = trimmed(F.regexp_extract(c, pattern, 2))
        return F.concat(directory, F.lit(word), number, F.when(tail == "", "").otherwise(F.concat(F.lit(" "), tail)))

    if profile == "live":
        out = out.when(c.rlike(P.GENERIC_CHAPTER), with_tail(P.GENERIC_CHAPTER, " Ch. ", F.coalesce(format_number(to_number(first_group(c, P.GENERIC_CHAPTER))), F.regexp_extract(c, P.GENERIC_CHAPTER, 1))))
        out = out.when(c.rlike(P.CHAPTER_ONLY), F.concat(directory, F.lit(" "), F.upper(c.substr(1, 1)), c.substr(F.lit(2), F.length(c))))
        out = out.when(c.rlike(P.NUMBERED_CHAPTER), numbered)
    else:
        out = out.when(c.rlike(P.NUMBERED_CHAPTER), numbered)
        for pattern in (P.UNKNOWN_CHAPTER, P.HASH_CHAPTER):
            out = out.when(c.rlike(pattern), with_tail(pattern, " Chapter ", F.regexp_extract(c, pattern, 1)))
    return out.when(is_generic(c, profile), directory).otherwise(c)


# ---- keys


def base_name(c: Column) -> Column:
    """A directory's name without its trailing number token, lower case; null without a token or name."""
    base = F.lower(F.regexp_replace(strip(without(c, P.TRAILING_TOKEN)), r"(?U)\s+", " "))
    return F.when(c.rlike(P.TRAILING_TOKEN), F.nullif(base, F.lit("")))


def unnumbered(c: Column) -> Column:
    """The same with its case kept."""
    return F.when(c.rlike(P.TRAILING_TOKEN), F.nullif(strip(without(c, P.TRAILING_TOKEN)), F.lit("")))


def n_upper(c: Column) -> Column:
    return F.length(without(c, r"[^\p{Lu}]"))


def canonical(c: Column) -> Column:
    """Cleaning of the name that a group of directories gets."""
    c = strip(without(sanitize(c, full_entities=False), P.ILLEGAL))
    return strip(without(without(c, P.LEADING_HASH), P.TRAILING_HASH))


def dedup_key(c: Column) -> Column:
    return without(F.lower(c), P.DEDUP_DROP)


def compare_key(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), P.PUNCTUATION, " "), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x) if x is not None and not x.isascii() else x)


def marker_key(c: Column, decompose: bool = True) -> Column:
    """Without marker words, lower case, only letters a to z, digits and single spaces."""
    c = without(_decomposed(c) if decompose else c, P.MARKER)
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+", " "))


def has_marker(c: Column) -> Column:
    return c.rlike(P.MARKER)


# ---- repeated tokens

DUP_LABEL = rf"(?iU)({P.LABEL}\.?\s*\d+(?:\.\d+)?)\s+{P.LABEL}\.?\s*(\d+(?:\.\d+)?)"


def label_once(c: Column) -> Column:
    """A labelled number that follows itself, once; labels need not be the same."""
    return rewritten(c, DUP_LABEL, lambda all_, first, number: F.when(F.regexp_extract(first, r"(?U)\d+(?:\.\d+)?", 0) == number, first).otherwise(all_), (0, 1, 2))


def without_repeats(c: Column) -> Column:
    """Repeated labelled or bare numbers once, spaced punctuation closed up, lone-sided hyphens joined, single spaces."""
    c = F.regexp_replace(label_once(c), r"(?U)\b(\d+(?:\.\d+)?)\s+\1\b", "$1")
    c = F.regexp_replace(c, r"(?<=([!?.])) +(?=\1)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)(\S) -(\S)", "$1-$2"), r"(?U)(\S)- (\S)", "$1-$2")
    return strip(F.regexp_replace(c, "  +", " "))


def log_severity(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.contains("error") | low.contains("failed"), "error")
        .when(low.contains("warning") | low.contains("warn") | low.contains("skipping"), "warn")
        .when(low.contains("complete") | low.contains("done") | low.contains("success"), "success")
        .otherwise("info")
    )
