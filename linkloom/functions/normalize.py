"""Normalisation of names and addresses as Column expressions; only transliteration needs Python.

Every function takes a string Column and treats null as the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as D

# Words for a missing value, name markers, and web domains.
NULL_WORDS = r"(?i)<\s*null\s*>|\bnull\b|\bnone\b|\bn/?a\b|\bnil\b"
MARKERS = r"(?i)\b(?:d\s*/\s*b\s*/\s*a|dba|d\.b\.a\.?|t\s*/\s*a|trading as|doing business as|aka|a\.k\.a\.?|f\s*/\s*k\s*/\s*a|fka|formerly known as|formerly)\b\s*:?"
DOMAIN = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:com|net|org|in|co\.in|fr|biz|us|info)\b"


def _by_name(c: str) -> str | None:
    """Letters from the character's name: syllables and kana as they are called, letters by the start of their name."""
    name = unicodedata.name(c, "")
    if found := re.search(r"SYLLABLE (?:GLOTTAL )?([A-Z]+)|(?:KATAKANA|HIRAGANA) LETTER (?:SMALL )?([A-Z]+)", name):
        sound = (found[1] or found[2]).lower()
        return D.KANA.get(sound, sound) if found[2] else sound
    if found := re.search(r"(?:LETTER|CHARACTER)(?: (?:FINAL|SMALL|SHORT|LONG|CAPITAL|SARA))* ([A-Z]+)", name):
        return re.match("[AEIOU]|[^AEIOU]+", found[1])[0].lower()
    return None


def _letters(c: str) -> str:
    """ASCII for any character. An ideograph, whose reading no rule gives, becomes a word of its own, so that equal names stay
    equal: z and its code point in the letters a to p."""
    if c.isascii():
        return c
    for table in (D.LATIN, D.CYRILLIC, D.GREEK, D.HEBREW, D.ARABIC):
        if (out := table.get(c)) is not None:
            return out
        if (out := table.get(c.lower())) is not None:
            return out.title()
    for block in D.INDIC_BLOCKS:
        if block <= ord(c) < block + 0x80:
            return D.INDIC.get(ord(c) - block, "")
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    kind, name = unicodedata.category(c), unicodedata.name(c, "")
    if "IDEOGRAPH" in name:
        return f" z{''.join(chr(97 + int(x, 16)) for x in f'{ord(c):04x}')} "
    if "SYLLABLE" in name or "KATAKANA LETTER" in name or "HIRAGANA LETTER" in name:
        return _by_name(c)
    if kind[0] in "MC":
        return ""
    plain = unicodedata.normalize("NFKD", c)
    if plain != c:
        return "".join(_letters(x) for x in plain)
    return (_by_name(c) or "") if kind[0] == "L" else " "


class _Table(dict):
    """Code point to ASCII, worked out when first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _letters(chr(code))
        return out


_ASCII = _Table()


def to_ascii(text: str) -> str:
    return text if text.isascii() else text.translate(_ASCII)


def transliterate(col: Column) -> Column:
    @F.pandas_udf("string")
    def transliterated(s: pd.Series) -> pd.Series:
        return s.map(lambda x: to_ascii(x) if x is not None else "")

    return transliterated(F.coalesce(col, F.lit("")))


def token_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def tokens(col: Column) -> Column:
    """The blank-separated tokens; none of an empty string."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), " "), lambda t: t != "")


def basic_clean(col: Column, ascii_only: bool = False) -> Column:
    """Lower-case ASCII letters, digits and single blanks. ``ascii_only``: the input is known to need no transliteration."""
    s = F.coalesce(col, F.lit("")) if ascii_only else transliterate(col)
    s = F.regexp_replace(F.lower(s), r"\s*&\s*|\s+\+\s+", " and ")
    s = F.regexp_replace(s, "['`]", "")
    s = F.regexp_replace(s, r"(?<=\b[a-z])\.(?=[a-z]\.)|(?<=\b[a-z]\.[a-z])\.", "")
    s = F.regexp_replace(s, "[^a-z0-9 ]+", " ")
    s = F.regexp_replace(s, r"\b(\d+)(?:st|nd|rd|th|er|e|eme)\b", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def fix_leet(token: Column) -> Column:
    """One digit among at least three letters is read as the letter it looks like."""
    size = F.length(token)
    digits = size - F.length(F.translate(token, "0123456789", ""))
    letters = size - F.length(F.translate(token, "abcdefghijklmnopqrstuvwxyz", ""))
    return F.when((size >= 4) & (digits == 1) & (letters >= 3), F.translate(token, "013458", "oleasb")).otherwise(token)


def canonical(token: Column, table: dict[str, str]) -> Column:
    """The table's value. A set tells whether a token has one, so only those that have search the map."""
    return F.when(token.isin(list(table)), F.try_element_at(token_map(table), token)).otherwise(token) if table else token


def unwrap_domain(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), DOMAIN, " $1 ")


def name_tokens(col: Column, synonyms: dict[str, str] | None = None, ascii_only: bool = False) -> Column:
    out = tokens(basic_clean(unwrap_domain(col), ascii_only))
    for step in (fix_leet, lambda t: canonical(t, D.LEGAL_CANON), *([lambda t: canonical(t, synonyms)] if synonyms else [])):
        out = F.transform(out, step)  # one step a pass: an expression that takes another's value twice would compute it twice
    return out


def skeleton(token: Column) -> Column:
    """A phonetic skeleton; tokens of digits stay."""
    s = token
    for a, b in D.SKELETON_STEPS:
        s = F.replace(s, F.lit(a), F.lit(b))
    rest = F.regexp_replace(F.substring(s, 2, 1 << 20), "[aeiouh]", "")
    return F.when(token.rlike("^[0-9]+$"), token).otherwise(F.concat(F.substring(s, 1, 1), F.regexp_replace(rest, r"(.)\1+", "$1")))


def skeleton_of(token: str) -> str:
    """The same for one Python string."""
    if token.isdigit():
        return token
    s = token
    for a, b in D.SKELETON_STEPS:
        s = s.replace(a, b)
    return s[:1] + re.sub(r"(.)\1+", r"\1", re.sub("[aeiouh]", "", s[1:]))


LEGAL_SKELETONS = sorted({skeleton_of(w) for w in D.LEGAL_WORDS})


def is_legal(token: Column) -> Column:
    return token.isin(D.LEGAL_FORMS) | ((F.length(token) >= 5) & skeleton(token).isin(LEGAL_SKELETONS))


def core_tokens(toks: Column) -> Column:
    """Without legal forms, noise, country words and numbers; all tokens where nothing is left."""
    core = F.filter(toks, lambda t: ~is_legal(t) & ~t.isin(D.NAME_NOISE) & ~t.isin(D.COUNTRY_WORDS) & ~t.rlike("^[0-9]+$"))
    return F.when(F.size(core) > 0, core).otherwise(toks)


def acronym(core: Column) -> Column:
    return F.array_join(F.transform(F.filter(core, lambda t: ~t.rlike("^[0-9]+$")), lambda t: F.substring(t, 1, 1)), "")


def phonetic_key(cleaned: Column) -> Column:
    return F.array_join(F.transform(tokens(cleaned), skeleton), " ")


def name_variants(col: Column) -> Column:
    """[whole, parts...] where a marker or a bar parts the name in several, else [whole]."""
    raw = F.coalesce(col, F.lit(""))
    strip = lambda p: F.regexp_replace(p, r"^[ ,;:()|-]+|[ ,;:()|-]+$", "")
    parts = F.filter(F.transform(F.split(raw, MARKERS), strip), lambda p: p != "")
    bars = F.filter(F.transform(F.split(raw, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.when(raw.contains("|"), F.concat(parts, bars)).otherwise(parts)
    return F.when(F.size(parts) > 1, F.concat(F.array(raw), parts)).otherwise(F.array(raw))


def address_tokens(col: Column, synonyms: dict[str, str] | None = None, ascii_only: bool = False) -> Column:
    """Tokens over the comma-separated components; a component that is exactly a state becomes its code."""
    raw = F.regexp_replace(F.coalesce(col, F.lit("")), NULL_WORDS, " ")
    raw = raw if ascii_only else transliterate(raw)
    parts = F.transform(F.split(raw, ","), lambda c: canonical(basic_clean(c, True), D.STATES))
    out = F.transform(tokens(F.array_join(F.filter(parts, lambda c: c != ""), " ")), lambda t: canonical(t, D.ADDR_CANON))
    return F.transform(out, lambda t: canonical(t, synonyms)) if synonyms else out


def _no_zeros(d: Column) -> Column:
    cut = F.regexp_replace(d, "^0+", "")
    return F.when(cut == "", "0").otherwise(cut)


def numbers(col: Column) -> Column:
    """Sorted distinct digit runs without leading zeros."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), _no_zeros)))


def house_number(col: Column) -> Column:
    """The first digit run of at most five digits, leading zeros aside; empty if there is none."""
    runs = F.regexp_extract_all(F.regexp_replace(F.coalesce(col, F.lit("")), NULL_WORDS, " "), F.lit(r"(\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(F.transform(F.filter(runs, lambda d: F.length(F.regexp_replace(d, "^0+", "")) <= 5), _no_zeros), F.lit(1)), F.lit(""))


def postal_code(col: Column) -> Column:
    """Six digits, else 3+3, else the last five-digit number of several numbers, else empty."""
    a = F.coalesce(col, F.lit(""))
    six = F.regexp_extract(a, r"\b(\d{6})\b", 1)
    split = F.concat(F.regexp_extract(a, r"\b(\d{3})\s(\d{3})\b", 1), F.regexp_extract(a, r"\b(\d{3})\s(\d{3})\b", 2))
    five = F.try_element_at(F.regexp_extract_all(a, F.lit(r"\b(\d{5})(?:-\d{4})?\b"), F.lit(1)), F.lit(-1))
    several = F.regexp_count(a, F.lit(r"\d+")) > 1
    return F.when(six != "", six).when(split != "", split).when(several & five.isNotNull(), five).otherwise("")


def bigrams(arr: Column, lead: str) -> Column:
    """lead + a_b for neighbours."""
    n = F.size(arr)
    pairs = F.zip_with(F.slice(arr, 1, F.greatest(n - 1, F.lit(0))), F.slice(arr, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit(lead), a, F.lit("_"), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def block_tokens(core: Column, addr: Column) -> Column:
    """Sorted distinct tokens for blocking, each kind under its own mark."""
    names = F.transform(F.filter(core, lambda t: F.length(t) > 1), skeleton)
    solid = F.replace(F.array_join(core, " "), F.lit(" "), F.lit(""))
    places = F.transform(F.filter(addr, lambda t: t.rlike("^[0-9]+$") | (F.length(t) > 1)), lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), _no_zeros(t))).otherwise(skeleton(t)))
    marked = F.transform(places, lambda t: F.when(t.startswith("#"), F.concat(F.lit("#:"), F.substring(t, 2, 1 << 20))).otherwise(F.concat(F.lit("a:"), t)))
    return F.array_sort(F.array_distinct(F.concat(F.transform(names, lambda t: F.concat(F.lit("n:"), t)), bigrams(names, "nb:"), F.when(F.length(solid) >= 4, F.array(F.concat(F.lit("ns:"), solid))).otherwise(F.array().cast("array<string>")), marked, bigrams(places, "ab:"))))


def over_distinct(df: DataFrame, key: str, make: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """df with make(key)'s columns, computed once for each distinct string and joined back; blank ones, which may be a large
    share of the rows, where they stand."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    each = df.where(~blank).select(key).distinct()
    each = each.select(key, *[c.alias(n) for n, c in make(F.col(key)).items()])
    return df.where(~blank).join(each, key).select(*df.columns, *each.columns[1:]).unionByName(df.where(blank).withColumns(make(F.col(key))))


def prepare_records(records: DataFrame, name_synonyms: dict | None = None, addr_synonyms: dict | None = None) -> DataFrame:
    """Raw records (entity_id, business_name, business_address, country) -> prepared records.

    Strings are transliterated once, before the column expressions run on plain ASCII.
    """
    raw = records.select("entity_id", F.lower(F.trim(F.coalesce("country", F.lit("")))).alias("ckey"), F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("addr"))
    plain = raw.withColumns({"__n": transliterate(F.col("name")), "__a": transliterate(F.regexp_replace("addr", NULL_WORDS, " "))})
    toks = plain.withColumns({"__t": name_tokens(F.col("__n"), name_synonyms, True), "__at": address_tokens(F.col("__a"), addr_synonyms, True)}).withColumn("__c", core_tokens(F.col("__t")))
    return toks.select(
        "entity_id", "ckey", "name", "addr", F.array_join("__t", " ").alias("n_name"), F.array_join("__c", " ").alias("c_name"), F.array_join("__at", " ").alias("n_addr"),
        phonetic_key(F.array_join("__c", " ")).alias("p_name"), house_number(F.col("__a")).alias("hn"), numbers(F.col("__a")).alias("nums"), postal_code(F.col("__a")).alias("pc"), block_tokens(F.col("__c"), F.col("__at")).alias("btok"),
    )
