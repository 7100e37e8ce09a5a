"""Normalisation of names and addresses as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name suffixes (each becomes a blank, anywhere, in this order) and prefixes (removed at the start).
NAME_SUFFIXES = (
    r"private\s+limited", r"pvt\.?\s*ltd\.?", r"pvt", r"ltd\.?", r"llp", r"limited\s+liability\s+partnership", r"limited", r"incorporated", r"inc\.?", r"company", r"co\.?", r"and\s+co\.?", r"&\s*co\.?",
    r"enterprises?", r"industries?", r"works", r"traders?", r"suppliers?", r"manufacturers?", r"agency", r"agencies", r"group", r"associates?", r"corporation", r"corp\.?",
)
NAME_PREFIXES = (r"m/?s\.?\s*", r"m\s+s\s+", r"shri\s+", r"shree\s+", r"sri\s+", r"smt\.?\s+", r"new\s+", r"the\s+", r"m/s\s+")
# Address abbreviations (in this order) and locality aliases (literal, after them).
ADDRESS_WORDS = (("road", "rd"), (r"rd\.?", "rd"), ("street", "st"), (r"st\.?", "st"), ("avenue", "ave"), (r"ave\.?", "ave"), ("layout", "layout"), ("industrial", "indl"), (r"indl\.?", "indl"), ("estate", "est"), (r"est\.?", "est"))
LOCALITIES = (
    ("peenya industrial area", "peenya indl area"), ("peenya indl est", "peenya indl area"), ("peenya industrial estate", "peenya indl area"),
    ("brigade road", "brigade rd"), ("brigade rd", "brigade rd"), ("mg road", "mahatma gandhi rd"), ("m g road", "mahatma gandhi rd"),
)
# Phonetic digits.
SOUNDEX = (("bfpv", "1"), ("cgjkqsxz", "2"), ("dt", "3"), ("l", "4"), ("mn", "5"), ("r", "6"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
CODES = "".join(next((d for letters, d in SOUNDEX if c in letters), "0") for c in ALPHABET)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _once(value: Column, body) -> Column:
    """body(value) as one lambda: its many steps do not swell the generated code wherever the result is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_name(name: Column) -> Column:
    return _once(name, _name)


def normalize_address(address: Column) -> Column:
    return _once(address, _address)


def _name(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9\s]", " ")
    out = reduce(lambda c, p: F.regexp_replace(c, rf"\b{p}\b", " "), NAME_SUFFIXES, out)
    out = reduce(lambda c, p: F.regexp_replace(c, rf"^{p}", ""), NAME_PREFIXES, out)
    return _blank_to_null(_squeeze(out))


def _address(address: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(address)), r"[,.;:/\\-]", " ")
    out = reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), ADDRESS_WORDS, out)
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), LOCALITIES, out)
    return _blank_to_null(_squeeze(out))


def pincode(text: Column) -> Column:
    return _blank_to_null(F.regexp_extract(text, r"\b([1-9][0-9]{5})\b", 1))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def soundex_word(word: Column) -> Column:
    """First letter and three digits of the word's letters; vowels, h and w part equal digits; null without a letter."""
    return _once(F.regexp_replace(F.lower(word), "[^a-z]", ""), _soundex)


def _soundex(letters: Column) -> Column:
    digits = F.translate(letters, ALPHABET, CODES)
    at = lambda i: F.substring(digits, i, F.lit(1))
    places = F.when(F.length(letters) > 1, F.sequence(F.lit(2), F.length(letters))).otherwise(F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.filter(places, lambda i: (at(i) != at(i - 1)) & (at(i) != "0")), at), "")
    return F.when(letters != "", F.rpad(F.concat(F.upper(F.substring(letters, 1, 1)), kept), 4, "0"))


def phonetic(name: Column, metaphone: Column | None = None) -> Column:
    """SX: and the Soundex codes of the words, joined by blanks. Codes of a further encoder (a string, null or empty
    without any) come first, as DM: and a bar."""
    codes = F.filter(F.transform(words(F.lower(name)), soundex_word), lambda c: c.isNotNull())
    plain = F.when(F.size(codes) > 0, F.concat(F.lit("SX:"), F.array_join(codes, " ")))
    if metaphone is None:
        return plain
    both = F.concat_ws("|", F.when(F.coalesce(metaphone, F.lit("")) != "", F.concat(F.lit("DM:"), metaphone)), plain)
    return _blank_to_null(both)


def _split_address(flat: Column) -> Column:
    """(building, street, locality, city) of an address whose parts are set off by commas or wide gaps."""
    parts = F.filter(F.transform(F.split(flat, r",|\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    return _once(parts, lambda p: F.struct(
        F.when(F.size(p) >= 3, p[0]).alias("building"), F.when(F.size(p) >= 3, F.get(p, F.lit(1))).when(F.size(p) == 2, p[0]).alias("street"),
        F.coalesce(F.when(F.size(p) >= 3, F.get(p, F.lit(2))), F.when(F.size(p) == 2, F.get(p, F.lit(1))), F.get(p, F.lit(0))).alias("locality"), F.when(F.size(p) >= 3, F.get(p, F.size(p) - 2)).alias("city"),
    ))


def parse_address(address: Column, keep_commas: bool = False) -> Column:
    """struct(building, street, locality, city, pincode, raw).

    The normal form has neither commas nor wide gaps, so by default the whole of it is the locality, unless a locality's
    alias is in it; keep_commas splits the address as it was written instead. Null for null or empty addresses.
    """
    def build(flat):
        named = F.coalesce(*[F.when(F.contains(flat, F.lit(alias)), F.lit(name)) for alias, name in LOCALITIES])
        split = _split_address(F.lower(F.trim(address)) if keep_commas else flat)
        return F.struct(split["building"].alias("building"), split["street"].alias("street"), F.coalesce(named, split["locality"]).alias("locality"), split["city"].alias("city"), pincode(flat).alias("pincode"), flat.alias("raw"))

    return F.when(F.coalesce(address, F.lit("")) != "", _once(F.coalesce(normalize_address(address), F.lower(F.trim(address))), build))


# Letters with marks and their plain forms, from the Unicode tables.
_MARKED = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (d := unicodedata.normalize("NFKD", chr(c))) and d[0].isascii() and d != chr(c) and all(unicodedata.combining(x) for x in d[1:])]


def plain_key(text: Column) -> Column:
    """Lower case, marks off, only a-z, 0-9 and single blanks; empty for null."""
    bare = F.translate(F.coalesce(text, F.lit("")), "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))
    return _squeeze(F.regexp_replace(F.lower(F.regexp_replace(bare, r"[^\x00-\x7F]", "")), r"[^a-z0-9\s]", ""))


def title(name: Column) -> Column:
    """Words from a technical name: underscores become blanks, each word has a capital."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def identity_text(name: Column, address: Column, sector: Column) -> Column:
    """What stands for a business as one text: name, cleaned address, sector. Tax numbers are never in it."""
    clean = F.replace(F.replace(F.lower(address), F.lit(","), F.lit(" ")), F.lit("."), F.lit(" "))
    return F.trim(F.concat_ws(" ", _blank_to_null(name), _blank_to_null(clean), _blank_to_null(F.lower(sector))))


def record_texts(name: Column, address: Column, sector: Column, proprietor: Column) -> Column:
    """struct(name, address, business): the texts of a record that are embedded."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    owner = F.when(empty(proprietor) != "", F.concat(F.lit(" proprietor "), proprietor)).otherwise("")
    business = F.trim(F.concat(identity_text(name, address, sector), owner))
    return F.struct(empty(name).alias("name"), empty(address).alias("address"), F.coalesce(_blank_to_null(business), _blank_to_null(name), empty(address)).alias("business"))


# Words that the embedding's name cleaner takes out before and after punctuation.
EMBED_BEFORE, EMBED_AFTER = r"\b(m/s\.|m/s|ms|mr|sri|shri|new|the)\b", r"\b(pvt ltd|llp|&co|pvt|ltd|private limited|proprietary|prop)\b"


def embedding_name(name: Column) -> Column:
    """A business name as it is embedded. (Hashing it first, as pseudonym_name does, would leave nothing to compare.)"""
    out = F.regexp_replace(F.lower(F.trim(name)), EMBED_BEFORE, "")
    out = F.regexp_replace(out, r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(out, EMBED_AFTER, ""))


# Words that tell a sector, in order of precedence.
SECTOR_WORDS = ((("ENGINEERING", "TOOLS", "WORKS", "METAL"), "Engineering"), (("CHEMICALS", "PLASTICS"), "Chemicals & Pharma"), (("ELECTRONICS", "AUTOMATION", "SYSTEMS"), "Electronics/IT"), (("LOGISTICS", "SERVICES", "SOLUTIONS"), "Services"))


def sector_of(name: Column, table=SECTOR_WORDS, other: str = "Others") -> Column:
    """The first sector of the table one of whose words is in the name."""
    return F.coalesce(*[F.when(F.upper(name).rlike("|".join(keys)), F.lit(sector)) for keys, sector in table], F.lit(other))


def unfence(text: Column) -> Column:
    """A statement without the fences of a code block around it."""
    return F.trim(F.regexp_replace(text, "```(sql)?", ""))


def name_prefix(name: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s", ""), 1, n)


def clip_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")
