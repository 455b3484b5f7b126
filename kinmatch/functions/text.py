"""Normalisation of names and addresses as column expressions.

Everything but accent folding is a built-in expression. Spark has no Unicode decomposition, so folding crosses to Python in Arrow
batches, and only for texts that have a character beyond ASCII.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Abbreviations of names.
NAME_WORDS = {
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "pvt": "private",
    "co": "company", "cie": "company", "intl": "international", "svcs": "services",
    "svc": "service", "mfg": "manufacturing", "assoc": "associates", "bros": "brothers",
    "dept": "department", "grp": "group", "natl": "national", "mgmt": "management",
    "tech": "technologies", "technology": "technologies",
}
# Legal forms and glue words that a core name goes without.
NAME_GLUE = [
    "incorporated", "corporation", "company", "limited", "private", "llc", "llp", "lp", "plc",
    "pty", "gmbh", "sarl", "sas", "sasu", "eurl", "sa", "sca", "snc", "opc", "ltda",
    "and", "et", "the", "of", "de", "du", "des", "la", "le", "les", "d", "l",
]
# Abbreviations of addresses.
ADDRESS_WORDS = {
    "r": "rue",
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "bd": "boulevard", "bvd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court", "pl": "place",
    "sq": "square", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "fl": "floor", "flr": "floor",
    "bldg": "building", "apt": "apartment", "sec": "sector", "mkt": "market", "cir": "circle",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest",
    "se": "southeast", "sw": "southwest", "rte": "route", "ext": "extension", "opp": "opposite", "nr": "near",
}
# Fixed value: a landmark clause, up to the next comma or semicolon.
LANDMARK = r"\b(near|nr|opp|opposite|behind|beside|besides|next to|adjacent to|close to)\b[^,;]*"

#: Letters and digits of any script; marks and the underscore are not among them. Java's \w would add the marks.
NOT_WORD = r"(?U)[^\p{L}\p{N}\s]"
SPACE = r"(?U)\s+"

_MARKS = "".join(chr(c) for c in range(sys.maxunicode) if unicodedata.combining(chr(c)))
_LATIN_MARKS = re.compile(f"(?<=[\x00-ɏ])[{re.escape(_MARKS)}]+")


def fold_text(text: str) -> str:
    """Decomposes a text and drops the marks on Latin letters; other scripts keep theirs."""
    return _LATIN_MARKS.sub("", unicodedata.normalize("NFKD", text))


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def fold_accents(text: Column) -> Column:
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(_fold(F.when(~plain, text)))


def strip(text: Column) -> Column:
    """Without white space of any script at the ends; trim() knows only the blank."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _simplify(lowered: Column) -> Column:
    spelled = F.replace(lowered, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, NOT_WORD, " "), SPACE, " "))


def tokens(text: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def _expand(text: Column, words: dict[str, str]) -> Column:
    long = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.element_at(long, t), t)), " ")


def lower_folded(text: Column) -> Column:
    return F.lower(fold_accents(text))


def basic(folded: Column) -> Column:
    """Of a folded lower-case text: `&` spelled out, punctuation to blanks, single blanks."""
    return _simplify(folded)


def name_norm(folded: Column) -> Column:
    return _expand(basic(folded), NAME_WORDS)


def name_core(norm: Column) -> Column:
    """A normalised name without legal forms and glue words, or the whole name if nothing else is left."""
    glue = F.array(*map(F.lit, NAME_GLUE))
    core = F.array_join(F.filter(tokens(norm), lambda t: ~F.array_contains(glue, t)), " ")
    return F.when(core == "", norm).otherwise(core)


def acronym(core: Column) -> Column:
    return F.array_join(F.transform(tokens(core), lambda t: F.substring(t, 1, 1)), "")


def address_full(folded: Column) -> Column:
    return _expand(basic(folded), ADDRESS_WORDS)


def address_core(folded: Column) -> Column:
    """A normalised address without landmark clauses, or the whole address if nothing else is left."""
    core = _expand(basic(F.regexp_replace(folded, LANDMARK, " ")), ADDRESS_WORDS)
    return F.when(core == "", address_full(folded)).otherwise(core)


def _digit_runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Nd}+)"), F.lit(1)))


def postal_codes(address: Column) -> Column:
    """The runs of five or six digits in a raw address, as a sorted set."""
    return F.array_sort(F.filter(_digit_runs(address), lambda r: F.length(r).isin(5, 6)))


def numbers(address: Column) -> Column:
    """The runs of digits of other lengths, as a sorted set."""
    return F.array_sort(F.filter(_digit_runs(address), lambda r: ~F.length(r).isin(5, 6)))


def compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def char_grams(text: Column, n: int) -> Column:
    """All windows of n characters, repeats included."""
    made = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, made).otherwise(F.array().cast("array<string>"))
