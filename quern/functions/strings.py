"""String scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENT = "[A-Za-z0-9_]"
_BLANK = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"

# The accented letters that fold to each ASCII letter.
FOLDS = {
    "A": "ÀÁÂÃÄÅ", "a": "àáâãäå", "C": "Ç", "c": "ç", "E": "ÈÉÊË", "e": "èéêë", "I": "ÌÍÎÏ", "i": "ìíîï",
    "N": "Ñ", "n": "ñ", "O": "ÒÓÔÕÖ", "o": "òóôõö", "U": "ÙÚÛÜ", "u": "ùúûü",
}


def lower_each(c: Column) -> Column:
    """Lower-case character by character: the two letters whose lower() depends on context or grows map alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.lower(F.translate(c, "İΣ", "iσ")))


def normalize(c: Column) -> Column:
    """Trim Unicode blanks, then lower-case."""
    return lower_each(F.regexp_replace(c, _BLANK, ""))


def normalize_all(terms: Column) -> Column:
    return F.filter(F.transform(terms, normalize), lambda x: x != "")


def is_ident(c: Column) -> Column:
    """Whether c is one ASCII letter, digit or underscore."""
    return c.rlike(f"^{IDENT}$")


def split_ident(c: Column) -> Column:
    """The runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(f"{IDENT}+"), F.lit(0))


def camel_split(c: Column) -> Column:
    """Split before a capital that follows a non-capital, and before the last capital of a run."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][^A-Z])"))


def fold_ascii(c: Column) -> Column:
    """Accented Latin letters to ASCII; other letters, digits and underscores stay, all else goes."""
    plain = "".join(k * len(v) for k, v in FOLDS.items())
    return F.regexp_replace(F.translate(c, "".join(FOLDS.values()), plain), r"[^\p{L}\p{Nd}_]", "")


def join_terms(terms: Column) -> Column:
    return F.array_join(terms, " ")
