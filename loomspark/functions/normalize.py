"""Normalisation functions of mappings: pipelines of named steps over a string column.

All but three steps are built-in expressions; NFKC, NFC and case folding have none and are Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .scalar import trim

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Legal suffixes of company names.
LEGAL_SUFFIXES = ("inc", "inc.", "llc", "ltd", "ltd.", "limited", "plc", "gmbh", "ag", "sa", "bv", "corp", "corp.", "co", "co.")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?$"
TIMESTAMP = r"^[^T]+T.*(Z|\+00:00)$"


def _udf(function):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else function(x))

    return run


def nfkc(x: Column) -> Column:
    return _udf(lambda s: unicodedata.normalize("NFKC", s))(x)


def nfc(x: Column) -> Column:
    return _udf(lambda s: unicodedata.normalize("NFC", s))(x)


def casefold(x: Column) -> Column:
    return _udf(str.casefold)(x)


def checked(x: Column, good: Column, what: str) -> Column:
    return F.when(x.isNull() | good, x).otherwise(F.raise_error(F.lit(f"E_EXPRESSION: not a {what}")).cast("string"))


def strip_legal_suffix(x: Column, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Removes suffixes that white space precedes, again and again, and never the whole value."""
    either = "|".join(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True))
    return F.regexp_replace(x, rf"(?iU)(?<=\S)(\s+({either}))+\s*$", "")


STEPS = {
    "identity": lambda x: x,
    "trim": trim,
    "unicode_nfkc": nfkc,
    "unicode_nfc": nfc,
    "unicode_casefold": casefold,
    "strip_punctuation": lambda x: F.regexp_replace(x, PUNCTUATION, ""),
    "collapse_whitespace": lambda x: trim(F.regexp_replace(x, r"(?U)\s+", " ")),
    "strip_legal_suffix": strip_legal_suffix,
    "sort_tokens": lambda x: F.array_join(F.array_sort(F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")), " "),
    "ascii_lower": lambda x: F.translate(x, UPPER, LOWER),
    "trim_lower": lambda x: F.translate(trim(x), UPPER, LOWER),
    "concat_delimited": lambda x: F.array_join(x, "|"),
    "parse_int64": lambda x: trim(x).cast("bigint"),
    "parse_decimal": lambda x: checked(trim(x), trim(x).rlike(DECIMAL), "decimal"),
    "parse_timestamp_utc": lambda x: checked(x, x.rlike(TIMESTAMP), "timestamp in UTC"),
    "sha256_hex": lambda x: F.sha2(x.cast("string"), 256),
}


def pipeline(x: Column, steps: list[str], declared: set[str] | None = None) -> Column:
    for step in steps:
        if step not in STEPS or declared is not None and step not in declared:
            raise QueryError("E_UNSUPPORTED_FUNCTION", step)
        x = STEPS[step](x)
    return x
