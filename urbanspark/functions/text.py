"""Text, identity and hashing functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Namespace of name-based ids: the standard URL namespace, a fixed value.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"\s+", " "))


def normalize_search(c: Column) -> Column:
    """Compatibility form, lower case, yo as ye, single spaces."""
    return _spaced(F.translate(F.lower(nfkc(c)), "ё", "е"))


def normalize_search_v1(c: Column) -> Column:
    return F.translate(F.lower(c), "ё", "е")


def norm_name(c: Column) -> Column:
    return _blank_to_null(_spaced(F.lower(nfkc(c))))


def norm_url(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    return _blank_to_null(F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", ""))


def norm_phone(c: Column) -> Column:
    """Digits of each number of seven digits or more, sorted and joined."""
    digits = F.transform(F.split(c, "[;,]"), lambda p: F.regexp_replace(p, r"\D", ""))
    return _blank_to_null(F.array_join(F.array_sort(F.array_distinct(F.filter(digits, lambda d: F.length(d) >= 7))), ";"))


def _blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def tag(tags: Column, *keys: str) -> Column:
    """The first non-blank value of several keys."""
    return F.coalesce(*(_blank_to_null(F.trim(F.try_element_at(tags, F.lit(k)))) for k in keys))


def has_any_key(tags: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys)))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trgm_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def row_sha256(*columns: Column | str) -> Column:
    """Digest of the canonical JSON of some columns; nulls are written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def any_distinct(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether some pair differs, nulls being equal to each other."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~a.eqNullSafe(b)
    return out
