"""Similarities as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import words


def tokens(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / every).otherwise(0.0).cast("double")


def dice(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both * 2 / (F.size(a) + F.size(b))).otherwise(0.0).cast("double")


def phonetic_tokens(code: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(code, F.lit("")), "DM:|SX:", "")
    return F.array_distinct(F.filter(F.split(plain, r"[|\s]+"), lambda x: x != ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_of(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    """With norms that are known."""
    return F.coalesce(F.when(norm_a * norm_b > 0, dot(a, b) / (norm_a * norm_b)), F.lit(0.0))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """0 for empty or zero vectors."""
    out = cosine_of(a, norm(a), b, norm(b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) if clamp else out


def exact(a: Column, b: Column) -> Column:
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def conflict(a: Column, b: Column) -> Column:
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (x != y), F.lit(False))


def shared_tokens(a: Column, b: Column) -> Column:
    """Words that both texts have, sorted."""
    return F.array_sort(F.array_intersect(tokens(a), tokens(b)))


def _longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine word of bits for each of a's characters."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    open_ = mask = (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & mask
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    return 2 * _longest_common(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def best(x, y):
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        return max(ratio(x, y), ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))))

    return pd.Series([best(x, y) for x, y in zip(a, b)], dtype="float64")


#: How alike two names are: by characters (ratio, in Arrow batches), or by words.
NAME_VARIANTS = {"ratio": lambda a, b: _name_ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), "dice": lambda a, b: dice(tokens(a), tokens(b)), "jaccard": lambda a, b: jaccard(tokens(a), tokens(b))}


def name_similarity(a: Column, b: Column, variant: str = "dice") -> Column:
    return NAME_VARIANTS[variant](a, b)


#: Variants that compare sets of words.
BY_WORDS = {"dice": dice, "jaccard": jaccard}


def address_tokens(address: Column, variant: str = "dice") -> Column:
    parts = {"dice": ("locality", "street", "building"), "jaccard": ("raw", "building", "street", "locality", "city")}[variant]
    return tokens(F.concat_ws(" ", *[address[p] for p in parts]))


def address_overlap(a: Column, b: Column, variant: str = "dice") -> Column:
    """Of two parsed addresses: Dice over locality, street and building, or Jaccard over all text parts."""
    return BY_WORDS[variant](address_tokens(a, variant), address_tokens(b, variant))
