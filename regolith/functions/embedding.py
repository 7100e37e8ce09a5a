"""Texts as vectors: a hook for any model, and a deterministic stand-in made of column expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

DIMENSIONS = 64


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed counts of hashed words (array<float>), empty for a blank text. The first four digits of a word's MD5 choose
    its place, the fifth its sign."""
    number = lambda w, at, n: F.conv(F.substring(F.md5(w), at, n), 16, 10).cast("int")
    cells = F.transform(words(F.lower(text)), lambda w: F.struct((number(w, 1, 4) % dimensions).alias("at"), F.when(number(w, 5, 1) % 2 == 0, 1).otherwise(-1).alias("sign")))

    def vector(found):
        one = lambda i: F.aggregate(F.filter(found, lambda c: c["at"] == i), F.lit(0), lambda s, c: s + c["sign"])
        return F.when(F.size(found) == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: one(i).cast("float")))

    return F.element_at(F.transform(F.array(cells), vector), 1)


def patient(model: Callable[[str], Iterable[float]], tries: int = 3, pause: float = 0.25) -> Callable[[str], list[float]]:
    """The model with a few more tries, each after a longer pause; an empty vector for a blank text or at last."""

    def embed(text: str) -> list[float]:
        if not text or not text.strip():
            return []
        for turn in range(tries):
            try:
                return [float(x) for x in model(text.strip())]
            except Exception:  # whatever a service raises, a batch of texts goes on
                time.sleep(pause * (turn + 1) if turn + 1 < tries else 0)
        return []

    return embed


def with_model(df: DataFrame, text_col: str, out_col: str, load: Callable[[], Callable[[str], Iterable[float]]], parallel: int | None = None, pause: float = 0.0) -> DataFrame:
    """Vectors by a model that `load` makes once a task. As many calls run at once as there are tasks (`parallel`, or the
    table's own); `pause` seconds lie between the calls of a task."""
    schema = df.drop(out_col).withColumn(out_col, F.array().cast("array<float>")).schema

    def run(frames):
        embed = patient(load())
        for frame in frames:
            found = []
            for text in frame[text_col]:
                found.append(embed(text))
                time.sleep(pause)
            yield frame.drop(columns=[out_col], errors="ignore").assign(**{out_col: pd.Series(found, dtype="object")})

    return (df.repartition(parallel) if parallel else df).mapInPandas(run, schema)


def ensure(df: DataFrame, texts: dict[str, str], embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """Missing (null or empty) vectors filled in: texts names the text column of each vector column. A blank text leaves
    its vector as it is."""
    fill = lambda v, t: F.when((F.coalesce(F.size(F.col(v)), F.lit(0)) <= 0) & (F.trim(F.col(t)) != ""), embed(F.col(t))).otherwise(F.col(v))
    return df.withColumns({v: fill(v, t) for v, t in texts.items()})
