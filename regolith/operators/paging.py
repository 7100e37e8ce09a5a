"""Pages by key: a page begins after the last row of the one before, so no rows are counted off."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A sort column, whether it falls, and whether nulls come first.
Key = tuple[str, bool, bool]


def _order(key: Key) -> Column:
    name, falls, nulls_first = key
    c = F.col(name)
    return (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if falls else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last())


def _after(key: Key, value) -> Column:
    """Whether a row's key comes after the value."""
    name, falls, nulls_first = key
    c = F.col(name)
    if value is None:
        return c.isNotNull() if nulls_first else F.lit(False)
    later = F.coalesce(c < F.lit(value) if falls else c > F.lit(value), F.lit(False))
    return later if nulls_first else later | c.isNull()


def cursor(row: Row | dict, keys: list[Key]) -> dict:
    """What names a row's place: the values of its keys."""
    return {k[0]: row[k[0]] for k in keys}


def page(rows: DataFrame, keys: list[Key], after: dict | None = None, limit: int = 25) -> DataFrame:
    """The first rows after the cursor, in order of the keys, the last of which must tell all rows apart.

    The first key's range stands as a condition of its own, which reaches the files: sorted or ranged ones are skipped.
    """
    if after is not None:
        first = keys[0]
        ahead = _after(first, after[first[0]])
        here = F.col(first[0]).isNull() if after[first[0]] is None else F.col(first[0]) == F.lit(after[first[0]])
        tests, same = [], []
        for k in keys:
            tests.append(reduce(and_, [*same, _after(k, after[k[0]])]))
            same.append(F.col(k[0]).eqNullSafe(F.lit(after[k[0]])))
        if after[first[0]] is not None and first[2]:  # what is ahead has values, so a plain range says it
            c = F.col(first[0])
            rows = rows.filter(c <= F.lit(after[first[0]]) if first[1] else c >= F.lit(after[first[0]]))
        else:
            rows = rows.filter(ahead | here)
        rows = rows.filter(reduce(or_, tests))
    return rows.orderBy(*[_order(k) for k in keys]).limit(limit)
