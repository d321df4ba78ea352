"""Joins of tables that both grow: neither is sent to every task, and keys that very many rows share do not gather in one.

Spark decides on a broadcast by the bytes of the files that a side is read from, before it knows what becomes of them: exploded
words of questions look like a few compressed megabytes and fill the driver. So sides that grow have a merge hint here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose rows are answered where they lie; no other key has more than one in as many of all rows.
FREQUENT = 1_000


def meet(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """many joined with few on keys, with many's columns first, where some keys may have any share of many's rows.

    What few has under many's most frequent keys goes to every task; all other rows meet by a merge join. Counts are ordered to
    the last key, so the same keys are the frequent ones wherever the plan asks. few should have a bounded number of rows for a key.
    """
    often = F.broadcast(many.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(FREQUENT).select(*keys))
    near = many.join(F.broadcast(few.join(often, keys, "left_semi")), keys)
    rest = many.join(often, keys, "left_anti").join(few.hint("merge"), keys)
    columns = many.columns + [c for c in few.columns if c not in keys]
    return near.select(*columns).unionByName(rest.select(*columns))
