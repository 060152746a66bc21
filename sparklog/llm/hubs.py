"""Joins by keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task may well take, all of one key or not.
FEW_ROWS = 20_000
#: A key with more than this share of all rows is a hub; there are fewer hubs than its inverse.
HUB_SHARE = 1 / 1000


def with_hubs(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``known(key, ..., n)`` by ``key``, where ``n`` counts the key's rows among ``total``.

    Keys with more than HUB_SHARE of all rows are broadcast, fewer than the inverse of it whatever the input.
    """
    if total <= FEW_ROWS:
        return rows.join(known.drop("n"), key)
    hub = F.col("n") > total * HUB_SHARE + 100
    hubs = F.broadcast(known.where(hub).drop("n").withColumn("__hub", F.lit(True)))
    told = rows.join(hubs, key, "left")
    others = told.where("__hub is null").select(*rows.columns).join(known.where(~hub).drop("n"), key)
    return others.unionByName(told.where("__hub").drop("__hub"))
