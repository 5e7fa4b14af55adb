"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, shared_dir, ship, stored, stored_at

__all__ = ["col", "drop", "fresh", "partitions", "read", "rest_hash", "shared_dir", "ship", "small", "stored", "stored_at", "whole_groups"]


def fresh(columns: list[str], *names: str) -> list[str]:
    """Internal column names that no column of the input has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        k = f"_{name}"
        while k.lower() in taken:
            k = f"_{k}"
        taken.add(k.lower())
        out.append(k)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def rest_hash(df: DataFrame, *but: str) -> Column:
    """A hash of all columns but those named: a tie order that doesn't depend on how rows lie. Maps and variants count by their JSON."""
    rest = [F.to_json(F.struct(col(c).alias("x"))) if "map<" in kind or "variant" in kind else col(c) for c, kind in df.dtypes if c not in but]
    return F.xxhash64(*rest) if rest else F.lit(0).cast("long")


def small(df: DataFrame, rows: int, row_bytes: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; else Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches, keys: list[str], most_bytes: int = 32 << 20):
    """(table, starts): tables of whole groups from record batches sorted by keys, with the first row of each group.

    What memory holds at once is bounded by most_bytes and the largest group.
    """
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most_bytes:
            t, starts = _grouped(held, keys)
            if len(starts) > 1:
                yield t.slice(0, int(starts[-1])), starts[:-1]
                t = t.slice(int(starts[-1])).take(pa.array(np.arange(t.num_rows - int(starts[-1]))))  # a copy, to let go of the rest
                held, size = t.to_batches(), t.nbytes
            most_bytes = max(most_bytes, 2 * size)
    if held:
        yield _grouped(held, keys)


def _grouped(held: list, keys: list[str]):
    t = pa.Table.from_batches(held).combine_chunks()
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t[k].to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return t, np.flatnonzero(new)
