"""Filters of messages and conversations, participants and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import numbered


def full_match(df: DataFrame, patterns: list, action: str = "drop", case_sensitive: bool = True) -> DataFrame:
    """Messages whose whole value is a pattern are dropped; the conversation stays, if empty."""
    if action != "drop":
        raise ValueError(f"unknown action {action!r}")
    p = [str(x) if case_sensitive else str(x).lower() for x in patterns]
    value = (lambda m: m["value"]) if case_sensitive else (lambda m: F.lower(m["value"]))
    return df.withColumn("messages", F.filter("messages", lambda m: ~value(m).isin(p))) if p else df


def participants(df: DataFrame, min: int = 0, max: int | None = None, alternating: bool = False) -> DataFrame:
    """Conversations of fewer than min speakers are dropped; of more than max, the speakers of the fewest messages lose theirs (among equals the
    one who spoke first stays); alternating joins consecutive messages of a speaker with line feeds under the first one's id."""
    names = F.array_distinct(F.transform("messages", lambda m: m["from"]))
    if min > 0:
        df = df.where(F.size(names) >= min)
    if max is not None:
        count = F.transform(names, lambda n, i: F.struct((-F.size(F.filter("messages", lambda m: m["from"] == n))).alias("c"), i.alias("i"), n.alias("n")))
        kept = F.transform(F.slice(F.array_sort(count), 1, max), lambda s: s["n"]) if max > 0 else F.array().cast("array<string>")
        df = df.withColumn("messages", F.when(F.size(names) > max, F.filter("messages", lambda m: F.array_contains(kept, m["from"]))).otherwise(F.col("messages")))
    return merged(df) if alternating else df


def merged(df: DataFrame) -> DataFrame:
    """Runs of messages of one speaker as one. The runs are found by place, so the work is linear in the messages."""
    m = F.col("messages")
    size = F.size(m)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(m, i)["from"] != F.get(m, i - 1)["from"]))
    values = F.transform(m, lambda x: x["value"])

    def run(s, k):
        end = F.coalesce(F.get(F.col("_starts"), k + 1), size)
        first = F.get(m, s)
        return first.withField("value", F.array_join(F.slice(values, s + 1, end - s), "\n"))

    out = df.withColumn("_starts", F.when(size > 0, starts).otherwise(F.array().cast("array<int>")))
    return out.withColumn("messages", F.transform("_starts", run)).drop("_starts")


def rename_participants(df: DataFrame, names: list) -> DataFrame:
    """The k-th speaker to appear gets the k-th name; those beyond keep theirs."""
    seen = F.array_distinct(F.transform("messages", lambda m: m["from"]))
    new = F.array(*map(F.lit, map(str, names))) if names else F.array().cast("array<string>")
    return df.withColumn("_seen", seen).withColumn("messages", F.transform("messages", lambda m: m.withField("from", F.coalesce(F.get(new, (F.array_position("_seen", m["from"]) - 1).cast("int")), m["from"])))).drop("_seen")


def sampled(df: DataFrame, ratio: float = 0.1, seed: int = 42, batch_size: int = 100) -> DataFrame:
    """df with `complete` (its block of batch_size conversations is full) and `sample` (it is among the floor(batch_size * ratio) drawn)."""
    n = numbered(df, "conversation_seq", "id", name="_n").withColumn("_block", F.floor(F.col("_n") / batch_size))
    size = F.count("*").over(Window.partitionBy("_block"))
    order = Window.partitionBy("_block").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "conversation_seq")
    n = n.withColumn("complete", size == batch_size).withColumn("_k", F.row_number().over(order))
    return n.withColumn("sample", F.col("complete") & (F.col("_k") <= int(batch_size * ratio))).drop("_n", "_block", "_k")
