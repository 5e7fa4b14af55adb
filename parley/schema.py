"""The conversation table and its flat form.

A conversation is one row: conversation_seq (its place in the order of the input), id, input_id (the id as the input
had it), messages (array of id, from, value, in order) and meta. It stays when all of its messages go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import ship

MESSAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
CONVERSATION = T.StructType([
    T.StructField("conversation_seq", T.LongType()), T.StructField("id", T.LongType()), T.StructField("input_id", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])
#: Bits of an order that share a bucket when rows are numbered.
BUCKET_BITS = 16
#: Bits of buckets that are summed up in one window.
TOP_BITS = 24


def no_meta() -> Column:
    return F.lit(None).cast("map<string,string>")


def message(id: Column, from_: Column, value: Column) -> Column:
    return F.struct(id.cast("long").alias("id"), from_.alias("from"), value.alias("value"))


def from_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations of a table with a row for each turn; nulls in role and text become empty."""
    m = message(F.col(turn), F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))
    c = turns.groupBy(F.col(conversation).alias("id")).agg(F.sort_array(F.collect_list(m)).alias("messages"))
    return c.select(F.col("id").cast("long").alias("conversation_seq"), F.col("id").cast("long").alias("id"), F.col("id").cast("string").alias("input_id"), "messages", no_meta().alias("meta"))


def from_texts(table: DataFrame, id: str, text: str, speaker: str = "text") -> DataFrame:
    """One conversation of one message for each row."""
    m = F.array(message(F.lit(0), F.lit(speaker), F.coalesce(text, F.lit(""))))
    return table.select(F.col(id).cast("long").alias("conversation_seq"), F.col(id).cast("long").alias("id"), F.col(id).cast("string").alias("input_id"), m.alias("messages"), no_meta().alias("meta"))


def flat(conversations: DataFrame) -> DataFrame:
    """conversation_seq, id, pos, message_id, from, value: a row for each message."""
    x = conversations.select("conversation_seq", "id", F.posexplode("messages").alias("pos", "m"))
    return x.select("conversation_seq", "id", "pos", F.col("m.id").alias("message_id"), F.col("m.from").alias("from"), F.col("m.value").alias("value"))


def with_values(conversations: DataFrame, rewrite) -> DataFrame:
    """Each message's value replaced by rewrite(value), a column expression."""
    return conversations.withColumn("messages", F.transform("messages", lambda m: m.withField("value", rewrite(m["value"]))))


def with_udf_values(conversations: DataFrame, udf) -> DataFrame:
    """The same by an Arrow function of array<string>, as Python functions can't stand in a lambda."""
    ship(conversations.sparkSession)
    new = conversations.withColumn("_values", udf(F.transform("messages", lambda m: m["value"])))
    return new.withColumn("messages", F.transform("messages", lambda m, i: m.withField("value", F.get("_values", i)))).drop("_values")


def numbered(df: DataFrame, by: str, *then: str, name: str = "n") -> DataFrame:
    """df with the place of each row, from 0, in the order of the whole number `by` (and then `then`).

    No window spans the table: rows are counted by stretches of 2**16 values of the order, stretches are summed up within 2**24 of them, and these sums in turn,
    so the widest window has 2**24 narrow rows however far apart the values lie. Rows are numbered within their stretch.
    """
    b = df.withColumn("_bucket", F.shiftright(F.col(by).cast("long"), BUCKET_BITS))
    counts = b.groupBy("_bucket").count().withColumn("_top", F.shiftright("_bucket", TOP_BITS))
    tops = counts.groupBy("_top").agg(F.sum("count").alias("_sum"))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("_top", ahead(Window.orderBy("_top"), "_sum").alias("_first"))
    base = counts.withColumn("_base", ahead(Window.partitionBy("_top").orderBy("_bucket"), "count")).join(tops, "_top").select("_bucket", (F.col("_base") + F.col("_first")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(by, *then))
    return b.join(base, "_bucket").withColumn(name, F.col("_base") + inside - 1).drop("_bucket", "_base")
