"""Conversations from CSV and chat JSON files."""

from __future__ import annotations

import csv
import gzip
import io
import urllib.request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONVERSATION, message, no_meta, numbered

_CHAT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CONVERSATION)


def append(upstream: DataFrame | None, new: DataFrame, mode: str = "append") -> DataFrame:
    """UNION ALL of what came before and what is read; read conversations come after in conversation_seq. mode "replace" leaves out the former."""
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    if upstream is None or mode == "replace":
        return new
    last = upstream.agg((F.coalesce(F.max("conversation_seq"), F.lit(-1)) + 1).alias("_next"))
    shifted = new.crossJoin(F.broadcast(last)).withColumn("conversation_seq", F.col("conversation_seq") + F.col("_next")).drop("_next")  # one row
    return upstream.unionByName(shifted)


def read_csv(spark: SparkSession, path: str, conversation: str, from_: str, message_: str, id: str | None = None, group: str = "adjacent") -> DataFrame:
    """Conversations of CSV rows under a header; the message id is the first column's unless a column is named.

    group "adjacent": a row whose conversation id differs from the row before begins a conversation, so an id may come back as a second
    one. group "global": all rows of an id in a file are one. Rows are taken in the order of each file, files in that of their names. Quoted fields may hold line
    ends, so a file is read by one task and parallelism is over files; nothing but ids and places goes through the windows over a file.
    """
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="", inferSchema=False, mode="PERMISSIVE").csv(path)
    for name in (conversation, from_, message_, *([id] if id else [])):
        if name not in raw.columns:
            raise ValueError(f"no column {name!r} in {path}: {raw.columns}")
    col = lambda n: F.col("`" + n.replace("`", "``") + "`")
    text = lambda n: F.coalesce(col(n), F.lit(""))
    number = F.expr("try_cast(`" + (id or raw.columns[0]).replace("`", "``") + "` as bigint)")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), text(conversation).alias("c"), message(number, text(from_), text(message_)).alias("m"))
    if group == "adjacent":
        w = Window.partitionBy("file").orderBy("row")
        rows = rows.withColumn("new", (F.lag("c").over(w).isNull() | (F.lag("c").over(w) != F.col("c"))).cast("long")).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    elif group == "global":
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        raise ValueError(f"unknown group {group!r}")
    g = rows.groupBy("file", "c", "part").agg(F.min("row").alias("row"), F.transform(F.sort_array(F.collect_list(F.struct("row", "m"))), lambda s: s["m"]).alias("messages"))
    seq = F.dense_rank().over(Window.orderBy("file")).cast("long")  # over files
    files = g.select("file").distinct().select("file", (seq - 1).alias("f"))
    g = g.join(F.broadcast(files), "file").withColumn("at", F.col("f") * F.lit(1 << 40) + F.col("row") % F.lit(1 << 33))
    n = numbered(g, "at", name="conversation_seq")
    return n.select("conversation_seq", F.xxhash64("c").alias("id"), F.col("c").alias("input_id"), "messages", F.create_map(F.lit("inputId"), F.col("c")).alias("meta"))


def read_chat_json(spark: SparkSession, path: str, preserve_ids: bool = False) -> DataFrame:
    """Conversations of JSON arrays of {id, conversations: [{id?, from, value}], meta?}.

    Messages are numbered through each file from 0; preserve_ids keeps the ids that are given, and these take no number.
    """
    raw = spark.read.schema(_CHAT).option("multiLine", True).json(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), "id", F.coalesce("conversations", F.array().cast(_CHAT["conversations"].dataType)).alias("c"), "meta")
    taken = F.size(F.filter("c", lambda m: m["id"].isNull())) if preserve_ids else F.size("c")
    before = F.coalesce(F.sum(taken).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = rows.select("file", "row", before.alias("base"))  # texts stay out of the window
    rows = rows.join(counted, ["file", "row"])
    ids = F.transform("c", lambda m: m["id"])

    def number(m, i):
        if not preserve_ids:
            return F.col("base") + i
        return F.coalesce(m["id"], F.col("base") + F.size(F.filter(F.slice(ids, 1, i), lambda x: x.isNull())))

    messages = F.transform("c", lambda m, i: F.struct(number(m, i).cast("long").alias("id"), F.coalesce(m["from"], F.lit("")).alias("from"), F.coalesce(m["value"], F.lit("")).alias("value")))
    files = rows.select("file").distinct().select("file", (F.dense_rank().over(Window.orderBy("file")) - 1).cast("long").alias("f"))
    rows = rows.join(F.broadcast(files), "file").withColumn("at", F.col("f") * F.lit(1 << 40) + F.col("row") % F.lit(1 << 33)).withColumn("messages", messages)
    n = numbered(rows, "at", name="conversation_seq")
    return n.select("conversation_seq", "id", F.col("id").cast("string").alias("input_id"), "messages", "meta")


def read_cells(path_or_bytes: str | bytes) -> list[list[str]]:
    """The rows of a small CSV file on the driver: side inputs of steps (UTF-8, gzip or not, no header)."""
    data = path_or_bytes
    if isinstance(data, str):
        with open(data, "rb") as f:
            data = f.read()
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    return [r for r in csv.reader(io.StringIO(data.decode("utf-8"), newline="")) if r]


def fetch(source: str, path: str) -> str:
    """A required file downloaded (http, https); anything but success raises."""
    if not source.startswith(("http://", "https://")):
        raise ValueError(f"only http and https can be fetched: {source}")
    with urllib.request.urlopen(source) as r:
        if r.status != 200:
            raise OSError(f"{source}: status {r.status}")
        with open(path, "wb") as f:
            while block := r.read(1 << 20):
                f.write(block)
    return path
