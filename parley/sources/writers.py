"""Sinks. Rows are formatted by the executors; a single file is put together from part files, streamed in order."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.filters import sampled
from ..schema import flat

FIELDS = ("message", "conversation", "from", "value", "hash")


def local(path: str) -> str:
    """A path on the driver: %worker% becomes a constant, a file: scheme goes."""
    return path.replace("%worker%", "main").removeprefix("file://")


def _streamed(df: DataFrame, column: str = "line") -> Iterator[str]:
    """A column's values in the order of the rows, a partition at a time."""
    for r in df.select(column).toLocalIterator(prefetchPartitions=True):
        yield r[0]


def _open(path: str, append: bool = False, make: bool = True):
    if make:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return open(path, "a" if append else "w", encoding="utf-8", newline="")


def _put(df: DataFrame, path: str, column: str = "line", end: str = "\n", append: bool = False) -> None:
    with _open(path, append) as f:
        for line in _streamed(df, column):
            f.write(line + end)


def write_parts(lines: DataFrame, path: str, *order: str, end: str = "\n", zipped: bool = False, overwrite: bool = False) -> None:
    """A folder of text files, written by the executors: in the order of the rows over the files' names, and within each."""
    out = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    out.select("line").write.mode("overwrite" if overwrite else "error").options(lineSep=end, **({"compression": "gzip"} if zipped else {})).text(path)


def csv_cell(c: Column) -> Column:
    """Quoted where it holds a comma, quote or line end."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_cell), ",")


def csv_rows(df: DataFrame, fields: list[str], ignore_duplicates: bool = False) -> DataFrame:
    """(conversation_seq, pos, line), a row for each message; ignore_duplicates keeps the first of equal lines."""
    unknown = [f for f in fields if f not in FIELDS]
    if unknown or not fields:
        raise ValueError(f"fields must be of {sorted(FIELDS)}: {fields}")
    def line(m):
        cells = {"message": m["id"], "conversation": F.col("id"), "from": m["from"], "value": m["value"], "hash": F.xxhash64(m["from"], m["value"])}
        return csv_line(F.array(*(F.coalesce(cells[f].cast("string"), F.lit("")) for f in fields)))

    lines = df.select("conversation_seq", F.transform("messages", line).alias("lines"))
    if not ignore_duplicates:
        return lines.select("conversation_seq", F.posexplode("lines").alias("pos", "line"))
    own = lines.select("conversation_seq", "lines", F.explode(F.array_distinct("lines")).alias("line"))
    own = own.select("conversation_seq", "line", (F.array_position("lines", F.col("line")) - 1).cast("int").alias("pos"))
    first = own.groupBy("line").agg(F.min_by("pos", "conversation_seq").alias("pos"), F.min("conversation_seq").alias("conversation_seq"))  # hashed, and combined before the shuffle
    return first.select("conversation_seq", "pos", "line")


def write_csv(df: DataFrame, path: str, fields: list[str], header: list[str] = (), ignore_duplicates: bool = False, overwrite: bool = False) -> DataFrame:
    """CRLF rows; the header is written only where the file is new. Returns df."""
    path = local(path)
    new = not os.path.exists(path)
    rows = csv_rows(df, fields, ignore_duplicates).orderBy("conversation_seq", "pos")
    with _open(path, append=not overwrite) as f:
        if header and new:
            f.write(",".join('"' + h.replace('"', '""') + '"' if any(c in h for c in ',"\r\n') else h for h in header) + "\r\n")
        for line in _streamed(rows):
            f.write(line + "\r\n")
    return df


def chat_lines(df: DataFrame, include_message_id: bool = False) -> DataFrame:
    """(conversation_seq, line): {id, conversations: [{[id,] from, value}]}."""
    m = F.transform("messages", lambda m: F.struct(*([m["id"].alias("id")] if include_message_id else []), m["from"].alias("from"), m["value"].alias("value")))
    return df.select("conversation_seq", F.to_json(F.struct("id", m.alias("conversations"))).alias("line"))


def native_lines(df: DataFrame) -> DataFrame:
    """(conversation_seq, line): {id, messages: [{from, value}]}."""
    m = F.transform("messages", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value")))
    return df.select("conversation_seq", F.to_json(F.struct("id", m.alias("messages"))).alias("line"))


def write_json_array(lines: DataFrame, path: str, indent: int = 0) -> None:
    """A valid JSON array of lines, in order."""
    import json

    with _open(local(path)) as f:
        f.write("[")
        for k, line in enumerate(_streamed(lines.orderBy("conversation_seq"))):
            f.write(",\n" if k else "\n")
            f.write(json.dumps(json.loads(line), ensure_ascii=False, indent=indent) if indent else line)
        f.write("\n]\n")


def raw_lines(df: DataFrame, escape: bool = False) -> DataFrame:
    v = F.col("value")
    return flat(df).select("conversation_seq", "pos", (F.replace(v, F.lit("\n"), F.lit("\\n")) if escape else v).alias("line"))


def write_raw(df: DataFrame, path: str, escape: bool = False) -> DataFrame:
    """One line for each message's value. Returns df."""
    _put(raw_lines(df, escape).orderBy("conversation_seq", "pos"), local(path))
    return df


def regex_matches(df: DataFrame, patterns: list[str], escape: bool = False, **flags) -> DataFrame:
    """(conversation_seq, id, pos, from, k, n, match): whole matches, all of pattern k = 0 first, then of 1 and so on."""
    found = F.array(*(F.struct(F.lit(k).alias("k"), F.regexp_extract_all("value", F.lit(T.java_regex(p, **flags)), F.lit(0)).alias("all")) for k, p in enumerate(patterns)))
    x = flat(df).select("conversation_seq", "id", "pos", "from", F.explode(found).alias("f"))
    x = x.select("conversation_seq", "id", "pos", "from", "f.k", F.posexplode("f.all").alias("n", "match"))
    return x.withColumn("match", F.replace("match", F.lit("\n"), F.lit("\\n"))) if escape else x


def write_regex(df: DataFrame, path: str, patterns: list[str], escape: bool, overwrite: bool = False, **flags) -> DataFrame:
    """For each message with a match the line "id / from:", its matches, and an empty line. Returns df."""
    m = regex_matches(df, patterns, escape, **flags)
    g = m.groupBy("conversation_seq", "id", "pos", "from").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "n", "match"))), lambda s: s["match"]), "\n").alias("all"))
    lines = g.select("conversation_seq", "pos", F.concat(F.col("id").cast("string"), F.lit(" / "), F.col("from"), F.lit(":\n"), F.col("all"), F.lit("\n")).alias("line"))
    _put(lines.orderBy("conversation_seq", "pos"), local(path), append=not overwrite)
    return df


def write_sample(df: DataFrame, path: str, ratio: float = 0.1, seed: int = 42, batch_size: int = 100, escape: bool = False, forward_filter: bool = False) -> DataFrame:
    """The messages of sampled conversations as lines. Returns the sample if forward_filter, else all of df."""
    s = sampled(df, ratio, seed, batch_size)
    chosen = s.where("sample").select(*df.columns)
    write_raw(chosen, path, escape)
    return chosen if forward_filter else df


def write_cells(rows: DataFrame, path: str, append: bool = False) -> None:
    """(pos, cells) as CRLF CSV rows."""
    _put(rows.orderBy("pos").select(csv_line("cells").alias("line")), local(path), end="\r\n", append=append)


def write_text(text: str, path: str, zipped: bool = False) -> None:
    path = local(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") if zipped else open(path, "w", encoding="utf-8") as f:
        f.write(text)


def distinct_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(row, line): the first occurrence of each line over all files, in the order given; row tells the order."""
    parts = [spark.read.text(f).select(F.col("value").alias("line")) for f in files]
    if not parts:
        return spark.createDataFrame([], "row long, line string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # a union's partitions are those of its parts in order
    return rows.groupBy("line").agg(F.min("row").alias("row")).select("row", "line")


def concatenate(spark: SparkSession, files: list[str], path: str, append: bool = False, ignore_duplicate_lines: bool = False, eol: str = "\n", delete: bool = False) -> None:
    """Files put together byte by byte, or by their distinct lines, each followed by eol."""
    path = local(path)
    if ignore_duplicate_lines:
        _put(distinct_lines(spark, ["file://" + os.path.abspath(f) for f in files]).orderBy("row"), path, end=eol, append=append)
    else:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "ab" if append else "wb") as out:
            for f in files:
                with open(f, "rb") as part:
                    while block := part.read(1 << 20):
                        out.write(block)
    if delete:
        for f in files:
            os.remove(f)


