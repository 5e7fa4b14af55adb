"""Runs stateless steps over a stream of conversations, batch by batch, with the batch engine's own operators.

Every step of STATELESS rewrites or drops rows by themselves, so a stream gives the rows that a batch gives. Sources, sinks, statistics and
sampling look across rows and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.descriptor import Step
from ..plans.registry import Context, Registry

STATELESS = {"Participants", "HtmlStrip", "RenameParticipants", "Encoding", "Trim", "RegexReplace", "ExactReplace", "FullMatch"}


def apply(stream: DataFrame, steps: list[Step], context: Context | None = None, registry: Registry | None = None) -> DataFrame:
    """The steps on a streaming DataFrame of the conversation schema: a lazy plan, without foreachBatch."""
    registry, context = registry or Registry(), context or Context(stream.sparkSession)
    for s in steps:
        if s.type not in STATELESS:
            raise ValueError(f"{s.type} looks across rows; it can't run on a stream")
        stream = registry[s.type](s.config, context)(stream)
    return stream


def write(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of Parquet files, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
