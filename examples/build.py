"""A small build from Python: python examples/build.py FOLDER writes chats to FOLDER/in.csv, cleans them and writes out.json and stats."""

import os
import sys

from pyspark.sql import SparkSession

from parley.plans.engine import Engine
from parley.plans.registry import Registry

BUILD = """
build: {}
passes:
- required: [{path: in.csv}]
  steps:
  - {type: CsvInput, config: {path: in.csv, fields: {conversation: chat, from: speaker, message: text}}}
  - {type: RegexReplace, config: {replacements: [[' +', ' ']]}}
  - {type: Trim}
  - {type: Quiet}
  - {type: Participants, config: {min: 2, alternating: true}}
  - {type: StatsOutput, config: {path: stats, tables: true, overwrite: true}}
  - {type: FastChatOutput, config: {path: out.json}}
  artifacts: [{file: out.json}]
"""
ROWS = "n,chat,speaker,text\n0,a,user,  Hello   there! \n1,a,bot,HELLO\n2,a,bot,How are you?\n3,b,user,Nobody answers\n"


def quiet(config: dict, conversations: list[dict]) -> list[dict]:
    """A step of one's own: no shouting."""
    for c in conversations:
        for m in c["messages"]:
            m["value"] = m["value"].capitalize() if m["value"].isupper() else m["value"]
    return conversations


def main(folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "in.csv"), "w", encoding="utf-8") as f:
        f.write(ROWS)
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    registry = Registry()
    registry.register_task("Quiet", quiet)
    result = Engine(spark, BUILD, folder, registry, lambda event, p: print(f"{event}: {p.messages_processed} of {p.messages_total} messages")).run()
    print(result.hashes)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "example-out")
