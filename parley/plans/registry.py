"""Step types by name. A builder takes (config, context) and gives a function of a DataFrame (or None, before any source)."""

from __future__ import annotations

import glob
import gzip
import json
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, statistics, text
from ..sources import readers, writers
from ..storage import ship

log = logging.getLogger("parley")
Transform = Callable[[DataFrame | None], DataFrame]


@dataclass
class Context:
    """What steps share: the session, the folder that relative paths start from, and side inputs by file name."""

    spark: SparkSession
    base: str = "."
    packed: dict[str, bytes] = field(default_factory=dict)
    finishers: list[Callable[[], None]] = field(default_factory=list)

    def at(self, path: str) -> str:
        path = writers.local(str(path))
        return path if os.path.isabs(path) else os.path.abspath(os.path.join(self.base, path))

    def uri(self, path: str) -> str:
        path = str(path)
        return path if "://" in path else "file://" + self.at(path)

    def files(self, patterns) -> list[str]:
        return [f for p in patterns for f in sorted(glob.glob(self.at(p)))]

    def cells(self, name: str) -> list[list[str]]:
        if name in self.packed:
            return readers.read_cells(self.packed[name])
        if os.path.exists(self.at(name)):
            return readers.read_cells(self.at(name))
        log.warning("side input %s isn't there", name)
        return []


Builder = Callable[[dict, Context], Transform]


def need(config: dict, key: str, kind: str):
    if config.get(key) is None:
        raise ValueError(f"{kind}: {key} is required")
    return config[key]


def _flags(c: dict) -> dict:
    return {"multi_line": bool(c.get("multiLine", False)), "case_sensitive": bool(c.get("caseSensitive", True)), "unicode": bool(c.get("unicode", False)), "dot_all": bool(c.get("dotAll", False))}


def _truth(v) -> bool:
    return v if isinstance(v, bool) else str(v).strip().lower() != "false"


def _participants(c, _):
    return lambda df: filters.participants(df, int(c.get("min", 0)), None if c.get("max") is None else int(c["max"]), bool(c.get("alternating", False)))


def _html(c, _):
    return lambda df: text.html_strip(df, c.get("stripAnchorPatterns") or [], c.get("anchorSelector", "a, img"), c.get("stripDom") or [], bool(c.get("caseSensitive", True)), bool(c.get("bareReferences", True)))


def _rename(c, _):
    names = need(c, "names", "RenameParticipants")
    return lambda df: filters.rename_participants(df, names)


def _encoding(c, _):
    return lambda df: text.encoding(df, c.get("codec", "utf-8"), c.get("invalid", "�"))


def _regex_replace(c, _):
    pairs = need(c, "replacements", "RegexReplace")
    return lambda df: text.regex_replace(df, pairs, **_flags(c))


def _regex_extract(c, x):
    patterns, path, escape = need(c, "patterns", "RegexExtract"), x.at(need(c, "path", "RegexExtract")), need(c, "escape", "RegexExtract")
    return lambda df: writers.write_regex(df, path, patterns, bool(escape), bool(c.get("overwrite", False)), **_flags(c))


def _csv_input(c, x):
    path, fields = x.uri(need(c, "path", "CsvInput")), need(c, "fields", "CsvInput")
    names = [need(fields, k, "CsvInput.fields") for k in ("conversation", "from", "message")]
    return lambda df: readers.append(df, readers.read_csv(x.spark, path, *names, id=fields.get("id"), group=c.get("group", "adjacent")), c.get("mode", "append"))


def _chat_input(c, x):
    path = x.uri(need(c, "path", "FastChatInput"))
    return lambda df: readers.append(df, readers.read_chat_json(x.spark, path, bool(c.get("preserveIds", False))), c.get("mode", "append"))


def _csv_output(c, x):
    if c.get("parts", False):
        return _parts(c, x, "CsvOutput", lambda df: writers.csv_rows(df, need(c, "fields", "CsvOutput"), bool(c.get("ignoreDuplicates", False))), "conversation_seq", "pos")
    path, fields = x.at(need(c, "path", "CsvOutput")), need(c, "fields", "CsvOutput")
    return lambda df: writers.write_csv(df, path, fields, c.get("header") or [], bool(c.get("ignoreDuplicates", False)), bool(c.get("overwrite", False)))


def _exact_replace(c, x):
    def run(df):
        packed = [r for name in c.get("packedReplacements") or [] for r in x.cells(name)]
        return text.exact_replace(df, c.get("replacements") or [], packed, bool(c.get("recursive", False)))

    return run


def _full_match(c, _):
    patterns, action = need(c, "patterns", "FullMatch"), need(c, "action", "FullMatch")
    return lambda df: filters.full_match(df, patterns, action, bool(c.get("caseSensitive", True)))


def _chat_output(c, x):
    if c.get("parts", False):  # a folder of JSON lines, written by the executors
        return _parts(c, x, "FastChatOutput", lambda df: writers.chat_lines(df, bool(c.get("includeMessageId", False))), "conversation_seq")
    path = x.at(need(c, "path", "FastChatOutput"))

    def run(df):
        writers.write_json_array(writers.chat_lines(df, bool(c.get("includeMessageId", False))), path, int(c.get("indent", 0)))
        return df

    return run


def _native_output(c, x):
    path = x.at(need(c, "path", "NativeOutput"))

    def run(df):
        writers.write_json_array(writers.native_lines(df), path)
        return df.limit(0) if c.get("terminal", False) else df

    return run


def _parts(c, x, kind, lines, *order):
    path = x.uri(need(c, "path", kind))

    def run(df):
        writers.write_parts(lines(df), path, *order, end="\r\n" if kind == "CsvOutput" else "\n", zipped=bool(c.get("gZip", False)), overwrite=bool(c.get("overwrite", False)))
        return df

    return run


def _raw_output(c, x):
    if c.get("parts", False):
        return _parts(c, x, "RawOutput", lambda df: writers.raw_lines(df, bool(c.get("escape", False))), "conversation_seq", "pos")
    path = x.at(need(c, "path", "RawOutput"))
    return lambda df: writers.write_raw(df, path, bool(c.get("escape", False)))


def _sample_output(c, x):
    path = x.at(need(c, "path", "RawSampleOutput"))
    ratio, size = float(c.get("ratio", 0.1)), int(c.get("batchSize", 100))
    if ratio * size < 1:
        log.warning("RawSampleOutput: no conversation of a block of %d is drawn at ratio %s", size, ratio)
    return lambda df: writers.write_sample(df, path, ratio, int(c.get("seed", 42)), size, bool(c.get("escape", False)), bool(c.get("forwardFilter", False)))


def _concatenate(c, x):
    files, path = need(c, "files", "FileConcatenate"), x.at(need(c, "path", "FileConcatenate"))

    def finish():
        writers.concatenate(x.spark, x.files(files), path, bool(c.get("append", False)), bool(c.get("ignoreDuplicateLines", False)), c.get("eol", "\n"), bool(c.get("delete", False)))

    def run(df):
        x.finishers.append(finish)  # after the pass has been drained
        return df

    return run


def _occurrences(c, x):
    path = x.at(need(c, "path", "StatsCountOccurrences"))

    def run(df):
        rows = [[p] for p in c.get("patterns") or []] + [r for name in c.get("packedPatterns") or [] for r in x.cells(name)]
        col = int(c.get("patternCol", 0))
        counts = statistics.count_occurrences(df, rows, col, bool(c.get("regex", False)), _truth(c.get("caseSensitive", True)))
        writers.write_cells(statistics.occurrence_rows(counts, rows, int(c.get("countCol", 1)), int(c.get("min", 0))), path, bool(c.get("append", False)))
        return df

    return run


def _merge(c, x):
    files, path = need(c, "files", "StatsAddColMerge"), x.at(need(c, "path", "StatsAddColMerge"))

    def finish():
        rows = read_cell_rows(x.spark, x.files(files))
        writers.write_cells(statistics.add_column_merge(rows, int(c.get("pkey", 0)), [int(k) for k in c.get("cols", [1])], int(c.get("min", 0))), path, bool(c.get("append", False)))

    def run(df):
        x.finishers.append(finish)
        return df

    return run


def read_cell_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """(pos, cells) of CSV files without header, in order."""
    parts = []
    for k, f in enumerate(files):
        raw = spark.read.options(header=False, multiLine=True, escape='"', nullValue="\x00", emptyValue="").csv("file://" + os.path.abspath(f))
        cells = F.filter(F.array(*(F.col(n) for n in raw.columns)), lambda v: v.isNotNull())
        parts.append(raw.select((F.lit(k << 40) + F.monotonically_increasing_id()).alias("pos"), cells.alias("cells")))
    if not parts:
        return spark.createDataFrame([], "pos long, cells array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stats_output(c, x):
    if c.get("tables", False):  # Parquet tables in a folder, written by the executors
        folder = x.uri(need(c, "path", "StatsOutput"))

        def tables(df):
            mode = "overwrite" if c.get("overwrite", False) else "error"
            statistics.conversation_stats(df).write.mode(mode).parquet(f"{folder}/conversations")
            statistics.corpus_stats(x.spark.read.parquet(f"{folder}/conversations")).write.mode(mode).parquet(f"{folder}/corpus")
            statistics.vocabulary(df).write.mode(mode).parquet(f"{folder}/vocabulary")
            return df

        return tables
    path = x.at(need(c, "path", "StatsOutput"))
    indent = c.get("indent", " ")

    def run(df):
        stats = statistics.conversation_stats(df).cache()
        try:
            corpus = statistics.corpus_stats(stats).first().asDict()
            out = {_camel(k): v for k, v in corpus.items()}
            rows = (r.asDict() for r in stats.orderBy("id").toLocalIterator())
            conversations = {str(r.pop("id")): {_camel(k): v for k, v in r.items()} for r in rows}
            vocab = {r["token"]: r["idx"] for r in statistics.vocabulary(df).orderBy("idx").toLocalIterator()}
            for key, section, where, zipped in (("conversations", conversations, c.get("conversationsPath"), c.get("gZipConversations", True)), ("vocabulary", vocab, c.get("vocabPath"), c.get("gZipVocabulary", True))):
                if where:
                    writers.write_text(json.dumps(section, ensure_ascii=False, indent=indent), x.at(where), bool(zipped))
                else:
                    out[key] = section
            writers.write_text(json.dumps(out, ensure_ascii=False, indent=indent), path)
        finally:
            stats.unpersist()
        return df

    return run


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(r.capitalize() for r in rest)


def _snake(name: str) -> str:
    return "".join("_" + ch.lower() if ch.isupper() else ch for ch in name)


def read_stats(spark: SparkSession, path: str, beside: str | None = None) -> DataFrame:
    """conversation_stats' rows from a statistics file: plain or gzip, the conversations inside or in a file beside it."""
    def load(p: str):
        with open(p, "rb") as f:
            data = f.read()
        return json.loads(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)

    found = load(path)
    section = found.get("conversations")
    if section is None:
        for p in (beside, *(os.path.join(os.path.dirname(path), n) for n in ("conversations.json.gz", "conversations.json"))):
            if p and os.path.exists(p):
                section = load(p)
                break
        else:
            raise FileNotFoundError(f"{path} has no conversations, nor has a file beside it")
    names = ["messages_count"] + [f"{m}_{k}" for m in ("len", "words", "tokens") for k in ("total", "mean", "std_dev", "min", "max", "median", "range")]
    kinds = {"messages_count": "long"} | {n: "double" if n.endswith(("mean", "std_dev", "median")) else "long" for n in names if n != "messages_count"}
    rows = []
    for i, r in section.items():
        r = {_snake(k): v for k, v in r.items()}
        rows.append((int(i), *((float if kinds[n] == "double" else int)(r.get(n) or 0) for n in names)))
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} {kinds[n]}" for n in names))


def _prune(c, x):
    where = c.get("statsPath") or c.get("packedStatsPath")
    if not where and not c.get("inPlan", False):
        raise ValueError("StatsConversationPrune: statsPath or packedStatsPath is required")

    def run(df):
        path = x.at(where) if where else None
        if path and os.path.isdir(os.path.join(path, "conversations")):  # tables
            return prune(df, x.spark.read.parquet(f"file://{path}/conversations"))
        if path and os.path.isdir(path):
            path = os.path.join(path, "stats.json")
        return prune(df, read_stats(x.spark, path) if path else None)

    def prune(df, stats):
        return statistics.stats_prune(df, stats, c.get("wordsStdDevRatioMin"), c.get("wordsStdDevRatioMax"), c.get("wordsClampMin"), c.get("wordsClampMax"), c.get("messagesCountMin"), c.get("messagesCountMax"), c.get("center"))

    return run


def _worked(df: DataFrame, task) -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema

    def work(batches):
        arrow = None
        for b in batches:
            arrow = arrow or b.schema
            yield pa.RecordBatch.from_pylist(task(b.to_pylist(maps_as_pydicts="lossy")), schema=arrow)

    return df.mapInArrow(work, kind)


DEFAULTS: dict[str, Builder] = {
    "Participants": _participants, "HtmlStrip": _html, "RenameParticipants": _rename, "Encoding": _encoding, "Trim": lambda c, x: text.trim, "RegexReplace": _regex_replace,
    "RegexExtract": _regex_extract, "CsvInput": _csv_input, "CsvOutput": _csv_output, "ExactReplace": _exact_replace, "FullMatch": _full_match, "FastChatInput": _chat_input,
    "FastChatOutput": _chat_output, "FileConcatenate": _concatenate, "RawOutput": _raw_output, "NativeOutput": _native_output, "StatsCountOccurrences": _occurrences,
    "StatsAddColMerge": _merge, "StatsOutput": _stats_output, "StatsConversationPrune": _prune, "RawSampleOutput": _sample_output,
}


class Registry:
    """Builders by name: the default ones, unless told otherwise, and those registered."""

    def __init__(self, with_defaults: bool = True) -> None:
        self._builders = dict(DEFAULTS) if with_defaults else {}

    def register(self, name: str, builder: Builder) -> None:
        self._builders[name] = builder

    def register_task(self, name: str, task: Callable[[dict, list[dict]], list[dict]]) -> None:
        """A step type by a function (config, conversations) -> conversations of plain dicts, which the executors call with a batch at a time."""
        self._builders[name] = lambda config, x: lambda df: _worked(df, lambda rows: task(config, rows))

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def __getitem__(self, name: str) -> Builder:
        return self._builders[name]

    def names(self) -> list[str]:
        return sorted(self._builders)
