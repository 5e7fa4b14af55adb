"""Runs a descriptor: requirements, passes, artifacts. Passes communicate through files."""

from __future__ import annotations

import glob
import hashlib
import logging
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..sources.readers import empty, fetch
from .descriptor import Descriptor, Pass, Step, parse
from .registry import Context, Registry

log = logging.getLogger("parley")
_SOURCES = {"CsvInput", "FastChatInput"}
_TEES = {"CsvOutput", "FastChatOutput", "RawOutput", "NativeOutput", "RegexExtract", "RawSampleOutput", "StatsOutput", "StatsCountOccurrences"}


class HashMismatch(ValueError):
    """A required file isn't the one that was meant."""

    def __init__(self, path: str, expected: str, actual: str) -> None:
        super().__init__(f"{path}: expected {expected}, found {actual}")
        self.path, self.expected, self.actual = path, expected, actual


@dataclass
class Progress:
    """Counters of a build."""

    conversations_total: int = 0
    messages_total: int = 0
    conversations_processed: int = 0
    messages_processed: int = 0
    passes_total: int = 0
    passes_complete: int = 0
    seconds: float = 0.0

    @property
    def conversations_dropped(self) -> int:
        return self.conversations_total - self.conversations_processed

    @property
    def messages_dropped(self) -> int:
        return self.messages_total - self.messages_processed

    def to_dict(self) -> dict:
        return asdict(self) | {"conversations_dropped": self.conversations_dropped, "messages_dropped": self.messages_dropped}


@dataclass
class Result:
    progress: Progress
    hashes: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def sha512(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha512").hexdigest()


def logged(event: str, progress: Progress) -> None:
    """The listener that an engine has unless it is given one."""
    log.info("%s after %.1f s: %s", event, progress.seconds, progress.to_dict())


class Engine:
    def __init__(self, spark: SparkSession, descriptor: Descriptor | dict | str, base: str = ".", registry: Registry | None = None, listener: Callable[[str, Progress], None] | None = None) -> None:
        """listener: told (event, progress) when the build, a pass or a step begins, a source has been read, a pass and the build are done; by default these are logged."""
        self.spark = spark
        self.descriptor = descriptor if isinstance(descriptor, Descriptor) else parse(descriptor)
        self.base, self.registry = base, registry or Registry()
        self.progress = Progress(passes_total=len(self.descriptor.passes))
        self.listener, self.began = listener or logged, time.monotonic()

    def tell(self, event: str) -> None:
        self.progress.seconds = time.monotonic() - self.began
        self.listener(event, self.progress)

    def verify(self) -> list[str]:
        """What is wrong with the descriptor, in words; nothing if all is well."""
        wrong = []
        for k, p in enumerate(self.descriptor.passes):
            for n, s in enumerate(p.steps):
                if s.type not in self.registry:
                    wrong.append(f"pass {k}, step {n}: no step type {s.type!r}")
                    continue
                try:
                    self.registry[s.type](s.config, Context(self.spark, self.base))
                except (ValueError, KeyError, TypeError) as e:
                    wrong.append(f"pass {k}, step {n} ({s.type}): {e}")
        return wrong

    def clean(self) -> list[str]:
        """Deletes what the globs of cleanDirectory name, none of them above the base; returns the files."""
        gone = []
        for g in self.descriptor.build.clean_directory:
            if ".." in g.split("/") or os.path.isabs(g):
                raise ValueError(f"cleanDirectory may not leave the folder: {g}")
            for f in sorted(glob.glob(os.path.join(self.base, g))):
                if os.path.isfile(f):
                    os.remove(f)
                    gone.append(f)
        return gone

    def fetch_requirements(self) -> list[str]:
        """Downloads requirements that have a source and aren't there."""
        x = Context(self.spark, self.base)
        return [fetch(r.source, x.at(r.path)) for p in self.descriptor.passes for r in p.required if r.source and not os.path.exists(x.at(r.path))]

    def check_requirements(self, p: Pass) -> dict[str, str]:
        x, found = Context(self.spark, self.base), {}
        for r in p.required:
            path = x.at(r.path)
            if not os.path.exists(path):
                if r.optional:
                    log.warning("%s isn't there", r.path)
                    continue
                raise FileNotFoundError(path)
            if r.sha512 or self.descriptor.build.verify_requirements or self.descriptor.build.generate_hashes:
                found[r.path] = sha512(path)
                if r.sha512 and r.sha512.lower() != found[r.path]:
                    raise HashMismatch(r.path, r.sha512, found[r.path])
        return found

    def context(self, steps: list[Step]) -> Context:
        """A context with the files that steps pack."""
        x = Context(self.spark, self.base)
        for name in (n for s in steps for n in s.pack):
            if os.path.exists(x.at(name)):
                with open(x.at(name), "rb") as f:
                    x.packed[name] = f.read()
            else:
                log.info("side input %s isn't there", name)
        return x

    def build_pipeline(self, steps: list[Step], initial: DataFrame | None = None, context: Context | None = None, keep: list | None = None) -> DataFrame:
        """The steps applied in order to initial (or to nothing, before the first source). Sinks among them write at once.

        What feeds a sink and more is kept (memory, then disk) while the pass runs; frames kept are put in keep.
        """
        x = context or self.context(steps)
        df = initial
        for k, s in enumerate(steps):
            f = self.registry[s.type](s.config, x)
            self.tell(f"step {s.type}")
            if s.type not in _SOURCES and df is None:
                df = empty(self.spark)
            if s.type in _TEES and k + 1 < len(steps) and keep is not None and not df.is_cached:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                keep.append(df)
            df = f(df)
        return empty(self.spark) if df is None else df

    def run_pass(self, p: Pass) -> None:
        x, keep = self.context(p.steps), []
        at = max((i for i, s in enumerate(p.steps) if s.type in _SOURCES), default=-1) + 1
        source = self.build_pipeline(p.steps[:at], None, x, keep) if at else None
        seen, out = Observation(), Observation()
        count = lambda: (F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("messages"))
        if source is not None:
            source = source.persist(StorageLevel.MEMORY_AND_DISK)
            keep.append(source)
            source.observe(seen, *count()).write.format("noop").mode("overwrite").save()
            self.progress.conversations_total += seen.get["conversations"]
            self.progress.messages_total += seen.get["messages"]
            self.tell("source read")
        df = self.build_pipeline(p.steps[at:], source, x, keep)
        df.observe(out, *count()).write.format("noop").mode("overwrite").save()  # drains what no sink has
        self.progress.conversations_processed += out.get["conversations"]
        self.progress.messages_processed += out.get["messages"]
        for finish in x.finishers:
            finish()
        for d in keep:
            d.unpersist()
        self.progress.passes_complete += 1
        self.tell("pass done")

    def check_artifacts(self) -> tuple[dict[str, str], list[str]]:
        x, hashes, warnings = Context(self.spark, self.base), {}, []
        for p in self.descriptor.passes:
            for a in p.artifacts:
                path = x.at(a.file)
                if not os.path.exists(path):
                    warnings.append(f"artifact {a.file} isn't there")
                    continue
                hashes[a.file] = sha512(path)
                if self.descriptor.build.verify_artifacts and a.sha512 and a.sha512.lower() != hashes[a.file]:
                    warnings.append(f"artifact {a.file}: expected {a.sha512}, found {hashes[a.file]}")
        for w in warnings:
            log.warning(w)
        return hashes, warnings

    def run(self) -> Result:
        self.began = time.monotonic()
        self.tell("build begins")
        if wrong := self.verify():
            raise ValueError("; ".join(wrong))
        self.clean()
        self.fetch_requirements()
        hashes: dict[str, str] = {}
        for p in self.descriptor.passes:
            hashes |= self.check_requirements(p)
            self.tell("pass begins")
            self.run_pass(p)
        made, warnings = self.check_artifacts()
        self.tell("build done")
        return Result(self.progress, hashes | made if self.descriptor.build.generate_hashes else {}, warnings)
