"""The YAML descriptor as dataclasses, checked before anything runs."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import yaml

log = logging.getLogger("parley")
SYNC = ("auto", "main", "local", "remote")


class DescriptorError(ValueError):
    pass


@dataclass
class Step:
    type: str
    config: dict = field(default_factory=dict)
    description: str = ""
    sync: str = "local"
    pack: list[str] = field(default_factory=list)


@dataclass
class Requirement:
    path: str
    source: str | None = None
    sha512: str | None = None
    optional: bool = False


@dataclass
class Artifact:
    file: str
    sha512: str | None = None


@dataclass
class Pass:
    steps: list[Step]
    required: list[Requirement] = field(default_factory=list)
    artifacts: list[Artifact] = field(default_factory=list)


@dataclass
class Build:
    generate_hashes: bool = True
    verify_requirements: bool = False
    verify_artifacts: bool = True
    conversation_batch: int = 100
    send_packed_files: bool = False
    clean_directory: list[str] = field(default_factory=list)
    concurrency: dict = field(default_factory=dict)


@dataclass
class Descriptor:
    passes: list[Pass]
    build: Build = field(default_factory=Build)
    name: str = "default"
    description: str = ""


def _need(m, key: str, where: str):
    if not isinstance(m, dict) or m.get(key) is None:
        raise DescriptorError(f"{where}: {key} is missing")
    return m[key]


def parse(source: str | dict) -> Descriptor:
    """A descriptor from YAML text or what it parses to."""
    d = yaml.safe_load(source) if isinstance(source, str) else source
    b = _need(d, "build", "descriptor")
    build = Build(
        bool(b.get("generateHashes", True)), bool(b.get("verifyRequirements", False)), bool(b.get("verifyArtifacts", b.get("verifyHashes", True))), int(b.get("conversationBatch", 100)),
        bool(b.get("sendPackedFiles", False)), list(b.get("cleanDirectory") or []), dict(b.get("concurrency") or {}),
    )
    if build.concurrency:
        log.debug("concurrency is left to Spark: %s", build.concurrency)
    passes = []
    for k, p in enumerate(_need(d, "passes", "descriptor")):
        where = f"pass {k}"
        steps = []
        for n, s in enumerate(_need(p, "steps", where)):
            sync = str(s.get("sync", "local"))
            if sync not in SYNC:
                log.debug("%s, step %d: group %s, run like any other", where, n, sync)
            steps.append(Step(str(_need(s, "type", f"{where}, step {n}")), dict(s.get("config") or {}), str(s.get("description") or ""), sync, [str(x) for x in s.get("pack") or []]))
        required = [Requirement(str(_need(r, "path", where)), r.get("source"), r.get("sha512"), bool(r.get("optional", False))) for r in (p.get("required") or [])]
        if "required" not in p:
            raise DescriptorError(f"{where}: required is missing")
        artifacts = [Artifact(str(_need(a, "file", where)), a.get("sha512")) for a in (p.get("artifacts") or [])]
        passes.append(Pass(steps, required, artifacts))
    return Descriptor(passes, build, str(d.get("name", "default")), str(d.get("description", "") or ""))


def with_hashes(source: str, hashes: dict[str, str]) -> str:
    """The YAML text of a descriptor with the sha512 of each required file and artifact that hashes has; everything else as it is."""
    d = yaml.safe_load(source)
    for p in d.get("passes") or []:
        for key, entries in (("path", p.get("required")), ("file", p.get("artifacts"))):
            for e in entries or []:
                if (found := hashes.get(str(e.get(key)))) is not None:
                    e["sha512"] = found
    return yaml.safe_dump(d, sort_keys=False, allow_unicode=True)
