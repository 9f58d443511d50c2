"""Scenarios on disk and the settings of a run."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .sources import copy_blocks
from .sources.ddl import parse_ddl
from .sources.qpair import QueryPair, parse_qpair

#: A scenario's files: the dump, the ontology (the first that is there), the query pairs.
DUMP, ONTOLOGIES, PAIRS = "dump.sql", ("ontology.ttl", "ontology.owl", "ontology.rdf"), "queries"


@dataclass
class Settings:
    """Settings of a run; text values may name environment variables as ${NAME}."""

    scenario: str = "mini"
    sample_fraction: float = 1.0
    seed: str = "sample-v1"
    top_k: int = 16
    method: str = "bm25"
    existence: str = "primary_key_positional"
    max_request: int = 500

    @classmethod
    def of(cls, given: dict) -> Settings:
        known = {f.name: f.type for f in fields(cls)}
        if unknown := set(given) - set(known):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        def cast(name, value):
            if isinstance(value, str):
                value = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
            return {"float": float, "int": int}.get(known[name], str)(value)

        return cls(**{k: cast(k, v) for k, v in given.items()})


def expanded(value):
    """A setting with environment variables put in, in lists and maps as well; unknown ones stay as they are."""
    if isinstance(value, str):
        return os.path.expandvars(value)
    if isinstance(value, list):
        return [expanded(v) for v in value]
    return {k: expanded(v) for k, v in value.items()} if isinstance(value, dict) else value


def read_config(path: str | Path) -> dict:
    """A run's settings from a YAML file (JSON is YAML too); an empty file has none."""
    try:
        import yaml
    except ImportError:  # JSON alone, where no YAML reader is installed
        import json

        return expanded(json.loads(Path(path).read_text(encoding="utf-8") or "{}"))
    return expanded(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


#: Settings that take a value, and those that are on or off, by the command's flag.
VALUE_FLAGS = {"scenario": "--scenario", "work": "--work", "top_k": "--top-k", "sample_fraction": "--fraction", "seed": "--seed"}
SWITCHES = {"reports": "--reports"}


def arguments(config: dict, command: str = "run", scenario: str | None = None, extra: tuple[str, ...] = ()) -> list[list[str]]:
    """The command lines of a configuration: one for each of its scenarios, or for the one that is named."""
    named = scenario or config.get("scenarios") or config.get("scenario") or []
    out = []
    for one in named.split(",") if isinstance(named, str) else named:
        held = {**config, "scenario": str(Path(config.get("root", "")) / one), "work": str(Path(config.get("work", "out")) / one)}
        argv = [command]
        for key, flag in VALUE_FLAGS.items():
            if held.get(key) not in (None, ""):
                argv += [flag, str(held[key])]
        out.append([*argv, *[flag for key, flag in SWITCHES.items() if held.get(key)], *extra])
    return out


def ontology_file(folder: str | Path) -> Path | None:
    return next((Path(folder) / n for n in ONTOLOGIES if (Path(folder) / n).is_file()), None)


def discover(root: str | Path, prefix: str = "") -> list[str]:
    """Names of the folders below ``root`` that hold a dump."""
    return sorted(p.name for p in Path(root).iterdir() if p.name.startswith(prefix) and (p / DUMP).is_file())


@dataclass
class Scenario:
    name: str
    catalog: Catalog
    frames: dict[str, DataFrame]
    pairs: list[QueryPair]
    ontology: Path | None


def load(spark: SparkSession, folder: str | Path) -> Scenario:
    """A scenario's catalog, tables and enabled query pairs; an error names what is missing."""
    folder = Path(folder)
    if not (folder / DUMP).is_file():
        raise FileNotFoundError(f"{folder} has no {DUMP}")
    catalog = parse_ddl((folder / DUMP).read_text(encoding="utf-8"))
    frames = copy_blocks.frames(copy_blocks.read_copy(spark, str(folder / DUMP)), catalog)
    pairs = [parse_qpair(p.read_text(encoding="utf-8")) for p in sorted((folder / PAIRS).glob("*.qpair"))] if (folder / PAIRS).is_dir() else []
    return Scenario(folder.name, catalog, frames, [p for p in pairs if not p.disabled], ontology_file(folder))
