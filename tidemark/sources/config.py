"""Configuration: the taxonomy, run settings and the generated dataset file."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Taxonomy:
    """Classes by id, groups of ids, domains of datasets and mappings of native names."""

    classes: dict[int, str]
    groups: dict[str, list[int]] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    mappings: dict[str, dict[str, str | None]] = field(default_factory=dict)
    dedup: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Taxonomy:
        with open(path, encoding="utf-8") as file:
            raw = yaml.safe_load(file) or {}
        return cls(
            {int(k): v for k, v in (raw.get("classes") or {}).items()},
            {k: list(v) for k, v in (raw.get("groups") or {}).items()},
            raw.get("domains") or {},
            raw.get("mappings") or {},
            {"method": "greedy", "threshold": 3} | (raw.get("dedup") or {}),
        )

    def names(self) -> list[str]:
        return [self.classes[k] for k in sorted(self.classes)]

    def military(self) -> list[int]:
        return sorted(self.groups.get("military", []))

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The taxonomy as small tables named classes, groups, domains and mappings."""
        return {
            "classes": spark.createDataFrame(sorted(self.classes.items()), "class_id int, name string"),
            "groups": spark.createDataFrame([(g, i) for g, ids in self.groups.items() for i in ids], "group string, class_id int"),
            "domains": spark.createDataFrame(list(self.domains.items()), "dataset string, domain string"),
            "mappings": spark.createDataFrame([(d, n, t) for d, m in self.mappings.items() for n, t in (m or {}).items()], "dataset string, native string, target string"),
        }


def source_names(path: str) -> list[str]:
    """The class names of a source's dataset file, given as a list or by number."""
    with open(path, encoding="utf-8") as file:
        names = (yaml.safe_load(file) or {}).get("names")
    if not names:
        raise ValueError(f"{path} has no names")
    return ordered(names)


def ordered(names: list[str] | dict[Any, str]) -> list[str]:
    """Names in the order of their ids."""
    return list(names) if isinstance(names, list) else [names[k] for k in sorted(names, key=int)]


def drift(taxonomy: Taxonomy, names: list[str] | dict[Any, str]) -> list[str]:
    """What differs, class by class, between the taxonomy and a dataset file's names."""
    have, want = ordered(names), taxonomy.names()
    out = [f"{len(have)} names for {len(want)} classes"] if len(have) != len(want) else []
    return out + [f"class {k}: {a!r} instead of {b!r}" for k, (a, b) in enumerate(zip(have, want, strict=False)) if a != b]


def dataset_file(taxonomy: Taxonomy, root: str) -> str:
    """The text of the dataset file that a trainer reads; paths with forward slashes."""
    body = {"path": root.replace("\\", "/"), **{s: f"images/{s}" for s in ("train", "val", "test")}, "nc": len(taxonomy.classes), "names": dict(enumerate(taxonomy.names()))}
    return yaml.safe_dump(body, sort_keys=False, allow_unicode=True)


def override(settings: dict[str, Any], pairs: list[str]) -> dict[str, Any]:
    """Settings with ``key=value`` pairs applied, values read as YAML."""
    out = dict(settings)
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign or not key:
            raise ValueError(f"{pair!r} is not key=value")
        out[key] = yaml.safe_load(value)
    return out
