"""Vocabularies and source lists, as YAML; small, and read whole."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import SparkSession

from bidstream.operators.capabilities import Capability


class _Strict(yaml.SafeLoader):
    """Repeated keys are errors, where YAML would take the last."""


def _mapping(loader: _Strict, node: yaml.MappingNode, deep: bool = False) -> dict:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if len(keys) != len(set(keys)):
        raise ValueError(f"repeated keys: {sorted(k for k in set(keys) if keys.count(k) > 1)}")
    return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def parsed(text: str) -> Any:
    return yaml.load(text, _Strict)


def read(spark: SparkSession, path: str) -> Any:
    """A YAML file from wherever Spark can read."""
    return parsed(spark.read.text(path, wholetext=True).first()[0])


def capabilities(config: dict) -> list[Capability]:
    """Of {capabilities: {name: {family, explicit, needs, contextual, context}}}; phrases in lower case, each once."""
    out = []
    for name, c in config["capabilities"].items():
        lists = {k: tuple(dict.fromkeys(p.lower() for p in c.get(k, ()))) for k in ("explicit", "needs", "contextual", "context")}
        if not any(lists[k] for k in ("explicit", "needs", "contextual")):
            raise ValueError(f"{name} has no phrases")
        out.append(Capability(name, c["family"], **lists))
    return out
