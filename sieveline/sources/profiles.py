"""Rules of a profile from a dict, JSON or YAML, events and their sinks, and what the catalogue holds."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import CATEGORIES, FAMILIES, FAMILY, SENSITIVITY
from ..patterns import Pattern, content_patterns, profile_rules

Rule = tuple[str, str, str, float, tuple[str, ...], tuple[str, ...]]


def profile_from_dict(data: Mapping, name: str = "standard") -> tuple[Rule, ...]:
    """Rules in order: {"profiles": {name: {"rules": [{entity_type, category, sensitivity, confidence, regulatory, patterns}]}}}."""
    try:
        rules = data["profiles"][name]["rules"]
    except KeyError as e:
        raise ValueError(f"no profile {name!r}; there are {sorted(data.get('profiles', {}))}") from e
    out = []
    for r in rules:
        if r["sensitivity"] not in SENSITIVITY:
            raise ValueError(f"unknown sensitivity {r['sensitivity']!r}")
        out.append((r["entity_type"], r["category"], r["sensitivity"], float(r["confidence"]), tuple(r.get("regulatory", ())), tuple(r["patterns"])))
    return tuple(out)


def load_profile(path: str, name: str = "standard") -> tuple[Rule, ...]:
    """From a JSON file, or a YAML one where a YAML parser is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return profile_from_dict(yaml.safe_load(text), name)
    return profile_from_dict(json.loads(text), name)


def standard_profile() -> tuple[Rule, ...]:
    return profile_rules()


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CATEGORIES], "category string")


def entity_types(spark: SparkSession) -> DataFrame:
    rows = {(p.entity_type, p.category, p.sensitivity) for p in content_patterns()} | {r[:3] for r in profile_rules()}
    return spark.createDataFrame(sorted((e, c, s, FAMILY.get(e, e)) for e, c, s in rows), "entity_type string, category string, sensitivity string, family string")


def pattern_table(spark: SparkSession, patterns: tuple[Pattern, ...] | None = None) -> DataFrame:
    rows = [(p.name, p.entity_type, p.category, p.sensitivity, p.confidence, p.validator, list(p.hints), p.regex) for p in (patterns or content_patterns())]
    return spark.createDataFrame(rows, "name string, entity_type string, category string, sensitivity string, confidence double, validator string, hints array<string>, regex string")


def families() -> tuple[str, ...]:
    return FAMILIES


class Emitter:
    """Gives events to handlers; one that fails does not keep an event from the others."""

    def __init__(self, *handlers: Callable[[dict], None]):
        self.handlers = list(handlers)

    def add(self, handler: Callable[[dict], None]) -> None:
        self.handlers.append(handler)

    def emit(self, event: dict) -> None:
        for h in self.handlers:
            try:
                h(event)
            except Exception:  # noqa: BLE001
                logging.getLogger(__name__).exception("event handler failed")

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: the (few) events of a micro-batch, row by row."""
        for r in df.toLocalIterator():
            self.emit(r.asDict(recursive=True) | {"batch_id": batch_id})


def to_stdout(event: dict) -> None:
    print(json.dumps(event, default=str))


def to_log(event: dict) -> None:
    logging.getLogger("sieveline.events").info(json.dumps(event, default=str))


def to_nothing(event: dict) -> None:
    """Drops the event."""
