"""All queries of the engine by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("text", "retrieval", "registry", "timeline", "stateful", "rules", "pages", "passages", "sources", "records", "binaries", "answers", "artifacts")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in FAMILIES:
    _family = importlib.import_module(f".{_name}", __package__)
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans projected onto dates for every customer."""
    return QUERIES["timeline_projection"](spark, sf_dir)
