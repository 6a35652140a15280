"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the exact-copy and shingle rules: a blank and \\x09 to \\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker process: read-only
    resources and bounded caches survive from task to task."""
    name = "riskframe_llm_process_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def whole_text(column: str = "text"):
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))
