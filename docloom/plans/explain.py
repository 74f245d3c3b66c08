"""What Spark plans for a DataFrame, as a small dict: pushed filters, pruning, exchanges, estimated bytes."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _option(metadata: Any, key: str) -> str:
    found = metadata.get(key)
    return found.get() if found.isDefined() else ""


def scans(df: DataFrame) -> list[dict[str, str]]:
    """Pushed filters, partition filters and columns of each file scan."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "FileSourceScanExec":
            m = leaf.metadata()
            out.append({"pushed": _option(m, "PushedFilters"), "partitions": _option(m, "PartitionFilters"), "columns": _option(m, "ReadSchema")})
    return out


def explain(df: DataFrame, indexes: list[str] = (), names: dict[str, str] | None = None) -> dict[str, Any]:
    """``names`` maps the beginnings of column names to the indexed fields that they hold."""
    found = scans(df)
    pushed = " ".join(s["pushed"] for s in found)
    used = [field for name, field in (names or {}).items() if re.search(rf"\b{name}_", pushed)]
    if re.search(r"[(]_id,", pushed):
        used.insert(0, "_id")
    physical = df._jdf.queryExecution().executedPlan().toString()
    return {
        "strategy": "pruned scan" if used else "scan",
        "index_field": used[0] if used else None,
        "indexes": list(indexes),
        "scans": found,
        "exchanges": re.findall(r"Exchange \w+", physical),
        "estimated_bytes": estimated_bytes(df),
        "physical": physical,
    }
