"""All rules together, over tables that are each scanned once.

Checks of single rows are compiled into one array of violations a table (quality.row_violations). The other rules, which group or join, read the stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import quality, records
from weftgraph.runtime import stored
from weftgraph.schema import KnowledgeSet

def validate(kg: KnowledgeSet, only: list[str] | None = None, drafted: tuple[DataFrame, DataFrame] | None = None, recorded: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """(rule, severity, focus, message): violations of all rules, or of those in `only`.

    drafted: entities and connections that wait to be staged, for dq_candidate; recorded(name, n): counts as written down, for
    dq_live_counts; registry: a relation registry to be checked in place of the one in use.
    """
    asked = lambda name: only is None or name in only
    kg = kg.with_(entities=stored(kg.entities), connections=stored(kg.connections))
    parts = [quality.row_violations(kg, [c for c in quality.CHECKS if asked(c.rule)])]
    checked = {"dq_registry_coherence": kg if registry is None else kg.with_(relations=registry)}
    parts += [f(checked.get(name, kg)) for name, f in quality.JOINED.items() if asked(name)]
    if drafted is not None and asked("dq_candidate"):
        parts.append(records.dq_candidate(kg, *drafted))
    if recorded is not None and asked("dq_live_counts"):
        parts.append(records.dq_live_counts(kg, recorded))
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no such rule")
    return out


def severity_counts(kg: KnowledgeSet, **extra) -> DataFrame:
    return validate(kg, **extra).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def conforms(kg: KnowledgeSet, **extra) -> DataFrame:
    n = validate(kg, **extra).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.withColumn("conforms", F.col("errors") == 0)
