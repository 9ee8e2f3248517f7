"""Claim identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def claim_signature(qualifiers: Column | None = None) -> Column:
    """SHA-256 over source, relation, target, polarity and the sorted qualifiers; the value of a valued claim takes no part.

    qualifiers: array<struct<type, unit, value>>; each is written as canonical JSON with a space after colon and comma.
    """
    if qualifiers is None:
        text = F.lit("[]")
    else:
        quote = lambda c: F.when(c.isNull(), "null").otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
        one = lambda q: F.concat(F.lit('{"type": '), quote(q["type"]), F.lit(', "unit": '), quote(q["unit"]), F.lit(', "value": '), quote(q["value"]), F.lit("}"))
        text = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(F.coalesce(qualifiers, F.array()), one)), ", "), F.lit("]"))
    parts = [F.col("source"), F.col("relation"), F.coalesce("target", F.lit("None")), F.coalesce("polarity", F.lit("positive")), text]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", *parts), 256))
