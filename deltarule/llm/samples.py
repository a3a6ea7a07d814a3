"""Bounded training samples, taken by the hash of an id so that reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each label (never above 1.5 times that): those with the smallest hash.

    One count per label sets a threshold on the hash, so no label is sorted or gathered.
    Labels are few by nature; their counts are all that reaches the driver.
    """
    counts = {x[label]: x["count"] for x in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    limit = F.lit(None).cast("long")
    for value, count in sorted(counts.items()):
        limit = F.when(F.col(label) == F.lit(value), F.lit(int((1 << 30) * min(1.0, most / count)))).otherwise(limit)
    return rows.filter(draw < limit).limit(int(1.5 * most * max(1, len(counts))))
