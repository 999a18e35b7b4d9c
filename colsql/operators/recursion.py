"""Recursive UNION: a fixpoint of distinct rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import SqlError
from ..sources.intermediate import written

ROUNDS, ROWS = 10_000, 1_000_000


def union_fixpoint(spark: SparkSession, base: str, names: list[str], step: Callable[[str], str], rounds: int = ROUNDS, rows: int = ROWS) -> str:
    """The name of a view with the rows of base and of all steps, each once. Every round sees only the rows that are new; all
    are written to the shared folder, so neither plans nor memory grow with the number of rounds."""
    view = f"__r{uuid.uuid4().hex[:12]}"
    new = written(spark.sql(base).toDF(*names).distinct())
    seen: list[DataFrame] = [new]
    total = new.count()
    for _ in range(rounds):
        new.createOrReplaceTempView(view)
        found = spark.sql(step(view)).toDF(*names).distinct()
        known = seen[0]
        for s in seen[1:]:
            known = known.union(s)
        new = written(found.subtract(known))
        n = new.count()
        if not n:
            break
        total += n
        if total > rows:
            raise SqlError(f"A recursive query has more than {rows} rows")
        seen.append(new)
        if len(seen) > 16:
            merged = seen[0]
            for s in seen[1:]:
                merged = merged.union(s)
            seen = [written(merged)]
    else:
        raise SqlError(f"A recursive query takes more than {rounds} rounds")
    out = seen[0]
    for s in seen[1:]:
        out = out.union(s)
    out.createOrReplaceTempView(view)
    return view
