"""Even tasks and few files for a write by units, such as (day, user bucket).

The rows of each unit are counted first. Small units share a task whole, so that each of them becomes one file; a unit
larger than an even share is cut into as many pieces as shares it fills. Rows go straight to the task that the plan names.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

#: Units whose sizes the driver plans; a calendar of a century with 40 buckets has 1.5 million.
MAX_UNITS = 2_000_000
#: The column that names a row's task.
TASK = "__task"


def planned(sizes: Mapping[Hashable, int], n_tasks: int) -> dict[Hashable, list[int]]:
    """The tasks of every unit: largest pieces first, each to the task with the fewest rows so far."""
    total = sum(sizes.values())
    share = max(1, -(-total // n_tasks))
    pieces = []
    for unit, rows in sizes.items():
        n = max(1, -(-rows // share))
        pieces += [(rows / n, unit)] * n
    pieces.sort(key=lambda p: (-p[0], repr(p[1])))
    loads = [(0.0, task) for task in range(n_tasks)]
    tasks: dict[Hashable, list[int]] = {}
    for rows, unit in pieces:
        load, task = heapq.heappop(loads)
        tasks.setdefault(unit, []).append(task)
        heapq.heappush(loads, (load + rows, task))
    return tasks


def unit_sizes(df: DataFrame, by: tuple[str, ...]) -> dict[tuple, int]:
    """Rows of each unit; only as many numbers as there are units reach the driver."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")).limit(MAX_UNITS + 1).collect()
    if len(counts) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units of {by}")
    return {tuple(r[c] for c in by): r["__rows"] for r in counts}


def packed(df: DataFrame, by: tuple[str, ...], n_tasks: int, row_id: str = "id", sizes: Mapping[tuple, int] | None = None) -> DataFrame:
    """``df`` with the column ``TASK``, each row in the partition of that number.

    Counting reads ``by`` alone: give a stored frame, or the sizes if they are known. Rows of one ``row_id`` and unit stay
    together. Units are at most ``MAX_UNITS`` rows, which are broadcast.
    """
    tasks = planned(unit_sizes(df, by) if sizes is None else sizes, n_tasks)
    keys = [T.StructField(f"__by{n}", df.schema[c].dataType) for n, c in enumerate(by)]
    schema = T.StructType([*keys, T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
    plan = df.sparkSession.createDataFrame([(*unit, where) for unit, where in tasks.items()], schema)
    same = [F.col(c).eqNullSafe(F.col(f"__by{n}")) for n, c in enumerate(by)]
    # Left: a row that came after the counting still has a task.
    joined = df.join(F.broadcast(plan), same, "left")
    piece = F.get("__tasks", F.pmod(F.xxhash64(row_id), F.size("__tasks")).cast("int"))
    placed = joined.withColumn(TASK, F.coalesce(piece, F.lit(0))).drop("__tasks", *[k.name for k in keys])
    return placed.repartitionById(n_tasks, F.col(TASK))
