"""Fan-in of candidate sources (SRC10, SRC11, SET1, LIM2, AGG8, AGG10, INC7)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CANDIDATE_COLUMNS

#: Room for rows of a source in the ordinal.
STRIDE = 1 << 40


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """SET1: all rows with an ordinal that follows the order of sources, then ``pos`` within a source."""
    parts = [s.select(*CANDIDATE_COLUMNS, (F.lit(i * STRIDE) + F.col("pos")).alias("ordinal")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def limit_per(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """LIM2: the first n rows of each group; Spark keeps n rows a group and task before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


@dataclass
class Fetched:
    name: str
    rows: DataFrame | None
    failed: bool


def guarded(name: str, read: Callable[[], DataFrame], expected: Callable[[Exception], bool] = lambda e: isinstance(e, OSError)) -> Fetched:
    """SRC11: a source that fails with an expected error gives no rows and says so; other errors go on."""
    try:
        return Fetched(name, read(), False)
    except Exception as e:
        if not expected(e):
            raise
        return Fetched(name, None, True)


def all_failed(sources: list[Fetched]) -> bool:
    """AGG10: there are sources, and every one failed."""
    return bool(sources) and all(s.failed for s in sources)
