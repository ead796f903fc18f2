"""What several operators share: worker memos, spread row numbers, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import bound_batches

#: A run of the white space that the text contracts name, as a regular expression.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


_MEMO: dict = {"owner": None, "memo": {}}


def worker_memo(owner: str) -> dict:
    """What a Python worker remembers between tasks. Workers outlive operators, so only one owner's memo is kept at a time."""
    if _MEMO["owner"] != owner:
        _MEMO["memo"].clear()
        _MEMO.update(owner=owner, memo={})
    return _MEMO["memo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest(column: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a string column."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def hash_words(seed: str, *columns: Column) -> Column:
    """52 bits of an MD5 over the columns as a bigint; the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), *columns)), 1, 13), 16, 10).cast("bigint")


def slices(rows: int, per_slice: int = 20_000) -> int:
    """Into how many slices a group that may hold all rows is cut; grows with the rows."""
    return max(1, -(-rows // per_slice))


def spread_row_number(df: DataFrame, group: list[str], slice_col: str, order: list[Column], name: str, value: Column | None = None) -> DataFrame:
    """Row number from 0 (or the sum of ``value`` over earlier rows) within each group, without bringing a group together.

    ``slice_col`` holds a slice number that rises with the order wanted. Rows are numbered within
    (group, slice); the sizes of the earlier slices, a table of groups x slices, are added. The group
    and slice columns must not be null.
    """
    value = F.lit(1).cast("bigint") if value is None else value
    counts = df.groupBy(*group, slice_col).agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, slice_col, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
    joined = numbered.join(counts, [*group, slice_col], "left")
    return joined.withColumn(name, F.col(name) + F.col("__base")).drop("__base")
