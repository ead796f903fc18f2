"""Mixing sources to target weights (operator 9) [native]: Efraimidis-Spirakis sampling.

Every source gets a target in words by water filling; its documents are taken for as many complete
epochs as the target holds, and the rest is a weighted sample without replacement: each document has
the key -ln(u) / weight with u from a hash of its identity, documents are sorted by key within the
source, and their sizes are summed until the rest is filled; the document at the edge is taken in part.

The running sum needs no source in one task: keys are cut into slices of the exponential's quantiles
(so slices are even), slice totals are summed first, rows within a slice afterwards.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; null text has size 0; documents
of size 0 are taken 0 times; repeated rows are documents of their own and ties of keys go by id, then text
hash; very long texts are documents like others, of which the edge may take a part; columns of other names do not
matter; an empty table gives no rows. The number of sources is that of a configuration, so windows over
the table of sources (one row each) run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import stored
from .common import WORD_RUN, hash_words, slices, table, text_of

SEED = "mix-1"
CAP = 3


def quality_weight(text: Column) -> Column:
    """A document's weight in the sample, 0.5 to 1.5: longer documents, up to 4096 characters, come sooner."""
    return F.lit(0.5) + F.least(F.length(text), F.lit(4096)) / F.lit(4096.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """source_key, source_size, target from (source_key, source_null, size) sums.

    The water level: with sources sorted by cap / weight and the first k held at their caps, the others'
    level is (total - caps of the first k) / (weights of the others). It rises with k until a source's
    ratio is no longer below it; that level, the highest of those that fit, is the water level.
    """
    everything = Window.orderBy("source_null", "source_key")
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("ceil") / F.col("w"), "source_null", "source_key")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        ranked.withColumn("ceil", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("ceil").over(upto), F.lit(0.0))) / F.sum("w").over(rest))
        .withColumn("fits", F.col("ceil") / F.col("w") >= F.col("level"))
        .withColumn("water", F.max(F.when(F.col("fits"), F.col("level"))).over(every))
    )
    target = F.least("ceil", F.coalesce(F.col("water") * F.col("w"), F.col("ceil")))
    return level.select("source_key", "source_null", "source_size", target.alias("target"))


def mix_rows(rows: DataFrame, seed: str = SEED, per_slice: int = 4_000) -> DataFrame:
    """``rows`` (doc_id, h, size, weight, source_key, source_null) with source_size, target and taken."""
    rows = stored(rows)
    sums = rows.groupBy("source_key", "source_null").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n = rows.count()
    targets = stored(source_targets(sums))
    u = (hash_words(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("h")) + F.lit(0.5)) / F.lit(float(2**52))
    cut = slices(n, per_slice)
    keyed = (
        rows.withColumn("u", u)
        .withColumn("es_key", -F.log("u") / F.col("weight"))
        # the quantile of the key among documents of weights 0.5, 1 and 1.5: no slice gets over 3 times its share
        .withColumn("slice", F.floor((F.lit(1.0) - (F.exp(-F.col("es_key") / 2) + F.exp(-F.col("es_key")) + F.exp(-F.col("es_key") * 1.5)) / 3) * cut).cast("int"))
    )
    totals = keyed.groupBy("source_key", "source_null", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source_key", "source_null").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("slice_size")
    plan = totals.join(targets, ["source_key", "source_null"])
    within = Window.partitionBy("source_key", "source_null", "slice").orderBy("es_key", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(plan, ["source_key", "source_null", "slice"])
    goal = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    left = goal - epochs * F.col("source_size") - F.col("base") - F.col("ahead")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.withColumn("taken", taken.cast("bigint"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.substring(F.md5(text), 1, 16).alias("h"),
        F.regexp_count(text, F.lit(WORD_RUN)).cast("bigint").alias("size"),
        quality_weight(text).alias("weight"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
        F.col(source_col).isNull().alias("source_null"),
    )


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return mix_rows(document_rows(docs, **columns)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each complete take, and one for a part.

    A part is the document's first words, joined by single spaces; rows that are not taken go. Repeated
    rows are told apart by a number among equal (id, text), in both tables.
    """
    names = docs.columns
    plan = mix_rows(document_rows(docs, id_col, text_col, source_col))
    same = Window.partitionBy("doc_id", "h").orderBy("taken")
    plan = plan.select("doc_id", "h", "size", "taken", F.row_number().over(same).alias("copy"))
    text = text_of(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("doc_id"), F.substring(F.md5(text), 1, 16).alias("h"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.lit(0))))
    plan = plan.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "h", "copy", "size", "taken")
    rows = rows.select("row", F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "h", "copy")
    taken = rows.join(plan, ["i", "h", "copy"]).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    ends = F.concat(F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>")), F.when(rest > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    takes = taken.withColumn("rest", rest).withColumn("take", F.explode(ends))
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(f"({WORD_RUN})"), 1)
    part = F.array_join(F.slice(words, 1, F.greatest(F.col("rest"), F.lit(1))), " ")
    new_text = F.when(F.col("take") > 0, F.col(f"row.{text_col}")).otherwise(part)
    columns = [new_text.alias(c) if c == text_col else F.length(new_text).cast("bigint").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return takes.select(*columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS sk, source IS NULL AS sn, substr(md5(coalesce(text, '')), 1, 16) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         0.5::DOUBLE + least(length(coalesce(text, '')), 4096) / 4096.0::DOUBLE AS weight
  FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('mix-1' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || h), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                    / 4503599627370496.0::DOUBLE) / weight AS es FROM d),
s AS (SELECT sk, sn, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY sn, sk) - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS top FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY top / w, sn, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r),
t AS (SELECT sk, sn, source_size, least(top, w * max(CASE WHEN top / w >= lvl THEN lvl END) OVER ()) AS target FROM l),
p AS (SELECT k.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
             coalesce(sum(size) OVER (PARTITION BY k.sk, k.sn ORDER BY es, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN t ON k.sk = t.sk AND k.sn = t.sn)
SELECT doc_id, size, source_size, target,
       CAST((goal // greatest(source_size, 1)) * size + greatest(0, least(size, goal - (goal // greatest(source_size, 1)) * source_size - ahead)) AS BIGINT) AS taken
FROM p
"""
