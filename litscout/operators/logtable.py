"""A keyed table that is merged as it is read (SNK1, SNK2, SNK3, INC3): a base in buckets, and sorted deltas with tombstones.

A batch writes its own rows and nothing else: one delta, sorted by bucket and key. Reading takes for each key the row of the last delta that has
one, and the base's rows of all other keys; the base is not shuffled for that while the deltas are small enough to be broadcast,
which Spark measures. What was written is folded in as it grows:

* over ``MOST_DELTAS`` deltas become one (only deltas are read and written);
* a bucket whose deltas hold over ``SHARE`` of its base rows is rewritten, the others stay as they are.

So a row is rewritten about ``1 / SHARE`` times as often as its bucket's size is changed, and a batch of one percent of the rows costs one percent. The number of
buckets follows the rows of the first write, one for each ``bucket_rows``; beyond ``FEW`` buckets they grow up to ``BUCKET_ROWS`` rows before there are more. Buckets share
folders, ``FOLDERS`` of them or one for each ``BUCKET_ROWS`` rows, as a file costs a rewrite and a read much whatever it holds. Every state is one pointer, renamed into place, that names a generation for each bucket, the deltas and
what is stored beside (the cursor): readers of an older pointer keep what they read, a run that dies leaves only files without a pointer, and ``vacuum``
removes what no pointer since a given one names.

Defined results: a batch has one row for each key at most, else one of them is taken; a key that a batch both sets and deletes is deleted. Rows without a key are not written. Deleting unknown keys changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .state import Snapshots

BUCKET_ROWS, MOST_DELTAS, SHARE = 1_000_000, 8, 0.25
#: Buckets up to which small ``bucket_rows`` are kept to; folders that small buckets are written to.
FEW, FOLDERS = 256, 16
BASE = "__bucket int, __generation int"
MORE = "__bucket int, __deleted boolean, __batch bigint"


class LogTable(Snapshots):
    """``append`` adds a batch, ``read`` gives the rows, ``write`` replaces all of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", bucket_rows: int = BUCKET_ROWS, most_deltas: int = MOST_DELTAS, share: float = SHARE):
        super().__init__(spark, path)
        self.schema, self.key = schema, key
        self.names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
        self.bucket_rows, self.most_deltas, self.share = bucket_rows, most_deltas, share

    def _layout(self, rows: int) -> tuple[int, int]:
        """How many buckets the first rows are dealt to, and in how many folders these are."""
        large = -(-rows // BUCKET_ROWS)
        buckets = max(1, min(-(-rows // self.bucket_rows), max(FEW, large)))
        return buckets, min(buckets, max(FOLDERS, large))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _base(self, at: dict, buckets: set[int] | None = None) -> DataFrame:
        base = {int(b): g for b, g in at.get("base", {}).items() if buckets is None or int(b) in buckets}
        paths = sorted({f"{self.path}/base-{g}/__folder={b % at.get('folders', 1)}" for b, g in base.items()})
        if "folders" not in at:  # a table of before buckets shared folders
            paths = [f"{self.path}/base-{g}/__bucket={b}" for b, g in base.items()]
            return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, {BASE}").parquet(*paths)
        if buckets is not None:
            rows = rows.where(F.col("__bucket").isin(*base))  # files are sorted by it
        # a folder of a generation may hold buckets that a later one rewrote
        return rows.where(F.get(F.lit([base.get(b, -1) for b in range(at["buckets"])]), "__bucket") == F.col("__generation")).select(*self.names)

    def _deltas(self, at: dict, buckets: set[int] | None = None) -> DataFrame:
        """The last row of each key that the deltas hold, or its tombstone."""
        names = [d["name"] for d in at.get("deltas", []) if buckets is None or any(int(b) in buckets for b in d["rows"])]
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, {MORE}")
        rows = self.spark.read.schema(f"{self.schema}, {MORE}").parquet(*[f"{self.path}/{n}" for n in names])
        if buckets is not None:
            rows = rows.where(F.col("__bucket").isin(*buckets))  # deltas are sorted by it: others' row groups are skipped
        return rows if len(names) == 1 else rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "__batch").alias("r")).select("r.*")

    def read(self, schema: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the keys of ``of``: only the buckets that hold these are read."""
        at = self.pointer()
        buckets = None
        if of is not None:
            buckets = {r[0] for r in of.select(self._bucket(at.get("buckets", 1))).distinct().collect()}  # as many as buckets
        base, deltas = self._base(at, buckets), self._deltas(at, buckets)
        if of is not None:
            base, deltas = (d.join(of.select(self.key), self.key, "left_semi") for d in (base, deltas))
        if at.get("deltas"):
            base = base.join(deltas.select(self.key), self.key, "left_anti")
        return base.select(*self.names).union(deltas.where("NOT __deleted").select(*self.names))

    def write(self, df: DataFrame, **beside: object) -> int:
        """Replaces all rows."""
        n = self.pointer()["version"] + 1
        rows = stored(df.where(F.col(self.key).isNotNull()).select(*self.names))
        buckets, folders = self._layout(rows.count())
        return self._commit(n, beside | {"buckets": buckets, "folders": folders} | self._rewrite(n, rows.withColumn("__bucket", self._bucket(buckets)), folders, {}, {}) | {"deltas": []})

    def append(self, rows: DataFrame, deleted: DataFrame | None = None, **beside: object) -> int:
        """A batch: ``rows`` replace those of their keys, ``deleted`` keys go. What is stored beside stays unless given anew."""
        at = self.pointer()
        if "buckets" in at and "folders" not in at:  # laid out anew once
            self.write(self.read(), **{k: x for k, x in at.items() if k not in ("version", "buckets", "base", "rows", "deltas")})
            at = self.pointer()
        n = at["version"] + 1
        rows = rows.where(F.col(self.key).isNotNull()).select(*self.names).dropDuplicates([self.key])
        if deleted is not None:
            deleted = deleted.select(self.key).where(F.col(self.key).isNotNull()).distinct()
            rows = rows.join(deleted, self.key, "left_anti")
        if "buckets" not in at:
            return self.write(rows, **beside)
        kinds = dict(rows.dtypes)
        changes = rows.withColumn("__deleted", F.lit(False))
        if deleted is not None:
            changes = changes.unionByName(deleted.select(self.key, *[F.lit(None).cast(kinds[c]).alias(c) for c in self.names if c != self.key], F.lit(True).alias("__deleted")))
        deltas = at["deltas"] + self._delta(n, changes.withColumn("__bucket", self._bucket(at["buckets"])), n)
        return self._commit(n, at | beside | self._folded(n, at | {"deltas": deltas}))

    def _delta(self, n: int, changes: DataFrame, batch: int | None = None) -> list[dict]:
        """Writes a delta; none for no rows."""
        name = f"delta-{n}" + ("" if batch is not None else "-merged")
        changes = changes if batch is None else changes.withColumn("__batch", F.lit(batch).cast("bigint"))
        names = [*self.names, *[x.split()[0] for x in MORE.split(", ")]]
        changes.select(*names).repartitionByRange("__bucket", self.key).sortWithinPartitions("__bucket", self.key).write.mode("overwrite").parquet(f"{self.path}/{name}")
        counted = self.spark.read.schema(f"{self.schema}, {MORE}").parquet(f"{self.path}/{name}").groupBy("__bucket").count().collect()  # as many as buckets
        return [{"name": name, "rows": {str(r[0]): r[1] for r in counted}}] if counted else []

    def _rewrite(self, n: int, rows: DataFrame, folders: int, base: dict, held: dict) -> dict:
        """Writes buckets (rows with __bucket) as generation n; the pointer's part for them and for those of ``base`` and ``held`` that stay."""
        placed = rows.withColumns({"__generation": F.lit(n).cast("int"), "__folder": F.pmod("__bucket", F.lit(folders))})
        placed.repartition("__folder").sortWithinPartitions("__folder", "__bucket", self.key).write.mode("overwrite").partitionBy("__folder").parquet(f"{self.path}/base-{n}")
        counted = {str(r[0]): r[1] for r in rows.groupBy("__bucket").count().collect()}  # as many as buckets
        return {"base": base | dict.fromkeys(counted, n), "rows": held | counted}

    def _folded(self, n: int, at: dict) -> dict:
        """What compaction makes of a pointer: full buckets rewritten, many deltas merged into one."""
        changed: dict[str, int] = {}
        for d in at["deltas"]:
            for b, k in d["rows"].items():
                changed[b] = changed.get(b, 0) + k
        full = {b for b, k in changed.items() if k > self.share * at["rows"].get(b, 0)}
        out = {k: at[k] for k in ("base", "rows", "deltas")}
        if full:
            numbers = {int(b) for b in full}
            base, deltas = self._base(at, numbers), self._deltas(at, numbers)
            merged = base.join(deltas.select(self.key), self.key, "left_anti").select(*self.names).union(deltas.where("NOT __deleted").select(*self.names))
            stay = [{b: x for b, x in at[k].items() if b not in full} for k in ("base", "rows")]
            out |= self._rewrite(n, stored(merged.withColumn("__bucket", self._bucket(at["buckets"]))), at["folders"], *stay)
            rest = self._deltas(at, {int(b) for b in changed} - numbers) if len(full) < len(changed) else None
            out["deltas"] = self._delta(n, rest) if rest is not None else []
        elif len(at["deltas"]) > self.most_deltas:
            out["deltas"] = self._delta(n, self._deltas(at))
        return out

    def vacuum(self, since: int) -> int:
        """Removes pointers before version ``since`` and the folders that no later one names; how many folders. For when no reader uses them any more."""
        fs = self._files()
        versions = [v for v in self.versions() if v >= since]
        named = set()
        for v in versions:
            at = self.pointer(v)
            named |= {f"base-{g}" for g in at.get("base", {}).values()} | {d["name"] for d in at.get("deltas", [])}
        gone = 0
        for name in [s.getPath().getName() for s in fs.listStatus(self._path())]:
            old = name.startswith("pointer-") and int(name[8:-5]) < since
            if old or (name.startswith(("base-", "delta-")) and name not in named):
                fs.delete(self._path(name), True)
                gone += not old
        return gone
