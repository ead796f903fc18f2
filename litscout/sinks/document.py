"""One document from rows in order, of any number (SNK10, SNK11 without a limit): tasks write parts, the commit joins them.

``rows.write.format("document").mode("overwrite").option("path", ...).save()`` for one string column in global order. Each task writes its partition's rows to a file beside the
document and tells where; a task that is tried again writes a file of its own, and only the file of the attempt that succeeded is told. The commit streams the parts, in order of their
partitions, behind the head, and puts the whole in place of an older document. No rows pass through the driver's memory. Any store that pyarrow opens will do, if all executors share it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..storage import stored

CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    rows: int
    path: str


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.head, self.tail, self.between = (options.get(k, "") for k in ("path", "head", "tail", "between"))
        self.parts = f"{self.target}.parts-{uuid.uuid4().hex}"

    def _store(self, target: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(target)

    def write(self, iterator: Iterator) -> Part:
        store, folder = self._store(self.parts)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        path, rows = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}", 0
        with store.open_output_stream(path) as f:
            for row in iterator:
                if row[0] is not None:
                    f.write((self.between if rows else "").encode() + row[0].encode())
                    rows += 1
        return Part(context.partitionId(), rows, path)

    def commit(self, messages: list[Part | None]) -> None:
        store, target = self._store(self.target)
        with store.open_output_stream(f"{target}.new") as out:
            out.write(self.head.encode())
            for n, part in enumerate(sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)):
                out.write((self.between if n else "").encode())
                with store.open_input_stream(part.path) as f:
                    while chunk := f.read(CHUNK):
                        out.write(chunk)
            out.write(self.tail.encode())
        store.move(f"{target}.new", target)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, folder = self._store(self.parts)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_document(rows: DataFrame, path: str, head: str = "", tail: str = "", between: str = "") -> None:
    """Writes rows (text) in their order."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    rows.write.format("document").mode("overwrite").options(path=path, head=head, tail=tail, between=between).save()


def ranked_anywhere(rows: DataFrame, order: list[Column]) -> DataFrame:
    """WIN4 for any number of rows: ``rank`` from 1. Rows are sorted over ranges and numbered within them; the ranges' sizes, a row for each, are summed up."""
    ids = F.monotonically_increasing_id()  # the range's number above 33 bits for the row
    placed = stored(rows.orderBy(*order).withColumn("__at", ids))
    size = {r[0]: r[1] for r in placed.groupBy(F.shiftright("__at", 33)).count().collect()}
    before, table = 0, []
    for p in sorted(size):
        table.append((p, before))
        before += size[p]
    if not table:
        return placed.withColumn("rank", F.lit(None).cast("bigint")).drop("__at")
    base = F.broadcast(rows.sparkSession.createDataFrame(table, "__p bigint, __before bigint"))  # a row for each range
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(base, F.shiftright("__at", 33) == F.col("__p")).withColumn("rank", rank).drop("__at", "__p", "__before")
