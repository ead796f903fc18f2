"""Page streams and keyed state, stopped and started again."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from litscout.operators.logtable import LogTable
from litscout.schema import LIBRARY
from litscout.sources.datasource import LibrarySource
from litscout.sources.pages import ApiPages, FolderPages
from litscout.streaming import keyed

from .served import served


def item(key, version, title, deleted=False):
    return json.dumps({"key": key, "data": {"key": key, "version": version, "title": title}, "deleted": deleted})


def collected(spark, options, out, check):
    pages = spark.readStream.format("library").options(**options).load()
    pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.pos, json.loads(r.json)["key"]) for r in spark.read.schema("json string, pos bigint").parquet(out).collect())


@pytest.mark.parametrize("counted", [True, False])
def test_pages_of_the_interface_are_read_by_tasks(spark, tmp_path, counted):
    spark.dataSource.register(LibrarySource)
    held = {"version": 7, "items": [{"key": f"k{i}"} for i in range(23)]}

    def items(q, request):
        a, n = int(q.get("start", 0)), int(q["limit"])
        more = {"Last-Modified-Version": str(held["version"])} | ({"Total-Results": str(len(held["items"]))} if counted else {})
        if a + n < len(held["items"]):
            more["Link"] = f'<{request["url"]}/items?limit={n}&start={a + n}>; rel="next"'
        return 200, more, held["items"][a : a + n]

    with served({"/items": items}, failing=1) as web:
        options = {"url": web.url, "page_size": 5, "delay": 0, "pages_per_task": 2}
        source = ApiPages({k: str(v) for k, v in options.items()})
        parts = source.plan(source.first, source.latest())
        assert [(p.start, p.stop) for p in parts] == ([(0, 2), (2, 4), (4, 5)] if counted else [(0, None)])
        at = [str(tmp_path / n) for n in ("out", "check")]
        want = [(i, f"k{i}") for i in range(23)]
        assert collected(spark, options, *at) == want
        assert collected(spark, options, *at) == want  # the version is the same: nothing is read
        held.update(version=8, items=held["items"][:4])
        assert collected(spark, options, *at) == sorted(want + want[:4])


def test_files_of_a_folder(spark, tmp_path):
    spark.dataSource.register(LibrarySource)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "_SUCCESS").write_text("")
    at = [str(tmp_path / n) for n in ("out", "check")]
    assert FolderPages({"folder": str(tmp_path / "none")}).latest() == {"files": 0}
    (folder / "a").mkdir()
    (folder / "a" / "1").write_text(item("x", 1, "é") + "\n\n" + item("y", 1, "t" * 3_000_000))
    (folder / "a" / "2").write_text(item("z", 1, "") + "\n")
    first = [(0, "x"), (2, "y"), (1 << 32, "z")]
    assert collected(spark, {"folder": str(folder)}, *at) == first
    (folder / "b").mkdir()
    (folder / "b" / "1").write_text(item("w", 1, ""))
    assert collected(spark, {"folder": str(folder)}, *at) == [*first, (2 << 32, "w")]


def test_keyed_state_guards_versions(spark, tmp_path):
    """Older versions and repeated content change nothing, a tombstone holds against late rows, and a restart goes on."""
    spark.dataSource.register(LibrarySource)
    folder = tmp_path / "in"
    folder.mkdir()
    table = LogTable(spark, str(tmp_path / "table"), LIBRARY)
    steps = [
        ([("a", 1, "x", False), ("b", 5, "y", False), ("a", 2, "x2", False), (None, 1, "n", False)], {"a": (2, "x2"), "b": (5, "y")}),
        ([("a", 1, "late", False), ("b", 6, "", True), ("c", 1, "z", False)], {"a": (2, "x2"), "c": (1, "z")}),
        ([("b", 4, "late", False), ("b", 6, "same version", False), ("a", 2, "corrected", False)], {"a": (2, "corrected"), "c": (1, "z")}),
        ([("b", 7, "again", False), ("c", 1, "z", False)], {"a": (2, "corrected"), "b": (7, "again"), "c": (1, "z")}),
    ]
    for n, (rows, want) in enumerate(steps):
        (folder / f"{n}.txt").write_text("\n".join(item(*r) for r in rows))
        raw = spark.readStream.format("library").option("folder", str(folder)).load()
        keyed.start(keyed.item_changes(raw), table, str(tmp_path / "check"), F.current_timestamp()).awaitTermination()
        assert {r.key: (r.version, r.title) for r in table.read().collect()} == want
    last = table.pointer()
    assert sum(sum(d["rows"].values()) for d in last["deltas"]) + sum(last["rows"].values()) < 9  # what changed nothing was not written


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from litscout.shipping import ship
from litscout.sources.datasource import LibrarySource
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
spark.dataSource.register(LibrarySource)
pages = spark.readStream.format("library").option("folder", sys.argv[2] + "/in").load()
pages.writeStream.format("parquet").option("path", sys.argv[2] + "/out").option("checkpointLocation", sys.argv[2] + "/check").trigger(availableNow=True).start().awaitTermination()
print("rows", spark.read.parquet(sys.argv[2] + "/out").count())
"""


def test_stream_planner_finds_the_package_from_any_folder(tmp_path):
    """A driver started elsewhere, whose environment does not name the package."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"key": "a"}\n{"key": "b"}\n')
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE, root, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 2" in done.stdout, done.stderr[-2000:]
