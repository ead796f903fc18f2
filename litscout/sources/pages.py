"""Paged sources as streams (INC1, SRC1): pages are planned on the driver and read by the executors.

Two transports: the library's interface, of which one small request tells the version and the number of items, and a folder of exported
files (any store that pyarrow opens), one JSON item a line, whose names rise with time. An offset holds all that planning needs, so a batch that is replayed
is planned alike; it is committed by Spark's checkpoint after the batch was processed, never earlier (INC5).

An interface's cursor is its version: while it stays, there is no batch; when it moved, all items are read again. Items that change between planning and reading
come with their newer versions, and their change moves the version, so the next batch reads what moved between pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from .http import Client, library_state, linked_pages, with_key


@dataclass
class Pages(InputPartition):
    """Pages from ``start`` to before ``stop``; without ``stop`` as many as links lead to. Or files, with the number of the first."""

    start: int
    stop: int | None = None
    files: tuple[str, ...] = ()


class ApiPages:
    """The library's interface. ``pages_per_task`` pages are read one after the other by a task, politely."""

    first = {"version": -1, "items": 0}

    def __init__(self, options: dict):
        self.url, self.size, self.delay = options["url"], int(options.get("page_size", 100)), float(options.get("delay", 0.2))
        self.per_task = int(options.get("pages_per_task", 10))
        self.headers = with_key(json.loads(options.get("headers", "{}")), options.get("token", ""))

    def latest(self) -> dict:
        return library_state(Client(dict(self.headers)), self.url)

    def plan(self, start: dict, end: dict) -> list[Pages]:
        if start["version"] == end["version"]:
            return []
        if end["items"] is None:  # the interface does not say how many there are
            return [Pages(0)]
        pages = -(-end["items"] // self.size)
        return [Pages(a, min(pages, a + self.per_task)) for a in range(0, pages, self.per_task)]

    def read(self, part: Pages) -> Iterator[tuple]:
        client = Client(dict(self.headers))
        ask = {"limit": self.size, "sort": "dateAdded", "direction": "asc"}
        pos = part.start * self.size
        if part.stop is None:
            pages = linked_pages(client, f"{self.url}/items", ask, self.delay)
        else:
            pages = (self._page(client, ask, n, n > part.start) for n in range(part.start, part.stop))
        for page in pages:
            for i, item in enumerate(page.json()):
                yield json.dumps(item, ensure_ascii=False), pos + i
            pos += self.size

    def _page(self, client: Client, ask: dict, n: int, wait: bool):
        if wait and self.delay:
            client.sleep(self.delay)
        return client.request("GET", f"{self.url}/items", ask | {"start": n * self.size})


class FolderPages:
    """Files below a folder in order of their paths; an offset is how many have been planned. ``files_per_task`` are read by a task."""

    first = {"files": 0}

    def __init__(self, options: dict):
        self.folder, self.per_task = options["folder"], int(options.get("files_per_task", 1))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def files(self) -> list[str]:
        from pyarrow import fs

        store, path = self._store()
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "_.")

    def latest(self) -> dict:
        return {"files": len(self.files())}

    def plan(self, start: dict, end: dict) -> list[Pages]:
        files = self.files()[start["files"] : end["files"]]
        return [Pages(start["files"] + a, None, tuple(files[a : a + self.per_task])) for a in range(0, len(files), self.per_task)]

    def read(self, part: Pages) -> Iterator[tuple]:
        store, _ = self._store()
        for n, path in enumerate(part.files, part.start):
            with store.open_input_stream(path) as f:
                held, line = b"", 0
                while chunk := f.read(1 << 20):
                    *lines, held = (held + chunk).split(b"\n")
                    for text in lines:
                        yield text.decode(), (n << 32) + line
                        line += 1
                if held:
                    yield held.decode(), (n << 32) + line


class PageStream(DataSourceStreamReader):
    """Rows (json, pos) of the pages between two offsets."""

    def __init__(self, options: dict):
        self.pages = (FolderPages if "folder" in options else ApiPages)(options)

    def initialOffset(self) -> dict:
        return dict(self.pages.first)

    def latestOffset(self) -> dict:
        return self.pages.latest()

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.pages.plan(start, end)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return ((text, pos) for text, pos in self.pages.read(partition) if text)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch beside Spark's checkpoint."""
