"""Paged web interfaces: retries, link headers, offsets (SRC1 to SRC9, SRC26, SRC27)."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

RETRY_STATUS = frozenset((408, 425, 429, 500, 502, 503, 504))
ATTEMPTS, BACKOFF = 3, 1.5


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: bytes = b""

    def json(self):
        return json.loads(self.body)


@dataclass
class Client:
    """GET and POST with headers; what ``send`` raises as OSError, and the statuses above, are tried again."""

    headers: dict[str, str] = field(default_factory=dict)
    timeout_s: float = 30
    sleep: Callable[[float], None] = time.sleep

    def send(self, method: str, url: str, body: bytes | None) -> Response:
        request = urllib.request.Request(url, body, self.headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                return Response(r.status, dict(r.headers.items()), r.read())
        except urllib.error.HTTPError as e:
            return Response(e.code, dict(e.headers.items()), e.read())

    def request(self, method: str, url: str, params: dict | None = None, body: bytes | None = None) -> Response:
        """SRC26: up to three attempts, 1.5 s more before each; the last failure is raised as OSError."""
        full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
        last: Exception | None = None
        for attempt in range(1, ATTEMPTS + 1):
            try:
                response = self.send(method, full, body)
                if response.status not in RETRY_STATUS:
                    if response.status >= 400:
                        raise OSError(f"{response.status} from {url}") from None
                    return response
                last = OSError(f"{response.status} from {url}")
            except (TimeoutError, ConnectionError, urllib.error.URLError) as e:
                last = e
            if attempt < ATTEMPTS:
                self.sleep(BACKOFF * attempt)
        raise OSError(f"{url} failed {ATTEMPTS} times") from last


def next_link(header: str | None) -> str | None:
    """SRC3: the target of ``rel="next"`` in a Link header."""
    for part in (header or "").split(","):
        if m := re.match(r"\s*<([^>]*)>\s*;(.*)", part):
            if re.search(r'rel\s*=\s*"?next"?', m[2]):
                return m[1]
    return None


def with_key(headers: dict[str, str], key: str, header: str = "Authorization") -> dict[str, str]:
    """SRC27: the headers with a key, as a bearer token in ``Authorization`` and as it is elsewhere; without a key none is sent."""
    return headers | ({header: f"Bearer {key}" if header == "Authorization" else key} if key else {})


def library_pages(client: Client, base_url: str, since: int | None = None, page_size: int = 100, delay_s: float = 0.2) -> Iterator[Response]:
    """SRC1: pages in order of addition, by link header; 304 gives none."""
    if since is not None:
        client.headers["If-Modified-Since-Version"] = str(since)
    yield from linked_pages(client, f"{base_url}/items", {"limit": page_size, "sort": "dateAdded", "direction": "asc"}, delay_s)


def library_state(client: Client, base_url: str) -> dict:
    """The library's version and number of items, if it says so, from the headers of a page of one item."""
    headers = {k.lower(): v for k, v in client.request("GET", f"{base_url}/items", {"limit": 1}).headers.items()}
    items = headers.get("total-results")
    return {"version": int(headers.get("last-modified-version", 0)), "items": None if items is None else int(items)}


def linked_pages(client: Client, first: str, ask: dict, delay_s: float = 0) -> Iterator[Response]:
    """A page and those that its ``next`` links lead to."""
    url: str | None = first
    params: dict | None = ask
    while url:
        page = client.request("GET", url, params)
        if page.status == 304:
            return
        yield page
        url, params = next_link(page.headers.get("Link")), None
        if url and delay_s:
            client.sleep(delay_s)


def deleted_keys(client: Client, base_url: str, since: int) -> list[str]:
    """SRC2: keys deleted since a version. Pass the *old* cursor: deletions between the old and the new one count."""
    return list(client.request("GET", f"{base_url}/deleted", {"since": since}).json().get("items", []))


def feed_page(client: Client, url: str, params: dict, delay_s: float) -> str:
    """SRC8: the feed's text after the delay it asks for; one that says with status 200 that the rate is exceeded is a failure."""
    client.sleep(delay_s)
    text = client.request("GET", url, params).body.decode("utf-8", "replace")
    if "rate exceeded" in text.lower():
        raise OSError(f"rate limit of {url}")
    return text


def offset_pages(client: Client, url: str, params: dict, page_size: int = 200) -> Iterator[list]:
    """SRC4: pages by offset; ends without a next offset, at an unchanged one, or at an empty page."""
    offset = 0
    while True:
        data = client.request("GET", url, params | {"limit": page_size, "offset": offset}).json()
        items = data.get("data") or []
        yield items
        after = (data.get("paging") or {}).get("next_offset")
        if after is None or after == offset or not items:
            return
        offset = int(after)


#: SRC5 to SRC9: where a source's items are, and how many are asked for.
QUERY_ROWS = 100
FEED_ROWS, FEED_DELAY_S, FEED_TIMEOUT_S = 50, 3.1, 60


def graph_params(query: str, since: str, mailto: str) -> dict:
    return {"filter": f"from_publication_date:{since}", "search": query, "sort": "publication_date:desc", "per-page": QUERY_ROWS, "mailto": mailto}


def registry_params(query: str, since: str, mailto: str) -> dict:
    return {"query": query, "filter": f"from-created-date:{since}", "sort": "created", "order": "desc", "rows": QUERY_ROWS, "mailto": mailto}


def venue_params(venue: str, since: str, mailto: str) -> dict:
    return {"filter": f"from-created-date:{since},container-title:{venue}", "sort": "created", "order": "desc", "rows": QUERY_ROWS, "mailto": mailto}


def feed_params(query: str) -> dict:
    return {"search_query": query, "sortBy": "submittedDate", "sortOrder": "descending", "max_results": FEED_ROWS}
