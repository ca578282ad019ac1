"""Objects of an HTTP server: requests are rows, answered by the tasks.

A whole read needs status 200 and its declared length, a range read status 206 and exactly the range asked for; a
server that ignores the range is an error, as is anything but 404 for a missing object. HTTP has no listing.
"""

from __future__ import annotations

import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.errors import ArrayError, ResourceLimit
from tesserae.functions.geometry import valid_key

#: Bytes of one object and seconds of one request, at most.
MAX_BYTES, TIMEOUT = 512 << 20, 60


def is_http(root: str) -> bool:
    return root.startswith(("http://", "https://"))


def _open(url: str, method: str = "GET", headers: dict | None = None):
    try:
        return urllib.request.urlopen(urllib.request.Request(url, method=method, headers={"Accept-Encoding": "identity", **(headers or {})}), timeout=TIMEOUT)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise ArrayError(f"{url}: status {e.code}") from None
    except urllib.error.URLError as e:
        raise ArrayError(f"{url}: {e.reason}") from None


def _url(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/{urllib.parse.quote(valid_key(key))}"


def length(root: str, key: str) -> int | None:
    """Declared length of an object; ``None`` where there is none."""
    answer = _open(_url(root, key), "HEAD")
    if answer is None:
        return None
    with answer:
        if (n := answer.headers.get("Content-Length")) is None:
            raise ArrayError(f"{key}: no declared length")
        return int(n)


def read(root: str, key: str, max_bytes: int = MAX_BYTES) -> bytes | None:
    """A whole object."""
    answer = _open(_url(root, key))
    if answer is None:
        return None
    with answer:
        if answer.status != 200:
            raise ArrayError(f"{key}: status {answer.status}")
        declared = answer.headers.get("Content-Length")
        if declared is not None and int(declared) > max_bytes:
            raise ResourceLimit(f"bytes of {key}", max_bytes, int(declared))
        data = answer.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ResourceLimit(f"bytes of {key}", max_bytes, len(data))
    if declared is not None and len(data) != int(declared):
        raise ArrayError(f"{key}: {len(data)} bytes where {declared} were declared")
    return data


def read_range(root: str, key: str, start: int, end: int) -> bytes | None:
    """Bytes from start to end (exclusive)."""
    answer = _open(_url(root, key), headers={"Range": f"bytes={start}-{end - 1}"})
    if answer is None:
        return None
    with answer:
        if answer.status != 206:
            raise ArrayError(f"{key}: the server ignored the range")
        m = re.fullmatch(r"bytes ([0-9]+)-([0-9]+)/(?:[0-9]+|\*)", answer.headers.get("Content-Range", ""))
        if not m or (int(m[1]), int(m[2])) != (start, end - 1):
            raise ArrayError(f"{key}: range {answer.headers.get('Content-Range')!r} is not {start}-{end - 1}")
        data = answer.read(end - start + 1)
    if len(data) != end - start:
        raise ArrayError(f"{key}: {len(data)} bytes where {end - start} were asked for")
    return data


def fetched(keys: DataFrame, root: str, content: bool = True) -> DataFrame:
    """``keys (key, path, ..)`` with ``length`` (and ``content``) of the objects that exist; ``path`` is asked for."""
    kept = [f for f in keys.schema.fields if f.name != "path"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "length long", *(["content binary"] if content else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, path in enumerate(batch["path"].to_pylist()):
                data = read(root, path) if content else None
                n = len(data) if data is not None else None if content else length(root, path)
                if n is None:
                    continue
                own = [batch[f.name].slice(at, 1) for f in kept]
                extra = [pa.array([n], pa.int64()), *([pa.array([data], pa.binary())] if content else [])]
                yield pa.RecordBatch.from_arrays([*own, *extra], [*(f.name for f in kept), "length", *(["content"] if content else [])])

    return keys.mapInArrow(run, schema)
