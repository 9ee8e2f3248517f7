"""One JSON document of any size as a data source: the elements of its top-level members, read by byte ranges.

Where a range begins nobody knows whether that place is in a string or how deep it is nested. So there are two passes. The first sums up each
range on its own: whether it holds an odd number of quotes, and by how much its brackets change the depth if it begins outside a string, and if it
begins inside one. Sums are put together in order, a row a range, which gives the state each range begins in. The second pass is the data source
`json_elements`: a range yields the elements that start in it, and what stands at the top level itself, the document's head.

Ranges begin neither behind a backslash nor within a character, so an escaped quote is never cut from its backslash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftgraph.runtime import ship, stored

#: Bytes of a range, and of those that a task reads at least; tasks at most.
RANGE, TASKS = 8 << 20, 4096
#: Bytes before an element in which its key is looked for; top-level members at most.
KEY_REACH, MEMBERS = 1 << 12, 1000
SCHEMA = "kind string, place long, key string, raw string"
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.S)


def store_of(path: str):
    """(file system, path in it) of a path or address in any store that pyarrow knows."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class File:
    """Bytes of a file in any store that pyarrow reads."""

    def __init__(self, path: str):
        store, at = store_of(path)
        self.size = store.get_file_info(at).size
        self.stream = store.open_input_file(at)

    def bytes(self, begin: int, end: int) -> bytes:
        self.stream.seek(begin)
        return self.stream.read(max(0, min(end, self.size) - begin))

    def start(self, at: int) -> int:
        """The first place from `at` on that is neither behind a backslash nor within a character."""
        while 0 < at < self.size:
            got = np.frombuffer(self.bytes(at - 1, at + 4096), np.uint8)
            free = np.flatnonzero((got[:-1] != 92) & (got[1:] & 0xC0 != 0x80))
            if len(free):
                return at + int(free[0])
            at += len(got) - 1
        return min(at, self.size)


def _outside(buf: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """(change of depth at each byte, real quotes) of bytes that begin behind no backslash."""
    slash = buf == 92
    at = np.arange(len(buf))
    last = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.concatenate([[0], (at - last)[:-1]])  # backslashes right before
    quote = (buf == 34) & (run % 2 == 0)
    inside = (np.cumsum(quote) - quote + in_string) & 1
    free = (inside == 0) & ~quote
    return ((buf == 123) | (buf == 91)) * free * 1 - ((buf == 125) | (buf == 93)) * free * 1, quote


def summary(buf: bytes) -> tuple[bool, int, int]:
    """(odd number of quotes, change of depth from outside a string, and from inside)."""
    raw = np.frombuffer(buf, np.uint8)
    if not len(raw):
        return False, 0, 0
    step, quote = _outside(raw, False)
    return bool(quote.sum() & 1), int(step.sum()), int(_outside(raw, True)[0].sum())


class _Range(InputPartition):
    def __init__(self, begin: int, end: int, in_string: bool, depth: int):
        self.begin, self.end, self.in_string, self.depth = begin, end, in_string, depth


def elements(file: File, part: _Range) -> Iterator[tuple[str, int, str | None, str]]:
    """(kind element | head, place, key, raw) of a range; an element is read to its end, wherever that is."""
    begin, end = file.start(part.begin), file.start(part.end)
    if begin >= end:
        return
    more = min(1 << 16, max(1 << 12, (end - begin) >> 3))
    while True:
        got = file.bytes(begin, end + more)
        raw = np.frombuffer(got, np.uint8)
        step, _ = _outside(raw, part.in_string)
        before = part.depth + np.cumsum(step) - step
        starts = np.flatnonzero((step > 0) & (before == 2) & (raw == 123))
        starts = starts[starts < end - begin]
        ends = np.flatnonzero((step < 0) & (before == 3) & (raw == 125))
        if not len(starts) or (len(ends) and ends[-1] > starts[-1]):
            break
        if begin + len(got) >= file.size:
            raise ValueError(f"the document ends within the element at byte {begin + int(starts[-1])}")
        more *= 4
    own = slice(0, end - begin)
    head = (before[own] < 2) | (before[own] == 2) & (step[own] < 0)
    if head.any():
        marks = np.flatnonzero((step[own] > 0) & (before[own] == 1))
        yield "head", begin, json.dumps((begin + marks).tolist()), raw[own][head].tobytes().decode()
    for s, e in zip(starts, ends[np.searchsorted(ends, starts)], strict=True):
        back = got[max(0, s - KEY_REACH) : s] if s >= KEY_REACH else file.bytes(max(0, begin + int(s) - KEY_REACH), begin + int(s))
        key = _KEY.search(back) if back.rstrip().endswith(b":") else None  # the search goes over all of it
        yield "element", begin + int(s), json.loads(key[1]) if key else None, got[s : e + 1].decode()


class JsonElements(DataSource):
    """Options: path; states, what `states` gives."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options["states"]))


class _Ranges(InputPartition):
    """Ranges that one task reads, one after another."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def tasks(total: int, size: int) -> int:
    """Ranges of a task: those of RANGE bytes, and more where a document has over TASKS times as many."""
    return max(1, -(-max(RANGE, total // TASKS) // size))


class _Reader(DataSourceReader):
    def __init__(self, path: str, ranges: list):
        self.path, self.ranges = path, ranges

    def __getstate__(self):
        return {"path": self.path, "ranges": []}  # a task has its own

    def partitions(self):
        if not self.ranges:
            return []
        own = tasks(self.ranges[-1][1], self.ranges[0][1] - self.ranges[0][0] or 1)
        return [_Ranges([_Range(*r) for r in self.ranges[i : i + own]]) for i in range(0, len(self.ranges), own)]

    def read(self, partition):
        file = File(self.path)
        for part in partition.ranges:
            rows = list(elements(file, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["kind", "place", "key", "raw"])


def states(spark: SparkSession, path: str, size: int = RANGE) -> list[tuple[int, int, bool, int]]:
    """(begin, end, in a string, depth) of each range, from a first pass over the bytes in parallel."""
    total = File(path).size
    n = max(1, -(-total // size))

    def run(batches):
        file = File(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            sums = [summary(file.bytes(file.start(i * size), file.start((i + 1) * size))) for i in ids]
            yield pa.RecordBatch.from_pydict({"i": pa.array(ids, pa.int64()), **{c: pa.array([s[k] for s in sums], t) for k, (c, t) in enumerate((("odd", pa.bool_()), ("out", pa.int64()), ("inside", pa.int64())))}})

    rows = sorted(spark.range(0, n, 1, -(-n // tasks(total, size))).mapInArrow(run, "i long, odd boolean, out long, inside long").collect())
    out, in_string, depth = [], False, 0
    for r in rows:
        out.append((r.i * size, min(total, (r.i + 1) * size), in_string, depth))
        depth += r.inside if in_string else r.out
        in_string ^= r.odd
    if in_string or depth:
        raise ValueError("the document's brackets or quotes do not close")
    return out


def read_document(spark: SparkSession, path: str, size: int = RANGE) -> tuple[dict, DataFrame]:
    """A JSON object -> (its top-level members, containers empty; (section, place, key, raw) of their elements that are objects)."""
    ship(spark)
    spark.dataSource.register(JsonElements)
    all_ = stored(spark.read.format("json_elements").option("path", path).option("states", json.dumps(states(spark, path, size))).load())
    heads = all_.where("kind = 'head'").select("place", "key", "raw").collect()  # the top level itself, and at most a row a range
    text = "".join(h.raw for h in sorted(heads))
    opened = [at for h in sorted(heads) for at in json.loads(h.key)]
    pairs = json.loads(text, object_pairs_hook=lambda x: x)
    names = [k for k, v in pairs if isinstance(v, list)]
    if len(names) > MEMBERS:
        raise ValueError(f"over {MEMBERS} members")
    section: Column = F.lit(None).cast("string")
    for name, at in zip(names, opened, strict=True):
        section = F.when(F.col("place") > at, F.lit(name)).otherwise(section)
    return dict(pairs), all_.where("kind = 'element'").select(section.alias("section"), "place", "key", "raw")
