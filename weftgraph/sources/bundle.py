"""Named views published together: a data source whose tasks report what they wrote, and whose commit alone makes it visible.

All views are written by one job. A task writes lines of JSON into files of its own, below a folder of the job, and reports of each file its rows, bytes
and SHA-256 (a commit message). The commit removes files that no message names (those of lost or repeated attempts), writes a manifest and then moves
the pointer CURRENT to it, which is one replacement of one small file. Readers go through CURRENT, so they see all views of a job or none. A job that
fails removes its folder and leaves CURRENT as it was; what a task that has not been stopped yet writes there after that has no manifest, and goes with
`drop_old`. Earlier jobs stay readable for those who hold their manifest, until then.

The manifest is as long as there are files, so it is bounded by the number of tasks, not of records.

Cases: a view without rows has no files and a count of 0 in the manifest; null records are not written; a name with other characters than letters, digits,
`_`, `.` and `-`, or beginning with a dot, raises an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from weftgraph.runtime import ship
from weftgraph.sources.document import store_of

NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*")
FILE = "view string, section string, file string, rows long, bytes long, sha256 string"


#: Sections that make a view a whole export; a view of connections alone is another kind.
EXPORT, EDGES = {"entities", "connections", "sources"}, {"connections"}


def kind_of(sections: set[str]) -> str:
    return "export" if sections >= EXPORT else "connections-view" if sections == EDGES else "other"


@dataclass
class Written(WriterCommitMessage):
    """(view, section, file, rows, bytes, sha256) of each file of a task."""

    files: list[tuple]


class _Part:
    """One file of a task: its stream, and what is reported of it."""

    def __init__(self, store, root: str, view: str, section: str, file: str):
        store.create_dir(f"{root}/{file.rpartition('/')[0]}", recursive=True)
        self.view, self.section, self.file = view, section, file
        self.stream, self.digest, self.rows, self.size = store.open_output_stream(f"{root}/{file}"), hashlib.sha256(), 0, 0

    def add(self, records: list[str]) -> None:
        data = "".join(f"{r}\n" for r in records).encode()
        self.stream.write(data)
        self.digest.update(data)
        self.rows, self.size = self.rows + len(records), self.size + len(data)

    def close(self) -> tuple:
        self.stream.close()
        return self.view, self.section, self.file, self.rows, self.size, self.digest.hexdigest()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, job: str, head: dict, names: list):
        self.path, self.job, self.head, self.names = path, job, head, names

    def write(self, iterator: Iterator) -> Written:
        store, root = store_of(self.path)
        attempt, parts = uuid.uuid4().hex, {}
        for b in iterator:
            table = {}
            for view, section, raw in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                table.setdefault((view, section), []).append(raw)
            for key, records in table.items():
                if key not in parts:
                    parts[key] = _Part(store, root, *key, f"{self.job}/{key[0]}/{key[1]}/{attempt}.jsonl")
                parts[key].add(records)
        return Written([p.close() for p in parts.values()])

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        named = {f"{root}/{f[2]}" for f in files}
        for found in store.get_file_info(fs.FileSelector(f"{root}/{self.job}", allow_not_found=True, recursive=True)):
            if found.type == fs.FileType.File and found.path not in named:
                store.delete_file(found.path)
        sums = "".join(f"{s}\n" for s in sorted(f[5] for f in files))
        views = {}
        for view, section in self.names:
            views.setdefault(view, {"kind": kind_of({s for v, s in self.names if v == view})})[f"{section}_count"] = sum(f[3] for f in files if f[:2] == (view, section))
        keys = [f.split()[0] for f in FILE.split(", ")]
        manifest = self.head | {"bundle_id": hashlib.sha256(sums.encode()).hexdigest()[:12], "job": self.job, "views": views, "files": [dict(zip(keys, f, strict=True)) for f in files]}
        store.create_dir(f"{root}/manifests", recursive=True)
        _put(store, f"{root}/manifests/{self.job}.json", json.dumps(manifest, indent=1))
        _put(store, f"{root}/.{self.job}", f"{self.job}\n")
        store.move(f"{root}/.{self.job}", f"{root}/CURRENT")

    def abort(self, messages: list) -> None:
        _remove(self.path, self.job)


def _put(store, at: str, text: str) -> None:
    with store.open_output_stream(at) as out:
        out.write(text.encode())


def _remove(path: str, job: str) -> None:
    from pyarrow import fs

    store, root = store_of(path)
    if store.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{job}")
    if store.get_file_info(f"{root}/manifests/{job}.json").type == fs.FileType.File:
        store.delete_file(f"{root}/manifests/{job}.json")


class Views(DataSource):
    """Options: path; job; head, JSON that the manifest begins with; names, JSON of the (view, section) there are."""

    @classmethod
    def name(cls) -> str:
        return "published_views"

    def schema(self) -> str:
        return "view string, section string, raw string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return _Writer(o["path"], o["job"], json.loads(o["head"]), [tuple(x) for x in json.loads(o["names"])])


def publish(spark: SparkSession, views: dict[str, dict[str, DataFrame]], path: str, head: dict | None = None) -> str:
    """Each view's sections (name to table) are written as lines of JSON and appear together; gives the job's name.

    `head` has what else the manifest shall tell, such as the content hash of what the views were made of.
    """
    names = [(v, s) for v, sections in views.items() for s in sections]
    for n in {x for pair in names for x in pair}:
        if not NAME.fullmatch(n):
            raise ValueError(f"no name of a view or section: {n!r}")
    ship(spark)
    spark.dataSource.register(Views)
    lines = [df.select(F.lit(v).alias("view"), F.lit(s).alias("section"), F.to_json(F.struct("*")).alias("raw")) for v, sections in views.items() for s, df in sections.items()]
    job = uuid.uuid4().hex
    rows = reduce(DataFrame.unionByName, lines).where("raw is not null")
    rows.write.format("published_views").mode("append").options(path=path, job=job, head=json.dumps(head or {}), names=json.dumps(names)).save()
    return job


def current(path: str, job: str | None = None) -> dict:
    """The manifest of the job published last, or of one that is named."""
    store, root = store_of(path)
    job = job or store.open_input_stream(f"{root}/CURRENT").read().decode().strip()
    return json.loads(store.open_input_stream(f"{root}/manifests/{job}.json").read())


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """(view, section, file, rows, bytes, sha256) as published."""
    rows = [tuple(f.values()) for f in current(path)["files"]]
    return spark.createDataFrame(rows, FILE)


def read_view(spark: SparkSession, path: str, view: str, section: str, fields: str) -> DataFrame:
    """The records of a section, read by a schema; no rows if it has none."""
    m = current(path)
    if f"{section}_count" not in m["views"].get(view, {}):
        raise KeyError(f"no section {section!r} of a view {view!r}")
    found = [f"{path}/{f['file']}" for f in m["files"] if (f["view"], f["section"]) == (view, section)]
    return spark.read.schema(fields).json(found) if found else spark.createDataFrame([], fields)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem mismatch | missing | unlisted) of the job published last, from a pass over its files' bytes."""
    from weftgraph.sources.files import bundle_manifest, bundle_verify

    m = current(path)
    listed = manifest_files(spark, path).select("file", "sha256")
    if not m["files"]:
        return bundle_verify(listed, listed)
    found = bundle_manifest(spark, f"{path}/{m['job']}").withColumn("file", F.concat(F.lit(m["job"] + "/"), "file"))
    return bundle_verify(listed, found)


def drop_old(path: str) -> list[str]:
    """Remove all jobs but the one published last; gives their names. Not while another job writes."""
    from pyarrow import fs

    store, root = store_of(path)
    keep = current(path)["job"]
    old = [f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name not in (keep, "manifests")]
    for job in old:
        _remove(path, job)
    return sorted(old)
