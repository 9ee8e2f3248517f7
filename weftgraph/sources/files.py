"""Reading and writing records: one published JSON document, a tree of front-matter files, text files, vectors, bundles."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.runtime import stored
from weftgraph.sources import document
from weftgraph.schema import KnowledgeSet

#: Bytes that are copied at once.
COPY = 8 << 20

_ASSERT = "assertion struct<status: string, type: string, polarity: string, review: struct<status: string>, confidence: double, confidence_basis: string>"


def _flat_connections(c: DataFrame) -> DataFrame:
    return c.select(
        "id", "source", "relation", "target", F.col("value.amount").alias("amount"), F.col("value.unit").alias("unit"), F.col("assertion.status").alias("assertion_status"),
        F.col("assertion.type").alias("assertion_type"), F.col("assertion.polarity").alias("polarity"), F.col("assertion.review.status").alias("review"),
        F.col("provenance.asserted_by.type").alias("asserted_by"), F.col("assertion.confidence").alias("confidence"), F.col("assertion.confidence_basis").alias("confidence_basis"),
        F.col("lifecycle.reason").alias("reason"), F.col("lifecycle.replaced_by").alias("replaced_by"),
    )


#: Members that an export, and records in it, have to have; the forms of some.
REQUIRED = {
    "export": ["export_version", "schema_version", "content_hash", "source", "entity_count", "connection_count", "source_count", "entities", "connections", "sources"],
    "entities": ["id", "type", "name", "domain", "status", "definition", "provenance"],
    "connections": ["id", "type", "source", "relation", "assertion", "provenance"],
    "sources": ["id", "type", "citation"],
}
VERSION, HASH, DECIMAL = r"^[0-9]+\.[0-9]+\.[0-9]+$", r"^sha256:[0-9a-f]{64}$", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"

_ENTITY = "id string, type string, name string, domain string, subdomain string, status string, definition string, symbol string, unit string, equation string, deprecated_by string, aliases array<string>, provenance struct<source: string>"
_CONNECTION = f"id string, source string, relation string, target string, value struct<amount: string, unit: string>, {_ASSERT}, lifecycle struct<reason: string, replaced_by: string>, provenance struct<asserted_by: struct<type: string>>, evidence array<struct<type: string, stance: string, source_ref: string, locator: string>>"
_SOURCE = "id string, type string, title string, publisher string, year string, url string, lifecycle string"
_RELATION = "family string, inverse string, transitive boolean, symmetric boolean, domain array<string>, range array<string>, status string"


def load_export(spark: SparkSession, path: str, size: int = document.RANGE) -> tuple[KnowledgeSet, dict, DataFrame]:
    """A published document -> its tables, its top-level members, and its records as (section, place, key, raw).

    The document is read by byte ranges of `size` in parallel, however it is laid out; see sources/document.py. Its relation registry becomes `relations`.
    """
    head, records = document.read_document(spark, path, size)
    part = lambda c, fields: records.where(F.col("section") == c).select("key", F.from_json("raw", fields).alias("x")).select("key", "x.*")
    e = part("entities", _ENTITY).drop("key").withColumn("source_ref", F.col("provenance.source")).drop("provenance")
    c = part("connections", _CONNECTION)
    ev = c.select(F.col("id").alias("connection_id"), F.explode("evidence").alias("x")).select("connection_id", "x.source_ref", "x.type", "x.stance", "x.locator")
    s = part("sources", _SOURCE).drop("key").withColumn("year", F.substring("year", 1, 4).try_cast("int"))
    relations = part("relation_registry", _RELATION).withColumnRenamed("key", "name").fillna(False, ["transitive", "symmetric"])
    return KnowledgeSet(entities=e, connections=_flat_connections(c), sources=s, evidence=ev, relations=relations), head, records


def write_export(spark: SparkSession, head: dict, sections: dict[str, DataFrame], path: str) -> None:
    """One JSON document of a head and named tables of records (a column raw): records are written in parallel with what stands between them, then their files' bytes are put behind one another."""
    from pyarrow import fs

    between = b",\n    "
    for name, df in sections.items():
        df.select("raw").write.option("lineSep", between.decode()).text(f"{path}.parts/{name}")
    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with store.open_output_stream(at) as out:
        out.write(json.dumps(head, indent=2)[:-2].encode() if head else b"{")
        for i, name in enumerate(sections):
            out.write(f"{',' if i or head else ''}\n  {json.dumps(name)}: [".encode())
            held = b""  # what may stand behind the last record
            for f in sorted(store.get_file_info(fs.FileSelector(f"{at}.parts/{name}")), key=lambda f: f.path):
                if f.base_name.startswith("part-") and f.size:
                    if not held:
                        out.write(between[1:])
                    with store.open_input_stream(f.path) as parts:
                        while got := parts.read(COPY):
                            got = held + got
                            out.write(got[: -len(between)])
                            held = got[-len(between) :]
            out.write(b"\n  ]")
        out.write(b"\n}\n")


def export_contract(spark: SparkSession, head: dict, records: DataFrame) -> DataFrame:
    """(section, focus, rule): what an export breaks of its contract; no rows if nothing."""
    bad = [(m, "required") for m in REQUIRED["export"] if m not in head]
    bad += [(m, "version") for m in ("export_version", "schema_version") if m in head and not re.match(VERSION, str(head[m]))]
    if "content_hash" in head and not re.match(HASH, str(head["content_hash"])):
        bad.append(("content_hash", "hash"))
    of = F.parse_json("raw")
    got = lambda m: F.try_variant_get("v", f"$.{m}", "string")
    r = stored(records.where(F.col("section").isin("entities", "connections", "sources")).select("section", of.alias("v")).withColumn("focus", F.coalesce(got("id"), F.lit("?"))))
    found = {x.section: x.n for x in r.groupBy("section").agg(F.count("*").alias("n")).collect()}
    stated = {"entities": "entity_count", "connections": "connection_count", "sources": "source_count"}
    bad += [(m, "count") for c, m in stated.items() if m in head and head[m] != found.get(c, 0)]
    checks = [F.when((F.col("section") == c) & F.try_variant_get("v", f"$.{m}", "variant").isNull(), F.lit(f"required:{m}")) for c in stated for m in REQUIRED[c]]
    edge = F.col("section") == "connections"
    has = lambda m: (x := F.try_variant_get("v", f"$.{m}", "variant")).isNotNull() & ~F.is_variant_null(x)
    checks.append(F.when(edge & (has("target") == has("value")), F.lit("target xor value")))
    checks += [F.when(edge & got(f"value.{m}").isNotNull() & ~got(f"value.{m}").rlike(DECIMAL), F.lit(f"decimal:{m}")) for m in ("amount", "lowerBound", "upperBound")]
    each = r.select("section", "focus", F.explode(F.array_compact(F.array(*checks))).alias("rule"))
    twice = r.groupBy("section", "focus").agg(F.count("*").alias("n")).where("n > 1").select("section", "focus", F.lit("duplicate id").alias("rule"))
    top = spark.createDataFrame([("export", m, rule) for m, rule in bad], "section string, focus string, rule string")
    return each.unionByName(twice).unionByName(top)


def load_corpus(spark: SparkSession, root: str) -> DataFrame:
    """A tree of Markdown files with YAML front matter and of plain YAML -> (path, kind, json, dup_keys, error).

    Files are parsed in parallel, one row a file; one that cannot be parsed is an error row. `dup_keys` has the paths of repeated keys, such as
    `provenance.writer` or `items.2.name`. `json` is read further with from_json and a fixed schema, or flattened whatever its shape is (see blocks).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    files = files.where(F.col("path").rlike(r"\.(md|ya?ml)$"))

    def repeated(node, at=""):
        import yaml

        if isinstance(node, yaml.MappingNode):
            seen = set()
            for k, v in node.value:
                here = f"{at}{k.value if isinstance(k, yaml.ScalarNode) else '?'}"
                if here in seen:
                    yield here
                seen.add(here)
                yield from repeated(v, f"{here}.")
        elif isinstance(node, yaml.SequenceNode):
            for i, v in enumerate(node.value):
                yield from repeated(v, f"{at}{i}.")

    def parse(frames):
        import yaml

        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                kind = "entity" if path.endswith(".md") else "record"
                try:
                    text = bytes(content).decode("utf-8")
                    if kind == "entity":
                        if not text.startswith("---"):
                            raise ValueError("no front matter")
                        text = text.split("---", 2)[1]
                    loader = yaml.SafeLoader(text)
                    node = loader.get_single_node()
                    data = None if node is None else loader.construct_document(node)
                    if not isinstance(data, dict):
                        raise ValueError("not a mapping")
                    out.append((path, kind, json.dumps(data, default=str, sort_keys=True), sorted(set(repeated(node))), None))
                except Exception as e:  # any bad file is a row, not a failure
                    out.append((path, kind, None, [], str(e)[:300]))
            yield pd.DataFrame(out, columns=["path", "kind", "json", "dup_keys", "error"])

    return files.mapInPandas(parse, "path string, kind string, json string, dup_keys array<string>, error string")


def duplicate_yaml_keys(corpus: DataFrame) -> DataFrame:
    """(path, key): a row for each key path that a file repeats."""
    return corpus.select("path", F.explode("dup_keys").alias("key"))


def corpus_entities(corpus: DataFrame) -> DataFrame:
    return corpus.where("kind = 'entity' and json is not null").select("path", F.from_json("json", schema.ENTITIES).alias("x")).select("path", "x.*")


def blocks(corpus: DataFrame) -> DataFrame:
    """(path, block, key, value): every scalar of records of any shape, with its key path below the top-level key `block`; a level of nesting is one pass.

    Scalars at the top level have an empty key; a null has a null value; elements of lists have their number, from 0, in the path; empty lists and mappings have no rows.
    """
    spark = corpus.sparkSession
    level = corpus.where("json is not null").select("path", F.lit("").alias("at"), F.parse_json("json").alias("v"))
    out = None
    while True:
        inner = spark.sql("SELECT path, concat_ws('.', nullif(at, ''), coalesce(x.key, CAST(x.pos AS STRING))) AS at, x.value AS v FROM {level}, LATERAL variant_explode(v) AS x", level=level)
        kind = F.schema_of_variant("v")
        inner = stored(inner.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        here = inner.where("not nested").select("path", "at", F.col("v").cast("string").alias("value"))
        out = here if out is None else out.unionByName(here)
        level = inner.where("nested").drop("nested")
        if level.isEmpty():
            return out.select("path", F.split_part("at", F.lit("."), F.lit(1)).alias("block"), F.regexp_replace("at", r"^[^.]*\.?", "").alias("key"), "value")


TEXT_KINDS = {"txt": "text", "md": "markdown", "csv": "table", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html"}


def decoded(content: Column) -> Column:
    """UTF-8, and Latin-1 where it isn't valid."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def ingest_text_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, text, preview, sha256) of text-like files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.coalesce(*[F.when(F.lower("path").endswith("." + e), F.lit(k)) for e, k in TEXT_KINDS.items()])
    out = files.select("path", kind.alias("kind"), decoded(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256")).where("kind is not null")
    return out.withColumn("preview", F.substring("text", 1, 2000))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entity_id string, model string, placeholder boolean, dimensions int, vector array<float>, content string, content_hash string").json(path)


def write_embeddings(vectors: DataFrame, path: str, model: str) -> DataFrame:
    """JSONL vectors; gives the one-row record about them."""
    vectors.write.mode("overwrite").json(path)
    return vectors.agg(F.count("*").alias("count"), F.max(F.size("vector")).alias("dimensions")).select(F.lit(model).alias("model"), "*", F.lit("cosine").alias("metric"))


def tree_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest of a table, whatever its order: row hashes are summed up by prefix, and the 4096 prefixes are hashed in order.

    This is another digest than a serial one over all bytes; it changes when any row does and is made in parallel.
    """
    cols = list(columns or rows.columns)
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
    h = rows.select(F.sha2(text, 256).alias("h"))
    long = lambda a: F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)")
    part = h.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count("*").alias("n"), *[F.sum(long(a)).alias(f"s{a}") for a in (4, 19, 34, 49)])
    line = F.concat_ws(":", "p", *[F.col(c).cast("string") for c in ("n", "s4", "s19", "s34", "s49")])
    return part.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


#: What a file is by its name; the first pattern that fits counts, `other` if none does. A parameter: publishers add their names.
FILE_KINDS = {r"^knowledge\.json$": "export", r"^connections\..*\.json$": "connections-view", r"\.hash\.json$": "hash-pointer", r"\.jsonld$": "jsonld-projection", r"\.ttl$": "shacl-shapes"}
COUNTS = ["entity_count", "connection_count", "source_count"]


def bundle_manifest(spark: SparkSession, path: str, kinds: dict[str, str] = FILE_KINDS) -> DataFrame:
    """(file, sha256, bytes, kind, entity_count, connection_count, source_count) of every file of a bundle.

    file is the path from its root, so folders may hold equal names; counts are those that a .json file states, null elsewhere.
    Files without bytes have no row, as Spark's readers of files pass over them.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.escape(re.sub("^[a-z][a-z0-9+.-]*:/*", "/", path).rstrip("/"))
    name, kind = F.element_at(F.split("path", "/"), -1), F.lit("other")
    for pattern, k in reversed(kinds.items()):
        kind = F.when(name.rlike(pattern), F.lit(k)).otherwise(kind)
    counts = [F.when(name.endswith(".json"), F.get_json_object(decoded(F.col("content")), f"$.{c}").try_cast("long")).alias(c) for c in COUNTS]
    return f.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), kind.alias("kind"), *counts)


def bundle_id(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), "\n"), 256), 1, 12).alias("bundle_id"))


def bundle_verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(file, problem mismatch | missing | unlisted)."""
    a, b = manifest.select("file", F.col("sha256").alias("was")), found.select(F.col("file").alias("f"), F.col("sha256").alias("now"))
    j = a.join(b, F.col("file") == F.col("f"), "full")
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("file").isNull(), "unlisted").when(F.col("was") != F.col("now"), "mismatch")
    return j.select(F.coalesce("file", "f").alias("file"), problem.alias("problem")).where("problem is not null")


def audit_read(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The last entries of a JSONL audit log; unreadable lines are kept as they are."""
    log = spark.read.schema("timestamp string, event string, doc_id string, detail string, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return log.orderBy(F.desc_nulls_last("timestamp"), "event", "doc_id").limit(last)
