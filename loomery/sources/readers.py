"""Readers of document trees, JSON lines, manifests, logs and streams into common schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.operators.positions import numbered_lines

try:
    import yaml
except ImportError:  # without it, trees are read as JSON, which every YAML reader accepts too
    yaml = None

INGEST = "entity_type string, entity_id string, content string, repo_id string, capability string, trust_score double, metadata map<string,string>"
EVENT = "session_id string, user_id string, query string, intent string, entity string, confidence double, tools_used array<string>, response string, escalated boolean, latency_ms double, model string, tokens_in long, tokens_out long, cost_usd double, timestamp double"
FEEDBACK = "session_id string, message_id string, rating int, comment string, tags array<string>, timestamp double"
TOPICS = {"query_completed": EVENT, "feedback": FEEDBACK}


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, doc: the document as JSON; {} for what is malformed or no mapping."""
    for x in batches:
        docs = []
        for body in x.column("content").to_pylist():
            try:
                got = yaml.safe_load(body) if yaml else json.loads(body)
            except Exception:  # noqa: BLE001  any document may be broken
                got = None
            docs.append(json.dumps(got if isinstance(got, dict) else {}, default=str))
        yield pa.RecordBatch.from_arrays([x.column("path"), pa.array(docs, pa.string())], ["path", "doc"])


def _underscored(spark: SparkSession, root: str, block: int = 5000) -> DataFrame:
    """path, content of the small _*.yaml files (one a table), which Spark's own listing passes over as hidden. The driver reads
    them through Hadoop's file system, so any store works, and hands them on in blocks."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files, blocks, rows = fs.listFiles(at, True), [], []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("_") and path.getName().endswith(".yaml"):
            stream = fs.open(path)
            try:
                rows.append((path.toString(), bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            finally:
                stream.close()
        if len(rows) >= block:
            blocks.append(spark.createDataFrame(rows, "path string, content binary"))
            rows = []
    return reduce(DataFrame.unionByName, [*blocks, spark.createDataFrame(rows, "path string, content binary")])


def yaml_tree(spark: SparkSession, root: str, glob: str = "*.yaml") -> DataFrame:
    """path, repo, pillar, folder, file, doc (JSON) for every document under root/{repo}/pillar_*/..."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")
    files = files.unionByName(_underscored(spark, root))
    docs = files.mapInArrow(_loaded, "path string, doc string")
    part = lambda p: F.regexp_extract("path", p, 1)
    return docs.select("path", part(r"([^/]+)/pillar_[^/]+/").alias("repo"), part(r"/(pillar_[^/]+)/").alias("pillar"), part(r"([^/]+)/[^/]+$").alias("folder"), part(r"([^/]+)\.ya?ml$").alias("file"), "doc")


def _field(doc: str, path: str) -> Column:
    return F.get_json_object(doc, f"$.{path}")


def _list(doc: str, path: str) -> Column:
    return F.coalesce(F.from_json(_field(doc, path), "array<string>"), F.array().cast("array<string>"))


def api_documents(tree: DataFrame) -> DataFrame:
    """One row for an API folder of overview, tool_agent_tags, examples and index files."""
    own = tree.filter(F.col("path").contains("/apis/"))
    wide = own.groupBy("repo", "folder").pivot("file", ["overview", "tool_agent_tags", "examples", "index"]).agg(F.first("doc"))
    aliases, words = _list("overview", "retrieval_hints.aliases"), _list("overview", "retrieval_hints.keywords")
    return wide.select(
        F.coalesce(_field("overview", "api.id"), F.col("folder")).alias("doc_id"), F.lit("api").alias("doc_type"), "repo", _field("overview", "classification.domain").alias("domain"),
        _field("overview", "retrieval_hints.canonical_summary").alias("summary"), F.array_distinct(F.concat(F.array_compact(F.array(_field("tool_agent_tags", "intent_tags.primary"))), _list("tool_agent_tags", "intent_tags.secondary"))).alias("intent_tags"),
        words.alias("keywords"), aliases.alias("aliases"), _field("tool_agent_tags", "tool_assignment.tool_candidate").alias("tool_candidate"), _field("tool_agent_tags", "tool_assignment.read_write_type").alias("read_write_type"),
        _field("tool_agent_tags", "tool_assignment.risk_level").alias("risk_level"), _field("overview", "api.method").alias("method"), _field("overview", "api.path").alias("path"),
        F.coalesce(_field("index", "training_ready").cast("boolean"), F.lit(False)).alias("training_ready"),
        F.concat_ws(" | ", _field("overview", "retrieval_hints.canonical_summary"), F.array_join(aliases, " "), F.array_join(words, " ")).alias("text_for_embedding"),
    )


def table_documents(tree: DataFrame) -> DataFrame:
    """One row for a table folder of _meta and columns files."""
    own = tree.filter(F.col("path").contains("/tables/"))
    wide = own.groupBy("repo", "folder").pivot("file", ["_meta", "columns"]).agg(F.first("doc"))
    columns = F.coalesce(F.transform(F.from_json(_field("columns", "columns"), "array<struct<name:string,type:string>>"), lambda c: c["name"]), F.array().cast("array<string>"))
    return wide.select(F.coalesce(_field("_meta", "table"), F.col("folder")).alias("doc_id"), F.lit("table").alias("doc_type"), "repo", _field("_meta", "domain").alias("domain"), _field("_meta", "description").alias("summary"), columns.alias("columns"), F.concat_ws(" | ", _field("_meta", "description"), F.array_join(columns, " ")).alias("text_for_embedding"))


#: document kind: (pillar prefix, capability, trust) of the twelve readers
KINDS = {
    "schema": ("pillar_1", "retrieval", 0.9), "api": ("pillar_3", "retrieval", 0.9), "page": ("pillar_4", "page_intel", 0.8), "module": ("pillar_5", "code_intel", 0.8), "action": ("pillar_6", "action", 0.9), "workflow": ("pillar_7", "workflow", 0.9),
    "negative_routing": ("pillar_8", "routing", 0.7), "hub": ("pillar_hub", "retrieval", 0.8), "agent": ("pillar_9", "routing", 0.7), "skill": ("pillar_10", "routing", 0.7), "tool": ("pillar_11", "routing", 0.7), "faq": ("pillar_12", "retrieval", 0.7),
}


def documents(tree: DataFrame, kind: str) -> DataFrame:
    """The ingest schema for one kind: a document a file; its id is the folder, and the file within it. Stubs are left out."""
    prefix, capability, trust = KINDS[kind]
    stub = (F.get_json_object("doc", "$._status") == "stub") | (F.get_json_object("doc", "$._tier") == "stub")
    own = tree.filter(F.col("pillar").rlike(f"^{prefix}(_|$)") & ~F.coalesce(stub, F.lit(False)))
    return own.select(F.lit(kind).alias("entity_type"), F.concat_ws(":", "folder", "file").alias("entity_id"), F.col("doc").alias("content"), F.col("repo").alias("repo_id"), F.lit(capability).alias("capability"), F.lit(trust).alias("trust_score"), F.create_map(F.lit("path"), F.col("path")).alias("metadata"))


#: registry file: (kind of its records, key of their list), and the fields that may name a record
REGISTRIES = {
    "entity_dictionary": ("entity_def", "entities"), "intent_taxonomy": ("intent_def", "intents"), "agent_registry": ("agent_def", "agents"),
    "api_registry": ("api_registry", "apis"), "tool_registry": ("tool_registry", "tools"),
}
RECORD_IDS = ["api_id", "tool_id", "agent_id", "entity_id", "id"]


def registry_documents(tree: DataFrame) -> DataFrame:
    """The ingest schema for registry files: a document a record that has a name, made of its plain fields in order ("field: value", empty,
    false and zero values and nested ones left out); a file without a list of records is one document of its own plain fields."""
    kinds = F.create_map(*[F.lit(x) for name, (kind, _) in REGISTRIES.items() for x in (name, kind)])
    own = tree.filter(F.col("file").isin(list(REGISTRIES))).select("repo", "file", "doc", F.element_at(kinds, F.col("file")).alias("entity_type"))
    lists = reduce(lambda c, r: c.when(F.col("file") == r[0], F.get_json_object("doc", f"$.{r[1][1]}")), REGISTRIES.items(), F.when(F.lit(False), F.lit("")))
    own = own.withColumn("records", F.from_json(lists, "array<map<string,string>>"))
    listed = F.coalesce(F.size("records") > 0, F.lit(False))
    told = lambda m, hidden: F.array_join(F.transform(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "false", "0", "0.0") & ~e["value"].rlike(r"^[\[{]") & ~(F.lit(hidden) & e["key"].startswith("_"))), lambda e: F.concat_ws(": ", e["key"], e["value"])), " | ")
    each = own.filter(listed).select("repo", "file", "entity_type", F.explode("records").alias("r"))
    name = F.coalesce(*[F.nullif(F.element_at("r", k), F.lit("")) for k in RECORD_IDS])
    records = each.select("repo", "file", "entity_type", name.alias("name"), told(F.col("r"), False).alias("plain"), F.coalesce(F.element_at("r", "domain"), F.lit("")).alias("domain")).filter("name is not null")
    files = own.filter(~listed).select("repo", "file", "entity_type", F.col("file").alias("name"), told(F.from_json("doc", "map<string,string>"), True).alias("plain"), F.lit("").alias("domain"))
    head = F.when(F.col("name") == F.col("file"), F.concat(F.lit("["), "repo", F.lit("] "), "file", F.lit(": "))).otherwise(F.concat(F.lit("["), "repo", F.lit(":"), "file", F.lit("] ")))
    out = records.unionByName(files)
    return out.select("entity_type", F.concat_ws(":", F.lit("registry"), "repo", "name").alias("entity_id"), F.concat(head, "plain").alias("content"), F.col("repo").alias("repo_id"), F.lit("retrieval").alias("capability"), F.lit(0.8).alias("trust_score"), F.create_map(F.lit("file"), F.col("file"), F.lit("domain"), F.col("domain")).alias("metadata"))


def read_all(tree: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [documents(tree, k) for k in kinds or KINDS])


def fill_missing(main: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """main with its null or empty columns filled from side; what main has is never overwritten."""
    s = side.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = main.join(s, key, "left")
    return x.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def manifest(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def verify(now: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """key, state against the saved manifest: ok, altered, missing or extra."""
    x = now.select(key, F.col("digest").alias("a")).join(saved.select(key, F.col("digest").alias("b")), key, "full")
    return x.select(key, F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") == F.col("b"), "ok").otherwise("altered").alias("state"))


def jsonl(spark: SparkSession, path: str, schema: str, label: str | None = None, limit: int | None = None) -> DataFrame:
    out = spark.read.schema(schema).json(path)
    out = out.filter(F.col(label).isNotNull()) if label else out
    return out.limit(limit) if limit else out


def with_provenance(spark: SparkSession, path: str, schema: str, source: str, repo: str) -> DataFrame:
    """JSON lines with _source, _source_file, _source_line (from 1) and _repo; files may be read in any number of blocks."""
    lines = numbered_lines(spark.read.text(path)).withColumn("_row", F.from_json("value", schema))
    named = F.element_at(F.split("_file", "/"), -1)
    return lines.select("_row.*", F.lit(source).alias("_source"), named.alias("_source_file"), F.col("_line").alias("_source_line"), F.lit(repo).alias("_repo"))


def merged(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def seeds_from_cases(cases: DataFrame, existing: DataFrame) -> DataFrame:
    """query, expected_tool of the golden cases that are not there yet."""
    x = cases.select(F.explode("queries").alias("query"), "expected_tool").dropDuplicates(["query", "expected_tool"])
    return x.join(existing.select("query", "expected_tool"), ["query", "expected_tool"], "left_anti")


def faq(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Spreadsheet rows as documents of trust 0.7; answers under 20 words are dropped."""
    from loomery.functions.text import clean_faq

    return df.select(question, clean_faq(F.col(answer)).alias("content"), F.lit(0.7).alias("trust_score")).filter("content is not null")


def events(spark: SparkSession, topic: str, options: dict[str, str] | None = None, path: str | None = None, offsets: str = "earliest") -> DataFrame:
    """A stream of one topic: from the broker the options name, or from a folder of JSON lines with the same fields."""
    if path:
        return spark.readStream.schema(TOPICS[topic]).json(path)
    raw = spark.readStream.format("kafka").options(subscribe=topic, startingOffsets=offsets, **(options or {})).load()
    return raw.select(F.from_json(F.col("value").cast("string"), TOPICS[topic]).alias("v")).select("v.*")


def messages(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("msg_type") == kind)


def changed_files(listing: DataFrame, known: DataFrame, key: str = "path", tag: str = "etag") -> DataFrame:
    """Objects that are new or whose tag changed."""
    return listing.join(known.select(key, F.col(tag).alias("_t")), key, "left").filter(F.col("_t").isNull() | (F.col("_t") != F.col(tag))).drop("_t")


def watch(spark: SparkSession, path: str, schema: str | T.StructType, key: str, at: str, quiet: str = "5 seconds") -> DataFrame:
    """New files of a folder as a stream, repeated events of a key within the quiet time dropped."""
    return spark.readStream.schema(schema).json(path).withWatermark(at, quiet).dropDuplicatesWithinWatermark([key])


def audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, missing_in: rows that one copy of a graph has and the other has not."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("missing_in", F.lit("b"))
    return left.unionByName(b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("missing_in", F.lit("a")))
