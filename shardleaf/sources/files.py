"""Folders of markdown files and logs of JSON lines, as tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardleaf.functions.ignore import ignored

TRACE_SCHEMA = (
    "event string, schema_version int, ts string, session_id string, agent string, "
    "call_context struct<tool_name: string, command_head: string, command_full: string, file_path: string, description: string, inferred_languages: array<string>, transcript_tail: string>, query string, "
    "candidates array<struct<chunk_id: string, source_file: string, is_universal: boolean, has_predicate: boolean, has_language_declaration: boolean, score_fts_fallback: double, score_fts_structural: double, "
    "score_vector: double, score_combined: double, predicate_outcome: string, above_threshold: boolean, deduped: boolean>>, injected array<string>, "
    "config struct<hybrid: boolean, top_k: bigint, min_relevance: double, min_relevance_universal: double, embedder_model: string>, ollama struct<embedding_succeeded: boolean, embedding_dims: bigint>, duration_ms bigint, "
    "phases struct<query_extract_ms: bigint, search_fts_ms: bigint, search_vector_ms: bigint, embedding_ms: bigint, predicate_filter_ms: bigint, dedup_ms: bigint>"
)
MARKDOWN = "*.{md,markdown}"


def _relative(path, root: str):
    """A file's path below ``root``, as written: the reader escapes it as an address."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, root.rstrip("/") + "/", -1)


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """``source_file`` of all markdown files; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", MARKDOWN).load(root)
    return files.select(_relative(F.col("_metadata.file_path"), root).alias("source_file"))


def markdown_files(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """``source_file`` (below root), ``text`` and ``modified_at`` of the markdown files that the rules do not exclude, each whole."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", MARKDOWN).load(root)
    rows = files.select(_relative(F.col("_metadata.file_path"), root).alias("source_file"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified_at"))
    return rows.where(~ignored(F.col("source_file"), list(rules)))


def scan_state(spark: SparkSession, root: str, rules: list[str] = ()) -> str:
    """``missing``, ``empty`` (no markdown), ``ignored`` (none that the rules leave) or ``populated``."""
    try:
        paths = _paths(spark, root)
        if paths.isEmpty():
            return "empty"
    except AnalysisException:
        return "missing"
    return "ignored" if paths.where(~ignored(F.col("source_file"), list(rules))).isEmpty() else "populated"


def trace_log(spark: SparkSession, root: str) -> DataFrame:
    """Records of all ``.jsonl`` and ``.jsonl.gz`` files below root, with ``file_name`` and ``modified_at``; lines that are no record are left out.

    Where a file stands there plain and compressed, the plain one counts.
    """
    schema = TRACE_SCHEMA + ", _broken string"

    def read(pattern: str) -> DataFrame:
        rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
        name = F.regexp_replace("_metadata.file_path", r"\.gz$", "")
        return rows.select("*", name.alias("file_name"), F.col("_metadata.file_modification_time").alias("modified_at"))

    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    plain = plain.select(F.col("_metadata.file_path").alias("file_name"))
    every = read("*.jsonl").unionByName(read("*.jsonl.gz").join(plain, "file_name", "left_anti"))
    return every.where("_broken IS NULL AND event IS NOT NULL").drop("_broken")


def append_traces(records: DataFrame, root: str, day: str = "day", compression: str = "none") -> None:
    """Adds records to a log of JSON lines, one folder a day: retention then drops whole folders."""
    records.write.mode("append").partitionBy(day).option("compression", compression).json(root)
