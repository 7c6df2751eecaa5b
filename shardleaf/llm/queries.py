"""Registered queries of this subpackage, each over its whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, lookalikes, neighbours, packing, privacy, quantiles, readability, splitting


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, sf_dir, "search_results"), "result_id", "body", ("heading_path",))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 1").select("result_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_rows(_table(spark, sf_dir, "search_results"), "result_id", _table(spark, sf_dir, "patterns"), _table(spark, sf_dir, "chunks"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct title and path as it is written, with its one form."""
    tables = [_table(spark, sf_dir, t).select(c) for t, c in (("search_results", "title"), ("search_results", "source_file"), ("chunks", "title"), ("patterns", "source_file"))]
    texts = tables[0].toDF("written")
    for t in tables[1:]:
        texts = texts.union(t)
    texts = texts.where("written IS NOT NULL").distinct()
    return texts.withColumn("form", lookalikes.visual_form("written", lookalikes.learn(texts)))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fields of every call, each call once, with placeholders in place of personal data."""
    calls = _table(spark, sf_dir, "call_contexts").select("call_id", "command", "transcript_tail").dropDuplicates(["call_id"])
    fields = F.explode(F.map_from_arrays(F.array(F.lit("command"), F.lit("transcript_tail")), F.array("command", "transcript_tail")))
    texts = calls.select("call_id", fields.alias("field_name", "text")).where("text <> ''").checkpoint()
    return privacy.redact_texts(texts, "text").drop("text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_redacted(spark, sf_dir).select("call_id", "field_name", F.explode("kinds").alias("kind"))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable durations of PreToolUse records, each record once: ``agent, day_utc, duration_ms``."""
    agent = F.lower(F.regexp_replace("agent", r"(?U)^\s+|\s+$", ""))
    day = F.date_format(F.to_utc_timestamp(F.try_to_timestamp("ts"), F.current_timezone()), "yyyy-MM-dd")
    rows = _table(spark, sf_dir, "trace_records").where("event = 'PreToolUse' AND duration_ms >= 0")
    rows = rows.select("trace_id", agent.alias("agent"), day.alias("day_utc"), "duration_ms")
    return rows.where("agent <> '' AND day_utc IS NOT NULL").distinct().drop("trace_id")


def p4_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per agent and day, read from the daily sketches."""
    daily = quantiles.build_sketches(_durations(spark, sf_dir), ["agent", "day_utc"], "duration_ms")
    return quantiles.read_percentiles(daily, ["agent", "day_utc"], [5, 50, 90, 95, 99])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent-days whose percentile is far above the agent's own; the agent's comes from its merged daily sketches."""
    daily = quantiles.build_sketches(_durations(spark, sf_dir), ["agent", "day_utc"], "duration_ms").checkpoint()
    day = quantiles.read_percentiles(daily, ["agent", "day_utc"], [50, 95]).where("n >= 20")
    every = quantiles.read_percentiles(quantiles.merge_sketches(daily, ["agent"]), ["agent"], [50, 95])
    both = day.join(every.select("agent", "pct", F.col("value").alias("usual")), ["agent", "pct"])
    return both.where(F.col("value") >= 1.75 * F.col("usual")).select("agent", "day_utc", "pct")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", packing.byte_tokens("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in more than one container: counted over the whole assignment, the packed remainders too."""
    held = p6_containers(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("container").alias("containers"))
    return held.where("containers > 1").select("doc_id")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embed_responses").select("response_id", "model", F.get("embeddings", F.lit(0)).alias("vector"))
    return neighbours.similar_vectors(rows, "response_id", "model", "vector")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = p5_neighbours(spark, sf_dir).where("similarity >= 0.85")
    return close.select(F.least("response_id", "neighbour").alias("response_a"), F.greatest("response_id", "neighbour").alias("response_b")).distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that it discloses, with the share of the item's words that it holds."""
    return leakage.find_leaks(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of prose, score and grade of every English document."""
    ranker = readability.fit(_table(spark, sf_dir, "graded_samples"), "text", "grade")
    english = _table(spark, sf_dir, "documents").where(F.lower(F.trim("lang")).rlike(r"^(?:en|eng|english)(?:[-_].*)?$"))
    return readability.reading_levels(english, "doc_id", "text", ranker)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).select("doc_id", "grade")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_forms, p3_found, p3_redacted, p4_found, p4_daily_percentiles, p5_found, p5_neighbours, p6_found, p6_containers, p7_found, p7_leaks, p8_found, p8_levels)
}

ORACLE_SQL: dict[str, str] = {
    "p1_found": "SELECT result_id FROM search_results WHERE octet_length(encode(body)) > 1600",
    "p6_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 4096",
}
