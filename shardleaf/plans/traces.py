"""Queries on the log of decisions: sessions with resets, newest records, retention, capped results."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardleaf.operators import retrieval
from shardleaf.registry import query
from shardleaf.sources.tables import table
from shardleaf.streaming import sessions


@query(
    """WITH t AS (SELECT DISTINCT trace_id, session_id, written_at, event, injected FROM trace_records),
    e AS (SELECT *, sum(CASE WHEN event IN ('SessionStart', 'PostCompact') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY written_at, trace_id) AS epoch FROM t),
    i AS (SELECT session_id, CAST(epoch AS BIGINT) AS epoch, trace_id, written_at, unnest(injected) AS chunk_id FROM e)
    SELECT session_id, epoch, chunk_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch, chunk_id ORDER BY written_at, trace_id) AS n FROM i) WHERE n = 1"""
)
def win6_first_since_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call that first injected each chunk since its session last started anew or was compacted."""
    rows = table(spark, sf_dir, "trace_records").select("trace_id", "session_id", "written_at", "event", "injected").dropDuplicates(["trace_id"])
    placed = sessions.with_epochs(rows, "session_id", "written_at", ["written_at", "trace_id"], F.col("event").isin("SessionStart", "PostCompact"))
    shown = placed.select("session_id", "epoch", "trace_id", "written_at", F.explode("injected").alias("chunk_id"))
    return sessions.first_in_session(shown, ["session_id", "epoch"], "chunk_id", ["written_at", "trace_id"]).select("session_id", "epoch", "chunk_id", "trace_id")


@query("SELECT trace_id, session_id, event FROM (SELECT DISTINCT trace_id, session_id, event, written_at FROM trace_records WHERE event = 'PreToolUse') ORDER BY written_at DESC, trace_id DESC LIMIT 20")
def top6_recent_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest records of calls: a top-k report."""
    rows = table(spark, sf_dir, "trace_records").where("event = 'PreToolUse'").select("trace_id", "session_id", "event", "written_at").distinct()
    return rows.orderBy(F.desc("written_at"), F.desc("trace_id")).limit(20).drop("written_at")


@query("SELECT DISTINCT trace_id FROM trace_records WHERE written_at > (SELECT max(written_at) FROM trace_records) - INTERVAL 7 DAY")
def snk8_retained_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records younger than seven days, counted from the newest."""
    rows = table(spark, sf_dir, "trace_records").select("trace_id", "written_at")
    newest = F.broadcast(rows.agg(F.max("written_at").alias("newest")))  # one row
    return rows.join(newest, F.col("written_at") > F.col("newest") - F.expr("INTERVAL 7 DAYS")).select("trace_id").distinct()


@query("SELECT event, count(*) AS records, count(DISTINCT session_id) AS sessions FROM (SELECT DISTINCT trace_id, event, session_id FROM trace_records) GROUP BY event")
def str1_records_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and sessions of each kind of event, in two steps: a hot session is one row before sessions are counted."""
    per = table(spark, sf_dir, "trace_records").select("trace_id", "event", "session_id").distinct().groupBy("event", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("event").agg(F.sum("n").alias("records"), F.count("session_id").alias("sessions"))


@query(
    "SELECT result_id, call_id, is_universal FROM (SELECT *, row_number() OVER (PARTITION BY call_id, is_universal ORDER BY score DESC, result_id) AS n FROM search_results "
    "WHERE score >= CASE WHEN is_universal THEN 0.2 ELSE 0.45 END) WHERE is_universal OR n <= 3"
)
def ret8_capped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results above their threshold: all pinned ones, the best three others of each call."""
    rows = table(spark, sf_dir, "search_results").select("result_id", "call_id", "is_universal", "score").where(retrieval.passes_threshold(F.col("score"), F.col("is_universal"), 0.45, 0.2))
    place = F.row_number().over(Window.partitionBy("call_id", "is_universal").orderBy(F.desc("score"), "result_id"))
    return rows.withColumn("n", place).where("is_universal OR n <= 3").select("result_id", "call_id", "is_universal")


@query(
    "SELECT query_id, vec_id, gated_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS gated_rank FROM (SELECT q.vec_id AS query_id, c.vec_id, c.label AS cl, q.label AS ql, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 30 AND cl = ql) WHERE gated_rank <= 10"
)
def ret4c_gated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of the query's own label among its thirty nearest: the gate comes after the first rank."""
    rows = table(spark, sf_dir, "embeddings")
    near = retrieval.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 30)
    own = near.join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(rows.select("vec_id", "label"), "vec_id").where("label = ql")
    return own.withColumn("gated_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("gated_rank <= 10").select("query_id", "vec_id", "gated_rank")


@query(
    """WITH t AS (SELECT DISTINCT trace_id, session_id, written_at, event, injected, candidates FROM trace_records),
    e AS (SELECT *, sum(CASE WHEN event IN ('SessionStart', 'PostCompact') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY written_at, trace_id) AS epoch FROM t),
    c AS (SELECT session_id, epoch, trace_id, written_at, unnest(candidates) AS c FROM e),
    s AS (SELECT DISTINCT session_id, CAST(epoch AS BIGINT) AS epoch, trace_id, written_at, c.chunk_id AS chunk_id, c.is_universal AS pinned FROM c WHERE coalesce(c.predicate_outcome, '') NOT IN ('suppressed', 'rejected') AND c.above_threshold)
    SELECT session_id, epoch, chunk_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch, chunk_id ORDER BY written_at, trace_id) AS n FROM s) WHERE n = 1 OR pinned"""
)
def str2_shown_with_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are shown: once since the session's reset, pinned ones always. What a condition suppresses is taken out before, so it never counts as seen."""
    rows = table(spark, sf_dir, "trace_records").select("trace_id", "session_id", "written_at", "event", "candidates").dropDuplicates(["trace_id"])
    placed = sessions.with_epochs(rows, "session_id", "written_at", ["written_at", "trace_id"], F.col("event").isin("SessionStart", "PostCompact"))
    each = placed.select("session_id", "epoch", "trace_id", "written_at", F.explode("candidates").alias("c"))
    passed = each.where(~F.coalesce(F.col("c.predicate_outcome"), F.lit("")).isin("suppressed", "rejected") & F.col("c.above_threshold"))
    shown = passed.select("session_id", "epoch", "trace_id", "written_at", "c.chunk_id", F.col("c.is_universal").alias("pinned")).distinct()
    kept = sessions.first_in_session(shown, ["session_id", "epoch"], "chunk_id", ["written_at", "trace_id"], always=F.col("pinned"))
    return kept.select("session_id", "epoch", "chunk_id", "trace_id")


@query(
    """WITH t AS (SELECT DISTINCT ON (trace_id) trace_id, lower(trim(agent)) AS agent, CASE WHEN config.hybrid AND NOT coalesce(ollama.embedding_succeeded, false) THEN 'degraded' WHEN len(injected) > 0 THEN 'surfaced' ELSE 'not_present' END AS state FROM trace_records WHERE event = 'PreToolUse')
    SELECT agent, count(*) FILTER (state = 'surfaced') AS surfaced, count(*) FILTER (state = 'not_present') AS not_present, count(*) FILTER (state = 'degraded') AS degraded,
    CASE WHEN count(*) FILTER (state = 'degraded') = 0 THEN round(count(*) FILTER (state = 'surfaced') / count(*), 6) ELSE -1 END AS ratio FROM t GROUP BY agent"""
)
def agg13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often calls of each agent surfaced anything; there is no ratio (-1) where any of them ran without the vectors it should have had."""
    rows = table(spark, sf_dir, "trace_records").where("event = 'PreToolUse'").dropDuplicates(["trace_id"])
    degraded = F.coalesce(F.col("config.hybrid"), F.lit(False)) & ~F.coalesce(F.col("ollama.embedding_succeeded"), F.lit(False))
    state = F.when(degraded, "degraded").when(F.size("injected") > 0, "surfaced").otherwise("not_present")
    counts = rows.groupBy(F.lower(F.trim("agent")).alias("agent")).agg(*[F.count_if(state == s).alias(s) for s in ("surfaced", "not_present", "degraded")], F.count(F.lit(1)).alias("n"))
    return counts.select("agent", "surfaced", "not_present", "degraded", F.when(F.col("degraded") == 0, F.round(F.col("surfaced") / F.col("n"), 6)).otherwise(-1.0).alias("ratio"))
