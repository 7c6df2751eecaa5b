"""Queries on the state of an index: rows to write, rows to drop, what is declared."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardleaf.functions import languages
from shardleaf.functions import text as T
from shardleaf.functions.ignore import ignored
from shardleaf.functions.stem import stems
from shardleaf.operators import index
from shardleaf.registry import query
from shardleaf.sources.tables import table

IGNORE = ["# working notes", "core/", "*-00001?.md", "!core/*-limits-*"]
IGNORED_SQL = r"CASE WHEN regexp_matches(source_file, '^core/[^/]*-limits-[^/]*$') THEN false WHEN regexp_matches(source_file, '(^|/)[^/]*-00001[^/]\.md$') THEN true ELSE regexp_matches(source_file, '^(.*/)?core/') END"

_PATTERN_SQL = r"""SELECT source_file, CASE WHEN t <> '' THEN t ELSE regexp_replace(regexp_extract(source_file, '[^/]*$'), '(.)\.[^.]*$', '\1') END AS title, md5(text) AS content_hash
FROM (SELECT *, trim(regexp_extract(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^# (.*)$', 1)) AS t FROM documents)"""


@query(_PATTERN_SQL)
def doc12_pattern_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pattern_rows(table(spark, sf_dir, "documents"), "source_file", "text").select("source_file", "title", "content_hash")


@query(_PATTERN_SQL)
def snk2_upserted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a state in which English notes were drafts, after the notes are written over them: all are then as new."""
    now = table(spark, sf_dir, "documents").select("source_file", "text", F.coalesce(F.lower("lang").startswith("en"), F.lit(False)))
    stale = now.toDF("source_file", "text", "late").withColumn("text", F.when(F.col("late"), F.concat(F.lit("# Draft\n"), F.substring("text", 1, 40))).otherwise(F.col("text")))
    written = now.toDF("source_file", "text", "late").where("late")
    old, new = (index.pattern_rows(df, "source_file", "text").select("source_file", "title", "content_hash") for df in (stale, written))
    return index.upsert(old, new, "source_file")


@query(f"SELECT id, source_file FROM chunks WHERE NOT ({IGNORED_SQL})")
def snk4_without_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that stay once the sources that are now ignored are deleted."""
    gone = table(spark, sf_dir, "patterns").where(ignored(F.col("source_file"), IGNORE))
    return index.delete_sources(table(spark, sf_dir, "chunks").select("id", "source_file"), gone, "source_file")


@query(f"SELECT source_file, {IGNORED_SQL} AS ignored FROM patterns")
def ign1_ignored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patterns").select("source_file", ignored(F.col("source_file"), IGNORE).alias("ignored"))


_FRONT_SQL = r"regexp_extract(regexp_replace(text, '\r\n?', chr(10), 'g'), '\A---\n((?s:.*?))\n---', 1)"


@query(
    rf"""SELECT doc_id, unnest(list_filter(list_transform(CASE WHEN flow <> '' THEN string_split(flow, ',') ELSE list_transform(string_split(block, chr(10)), lambda x: regexp_replace(x, '^[ \t]*-', '')) END, lambda x: trim(trim(x), '"''')), lambda x: x <> '')) AS tag
    FROM (SELECT doc_id, regexp_extract(f, 'tags:[ \t]*\[([^\]\n]*)\]', 1) AS flow, regexp_extract(f, 'tags:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|$))+)', 1) AS block FROM (SELECT doc_id, {_FRONT_SQL} AS f FROM documents))"""
)
def doc7_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tag_list(T.front_matter(F.col("text")))).alias("tag"))


@query("SELECT id, coalesce(title, '') || chr(10) || coalesce(tags, '') || chr(10) || coalesce(body, '') AS embedded FROM chunks")
def ret12_embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", index.embedding_text(F.col("title"), F.col("tags"), F.col("body")).alias("embedded"))


VECTORS_SQL = """SELECT chunk_id, model, response_id, v FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, model ORDER BY received_at DESC, response_id DESC) AS n FROM
(SELECT DISTINCT response_id, chunk_id, model, received_at, embeddings[1] AS v FROM embed_responses) WHERE len(v) > 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0) WHERE n = 1"""


def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, model, response_id, vector``: the newest usable answer for each chunk and model."""
    rows = table(spark, sf_dir, "embed_responses").select("response_id", "chunk_id", "model", "received_at", F.get("embeddings", F.lit(0)).alias("vector"))
    usable = rows.where((F.size("vector") > 0) & F.exists("vector", lambda x: x != 0)).dropDuplicates(["response_id"])
    newest = usable.groupBy("chunk_id", "model").agg(F.max_by(F.struct("response_id", "vector"), F.struct("received_at", "response_id")).alias("a"))
    return newest.select("chunk_id", "model", "a.response_id", "a.vector")


@query(f"WITH m AS (SELECT DISTINCT model FROM ({VECTORS_SQL})) SELECT c.id, m.model, coalesce(v.response_id, 0) AS response_id FROM chunks c CROSS JOIN m LEFT JOIN ({VECTORS_SQL}) v ON v.chunk_id = c.id AND v.model = m.model")
def jn2_chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that holds the current vector of each chunk in each model; 0 where it is still to be embedded."""
    vectors = current_vectors(spark, sf_dir).select("chunk_id", "model", "response_id")
    models = vectors.groupBy().agg(F.collect_set("model").alias("models"))  # one row: a table has few models
    wanted = table(spark, sf_dir, "chunks").select("id").join(F.broadcast(models)).select("id", F.explode("models").alias("model"))
    return wanted.join(vectors.withColumnRenamed("chunk_id", "id"), ["id", "model"], "left").select("id", "model", F.coalesce("response_id", F.lit(0)).alias("response_id"))


@query()
def ret1_stemmed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for each stem of their bodies' words: each distinct word is stemmed once."""
    words = table(spark, sf_dir, "chunks").select("id", F.explode(T.split_into_words(F.col("body"))).alias("word")).distinct()
    known = words.select("word").distinct().withColumn("stem", stems(F.array("word"))[0])
    return words.join(known, "word").select("id", "stem").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT source_file, CAST(sum(octet_length(encode(body))) AS BIGINT) AS bytes FROM chunks WHERE is_universal GROUP BY source_file HAVING sum(octet_length(encode(body))) > 256")
def agg7_oversized_universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned sources of more than 256 bytes: a cap that some of the given ones exceed."""
    return table(spark, sf_dir, "chunks").where("is_universal").groupBy("source_file").agg(F.sum(F.octet_length("body")).alias("bytes")).where("bytes > 256")


@query(f"""SELECT token, count(*) AS files FROM (SELECT DISTINCT source_file, unnest(from_json(language_json, '["VARCHAR"]')) AS token FROM patterns WHERE json_valid(language_json)) WHERE token NOT IN ({", ".join(map(repr, languages.TOKENS))}) GROUP BY token""")
def agg8_unknown_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files for each declared language that is not known."""
    declared = table(spark, sf_dir, "patterns").select("source_file", F.explode(T.json_list(F.col("language_json"))).alias("token")).where(~F.col("token").isin(*languages.TOKENS)).distinct()
    return declared.groupBy("token").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT count(*) AS total, count(*) FILTER (json_valid(language_json) AND json_array_length(CASE WHEN json_valid(language_json) THEN language_json END) > 0) AS declared FROM patterns""")
def agg9_declared_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.coalesce(F.size(T.json_list(F.col("language_json"))) > 0, F.lit(False))
    return table(spark, sf_dir, "patterns").agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("declared"))


@query("SELECT p.source_file, min(rank_no) AS best_rank, CASE WHEN min(rank_no) IS NULL THEN 'not_present' ELSE 'surfaced' END AS state FROM patterns p LEFT JOIN search_results r ON r.source_file = p.source_file GROUP BY p.source_file")
def agg13_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank at which each source ever surfaced; ranks are reduced before the join."""
    best = table(spark, sf_dir, "search_results").groupBy("source_file").agg(F.min("rank_no").alias("best_rank"))
    rows = table(spark, sf_dir, "patterns").select("source_file").join(best, "source_file", "left")
    return rows.withColumn("state", F.when(F.col("best_rank").isNull(), "not_present").otherwise("surfaced"))
