"""Registered queries of the core and the SQL that checks them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardleaf.functions import text as T
from shardleaf.functions.languages import TOKENS
from shardleaf.operators import documents, retrieval
from shardleaf.plans import calls, chain, events, index, ingest, search, traces  # noqa: F401  (they register their queries)
from shardleaf.registry import ORACLE_SQL, QUERIES, SQL_WORDS, query  # noqa: F401
from shardleaf.sources.tables import change_set, table
from shardleaf.streaming import sessions

FIELD_WEIGHTS = search.FIELD_WEIGHTS

@query("SELECT source_file, title, tags, is_universal, applies_when_json IS NOT NULL AS has_predicate FROM patterns")
def fil1_list_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patterns").select("source_file", "title", "tags", "is_universal", F.col("applies_when_json").isNotNull().alias("has_predicate"))


@query("SELECT source_file, title, raw_body FROM patterns WHERE is_universal AND applies_when_json IS NULL")
def fil2_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patterns").where("is_universal AND applies_when_json IS NULL").select("source_file", "title", "raw_body")


@query("SELECT source_file, CAST(running_bytes AS BIGINT) AS running_bytes FROM (SELECT source_file, sum(octet_length(encode(raw_body)) + 1) OVER (ORDER BY source_file) AS running_bytes FROM patterns WHERE is_universal AND applies_when_json IS NULL) WHERE running_bytes <= 32768")
def fil3_pinned_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.with_running_bytes(fil2_pinned(spark, sf_dir), "source_file", "raw_body", 32768).select("source_file", "running_bytes")


@query("""SELECT id, source_file FROM chunks WHERE language_json IS NULL OR coalesce(list_has_any(CASE WHEN json_valid(language_json) THEN from_json(language_json, '["VARCHAR"]') END, ['python', 'rust']), false)""")
def fil4_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    inferred = F.array(F.lit("python"), F.lit("rust"))
    return table(spark, sf_dir, "chunks").where(retrieval.language_gate(T.json_list(F.col("language_json")), inferred, F.col("language_json"))).select("id", "source_file")


@query("SELECT result_id, call_id, score FROM search_results WHERE score >= CASE WHEN is_universal THEN 0.8 ELSE 0.6 END")
def fil7_class_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_results").where(retrieval.passes_threshold(F.col("score"), F.col("is_universal"), 0.6, 0.8)).select("result_id", "call_id", "score")


@query("SELECT DISTINCT trace_id, session_id FROM trace_records WHERE event = 'PreToolUse' AND call_context.tool_name = 'Bash'")
def fil13_trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trace_records").where("event = 'PreToolUse' AND call_context.tool_name = 'Bash'").select("trace_id", "session_id").distinct()


@query("SELECT DISTINCT r.call_id, c.id FROM search_results r JOIN chunks c USING (source_file)")
def jn7_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the sources that a call's results come from."""
    seeds = table(spark, sf_dir, "search_results").select("call_id", "source_file").distinct()
    return seeds.join(table(spark, sf_dir, "chunks").select("source_file", "id"), "source_file").select("call_id", "id").distinct()


@query(
    "SELECT coalesce(d.source_file, p.source_file) AS source_file, CASE WHEN p.source_file IS NULL THEN 'added' WHEN d.source_file IS NULL THEN 'removed' ELSE 'changed' END AS change "
    "FROM (SELECT source_file, md5(text) AS h FROM documents) d FULL JOIN (SELECT source_file, content_hash AS h FROM patterns) p ON d.source_file = p.source_file WHERE d.source_file IS NULL OR p.source_file IS NULL OR d.h IS DISTINCT FROM p.h"
)
def jn8_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to add, remove and change in the patterns so that they hold the documents."""
    disk = table(spark, sf_dir, "documents").select("source_file", F.md5("text").alias("content_hash"))
    return change_set(table(spark, sf_dir, "patterns"), disk, "source_file", "content_hash")


@query("SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM patterns) AS patterns")
def agg1_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias(n)) for n in ("chunks", "patterns")]
    return counts[0].join(counts[1])  # one row each


@query("""SELECT token, count(*) AS sources FROM (SELECT DISTINCT source_file, unnest(from_json(language_json, '["VARCHAR"]')) AS token FROM patterns WHERE json_valid(language_json)) GROUP BY token""")
def agg2_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "patterns").select("source_file", F.explode(T.json_list(F.col("language_json"))).alias("token")).where("token IS NOT NULL").distinct()
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sources"))


@query("SELECT source_file, count(*) AS n_chunks, rtrim(string_agg(coalesce(body, ''), chr(10) ORDER BY id), chr(10)) || chr(10) AS whole FROM chunks GROUP BY source_file")
def agg12_whole_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("id", F.coalesce("body", F.lit("")).alias("body"))))
    whole = F.concat(F.rtrim(F.array_join(F.transform(parts, lambda p: p["body"]), "\n"), F.lit("\n")), F.lit("\n"))
    return table(spark, sf_dir, "chunks").groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"), whole.alias("whole"))


@query("SELECT session_id, event, count(DISTINCT trace_id) AS records, min(written_at) AS first_at, max(written_at) AS last_at FROM trace_records GROUP BY session_id, event")
def agg10_trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "trace_records").groupBy("session_id", "event", "trace_id").agg(F.min("written_at").alias("a"), F.max("written_at").alias("b"))
    return rows.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("records"), F.min("a").alias("first_at"), F.max("b").alias("last_at"))


def _search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, terms`` of every distinct inferred query; the query's own text is its id."""
    rows = table(spark, sf_dir, "trace_records").where("query <> ''").select(F.col("query").alias("qid")).distinct()
    words = F.array_except(T.split_into_words(F.col("qid")), F.array(F.lit("and"), F.lit("or"), F.lit("not")))
    return rows.withColumn("terms", words)


def _search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, terms`` like ``_search_terms``, in the index's own tokens and as often as they stand; only upper-case words are operators."""
    rows = table(spark, sf_dir, "trace_records").where("query <> ''").select(F.col("query").alias("qid")).distinct()
    return rows.withColumn("terms", T.search_tokens(F.regexp_replace("qid", r"(?<![\p{L}\p{M}\p{N}])(?:AND|OR|NOT)(?![\p{L}\p{M}\p{N}])", " ")))


_NO_OR = r"regexp_replace(side, '\s+OR\s+', ' ', 'g')"


_BM25_CTES = "WITH" + search.bm25_ctes(f"SELECT DISTINCT query AS qid, unnest(list_filter(list_distinct({SQL_WORDS.format('query')}), lambda x: x NOT IN ('and', 'or', 'not'))) AS term FROM trace_records WHERE query <> ''")
_PART_SQL, _KNOWN_SQL = search.PART_SQL, search.KNOWN_SQL
_BM25_SQL = f"""{_BM25_CTES}
SELECT qid, id, round(sum({_PART_SQL}), 6) AS score FROM asked JOIN post USING (term) JOIN len USING (id) JOIN idf USING (term), st GROUP BY qid, id"""


@query(f"SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({_BM25_SQL})) WHERE rank <= 10")
def ret1_lexical_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten chunks that hold any word of a query, for every query that the traces hold, by weighted BM25."""
    asked = _search_terms(spark, sf_dir).select("qid", F.array("terms").alias("groups"))
    return retrieval.search(search.lexical_index(spark, sf_dir), "id", asked, "qid", 10).select("qid", "id", "rank")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "trace_records").where("query <> ''").select(F.col("query").alias("qid")).distinct()
    return rows.withColumn("groups", retrieval.match_groups(F.col("qid")))


@query(
    rf"""{_BM25_CTES},
g AS (SELECT DISTINCT qid, generate_subscripts(s, 1) AS g, unnest(s) AS side FROM (SELECT DISTINCT query AS qid, string_split_regex(query, '\s+AND\s+') AS s FROM trace_records WHERE query <> '')),
a AS (SELECT qid, g, unnest({SQL_WORDS.format(_NO_OR)}) AS term FROM g),
h AS (SELECT qid, id, g, sum({_PART_SQL}) AS part FROM a JOIN post USING (term) JOIN len USING (id) JOIN idf USING (term), st GROUP BY qid, id, g),
m AS (SELECT qid, id, round(sum(part), 6) AS score FROM h JOIN (SELECT qid, count(DISTINCT g) AS n FROM a GROUP BY qid) USING (qid) GROUP BY qid, id, n HAVING count(*) = n)
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 10"""
)
def ret1_match_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ret1_lexical_top10``, of the chunks that the whole query matches: a word of every side of its ANDs."""
    asked = _matches(spark, sf_dir).withColumn("groups", F.filter(F.transform("groups", lambda g: F.flatten(F.transform(g, T.split_into_words))), lambda g: F.size(g) > 0))
    return retrieval.search(search.lexical_index(spark, sf_dir), "id", asked, "qid", 10).select("qid", "id", "rank")


@query()
def ret1_stemmed_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ret1_match_top10``, by stems without accents and with digits."""
    index = retrieval.build_index(table(spark, sf_dir, "chunks"), "id", FIELD_WEIGHTS, stemmed=True)
    return retrieval.search(index, "id", _matches(spark, sf_dir), "qid", 10, stemmed=True).select("qid", "id", "rank")


@query(
    rf"""{_BM25_CTES},
s AS (SELECT qid, id, round(sum({_PART_SQL}), 6) AS whole, round(sum({_PART_SQL}) FILTER (NOT {_KNOWN_SQL}), 6) AS by_terms, bool_or({_KNOWN_SQL}) AS hl, bool_or(NOT {_KNOWN_SQL}) AS ht FROM asked JOIN post USING (term) JOIN len USING (id) JOIN idf USING (term), st GROUP BY qid, id),
n AS (SELECT qid, list(term) FILTER ({_KNOWN_SQL}) AS langs, count(*) FILTER ({_KNOWN_SQL}) AS nl, count(*) FILTER (NOT {_KNOWN_SQL}) AS nt FROM asked GROUP BY qid),
r AS (SELECT s.*, n.* EXCLUDE (qid), language_json FROM s JOIN n USING (qid) JOIN chunks USING (id)),
l AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY whole DESC, id) AS rank FROM r WHERE language_json IS NULL AND (nl = 0 OR hl) AND (nt = 0 OR ht)
  UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY by_terms DESC, id) FROM r WHERE ht AND coalesce(list_has_any(CASE WHEN json_valid(language_json) THEN from_json(language_json, '["VARCHAR"]') END, langs), false))
SELECT qid, id, round(sum(1 / (60 + rank)) / (2 / 61), 9) AS fused FROM l WHERE rank <= 10 GROUP BY qid, id"""
)
def ret5_gated_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback and structural lists of every query that the traces hold, ten of each, fused."""
    known = F.array(*map(F.lit, TOKENS))
    asked = _search_terms(spark, sf_dir).select("qid", F.array_intersect("terms", known).alias("langs"), F.array_except("terms", known).alias("words"))
    return _fused_gates(search.lexical_index(spark, sf_dir), asked)


def _fused_gates(index: DataFrame, asked: DataFrame, **how) -> DataFrame:
    lists = retrieval.search_gated(index, "id", asked, "qid", "langs", "words", 10, **how)
    return retrieval.fuse(lists, "qid", "id").withColumn("fused", F.round("fused", 9))


@query()
def ret5_stemmed_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``ret5_gated_lexical``, by stems without accents and with digits."""
    known = F.array(*map(F.lit, TOKENS))
    asked = _search_tokens(spark, sf_dir).select("qid", F.array_intersect("terms", known).alias("langs"), F.filter("terms", lambda t: ~F.array_contains(known, t)).alias("words"))
    index = retrieval.build_index(table(spark, sf_dir, "chunks"), "id", FIELD_WEIGHTS, "language_json", stemmed=True)
    return _fused_gates(index, asked, stemmed=True)


@query(
    "SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.vec_id) AS rank "
    "FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10"
)
def ret2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query_id", "vec_id", "rank")


@query(
    "WITH l AS (SELECT call_id, id, row_number() OVER (PARTITION BY call_id ORDER BY s DESC, id) AS rank FROM (SELECT call_id, id, max(score_fts_fallback) AS s FROM search_results WHERE score_fts_fallback IS NOT NULL GROUP BY ALL) "
    "UNION ALL SELECT call_id, id, row_number() OVER (PARTITION BY call_id ORDER BY s DESC, id) FROM (SELECT call_id, id, max(score_fts_structural) AS s FROM search_results WHERE score_fts_structural IS NOT NULL GROUP BY ALL) "
    "UNION ALL SELECT call_id, id, row_number() OVER (PARTITION BY call_id ORDER BY s DESC, id) FROM (SELECT call_id, id, max(score_vector) AS s FROM search_results WHERE score_vector IS NOT NULL GROUP BY ALL)) "
    "SELECT call_id, id, round(sum(1 / (60 + rank)) / (3 / 61), 9) AS fused FROM l GROUP BY call_id, id"
)
def ret6_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, structural and vector ranks of every call's results, fused."""
    rows, lists = table(spark, sf_dir, "search_results"), []
    for score in ("score_fts_fallback", "score_fts_structural", "score_vector"):
        best = rows.where(F.col(score).isNotNull()).groupBy("call_id", "id").agg(F.max(score).alias("s"))
        lists.append(best.withColumn("rank", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("s"), "id"))))
    return retrieval.fuse(lists, "call_id", "id").withColumn("fused", F.round("fused", 9))


@query(
    r"""SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(length(regexp_extract(line, '^\s*(#{1,6})(?:[^#]|$)', 1)) AS INT) AS level, regexp_extract(line, '^\s*#{1,6}\s*(.*?)\s*$', 1) AS heading FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents))
    WHERE regexp_matches(line, '^\s*#{1,6}[^#]') AND trim(regexp_extract(line, '^\s*#{1,6}\s*(.*?)\s*$', 1)) <> ''"""
)
def doc4_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.headings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def doc1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading-level chunks of every document."""
    return documents.chunk_by_heading(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, regexp_extract(t, '\A---\n((?s:.*?))\n---', 1) AS front, trim(regexp_extract(t, '(?m)^# (.*)$', 1)) AS title FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents)""")
def doc6_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.front_matter(F.col("text")).alias("front"), T.first_title(F.col("text")).alias("title"))


@query(f"SELECT term, count(*) AS calls FROM (SELECT DISTINCT call_id, unnest({SQL_WORDS.format('command')}) AS term FROM call_contexts) WHERE octet_length(encode(term)) >= 3 AND NOT regexp_matches(term, '^[0-9a-f]{{6,}}$') AND term NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY term")
def qry9_command_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls for each search term in their command."""
    calls = table(spark, sf_dir, "call_contexts").select("call_id", "command").where("command IS NOT NULL").dropDuplicates(["call_id"])
    return calls.select(F.explode(T.clean_terms(T.split_into_words(F.col("command")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("calls"))


@query("SELECT trace_id, c.chunk_id AS chunk_id, c.predicate_outcome AS outcome, c.above_threshold AS above, c.deduped AS deduped, list_contains(injected, c.chunk_id) AS injected FROM (SELECT trace_id, injected, unnest(candidates) AS c FROM (SELECT trace_id, any_value(injected) AS injected, any_value(candidates) AS candidates FROM trace_records WHERE event = 'PreToolUse' GROUP BY trace_id))")
def trc1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every traced call and what became of it."""
    rows = table(spark, sf_dir, "trace_records").where("event = 'PreToolUse'").dropDuplicates(["trace_id"])
    rows = rows.select("trace_id", "injected", F.explode("candidates").alias("c"))
    return rows.select("trace_id", "c.chunk_id", F.col("c.predicate_outcome").alias("outcome"), F.col("c.above_threshold").alias("above"), "c.deduped", F.array_contains("injected", F.col("c.chunk_id")).alias("injected"))


@query(
    "SELECT session_id, chunk_id, trace_id FROM (SELECT session_id, chunk_id, trace_id, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY written_at, trace_id) AS n "
    "FROM (SELECT session_id, trace_id, written_at, unnest(injected) AS chunk_id FROM trace_records)) WHERE n = 1"
)
def win3_first_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call that first injected each chunk into a session."""
    rows = table(spark, sf_dir, "trace_records").select("session_id", "trace_id", "written_at", F.explode("injected").alias("chunk_id"))
    return sessions.first_in_session(rows, "session_id", "chunk_id", ["written_at", "trace_id"]).select("session_id", "chunk_id", "trace_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts::TIMESTAMP) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def str1_events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.counts_by_window(table(spark, sf_dir, "events"), "ts", ["event_type"])


FLAGSHIP = "ret1_lexical_top10"
