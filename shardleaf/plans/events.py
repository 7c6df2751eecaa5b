"""Queries on raw events, on what a search shows of its results, and on notes that are written."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardleaf.functions import calls, events, languages
from shardleaf.functions import text as T
from shardleaf.operators import documents
from shardleaf.plans.calls import CALL, HEAD_SQL
from shardleaf.registry import SQL_WORDS, query
from shardleaf.sources.tables import table


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``call_id, event``: every call as the JSON of an event. Shell calls count as failed where the transcript's tail speaks of a failure, and then end with it."""
    rows = table(spark, sf_dir, "call_contexts").dropDuplicates(["call_id"])
    failed = F.coalesce(F.lower("transcript_tail").rlike("fail|error"), F.lit(False))
    given = F.struct("command", "file_path", "description")
    answer = F.struct(failed.cast("int").alias("exit_code"), F.when(failed, F.col("transcript_tail")).alias("stderr"))
    return rows.select("call_id", F.to_json(F.struct(F.lit("PostToolUse").alias("hook_event_name"), "session_id", "tool_name", given.alias("tool_input"), answer.alias("tool_response"))).alias("event"))


@query(
    f"SELECT call_id, term FROM (SELECT DISTINCT call_id, unnest({SQL_WORDS.format('transcript_tail')}) AS term FROM call_contexts WHERE tool_name = 'Bash' AND regexp_matches(lower(transcript_tail), 'fail|error')) "
    f"WHERE octet_length(encode(term)) >= 3 AND NOT regexp_matches(term, '^[0-9a-f]{{6,}}$') AND term NOT IN ({', '.join(map(repr, T.STOP_WORDS))})"
)
def qry12_error_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of every failed shell call, from the JSON of its event."""
    rows = raw_events(spark, sf_dir).select("call_id", events.parsed(F.col("event")).alias("e")).where(events.counts(F.col("e")))
    asked = rows.select("call_id", events.error_query(events.error_text(F.col("e"))).alias("q")).where("q IS NOT NULL")
    return asked.select("call_id", F.explode(F.split("q", " OR ")).alias("term"))


@query("SELECT DISTINCT call_id, tool_name, command, file_path, description FROM call_contexts")
def qry13_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call of every event, read back from its JSON."""
    rows = raw_events(spark, sf_dir).select("call_id", events.parsed(F.col("event")).alias("e"))
    return rows.select("call_id", events.call_context(F.col("e")).alias("c")).select("call_id", "c.*")


_FIRST_SQL = f"SELECT source_file, tool_name AS t, head AS h FROM (SELECT r.source_file, c.tool_name, c.head, row_number() OVER (PARTITION BY r.source_file ORDER BY r.rank_no, r.result_id) AS n FROM search_results r JOIN (SELECT call_id, any_value(tool_name) AS tool_name, any_value(CASE WHEN command IS NOT NULL THEN {HEAD_SQL} END) AS head FROM call_contexts GROUP BY call_id) c USING (call_id)) WHERE n = 1"


@query(
    f"SELECT result_id FROM search_results r JOIN (SELECT call_id, any_value(tool_name) AS tool, any_value(CASE WHEN command IS NOT NULL THEN {HEAD_SQL} END) AS head FROM call_contexts GROUP BY call_id) c USING (call_id) JOIN ({_FIRST_SQL}) f USING (source_file) "
    "WHERE CASE WHEN t IS NULL THEN true WHEN t = 'Bash' AND h <> '' THEN coalesce(tool = 'Bash' AND head = h, false) ELSE coalesce(tool = t, false) END"
)
def fil10_conditions_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that remain when each source applies only to calls like the one that it was found best for: the same command, or the same tool."""
    asked = table(spark, sf_dir, "call_contexts").dropDuplicates(["call_id"]).select("call_id", "tool_name", "command")
    rows = table(spark, sf_dir, "search_results").select("result_id", "call_id", "source_file", "rank_no").join(asked, "call_id")
    best = rows.groupBy("source_file").agg(F.min_by(F.struct("tool_name", calls.effective_head(F.col("command")).alias("head")), F.struct("rank_no", "result_id")).alias("b"))
    shell = (F.col("b.tool_name") == "Bash") & F.col("b.head").isNotNull()
    wanted = F.when(shell, F.to_json(F.struct(F.array("b.head").alias("bash_command_starts_with")))).when(F.col("b.tool_name").isNotNull(), F.to_json(F.struct(F.array("b.tool_name").alias("tools"))))
    return rows.join(best.select("source_file", wanted.alias("condition")), "source_file").where(calls.applies(F.col("condition"), F.col("tool_name"), F.col("command"))).select("result_id")


_MODE_SQL = "CASE WHEN score_vector IS NOT NULL THEN 'hybrid' WHEN score_fts_fallback IS NOT NULL OR score_fts_structural IS NOT NULL THEN 'fts_fallback' ELSE 'fts_only' END"


@query(f"SELECT result_id, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, result_id) AS rank, {_MODE_SQL} AS mode, title, source_file, is_universal FROM search_results")
def ret10_search_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each result: its rank from 1, where it comes from, and by which kind of search."""
    mode = F.when(F.col("score_vector").isNotNull(), "hybrid").when(F.col("score_fts_fallback").isNotNull() | F.col("score_fts_structural").isNotNull(), "fts_fallback").otherwise("fts_only")
    rank = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("score"), "result_id"))
    return table(spark, sf_dir, "search_results").select("result_id", rank.alias("rank"), mode.alias("mode"), "title", "source_file", "is_universal")


_COUNTS_SQL = """SELECT token, count(*) AS sources FROM (SELECT DISTINCT source_file, unnest(from_json(language_json, '["VARCHAR"]')) AS token FROM patterns WHERE json_valid(language_json)) WHERE token IS NOT NULL GROUP BY token"""
_NAME_SQL = "CASE token " + " ".join(f"WHEN '{t}' THEN '{languages.NAMES.get(t, t.capitalize())}'" for t in languages.TOKENS) + " ELSE regexp_replace(token, '[,\\s]', '_', 'g') END"


@query(
    f"SELECT string_agg(part, ', ' ORDER BY last, n DESC, name) AS line FROM (SELECT 0 AS last, sources AS n, {_NAME_SQL} AS name, {_NAME_SQL} || ' ' || sources AS part FROM ({_COUNTS_SQL}) "
    "UNION ALL SELECT 1, 0, '', 'undeclared ' || n FROM (SELECT count(*) AS n FROM patterns WHERE language_json IS NULL OR (json_valid(language_json) AND json_array_length(CASE WHEN json_valid(language_json) THEN language_json END) = 0)) WHERE n > 0)"
)
def agg3_language_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line on the languages of all sources, the most frequent first, those without any last."""
    rows = table(spark, sf_dir, "patterns").select("source_file", F.col("language_json"), T.json_list(F.col("language_json")).alias("listed"))
    tokens = rows.select("source_file", F.explode("listed").alias("token")).where("token IS NOT NULL").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    named = tokens.select(F.lit(0).alias("last"), (-F.col("n")).alias("order"), T.one_line_token(languages.display_name(F.col("token"))).alias("name"), F.col("n"))
    none = rows.where(F.col("language_json").isNull() | (F.size("listed") == 0)).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(1).alias("last"), F.lit(0).cast("long").alias("order"), F.lit("undeclared").alias("name"), "n")
    parts = named.unionByName(none).select("last", "order", "name", F.concat_ws(" ", "name", F.col("n").cast("string")).alias("part"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "order", "name", "part"))), lambda x: x["part"]), ", ").alias("line"))  # a part for each language


@query(
    """SELECT source_file, CASE WHEN tags <> '' OR len(l) > 0 THEN '---' || chr(10) || CASE WHEN tags <> '' THEN 'tags: [' || tags || ']' || chr(10) ELSE '' END || CASE WHEN len(l) > 0 THEN 'language: [' || array_to_string(l, ', ') || ']' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) ELSE '' END
    || '# ' || title || chr(10) || chr(10) || raw_body || chr(10) AS text FROM (SELECT *, coalesce(CASE WHEN json_valid(language_json) THEN from_json(language_json, '["VARCHAR"]') END, []) AS l FROM patterns)"""
)
def snk11_rendered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern as the text of its note."""
    none = F.array().cast("array<string>")
    tags = F.when(F.col("tags") == "", none).otherwise(F.split("tags", ", "))
    return table(spark, sf_dir, "patterns").select("source_file", documents.rendered(F.col("title"), tags, F.coalesce(T.json_list(F.col("language_json")), none), F.col("raw_body")).alias("text"))


@query("SELECT p.source_file, p.is_universal, c.chunks, c.universal, CASE WHEN p.is_universal THEN CASE WHEN p.applies_when_json IS NOT NULL THEN ' [universal, deferred]' ELSE ' [universal]' END ELSE '' END AS suffix FROM patterns p LEFT JOIN (SELECT source_file, count(*) AS chunks, count(*) FILTER (is_universal) AS universal FROM chunks GROUP BY source_file) c USING (source_file)")
def fil15_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each pattern, how many of them are pinned, and how its listing marks it."""
    held = table(spark, sf_dir, "chunks").groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("is_universal").alias("universal"))
    suffix = F.when(~F.col("is_universal"), "").when(F.col("applies_when_json").isNotNull(), " [universal, deferred]").otherwise(" [universal]")
    return table(spark, sf_dir, "patterns").select("source_file", "is_universal", suffix.alias("suffix")).join(held, "source_file", "left")
