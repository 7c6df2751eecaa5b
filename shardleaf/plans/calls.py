"""Queries on what calls ask for: their languages, terms and conditions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardleaf.functions import calls, languages
from shardleaf.functions import text as T
from shardleaf.registry import SQL_WORDS, query
from shardleaf.sources.tables import table

CALL = ("tool_name", "file_path", "command", "description")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "call_contexts").dropDuplicates(["call_id"])


def _values(names: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in languages.signals(names)) + ") v(k, token)"


_LANGUAGES_SQL = rf"""
WITH calls AS (SELECT DISTINCT call_id, tool_name, file_path, command, description FROM call_contexts),
m AS (SELECT call_id, token FROM calls JOIN {_values(languages.MARKERS)} ON k = regexp_extract(file_path, '[^/]*$')),
e AS (SELECT call_id, token FROM calls JOIN {_values(languages.EXTENSIONS)} ON k = lower(regexp_extract(file_path, '[^/]\.([^./]+)$', 1)) WHERE call_id NOT IN (SELECT call_id FROM m)),
d AS (SELECT call_id, token FROM (SELECT call_id, unnest(string_split(file_path, '/')) AS part FROM calls) JOIN {_values(languages.FOLDERS)} ON k = part WHERE call_id NOT IN (SELECT call_id FROM m UNION ALL SELECT call_id FROM e)),
w AS (SELECT call_id, unnest(string_split_regex(concat_ws(' ', command, description), '\s+')) AS word FROM calls WHERE tool_name = 'Bash'),
b AS (SELECT call_id, token FROM w JOIN {_values(languages.COMMANDS)} ON k = lower(regexp_extract(word, '[^/]*$')) WHERE NOT regexp_matches(word, '^[A-Z_][A-Z0-9_]*='))
SELECT DISTINCT call_id, token FROM (FROM m UNION ALL FROM e UNION ALL FROM d UNION ALL FROM b)"""


@query(_LANGUAGES_SQL)
def qry2_call_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that each call is about."""
    return _calls(spark, sf_dir).select("call_id", F.explode(languages.infer_languages(*map(F.col, CALL))).alias("token"))


_TERMS_SQL = rf"""
WITH calls AS (SELECT DISTINCT call_id, tool_name, file_path, command, description, transcript_tail FROM call_contexts),
texts AS (SELECT call_id, regexp_replace(regexp_replace(regexp_extract(file_path, '[^/]*$'), '(.)\.[^.]*$', '\1'), '(\p{{Lu}})', ' \1', 'g') AS t FROM calls WHERE file_path <> ''
  UNION ALL SELECT call_id, concat_ws(' ', command, description) FROM calls WHERE tool_name = 'Bash'
  UNION ALL SELECT call_id, left(transcript_tail, list_max(list_filter(range(0, 201), lambda n: octet_length(encode(left(transcript_tail, n))) <= 200))::BIGINT) FROM calls)
SELECT DISTINCT call_id, term FROM (SELECT call_id, unnest({SQL_WORDS.format("t")}) AS term FROM texts)
WHERE octet_length(encode(term)) >= 3 AND NOT regexp_matches(term, '^[0-9a-f]{{6,}}$') AND term NOT IN ({", ".join(map(repr, T.STOP_WORDS))})"""


@query(_TERMS_SQL)
def qry7_call_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of each call."""
    return _calls(spark, sf_dir).select("call_id", F.explode(calls.call_terms(*map(F.col, (*CALL, "transcript_tail")))).alias("term"))


@query(f"SELECT token, count(*) AS calls FROM ({_LANGUAGES_SQL}) GROUP BY token")
def qry2_calls_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qry2_call_languages(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("calls"))


@query()
def qry1_call_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, terms and query string of every call that has any."""
    found = _calls(spark, sf_dir).select("call_id", languages.infer_languages(*map(F.col, CALL)).alias("languages"), calls.call_terms(*map(F.col, (*CALL, "transcript_tail"))).alias("terms"))
    return found.withColumn("query", calls.query_string(F.col("languages"), F.col("terms"))).where("query IS NOT NULL")


HEAD_SQL = r"""regexp_extract(regexp_replace(regexp_replace(command, '^\s*sudo(\s+(-u\s+\S+|-E|-H))*\s+', ''), '^\s*(env(\s+(-i|-u\s+\S+|[A-Z_][A-Z0-9_]*=\S*))*\s+)+', ''), '^\s*(\S+)', 1)"""


@query(f"SELECT head, count(*) AS calls FROM (SELECT call_id, any_value({HEAD_SQL}) AS head FROM call_contexts WHERE command IS NOT NULL GROUP BY call_id) WHERE head <> '' GROUP BY head")
def fn20_command_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls for each command that they really run."""
    heads = _calls(spark, sf_dir).select(calls.effective_head(F.col("command")).alias("head")).where("head IS NOT NULL")
    return heads.groupBy("head").agg(F.count(F.lit(1)).alias("calls"))


@query(
    f"""SELECT result_id FROM search_results JOIN (SELECT call_id, any_value(tool_name) AS tool, any_value(CASE WHEN command IS NOT NULL THEN {HEAD_SQL} END) AS head FROM call_contexts GROUP BY call_id) USING (call_id)
    WHERE NOT is_universal OR applies_when_json IS NULL OR NOT json_valid(applies_when_json) OR
    ((json_extract(applies_when_json, '$.tools') IS NULL OR coalesce(list_contains(json_extract(applies_when_json, '$.tools')::VARCHAR[], tool), false)) AND
    (json_extract(applies_when_json, '$.bash_command_starts_with') IS NULL OR coalesce(tool = 'Bash' AND list_contains(json_extract(applies_when_json, '$.bash_command_starts_with')::VARCHAR[], head), false)))"""
)
def fil9_condition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose condition holds for their call; only pinned ones have conditions that count."""
    asked = _calls(spark, sf_dir).select("call_id", "tool_name", "command")
    rows = table(spark, sf_dir, "search_results").select("result_id", "call_id", "is_universal", "applies_when_json").join(asked, "call_id")
    holds = calls.applies(F.col("applies_when_json"), F.col("tool_name"), F.col("command"))
    return rows.where(~F.col("is_universal") | F.col("applies_when_json").isNull() | holds).select("result_id")
