"""Raw events (JSON) as calls: which of them count, and what they ask for."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardleaf.functions import text as T

# Kinds of agents whose calls get nothing.
SKIPPED_AGENTS = ("Explore", "Plan")
EVENT = (
    "hook_event_name string, session_id string, tool_name string, agent_type string, transcript_path string, tool_input struct<command: string, file_path: string, description: string>, "
    "tool_response struct<exit_code: bigint, exitCode: bigint, stderr: string, result: struct<stderr: string>>"
)


def parsed(event: Column) -> Column:
    """The fields of an event; null for null, and null fields where a text is no event."""
    return F.from_json(event, EVENT)


def counts(event: Column) -> Column:
    """Whether an event gets anything: its agent is none of those that are skipped."""
    return ~F.coalesce(event["agent_type"].isin(*SKIPPED_AGENTS), F.lit(False))


def call_context(event: Column) -> Column:
    """``tool_name, command, file_path, description`` of an event's call."""
    given = event["tool_input"]
    return F.struct(event["tool_name"].alias("tool_name"), given["command"].alias("command"), given["file_path"].alias("file_path"), given["description"].alias("description"))


def error_text(event: Column) -> Column:
    """What a failed shell call wrote to its error stream; null for any other event."""
    answer = event["tool_response"]
    code = F.coalesce(answer["exit_code"], answer["exitCode"])
    said = F.coalesce(F.nullif(answer["stderr"], F.lit("")), answer["result"]["stderr"])
    return F.when((event["hook_event_name"] == "PostToolUse") & (event["tool_name"] == "Bash") & (code != 0) & (said != ""), said)


def error_query(said: Column) -> Column:
    """The search terms of an error text, any of which may match; null for none."""
    return F.nullif(F.array_join(T.clean_terms(T.split_into_words(said)), " OR "), F.lit(""))


def last_user_text(transcript: Column, most_bytes: int = 32768) -> Column:
    """The last text of a user in a transcript of JSON lines (binary), of which the last ``most_bytes`` count; null for none.

    A line that is cut at the start of this part is left out, as are lines that are no records and contents that are no text.
    """
    tail = F.substring(transcript, -most_bytes, most_bytes).cast("string")
    lines = F.split(F.when(F.octet_length(transcript) > most_bytes, F.regexp_replace(tail, r"(?s)\A[^\n]*\n?", "")).otherwise(tail), "\n")
    users = F.filter(lines, lambda x: (F.get_json_object(x, "$.type") == "user") & F.get_json_object(x, "$.message.content").isNotNull() & ~F.get_json_object(x, "$.message.content").rlike(r"\A[\[{]"))
    return F.get_json_object(F.get(users, F.size(users) - 1), "$.message.content")
