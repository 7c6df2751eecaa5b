"""What a call asks for: its search terms, its query string, the command behind its wrappers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardleaf.functions import text as T

#: One sudo with its flags, any number of env with theirs; the group is the word after them.
WRAPPED = r"^(?U)\s*(?:sudo(?=\s|$)(?:\s+(?:-u\s+\S+|-u$|-E|-H)(?=\s|$))*+\s*)?+(?:env(?=\s|$)(?:\s+(?:-i|-u\s+\S+|-u$|[A-Z_][A-Z0-9_]*=\S*)(?=\s|$))*+\s*)*+(\S+)"


def effective_head(command: Column) -> Column:
    """The command that a line really runs: behind ``sudo``, ``env`` and one ``bash -c`` or ``sh -c``; null for none.

    Of a ``-c`` body the first word counts as it stands; an empty or unclosed quoted body has none.
    """
    head = F.regexp_extract(command, WRAPPED, 1)
    inner = WRAPPED[:-len(r"(\S+)")] + r"(?:bash|sh)\s+-c(?:\s+|$)"
    body = F.regexp_replace(command, inner + "(?s:(.*))$", "$1")
    quoted = F.coalesce(F.nullif(F.regexp_extract(body, r'(?s)^"([^"]*)"', 1), F.lit("")), F.regexp_extract(body, r"(?s)^'([^']*)'", 1))
    word = F.regexp_extract(F.when(body.rlike("^[\"']"), quoted).otherwise(body), r"(?U)^\s*(\S+)", 1)
    return F.nullif(F.when(head.isin("bash", "sh") & command.rlike(inner), word).otherwise(head), F.lit(""))


def filename_terms(path: Column) -> Column:
    """Words of a file's name, also split before every capital."""
    return T.split_into_words(F.regexp_replace(T.file_stem(path), r"(?<=.)(?=\p{Lu})", " "))


def call_terms(tool: Column, path: Column, command: Column, description: Column, tail: Column, tail_bytes: int = 200) -> Column:
    """Search terms of a call: its file's name, a shell command and its description, the first bytes of the transcript's tail."""
    none = F.array().cast("array<string>")
    shell = F.coalesce(tool == "Bash", F.lit(False))
    spoken = [F.when(shell, T.split_into_words(c)) for c in (command, description)]
    words = [F.when(path != "", filename_terms(path)), *spoken, T.split_into_words(T.truncate_bytes(tail, tail_bytes))]
    return T.clean_terms(F.concat(*[F.coalesce(w, none) for w in words]))


def query_string(languages: Column, terms: Column) -> Column:
    """``language AND (term OR term)``; one side alone where the other is empty; null where both are."""
    langs = F.when(F.size(languages) > 1, F.concat(F.lit("("), F.array_join(languages, " OR "), F.lit(")"))).when(F.size(languages) == 1, languages[0])
    words = F.when(F.size(terms) > 0, F.array_join(terms, " OR "))
    return F.coalesce(F.concat(langs, F.lit(" AND ("), words, F.lit(")")), langs, words)


def applies(condition: Column, tool: Column, command: Column) -> Column:
    """Whether a condition (JSON with ``tools`` and ``bash_command_starts_with``) holds for a call.

    All lists that are set must hold, each by any of its values, and an empty list by none. No condition, a malformed
    one and one that sets nothing hold for every call.
    """
    return applies_to(condition, tool, effective_head(command))


def applies_to(condition: Column, tool: Column, head: Column) -> Column:
    """As ``applies``, given the command that the call really runs."""
    lists = F.from_json(condition, "tools array<string>, bash_command_starts_with array<string>")
    tools, heads = lists["tools"], lists["bash_command_starts_with"]
    by_tool = tools.isNull() | F.coalesce(F.array_contains(tools, tool), F.lit(False))
    by_head = heads.isNull() | F.coalesce((tool == "Bash") & F.array_contains(heads, head), F.lit(False))
    return by_tool & by_head
