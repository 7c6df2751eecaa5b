"""Scalar text functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search query.
STOP_WORDS = (
    "the and for with from into that this then when will has have was are not but can all its our use new let set get add run see how may per via yet also just some been "
    "were what they each which their there about would could should these those other than them your does here"
).split()


def split_into_words(text: Column) -> Column:
    """Lower-cased runs of letters and their marks, in order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, their marks, digits and private characters, in order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{Co}]+"), lambda w: w != "")


def clean_terms(words: Column, stop_words=tuple(STOP_WORDS), least: int = 3) -> Column:
    """Words of at least ``least`` bytes that are neither hex-like nor stop words, each once, as first seen."""
    stop = F.array(*map(F.lit, stop_words))
    keep = F.filter(words, lambda w: (F.octet_length(w) >= least) & ~w.rlike("^[0-9a-f]{6,}$") & ~F.array_contains(stop, w))
    return F.array_distinct(keep)


def sanitize_query(text: Column) -> Column:
    """A query without the characters that a match expression gives a meaning to; single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"""[./\\:{}\[\]"'*^-]""", " "), r"\s+", " "))


def file_stem(path: Column) -> Column:
    """Base name without its last extension; ``untitled`` for an empty one."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem == "", "untitled").otherwise(stem)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest start of a text within ``most`` UTF-8 bytes."""
    starts = [F.try_validate_utf8(F.substring(F.encode(text, "utf-8"), 1, most - back).cast("string")) for back in range(min(4, most + 1))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*starts))


def strip_quotes(text: Column) -> Column:
    """Without one pair of equal quotes around the whole text."""
    return F.regexp_replace(text, r"""(?s)^(["'])(.*)\1$""", "$2")


def one_line_token(text: Column) -> Column:
    """With ``_`` for every comma, blank and control character."""
    return F.regexp_replace(text, r"(?U)[,\s\p{Cntrl}]", "_")


def format_bytes(size: Column) -> Column:
    """A size in B, KB, MB or GB of 1024, the larger ones with one decimal."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", size / float(1024**power))
    return F.when(size >= 1024**3, unit(3, "GB")).when(size >= 1024**2, unit(2, "MB")).when(size >= 1024, unit(1, "KB")).otherwise(F.format_string("%d B", size))


def rfc3339_millis(at: Column) -> Column:
    """A timestamp in UTC as ``yyyy-MM-ddTHH:mm:ss.SSSZ``."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def tag_list(front: Column, key: str = "tags") -> Column:
    """Values of a list in front matter, flow (``[a, "b"]``) or block (``- a`` lines); an empty array for none or a scalar."""
    flow = F.regexp_extract(front, rf"{key}:[ \t]*\[([^\]\n]*)\]", 1)
    block = F.regexp_extract(front, rf"{key}:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1)
    items = F.when(flow != "", F.split(flow, ",")).when(block != "", F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*-", "")))
    trimmed = F.transform(items, lambda x: strip_quotes(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array().cast("array<string>"))


def near_miss(name: Column, wanted: str, most: int = 2) -> Column:
    """Names that are probably misspellings of ``wanted``: other case, or at most ``most`` edits away, but not equal."""
    return (name != wanted) & ((F.lower(name) == wanted.lower()) | (F.levenshtein(name, F.lit(wanted), most) >= 0))


def json_list(text: Column) -> Column:
    """A JSON array of strings as an array; null where null, empty or malformed."""
    return F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})


def is_env_assignment(text: Column) -> Column:
    return text.rlike("^[A-Z_][A-Z0-9_]*=")


def command_head(text: Column) -> Column:
    """First word of a command; null for null or blank."""
    return F.nullif(F.get(F.split(F.trim(text), r"\s+"), F.lit(0)), F.lit(""))


def front_matter(text: Column) -> Column:
    """What stands between an opening ``---`` line and the next one; empty where there is none or it has no end."""
    return F.regexp_extract(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)\A---\n(.*?)\n---", 1)


def first_title(text: Column) -> Column:
    """The first top heading, trimmed; empty where there is none."""
    return F.trim(F.regexp_extract(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)^# (.*)$", 1))
