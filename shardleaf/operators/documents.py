"""Markdown documents into heading-level chunks."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardleaf.functions.text import file_stem

_LINES = re.compile(r"\r\n|\r|\n")
_HEADING = re.compile(r"\s*(#{1,6})(?!#)\s*(.*?)\s*\Z")
_FRONT = re.compile(r"\A---\r?\n.*?\n---\n*", re.S)


def headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, line_no, level, heading``, lines from 1, of every heading line; a line like ``#tag`` counts, code is not told apart."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("_at", "_line"))
    mark = r"^\s*(#{1,6})(?!#)\s*(.*?)\s*$"
    found = lines.select(id_col, (F.col("_at") + 1).alias("line_no"), F.length(F.regexp_extract("_line", mark, 1)).alias("level"), F.regexp_extract("_line", mark, 2).alias("heading"))
    return found.where("level > 0 AND heading <> ''")


def sections(text: str) -> list[tuple[str, str, str]]:
    """(heading path, title, body) of each section of a text, in order; the first one has neither path nor title."""
    out, stack, begun = [], [], 0
    lines = _LINES.split(_FRONT.sub("", text))
    path = title = ""
    for at, line in enumerate(lines):
        mark = _HEADING.match(line) if "#" in line[:64] or line.lstrip().startswith("#") else None
        if mark and mark[2]:
            out.append((path, title, "\n".join(lines[begun:at]).strip()))
            while stack and stack[-1][0] >= len(mark[1]):
                stack.pop()
            stack.append((len(mark[1]), mark[2]))
            path, title, begun = " > ".join(name for _, name in stack), mark[2], at
    return [*out, (path, title, "\n".join(lines[begun:]).strip())]


def chunk_by_heading(df: DataFrame, id_col: str, text_col: str, least_bytes: int = 10) -> DataFrame:
    """``id_col, chunk_no, chunk_id, heading_path, title, body`` of every section whose trimmed body has ``least_bytes``.

    The body holds its own heading line. The path has the titles of the enclosing headings, outermost first; what
    stands before the first heading has an empty path and the name of the document as title. ``chunk_id`` is the
    document's id and the path (``root`` for an empty one), and from the second chunk of the same path on its ordinal
    among the chunks that are kept. A document that has no chunk but ``least_bytes`` in all is one chunk, named by its
    id. Null and empty texts have no chunk, repeated rows their own. Batches of documents are mapped over: no shuffle,
    and work in proportion to the lines.
    """
    given = df.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_name"), file_stem(F.col(id_col).cast("string")).alias("_stem"), F.col(text_col).cast("string").alias("_text")).where("_text <> ''")
    schema = T.StructType([T.StructField(id_col, given.schema["_id"].dataType), T.StructField("chunk_no", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("chunk_id", "heading_path", "title", "body")]])

    def cut(batches):
        for batch in batches:
            at, columns = [], [[] for _ in range(5)]
            for row, (name, stem, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_name", "_stem", "_text")))):
                seen: dict[str, int] = {}
                kept = [(n, *s) for n, s in enumerate(sections(text)) if len(s[2].encode()) >= least_bytes]
                for n, path, title, body in kept:
                    key = f"{name}:{path or 'root'}"
                    seen[key] = seen.get(key, 0) + 1
                    at.append(row)
                    for column, value in zip(columns, (n, key if seen[key] == 1 else f"{key}:{seen[key]}", path, title or stem, body)):
                        column.append(value)
                whole = _FRONT.sub("", text).strip() if not kept else ""
                if len(whole.encode()) >= least_bytes:
                    at.append(row)
                    for column, value in zip(columns, (0, name, "", stem, whole)):
                        column.append(value)
            kinds = (pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return given.mapInArrow(cut, schema)


def with_running_bytes(df: DataFrame, order_col: str, text_col: str, budget: int) -> DataFrame:
    """Rows in order whose bytes, each with one more, stay within the budget, up to the first that does not.

    Every row takes a byte at least, so no row beyond the first ``budget`` ones can fit: the running sum in one task is
    over that many rows at most.
    """
    df = df.orderBy(order_col).limit(budget)
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_bytes", F.sum(F.octet_length(text_col) + 1).over(w)).where(F.col("running_bytes") <= budget)


def rendered(title, tags, languages, body):
    """The text of a note: front matter where it has tags or languages, its title, its body and a line end."""
    listed = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(values, ", "), F.lit("]\n"))).otherwise("")
    front = F.concat(listed("tags", tags), listed("language", languages))
    return F.concat(F.when(front != "", F.concat(F.lit("---\n"), front, F.lit("---\n\n"))).otherwise(""), F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))


def appended(text, heading, body):
    """A note with one more section at its end."""
    return F.concat(text, F.lit("\n## "), heading, F.lit("\n\n"), body, F.lit("\n"))


def updated(text, title, body, tags=None, languages=None):
    """A note written anew: absent tags and languages stay as they are, empty ones go, given ones take their place."""
    from shardleaf.functions import front as front_matter
    from shardleaf.functions import text as T

    old = T.front_matter(text)
    return rendered(title, F.coalesce(tags, T.tag_list(old)) if tags is not None else T.tag_list(old), F.coalesce(languages, front_matter.language_list(old)) if languages is not None else front_matter.language_list(old), body)
