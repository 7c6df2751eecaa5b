"""Keeping an index in step with its documents: upserts, cascading deletes, deltas."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardleaf.functions import text as T
from shardleaf.operators.documents import chunk_by_heading


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key it does not hold; columns are those of ``old``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_sources(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose source is not in ``gone``; rows without a source stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def pattern_rows(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key, title, tags, raw_body, content_hash`` of each document: a map over rows.

    The title is the first top heading, or the file's name; the body goes without front matter; the hash covers all.
    """
    text = F.col(text_col)
    front = T.front_matter(text)
    title = F.coalesce(F.nullif(T.first_title(text), F.lit("")), T.file_stem(F.col(key)))
    body = F.regexp_replace(F.regexp_replace(text, r"\A---\r?\n(?s:.*?)\n---", ""), r"(?U)\A\s+|\s+\z", "")
    return df.where(text.isNotNull()).select(key, title.alias("title"), F.array_join(T.tag_list(front), ", ").alias("tags"), body.alias("raw_body"), F.md5(text).alias("content_hash"))


def apply_changes(chunks: DataFrame, documents: DataFrame, changes: DataFrame, key: str, text_col: str) -> DataFrame:
    """The chunks (columns of ``chunk_by_heading``) after a change set of ``key, change``.

    Chunks of every changed, removed or added source leave; those of sources that still exist are made anew, so only
    changed documents are read in full. The outcome equals chunking all documents.
    """
    kept = delete_sources(chunks, changes, key)
    again = documents.join(changes.where("change <> 'removed'").select(key), key, "left_semi")
    return kept.unionByName(chunk_by_heading(again, key, text_col).select(*kept.columns))


def whole_documents(df: DataFrame, key: str, text_col: str, least_bytes: int = 10) -> DataFrame:
    """One chunk a document: ``id, title, heading_path, body``; none below ``least_bytes``."""
    title = F.coalesce(F.nullif(T.first_title(F.col(text_col)), F.lit("")), T.file_stem(F.col(key)))
    body = F.regexp_replace(F.regexp_replace(text_col, r"\A---\r?\n(?s:.*?)\n---", ""), r"(?U)\A\s+|\s+\z", "")
    return df.select(F.col(key).alias("id"), title.alias("title"), F.lit("").alias("heading_path"), body.alias("body")).where(F.octet_length("body") >= least_bytes)


def embedding_text(title: Column, tags: Column, body: Column) -> Column:
    """Title, tags and body by line, with an empty line for a null."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (title, tags, body)])
