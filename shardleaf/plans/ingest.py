"""Bringing an index in line with its documents: patterns, chunks, postings and vectors of one generation."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardleaf.functions import front as front_matter
from shardleaf.functions import languages
from shardleaf.functions import text as T
from shardleaf.functions.ignore import ignored
from shardleaf.operators import index, retrieval
from shardleaf.operators.documents import chunk_by_heading
from shardleaf.plans.index import IGNORE, IGNORED_SQL, current_vectors
from shardleaf.registry import query
from shardleaf.sources.tables import change_set, table

WEIGHTS = {"title": 10.0, "body": 1.0, "tags": 5.0, "source_file": 0.0}
UNIVERSAL_MOST, UNIVERSAL_WARNING, UNIVERSAL_MANY = 8192, 1024, 3


@dataclass(frozen=True)
class Index:
    """One generation of the tables of an index, keyed by ``source_file`` and ``id``."""

    patterns: DataFrame
    chunks: DataFrame
    postings: DataFrame
    vectors: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"patterns": self.patterns, "chunks": self.chunks, "postings": self.postings, "vectors": self.vectors}


def declared(documents: DataFrame) -> DataFrame:
    """``source_file, tags, languages, is_universal, condition, advice, near_tags`` of each document's front matter."""
    fronts = documents.select("source_file", T.front_matter(F.col("text")).alias("_front"))
    rows = fronts.select("source_file", T.tag_list(F.col("_front")).alias("tags"), front_matter.language_list(F.col("_front")).alias("languages"), front_matter.condition(F.col("_front")).alias("_c"))
    return rows.select("source_file", "tags", "languages", F.array_contains("tags", front_matter.UNIVERSAL).alias("is_universal"), "_c.condition", "_c.advice", front_matter.near_miss_tags(F.col("tags")).alias("near_tags"))


def build(documents: DataFrame, vectors: DataFrame) -> Index:
    """The index of all ``documents`` (``source_file, text``); ``vectors`` (``id, vector``) are those at hand, chunks without one stay.

    A universal document whose chunks have more than ``UNIVERSAL_MOST`` bytes together is left out whole.
    """
    flags = declared(documents)
    chunks = chunk_by_heading(documents, "source_file", "text").join(flags.select("source_file", F.array_join("tags", ", ").alias("tags"), "is_universal", F.when(F.size("languages") > 0, F.to_json("languages")).alias("language_json"), F.col("condition").alias("applies_when_json")), "source_file")
    large = chunks.where("is_universal").groupBy("source_file").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > UNIVERSAL_MOST)
    chunks = chunks.join(large.select("source_file"), "source_file", "left_anti").withColumnRenamed("chunk_id", "id").checkpoint()
    known = chunks.select("source_file", "is_universal", "language_json", "applies_when_json").distinct()
    patterns = index.pattern_rows(documents, "source_file", "text").join(known, "source_file")
    rows = retrieval.build_index(chunks, "id", WEIGHTS)
    postings = rows.select("id", F.explode(F.arrays_zip("terms", "hits")).alias("_t")).select("id", F.col("_t.terms").alias("term"), F.col("_t.hits").alias("hits"))
    return Index(patterns, chunks, postings, vectors.join(chunks.select("id"), "id", "left_semi"))


def apply_delta(old: Index, documents: DataFrame, changes: DataFrame, vectors: DataFrame) -> Index:
    """The index after ``changes`` (``source_file, change``): rows of every changed source leave all tables, and what still exists is built anew."""
    gone = changes.select("source_file").distinct().checkpoint()
    again = build(documents.join(changes.where("change <> 'removed'").select("source_file"), "source_file", "left_semi"), vectors)
    lost = old.chunks.join(gone, "source_file", "left_semi").select("id")
    keep = lambda rows, by, key: rows.join(by, key, "left_anti")
    return Index(
        keep(old.patterns, gone, "source_file").unionByName(again.patterns), keep(old.chunks, gone, "source_file").unionByName(again.chunks), keep(old.postings, lost, "id").unionByName(again.postings), keep(old.vectors, lost, "id").unionByName(again.vectors)
    )


def reconcile(old: Index, documents: DataFrame, rules: list[str], vectors: DataFrame) -> Index:
    """The index after new ignore rules: what they exclude leaves, what is allowed and not indexed yet comes in."""
    allowed = documents.where(~ignored(F.col("source_file"), rules))
    known = old.patterns.select("source_file")
    changes = known.join(allowed.select("source_file"), "source_file", "left_anti").withColumn("change", F.lit("removed")).unionByName(allowed.select("source_file").join(known, "source_file", "left_anti").withColumn("change", F.lit("added")))
    return apply_delta(old, allowed, changes, vectors)


def summary(before: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: sources ``added``, ``changed``, ``removed`` and ``unchanged`` by a run."""
    counts = changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")])
    total = before.agg(F.count(F.lit(1)).alias("_before"))
    return counts.join(total).select("added", "changed", "removed", F.greatest(F.lit(0), F.col("_before") - F.col("changed") - F.col("removed")).alias("unchanged"))  # one row each


def advisories(documents: DataFrame) -> DataFrame:
    """One row on what is pinned: its sources, those with large bodies, tags nearly right, and whether there are too many."""
    rows = declared(documents).join(chunk_by_heading(documents, "source_file", "text").groupBy("source_file").agg(F.sum(F.octet_length("body")).alias("bytes")), "source_file", "left")
    name = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("source_file"))))
    pinned = F.col("is_universal")
    return rows.agg(
        F.count_if(pinned).alias("universal_count"), name(pinned).alias("universal_sources"), name(pinned & (F.col("bytes") > UNIVERSAL_WARNING)).alias("oversized"), name(F.size("near_tags") > 0).alias("near_misses"),
        (F.count_if(pinned) > UNIVERSAL_MANY).alias("count_warning"),
    )


# The earlier state: a note that was written again since ended before its last line, and the newest tenth was not there yet.
def _earlier(documents: DataFrame) -> DataFrame:
    before = F.regexp_replace("text", r"\n[^\n]*\s*\z", "")
    bounds = documents.agg(F.expr("percentile_approx(ingested_at, 0.9)").alias("_late"), F.expr("percentile_approx(ingested_at, 0.6)").alias("_mid"))
    rows = documents.join(F.broadcast(bounds))  # one row
    return rows.where("ingested_at <= _late").select("source_file", F.when(F.col("ingested_at") > F.col("_mid"), before).otherwise(F.col("text")).alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_vectors(spark, sf_dir).groupBy("chunk_id").agg(F.min_by("vector", "model").alias("vector")).withColumnRenamed("chunk_id", "id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source_file", "text", "ingested_at")


@query()
def ing1_full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, postings and hits of each source after a full run."""
    return _profile(build(_documents(spark, sf_dir), _vectors(spark, sf_dir)))


@query()
def ing2_delta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a delta run over an earlier state; it equals that of a full run."""
    now = _documents(spark, sf_dir)
    before, vectors = _earlier(now), _vectors(spark, sf_dir)
    digest = lambda df: df.select("source_file", F.md5("text").alias("h"))
    return _profile(apply_delta(build(before, vectors), now, change_set(digest(before), digest(now), "source_file", "h"), vectors))


@query()
def ing4_reconciled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after new ignore rules over the earlier state."""
    now, vectors = _documents(spark, sf_dir), _vectors(spark, sf_dir)
    return _profile(reconcile(build(_earlier(now), vectors), now, IGNORE, vectors))


def _profile(made: Index) -> DataFrame:
    posts = made.postings.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("hits").alias("hits"))
    chunks = made.chunks.join(posts, "id", "left").groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"), F.sum("terms").alias("terms"), F.round(F.sum("hits"), 3).alias("hits"), F.md5(F.array_join(F.array_sort(F.collect_list("id")), "|")).alias("ids"))
    return made.patterns.select("source_file", "title", "tags", "language_json", "content_hash").join(chunks, "source_file", "left")


_OLD_SQL = r"""SELECT source_file, CASE WHEN ingested_at > (SELECT quantile_disc(ingested_at, 0.6) FROM documents) THEN regexp_replace(text, '\n[^\n]*\s*$', '') ELSE text END AS text FROM documents WHERE ingested_at <= (SELECT quantile_disc(ingested_at, 0.9) FROM documents)"""


@query(
    f"SELECT d.source_file, CASE WHEN o.source_file IS NULL THEN 'added' ELSE 'changed' END AS change FROM documents d LEFT JOIN ({_OLD_SQL}) o USING (source_file) WHERE o.source_file IS NULL OR md5(o.text) <> md5(d.text)"
)
def src3_document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added and changed in the documents since their earlier state."""
    now = _documents(spark, sf_dir)
    digest = lambda df: df.select("source_file", F.md5("text").alias("h"))
    return change_set(digest(_earlier(now)), digest(now), "source_file", "h")


@query(
    f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, 0::BIGINT AS removed, (SELECT count(*) FROM ({_OLD_SQL})) - count(*) FILTER (change = 'changed') AS unchanged FROM "
    f"(SELECT CASE WHEN o.source_file IS NULL THEN 'added' ELSE 'changed' END AS change FROM documents d LEFT JOIN ({_OLD_SQL}) o USING (source_file) WHERE o.source_file IS NULL OR md5(o.text) <> md5(d.text))"
)
def agg11_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _documents(spark, sf_dir)
    return summary(_earlier(now), src3_document_changes(spark, sf_dir))


_LANGUAGE_SQL = r"""SELECT source_file, unnest(list_filter(list_transform(CASE WHEN head = '' THEN string_split_regex(trim(below, chr(10)), '\n') WHEN head LIKE '[%]' THEN string_split(trim(head, '[]'), ',') ELSE [head] END, lambda x: lower(trim(trim(regexp_replace(x, '^[ ]*- ?', '')), '"' || chr(39)))), lambda x: x <> '')) AS token
FROM (SELECT source_file, trim(regexp_extract(f, '(?m)^language:([^\n]*)', 1)) AS head, regexp_extract(f, '(?m)^language:[^\n]*\n((?:(?:  -|- )[^\n]*(?:\n|$))*)', 1) AS below, f
FROM (SELECT source_file, regexp_extract(regexp_replace(text, '\r\n?', chr(10), 'g'), '\A---\n((?s:.*?))\n---', 1) AS f FROM documents) WHERE regexp_matches(f, '(?m)^language:'))"""


@query(_LANGUAGE_SQL)
def doc8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that each document declares."""
    fronts = table(spark, sf_dir, "documents").select("source_file", T.front_matter(F.col("text")).alias("front"))
    return fronts.select("source_file", F.explode(front_matter.language_list(F.col("front"))).alias("token"))


@query(f"SELECT token, count(DISTINCT source_file) AS files FROM ({_LANGUAGE_SQL}) WHERE token NOT IN ({', '.join(map(repr, languages.TOKENS))}) GROUP BY token")
def ing6_unknown_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for each declared language that is not known."""
    rows = declared(table(spark, sf_dir, "documents")).select("source_file", F.explode(F.array_distinct(front_matter.unknown_languages(F.col("languages")))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("files"))


@query()
def agg6_universal_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advisories(table(spark, sf_dir, "documents"))


@query(f"SELECT source_file, 'removed' AS change FROM patterns WHERE {IGNORED_SQL} UNION ALL SELECT source_file, 'added' FROM documents WHERE NOT ({IGNORED_SQL}) AND source_file NOT IN (SELECT source_file FROM patterns)")
def jn8_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new ignore rules take out of the patterns, and which allowed documents are not among them yet."""
    old, disk = table(spark, sf_dir, "patterns").select("source_file"), table(spark, sf_dir, "documents").select("source_file")
    out = old.where(ignored(F.col("source_file"), IGNORE)).withColumn("change", F.lit("removed"))
    return out.unionByName(disk.where(~ignored(F.col("source_file"), IGNORE)).join(old, "source_file", "left_anti").withColumn("change", F.lit("added")))
