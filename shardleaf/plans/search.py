"""Hybrid search: words and vectors of one query, fused, gated and capped."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardleaf.functions import languages
from shardleaf.functions import text as T
from shardleaf.operators import retrieval
from shardleaf.plans.index import VECTORS_SQL, current_vectors
from shardleaf.registry import SQL_WORDS, query
from shardleaf.sources.tables import table

FIELD_WEIGHTS = {"title": 10.0, "body": 1.0, "tags": 5.0, "source_file": 0.0}
LIMIT = 10
LEAST, LEAST_UNIVERSAL = 0.3, 0.25


def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build_index(table(spark, sf_dir, "chunks"), "id", FIELD_WEIGHTS, "language_json")


def bm25_ctes(asked: str) -> str:
    """The statistics of BM25 in SQL; ``asked`` selects ``qid, term``."""
    return f"""
asked AS ({asked}),
tok AS (SELECT id, unnest({SQL_WORDS.format("title")}) AS term, 10.0::DOUBLE AS w FROM chunks UNION ALL SELECT id, unnest({SQL_WORDS.format("body")}), 1.0 FROM chunks
  UNION ALL SELECT id, unnest({SQL_WORDS.format("tags")}), 5.0 FROM chunks UNION ALL SELECT id, unnest({SQL_WORDS.format("source_file")}), 0.0 FROM chunks),
post AS (SELECT id, term, sum(w) AS hits FROM tok GROUP BY ALL), len AS (SELECT id, count(*) AS d FROM tok GROUP BY id),
st AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM chunks) AS av),
idf AS (SELECT term, greatest(ln((st.n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS v FROM post, st GROUP BY term, st.n)"""


PART_SQL = "v * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * d / st.av))"
KNOWN_SQL = f"term IN ({', '.join(map(repr, languages.TOKENS))})"


def asked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, chunk_id, model, vector, words, langs``: chunks to find others like, those whose current answer's id is divisible by 50."""
    known = F.array(*map(F.lit, languages.TOKENS))
    chunks = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), F.array_distinct(T.split_into_words(F.col("title"))).alias("words"), T.json_list(F.col("language_json")).alias("declared"))
    rows = current_vectors(spark, sf_dir).where("response_id % 50 = 0").withColumnRenamed("response_id", "qid").join(chunks, "chunk_id")
    spoken = F.array_intersect(F.concat(F.coalesce("declared", F.array().cast("array<string>")), "words"), known)
    return rows.select("qid", "chunk_id", "model", "vector", F.array_except("words", known).alias("words"), F.array_distinct(spoken).alias("langs"), F.col("words").alias("all_words"))


def vector_list(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    """``qid, id, distance, rank``: the k nearest current vectors of the same model; the chunk itself is left out."""
    vectors = current_vectors(spark, sf_dir).checkpoint()
    lists = []
    for r in vectors.select("model", F.size("vector").alias("n")).distinct().orderBy("model", "n").collect():  # models and widths are few
        same = (F.col("model") == r.model) & (F.size("vector") == r.n)
        near = retrieval.nearest(vectors.where(same).select("chunk_id", "vector"), asked.where(same).select("chunk_id", "vector"), "chunk_id", "vector", k)
        lists.append(near.select(F.col("query_id").alias("asked"), "chunk_id", "distance", "rank").withColumn("model", F.lit(r.model)))
    if not lists:
        return asked.select("qid", F.col("chunk_id").alias("id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
    found = reduce(DataFrame.unionByName, lists)
    return found.join(asked.select("qid", F.col("chunk_id").alias("asked"), "model"), ["asked", "model"]).select("qid", F.col("chunk_id").alias("id"), "distance", "rank")


def without_own(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """A ranked list without the chunk that asks, ranked again."""
    others = found.join(asked.select("qid", "chunk_id"), "qid").where(F.col("id") != F.col("chunk_id")).drop("chunk_id", "rank")
    return retrieval.ranked(others, "qid", "score", "id", k)


_CURRENT = f"cur AS ({VECTORS_SQL}), q AS (SELECT response_id AS qid, chunk_id, model, v AS vec FROM cur WHERE response_id % 50 = 0),"
_VECTOR_LIST = "SELECT q.qid, c.chunk_id AS id, list_distance(q.vec::DOUBLE[], c.v::DOUBLE[]) AS distance FROM q JOIN cur c ON c.model = q.model AND len(c.v) = len(q.vec) AND c.chunk_id <> q.chunk_id"
_HYBRID_SQL = f"""WITH {_CURRENT} {bm25_ctes(f"SELECT DISTINCT qid, unnest({SQL_WORDS.format('title')}) AS term FROM q JOIN chunks ON id = chunk_id")},
s AS (SELECT qid, id, round(sum({PART_SQL}), 6) AS score FROM asked JOIN post USING (term) JOIN len USING (id) JOIN idf USING (term), st GROUP BY qid, id),
l AS (SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, id) AS rank FROM s JOIN q ON q.qid = s.qid AND q.chunk_id <> s.id),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM ({_VECTOR_LIST})),
f AS (SELECT qid, id, sum(1 / (60 + rank)) / (2 / 61) AS fused, max(score) AS score_lexical, max(distance) AS distance FROM (SELECT qid, id, rank, score, NULL AS distance FROM l WHERE rank <= {2 * LIMIT} UNION ALL SELECT qid, id, rank, NULL, distance FROM w WHERE rank <= {2 * LIMIT}) GROUP BY qid, id),
h AS (SELECT qid, id, round(fused, 9) AS fused, round(score_lexical, 6) AS score_lexical, round(distance, 6) AS score_vector, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rank FROM f)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fused row of each asked chunk, with the scores of both lists and its rank."""
    asked = asked_chunks(spark, sf_dir).checkpoint()
    words = retrieval.search(lexical_index(spark, sf_dir), "id", asked.select("qid", F.array("all_words").alias("groups")), "qid", 2 * LIMIT + 1)
    lexical = without_own(words, asked, 2 * LIMIT)
    vectors = vector_list(spark, sf_dir, asked, 2 * LIMIT)
    fused = retrieval.fuse([lexical, vectors], "qid", "id", {"score_lexical": (0, "score"), "score_vector": (1, "distance")})
    rows = fused.select("qid", "id", F.round("fused", 9).alias("fused"), F.round("score_lexical", 6).alias("score_lexical"), F.round("score_vector", 6).alias("score_vector"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused"), "id")))


@query(f"{_HYBRID_SQL} SELECT * FROM h WHERE rank <= {LIMIT}")
def ret3_hybrid_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks most like a chunk by the words of its title and by its vector, with the scores of either list."""
    return _hybrid(spark, sf_dir).where(F.col("rank") <= LIMIT)


@query(
    f"""{_HYBRID_SQL}, t AS (SELECT h.qid, h.id, h.fused, is_universal, row_number() OVER (PARTITION BY h.qid, is_universal ORDER BY h.rank) AS n FROM h JOIN chunks c ON c.id = h.id
    WHERE h.score_vector IS NULL OR h.fused >= CASE WHEN is_universal THEN {LEAST_UNIVERSAL} ELSE {LEAST} END)
    SELECT qid, id, fused, is_universal, row_number() OVER (PARTITION BY qid ORDER BY is_universal DESC, n) AS place FROM t WHERE is_universal OR n <= 5"""
)
def ret8_hybrid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results over the threshold of their class: all pinned ones first, then the best five others.

    The threshold applies to rows that the vectors helped to find; scores of words alone are of another scale.
    """
    rows = _hybrid(spark, sf_dir).join(table(spark, sf_dir, "chunks").select("id", "is_universal"), "id")
    kept = rows.where(F.col("score_vector").isNull() | retrieval.passes_threshold(F.col("fused"), F.col("is_universal"), LEAST, LEAST_UNIVERSAL))
    capped = kept.withColumn("n", F.row_number().over(Window.partitionBy("qid", "is_universal").orderBy("rank"))).where("is_universal OR n <= 5")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("is_universal"), "n"))
    return capped.select("qid", "id", "fused", "is_universal", place.alias("place"))


_DECLARED = """CASE WHEN json_valid(language_json) THEN from_json(language_json, '["VARCHAR"]') END"""


@query(
    f"""WITH {_CURRENT} {bm25_ctes(f"SELECT DISTINCT qid, unnest(list_concat({SQL_WORDS.format('title')}, list_filter(coalesce({_DECLARED}, []), lambda x: {KNOWN_SQL.replace('term', 'x')}))) AS term FROM q JOIN chunks ON id = chunk_id")},
s AS (SELECT qid, id, round(sum({PART_SQL}), 6) AS whole, round(sum({PART_SQL}) FILTER (NOT {KNOWN_SQL}), 6) AS by_terms, bool_or({KNOWN_SQL}) AS hl, bool_or(NOT {KNOWN_SQL}) AS ht FROM asked JOIN post USING (term) JOIN len USING (id) JOIN idf USING (term), st GROUP BY qid, id),
n AS (SELECT qid, coalesce(list(term) FILTER ({KNOWN_SQL}), []) AS langs, count(*) FILTER ({KNOWN_SQL}) AS nl, count(*) FILTER (NOT {KNOWN_SQL}) AS nt FROM asked GROUP BY qid),
r AS (SELECT s.*, n.* EXCLUDE (qid), language_json FROM s JOIN n USING (qid) JOIN q USING (qid) JOIN chunks USING (id) WHERE q.chunk_id <> id),
w AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM ({_VECTOR_LIST})),
g AS (SELECT w.qid, w.id, row_number() OVER (PARTITION BY w.qid ORDER BY w.rank) AS rank FROM w JOIN n USING (qid) JOIN chunks c ON c.id = w.id WHERE w.rank <= {6 * LIMIT} AND (c.language_json IS NULL OR nl = 0 OR coalesce(list_has_any(CASE WHEN json_valid(c.language_json) THEN from_json(c.language_json, '["VARCHAR"]') END, langs), false))),
l AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY whole DESC, id) AS rank FROM r WHERE language_json IS NULL AND (nl = 0 OR hl) AND (nt = 0 OR ht)
  UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY by_terms DESC, id) FROM r WHERE ht AND coalesce(list_has_any({_DECLARED}, langs), false)
  UNION ALL FROM g)
SELECT * FROM (SELECT qid, id, round(fused, 9) AS fused, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rank FROM (SELECT qid, id, sum(1 / (60 + rank)) / (3 / 61) AS fused FROM l WHERE rank <= {2 * LIMIT} GROUP BY qid, id)) WHERE rank <= {LIMIT}"""
)
def ret5_gated_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback, structural and vector list of each asked chunk, fused: the vectors pass the language gate after their first rank."""
    asked = asked_chunks(spark, sf_dir).checkpoint()
    index = lexical_index(spark, sf_dir)
    lists = [without_own(retrieval.search(index, "id", q, "qid", 2 * LIMIT + 1), asked, 2 * LIMIT) for q in retrieval.gated(asked, "qid", "langs", "words")]
    near = vector_list(spark, sf_dir, asked, 6 * LIMIT).join(asked.select("qid", "langs"), "qid").join(table(spark, sf_dir, "chunks").select("id", "language_json"), "id")
    passed = near.where((F.size("langs") == 0) | retrieval.language_gate(T.json_list(F.col("language_json")), F.col("langs"), F.col("language_json")))
    gated = passed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= 2 * LIMIT)
    fused = retrieval.fuse([*lists, gated], "qid", "id").withColumn("fused", F.round("fused", 9))
    return retrieval.ranked(fused, "qid", "fused", "id", LIMIT)


@query(
    f"""WITH {bm25_ctes(f"SELECT DISTINCT description AS qid, unnest({SQL_WORDS.format('description')}) AS term FROM call_contexts WHERE description <> ''")},
h AS (SELECT qid, id, round(sum({PART_SQL}), 6) AS score, count(*) AS met FROM asked JOIN post USING (term) JOIN len USING (id) JOIN idf USING (term), st GROUP BY qid, id),
m AS (SELECT h.* FROM h JOIN (SELECT qid, count(*) AS n FROM asked GROUP BY qid) USING (qid) WHERE met = n)
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= {LIMIT}"""
)
def ret9_text_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten chunks that hold every word of a description, for each description of a call."""
    asked = table(spark, sf_dir, "call_contexts").where("description <> ''").select(F.col("description").alias("qid")).distinct()
    groups = F.transform(F.array_distinct(T.split_into_words(F.col("qid"))), lambda w: F.array(w))
    return retrieval.search(lexical_index(spark, sf_dir), "id", asked.withColumn("groups", groups), "qid", LIMIT).select("qid", "id", "rank")
