"""Batch retrieval: BM25 over an index that is built once, exact nearest vectors in blocks, rank fusion, gates."""

import json
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shardleaf.functions.stem import search_form
from shardleaf.functions.text import search_tokens, split_into_words
from shardleaf.operators import packs

K1, B, RRF_K = 1.2, 0.75, 60


def build_index(df: DataFrame, id_col: str, weights: dict[str, float], declared_col: str | None = None, stemmed: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, length, terms, hits, declared`` and the columns ``also`` of each row: its terms with their weighted hits, as a table written once.

    Terms are words of letters, or if ``stemmed`` tokens with their digits, without accents, as stems. A term of a column
    of weight 0 matches with 0 hits. ``declared`` is the text of the declaring column. A map over rows without shuffle; it is written packed.
    """
    words = search_tokens if stemmed else split_into_words
    declared = F.lit(None).cast("string") if declared_col is None else F.col(declared_col)
    given = df.select(F.col(id_col).alias("_id"), declared.alias("_declared"), *also, *[F.coalesce(words(F.col(c)), F.array().cast("array<string>")).alias(f"_w{i}") for i, c in enumerate(weights)])
    schema = T.StructType([T.StructField(id_col, given.schema["_id"].dataType), T.StructField("length", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType()), *[given.schema[c] for c in also]])

    def count(batches):
        known: dict[str, str] = {}
        for batch in batches:
            fields = [batch.column(f"_w{i}").to_pylist() for i in range(len(weights))]
            lengths, terms, hits = [], [], []
            for row in zip(*fields):
                found: dict[str, float] = {}
                length = 0
                for weight, tokens in zip(weights.values(), row):
                    for token, n in Counter(tokens).items():
                        if stemmed:
                            if token not in known:
                                if len(known) > 200_000:
                                    known.clear()
                                known[token] = search_form(token)
                            token = known[token]
                            if not token:
                                continue
                        found[token] = found.get(token, 0.0) + weight * n
                        length += n
                lengths.append(length)
                terms.append(list(found))
                hits.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.float64())), batch.column("_declared"), *[batch.column(c) for c in also]], names=schema.names)

    return packs.written(given, by=count, schema=schema)


def _idf(df: Column, rows: int) -> Column:
    return F.greatest(F.log((F.lit(rows) - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def parts(index: DataFrame, id_col: str, terms: DataFrame, rows: int, mean: float) -> DataFrame:
    """``id_col, declared, term, part``: what each of the ``terms`` (a column of distinct ones) adds to the score of a row that holds it.

    ``rows`` and their ``mean`` length are those of the whole index.
    """
    post = index.select(id_col, "length", "declared", F.explode(F.arrays_zip("terms", "hits")).alias("_t")).select(id_col, "length", "declared", F.col("_t.terms").alias("term"), F.col("_t.hits").alias("tf"))
    post = post.join(terms, "term")
    idf = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", _idf(F.col("df"), rows).alias("idf"))
    tf = F.col("tf")
    return post.join(idf, "term").select(id_col, "declared", "term", (F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))).alias("part"))


def weighed(index: DataFrame, id_col: str, terms: DataFrame, most_known: int = 200_000) -> tuple[DataFrame, Callable | None, dict[str, float] | None, int]:
    """Rows, what makes of their batches ``id, declared, terms, hits, small, norm`` of those that hold any of the ``terms``, the weights of these, and how many postings at most.

    Up to ``most_known`` terms are known everywhere: rows carry their places among the weights, and no posting is shuffled.
    Where all hits of a row are whole numbers of a byte, they stand in ``small``. Of more terms rows carry names and, as
    hits, what each adds to the score; they need no more making, and the weights are None. A column ``_part`` stays.
    """
    whole = index.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.sum(F.size("terms")).alias("postings")).head()
    mean = (whole.total or 0) / max(1, whole.n) or 1.0
    some = terms.limit(most_known + 1).collect()
    if len(some) > most_known:
        rows = parts(index, id_col, terms, whole.n, mean).groupBy(F.col(id_col).alias("id"), "declared").agg(F.collect_list(F.struct("term", "part")).alias("_p"))
        return rows.select("id", "declared", F.col("_p.term").alias("terms"), F.col("_p.part").alias("hits"), F.lit(None).cast("array<tinyint>").alias("small"), F.lit(0.0).alias("norm")), None, None, whole.postings or 0
    spark = index.sparkSession
    post = index.select(F.explode("terms").alias("term")).join(F.broadcast(spark.createDataFrame([(r.term,) for r in some], "term string")), "term")
    found = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", _idf(F.col("df"), whole.n).alias("idf")).collect()
    names = spark.sparkContext.broadcast([r.term for r in found])
    given = index.select(F.col(id_col).alias("id"), "declared", "terms", "hits", (K1 * (1 - B + B * F.col("length") / F.lit(mean))).alias("norm"))
    kind = pa.int16() if len(found) < 2**15 else pa.int32()

    def known(batches):
        listed = pa.array(names.value, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            places = pc.index_in(lists.flatten(), value_set=listed)
            here = places.is_valid()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            row, places, hits = row[here.to_numpy(zero_copy_only=False)], places.filter(here), batch.column("hits").flatten().filter(here).to_numpy()
            counts = np.bincount(row, minlength=len(lists))
            ends = np.concatenate([[0], np.cumsum(counts[counts > 0])])
            large = np.bincount(row[(hits < 0) | (hits > 127) | (hits != np.floor(hits))], minlength=len(lists)) > 0
            rest = batch.filter(pa.array(counts > 0))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places.cast(kind))
            packed = [pack(ends, hits[of[row]], of[counts > 0], to) for of, to in ((large, pa.float64()), (~large, pa.int8()))]
            kept = {"id": rest.column("id"), "declared": rest.column("declared"), "terms": terms, "hits": packed[0], "small": packed[1], "norm": rest.column("norm")}
            yield pa.RecordBatch.from_pydict(kept | {c: rest.column(c) for c in rest.schema.names if c == "_part"})

    def pack(ends: np.ndarray, hits: np.ndarray, here: np.ndarray, to: pa.DataType) -> pa.Array:
        """The hits of the rows that are here, null for others."""
        own = np.concatenate([[0], np.cumsum(np.where(here, np.diff(ends), 0))])
        return pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(hits, to), mask=pa.array(~here))

    return given, known, {r.term: r.idf for r in found}, sum(r.df for r in found)


class Lists:
    """The postings of ``n`` rows by term: term ``t`` has those from ``begin[t]`` to ``begin[t + 1]``. ``back`` has the rows' places in the shard."""

    def __init__(self, n: int, rows: np.ndarray, parts: np.ndarray, begin: np.ndarray, back: np.ndarray):
        self.n, self.rows, self.parts, self.begin, self.back = n, rows, parts, begin, back
        self.dense: dict[int, np.ndarray] = {}

    def only(self, keep: np.ndarray) -> "Lists":
        """Those of some rows."""
        held = keep[self.rows]
        begin = np.concatenate([[0], np.cumsum(held)])[self.begin]
        return Lists(int(keep.sum()), (np.cumsum(keep) - 1)[self.rows[held]], self.parts[held], begin, self.back[keep])

    def add(self, t: int, scores: np.ndarray) -> None:
        a, b = self.begin[t], self.begin[t + 1]
        if (b - a) * 8 < self.n:
            scores[self.rows[a:b]] += self.parts[a:b]
            return
        if t not in self.dense:
            self.dense[t] = np.zeros(self.n)
            self.dense[t][self.rows[a:b]] = self.parts[a:b]
        scores += self.dense[t]

    def sums(self, terms: list[int]) -> np.ndarray:
        """Over 0 where a row holds one of the terms."""
        scores = np.zeros(self.n)
        for t in terms:
            self.add(t, scores)
        return scores

    def top(self, scores: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard and rounded scores of the k best rows over 0, the first of equal ones."""
        width, least, slack = 64, 0.0, 2 * 10.0**-digits
        if self.n >= 2 * k * width:  # k stretches have a row as good as the least of their best
            best = scores[: self.n // width * width].reshape(-1, width).max(axis=1)
            least = np.partition(best, -k)[-k] - slack
        at = np.flatnonzero(scores >= least) if least > 0 else np.flatnonzero(scores > 0)
        found = scores[at]
        if len(at) > k:
            near = found >= np.partition(found, -k)[-k] - slack
            at, found = at[near], found[near]
        found = np.round(found, digits)
        order = np.argsort(-found, kind="stable")[:k]
        return self.back[at[order]], found[order]


class Shard:
    """The postings of some rows (a table as ``weighed`` gives it), in the order of their ids."""

    LEAST = 1e-300  # what a term without hits adds, so that a row that holds a term has a score over 0

    def __init__(self, table: pa.Table, weights: dict[str, float] | None):
        ids, norm = np.array(table["id"].to_pylist()), table["norm"].to_numpy()
        if ids.dtype.kind not in "iu":
            ids = np.array(table["id"].to_pylist(), object)
        self.ids, first, at = np.unique(ids, return_index=True, return_inverse=True)
        lists = table["terms"].combine_chunks()
        counts, codes, hits = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten(), np.zeros(int(pc.sum(pc.list_value_length(lists)).as_py()))
        for name in ("hits", "small"):
            given = table[name].combine_chunks()
            hits[np.repeat(given.is_valid().to_numpy(zero_copy_only=False), counts)] = given.flatten().to_numpy()
        if weights is None:
            codes = codes.dictionary_encode()
            self.terms, codes = {t: i for i, t in enumerate(codes.dictionary.to_pylist())}, codes.indices.to_numpy()
        else:
            self.terms, codes = {t: i for i, t in enumerate(weights)}, codes.to_numpy()
            hits = np.array([*weights.values()])[codes] * hits * (K1 + 1) / (hits + np.repeat(norm, counts))
        rows = np.repeat(at, counts)
        order = np.lexsort((rows, codes))
        rows, codes, parts = rows[order], codes[order], np.maximum(hits[order], self.LEAST)
        if len(self.ids) < len(ids):  # a row that comes twice counts once
            once = np.append((rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1]), True)
            rows, codes, parts = rows[once], codes[once], parts[once]
        self.whole = Lists(len(self.ids), rows, parts, np.searchsorted(codes, np.arange(len(self.terms) + 1)), np.arange(len(self.ids)))
        declared = table["declared"].combine_chunks().dictionary_encode()
        texts, of = declared.dictionary.to_pylist(), declared.indices.fill_null(-1).to_numpy()[first]
        self.undeclared, self.speaks = of < 0, {}
        for i, text in enumerate(texts):
            try:
                tokens = {t for t in json.loads(text) if isinstance(t, str)}
            except (ValueError, TypeError):
                tokens = set()
            for token in tokens:
                self.speaks[token] = self.speaks.get(token, np.zeros(len(of), bool)) | (of == i)

    def gate(self, tokens: tuple[str, ...]) -> np.ndarray:
        """Rows that declare one of the languages; without languages those that declare nothing."""
        return np.any([self.speaks.get(t, np.zeros(len(self.ids), bool)) for t in tokens], axis=0) if tokens else self.undeclared

    def best(self, queries: list[tuple], k: int, digits: int, shared: int = 32):
        """Number, places and scores of the k best rows of each (groups, without, gate).

        Queries that share their gate, and their first group where they have others, are taken together, over the rows that pass these.
        """
        codes = lambda terms: [self.terms[t] for t in terms if t in self.terms]
        gates: dict = {}
        for q, (groups, without, gate) in enumerate(queries):
            gates.setdefault(None if gate is None else tuple(sorted(set(gate))), {}).setdefault(tuple(sorted(groups[0])) if len(groups) > 1 else None, []).append(q)
        for gate, firsts in gates.items():
            passed = self.whole if gate is None else self.whole.only(self.gate(gate))
            for first, members in firsts.items():
                lists, base = passed, None
                if first is not None and len(members) >= shared:
                    base = passed.sums(codes(first))
                    lists, base = passed.only(base > 0), base[base > 0]
                for q in members if lists.n else ():
                    groups, without, _ = queries[q]
                    scores = None
                    for group in groups if base is None else groups[1:]:
                        one = lists.sums(codes(group))
                        scores = one if scores is None else np.where((scores > 0) & (one > 0), scores + one, 0)
                    if base is not None:
                        scores = np.where(scores > 0, scores + base, 0)
                    for t in codes(without):
                        scores[lists.rows[lists.begin[t] : lists.begin[t + 1]]] = 0
                    yield q, *lists.top(scores, k, digits)


def matches(index: DataFrame, id_col: str, asked: DataFrame, k: int, digits: int = 6, shard_rows: int = 262_144, block_queries: int = 524_288, shard_postings: int = 8_000_000) -> DataFrame:
    """``_q, id, score``: the k best rows of each query ``_q`` in each shard, for ``asked`` as in ``search``; it is read several times.

    Each block of queries meets each shard in one task. There are few shards, since queries and results travel once a
    shard, and as few blocks as keep all cores busy, since the postings of the asked terms travel once a block. Both
    travel packed. A query that comes again counts once.
    """
    spark = index.sparkSession
    vocabulary = asked.select(F.explode(F.concat(F.flatten("groups"), F.coalesce("without", F.array().cast("array<string>")))).alias("term")).where("term IS NOT NULL").distinct()
    rows, made, weights, postings = weighed(index, id_col, vocabulary)
    wanted = asked.count()
    shards = max(1, -(-index.count() // shard_rows), -(-postings // shard_postings))
    blocks = max(1, -(-wanted // block_queries), min(-(-spark.sparkContext.defaultParallelism // shards), -(-wanted // 4096)))
    task = lambda shard, block: (shard * blocks + block).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_n")
    left = packs.packed(rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), by=made).select(F.lit(True).alias("_row"), "_pack", "_part", every(blocks)).withColumn("_task", task(F.col("_part"), F.col("_n")))
    right = packs.packed(asked.select("_q", "groups", "without", "gate", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int").alias("_part")), once="_q").select(F.lit(False).alias("_row"), "_pack", "_part", every(shards)).withColumn("_task", task(F.col("_n"), F.col("_part")))
    schema = T.StructType([T.StructField("_q", asked.schema["_q"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    known = None if weights is None else spark.sparkContext.broadcast(weights)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def best(batches):
        held, queries, seen = [], [], set()
        for batch in batches:
            for row, pack in zip(batch.column("_row").to_pylist(), batch.column("_pack").to_pylist()):
                (held if row else queries).append(pack)
        if not held or not queries:
            return
        shard = Shard(pa.Table.from_batches([packs.rows_of(pack) for pack in held]), None if known is None else known.value)
        del held
        for part in parts_of(queries, seen):
            listed = [(g, w or (), gate) for g, w, gate in zip(*(part[c].to_pylist() for c in ("groups", "without", "gate")))]
            found = [x for x in shard.best(listed, k, digits) if len(x[1])]
            if found:
                q = np.repeat([q for q, _, _ in found], [len(at) for _, at, _ in found])
                ids, scores = shard.ids[np.concatenate([at for _, at, _ in found])], np.concatenate([x for _, _, x in found])
                yield pa.RecordBatch.from_arrays([part["_q"].combine_chunks().take(pa.array(q)).cast(kinds[0]), pa.array(ids.tolist(), kinds[1]), pa.array(scores)], names=schema.names)

    def parts_of(queries, seen, rows=16_384):
        """Tables of about so many queries, of each the first; packs are opened as they are needed."""
        some, n = [], 0
        for at, pack in enumerate(queries):
            batch = packs.rows_of(pack)
            names = batch.column("_q").to_pylist()
            new = [not (q in seen or seen.add(q)) for q in names]
            some.append(batch if all(new) else batch.filter(pa.array(new, pa.bool_())))
            n += len(some[-1])
            if n >= rows or at == len(queries) - 1:
                table, n = pa.Table.from_batches(some), 0
                some = []
                yield from (table.slice(low, rows) for low in range(0, len(table), rows))

    return left.unionByName(right).select("_row", "_pack", "_task").repartitionById(shards * blocks, "_task").drop("_task").mapInArrow(best, schema)


def search(index: DataFrame, id_col: str, queries: DataFrame, query_id: str, k: int, stemmed: bool = False, digits: int = 6, **how) -> DataFrame:
    """``query_id, id_col, score, rank``: the k best rows of each query by BM25, ties by id.

    ``queries`` has ``groups`` (lists of terms: a row must hold a term of each; a repeated term counts again), and may
    have ``without`` (terms that it must not hold) and ``gate``: null for none, an empty list for rows that declare
    nothing, else languages of which the row must declare one. A query without groups finds nothing. If ``stemmed``,
    terms meet by their search form. Scores are rounded so that sums in another order tie alike.

    Shards of rows meet blocks of queries (``how`` is for ``matches``); each pair keeps k rows a query. What is shuffled is
    the postings of the asked terms and k rows a query and shard, never all matches.
    """
    for name, kind in (("without", "array<string>"), ("gate", "array<string>")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    asked = queries.select(F.col(query_id).alias("_q"), "groups", "without", "gate").where("size(groups) > 0")
    if stemmed:

        @F.pandas_udf("array<array<string>>")
        def formed(lists: pd.Series) -> pd.Series:
            return lists.map(lambda groups: [[f for t in g if (f := search_form(t))] for g in groups])

        asked = asked.withColumn("_f", formed(F.array_append("groups", F.coalesce("without", F.array().cast("array<string>")))))
        asked = asked.withColumns({"groups": F.filter(F.slice("_f", 1, F.size("_f") - 1), lambda g: F.size(g) > 0), "without": F.element_at("_f", -1)}).drop("_f").where("size(groups) > 0")
    found = matches(index, id_col, asked.checkpoint(), k, digits, **how)
    return ranked(found, "_q", "score", "id", k).select(F.col("_q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def gated(queries: DataFrame, query_id: str, languages_col: str, terms_col: str) -> tuple[DataFrame, DataFrame]:
    """The fallback and the structural form of each query, for ``search``.

    The fallback wants rows that declare no language, with any of the query's languages as a word (where it has
    languages) and any of its terms (where it has terms). The structural one wants rows that declare a language of the
    query and hold any of its terms; a query without languages or without terms has none.
    """
    fallback, structural = gated_forms(languages_col, terms_col)
    return queries.select(query_id, fallback.alias("_f")).select(query_id, "_f.groups", "_f.gate"), queries.select(query_id, structural.alias("_f")).where("_f IS NOT NULL").select(query_id, "_f.groups", "_f.gate")


def gated_forms(languages_col: str, terms_col: str) -> tuple[Column, Column]:
    """``groups, gate`` of the fallback and of the structural form, null where a query has none."""
    none = F.array().cast("array<string>")
    langs, words = F.coalesce(languages_col, none), F.coalesce(terms_col, none)
    fallback = F.struct(F.filter(F.array(langs, words), lambda g: F.size(g) > 0).alias("groups"), none.alias("gate"))
    return fallback, F.when((F.size(langs) > 0) & (F.size(words) > 0), F.struct(F.array(words).alias("groups"), langs.alias("gate")))


def search_gated(index: DataFrame, id_col: str, queries: DataFrame, query_id: str, languages_col: str, terms_col: str, k: int, **how) -> list[DataFrame]:
    """The fallback and the structural list of queries whose ids are texts, found in one search."""
    marked = [q.withColumn(query_id, F.concat(F.lit(mark), F.col(query_id))) for mark, q in zip("fs", gated(queries, query_id, languages_col, terms_col))]
    found = search(index, id_col, marked[0].unionByName(marked[1]), query_id, k, **how).checkpoint()
    return [found.where(F.col(query_id).startswith(mark)).withColumn(query_id, F.expr(f"substring({query_id}, 2)")) for mark in "fs"]


def match_groups(query: Column) -> Column:
    """The groups of an inferred query: ``a AND (b OR c)`` wants a, and b or c."""
    sides = F.transform(F.split(query, r"\s+AND\s+"), lambda side: F.regexp_replace(side, r"\s+OR\s+", " "))
    return F.filter(F.transform(sides, search_tokens), lambda g: F.size(g) > 0)


def ranked(df: DataFrame, query_id: str, score: str, id_col: str, limit: int, ascending: bool = False) -> DataFrame:
    """The best rows of each query with ``rank`` from 1; ties go by id."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(order, id_col))).where(F.col("rank") <= limit)


def fuse(lists: list[DataFrame], query_id: str, id_col: str, scores: dict[str, tuple[int, str]] | None = None, n: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists into ``query_id, id_col, fused`` from 0 to 1; ``n`` lists, where several come as one.

    ``scores`` names further columns: the score of a row in one of the lists (its number and column), null where the list lacks the row.
    """
    scores = scores or {}
    own = [[F.col(column).cast("double").alias(name) if at == n else F.lit(None).cast("double").alias(name) for name, (n, column) in scores.items()] for at in range(len(lists))]
    every = lists[0].select(query_id, id_col, "rank", *own[0])
    for one, kept in zip(lists[1:], own[1:]):
        every = every.unionAll(one.select(query_id, id_col, "rank", *kept))
    return every.groupBy(query_id, id_col).agg((F.sum(1 / (RRF_K + F.col("rank"))) / ((n or len(lists)) / (RRF_K + 1))).alias("fused"), *[F.max(n).alias(n) for n in scores])


def nearest(corpus: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, block: int = 2048) -> DataFrame:
    """``query_id, id_col, distance`` of the k nearest rows for each query, exact, a row never for itself.

    Queries form blocks of at most about ``block`` vectors; each task multiplies its rows with one block and keeps k
    rows a query, so that what is shuffled is k rows for a query and task, never all pairs.
    """
    n_blocks = max(1, -(-queries.count() // block))
    kind = corpus.schema[id_col].dataType
    held = lambda df: F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = queries.select(F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).alias("_b"), held(queries).alias("_q")).groupBy("_b").agg(F.array_sort(F.collect_list("_q")).alias("_q"))
    packs = corpus.select(F.spark_partition_id().alias("_p"), F.pmod(F.xxhash64(id_col), F.lit(64)).alias("_s"), held(corpus).alias("_r")).groupBy("_p", "_s").agg(F.collect_list("_r").alias("_r"))
    schema = T.StructType([T.StructField("query_id", kind), T.StructField(id_col, kind), T.StructField("distance", T.DoubleType())])

    def best(batches):
        for batch in batches:
            for qs, rs in zip(batch.column("_q").to_pylist(), batch.column("_r").to_pylist()):
                q, r = np.array([x["v"] for x in qs], float), np.array([x["v"] for x in rs], float)
                qi, ri = np.array([x["id"] for x in qs], object), np.array([x["id"] for x in rs], object)
                rough = (q**2).sum(1)[:, None] + (r**2).sum(1)[None] - 2 * q @ r.T
                rough[qi[:, None] == ri[None]] = np.inf
                # The quick form loses the distance of vectors that are nearly equal, so more are kept and measured again.
                at = np.argsort(rough, axis=1, kind="stable")[:, : 2 * k + 8]
                near = np.array([np.sqrt(((q[i] - r[at[i]]) ** 2).sum(1)) for i in range(len(q))]).reshape(len(q), -1)
                near[np.isinf(np.take_along_axis(rough, at, 1))] = np.inf
                keep = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, at.shape[1]).reshape(at.shape)[keep].tolist(), type=batch_type), pa.array(ri[at][keep].tolist(), type=batch_type), pa.array(near[keep])], names=schema.names)

    batch_type = to_arrow_type(kind)
    pairs = packs.join(blocks).mapInArrow(best, schema)
    return ranked(pairs, "query_id", "distance", id_col, k, ascending=True)


def passes_threshold(score: Column, universal: Column, least: float, least_universal: float) -> Column:
    return score >= F.when(universal, F.lit(least_universal)).otherwise(F.lit(least))


def language_gate(languages: Column, inferred: Column, declared: Column) -> Column:
    """Rows without a declaration pass, others with a language of the query; a malformed declaration fails."""
    return declared.isNull() | F.coalesce(F.arrays_overlap(languages, inferred), F.lit(False))
