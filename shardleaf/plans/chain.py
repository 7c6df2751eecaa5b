"""From calls to the text that each of them gets: inference, gated search, siblings, conditions, sessions, formatting."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shardleaf.functions import calls, languages
from shardleaf.operators import packs, retrieval
from shardleaf.plans.calls import CALL
from shardleaf.plans.search import FIELD_WEIGHTS
from shardleaf.registry import query
from shardleaf.sources.tables import table
from shardleaf.streaming import sessions

SEEDS = 3


def found_sources(spark: SparkSession, sf_dir: str, seeds: int = SEEDS, known: DataFrame | None = None) -> DataFrame:
    """``no, call_id, session_id, called_at, tool_name, head, source_file``: the sources that each call's best ``seeds`` chunks come from.

    Calls have numbers, and chunks, in the order of their ids, so that no long key travels with what is found. What calls
    ask travels apart from them, under its digest, once for those that ask the same. If ``known`` (a row for each
    ``source_file``) is given, its columns stand in place of the source's name.
    """
    given = table(spark, sf_dir, "call_contexts").withColumns({"langs": languages.infer_languages(*map(F.col, CALL)), "words": calls.call_terms(*map(F.col, (*CALL, "transcript_tail")))})
    given = given.withColumn("_ask", F.when(F.expr("size(langs) > 0 OR size(words) > 0"), F.substring(F.unhex(F.sha2(F.to_json(F.struct("langs", "words")), 256)), 1, 16)))
    head = F.when(F.col("tool_name") == "Bash", calls.effective_head(F.col("command"))).alias("head")
    asked = given.select("call_id", "session_id", "called_at", "tool_name", head, "_ask").dropDuplicates(["call_id"]).where("_ask IS NOT NULL").withColumn("no", F.monotonically_increasing_id()).checkpoint()
    forms = F.array(*[F.struct(F.lit(bytes([at])).alias("form"), form.alias("of")) for at, form in enumerate(retrieval.gated_forms("langs", "words"))])
    queries = given.where("_ask IS NOT NULL").select("_ask", F.explode(forms).alias("_f")).where("_f.of IS NOT NULL AND size(_f.of.groups) > 0")
    queries = packs.written(queries.select(F.concat("_ask", "_f.form").alias("_q"), "_f.of.groups", F.lit(None).cast("array<string>").alias("without"), "_f.of.gate"), once="_q")
    chunks = packs.in_order(table(spark, sf_dir, "chunks").select("id", "source_file", "language_json", *[c for c in FIELD_WEIGHTS if c != "source_file"]), "id")
    index = retrieval.build_index(chunks.withColumn("no", F.monotonically_increasing_id()), "no", FIELD_WEIGHTS, "language_json", also=("source_file",))
    found = retrieval.matches(index, "no", queries, 2 * seeds).withColumn("_ask", F.substring("_q", 1, 16)).repartition("_ask")
    first = F.row_number().over(Window.partitionBy("_ask", "_q").orderBy(F.desc("score"), "id"))
    lists = found.withColumn("rank", first).where(F.col("rank") <= 2 * seeds)
    best = retrieval.ranked(retrieval.fuse([lists], "_ask", "id", n=2).withColumn("fused", F.round("fused", 9)), "_ask", "fused", "id", seeds)
    places = index.where("source_file IS NOT NULL").select(F.col("no").alias("id"), "source_file")
    if known is not None:
        places = places.join(known, "source_file").drop("source_file")
    return asked.join(best.select("_ask", "id").join(places, "id").drop("id").distinct().checkpoint(), "_ask").drop("_ask")


def split_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chunks that are shown or not for their source and session alone, and the others: those with a condition, and those whose id comes twice."""
    chunks = table(spark, sf_dir, "chunks").select("id", "source_file", "body", "is_universal", "applies_when_json")
    gated = F.coalesce("is_universal", F.lit(True)) & F.col("applies_when_json").isNotNull()
    twice = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id", F.lit(True).alias("_twice"))
    if twice.isEmpty():
        return chunks.where(~gated), chunks.where(gated)
    chunks = chunks.join(twice, "id", "left").withColumn("_other", gated | F.col("_twice").isNotNull()).drop("_twice")
    return chunks.where("NOT _other").drop("_other"), chunks.where("_other").drop("_other")


def shown_sources(found: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``no, call_id, source_file, first`` and the columns ``also``: whether a call is the first of its session that finds the source. Others get its pinned chunks alone."""
    order = Window.partitionBy("session_id", "source_file").orderBy("called_at", "call_id")
    return found.select("no", "call_id", "source_file", "session_id", "called_at", *also).withColumn("first", F.row_number().over(order) == 1).drop("session_id", "called_at")


def shown_others(found: DataFrame, others: DataFrame) -> DataFrame:
    """``no, call_id, source_file, id, body`` of the chunks for which each has to be looked at; those whose condition does not hold for a call are not seen."""
    head = F.col("head") if "head" in found.columns else calls.effective_head(F.col("command"))
    holds = ~F.col("is_universal") | F.col("applies_when_json").isNull() | calls.applies_to(F.col("applies_when_json"), F.col("tool_name"), head)
    shown = sessions.first_in_session(found.join(others, "source_file").where(holds), "session_id", "id", ["called_at", "call_id"], always=F.col("is_universal"))
    return shown.select("no", "call_id", "source_file", "id", "body")


def injected(spark: SparkSession, sf_dir: str, seeds: int = SEEDS) -> DataFrame:
    """``call_id, id, source_file, body``: what each call gets that its session has not been shown yet.

    The best ``seeds`` chunks bring along all chunks of their sources; chunks whose condition does not hold for the call
    are taken out before the session counts them as seen.
    """
    found, (plain, others) = found_sources(spark, sf_dir, seeds), split_chunks(spark, sf_dir)
    shown = shown_sources(found).join(plain, "source_file").where("first OR is_universal").select("call_id", "id", "source_file", "body")
    return shown.unionByName(shown_others(found, others).select("call_id", "id", "source_file", "body"))


def texts(shown: DataFrame, plain: DataFrame, others: DataFrame, group_rows: int = 131_072) -> DataFrame:
    """``call_id, chunks, text`` of each call that gets anything.

    Calls are dealt out to groups, and of each source one copy goes to a group that needs it, not one to each call.
    """
    blocks = max(1, -(-shown.count() // group_rows), min(shown.sparkSession.sparkContext.defaultParallelism // 2, -(-shown.count() // 4096)))
    task = F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("_task")
    asked = shown.select("no", "call_id", "source_file", "first", task)
    bodies = asked.select("_task", "source_file").distinct().join(plain, "source_file").select("_task", "source_file", "id", "body", F.coalesce("is_universal", F.lit(False)).alias("first"))
    every = asked.unionByName(bodies, allowMissingColumns=True).unionByName(others.select("*", task), allowMissingColumns=True)
    kind = shown.schema["call_id"].dataType
    schema = T.StructType([T.StructField("call_id", kind), T.StructField("chunks", T.LongType()), T.StructField("text", T.StringType())])

    def assembled(batches):
        sources, wanted = {}, {}
        for batch in batches:
            for no, call, source, first, chunk, body in zip(*(batch.column(c).to_pylist() for c in ("no", "call_id", "source_file", "first", "id", "body"))):
                if no is None:
                    sources.setdefault(source, []).append((chunk, body or "", first))
                elif first is None:
                    wanted.setdefault(no, (call, {}))[1].setdefault(source, []).append((chunk, body or ""))
                else:
                    wanted.setdefault(no, (call, {}))[1].setdefault(source, []).append(first)
        for source in sources.values():
            source.sort(key=lambda x: x[:2])
        rows, size = [], 0
        for call, found in wanted.values():
            n, out = 0, []
            for name in sorted(found):
                own = [x for x in found[name] if not isinstance(x, bool)]
                for first in (x for x in found[name] if isinstance(x, bool)):
                    own += [(chunk, body) for chunk, body, pinned in sources.get(name, ()) if first or pinned]
                if own:
                    n += len(own)
                    out.append(f"From {name}:\n" + re.sub(r"\n+\Z", "", "\n".join(body for _, body in sorted(own))) + "\n")
            if n:
                rows.append((call, n, "".join(out)))
                size += len(rows[-1][2])
            if size > 4_000_000:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    def batch_of(rows):
        calls, counts, made = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(calls, to_arrow_type(kind)), pa.array(counts, pa.int64()), pa.array(made, pa.string())], names=schema.names)

    return every.repartitionById(blocks, "_task").drop("_task").mapInArrow(assembled, schema)


@query()
def chain_call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every call that gets anything: how many chunks, and their text by source, each under a line that names it."""
    found, (plain, others) = found_sources(spark, sf_dir), split_chunks(spark, sf_dir)
    return texts(shown_sources(found).checkpoint(), plain, shown_others(found, others))


@query()
def chain_session_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session: calls, those that got anything, and the chunks that they were shown.

    A source is known by a number, and with it go how many chunks it has to show and whether others have to be looked at.
    """
    plain, others = split_chunks(spark, sf_dir)
    count = lambda condition: F.count(F.when(F.expr(condition), 1))
    every = plain.select("source_file", "is_universal", F.lit(False).alias("_other")).unionAll(others.select("source_file", "is_universal", F.lit(True)))
    known = every.where("source_file IS NOT NULL").groupBy("source_file").agg(count("NOT _other").alias("whole"), count("NOT _other AND is_universal").alias("pinned"), F.max("_other").alias("more"))
    known = known.withColumn("source", F.monotonically_increasing_id()).checkpoint()
    found = found_sources(spark, sf_dir, known=known).withColumnRenamed("source", "source_file")
    shown = shown_sources(found, ("whole", "pinned")).select("call_id", F.when(F.col("first"), F.col("whole")).otherwise(F.col("pinned")).alias("n")).where("n > 0")
    others = others.join(known.select("source_file", "source"), "source_file").drop("source_file").withColumnRenamed("source", "source_file")
    got = shown.unionAll(shown_others(found.where("more"), others).select("call_id", F.lit(1).alias("n"))).groupBy("call_id").agg(F.sum("n").alias("n"))
    rows = table(spark, sf_dir, "call_contexts").select("call_id", "session_id").dropDuplicates(["call_id"]).join(got, "call_id", "left")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count("n").alias("answered"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
