import os
import re

import pytest
from pyspark.sql import functions as F

from shardleaf.catalog import QUERIES
from shardleaf.functions import calls
from shardleaf.operators import packs
from shardleaf.plans import chain
from shardleaf.streaming import sessions


@pytest.mark.parametrize("name", ["chain_call_texts", "chain_session_shares"])
def test_what_the_chain_shuffles_stays_small(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert QUERIES[name](spark, sf_dir).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - before < 3_000_000


def test_shares_of_sessions_take_little_disk(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables here")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    taken = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() + sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    before = taken()
    assert QUERIES["chain_session_shares"](spark, sf_dir).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert taken() - before < 1_200_000


def test_rows_come_out_of_packs_as_they_went_in(spark):
    rows = [(i % 3, i // 2, None if i == 4 else [["a", "b"], [], [f"w{i}"]], None if i == 5 else ["x", None], f"t{i}" if i % 2 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "_part int, q long, lists array<array<string>>, words array<string>, t string").coalesce(1)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, packs.unpacked(packs.packed(df, most=1), df.drop("_part").schema).collect())) == sorted(repr(r[1:]) for r in rows)
    assert sorted(r.q for r in packs.written(df.drop("_part"), once="q").collect()) == [0, 1, 2, 3, 4]
    ids = spark.createDataFrame([(None if i % 50 == 0 else f"{i * 7919 % 1000:04}", i) for i in range(1000)], "id string, i int").repartition(3)
    assert [r.id for r in packs.in_order(ids, "id", part_rows=100).collect()] == [r.id for r in ids.orderBy("id").collect()]


def test_chain_gives_what_looking_at_each_chunk_gives(spark):
    """Also for chunks that come twice, have a condition, no body or nothing that says whether they are pinned."""
    chunks = spark.createDataFrame(
        [("a1", "a", "x\n\n", False, None), ("a2", "a", None, True, None), ("a3", "a", "z", True, '{"tools": ["Edit"]}'), ("a4", "a", "n", None, '{"tools": ["Bash"]}'), ("b1", "b", "two", False, None), ("b1", "b", "two", False, None), ("b1", "c", "else", True, None), ("b2", "b", "w\n", None, None)],
        "id string, source_file string, body string, is_universal boolean, applies_when_json string",
    )
    found = spark.createDataFrame(
        [(i, i, session, at, tool, "ls", source) for i, (session, at, tool) in enumerate([("s", 1, "Bash"), ("s", 1, "Edit"), ("s", 0, "Read"), (None, 1, "Edit"), (None, 2, "Bash"), ("t", None, "Bash")]) for source in "abc"[i % 2 :]],
        "no long, call_id long, session_id string, called_at int, tool_name string, command string, source_file string",
    )
    folder = spark.conf.get("spark.checkpoint.dir", spark.sparkContext.getCheckpointDir()).removeprefix("file://") + "/odd"
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks.parquet")
    holds = ~F.col("is_universal") | F.col("applies_when_json").isNull() | calls.applies(F.col("applies_when_json"), F.col("tool_name"), F.col("command"))
    want: dict = {}
    for r in sessions.first_in_session(found.join(chunks, "source_file").where(holds), "session_id", "id", ["called_at", "call_id"], always=F.col("is_universal")).where("id <> 'b1'").collect():
        want.setdefault(r.call_id, {}).setdefault(r.source_file, []).append((r.id, r.body or ""))
    plain, others = chain.split_chunks(spark, folder)
    assert {r.id for r in others.collect()} == {"a3", "a4", "b1"}
    others = others.where("id <> 'b1'")  # which of two chunks of one id is shown is open
    got = {r.call_id: (r.chunks, r.text) for r in chain.texts(chain.shown_sources(found), plain, chain.shown_others(found, others), group_rows=4).collect()}
    text = lambda parts: "".join(f"From {s}:\n" + re.sub(r"\n+\Z", "", "\n".join(b for _, b in sorted(parts[s]))) + "\n" for s in sorted(parts))
    assert got == {call: (sum(map(len, parts.values())), text(parts)) for call, parts in want.items()}
