import regex
from pyspark.sql import functions as F

from shardleaf.functions.ignore import ignored
from shardleaf.operators import index
from shardleaf.operators.documents import chunk_by_heading
from shardleaf.sources.tables import change_set
from shardleaf.streaming import sessions


def test_ignore_rules(spark):
    rules = ["# comment", "", "drafts/", "*.tmp.md", "/top.md", "a/**/z.md", "!keep.tmp.md", "odd[0-9].md", "logs/**"]
    want = {
        "drafts/x.md": True, "a/drafts/b/x.md": True, "drafts": False, "x.tmp.md": True, "b/x.tmp.md": True, "b/keep.tmp.md": False, "top.md": True, "b/top.md": False, "a/z.md": True, "a/b/c/z.md": True,
        "b/a/z.md": False, "odd7.md": True, "oddx.md": False, "logs/a/b.md": True, "logs": False, "drafts/keep.tmp.md": False, "": False, None: None,
    }
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.i for r in df.withColumn("i", ignored(F.col("p"), rules)).collect()} == want
    assert {r.i for r in df.withColumn("i", ignored(F.col("p"), ["#"])).collect()} == {False, None}


def test_delta_equals_chunking_all(spark):
    old = [("a.md", "# A\nsome words here\n## B\nmore words there"), ("b.md", "# B\nwords that will leave"), ("c.md", "# C\nwords before the change")]
    new = [old[0], ("c.md", "# C\nwords after\n## D\nand a new section"), ("d.md", "no heading but enough words"), ("e.md", None)]
    before, after = (spark.createDataFrame(x, "source string, t string") for x in (old, new))
    hashed = lambda df: df.select("source", F.md5("t").alias("h"))
    changes = change_set(hashed(before), hashed(after), "source", "h")
    got = index.apply_changes(chunk_by_heading(before, "source", "t"), after, changes, "source", "t")
    full = chunk_by_heading(after, "source", "t").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect())) and got.count() == 5


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 8)], "k string, v int")
    assert {tuple(r) for r in index.upsert(old, new, "k").collect()} == {("a", 1), (None, 3), ("b", 9), ("c", 8)}
    assert {tuple(r) for r in index.delete_sources(old, new, "k").collect()} == {("a", 1), (None, 3)}


def test_pattern_rows_and_whole_documents(spark):
    df = spark.createDataFrame([("x/my-notes.md", "just a paragraph"), ("g.md", "---\ntags: [a, b]\n---\n\n# Title here\nbody"), ("s.md", "short"), ("n.md", None)], "source string, t string")
    rows = {r.source: r for r in index.pattern_rows(df, "source", "t").collect()}
    assert rows["x/my-notes.md"].title == "my-notes" and rows["g.md"].title == "Title here" and rows["g.md"].tags == "a, b" and rows["g.md"].raw_body == "# Title here\nbody"
    assert {r.id: r.title for r in index.whole_documents(df, "source", "t").collect()} == {"x/my-notes.md": "my-notes", "g.md": "Title here"}


def test_epochs(spark):
    rows = [("s", "2026-01-01 00:10:00", 1, "in"), ("s", "2026-01-01 00:20:00", 2, "reset"), ("s", "2026-01-01 00:30:00", 3, "in"), ("s", "2026-01-01 05:00:00", 4, "in"), ("s", "2026-01-02 00:00:00", 5, "reset"), ("s", "2026-01-02 00:00:00", 6, "in"), (None, "2026-01-01 00:00:00", 7, None), ("t", "2026-01-03 00:00:00", 8, "in")]
    df = spark.createDataFrame(rows, "s string, at string, n int, e string").withColumn("at", F.to_timestamp("at"))
    got = {r.n: r.epoch for r in sessions.with_epochs(df, "s", "at", ["at", "n"], F.col("e") == "reset").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 0, 8: 0}


def test_registered_queries_without_sql(spark, sf_dir):
    from shardleaf.catalog import QUERIES
    from shardleaf.functions.stem import stem

    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").collect()
    want = {}
    for r in chunks:
        for s in {stem(w) for w in regex.findall(r"[\p{L}\p{M}]+", r.body.lower())}:
            want[s] = want.get(s, 0) + 1
    assert {r.stem: r.chunks for r in QUERIES["ret1_stemmed_postings"](spark, sf_dir).collect()} == want
    asked = QUERIES["qry1_call_queries"](spark, sf_dir).collect()
    assert asked and all(r.query and (r.languages or r.terms) for r in asked)
