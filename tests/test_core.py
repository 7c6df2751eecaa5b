import math

import pytest
from pyspark.sql import functions as F

from shardleaf.catalog import ORACLE_SQL, QUERIES
from shardleaf.functions import text as T
from shardleaf.operators import documents, retrieval
from shardleaf.sources.tables import change_set
from shardleaf.streaming import sessions


def same(rows):
    """Rows as text, sorted, with numbers in one form."""
    def form(x):
        if x is None or x != x:
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(form, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    from pathlib import Path

    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert same(df.select(*columns).collect()) == same(wanted)


def test_words_terms_and_queries(spark):
    df = spark.createDataFrame([("HTTPServer v2, the_café deadbeef error Error",), ("",), (None,)], "t string")
    words = T.split_into_words(F.col("t"))
    rows = df.select(words.alias("w"), T.clean_terms(words).alias("c"), T.sanitize_query(F.lit('a.b "c" AND (d)')).alias("q")).collect()
    assert rows[0].w == ["httpserver", "v", "the", "café", "deadbeef", "error", "error"]
    assert rows[0].c == ["httpserver", "café", "error"]
    assert rows[1].w == [] and rows[2].w is None
    assert rows[0].q == "a b c AND (d)"


def test_paths_and_commands(spark):
    df = spark.createDataFrame([("a/b.c.md", "  git push"), (".env", " "), ("", None)], "p string, c string")
    rows = df.select(T.file_stem(F.col("p")).alias("s"), T.command_head(F.col("c")).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("b.c", "git"), (".env", None), ("untitled", None)]


def test_chunks_by_heading(spark):
    text = "---\ntags: [a]\n---\n# Top\nsome words here\n## Sub\nother words there\n### Deep\nwords again\n## Next\nlast words of it\n# Bare\n"
    rows = documents.chunk_by_heading(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t").orderBy("chunk_no").collect()
    assert [(r.heading_path, r.title) for r in rows] == [("Top", "Top"), ("Top > Sub", "Sub"), ("Top > Sub > Deep", "Deep"), ("Top > Next", "Next")]
    assert rows[0].body == "# Top\nsome words here"


def test_bm25_and_fusion(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta"), (4, "epsilon"), (5, None)], "id int, t string")
    asked = spark.createDataFrame([("q", [["alpha", "delta", "absent"]]), ("none", []), ("both", [["alpha"], ["gamma", "beta"]])], "q string, groups array<array<string>>")
    index = retrieval.build_index(df, "id", {"t": 1.0})
    got = {(r.q, r.id): r.score for r in retrieval.search(index, "id", asked, "q", 10, digits=12, shard_rows=2, block_queries=1).collect()}
    idf, mean = math.log((5 - 2 + 0.5) / 2.5), 7 / 5
    assert got["q", 1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean)))
    assert set(got) == {("q", 1), ("q", 2), ("q", 3), ("both", 1), ("both", 2)}
    assert {(r.q, r.id) for r in retrieval.search(index, "id", asked.withColumn("without", F.array(F.lit("gamma"))), "q", 1).collect()} == {("q", 3), ("both", 1)}
    assert retrieval.search(retrieval.build_index(df.where("false"), "id", {"t": 1.0}), "id", asked, "q", 10).count() == 0
    lists = [spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, id int, rank int"), spark.createDataFrame([("q", 1, 1)], "q string, id int, rank int")]
    fused = {r.id: r.fused for r in retrieval.fuse(lists, "q", "id").collect()}
    assert fused[1] == pytest.approx(1.0) and fused[2] == pytest.approx(61 / 62 / 2)


def test_stemmed_search_against_brute_force(spark):
    import re
    import unicodedata

    from shardleaf.functions.stem import stem

    texts = {1: "Error v2 in the café", 2: "errors locks caching", 3: "v café\u0301 nothing", 4: "test v2 cache", 5: None, 6: "filler words stand here", 7: "more filler words", 8: "and yet more words"}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    tokens = {i: [stem(w) for w in re.findall(r"[^\W_]+", plain((t or "").lower()))] for i, t in texts.items()}
    asked = {"a": ["errors", "error"], "b": ["v2"], "c": ["cafe"], "d": ["testing", "cached"]}
    mean, want = sum(map(len, tokens.values())) / len(texts), {}
    for q, terms in asked.items():
        for term in map(stem, terms):
            df = sum(term in ws for ws in tokens.values())
            for i, ws in tokens.items():
                if term in ws:
                    tf, idf = ws.count(term), max(math.log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6)
                    want[q, i] = want.get((q, i), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    rows = spark.createDataFrame(list(texts.items()), "id int, t string").withColumn("l", F.lit(None).cast("string"))
    queries = spark.createDataFrame([(q, [], t) for q, t in asked.items()], "q string, langs array<string>, terms array<string>")
    index = retrieval.build_index(rows, "id", {"t": 1.0}, "l", stemmed=True)
    got = {(r.q, r.id): r.score for r in retrieval.search(index, "id", queries.withColumn("groups", F.array("terms")), "q", 10, stemmed=True, digits=12).collect()}
    assert got == pytest.approx(want) and ("a", 2) in got and ("c", 3) in got and ("b", 3) not in got
    fallback, structural = retrieval.gated(queries, "q", "langs", "terms")
    assert {(r.q, r.id): r.score for r in retrieval.search(index, "id", fallback, "q", 10, stemmed=True).collect()} == pytest.approx(want, abs=1e-6)
    assert structural.count() == 0


def test_gated_lists(spark):
    rows = spark.createDataFrame([(1, "rust locks", None), (2, "locks", '["rust"]'), (3, "locks", '["go", "rust"]'), (4, "locks", "[]"), (5, "locks", "not json"), (6, "rust", None), (7, "locks", None), (8, "none", '["rust"]')], "id int, t string, l string")
    asked = spark.createDataFrame([("both", ["rust"], ["locks"]), ("words", [], ["locks"]), ("lang", ["rust"], [])], "q string, langs array<string>, terms array<string>")
    index = retrieval.build_index(rows, "id", {"t": 1.0}, "l")
    lists = [{(r.q, r.id) for r in retrieval.search(index, "id", x, "q", 10).collect()} for x in retrieval.gated(asked, "q", "langs", "terms")]
    assert lists[0] == {("both", 1), ("words", 1), ("words", 7), ("lang", 1), ("lang", 6)} and lists[1] == {("both", 2), ("both", 3)}


def test_stemmed_queries_find_every_form(spark, sf_dir):
    import re

    import regex

    from shardleaf.functions.stem import search_form

    tokens = lambda t: {search_form(w) for w in regex.findall(r"[\p{L}\p{M}\p{N}\p{Co}]+", (t or "").lower())} - {""}
    held = [tokens(" ".join(r[c] or "" for c in ("title", "body", "tags", "source_file"))) for r in spark.read.parquet(f"{sf_dir}/chunks.parquet").collect()]
    queries = [r[0] for r in spark.read.parquet(f"{sf_dir}/trace_records.parquet").where("query <> ''").select("query").distinct().collect()]
    sides = {q: [tokens(re.sub(r"\bOR\b", " ", side)) for side in re.split(r"\s+AND\s+", q)] for q in queries}
    want = {q: n for q in queries if (n := min(10, sum(all(not ws.isdisjoint(side) for side in sides[q]) for ws in held)))}
    got = {}
    for r in QUERIES["ret1_stemmed_top10"](spark, sf_dir).collect():
        got[r.qid] = got.get(r.qid, 0) + 1
    assert got == want
    fused = QUERIES["ret5_stemmed_gated"](spark, sf_dir).collect()
    assert fused and len({(r.qid, r.id) for r in fused}) == len(fused)


def test_nearest_is_exact(spark):
    df = spark.createDataFrame([(i, [float(i * i % 17), float(i)]) for i in range(60)], "id bigint, v array<double>")
    got = retrieval.nearest(df, df.where("id % 7 = 0"), "id", "v", 3, block=4).collect()
    points = {i: (float(i * i % 17), float(i)) for i in range(60)}
    far = spark.createDataFrame([("a", [1e8, 0.0]), ("b", [1e8, 1e-3]), ("c", [1e8, 3e-3])], "id string, v array<double>")
    assert [r.id for r in retrieval.nearest(far, far.where("id = 'a'"), "id", "v", 2).orderBy("rank").collect()] == ["b", "c"]
    for q in range(0, 60, 7):
        want = sorted((math.dist(points[q], points[i]), i) for i in points if i != q)[:3]
        assert [x for _, x in want] == [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (2, '["go"]'), (3, '["c"]'), (4, "not json")], "id int, l string")
    kept = df.where(retrieval.language_gate(T.json_list(F.col("l")), F.array(F.lit("go")), F.col("l"))).collect()
    assert [r.id for r in kept] == [1, 2]


def test_change_set(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "k string, h string")
    assert {tuple(r) for r in change_set(old, new, "k", "h").collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_dedup_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", "x", "2026-01-01 00:00:00"), ("s", "x", "2026-01-01 01:00:00"), ("t", "x", "2026-01-01 00:00:00")], "s string, k string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = sessions.dedup_stream(stream, "s", "k", "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_search_with_many_terms_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vocabulary = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "klmnprstvw"]
    texts = {i: [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for i in range(400)}
    asked = {q: [[rng.choice(vocabulary) for _ in range(12)], [rng.choice(vocabulary) for _ in range(30)]] for q in range(40)}
    mean, df = sum(map(len, texts.values())) / 400, {}
    for words in texts.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    want = {}
    for q, groups in asked.items():
        scores = {}
        for i, words in texts.items():
            if all(set(g) & set(words) for g in groups):
                part = lambda t: max(math.log((400 - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / mean))  # noqa: E731, B023
                scores[i] = round(sum(part(t) for g in groups for t in g if t in words), 6)
        want[q] = [i for i, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]]
    rows = spark.createDataFrame([(i, " ".join(words)) for i, words in texts.items()], "id int, t string")
    queries = spark.createDataFrame(list(asked.items()), "q int, groups array<array<string>>")
    got = {}
    for r in retrieval.search(retrieval.build_index(rows, "id", {"t": 1.0}), "id", queries, "q", 5, shard_rows=100).orderBy("rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == {q: ids for q, ids in want.items() if ids}
