import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardleaf.llm import leakage, lookalikes, neighbours, packing, quantiles, queries, readability, splitting


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_over_its_whole_tables(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len({str(r) for r in rows}) == len(rows)


def test_split_round_trip_and_edges(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "\n\n", "!"]) for _ in range(4000))
    rows = [(1, "short", "h"), (2, long, "h > i"), (3, "€" * 5000, None), (4, "", "h"), (5, None, "h"), (2, long, "h > i"), (6, "x" * 1600, "h")]
    df = spark.createDataFrame(rows, "id int, body string, path string").withColumn("piece", F.lit("clash"))
    got = splitting.split_oversized(df, "id", "body", ("path",)).collect()
    assert {r.id for r in got} == {1, 2, 3, 6} and next(r for r in got if r.id == 6).n_pieces == 1
    for key, text in ((2, long), (3, "€" * 5000)):
        pieces = sorted({(r.piece_no, r.piece, r.overlap_bytes, r.n_pieces) for r in got if r.id == key})
        assert len(pieces) == pieces[0][3] and all(len(p.encode()) <= 1600 for _, p, _, _ in pieces)
        assert b"".join(p.encode()[o:] for _, p, o, _ in pieces).decode() == text
    assert sum(r.id == 2 and r.piece_no == 1 for r in got) == 2
    assert splitting.split_oversized(df.where("false"), "id", "body").count() == 0
    cores = [end - start for _, start, end in splitting.bisect(b"a. " + b"x" * 5000, 1600, 160)]
    assert sum(cores) == 5003 and min(cores) > 180 and max(cores) <= 1440


def test_lookalikes(spark):
    titles = ["Retry limits", "Rеtry limits", "Retry limits ", "Re​try limits", "Ｒetry limits", "retry limits", "Señales", "Señales", "Senales", "Привет мир", "", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    model = lookalikes.learn(df)
    form = {r.t: r.f for r in df.withColumn("f", lookalikes.visual_form("t", model)).collect()}
    assert len({form[t] for t in titles[:5]}) == 1 and form["retry limits"] != form["Retry limits"]
    assert form["Señales"] == form["Señales"] != form["Senales"]
    assert form[None] is None and form[""] == ""


def test_context_decides_what_nearly_looks_alike():
    said = "modern modem module modules model models limit limits line lines lock locks list lists close closed cloud document dump image Index Import Inport Item v1 v2 sha1 base64 h1 l10n turn turned corner".split()
    model = lookalikes.Model(lookalikes.count_runs(said * 5))
    same = [("rnodule", "module"), ("1imits", "limits"), ("Iock", "lock"), ("lnport", "Inport"), ("c1oud", "cloud")]
    for a, b in same:
        assert model.form(a) == model.form(b) == b
    for word in ("modern", "modem", "turn", "corner", "v1", "sha1", "base64", "h1", "1", "10", "000110", "close", "Item", "l10n"):
        assert model.form(word) == word  # a table that always reads rn as m, or 1 as l, would change some of these
    assert len({model.form(w) for w in ("modern", "modem", "model", "module")}) == 4


def test_percentiles_within_error_and_mergeable(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i % 4}", "a" if i % 3 else None, float(v)) for i, v in enumerate(rng.lognormal(3, 2, 12000))] + [("d0", "a", None), ("d0", "a", float("nan"))]
    df = spark.createDataFrame(rows, "day string, agent string, v double")
    daily = quantiles.build_sketches(df, ["day", "agent"], "v")
    got = quantiles.read_percentiles(quantiles.merge_sketches(daily, ["agent"]), ["agent"], [5, 50, 95, 99]).collect()
    assert len(got) == 8
    for r in got:
        values = np.sort([v for _, a, v in rows if a == r.agent and v is not None and v == v])
        assert r.n == len(values)
        rank = np.searchsorted(values, r["value"], side="right") / len(values) * 100
        assert abs(rank - r.pct) <= 0.03 * (100 - r.pct) + 0.1
    assert quantiles.build_sketches(df.where("false"), ["agent"], "v").count() == 0
    tree = quantiles.read_percentiles(quantiles.build_sketches(df.repartition(9), ["agent"], "v", hold=500, fan_in=2), ["agent"], [50]).collect()
    for r in tree:
        values = np.sort([v for _, a, v in rows if a == r.agent and v is not None and v == v])
        assert r.n == len(values) and abs(np.searchsorted(values, r["value"], side="right") / len(values) - 0.5) <= 0.02


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    vectors = centres[rng.integers(0, 60, 1500)] + 0.35 * rng.normal(size=(1500, 24))
    rows = [(i, "m", v.tolist()) for i, v in enumerate(vectors)] + [(9001, "m", None), (9002, "m", []), (9003, "m", [0.0] * 24)]
    got = neighbours.similar_vectors(spark.createDataFrame(rows, "id bigint, model string, v array<double>"), "id", "model", "v").collect()
    assert not {r.id for r in got} & {9001, 9002, 9003} and all(r.id != r.neighbour for r in got)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    true = np.argsort(-cos, axis=1)[:, :5]
    found = {(r.id, r.neighbour) for r in got}
    assert np.mean([(i, j) in found for i in range(1500) for j in true[i]]) >= 0.9


def test_neighbours_in_a_crowd_and_among_copies(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64) / 8
    crowd = base + 0.003 * rng.normal(size=(6000, 64))
    rows = [(i, "m", v.tolist()) for i, v in zip(rng.permutation(6000).tolist(), crowd)] + [(10_000 + i, "m", (-base * (1 + i % 7)).tolist()) for i in range(400)]
    got = neighbours.similar_vectors(spark.createDataFrame(rows, "id bigint, model string, v array<double>"), "id", "model", "v").collect()
    found = {}
    for r in got:
        found.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.similarity)
    assert len(found) == 6400 and all(len(x) == 5 for x in found.values())
    for i in range(10_000, 10_400):
        assert [found[i][r] for r in range(1, 6)] == [(j, 1.0) for j in range(10_000, 10_006) if j != i][:5]
    ids = np.array([r[0] for r in rows[:6000]])
    unit = crowd / np.linalg.norm(crowd, axis=1, keepdims=True)
    at = np.arange(0, 6000, 10)
    cos = unit[at] @ unit.T
    cos[np.arange(len(at)), at] = -2
    true = ids[np.argsort(-cos, axis=1)[:, :5]]
    assert np.mean([j in {n for n, _ in found[i].values()} for i, js in zip(ids[at].tolist(), true) for j in js]) >= 0.9


def test_neighbours_recall_in_a_larger_table(spark):
    vectors = np.random.default_rng(7).normal(size=(9000, 32))
    rows = [(i, "m", v.tolist()) for i, v in enumerate(vectors)]
    got = neighbours.similar_vectors(spark.createDataFrame(rows, "id bigint, model string, v array<double>"), "id", "model", "v").collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = np.arange(0, 9000, 20)
    cos = unit[at] @ unit.T
    cos[np.arange(len(at)), at] = -2
    found = {(r.id, r.neighbour) for r in got}
    assert np.mean([(i, j) in found for i, js in zip(at.tolist(), np.argsort(-cos, axis=1)[:, :5].tolist()) for j in js]) >= 0.9


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([50, 300, 900, 1500, 2500]) + rng.randint(0, 300) for _ in range(1500)] + [4096, 4097, 10000]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, n int")
    got = packing.pack(df, "id", F.col("n")).collect()
    load, held = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.length
        held[r.id] = held.get(r.id, 0) + r.length
    assert max(load.values()) <= 4096 and held == dict(enumerate(sizes))
    assert {r.id for r in got if r.n_pieces > 1} == {1501, 1502}
    assert len(load) <= 1.05 * -(-sum(sizes) // 4096)
    assert packing.pack(df.where("false"), "id", F.col("n")).count() == 0


def test_generations_lower_the_count():
    rng = random.Random(12)
    fewer = 0
    for seed in range(4):
        sizes = [min(4096, max(40, int(rng.lognormvariate(7.4, 0.5)))) for _ in range(500)]
        start = packing.evolve(sizes, [], 4096, 4, 0, random.Random(seed))
        end = packing.evolve(sizes, [], 4096, 4, 60, random.Random(seed))
        for x in (*start, *end):
            assert sorted(i for b in x.bins for i in b) == list(range(500)) and max(x.loads) <= 4096
            assert x.loads == [sum(sizes[i] for i in b) for b in x.bins]
        plain = len(packing._best_fit([], sorted(range(500), key=lambda i: -sizes[i]), sizes, 4096))
        assert len(end[0].bins) <= min(plain, len(start[0].bins)) and end[0].fitness > start[0].fitness
        fewer += plain - len(end[0].bins)
    assert fewer >= 3


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(60)) for i in range(20)] + [(99, None), (98, "")]
    whole, half = items[3][1], " ".join(items[5][1].split()[:34])
    changed = items[7][1].split()
    for k in range(5, 60, 11):
        changed[k] = "changed"
    docs = [(1, text(300) + " " + whole.upper().replace(" ", ",\n> ") + " " + text(100)), (2, text(50) + " " + half + " " + text(400)), (3, text(80) + " " + " ".join(changed)), (4, text(500)), (5, None), (6, ""), (7, text(30) + " " + " ".join(items[9][1].split()[:6]))]
    got = leakage.find_leaks(spark.createDataFrame(docs, "id int, t string"), "id", "t", spark.createDataFrame(items, "item int, t string"), "item", "t").collect()
    assert {(r.id, r["item"]) for r in got} == {(1, 3), (2, 5), (3, 7)}


def test_leaks_of_short_and_unspaced_items(spark):
    rng = random.Random(8)
    hanzi = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    passage = "".join(rng.choice(hanzi) for _ in range(40))
    items = [(1, "Quokka bandicoot"), (2, passage[:20] + "。" + passage[20:]), (3, "3.14159 26535"), (4, "!!"), (5, "of the")]
    noise = "".join(rng.choice(hanzi) for _ in range(300))
    docs = [(1, "a QUOKKA,\n> bandicoot sat"), (2, "the quokka and the bandicoot"), (3, noise + passage + noise), (4, noise + passage[:24] + noise), (5, noise + passage[:8] + noise), (6, "pi is 3.14159 26535 or so"), (7, "pi is 3.14159 26536"), (8, "some of the rest")]
    got = leakage.find_leaks(spark.createDataFrame(docs, "id int, t string"), "id", "t", spark.createDataFrame(items, "item int, t string"), "item", "t").collect()
    assert {(r.id, r["item"]) for r in got} == {(1, 1), (3, 2), (4, 2), (6, 3), (8, 5)}
    assert leakage.find_leaks(spark.createDataFrame(docs, "id int, t string"), "id", "t", spark.createDataFrame(items, "item int, t string").where("false"), "item", "t").count() == 0


def test_leaks_among_many_items_in_several_groups_and_long_texts(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(300)]
    docs = [(i, text(50) + " " + items[i][1] + " " + text(50)) for i in range(0, 300, 3)] + [(1000, text(60_000) + " " + items[7][1] + " " + text(30_000) + " " + items[8][1])]
    args = spark.createDataFrame(docs, "id int, t string"), "id", "t", spark.createDataFrame(items, "item int, t string"), "item", "t"
    got = leakage.find_leaks(*args, block_items=50, group_words=5000).collect()
    assert {(r.id, r["item"]) for r in got} == {(i, i) for i in range(0, 300, 3)} | {(1000, 7), (1000, 8)}


def test_reading_levels_on_held_out_samples(spark, sf_dir):
    samples = spark.read.parquet(f"{sf_dir}/graded_samples.parquet")
    # The grade goes with the id modulo 4, so whole runs of four ids are held out.
    ranker = readability.fit(samples.where("sample_id div 4 % 2 = 0"), "text", "grade")
    held = samples.where("sample_id div 4 % 2 = 1")
    got = readability.reading_levels(held, "sample_id", "text", ranker, min_words=20).join(held.select("sample_id", F.col("grade").alias("true")), "sample_id").collect()
    assert len(got) > 40 and np.mean([r.grade == r.true for r in got]) >= 0.95
    none = spark.createDataFrame([(1, None), (2, ""), (3, "too short")], "id int, t string")
    assert readability.reading_levels(none, "id", "t", ranker).count() == 0
