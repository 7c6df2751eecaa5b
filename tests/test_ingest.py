import json

from pyspark.sql import functions as F

from shardleaf.functions import events
from shardleaf.functions import front as front_matter
from shardleaf.operators import documents
from shardleaf.plans import ingest

NOTE = "intro words stand here\n# Top\nsome words here\n## Cases\nfirst of them here\n## Cases\nsecond of them here\n# Bare\n"


def test_chunk_ids_and_ordinals(spark):
    df = spark.createDataFrame([("a/guide.md", NOTE), ("b.md", "short"), ("c.md", "a plain note without headings"), ("d.md", None), ("e.md", "")], "source_file string, text string")
    rows = {r.chunk_id: r for r in documents.chunk_by_heading(df, "source_file", "text").collect()}
    assert set(rows) == {"a/guide.md:root", "a/guide.md:Top", "a/guide.md:Top > Cases", "a/guide.md:Top > Cases:2", "c.md:root"}
    assert rows["a/guide.md:root"].title == "guide" and rows["a/guide.md:Top > Cases:2"].body == "## Cases\nsecond of them here"
    tiny = spark.createDataFrame([("x.md", "# One\n# Two\n# Six")], "source_file string, text string")
    assert [(r.chunk_id, r.title) for r in documents.chunk_by_heading(tiny, "source_file", "text").collect()] == [("x.md", "x")]
    assert documents.chunk_by_heading(df.where("false"), "source_file", "text").count() == 0


def test_front_matter(spark):
    def one(column, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r.y for r in df.withColumn("y", column(F.col("x"))).orderBy("i").collect()]

    fronts = ["language: Rust", "language: [go, 'C']", "language:\n  - zig\n- nix", "  language: no", "language: []", "", None, 'language: "a b"']
    assert one(front_matter.language_list, fronts) == [["rust"], ["go", "c"], ["zig", "nix"], [], [], [], [], ["a b"]]
    assert one(front_matter.near_miss_key, ["applies_wen: x", "Applies_When:\n", "applies: y", "tags: [a]", "applies_when:\n"]) == ["applies_wen", "Applies_When", "applies", None, None]
    tags = spark.createDataFrame([(["Universal", "un\u0456versal", "universal", "résumé", "x"],)], "t array<string>").select(front_matter.near_miss_tags(F.col("t")).alias("t")).head().t
    assert tags == ["Universal", "un\u0456versal"]
    conditions = [
        ("applies_when:\n  tools: [Bash, 'Edit']\n  bash_command_starts_with:\n    - git\n    - gh\ntags: [a]", ({"tools": ["Bash", "Edit"], "bash_command_starts_with": ["git", "gh"]}, [])),
        ("applies_when: Bash", (None, ["expected keys below, not a value"])), ("applies_when:\n\ttools: [a]", (None, ["indented by a tab"])), ("applies_when:\n  tool: [a]", (None, ["unknown key tool"])),
        ("applies_when:\n  tools: Bash\n  bash_command_starts_with: [ls]", ({"bash_command_starts_with": ["ls"]}, ["tools is no list"])), ("tags: [a]", (None, [])), (None, (None, [])), ("applies_when:\n  tools: []", ({"tools": []}, [])),
    ]
    assert [front_matter.read_condition(x) for x, _ in conditions] == [want for _, want in conditions]
    got = one(front_matter.condition, [x for x, _ in conditions] + ["aplies_when:\n  tools: [a]"])
    assert [None if r.condition is None else json.loads(r.condition) for r in got[:-1]] == [c for _, (c, _) in conditions]
    assert got[-1].condition is None and got[-1].advice == ["unknown key aplies_when, meant as applies_when"]


def _index(spark, documents, vectors=()):
    df = spark.createDataFrame(documents, "source_file string, text string")
    return df, spark.createDataFrame(list(vectors), "id string, vector array<float>")


def _state(made):
    return {name: sorted(map(str, (sorted(r.asDict().items()) for r in df.collect()))) for name, df in made.tables().items()}


def test_delta_and_reconciliation_equal_a_full_run(spark):
    old = [("a.md", NOTE), ("b.md", "---\ntags: [universal]\nlanguage: [go]\n---\n# B\nwords of the old note"), ("gone.md", "# Gone\nwords that will go"), ("core/x.md", "# X\nignored from now on")]
    new = [("a.md", NOTE), ("b.md", "# B\nwords of the new note"), ("core/x.md", "# X\nignored from now on"), ("new.md", "# New\nwords that are new"), ("big.md", "---\ntags: [universal]\n---\n# Big\n" + "word " * 2000)]
    before, vectors = _index(spark, old, [("b.md:B", [1.0]), ("a.md:Top", [2.0]), ("gone.md:Gone", [3.0]), ("new.md:New", [4.0])])
    now, _ = _index(spark, new)
    first = ingest.build(before, vectors)
    assert {r.id for r in first.vectors.collect()} == {"b.md:B", "a.md:Top", "gone.md:Gone"}
    assert {(r.source_file, r.is_universal, r.language_json) for r in first.patterns.where("source_file = 'b.md'").collect()} == {("b.md", True, '["go"]')}
    changes = spark.createDataFrame([("b.md", "changed"), ("gone.md", "removed"), ("new.md", "added"), ("big.md", "added")], "source_file string, change string")
    full = _state(ingest.build(now, vectors))
    assert _state(ingest.apply_delta(first, now, changes, vectors)) == full and "big.md" not in str(full["patterns"])
    assert ingest.summary(first.patterns, changes).head().asDict() == {"added": 2, "changed": 1, "removed": 1, "unchanged": 2}
    left = ingest.reconcile(first, before, ["core/"], vectors)
    assert {r.source_file for r in left.patterns.collect()} == {"a.md", "b.md", "gone.md"} and not left.chunks.where("source_file = 'core/x.md'").count()
    assert _state(ingest.reconcile(left, before, [], vectors)) == _state(first)
    advice = ingest.advisories(now.union(spark.createDataFrame([("z.md", "---\ntags: [UNIVERSAL]\n---\n# Z\nwords of it")], now.schema))).head()
    assert (advice.universal_count, advice.universal_sources, advice.oversized, advice.near_misses, advice.count_warning) == (1, ["big.md"], ["big.md"], ["z.md"], False)


def test_registered_runs_agree(spark, sf_dir):
    from shardleaf.catalog import QUERIES

    rows = lambda name: sorted(map(str, QUERIES[name](spark, sf_dir).collect()))
    full = rows("ing1_full_index")
    assert full and rows("ing2_delta_index") == full and len(rows("ing4_reconciled_index")) <= len(full)


def test_events(spark):
    def event(**kw):
        return json.dumps({"hook_event_name": "PostToolUse", "tool_name": "Bash"} | kw)

    rows = [
        (1, event(tool_response={"exit_code": 1, "stderr": "Linker failed on module"})), (2, event(tool_response={"exitCode": 2, "result": {"stderr": "deadbeef lost"}})), (3, event(tool_response={"exit_code": 0, "stderr": "warning"})),
        (4, event(tool_name="Edit", tool_response={"exit_code": 1, "stderr": "bad"})), (5, event(agent_type="Plan", tool_input={"command": "ls"})), (6, "no event"), (7, None), (8, event(tool_response={"exit_code": 1, "stderr": ""})),
    ]
    df = spark.createDataFrame(rows, "i int, t string").select("i", events.parsed(F.col("t")).alias("e"))
    got = {r.i: r for r in df.select("i", events.error_query(events.error_text(F.col("e"))).alias("q"), events.counts(F.col("e")).alias("c"), events.call_context(F.col("e")).alias("x")).collect()}
    assert {i: r.q for i, r in got.items() if r.q} == {1: "linker OR failed OR module", 2: "lost"}
    assert not got[5].c and got[1].c and got[5].x.command == "ls"
    user = lambda text: json.dumps({"type": "user", "message": {"content": text}})
    other = json.dumps({"type": "assistant", "message": {"content": "no"}})
    texts = [user("first") + "\n" + user("last") + "\n" + other + "\nbroken {", other, "", user("x" * 100) + "\n" + user("y"), user("z" * 100)]
    found = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "i int, b binary").select("i", events.last_user_text(F.col("b"), 150).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == ["last", None, None, "y", "z" * 100]
    cut = spark.createDataFrame([(bytearray((user("z" * 100) + other).encode()),)], "b binary").select(events.last_user_text(F.col("b"), 90).alias("t")).head()
    assert cut.t is None


def test_written_notes(spark):
    df = spark.createDataFrame([("---\ntags: [a, b]\n---\n\n# T\n\nbody\n",)], "t string")
    none = F.array().cast("array<string>")
    row = df.select(
        documents.rendered(F.lit("T"), F.array(F.lit("a"), F.lit("b")), none, F.lit("body")).alias("made"), documents.rendered(F.lit("T"), none, none, F.lit("body")).alias("bare"),
        documents.appended(F.col("t"), F.lit("More"), F.lit("x")).alias("more"), documents.updated(F.col("t"), F.lit("U"), F.lit("new")).alias("kept"), documents.updated(F.col("t"), F.lit("U"), F.lit("new"), tags=none, languages=F.array(F.lit("go"))).alias("set"),
    ).head()
    assert row.made == "---\ntags: [a, b]\n---\n\n# T\n\nbody\n" and row.bare == "# T\n\nbody\n" and row.more.endswith("body\n\n## More\n\nx\n")
    assert row.kept == "---\ntags: [a, b]\n---\n\n# U\n\nnew\n" and row.set == "---\nlanguage: [go]\n---\n\n# U\n\nnew\n"


def test_chain_shows_each_chunk_once_in_a_session(spark, sf_dir):
    from shardleaf.catalog import QUERIES
    from shardleaf.plans import chain

    shown = chain.injected(spark, sf_dir).collect()
    session = {r.call_id: r.session_id for r in spark.read.parquet(f"{sf_dir}/call_contexts.parquet").collect()}
    pinned = {r.id for r in spark.read.parquet(f"{sf_dir}/chunks.parquet").where("is_universal").collect()}
    seen = [(session[r.call_id], r.id) for r in shown if r.id not in pinned]
    assert shown and len(seen) == len(set(seen))
    texts = {r.call_id: r for r in QUERIES["chain_call_texts"](spark, sf_dir).collect()}
    assert set(texts) == {r.call_id for r in shown}
    for r in shown[:50]:
        assert f"From {r.source_file}:\n" in texts[r.call_id].text and (r.body or "").strip() in texts[r.call_id].text
    assert sum(r.chunks for r in QUERIES["chain_session_shares"](spark, sf_dir).collect()) == len(shown)
