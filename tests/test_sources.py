import gzip
import json

from pyspark.sql import functions as F

from shardleaf.functions.embedding import embed
from tests.backends import hashed_vectors
from shardleaf.functions.stem import stem, stems
from shardleaf.sources import files
from shardleaf.streaming import sessions


def test_markdown_files_and_scan_state(spark, tmp_path):
    root = tmp_path / "notes"
    assert files.scan_state(spark, str(root)) == "missing"
    (root / "a b").mkdir(parents=True)
    assert files.scan_state(spark, str(root)) == "empty"
    for name, text in (("top.md", "# T\nline\n"), ("a b/ünï+x.markdown", "deep"), ("skip.txt", "no"), ("a b/draft.md", "")):
        (root / name).write_text(text)
    got = {r.source_file: r.text for r in files.markdown_files(spark, str(root), ["draft.md"]).collect()}
    assert got == {"top.md": "# T\nline\n", "a b/ünï+x.markdown": "deep"}
    assert files.scan_state(spark, str(root)) == "populated" and files.scan_state(spark, str(root), ["*"]) == "ignored"


def test_trace_log(spark, tmp_path):
    line = lambda e, n: json.dumps({"event": e, "session_id": n, "call_context": {"tool_name": "Bash"}, "duration_ms": 5})
    (tmp_path / "a.jsonl").write_text("\n".join([line("PreToolUse", "plain"), "", "{broken", line("PostCompact", "plain")]))
    for name in ("a.jsonl.gz", "b.jsonl.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(line("PreToolUse", "packed"))
    rows = files.trace_log(spark, str(tmp_path)).collect()
    assert sorted(r.session_id for r in rows) == ["packed", "plain", "plain"]
    again = tmp_path / "log"
    records = files.trace_log(spark, str(tmp_path)).withColumn("day", F.lit("2026-01-01")).drop("file_name", "modified_at")
    files.append_traces(records, str(again), compression="gzip")
    files.append_traces(records.limit(1), str(again))
    assert spark.read.schema(files.TRACE_SCHEMA).json(str(again)).count() == 4


def test_stems(spark):
    pairs = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit hopefulness:hope formality:formal electrical:electr goodness:good revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate controller:control roll:roll testing:test fakes:fake errors:error at:at"
    for word, want in (p.split(":") for p in pairs.split()):
        assert stem(word) == want, word
    df = spark.createDataFrame([(["testing", "tests"],), (None,), ([],)], "w array<string>")
    assert [r.s for r in df.select(stems("w").alias("s")).collect()] == [["test", "test"], None, []]


def test_embedding(spark):
    backend = hashed_vectors(8)
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "bad")], "n int, t string")

    def fragile(texts):
        if "bad" in texts:
            raise ValueError
        return backend(texts)

    got = {r.n: r.embedding for r in embed(df, "n", "t", fragile).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and got[5] is None and len(got[1]) == 8 and all(-1 <= x <= 1 for x in got[1])


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("s" if i % 3 else "t", f"2026-01-{1 + i // 30:02d} 00:{i % 30:02d}:00", i, None if i % 17 == 0 else f"k{i * 7 % 11}", i % 17 == 0) for i in range(180)]
    df = spark.createDataFrame(rows, "s string, at string, n int, k string, r boolean").withColumn("at", F.to_timestamp("at"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for part in (df.where("n < 90"), df.where("n >= 90")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = sessions.first_since_reset_stream(stream, "s", "k", ["at", "n"], F.col("r"))
        run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    epochs = sessions.with_epochs(df, "s", "at", ["at", "n"], F.col("r")).where("k IS NOT NULL")
    want = sessions.first_in_session(epochs, ["s", "epoch"], "k", ["at", "n"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect())
