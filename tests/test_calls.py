import pytest
from pyspark.sql import functions as F

from shardleaf.functions import calls, languages
from shardleaf.functions import text as T


def answers(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.withColumn("y", expression(F.col("x"))).orderBy("i").collect()]


def test_command_behind_its_wrappers(spark):
    cases = {
        "git status": "git", "  gh pr list": "gh", "sudo git pull": "git", "sudo -u me -E git pull": "git", "env A=1 git log": "git", "sudo env RETRY=3 git fetch --all": "git",
        "env A=1 env B=2 env -i git log": "git", "env -u HOME git log": "git", 'bash -c "git status"': "git", "sh -c 'git log'": "git", "bash -c git status": "git", 'sudo bash -c "gh pr"': "gh",
        'bash -c "sudo git status"': "sudo", "bash run.sh": "bash", "ls": "ls", "": None, "   ": None, "sudo": None, 'bash -c ""': None, 'bash -c "  "': None, "bash -c": None, "environment x": "environment", "sudoku": "sudoku",
    }
    assert answers(spark, [*cases, None], calls.effective_head) == [*cases.values(), None]


def test_conditions(spark):
    git = '{"bash_command_starts_with": ["git", "gh"]}'
    rows = [
        (git, "Bash", "sudo git push", True), (git, "Bash", "ls", False), (git, "Edit", "git", False), (git, "Bash", None, False), (git, None, "git", False), (git, "Bash", "GIT push", False),
        ('{"tools": ["Edit"]}', "Edit", None, True), ('{"tools": ["Edit"]}', "edit", None, False), ('{"tools": []}', "Edit", None, False), ("{}", "Edit", None, True), (None, None, None, True), ("not json", None, None, True),
        ('{"tools": ["Bash"], "bash_command_starts_with": ["gh"]}', "Bash", "git", False),
    ]
    df = spark.createDataFrame(rows, "c string, tool string, command string, want boolean")
    for r in df.withColumn("got", calls.applies(F.col("c"), F.col("tool"), F.col("command"))).collect():
        assert r.got == r.want, r


def test_languages_of_calls(spark):
    rows = [
        ("Edit", "lib/parse_dates.rs", None, None, ["rust"]), ("Edit", "tools/go.mod", None, None, ["golang"]), ("Edit", "a/B.TSX", None, None, ["typescript"]), ("Bash", None, "make all", None, []),
        ("Bash", None, "bundler exec", None, []), ("Bash", None, "TRACE=1 ghc Main.hs", None, ["haskell"]), ("Bash", None, "yarn lint orders", None, ["typescript", "javascript"]),
        ("Edit", None, "mix test", None, []), ("Bash", None, None, "Start dotnet watch", ["csharp"]), ("Edit", "x/.venv/lib/readme", None, None, ["python"]), ("Edit", ".py", None, None, []), (None, None, None, None, []),
        ("Bash", "a/x.py", "/usr/bin/python3 x.py && zig build", "", ["python", "zig"]),
    ]
    df = spark.createDataFrame(rows, "tool string, path string, command string, description string, want array<string>")
    for r in df.withColumn("got", languages.infer_languages(*map(F.col, ("tool", "path", "command", "description")))).collect():
        assert r.got == r.want, r


def test_terms_and_query_strings(spark):
    assert answers(spark, ["a/parseDates.rs", "OrderTable.tsx", "retry_limits.py", "XMLFeed"], calls.filename_terms) == [["parse", "dates"], ["order", "table"], ["retry", "limits"], ["x", "m", "l", "feed"]]
    rows = [(["rust"], ["parse", "dates"], "rust AND (parse OR dates)"), (["a", "b"], ["c"], "(a OR b) AND (c)"), (["a"], [], "a"), ([], ["x", "y"], "x OR y"), ([], [], None)]
    df = spark.createDataFrame(rows, "l array<string>, t array<string>, want string")
    for r in df.withColumn("got", calls.query_string(F.col("l"), F.col("t"))).collect():
        assert r.got == r.want
    words = "the a retry which limits retry cafebabe about ok their one how".split()
    got = spark.createDataFrame([(words,)], "w array<string>").select(T.clean_terms(F.col("w")).alias("t")).head().t
    assert got == ["retry", "limits", "one"] and len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 57


def test_small_text_functions(spark):
    assert answers(spark, ["aé", "aéb", "日本", "", None], lambda x: T.truncate_bytes(x, 2)) == ["a", "a", "", "", None]
    assert answers(spark, ['"a"', "'b'", "\"c'", '"', ""], T.strip_quotes) == ["a", "b", "\"c'", '"', ""]
    assert answers(spark, ["0", "1023", "1536", "1048576", "3221225472"], lambda x: T.format_bytes(x.cast("long"))) == ["0 B", "1023 B", "1.5 KB", "1.0 MB", "3.0 GB"]
    assert answers(spark, ["a, b\tc"], T.one_line_token) == ["a__b_c"]
    assert answers(spark, ['tags: [design, "patterns"]', "tags:\n  - a\n  - 'b'\nlanguage: go", "tags: x", "", None], T.tag_list) == [["design", "patterns"], ["a", "b"], [], [], []]
    assert answers(spark, ["applies_when", "Applies_When", "aplies_when", "other"], lambda x: T.near_miss(x, "applies_when")) == [False, True, True, False]


@pytest.mark.parametrize("empty", [True, False])
def test_call_queries_take_empty_and_null_rows(spark, empty):
    df = spark.createDataFrame([(None,) * 5], "tool string, path string, command string, description string, tail string").where(F.lit(not empty))
    terms = df.select(calls.call_terms(*map(F.col, df.columns)).alias("t")).collect()
    assert [r.t for r in terms] == ([] if empty else [[]])
