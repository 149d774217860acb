"""Text functions, seeds and batches."""

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.operators import seed as S

LINES = {b"": [], b"a": ["a"], b"a\n": ["a"], b"a\n\n": ["a", ""], b"\n": [""], b"a\r\nb\r\n": ["a", "b"], b"a\r": ["a"], b"a\nb": ["a", "b"], b"\xff\n": ["�"]}


def test_lines(spark):
    df = spark.createDataFrame([(bytearray(k),) for k in LINES], "c binary")
    got = [r.l for r in df.select(T.lines(T.utf8(F.col("c"))).alias("l")).collect()]
    assert got == list(LINES.values())


def test_ascii_lower_and_strip(spark):
    r = spark.createDataFrame([("ÉA b ",)], "c string").select(T.ascii_lower(F.col("c")).alias("a"), T.strip(F.col("c")).alias("s")).first()
    assert (r.a, r.s) == ("Éa b ", "ÉA b")


def test_redacted(spark):
    r = spark.createDataFrame([("run: x ${{ Secrets.TOK-1.a }} mysecrets.b",)], "c string").select(T.redacted(F.col("c"), 160).alias("r")).first()
    assert r.r == "run: x ${{ secrets.<redacted> }} mysecrets.b"


def test_compaction_keeps_its_cap(spark):
    big = [{"line": i, "kind": "call", "text": "x" * 200} for i in range(500)]
    df = spark.createDataFrame([("a", "rust", [], ["s" * 300] * 50, ["c"] * 90, big, [])], "path string, lang string, imports array<string>, signatures array<string>, calls array<string>, locations array<struct<line:int,kind:string,text:string>>, external array<string>")
    for cap in (65536, 9000, 10):
        r = S.compact(df, cap).first()
        assert r.truncated and (len(r.json) + 1 <= cap or r.reason.startswith("minimal"))
    assert len(S.compact(df, 65536).first().record.locations) == 120


def test_ladder():
    steps = S.limit_ladder()
    assert steps[0]["locations"] == 120 and steps[-1] == {"signatures": 6, "calls": 20, "locations": 15, "external": 6, "text": 60}


def test_batches(spark):
    rows = spark.createDataFrame([("t", i, n) for i, n in enumerate([40, 50, 20, 200, 10, 95])], "tree string, seq int, size long")
    got = [r.batch for r in S.batches(rows, "size", ["seq"], ["tree"], 100).orderBy("seq").collect()]
    assert got == [0, 0, 1, 2, 3, 4]


def test_token_counts(spark):
    r = spark.range(1).select(S.tokens_of(F.lit(9)).alias("t"), S.cost(F.lit(2_000_000), 1.5).alias("c"), S.cost(F.lit(1), None).alias("n")).first()
    assert (r.t, r.c, r.n) == (3, 3.0, None)


def test_invalid_names_are_errors(spark):
    from tarnwork.operators.surface import selected

    with pytest.raises(ValueError):
        selected(spark.range(0), ["nowhere"])


def test_calls_are_not_definitions(spark):
    from tarnwork.functions.text import calls_named

    rows = ["system(x)", "def system(self)", "def" + " " * 200 + "system(self)", "def\u3000system(a)", "subsystem(x)", "_system(1)", "def system(a): system(b)", "x.system (1)", "system(system(1))", "undef system(1)", ""]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(calls_named(F.col("t"), "system").alias("c")).collect()]
    assert got == [True, False, False, False, False, False, True, False, True, False, False]


def test_observation_bytes(spark):
    """Sizes of indented JSON arrays, against Python's."""
    import json

    rows = [(0, "high", "a/é.py", 3, "r-1", 'say "x"', "tab\tline\n"), (0, "low", "b", None, "r-2", "t", ""), (1, "medium", "c\\d", 12, "r", "t", "e")]
    names = ["severity", "path", "line", "rule", "title", "evidence"]
    df = spark.createDataFrame(rows, "batch int, severity string, path string, line int, rule string, title string, evidence string")
    got = {r.batch: r.bytes for r in S.observation_bytes(df).collect()}
    for b in (0, 1):
        assert got[b] == len(json.dumps([dict(zip(names, r[1:], strict=True)) for r in rows if r[0] == b], indent=2, ensure_ascii=False).encode())


def test_seed_lines_and_batch_reports(spark):
    lines = ['{"path":"src/a.rs","locations":[{"kind":"call","line":9,"text":"thing.unwrap"}]}', '{"path":"src/b.rs","calls":["x.unwrap"]}', "not json", '{"calls":[]}', ""]
    seeds = S.read_seeds(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.path, r.kind, r.line, r.text) for r in S.seed_evidence(seeds).collect()) == [("src/a.rs", "call", 9, "thing.unwrap"), ("src/b.rs", "call", None, "x.unwrap")]
    reports = spark.createDataFrame([("# L\n| Severity | x |\n|---|---|\n| HIGH | b |\n| LOW | a |",), ("| HIGH | b | \nwords",)], "markdown string")
    assert [r.row for r in S.merged_reports(reports).collect()] == ["| HIGH | b |", "| LOW | a |"]


def test_settings(tmp_path):
    from tarnwork.sources import config

    text = "# c\n\nexport A = 1 # note\nB=\"x # y\" z\nC='q'\nD=a#b\nA=2\nE=\n"
    assert config.parse_env(text) == {"A": "2", "B": "x # y", "C": "q", "D": "a#b", "E": ""}
    for bad in ("x", "1a=2", "a b=1", "a='x"):
        with pytest.raises(config.SettingsError):
            config.parse_env(bad)
    assert config.read_env(str(tmp_path / "none")) == {} and config.read_policy(str(tmp_path / "none")).allow == []
    assert config.setting("A", {"A": "file"}, {"A": "process"}) == "process" and config.setting("A", {"A": "file"}, {}) == "file"


def test_spelled_patterns_match_as_the_alternation():
    import random
    import re

    from tarnwork.functions.text import quoted, shortest, spelled

    r = random.Random(1)
    for _ in range(3000):
        tokens = ["".join(r.choice("ab.") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 7))]
        text = "".join(r.choice("ab. ") for _ in range(r.randint(0, 9)))
        assert bool(re.search(spelled(tokens), text)) == bool(re.search(spelled(shortest(tokens)), text)) == any(t in text for t in tokens)
        assert bool(re.search(f"(?<![ab]){spelled(tokens)}(?![ab])", text)) == bool(re.search(f"(?<![ab])(?:{quoted(tokens)})(?![ab])", text))
    assert spelled(["curl", "cat ", "chmod "]) == "c(?:at |hmod |url)"
