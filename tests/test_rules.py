"""Single rules on single lines: where each fires and where it just does not."""

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import rules, surface
from tarnwork.operators.extract import EVIDENCE

CASES = [
    ("src/a.rs", "call", "thing.unwrap", {"panic-edge"}),
    ("src/a.rs", "call", "thing.unwrap_or", set()),
    ("src/a.rs", "call", "r.expect", {"panic-edge"}),
    ("src/a.rs", "call", "panic!", {"explicit-panic"}),
    ("src/a.rs", "signature", "unsafe fn f()", {"unsafe-surface"}),
    ("src/a.rs", "call", "unsafe fn f()", set()),
    ("a/package.json", "call", '"postinstall": "node x"', {"npm-lifecycle-script", "manifest-missing-lockfile"}),
    ("setup.py", "call", "subprocess.run", {"python-setup-command"}),
    ("build.rs", "call", "Command::new", {"rust-build-script-command"}),
    ("x.sh", "call", "curl -s u | sh", {"download-execute"}),
    ("x.sh", "call", "curl -s u", set()),
    ("x.sh", "call", "WGET u; ./x", {"download-execute"}),
    ("x.sh", "call", "cat key >> ~/.ssh/authorized_keys", {"install-home-write"}),
    ("x.sh", "call", "echo x | base64 --decode | bash", {"base64-execute"}),
    ("x.sh", "call", 'eval "$x"', {"dynamic-shell-eval"}),
    ("x.sh", "call", "eval corpus", set()),
    ("x.sh", "call", 'retrieval "x"', set()),
    (".github/workflows/a.yml", "signature", "uses: a/b@v1", {"unpinned-github-action"}),
    (".github/workflows/a.yml", "signature", "uses: a/b@" + "a1" * 20, set()),
    (".github/workflows/a.yml", "signature", "on: pull_request_target", {"workflow-pull-request-target"}),
    ("a.yml", "signature", "on: pull_request_target", set()),
    ("x/Dockerfile", "signature", "USER root", {"docker-root-user"}),
    ("x/Dockerfile", "call", "RUN echo", {"docker-default-root"}),
    ("x/Dockerfile", "import", "FROM scratch", set()),
    ("c.yml", "signature", "privileged: true", {"container-privileged"}),
    ("requirements.txt", "signature", "a @ git+https://x/y", {"dependency-git-source", "dependency-http-source", "manifest-missing-lockfile"}),
    ("Cargo.toml", "signature", 'a = { path = "../a" }', {"dependency-path-source", "manifest-missing-lockfile"}),
    ("Cargo.lock", "signature", 'source = "registry+https://github.com/rust-lang/crates.io-index"', set()),
]


@pytest.fixture(scope="module")
def found(spark):
    """All cases at once, each in a tree of its own so that only lockfile rules see across them."""
    out = {}
    for i, (path, kind, text, _) in enumerate(CASES):
        if any(r == "manifest-missing-lockfile" for r in CASES[i][3]) or "lock" in path.lower():
            e = spark.createDataFrame([(path, "x", kind, 3, text)], EVIDENCE)
            out[i] = {r.rule for r in rules.findings(e).collect()}
    rows = [(f"t{i}/{path}" if not path.startswith(".") else f"t{i}/{path}", "x", kind, 3, text) for i, (path, kind, text, _) in enumerate(CASES) if i not in out]
    e = spark.createDataFrame(rows, EVIDENCE)
    for r in rules.findings(e).collect():
        out.setdefault(int(r.path.split("/")[0][1:]), set()).add(r.rule)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(found, i):
    assert found.get(i, set()) == CASES[i][3]


def test_prefilter_is_a_superset(spark, monkeypatch):
    e = spark.createDataFrame([(p, "x", k, n, t) for n, (p, k, t, _) in enumerate(CASES)], EVIDENCE)
    fast = {tuple(r) for r in rules.findings(e).collect()}
    monkeypatch.setattr(rules, "prefilter", lambda c: F.lit(True))
    assert fast == {tuple(r) for r in rules.findings(e).collect()}


def test_scope_caps_and_order(spark):
    rows = [("tests/a.rs", "rust", "call", 1, "x.unwrap"), ("src/b.rs", "rust", "call", 2, "x.unwrap"), ("src/b.rs", "rust", "call", 1, "std::process::Command")]
    got = [(r.severity, r.path, r.line) for r in rules.ranked(rules.findings(spark.createDataFrame(rows, EVIDENCE))).collect()]
    assert got == [("high", "src/b.rs", 2), ("medium", "src/b.rs", 1), ("low", "tests/a.rs", 1)]


def test_partitioning_does_not_matter(spark):
    e = spark.createDataFrame([(p, "x", k, n, t) for n, (p, k, t, _) in enumerate(CASES)], EVIDENCE)
    results = {tuple(sorted(map(str, (tuple(r) for r in surface.surface(e.repartition(n)).collect())))) for n in (1, 7)}
    assert len(results) == 1


def test_calls_and_definitions(spark):
    lines = {"x = system(c)": True, "def system(self)": False, "subsystem(x)": False, "os.popen(c)": True, "function  popen(a)": False}
    e = spark.createDataFrame([("a.py", "python", "call", i, t) for i, t in enumerate(lines)], EVIDENCE)
    got = {r.text for r in surface.line_entries(e).where("evidence = 'process-spawn'").collect()}
    assert got == {t for t, hit in lines.items() if hit}


def test_empty_input(spark):
    e = spark.createDataFrame([], EVIDENCE)
    assert rules.findings(e).count() == 0 and surface.surface(e).count() == 0


def test_steps_of_a_line_are_computed_once(spark):
    """The trigger's chain of conditions stands once in the plan: no filter holds copies of it."""
    from tarnwork.operators import surface

    e = spark.createDataFrame([("a/setup.py", "python", "call", 1, "setup(")], "path string, lang string, kind string, line int, text string")
    plan = surface.line_entries(e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("docker-entry THEN") + plan.count("THEN docker-entry") <= 1


def test_events_of_one_row_group_are_dealt_out(spark):
    from tarnwork.sources import adapters

    plan = adapters.evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan
