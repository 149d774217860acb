"""Compaction of records: the rung found by sums is the one that writing every rung would find."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import fixed as X
from tarnwork.operators import seed as S

RECORD = "path string, lang string, imports array<string>, signatures array<string>, calls array<string>, locations array<struct<line:int,kind:string,text:string>>, external array<string>"


def written(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def limited(rec, k):
    clip = lambda s: s if len(s) <= k["text"] else s[: k["text"]] + "..."
    place = lambda p: {n: v for n, v in (("kind", p[1]), ("line", p[0]), ("text", clip(p[2]))) if v is not None}
    lists = {n: [clip(s) for s in rec[n][: k[n]]] for n in ("signatures", "calls")}
    out = {"path": rec["path"], "lang": rec["lang"], **lists, "locations": [place(p) for p in rec["locations"][: k["locations"]]], "external": [clip(s) for s in rec["external"][: k["external"]]]}
    return out | {"omitted": {n: max(len(rec[n]) - k[n], 0) for n in S.LISTS}}


def by_writing(rec, cap):
    for k in S.limit_ladder():
        out = limited(rec, k)
        if len(written(out).encode()) + 1 <= cap:
            return out, "compact_record_limits"
    return limited(rec, X.SEED_MINIMAL), "minimal_record_after_size_cap"


def records(seed, n):
    r = random.Random(seed)
    text = lambda: "".join(r.choice('ab"\\\n\t\b\f\r\x01\x1f\x7f/é世😀 ') for _ in range(r.choice([0, 1, 5, 47, 48, 49, 60, 61, 119, 120, 121, 300])))
    many = lambda: [text() for _ in range(r.choice([0, 1, 6, 7, 12, 24, 25, 80, 81, 130]))]
    for i in range(n):
        places = [(r.choice([None, 1, 12345]), r.choice(["call", "import"]), text()) for _ in range(r.choice([0, 1, 15, 16, 120, 121, 200]))]
        yield {"path": f'd"{i}/é.py', "lang": r.choice(["python", "rust"]), "imports": many(), "signatures": many(), "calls": many(), "locations": places, "external": many()}


@pytest.mark.parametrize("cap", [300, 2048, 12_000, X.SEED_CAP])
def test_the_rung_is_the_first_that_fits(spark, cap):
    recs = list(records(cap, 60))
    got = {x.path: x for x in S.compact(spark.createDataFrame([tuple(r.values()) for r in recs], RECORD), cap).collect()}
    for rec in recs:
        want, reason = by_writing(rec, cap)
        x = got[rec["path"]]
        assert json.loads(x.json) == want and x.reason == reason
        assert len(x.json.encode()) == len(written(want).encode())
        assert x.truncated == (reason.startswith("minimal") or sum(want["omitted"].values()) > 0)
        whole = {n: v for n, v in rec.items() if n != "locations"} | {"locations": [{k: v for k, v in zip(("line", "kind", "text"), p) if v is not None} for p in rec["locations"]]}
        assert x.whole_bytes == len(written(whole).encode())


def test_a_cap_at_the_exact_size(spark):
    rec = {"path": "a", "lang": "go", "imports": [], "signatures": ["s"], "calls": ["c" * 100] * 100, "locations": [], "external": []}
    for k, less in ((80, 0), (40, 1)):
        size = len(written(limited(rec, S.limit_ladder()[0])).encode()) + 1
        x = S.compact(spark.createDataFrame([tuple(rec.values())], RECORD), size - less).first()
        assert len(x.record.calls) == k


def test_results_are_written_and_read_from_there(spark):
    seeds = S.compact(spark.createDataFrame([], RECORD))
    plan = S.compact_evidence(seeds)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and len(plan) < 20_000 and seeds.count() == 0


def test_records_with_room_are_not_measured_by_element(spark, monkeypatch):
    from pyspark.sql import functions as F

    rec = {"path": "a", "lang": "go", "imports": ["i"], "signatures": ["s"], "calls": ["c" * 100] * 100, "locations": [(1, "call", "x" * 121)], "external": []}
    monkeypatch.setattr(S, "_element_bytes", lambda n, *_: F.transform(n, lambda x: F.raise_error(F.lit("measured")).cast("int")))
    x = S.compact(spark.createDataFrame([tuple(rec.values())], RECORD)).first()
    assert len(x.record.calls) == 80 and x.reason == "compact_record_limits" and x.truncated


@pytest.mark.parametrize("less", [-200, -128, -60, -1, 0, 1])
def test_the_rung_near_the_bound_of_the_whole(spark, less):
    rec = {"path": "a", "lang": "go", "imports": [], "signatures": ["s" * 121] * 3, "calls": ['"' * 121], "locations": [(1, "call", "x" * 121)], "external": ["é" * 121]}
    want = len(written(limited(rec, S.limit_ladder()[0])).encode()) + 1
    x = S.compact(spark.createDataFrame([tuple(rec.values())], RECORD), want - less).first()
    assert json.loads(x.json) == by_writing(rec, want - less)[0]


def test_imports_that_lead_out_are_found_in_one_pass(spark):
    from tarnwork.operators import extract as E

    kinds, texts = ["call", "import", "signature", "external", None], ["from .a import b", "  import c", "use d", "[EXTERNAL_BLACKBOX] from .a import b", "", None]
    r = random.Random(5)
    rows = [(f"p{i % 40}", r.choice(["a", "b"]), r.choice(kinds), r.choice([None, 1, 2, 10]), r.choice(texts)) for i in range(400)] + [("only", "a", None, 1, "x")]
    e = spark.createDataFrame(rows, "path string, lang string, kind string, line int, text string")
    told = lambda df: {(x.path, x.lang): x for x in df.collect()}
    one, two = E.records(e, follow=False), E.records(e.unionByName(E.external(e)))
    assert told(one) == told(two) and one.columns == two.columns and told(one)["only", "a"].locations == []
    for (path, lang), x in told(two).items():
        own = [q for q in rows if q[:2] == (path, lang)]
        for kind, got in (("import", x.imports), ("signature", x.signatures), ("call", x.calls)):
            assert got == sorted({q[4] for q in own if q[2] == kind and q[4] is not None})
        key = lambda q: tuple((v is not None, v or (0 if i == 0 else "")) for i, v in enumerate(q))
        assert [tuple(p) for p in x.locations] == sorted(((q[3], q[2], q[4]) for q in own if q[2] not in (None, "external")), key=key)
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert (leaves(one), leaves(two)) == (1, 2)


def test_only_lines_of_workflows_are_sorted_for_the_flag(spark):
    from tarnwork.operators import rules as R

    rows = [(".github/workflows/a.yml", "signature", 1, "run: echo ${{ github.event.x }} secrets.TOKEN"), (".github/workflows/a.yml", "signature", 2, "run: echo ${{ github.event.y }}"), (".github/workflows/b.yml", "signature", 1, "run: echo ${{ github.event.z }} | bash -c"), ("a.sh", "call", 1, "eval(secrets.TOKEN)"), (None, "call", 1, "eval(x)")]
    e = spark.createDataFrame(rows, "path string, kind string, line int, text string").withColumn("lang", F.lit("yaml"))
    found = R.line_findings(e)
    assert {(x.path, x.line) for x in found.collect() if x.rule == "workflow-secret-shell"} == {(".github/workflows/a.yml", 1), (".github/workflows/a.yml", 2)}
    assert {x.path for x in found.collect() if x.rule == "dynamic-shell-eval"} == {".github/workflows/b.yml", "a.sh", None}
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
