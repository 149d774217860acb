"""Whole runs over trees: query, surface, diff and gate, with the exit status of each."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import utf8
from ..operators import diff as D
from ..operators import extract as E
from ..operators import gate as G
from ..operators import policy as J
from ..operators import query as Q
from ..operators import rules as R
from ..operators import seed as S
from ..operators import surface as C
from ..operators.paths import language, severity_rank
from ..session import cut
from ..sources.tree import read_tree
from . import render


@dataclass
class Outcome:
    """rows: the result; status: 0, 1 or 2 as the command of that name exits; more: counts, texts."""

    rows: DataFrame
    status: int
    more: dict[str, Any]


def load(spark: SparkSession, root: str, max_bytes: int = X.MAX_BYTES, **options) -> tuple[DataFrame, DataFrame]:
    """(files with lang and status, evidence with external references)."""
    return prepared(read_tree(spark, root, maxBytes=max_bytes, **options), max_bytes)


def prepared(tree: DataFrame, max_bytes: int = X.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    files = E.routed(tree, max_bytes)
    files = files.withColumn("status", F.when(F.col("read_failed"), "read_failed").otherwise(F.col("status")))
    read = files.where("status = 'dehydrated'")
    evidence = E.line_evidence(E.file_lines(read)).unionByName(E.syntax_evidence(read))
    evidence = cut(evidence.distinct())  # later steps neither read the tree nor extract again
    return files, evidence.unionByName(E.external(evidence))


def query(spark: SparkSession, root: str, filters: Q.Filters, limit: int = 200, **options) -> Outcome:
    wanted = Q.about_file(filters, language(F.col("path")))  # other files are listed, not opened
    files, evidence = load(spark, root, wanted=wanted, **options)
    found = Q.matches(evidence, filters, files.where("status = 'dehydrated'"))
    shown = Q.limited(found, limit)
    return Outcome(found, 0 if shown.limit(1).count() else 1, {"scanned": files, "files": shown, "lines": Q.grep_lines(found)})


def ledger(spark: SparkSession, root: str, max_bytes: int = X.MAX_BYTES, **options) -> DataFrame:
    """All capability entries of a tree."""
    files, evidence = load(spark, root, max_bytes, **options)
    text = files.where("status = 'dehydrated'").select("path", utf8(F.col("content")).alias("content"))
    extra = [C.artifact_entries(C.artifacts(files, max_bytes)), C.shape_entries(C.shapes(text))]
    return C.surface(evidence.where("kind <> 'external'"), files.where("status = 'dehydrated'"), extra)


def surface(spark: SparkSession, root: str, scopes=None, capabilities=None, limit: int = 200, fail_on=(), **options) -> Outcome:
    entries = ledger(spark, root, **options)
    chosen = C.selected(entries, scopes, capabilities)
    rows = C.ranked(chosen)
    C.selected(entries, None, list(fail_on))
    failed = bool(fail_on) and C.fails(entries, list(fail_on))
    return Outcome(rows.limit(limit) if limit else rows, int(failed), {"entries": entries, "counts": C.counts(chosen), "hidden": C.hidden_by_scope(entries, scopes), "lines": render.entry_line(rows)})


def diff(spark: SparkSession, a: str, b: str, scopes=None, capabilities=None, **options) -> Outcome:
    sides = [C.selected(ledger(spark, r, **options), scopes, capabilities) for r in (a, b)]
    rows = D.diff(*sides)
    return Outcome(rows, int(rows.limit(1).count() > 0), {})


def seed_records(files: DataFrame, evidence: DataFrame, cap: int = X.SEED_CAP) -> DataFrame:
    """The compacted record of every file that was read, evidence or none, with its size before."""
    read, empty = files.where("status = 'dehydrated'").select("path", "lang"), F.array().cast("array<string>")
    whole = read.join(E.records(evidence).drop("lang"), "path", "left")
    whole = whole.select("path", "lang", *(F.coalesce(c, empty).alias(c) for c in ("imports", "signatures", "calls")), F.coalesce("locations", F.array().cast("array<struct<line:int,kind:string,text:string>>")).alias("locations"), F.coalesce("external", empty).alias("external"))
    return S.compact(whole, cap)


def eval_corpus(spark: SparkSession, files: DataFrame, cases=X.EVAL_CASES, max_bytes: int = X.MAX_BYTES, trees: DataFrame | None = None) -> DataFrame:
    """Expected and found outcome of each tree; a tree is the first folder of ``files``.

    ``trees``: (fixture, case), any number of trees a case; without it each case is a tree of its own name.
    All trees are judged in one run: rules see whole paths, so the name of a tree must not name a scope.
    """
    tree = F.substring_index("path", "/", 1)
    files, evidence = prepared(files, max_bytes)
    seeds = seed_records(files, evidence)
    external = seeds.select("path", F.explode("record.external").alias("text"))
    found = R.findings(S.compact_evidence(seeds), external, seeds.select("path"), tree)
    rules = found.groupBy(tree.alias("fixture")).agg(F.array_sort(F.collect_set("rule")).alias("actual_rules"), F.count_if(F.col("severity") == "high").alias("high"))
    odd = C.artifacts(files, max_bytes).groupBy(tree.alias("fixture")).agg(F.count("*").alias("n_artifacts"))
    read = files.groupBy(tree.alias("fixture")).agg(F.count_if(F.col("status") == "dehydrated").alias("n_read"))
    size = seeds.groupBy(tree.alias("fixture")).agg(F.sum(F.octet_length("json") + 1).cast("long").alias("seed_bytes"))
    want = spark.createDataFrame([(n, v, list(r)) for n, v, r in cases], "case string, expected_verdict string, expected_rules array<string>")
    # the cases are a fixed list
    out = F.broadcast(want.withColumnRenamed("case", "fixture")) if trees is None else trees.join(F.broadcast(want), "case").drop("case")
    for part in (rules, odd, read, size):
        out = out.join(part, "fixture", "left")
    n_artifacts, n_read = F.coalesce("n_artifacts", F.lit(0)), F.coalesce("n_read", F.lit(0))
    got = F.coalesce("actual_rules", F.array().cast("array<string>"))
    verdict = F.when((n_read == 0) & (n_artifacts == 0), "INCOMPLETE").when(F.col("high") > 0, "REJECT").when((n_artifacts > 0) | (F.size(got) > 0), "CAUTION").otherwise("ACCEPT")
    seed_bytes = F.coalesce("seed_bytes", F.lit(0).cast("long"))
    out = out.select("fixture", "expected_verdict", verdict.alias("actual_verdict"), "expected_rules", got.alias("actual_rules"), F.array_sort(F.array_except("expected_rules", got)).alias("false_negative_rules"), F.array_sort(F.array_except(got, "expected_rules")).alias("false_positive_rules"), seed_bytes.alias("seed_bytes"), S.tokens_of(seed_bytes).alias("estimated_tokens"))
    return out.withColumn("pass", (F.col("actual_verdict") == F.col("expected_verdict")) & (F.size("false_negative_rules") == 0))


def gate(spark: SparkSession, root: str, policy: J.Policy | None = None, max_bytes: int = X.MAX_BYTES, cap: int = X.SEED_CAP, **options) -> Outcome:
    """Findings of compacted records, policy, artifacts, verdict; status 0 only for ACCEPT."""
    policy = policy or J.Policy()
    files, evidence = load(spark, root, max_bytes, **options)
    seen = Observation()
    files = cut(G.counted(files.drop("content"), seen))  # names, sizes and outcomes: no file is opened for them again
    seeds = seed_records(files, evidence, cap)
    external = seeds.select("path", F.explode("record.external").alias("text"))
    found = R.findings(S.compact_evidence(seeds), external, seeds.select("path"))
    judged = cut(J.judged(found, policy))
    kept = judged.where("not suppressed")
    artifacts = J.artifacts_left(C.artifacts(files, max_bytes), policy)
    left = artifacts.where("action is null")
    coverage = G.coverage_on_the_way(seeds.select("truncated", (F.octet_length("json") + 1).alias("seed_bytes")), seen)
    row = G.verdict(kept, left, coverage, policy.max_candidate_files).first().asDict()
    why = [r.why for r in G.why(kept, 3, "severity_before").collect()]
    truncated = seeds.where("truncated").select("path", (F.col("whole_bytes") + 1).alias("original_bytes"), (F.octet_length("json") + 1).alias("compacted_bytes"), "reason")
    cut_short = [f"{r.path} original_bytes={r.original_bytes} compacted_bytes={r.compacted_bytes} reason={r.reason}" for r in truncated.orderBy("path").limit(X.SHOWN).collect()]
    if row["reasons"]:
        why = [f"Input coverage is incomplete: {r}" for r in row["reasons"][:3]]
        stops = [f"coverage requires review: {r}" for r in row["reasons"]] + [f"truncated record: {r}" for r in cut_short]
    else:
        listed = left.orderBy("path").limit(X.SHOWN).collect()
        stops = [r.blocker for r in G.blockers(kept, 10, "severity_before").collect()] + [f"artifact requires review: {a.path} size_bytes={a.size_bytes} reason={a.reason}" for a in listed]
        if not why:
            why = [f"Suspicious artifact requires review: {a.path}" for a in listed[:3]] or ["No deterministic risks found in the analyzed input.", "This gate does not replace manual review of runtime behavior."]
    order = (severity_rank(F.col("severity_before")).alias("o1"), F.col("path").alias("o2"), F.coalesce("line", F.lit(-1)).alias("o3"), F.col("rule").alias("o4"), F.col("rule_seq").alias("o5"), F.col("evidence").alias("o6"))
    actions = judged.where("action is not null").select(F.lit(0).alias("o0"), *order, "action")  # in the ledger's order, artifacts behind
    behind = artifacts.where("action is not null").select(F.lit(1).alias("o0"), F.lit(0).alias("o1"), F.col("path").alias("o2"), F.lit(0).alias("o3"), F.lit("").alias("o4"), F.lit(0).alias("o5"), F.lit("").alias("o6"), "action")
    actions = actions.unionByName(behind).orderBy(*(f"o{i}" for i in range(7))).select("action")
    odd = [f"{a.path} size_bytes={a.size_bytes} reason={a.reason}" for a in left.orderBy("path").limit(X.SHOWN).collect()]
    return Outcome(kept, 0 if row["verdict"] == "ACCEPT" else 1, {"verdict": row, "why": why, "blockers": stops, "actions": actions, "artifacts": left, "truncated": truncated, "text": render.gate_text(row, why, stops, cut_short, odd)})
