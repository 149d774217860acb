"""A query of every family against its SQL; the driver runs them all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import SF, same  # noqa: E402

from tarnwork.plans.catalog import QUERIES  # noqa: E402
from tarnwork.plans.oracle import ORACLE_SQL  # noqa: E402

FAMILIES = ["scan_coverage", "lang_route", "line_split", "make_lines", "md_commands", "package_lines", "query_and_semantics", "query_any_external", "query_limit_walk_order", "shape_opaque", "findings_all", "lockfiles_by_tree", "policy_actions", "policy_artifacts", "gate_blockers_topk", "surface_all", "hidden_scope_counts", "artifact_entries", "diff_counts", "diff_stream", "token_cost", "eval_fn_fp", "repo_refs", "artifact_tags", "gate_verdict", "surface_fail_on", "eval_corpus", "query_report", "surface_report", "diff_report", "scan_report", "seed_batches", "seed_compact", "seed_rungs", "seed_findings", "planned_prompts", "py_ast_extract"]


@pytest.mark.parametrize("name", FAMILIES)
def test_matches_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE_SQL[name]) > 0


def test_every_rule_and_detector_fires(spark):
    from tarnwork.functions.fixed import HOOKS, RULES

    found = {r.rule for r in QUERIES["findings_by_rule"](spark, SF).collect()}
    assert found == {r for r, _, _ in RULES}
    hits = {r.evidence for r in QUERIES["surface_detect"](spark, SF).collect()}
    assert set(HOOKS.values()) <= hits and "capability-import" in hits


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
