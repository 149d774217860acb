"""Whole files lexed in one row: the states of the prefix scan, the calls of its statements, and nothing shuffled."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
from test_lexer_batches import CASES, walked  # noqa: E402

from tarnwork.operators import extract as E  # noqa: E402
from tarnwork.operators import lexer as L  # noqa: E402
from tarnwork.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
FILE = "path string, lang string, content string"


def _files(spark):
    r = random.Random(11)
    parts = ["foo(", ")", "[", "]", '"a(b"', "'x'", "/*", "*/", "//", "#", '"""', "'''", "`", "--", "<!--", "-->", "x.y", " ", "é ", "=begin", "=end", 'r#"', '"#', ";", "\n", "\n", "\\", "fn ", ".z ("]
    rows = [(f"{lang}{n}", lang, "".join(r.choice(parts) for _ in range(90))) for lang in L.LEXIS for n in range(3)]
    rows += [(f"f{i}", lang, t) for i, (lang, t, _) in enumerate(CASES)] + [("none", "c", ""), ("end", "c", "a(1)\r\nb(2)\r\n"), ("other", "yaml", "a(1)")]
    return rows, spark.createDataFrame(rows, FILE)


def test_states_of_whole_files(spark):
    rows, files = _files(spark)
    got = {x.path: [(y.state, y.depth) for y in x.lines] for x in L.file_states(files).collect()}
    assert got == {p: walked(lang, t.removesuffix("\n") if p != "end" else "a(1)\nb(2)") for p, lang, t in rows if lang in L.LEXIS}


def test_calls_of_whole_files(spark):
    _, files = _files(spark)
    seen = lambda df: sorted(tuple(x) for x in df.select("path", "lang", "line", "text").collect())
    got = seen(L.file_calls(files, 7))
    assert got == seen(L.calls(L.statements(L.lexed(E.file_lines(files))))) and len(got) > 50


def test_lexed_queries_shuffle_no_lines(spark):
    assert "Exchange" not in QUERIES["lexed_calls"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = QUERIES["lexed_states"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Checkpoint" not in plan and "Scan ExistingRDD" not in plan  # counts alone
