"""Lexer states by prefix scan and batching by pointer doubling, against plain loops."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import SF, same  # noqa: E402

from tarnwork.operators import lexer as L  # noqa: E402
from tarnwork.operators import seed as S  # noqa: E402
from tarnwork.operators.extract import syntax_evidence  # noqa: E402
from tarnwork.plans.catalog import QUERIES  # noqa: E402
from tarnwork.plans.oracle import ORACLE_SQL  # noqa: E402


def walked(lang, text):
    """(state, depth) on entry to each line, by a loop over the characters' tokens."""
    x = L.LEXIS[lang]
    state, depth, out = 0, 0, []
    for line in text.split("\n"):
        out.append((state, depth))
        i = 0
        while i <= len(line):
            if state:
                end = line.find(x.across[state - 1][1], i)
                if end < 0:
                    break
                i, state = end + len(x.across[state - 1][1]), 0
                continue
            if i == len(line):
                break
            for k, (a, _) in enumerate(x.across):
                if line.startswith(a, i):
                    state, i = k + 1, i + len(a)
                    break
            else:
                if any(line.startswith(c, i) for c in x.line):
                    break
                m = next((m for s in x.strings if (m := re.compile(s).match(line, i))), None)
                i = m.end() if m else i + 1
                depth += 0 if m else (line[i - 1] in "([") - (line[i - 1] in ")]")
    return out


@pytest.mark.parametrize("size", [256, 3])
def test_states_equal_a_walk(spark, size):
    r = random.Random(size)
    parts = ["foo(", ")", "[", "]", '"a(b"', "'x'", "/*", "*/", "//", "#", '"""', "'''", "`", "--", "<!--", "-->", "x.y", " ", " ", "=begin", "=end", 'r#"', '"#', ";"]
    files = {f"{lang}{n}": (lang, "\n".join("".join(r.choice(parts) for _ in range(r.randrange(0, 7))) for _ in range(40))) for lang in L.LEXIS for n in range(2)}
    rows = [(p, lang, i + 1, raw) for p, (lang, t) in files.items() for i, raw in enumerate(t.split("\n"))]
    got = {(x.path, x.line): (x.state, x.depth) for x in L.lexed(spark.createDataFrame(rows, "path string, lang string, line int, raw string"), size).collect()}
    assert got == {(p, i + 1): s for p, (lang, t) in files.items() for i, s in enumerate(walked(lang, t))}


CASES = [
    ("javascript", "import x from 'y(z)';\n/* a(1)\n b(2) */ c\n  .d(3);\nconst s = `t(1)\nu(2)`; v(\n  w\n   (5)) // z(6)\nfunction f(9) { return g(10) }", {(3, "c"), (6, "v"), (7, "w"), (9, "g")}),
    ("go", 'import (\n "fmt"\n)\nfunc main() {\n x := a(`b(1)\nc(2)`)\n fmt.Println(\n  y,\n  z())\n name\n (1)\n}', {(5, "a"), (7, "fmt.Println"), (9, "z")}),
    ("rust", "fn f<'a>() { let c = '('; println!(\"x(1)\"); a::<T>(2); }\n/* b(1) */ d\n  .e(1)", {(1, "println!"), (1, "a"), (2, "d")}),
    ("java", 'int x = a\n (1); // b(2)\nString s = """\n c(3)\n""" + d(4);', {(1, "a"), (5, "d")}),
    ("c", "int main(void) {\n#define X a(1)\n  return b /* c(2) */ (3);\n}", {(3, "b")}),
    ("python", "def f(:\n  '''doc a(1)\n  b(2)\n  '''\n  y = c(\n   d)", {(5, "c")}),
    ("php", "$x = a(1); # b(2)\nc\n(3);", {(1, "a"), (2, "c")}),
]


def test_calls_over_lines_and_none_in_comments_and_strings(spark):
    files = spark.createDataFrame([(f"f{i}", lang, t) for i, (lang, t, _) in enumerate(CASES)], "path string, lang string, content string")
    rows = syntax_evidence(files).where("kind = 'call'").collect()
    for i, (lang, _, want) in enumerate(CASES):
        got = {(x.line, x.text) for x in rows if x.path == f"f{i}"}
        assert want <= got and {t for _, t in got} - {t for _, t in want} <= {"main"}, (lang, got)


def folded(sizes, cap):
    number, filled, out = 0, 0, []
    for n in sizes:
        if filled and filled + n > cap:
            number, filled = number + 1, 0
        filled += n
        out.append(number)
    return out


def test_batches_equal_the_fold(spark):
    r, trees = random.Random(3), {}
    for t in range(24):
        trees[t] = [r.choice([0, 0, 1, 7, 40, 99, 100, 101, 250, r.randrange(130)]) for _ in range(r.randrange(0, 60))]
    trees |= {100: [0, 0, 0], 101: [500], 102: [500, 0], 103: [500, 0, 300, 0, 0, 5], 104: [0, 500, 500], 105: [100, 0, 0, 100], 106: [1] * 500, 107: [50, 50, 0, 1]}
    rows = [(t, i, n) for t, sizes in trees.items() for i, n in enumerate(sizes)]
    df = S.batches(spark.createDataFrame(rows, "tree int, i int, n int").repartition(5), "n", ["i"], ["tree"], 100)
    got = {(x.tree, x.i): x.batch for x in df.collect()}
    assert got == {(t, i): b for t, sizes in trees.items() for i, b in enumerate(folded(sizes, 100))}


@pytest.mark.parametrize("segment", [2, 64])
def test_batches_over_levels_of_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    r = random.Random(segment)
    trees = {t: [r.choice([0, 1, 30, 99, 100, 101, 150, 700, r.randrange(1, 40)]) for _ in range(n)] for t, n in enumerate((1, 5, 300, 600))}
    rows = [(t, i, n) for t, sizes in trees.items() for i, n in enumerate(sizes)]
    df = S.batches(spark.createDataFrame(rows, "tree int, i int, n int").repartition(5), "n", ["i"], ["tree"], 100)
    assert {(x.tree, x.i): x.batch for x in df.collect()} == {(t, i): b for t, sizes in trees.items() for i, b in enumerate(folded(sizes, 100))}


def test_pointers_of_all_records_are_written_once(spark, monkeypatch):
    """All pointers were joined and written anew for each doubling of the batches."""
    written, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = spark.range(4000).selectExpr("0 as tree", "id * 10 as start", "10L as size")
    starts = {x.batch: x.start for x in S.bin_starts(rows, ["tree"], 50).collect()}
    assert starts == {b: 50 * b for b in range(800)}
    assert sum(df.count() for df in written) < 2 * 4000


def test_no_group_is_folded_in_one_task(spark):
    df = S.batches(spark.range(1000).selectExpr("0 as tree", "id as i", "10 as n"), "n", ["i"], ["tree"], 100)
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString() and {x.batch for x in df.collect()} == set(range(100))


@pytest.mark.parametrize("name", ["lexed_calls", "lexed_states", "seed_batches"])
def test_matches_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE_SQL[name]) > 0
