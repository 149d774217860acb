"""The pipeline on the smallest tables, each stage against the operators' own results."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    packed = P.STAGES[-1][1](spark, docs, SF)
    whole = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(whole) == sizes[4] and all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)


def test_sql(spark):
    from compare import same

    from tarnwork.llm.queries import ORACLE_SQL, QUERIES

    for name, sql in ORACLE_SQL.items():
        assert same(QUERIES[name](spark, SF), sql) > 0


def _brute_force(rows, bench):
    """doc_ids and texts after the first four stages, straight from their rules."""
    import collections

    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(strip))
    rank = lambda i: -1 if i is None else i
    words = lambda t: (t or "").encode().lower().split()

    def shingles(t, n=5):
        w = words(t)
        return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else collections.Counter()

    rows = [(i, t) for i, t in rows if t is not None and any(c.isalpha() for c in t)]
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            held[key(line)].add(rank(i))
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != rank(i)
    rows = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]
    group = {i: i for i, _ in rows if i is not None}
    for i, t in rows:
        for j, u in rows:
            a, b = shingles(t), shingles(u)
            if None not in (i, j) and a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                low, both = min(group[i], group[j]), (group[i], group[j])
                group = {k: low if g in both else g for k, g in group.items()}
    rows = [(i, t) for i, t in rows if i is None or group[i] == i]

    def holds(t):
        for u in bench:
            n = min(5, len(words(u)))
            item, w = set(shingles(u)), words(t)
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if item and len(item & own) >= 0.8 * len(item):
                return True
        return False

    return [(i, t) for i, t in rows if not holds(t)]


def test_stages_equal_brute_force(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, ties and extra columns, against the rules themselves."""
    import collections
    import random

    import corpus_pipeline as P

    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(300)}q" for _ in range(n))
    shared, item, long = "a line that many of these documents share", text(12), text(150)
    rows = [(i, f"{text(40)}\n{shared}\n{text(9)}") for i in range(6)] + [(10, long), (11, long), (12, long + " more"), (13, f"{text(30)} {item} {text(30)}"), (14, None), (15, ""), (16, "12 34 !"), (17, "été"), (18, text(4000))]
    rows += [(3, rows[3][1]), (None, text(20)), (None, shared)]
    other = text(80)
    rows += [(21, other), (19, other), (19, long), (23, other + " extra"), (24, text(60)), (24, text(70)), (25, rows[-1][1])]  # ids with two texts
    table = [(i, t, None if k % 4 == 0 else "xx", None if k % 3 else "s", k) for k, (i, t) in enumerate(rows)]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(1).alias(c) for c in ("n_lines", "gone", "class_id", "flags", "key")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = P.read_table(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES[:-1]:
        now = P.materialize(stage(spark, now, str(tmp_path)), f"brute-{name}")
        assert now.columns == docs.columns
    want = collections.Counter(_brute_force(rows, [item, None, ""]))
    assert collections.Counter((x.doc_id, x.text) for x in now.collect()) == want
    pieces = P.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("m")).collect()
    assert {x.doc_id for x in pieces} == {i for i, _ in want} and all(x.n == x.m for x in pieces)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
