"""Collocations, repeated passages and vector codes against brute force."""

import collections
import hashlib
import math
import os
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import SF, same  # noqa: E402


def _clashing(df):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(("n", "word", "block", "did", "owner", "x", "code", "error", "size", "w1", "rank", "key"))))


# --- collocations


def _texts(seed, n):
    r = np.random.default_rng(seed)
    words = [f"W{i}" for i in range(12)] + ["über", "the", "of", "x" * 80]
    p = 1 / np.arange(1, len(words) + 1)
    out = []
    for _ in range(n):
        t = r.choice(words, 60, p=p / p.sum()).tolist()
        out.append("".join(w + str(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])) for w in t))
    return out


def brute_collocations(rows, least, top):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for g, a in c.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(len(h) == 3 and g in (h[:2], h[1:]) and 100 * b >= 50 * a for h, b in c.items() if b >= least):
                continue
            score, _, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k, k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        n = sum(v for g, v in c.items() if len(g) == 1)
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("dictionary", [1_000_000, 4, 0])
def test_collocations(spark, dictionary):
    from tarnwork.llm.collocations import collocations

    rows = [("en", t) for t in _texts(1, 30)] + [(None, t) for t in _texts(2, 12)] + [("und", "the of the of"), ("en", None), ("de", ""), ("fr", " \t. ")] + [("en", _texts(1, 1)[0])] * 5
    rows += [("en", " ".join(_texts(3, 400)))]  # a long text
    docs = _clashing(spark.createDataFrame(rows, "lang string, text string"))
    got = sorted(tuple(r) for r in collocations(docs, 6, 25, dictionary).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_collocations(rows, 6, 25) and len(got) > 40
    assert collocations(docs.limit(0), 6, 25, dictionary).count() == 0


def test_scores_beyond_64_bits(spark):
    from tarnwork.llm.collocations import _millionths

    a, x, y = 3_000_000_001, 90_000_000_007, 3_000_000_019
    got = spark.createDataFrame([(a, x, y)], "a long, l long, r long").select(_millionths("a", "l", "r")).first()[0]
    assert got == 1000000 * a * a // (x * y)


def test_ranges_cut_hot_words():
    import pyarrow as pa

    from tarnwork.llm.collocations import Numbers, pack, run_lengths

    d = Numbers(pa.table({"lang": ["a"] * 4 + ["b"], "word": ["p", "q", "r", "s", "p"], "n": [1000, 30, 20, 10, 15]}))
    splits = d.splits(100)
    assert ((splits >> np.uint64(32)) == 1).sum() == 3  # the hot word by its second word
    r = np.random.default_rng(4)
    x = r.integers(0, 70000, (3, 5000)).astype(np.uint32)
    x[:, 1::2] = x[:, ::2]
    keys, n = run_lengths(pack(*x), np.ones(5000, np.int64))
    want = collections.Counter(zip(*x.tolist(), strict=True))
    ids = [(keys[i].astype(int) << 16) + keys[i + 1] for i in (0, 2, 4)]
    assert list(zip(zip(*(i.tolist() for i in ids), strict=True), n.tolist(), strict=True)) == sorted(want.items())


# --- repeated passages


def brute_passages(rows, width):
    words = [(-math.inf if i is None else i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, math.inf), i)
    out = []
    for (i, _), (j, w) in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < j:
                gone.update(range(k, k + width))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def _passage_rows():
    r = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in r.integers(0, 3000, n)]
    shared = [word(n) for n in (5, 13, 14, 40, 90, 200)]
    rows = []
    for i in range(60):
        parts = [word(int(r.integers(0, 40)))]
        for _ in range(int(r.integers(0, 4))):
            s = shared[int(r.integers(0, len(shared)))]
            a = int(r.integers(0, max(1, len(s) // 2)))
            parts += [s[a : a + int(r.integers(1, len(s) + 1))], word(int(r.integers(0, 20)))]
        rows.append((int(r.integers(0, 50)), " ".join(x for p in parts for x in p)))
    loop = " ".join(["a", "b", "c"] * 30)
    rows += [(None, rows[3][1]), (None, None), (200, ""), (201, " \n\t "), (202, loop), (203, loop + " d"), (204, "b " + loop), (205, "x " * 50), (206, "X " * 50), (1, "x " * 20)]
    rows += [(300, rows[5][1]), (300, rows[5][1]), (301, " ".join(word(20000) + shared[3])), (302, "é" * 3 + " " + " ".join(shared[4])), (303, shared[1][0] + "\x0b" + "\r\n".join(shared[1][1:]))]
    return rows


@pytest.mark.parametrize(("width", "block", "words"), [(13, 8 << 20, 500_000), (13, 300, 60), (4, 2000, 500_000)])
def test_repeated_passages(spark, monkeypatch, width, block, words):
    from tarnwork.llm import passages

    rows = _passage_rows()
    monkeypatch.setattr(passages, "SHARD_WORDS", words)
    docs = _clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in passages.remove_repeated_passages(docs, width, block).collect())
    want = brute_passages(rows, width)
    assert got == want and sum(r[2] > 0 for r in want) > 20
    assert passages.remove_repeated_passages(docs.limit(0), width, block).count() == 0


def test_long_passages_are_cut(spark, monkeypatch):
    from tarnwork.llm import passages

    rows = [(i, " ".join(f"w{x}" for x in range(300 * (i % 2), 700))) for i in range(4)] + [(9, "w10 " + " ".join(f"w{x}" for x in range(400, 440)) + " w9")]
    pieces = passages._cut_passages
    monkeypatch.setattr(passages, "_cut_passages", lambda width: _with(passages, pieces(width), 50))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in passages.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect())
    assert got == brute_passages(rows, 13)


def _with(module, f, words):
    def run(key, table, owned):
        import tarnwork.llm.passages as m

        m.PASSAGE_WORDS = words
        return f(key, table, owned)

    return run


# --- vector codes


def brute_codes(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    cuts = [(i * d // 4, (i + 1) * d // 4) for i in range(4)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in cuts]
    near = lambda v, book: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = collections.defaultdict(list)
            for r in kept:
                groups[near(r[1][a:b], books[p])[1]].append(r[1][a:b])
            for e, g in groups.items():
                books[p][e] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out = []
    for i, v, y in kept:
        n = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append((i, "".join(f"{e:02x}" for _, e in n), sum(x for x, _ in n), y))
    sums = collections.Counter()
    for r in out:
        sums[r[3]] += r[2]
    return sorted(map(str, [(i, c, e, sums[y]) for i, c, e, y in out])), books


@pytest.mark.parametrize(("dimension", "entries", "count"), [(8, 5, 300), (10, 7, 120), (8, 256, 40), (4, 3, 60)])
def test_vector_codes(spark, dimension, entries, count):
    from tarnwork.llm.vector_codes import encode_vectors, with_label_errors

    r = np.random.default_rng(dimension)
    values = np.round(r.normal(0, 1, (count, dimension)) * 4) / 4 if dimension != 10 else r.normal(0, 30, (count, dimension))
    rows = [(i * 3 % count if i % 9 else None, [float(np.float32(x)) for x in v], [None, 1, 2][i % 3]) for i, v in enumerate(values)]
    rows += [(7, rows[1][1], 1), (8, None, 1), (9, [None] * dimension, 1), (10, [float("nan")] * dimension, 2), (11, [float("inf")] + [0.0] * (dimension - 1), 2), (10**6, [1.0], 2)]
    vectors = _clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    coded = encode_vectors(vectors.repartition(3), entries)
    got = sorted(str((x.vec_id, x.code, x.error, x.label_error)) for x in with_label_errors(coded.rows).collect())
    want, books = brute_codes(rows, entries)
    assert got == want and [c.tolist() for c in coded.books] == books
    text = ",".join(str(x) for c in books for e in c for x in e)
    assert coded.sha256() == hashlib.sha256(text.encode()).hexdigest()
    empty = encode_vectors(vectors.limit(0))
    assert with_label_errors(empty.rows).count() == 0 and empty.sha256() == hashlib.sha256(b"").hexdigest()


def test_bounds_prune_and_stay_true():
    from tarnwork.llm.vector_codes import Bounds, half_distances, movements, squared

    r = np.random.default_rng(5)
    centre = r.integers(-5000, 5000, (20, 6))
    x = centre[r.integers(0, 20, 2000)] + r.integers(-300, 300, (2000, 6))
    c = x[:40].copy()
    b, measured = Bounds.measured(x, c), []
    for _ in range(6):
        new = np.array([x[b.code == e].sum(0) // max(1, (b.code == e).sum()) if (b.code == e).any() else c[e] for e in range(40)])
        b.follow(movements(c, new))
        measured.append(b.assign(x, new, half_distances(new)))
        c, d = new, squared(x, new)
        assert (b.code == d.argmin(1)).all()
        assert (b.upper >= np.sqrt(d[np.arange(2000), b.code])).all() and (b.lower.astype(float) <= np.sqrt(d)).all()
    assert measured[-1] < 0.1 * 2000 * 40


def test_far_components_are_refused(spark):
    from tarnwork.llm.vector_codes import encode_vectors

    with pytest.raises(ValueError, match="not coded"):
        encode_vectors(spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int"))


@pytest.mark.parametrize("name", ["op11_collocations", "op12_substring_dedup", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    from tarnwork.llm.queries import ORACLE_SQL, QUERIES

    assert same(QUERIES[name](spark, SF), ORACLE_SQL[name]) > 0


def test_context_words_of_any_length(spark):
    """Words of context are whole: a word of 100 letters counts as it is, and blanks between words do not push one out of sight."""
    from pyspark.sql import functions as F

    from tarnwork.llm.pii import CANDIDATE, _checked, _occurrences, _placed, matches

    stem, gap = "k" * 100, " " * 90
    text = f"left{stem}a{gap}right{stem}b{gap}ref4711882{gap}behind{stem}c tail"
    rows = spark.createDataFrame([(1, text), (2, "w" * 300_000 + " " * 300_000 + "ref4711882")], "rid long, text string")
    seen = _occurrences(_checked(_placed(rows.select("rid", matches(F.col("text"), CANDIDATE).alias("matches")))))
    got = {r.rid: set(r.patterns) for r in seen.collect()}
    assert {f"l right{stem}b", f"ll left{stem}a right{stem}b", f"r behind{stem}c"} <= got[1]
    assert "l " + "w" * 300_000 in got[2]
