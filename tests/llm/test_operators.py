"""Operators on small tables against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}q" for i in range(400)]


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


LONG = text(1, 120)
LINE = "This line is repeated in many documents."
ROWS = [
    (0, LONG), (1, LONG), (2, LONG.replace("w1q", "zz", 1)), (3, None), (4, ""), (5, "  \n "), (6, "Hi there"), (7, "hi  THERE"),
    (8, f"{LINE}\nown line of eight here\n  {LINE.upper()}\t"), (9, f"x\n{LINE}"), (10, f"{LINE}\n\nend"), (11, text(2, 3000)), (12, text(3, 60) + " " + text(9, 30)),
    (12, text(3, 60) + " " + text(9, 30)), (None, "no id at all but some words here"), (13, "mail a.b@c.example and 4111 1111 1111 1111, 10.0.0.1, +1 (234) 555-0199"), (14, "café naïve über 12345"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_tokens"), F.lit(2).alias("key"), F.lit(3).alias("start"), F.lit(4).alias("pos"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def ids_of(name, t):
    import public_tokenizers
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(public_tokenizers.path(name))
    return [*k.encode(t or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, empty):
    import public_tokenizers

    from tarnwork.llm.token_files import encode_documents, ids_crc32

    path = public_tokenizers.path("word_bpe_49k.json")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ids_crc32(encode_documents(docs, path)).orderBy("start").collect()]
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0])):
        ids = ids_of("word_bpe_49k.json", t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert encode_documents(empty, path).count() == 0


def test_packing(spark, docs, empty):
    import public_tokenizers

    from tarnwork.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack_documents(docs.repartition(5), path, window=256, open_windows=3).collect()
    seen, fill = collections.defaultdict(set), collections.defaultdict(list)
    texts = collections.defaultdict(list)
    for i, t in ROWS:
        texts[i].append(ids_of("byte_bpe_50k.json", t))
    total = 0
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == texts[r.doc_id][0][r.start : r.start + r.length] and r.doc_tokens == len(texts[r.doc_id][0])
        seen[r.doc_id].add((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(x) for t in texts.values() for x in t)
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in p) < 256 - 16 for p in fill.values()) <= 1
    assert pack_documents(empty, path).count() == 0


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(spark, docs, empty, batches):
    from tarnwork.llm.line_dedup import drop_repeated_lines

    rank = lambda i: -1 if i is None else i
    held = collections.defaultdict(set)
    for i, t in ROWS:
        for line in (t or "").split("\n"):
            held[key(line)].add(rank(i))
    want = []
    for i, t in ROWS:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != rank(i))]
        want.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_repeated_lines(docs, batches=batches).collect()]
    order = lambda r: (rank(r[0]), r[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(r[2] for r in got)
    assert drop_repeated_lines(empty).count() == 0


def test_line_runs_are_merged_as_they_lie(spark):
    """Runs are read without an exchange or a sort; keys of one batch that a run holds are its delta only."""
    from tarnwork.llm.line_dedup import LineRuns, sorted_buckets

    r = np.random.default_rng(6)
    rows = [(int(h), int(h) * 7, int(d)) for h, d in zip(r.integers(0, 300, 4000), r.integers(0, 500, 4000), strict=True)]
    df = spark.createDataFrame(rows, "h1 long, h2 long, did long")
    runs = LineRuns(spark, 4)
    try:
        with sorted_buckets(spark):
            for b in range(5):
                runs.add(df.where(F.col("did") % 5 == b))
            assert runs.deltas != [[]] and runs.names
            some = [n for level in runs.runs for n in level] + runs.names[:1]
            for plan in (runs.without(some[0], some[1:]), runs.merged(some[0], some[-1])):
                text = plan._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin" in text and "Exchange" not in text and "Sort [" not in text
            got = {x.h1: (x.n, x.last) for x in runs.compact().collect()}
    finally:
        runs.close()
    held = collections.defaultdict(set)
    for h, _, d in rows:
        held[h].add(d)
    assert got == {h: (len(d), max(d)) for h, d in held.items()}


def test_line_dedup_of_long_texts_and_clashing_columns(spark):
    import time

    from tarnwork.llm.line_dedup import drop_repeated_lines

    lines = [f"a line that three documents hold {i % 100_000}" for i in range(200_000)]
    df = spark.createDataFrame([(i, "\n".join(lines), 7, 8) for i in range(3)], "doc_id long, text string, n_lines int, flags int")
    a = time.time()
    out = {r.doc_id: r for r in drop_repeated_lines(df).collect()}
    assert time.time() - a < 20
    assert [(out[i].n_lines, out[i].n_dropped, out[i].flags) for i in range(3)] == [(200_000, 200_000, 8)] * 2 + [(200_000, 0, 8)]
    assert out[0].text == "" and out[2].text == "\n".join(lines)


def shingles(t):
    w = (t or "").encode().lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_near_duplicates(spark, docs, empty):
    from tarnwork.llm.near_dedup import keep_one_of_each, near_duplicates

    group = {i: i for i, _ in ROWS if i is not None}
    for i, t in ROWS:
        for j, u in ROWS:
            a, b = shingles(t), shingles(u)
            if None not in (i, j) and a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                low = min(group[i], group[j])
                for k, g in list(group.items()):
                    if g in (group[i], group[j]):
                        group[k] = low
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.class_id) for r in rows} == {(i, group.get(i)) for i, _ in ROWS}
    kept = [r.doc_id for r in keep_one_of_each(docs).collect()]
    assert collections.Counter(kept) == collections.Counter(i for i, _ in ROWS if i is None or group[i] == i)
    assert near_duplicates(empty).count() == 0


def test_documents_of_several_texts_link_them(spark):
    """Every class keeps exactly its smallest document, whatever texts its documents have."""
    from tarnwork.llm.near_dedup import keep_one_of_each, near_duplicates

    r = np.random.default_rng(8)
    texts = [text(500 + i, 90) for i in range(12)]
    rows = [(3, texts[1]), (5, texts[0]), (5, texts[1]), (9, texts[0] + " extra"), (9, ""), (40, ""), (41, None)]
    rows += [(int(i), texts[int(x)] + (" more" if y else "")) for i, x, y in zip(r.integers(50, 60, 25), r.integers(2, 12, 25), r.integers(0, 2, 25), strict=True)]
    group = {i: i for i, _ in rows}
    for i, t in rows:
        for j, u in rows:
            a, b = shingles(t), shingles(u)
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                low, both = min(group[i], group[j]), (group[i], group[j])
                group = {k: low if g in both else g for k, g in group.items()}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = near_duplicates(docs).collect()
    assert collections.Counter((x.doc_id, x.class_id) for x in got) == collections.Counter((i, group[i]) for i, _ in rows)
    kept = collections.Counter((x.doc_id, x.text) for x in keep_one_of_each(docs).collect())
    assert kept == collections.Counter((i, t) for i, t in rows if group[i] == i)
    assert {group[i] for i, _ in kept} == set(group.values())


def test_near_duplicate_groups_beyond_one_leader(spark):
    """A chain of edits and a crowd that shares a passage: classes equal brute force."""
    from tarnwork.llm.near_dedup import near_duplicates

    base, rows = text(20, 300).split(), []
    for i in range(30):
        base = list(base)
        base[i * 7] = f"edit{i}"
        rows.append((100 + i, " ".join(base)))
    passage = text(21, 60)
    rows += [(200 + i, f"{text(1000 + i, 20)} {passage}") for i in range(60)]
    group = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                low, both = min(group[i], group[j]), (group[i], group[j])
                group = {k: low if g in both else g for k, g in group.items()}
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == group


def test_decontamination(spark, docs, empty):
    from tarnwork.llm.decontaminate import contaminated, decontaminate

    items = [(1, LONG), (2, " ".join(ROWS[11][1].split()[500:530])), (3, "hi there"), (4, None), (5, ""), (6, text(77, 30)), (2, text(78, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in ROWS:
        for j, u in items:
            q = set(shingles(u))
            n = min(5, len((u or "").split()))
            w = (t or "").encode().lower().split()
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if q and len(q & own) >= 0.8 * len(q):
                want.add((i, j))
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want
    assert {(0, 1), (2, 1), (11, 2), (6, 3), (7, 3)} <= want
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in decontaminate(docs, bench).collect()) == sorted(str(i) for i, _ in ROWS if i not in bad)
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_language_id(spark, docs, empty):
    from tarnwork.llm.language_id import predict_held_out, reject_unknown, train

    rows = predict_held_out(docs).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows} <= {"en", "und"}
    blank = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {3, 4, 5} == blank
    assert reject_unknown(docs, train(docs)).count() == len(ROWS) - 3
    assert predict_held_out(empty).count() == 0 and {r.lang_pred for r in predict_held_out(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    from tarnwork.llm.toxicity import score_held_out

    letters = lambda s, n: re.sub(r"\d", lambda m: "abcdefghij"[int(m.group())], text(s, n))
    rows = [(1000 + i, f"{letters(i, 20)} {'you grobwort' if i % 2 else 'fine'} {letters(i + 500, 9)}") for i in range(200)]
    t = spark.createDataFrame(rows + ROWS, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i, _ in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = score_held_out(t, labels).collect()
    assert len(got) == len(rows) + len(ROWS)
    assert [] == [(r.doc_id, r.score) for r in got if (r.doc_id or 0) >= 1000 and r.predicted != r.doc_id % 2]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert score_held_out(empty, labels).count() == 0
    assert score_held_out(docs, labels.limit(0)).count() == len(ROWS)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, (_, rx) in enumerate(BASE):
        for m in re.finditer(rx, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_private_spans(spark, docs, empty):
    from tarnwork.llm.pii import find_private

    r = np.random.default_rng(4)
    odd = ["".join(r.choice(list("a1 .@+-()é_%9") + ["4111111111111111", "10.2.3.4", "x@y.z_q@r.s", "+12 345-678901"], 25)) for _ in range(300)]
    rows = ROWS + [(1000 + i, t) for i, t in enumerate(odd)]
    got = find_private(spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit(1))).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(list)
    for i, t in rows:
        b = base_spans(t)
        s = ",".join(f"{BASE[k][0]}:{a}:{e}" for a, k, e in b)
        want[i].append((hashlib.sha256(s.encode()).hexdigest(), *(sum(k == n for _, k, _ in b) for n in range(4))))
    for x in got:
        assert (x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) in want[x.doc_id]
    assert find_private(empty).count() == 0


def test_private_patterns_find_unseen_identifiers(spark):
    from tarnwork.llm.pii import find_private

    rows = [(i, f"please write to number +1 (555) 0{i:02d}-4321 soon") for i in range(10, 30)] + [(50, "please write to number 0555-778-1234 soon"), (51, "we sold 4412-9981 units")]
    got = {r.doc_id: r.spans for r in find_private(spark.createDataFrame([(i, t.replace("number +", "number: +").replace("number 0", "number: 0")) for i, t in rows], SCHEMA)).collect()}
    assert got[50] == "phone:24:37" and got[51] == "" and got[10].startswith("phone:24:")


def test_found_identifiers_induce_patterns(spark):
    """Seeds trust the words before them, what these find trusts the word behind, which finds the rest."""
    from tarnwork.llm.pii import find_private

    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(100 + i, f"{names[i % 10]} dial: +1 (555) 0{i + 10}-4321 {names[-1 - i % 10]}") for i in range(20)]
    rows += [(20 + i, f"{names[i]} dial: 0{i}55-778-12{i}4 thanks {names[i]}") for i in range(6)]  # found by the words before
    rows += [(40, "completely other 0999/123456 thanks again"), (41, "completely other 0999/123457 units again")]  # by the word behind
    rows += [(50 + i, f"{names[i]} token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" {names[i]}") for i in range(9)]
    rows += [(60, f"a bare {hashlib.sha1(b'x').hexdigest()} here"), (61, "4111 1111 1111 1112 is no card"), (62, "+1 (555) 019-4321, 10.0.0.1")]
    got = {r.doc_id: (r.spans, r.n_spans, r.n_phone) for r in find_private(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[20 + i][1:] for i in range(6)] == [(1, 0)] * 6 and got[20][0] == "phone:12:25"
    assert got[40] == ("phone:17:28", 1, 0) and got[41][1] == 0
    assert got[50][0] == "secret:15:55" and got[60][0] == "secret:7:47" and got[61][1] == 0
    assert got[62][0] == "phone:0:17,ip:19:27"


def test_long_text_with_numbers(spark):
    import time

    from tarnwork.llm.pii import find_private

    long = " ".join(f"w{i} {i}.1.2.3 x" for i in range(70_000))
    a = time.time()
    r = find_private(spark.createDataFrame([(1, long), (2, "9" * 200_000), (3, "a" * 300_000 + "@")], SCHEMA)).collect()
    assert time.time() - a < 40
    assert {x.doc_id: x.n_ip for x in r} == {1: 256, 2: 0, 3: 0}


def test_lm_scoring(spark, docs, empty):
    from tarnwork.llm.lm_scoring import score_held_out

    rows = score_held_out(docs).collect()
    count = collections.Counter()
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in ROWS:
        if held(i) is False:
            count.update(tok(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(tok(t)), sum(count[w] > 0 for w in tok(t)), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 6)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 and r.held_out == held(r.doc_id) for r in rows)
    assert score_held_out(empty).count() == 0


def test_lm_scores_do_not_depend_on_how_files_are_split(spark, monkeypatch):
    """Blocks of several runs of rows, several chunks of blocks: the same scores."""
    from tarnwork.llm import lm_scoring as lm

    rows = [(i, text(300 + i, 60)) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
    plain = {r.doc_id: r.score for r in lm.score_held_out(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "SUB_BYTES", 100)
    monkeypatch.setattr(lm, "MOST_SUBS", 256)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        split = {r.doc_id: r.score for r in lm.score_held_out(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plain.keys() == split.keys() and all(abs(plain[i] - split[i]) < 1e-3 for i in plain)


def test_topk(spark):
    from tarnwork.llm.topk import search_twentieth

    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.normal(size=6)], 1) for i in range(120)] + [(200 + i, [0.5] * 6, 1) for i in range(60)]
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (304, [], 1), (305, [1.0, 2.0], 1), (320, [0.5, 0.25], 1), (None, [0.1] * 6, 1)]
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in search_twentieth(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect()]
    good = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in good.items():
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))[:20]
            want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert sorted(got) == sorted(want)
    assert search_twentieth(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_leaves_out_blocks_of_other_clusters(spark):
    """On clustered data few pairs of bucket and block are searched, few pairs of vectors below them, and results are exact."""
    from tarnwork.llm import topk

    r = np.random.default_rng(12)
    centres = r.normal(size=(8, 6)) * 4
    rows = [(i, [float(math.floor(64 * x)) for x in centres[i % 8] + r.normal(size=6) * 0.05]) for i in range(1600)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    blocks, buckets, pairs = topk.dealt(v, v.where("vec_id % 20 = 0"), 5, 32, 40)
    every = blocks.select("part").distinct().count() * buckets.select("part").distinct().count()
    assert 0 < pairs.count() < 0.7 * every
    x = np.array([w for _, w in rows])
    s = topk.Search(x[::20], np.arange(0, 1600, 20), np.full(80, -np.inf), x, np.arange(1600), 5)
    assert s.pairs < 0.7 * 80 * 1600
    got = [(a.query_id, a.rank, a.vec_id, a.score) for a in topk.search(v, v.where("vec_id % 20 = 0"), 5, 32, 40).collect()]
    want = []
    for q in range(0, 1600, 20):
        best = sorted((-int(n), i) for i, n in enumerate(x @ x[q]) if i != q)[:5]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(best)]
    assert sorted(got) == want
