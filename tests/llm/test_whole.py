"""Cases in which an operator once did less than its whole job."""


def _words(n, name="w"):
    return [f"{name}{i}" for i in range(n)]


def _changed(words, places, name):
    return [f"{name}{i}" if i in places else w for i, w in enumerate(words)]


def test_near_copy_of_one_variant_of_a_hot_group(spark):
    from tarnwork.llm.near_dedup import near_duplicates

    base = _words(404)  # 400 shingles; a changed word changes five
    docs = [(50, " ".join(base)), (60, " ".join(_changed(base, range(100, 180, 10), "b")))]  # 0.818 to each other
    docs += [(i, " ".join(_changed(base, (200 + 10 * i, 205 + 10 * i), f"v{i}x"))) for i in range(1, 20)]  # 0.951 to 50, 0.778 to 60
    out = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in out} == {1} and len(out) == len(docs)


def test_links_of_blocks_equal_links_of_all_pairs(spark):
    from tarnwork.llm import near_dedup as nd

    bags = [(g, i) for g in range(6) for i in range(9)]
    blobs = {10 * g + i: nd.np.sort(nd.np.array([g * 1000 + x for x in range(40)] + [9000 + 10 * g + i], nd.np.uint64)).tobytes() for g, i in bags}
    rows = [(7, k, k // 10 * 10 if k < 30 else k) for k in blobs]
    before, nd.BLOCK = nd.BLOCK, 4
    try:
        found = nd._rest_links(spark.createDataFrame(rows, "bucket long, id long, linked long"), spark.createDataFrame(list(blobs.items()), "id long, cells binary"), 0.8).collect()
    finally:
        nd.BLOCK = before
    root = {k: v for _, k, v in rows}
    for a, b in ((r.a, r.b) for r in found):
        assert a // 10 == b // 10
        root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    assert len(set(root.values())) == 6


def test_insults_of_a_small_language_in_many_forms(spark):
    import random

    from tarnwork.llm.toxicity import THRESHOLD, score, train

    r = random.Random(3)
    plain = lambda n, x: [f"{x}{r.choice('abcdefgh')}{r.choice('klmnop')}{r.choice('abcdefgh')}{r.choice('klmnop')}" for _ in range(n)]
    forms = ["bomente" + x for x in "ca co da do ga go ja jo la lo ma mo".split()]  # five times each
    mix = lambda words, x: " ".join(w for a in words for w in (*plain(3, x), a, *plain(2, x)))
    bulk = [(mix(["zwurb"] * 3, "e"), 1) for _ in range(300)] + [(" ".join(plain(20, "e")), 0) for _ in range(300)] + [(" ".join(plain(20, "s")), 0) for _ in range(60)]
    small = [(mix(forms[6 * (i % 2) : 6 * (i % 2) + 6], "s"), 1) for i in range(10)]
    rows = [(i, t, y) for i, (t, y) in enumerate(bulk + small)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert all(model.matcher.weight(x) for x in (*forms, "zwurb", "bomentexyz")) and not model.matcher.weight("plain")
    got = {x.doc_id: x.score for x in score(docs, model).collect()}
    assert all((got[i] >= THRESHOLD) == bool(y) for i, _, y in rows)


def test_repeated_rows_of_a_query_among_equal_vectors(spark):
    from tarnwork.llm.topk import search_twentieth

    rows = [(i, [1.0, 2.0]) for i in (*range(1, 31), 20, 20)] + [(i, [1.0, 2.0]) for i in [0] * 4]
    out = search_twentieth(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20)}
    every = sorted(i for i, _ in rows)
    assert got == {q: [i for i in every if i != q][:20] for q in (0, 20)}


def test_corpus_without_languages_keeps_its_texts(spark):
    from tarnwork.llm.language_id import reject_unknown, train

    docs = spark.createDataFrame([(1, "plain words", None), (2, None, None), (3, "12 34 !", None), (4, "é", None), (5, "", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in reject_unknown(docs, train(docs)).collect()) == [1, 4]
