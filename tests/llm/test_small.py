"""Pieces without Spark: encoders, packing, search trees, signatures, automata, grammar, trees of contexts."""

import collections
import functools
import math
import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tarnwork.llm import language_id, lm_scoring, near_dedup, packing, shingles, topk, toxicity  # noqa: E402
from tarnwork.llm.decontaminate import ItemIndex, sketch_size  # noqa: E402
from tarnwork.llm.tokens import encoder  # noqa: E402

PARTS = [*"aZé ß'\n\t\r\x1c\x85１9.!-|<>ﬁ日本ǅİ\u0301\xa0", "'ll", "<|endoftext|>", "the ", " of", "  "]
ODD = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)


@functools.lru_cache
def plain_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=200, deadline=None)
@given(text=ODD | st.text(max_size=40))
def test_pieces_equal_whole_texts(name, text):
    import public_tokenizers

    e, t = encoder(public_tokenizers.path(name)), plain_tokenizer(name)
    texts = [text.encode("utf-8", "replace").decode(), "the plain words of a text", None, text[:9].encode("utf-8", "replace").decode()]
    got = []
    for _, ids, at in e.encode(pa.array(texts, pa.string())):
        got += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_added_tokens_are_as_the_plain_tokenizer_has_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "hi <|endoftext|> there"
    ids = next(encoder(path).encode(pa.array([text])))[1].tolist()
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids == [5303, 220, 50256, 612]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 5), st.integers(0, 6))
def test_packing_keeps_every_id(sizes, most, gap):
    done, left = [], []
    p = packing.Packer(lambda pieces, is_open: (left if is_open else done).append(pieces), 32, most, gap)
    for i, n in enumerate(sizes):
        p.add(packing.Piece(i, 0, np.arange(n, dtype="<u4").tobytes(), n))
        assert len(p.open) <= most
    p.close()
    assert len(left) <= most
    last = []
    packing.merge_leftovers(left, lambda pieces, is_open: (last if is_open else done).append(pieces), 32)
    assert len(last) <= 1
    assert all(32 - gap <= sum(map(len, w)) <= 32 for w in done)
    got = collections.defaultdict(list)
    for w in done + last:
        assert w and all(len(x) for x in w)
        for x in w:
            got[x.doc_id] += [(x.start + i, v) for i, v in enumerate(np.frombuffer(x.ids, "<u4").tolist())]
    for i, n in enumerate(sizes):
        assert sorted(got[i]) == [(k, k) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_dual_tree_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    x = np.floor(r.normal(size=(700, 8)) * (3 if seed % 2 else 40)).astype(float)
    x[100:160] = x[99]
    ids = r.permutation(5000)[:700]
    q = x[:90]
    s = topk.Search(q, ids[:90], np.full(90, -np.inf), x, ids, 20)
    for i in range(90):
        score = x @ q[i]
        want = sorted(((-score[j], ids[j]) for j in range(700) if ids[j] != ids[i]))[:20]
        assert [(-a, b) for a, b in zip(s.score[i], s.ids[i], strict=True)] == want
    tree = topk.CoverTree(x)
    for n, pts in enumerate(s.qt.points):
        if pts is not None:
            assert np.sqrt(((q[pts] - q[s.qt.center[n]]) ** 2).sum(axis=1)).max() <= s.qt.radius[n] + 1e-9
    assert sorted(np.concatenate([p for p in tree.points if p is not None]).tolist()) == list(range(700))


def _shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab A\n\té日")), max_size=40) | st.none(), max_size=8))
def test_shingles_count_like_python(texts):
    data, offsets = shingles.buffers(pa.array(texts, pa.string()))
    s, row = shingles.shingles(*shingles.words(data, offsets))
    for i, want in enumerate(_shingle_sets(texts)):
        assert sorted(collections.Counter(s[row == i].tolist()).values()) == sorted(want.values())


def test_equal_shingles_hash_alike_across_rows():
    data, offsets = shingles.buffers(pa.array(["x one two three four five", "ONE two  three\nfour five six", "one two"]))
    s, row = shingles.shingles(*shingles.words(data, offsets))
    assert set(s[row == 0]) & set(s[row == 1]) and not set(s[row == 2]) & set(s[row == 1])


def test_dart_minhash_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    base = shingles.mix(r.integers(0, 2**63, 400).astype(np.uint64))
    a, b = np.concatenate([base[:300], base[:50]]), base[30:360]
    cell, row = near_dedup.cells(np.concatenate([a, b, base[:1]]), np.concatenate([np.zeros(len(a), int), np.ones(len(b), int), [2]]))
    sig = near_dedup.dart_minhash(cell, row, 4, 512)
    x, y = collections.Counter(a.tolist()), collections.Counter(b.tolist())
    want = sum((x & y).values()) / sum((x | y).values())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.07
    assert not sig[3].any() and sig[2].all()


def test_links_connect_what_is_similar():
    r = np.random.default_rng(3)
    common = r.integers(0, 2**32, 60)
    blobs, sets = [], []
    for i in range(40):
        own = r.integers(0, 2**32, 140)
        sets.append(np.unique(np.concatenate([common, own]).astype(np.uint64)))
        if i % 4 == 3:
            sets[-1] = np.unique(np.concatenate([sets[-2][:-8], own[:8].astype(np.uint64)]))
    blobs = [np.sort(s).tobytes() for s in sets]
    got = near_dedup.links_among(list(range(40)), blobs, [0] * 40, False, 0.8)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if near_dedup.similar(blobs[i], blobs[j], 0.8)}
    assert want and set(got) == want


def test_items_are_found_inside_long_documents():
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 12, 40, 900])]
    docs = [" ".join(word() for _ in range(3000)) + " " + t.upper() + " " + word() for _, t in items] + ["", None, items[3][1][:20]]
    index = ItemIndex(items, 5, 0.8)
    assert {(a, b) for a, b, _, _ in index.matches(pa.array(docs, pa.string()))} == {(i, i) for i in range(5)}
    assert sketch_size(0.8) == 13
    assert list(ItemIndex([], 5, 0.8).matches(pa.array(docs, pa.string()))) == []


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.text("abcd", max_size=40))
def test_suffix_automaton_holds_all_substrings(sample, text):
    t = language_id.Automata([[1, 2], [ord(c) - 96 for c in sample]], 8)
    state = t.roots[1:]
    for n, c in enumerate(text):
        state = t.step(state, np.array([ord(c) - 96]))
        assert bool(state[0]) == (text[: n + 1] in sample)
        if not state[0]:
            break


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abĀж 漢1", min_size=1, max_size=30), min_size=1, max_size=3), st.lists(st.text("abĀж 漢\U00010400z,", max_size=40), max_size=5))
def test_rates_equal_phrases_counted_by_hand(sample, texts):
    """Cross-parsing by substring search, on the bytes of lower-cased letters."""
    import re

    plain = lambda t: re.sub(r"[\W\d_]+", " ", t).lower().encode()
    p = language_id.Parser({"xx": sample})
    if not p.langs:
        return
    own = plain("\n".join(sample))
    data, offsets = shingles.buffers(pa.array(texts, pa.string()))
    rates, has = p.rates(data, offsets)
    for i, t in enumerate(texts):
        b, phrases, begin = plain(t), 0, 0
        for n in range(len(b)):
            if b[begin : n + 1] not in own:
                phrases += 1
                begin = n if b[n : n + 1] in own else n + 1
        assert has[i] == any(c.isalpha() for c in t)
        assert abs(rates[i, 0] * max(1, len(b)) - phrases * math.log2(len(own) + 1)) < 1e-6


def test_language_is_the_cheapest_parse():
    p = language_id.Parser({"xx": ["abab abba baab " * 20], "yy": ["cdcd dccd ddcc " * 20]})
    data, offsets = shingles.buffers(pa.array(["abba abab", "DCCD ddcc", "12 !", None, "", "é" * 3, "abab " * 2000]))
    langs, score = p.predict(data, offsets)
    assert langs[:5] == ["xx", "yy", "und", "und", "und"] and langs[6] == "xx"
    assert ((0 <= score) & (score <= 1)).all() and score[2] == 0


def test_grammar():
    m = toxicity.Matcher(dict.fromkeys(toxicity.INSULTS, 4.0), {"schimpf": 3.0})
    f = lambda t: {o for o, c in zip(toxicity.OUTPUTS, m.features(t), strict=True) if c}
    assert f("you are an idiot") == {"insult>target"} and f("he is not an idiot") == {"insult~not"}
    assert f('He said "you idiot"') == {"insult~said"} and f("the idiot of it") == {"insult"}
    assert f("I will kill you") == {"threat>target"} and f("kill the process") == {"threat"}
    assert f("idiotic. you") == set() and f(None) == f("") == set() and f("das schimpfwortes da") == {"insult"}
    many = m.features("you idiot, idiot. " * 50)
    assert many[1] == round(math.log1p(4.0 * 100), 6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("IIITYNRQoo"), max_size=14))
def test_grammar_equals_its_rules(symbols):
    """The composed transducers against the rules said in loops."""
    reach, quoted, said, want = toxicity.WINDOW, False, False, []
    after_negation = 0
    marks = []
    for c in symbols:
        mark = ""
        if c in "IT":
            mark = "~not" if after_negation else "~said" if quoted or said else ""
        if c == "R" and not quoted:
            said = True
        elif c == "Q":
            quoted, said = not quoted, False
        marks.append(mark)
        after_negation = reach if c == "N" else max(0, after_negation - 1)
    for i, c in enumerate(symbols):
        if c in "IT":
            word = "insult" if c == "I" else "threat"
            near = "Y" in symbols[max(0, i - reach) : i] + symbols[i + 1 : i + 1 + reach]
            want.append(word + (marks[i] or (">target" if near else "")))
    assert [o for o in toxicity.grammar().best(list(symbols)) if o] == want


def _gram_keys(texts, depth):
    data, offsets = shingles.buffers(pa.array([t.decode() for t in texts]))
    return lm_scoring.grams(data, offsets, depth)[0]


def _weighted_by_hand(train, depth):
    """Context-tree weighting straight from its definition: a function of (context, decided bits) and bit."""
    counts = collections.Counter()
    for t in train:
        s = bytes([lm_scoring.START] * depth) + t.lower() + bytes([lm_scoring.END])
        for x in range(depth, len(s)):
            for i in range(8):
                for d in range(depth + 1):
                    counts[s[x - d : x], (1 << i) | (s[x] >> (8 - i)), (s[x] >> (7 - i)) & 1] += 1

    @functools.cache
    def kt(c, p):
        a, b = counts[c, p, 0], counts[c, p, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    seen = {(c, p) for c, p, _ in counts}

    @functools.cache
    def children(c, p):
        return sum(pw(bytes([x]) + c, p) for x in range(256) if (bytes([x]) + c, p) in seen)

    @functools.cache
    def pw(c, p):
        return kt(c, p) if len(c) == depth else math.log(0.5 * math.exp(kt(c, p)) + 0.5 * math.exp(children(c, p)))

    def one(context, p):
        out = None
        for d in range(depth, -1, -1):
            c = context[len(context) - d :]
            if (c, p) in seen:
                own = (counts[c, p, 1] + 0.5) / (counts[c, p, 0] + counts[c, p, 1] + 1)
                share = 1 / (1 + math.exp(children(c, p) - kt(c, p))) if d < depth else 1
                out = own if out is None else share * own + (1 - share) * out
        return 0.5 if out is None else out

    return one


def test_context_tree_is_the_weighting_by_its_definition():
    train, depth = [b"abcabcabcabc", b"abcabd", b"abcab"], 3
    key, n = lm_scoring.tally([(k, np.ones(len(k), np.int64)) for k in [_gram_keys(train, depth)]])
    tree = lm_scoring.Subtree(key, n, depth)
    rows = collections.defaultdict(lambda: [0.0, 0.0, 0.0])
    for node, a, b, pw in tree.tops:
        for k in range(len(node)):
            r = rows[int(node[k] >> 16), int(node[k] & 255)]
            r[0], r[1], r[2] = r[0] + a[k], r[1] + b[k], r[2] + pw[k]
    upper, one = lm_scoring.Upper([(*k, *v) for k, v in rows.items()]), _weighted_by_hand(train, depth)
    for context in (b"abc", b"zzc", b"qqq", b"bca", b"xab"):
        keys = np.arange(256) + (int.from_bytes(context[::-1], "big") << 8)
        p = 2 ** tree.log2_probability(keys, upper)
        assert abs(p.sum() - 1) < 1e-9
        for byte in (97, 98, 100, 0, 255):
            want = 1.0
            for i in range(8):
                q = one(context, (1 << i) | (byte >> (8 - i)))
                want *= q if (byte >> (7 - i)) & 1 else 1 - q
            assert abs(math.log(p[byte]) - math.log(want)) < 1e-6
        if context == b"abc":
            assert p.argmax() == ord("a") and p.max() > 0.5
    assert abs(lm_scoring.log_kt(np.array([2.0]), np.array([1.0]))[0] - math.log(0.5 * 0.75 * 0.5 / 3)) < 1e-9
    assert lm_scoring.Upper([(7, 1, 90_000.0, 8.0, -9.0)]).first.shape == (256, 256)
    big = np.array([70_000.0, 3.0])
    assert np.allclose(lm_scoring.log_kt(big, big[::-1]), [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.log(math.pi) - math.lgamma(x + y + 1) for x, y in zip(big, big[::-1], strict=True)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**62), unique=True, max_size=200))
def test_packed_rows(keys):
    k = np.sort(np.array(keys, np.int64))
    f = k.astype(np.float32)
    assert (lm_scoring.unpack(lm_scoring.pack(k), len(k)) == k).all() and (lm_scoring.unpack(lm_scoring.pack(f), len(k), np.float32) == f).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), unique=True, max_size=200))
def test_key_table(keys):
    k = np.array(keys, np.int64)
    t = lm_scoring.KeyTable(k)
    assert (t.find(k[::-1].copy()) == np.arange(len(k))[::-1]).all()
