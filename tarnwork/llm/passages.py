"""Removal of passages that repeat across documents, located by repeated-phrase automata.

A window is ``width`` consecutive words of one document.  Every word goes that is covered by a window
whose words also stand in a document of smaller doc_id.

Texts are dealt into *blocks* of bounded size, once, in a table bucketed by block; every later pass
reads it as it lies, a block at a time.

1. *Anchors*: the least hash of the five-word pieces of a window stands for the window.  About a fifth of
   the places are anchors.  Blocks send their distinct anchors, packed, to shards by hash; a shard answers
   each block with those that other rows hold as well.  Only windows of such anchors can recur.
2. *Confirming*: blocks send 96-bit hashes of these windows with their smallest document, number and
   next word; shards keep the recurring ones: owner (smallest document), holders (blocks), number, and
   whether the same word always follows.
3. *Passages*: the owner's block joins consecutive windows to one passage as long as the next one always
   follows and is as frequent: a passage recurs as a whole, so it is cut out of the owner's text once and
   sent to the blocks that hold it.
4. *Automata*: each block compiles the passages it holds into Aho-Corasick automata over word numbers, a
   shard of at most ``SHARD_WORDS`` words each, and streams its documents through them; every occurrence of a
   passage whose owner has a smaller id removes its words.  Matches are of whole words, not of hashes.

A hot passage is one row per block that holds it, however many documents do; no task holds more than a
block and its passages, or a shard of hashes, whose number grows with the input.

Cases: a text that is null, empty or blank has no words; texts shorter than a window lose nothing; null
doc_ids order before all ids; rows of equal doc_id (repeated rows too) are not each other's smaller
document and lose alike; a very long text is a block of its own; an empty table gives no rows; only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_or_min, materialize, shared_dir
from .shingles import EXACT, U, buffers, chunks, mix, spans, word_strings, words

WIDTH = 13
PIECE = 5
#: Bytes of text a block; a task needs some 25 times as much.
BLOCK_BYTES = 8 << 20
#: Bytes of text for which there is a shard of hashes, at least as many as shuffle partitions.
SHARD_BYTES = 64 << 20
#: Words of the passages in one automaton, and of a passage (longer ones are cut, with overlap).
SHARD_WORDS = 500_000
PASSAGE_WORDS = 4096
_K1, _K2 = U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)
_BRANCH = U(0xFFFFFFFFFFFFFFFF)
#: Symbols of a known word: DIGITS x BITS bits number more words than an automaton holds.
DIGITS, BITS = 4, 5


def _texts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, last row, bytes, offsets) of pieces of a block."""
    for batch in table.to_batches():
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            yield batch, a, b, data, offsets[a : b + 1]


def _rows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word and end of that row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return row, at[1:][row]


def _anchors(word: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (bit 0 clear) at every place where a window could start, whether one does, row of the place."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    piece = min(PIECE, width)
    with np.errstate(over="ignore"):
        s = np.zeros(len(word) - piece + 1, np.uint64)
        for j in range(piece):
            s = s * _K1 + word[j : j + len(s)]
        s = mix(s)
    least = s[:n].copy()
    for j in range(1, width - piece + 1):
        np.minimum(least, s[j : j + n], out=least)
    row, end = _rows_of(at)
    return least & ~U(1), np.arange(n) + width <= end[:n], row[:n]


def _hashes(word: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hash of the windows that start at the given places."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = word[at + j]
            one, two = one * _K1 + h, two * _K2 + h
        return mix(one), (mix(two) >> U(32)).astype(np.uint32)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """First places of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _found(value: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(value), bool)
    return ordered[np.minimum(np.searchsorted(ordered, value), len(ordered) - 1)] == value


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _joined(table: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and the row of each."""
    parts = [np.frombuffer(x, dtype) for x in table[name].to_pylist()]
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _by(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns cut by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = _heads(key) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(heads, np.append(heads, len(key))[1:], strict=True):
        yield int(key[a]), [c[order[a:b]] for c in columns]


def _deal(block_bytes: int):
    """Rows of a task in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            _, offsets = buffers(batch.column(2))
            for a, b in chunks(offsets, min(1 << 20, block_bytes)):
                more = int(offsets[b] - offsets[a])
                if size and size + more > block_bytes:
                    block, size = block + 1, 0
                size += more
                own = pa.array(np.full(b - a, block, np.int64))
                sizes = pa.array(np.diff(offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([own, sizes, *(batch.column(i).slice(a, b - a) for i in range(3))], ["block", "size", "doc_id", "did", "text"])

    return run


def _send_anchors(width: int, shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = []
        for _, _, _, data, offsets in _texts(table):
            anchor, whole, row = _anchors(*words(data, offsets, EXACT), width)
            anchor, row = anchor[whole], row[whole]
            if len(anchor):
                at = _heads(anchor, row)
                order = np.lexsort((row[at], anchor[at]))
                anchor, row = anchor[at][order], row[at][order]
                held.append(anchor[_heads(anchor, row)])
        value, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        value |= (n > 1).astype(np.uint64)
        sent = list(_by((value >> U(1)) % U(shards), value))
        return pa.table({"shard": pa.array([s for s, _ in sent], pa.int64()), "block": pa.array([key[0].as_py()] * len(sent), pa.int64()), "anchors": _blobs([x[0] for _, x in sent])})

    return run


def _shared_anchors(key: tuple, table: pa.Table) -> pa.Table:
    value, row = _joined(table, "anchors", np.uint64)
    several = (value & U(1)).astype(bool)
    _, which, n = np.unique(value & ~U(1), return_inverse=True, return_counts=True)
    shared = ((n > 1) | (np.bincount(which, several, len(n)) > 0))[which]
    block = table["block"].to_numpy()
    back = list(_by(row[shared], (value & ~U(1))[shared]))
    return pa.table({"block": pa.array([block[r] for r, _ in back], pa.int64()), "anchors": _blobs([x[0] for _, x in back])})


WINDOWS = {"w1": np.uint64, "w2": np.uint32, "who": np.uint32, "n": np.uint32, "next": np.uint64}


def _send_windows(width: int, shards: int):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["shard", "block", *WINDOWS, "ids"]
        shared = np.unique(_joined(answers, "anchors", np.uint64)[0])
        parts = []
        for batch, a, _, data, offsets in _texts(table) if len(shared) else ():
            word, at = words(data, offsets, EXACT)
            anchor, whole, row = _anchors(word, at, width)
            start = np.flatnonzero(whole & _found(anchor, shared))
            if len(start):
                follows = start + width < at[1:][row[start]]
                after = np.where(follows, word[np.minimum(start + width, len(word) - 1)], U(0))
                parts.append((*_hashes(word, start, width), batch.column("did").to_numpy()[a:][row[start]], after))
        if not parts:
            return pa.table({n: pa.array([], pa.int64() if n in ("shard", "block") else pa.binary()) for n in names})
        w1, w2, did, after = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((w2, w1))
        w1, w2, did, after = w1[order], w2[order], did[order], after[order]
        heads = _heads(w1, w2)
        n = np.diff(heads, append=len(w1))
        least, most = np.minimum.reduceat(did, heads), np.maximum.reduceat(did, heads)
        after = np.where(np.minimum.reduceat(after, heads) == np.maximum.reduceat(after, heads), after[heads], _BRANCH)
        sent = []
        for shard, (x1, x2, d, count, nx) in _by(w1[heads] % U(shards), w1[heads], w2[heads], least, (2 * n + (least < most)).astype(np.uint32), after):
            ids, who = np.unique(d, return_inverse=True)
            sent.append((shard, x1, x2, who.astype(np.uint32), count, nx, ids))
        columns = list(zip(*sent, strict=True))
        return pa.table({"shard": pa.array(columns[0], pa.int64()), "block": pa.array([key[0].as_py()] * len(sent), pa.int64())} | {n: _blobs(columns[i + 1]) for i, n in enumerate(names[2:])})

    return run


#: follows: number of occurrences, doubled, plus 1 where the same word always follows.
OWNED = {"w1": np.uint64, "w2": np.uint32, "did": np.int64, "follows": np.uint64, "blocks": np.uint32, "holders": np.int64}


def _owned_windows(key: tuple, table: pa.Table) -> pa.Table:
    """The recurring windows of a shard, for the blocks of their owners."""
    value = {}
    for name, dtype in WINDOWS.items():
        value[name], row = _joined(table, name, dtype)
    ids, id_row = _joined(table, "ids", np.int64)
    first = np.searchsorted(id_row, np.arange(table.num_rows))
    did = ids[first[row] + value["who"]]
    block = table["block"].to_numpy()[row]
    order = np.lexsort((block, did, value["w2"], value["w1"]))
    w1, w2, did, block, n, after = value["w1"][order], value["w2"][order], did[order], block[order], value["n"][order], value["next"][order]
    heads = _heads(w1, w2)
    holders = np.diff(heads, append=len(w1))
    keep = (holders > 1) | ((n[heads] & 1) > 0)
    same = (np.minimum.reduceat(after, heads) == np.maximum.reduceat(after, heads)) & (after[heads] != _BRANCH)
    total = np.add.reduceat((n >> 1).astype(np.uint64), heads)
    at, holders = heads[keep], holders[keep]
    out = []
    for owner, (i, count) in _by(block[at], np.flatnonzero(keep), holders):
        h = heads[i]
        places = np.repeat(h, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append((owner, w1[h], w2[h], did[h], 2 * total[i] + same[i].astype(np.uint64), count.astype(np.uint32), block[places]))
    columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
    return pa.table({"block": pa.array(columns[0], pa.int64())} | {n: _blobs(columns[i + 1]) for i, n in enumerate(OWNED)})


def _cut_passages(width: int):
    """(holders, did, text) of the passages that documents of the block own."""

    def run(key: tuple, table: pa.Table, owned: pa.Table) -> pa.Table:
        o = {n: _joined(owned, n, t)[0] for n, t in OWNED.items()}
        order = np.lexsort((o["w2"], o["w1"]))
        last = np.cumsum(o["blocks"])[order]
        w1, w2, own, follows = (o[n][order] for n in ("w1", "w2", "did", "follows"))
        count = o["blocks"][order]
        alike = int(np.diff(np.append(_heads(w1), len(w1))).max()) if len(w1) else 0
        owners = np.unique(own)
        holders, dids, texts, done = [], [], [], set()
        for batch, a, _, data, offsets in _texts(table) if len(w1) else ():
            did = batch.column("did").to_numpy()[a:]
            raw, starts, ends, at = spans(data, offsets)
            word, _ = words(data, offsets, EXACT)
            row, end = _rows_of(at)
            start = np.flatnonzero((np.arange(len(word)) + width <= end) & _found(did[row], owners))
            if not len(start):
                continue
            x1, x2 = _hashes(word, start, width)
            entry, place = np.full(len(word) + 1, -1), np.searchsorted(w1, x1)
            for step in range(alike):
                p = np.minimum(place + step, len(w1) - 1)
                hit = (w1[p] == x1) & (w2[p] == x2) & (own[p] == did[row[start]])
                entry[start[hit]] = p[hit]
            here, after = entry[:-1], entry[1:]
            both = (here >= 0) & (after >= 0)
            both[:-1] &= row[1:] == row[:-1]
            joined = both & (follows[here] % 2 == 1) & (follows[here] // 2 == follows[after] // 2)
            opens = here >= 0
            opens[1:] &= ~joined[:-1]
            closes = np.flatnonzero((here >= 0) & ~joined)
            for x, y in zip(np.flatnonzero(opens), closes, strict=True):
                e = int(here[x])
                if e in done:
                    continue
                done.add(e)
                to = o["holders"][int(last[e]) - int(count[e]) : int(last[e])].tolist()
                for z in range(x, y + 1, PASSAGE_WORDS - width + 1):
                    stop = min(z + PASSAGE_WORDS, y + width)
                    holders.append(to)
                    dids.append(int(own[e]))
                    texts.append(raw[starts[z] : ends[stop - 1]].tobytes().decode())
        return pa.table({"holders": pa.array(holders, pa.list_(pa.int64())), "owner": pa.array(dids, pa.int64()), "passage": pa.array(texts, pa.string())})

    return run


class Automaton:
    """Passages over numbered words; values are (number of words, owner).

    A known word is ``DIGITS`` symbols of five bits, the first of an alphabet of its own, so that matches begin
    and end at words; an unknown word is one symbol that no passage holds.  (An automaton looks for a child
    among all children in turn, so few symbols beat a symbol a word.)
    """

    def __init__(self, passages: pa.Array, owners: list[int]):
        data, offsets = buffers(passages)
        raw, starts, ends, at = spans(data, offsets)
        word = word_strings(raw, starts, ends)
        self.known = pc.unique(word)
        self.automaton = ahocorasick.Automaton()
        text, _ = self.symbols(word)
        for a, b, owner in zip(at[:-1].tolist(), at[1:].tolist(), owners, strict=True):
            piece = text[DIGITS * a : DIGITS * b]
            self.automaton.add_word(piece, (b - a, min(owner, self.automaton.get(piece, (0, owner))[1])))
        self.automaton.make_automaton()

    def symbols(self, word: pa.Array) -> tuple[str, np.ndarray]:
        """The words in symbols, and the first symbol of each word (and the end)."""
        number = pc.fill_null(pc.index_in(word, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        at = np.zeros(len(number) + 1, np.int64)
        np.cumsum(np.where(number < 0, 1, DIGITS), out=at[1:])
        out = np.zeros(int(at[-1]), np.uint8)
        number, first = number[number >= 0], at[:-1][number >= 0]
        for d in range(DIGITS):
            out[first + d] = (number >> BITS * (DIGITS - 1 - d) & (1 << BITS) - 1) + 1 + (d > 0) * (1 << BITS)
        return out.tobytes().decode("ascii"), at


def automata(passages: pa.Table) -> Iterator[Automaton]:
    """Shards of at most SHARD_WORDS words (or of one passage)."""
    text = passages["passage"].combine_chunks()
    owners = passages["owner"].to_pylist()
    if not owners:
        return
    shard = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False) // 2 + 1) // SHARD_WORDS
    heads = _heads(shard)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(shard)], strict=True):
        yield Automaton(text.slice(a, b - a), owners[a:b])


REMOVED = "doc_id long, n_words long, n_removed long, text string"


def _remove(key: tuple, table: pa.Table, passages: pa.Table) -> pa.Table:
    """Streams the block's documents through its automata, one after the other."""
    pieces = []
    for batch, a, b, data, offsets in _texts(table):
        raw, starts, ends, at = spans(data, offsets)
        word = word_strings(raw, starts, ends)
        pieces.append((batch.slice(a, b - a), at, word, np.zeros(len(word) + 1, np.int64)))
    for m in automata(passages):
        for batch, at, word, change in pieces:
            text, first = m.symbols(word)
            edge, ends, lengths = first[at].tolist(), [], []
            for r, own in enumerate(batch.column("did").to_pylist()):
                base = edge[r]
                for end, (n, owner) in m.automaton.iter(text[base : edge[r + 1]]):
                    if owner < own:
                        ends.append(base + end + 1)
                        lengths.append(n)
            stop = np.searchsorted(first, np.array(ends, np.int64))
            np.add.at(change, stop - np.array(lengths, np.int64), 1)
            np.add.at(change, stop, -1)
        del m
    out = []
    for batch, at, word, change in pieces:
        kept = np.cumsum(change)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(kept)])[at]
        lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), word.filter(pa.array(kept)))
        n = np.diff(at)
        out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - np.diff(left)), pc.binary_join(lists, " ")], ["doc_id", "n_words", "n_removed", "text"]))
    return pa.Table.from_batches(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string())})


def recurring_passages(blocks: DataFrame, width: int, shards: int) -> DataFrame:
    """(block, owner, passage): each passage that documents share, for every block that holds it."""
    packed = lambda names: ", ".join(f"{n} binary" for n in names)
    sent = blocks.groupBy("block").applyInArrow(_send_anchors(width, shards), "shard long, block long, anchors binary")
    answers = sent.groupBy("shard").applyInArrow(_shared_anchors, "block long, anchors binary")
    windows = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_windows(width, shards), f"shard long, block long, {packed([*WINDOWS, 'ids'])}")
    owned = windows.groupBy("shard").applyInArrow(_owned_windows, f"block long, {packed(OWNED)}")
    passages = blocks.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(_cut_passages(width), "holders array<long>, owner long, passage string")
    return materialize(passages, "passages").select(F.explode("holders").alias("block"), "owner", "passage")


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the text of the words that stay, joined by single spaces."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_min("doc_id").alias("did"), text.alias("text"))
    dealt = dealt.mapInArrow(_deal(block_bytes), "block long, size long, doc_id long, did long, text string")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"passage_blocks_{uuid.uuid4().hex}"
    writer = dealt.write.format("parquet").bucketBy(buckets, "block").sortBy("block").option("compression", "zstd")
    writer.option("path", shared_dir(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    # several shards a partition, as they are dealt by hash
    shards = 4 * max(buckets, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    blocks = blocks.select("block", "doc_id", "did", "text")
    passages = recurring_passages(blocks.select("block", "did", "text"), width, shards)
    out = blocks.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(_remove, REMOVED)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay, as results read them lazily
    return out
