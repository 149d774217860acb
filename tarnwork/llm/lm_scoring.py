"""Language-model scoring by context-tree weighting over bytes.

Model.  The next byte is eight binary decisions, each with a context tree of its own over the ``DEPTH``
bytes before; every node keeps how often the training texts chose 0 and 1 there.  With the
Krichevsky-Trofimov estimate KT of a node's counts, the weighted probability of a node is
    Pw = (KT + product of the children's Pw) / 2        (Pw = KT at full depth),
and a decision is predicted by mixing the estimates along its context path, each node against what is
below it in proportion KT : product of children.  Contexts that training never saw take no part.  A
text is preceded by start bytes and ended by an end byte, values that UTF-8 does not use, so the
probabilities of all texts add up to one.  A-Z are lower-cased, as for the word counts.

Scale.  All training bytes count, and the model grows with the corpus; it is never in one place:
* the rows are written once to the shared folder, each with a number of its own; a block is the rows of
  one written part with equal number modulo ``parts``, so whoever reads them later, however the files
  are split, finds the same blocks.  A block asks for the distinct (DEPTH+1)-grams and words in each run of
  rows that one task reads, with its training counts, in packed rows: sorted keys of one run and one
  subtree, delta coded;
* a subtree holds the grams whose last two context bytes fall in one of ``subs`` hash classes (their
  number follows the input, to 65,536; then chunks of blocks are counted apart first); counts meet there,
  it is weighted on its own, and only sums per last byte (at most 65,536 rows) pass the driver;
* log probabilities go back to the blocks that asked (in single precision, in the order of the keys, which
  are not sent again: the block finds them in its own texts), and each block is scored with its answers.
Nothing is grouped by a key that is frequent: a chunk has a bounded number of keys and a block of bytes.
Keys of words are 63-bit hashes.

Cases: null text is empty (one end token); rows of null doc_id do not train; repeated rows and ties train
and are scored as often as they occur; a very long text is a block, or a part of one, as a whole; without
training rows every decision costs one bit; an empty table gives no rows; only doc_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, materialize
from .shingles import U, buffers, chunks, mix, words

DEPTH = 6
START, END = 0xFE, 0xFF
#: Text bytes of a block, and to a subtree class (of a chunk).
BLOCK_BYTES, SUB_BYTES = 24 << 20, 8 << 20
LEAST_SUBS, MOST_SUBS = 256, 65_536
END_KEY = np.int64(-(1 << 63))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte with its context (end byte included), and the key offsets of the rows.

    The last context byte is the highest of the key, the byte itself the lowest: sorted keys are in the
    order of the tree.
    """
    raw = _LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    rows = len(at) - 1
    sizes = np.diff(at)
    head = at[:-1] + np.arange(rows) * (depth + 1)
    out = np.full(len(raw) + rows * (depth + 1), START, np.uint8)
    own = np.zeros(len(out), bool)
    place = np.arange(len(raw)) + np.repeat((np.arange(rows) + 1) * depth + np.arange(rows), sizes)
    out[place] = raw
    out[head + depth + sizes] = END
    own[place] = True
    own[head + depth + sizes] = True
    key = np.zeros(len(out), np.int64)
    for j in range(1, depth + 1):
        key[j:] |= out[:-j].astype(np.int64) << (8 * (depth - j + 1))
    key |= out
    return key[own], at + np.arange(rows + 1)


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A negative key for each word, and the word offsets of the rows."""
    h, at = words(data, offsets)
    return np.maximum((h | np.uint64(1 << 63)).view(np.int64), END_KEY + 1), at


class KeyTable:
    """Vectorised hash table from distinct int64 keys to their positions."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, probe = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[probe] < 0
            self.slots[probe[free]] = todo[free]
            left = self.slots[probe] != todo
            todo, probe = todo[left], (probe[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions; all keys must be there."""
        probe = self._home(keys)
        out = self.slots[probe]
        wrong = np.flatnonzero(self.keys[out] != keys)
        while len(wrong):
            probe[wrong] = (probe[wrong] + 1) & ((1 << self.bits) - 1)
            x = self.slots[probe[wrong]]
            if (x < 0).any():
                raise RuntimeError("a block holds keys that it did not ask for: its rows changed between two reads")
            out[wrong] = x
            wrong = wrong[self.keys[x] != keys[wrong]]
        return out


# ---- packed rows --------------------------------------------------------------------------------


def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = _begins(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _begins(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def pack(x: np.ndarray) -> bytes:
    """Integers as byte planes of their differences, or single-precision numbers, compressed."""
    if x.dtype == np.int64:
        x = np.diff(x, prepend=np.int64(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)
    return np.cumsum(x) if kind == np.int64 else x


def classes(keys: np.ndarray, depth: int, subs: int) -> np.ndarray:
    """Subtree class of grams (by the last two context bytes, below ``subs``) and of words (above)."""
    gram = keys >= 0
    two = mix((keys >> (8 * (depth - 1))).astype(np.uint64) + U(1)) % U(subs)
    word = mix(keys.view(np.uint64)) % U(subs) + U(subs)
    return np.where(gram, two, word).astype(np.int64)


# ---- the tree -----------------------------------------------------------------------------------

_TABLE = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))]) + 0.5 * np.log(np.pi)
_ONE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 1.0))])


def _log_gamma(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """log gamma(n + add) of whole n: by table, by Stirling's series beyond it."""
    low = np.minimum(n, _TABLE)
    out = table[low.astype(np.int64)]
    big = n > _TABLE
    if big.any():
        y = n[big] + add
        out[big] = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, _HALF, 0.5) + _log_gamma(b, _HALF, 0.5) - np.log(np.pi) - _log_gamma(a + b, _ONE, 1.0)


def _one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate of a one."""
    return (b + 0.5) / (a + b + 1)


def _share(ratio: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))


class Upper:
    """The nodes of depths 1 and 0: dense by last byte and decided bits."""

    def __init__(self, rows: list[tuple]):
        """rows: (last context byte, decided bits, zeros, ones, sum of the depth-2 nodes' log Pw)."""
        a, b, s = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for byte, prefix, zeros, ones, below in rows:
            a[byte, prefix], b[byte, prefix], s[byte, prefix] = zeros, ones, below
        kt = log_kt(a, b)
        pw = np.where(a + b > 0, np.logaddexp(kt, s) - np.log(2), 0.0)
        a0, b0 = a.sum(axis=0), b.sum(axis=0)
        share0, one0 = _share(log_kt(a0, b0) - pw.sum(axis=0)), _one(a0, b0)
        # probability of a one where depth 0 or 1 is the deepest seen; what depth 2 is mixed into
        self.zero = np.where(a0 + b0 > 0, one0, 0.5)
        self.seen = a + b > 0
        before, left = share0 * one0, 1 - share0
        self.first = before[None, :] + left[None, :] * _one(a, b)
        share1 = _share(kt - s)
        self.before, self.left = before[None, :] + left[None, :] * share1 * _one(a, b), left[None, :] * (1 - share1)


class Subtree:
    """Nodes of depths ``depth`` to 2 for ascending distinct grams with whole groups of last two context bytes.

    For each of the eight decisions and each depth, deepest first: (nodes, zeros, ones, log of KT to
    children); a node is its context and, lowest, the bits decided before (a one first).
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int):
        self.depth, key, count = depth, key[count > 0], count[count > 0].astype(np.float64)
        self.levels: list[list[tuple]] = []
        self.tops: list[tuple] = []  # of each decision: nodes, zeros, ones, log Pw at depth 2
        for i in range(8 if len(key) else 0):
            byte = key & 255
            node, bit = (key >> 8 << 8) | (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
            first = _begins(node)
            node, a, b = node[first], np.add.reduceat(count * (1 - bit), first), np.add.reduceat(count * bit, first)
            pw = log_kt(a, b)
            levels = [(node, a, b, None)]
            for _ in range(depth - 2):
                parent = (node >> 16 << 8) | (node & 255)
                order = np.argsort(parent, kind="stable")
                parent = parent[order]
                first = _begins(parent)
                node, a, b, s = parent[first], np.add.reduceat(a[order], first), np.add.reduceat(b[order], first), np.add.reduceat(pw[order], first)
                kt = log_kt(a, b)
                pw = np.logaddexp(kt, s) - np.log(2)
                levels.append((node, a, b, kt - s))
            self.levels.append(levels)
            self.tops.append((node, a, b, pw))

    def log2_probability(self, key: np.ndarray, upper: Upper) -> np.ndarray:
        """Of each gram's byte after its context."""
        out, byte, last = np.zeros(len(key)), key & 255, key >> (8 * self.depth)
        for i in range(8):
            prefix, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
            one = np.where(upper.seen[last, prefix], upper.first[last, prefix], upper.zero[prefix])
            if self.levels:
                one = self._deepest(i, (key >> 8 << 8) | prefix, one, upper)
            out += np.log2(np.where(bit == 1, one, 1 - one))
        return out

    def _deepest(self, i: int, node: np.ndarray, one: np.ndarray, upper: Upper) -> np.ndarray:
        """``one`` replaced by the mixture that ends in the deepest node seen in training."""
        reach: list[tuple[np.ndarray, np.ndarray]] = []  # (nodes, probability of a one if that node is the deepest)
        before = left = above = None
        for d, (nodes, a, b, ratio) in zip(range(2, self.depth + 1), self.levels[i][::-1], strict=True):
            if above is None:
                at = (nodes >> 16, nodes & 255)
                before, left = upper.before[at], upper.left[at]
            else:
                at = np.searchsorted(above, (nodes >> 16 << 8) | (nodes & 255))
                before, left = before[at], left[at]
            p = _one(a, b)
            reach.append((nodes, before + left * p))
            if d < self.depth:
                share = _share(ratio)
                before, left, above = before + left * share * p, left * (1 - share), nodes
        todo, want = np.arange(len(node)), node
        for nodes, p in reach[::-1]:
            at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
            hit = nodes[at] == want
            one[todo[hit]] = p[at[hit]]
            todo, want = todo[~hit], want[~hit]
            if not len(todo):
                break
            want = (want >> 16 << 8) | (want & 255)
        return one


# ---- the passes ---------------------------------------------------------------------------------

ASKED = "blk long, start long, sub int, n_keys long, keys binary, counts binary"
MERGED = "sub int, n_keys long, keys binary, counts binary, total long, taught long, tops binary"


def block_keys(texts: pa.Array, trains: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and words of a run of rows, ascending, with their training counts."""
    parts: list[tuple] = []
    for teach in (True, False):
        pick = np.flatnonzero(trains == teach)
        if not len(pick):
            continue
        data, offsets = buffers(texts.take(pa.array(pick)))
        parts.append((np.array([END_KEY]), np.array([len(pick) * teach])))
        for x, y in chunks(offsets):
            for keys in (grams(data, offsets[x : y + 1], depth)[0], word_keys(data, offsets[x : y + 1])[0]):
                keys.sort()
                first = _begins(keys)
                parts.append((keys[first], np.diff(np.append(first, len(keys))) * teach))
    return tally(parts)


def by_class(keys: np.ndarray, depth: int, subs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys' order by class, the classes, and where each begins in that order (one more at the end)."""
    sub = classes(keys, depth, subs)
    order = np.argsort(sub, kind="stable")
    first = _begins(sub[order])
    return order, sub[order][first], np.append(first, len(keys))


def _ask(depth: int, subs: int, parts: int):
    """Packed rows of each block, (rid, blk, trains, text) rows in order of rid."""

    def rows(blk: int, start: int, held: list[tuple]) -> pa.RecordBatch:
        keys, n = tally(held)
        order, sub, edge = by_class(keys, depth, subs)
        keys, n = keys[order], n[order]
        cut = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        columns = [np.full(len(sub), blk, np.int64), np.full(len(sub), start, np.int64), sub.astype(np.int32), np.diff(edge), [pack(keys[x:y]) for x, y in cut], [pack(n[x:y]) for x, y in cut]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["blk", "start", "sub", "n_keys", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by block: first row, next row, keys
        for batch in batches:
            rid, blk, trains = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for b in np.unique(blk).tolist():
                mine = np.flatnonzero(blk == b)
                gaps = np.flatnonzero(np.diff(rid[mine]) != parts) + 1
                for pick in np.split(mine, gaps):
                    now = held.get(b)
                    if now is not None and now[1] != rid[pick[0]]:  # rows between are read elsewhere: a run ends
                        yield rows(b, now[0], now[2])
                        now = None
                    if now is None:
                        now = held[b] = [int(rid[pick[0]]), 0, []]
                    now[1] = int(rid[pick[-1]]) + parts
                    now[2].append(block_keys(batch.column(3).take(pa.array(pick)), trains[pick], depth))
                    if sum(len(m[0]) for m in now[2]) > 1 << 23:
                        now[2] = [tally(now[2])]
        for b, (start, _, keys) in held.items():
            yield rows(b, start, keys)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blk, rows): the rows of each block in a batch as one compressed piece, so that texts travel small."""
    for batch in batches:
        blk = batch.column(1).to_numpy()
        for b in np.unique(blk).tolist():
            sink = pa.BufferOutputStream()
            part = batch.take(pa.array(np.flatnonzero(blk == b)))
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blk", "rows"])


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys and counts put together."""
    parts: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size = 0
    for batch in batches:
        for n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("n_keys", "keys", "counts")), strict=True):
            parts.append((unpack(keys, n), unpack(counts, n)))
            size += n
        if size > 1 << 23:
            parts = [tally(parts)]
            size = 0
    return tally(parts)


def _merge(depth: int, subs: int, last: bool):
    """Counts of one class (of a chunk of it, unless ``last``) by key; what it adds to the upper nodes."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _read(batches)
        sub = key[0].as_py()
        tops = b""
        if last and sub < subs:
            tops = np.concatenate([np.stack([node >> 16, node & 255, a, b, pw]) for node, a, b, pw in Subtree(keys, n, depth).tops] or [np.zeros((5, 0))], axis=1).tobytes()
        row = [sub, len(keys), pack(keys), pack(n), int(n.sum()), int((n > 0).sum()), tops]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["sub", "n_keys", "keys", "counts", "total", "taught", "tops"])

    return run


def _upper_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tops in batch.column(0).to_pylist():
            x = np.frombuffer(tops).reshape(5, -1)
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int64)) for v in x[:2]), *map(pa.array, x[2:])], ["byte", "prefix", "a", "b", "pw"])


SCORED = "doc_id long, trains boolean, n_tokens long, n_known long, base_score double, score double"


def _score(depth: int, subs: int, n_all: int, n_distinct: int):
    """Scores of a block's rows, run by run of those who asked."""

    def scored(docs: pa.Table, values: dict[int, bytes]) -> pa.Table:
        texts = docs["text"].combine_chunks()
        keys, _ = block_keys(texts, docs["trains"].to_numpy(), depth)
        order, sub, edge = by_class(keys, depth, subs)
        val = np.zeros(len(keys))
        for c, x, y in zip(sub.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            val[order[x:y]] = unpack(values[c], y - x, np.int64 if c >= subs else np.float32)
        n_words = int(np.searchsorted(keys, 0))  # words are below, grams above
        word_at, word_n = KeyTable(keys[:n_words]), val[:n_words]
        gram_at, gram_log = KeyTable(keys[n_words:]), val[n_words:]
        word_log = np.log10((word_n + 0.1) / (n_all + 0.1 * (n_distinct + 1)))
        cols: list[list] = [[], [], [], []]
        data, offsets = buffers(texts)
        for x, y in chunks(offsets):
            part = offsets[x : y + 1]
            g, at = grams(data, part, depth)
            sums = np.concatenate([[0.0], np.cumsum(gram_log[gram_at.find(g)])])
            cols[0].append(sums[at[1:]] - sums[at[:-1]])
            w, at = word_keys(data, part)
            found = word_at.find(w)
            sums = np.concatenate([[0.0], np.cumsum(word_log[found])])
            known = np.concatenate([[0], np.cumsum(word_n[found] > 0)])
            cols[1].append(sums[at[1:]] - sums[at[:-1]] + word_log[0])  # the end is the least key
            cols[2].append(np.diff(at) + 1)
            cols[3].append(known[at[1:]] - known[at[:-1]] + int(word_n[0] > 0))
        score, base, n, known = (np.concatenate(c) for c in cols)
        return pa.table({"doc_id": docs["doc_id"], "trains": docs["trains"], "n_tokens": n, "n_known": known, "base_score": base, "score": score})

    def run(key: tuple, packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.concat_tables([pa.ipc.open_stream(r).read_all() for r in packed["rows"].to_pylist()]).sort_by("rid")
        values: dict[int, dict[int, bytes]] = {}
        for start, sub, v in zip(*(answers[c].to_pylist() for c in ("start", "sub", "vals")), strict=True):
            values.setdefault(start, {})[sub] = v
        starts = sorted(values)
        edge = [*np.searchsorted(docs["rid"].to_numpy(), starts).tolist(), docs.num_rows]
        return pa.concat_tables([scored(docs.slice(x, y - x), values[s]) for s, x, y in zip(starts, edge[:-1], edge[1:], strict=True)])

    return run


def score_texts(docs: DataFrame, train, depth: int = DEPTH) -> DataFrame:
    """doc_id, trains, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    ``train``: condition for rows that teach.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("trains"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    rows = materialize(rows, "rows")
    own = F.shiftright("rid", 33)
    sizes = rows.groupBy(own.alias("part")).agg(F.sum("size").alias("s")).agg(F.max("s").alias("most"), F.sum("s").alias("all")).first()
    size = sizes["all"] or 0
    parts = max(1, -(-(sizes["most"] or 0) // BLOCK_BYTES))
    subs = min(MOST_SUBS, max(LEAST_SUBS, 1 << (size // SUB_BYTES).bit_length()))
    n_chunks = max(1, -(-size // (subs * SUB_BYTES)))
    rows = rows.select("rid", F.xxhash64(own, F.pmod("rid", F.lit(parts))).alias("blk"), "trains", "text", "doc_id")
    # computed twice rather than kept: packed keys take more room than texts
    asked = rows.select("rid", "blk", "trains", "text").mapInArrow(_ask(depth, subs, parts), ASKED).withColumn("chunk", F.pmod("blk", F.lit(n_chunks)))

    merged = asked.groupBy("sub", "chunk").applyInArrow(_merge(depth, subs, False), MERGED)
    merged = materialize(merged.groupBy("sub").applyInArrow(_merge(depth, subs, True), MERGED), "merged")
    total = merged.where(F.col("sub") >= subs).agg(F.sum("total").alias("n"), F.sum("taught").alias("v")).first()
    n_all, n_distinct = total["n"] or 0, total["v"] or 0
    sums = merged.where(F.col("sub") < subs).select("tops").mapInArrow(_upper_rows, "byte long, prefix long, a double, b double, pw double")
    sums = sums.groupBy("byte", "prefix").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("pw"))
    upper = spark.sparkContext.broadcast(Upper([tuple(r) for r in sums.collect()]))  # at most 65,536 rows

    def answer(key: tuple, asks: pa.Table, counted: pa.Table) -> pa.Table:
        keys, n = _read(counted.to_batches())
        sub = key[0].as_py()
        if sub < subs:
            n = (Subtree(keys, n, depth).log2_probability(keys, upper.value) * np.log10(2)).astype(np.float32)
        values = [pack(n[np.searchsorted(keys, unpack(k, m))]) for k, m in zip(asks["keys"].to_pylist(), asks["n_keys"].to_pylist(), strict=True)]
        return pa.table({"blk": asks["blk"], "start": asks["start"], "sub": asks["sub"], "vals": pa.array(values, pa.binary())})

    counted = merged.select("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))).alias("chunk"), "n_keys", "keys", "counts")
    answers = asked.select("blk", "start", "sub", "n_keys", "keys", "chunk").groupBy("sub", "chunk").cogroup(counted.groupBy("sub", "chunk")).applyInArrow(answer, "blk long, start long, sub int, vals binary")
    packed = rows.select("rid", "blk", "doc_id", "trains", "text").mapInArrow(_packed, "blk long, rows binary")
    out = packed.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(_score(depth, subs, n_all, n_distinct), SCORED)
    return out.select("doc_id", "trains", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame, mod: int = 10, held: int = 0, depth: int = DEPTH) -> DataFrame:
    out = score_texts(docs, fold("doc_id", mod) != held, depth)
    return out.select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
