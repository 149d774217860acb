"""Language identification by cross-parsing entropy.

Per language, labelled text (a bounded sample: whole texts, ``SAMPLE_BYTES`` together) is made into a
suffix automaton, held as a hash table of its transitions.  A text is parsed
by each automaton into longest matches: a phrase ends where the text leaves what the language's sample
contains.  phrases * log2(sample length) / symbols estimates the cross entropy; the smallest wins.

Symbols are the UTF-8 bytes of lower-cased letters, so that no alphabet is too large; a run of other
characters is one blank.  Whole texts are parsed: a long text is cut into segments of ``SEGMENT`` symbols,
whose phrases are added up, and all segments of a batch are advanced together, one symbol at a time, by
numpy gathers.

The sample: texts with a letter, equal ones being one, in order of their hash - the least of each of
``SAMPLE_CLASSES`` hash classes, so no sort of all rows is needed - as long as they fit the bound; where
none fits, the shortest.

Cases: null text and text without a letter give ``und`` with score 0; rows of null lang or doc_id do not
teach; without any teaching row all predictions are ``und``; ties go to the smaller language name;
repeated rows are answered each; very long texts are parsed whole; an empty table gives no rows; of other
columns only lang is read, and any names may occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold
from .shingles import buffers, chunks

SAMPLE_CLASSES = 256
SAMPLE_BYTES = 64 << 10
SEGMENT = 512
#: Text bytes parsed together, or one text.
CHUNK = 1 << 20
SHARPNESS = 10.0
UND = "und"
OTHER, BLANK = 0, 1
_LUT: dict[str, np.ndarray] = {}


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter; its lower-case form."""
    if not _LUT:
        n = 0x110000
        letter, low = np.zeros(n, bool), np.arange(n, dtype=np.int32)
        for c in range(n):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                letter[c] = True
                if len(x := s.lower()) == 1:
                    low[c] = ord(x)
        _LUT["letter"], _LUT["low"] = letter, low
    return _LUT["letter"], _LUT["low"]


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and where each begins."""
    n = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint8)
    for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        x = np.flatnonzero(n == size)
        if len(x):
            p = points[x]
            out[at[x]] = lead | (p >> (6 * (size - 1)))
            for k in range(1, size):
                out[at[x] + k] = 0x80 | ((p >> (6 * (size - 1 - k))) & 63)
    return out, at


def suffix_transitions(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton's transitions by state; state 1 is the root, 0 none."""
    trans: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols:
        cur = len(trans)
        trans.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Automata:
    """Suffix automata in one hash table of transitions, half full at most; ``roots`` are their first states."""

    def __init__(self, samples: list[list[int]], width: int):
        self.width, first, keys, goals, roots = width, 0, [], [], []
        for symbols in samples:
            trans = suffix_transitions(symbols)
            keys.append(np.array([(first + s) * width + c for s, row in enumerate(trans) for c in row], np.int64))
            goals.append(np.array([first + x for row in trans for x in row.values()], np.int32))
            roots.append(first + 1)
            first += len(trans)
        self.roots = np.array(roots, np.int64)
        key, goal = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int32), *goals])
        self.bits = max(4, int(2 * max(1, len(key)) - 1).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[todo[free]]
            mine = self.keys[at] == key[todo]
            self.next[at[mine]] = goal[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; 0 where there is none."""
        keys = state * self.width + symbol
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.next[at], 0)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[more]]
            hit = found == keys[more]
            out[more[hit]] = self.next[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


class Parser:
    """The automata of all languages and the symbol table they share."""

    def __init__(self, samples: dict[str, list[str]]):
        self.letter, self.low = _lookup()
        texts = {lang: self._bytes(np.frombuffer("\n".join(samples[lang]).encode("utf-32-le", "surrogatepass"), np.uint32))[0] for lang in sorted(samples)}
        seen = sorted(set().union(*(np.unique(t).tolist() for t in texts.values())) - {32}) if texts else []
        self.symbol = np.full(256, OTHER, np.uint8)
        self.symbol[32] = BLANK
        self.symbol[seen] = np.arange(2, 2 + len(seen))
        texts = {lang: text for lang, text in texts.items() if (text != 32).any()}
        self.langs = list(texts)
        self.automata = Automata([self.symbol[t].tolist() for t in texts.values()], 2 + len(seen))
        self.bits = [np.log2(len(t) + 1) for t in texts.values()]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("letter", "low")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.letter, self.low = _lookup()

    def _bytes(self, points: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of the letters, 32 for each run of others; the edges (rows begin anew) and the letters so far."""
        p = np.where(self.letter[points], self.low[points], 32)
        keep = np.ones(len(p), bool)
        keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
        if edges is None:
            edges = np.array([0, len(p)])
        keep[edges[:-1][edges[:-1] < len(p)]] = True
        kept = np.zeros(len(p) + 1, np.int32)
        np.cumsum(keep, out=kept[1:])
        p = p[keep]
        letters = np.zeros(len(p) + 1, np.int32)
        np.cumsum(p != 32, out=letters[1:])
        out, at = utf8(p)
        return out, at[kept[edges]], letters[kept[edges]]

    def rates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) bits per symbol, and whether a row has letters."""
        raw = data[offsets[0] : offsets[-1]]
        rows = len(offsets) - 1
        head = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((raw & 0xC0) != 0x80, out=head[1:])
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        s, at, letters = self._bytes(points, head[offsets - offsets[0]])
        s, lengths, has = self.symbol[s], np.diff(at), np.diff(letters) > 0
        n_seg = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(rows), n_seg)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        begin = at[:-1][row] + nth * SEGMENT
        size = np.minimum(SEGMENT, at[1:][row] - begin)
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), "right")
        out, n_langs, roots = np.zeros((rows, len(self.langs))), len(self.langs), self.automata.roots
        state = np.repeat(roots[:, None], len(row), axis=1)  # all languages advance together
        count = np.zeros(state.shape, np.int64)
        for t in range(int(size[0]) if len(size) and n_langs else 0):
            n = live[t]
            c = np.tile(s[begin[:n] + t].astype(np.int64), n_langs)
            x = self.automata.step(state[:, :n].ravel(), c)
            left = np.flatnonzero(x == 0)
            lang, at_row = left // n, left % n
            count[lang, at_row] += 1
            again = self.automata.step(roots[lang], c[left])
            x[left] = np.where(again == 0, roots[lang], again)
            state[:, :n] = x.reshape(n_langs, n)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(row, count[k], minlength=rows) * self.bits[k]
        return out / np.maximum(lengths, 1)[:, None], has

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rates, has = self.rates(data, offsets)
        if not self.langs:
            return [UND] * len(has), np.zeros(len(has))
        best = rates.argmin(axis=1)
        e = np.exp(-SHARPNESS * (rates - rates.min(axis=1, keepdims=True)))
        score = np.where(has, 1 / e.sum(axis=1), 0.0)
        return [self.langs[b] if h else UND for b, h in zip(best, has, strict=True)], score


def train(docs: DataFrame, learn=None, classes: int = SAMPLE_CLASSES, most: int = SAMPLE_BYTES) -> Parser:
    """Automata of a bounded sample of the rows where ``learn`` holds (default: all with a lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if learn is not None:
        rows = rows.where(learn)
    h, size = F.xxhash64("text"), F.octet_length("text")
    least = rows.groupBy("lang", F.pmod(h, F.lit(classes)).alias("c")).agg(F.min(F.struct(h.alias("h"), size.alias("n"))).alias("first"), F.min(F.struct(size.alias("n"), h.alias("h"))).alias("shortest"))
    by_lang: dict[str, list] = {}
    for r in least.collect():  # ``classes`` rows a language
        by_lang.setdefault(r.lang, []).append(r)
    picked: set[tuple[str, int]] = set()
    for lang, own in by_lang.items():
        left, some = most, False
        for r in sorted(own, key=lambda r: r.first.h):
            if r.first.n <= left:
                left, some = left - r.first.n, True
                picked.add((lang, r.first.h))
        if not some:
            picked.add((lang, min(own, key=lambda r: (r.shortest.n, r.shortest.h)).shortest.h))
    samples: dict[str, dict[int, str]] = {}
    if picked:
        texts = rows.select("lang", h.alias("h"), "text").where(F.col("h").isin(sorted({x for _, x in picked})))
        for r in texts.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
            if (r.lang, r.h) in picked:
                samples.setdefault(r.lang, {})[r.h] = r.text
    return Parser({lang: [t for _, t in sorted(texts.items())] for lang, texts in samples.items()})


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                langs, score = model.value.predict(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def reject_unknown(docs: DataFrame, parser: Parser) -> DataFrame:
    """The rows whose language is known (without any learned language: that have a letter); all columns.

    The verdict is made next to the row.
    """
    model, at = docs.sparkSession.sparkContext.broadcast(parser), docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            keep: list[bool] = []
            for a, b in chunks(offsets, CHUNK):
                part = offsets[a : b + 1]
                keep += [x != UND for x in model.value.predict(data, part)[0]] if model.value.langs else model.value.rates(data, part)[1].tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict_held_out(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all."""
    f = fold("doc_id", mod)
    parser = train(docs, f != held)
    return identify(docs, parser).select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "lang_pred", "score")
