"""Phrases of two and three words that go together, per language, by counting packed n-grams.

1. Words are counted per language.  The frequent ones (a phrase is never more frequent than its words) are
   numbered: the *dictionary*, at most ``DICTIONARY`` words of at most ``WORD_BYTES`` bytes, so its size is
   bounded.  Other words break pieces of text.
2. Every run of two or three numbers becomes a binary key of twelve bytes (three big-endian numbers, the
   last one 0 for two words).  A task radix-sorts the keys of some megabytes of text, counts runs of equal ones
   and cuts the result into ranges.  The ranges follow from the dictionary: a word begins as many phrases
   as it occurs, and a word above a range's size is cut by its second word, so no range is hot.
3. A range's sorted runs meet in one task, are radix-sorted and run-length counted again.
4. Where the dictionary could not hold all frequent words, phrases with a word outside it are counted as
   strings by a plain aggregation; nothing is lost.

A candidate's association is a*a / (l*r) of its weakest cut, in whole millionths; all arithmetic is in
integers or decimals.  Candidates inside a longer one that has at least half their occurrences go.  The
first ``top`` of a language are found in two steps, so that no task ranks a whole language.

Cases: a null language is ``und``; null and empty texts have no words; repeated rows count as often as they
occur; ties are broken by frequency and phrase; very long texts are taken whole, one at a time; words of
any length take part; an empty table gives no rows; only lang and text are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .shingles import buffers, chunks, spans, word_strings

MIN_COUNT = 10
TOP = 2000
#: Most words of the dictionary, and the longest of them.
DICTIONARY = 1_000_000
WORD_BYTES = 64
#: n-grams a range of keys should hold.
RANGE_GRAMS = 2_000_000
#: Bytes of text that are sorted at once.
CHUNK = 2 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BREAK, BOUND = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BOUND[[32, 9, *np.flatnonzero(BREAK)]] = True
#: Two-byte digits of a key.
DIGITS = 6


@dataclass
class Piece:
    """Some rows' words, in text order."""

    words: pa.Array
    row: np.ndarray
    #: whether a word and the next are in one piece of one row
    link: np.ndarray
    #: language of each row
    lang: pa.DictionaryArray


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets, CHUNK):
            raw, starts, ends, at = spans(data, offsets[a : b + 1], BOUND)
            if not len(starts):
                continue
            row = np.repeat(np.arange(b - a), np.diff(at))
            breaks = np.cumsum(BREAK[raw])
            link = np.zeros(len(starts), bool)
            link[:-1] = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
            yield Piece(word_strings(FOLD[raw], starts, ends, BOUND), row, link, batch.column("lang").slice(a, b - a).dictionary_encode())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in _pieces(batches):
        word = p.words.dictionary_encode()
        v = len(word.dictionary)
        key, n = np.unique(p.lang.indices.to_numpy()[p.row].astype(np.int64) * v + word.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([p.lang.dictionary.take(pa.array(key // v)), word.dictionary.take(pa.array(key % v)), pa.array(n)], ["lang", "word", "n"])


class Numbers:
    """The dictionary: words numbered from 1, a language's words together."""

    def __init__(self, head: pa.Table):
        head = head.sort_by([("lang", "ascending"), ("n", "descending"), ("word", "ascending")]).combine_chunks()
        self.words, self.n = head["word"].combine_chunks(), np.concatenate([[0], head["n"].to_numpy()])
        lang = head["lang"].combine_chunks()
        names = lang.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, int)
        self.lang, self.ends = [names[i] for i in first], np.append(first, len(names))[1:]
        self.slices = {n: (int(a), int(b)) for n, a, b in zip(self.lang, first, self.ends, strict=True)}

    def of(self, p: Piece) -> np.ndarray:
        """Number of each word, 0 outside the dictionary."""
        out = np.zeros(len(p.words), np.uint32)
        lang = p.lang.indices.to_numpy()[p.row]
        for i, name in enumerate(p.lang.dictionary.to_pylist()):
            if name in self.slices:
                a, b = self.slices[name]
                at = np.flatnonzero(lang == i)
                found = pc.index_in(p.words.take(pa.array(at)), value_set=self.words.slice(a, b - a))
                out[at] = pc.fill_null(pc.add(found, a + 1), 0).to_numpy(zero_copy_only=False)
        return out

    def splits(self, size: int) -> np.ndarray:
        """First (word, second word) of each range but the first, of some ``size`` n-grams each."""
        weight = 2 * self.n
        before = np.cumsum(weight) - weight
        heavy = np.flatnonzero(weight > size)
        starts = [np.flatnonzero(np.diff(before // size, prepend=0)), heavy, heavy + 1]
        out = [np.concatenate(starts).astype(np.uint64) << np.uint64(32)]
        for i in heavy:
            a, b = self.slices[self.lang[int(np.searchsorted(self.ends, i - 1, "right"))]]
            share = np.cumsum(self.n[a + 1 : b + 1])
            parts = int(-(-weight[i] // size))
            second = a + 1 + np.searchsorted(share, share[-1] * np.arange(1, parts) // parts)
            out.append((np.uint64(i) << np.uint64(32)) | second.astype(np.uint64))
        return np.unique(np.concatenate(out))


def pack(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Keys as (digit, key), the most significant digit first."""
    return np.stack([(c >> np.uint32(s)).astype(np.uint16) for c in (one, two, three) for s in (16, 0)])


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of the keys, digit by digit from the last; numpy sorts two-byte digits by radix."""
    order = np.arange(keys.shape[1])
    for digit in keys[::-1]:
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers."""
    order = radix_order(keys)
    keys, n = keys[:, order], n[order]
    if not len(n):
        return keys, n
    heads = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    return keys[:, heads], np.add.reduceat(n, heads)


def _send_grams(numbers, splits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pieces(batches):
            x = numbers.value.of(p)
            two = np.flatnonzero(p.link[:-1] & (x[:-1] > 0) & (x[1:] > 0))
            three = two[:-1][np.diff(two) == 1]
            none = np.zeros(len(two), np.uint32)
            keys = np.concatenate([pack(x[two], x[two + 1], none), pack(x[three], x[three + 1], x[three + 2])], axis=1)
            keys, n = run_lengths(keys, np.ones(keys.shape[1], np.int64))
            if not len(n):
                continue
            lead = np.zeros(len(n), np.uint64)
            for digit in keys[:4]:
                lead = (lead << np.uint64(16)) | digit
            at = np.searchsorted(splits, lead, "right")
            heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            edges = [*heads.tolist(), len(at)]
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[heads], pa.int64()), pa.array([np.ascontiguousarray(keys[:, a:b]).tobytes() for a, b in parts], pa.binary()), pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary())], ["range", "keys", "n"]
            )

    return run


GRAMS = "lang string, w1 string, w2 string, w3 string, a long, f1 long, f2 long, f3 long"


def _meet_grams(numbers, least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint16).reshape(DIGITS, -1) for x in table["keys"].to_pylist()], axis=1)
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table["n"].to_pylist()]).astype(np.int64)
        keys, n = run_lengths(keys, n)
        keys, n = keys[:, n >= least].astype(np.int64), n[n >= least]
        d = numbers.value
        ids = [(keys[i] << 16) + keys[i + 1] for i in (0, 2, 4)]
        words = [d.words.take(pa.array(np.where(i > 0, i - 1, 0), mask=i == 0)) for i in ids]
        lang = [d.lang[i] for i in np.searchsorted(d.ends, ids[0] - 1, "right")]
        f = [pa.array(d.n[i], mask=i == 0) for i in ids]
        return pa.table([pa.array(lang, pa.string()), *words, pa.array(n), *f], names=["lang", "w1", "w2", "w3", "a", "f1", "f2", "f3"])

    return run


def _rare_grams(numbers):
    """(lang, w1, w2, w3, n): n-grams with a word that has no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pieces(batches):
            known = numbers.value.of(p) > 0
            lang = p.lang.indices.to_numpy()[p.row]
            for size in (2, 3):
                at = np.flatnonzero(p.link[: len(p.link) - size + 1])
                for j in range(1, size - 1):
                    at = at[p.link[at + j]]
                at = at[~np.all([known[at + j] for j in range(size)], axis=0)] if len(at) else at
                words = [p.words.take(pa.array(at + j)) for j in range(size)] + [pa.nulls(len(at), pa.string())] * (3 - size)
                yield pa.RecordBatch.from_arrays([p.lang.dictionary.take(pa.array(lang[at])), *words, pa.array(np.ones(len(at), np.int64))], ["lang", "w1", "w2", "w3", "n"])

    return run


def _millionths(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly, for numbers of up to fifteen digits."""
    part = f"cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))"
    return F.expr(f"({part}) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def _head(frequent: DataFrame, dictionary: int) -> DataFrame:
    """The words whose number has so many binary digits that at most ``dictionary`` have as many."""
    short = frequent.where(F.octet_length("word") <= WORD_BYTES)
    digits = F.length(F.bin("n"))
    room, least = dictionary, 65
    for r in sorted(short.groupBy(digits.alias("digits")).count().collect(), key=lambda r: -r.digits):  # at most 64 rows
        room -= r["count"]
        if room < 0:
            break
        least = r.digits
    return short.where(digits >= least)


def candidates(docs: DataFrame, min_count: int, dictionary: int) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, a, f1, f2, f3) of the frequent n-grams with their words' numbers, and (lang, n)."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = d.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    frequent = counts.where(F.col("n") >= min_count)
    head = _head(frequent, dictionary).toArrow()  # bounded by its parameters
    found = Numbers(head)
    numbers = spark.sparkContext.broadcast(found)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(RANGE_GRAMS, int(2 * found.n.sum()) // (4 * partitions)))
    sent = d.mapInArrow(_send_grams(numbers, found.splits(size)), "range long, keys binary, n binary")
    grams = sent.groupBy("range").applyInArrow(_meet_grams(numbers, min_count), GRAMS)
    if frequent.count() > head.num_rows:
        rare = d.mapInArrow(_rare_grams(numbers), "lang string, w1 string, w2 string, w3 string, n long").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
        for i in (1, 2, 3):
            rare = rare.join(frequent.select("lang", F.col("word").alias(f"w{i}"), F.col("n").alias(f"f{i}")), ["lang", f"w{i}"], "left")
        grams = grams.unionByName(rare)
    return materialize(grams, "grams"), counts.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, dictionary: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases."""
    grams, totals = candidates(docs, min_count, dictionary)
    two, three = grams.where("w3 is null"), grams.where("w3 is not null")
    longer = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    two = two.join(longer, ["lang", "w1", "w2"], "left").where("longest is null or 2 * longest < a")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _millionths("a", "f1", "f2").alias("score"))
    pairs = grams.where("w3 is null")
    three = three.join(pairs.select("lang", "w1", "w2", F.col("a").alias("f12")), ["lang", "w1", "w2"])
    three = three.join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["lang", "w2", "w3"])
    cut = lambda left, right: F.struct(_millionths("a", left, right).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    three = three.withColumns({"k1": cut("f1", "f23"), "k2": cut("f12", "f3")}).withColumn("k", F.when(F.col("k1.score") <= F.col("k2.score"), F.col("k1")).otherwise(F.col("k2")))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "k.l", "k.r", "k.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
