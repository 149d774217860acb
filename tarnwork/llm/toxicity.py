"""Toxicity by a weighted finite-state grammar over clauses.

A clause's words become classes: insult, threat, target (a person spoken to or about), negation,
reporting verb, quotation mark, other.  Three small transducers are composed once: *negation* marks
insults and threats in the reach of a negation, *reported speech* marks those that follow a reporting
verb or stand in quotation marks, *target* marks those with a target near by.  The composition is run
over the clause by best path, and its output - not the words - is what counts: the weights of the
directed, plain, negated, reported insults and threats of all the text's clauses.

Everything but the structure is learned, from a bounded sample of labelled rows.  *Insults* are words and
stems whose distinct contexts (word before, word after) are significantly more in toxic texts than in
clean ones, by log-likelihood ratio over the whole vocabulary; copies of a text share their contexts
and so count once.  A stem stands for all its forms, seen or not; its weight, like a word's, is the log
of its odds.  *Targets* and *negations* are, besides the built-in ones, words whose nearness to an insult
is significantly more, or less, in toxic texts.  Arc weights of the outputs are fitted by logistic
regression (towards the built-in ones), and the grammar is composed anew with them.

Cases: null and empty texts get the score of a text without matches; rows of null doc_id are scored
but do not teach; several labels of one id teach each; without labels the built-in weights hold; words
of equal weight are equal (ties have no order); repeated rows are scored each; very long texts are read
whole, clause by clause; an empty table gives no rows; only doc_id and text are read, lang and source
are not, and other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold, materialize

#: Labelled rows of each label that teach, at most (those of least id hash).
SAMPLE_PER_LABEL = 4000
#: How much more frequent an insult word and stem must be in toxic texts than in clean ones; letters of a stem.
MIN_RATIO, STEM_RATIO, STEM = 20.0, 10.0, (4, 12)
#: Weight (log odds) of a built-in word; how much more or less frequent a learned target or negation is.
BUILT_IN, NEAR_RATIO = 4.0, 4.0
WINDOW = 3
THRESHOLD = 0.3

INSULTS = ("idiot", "moron", "imbecile", "scum", "loser", "pathetic", "worthless", "trash", "clown", "stupid", "disgusting", "dumbass", "bastard", "dummkopf", "arschloch", "imbécile", "connard", "gilipollas", "estúpido")
THREATS = ("kill", "murder", "hurt", "destroy", "strangle", "stab", "shoot", "burn", "beat", "töten", "tuer", "matar")
TARGETS = ("you", "your", "you're", "u", "he", "she", "they", "him", "her", "them", "du", "dich", "ihr", "tu", "toi", "vous", "tú", "usted")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "won't", "wasn't", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "claimed", "claims", "wrote", "quoted", "reported", "called", "sagte", "dit", "dijo")

#: Outputs of the grammar, in feature order, and the weights that hold without labels.
OUTPUTS = ("insult", "insult>target", "insult~not", "insult~said", "threat>target", "threat", "threat~not", "threat~said")
PRIOR = np.array([-3.0, 1.6, 2.2, -0.3, 0.3, 2.5, 0.3, -0.3, 0.3])

_CLAUSE = re.compile(r"[^.!?;:\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]")


class Fst:
    """Weighted transducer: arcs[state][input] = [(output, weight, next state)]; state 0 starts."""

    def __init__(self):
        self.arcs: dict[int, dict[str, list]] = {}
        self.final: dict = {0: 0.0}

    def arc(self, state, read, write, weight, to) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((write, weight, to))

    def then(self, other: Fst) -> Fst:
        """Composition: what this one writes, the other reads."""
        out, number, todo = Fst(), {(0, 0): 0}, [(0, 0)]
        out.final = {}
        while todo:
            pair = todo.pop()
            here = number[pair]
            if pair[0] in self.final and pair[1] in other.final:
                out.final[here] = self.final[pair[0]] + other.final[pair[1]]
            for read, arcs in self.arcs.get(pair[0], {}).items():
                for mid, w1, a in arcs:
                    for write, w2, b in other.arcs.get(pair[1], {}).get(mid, ()):
                        if (a, b) not in number:
                            number[a, b] = len(number)
                            todo.append((a, b))
                        out.arc(here, read, write, w1 + w2, number[a, b])
        return out

    def best(self, symbols: list[str]) -> list[str]:
        """Outputs of the heaviest accepting path."""
        front = {0: (0.0, None)}
        for s in symbols:
            step: dict = {}
            for state, (weight, path) in front.items():
                for write, w, to in self.arcs.get(state, {}).get(s, ()):
                    if to not in step or weight + w > step[to][0]:
                        step[to] = (weight + w, (write, path))
            front = step
        ends = [(w + self.final[s], -s, p) for s, (w, p) in front.items() if s in self.final]
        out, path = [], max(ends, key=lambda e: e[:2])[2] if ends else None
        while path is not None:
            out.append(path[0])
            path = path[1]
        return out[::-1]


def negation_fst(reach: int = WINDOW) -> Fst:
    t = Fst()
    for s in range(reach + 1):
        t.final[s] = 0.0
        for c in "YRQo":
            t.arc(s, c, c, 0.0, max(0, s - 1))
        t.arc(s, "N", "o", 0.0, reach)
        for c in "IT":
            t.arc(s, c, c + "~not" if s else c, 0.0, max(0, s - 1))
    return t


def reported_fst() -> Fst:
    """States: 0 outside, 1 after a reporting verb, 2 within quotation marks."""
    t = Fst()
    for s in (0, 1, 2):
        t.final[s] = 0.0
        for c in "Yo":
            t.arc(s, c, c, 0.0, s)
        t.arc(s, "R", "o", 0.0, 2 if s == 2 else 1)
        t.arc(s, "Q", "o", 0.0, 0 if s == 2 else 2)
        for c in "IT":
            t.arc(s, c, c + "~said" if s else c, 0.0, s)
            t.arc(s, c + "~not", c + "~not", 0.0, s)
    return t


def target_fst(weights: dict[str, float], reach: int = WINDOW) -> Fst:
    """Writes the outputs, each with its weight.  ("b", n): a target stood n or fewer words back; ("a", n): one is promised within n words, on pain of no path."""
    t, name = Fst(), {("b", 0): 0}

    def state(kind: str, n: int) -> int:
        return name.setdefault((kind, n), len(name))

    marks = ("~not", "~said")
    for kind in "ba":
        for n in range(reach + 1):
            s, down = state(kind, n), max(0, n - 1)
            dead = kind == "a" and n == 0
            if kind == "b":
                t.final[s] = 0.0
            if dead:
                continue
            t.arc(s, "Y", "", 0.0, state("b", reach))
            if kind == "a" and down == 0:
                continue
            to = state(kind, down)
            t.arc(s, "o", "", 0.0, to)
            for c, word in (("I", "insult"), ("T", "threat")):
                for m in marks:
                    t.arc(s, c + m, word + m, weights[word + m], to)
                if kind == "b":
                    t.arc(s, c, word + ">target" if n else word, weights[word + ">target" if n else word], to)
                    if not n:
                        t.arc(s, c, word + ">target", weights[word + ">target"], state("a", reach))
                else:
                    t.arc(s, c, word + ">target", weights[word + ">target"], to)
    return t


def grammar(weights: np.ndarray = PRIOR) -> Fst:
    """The composition; ``weights`` of the outputs, after the bias."""
    own = dict(zip(OUTPUTS, map(float, weights[1:]), strict=True))
    return negation_fst().then(reported_fst()).then(target_fst(own))


def _prefix_free(words: list[str]) -> list[str]:
    """Words of which no other one is a beginning."""
    out: list[str] = []
    for w in sorted(words):
        if not out or not w.startswith(out[-1]):
            out.append(w)
    return out


class Matcher:
    """Features of a text: what the grammar's outputs over its clauses weigh.

    insults, stems: words and beginnings of words with their weights; near: learned class of words.
    """

    def __init__(self, insults: dict[str, float], stems: dict[str, float] | None = None, near: dict[str, str] | None = None, weights: np.ndarray = PRIOR):
        self.kind = dict(near or {}) | dict.fromkeys(REPORTS, "R") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(TARGETS, "Y") | dict.fromkeys(THREATS, "T") | dict.fromkeys('"“”„«»', "Q")
        self.insults, self.stems, self.near, self.grammar = insults, dict(stems or {}), dict(near or {}), grammar(weights)
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        begins = [r"\b(?:" + "|".join(map(re.escape, _prefix_free(list(self.stems)))) + ")"] if self.stems else []
        self.find = re.compile("|".join([r"\b(?:" + "|".join(map(re.escape, sorted({*insults, *THREATS}))) + r")\b", *begins])).search

    def weight(self, word: str) -> float:
        """Of an insult (0: none): the word's own or that of its longest stem."""
        own = self.insults.get(word)
        if own is None and word not in self.kind:
            own = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), None)
        return own or 0.0

    def clause(self, words: list[str]) -> list[tuple[str, float]]:
        """(output, weight of the word) along the best path."""
        weights = [self.weight(w) for w in words]
        symbols = ["I" if x else self.kind.get(w, "o") for w, x in zip(words, weights, strict=True)]
        outputs = [o for o in self.grammar.best(symbols) if o]
        places = [x or BUILT_IN for s, x in zip(symbols, weights, strict=True) if s in "IT"]
        return list(zip(outputs, places, strict=True))

    def clauses(self, text: str | None) -> Iterator[list[str]]:
        """Words of the clauses that hold a trigger."""
        low = (text or "").lower()
        if self.find(low):
            for m in _CLAUSE.finditer(low):
                if self.find(m.group()):
                    yield _WORD.findall(m.group())

    def features(self, text: str | None) -> tuple[float, ...]:
        sums = dict.fromkeys(OUTPUTS, 0.0)
        for words in self.clauses(text):
            for out, weight in self.clause(words):
                sums[out] += weight
        return tuple(round(math.log1p(sums[o]), 6) for o in OUTPUTS)

    def neighbours(self, text: str | None) -> set[tuple[str, str]]:
        """(insult or its stem, word within its reach)."""
        out: set[tuple[str, str]] = set()
        for words in self.clauses(text):
            for i, w in enumerate(words):
                if self.weight(w):
                    own = w if w in self.insults else next(w[:n] for n in self.lengths if w[:n] in self.stems)
                    out.update((own, x) for x in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW] if x.isalpha() and not self.weight(x))
        return out


class Model:
    def __init__(self, matcher: Matcher, weights: np.ndarray):
        self.matcher, self.weights = matcher, weights

    def score(self, features: tuple[float, ...]) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(vectors: list[tuple[float, ...]], toxic: np.ndarray, total: np.ndarray, steps: int = 50, ridge: float = 0.5) -> np.ndarray:
    """Ridge-penalised logistic regression (towards the built-in weights) by Newton steps on counts."""
    x = np.hstack([np.ones((len(vectors), 1)), np.array(vectors, float)])
    w = PRIOR.copy()
    pull = np.full(len(w), ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (toxic - total * p) - pull * (w - PRIOR)
        h = (x * (total * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(labels: DataFrame, learn, most: int) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` rows of each label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if learn is not None:
        rows = rows.where(learn)
    h = F.xxhash64("doc_id", F.lit(11))
    parts = [rows.where(F.col("toxic") == t).orderBy(h, "doc_id").limit(most) for t in (0, 1)]
    found = [(r.doc_id, r.toxic) for p in parts for r in p.collect()]
    return labels.sparkSession.createDataFrame(found, "doc_id long, toxic int")


def _contrast(like: Column, unlike: Column) -> tuple[Column, Column]:
    """Log-likelihood ratio of columns t and c against what is expected of them; whether t is above."""
    part = lambda x, y: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / y)).otherwise(0.0)
    return 2 * (part("t", like) + part("c", unlike)), F.col("t") > like


def learn_words(counts: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Insult words and stems with their weights, by (word, t, c): distinct contexts in ``toxic`` and ``clean`` many texts."""
    counts = materialize(counts, "words")
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("n")).first()
    if not total.t or not total.c:
        return {}, {}
    need = 2 * math.log(total.n) + 4  # one word in e squared of all vocabularies passes by chance
    share = total.t / (total.t + total.c)
    gain, more = _contrast((F.col("t") + F.col("c")) * share, (F.col("t") + F.col("c")) * (1 - share))
    floor = min(1.0, clean / (5 * toxic))
    odds = F.ln((F.col("t") / toxic) / ((F.col("c") + floor) / clean)).alias("odds")

    def clear(ratio: float) -> Column:
        return more & (gain >= need) & (odds >= math.log(ratio))

    begins = F.explode(F.transform(F.sequence(F.lit(STEM[0]), F.least(F.char_length("word"), F.lit(STEM[1]))), lambda k: F.substring("word", F.lit(1), k))).alias("stem")
    known = counts.where(~F.col("word").isin([*TARGETS, *NEGATIONS, *REPORTS, *THREATS]))
    forms = known.where(F.char_length("word") >= STEM[0]).select("word", "t", "c", begins)
    stems = forms.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("forms")).where("t > 0 and forms > 1").where(clear(STEM_RATIO))
    words = known.where("t > 0").where(clear(MIN_RATIO))
    return {r.word: r.odds for r in words.select("word", odds).collect()}, {r.stem: r.odds for r in stems.select("stem", odds).collect()}


def learn_near(rows: DataFrame, matcher: Matcher) -> dict[str, str]:
    """Learned targets (Y) and negations (N): words near insults in significantly more, or fewer, toxic
    texts than these insults have by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(y, *x) for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in sorted(matcher.neighbours(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int32()), *(pa.array([p[k] for p in found], pa.string()) for k in (1, 2))], ["toxic", "insult", "word"])

    t, c = F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")
    pairs = materialize(rows.mapInArrow(run, "toxic int, insult string, word string").groupBy("insult", "word").agg(t, c), "near")
    rate = pairs.groupBy("insult").agg(((F.sum("t") + 0.5) / (F.sum(F.col("t") + F.col("c")) + 1)).alias("rate"))
    both = F.col("t") + F.col("c")
    words = pairs.join(rate, "insult").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(both * F.col("rate")).alias("like"), F.sum(both * (1 - F.col("rate"))).alias("unlike"))
    gain, more = _contrast(F.col("like"), F.col("unlike"))
    ratio = F.abs(F.ln((F.col("t") + 0.5) / (F.col("like") + 0.5)) - F.ln((F.col("c") + 0.5) / (F.col("unlike") + 0.5)))
    need = 2 * math.log(max(1, words.count())) + 4
    found = words.where((gain >= need) & (ratio >= math.log(NEAR_RATIO))).select("word", more.alias("more"))
    return {r.word: "Y" if r.more else "N" for r in found.collect()}  # words of a bounded sample


def train(docs: DataFrame, labels: DataFrame, learn=None, most: int = SAMPLE_PER_LABEL) -> Model:
    """``learn``: condition on doc_id for labelled rows that may teach."""
    sample = _sample(labels, learn, most)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(d.join(F.broadcast(sample), "doc_id").where("text is not null").select("toxic", "text"), "labelled")  # at most 2 * most labels
    built_in = dict.fromkeys(INSULTS, BUILT_IN)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(Matcher(built_in), PRIOR.copy())
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}']+"), lambda x: x != "")
    # a word with its neighbours: the array of words against itself moved by one
    near = F.arrays_zip(w.alias("w"), F.concat(F.array(F.lit("")), w).alias("b"), F.slice(F.concat(w, F.array(F.lit(""))), 2, 1 << 30).alias("a"))
    at = rows.select("toxic", F.explode(near).alias("x")).where("x.w is not null")
    contexts = at.select("toxic", F.col("x.w").alias("word"), F.xxhash64("x.b", "x.w", "x.a").alias("c")).distinct()
    counts = contexts.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    words, stems = learn_words(counts, sizes[1], sizes[0])
    insults = built_in | words
    matcher = Matcher(insults, stems, learn_near(rows, Matcher(insults, stems)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [list(matcher.features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    table = rows.mapInArrow(run, "toxic int, f array<double>").groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("f").collect()
    weights = fit([tuple(r.f) for r in table], np.array([r.t for r in table], float), np.array([r.n for r in table], float))
    return Model(Matcher(insults, stems, matcher.near, weights), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the weights of the grammar's outputs of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, f, s = sent.value, [], []
            for t in batch.column(1):
                x = m.matcher.features(t.as_py())
                f.append(list(x))
                s.append(m.score(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32()), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "score", "predicted", "matches"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double, predicted int, matches array<double>")


def score_held_out(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    model = train(docs, labels, fold("doc_id", mod) != held)
    return score(docs, model).select("doc_id", (fold("doc_id", mod) == held).alias("held_out"), "score", "predicted")
