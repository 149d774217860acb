"""Personal data: base patterns, and more identifiers by bootstrapped contextual extraction.

Base.  E-mail, IP, card and phone spans by regular expression with their checks (parts at most 255,
Luhn, digit counts), leftmost and non-overlapping per kind.  The expressions are written with possessive
runs that may only begin where a run begins (or where the last match ended), which finds the same spans
in linear time.  Matches are exploded, and their positions are running sums of the lengths of matches and
of the gaps between them, so a text costs time in proportion to its length.

Bootstrap.  Seeds are the base spans and secrets: quoted values given to a name like token or password.
Other words with a digit, ``@`` or ``_`` are candidates; an IP with a part above 255 or a card number
that fails Luhn's check is known to be none.  Each occurrence shows patterns: the one and the two words before it, the word
behind it, the words on both sides, and its own shape (a neighbour that is a candidate stands as its
shape).  Over the graph of distinct patterns and instances, for each kind,
    confidence(pattern) = sum of its instances' scores / (number of its instances + 1)
    score(instance)     = 1 - product over its trusted patterns of (1 - confidence)      (seeds: 1)
is iterated until the confidences settle.  A pattern is trusted from ``MIN_SEEDS`` instances of score one
half and ``MIN_CONFIDENCE`` on; so found identifiers induce patterns in their turn, and as scores only
grow, the iteration ends.  Occurrences of a trusted pattern that look like identifiers get its kind.

DataFrame functions only.  Cases: null text is empty; empty texts have no spans; repeated rows are
answered each (rows carry a number of their own); null doc_id stays null; of kinds that claim one
candidate, the most confident counts, on a tie the first listed; very long texts are read whole; an empty
table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Kinds in order; all but the last are base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
CANDIDATE = len(KINDS)
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?i)(?<=(?:token|secret|password|passwd|api[_-]?key) ?[:=] ?[\"'])[^\s\"']{8,}+",
    r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+",
)
#: What a text must hold for a pattern to be looked for.
NEEDS = ("@", "[0-9]", "[0-9]", r"\+", "[:=] ?[\"']", "[0-9@_]")
CORE = r"[A-Za-z0-9+](?:.*[A-Za-z0-9])?"
#: The two last words of a reversed gap and the first word of one, whatever their length.
TWO_LAST, FIRST = r"^\s*+\S++(?:\s++\S++)?", r"^\s*+\S++"
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.7
MIN_LENGTH, MIN_DIGITS = 6, 4
SETTLED = 1e-6
#: Parts of a pattern's or an instance's edges, so that no frequent one is joined in one task.
SALTS = 16
MATCHES = "array<struct<ord:int,i:int,gap:int,match:string,before:string,after:string>>"


def matches(text: Column, order: int) -> Column:
    """All matches of a pattern, with the length of the gap before each and the words on both sides."""
    pattern = PATTERNS[order]
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("h"))
    one = F.transform(
        both,
        lambda z, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.char_length(z["g"]).alias("gap"), z["m"].alias("match"), F.reverse(F.regexp_extract(F.reverse(z["g"]), TWO_LAST, 0)).alias("before"), F.regexp_extract(z["h"], FIRST, 0).alias("after")),
    )
    return F.when(text.rlike(NEEDS[order]), F.filter(one, lambda z: z["match"].isNotNull())).otherwise(F.array().cast(MATCHES)).cast(MATCHES)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _is_ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        p = F.regexp_replace(part, "^0+", "")
        return (F.char_length(p) <= 3) & (F.coalesce(F.when(F.char_length(p) <= 3, p.try_cast("int")), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


def _is_card(m: Column) -> Column:
    d = _digits(m)
    return F.char_length(d).between(14, 19) & F.when(F.char_length(d).between(14, 19), _luhn(d)).otherwise(False)


def shape(word: Column) -> Column:
    """Digits as 9, runs of letters as a or A, long hexadecimal strings as their length."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[0-9]", "9"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")
    return F.when(word.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") & word.rlike("[A-Fa-f]"), F.concat(F.lit("hex"), F.char_length(word).cast("string"))).otherwise(plain)


def _word(text: Column, pattern: str, group: int) -> Column:
    """A word of context, lower-cased; a candidate as its shape; null where there is none."""
    w = F.regexp_extract(text, pattern, group)
    return F.when(w == "", None).when(w.rlike("[0-9@_]"), F.concat(F.lit("#"), shape(w))).otherwise(F.lower(w))


def _placed(found: DataFrame) -> DataFrame:
    """One row for each match: rid, ord, start, end (code points, of the match), match, before, after."""
    m = found.select("rid", F.explode("matches").alias("m")).select("rid", "m.*")
    so_far = Window.partitionBy("rid", "ord").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("match")).over(so_far).cast("int")
    # a gap may hold a candidate's neighbour: with nothing between, the match before is the context
    last = F.lag("match").over(so_far)
    before = F.when(F.col("before").rlike(r"\S"), F.col("before")).otherwise(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.col("before")))
    return m.withColumns({"end": end, "before": before}).withColumn("start", F.col("end") - F.char_length("match"))


def _checked(placed: DataFrame) -> DataFrame:
    """With ``ok``: whether a base match passes its check."""
    ok = F.when(F.col("ord") == 1, _is_ip(F.col("match"))).when(F.col("ord") == 2, _is_card(F.col("match"))).when(F.col("ord") == 3, F.char_length(_digits(F.col("match"))).between(10, 15)).otherwise(True)
    return placed.withColumn("ok", ok)


def _occurrences(placed: DataFrame) -> DataFrame:
    """rid, start, end, ord (null: candidate), bad (known to be none), instance, patterns."""
    seed = (F.col("ord") < CANDIDATE) & F.col("ok")
    fails = ~F.col("ok") & ((F.col("ord") == 1) | ((F.col("ord") == 2) & F.char_length(_digits(F.col("match"))).between(14, 19)))
    left, right = Window.partitionBy("rid").orderBy("start", "ord"), Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("ord"))

    def meets(which: Column) -> Column:
        """Whether a match of that sort overlaps: one that began before, or one that begins inside."""
        before = F.max(F.when(which, F.col("end"))).over(left) > F.col("start")
        inside = F.min(F.when(which, F.col("start"))).over(right) < F.col("end")
        return F.coalesce(before, F.lit(False)) | F.coalesce(inside, F.lit(False))

    o = placed.withColumns({"seeded": meets(seed), "bad": meets(fails)})
    o = o.where(seed | ((F.col("ord") == CANDIDATE) & ~F.col("seeded")))
    own = F.col("ord") == CANDIDATE
    core = F.when(own, F.regexp_extract("match", CORE, 0)).otherwise(F.col("match"))
    o = o.withColumn("core", core).where("core <> ''")
    begin = F.when(own, F.col("start") + F.instr("match", F.col("core")) - 1).otherwise(F.col("start")).cast("int")
    one, two, behind = _word(F.col("before"), r"(?<!\S)(\S++)\s*+$", 1), _word(F.col("before"), r"(?<!\S)(\S++)\s++\S++\s*+$", 1), _word(F.col("after"), r"^\s*+(\S++)", 1)
    o = o.withColumns({"start": begin, "end": begin + F.char_length("core"), "l1": one, "l2": two, "r1": behind, "form": shape(F.col("core"))})
    patterns = F.array(F.concat(F.lit("l "), "l1"), F.concat(F.lit("ll "), "l2", F.lit(" "), "l1"), F.concat(F.lit("r "), "r1"), F.concat(F.lit("lr "), "l1", F.lit(" "), "r1"), F.concat(F.lit("s "), "form"))
    return o.select("rid", "start", "end", F.when(~own, F.col("ord")).alias("ord"), (own & F.col("bad")).alias("bad"), F.lower("core").alias("instance"), F.array_distinct(F.array_compact(patterns)).alias("patterns"))


def _fits(c: Column) -> Column:
    return (F.char_length(c) >= MIN_LENGTH) & (F.char_length(_digits(c)) >= MIN_DIGITS)


def _salted(df: DataFrame) -> DataFrame:
    """Once for each salt; grows with the corpus, so never broadcast."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def trusted_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, ord, confidence) of the patterns that the bootstrap ends with."""
    edges = seen.select("instance", "ord", "bad", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.min("ord").alias("ord"), F.max("bad").alias("bad"))
    edges = materialize(edges.withColumn("salt", F.pmod(F.xxhash64("pattern", "instance"), F.lit(SALTS)).cast("int")), "graph")
    known = edges.where("ord is not null").groupBy("instance").agg(F.min("ord").alias("ord"))
    seeds = materialize(known.withColumn("score", F.lit(1.0)), "seeds")
    open_ = edges.where(F.col("ord").isNull() & ~F.col("bad") & _fits(F.col("instance"))).select("pattern", "instance", "salt").join(seeds.select("instance").hint("merge"), "instance", "left_anti")
    open_ = materialize(open_, "open")
    sizes = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS), "sizes")
    scores, before = seeds, None
    while True:
        held = edges.select("pattern", "instance", "salt").join(_salted(scores), ["instance", "salt"])
        sums = held.groupBy("pattern", "ord").agg(F.sum("score").alias("s"), F.count_if(F.col("score") >= 0.5).alias("k")).where(F.col("k") >= MIN_SEEDS)
        good = sums.join(sizes.hint("merge"), "pattern").select("pattern", "ord", (F.col("s") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
        good = materialize(good, "patterns")
        state = good.agg(F.count("*").alias("n"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("s")).first()
        if not state.n or (before is not None and state.n == before.n and state.s - before.s <= SETTLED * state.n):
            return good
        before = state
        reached = open_.join(_salted(good), ["pattern", "salt"]).groupBy("instance", "ord").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = seeds.unionByName(materialize(reached, "scores"))


def _joined(s: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, n_<base kind> (base spans), base_sha256, spans (base and found), n_spans of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    every = F.concat(*(matches(F.col("text"), k) for k in range(len(PATTERNS))))
    found = materialize(rows.select("rid", "doc_id", every.alias("matches")), "private")
    placed = materialize(_checked(_placed(found)), "placed")
    seen = materialize(_occurrences(placed), "occurrences")
    good = trusted_patterns(seen)
    open_ = seen.where(F.col("ord").isNull() & ~F.col("bad") & _fits(F.col("instance"))).select("rid", "start", "end", F.explode("patterns").alias("pattern"))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS)).cast("int"))
    claimed = open_.join(_salted(good), ["pattern", "salt"]).groupBy("rid", "start", "end").agg(F.max_by("ord", F.struct("confidence", -F.col("ord"))).alias("ord"))
    fixed = placed.where((F.col("ord") < CANDIDATE) & F.col("ok")).select("rid", "start", "ord", "end", (F.col("ord") < BASE).alias("base"))
    spans = fixed.unionByName(claimed.select("rid", "start", "ord", "end", F.lit(False).alias("base")))
    one = F.struct("start", "ord", "end")
    spans = spans.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("all_base"))
    out = found.select("rid", "doc_id").join(spans, "rid", "left")
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    out = out.select("doc_id", F.coalesce("spans", none).alias("every"), F.coalesce("all_base", none).alias("base"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["ord"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return out.select("doc_id", *map(number, range(BASE)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))
