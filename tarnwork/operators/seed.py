"""Seed records: compaction of a file's record to a byte cap, greedy batching, sizes and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..session import cut


def limit_ladder() -> list[dict[str, int]]:
    """The limits that compaction tries, in order: one is halved at each step down to its floor."""
    steps, now = [dict(X.SEED_START)], dict(X.SEED_START)
    for name, floor in (("locations", 20), ("calls", 20), ("signatures", 8), ("external", 8), ("text", 60)):
        while now[name] > floor:
            now = now | {name: now[name] // 2}
            steps.append(now)
    return steps


def clipped(c: Column, n: int | Column) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n)), F.lit("..."))).otherwise(c)


#: Characters that JSON escapes with one more byte, and those that become six.
SHORT_ESCAPES = '"\\\b\f\n\r\t'
LONG_ESCAPES = "".join(chr(i) for i in range(32) if chr(i) not in SHORT_ESCAPES)
LISTS = ("signatures", "calls", "locations", "external")


def json_bytes(c: Column) -> Column:
    """Bytes of a string as JSON: its own, two quotes and what escapes add; a null in a list is four letters."""
    def held(chars: str) -> Column:
        return F.char_length(c) - F.char_length(F.translate(c, chars, ""))

    escapes = F.when(c.rlike(r'["\\\x00-\x1f]'), held(SHORT_ESCAPES) + 5 * held(LONG_ESCAPES)).otherwise(0)
    return F.coalesce(F.octet_length(c) + 2 + escapes, F.lit(4))


def _object_bytes(members: dict[str, Column]) -> Column:
    """Bytes of a JSON object of (name, bytes of value); members whose bytes are null are left out."""
    each = (F.coalesce(v + len(k) + 4, F.lit(0)) for k, v in members.items())  # quotes, colon, comma
    return F.greatest(sum(each, F.lit(1)), F.lit(2))


def _element_bytes(name: str, limit: int | None = None, text: int | None = None) -> Column:
    """Bytes of each of a list's first elements as JSON, their texts clipped."""
    def size(x: Column) -> Column:
        return json_bytes(x if text is None else clipped(x, text))

    def place(x: Column) -> Column:
        present = {k: F.when(x[k].isNotNull(), v) for k, v in (("kind", json_bytes(x["kind"])), ("text", size(x["text"])))}
        return _object_bytes(present | {"line": F.octet_length(x["line"].cast("string"))})

    return F.transform(name if limit is None else F.slice(name, 1, limit), place if name == "locations" else size)


def _list_bytes(sizes: Column, limit: Column | None = None) -> Column:
    """Bytes of the JSON array of the first elements."""
    some = sizes if limit is None else F.slice(sizes, 1, limit)
    return F.aggregate(some, F.lit(2).cast("long"), lambda n, x: n + x + 1) - F.when(F.size(some) > 0, 1).otherwise(0)


def _head_bytes() -> dict[str, Column]:
    return {c: F.when(F.col(c).isNotNull(), json_bytes(F.col(c))) for c in ("path", "lang")}


def compact(records: DataFrame, cap: int = X.SEED_CAP) -> DataFrame:
    """(path, record, json, truncated, reason, whole_bytes): the first rung whose JSON and line feed fit the cap.

    Lists must not be null.  ``whole_bytes`` is the length of the record as it was, with imports; where it shows
    that the first rung fits, nothing else is measured.  Elsewhere which rung fits is arithmetic: the JSON length of
    each element is computed once for each text limit (the rungs have two), rung by rung they are summed up to its
    limits until a sum fits the cap.  Then the one record that fits is built and written.  The result is written, as
    findings, batches and reports all read it.
    """
    rungs = limit_ladder()
    texts = sorted({r["text"] for r in rungs}, reverse=True)  # the last limit to be halved
    most = {t: {n: max(r[n] for r in rungs if r["text"] == t) for n in LISTS} for t in texts}
    heads = _head_bytes()
    # the first rung keeps a part of the whole, clips add two bytes to an element at most, "omitted" takes less than 128
    whole = records.withColumn("whole_bytes", F.octet_length(F.to_json(F.struct("path", "lang", "imports", *LISTS))).cast("long"))
    elements = sum((F.size(n) for n in LISTS), F.lit(0))
    roomy = whole.withColumn("roomy", F.col("whole_bytes") + 2 * elements + 128 < cap)
    summed = {f"b_{n}_{t}": _element_bytes(n, k[n], t) for t, k in most.items() for n in LISTS} | {f"b_{c}": v for c, v in heads.items()}
    sized = roomy.withColumns({k: F.when(~F.col("roomy"), v) for k, v in summed.items()})

    def limit(n: str, i: Column) -> Column:
        return F.get(F.array(*(F.lit(r[n]) for r in (*rungs, X.SEED_MINIMAL))), i)

    def left(n: str, k: Column) -> Column:
        return F.greatest(F.size(n) - k, F.lit(0))

    def total(r: dict[str, int]) -> Column:
        omitted = _object_bytes({n: F.octet_length(left(n, F.lit(r[n])).cast("string")) for n in LISTS})
        return _object_bytes({c: F.col(f"b_{c}") for c in heads} | {n: _list_bytes(F.col(f"b_{n}_{r['text']}"), F.lit(r[n])) for n in LISTS} | {"omitted": omitted})

    # a later rung is summed only where none before it fits
    chosen = sized.withColumn("rung", F.coalesce(F.when(F.col("roomy"), 0), *(F.when(total(r) + 1 <= cap, i) for i, r in enumerate(rungs)), F.lit(len(rungs))))
    chosen = chosen.withColumns({f"k_{n}": limit(n, F.col("rung")) for n in (*LISTS, "text")})

    def strings(n: str) -> Column:
        return F.transform(F.slice(n, 1, F.col(f"k_{n}")), lambda s: clipped(s, F.col("k_text"))).alias(n)

    def place(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["line"].alias("line"), clipped(x["text"], F.col("k_text")).alias("text"))

    places = F.transform(F.slice("locations", 1, F.col("k_locations")), place).alias("locations")
    omitted = F.struct(*(left(n, F.col(f"k_{n}")).alias(n) for n in LISTS)).alias("omitted")
    minimal = F.col("rung") == len(rungs)
    lost = F.exists(F.array(*(F.size(n) > F.col(f"k_{n}") for n in LISTS)), lambda x: x)
    out = chosen.select("path", F.struct("path", "lang", strings("signatures"), strings("calls"), places, strings("external"), omitted).alias("record"), F.when(minimal, "minimal_record_after_size_cap").otherwise("compact_record_limits").alias("reason"), (minimal | lost).alias("truncated"), "whole_bytes")
    return cut(out.withColumn("json", F.to_json("record")))


def compact_evidence(seeds: DataFrame) -> DataFrame:
    """Evidence rows as the gate sees them: after compaction; calls stand in where there is no location."""
    places = seeds.select("path", F.col("record.lang").alias("lang"), F.explode("record.locations").alias("l")).select("path", "lang", "l.kind", "l.line", "l.text")
    calls = seeds.where(F.size("record.locations") == 0).select("path", F.col("record.lang").alias("lang"), F.explode("record.calls").alias("text"))
    return places.unionByName(calls.select("path", "lang", F.lit("call").alias("kind"), F.lit(None).cast("int").alias("line"), "text"))


def placed(rows: DataFrame, size: str, order: list[str], group: list[str]) -> DataFrame:
    """``start``: the sum of ``size`` over the group's rows before each, in order; a group may span all tasks.

    Rows are dealt into ranges in order; sums run within a range, and over the ranges of a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(rows.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*group, "part").agg(F.sum(size).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    start = F.coalesce(F.sum(size).over(within), F.lit(0)) + F.col("before")
    return ranges.join(sums, [*group, "part"]).withColumn("start", start).drop("part", "before")


#: Segments of the first level hold this many caps, those of a higher level this many of the level below.
SEGMENT = 64


def _segments(leaps: DataFrame, group: list[str], width: int) -> DataFrame:
    """Per segment of ``width`` bytes: its leaps in order, the place to which each leads, places led to from outside.

    ``leaps``: (group, start, next, hops), next the start of another leap or null.  A place is a position among the
    segment's leaps; one that leads out of the segment, or to nothing, leads behind the last.
    """
    of = lambda c: F.floor(F.col(c) / width)
    none = F.lit(None).cast("struct<start:bigint,next:bigint,hops:bigint>")
    stays = F.coalesce(of("next") == of("start"), F.lit(False))
    held = leaps.select(*group, of("start").alias("segment"), F.col("start").alias("at"), F.lit(0).alias("role"), F.struct("start", "next", "hops").alias("leap"))
    asked = leaps.select(*group, of("start").alias("segment"), F.when(stays, F.col("next")).otherwise(2**63 - 1).alias("at"), F.lit(1).alias("role"), F.struct("start", "next", "hops").alias("leap"))
    entered = leaps.where(~stays & F.col("next").isNotNull()).select(*group, of("next").alias("segment"), F.col("next").alias("at"), F.lit(2).alias("role"), none.alias("leap")).distinct()
    until = Window.partitionBy(*group, "segment").orderBy("at", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.when(F.col("role") == 0, 1)).over(until)
    rows = held.unionByName(asked).unionByName(entered).withColumn("place", (F.when(F.col("at") == 2**63 - 1, n).otherwise(n - 1)).cast("int"))
    lists = rows.groupBy(*group, "segment").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == 0, F.col("leap")))).alias("leaps"),
        F.sort_array(F.collect_list(F.when(F.col("role") == 1, F.struct("leap.start", "place")))).alias("to"),
        F.sort_array(F.collect_list(F.when(F.col("role") == 2, F.col("place")))).alias("entries"),
    )
    first = F.when(F.col("segment") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return cut(lists.select(*group, "segment", "leaps", F.col("to.place").alias("to"), F.array_union(first, "entries").alias("entries")))


def _steps() -> Column:
    """Enough steps to leave a segment: the next batch but one begins more than a cap behind a batch."""
    return F.sequence(F.lit(1), F.lit(2 * SEGMENT + 2))


def _leaving(segments: DataFrame, group: list[str]) -> DataFrame:
    """(group, start, next, hops): of each place at which a segment is entered, where it is left and after how many batches."""
    def step(a: Column, _: Column) -> Column:
        leap = F.get("leaps", a["place"])
        moved = F.struct(F.get("to", a["place"]).alias("place"), leap["next"].alias("next"), (a["hops"] + leap["hops"]).alias("hops"))
        return F.when(a["place"] < F.size("leaps"), moved).otherwise(a)

    zero = lambda e: F.struct(e.alias("place"), F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("hops"))
    left = F.transform("entries", lambda e: F.struct(F.get("leaps", e)["start"].alias("start"), F.aggregate(_steps(), zero(e), step).alias("a")))
    return segments.select(*group, F.explode(left).alias("l")).select(*group, "l.start", F.col("l.a.next").alias("next"), F.col("l.a.hops").alias("hops"))


def _visited(segments: DataFrame, known: DataFrame, group: list[str], width: int) -> DataFrame:
    """(group, start, batch) of the leaps that are taken in the segments that ``known`` enters, each at one place."""
    def step(a: Column, _: Column) -> Column:
        leap = F.get("leaps", a["place"])
        seen = F.concat(a["seen"], F.array(F.struct(leap["start"].alias("start"), a["batch"].alias("batch"))))
        moved = F.struct(F.get("to", a["place"]).alias("place"), (a["batch"] + leap["hops"]).alias("batch"), seen.alias("seen"))
        return F.when(a["place"] < F.size("leaps"), moved).otherwise(a)

    entry = F.filter("entries", lambda e: F.get("leaps", e)["start"] == F.col("start"))[0]
    zero = F.struct(entry.alias("place"), F.col("batch"), F.array().cast("array<struct<start:bigint,batch:bigint>>").alias("seen"))
    rows = segments.join(known.withColumn("segment", F.floor(F.col("start") / width)), [*group, "segment"])
    return rows.select(*group, F.explode(F.aggregate(_steps(), zero, step)["seen"]).alias("s")).select(*group, "s.start", "s.batch")


def bin_starts(records: DataFrame, group: list[str], cap: int) -> DataFrame:
    """(group, start, batch) of the records that open a batch, of (group, start, size) with sizes above 0.

    The batch that a record would open ends before the record that holds its start + cap (or its own end, if
    that is later), which a search within stretches of ``cap`` bytes finds: each has at most ``cap`` records.
    These next pointers are followed in segments of ``SEGMENT`` caps, from the places at which others lead into one,
    to where they leave it: a small part of the pointers, that leap a whole segment, and so on, level by level, until
    one segment holds a group.  Down the levels, the segments are walked from the one place at which each is entered.
    """
    end = F.col("start") + F.col("size")
    want = F.greatest(end, F.col("start") + cap)
    spans = F.explode(F.sequence(F.floor(F.col("start") / cap), F.floor((end - 1) / cap)))
    held = records.select(*group, spans.alias("stretch"), "start", F.struct(F.col("start").alias("start"), end.alias("end")).alias("holder"), F.lit(None).cast("long").alias("of"))
    asked = records.select(*group, F.floor(want / cap).alias("stretch"), want.alias("start"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("holder"), F.col("start").alias("of"))
    order = Window.partitionBy(*group, "stretch").orderBy("start", F.col("of").isNotNull())
    found = held.unionByName(asked).withColumn("next", F.last("holder", ignorenulls=True).over(order)).where("of is not null")
    leaps = cut(found.select(*group, F.col("of").alias("start"), F.when(F.col("next.end") > F.col("start"), F.col("next.start")).alias("next"), F.lit(1).cast("long").alias("hops")))
    last, width, levels = records.agg(F.max("start")).first()[0] or 0, cap * SEGMENT, []
    while True:
        levels.append((_segments(leaps, group, width), width))
        if last < width:
            break
        leaps, width = cut(_leaving(levels[-1][0], group)), width * SEGMENT
    known = records.where("start = 0").select(*group, "start", F.lit(0).cast("long").alias("batch"))
    for segments, width in reversed(levels):
        known = cut(_visited(segments, known, group, width))
    return known


def batches(rows: DataFrame, size: str, order: list[str], group: list[str], cap: int = X.SEED_CAP) -> DataFrame:
    """``batch``: greedy bins of at most ``cap`` bytes in order, a larger record alone; per group.

    No group is folded in one place: see ``placed`` and ``bin_starts``.  A record belongs to the last opener
    at or before it; an empty one never opens a batch, unless a too large record is just before it.
    """
    at = cut(placed(rows.select(*group, *order, size), size, order, group))
    full = at.where(F.col(size) > 0).select(*group, "start", F.col(size).cast("long").alias("size"))
    starts = bin_starts(full, group, cap)
    ends = at.groupBy(*group).agg(F.max(F.col("start") + F.col(size)).alias("end"))
    later = starts.select(*group, (F.col("batch") - 1).alias("batch"), F.col("start").alias("until"))
    spans = starts.join(later, [*group, "batch"], "left").join(ends, group).withColumn("until", F.coalesce("until", "end"))
    # a stretch of ``cap`` bytes meets a few batches
    spans = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / cap), F.floor(F.col("until") / cap))))
    spans = spans.groupBy(*group, "stretch").agg(F.collect_list(F.struct("start", "batch")).alias("openers"))
    out = at.withColumn("stretch", F.floor(F.col("start") / cap)).join(spans, [*group, "stretch"], "left")
    empty = F.col(size) == 0
    opener = F.array_max(F.filter("openers", lambda o: (o["start"] < F.col("start")) | (~empty & (o["start"] == F.col("start")))))
    over = empty & (F.col("start") - opener["start"] > cap)
    batch = F.when(opener.isNull(), 0).when(over, opener["batch"] + 1).otherwise(opener["batch"]).cast("long")
    return out.withColumn("batch", batch).select(*rows.select(*group, *order, size).columns, "batch")


def read_seeds(lines: DataFrame) -> DataFrame:
    """Records from seed lines (column ``value``): path is needed, other fields may lack; bad lines are dropped."""
    row = F.from_json("value", "path string, lang string, calls array<string>, external array<string>, locations array<struct<kind:string,line:int,text:string>>", {"mode": "PERMISSIVE"})
    rows = lines.select(row.alias("r")).where("r.path is not null").select("r.*")
    none = F.array().cast("array<string>")
    return rows.select("path", "lang", F.coalesce("calls", none).alias("calls"), F.coalesce("external", none).alias("external"), F.coalesce("locations", F.array().cast("array<struct<kind:string,line:int,text:string>>")).alias("locations"))


def seed_evidence(seeds: DataFrame) -> DataFrame:
    """Evidence rows of records read from seed lines; calls stand in where there is no location."""
    places = seeds.select("path", "lang", F.explode("locations").alias("l")).select("path", "lang", "l.kind", "l.line", "l.text")
    calls = seeds.where(F.size("locations") == 0).select("path", "lang", F.explode("calls").alias("text"))
    return places.unionByName(calls.select("path", "lang", F.lit("call").alias("kind"), F.lit(None).cast("int").alias("line"), "text"))


def observation_bytes(found: DataFrame, batch: str = "batch") -> DataFrame:
    """Bytes of the findings of each batch as an indented JSON array: what a planned request observes."""
    def text(c: Column) -> Column:
        return F.octet_length(F.to_json(F.array(c))) - 2

    fields = {"severity": text(F.col("severity")), "path": text(F.col("path")), "line": F.octet_length(F.coalesce(F.col("line").cast("string"), F.lit("null"))), "rule": text(F.col("rule")), "title": text(F.col("title")), "evidence": text(F.col("evidence"))}
    # a field: four blanks, its name in quotes, colon, blank, value, comma (not the last), line feed;
    # an object: indented braces, a line feed, and comma and line feed behind it
    size = sum((v + len(k) + 10 for k, v in fields.items()), F.lit(0)) - 1 + 4 + 3 + 2
    return found.groupBy(batch).agg((F.sum(size) - 2 + 4).cast("long").alias("bytes"))


def merged_reports(reports: DataFrame) -> DataFrame:
    """Distinct table rows, in order, of the batches' Markdown reports (column ``markdown``)."""
    rows = reports.select(F.explode(F.split("markdown", "\n")).alias("row")).select(F.btrim("row").alias("row")).where(F.startswith("row", F.lit("|")) & ~F.contains("row", F.lit("---")) & ~F.contains("row", F.lit("Severity")) & ~F.contains("row", F.lit("严重性")))
    return rows.distinct().orderBy("row")


def tokens_of(n_bytes: Column) -> Column:
    return F.floor((n_bytes + 3) / 4).cast("long")


def cost(tokens: Column, per_million: float | None) -> Column:
    return F.lit(None).cast("double") if per_million is None else tokens / 1e6 * per_million


def rule_sets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per case: verdict as expected, rules missed and rules not expected; a case passes without misses."""
    both = expected.join(actual.select("name", F.col("verdict").alias("actual_verdict"), F.col("rules").alias("actual_rules")), "name", "left")
    got = F.coalesce("actual_rules", F.array().cast("array<string>"))
    out = both.withColumns({"missed": F.array_sort(F.array_except("rules", got)), "unexpected": F.array_sort(F.array_except(got, "rules"))})
    return out.withColumn("passed", F.coalesce(F.col("verdict") == F.col("actual_verdict"), F.lit(False)) & (F.size("missed") == 0))
