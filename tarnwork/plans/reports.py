"""Version 1 reports of query, surface, diff, gate, benchmark and eval corpus.

The head of a report is a one-row DataFrame of counts; its rows stay a DataFrame and are written one
after the other, so a report of any length takes the driver one row of memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import IO, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import query as Q
from ..operators import rules as R
from ..operators import seed as S
from ..operators import surface as C
from ..session import cut


def coverage(files: DataFrame) -> DataFrame:
    """One row: candidate, scanned and unsupported files, failures, over rows with ``status``."""
    n = {"scanned_files": "dehydrated", "unsupported_files": "unsupported", "read_failed": "read_failed", "parse_failed": "parse_failed"}
    return files.agg(F.count("*").alias("candidate_files"), *(F.count_if(F.col("status") == v).alias(k) for k, v in n.items()))


def query_head(found: DataFrame, limit: int) -> DataFrame:
    """One row: files and evidence that match, evidence shown, whether that is less."""
    rows = found.agg(F.count_distinct("path").alias("matched_files"), F.count("kind").alias("matched_evidence"))
    shown = F.least("matched_evidence", F.lit(limit).cast("long")) if limit else F.col("matched_evidence")
    return rows.select("*", shown.alias("shown_evidence"), (shown < F.col("matched_evidence")).alias("truncated"))


def surface_head(entries: DataFrame, scopes=None, capabilities=None, limit: int = 200) -> DataFrame:
    """One row: entries that are selected and shown, counts by capability and by hidden scope."""
    chosen = C.selected(entries, scopes, capabilities)
    pairs = lambda df, key: df.agg(F.array_sort(F.collect_list(F.struct(key, "n"))).alias("p")).select(F.map_from_entries("p").alias("p"))
    counts, hidden = pairs(C.counts(chosen), "capability"), pairs(C.hidden_by_scope(entries, scopes), "scope")
    total = chosen.agg(F.count("*").alias("entries_total"))
    shown = F.least("entries_total", F.lit(limit).cast("long")) if limit else F.col("entries_total")
    head = total.crossJoin(counts.withColumnRenamed("p", "counts")).crossJoin(hidden.withColumnRenamed("p", "hidden_by_scope"))  # one row each
    return head.select("entries_total", shown.alias("entries_shown"), (shown < F.col("entries_total")).alias("truncated"), "counts", "hidden_by_scope")


def diff_head(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("side") == "added").alias("added"), F.count_if(F.col("side") == "removed").alias("removed"))


def batched_findings(seeds: DataFrame, cap: int = X.SEED_CAP) -> tuple[DataFrame, DataFrame]:
    """(findings with ``batch``, batch numbers): the rules over each batch of compacted records on its own.

    Records are batched by their bytes in the order of paths.  A batch is a tree to the rules: a manifest whose
    lockfile is in another batch has none, and equal findings of two batches count twice.
    """
    sizes = seeds.select(F.lit(0).alias("tree"), "path", (F.octet_length("json") + 1).alias("bytes"))
    numbers = cut(S.batches(sizes, "bytes", ["path"], ["tree"], cap).select("path", "batch"))
    marked = cut(seeds.join(numbers, "path").select(F.concat(F.col("batch").cast("string"), F.lit("/"), "path").alias("path"), "record"))  # read by each kind of rule
    external = marked.select("path", F.explode("record.external").alias("text"))
    found = R.findings(S.compact_evidence(marked), external, marked.select("path"), F.substring_index("path", "/", 1))
    batch = F.substring_index("path", "/", 1)
    own = F.substring("path", F.char_length(batch) + 2, F.char_length("path"))
    return found.withColumns({"batch": batch.cast("long"), "path": own}), numbers.select("batch").distinct()


def planned_prompts(found: DataFrame, batches: DataFrame, language: str = "en") -> DataFrame:
    """One row: requests and bytes of the prompts that the batches would send, one each.

    ``found``: findings with ``batch``; ``batches``: distinct batch numbers, those without findings too.
    """
    sizes = batches.join(S.observation_bytes(found), "batch", "left").select(F.coalesce("bytes", F.lit(2)).alias("bytes"))  # []
    return sizes.agg(F.count("*").alias("planned_requests"), F.coalesce(F.sum(F.col("bytes") + X.PROMPT_BYTES[language]), F.lit(0)).cast("long").alias("planned_prompt_bytes"))


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def write(out: IO[str], head: dict[str, Any], **rows: Iterable[dict] | DataFrame) -> None:
    """A JSON document: the fields of ``head``, then one array of objects for each of ``rows``."""
    out.write(json.dumps({"schema_version": X.REPORT_VERSION, **head}, ensure_ascii=False)[:-1])
    for name, items in rows.items():
        out.write(f", {json.dumps(name)}: [")
        docs = (r[0] for r in items.select(F.to_json(F.struct("*"))).toLocalIterator()) if isinstance(items, DataFrame) else (json.dumps(x, ensure_ascii=False) for x in items)
        for i, doc in enumerate(docs):
            out.write(",\n" * bool(i) + doc)
        out.write("]")
    out.write("}\n")


def write_query(out: IO[str], filters: Q.Filters, files: DataFrame, found: DataFrame, limit: int = 200) -> None:
    """Matches by file in walk order; evidence beyond the limit is counted, not shown."""
    given = {k: v for k, v in filters.__dict__.items() if v is not None}
    shown = Q.limited(found, limit)
    order = F.struct(F.coalesce("line", F.lit(0)).alias("o"), "kind", "text", "line")
    evidence = found.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), order))).alias("e"))
    rows = shown.join(evidence, "path").select("path", "lang", F.transform(F.slice("e", F.lit(1), F.col("n_shown").cast("int")), lambda x: F.struct(x["kind"].alias("kind"), x["line"].alias("line"), x["text"].alias("text"))).alias("evidence"))
    write(out, {"query": given, "coverage": _one(coverage(files)), **_one(query_head(found, limit))}, matches=rows.orderBy("path"))


def write_surface(out: IO[str], root: str, files: DataFrame, entries: DataFrame, scopes=None, capabilities=None, limit: int = 200) -> None:
    rows = C.ranked(C.selected(entries, scopes, capabilities))
    write(out, {"root": root, **_one(surface_head(entries, scopes, capabilities, limit)), "coverage": _one(coverage(files))}, entries=rows.limit(limit) if limit else rows)


def write_diff(out: IO[str], a: tuple[str, int], b: tuple[str, int], rows: DataFrame) -> None:
    """a, b: root and number of entries of either side."""
    sides = {n: {"root": root, "entries": entries} for n, (root, entries) in (("a", a), ("b", b))}
    one = lambda side: C.ranked(rows.where(F.col("side") == side).drop("side"))
    write(out, {**sides, **_one(diff_head(rows))}, added_entries=one("added"), removed_entries=one("removed"))


def write_gate(out: IO[str], gate) -> None:
    """``gate``: the outcome of ``audit.gate``; the lists of coverage follow its counts."""
    row, more = dict(gate.more["verdict"]), gate.more
    names = ("candidate_files", "dehydrated_files", "read_failed", "unsupported_files", "parse_failed", "serialization_failed", "record_truncated", "seed_bytes")
    head = {"verdict": row["verdict"], "safe_to_agent_run": row["safe_to_agent_run"], "exit_reason": row["verdict"].lower(), "why": more["why"], "blockers": more["blockers"], "coverage": {n: row[n] for n in names}}
    actions = (r[0] for r in more["actions"].toLocalIterator())
    columns = ["severity", "path", "line", "rule", "title", "evidence"]
    write(out, head, findings=gate.rows.select(*columns), policy_actions=actions, suspicious_artifacts=more["artifacts"].drop("action"), truncated_records=more["truncated"])


def write_eval(out: IO[str], rows: DataFrame) -> None:
    n = _one(rows.agg(F.count("*").alias("fixture_count"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed")))
    write(out, n, rows=rows.orderBy("fixture"))


def benchmark(root: str, gate, planned: DataFrame, wall_clock_ms: int, max_bytes: int = X.MAX_BYTES, cap: int = X.SEED_CAP, output_tokens: int = 0, costs: tuple[float | None, float | None] = (None, None)) -> dict[str, Any]:
    """The benchmark document of a gate run: scan, seed, planned prompts, tokens and their cost; no model is called."""
    row, plan = dict(gate.more["verdict"]), _one(planned)
    tokens = (plan["planned_prompt_bytes"] + 3) // 4
    price = [None if c is None else n / 1e6 * c for n, c in zip((tokens, output_tokens), costs, strict=True)]
    names = ("candidate_files", "dehydrated_files", "unsupported_files", "read_failed", "parse_failed", "serialization_failed")
    shown = lambda df: [json.loads(x) for x in df.limit(20).toJSON().collect()]  # noqa: E731  twenty rows
    return {
        "schema_version": X.REPORT_VERSION,
        "repo": {"path": root, "name": root.rstrip("/").rpartition("/")[2]},
        "scan": {n: row[n] for n in names} | {"wall_clock_ms": wall_clock_ms, "max_file_bytes": max_bytes},
        "seed": {"records_sent": row["dehydrated_files"], "bytes_sent": row["seed_bytes"], "seed_cap_bytes": cap, "reduce_batches": plan["planned_requests"], "record_truncated": row["record_truncated"], "truncated_records": shown(gate.more["truncated"]), "suspicious_artifacts": shown(gate.more["artifacts"].drop("action"))},
        "tokens": {"estimated_input_tokens": tokens, "estimated_output_tokens": output_tokens, **plan},
        "cost": {"currency": "USD", "configured": None not in costs, "input_per_million": costs[0], "output_per_million": costs[1], "estimated_input_cost": price[0], "estimated_output_cost": price[1], "estimated_total_cost": None if None in price else sum(price)},
    }
