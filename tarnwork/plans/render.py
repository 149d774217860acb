"""Reports: JSON documents, text lines and Markdown tables.

Large outputs stay DataFrames (``jsonl``, text lines) and are written by the executors; the reports
for people are small by construction (limits, top k) and are put together on the driver.
"""

from __future__ import annotations

import io
import uuid
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators.paths import scope
from ..sources.report_file import STEM, claim, save_rows, utc_day

EMPTY_LEDGER = "No deterministic risks found in the analyzed input. Review coverage, runtime behavior, configuration, and cross-module semantics manually."
#: Headings and cell words of the ledger by language.
WORDS = {
    "en": {"title": "# Risk Ledger", "head": "| Severity | Scope | Location | Rule | Finding |", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "empty": EMPTY_LEDGER},
    "zh": {"title": "# 风险账本", "head": "|严重性|作用域|位置|规则|发现|", "high": "高", "medium": "中", "low": "低", "empty": "已分析输入中未发现确定性风险。请人工复核覆盖率、运行时行为、配置和跨模块语义。",
           "production": "生产", "ci": "CI", "test": "测试", "fixture": "夹具", "docs": "文档"},
}


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON document per row; null fields are left out."""
    df.write.json(path)


def escaped(c):
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def ledger_rows(found: DataFrame, language: str = "en") -> DataFrame:
    """Findings as Markdown table rows, in the order of ``found``."""
    w = WORDS[language]
    severity = F.create_map(*(F.lit(x) for s in X.SEVERITIES for x in (s, w[s])))[F.col("severity")]
    where = scope(F.col("path"))
    words = F.coalesce(F.create_map(*(F.lit(x) for s in X.SCOPES for x in (s, w.get(s, s))))[where], where)
    at = F.when(F.col("line").isNotNull(), F.concat("path", F.lit(":"), F.col("line").cast("string"))).otherwise(F.col("path"))
    return found.select(F.concat(F.lit("| "), severity, F.lit(" | "), words, F.lit(" | `"), escaped(at), F.lit("` | `"), escaped(F.col("rule")), F.lit("` | "), escaped(F.col("title")), F.lit(": `"), escaped(F.col("evidence")), F.lit("` |")).alias("row"))


def ledger(found: DataFrame, language: str = "en") -> str:
    """The Markdown ledger of a small result as a string; ``write_ledger`` has no such bound."""
    out = io.StringIO()
    write_ledger(out, found, language)
    return out.getvalue()


def entry_line(entries: DataFrame) -> DataFrame:
    """Ledger entries as text lines."""
    line = F.coalesce(F.col("line").cast("string"), F.lit("-"))
    return entries.select("*", F.concat("path", F.lit(":"), line, F.lit(": "), "confidence", F.lit(" "), "trigger", F.lit(" "), "evidence", F.lit(" "), "scope", F.lit(": "), "text").alias("out"))


def gate_text(verdict: dict, why: list[str], blockers: list[str], truncated: list[str] = (), artifacts: list[str] = ()) -> str:
    """The gate's text up to the policy's actions, of which there may be any number: see write_gate_text."""
    out = [f"VERDICT: {verdict['verdict']}", "WHY:", *(f"- {x}" for x in why), "BLOCKERS:", *(f"- {x}" for x in blockers or ["none"]), f"SAFE_TO_AGENT_RUN: {'yes' if verdict['safe_to_agent_run'] else 'no'}", "", "COVERAGE:"]
    names = ("candidate_files", "dehydrated_files", "unsupported_files", "read_failed", "parse_failed", "serialization_failed", "record_truncated", "seed_bytes")
    out += [f"- {n}: {verdict[n]}" for n in names]
    for head, items in (("TRUNCATED_RECORDS:", truncated), ("ARTIFACTS:", artifacts)):
        out += [head, *(f"- {x}" for x in items)] if items else []
    return "\n".join(out) + "\n"


def write_gate_text(out: IO[str], gate) -> None:
    """The text of a gate's outcome, every action of the policy in the order of the ledger, one at a time."""
    out.write(gate.more["text"])
    for i, r in enumerate(gate.more["actions"].toLocalIterator()):
        out.write("POLICY:\n" * (i == 0) + f"- {r.action}\n")


def write_ledger(out: IO[str], found: DataFrame, language: str = "en") -> None:
    """The Markdown ledger, a row at a time."""
    w, n = WORDS[language], 0
    out.write(f"{w['title']}\n\n")
    for n, r in enumerate(ledger_rows(found, language).toLocalIterator(), 1):
        out.write((f"{w['head']}\n|---|---|---|---|---|\n" if n == 1 else "") + f"{r.row}\n")
    if not n:
        out.write(f"{w['empty']}\n")


def save_ledger(found: DataFrame, folder: str, day: str | None = None, language: str = "en", stem: str = STEM) -> None:
    """The Markdown ledger as the day's next report, its rows written by the executors."""
    w = WORDS[language]
    table = ledger_rows(found, language)
    head = f"{w['title']}\n\n"
    if table.limit(1).count():
        head += f"{w['head']}\n|---|---|---|---|---|\n"
    save_rows(table, folder, day=day or utc_day(), stem=stem, head=head, none=f"{w['empty']}\n")


def save_report(text: str, folder: str, day: str | None = None, stem: str = STEM) -> Path:
    """``<stem>-<day>-NNN.md`` with the next free number of that day (default: today in UTC)."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    done = top / f".{stem}-{uuid.uuid4().hex}"
    done.write_text(text, encoding="utf-8")
    return claim(done, top, day or utc_day(), stem)
