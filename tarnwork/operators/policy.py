"""Project policy on findings and artifacts: allow, deny, override, then the cap of the scope.

A policy is a relation of rules, of any number: findings meet the rules whose path they may hold by a
join on trigrams, and the rules that hit are folded in their order.
"""

from __future__ import annotations

import collections
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import normal_path
from .paths import capped, scope


class PolicyError(ValueError):
    """A policy that cannot be used; exit status 2."""


@dataclass(frozen=True)
class Rule:
    path: str | None = None
    rule: str | None = None
    reason: str | None = None
    severity: str | None = None

    @property
    def said(self) -> str:
        return f" ({self.reason})" if self.reason and self.reason.strip() else ""


@dataclass(frozen=True)
class Policy:
    allow: list[Rule] = field(default_factory=list)
    deny: list[Rule] = field(default_factory=list)
    override: list[Rule] = field(default_factory=list)
    max_candidate_files: int | None = None


def parse(text: str) -> Policy:
    """From TOML; unknown keys, wrong types and rules that name neither path nor rule are errors."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PolicyError(str(e)) from e
    if extra := set(raw) - {"max_candidate_files", "allowlist", "denylist", "severity_override"}:
        raise PolicyError(f"unknown key {sorted(extra)[0]}")
    limit = raw.get("max_candidate_files")
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 0):
        raise PolicyError("max_candidate_files must be a whole number")
    out: dict[str, list[Rule]] = {}
    for name in ("allowlist", "denylist", "severity_override"):
        entries = raw.get(name, [])
        if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
            raise PolicyError(f"{name} must be an array of tables")
        allowed = {"path", "rule", "reason"} | ({"severity"} if name == "severity_override" else set())
        for e in entries:
            if set(e) - allowed or not all(isinstance(v, str) for v in e.values()):
                raise PolicyError(f"bad entry in {name}")
            if not e.get("path") and not e.get("rule"):
                raise PolicyError(f"{name} entry needs path or rule")
            if name == "severity_override" and e.get("severity") not in X.SEVERITIES:
                raise PolicyError("severity must be high, medium or low")
        out[name] = [Rule(**e) for e in entries]
    return Policy(out["allowlist"], out["denylist"], out["severity_override"], limit)


ALLOW, DENY, OVERRIDE = range(3)
#: Policy rules that are sent to all tasks; more are dealt by key.
BROADCAST_RULES = 10_000
_HIT = "struct<list:int,n:int,severity:string,said:string>"


def _trigrams(path: str) -> list[str]:
    return [path[i : i + 3] for i in range(len(path) - 2)]


def _keyed(policy: Policy) -> list[tuple]:
    """(key, list, n, path, rule, severity, said): each rule under the trigram of its path that the fewest rules
    have; rules without one under ''."""
    lists = ((ALLOW, policy.allow), (DENY, policy.deny), (OVERRIDE, policy.override))
    rules = [(i, n, r.path.replace("\\", "/") if r.path is not None else "", r) for i, rules in lists for n, r in enumerate(rules)]
    common = collections.Counter(t for _, _, path, _ in rules for t in {*_trigrams(path)})
    return [(min(_trigrams(path), key=lambda t: (common[t], t), default=""), i, n, path, r.rule, r.severity, r.said) for i, n, path, r in rules]


def rule_hits(subjects: DataFrame, policy: Policy) -> DataFrame:
    """Subjects (path, tags, more columns) that rules hit, with ``hits`` in the order of the policy.

    A rule can only hit paths that hold its trigram: an equi-join of the paths' distinct trigrams with the
    rules' keys, then the exact test.  The plan has the same size for any number of rules.
    """
    spark = subjects.sparkSession
    rows = _keyed(policy)
    rules = spark.createDataFrame(rows, "key string, list int, n int, part string, rule string, severity string, said string")
    rules = F.broadcast(rules) if len(rows) <= BROADCAST_RULES else rules
    path = normal_path(F.col("path"))
    trigrams = F.when(F.char_length(path) > 2, F.transform(F.sequence(F.lit(1), F.char_length(path) - 2), lambda i: F.substring(path, i, F.lit(3))))
    keys = F.array_union(F.array(F.lit("")), F.coalesce(trigrams, F.array().cast("array<string>")))
    met = subjects.withColumn("key", F.explode(keys)).join(rules.withColumnRenamed("rule", "tag"), "key")
    met = met.where((F.col("tag").isNull() | F.array_contains("tags", F.col("tag"))) & F.contains(path, F.col("part")))
    return met.groupBy(*subjects.columns).agg(F.array_sort(F.collect_list(F.struct("list", "n", "severity", "said"))).alias("hits"))


def _first(list_: int) -> Column:
    """What the first rule of a list says, null if none hits."""
    return F.get(F.filter("hits", lambda h: h["list"] == list_), F.lit(0))["said"]


def judged(findings: DataFrame, policy: Policy) -> DataFrame:
    """Findings with ``severity`` after policy, ``suppressed`` and ``action`` (null: nothing changed).

    Every distinct (path, rule) meets the policy once; the rules that hit it are folded in their order.
    """
    subjects = findings.select("path", "rule").distinct().withColumn("tags", F.array("rule"))
    out = findings.join(rule_hits(subjects, policy).drop("tags"), ["path", "rule"], "left").withColumn("hits", F.coalesce("hits", F.array().cast(f"array<{_HIT}>")))
    where = F.concat(F.col("rule"), F.lit(" at "), F.col("path"))
    allow = F.concat(F.lit("suppressed "), where, F.lit(" by allowlist"), _first(ALLOW))
    denied = _first(DENY)
    raised = F.struct(F.lit("high").alias("severity"), F.concat(F.lit("raised "), where, F.lit(" to high by denylist"), denied).alias("asked"))
    as_found = F.struct(F.col("severity").alias("severity"), F.lit(None).cast("string").alias("asked"))
    start = F.when(denied.isNotNull() & (F.col("severity") != "high"), raised).otherwise(as_found)

    def override(state: Column, h: Column) -> Column:
        said = F.concat(F.lit("set "), where, F.lit(" severity to "), h["severity"], F.lit(" by override"), h["said"])
        return F.when(state["severity"] != h["severity"], F.struct(h["severity"].alias("severity"), said.alias("asked"))).otherwise(state)

    out = out.withColumns({"_allow": allow, "_state": F.aggregate(F.filter("hits", lambda h: h["list"] == OVERRIDE), start, override)})
    wanted, final = F.col("_state.severity"), capped(F.col("_state.severity"), F.col("path"))
    held = F.concat(F.lit("held "), where, F.lit(" at "), final, F.lit(": "), scope(F.col("path")), F.lit(" paths are capped (policy asked for "), wanted, F.lit(")"))
    action = F.when(F.col("_allow").isNotNull(), F.col("_allow")).when(wanted == F.col("severity"), F.lit(None).cast("string")).when(final == wanted, F.col("_state.asked")).otherwise(held)
    out = out.withColumns({"action": action, "suppressed": F.col("_allow").isNotNull(), "severity_before": F.col("severity")})
    out = out.withColumn("severity", F.when(F.col("suppressed"), F.col("severity")).otherwise(final))
    return out.select(*findings.columns, "action", "suppressed", "severity_before")


def artifacts_left(artifacts: DataFrame, policy: Policy) -> DataFrame:
    """Artifacts with ``action`` if the allowlist suppresses them; a rule may name any one tag."""
    subjects = artifacts.select("path", "reason").distinct().withColumn("tags", F.split("reason", ","))
    hits = rule_hits(subjects, Policy(allow=policy.allow)).drop("tags")
    said = F.concat(F.lit("suppressed artifact "), F.col("reason"), F.lit(" at "), F.col("path"), F.lit(" by allowlist"), _first(ALLOW))
    return artifacts.join(hits, ["path", "reason"], "left").withColumn("action", said).select(*artifacts.columns, "action")
