"""The risk ledger: 24 rules over evidence rows.

Evidence is (path, lang, kind, line, text).  Text is lower-cased once; lines that no rule token can
touch are left out by one regular expression before the exact predicates run; every predicate is one
entry of an array of findings that is inlined.  File-level facts (a workflow with secrets, a container
file without USER) are one aggregation per path; manifests without lockfile are one aggregation over
the distinct manifest paths, a few values wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_of, ascii_lower, contains_any, eval_invoked, is_file, lstrip, normal_path, redacted, shortest, spelled, strip
from .paths import capped, is_container_file, is_manifest, is_workflow, scope, severity_rank

COLUMNS = ["severity", "path", "line", "rule", "title", "evidence"]
_META = {rule: (severity, title, i) for i, (rule, severity, title) in enumerate(X.RULES)}


def prefilter(text: Column) -> Column:
    """A superset of the lines on which some rule of a line can fire, in one pass over the text."""
    tokens = {*X.DOWNLOADS, "base64", "eval", "bash -c", *X.SSH_PATHS, *X.BUILD_COMMANDS, *X.SETUP_COMMANDS, *X.SECRETS, "run:", "uses:", "pull_request_target", "write-all", *X.REPOSITORIES, "apk add", "user root", *X.PRIVILEGED, *X.GIT_SOURCES, "http://", "https://", *X.PATH_SOURCES, ".unwrap", ".expect", "panic", "unsafe ", "from .", *(f'"{k}"' for k in X.LIFECYCLE)}
    return ascii_lower(text).rlike(spelled(shortest(tokens)))


def _finding(rule: str, when: Column, evidence: Column) -> Column:
    severity, title, seq = _META[rule]
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(title).alias("title"), evidence.alias("evidence"), F.lit(seq).alias("rule_seq")))


def download_execute(low: Column) -> Column:
    return contains_any(low, X.DOWNLOADS) & contains_any(low, X.EXECUTE_SINKS)


def home_write(low: Column) -> Column:
    return contains_any(low, X.SSH_PATHS) & contains_any(low, X.WRITE_OPS)


def base64_execute(low: Column) -> Column:
    return F.contains(low, F.lit("base64")) & contains_any(low, X.DECODE_FLAGS) & contains_any(low, X.DECODE_SINKS)


def lifecycle(text: Column) -> Column:
    return contains_any(text, [f'"{k}"' for k in X.LIFECYCLE]) & F.contains(text, F.lit(":"))


def line_findings(e: DataFrame) -> DataFrame:
    """Rules that one line decides, given its file's workflow flag."""
    # lines with a secret pass the filter, so the file's flag is found among the lines that are left
    # lines of other files need no flag, and are not sorted by file for one
    rows = e.withColumn("flow", F.coalesce(is_workflow(F.col("path")), F.lit(False)))
    low = ascii_lower(F.col("text"))
    flag = F.max(contains_any(low, X.SECRETS)).over(Window.partitionBy("path"))
    passed = prefilter(F.col("text"))
    rows = rows.where(F.col("flow") & passed).withColumn("file_secret", flag).unionByName(rows.where(~F.col("flow") & passed).withColumn("file_secret", F.lit(False)))
    rows = rows.withColumns({"low": low, "docker": is_container_file(F.col("path")), "manifest": is_manifest(F.col("path")) & F.col("line").isNotNull()})
    t, low, flow, docker, kind = (F.col(c) for c in ("text", "low", "flow", "docker", "kind"))
    path = normal_path(F.col("path"))
    run = F.startswith(lstrip(t), F.lit("run:"))
    coupled = contains_any(low, X.SECRETS) & (run | contains_any(low, X.SECRET_SHELLS))
    tainted = F.col("file_secret") & run & contains_any(low, X.UNTRUSTED)
    registry = contains_any(low, X.REGISTRIES)
    panics = (F.contains(t, F.lit(".unwrap")) & ~F.contains(t, F.lit(".unwrap_or"))) | F.contains(t, F.lit(".expect"))
    explicit = F.contains(t, F.lit("panic")) & F.contains(t, F.lit("!"))
    call = kind == "call"
    repository = contains_any(low, X.REPOSITORIES) | (F.contains(low, F.lit("apk add")) & F.contains(low, F.lit("--repository")))
    manifest, safe = F.col("manifest"), redacted(t, X.EVIDENCE_CHARS)
    # Lines of records without locations are calls that have no line: manifest rules read locations only.
    when = {
        "npm-lifecycle-script": is_file(path, ["package.json"]) & lifecycle(t),
        "rust-build-script-command": is_file(path, ["build.rs"]) & contains_any(low, X.BUILD_COMMANDS),
        "python-setup-command": is_file(path, ["setup.py"]) & contains_any(low, X.SETUP_COMMANDS),
        "download-execute": download_execute(low),
        "install-home-write": home_write(low),
        "base64-execute": base64_execute(low),
        "dynamic-shell-eval": eval_invoked(low) | contains_any(low, ["eval(", "bash -c"]),
        "workflow-secret-shell": flow & (coupled | tainted),
        "unpinned-github-action": flow & F.startswith(lstrip(t), F.lit("uses:")) & ~strip(F.regexp_extract(t, r"^[^@]*@([\s\S]*)$", 1)).rlike("^[0-9A-Fa-f]{40}$"),
        "workflow-pull-request-target": flow & F.contains(low, F.lit("pull_request_target")),
        "workflow-write-all": flow & F.contains(low, F.lit("permissions: write-all")),
        "docker-remote-repository": docker & repository & contains_any(low, X.REPOSITORY_URLS),
        "docker-root-user": docker & F.startswith(lstrip(low), F.lit("user root")),
        "container-privileged": contains_any(low, X.PRIVILEGED),
        "panic-edge": call & panics,
        "explicit-panic": call & ~panics & explicit,
        "subprocess-boundary": call & ~panics & ~explicit & F.contains(t, F.lit("std::process::Command")),
        "unsafe-surface": (kind == "signature") & F.startswith(lstrip(t), F.lit("unsafe ")),
        "external-blackbox": (kind == "import") & F.startswith(lstrip(t), F.lit("from .")),
        "dependency-git-source": manifest & contains_any(low, X.GIT_SOURCES) & ~registry,
        "dependency-http-source": manifest & contains_any(low, ["http://", "https://"]) & ~registry,
        "dependency-path-source": manifest & contains_any(low, X.PATH_SOURCES),
    }
    cleaned = {"npm-lifecycle-script", "workflow-secret-shell", "unpinned-github-action"} | {r for r in when if r.startswith("dependency-")} | _CLEANED
    found = F.array_compact(F.array(*(_finding(r, w, safe if r in cleaned else t) for r, w in when.items())))
    return rows.select("path", "line", F.inline(found))


#: Rules whose evidence is shortened and stripped of secret names.
_CLEANED = {r for r, _, _ in X.RULES[:14]}


def external_findings(external: DataFrame) -> DataFrame:
    """(path, text) of imports that lead out of the tree."""
    severity, title, seq = _META["external-blackbox"]
    text = F.regexp_replace("text", r"^(?:\[EXTERNAL_BLACKBOX\] )+", "")
    return external.select("path", F.lit(None).cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit("external-blackbox").alias("rule"), F.lit(title).alias("title"), text.alias("evidence"), F.lit(seq).alias("rule_seq"))


def lockfile_facts(paths: DataFrame, *keys: str) -> DataFrame:
    """Of each ``keys`` value: the first manifest of every ecosystem, and whether it has a lockfile.  Also on a stream."""
    low = ascii_lower(normal_path(F.col("path")))
    exprs = []
    for i, (manifests, locks, _) in enumerate(X.ECOSYSTEMS):
        firsts = [F.min(F.when(is_file(low, [m]), low)) for m in manifests]
        exprs += [F.coalesce(*firsts, F.lit(None).cast("string")).alias(f"manifest{i}"), F.coalesce(F.bool_or(is_file(low, locks)), F.lit(False)).alias(f"lock{i}")]
    return paths.where(is_manifest(F.col("path"))).groupBy(*keys).agg(*exprs)


def lockless(facts: DataFrame, *keys: str) -> DataFrame:
    """Findings of the manifests without lockfile."""
    severity, title, seq = _META["manifest-missing-lockfile"]
    found = F.array_compact(F.array(*(F.when(F.col(f"manifest{i}").isNotNull() & ~F.col(f"lock{i}"), F.struct(F.col(f"manifest{i}").alias("path"), F.lit(e).alias("evidence"))) for i, (_, _, e) in enumerate(X.ECOSYSTEMS))))
    rows = facts.select(*keys, F.inline(found))
    return rows.select(*keys, "path", F.lit(None).cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit("manifest-missing-lockfile").alias("rule"), F.lit(title).alias("title"), "evidence", F.lit(seq).alias("rule_seq"))


def missing_lockfiles(paths: DataFrame, tree: str | None = None) -> DataFrame:
    """Ecosystems with a manifest but no lockfile, over all paths (of each ``tree`` value, if named)."""
    keys = [tree] if tree else []
    return lockless(lockfile_facts(paths, *keys), *keys)


def container_facts(e: DataFrame, *keys: str) -> DataFrame:
    """Of each container file: ``set``, whether some line sets a user or starts from scratch.  Also on a stream."""
    low = lstrip(ascii_lower(F.col("text")))
    return e.where(is_container_file(F.col("path"))).groupBy(*keys, "path").agg(F.bool_or(F.coalesce(F.startswith(low, F.lit("user ")) | F.startswith(low, F.lit("from scratch")), F.lit(False))).alias("set"))


def rootful(facts: DataFrame, *keys: str) -> DataFrame:
    """Findings of the container files that set no user."""
    severity, title, seq = _META["docker-default-root"]
    return facts.where(~F.col("set")).select(*keys, "path", F.lit(None).cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit("docker-default-root").alias("rule"), F.lit(title).alias("title"), F.lit("no USER directive").alias("evidence"), F.lit(seq).alias("rule_seq"))


def default_root(e: DataFrame) -> DataFrame:
    """Container files in which no line sets a user and none starts from scratch."""
    return rootful(container_facts(e))


def ledger(rows: DataFrame) -> DataFrame:
    """Findings capped by scope and distinct in (path, line, rule, evidence)."""
    severity, rule, title = (F.get(F.array(*(F.lit(x) for x in values)), F.col("rule_seq")) for values in zip(*((s, r, t) for r, s, t in X.RULES), strict=True))
    # a rule's number says its name, title and severity: no more is shuffled or compared
    out = rows.select("path", "line", "evidence", "rule_seq").distinct()
    return out.withColumns({"severity": capped(severity, F.col("path")), "rule": rule, "title": title}).select(*COLUMNS, "rule_seq")


def findings(evidence: DataFrame, external: DataFrame | None = None, files: DataFrame | None = None, tree: Column | None = None) -> DataFrame:
    """All findings, capped by scope and distinct in (path, line, rule, evidence).

    ``files``: the paths that count as present (default: those with evidence); a container file
    without any evidence still has no USER line.  ``tree``: of a path, where several trees are judged at
    once, each with its own lockfiles.
    """
    present = files if files is not None else evidence
    locks = missing_lockfiles(present) if tree is None else missing_lockfiles(present.select("path", tree.alias("tree")), "tree").drop("tree")
    parts = [line_findings(evidence), locks]
    containers = evidence.select("path", "text")
    if files is not None:
        containers = containers.unionByName(files.select("path", F.lit("").alias("text")))
    parts.append(default_root(containers))
    if external is not None:
        parts.append(external_findings(external))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ledger(out)


def ranked(found: DataFrame) -> DataFrame:
    """Ledger order: severity, path, line (none first), rule, order of report."""
    return found.orderBy(severity_rank(F.col("severity")), "path", F.asc_nulls_first("line"), "rule", "rule_seq", "evidence")


def with_scope(found: DataFrame) -> DataFrame:
    return found.withColumn("scope", scope(F.col("path")))


__all__ = ["COLUMNS", "any_of", "findings", "prefilter", "ranked", "with_scope"]
