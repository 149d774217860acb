"""The registered queries: one per operator, over the test tables read as trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import lines
from ..operators import diff as D
from ..operators import extract as E
from ..operators import gate as G
from ..operators import lexer as L
from ..operators import paths as P
from ..operators import policy as J
from ..operators import query as Q
from ..operators import rules as R
from ..operators import seed as S
from ..operators import surface as C
from ..sources import adapters as A
from ..sources import checkout as K
from ..session import cut, shared_folder
from ..sources import golden
from ..streaming import changes as T
from . import reports as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Sizes at which the test texts show both sides of a limit.
SMALL, LONG_LINE, SEED_CAP, PROMPT_CAP = 4096, 800, 2048, 65536


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.evidence(spark, d).select("path", "lang", "kind", "line", "text")


def _found(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d)
    return R.findings(e, E.external(e))


@query
def scan_coverage(spark, d):
    files = E.routed(A.mixed_files(spark, d), SMALL)
    return G.coverage(files.select("status", F.lit(False).alias("truncated"), F.when(F.col("status") == "dehydrated", F.col("length")).alias("seed_bytes")))


@query
def lang_route(spark, d):
    return A.mixed_files(spark, d).groupBy(F.coalesce(P.language(F.col("path")), F.lit("unsupported")).alias("lang")).agg(F.count("*").alias("n"))


@query
def line_split(spark, d):
    rows = A.markdown_files(spark, d).select("doc_id", lines(F.col("content")).alias("ls"))
    return rows.select("doc_id", F.size("ls").cast("long").alias("n"), F.coalesce(F.aggregate("ls", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)).cast("long").alias("bytes"))


def _scripts(spark, d, path: str, lang: str) -> DataFrame:
    """One file per user, its lines made of the user's evidence texts in several dresses."""
    ev = A.table(spark, d, "events").select("event_id", "user_id").withColumn("tpl", (F.col("event_id") % len(A.TEMPLATES)).cast("int"))
    t = spark.createDataFrame([(i, x[3]) for i, x in enumerate(A.TEMPLATES)], "tpl int, text string")
    e = ev.join(F.broadcast(t), "tpl")
    n = F.col("event_id") % 5
    dressed = F.when(n == 0, F.concat(F.lit("\t"), "text")).when(n == 1, F.concat(F.lit("- `"), "text", F.lit("`"))).when(n == 2, F.concat("text", F.lit(":"))).when(n == 3, F.concat(F.lit("# "), "text", F.lit("\r"))).otherwise(F.concat("text", F.lit("  ")))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", dressed.alias("s")))).alias("a"))
    content = F.concat(F.array_join(F.col("a.s"), "\n"), F.lit("\n"))
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/" + path)).alias("path"), F.lit(lang).alias("lang"), content.alias("content"))


for _name, _path, _lang in (("make_lines", "Makefile", "makefile"), ("manifest_lines", "Cargo.toml", "manifest"), ("md_commands", "README.md", "markdown"), ("package_lines", "package.json", "package-json"), ("shell_lines", "run.sh", "bash")):

    def _lines(spark, d, path=_path, lang=_lang):
        return E.line_evidence(E.file_lines(_scripts(spark, d, path, lang)))

    QUERIES[_name] = _lines


@query
def scope_classify(spark, d):
    return _evidence(spark, d).groupBy(P.scope(F.col("path")).alias("scope")).agg(F.count("*").alias("n"))


@query
def external_markers(spark, d):
    return E.external(_evidence(spark, d)).select("path", "text")


@query
def query_calls(spark, d):
    return Q.matches(_evidence(spark, d), Q.Filters(calls="curl|subprocess"))


@query
def query_imports_lang(spark, d):
    return Q.matches(_evidence(spark, d), Q.Filters(imports="reqwest|from", lang="RUST"))


@query
def query_and_semantics(spark, d):
    return Q.matches(_evidence(spark, d), Q.Filters(calls="system|unwrap", signatures="unsafe|setup", path="src"))


@query
def query_any_external(spark, d):
    e = _evidence(spark, d)
    return Q.matches(e.unionByName(E.external(e)), Q.Filters(any="curl|BLACKBOX"))


@query
def query_external(spark, d):
    e = _evidence(spark, d)
    return Q.matches(e.unionByName(E.external(e)), Q.Filters(external="helpers"))


@query
def query_path_list(spark, d):
    return Q.matches(_evidence(spark, d), Q.Filters(path="[.]yml$", lang="yaml"))


@query
def query_license_lines(spark, d):
    ls = E.file_lines(A.markdown_files(spark, d).withColumn("lang", F.lit("markdown")))
    e = ls.select("path", "lang", F.lit("call").alias("kind"), "line", F.col("raw").alias("text"))
    return Q.matches(e, Q.Filters(any="MIT License|Apache License"))


@query
def query_limit_walk_order(spark, d):
    return Q.limited(Q.matches(_evidence(spark, d), Q.Filters(calls="curl|wget")), 100)


@query
def query_grep_lines(spark, d):
    return Q.grep_lines(Q.matches(_evidence(spark, d), Q.Filters(calls="base64")))


@query
def shape_metrics(spark, d):
    return C.shapes(A.markdown_files(spark, d))


@query
def shape_opaque(spark, d):
    return C.shape_entries(C.shapes(A.markdown_files(spark, d)), long_line=LONG_LINE)


@query
def findings_all(spark, d):
    return _found(spark, d).select(*R.COLUMNS)


@query
def findings_ranked(spark, d):
    return R.ranked(R.with_scope(_found(spark, d))).select(*R.COLUMNS, "scope")


for _rule, _, _ in X.RULES:

    def _one(spark, d, rule=_rule):
        return _found(spark, d).where(F.col("rule") == rule).select("severity", "path", "line", "title", "evidence")

    QUERIES[f"rule_{_rule.replace('-', '_')}"] = _one


@query
def findings_by_rule(spark, d):
    return _found(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query
def lockfiles_by_tree(spark, d):
    e = _evidence(spark, d).select(F.substring_index("path", "/", 1).alias("tree"), "path")
    return R.missing_lockfiles(e, "tree").select("tree", "path", "evidence")


POLICY = """
max_candidate_files = 100000
[[allowlist]]
path = "docs/"
rule = "download-execute"
reason = "documented"
[[allowlist]]
rule = "panic-edge"
path = "src1"
[[denylist]]
rule = "unpinned-github-action"
reason = "pin"
[[denylist]]
path = "tests/"
[[severity_override]]
rule = "dependency-path-source"
severity = "medium"
[[severity_override]]
rule = "unpinned-github-action"
severity = "low"
[[severity_override]]
rule = "external-blackbox"
severity = "high"
reason = " "
"""


def _judged(spark, d) -> DataFrame:
    return J.judged(_found(spark, d), J.parse(POLICY))


@query
def policy_severity(spark, d):
    return _judged(spark, d).where("not suppressed").select("severity", "path", "line", "rule", "evidence")


@query
def policy_allow(spark, d):
    return _judged(spark, d).where("suppressed").select("path", "line", "rule", "evidence")


@query
def policy_actions(spark, d):
    return _judged(spark, d).where("action is not null").groupBy("action").agg(F.count("*").alias("n"))


@query
def policy_artifacts(spark, d):
    p = J.parse('[[allowlist]]\nrule = "binary_or_archive_extension"\npath = "dist/"\n[[allowlist]]\nrule = "large_opaque_file"\nreason = "data"\n')
    return J.artifacts_left(C.artifacts(A.mixed_files(spark, d), SMALL), p)


def _coverage(spark, d) -> DataFrame:
    files = E.routed(A.mixed_files(spark, d), SMALL)
    return G.coverage(files.select("status", F.lit(False).alias("truncated"), F.col("length").alias("seed_bytes")))


@query
def gate_verdict(spark, d):
    v = G.verdict(_judged(spark, d).where("not suppressed"), C.artifacts(A.mixed_files(spark, d), SMALL), _coverage(spark, d))
    return v.select("verdict", "safe_to_agent_run", "n_findings", "n_high", "n_artifacts", "candidate_files")


@query
def gate_incomplete(spark, d):
    v = G.verdict(_found(spark, d), C.artifacts(A.mixed_files(spark, d), SMALL), _coverage(spark, d), limit=10)
    return v.select("verdict", F.array_join("reasons", "; ").alias("reasons"))


@query
def gate_blockers_topk(spark, d):
    return G.blockers(_judged(spark, d).where("not suppressed"), 10, "severity_before")


@query
def gate_why(spark, d):
    return G.why(_judged(spark, d).where("not suppressed"), 3, "severity_before")


def _surface(spark, d) -> DataFrame:
    return C.surface(_evidence(spark, d))


@query
def surface_all(spark, d):
    return _surface(spark, d)


@query
def surface_detect(spark, d):
    return C.line_entries(_evidence(spark, d)).groupBy("capability", "evidence", "confidence").agg(F.count("*").alias("n"))


@query
def surface_trigger(spark, d):
    e = _evidence(spark, d)
    return e.groupBy("path", C.trigger(F.col("path"), F.col("lang"), F.col("text")).alias("trigger")).agg(F.count("*").alias("n"))


DETECTORS = (
    "capability-import", "download-execute", "remote-fetch", "base64-execute", "home-or-ssh-write", "dynamic-eval", "pipe-to-shell", "shell-invocation", "chmod-exec", "process-spawn",
    "package-manager", "remote-url", "file-write-op", "redirect-to-path", "env-access", "credential-file", "ci-secret", "remote-dep-source", "local-path-dep", "build-script-present", *X.HOOKS.values(),
)
for _ev in DETECTORS:

    def _detected(spark, d, ev=_ev):
        return _surface(spark, d).where(F.col("evidence") == ev).select("capability", "trigger", "confidence", "path", "line", "scope", "text")

    QUERIES[f"surface_{_ev.replace('-', '_')}"] = _detected


@query
def surface_counts(spark, d):
    return C.counts(C.selected(_surface(spark, d)))


@query
def surface_selected(spark, d):
    return C.selected(_surface(spark, d), ["production", "test"], ["execute", "secret"])


@query
def surface_top(spark, d):
    return C.ranked(C.selected(_surface(spark, d))).limit(50)


@query
def hidden_scope_counts(spark, d):
    return C.hidden_by_scope(_surface(spark, d))


@query
def surface_fail_on(spark, d):
    return C.failing(_surface(spark, d), ["execute", "deps"])


@query
def artifact_tags(spark, d):
    return C.artifacts(A.mixed_files(spark, d), SMALL)


@query
def artifact_entries(spark, d):
    return C.artifact_entries(C.artifacts(A.mixed_files(spark, d), SMALL))


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    e = A.evidence(spark, d)
    cols = ["path", "lang", "kind", "line", "text"]
    return C.surface(e.where("side <> 0").select(*cols)), C.surface(e.where("side <> 1").select(*cols))


def _diff(spark, d) -> DataFrame:
    return D.diff(*_sides(spark, d)).select("side", "capability", "path", "text")


@query
def diff_added(spark, d):
    return _diff(spark, d).where("side = 'added'").drop("side")


@query
def diff_removed(spark, d):
    return _diff(spark, d).where("side = 'removed'").drop("side")


@query
def diff_counts(spark, d):
    return _diff(spark, d).groupBy("side", "capability").agg(F.count("*").alias("n"))


@query
def diff_wrapper_strip(spark, d):
    a, b = _sides(spark, d)
    wrap = lambda x, w: x.withColumn("path", F.concat(F.lit(w), "path"))
    return D.diff(wrap(a, "package/"), wrap(b, "foo-1.2.3/")).groupBy("side").agg(F.count("*").alias("n"))


@query
def diff_stream(spark, d):
    """Both trees' ledgers as snapshots of one tree in a stream: what the second gained and lost."""
    a, b = _sides(spark, d)
    a = cut(a)  # read for its own feed and for the paths that the next one lacks
    feeds = [T.snapshot_feed(a, "t", 1), T.snapshot_feed(b, "t", 2, before=a)]
    folder = shared_folder(spark, "changes")
    return T.replay(feeds, f"{folder}/checkpoint", f"{folder}/rows").where("snapshot = 2").select("side", "capability", "path", "text")


def _seeds(spark, d) -> DataFrame:
    return S.compact(E.records(_evidence(spark, d), follow=False), SEED_CAP)


@query
def seed_compact(spark, d):
    return _seeds(spark, d).select("path", "reason", "truncated", F.octet_length("json").alias("bytes"), F.size("record.locations").alias("n_locations"), F.md5(F.encode("json", "UTF-8")).alias("json_md5"))


@query
def seed_rungs(spark, d):
    """Compaction of records of many files: by language and line, most of them beyond the cap."""
    e = _evidence(spark, d).withColumn("path", F.concat("lang", F.lit("/"), (F.col("line") % 20).cast("string")))
    return S.compact(E.records(e), SEED_CAP).select("path", "reason", "truncated", "record.omitted.*", F.md5(F.encode("json", "UTF-8")).alias("json_md5"))


@query
def seed_findings(spark, d):
    return R.findings(S.compact_evidence(_seeds(spark, d))).select(*R.COLUMNS)


@query
def seed_batches(spark, d):
    rows = A.table(spark, d, "conversations").select((F.col("conv_id") % 16).alias("tree"), "conv_id", "turn", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return S.batches(rows, "bytes", ["conv_id", "turn"], ["tree"], 4096)


@query
def token_cost(spark, d):
    files = A.markdown_files(spark, d)
    tokens = S.tokens_of(F.col("length"))
    return files.groupBy(F.split(F.col("path"), "/")[0].alias("source")).agg(F.sum(tokens).alias("tokens"), F.round(F.sum(S.cost(tokens, 3.0)), 6).alias("usd"))


@query
def eval_fn_fp(spark, d):
    """Rules expected of and found in each kind of tree."""
    tree = F.regexp_extract("path", "^([.a-z]+)", 1)
    found = _found(spark, d).groupBy(tree.alias("name")).agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.when(F.max(F.col("severity") == "high"), "REJECT").otherwise("CAUTION").alias("verdict"))
    expected = spark.createDataFrame([("img", "REJECT", ["docker-remote-repository", "docker-default-root"]), ("mk", "REJECT", ["download-execute"]), ("py", "CAUTION", ["dependency-http-source", "base64-execute"]), ("none", "ACCEPT", [])], "name string, verdict string, rules array<string>")
    out = S.rule_sets(expected, found)
    return out.select("name", "passed", F.array_join("missed", ",").alias("missed"), F.array_join("unexpected", ",").alias("unexpected"))


@query
def eval_corpus(spark, d):
    """A tree of files for each conversation, by its number one of the golden cases: outcome of each against expectation."""
    from .audit import eval_corpus as run

    names = F.array(*(F.lit(c) for c, _, _ in X.EVAL_CASES))
    number = F.pmod("conv_id", F.lit(len(X.EVAL_CASES))).cast("int")
    convs = A.table(spark, d, "conversations").where("conv_id is not null").select("conv_id").distinct()
    trees = convs.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("fixture"), F.get(names, number).alias("case"))
    return run(spark, golden.files(spark, trees), trees=trees).select("fixture", "actual_verdict", F.array_join("false_negative_rules", ",").alias("missed"), "pass")


@query
def query_report(spark, d):
    return V.query_head(Q.matches(_evidence(spark, d), Q.Filters(calls="curl|wget")), 100)


@query
def surface_report(spark, d):
    head = V.surface_head(_surface(spark, d), limit=50)
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias(c)
    return head.select("entries_total", "entries_shown", "truncated", said("counts"), said("hidden_by_scope"))


@query
def diff_report(spark, d):
    return V.diff_head(_diff(spark, d))


@query
def scan_report(spark, d):
    return V.coverage(E.routed(A.mixed_files(spark, d), SMALL))


@query
def planned_prompts(spark, d):
    """Requests and bytes of the prompts for batches of compacted records, the rules run over each batch."""
    return V.planned_prompts(*V.batched_findings(_seeds(spark, d), PROMPT_CAP))


@query
def repo_refs(spark, d):
    c = A.table(spark, d, "pages").select("page_id", F.concat(F.lit("owner"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "/re po").when(F.col("page_id") % 3 == 1, "/repo.git").otherwise("/a/b")).alias("ref"))
    p = K.parse_repo(F.col("ref"))
    return c.select("page_id", p["owner"].alias("owner"), p["repo"].alias("repo"), K.valid_ref(F.col("ref")).alias("valid"))


@query
def checkout_inspect(spark, d):
    return K.inspected(A.mixed_files(spark, d))


@query
def py_ast_extract(spark, d):
    """Python evidence of small modules made of users' event types."""
    ev = A.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat(F.lit("import "), x, F.lit("\ndef on_"), x, F.lit("(v):\n    return "), x, F.lit(".handle(v)"))), "\n")
    files = ev.select(F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), body.alias("content"))
    return E.syntax_evidence(files)


@query
def lexed_calls(spark, d):
    """Calls in code of twelve languages, over several lines, with calls in comments and strings that are none."""
    return L.file_calls(A.code_files(spark, d))


@query
def lexed_states(spark, d):
    """Lines by language and by what they are entered in."""
    rows = L.file_states(A.code_files(spark, d)).select("lang", F.inline("lines"))
    return rows.groupBy("lang", F.when(F.col("state") > 0, "inside").when(F.col("depth") > 0, "bracket").otherwise("code").alias("entered")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_ranked(spark, sf_dir)
