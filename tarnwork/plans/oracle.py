"""DuckDB SQL for the registered queries, written apart from the DataFrame code.

The two share only the fixed values (token lists, titles, templates).
"""

from __future__ import annotations

from ..functions import fixed as X
from ..operators.lexer import GROUPS, NOT_CALLED
from ..sources.adapters import CODE, ENDINGS, TEMPLATES
from .catalog import DETECTORS, LONG_LINE, PROMPT_CAP, SEED_CAP, SMALL

UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def low(c: str) -> str:
    return f"translate({c}, '{UP}', '{LO}')"


def has(c: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(t)})" for t in tokens) + ")"


def names(c: str, tokens) -> str:
    return f"regexp_extract({c}, '[^/]*$') IN ({', '.join(map(lit, tokens))})"


def esc(tokens) -> str:
    out = []
    for t in tokens:
        out.append("".join(ch if ch.isalnum() or ch in "_ " else "\\" + ch for ch in t))
    return "|".join(out)


def bounded(c: str, tokens) -> str:
    return f"regexp_matches({c}, {lit('(^|[^A-Za-z0-9_])(' + esc(tokens) + ')($|[^A-Za-z0-9_])')})"


EV = (
    "tpl(tpl, pattern, lang, kind, text) AS (VALUES "
    + ", ".join(f"({i}, {lit(p)}, {lit(g)}, {lit(k)}, {lit(t)})" for i, (p, g, k, t) in enumerate(TEMPLATES))
    + f"), ev AS (SELECT replace(pattern, '{{u}}', CAST(user_id AS VARCHAR)) AS path, lang, kind, CAST(event_id % 500 + 1 AS INTEGER) AS line, text, CAST(user_id % 3 AS INTEGER) AS side FROM events JOIN tpl ON event_id % {len(TEMPLATES)} = tpl)"
)
MIXED = f"mixed AS (SELECT doc_id, 'p' || doc_id || '/' || ([{', '.join(map(lit, ENDINGS))}])[doc_id % {len(ENDINGS)} + 1] AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, doc_id % 3 = 0 AS runs FROM documents)"


def scope_sql(path: str) -> str:
    p = low(path)

    def marks(m):
        return " OR ".join([f"contains({p}, {lit(x)})" for x in m[0]] + [f"starts_with({p}, {lit(x)})" for x in m[1]] + [f"ends_with({p}, {lit(x)})" for x in m[2]])

    return f"CASE WHEN {marks(X.FIXTURE_PATHS)} THEN 'fixture' WHEN {marks(X.TEST_PATHS)} THEN 'test' WHEN {marks(X.CI_PATHS)} THEN 'ci' WHEN {marks(X.DOCS_PATHS)} THEN 'docs' ELSE 'production' END"


def lang_sql(path: str) -> str:
    name, ext = f"regexp_extract({path}, '[^/]*$')", f"regexp_extract(regexp_extract({path}, '[^/]*$'), '^.+\\.([^.]*)$', 1)"
    arms = [f"WHEN {k} IN ({', '.join(map(lit, v))}) THEN {lit(g)}" for k, t in ((name, X.LANG_BY_NAME), (ext, X.LANG_BY_EXTENSION)) for g, v in t.items()]
    return f"CASE {' '.join(arms)} END"


META = {r: (s, t, i) for i, (r, s, t) in enumerate(X.RULES)}
FLOW = "starts_with(path, '.github/workflows/')"
DOCKER = "(regexp_extract(lp, '[^/]*$') IN ('dockerfile', 'containerfile') OR ends_with(lp, '.dockerfile') OR ends_with(lp, '.containerfile'))"
MANIFEST = names("lp", X.MANIFESTS)
NOT_REGISTRY = f"NOT {has('low', X.REGISTRIES)}"
UNWRAP = "((contains(text, '.unwrap') AND NOT contains(text, '.unwrap_or')) OR contains(text, '.expect'))"
PANIC = "(contains(text, 'panic') AND contains(text, '!'))"
EVAL = "regexp_matches(low, '(^|[^A-Za-z0-9])eval +[$`\"'']')"
DOWNLOAD = f"({has('low', X.DOWNLOADS)} AND {has('low', X.EXECUTE_SINKS)})"
HOME = f"({has('low', X.SSH_PATHS)} AND {has('low', X.WRITE_OPS)})"
BASE64 = f"(contains(low, 'base64') AND {has('low', X.DECODE_FLAGS)} AND {has('low', X.DECODE_SINKS)})"
LIFE = has("text", [f'"{k}"' for k in X.LIFECYCLE]) + " AND contains(text, ':')"
TRIM = f"ltrim(text, {WS})"
LINE_RULES = {
    "npm-lifecycle-script": f"{names('path', ['package.json'])} AND {LIFE}",
    "rust-build-script-command": f"{names('path', ['build.rs'])} AND {has('low', X.BUILD_COMMANDS)}",
    "python-setup-command": f"{names('path', ['setup.py'])} AND {has('low', X.SETUP_COMMANDS)}",
    "download-execute": DOWNLOAD,
    "install-home-write": HOME,
    "base64-execute": BASE64,
    "dynamic-shell-eval": f"({EVAL} OR {has('low', ['eval(', 'bash -c'])})",
    "workflow-secret-shell": f"{FLOW} AND (({has('low', X.SECRETS)} AND (starts_with({TRIM}, 'run:') OR {has('low', X.SECRET_SHELLS)})) OR (file_secret AND starts_with({TRIM}, 'run:') AND {has('low', X.UNTRUSTED)}))",
    "unpinned-github-action": f"{FLOW} AND starts_with({TRIM}, 'uses:') AND NOT regexp_matches({TRIM}, '^[^@]*@\\s*[0-9A-Fa-f]{{40}}\\s*$')",
    "workflow-pull-request-target": f"{FLOW} AND contains(low, 'pull_request_target')",
    "workflow-write-all": f"{FLOW} AND contains(low, 'permissions: write-all')",
    "docker-remote-repository": f"{DOCKER} AND ({has('low', X.REPOSITORIES)} OR (contains(low, 'apk add') AND contains(low, '--repository'))) AND {has('low', X.REPOSITORY_URLS)}",
    "docker-root-user": f"{DOCKER} AND starts_with(ltrim(low, {WS}), 'user root')",
    "container-privileged": has("low", X.PRIVILEGED),
    "panic-edge": f"kind = 'call' AND {UNWRAP}",
    "explicit-panic": f"kind = 'call' AND NOT {UNWRAP} AND {PANIC}",
    "subprocess-boundary": f"kind = 'call' AND NOT {UNWRAP} AND NOT {PANIC} AND contains(text, 'std::process::Command')",
    "unsafe-surface": f"kind = 'signature' AND starts_with({TRIM}, 'unsafe ')",
    "external-blackbox": f"kind = 'import' AND starts_with({TRIM}, 'from .')",
    "dependency-git-source": f"{MANIFEST} AND {has('low', X.GIT_SOURCES)} AND {NOT_REGISTRY}",
    "dependency-http-source": f"{MANIFEST} AND {has('low', ['http://', 'https://'])} AND {NOT_REGISTRY}",
    "dependency-path-source": f"{MANIFEST} AND {has('low', X.PATH_SOURCES)}",
}
SAFE = "regexp_replace(substr(text, 1, 160), '(?i)(^|[^A-Za-z0-9_.-])secrets\\.[A-Za-z0-9_.-]*', '\\1secrets.<redacted>', 'g')"


def _line_rule(rule: str, when: str) -> str:
    severity, title, seq = META[rule]
    shown = SAFE if seq < 14 or rule.startswith("dependency-") else "text"
    return f"SELECT path, line, '{rule}' AS rule, '{severity}' AS base, {lit(title)} AS title, {shown} AS evidence, {seq} AS seq FROM x WHERE {when}"


def _missing(from_: str, group: str = "") -> str:
    out = []
    severity, title, seq = META["manifest-missing-lockfile"]
    pre = f"{group}, " if group else ""
    for manifests, locks, text in X.ECOSYSTEMS:
        first = "coalesce(" + ", ".join(f"min(CASE WHEN {names('lp', [m])} THEN lp END)" for m in manifests) + ")"
        having = f"HAVING bool_or({names('lp', manifests)}) AND NOT bool_or({names('lp', locks)})"
        out.append(f"SELECT {pre}{first} AS path, CAST(NULL AS INTEGER) AS line, 'manifest-missing-lockfile' AS rule, '{severity}' AS base, {lit(title)} AS title, {lit(text)} AS evidence, {seq} AS seq FROM {from_} {'GROUP BY ' + group if group else ''} {having}")
    return " UNION ALL ".join(out)


ROOT = f"SELECT path, CAST(NULL AS INTEGER) AS line, 'docker-default-root' AS rule, 'medium' AS base, {lit(META['docker-default-root'][1])} AS title, 'no USER directive' AS evidence, {META['docker-default-root'][2]} AS seq FROM x WHERE {DOCKER} GROUP BY path HAVING NOT bool_or(starts_with(ltrim(low, {WS}), 'user ') OR starts_with(ltrim(low, {WS}), 'from scratch'))"
LEAVES = "(" + " OR ".join(f"starts_with(ltrim(text), {lit(s)})" for s in X.EXTERNAL_STARTS) + ")"
EXT = f"SELECT DISTINCT path, lang, 'external' AS kind, CAST(NULL AS INTEGER) AS line, {lit(X.EXTERNAL_MARK)} || text AS text FROM ev WHERE kind = 'import' AND {LEAVES}"
EXT_FOUND = f"SELECT path, CAST(NULL AS INTEGER) AS line, 'external-blackbox' AS rule, 'low' AS base, {lit(META['external-blackbox'][1])} AS title, substr(text, {len(X.EXTERNAL_MARK) + 1}) AS evidence, {META['external-blackbox'][2]} AS seq FROM ext"
XCTE = f"x AS (SELECT *, {low('text')} AS low, {low('path')} AS lp, bool_or({has(low('text'), X.SECRETS)}) OVER (PARTITION BY path) AS file_secret FROM ev), ext AS ({EXT})"
FOUND = (
    f"WITH {EV}, {XCTE}, raw AS ({' UNION ALL '.join(_line_rule(r, w) for r, w in LINE_RULES.items())} UNION ALL {_missing('x')} UNION ALL {ROOT} UNION ALL {EXT_FOUND}), "
    f"found AS (SELECT path, line, rule, evidence, any_value(title) AS title, min(seq) AS seq, any_value(CASE WHEN {scope_sql('path')} IN ('test', 'fixture') THEN 'low' ELSE base END) AS severity FROM raw GROUP BY path, line, rule, evidence)"
)
COLS = "severity, path, line, rule, title, evidence"
RANK = "CASE {0} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"

# ---- policy -----------------------------------------------------------------------------------------

SUPPRESSED = "((contains(path, 'docs/') AND rule = 'download-execute') OR (contains(path, 'src1') AND rule = 'panic-edge'))"
ACT = "rule || ' at ' || path"
STEP1 = "CASE WHEN rule = 'unpinned-github-action' OR contains(path, 'tests/') THEN 'high' ELSE severity END"
STEP2 = "CASE WHEN rule = 'dependency-path-source' THEN 'medium' WHEN rule = 'unpinned-github-action' THEN 'low' WHEN rule = 'external-blackbox' THEN 'high' ELSE s1 END"
JUDGED = FOUND + (
    f", p1 AS (SELECT *, {SUPPRESSED} AS suppressed, {STEP1} AS s1, {scope_sql('path')} AS scope FROM found), p2 AS (SELECT *, {STEP2} AS s2 FROM p1), "
    "p3 AS (SELECT *, CASE WHEN scope IN ('test', 'fixture') THEN 'low' ELSE s2 END AS final FROM p2), "
    f"judged AS (SELECT * EXCLUDE (severity), severity AS before, CASE WHEN suppressed THEN severity ELSE final END AS severity, CASE WHEN suppressed AND rule = 'download-execute' THEN 'suppressed ' || {ACT} || ' by allowlist (documented)' WHEN suppressed THEN 'suppressed ' || {ACT} || ' by allowlist' "
    f"WHEN s2 = severity THEN NULL WHEN final <> s2 THEN 'held ' || {ACT} || ' at ' || final || ': ' || scope || ' paths are capped (policy asked for ' || s2 || ')' "
    f"WHEN s2 <> s1 THEN 'set ' || {ACT} || ' severity to ' || s2 || ' by override' WHEN rule = 'unpinned-github-action' THEN 'raised ' || {ACT} || ' to high by denylist (pin)' ELSE 'raised ' || {ACT} || ' to high by denylist' END AS action FROM p3)"
)
SUMMARY = f"path || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || ' [' || rule || ']: ' || title || ' (' || evidence || ') [scope=' || {scope_sql('path')} || ']'"
ORDER = f"{RANK.format('before')}, path, line NULLS FIRST, rule, seq, evidence"

# ---- surface ----------------------------------------------------------------------------------------

KEY = "CASE " + " ".join(f"WHEN contains(low, {lit(chr(34) + k + chr(34))}) AND contains(low, ':') THEN '{k}'" for k in X.LIFECYCLE) + " ELSE 'manifest' END"
START = f"ltrim(low, {WS})"
TRIGGER = (
    f"CASE lang WHEN 'manifest' THEN 'manifest' WHEN 'makefile' THEN 'make' WHEN 'package-json' THEN {KEY} WHEN 'markdown' THEN 'doc' "
    f"WHEN 'dockerfile' THEN CASE WHEN starts_with({START}, 'run ') THEN 'docker-run' WHEN starts_with({START}, 'cmd ') OR starts_with({START}, 'entrypoint ') THEN 'docker-entry' ELSE 'manifest' END "
    f"ELSE CASE WHEN contains(lp, '.github/workflows/') THEN CASE WHEN contains(low, 'run:') THEN 'ci-run' WHEN contains(low, 'uses:') THEN 'ci-uses' ELSE 'manifest' END "
    f"WHEN ends_with(path, 'setup.py') THEN CASE WHEN {has('low', X.SETUP_MARKS)} THEN 'python-setup' ELSE 'source' END "
    f"WHEN {names('lp', X.INSTALL_SCRIPTS)} OR starts_with(lp, 'scripts/') OR contains(lp, '/scripts/') THEN 'install-script' ELSE 'source' END END"
)
VALUE = "CASE WHEN instr(low, '\": ') > 0 THEN substr(low, instr(low, '\": ') + 3) WHEN instr(low, ' = ') > 0 THEN substr(low, instr(low, ' = ') + 2) ELSE low END"
DEP = f"({names('lp', X.DEPENDENCY_FILES)} OR {names('path', X.LANG_BY_NAME['manifest'])})"
META_KEY = has("low", [f'"{k}": ' for k in X.METADATA_KEYS])
FETCH = bounded("low", X.FETCH_TOOLS)
CALLED = "regexp_matches(regexp_replace(low, '(def|fn|function|func|class)\\s+(system|popen)\\(', '', 'g'), '(^|[^\\p{L}\\p{N}_])(system|popen)\\(')"
HITS = [
    ("execute", "download-execute", "strong", DOWNLOAD),
    ("network", "remote-fetch", "strong", f"({DOWNLOAD} OR {FETCH})"),
    ("execute", "base64-execute", "strong", BASE64),
    ("fs-write", "home-or-ssh-write", "strong", HOME),
    ("execute", "dynamic-eval", "strong", f"(({bounded('low', ['eval'])} AND contains(low, 'eval(')) OR {has('low', X.SHELL_C)})"),
    ("execute", "pipe-to-shell", "strong", has("low", X.PIPES)),
    ("execute", "shell-invocation", "strong", has("low", X.SHELLS)),
    ("execute", "chmod-exec", "strong", f"({bounded('low', ['chmod'])} AND {has('low', X.CHMOD_MODES)})"),
    ("execute", "process-spawn", "strong", f"({has('low', X.PROCESS_SPAWN)} OR {CALLED})"),
    ("network", "package-manager", "weak", has("low", X.PACKAGE_MANAGERS)),
    ("network", "remote-url", "weak", f"(NOT {FETCH} AND {has('low', X.URL_SCHEMES)} AND (trigger <> 'manifest' OR ({DEP} AND {has('value', X.DEPENDENCY_SOURCES)})))"),
    ("fs-write", "file-write-op", "strong", has("low", X.FILE_WRITES)),
    ("fs-write", "redirect-to-path", "weak", f"(contains(low, '>') AND {has('low', X.REDIRECT_TARGETS)})"),
    ("secret", "env-access", "weak", has("low", X.ENV_READS)),
    ("secret", "credential-file", "strong", has("low", X.CREDENTIAL_FILES)),
    ("secret", "ci-secret", "strong", has("low", X.SECRETS)),
    ("deps", "remote-dep-source", "strong", f"(trigger = 'manifest' AND {DEP} AND NOT {META_KEY} AND {has('value', X.DEPENDENCY_SOURCES)})"),
    ("deps", "local-path-dep", "strong", f"(trigger = 'manifest' AND {DEP} AND NOT {META_KEY} AND {has('value', X.LOCAL_DEPENDENCIES)})"),
]
_PARTS = [f"SELECT '{c}' AS capability, trigger, '{s}' AS confidence, '{e}' AS evidence, path, line, text FROM t WHERE kind <> 'import' AND {w}" for c, e, s, w in HITS]
_PARTS += [f"SELECT '{c}' AS capability, trigger, 'weak' AS confidence, 'capability-import' AS evidence, path, line, text FROM t WHERE kind = 'import' AND {bounded('low', tokens)}" for c, tokens in X.IMPORT_TOKENS.items()]
_PARTS += [f"SELECT 'hook' AS capability, trigger, 'strong' AS confidence, '{h}' AS evidence, path, line, text FROM t WHERE trigger = '{g}'" for g, h in X.HOOKS.items()]


def surface_ctes(ev: str, tag: str = "") -> str:
    parts = " UNION ALL ".join(p.replace("FROM t ", f"FROM t{tag} ") for p in _PARTS)
    return (
        f"t0{tag} AS (SELECT *, {low('text')} AS low, {low('path')} AS lp FROM {ev}), t{tag} AS (SELECT *, {TRIGGER} AS trigger, {VALUE} AS value FROM t0{tag}), hits{tag} AS ({parts}), "
        f"best{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, capability, trigger, line, evidence ORDER BY length(text) DESC, text) AS n FROM hits{tag}) WHERE n = 1), "
        f"kept{tag} AS (SELECT capability, trigger, confidence, evidence, path, line, text FROM (SELECT *, bool_or(confidence = 'strong') OVER (PARTITION BY path, capability, line) AS s FROM best{tag}) WHERE confidence = 'strong' OR NOT s), "
        f"surf{tag} AS (SELECT DISTINCT *, {scope_sql('path')} AS scope FROM (SELECT * FROM kept{tag} UNION ALL SELECT DISTINCT 'hook', 'build-script', 'strong', 'build-script-present', path, CAST(NULL AS INTEGER), '' FROM {ev} WHERE ends_with(path, 'build.rs')))"
    )


SURFACE = f"WITH {EV}, {surface_ctes('ev')}"
SURF_COLS = "capability, trigger, confidence, evidence, path, line, scope, text"
CAP_RANK = "list_position([" + ", ".join(map(lit, X.CAPABILITIES)) + "], capability)"
DIFF = (
    f"WITH {EV}, ea AS (SELECT * FROM ev WHERE side <> 0), eb AS (SELECT * FROM ev WHERE side <> 1), {surface_ctes('ea', 'a')}, {surface_ctes('eb', 'b')}, "
    f"ka AS (SELECT *, trim(text, {WS}) AS key FROM surfa), kb AS (SELECT *, trim(text, {WS}) AS key FROM surfb), "
    f"added AS (SELECT DISTINCT ON (capability, path, key) * FROM kb WHERE NOT EXISTS (SELECT 1 FROM ka WHERE ka.capability = kb.capability AND ka.path = kb.path AND ka.key = kb.key) ORDER BY capability, path, key, line NULLS FIRST, evidence, text), "
    f"removed AS (SELECT DISTINCT ON (capability, path, key) * FROM ka WHERE NOT EXISTS (SELECT 1 FROM kb WHERE ka.capability = kb.capability AND ka.path = kb.path AND ka.key = kb.key) ORDER BY capability, path, key, line NULLS FIRST, evidence, text), "
    "d AS (SELECT 'added' AS side, capability, path, text FROM added UNION ALL SELECT 'removed', capability, path, text FROM removed)"
)
NAME = f"regexp_extract({low('path')}, '[^/]*$')"
ENDS = lambda xs: "(" + " OR ".join(f"ends_with({NAME}, {lit(s)})" for s in xs) + ")"
ARTIFACTS = (
    f"WITH {MIXED}, art AS (SELECT path, length AS size_bytes, concat_ws(',', CASE WHEN length > {SMALL} THEN 'large_opaque_file' END, CASE WHEN {ENDS(X.BINARY_SUFFIXES)} THEN 'binary_or_archive_extension' END, "
    f"CASE WHEN runs AND {has(low('path'), X.RELEASE_MARKS)} THEN 'executable_in_install_or_release_path' WHEN runs AND NOT {ENDS(X.SCRIPT_SUFFIXES)} THEN 'extensionless_or_binary_executable' END) AS reason FROM mixed WHERE length > {SMALL} OR {lang_sql('path')} IS NULL), art1 AS (SELECT * FROM art WHERE reason <> '')"
)
MD = "md AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, coalesce(text, '') AS c FROM documents)"
SPLIT = "CASE WHEN ends_with(c, chr(10)) OR c = '' THEN list_slice(string_split(c, chr(10)), 1, -2) ELSE string_split(c, chr(10)) END"
BARE = "list_transform({0}, lambda x: regexp_replace(x, '\\r$', ''))"
SHAPE = f"WITH {MD}, ls AS (SELECT path, c, {BARE.format(SPLIT)} AS l FROM md), shape AS (SELECT path, CAST(strlen(c) AS BIGINT) AS bytes, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(list_max(list_transform(l, lambda x: strlen(x))), 0) AS BIGINT) AS max_line, CAST((length(c) - length(replace(c, '_0x', ''))) / 3 AS BIGINT) AS generated FROM ls)"


def _scripts(path: str, lang: str) -> str:
    return (
        f"WITH {EV}, dr AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN chr(9) || text WHEN 1 THEN '- `' || text || '`' WHEN 2 THEN text || ':' WHEN 3 THEN '# ' || text || chr(13) ELSE text || '  ' END AS s FROM events JOIN tpl ON event_id % {len(TEMPLATES)} = tpl), "
        f"ln AS (SELECT 'u' || user_id || '/{path}' AS path, '{lang}' AS lang, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS line, regexp_replace(s, '\\r$', '') AS raw FROM dr), "
        f"tr AS (SELECT *, trim(raw, {WS}) AS text FROM ln), lo AS (SELECT *, {low('text')} AS low, (text <> '' AND NOT starts_with(text, '#')) AS plain FROM tr)"
    )


def shell_like(low_col: str) -> str:
    ev = EVAL.replace("(low,", f"({low_col},")
    return f"({has(low_col, [*X.DOWNLOADS, 'base64', *X.SHELL_C, *X.SSH_SHORT])} OR {ev})"


MAKE = f"CASE WHEN plain AND ends_with(text, ':') AND NOT contains(text, '=') AND NOT contains(text, '://') THEN 'signature' WHEN plain AND (starts_with(raw, chr(9)) OR starts_with(text, '@') OR {shell_like('low')}) THEN 'call' END"
PKG = f"CASE WHEN starts_with(text, '\"scripts\"') THEN 'signature' WHEN {LIFE} THEN 'call' WHEN {has('low', X.MANIFEST_SIGNALS)} THEN 'long' END"
BARE_MD = f"trim(trim(ltrim(text, '-*> '), '`'), {WS})"


def _matched(flags: dict[str, str], where: str = "TRUE", source: str = "ev") -> str:
    cols = ", ".join(f"({c}) AS {n}" for n, c in flags.items())
    wins = ", ".join(f"bool_or({n}) OVER (PARTITION BY path) AS all_{n}" for n in flags)
    return f"f0 AS (SELECT path, lang, kind, line, text, {cols} FROM {source} WHERE {where}), f1 AS (SELECT *, {wins} FROM f0), m AS (SELECT DISTINCT path, lang, kind, line, text FROM f1 WHERE ({' OR '.join(flags)}) AND {' AND '.join('all_' + n for n in flags)})"


def rx(kind: str, pattern: str) -> str:
    return f"kind = '{kind}' AND regexp_matches(text, {lit(pattern)})"


BOTH = f"ext AS ({EXT}), both_ AS (SELECT path, lang, kind, line, text FROM ev UNION ALL SELECT path, lang, kind, line, text FROM ext)"
ROW = "path, lang, kind, line, text"

ORACLE_SQL: dict[str, str] = {
    "scan_coverage": f"WITH {MIXED}, s AS (SELECT *, length <= {SMALL} AND {lang_sql('path')} IS NOT NULL AS ok FROM mixed) SELECT count(*) AS candidate_files, count(*) FILTER (WHERE ok) AS dehydrated_files, count(*) FILTER (WHERE NOT ok) AS unsupported_files, CAST(0 AS BIGINT) AS read_failed, CAST(0 AS BIGINT) AS parse_failed, CAST(0 AS BIGINT) AS serialization_failed, CAST(0 AS BIGINT) AS record_truncated, CAST(coalesce(sum(length) FILTER (WHERE ok), 0) AS BIGINT) AS seed_bytes FROM s",
    "lang_route": f"WITH {MIXED} SELECT coalesce({lang_sql('path')}, 'unsupported') AS lang, count(*) AS n FROM mixed GROUP BY 1",
    "line_split": f"WITH {MD}, ls AS (SELECT doc_id, {BARE.format(SPLIT)} AS l FROM md) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(l, lambda x: strlen(x))), 0) AS BIGINT) AS bytes FROM ls",
    "make_lines": f"{_scripts('Makefile', 'makefile')}, k AS (SELECT *, {MAKE} AS kind FROM lo) SELECT path, lang, kind, line, substr(text, 1, 140) AS text FROM k WHERE kind IS NOT NULL",
    "manifest_lines": f"{_scripts('Cargo.toml', 'manifest')} SELECT path, lang, 'signature' AS kind, line, substr(text, 1, 180) AS text FROM lo WHERE plain",
    "md_commands": f"{_scripts('README.md', 'markdown')}, b AS (SELECT path, lang, line, {BARE_MD} AS text FROM lo) SELECT path, lang, 'call' AS kind, line, substr(text, 1, 140) AS text FROM (SELECT *, {low('text')} AS bl FROM b) WHERE {shell_like('bl')}",
    "package_lines": f"{_scripts('package.json', 'package-json')}, k AS (SELECT *, {PKG} AS kk FROM lo) SELECT path, lang, CASE WHEN kk = 'call' THEN 'call' ELSE 'signature' END AS kind, line, substr(text, 1, CASE WHEN kk = 'long' THEN 180 ELSE 140 END) AS text FROM k WHERE kk IS NOT NULL",
    "shell_lines": f"{_scripts('run.sh', 'bash')} SELECT path, lang, 'call' AS kind, line, substr(text, 1, 140) AS text FROM lo WHERE plain AND {shell_like('low')}",
    "scope_classify": f"WITH {EV} SELECT {scope_sql('path')} AS scope, count(*) AS n FROM ev GROUP BY 1",
    "external_markers": f"WITH {EV}, ext AS ({EXT}) SELECT path, text FROM ext",
    "query_calls": f"WITH {EV}, {_matched({'a': rx('call', 'curl|subprocess')})} SELECT {ROW} FROM m",
    "query_imports_lang": f"WITH {EV}, {_matched({'a': rx('import', 'reqwest|from')}, chr(39).join(['lang = ', 'rust', '']))} SELECT {ROW} FROM m",
    "query_and_semantics": f"WITH {EV}, {_matched({'a': rx('call', 'system|unwrap'), 'b': rx('signature', 'unsafe|setup')}, 'contains(path, ' + lit('src') + ')')} SELECT {ROW} FROM m",
    "query_any_external": f"WITH {EV}, {BOTH}, {_matched({'a': 'regexp_matches(text, ' + lit('curl|BLACKBOX') + ')'}, source='both_')} SELECT {ROW} FROM m",
    "query_external": f"WITH {EV}, {BOTH}, {_matched({'a': rx('external', 'helpers')}, source='both_')} SELECT {ROW} FROM m",
    "query_path_list": f"WITH {EV} SELECT DISTINCT path, lang, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS text FROM ev WHERE lang = 'yaml' AND ends_with(path, '.yml')",
    "query_license_lines": f"WITH {MD}, l AS (SELECT path, unnest({BARE.format(SPLIT)}) AS text, generate_subscripts({SPLIT}, 1) AS line FROM md) SELECT DISTINCT path, 'markdown' AS lang, 'call' AS kind, CAST(line AS INTEGER) AS line, text FROM l WHERE contains(text, 'MIT License') OR contains(text, 'Apache License')",
    "query_limit_walk_order": f"WITH {EV}, {_matched({'a': rx('call', 'curl|wget')})}, per AS (SELECT path, lang, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM per) SELECT path, lang, n AS n_matched, CAST(least(n, greatest(0, 100 - b)) AS BIGINT) AS n_shown FROM r",
    "query_grep_lines": f"WITH {EV}, {_matched({'a': rx('call', 'base64')})} SELECT path, path || ':' || line || ': ' || kind || ': ' || text AS out FROM m",
    "shape_metrics": f"{SHAPE} SELECT * FROM shape",
    "shape_opaque": f"{SHAPE} SELECT 'artifact' AS capability, 'source' AS trigger, CASE WHEN generated >= 100 THEN 'strong' ELSE 'weak' END AS confidence, CASE WHEN generated >= 100 THEN 'obfuscated_source' ELSE 'minified_source' END AS evidence, path, CAST(NULL AS INTEGER) AS line, {scope_sql('path')} AS scope, 'bytes=' || bytes || ' lines=' || n_lines || ' max_line=' || max_line || ' generated_idents=' || generated AS text FROM shape WHERE generated >= 100 OR max_line >= {LONG_LINE}",
    "findings_all": f"{FOUND} SELECT {COLS} FROM found",
    "findings_ranked": f"{FOUND} SELECT {COLS}, {scope_sql('path')} AS scope FROM found ORDER BY {RANK.format('severity')}, path, line NULLS FIRST, rule, seq, evidence",
    "findings_by_rule": f"{FOUND} SELECT rule, severity, count(*) AS n FROM found GROUP BY ALL",
    "lockfiles_by_tree": f"WITH {EV}, x AS (SELECT split_part(path, '/', 1) AS tree, {low('path')} AS lp FROM ev), l AS ({_missing('x', 'tree')}) SELECT tree, path, evidence FROM l",
    "policy_severity": f"{JUDGED} SELECT severity, path, line, rule, evidence FROM judged WHERE NOT suppressed",
    "policy_allow": f"{JUDGED} SELECT path, line, rule, evidence FROM judged WHERE suppressed",
    "policy_actions": f"{JUDGED} SELECT action, count(*) AS n FROM judged WHERE action IS NOT NULL GROUP BY 1",
    "policy_artifacts": f"{ARTIFACTS} SELECT *, CASE WHEN contains(path, 'dist/') AND list_contains(string_split(reason, ','), 'binary_or_archive_extension') THEN 'suppressed artifact ' || reason || ' at ' || path || ' by allowlist' WHEN list_contains(string_split(reason, ','), 'large_opaque_file') THEN 'suppressed artifact ' || reason || ' at ' || path || ' by allowlist (data)' END AS action FROM art1",
    "gate_verdict": f"{JUDGED}, {ARTIFACTS.removeprefix('WITH ')} SELECT CASE WHEN (SELECT count(*) FROM judged WHERE NOT suppressed AND severity = 'high') > 0 THEN 'REJECT' WHEN (SELECT count(*) FROM judged WHERE NOT suppressed) + (SELECT count(*) FROM art1) > 0 THEN 'CAUTION' ELSE 'ACCEPT' END AS verdict, ((SELECT count(*) FROM judged WHERE NOT suppressed) + (SELECT count(*) FROM art1) = 0) AS safe_to_agent_run, (SELECT count(*) FROM judged WHERE NOT suppressed) AS n_findings, (SELECT count(*) FROM judged WHERE NOT suppressed AND severity = 'high') AS n_high, (SELECT count(*) FROM art1) AS n_artifacts, (SELECT count(*) FROM mixed) AS candidate_files",
    "gate_incomplete": "SELECT 'INCOMPLETE' AS verdict, 'candidate_files=' || count(*) || ' exceeds policy max_candidate_files=10' AS reasons FROM documents",
    "gate_blockers_topk": f"{JUDGED} SELECT {SUMMARY} AS blocker FROM judged WHERE NOT suppressed AND severity <> 'low' ORDER BY {ORDER} LIMIT 10",
    "gate_why": f"{JUDGED} SELECT upper(severity) || ' ' || {SUMMARY} AS why FROM judged WHERE NOT suppressed ORDER BY {ORDER} LIMIT 3",
    "surface_all": f"{SURFACE} SELECT {SURF_COLS} FROM surf",
    "surface_detect": f"{SURFACE} SELECT capability, evidence, confidence, count(*) AS n FROM hits GROUP BY ALL",
    "surface_trigger": f"{SURFACE} SELECT path, trigger, count(*) AS n FROM t GROUP BY ALL",
    "surface_counts": f"{SURFACE} SELECT capability, count(*) AS n FROM surf WHERE scope IN ('production', 'ci') GROUP BY 1",
    "surface_selected": f"{SURFACE} SELECT {SURF_COLS} FROM surf WHERE scope IN ('production', 'test') AND capability IN ('execute', 'secret')",
    "surface_top": f"{SURFACE} SELECT {SURF_COLS} FROM surf WHERE scope IN ('production', 'ci') ORDER BY {CAP_RANK}, path, line NULLS FIRST, evidence, text LIMIT 50",
    "hidden_scope_counts": f"{SURFACE} SELECT scope, count(*) AS n FROM surf WHERE scope NOT IN ('production', 'ci') GROUP BY 1",
    "surface_fail_on": f"{SURFACE} SELECT c AS capability, EXISTS (SELECT 1 FROM surf WHERE surf.capability = c) AS failed FROM (VALUES ('execute'), ('deps')) v(c)",
    "artifact_tags": f"{ARTIFACTS} SELECT path, size_bytes, reason FROM art1",
    "artifact_entries": f"{ARTIFACTS}, u AS (SELECT path, size_bytes, unnest(string_split(reason, ',')) AS tag FROM art1) SELECT 'artifact' AS capability, 'manifest' AS trigger, 'strong' AS confidence, tag AS evidence, path, CAST(NULL AS INTEGER) AS line, {scope_sql('path')} AS scope, size_bytes || ' bytes' AS text FROM u",
    "diff_added": f"{DIFF} SELECT capability, path, text FROM d WHERE side = 'added'",
    "diff_removed": f"{DIFF} SELECT capability, path, text FROM d WHERE side = 'removed'",
    "diff_stream": f"{DIFF} SELECT side, capability, path, text FROM d",
    "diff_counts": f"{DIFF} SELECT side, capability, count(*) AS n FROM d GROUP BY ALL",
    "diff_wrapper_strip": f"{DIFF} SELECT side, count(*) AS n FROM d GROUP BY 1",
    "token_cost": f"WITH {MD}, k AS (SELECT split_part(path, '/', 1) AS source, CAST(floor((strlen(c) + 3) / 4) AS BIGINT) AS t FROM md) SELECT source, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t / 1e6 * 3.0), 6) AS usd FROM k GROUP BY 1",
    "eval_fn_fp": f"{FOUND}, act AS (SELECT regexp_extract(path, '^([.a-z]+)', 1) AS name, list_sort(list(DISTINCT rule)) AS rules, CASE WHEN bool_or(severity = 'high') THEN 'REJECT' ELSE 'CAUTION' END AS verdict FROM found GROUP BY 1), want(name, verdict, rules) AS (VALUES ('img', 'REJECT', ['docker-remote-repository', 'docker-default-root']), ('mk', 'REJECT', ['download-execute']), ('py', 'CAUTION', ['dependency-http-source', 'base64-execute']), ('none', 'ACCEPT', CAST([] AS VARCHAR[]))), b AS (SELECT w.name, w.verdict = a.verdict AS same, list_sort(list_filter(w.rules, lambda r: NOT list_contains(coalesce(a.rules, []), r))) AS missed, list_sort(list_filter(coalesce(a.rules, []), lambda r: NOT list_contains(w.rules, r))) AS unexpected FROM want w LEFT JOIN act a ON a.name = w.name) SELECT name, (coalesce(same, FALSE) AND len(missed) = 0) AS passed, array_to_string(missed, ',') AS missed, array_to_string(unexpected, ',') AS unexpected FROM b",
    "seed_batches": "WITH RECURSIVE r AS (SELECT conv_id % 16 AS tree, conv_id, turn, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) AS n FROM conversations), "
    "f AS (SELECT tree, conv_id, turn, bytes, n, CAST(0 AS BIGINT) AS batch, bytes AS filled FROM r WHERE n = 1 UNION ALL SELECT r.tree, r.conv_id, r.turn, r.bytes, r.n, CASE WHEN f.filled > 0 AND f.filled + r.bytes > 4096 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.filled > 0 AND f.filled + r.bytes > 4096 THEN r.bytes ELSE f.filled + r.bytes END FROM f JOIN r ON r.tree = f.tree AND r.n = f.n + 1) SELECT tree, conv_id, turn, bytes, batch FROM f",
    "py_ast_extract": "WITH t AS (SELECT DISTINCT user_id, event_type AS x FROM events), k AS (SELECT user_id, x, CAST(3 * (row_number() OVER (PARTITION BY user_id ORDER BY x) - 1) AS INTEGER) AS b FROM t) "
    "SELECT 'm' || user_id || '.py' AS path, 'python' AS lang, kind, b + d AS line, a || x || z AS text FROM k, (VALUES ('import', 1, 'import ', ''), ('signature', 2, 'def on_', '(v):'), ('call', 3, '', '.handle')) v(kind, d, a, z)",
    "eval_corpus": f"SELECT 'c' || conv_id AS fixture, ([{', '.join(lit(v) for _, v, _ in X.EVAL_CASES)}])[conv_id % {len(X.EVAL_CASES)} + 1] AS actual_verdict, '' AS missed, TRUE AS \"pass\" FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)",
    "query_report": f"WITH {EV}, {_matched({'a': rx('call', 'curl|wget')})} SELECT count(DISTINCT path) AS matched_files, count(*) AS matched_evidence, least(count(*), 100) AS shown_evidence, count(*) > 100 AS truncated FROM m",
    "surface_report": f"{SURFACE}, ch AS (SELECT * FROM surf WHERE scope IN ('production', 'ci')), cc AS (SELECT capability || '=' || count(*) AS s FROM ch GROUP BY capability), hh AS (SELECT scope || '=' || count(*) AS s FROM surf WHERE scope NOT IN ('production', 'ci') GROUP BY scope) SELECT (SELECT count(*) FROM ch) AS entries_total, least((SELECT count(*) FROM ch), 50) AS entries_shown, (SELECT count(*) FROM ch) > 50 AS truncated, (SELECT string_agg(s, ' ' ORDER BY s) FROM cc) AS counts, (SELECT string_agg(s, ' ' ORDER BY s) FROM hh) AS hidden_by_scope",
    "diff_report": f"{DIFF} SELECT count(*) FILTER (WHERE side = 'added') AS added, count(*) FILTER (WHERE side = 'removed') AS removed FROM d",
    "scan_report": f"WITH {MIXED}, s AS (SELECT *, length <= {SMALL} AND {lang_sql('path')} IS NOT NULL AS ok FROM mixed) SELECT count(*) AS candidate_files, count(*) FILTER (WHERE ok) AS scanned_files, count(*) FILTER (WHERE NOT ok) AS unsupported_files, CAST(0 AS BIGINT) AS read_failed, CAST(0 AS BIGINT) AS parse_failed FROM s",
    "repo_refs": "WITH r AS (SELECT page_id, 'owner' || page_id || CASE page_id % 3 WHEN 0 THEN '/re po' WHEN 1 THEN '/repo.git' ELSE '/a/b' END AS ref FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'owner' || page_id END AS owner, CASE WHEN page_id % 3 = 1 THEN 'repo' END AS repo, NOT contains(ref, ' ') AS valid FROM r",
    "checkout_inspect": f"WITH {MIXED} SELECT count(*) AS n_files, CAST(coalesce(sum(length), 0) AS BIGINT) AS n_bytes, FALSE AS submodules, FALSE AS lfs, (count(*) <= 20000 AND coalesce(sum(length), 0) <= 262144000) AS within_limits FROM mixed",
}
#: What the lines of code are made to hold: see STANZA.
_CODE = (
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,8}') AS w FROM documents), "
    f"s AS (SELECT doc_id, {{langs}}[doc_id % {len(CODE)} + 1] AS lang, w, unnest(range(0, len(w) // 8)) AS k FROM w)"
).replace("{langs}", "[" + ", ".join(lit(c[0]) for c in CODE) + "]")
ORACLE_SQL["lexed_calls"] = (
    f"{_CODE} SELECT 'src/f' || doc_id AS path, lang, CAST(9 * k + l AS INTEGER) AS line, CASE l WHEN 1 THEN w[8 * k + 1] || '.' || w[8 * k + 2] WHEN 7 THEN w[8 * k + 5] ELSE w[8 * k + 6] END AS text "
    f"FROM s, (VALUES (1), (7), (9)) v(l) WHERE l = 1 OR w[8 * k + CASE l WHEN 7 THEN 5 ELSE 6 END] NOT IN ({', '.join(map(lit, NOT_CALLED))}) AND NOT (lang = 'go' AND w[8 * k + CASE l WHEN 7 THEN 5 ELSE 6 END] IN ({', '.join(map(lit, GROUPS))}))"
)
ORACLE_SQL["lexed_states"] = f"{_CODE} SELECT lang, CASE WHEN l IN (6, 7) THEN 'inside' WHEN l IN (2, 3, 8) THEN 'bracket' ELSE 'code' END AS entered, count(*) AS n FROM s, range(1, 10) v(l) GROUP BY ALL"
for _rule in META:
    ORACLE_SQL[f"rule_{_rule.replace('-', '_')}"] = f"{FOUND} SELECT severity, path, line, title, evidence FROM found WHERE rule = '{_rule}'"
for _ev in DETECTORS:
    ORACLE_SQL[f"surface_{_ev.replace('-', '_')}"] = f"{SURFACE} SELECT capability, trigger, confidence, path, line, scope, text FROM surf WHERE evidence = '{_ev}'"

# ---- compacted records: every rung's JSON is written and measured here ---------------------------------
_START, _LEAST = ([str(r[k]) for k in ("signatures", "calls", "locations", "external", "text")] for r in (X.SEED_START, X.SEED_MINIMAL))
_CLIP = "list_transform(list_slice({0}, 1, {1}), lambda s: CASE WHEN length(s) > tx THEN substr(s, 1, tx) || '...' ELSE s END)"
_PLACES = "list_transform(list_slice(l_lo, 1, lo), lambda p: {'kind': p.kind, 'line': p.line, 'text': CASE WHEN length(p.text) > tx THEN substr(p.text, 1, tx) || '...' ELSE p.text END})"
_OMITTED = "{" + ", ".join(f"'{n}': greatest(len(l_{c}) - {c}, 0)" for n, c in (("signatures", "sg"), ("calls", "ca"), ("locations", "lo"), ("external", "ex"))) + "}"
_KIND = "coalesce(list_sort(list(DISTINCT text) FILTER (WHERE kind = '{0}')), [])"
SEEDS = (
    f"WITH RECURSIVE ladder(i, sg, ca, lo, ex, tx) AS (SELECT 0, {', '.join(_START)} UNION ALL SELECT i + 1, CASE WHEN lo <= 20 AND ca <= 20 AND sg > 8 THEN sg // 2 ELSE sg END, CASE WHEN lo <= 20 AND ca > 20 THEN ca // 2 ELSE ca END, CASE WHEN lo > 20 THEN lo // 2 ELSE lo END, "
    "CASE WHEN lo <= 20 AND ca <= 20 AND sg <= 8 AND ex > 8 THEN ex // 2 ELSE ex END, CASE WHEN lo <= 20 AND ca <= 20 AND sg <= 8 AND ex <= 8 THEN tx // 2 ELSE tx END FROM ladder WHERE lo > 20 OR ca > 20 OR sg > 8 OR ex > 8 OR tx > 60), "
    f"rungs AS (SELECT * FROM ladder UNION ALL SELECT 99, {', '.join(_LEAST)}), {EV.replace(', ev AS (', ', all_ev AS (')}, all_ext AS ({EXT.replace('FROM ev', 'FROM all_ev')}), "
    "both_ev AS (SELECT path, lang, kind, line, text FROM all_ev UNION ALL SELECT path, lang, kind, line, text FROM all_ext), "
    f"rec AS (SELECT path, lang, {_KIND.format('signature')} AS l_sg, {_KIND.format('call')} AS l_ca, coalesce(list_sort(list({{'line': line, 'kind': kind, 'text': text}}) FILTER (WHERE kind <> 'external')), []) AS l_lo, {_KIND.format('external')} AS l_ex FROM both_ev GROUP BY path, lang), "
    f"tried AS (SELECT path, lang, i, {{'path': path, 'lang': lang, 'signatures': {_CLIP.format('l_sg', 'sg')}, 'calls': {_CLIP.format('l_ca', 'ca')}, 'locations': {_PLACES}, 'external': {_CLIP.format('l_ex', 'ex')}, 'omitted': {_OMITTED}}} AS j FROM rec, rungs), "
    f"seeds AS (SELECT path, lang, min(i) AS i, arg_min(j, i) AS j FROM tried WHERE i = 99 OR strlen(CAST(to_json(j) AS VARCHAR)) + 1 <= {SEED_CAP} GROUP BY path, lang)"
)
ORACLE_SQL["seed_compact"] = (
    f"{SEEDS} SELECT path, CASE i WHEN 99 THEN 'minimal_record_after_size_cap' ELSE 'compact_record_limits' END AS reason, i = 99 OR j.omitted.signatures + j.omitted.calls + j.omitted.locations + j.omitted.external > 0 AS truncated, "
    "CAST(strlen(CAST(to_json(j) AS VARCHAR)) AS INTEGER) AS bytes, CAST(len(j.locations) AS INTEGER) AS n_locations, md5(CAST(to_json(j) AS VARCHAR)) AS json_md5 FROM seeds"
)

ORACLE_SQL["seed_rungs"] = (
    SEEDS.replace("both_ev AS (SELECT path, lang, kind, line, text FROM all_ev UNION ALL SELECT path, lang, kind, line, text FROM all_ext)", "both_ev AS (SELECT lang || '/' || line % 20 AS path, lang, kind, line, text FROM all_ev)")
    + " SELECT path, CASE i WHEN 99 THEN 'minimal_record_after_size_cap' ELSE 'compact_record_limits' END AS reason, i = 99 OR j.omitted.signatures + j.omitted.calls + j.omitted.locations + j.omitted.external > 0 AS truncated, "
    "CAST(j.omitted.signatures AS INTEGER) AS signatures, CAST(j.omitted.calls AS INTEGER) AS calls, CAST(j.omitted.locations AS INTEGER) AS locations, CAST(j.omitted.external AS INTEGER) AS external, md5(CAST(to_json(j) AS VARCHAR)) AS json_md5 FROM seeds"
)


def _seen(seeds: str, path: str) -> str:
    """Evidence of compacted records."""
    return f"SELECT {path} AS path, lang, p.kind AS kind, p.line AS line, p.text AS text FROM (SELECT *, unnest(j.locations) AS p FROM {seeds}) UNION ALL SELECT {path} AS path, lang, 'call' AS kind, CAST(NULL AS INTEGER) AS line, unnest(j.calls) AS text FROM {seeds} WHERE len(j.locations) = 0"


def _judged_seeds(missing: str, ext: str = "") -> str:
    rules = " UNION ALL ".join(_line_rule(r, w) for r, w in LINE_RULES.items()).replace(FLOW, "contains('/' || path, '/.github/workflows/')")
    return (
        f"x AS (SELECT *, {low('text')} AS low, {low('path')} AS lp, bool_or({has(low('text'), X.SECRETS)}) OVER (PARTITION BY path) AS file_secret FROM ev), raw AS ({rules} UNION ALL {missing} UNION ALL {ROOT}{ext}), "
        f"found AS (SELECT path, line, rule, evidence, any_value(title) AS title, any_value(CASE WHEN {scope_sql('path')} IN ('test', 'fixture') THEN 'low' ELSE base END) AS severity FROM raw GROUP BY path, line, rule, evidence)"
    )


ORACLE_SQL["seed_findings"] = f"{SEEDS}, ev AS ({_seen('seeds', 'path')}), {_judged_seeds(_missing('x'))} SELECT {COLS} FROM found"
_TREE = "split_part(path, '/', 1)"
_FIELDS = " || ',' || chr(10) || ".join(f"""'    "{c}": ' || coalesce(CAST(to_json({"substr(path, strpos(path, '/') + 1)" if c == "path" else c}) AS VARCHAR), 'null')""" for c in COLS.split(", "))
ORACLE_SQL["planned_prompts"] = (
    f"{SEEDS}, sized AS (SELECT *, strlen(CAST(to_json(j) AS VARCHAR)) + 1 AS bytes, row_number() OVER (ORDER BY path) AS n FROM seeds), "
    "dealt AS (SELECT n, path, lang, j, CAST(0 AS BIGINT) AS batch, CAST(bytes AS BIGINT) AS filled FROM sized WHERE n = 1 "
    f"UNION ALL SELECT s.n, s.path, s.lang, s.j, CASE WHEN filled > 0 AND filled + bytes > {PROMPT_CAP} THEN batch + 1 ELSE batch END, CASE WHEN filled > 0 AND filled + bytes > {PROMPT_CAP} THEN bytes ELSE filled + bytes END FROM dealt d JOIN sized s ON s.n = d.n + 1), "
    "marked AS (SELECT batch || '/' || path AS path, lang, j, batch FROM dealt), "
    f"ev AS ({_seen('marked', 'path')}), ext AS (SELECT path, unnest(j.external) AS text FROM marked), "
    f"{_judged_seeds(f'SELECT path, line, rule, base, title, evidence, seq FROM ({_missing("x", _TREE)})', ' UNION ALL ' + EXT_FOUND)}, "
    f"said AS (SELECT {_TREE} AS batch, strlen('[' || chr(10) || string_agg('  {{' || chr(10) || {_FIELDS} || chr(10) || '  }}', ',' || chr(10)) || chr(10) || ']') AS bytes FROM found GROUP BY 1) "
    f"SELECT count(*) AS planned_requests, CAST(coalesce(sum(coalesce(bytes, 2) + {X.PROMPT_BYTES['en']}), 0) AS BIGINT) AS planned_prompt_bytes FROM (SELECT DISTINCT CAST(batch AS VARCHAR) AS batch FROM marked) LEFT JOIN said USING (batch)"
)
