"""The capability ledger: what a tree can do at install, build or CI time.

Entries are (capability, trigger, confidence, evidence, path, line, scope, text).  One projection over
evidence rows makes all line entries; file-level entries (build scripts, artifacts, opaque shape) are
unions.  Collapsing is a window arg-max per line and a strong-over-weak window on the same partitioning
by path, so both share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_of, ascii_lower, base_name, calls_named, contains_any, has_token, is_file, lines, lstrip, normal_path, shortest, spelled
from .paths import is_dependency_file, is_install_script, language, scope
from .rules import base64_execute, download_execute, home_write

COLUMNS = ["capability", "trigger", "confidence", "evidence", "path", "line", "scope", "text"]


def _hit(capability: str, evidence: str, confidence: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(capability).alias("capability"), F.lit(evidence).alias("evidence"), F.lit(confidence).alias("confidence")))


def trigger(path: Column, lang: Column, text: Column) -> Column:
    """What makes a line run; ``source`` or ``manifest`` if nothing does."""
    low = ascii_lower(text)
    start = lstrip(low)
    key = F.coalesce(*(F.when(F.contains(low, F.lit(f'"{k}"')) & F.contains(low, F.lit(":")), k) for k in X.LIFECYCLE), F.lit("manifest"))
    docker = F.when(F.startswith(start, F.lit("run ")), "docker-run").when(F.startswith(start, F.lit("cmd ")) | F.startswith(start, F.lit("entrypoint ")), "docker-entry").otherwise("manifest")
    flow = F.when(F.contains(low, F.lit("run:")), "ci-run").when(F.contains(low, F.lit("uses:")), "ci-uses").otherwise("manifest")
    setup = F.when(contains_any(low, X.SETUP_MARKS), "python-setup").otherwise("source")
    by_lang = F.when(lang == "manifest", F.lit("manifest")).when(lang == "makefile", "make").when(lang == "package-json", key).when(lang == "markdown", "doc").when(lang == "dockerfile", docker)
    by_path = F.when(F.contains(ascii_lower(normal_path(path)), F.lit(".github/workflows/")), flow).when(F.endswith(path, F.lit("setup.py")), setup).when(is_install_script(path), "install-script")
    return F.coalesce(by_lang, by_path, F.lit("source"))


def dependency_value(low: Column) -> Column:
    """What follows the first ``": ``, else the first `` =``, else all."""
    quoted_key, assigned = F.instr(low, '": '), F.instr(low, " = ")
    return F.when(quoted_key > 0, F.substring(low, quoted_key + 3, F.char_length(low))).when(assigned > 0, F.substring(low, assigned + 2, F.char_length(low))).otherwise(low)


def line_hits(path: Column, trig: Column, kind: Column, low: Column) -> Column:
    """Array of (capability, evidence, confidence) of one line; imports only indicate reach."""
    imports = [_hit(c, "capability-import", "weak", has_token(low, tokens)) for c, tokens in X.IMPORT_TOKENS.items()]
    manifest, dependency = trig == "manifest", is_dependency_file(path)
    value = dependency_value(low)
    remote_value = contains_any(value, X.DEPENDENCY_SOURCES)
    metadata = any_of(F.contains(low, F.lit(f'"{k}": ')) for k in X.METADATA_KEYS)
    download, fetch = download_execute(low), has_token(low, X.FETCH_TOOLS)
    code = [
        _hit("execute", "download-execute", "strong", download),
        _hit("network", "remote-fetch", "strong", download | fetch),
        _hit("execute", "base64-execute", "strong", base64_execute(low)),
        _hit("fs-write", "home-or-ssh-write", "strong", home_write(low)),
        _hit("execute", "dynamic-eval", "strong", (has_token(low, ["eval"]) & F.contains(low, F.lit("eval("))) | contains_any(low, X.SHELL_C)),
        _hit("execute", "pipe-to-shell", "strong", contains_any(low, X.PIPES)),
        _hit("execute", "shell-invocation", "strong", contains_any(low, X.SHELLS)),
        _hit("execute", "chmod-exec", "strong", has_token(low, ["chmod"]) & contains_any(low, X.CHMOD_MODES)),
        _hit("execute", "process-spawn", "strong", contains_any(low, X.PROCESS_SPAWN) | calls_named(low, "system") | calls_named(low, "popen")),
        _hit("network", "package-manager", "weak", contains_any(low, X.PACKAGE_MANAGERS)),
        _hit("network", "remote-url", "weak", ~fetch & contains_any(low, X.URL_SCHEMES) & (~manifest | (dependency & remote_value))),
        _hit("fs-write", "file-write-op", "strong", contains_any(low, X.FILE_WRITES)),
        _hit("fs-write", "redirect-to-path", "weak", F.contains(low, F.lit(">")) & contains_any(low, X.REDIRECT_TARGETS)),
        _hit("secret", "env-access", "weak", contains_any(low, X.ENV_READS)),
        _hit("secret", "credential-file", "strong", contains_any(low, X.CREDENTIAL_FILES)),
        _hit("secret", "ci-secret", "strong", contains_any(low, X.SECRETS)),
        _hit("deps", "remote-dep-source", "strong", manifest & dependency & ~metadata & remote_value),
        _hit("deps", "local-path-dep", "strong", manifest & dependency & ~metadata & contains_any(value, X.LOCAL_DEPENDENCIES)),
    ]
    return F.array_compact(F.when(kind == "import", F.array(*imports)).otherwise(F.array(*code)))


def prefilter(text: Column) -> Column:
    """A superset of the lines that some detector hits (entry points are kept apart)."""
    tokens = {*X.DOWNLOADS, "base64", "eval", *X.SHELL_C, *X.PIPES, *X.SHELLS, "chmod", *X.PROCESS_SPAWN, "system(", "popen(", *X.FETCH_TOOLS, *X.PACKAGE_MANAGERS, *X.URL_SCHEMES, *X.FILE_WRITES, ">", *X.ENV_READS, *X.CREDENTIAL_FILES, *X.SECRETS, *X.DEPENDENCY_SOURCES, *X.LOCAL_DEPENDENCIES, *X.SSH_PATHS, *(t for ts in X.IMPORT_TOKENS.values() for t in ts)}
    return ascii_lower(text).rlike(spelled(shortest(tokens)))


def line_entries(e: DataFrame) -> DataFrame:
    """Entries of lines.  Each step is a column that the next ones read, and lines without a hit go last, with the
    empty arrays: a filter on them would be pushed below the steps and compute them again for each mention."""
    rows = e.where(F.col("line").isNotNull()).withColumn("low", ascii_lower(F.col("text")))
    rows = rows.withColumn("trigger", trigger(F.col("path"), F.col("lang"), F.col("low")))
    hook = F.create_map(*(F.lit(x) for pair in X.HOOKS.items() for x in pair))[F.col("trigger")]
    rows = rows.withColumns({"hook": hook, "touched": prefilter(F.col("low"))})
    entry = F.struct(F.lit("hook").alias("capability"), F.col("hook").alias("evidence"), F.lit("strong").alias("confidence"))
    none = F.slice(F.array(entry), 1, 0)
    hits = F.concat(F.when(F.col("touched"), line_hits(F.col("path"), F.col("trigger"), F.col("kind"), F.col("low"))).otherwise(none), F.when(F.col("hook").isNotNull(), F.array(entry)).otherwise(none))
    return rows.select("path", "line", "text", "trigger", F.inline(hits)).withColumn("scope", scope(F.col("path"))).select(*COLUMNS)


def collapse(entries: DataFrame) -> DataFrame:
    """Per line: the longest text of each (capability, trigger, evidence); weak goes where strong is."""
    line = F.coalesce("line", F.lit(0))
    best = Window.partitionBy("path", "capability", line, "trigger", "evidence").orderBy(F.desc(F.char_length("text")), "text")
    kept = entries.repartition("path").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    strong = F.max(F.col("confidence") == "strong").over(Window.partitionBy("path", "capability", line))
    return kept.withColumn("s", strong).where((F.col("confidence") == "strong") | ~F.col("s")).drop("s")


def _file_entry(df: DataFrame, capability: str, trig: str, confidence: Column, evidence: Column, text: Column) -> DataFrame:
    return df.select(F.lit(capability).alias("capability"), F.lit(trig).alias("trigger"), confidence.alias("confidence"), evidence.alias("evidence"), "path", F.lit(None).cast("int").alias("line"), scope(F.col("path")).alias("scope"), text.alias("text"))


def build_scripts(files: DataFrame) -> DataFrame:
    return _file_entry(files.where(F.endswith("path", F.lit("build.rs"))).select("path").distinct(), "hook", "build-script", F.lit("strong"), F.lit("build-script-present"), F.lit(""))


def artifact_tags(path: Column, length: Column, mode: Column, max_bytes: int = X.MAX_BYTES) -> Column:
    """Reasons for which a file is suspicious, in order."""
    low = ascii_lower(normal_path(path))
    name = base_name(low)
    runs = mode.bitwiseAND(F.lit(0o111)) != 0
    placed = contains_any(low, X.RELEASE_MARKS)
    return F.array_compact(
        F.array(
            F.when(length > max_bytes, "large_opaque_file"),
            F.when(any_of(F.endswith(name, F.lit(s)) for s in X.BINARY_SUFFIXES), "binary_or_archive_extension"),
            F.when(placed & runs, "executable_in_install_or_release_path").when(runs & ~any_of(F.endswith(name, F.lit(s)) for s in X.SCRIPT_SUFFIXES), "extensionless_or_binary_executable"),
        )
    )


def artifacts(files: DataFrame, max_bytes: int = X.MAX_BYTES) -> DataFrame:
    """(path, size_bytes, reason) of suspicious files, from their metadata alone: those that are too large
    or of no known language, as what is read is judged by its content."""
    tags = artifact_tags(F.col("path"), F.col("length"), F.col("mode"), max_bytes)
    return files.where((F.col("length") > max_bytes) | language(F.col("path")).isNull()).select("path", F.col("length").cast("long").alias("size_bytes"), tags.alias("tags")).where(F.size("tags") > 0).select("path", "size_bytes", F.array_join("tags", ",").alias("reason"))


def artifact_entries(found: DataFrame) -> DataFrame:
    rows = found.select("path", "size_bytes", F.explode(F.split("reason", ",")).alias("tag"))
    return _file_entry(rows, "artifact", "manifest", F.lit("strong"), F.col("tag"), F.format_string("%d bytes", "size_bytes"))


def shapes(files: DataFrame) -> DataFrame:
    """(path, bytes, n_lines, max_line, generated) of text content; ``content`` is a string column."""
    split = lines(F.col("content"))
    empty = F.col("content") == ""
    longest = F.coalesce(F.array_max(F.transform(split, lambda x: F.octet_length(x))), F.lit(0))
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.when(empty, 0).otherwise(F.size(split)).cast("long").alias("n_lines"), longest.cast("long").alias("max_line"), F.regexp_count("content", F.lit(X.GENERATED_MARK)).cast("long").alias("generated"))


def shape_entries(shape: DataFrame, long_line: int = X.LONG_LINE, generated_min: int = X.GENERATED_MIN) -> DataFrame:
    """Opaque source by its shape; lockfiles and requirement lists are exempt."""
    obfuscated, minified = F.col("generated") >= generated_min, F.col("max_line") >= long_line
    rows = shape.where(~is_file(ascii_lower(normal_path(F.col("path"))), X.SHAPE_EXEMPT) & (obfuscated | minified))
    text = F.format_string("bytes=%d lines=%d max_line=%d generated_idents=%d", "bytes", "n_lines", "max_line", "generated")
    return _file_entry(rows, "artifact", "source", F.when(obfuscated, "strong").otherwise("weak"), F.when(obfuscated, "obfuscated_source").otherwise("minified_source"), text)


def surface(evidence: DataFrame, files: DataFrame | None = None, extra: list[DataFrame] | None = None) -> DataFrame:
    """The distinct entries of evidence rows, build scripts among ``files`` and further producers."""
    out = collapse(line_entries(evidence)).unionByName(build_scripts(files if files is not None else evidence))
    for x in extra or []:
        out = out.unionByName(x)
    return out.dropDuplicates(COLUMNS)


def capability_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, X.CAPABILITIES)), c)


def ranked(entries: DataFrame) -> DataFrame:
    return entries.orderBy(capability_rank(F.col("capability")), "path", F.asc_nulls_first("line"), "evidence", "text")


def selected(entries: DataFrame, scopes: list[str] | None = None, capabilities: list[str] | None = None) -> DataFrame:
    """Scope filter (production and ci unless named; ``all``), then capability filter; unknown names are errors."""
    scopes = scopes if scopes is not None else ["production", "ci"]
    for names, known, what in ((scopes, ("all", *X.SCOPES), "scope"), (capabilities or [], X.CAPABILITIES, "capability")):
        if bad := [n for n in names if n not in known]:
            raise ValueError(f"unknown {what} {bad[0]!r} (known: {', '.join(known)})")
    out = entries if "all" in scopes else entries.where(F.col("scope").isin(scopes))
    return out.where(F.col("capability").isin(capabilities)) if capabilities else out


def hidden_by_scope(entries: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    scopes = scopes if scopes is not None else ["production", "ci"]
    return entries.where(~F.col("scope").isin(scopes) & F.lit("all" not in scopes)).groupBy("scope").agg(F.count("*").alias("n"))


def counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("capability").agg(F.count("*").alias("n"))


def failing(entries: DataFrame, capabilities: list[str]) -> DataFrame:
    """(capability, failed): whether any entry, whatever its scope, has it."""
    asked = F.array(*map(F.lit, capabilities))
    seen = entries.where(F.col("capability").isin(capabilities)).agg(F.collect_set("capability").alias("seen"))
    return seen.select("seen", F.explode(asked).alias("capability")).select("capability", F.array_contains("seen", F.col("capability")).alias("failed"))


def fails(entries: DataFrame, capabilities: list[str]) -> bool:
    return bool(failing(entries, capabilities).where("failed").limit(1).count())
