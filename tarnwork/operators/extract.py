"""From files to evidence rows (path, lang, kind, line, text).

Line-oriented languages (package.json, manifests, makefiles, Markdown, shell risk lines) are DataFrame
expressions over exploded lines.  Python is parsed with the standard library's ``ast`` in Arrow
batches.  The other languages, and Python with a syntax error, are lexed (lexer.py): comments and strings
hold no evidence, calls are found in statements, which may have several lines, imports and signatures by
the line on which they begin; an approximation of a syntax tree (see README).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import any_of, ascii_lower, contains_any, eval_invoked, lines, strip, utf8
from ..session import cut, ship_code
from .lexer import CALLING, LEXIS, calls, lexed, statements
from .paths import language
from .rules import lifecycle

LINE_LANGS = ("package-json", "manifest", "makefile", "markdown")
EVIDENCE = "path string, lang string, kind string, line int, text string"


def routed(files: DataFrame, max_bytes: int = X.MAX_BYTES) -> DataFrame:
    """``lang`` and ``status``: files too large or of no known language are not read further."""
    out = files.withColumn("lang", language(F.col("path")))
    return out.withColumn("status", F.when((F.col("length") > max_bytes) | F.col("lang").isNull(), "unsupported").otherwise("dehydrated"))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, raw) of text content; ``content`` may be binary."""
    text = utf8(F.col("content")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    return files.select("path", "lang", F.posexplode(lines(text)).alias("n", "raw")).select("path", "lang", (F.col("n") + 1).alias("line"), "raw")


def shell_like(text: Column) -> Column:
    low = ascii_lower(text)
    return contains_any(low, [*X.DOWNLOADS, "base64", *X.SHELL_C, *X.SSH_SHORT]) | eval_invoked(low)


def line_evidence(rows: DataFrame) -> DataFrame:
    """Evidence of the line-oriented languages, and shell lines of Bash."""
    raw, text = F.col("raw"), F.col("text")
    t = rows.where(F.col("lang").isin(*LINE_LANGS, "bash")).withColumn("text", strip(raw))
    bare = strip(F.btrim(F.ltrim(text, F.lit("-*> ")), F.lit("`")))
    t = t.withColumn("text", F.when(F.col("lang") == "markdown", bare).otherwise(text))
    plain = (text != "") & ~F.startswith(text, F.lit("#"))
    short, long = F.substring(text, 1, X.LINE_CHARS), F.substring(text, 1, X.MANIFEST_CHARS)

    def out(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    package = F.when(F.startswith(text, F.lit('"scripts"')), out("signature", short)).when(lifecycle(text), out("call", short)).when(contains_any(ascii_lower(text), X.MANIFEST_SIGNALS), out("signature", long))
    manifest = F.when(plain, out("signature", long))
    target = F.endswith(text, F.lit(":")) & ~F.contains(text, F.lit("=")) & ~F.contains(text, F.lit("://"))
    recipe = F.startswith(raw, F.lit("\t")) | F.startswith(text, F.lit("@")) | shell_like(text)
    make = F.when(plain & target, out("signature", short)).when(plain & recipe, out("call", short))
    shell = F.when(shell_like(text), out("call", short))
    lang = F.col("lang")
    e = F.when(lang == "package-json", package).when(lang == "manifest", manifest).when(lang == "makefile", make).when(lang == "markdown", shell).when(lang == "bash", F.when(plain, shell))
    return t.withColumn("e", e).where(F.col("e").isNotNull()).select("path", "lang", F.col("e.kind").alias("kind"), "line", F.col("e.text").alias("text"))


# ---- languages with syntax -------------------------------------------------------------------------

#: Per language: import, signature and call patterns at the start of a line; the calls of languages that are
#: called by name and bracket come from statements (lexer.py).
_PATTERNS: dict[str, tuple[str | None, str | None, str | None]] = {
    "python": (r"(?:import|from)\s", r"(?:async\s+)?(?:def|class)\s", None),
    "rust": (r"(?:pub(?:\([^)]*\))?\s+)?use\s", r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|const\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?:fn|struct|enum|trait|impl)\b", None),
    "go": (r"import\s", r"(?:func|type)\s", None),
    "javascript": (r"(?:import|export)\b(?!\()", r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\b|class\s)", None),
    "dart": (r"(?:import|export|library)\s", r"(?:abstract\s+)?(?:class|mixin|extension)\s", None),
    "kotlin": (r"(?:import|package)\s", r"(?:\w+\s+)*(?:class|object|fun|interface|val|var)\s", None),
    "java": (r"import\s", r"(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s", None),
    "c": (r"#\s*(?:include|define)\b", r"(?:struct|enum|class|namespace)\s|[A-Za-z_][\w\s*&:<>,]*\([^;{]*\)\s*\{", None),
    "csharp": (r"(?:using|extern alias)\s", r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|enum|record|struct)\s", None),
    "php": (r"(?:use\s|require(?:_once)?\b)", r"(?:(?:public|private|protected|static|final|abstract)\s+)*(?:function|class|interface|trait)\s", None),
    "swift": (r"import\s", r"(?:(?:public|private|internal|open|final|static)\s+)*(?:class|struct|protocol|enum|func)\s", None),
    "ruby": (None, r"(?:def|class|module)\s", r"([a-z_][\w.]*[!?]?\s+[^=].*|[\w.]+\(.*)"),
    "zig": (None, r"(?:pub\s+)?(?:fn|const|var)\s", None),
    "css": (r"@import\b", r"[^{}]+\{|@\w+", None),
    "html": (None, r"<[A-Za-z][^>]*>", None),
    "vue": (None, r"<[A-Za-z][^>]*>", None),
    "svelte": (None, r"<[A-Za-z][^>]*>", None),
    "sql": (None, r"(?i:select|insert|update|delete|create|drop|alter)\b", r"(?i:(?:call|exec|execute)\b.*)"),
    "yaml": (None, r"(?:-\s+)?[^\s#][^:]*:(?:\s|$)|-\s", None),
    "hcl": (None, r"\w[\w\" .-]*(?:\{|=)", None),
    "bash": (r"(?:source|\.)\s", r"(?:function\s+\w+|\w+\s*\(\)\s*\{?)", r"((?!(?:if|then|else|fi|for|do|done|while|case|esac|function)\b)[^\s#=({}]+(?:\s.*)?)$"),
    "dockerfile": (r"FROM\s", r"(?!RUN\b|FROM\b)[A-Z]+\s", r"(RUN\s.*)"),
}
for _same, _as in (("typescript", "javascript"), ("tsx", "javascript"), ("cpp", "c")):
    _PATTERNS[_same] = _PATTERNS[_as]
#: Languages in which a line is a call as a whole; in these, a signature is none.
_WHOLE, _NEITHER = ("bash", "ruby", "dockerfile", "sql"), ("bash", "ruby", "dockerfile")


def _capped(text: str) -> str:
    return text.strip().split("\n")[0].strip()[: X.LINE_CHARS]


def _pattern(i: int) -> Column:
    """The row's language's import (0), signature (1) or call (2) pattern."""
    known = [x for name, p in _PATTERNS.items() if p[i] for x in (F.lit(name), F.lit(f"^(?:{p[i]})"))]
    return F.element_at(F.create_map(*known), F.col("lang"))


def _starts(c: Column, i: int) -> Column:
    return F.coalesce(F.rlike(c, _pattern(i)), F.lit(False))


def pattern_evidence(rows: DataFrame) -> DataFrame:
    """Imports, signatures and calls by whole lines of (path, lang, line, raw) rows."""
    text, lang, pattern, starts = F.col("text"), F.col("lang"), _pattern, _starts

    def out(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.substring(strip(value), 1, X.LINE_CHARS).alias("text"))

    t = rows.where(lang.isin(*_PATTERNS)).withColumn("text", strip(F.col("raw"))).where((text != "") & ~(lang.isin("bash", "yaml", "dockerfile") & F.startswith(text, F.lit("#"))))
    t = t.withColumns({"imports": starts(text, 0), "signs": starts(text, 1)})
    inner = F.ltrim(text, F.lit("- "))  # an item that holds a pair is both
    pair = (lang == "yaml") & (inner != text) & starts(inner, 1)
    called = F.call_function("regexp_extract", text, pattern(2), F.when(lang == "sql", 0).otherwise(1))
    calls = lang.isin(*_WHOLE) & ~(F.col("signs") & lang.isin(*_NEITHER)) & starts(text, 2)
    found = F.array(F.when(F.col("signs"), out("signature", text)), F.when(F.col("signs") & pair, out("signature", inner)), F.when(calls, out("call", called)))
    found = F.when(F.col("imports"), F.array(out("import", text))).otherwise(found)
    return t.select("path", "lang", "line", F.explode(F.array_compact(found)).alias("e")).select("path", "lang", F.col("e.kind").alias("kind"), "line", F.col("e.text").alias("text"))


def lexed_evidence(lines: DataFrame) -> DataFrame:
    """Evidence of (path, lang, line, raw) rows: comments and strings hold none, calls may lie on several lines."""
    seen = cut(lexed(lines))  # read by patterns and by statements
    code = seen.where((F.col("state") == 0) & (F.btrim("code") != ""))
    calling = seen.where(F.col("lang").isin(*CALLING))  # an import calls nothing
    calling = calling.withColumn("code", F.when((F.col("state") == 0) & _starts(strip(F.col("raw")), 0), F.lit("")).otherwise(F.col("code")))
    named = calls(statements(calling))
    first = F.substring(strip(F.substring_index("text", "\n", 1)), 1, X.LINE_CHARS)
    named = named.where((F.col("lang") == "zig") | ~F.startswith("text", F.lit("@"))).select("path", "lang", F.lit("call").alias("kind"), "line", first.alias("text"))
    return pattern_evidence(code).unionByName(named)


def by_ast(text: str) -> Iterator[tuple[str, int, str]] | None:
    """Python: imports, definitions, and the callee of each call; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    source = text.split("\n")

    def segment(node: ast.AST) -> str:
        return _capped(ast.get_source_segment(text, node) or source[node.lineno - 1])

    def walk() -> Iterator[tuple[str, int, str]]:
        for node in ast.walk(tree):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                yield "import", node.lineno, segment(node)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield "signature", node.lineno, _capped(source[node.lineno - 1])
            elif isinstance(node, ast.Call):
                yield "call", node.lineno, segment(node.func)

    return walk()


def _parsed(files: DataFrame) -> DataFrame:
    """Evidence of Python files; a file that does not parse has one row of kind ``unparsed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = by_ast(text)
                rows += [(path, lang, "unparsed", 0, "")] if found is None else ((path, lang, k, n, t) for k, n, t in {*found} if t)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()))], ["path", "lang", "kind", "line", "text"])

    ship_code(files.sparkSession)
    return files.mapInArrow(run, EVIDENCE)


def syntax_evidence(files: DataFrame) -> DataFrame:
    """Evidence of the other languages: Python by its syntax tree, the others and what does not parse by the lexer."""
    text = utf8(F.col("content")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    files = files.where(~F.col("lang").isin(*LINE_LANGS)).select("path", "lang", text.alias("content"))
    python = cut(_parsed(files.where("lang = 'python'")))
    left = files.where("lang = 'python'").join(python.where("kind = 'unparsed'").select("path"), "path", "left_semi")
    lines = file_lines(files.where("lang <> 'python'").unionByName(left.select(*files.columns)))
    plain = pattern_evidence(lines.where(~F.col("lang").isin(*LEXIS)))
    return python.where("kind <> 'unparsed'").unionByName(plain).unionByName(lexed_evidence(lines)).distinct()


def _leaves(text: Column) -> Column:
    """An import that is not followed."""
    return any_of(F.startswith(F.ltrim(text), F.lit(s)) for s in X.EXTERNAL_STARTS)


def external(evidence: DataFrame) -> DataFrame:
    """(path, lang, kind external, no line, marked text) of imports that are not followed."""
    rows = evidence.where((F.col("kind") == "import") & _leaves(F.col("text")))
    return rows.select("path", "lang", F.lit("external").alias("kind"), F.lit(None).cast("int").alias("line"), F.concat(F.lit(X.EXTERNAL_MARK), "text").alias("text")).distinct()


def dehydrate(files: DataFrame, max_bytes: int = X.MAX_BYTES) -> DataFrame:
    """All evidence of the files that are supported and small enough."""
    read = routed(files, max_bytes).where("status = 'dehydrated'")
    return line_evidence(file_lines(read)).unionByName(syntax_evidence(read))


def records(evidence: DataFrame, follow: bool = True) -> DataFrame:
    """One nested record per file: lists sorted and distinct, locations by (line, kind, text).

    A file's rows are collected once, all lists are parts of that one.  Without ``follow``, imports that lead out
    are marked here, as rows of ``external`` would be.
    """
    rows = evidence.select("path", "lang", F.struct("line", "kind", "text").alias("row"))
    files = rows.groupBy("path", "lang").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def texts(kind: str) -> Column:
        return F.transform(F.filter("rows", lambda r: (r["kind"] == kind) & r["text"].isNotNull()), lambda r: r["text"])

    lists = {f"{k}s": F.sort_array(F.array_distinct(texts(k))) for k in ("import", "signature", "call")}
    marked = F.transform(F.filter(texts("import"), _leaves), lambda t: F.concat(F.lit(X.EXTERNAL_MARK), t))
    leaving = texts("external") if follow else F.concat(texts("external"), marked)
    places = F.filter("rows", lambda r: r["kind"] != "external")
    return files.select("path", "lang", *(v.alias(n) for n, v in lists.items()), places.alias("locations"), F.sort_array(F.array_distinct(leaving)).alias("external"))

