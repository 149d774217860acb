"""A source tree as a table: file(path, length, mode, content), hidden files included.

Spark's own binary source leaves out names that begin with a dot or an underscore, so workflows would
vanish; ``read_tree`` lists folders on the executors in rounds, prunes what ignore files hide and reads
contents there.  Content of files over ``maxBytes`` is never read.  The tree must be on storage that all
executors mount; on other storage, use ``from_binary`` over paths that Spark lists, and ``without_ignored``.

    read_tree(spark, "/trees/pkg", maxBytes=524288)
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from ..functions import fixed as X
from ..operators.seed import placed
from ..session import cut, ship_code

SCHEMA = "seq long, path string, length long, mode int, content binary, read_failed boolean"


def _glob(pattern: str) -> str:
    """A path pattern as a regular expression: * and ? stay within a component, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out, i = out + "(?!/)[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


class Ignores:
    """The rules of one ignore file: last match wins, ! re-includes, / anchors, trailing / means directories."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for raw in text.splitlines():
            line = raw.rstrip("\r")
            line = line.rstrip(" ") + (" " if line.rstrip(" ").endswith("\\") else "")
            if not line or line.startswith("#"):
                continue
            again = line.startswith("!")
            line = line[1:] if again else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            if not line:
                continue
            inside = _glob(line.lstrip("/") if "/" in line else f"**/{line}")
            try:
                self.rules.append((re.compile(inside + r"\Z", re.S), again, folder))
            except re.error:  # an invalid class: such a line matches nothing
                continue

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        out = None
        for pattern, again, folder in self.rules:
            if (is_dir or not folder) and pattern.match(rel):
                out = not again
        return out


@functools.lru_cache(maxsize=4096)
def _compiled(text: str) -> Ignores:
    return Ignores(text)


def _text(*parts: str) -> str | None:
    try:
        with open(os.path.join(*parts), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


class Rules:
    """The ignore files that hold in a folder: rows (folder, prefix, text), outermost first.

    ``.ignore`` files hold everywhere; ``.gitignore`` files only inside a git work tree, from its top folder
    (where ``.git`` stands) down, and so does its exclude file.  Of those, ``.ignore`` comes first, then ``.gitignore``,
    then the exclude file; of one kind the innermost that has a match decides.  Files of folders above the
    root hold as well: their prefix leads from them to the root.  The user's own files do not.
    """

    def __init__(self, ignore: list | None = None, git: list | None = None, exclude: list | None = None):
        self.ignore, self.git, self.exclude = ignore or [], git, exclude or []

    def dumps(self) -> str:
        return json.dumps([self.ignore, self.git, self.exclude])

    def entered(self, folder: str, rel: str, prefix: str = "") -> Rules:
        """Those inside a folder."""
        ignore, git, exclude = self.ignore, self.git, self.exclude
        if os.path.lexists(os.path.join(folder, ".git")):
            more = _text(folder, ".git", "info", "exclude")
            git, exclude = [], [[rel, prefix, more]] if more else []
        if git is not None and (more := _text(folder, ".gitignore")):
            git = [*git, [rel, prefix, more]]
        if more := _text(folder, ".ignore"):
            ignore = [*ignore, [rel, prefix, more]]
        return Rules(ignore, git, exclude)

    @classmethod
    def above(cls, root: str) -> Rules:
        """Those of the folders that hold the root."""
        rules, chain = cls(), []
        while (up := os.path.dirname(root if not chain else chain[-1])) not in chain and up != (chain[-1] if chain else root):
            chain.append(up)
        for folder in reversed(chain):
            rules = rules.entered(folder, "", os.path.relpath(root, folder).replace(os.sep, "/") + "/")
        return rules

    def hide(self, path: str, is_dir: bool) -> bool:
        for files in (self.ignore, self.git or [], self.exclude):
            for base, prefix, text in reversed(files):
                v = _compiled(text).verdict(prefix + (path[len(base) + 1 :] if base else path), is_dir)
                if v is not None:
                    return v
        return False


def _entries(root: str, rel: str, rules: Rules, names: set[str]) -> Iterator[tuple[str, int, int, bool]]:
    """(path, length, mode, is folder) of what a folder holds; unreadable entries are passed over."""
    try:
        scan = os.scandir(os.path.join(root, rel))
    except OSError:
        return
    with scan:
        for e in scan:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                path.encode()  # a name that is not UTF-8 cannot be a row
                is_dir = e.is_dir(follow_symlinks=False)
                if e.name in names or rules.hide(path, is_dir):
                    continue
                if is_dir:
                    yield path, 0, 0, True
                elif e.is_file(follow_symlinks=False):
                    st = e.stat(follow_symlinks=False)
                    yield path, st.st_size, st.st_mode & 0o7777, False
            except (OSError, UnicodeEncodeError):
                continue


def _explored(root: str, rel: str, rules: Rules, names: set[str], budget: int) -> Iterator[tuple[str, int, int, str | None]]:
    """(path, length, mode, rules) of the files below a folder; after ``budget`` entries, of folders yet to be
    explored, with the rules that lead to them."""
    todo, n = [(rel, rules)], 0
    while todo:
        rel, rules = todo.pop()
        if n >= budget:
            yield rel, 0, 0, rules.dumps()
            continue
        inner = rules.entered(os.path.join(root, rel), rel)
        for path, length, mode, is_dir in _entries(root, rel, inner, names):
            n += 1
            if is_dir:
                todo.append((path, inner))
            else:
                yield path, length, mode, None


def walk(root: str, ignores: tuple[str, ...] = X.DEFAULT_IGNORES) -> Iterator[tuple[str, int, int]]:
    """(path, length, mode) of a small tree's files in byte order of paths, in this process."""
    found = _explored(root, "", Rules.above(os.path.abspath(root)), {*ignores, *X.VCS_DIRS}, sys.maxsize)
    return iter(sorted(((p, n, m) for p, n, m, _ in found), key=lambda x: x[0].encode()))


#: Entries that a task lists before it hands back the folders that are left.
LISTED = 20_000


def listing(spark: SparkSession, root: str, ignores: tuple[str, ...] = X.DEFAULT_IGNORES, listed: int = LISTED) -> DataFrame:
    """(path, length, mode) of a tree's files, listed on the executors.

    Folders are a frontier table: a task explores the folders it has and hands back those that are left
    after some entries, which are dealt out again.  Nothing but the number of folders reaches the
    driver; a lost executor repeats its part of one round.
    """
    names = {*ignores, *X.VCS_DIRS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _explored(root, rel, Rules(*json.loads(state)), names, listed)
                while rows := list(itertools.islice(found, 8192)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], ["path", "length", "mode", "rules"])

    ship_code(spark)
    frontier, rounds = spark.createDataFrame([("", Rules.above(os.path.abspath(root)).dumps())], "path string, rules string"), []
    while True:
        out = cut(frontier.mapInArrow(run, "path string, length long, mode int, rules string"))
        rounds.append(out.where("rules is null").drop("rules"))
        left = out.where("rules is not null").select("path", "rules")
        n = left.count()
        if not n:
            break
        frontier = left.repartition(min(n, 16 * spark.sparkContext.defaultParallelism))
    return functools.reduce(DataFrame.unionByName, rounds)


def numbered(files: DataFrame) -> DataFrame:
    """``seq``: the place of each file in byte order of paths, over ranges of paths and then over the ranges."""
    ones = files.withColumn("one", F.lit(1))
    return placed(ones, "one", ["path"], []).drop("one").withColumnRenamed("start", "seq")


def read_contents(files: DataFrame, root: str, max_bytes: int = X.MAX_BYTES, wanted: Column | None = None, part_bytes: int = 16 << 20) -> DataFrame:
    """The files with their contents; those too large or not ``wanted`` are not opened and have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                contents, failed = [], []
                for path, want in zip(part.column("path").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    contents.append(None)
                    failed.append(False)
                    if want:
                        try:
                            with open(os.path.join(root, path), "rb") as f:
                                contents[-1] = f.read()
                        except OSError:
                            failed[-1] = True
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("seq", "path", "length", "mode")), pa.array(contents, pa.binary()), pa.array(failed, pa.bool_())], ["seq", "path", "length", "mode", "content", "read_failed"])

    want = F.col("length") <= max_bytes if wanted is None else (F.col("length") <= max_bytes) & F.coalesce(wanted, F.lit(False))
    files = files.select("seq", "path", "length", "mode", want.alias("wanted"))
    size = files.agg(F.sum(F.when(F.col("wanted"), F.col("length")).otherwise(0) + 4096)).first()[0] or 0
    return files.repartition(max(1, -(-size // part_bytes)), "seq").mapInArrow(run, SCHEMA)


class _Part(InputPartition):
    def __init__(self, files: list[tuple[int, str, int, int]]):
        self.files = files


#: How pushed filters look at a value.
_TESTS = {
    EqualTo: lambda v, f: v == f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
    In: lambda v, f: v in f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value), StringContains: lambda v, f: f.value in v, IsNotNull: lambda v, f: True,
}


class _Reader(DataSourceReader):
    """A small tree; with ``spark.sql.python.filterPushdown.enabled``, conditions on path, length and mode drop
    files before they are opened."""

    COLUMNS = ("seq", "path", "length", "mode")

    def __init__(self, root: str, max_bytes: int, ignores: tuple[str, ...], part_bytes: int):
        self.root, self.max_bytes, self.ignores, self.part_bytes = root, max_bytes, ignores, part_bytes
        self.pushed: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.COLUMNS:
                self.pushed.append((self.COLUMNS.index(f.attribute[0]), f))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        parts, now, size = [], [], 0
        for seq, (path, length, mode) in enumerate(walk(self.root, self.ignores)):
            row = (seq, path, length, mode)
            if not all(_TESTS[type(f)](row[i], f) for i, f in self.pushed):
                continue
            now.append(row)
            size += min(length, self.max_bytes) + 4096
            if size >= self.part_bytes:
                parts.append(_Part(now))
                now, size = [], 0
        return [*parts, _Part(now)] if now or not parts else parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for seq, path, length, mode in partition.files:
            content, failed = None, False
            if length <= self.max_bytes:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    failed = True
            yield seq, path, length, mode, content, failed


class TreeSource(DataSource):
    """``spark.read.format("tree")``: a tree that the driver can list; ``read_tree`` has no such bound."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        ignores = tuple(x for x in o["ignores"].split(",") if x) if "ignores" in o else X.DEFAULT_IGNORES
        root = module_root(o["path"], o.get("module"))
        return _Reader(root, int(o.get("maxBytes", X.MAX_BYTES)), ignores, int(o.get("partitionBytes", 16 << 20)))


def module_root(root: str, module: str | None) -> str:
    """The folder of a module, which must lie inside the root."""
    top = os.path.realpath(root)
    if not os.path.isdir(top):
        raise ValueError(f"not a directory: {root}")
    if not module:
        return top
    inner = os.path.realpath(os.path.join(top, module))
    if inner != top and not inner.startswith(top + os.sep) or not os.path.isdir(inner):
        raise ValueError(f"module is not a directory inside the root: {module}")
    return inner


def read_tree(spark: SparkSession, root: str, wanted: Column | None = None, **options) -> DataFrame:
    """A tree listed and read on the executors; ``wanted`` is a condition on path, length and mode, without
    which a file is listed but not opened.  Options: maxBytes, ignores (comma-separated), module, listed, partitionBytes."""
    top = module_root(root, options.get("module"))
    ignores = tuple(x for x in options["ignores"].split(",") if x) if "ignores" in options else X.DEFAULT_IGNORES
    files = cut(numbered(listing(spark, top, ignores, int(options.get("listed", LISTED)))))
    return read_contents(files, top, int(options.get("maxBytes", X.MAX_BYTES)), wanted, int(options.get("partitionBytes", 16 << 20)))


#: (folder, kind, place, expression, again, folders): the rules of ignore files; kind 2: .ignore, 1: .gitignore, 0: exclude
#: file; a row of kind null says that the folder is the top of a git work tree.
RULES = "folder string, kind int, place int, expression string, again boolean, folders boolean"


def rules_of(files: DataFrame) -> DataFrame:
    """The rules in a listing that has contents (path, content): of its ignore files, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {".ignore": 2, ".gitignore": 1, "exclude": 0}
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                folder = folder.removesuffix(".git/info").rstrip("/") if name == "exclude" else folder
                rows += [(folder, kinds[name], i, f"^(?s:{p.pattern.removesuffix(chr(92) + 'Z')})\\z", again, only) for i, (p, again, only) in enumerate(_compiled(text or "").rules)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], ["folder", "kind", "place", "expression", "again", "folders"])

    ship_code(files.sparkSession)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    named = files.where(F.substring_index("path", "/", -1).isin(".ignore", ".gitignore") | F.col("path").rlike(r"(^|/)\.git/info/exclude$"))
    found = named.select("path", text.alias("content")).mapInArrow(run, RULES)
    tops = files.where(F.col("path").rlike(r"(^|/)\.git(/|$)")).select(F.regexp_replace("path", r"(^|/)\.git(/.*)?$", "").alias("folder")).distinct()
    none = {n: F.lit(None).cast(t) for n, t in (x.split() for x in RULES.split(", ")[1:])}
    return found.unionByName(tops.select("folder", *(c.alias(n) for n, c in none.items())))


def _ancestors(path: Column) -> Column:
    """The folders that hold a path, outermost first; the first is the root, ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def without_ignored(files: DataFrame, rules: DataFrame, ignores: tuple[str, ...] = X.DEFAULT_IGNORES) -> DataFrame:
    """The files of any listing (path, ...) that no rule and no name hides: rules are a relation.

    Every file and every folder that holds one is a place; a place meets the rules of the folders above it
    by an equi-join on folder, and the last match (by kind, depth and order) decides.  A hidden folder hides all below.
    """
    paths = files.select("path").distinct()
    places = paths.select(F.col("path").alias("place_path"), F.lit(False).alias("is_dir")).unionByName(
        paths.select(F.explode(F.slice(_ancestors(F.col("path")), F.lit(2), F.size(F.split("path", "/")))).alias("place_path"), F.lit(True).alias("is_dir"))
    ).distinct()
    each = places.select("place_path", "is_dir", F.explode(_ancestors(F.col("place_path"))).alias("folder"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    met = each.join(rules, "folder").withColumn("depth", depth)
    rel = F.when(F.col("folder") == "", F.col("place_path")).otherwise(F.substring("place_path", F.char_length("folder") + 2, F.char_length("place_path")))
    hits = F.col("kind").isNull() | ((F.col("is_dir") | ~F.col("folders")) & F.rlike(rel, F.col("expression")))
    met = met.where(hits).groupBy("place_path", "is_dir").agg(F.max(F.when(F.col("kind").isNull(), F.col("depth"))).alias("top"), F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "depth", "place", "again"))).alias("m"))
    live = F.filter("m", lambda r: (r["kind"] == 2) | (r["depth"] >= F.col("top")))
    hidden = met.where(~F.array_max(live)["again"]).select(F.col("place_path").alias("hidden"))
    odd = places.where(F.substring_index("place_path", "/", -1).isin(*ignores, *X.VCS_DIRS)).select(F.col("place_path").alias("hidden"))
    held = paths.select("path", F.explode(F.concat(_ancestors(F.col("path")), F.array("path"))).alias("hidden"))
    gone = held.join(hidden.unionByName(odd).distinct(), "hidden", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")


def from_binary(files: DataFrame, root: str) -> DataFrame:
    """The same shape from Spark's binary files, for stores that only Spark reads (no hidden files)."""
    rel = F.substring(F.col("path"), F.instr("path", F.lit(root)) + len(root.rstrip("/")) + 1, F.lit(1 << 20))
    return files.select(F.lit(None).cast("long").alias("seq"), rel.alias("path"), "length", F.lit(0o644).alias("mode"), "content", F.lit(False).alias("read_failed"))
