"""Code without its comments and strings: lexer states of lines by a prefix scan.

A line is a function from the state on entry (code, or one of the comments and strings that cross lines)
to the state on exit and the change of bracket depth.  Functions compose, and composition is associative:
they are folded over ranges of lines, the ranges of a file are scanned, and each range's lines then are
scanned from its entry.  So a file of any length is read in ranges, in parallel, and every line knows its
state without a parser that walks the file.

From the states follow the code of each line, and the statements: lines that a bracket, or in most languages
a missing end mark, holds together.  Patterns on statements find calls whose name and bracket lie on
several lines, and nothing inside comments and strings.

Files whose content is at hand (``file_states``, ``file_calls``) need no scan: a file is one row already, one regular
expression takes the comments and strings out of it, and neither a line is shuffled nor a state written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines as lines_of
from ..session import cut, ship_code

#: Lines that are folded together.
RANGE = 64
_TEXT, _CHAR = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'"
_BLOCK = ("/*", "*/")


@dataclass(frozen=True)
class Lexis:
    """line: what opens a comment to the end of the line; across: comments and strings over lines, (open, close);
    strings: expressions of strings within a line; ends: whether a line end ends a statement outside brackets."""

    line: tuple[str, ...]
    across: tuple[tuple[str, str], ...]
    strings: tuple[str, ...] = (_TEXT, _CHAR)
    ends: bool = False

    def tokens(self) -> str:
        """Everything in a line that is not code; group 1 is what opens something that the line does not close."""
        q = re.escape
        closed = [f"{q(a)}.*?{q(b)}" for a, b in self.across]
        opened = [f"({'|'.join(q(a) for a, _ in self.across)}).*"] if self.across else ["(\\A\\z)"]
        marks = {x[0] for x in (*(a for a, _ in self.across), *self.line, *self.strings)}  # nothing else begins a token
        return f"(?=[{''.join(map(q, sorted(marks)))}])(?:{'|'.join([*closed, *opened, *(f'{q(x)}.*' for x in self.line), *self.strings])})"


_C = Lexis(("//",), (_BLOCK,))
#: Lexical facts of the languages.
LEXIS: dict[str, Lexis] = {
    "c": _C,
    "cpp": _C,
    "java": Lexis(("//",), (_BLOCK, ('"""', '"""'))),
    "csharp": Lexis(("//",), (_BLOCK, ('"""', '"""'))),
    "dart": Lexis(("//",), (_BLOCK, ('"""', '"""'), ("'''", "'''"))),
    "php": Lexis(("//", "#"), (_BLOCK,)),
    "javascript": Lexis(("//",), (_BLOCK, ("`", "`"))),
    "typescript": Lexis(("//",), (_BLOCK, ("`", "`"))),
    "tsx": Lexis(("//",), (_BLOCK, ("`", "`"))),
    "rust": Lexis(("//",), (_BLOCK, ('r#"', '"#')), (_TEXT, r"'(?:\\[^']*|[^'\\])'")),
    "go": Lexis(("//",), (_BLOCK, ("`", "`")), ends=True),
    "kotlin": Lexis(("//",), (_BLOCK, ('"""', '"""')), ends=True),
    "swift": Lexis(("//",), (_BLOCK, ('"""', '"""')), (_TEXT,), ends=True),
    "zig": Lexis(("//",), (), ends=False),
    "python": Lexis(("#",), (('"""', '"""'), ("'''", "'''")), ends=True),
    "ruby": Lexis(("#",), (("=begin", "=end"),), ends=True),
    "sql": Lexis(("--",), (_BLOCK,)),
    "hcl": Lexis(("#", "//"), (_BLOCK,), (_TEXT,), ends=True),
    "css": Lexis((), (_BLOCK,)),
    "html": Lexis((), (("<!--", "-->"),), ()),
    "vue": Lexis((), (("<!--", "-->"),), ()),
    "svelte": Lexis((), (("<!--", "-->"),), ()),
}
#: Languages in which calls are a name and a bracket.
CALLING = ("c", "cpp", "java", "csharp", "dart", "php", "javascript", "typescript", "tsx", "rust", "go", "kotlin", "swift", "zig", "python")


def _of(lang: Column, value) -> Column:
    """A fact of the row's language."""
    pairs = [x for name, lexis in LEXIS.items() for x in (F.lit(name), value(lexis))]
    return F.element_at(F.create_map(*pairs), lang)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def code_of(text: Column, tokens: Column) -> Column:
    """The text without comments and strings; what it leaves open stays at the end."""
    return F.regexp_replace(text, tokens, F.lit(" $1"))


def _brackets(code: Column) -> Column:
    return F.char_length(F.translate(code, ")]", "")) - F.char_length(F.translate(code, "([", ""))


def _exit(code: Column, opens: Column) -> Column:
    """The state after a line of code: 0, or the number of what it leaves open."""
    return F.array_position(F.transform(opens, lambda o: F.endswith(code, o)), True).cast("int")


def _entered(raw: Column, state: Column, closes: Column) -> Column:
    """The part of a line that is code when it is entered in a state; null if none is."""
    close = F.get(closes, state - 1)
    at = F.call_function("instr", raw, close)
    after = F.substring(raw, at + F.char_length(close), F.char_length(raw))
    return F.when(state == 0, raw).otherwise(F.when(at > 0, after))


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _step(raw: Column, state: Column, tokens: Column, opens: Column, closes: Column) -> Column:
    """(exit, depth): exit state and change of depth of a line that is entered in a state."""
    code = code_of(_entered(raw, state, closes), tokens)
    return _with(code, lambda c: F.struct(F.when(c.isNull(), state).otherwise(_exit(c, opens)).alias("exit"), F.coalesce(_brackets(c), F.lit(0)).alias("depth")))


def composed(first: Column, then: Column) -> Column:
    """The function of two stretches in a row."""
    return F.transform(first, lambda a: F.struct(F.get(then, a["exit"])["exit"].alias("exit"), (a["depth"] + F.get(then, a["exit"])["depth"]).alias("depth")))


_STATE = "struct<state:int,depth:int>"
_STATES = f"array<{_STATE}>"


def _scanned(functions: Column, entry: Column) -> Column:
    """The state on entry to each element, from the state on entry to the first."""
    start = F.struct(entry.alias("now"), F.array().cast(_STATES).alias("seen"))

    def step(acc: Column, f: Column) -> Column:
        g = F.get(f, acc["now"]["state"])
        now = F.struct(g["exit"].alias("state"), (acc["now"]["depth"] + g["depth"]).alias("depth"))
        return F.struct(now.alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen"))

    return F.aggregate(functions, start, step, lambda acc: acc["seen"])


def lexed(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, lang, line, raw, state, depth, code) of the lines (path, lang, line, raw) of languages in LEXIS.

    state, depth: on entry; code: the line without comments and strings, null if it has no code at all.
    """
    lines = lines.where(F.col("lang").isin(*LEXIS))
    lang = F.col("lang")
    tokens, opens, closes = _of(lang, lambda x: F.lit(x.tokens())), _of(lang, lambda x: _strings(a for a, _ in x.across)), _of(lang, lambda x: _strings(b for _, b in x.across))
    facts = lines.withColumns({"tokens": tokens, "opens": opens, "closes": closes})
    states = F.sequence(F.lit(0), F.size("opens"))
    f = F.transform(states, lambda s: _step(F.col("raw"), s, F.col("tokens"), F.col("opens"), F.col("closes")))
    # a stretch of lines, in order, with the function of each and of all
    ranges = facts.withColumn("f", f).groupBy("path", "lang", F.floor((F.col("line") - 1) / size).cast("int").alias("range"))
    ranges = ranges.agg(F.array_sort(F.collect_list(F.struct("line", "raw", "f"))).alias("lines"), F.first("opens").alias("opens"))
    same = F.transform(F.sequence(F.lit(0), F.size("opens")), lambda s: F.struct(s.alias("exit"), F.lit(0).alias("depth")))
    ranges = ranges.withColumn("all", F.aggregate(F.transform("lines", lambda x: x["f"]), same, composed)).drop("opens")
    ranges = cut(ranges)  # read for the states between stretches, and within them
    # where each stretch begins
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("depth"))
    files = ranges.groupBy("path", "lang").agg(F.array_sort(F.collect_list(F.struct("range", "all"))).alias("r"))
    files = files.select("path", "lang", F.explode(F.arrays_zip(F.transform("r", lambda x: x["range"]).alias("range"), _scanned(F.transform("r", lambda x: x["all"]), start).alias("entry"))).alias("e"))
    ranges = ranges.drop("all").join(files.select("path", "lang", "e.range", "e.entry"), ["path", "lang", "range"])
    seen = _scanned(F.transform("lines", lambda x: x["f"]), F.col("entry"))
    out = ranges.select("path", "lang", F.explode(F.arrays_zip(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["raw"].alias("raw"))).alias("x"), seen.alias("s"))).alias("e"))
    out = out.select("path", "lang", "e.x.line", "e.x.raw", "e.s.state", "e.s.depth")
    code = code_of(_entered(F.col("raw"), F.col("state"), closes), tokens)

    def closed(c: Column) -> Column:  # without the mark that the line leaves open
        return F.substring(c, F.lit(1), F.char_length(c) - F.coalesce(F.char_length(F.get(opens, _exit(c, opens) - 1)), F.lit(0)))

    return out.withColumn("code", _with(code, closed))


def statements(rows: DataFrame) -> DataFrame:
    """(path, lang, line, code) of statements: the code of their lines, joined by line feeds; line: the first.

    A line opens a statement if no bracket is open before it and the code before it has ended: at a line end
    in some languages (a line that begins with a point goes on), at one of ; { } : , in the others.
    """
    # one file's lines in order: all that depends on the line before
    order = Window.partitionBy("path", "lang").orderBy("line")
    code = F.btrim(F.coalesce("code", F.lit("")))
    before = F.last(F.when(code != "", code), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = _of(F.col("lang"), lambda x: F.lit(x.ends))
    ended = before.isNull() | before.rlike(r"[;{}:,]\z") | (ends & ~F.startswith(code, F.lit(".")) & ~before.rlike(r"\.\z"))
    opens = (F.col("depth") <= 0) & (code != "") & ended
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("of", F.coalesce(F.last(F.when(F.col("opens"), F.col("line")), ignorenulls=True).over(order), F.lit(1)))
    joined = F.array_sort(F.collect_list(F.struct("line", F.coalesce("code", F.lit("")).alias("code"))))
    return rows.groupBy("path", "lang", F.col("of").alias("line")).agg(joined.alias("l")).select("path", "lang", F.get(F.transform("l", lambda x: x["line"]), F.lit(0)).alias("line"), F.array_join(F.transform("l", lambda x: x["code"]), "\n").alias("code"))


#: A name, its parts joined by . :: -> ?. , over lines too.
NAME = r"(?<![\w$@])@?[A-Za-z_$][\w$]*+(?:\s*+(?:\.|::|->|\?\.)\s*+[A-Za-z_$][\w$]*+!?)*+!?"
#: group 1: a word that makes it a definition, group 2: the name that is called.
CALL = rf"(?:\b(fn|func|function|fun|def|class|new\s+class)\s+)?({NAME})\s*+(?:::<[^()]*>)?\("
#: Words before a bracket that are no calls.
NOT_CALLED = ("if", "for", "while", "switch", "catch", "return", "match", "fn", "func", "function", "fun", "def", "sizeof", "and", "or", "not", "in", "elif", "with", "except", "lambda")

#: Words that open a group of declarations in Go.
GROUPS = ("import", "const", "var", "type")


def _feeds(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, "\n", ""))


def calls(rows: DataFrame) -> DataFrame:
    """(path, lang, line, text): the name of every call in statements, at the line on which the name begins.

    Lines are counted along the pieces between the matches and the matches themselves.
    """
    found = rows.where(F.contains("code", F.lit("("))).withColumns({
        "whole": F.regexp_extract_all("code", F.lit(CALL), 0),
        "kind": F.regexp_extract_all("code", F.lit(CALL), 1),
        "name": F.regexp_extract_all("code", F.lit(CALL), 2),
        "between": F.split("code", CALL, -1),
    })
    feeds = F.transform("between", _feeds)
    inner = F.transform("whole", _feeds)

    def step(acc: Column, i: Column) -> Column:
        line = acc["line"] + F.get(feeds, i)
        return F.struct((line + F.get(inner, i)).alias("line"), F.concat(acc["at"], F.array(line)).alias("at"))

    places = F.sequence(F.lit(0), F.size("name") - 1)
    at = F.aggregate(places, F.struct(F.col("line").cast("int").alias("line"), F.array().cast("array<int>").alias("at")), step, lambda acc: acc["at"])
    each = found.where(F.size("name") > 0).select("path", "lang", F.explode(F.arrays_zip(at.alias("line"), F.col("kind"), F.col("name"), F.col("whole"))).alias("c"))
    group = (F.col("lang") == "go") & F.col("c.name").isin(*GROUPS)
    return each.where((F.coalesce("c.kind", F.lit("")) == "") & ~F.col("c.name").isin(*NOT_CALLED) & ~group).select("path", "lang", "c.line", F.col("c.name").alias("text"))


# ---- whole files ------------------------------------------------------------------------------------

@cache
def _blanked(lang: str) -> re.Pattern:
    """What is not code in a file; group n is the opening mark of the n-th comment or string over lines."""
    x, q = LEXIS[lang], re.escape
    across = [f"({q(a)})[\\s\\S]*?(?:{q(b)}|\\Z)" for a, b in x.across]
    within = [t.replace("[^", "[^\\n") for t in x.strings]
    return re.compile("|".join([*across, *(f"{q(m)}.*" for m in x.line), *within]) or r"(?!)")


def code_and_states(lang: str, text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A file's code, with all its line feeds, and (state, first, last) of the lines (from 0) that are entered in a state."""
    inside: list[tuple[int, int, int]] = []
    line = at = 0

    def blank(m: re.Match) -> str:
        nonlocal line, at
        if not m.lastindex or not (n := text.count("\n", m.start(), m.end())):
            return " "
        line, at = line + text.count("\n", at, m.start()) + n, m.end()
        inside.append((m.lastindex, line - n + 1, line))
        return " " + "\n" * n

    return _blanked(lang).sub(blank, text), inside


def entry_depths(code: str) -> np.ndarray:
    """Open brackets before each line."""
    b = np.frombuffer(code.encode("utf-8", "surrogatepass"), np.uint8)
    step = np.isin(b, np.frombuffer(b"([", np.uint8)).astype(np.int32) - np.isin(b, np.frombuffer(b")]", np.uint8))
    return np.concatenate([[0], np.cumsum(step, dtype=np.int32)[b == 10]]).astype(np.int32)


def statement_starts(lang: str, code: str) -> list[int]:
    """The lines (from 0) on which statements begin; see ``statements``."""
    depths, ends, before, starts = entry_depths(code).tolist(), LEXIS[lang].ends, "", []
    for i, (line, depth) in enumerate(zip(code.split("\n"), depths, strict=True)):
        if c := line.strip(" "):
            if depth <= 0 and (not before or before[-1] in ";{}:," or (ends and c[0] != "." and before[-1] != ".")):
                starts.append(i)
            before = c
    return starts if starts[:1] == [0] else [0, *starts]


_CALLS = re.compile(CALL, re.ASCII)


def calls_of(lang: str, code: str) -> Iterator[tuple[int, str]]:
    """(line from 0, name) of the calls in a file's code; none reaches over the end of a statement."""
    feeds = [-1, *(m.start() for m in re.finditer("\n", code)), len(code)]
    starts = statement_starts(lang, code)
    for first, after in zip(starts, [*starts[1:], len(feeds) - 1], strict=True):
        line, at = first, feeds[first] + 1
        for m in _CALLS.finditer(code, at, feeds[after]):
            line, at = line + code.count("\n", at, m.start()), m.start()
            if not m[1] and m[2] not in NOT_CALLED and not (lang == "go" and m[2] in GROUPS):
                yield line, m[2]


def _texts(files: DataFrame) -> DataFrame:
    """Files of languages in LEXIS, their lines as ``lines`` has them."""
    whole = F.array_join(lines_of(F.col("content")), "\n")
    plain = F.contains("content", F.lit("\r")) | F.endswith("content", F.lit("\n"))
    return files.where(F.col("lang").isin(*LEXIS)).select("path", "lang", F.when(plain, whole).otherwise(F.col("content")).alias("content"))


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str]]:
    return zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


def file_states(files: DataFrame) -> DataFrame:
    """(path, lang, lines) of files (path, lang, content): state and depth on entry to each line, as ``lexed`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, depths, sizes = [], [], [0]
            for _, lang, text in _columns(batch):
                code, inside = code_and_states(lang, text)
                depth = entry_depths(code)
                state = np.zeros(len(depth), np.int32)
                for s, first, last in inside:
                    state[first : last + 1] = s
                states.append(state), depths.append(depth), sizes.append(sizes[-1] + len(depth))
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int32)])) for x in (states, depths)], ["state", "depth"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)], ["path", "lang", "lines"])

    ship_code(files.sparkSession)
    return _texts(files).mapInArrow(run, f"path string, lang string, lines {_STATES}")


def file_calls(files: DataFrame, rows: int = 100_000) -> DataFrame:
    """(path, lang, line, text) of files (path, lang, content): what ``calls`` finds in their statements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], ["path", "lang", "line", "text"])

        out: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for path, lang, text in _columns(batch):
                found = [*calls_of(lang, code_and_states(lang, text)[0])]
                out[0].extend([path] * len(found)), out[1].extend([lang] * len(found))
                out[2].extend(n + 1 for n, _ in found), out[3].extend(t for _, t in found)
                if len(out[0]) >= rows:
                    yield made()
                    out = ([], [], [], [])
        yield made()

    ship_code(files.sparkSession)
    return _texts(files).mapInArrow(run, "path string, lang string, line int, text string")
