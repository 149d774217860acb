"""Saved reports: ``<stem>-<day>-NNN.md``, rows written by the executors, the number claimed at commit.

``rows.write.format("report").option("folder", ...).mode("append").save()`` takes a frame with one string column, a
line each, in the order of its partitions.  Each task writes a part of its own into a hidden folder beside the
reports.  The commit joins the parts of the tasks that succeeded, in order and a block at a time, and links the whole
file under the next free number of the day: of two jobs at the same time each gets a number of its own, and no
report is ever seen half written.  A job that fails leaves nothing; a lost executor's task is written anew under another name.

Options: ``folder`` (shared by driver and executors), ``day`` (YYYYMMDD, default: today in UTC), ``stem``, ``head``
(text before the rows), ``none`` (text in place of rows where there are none).

Cases: null rows are empty lines; no rows give ``head`` and ``none`` alone; other or further columns are an error.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STEM = "audit-result"


def utc_day() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d")


def claim(done: Path, folder: Path, day: str, stem: str = STEM) -> Path:
    """Give the finished file ``done`` the next free number of the day; the link fails where another job was faster."""
    number = re.compile(re.escape(f"{stem}-{day}-") + r"([0-9]+)\.md")
    while True:
        taken = [int(m[1]) for p in folder.iterdir() if (m := number.fullmatch(p.name))]
        path = folder / f"{stem}-{day}-{max(taken, default=0) + 1:03d}.md"
        try:
            os.link(done, path)
        except FileExistsError:
            continue
        done.unlink()
        return path


@dataclass
class Part(WriterCommitMessage):
    index: int
    name: str
    rows: int


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.day, self.stem = Path(options["folder"].removeprefix("file:")), options.get("day") or utc_day(), options.get("stem", STEM)
        self.head, self.none = options.get("head", ""), options.get("none", "")
        self.parts = self.folder / f".{self.stem}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        task = TaskContext.get()
        part = Part(task.partitionId(), f"{task.partitionId()}-{task.taskAttemptId()}", 0)
        self.parts.mkdir(parents=True, exist_ok=True)
        with open(self.parts / part.name, "w", encoding="utf-8", newline="") as out:
            for batch in iterator:
                out.writelines((x or "") + "\n" for x in batch.column(0).to_pylist())
                part.rows += batch.num_rows
        return part

    def commit(self, messages: list[Part | None]) -> None:
        self.parts.mkdir(parents=True, exist_ok=True)
        good = sorted((m for m in messages if m is not None), key=lambda m: m.index)
        done = self.parts / "report"
        with open(done, "wb") as out:
            out.write(self.head.encode())
            for m in good:
                with open(self.parts / m.name, "rb") as part:
                    shutil.copyfileobj(part, out)
            if not any(m.rows for m in good):
                out.write(self.none.encode())
        claim(done, self.folder, self.day, self.stem)
        shutil.rmtree(self.parts)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if overwrite or [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("a report takes one string column and is never overwritten")
        return ReportWriter(dict(self.options))


def save_rows(rows: DataFrame, folder: str, **options: str) -> None:
    """Write the lines of ``rows`` as the day's next report."""
    from ..session import ship_code

    spark = rows.sparkSession
    ship_code(spark)
    spark.createDataFrame([], "x int")  # makes the session active in this thread, where data sources are looked up
    spark.dataSource.register(ReportSource)
    rows.write.format("report").options(folder=folder, **options).mode("append").save()
