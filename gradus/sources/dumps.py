"""Clipboard dumps as a data source of their own, a file a paste, and reports."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Lines that say which payload follows, two lines on.
PLAIN, HTML = "text/plain", "text/html"
SCHEMA = "name string, plain string, html string, error string"


def _folder(options: dict) -> str:
    return re.sub(r"^file:(?://)?", "", options["path"])


def split_dump(text: str) -> tuple[str | None, str | None, str | None]:
    """Plain text, HTML and error of a dump.  The last marker of each kind counts; the plain
    payload ends at the HTML marker; without one of them there is an error."""
    lines = re.split(r"\r?\n", text)
    at = {line.strip(): i for i, line in enumerate(lines) if line.strip() in (PLAIN, HTML)}
    if len(at) < 2:
        return None, None, "no " + " and ".join(m for m in (PLAIN, HTML) if m not in at)
    return "\n".join(lines[at[PLAIN] + 2 : at[HTML]]).strip(), "\n".join(lines[at[HTML] + 2 :]).strip(), None


def join_dump(plain: str | None, html: str | None) -> str:
    return f"{PLAIN}\n\n{plain or ''}\n{HTML}\n\n{html or ''}\n"


class DumpFiles(DataSource):
    """`spark.read.format("dumps").load(folder)` and `df.write.format("dumps").save(folder)`.

    The folder is one that the driver and all executors mount.  Read: name, plain, html, error; a
    partition for each `files` files (option, 100).  Written: name, plain, html; a file a row.
    """

    @classmethod
    def name(cls) -> str:
        return "dumps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.files = _folder(options), int(options.get("files", 100))

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".txt"))
        return [InputPartition(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in partition.value:
            text = Path(self.folder, n).read_bytes().decode("utf-8", "replace")
            yield (n.removesuffix(".txt"), *split_dump(text))


@dataclass
class _Staged(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Tasks write into a folder of this write; the commit moves its files, an abort removes it.

    A task that ran twice has its own names in that folder, and only those that were reported
    move; so neither a failed task nor a failed write leaves a file among the others.
    """

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.folder, self.columns, self.overwrite = _folder(options), columns, overwrite
        self.stage = f"{self.folder}/.writing-{uuid.uuid4().hex}"
        os.makedirs(self.stage)

    def write(self, rows: Iterator) -> _Staged:
        own, files = uuid.uuid4().hex, []
        for row in rows:
            r = dict(zip(self.columns, row))
            if not r["name"] or "/" in r["name"]:
                raise ValueError(f"not a file name: {r['name']!r}")
            file = f"{own}-{r['name']}.txt"
            with open(f"{self.stage}/{file}", "w", encoding="utf-8", newline="") as out:
                out.write(join_dump(r.get("plain"), r.get("html")))
            files.append(file)
        return _Staged(files)

    def commit(self, messages: list) -> None:
        staged = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for n in os.listdir(self.folder):
                if n.endswith(".txt"):
                    os.remove(f"{self.folder}/{n}")
        for f in staged:
            os.replace(f"{self.stage}/{f}", f"{self.folder}/{f.partition('-')[2]}")
        shutil.rmtree(self.stage)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


def _share(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f", F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)))


def report(evaluations: DataFrame) -> DataFrame:
    """A report of evaluations as Markdown: place and line.

    evaluations: index, qnum, similarity (0 to 1), options_match, class_match, warnings.  The
    summary's lines are made from one aggregate; the others are a row each, in order of index.
    Without evaluations the shares are 0 and the table is empty.
    """
    n = F.count("*")
    s = evaluations.agg(n.alias("n"), F.coalesce(F.sum("similarity"), F.lit(0.0)).alias("similar"), F.count_if("options_match").alias("options"), F.count_if("class_match").alias("classes"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    line = lambda name, value: F.concat(F.lit(f"| **{name}** | **"), value, F.lit("** |"))
    percent = lambda c: F.concat(_share(F.col(c), F.col("n")), F.lit("%"))
    text = lambda x: F.lit(x)
    head = [
        text("# Validation report"), text(""), text("## Executive Summary"), text(""), text("| Metric | Score |"), text("| --- | --- |"),
        line("Total Detected Questions", F.col("n").cast("string")), line("Average Stem Match Similarity", percent("similar")), line("Option Count Alignment Rate", percent("options")),
        line("Classification Match", percent("classes")), line("Total Warnings", F.col("warnings").cast("string")),
        text(""), text("## Comparison"), text(""), text("| Q# | Number | Stem Match % | Option Match | Class Match | Status |"), text("| --- | --- | --- | --- | --- | --- |"),
    ]
    top = s.select(F.posexplode(F.array(*head)).alias("place", "line")).select(F.col("place").cast("bigint").alias("place"), "line")
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    good = F.col("options_match") & F.col("class_match") & (F.col("warnings") == 0)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("index").cast("string"), F.coalesce(F.col("qnum").cast("string"), F.lit("N/A")), F.concat(F.format_string("%.0f", F.floor(F.col("similarity") * 100 + 0.5).cast("double")), F.lit("%")), yes("options_match"), yes("class_match"), F.when(good, "Success").otherwise("Review")), F.lit(" |"))
    return top.union(evaluations.select((F.col("index") + len(head)).cast("bigint"), row))


def numbered(rows: DataFrame, *order: str, per_range: int = 100_000) -> DataFrame:
    """`rows` with `index`, 0 and on in an order: ranges are numbered apart and put one behind the
    other by their sizes, so that no task holds all."""
    parts = max(1, rows.count() // per_range)
    ranged = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return ranged.withColumn("__i", inner).join(F.broadcast(starts), "__part").withColumn("index", F.col("__before") + F.col("__i") - 1).drop("__part", "__i", "__before")
