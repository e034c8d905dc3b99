"""Zipped sources, read in place: member listing and line scan, also for an archive inside an archive.

Listing and reading are both distributed: archives are spread over tasks to read their directories, then
members are spread over tasks to be inflated. A line row carries its member's first two lines, so that
headers and sample rates need no join.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.text import canonical_name

BATCH_LINES = 65_536
MEMBER_SCHEMA = "path string, archive string, nested string, member string, compressed_bytes long, uncompressed_bytes long, crc32 string"
LINE_SCHEMA = "archive string, nested string, member string, line_no long, value string, head array<string>"


def _open(uri: str):
    """Seekable input stream of a file on any filesystem Arrow can reach."""
    from urllib.parse import quote

    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/%@?=&"))
    return system.open_input_file(path)


def _useful(info) -> bool:
    name = posixpath.basename(info.filename)
    return not (info.is_dir() or name.startswith("._") or name == ".DS_Store" or info.filename.startswith("__MACOSX/"))


def archive_members(spark: SparkSession, root: str, nested_pattern: str | None = None) -> DataFrame:
    """One row per useful member of every ``*.zip`` under ``root``.

    With ``nested_pattern`` the members of matching inner archives are listed too (``nested`` names the inner one).
    """

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zipfile

        for pdf in batches:
            for uri in pdf["path"]:
                rows = []
                with _open(uri) as raw, zipfile.ZipFile(raw) as zf:
                    for info in filter(_useful, zf.infolist()):
                        rows.append((uri, posixpath.basename(uri), None, info))
                        if nested_pattern and re.search(nested_pattern, info.filename):
                            with zf.open(info) as inner_raw, zipfile.ZipFile(inner_raw) as inner:
                                rows += [(uri, posixpath.basename(uri), info.filename, i) for i in filter(_useful, inner.infolist())]
                yield pd.DataFrame(
                    [(p, a, n, i.filename, i.compress_size, i.file_size, f"{i.CRC:08x}") for p, a, n, i in rows],
                    columns=[c.split()[0] for c in MEMBER_SCHEMA.split(", ")])

    # binaryFile is used for its file listing only: the content column is pruned.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(root).select("path")
    return files.repartition(F.col("path")).mapInPandas(listing, MEMBER_SCHEMA)


def member_lines(members: DataFrame, partitions: int | None = None) -> DataFrame:
    """Lines of the given members (0-based ``line_no``), inflated in batches, one member at a time per task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        def emit(row, text) -> Iterator[pd.DataFrame]:
            head: list[str] = []
            values: list[str] = []
            start = 0
            for line in text:
                line = line.rstrip("\r\n")
                if len(head) < 2:
                    head.append(line)
                values.append(line)
                if len(values) >= BATCH_LINES:
                    yield frame(row, start, values, head)
                    start, values = start + len(values), []
            if values:
                yield frame(row, start, values, head)

        def frame(row, start, values, head) -> pd.DataFrame:
            n = len(values)
            return pd.DataFrame({"archive": row.archive, "nested": [row.nested] * n, "member": row.member, "line_no": range(start, start + n),
                                 "value": values, "head": [head] * n})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with _open(row.path) as raw, zipfile.ZipFile(raw) as zf:
                    if row.nested is None:
                        with zf.open(row.member) as data:
                            yield from emit(row, io.TextIOWrapper(data, "utf-8-sig", errors="replace"))
                    else:
                        with zf.open(row.nested) as mid, zipfile.ZipFile(mid) as inner, inner.open(row.member) as data:
                            yield from emit(row, io.TextIOWrapper(data, "utf-8-sig", errors="replace"))

    keys = [F.col("archive"), F.col("nested"), F.col("member")]
    spread = members.repartition(partitions, *keys) if partitions else members.repartition(*keys)
    return spread.mapInPandas(read, LINE_SCHEMA)


def inventory(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per archive member/byte totals, and the histogram of file extensions."""
    top = members.where("nested IS NULL")
    extension = F.lower(F.regexp_extract("member", r"(\.[^./]+)$", 1))
    totals = top.groupBy("archive").agg(
        F.count(F.lit(1)).alias("members"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))
    return totals, top.groupBy("archive", extension.alias("extension")).agg(F.count(F.lit(1)).alias("members"))


def csv_cells(line: Column, sep: str = ",") -> Column:
    """All cells of a CSV line, however many: quotes are taken off, doubled ones are one, an empty cell is NULL."""
    mark = re.escape(sep)
    # A leading separator makes every cell "separator, content", so that no match is empty.
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{mark}("[^"]*+(?:""[^"]*+)*+"|[^{mark}]*+)'), F.lit(1))
    bare = F.transform(raw, lambda c: F.when(c.rlike('(?s)^".*"$') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.transform(bare, lambda c: F.nullif(c, F.lit("")))


def csv_columns(lines: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """Named string columns from CSV lines whose header (line 0) may differ per member, of any width.

    Header names are canonicalised; a column missing from a member is NULL. ``sample_index`` is the data
    line number, so no ordering job is needed.
    """
    # Parsed once per line into a column of its own: field accesses must not each bring a parser along.
    rows = lines.where((F.col("line_no") > 0) & (F.trim("value") != "")).withColumns(
        {"__cells": csv_cells(F.col("value"), sep), "__head": F.transform(csv_cells(F.get("head", 0), sep), lambda c: canonical_name(F.coalesce(c, F.lit(""))))})
    picked = [F.get("__cells", F.nullif(F.array_position("__head", c), F.lit(0)).cast("int") - 1).alias(c) for c in columns]
    return rows.select("archive", "nested", "member", (F.col("line_no") - 1).alias("sample_index"), *picked)


def tab_columns(lines: DataFrame, names: list[str], skip: int = 3) -> DataFrame:
    """Headerless tab-separated lines after a preamble, as named string columns."""
    parts = F.split("value", "\t")
    rows = lines.where((F.col("line_no") >= skip) & (F.trim("value") != ""))
    return rows.select("archive", "nested", "member", (F.col("line_no") - skip).alias("sample_index"), *[F.get(parts, i).alias(n) for i, n in enumerate(names)])
