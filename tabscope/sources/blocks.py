"""CSV files, each read by many tasks, quoted line breaks included.

Spark splits the file's lines into blocks.  A line break may lie within quotes, so a block
doesn't know whether it starts inside a record.  A first pass, over lines with quotes only,
tells for each block how it would end from either start; the starts then follow from block
to block, in one short run over as many rows as the file has blocks.  A second pass cuts each
block at the true ends of records and parses them, all blocks side by side; records that
cross blocks are few and are put together from their parts.

A quote opens a field only at the field's start, as in Python's csv module; elsewhere it is
a letter.  Each record has an ordinal out of its block's place in the file and its own in
the block, so source order is known without a sort.

A folder's files stand one after the other, in the order of their names: a block is known by
its place in all of them, and no record goes on from one file into the next.
"""

from __future__ import annotations

import csv
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.values import ORDINAL
from tabscope.functions.workers import ship

#: Characters that a field may have.
FIELD = 1 << 30


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether the line's end is within quotes, from within or from a record's start."""
    at, end = 0, len(line)
    while True:
        if not inside and line[at : at + 1] == '"':
            inside, at = True, at + 1
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        at = line.find(delimiter, at, end)
        if at < 0:
            return False
        at += len(delimiter)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and size of each file, in order; no content is read."""
    found = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    return sorted((r["file"], r["length"]) for r in found.collect())  # a row for each file


def starts_of(files: list[tuple[str, int]]) -> list[int]:
    """Where each file begins among all of them."""
    return list(accumulate((size for _, size in files), initial=0))[:-1]


def lines_of(spark: SparkSession, path: str, encoding: str, files: list[tuple[str, int]] | None = None) -> DataFrame:
    """(block, line): the files' lines by the block they start in, in order within it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    block, line = F.col("_metadata.file_block_start").alias("block"), F.decode(F.col("value").cast("binary"), encoding).alias("line")
    if files is None or len(files) < 2:
        return lines.select(block, line)
    places = spark.createDataFrame([(f, at) for (f, _), at in zip(files, starts_of(files), strict=True)], "file string, at long")
    named = lines.select(block, line, F.col("_metadata.file_path").alias("file"))
    return named.join(F.broadcast(places), "file").select((F.col("block") + F.col("at")).alias("block"), "line")


def block_ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """For each block with quotes: (block, from_start, from_inside, closes, broken).

    How it ends from a record's start and from within quotes, whether the latter ends a
    record in it, and whether any of its lines, as a record, ends within quotes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for block, line in zip(batch["block"], batch["line"], strict=True):
                own = found.setdefault(block, [False, True, False, False])
                own[3] |= ends_inside(line, False, delimiter)
                own[0] = ends_inside(line, own[0], delimiter)
                own[1] = ends_inside(line, own[1], delimiter)
                own[2] |= not own[1]
        yield pd.DataFrame([(b, *own) for b, own in found.items()], columns=["block", "from_start", "from_inside", "closes", "broken"])

    quoted_lines = lines.where(F.contains("line", F.lit('"')))
    return quoted_lines.mapInPandas(run, "block long, from_start boolean, from_inside boolean, closes boolean, broken boolean")


def block_starts(ends: list, blocks: list[int], firsts: list[int]) -> dict[int, int]:
    """The block in which the record begins that a block starts within, for blocks that start within one.

    ``firsts`` are the first blocks of files.
    """
    by_block, fresh = {r["block"]: r for r in ends}, set(firsts)
    starts, begun = {}, None
    for block in sorted(blocks):
        r = by_block.get(block)
        begun = None if block in fresh else begun
        if begun is None:
            begun = block if r is not None and r["from_start"] else None
            continue
        starts[block] = begun
        if r is not None and r["closes"]:
            begun = block if r["from_inside"] else None
    return starts


def cut(lines: DataFrame, starts: dict[int, int], firsts: list[int], delimiter: str) -> DataFrame:
    """(file, block, place, part, fields, text): whole records parsed, and the parts of others as text.

    ``part`` is null for a whole record, else the block in which the record begins.
    """

    def fields_of(records: list[str]) -> list[list[str]]:
        csv.field_size_limit(FIELD)
        return [next(csv.reader([r], delimiter=delimiter), []) for r in records] if any("\n" in r for r in records) else list(csv.reader(records, delimiter=delimiter))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, inside, place, begun = None, [], False, 0, 0
        whole: list[tuple[int, int, str]] = []
        columns = ["file", "block", "place", "part", "fields", "text"]
        file = lambda block: firsts[bisect_right(firsts, block) - 1]

        def flush() -> pd.DataFrame:
            parsed = fields_of([r for *_, r in whole])
            rows = [(file(b), b, p, None, f, None) for (b, p, _), f in zip(whole, parsed, strict=True)]
            whole.clear()
            return pd.DataFrame(rows, columns=columns).astype({"part": "Int64"})

        def part(of: int) -> pd.DataFrame:
            row = (file(block), block, 0 if of != block else place, of, None, "\n".join(held))
            return pd.DataFrame([row], columns=columns).astype({"part": "Int64"})

        for batch in batches:
            for b, line in zip(batch["block"], batch["line"], strict=True):
                if b != block:
                    if held:
                        yield part(begun)
                    block, held, inside, place = b, [], b in starts, 0
                    begun = starts.get(b, b)
                held.append(line)
                inside = ends_inside(line, inside, delimiter) if '"' in line else inside
                if not inside:
                    if begun == block:
                        text = "\n".join(held).removesuffix("\r")
                        if text:
                            whole.append((block, place, text))
                        place += 1
                    else:
                        yield part(begun)
                    held, begun = [], block
            yield flush()
        if held:
            yield part(begun)

    return lines.mapInPandas(run, "file long, block long, place long, part long, fields array<string>, text string")


def records(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame | None:
    """(file, ordinal, fields) of every record that isn't blank, headers among them; None if no line break is quoted.

    ``file`` is where the record's file begins among all of them.
    """
    ship(spark)
    files = files_of(spark, path)
    firsts = starts_of(files)
    lines = lines_of(spark, path, encoding, files)
    ends = block_ends(lines, delimiter).collect()  # a row for each block at most
    if not any(r["broken"] for r in ends):
        return None
    blocks = [r["block"] for r in lines.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
    found = cut(lines, block_starts(ends, blocks, firsts), firsts, delimiter)

    @F.pandas_udf("array<string>")
    def parsed(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(FIELD)
        return pd.Series([next(csv.reader([t.removesuffix("\r")], delimiter=delimiter), []) for t in texts])

    # a record begins once in a block at most without ending there
    parts = found.where("part is not null").groupBy("file", "part").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("t"), F.max(F.when(F.col("part") == F.col("block"), F.col("place"))).alias("place")
    )
    crossing = parts.select("file", F.col("part").alias("block"), "place", parsed(F.array_join(F.transform("t", lambda t: t["text"]), "\n")).alias("fields"))
    every = found.where("part is null").select("file", "block", "place", "fields").union(crossing)
    return every.select("file", (2 * F.col("block") + F.col("place")).alias(ORDINAL), "fields")  # a block has fewer records than twice its bytes
