"""Records of a CSV file that is read in splits, also where a quoted field holds line breaks.

A line break ends a record unless a quoted field is open. Whether one is open at the
beginning of a split depends on all that comes before it, so files are passed over twice, each
time in splits and without shuffling lines:

1. Each split says in which state it ends if it began outside of a quoted field, and if it began
   inside. These maps of two states are composed along each file.
2. With its true first state, each split joins its lines to records. Only what crosses
   its borders, at most one piece at either end, is shuffled and put together by file and the
   split in which the record begins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What runs in tasks is sent with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Splits up to which their first states are broadcast; beyond, lines are shuffled to them.
BROADCAST_SPLITS = 200_000

_MAPS = "file string, split long, place long, open0 boolean, open1 boolean, begins1 boolean"
_RECORDS = "file string, split long, at long, number long, record string, whole boolean, head boolean"


def open_after(line: str, inside: bool, separator: str = ",", quote: str = '"') -> bool:
    """Whether a quoted field is open after a line, given whether one is before it. A quote
    opens a field as its first character only; doubled, it stands for itself inside."""
    if quote not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside = False
            at += 1
        elif line.startswith(quote, at):
            inside = True
            at += 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, place, line: the lines in the order of the file; ``place`` orders those of
    a split. Only a line feed ends a line, so a carriage return within a field stays."""
    where = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        where["file_path"].alias("file"), where["file_block_start"].alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )


def _split_maps(lines: DataFrame) -> DataFrame:
    """Per split: the state after it from either state before it, and whether a record begins in
    it if it began inside a quoted field."""
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("open0", pa.bool_()), ("open1", pa.bool_()), ("begins1", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None
        for batch in batches:
            held = batch.to_pydict()
            out = []
            for file, split, place, line in zip(held["file"], held["split"], held["place"], held["line"], strict=True):
                if (file, split) != key:
                    if row is not None:
                        out.append(row)
                    key = (file, split)
                    row = {"file": file, "split": split, "place": place, "open0": False, "open1": True, "begins1": False}
                if not row["open1"]:
                    row["begins1"] = True
                if '"' in line:
                    same = row["open0"] == row["open1"]
                    row["open0"] = open_after(line, row["open0"])
                    row["open1"] = row["open0"] if same else open_after(line, row["open1"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], schema)

    return lines.mapInArrow(run, _MAPS)


def _first_states(maps: DataFrame) -> DataFrame:
    """file, split, open (whether a quoted field is open at its beginning), owner (the split in which
    that field's record begins). A window by file, over one row per split.

    A split whose end does not depend on its beginning fixes the state; of the others after it,
    those that turn the state over are counted.
    """
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("open0") == F.col("open1")
    turns = maps.withColumn("turns", F.coalesce(F.sum((~fixed & F.col("open0")).cast("long")).over(Window.partitionBy("file").orderBy("split")), F.lit(0)))
    last = F.last(F.when(fixed, F.struct("open0", "turns")), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    known = turns.withColumn("open", F.coalesce(last["open0"], F.lit(False)) != (turned % 2 == 1))
    begins = ~F.col("open") | F.col("begins1")
    owner = F.last(F.when(begins, F.col("split")), ignorenulls=True).over(before)
    return known.withColumn("owner", owner).select("file", "split", "open", F.coalesce("owner", "split").alias("owner"))


def _joined(lines: DataFrame) -> DataFrame:
    """``_RECORDS`` from lines that carry the first state of their split: whole records, and pieces
    (``whole`` false) of the record which begins in ``split``; a piece lies in split ``at``, which
    has no other one of that record. ``head`` marks the first record of a file."""
    schema = pa.schema(
        [("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("number", pa.int64()), ("record", pa.string()), ("whole", pa.bool_()), ("head", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, first, inside, owner, foreign, head = None, [], 0, False, 0, False, False
        out: list[dict] = []

        def end(whole: bool) -> None:
            nonlocal head
            if piece:
                text = "\n".join(piece)
                out.append({"file": key[0], "split": owner, "at": key[1], "number": first, "record": text, "whole": whole, "head": head})
                piece.clear()
                head = False

        for batch in batches:
            held = batch.to_pydict()
            for file, split, place, line, opened, begun in zip(*(held[c] for c in ("file", "split", "place", "line", "open", "owner")), strict=True):
                if (file, split) != key:
                    end(False)  # a record that its split does not close
                    key, inside, foreign = (file, split), opened, opened
                    owner, head = begun if opened else split, split == 0
                if not piece:
                    first = place
                piece.append(line)
                inside = open_after(line, inside)
                if not inside:
                    end(not foreign)
                    foreign, owner = False, split
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        end(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return lines.mapInArrow(run, _RECORDS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, split, number, record, head: every record of the CSV files at ``path``, line breaks of
    quoted fields kept, the line end left off. Records of a file are in the order of (split,
    number); ``head`` marks the first. A quoted field that is never closed makes one
    record of the rest of its file.
    """
    lines = _lines(spark, path)
    states = _first_states(_split_maps(lines))
    if states.count() <= BROADCAST_SPLITS:
        known = lines.join(F.broadcast(states), ["file", "split"])
    else:
        known = lines.join(states, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "place")
    found = _joined(known)
    pieces = found.filter(~F.col("whole")).groupBy("file", "split").agg(
        F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("at", "number", "record"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    stitched = pieces.select("file", "split", F.col("parts")[0]["number"].alias("number"), text.alias("record"), "head")
    every = found.filter("whole").select("file", "split", "number", "record", "head").unionByName(stitched)
    return every.withColumn("record", F.regexp_replace("record", "\r$", ""))


def quoted(spark: SparkSession, path: str) -> bool:
    """Whether any line of the files holds a quote at all; without one, every line is a record."""
    return not spark.read.text(path).filter(F.col("value").contains('"')).isEmpty()
