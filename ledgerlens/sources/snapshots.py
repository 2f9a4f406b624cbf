"""Versions of a set of tables, replaced as one.

A load writes its tables to a folder of its own below ``root`` and at last one small manifest,
which names the folder of each table. Readers follow the newest manifest, so they
see the tables of one load or of another, never some of each: a load that fails, or whose
driver is lost, has published nothing. Manifests are numbered and made by a rename onto
a name that must not exist; of two loads that end at once, one is told so.

With each table the manifest keeps a digest of its content, taken while it was written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS, VERSIONS = "_manifests", "_versions"


class ConflictingLoad(RuntimeError):
    """Another load was published meanwhile."""


# --- digests -----------------------------------------------------------------


@dataclass(frozen=True)
class Digest:
    """Rows of a table with the sum (in three parts, none of which can overflow) and the XOR of
    their hashes: the same for the same rows in any order and any partitions, and different
    if a row is lost, doubled or changed."""

    rows: int
    high: int
    middle: int
    low: int
    xor: int


def _hash(df: DataFrame, blank_is_null: bool) -> Column:
    """64 bits of a row. Which columns are null goes in apart, as hashes skip nulls."""
    values = [
        F.nullif(F.col(f.name), F.lit("")) if blank_is_null and isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema
    ]
    return F.xxhash64(*values, F.array(*[v.isNull() for v in values]))


def digest_columns(df: DataFrame, blank_is_null: bool = False) -> list[Column]:
    """The parts of a digest as aggregates, to be observed or selected. ``blank_is_null`` takes
    empty texts as nulls, which is what a CSV file keeps of them."""
    hashed, mask = _hash(df, blank_is_null), F.lit((1 << 22) - 1)
    parts = {
        "high": F.sum(F.shiftright(hashed, 44)),
        "middle": F.sum(F.shiftright(hashed, 22).bitwiseAND(mask)),
        "low": F.sum(hashed.bitwiseAND(mask)),
        "xor": F.bit_xor(hashed),
    }
    return [F.count(F.lit(1)).alias("rows"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in parts.items()]]


def digest(df: DataFrame, blank_is_null: bool = False) -> Digest:
    return Digest(**df.agg(*digest_columns(df, blank_is_null)).first().asDict())


# --- manifests ---------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str) -> list[int]:
    files, folder = _files(spark, f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest_path(root: str, number: int) -> str:
    return f"{root}/{MANIFESTS}/{number:010d}.json"


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict[str, dict]:
    """Path and digest of each table of the newest load, or of load ``number``; empty if there is none."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    if not numbers:
        return {}
    text = spark.read.text(_manifest_path(root, number or numbers[-1]), wholetext=True).first()[0]
    return json.loads(text)


@dataclass
class Load:
    """A load in the making: tables written so far, published by ``publish``."""

    spark: SparkSession
    root: str
    after: int
    folder: str
    tables: dict[str, dict]

    def path(self, table: str) -> str:
        return f"{self.root}/{self.folder}/{table}"

    def wrote(self, table: str, found: Digest) -> None:
        self.tables[table] = {"path": f"{self.folder}/{table}", "digest": asdict(found)}

    def publish(self) -> int:
        """Make the load the newest one; tables it does not have stay as they are. Its number."""
        entries = {**manifest(self.spark, self.root), **self.tables}
        number = self.after + 1
        final = _manifest_path(self.root, number)
        files, target = _files(self.spark, final)
        _, draft = _files(self.spark, f"{final}.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        finally:
            out.close()
        if _numbers(self.spark, self.root)[-1:] not in ([], [self.after]) or not files.rename(draft, target):
            files.delete(draft, False)
            raise ConflictingLoad(f"load {number} of {self.root} exists already")
        return number


def begin(spark: SparkSession, root: str) -> Load:
    root = root.rstrip("/")
    return Load(spark, root, (_numbers(spark, root) or [0])[-1], f"{VERSIONS}/{uuid.uuid4().hex}", {})


def table_path(spark: SparkSession, root: str, table: str, number: int | None = None) -> str:
    """Where the newest load, or load ``number``, keeps a table; without any load, the folder of
    its name."""
    root = root.rstrip("/")
    entry: Mapping = manifest(spark, root, number).get(table, {"path": table})
    return f"{root}/{entry['path']}"


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep``, and folders of versions that none of these names;
    the folders that went. A load in the making is lost, so none may run."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    for number in numbers[:-keep]:
        files, at = _files(spark, _manifest_path(root, number))
        files.delete(at, False)
    used = {entry["path"].split("/")[1] for n in numbers[-keep:] for entry in manifest(spark, root, n).values()}
    files, folder = _files(spark, f"{root}/{VERSIONS}")
    found = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    gone = [p for p in found if p.getName() not in used]
    for path in gone:
        files.delete(path, True)
    return sorted(p.getName() for p in gone)
