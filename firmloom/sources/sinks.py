"""Versioned Parquet tables and the ingestion audit row.

A table is a folder of version folders and of pointers. A version is written to a
fresh folder of its own attempt, then a numbered pointer names it; the pointer is put
in place by a rename that fails if that number exists. Readers follow the highest
pointer, so they see the version before or after, never a part. Nothing that a
pointer names is overwritten or deleted by a write; `remove_old_versions` does that.

A version that was made from another one is committed against it: its number is the
other's plus one, so of two writers that read the same version the second gets
`LostRace`, before or after it has written its files, and no update is lost.

A keyed table can be kept in buckets by a hash of its key. A version then names a folder
for each bucket; an update reads and writes the buckets of its keys, and the pointer
keeps the folders of all others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmloom import schemas

POINTERS = "_pointers"
BUCKET, BUCKETS = "key_bucket", 64


class LostRace(RuntimeError):
    """Another writer has committed since the version was read that this write was made from."""


@dataclass(frozen=True)
class Pointer:
    """One written version: its number, name, folder, and the number of the version it was made from.

    `buckets`, of a table in buckets: the folder of each, None for one without rows.
    """

    number: int
    version: str
    folder: str
    base: int | None
    buckets: dict[str, str | None] | None = None


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def pointers(spark: SparkSession, root: str, table: str) -> list[Pointer]:
    """All pointers of a table, oldest first."""
    folder, files = _path(spark, f"{root}/{table}/{POINTERS}")
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        if status.getPath().getName().endswith(".json"):
            stream = files.open(status.getPath())
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append(Pointer(**json.loads(text)))
    return sorted(found, key=lambda p: p.number)


def _point(spark: SparkSession, root: str, table: str, pointer: Pointer) -> None:
    folder, files = _path(spark, f"{root}/{table}/{POINTERS}")
    files.mkdirs(folder)
    draft, _ = _path(spark, f"{folder.toString()}/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(pointer.__dict__).encode()))
    finally:
        stream.close()
    final, _ = _path(spark, f"{folder.toString()}/{pointer.number:012d}.json")
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise LostRace(f"{table}: another writer made version {pointer.number}; run again from it")


def newest(spark: SparkSession, root: str, table: str) -> Pointer | None:
    """The pointer readers follow, None before the first write."""
    known = pointers(spark, root, table)
    return known[-1] if known else None


def write_snapshot(df: DataFrame, root: str, table: str, version: str, base: int | None = None) -> Pointer:
    """Write a version to a fresh folder, then point readers at it.

    `base`: number of the version that `df` was made from, 0 for the empty table. It has to be
    the newest still. None is for rows that were made from no version: they replace whatever is newest.
    """
    spark = df.sparkSession
    now = newest(spark, root, table)
    number = now.number if now else 0
    if base is not None and base != number:
        raise LostRace(f"{table}: made from version {base}, but version {number} is there; run again from it")
    folder = f"{version}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{table}/{folder}")
    pointer = Pointer(number + 1, version, folder, number)
    _point(spark, root, table, pointer)
    return pointer


def update_snapshot(
    spark: SparkSession, root: str, table: str, version: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5
) -> Pointer:
    """Write what `change` makes of the newest version; again from the newest one if the race for it was lost."""
    for left in reversed(range(attempts)):
        now = newest(spark, root, table)
        try:
            return write_snapshot(change(read_pointer(spark, root, table, now)), root, table, version, now.number if now else 0)
        except LostRace:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def read_pointer(spark: SparkSession, root: str, table: str, pointer: Pointer | None, only: list[int] | None = None) -> DataFrame:
    """The version of a pointer; the empty table for None. A version whose files are gone is an error.

    `only`: the buckets to read, of a table in buckets.
    """
    schema = getattr(schemas, table.upper())
    if pointer is None:
        return spark.createDataFrame([], schema)
    if pointer.buckets is None:
        paths = [f"{root}/{table}/{pointer.folder}"]
    else:
        wanted = pointer.buckets if only is None else [str(b) for b in only]
        paths = [f"{root}/{table}/{pointer.buckets[b]}/{BUCKET}={b}" for b in wanted if pointer.buckets[b]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def touched_buckets(keys: DataFrame, key: str, pointer: Pointer | None, buckets: int = BUCKETS) -> list[int]:
    """The buckets of the keys. Of a table that is not in buckets yet, all."""
    if pointer is None or pointer.buckets is None:
        return list(range(buckets))
    return sorted(r[0] for r in keys.select(bucket_of(key, len(pointer.buckets))).distinct().collect())


def write_buckets(
    df: DataFrame, root: str, table: str, version: str, base: Pointer | None, key: str, touched: list[int], buckets: int = BUCKETS
) -> Pointer:
    """Write `df`, all rows of the `touched` buckets, as a version made from `base`; its other buckets stay."""
    spark = df.sparkSession
    now = newest(spark, root, table)
    if (now.number if now else 0) != (base.number if base else 0):
        raise LostRace(f"{table}: made from version {base.number if base else 0}, but version {now.number} is there; run again from it")
    kept = base.buckets if base is not None and base.buckets is not None else {}
    many = len(kept) or buckets
    folder = f"{version}-{uuid.uuid4().hex}"
    placed = df.withColumn(BUCKET, bucket_of(key, many))
    placed.repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{root}/{table}/{folder}")
    written = {}
    for b in touched:
        path, files = _path(spark, f"{root}/{table}/{folder}/{BUCKET}={b}")
        written[str(b)] = folder if files.exists(path) else None
    pointer = Pointer((now.number if now else 0) + 1, version, folder, base.number if base else 0, {**kept, **written})
    _point(spark, root, table, pointer)
    return pointer


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The current version of a table, empty before its first write."""
    return read_pointer(spark, root, table, newest(spark, root, table))


def remove_old_versions(spark: SparkSession, root: str, table: str, keep: int) -> int:
    """Delete all but the last `keep` versions with their pointers; returns how many. Buckets that a kept one names stay."""
    known = pointers(spark, root, table)
    old = known[:-keep] if keep > 0 else []
    named = {(folder, b) for p in known[len(old):] for b, folder in (p.buckets or {}).items()}

    def delete(path: str) -> None:
        target, files = _path(spark, path)
        files.delete(target, True)

    for pointer in old:
        delete(f"{root}/{table}/{POINTERS}/{pointer.number:012d}.json")
    for folder in {f for p in old for f in (p.folder, *(p.buckets or {}).values()) if f}:
        if all(f != folder for f, _ in named):
            delete(f"{root}/{table}/{folder}")
        else:
            for b in {b for p in old for b, f in (p.buckets or {}).items() if f == folder and (f, b) not in named}:
                delete(f"{root}/{table}/{folder}/{BUCKET}={b}")
    return len(old)


def run_audit(
    spark: SparkSession, run_id: str, source: str, started_at, finished_at,
    found: int, new: int, errors: list[str],
) -> DataFrame:
    """The audit row of one ingestion run."""
    row = [(run_id, source, started_at, finished_at, found, new)]
    base = spark.createDataFrame(
        row, "id string, source string, started_at timestamp, finished_at timestamp, records_found long, records_new long"
    )
    messages = F.array(*[F.lit(e) for e in errors]) if errors else F.array().cast("array<string>")
    return base.withColumn("errors", F.to_json(messages))


def raw_payload(columns: list[str], exclude: tuple[str, ...] = ("raw_row",)) -> Column:
    """JSON of a record's scalar fields, NULLs included."""
    return F.to_json(
        F.struct(*[F.col(c) for c in columns if c not in exclude]), {"ignoreNullFields": "false"}
    )
