"""SimHash near-dedup with the pigeonring filter.

Fingerprints. Each word shingle of a text, repeats included, is hashed with XXH64; bit k
of the 64 is set where it is set in over half of the hashes. Tasks hash whole texts,
in slices of bounded size; a fingerprint leaves the task, no text does. Equal
fingerprints are one node from here on.

Pigeonring. The 64 bits are a ring of `segments` equal parts. Where two fingerprints
differ in at most `distance` bits, one part begins a chain in which the first l parts
differ in at most l * distance / segments bits, for every l. So:

* The first parts of that chain, as long as this budget is below 1, are equal. They are
  the join key, one for each beginning: 24 of 64 bits at a distance of 2 and 8 parts.
* Further budgets prune the pairs that meet, one part after another, before the
  whole Hamming distance is taken.
* A key that more than `crowd` fingerprints share is not paired as it stands. The same
  budgets allow the next parts (up to where the budget reaches 2) one difference in all:
  those fingerprints join on a key over them too, once whole and once for each bit that
  may differ, 0 against 1. Only the rest of the ring is open in such a group, 8 bits or
  at most 256 fingerprints, so no group of near copies makes pairs by its square.

Links between different fingerprints are all found, and components.py joins them up.

Defined cases: a null or empty text, or one of blanks, has fingerprint zero and links
like any other; with fewer words than a shingle the whole sequence is one shingle; rows
that repeat, and ties, share their fingerprint and component; a null id stays null and
names a component only where no other row of it has an id; very long texts are hashed
whole, slice by slice; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import attach, stage, text_of
from firmloom.llm.components import components
from firmloom.llm.shingles import texts_of

BITS = 64
SLICE = 1 << 15


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text (UTF-8): its word shingles, A-Z as a-z, joined by a space."""
    words = text.lower().split()  # of bytes: A-Z only, and cut at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    n = min(n, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ends = starts[n:] - 1
    digest, total, counts = xxhash.xxh64_intdigest, len(ends), np.zeros(BITS, np.int64)
    for at in range(0, total, SLICE):
        cut = slice(at, min(at + SLICE, total))
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[cut].tolist(), ends[cut].tolist(), strict=False)], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.tobytes(), n, seed) for t in texts_of(batch.column("text"))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


# --- The ring -------------------------------------------------------------

def turned(value: Column, bits: int) -> Column:
    """`value` with its lowest `bits` bits taken around to the top: part `bits / width` of the ring comes first."""
    if bits == 0:
        return value
    return F.shiftrightunsigned(value, bits).bitwiseOR(F.shiftleft(value, BITS - bits))


def lowest(value: Column, bits: int) -> Column:
    return value if bits >= BITS else value.bitwiseAND(F.lit((1 << bits) - 1))


def chain(segments: int, distance: int, most: int) -> int:
    """Longest chain of parts that may differ in at most `most` bits."""
    return max(l for l in range(segments + 1) if l * distance // segments <= most)


def viable(differs: Column, segments: int, distance: int) -> Column:
    """Whether the chain that begins at the lowest part keeps every budget; the last one is the Hamming check."""
    width, keeps = BITS // segments, F.lit(True)
    for l in range(1, segments + 1):
        keeps = keeps & (F.bit_count(lowest(differs, l * width)) <= l * distance // segments)
    return keeps


def close_pairs(nodes: DataFrame, distance: int = 2, segments: int = 8, crowd: int = 64) -> DataFrame:
    """Pairs (a, b) of the distinct longs `fp` that differ in at most `distance` bits, each at least once."""
    if BITS % segments or distance >= segments:
        raise ValueError("segments must divide 64 and be more than the distance")
    width = BITS // segments
    equal, one = chain(segments, distance, 0) * width, chain(segments, distance, 1) * width
    rings = nodes.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ring"), turned(F.col("fp"), i * width).alias("value")) for i in range(segments)])).alias("r")
    ).select("r.*").withColumn("head", lowest(F.col("value"), equal))
    many = rings.groupBy("ring", "head").agg(F.count("*").alias("many")).filter("many > 1")
    shared = stage(rings.join(many, ["ring", "head"]), "rings")

    def met(left: DataFrame, right: DataFrame, keys: list[str], ordered: bool) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        both = x.join(y, keys)
        if ordered:
            both = both.filter(F.col("x.value") < F.col("y.value"))
        near = both.filter(viable(F.col("x.value").bitwiseXOR(F.col("y.value")), segments, distance))
        back = lambda c: F.expr("CASE ring " + " ".join(
            f"WHEN {i} THEN " + (f"shiftleft({c}, {i * width}) | shiftrightunsigned({c}, {BITS - i * width})" if i else c)
            for i in range(segments)) + " END")
        return near.select(back("x.value").alias("a"), back("y.value").alias("b"))

    few, crowded = shared.filter(F.col("many") <= crowd), shared.filter(F.col("many") > crowd)
    pairs = met(few, few, ["ring", "head"], True)
    if not crowded.isEmpty():
        # A bit of the parts that may differ in one: 0 on one side, 1 on the other, all others equal.
        longer = crowded.withColumn("body", lowest(F.col("value"), one))
        open_bits = F.sequence(F.lit(equal), F.lit(one - 1))
        masked = longer.select("ring", "value", "body", F.explode(open_bits).alias("bit")).withColumn(
            "set", F.expr("shiftrightunsigned(body, bit) & 1L") == 1)
        masked = masked.withColumn("body", F.expr("body & ~shiftleft(1L, bit)"))
        shared_keys = stage(masked.join(
            masked.groupBy("ring", "bit", "body").agg(F.min("set").alias("off"), F.max("set").alias("on")).filter("on and not off")
            .select("ring", "bit", "body"), ["ring", "bit", "body"]), "masked")
        pairs = pairs.unionByName(met(longer, longer, ["ring", "body"], True)).unionByName(
            met(shared_keys.filter("not set"), shared_keys.filter("set"), ["ring", "bit", "body"], False))
    return pairs


def simhash_groups(
    docs: DataFrame, n: int = 3, distance: int = 2, segments: int = 8, crowd: int = 64, seed: int = 42,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach, of every row."""
    rows = stage(fingerprints(docs, n, seed, id_column, text_column).withColumn(
        "salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(256)).cast("int")), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = components(close_pairs(nodes.select("fp"), distance, segments, crowd))
    placed = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    named = stage(placed.join(placed.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "component_id"), "named")
    return attach(rows, named, ["fp"], "salt").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
