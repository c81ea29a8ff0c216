"""Benchmark decontamination by a prefix-filtered containment join.

A window is `window` consecutive words of an item (an item of fewer words is one
window). A document word is hit if it stands inside an occurrence of a window. A
window is a set of word shingles and must be contained whole, so its necessary
prefix is a single shingle: its rarest in the documents, ties by hash. Neighbouring
windows mostly share that shingle, so an item has few of them.

1. One pass over the documents marks the positions of all item shingles (a bit table
   of fixed size, then an exact join) and keeps the words around each. Counting them
   gives the rarity.
2. Documents join the prefix shingles only.
3. Length and position bounds drop pairs where the document or the item has too few
   words left and right; the others are compared word by word to both sides. A run
   of equal words at least as long as the window is a hit.

Every window contains its own prefix shingle, and every word of an occurrence is
within reach of it, so the union of the runs is exact.

Defined cases: null and empty texts have no words; items without words have no
windows; items with the same words share their windows and are each reported; a
null item id is printed as an empty string, a repeated one counts once; repeated
documents give repeated rows; empty tables give no rows or no hits; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from firmloom.llm.common import ascii_lower, broadcast_if_small, row_key, stage, text_of, without

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text_column: str) -> Column:
    return F.array_remove(F.split(ascii_lower(text_of(text_column)), SEPARATORS), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(size)])


def _positions(words: Column, size: int) -> Column:
    """Start positions of the shingles of `size` words, from 0."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))


def item_classes(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per distinct word sequence: class, words, sorted ids of its items."""
    item = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return stage(
        items.select(item.alias("item"), words_of(text_column).alias("words")).filter(F.size("words") > 0)
        .groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("class", F.monotonically_increasing_id()), "items")


def item_shingles(classes: DataFrame, shingle: int) -> DataFrame:
    """class, at, size, h: all shingles of all items; items shorter than a shingle are one."""
    size = F.least(F.size("words"), F.lit(shingle))
    spots = F.transform(
        F.sequence(F.lit(0), F.size("words") - size),
        lambda p: F.struct(p.alias("at"), _by_size(F.col("words"), p, size, shingle).alias("h")))
    return classes.withColumn("size", size).withColumn("s", F.explode(spots)).select("class", "words", "size", "s.at", "s.h")


def _by_size(words: Column, at: Column, size: Column, shingle: int) -> Column:
    chosen = F.when(size == 1, _hash(words, at, 1))
    for k in range(2, shingle + 1):
        chosen = chosen.when(size == k, _hash(words, at, k))
    return chosen


def bit_table(shingles: DataFrame, bits: int) -> DataFrame:
    """One row with `table`, an array of bits / 64 longs: bit pmod(h, bits) is set for every h. Its size is fixed."""
    spot = F.pmod("h", F.lit(bits))
    set_bits = (
        shingles.select(F.shiftright(spot, 6).alias("id"), F.expr(f"shiftleft(1L, int(pmod(h, {bits}L) % 64))").alias("bit"))
        .groupBy("id").agg(F.bit_or("bit").alias("bits"))
    )
    every = shingles.sparkSession.range(0, bits // 64, 1, 1).join(set_bits, "id", "left")
    return every.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))),
        lambda x: x["bits"]).alias("table"))


def mark_documents(
    docs: DataFrame, table: DataFrame, sizes: list[int], bits: int, reach: int, shingle: int,
    id_column: str, text_column: str,
) -> DataFrame:
    """row, doc_id, key, n_words and `spots`: positions that may hold an item shingle, with the words around them."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        row_key(id_column, text_column).alias("key"), words_of(text_column).alias("words"))
    rows = rows.select("*", *[table.scalar().alias(f"table{k}") for k in sizes])

    def spots(k: int) -> Column:
        far = reach if k == shingle else 0
        words = F.col("words")

        def marked(p):
            spot = F.pmod(_hash(words, p, k), F.lit(bits))
            return F.getbit(F.get(F.col(f"table{k}"), F.shiftright(spot, 6).cast("int")), (spot % 64).cast("int")) == 1

        return F.transform(F.filter(_positions(words, k), marked), lambda p: F.struct(
            p.alias("at"), F.lit(k).alias("size"), _hash(words, p, k).alias("h"),
            F.reverse(F.slice(words, F.greatest(p - far, F.lit(0)) + 1, F.least(p, F.lit(far)))).alias("left"),
            F.slice(words, p + 1, k + far).alias("rest")))

    return stage(rows.select(
        "row", "doc_id", "key", F.size("words").alias("n_words"), F.concat(*[spots(k) for k in sizes]).alias("spots")), "spots")


def _common(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of both arrays."""
    both = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x == y), False)
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(both)


def prefix_shingles(classes: DataFrame, shingles: DataFrame, spots: DataFrame, window: int, shingle: int) -> DataFrame:
    """Per window the rarest of its shingles, with the item's words to both sides; each place of an item once."""
    wanted = shingles.select("size", "h").distinct()
    counts = spots.join(broadcast_if_small(wanted), ["size", "h"], "left_semi").groupBy("size", "h").agg(F.count("*").alias("seen"))
    placed = shingles.drop("words").join(counts, ["size", "h"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    ahead = W.partitionBy("class").orderBy("at").rowsBetween(0, max(window - shingle, 0))
    length = F.least(F.size("words"), F.lit(window))
    rarest = (
        placed.withColumn("first", F.min(F.struct("seen", "h", "at", "size")).over(ahead))
        .join(classes.select("class", "words"), "class").filter(F.col("at") <= F.size("words") - length)
        .select("class", "words", length.alias("length"), F.col("first.h").alias("h"),
                F.col("first.at").alias("item_at"), F.col("first.size").alias("size")).distinct()
    )
    beside = F.col("length") - F.col("size")
    return stage(rarest.select(
        "class", "length", "h", "size",
        F.reverse(F.slice("words", F.greatest(F.col("item_at") - beside, F.lit(0)) + 1, F.least("item_at", beside))).alias("item_left"),
        F.slice("words", F.col("item_at") + 1, F.col("size") + beside).alias("item_rest")), "prefixes")


def find_hits(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, bits: int = 2**22,
    id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: row, doc_id, key, n_words), (hits: row, class, spans), (classes: class, words, items)."""
    classes = item_classes(items, item_id_column, item_text_column)
    shingles = stage(item_shingles(classes, shingle), "shingles")
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect()) or [shingle]
    reach = max(window - shingle, 0)
    marked = mark_documents(docs, bit_table(shingles, bits), sizes, bits, reach, shingle, id_column, text_column)
    spots = marked.select("row", "n_words", F.explode("spots").alias("s")).select("row", "n_words", "s.*")
    prefixes = prefix_shingles(classes, shingles, spots.select("size", "h"), window, shingle)

    left_room = F.least(F.size("left"), F.size("item_left"))
    right_room = F.least(F.size("rest"), F.size("item_rest"))
    pairs = spots.join(broadcast_if_small(prefixes), ["size", "h"]).filter(
        (F.col("n_words") >= F.col("length")) & (left_room + right_room >= F.col("length")))
    runs = pairs.select(
        "row", "class", "at", "size", "length",
        _common(F.col("left"), F.col("item_left")).alias("before"), _common(F.col("rest"), F.col("item_rest")).alias("after"))
    hits = (
        runs.filter((F.col("after") >= F.col("size")) & (F.col("before") + F.col("after") >= F.col("length")))
        .select("row", "class", F.struct(
            (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end")).alias("span"))
        .groupBy("row", "class").agg(F.collect_set("span").alias("spans"))
    )
    return marked.select("row", "doc_id", "key", "n_words"), hits, classes


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    rows, hits, classes = find_hits(docs, items, **options)
    covered = F.array_distinct(F.flatten(F.transform(F.flatten("spans"), lambda s: F.sequence(s["start"], s["end"] - 1))))
    found = (
        hits.join(classes.select("class", "items"), "class").groupBy("row")
        .agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("row", F.size(covered).cast("bigint").alias("hit"), "items")
    )
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, "row", "left").select(
        "doc_id", "key", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with their columns, in which no window of an item occurs."""
    verdict = stage(decontaminate(docs, items, id_column=id_column, text_column=text_column, **options), "verdict")
    return without(docs, verdict.filter("contaminated").select("key").distinct(), id_column, text_column)
