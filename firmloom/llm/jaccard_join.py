"""N-gram Jaccard join by vertical partitioning.

Documents with the same set of shingles form one class; the join works on classes.

Order. All n-grams stand in one global order: rare ones by hash first, then the
frequent ones by their count. Every task sends its n-grams as sorted runs of 40-bit
codes, three bytes each, and the runs are counted range by range; n-grams seen more
often than a bound are frequent. The bound is raised until at most `frequent_limit`
are left; this list, at most 16 bytes times that limit, goes to all tasks.

Candidates. Two sets of similarity t share an n-gram among the first
|s| - ceil(t |s|) + 1 of either, lengths differ by t at most, and the place of the
shared n-gram bounds the overlap. A group of near copies shares many n-grams, so
pairs within an n-gram are not all built: first every class is paired with one hub
of its n-gram and length band, and the links found give components; then only pairs
of classes in different components are built, each smaller part against the n-gram's
largest. All links that components need are found, none is guessed.

Dense groups. Texts that consist mostly of frequent n-grams are clustered by the
smallest of these; a cluster that fills an n-gram with more than `dense` classes is
not paired by n-gram at all. Its members are compared with one set instead, the n-grams
that most of them have, and kept as differences D from it; no set has fewer in all. Two
sets differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)| n-grams: pairs whose differences are short
link by the triangle inequality and need one star; all others link only if their differences
share n-grams. Pairs that share one of their own meet there, so what members only lack
is a meeting place just for pairs that share nothing else. Differences without a possible
partner are dropped in rounds, what is left is cut to prefixes, and these pair as n-grams
do: first with one hub a difference, then only across components. Shared differences are
counted per fragment and summed.

Verification. The order is cut into fragments, sets into segments by fragment. A
pair's overlap is counted per fragment and summed; a link needs
100 * overlap >= percent * union. The first fragment of a pair is what the prefixes
of both cover: it is counted before the others, and a pair that could not link even
if all that follows were shared goes no further.

Defined cases: null and empty texts have no n-grams and link with nothing; a text of
fewer than `n` words is one n-gram; classes of equal sets are linked; null ids come
after all others; repeated rows belong to one class; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmloom.llm.common import attach, broadcast_if_small, free_name, row_key, stage, text_of, without
from firmloom.llm.components import components, star_links
from firmloom.llm.shingles import batch_words, shingle_set

CODE_BITS, SKIP = 40, (1 << 24) - 1
RUN = 1 << 20
FREQUENT_FROM = 16
FRAGMENTS = 4
SALTS = 16


def pack_codes(codes: np.ndarray) -> bytes:
    """Sorted codes as differences of three bytes; a larger difference takes several."""
    steps = np.diff(codes, prepend=codes.dtype.type(0))
    skips, rest = np.divmod(steps, SKIP)
    out = np.full(len(codes) + int(skips.sum()), SKIP, np.uint32)
    out[np.arange(len(codes)) + np.cumsum(skips).astype(np.int64)] = rest
    return out.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    steps = wide.view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64)[steps != SKIP]


def code_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CODE_BITS)


def _runs(n: int, ranges: int):
    """mapInArrow function: packed runs of all n-grams, by range of the code."""
    width = -(-(1 << CODE_BITS) // ranges)

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.sort(np.concatenate(held))
        at = np.searchsorted(codes, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
        rows = [(i, pack_codes(codes[at[i]:at[i + 1]] - np.uint64(i * width))) for i in range(ranges) if at[i] < at[i + 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for words in batch_words(batch.column("text")):
                held.append(code_of(shingle_set(words, n)))
                size += len(held[-1])
                if size >= RUN:
                    yield cut(held)
                    held, size = [], 0
        if size:
            yield cut(held)

    return run, width


def frequent_ngrams(docs: DataFrame, n: int, limit: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the frequent n-grams, by code; at most `limit`."""
    run, width = _runs(n, ranges)

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        codes, seen = np.unique(
            np.concatenate([unpack_codes(x) for x in table.column("run").to_pylist()]), return_counts=True)
        often = seen > FREQUENT_FROM
        return pa.table({"code": (codes[often] + np.uint64(part * width)).astype(np.int64), "seen": seen[often].astype(np.int64)})

    found = stage(
        docs.select("text").mapInArrow(run, "part int, run binary").groupBy("part").applyInArrow(count, "code bigint, seen bigint"),
        "frequent")
    level = F.floor(F.log2("seen")).cast("int")
    sizes = sorted((r[0], r[1]) for r in found.groupBy(level).count().collect())
    bound, total = 0, 0
    for lv, many in reversed(sizes):
        if total + many > limit:
            bound = lv + 1
            break
        total += many
    rows = found.filter(level >= bound).orderBy("code").toPandas()
    return rows["code"].to_numpy(np.uint64), rows["seen"].to_numpy(np.int64)


def in_order(hashes: np.ndarray, codes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in global order, and how many of it are rare. Frequent ones follow, by count and hash."""
    if not len(codes):
        return hashes, len(hashes)
    mine = code_of(hashes)
    at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
    often = codes[at] == mine
    late = hashes[often]
    return np.concatenate((hashes[~often], late[np.lexsort((late, seen[at[often]]))])), int(len(hashes) - often.sum())


def signed(hashes: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def _least(size: int, percent: int) -> int:
    """ceil(percent * size / 100): the smallest partner, and the overlap it needs."""
    return -(-percent * size // 100)


def _prefixes(n: int, percent: int, frequent):
    """mapInArrow function: per document its set's size, signature and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = frequent.value
        for batch in batches:
            sizes, names, prefixes, rares, clusters = [], [], [], [], []
            for words in batch_words(batch.column("text")):
                ngrams = shingle_set(words, n)
                size = len(ngrams)
                sizes.append(size)
                names.append(hashlib.blake2b(ngrams.tobytes(), digest_size=16).digest())
                keep = size - _least(size, percent) + 1 if size else 0
                ordered, rare = in_order(ngrams, codes, seen)
                prefixes.append(signed(ordered[:keep]))
                rares.append(rare)
                clusters.append(int(signed(ordered[rare:]).min()) if size > 2 * rare else None)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(rares, pa.int32()),
                 pa.array(clusters, pa.int64())],
                names=["doc_id", "key", "size", "name", "prefix", "rare", "cluster"])

    return run


def _segments(n: int, frequent):
    """mapInArrow function: a set's segments, one row per fragment of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = frequent.value
        cuts = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64(2**64 // FRAGMENTS)
        for batch in batches:
            classes, parts, segments = [], [], []
            for name, words in zip(batch.column("class").to_pylist(), batch_words(batch.column("text")), strict=True):
                ngrams, rare = in_order(shingle_set(words, n), codes, seen)
                ends = [0, *np.searchsorted(ngrams[:rare], cuts), rare, len(ngrams)]
                for i in range(FRAGMENTS + 1):
                    if ends[i] < ends[i + 1]:
                        classes.append(name)
                        parts.append(i)
                        segments.append(signed(ngrams[ends[i]:ends[i + 1]]))
            ends = np.cumsum([0, *map(len, segments)]).astype(np.int32)
            flat = np.concatenate(segments) if segments else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["class", "fragment", "segment"])

    return run


def _enough(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with this overlap link."""
    return 100 * overlap >= percent * (a + b - overlap)


class JaccardJoin:
    """The join over one table; see the module."""

    def __init__(
        self, docs: DataFrame, n: int = 3, percent: int = 90, frequent_limit: int = 1_000_000,
        dense: int = 64, id_column: str = "doc_id", text_column: str = "text",
    ):
        spark = docs.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        text = text_of(text_column)
        self.n, self.percent, self.dense = n, percent, dense
        self.docs = docs.select(
            F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"),
            row_key(id_column, text_column).alias("key"))
        self.source, self.id_column, self.text_column = docs, id_column, text_column
        ranges = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.frequent = spark.sparkContext.broadcast(frequent_ngrams(self.docs, n, frequent_limit, ranges))
        self.rows = stage(self.docs.select("doc_id", "key", "text").mapInArrow(
            _prefixes(n, percent, self.frequent), "doc_id bigint, key string, size bigint, name binary, prefix array<bigint>, rare int, cluster bigint"), "prefixes")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
        self.classes = stage(
            self.rows.filter("size > 0").groupBy("name").agg(first, F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("rare").alias("rare"),
                F.first("cluster").alias("cluster"))
            .select("name", "size", "prefix", "rare", "cluster", F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"),
                    F.monotonically_increasing_id().alias("class")), "classes")

    def places(self) -> DataFrame:
        """h, class, size, rank, dense: prefix n-grams that several classes share; dense is the class's dense cluster or null."""
        every = self.classes.select("class", "size", "cluster", F.posexplode("prefix").alias("rank", "h"))
        shared = every.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1").select("h")
        places = stage(every.join(shared, "h"), "places")
        full = (
            places.filter("cluster is not null").groupBy("h", "cluster").agg(F.count("*").alias("many"))
            .filter(F.col("many") > self.dense).select("cluster").distinct().withColumn("dense", F.col("cluster"))
        )
        return places.join(broadcast_if_small(stage(full, "dense")), "cluster", "left").drop("cluster")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """class, fragment, segment of the classes in `wanted`."""
        keys = broadcast_if_small(stage(self.classes.join(wanted.select("class"), "class").select("class", "key"), "wanted"))
        texts = self.docs.join(keys, "key").select("class", "text")
        return stage(
            texts.mapInArrow(_segments(self.n, self.frequent), "class bigint, fragment int, segment array<bigint>")
            .dropDuplicates(["class", "fragment"]), "segments")

    def dense_links(self, places: DataFrame) -> DataFrame:
        """Links (a, b) inside dense clusters, enough for their components."""
        members = places.filter("dense is not null").select("class", "dense").distinct()
        mine = stage(self.classes.select("class", "size", "rare", "cluster").join(
            members.select(F.col("dense").alias("cluster")).distinct(), "cluster"), "members")
        if mine.isEmpty():
            return mine.select(F.col("class").alias("a"), F.col("class").alias("b"))
        whole = self.sets(mine).groupBy("class").agg(F.flatten(F.collect_list("segment")).alias("grams"))
        full = stage(mine.join(whole, "class"), "dense_sets")
        own, lost = F.array_except("grams", "hub"), F.array_except("hub", "grams")
        over, under = 100 + self.percent, 100 - self.percent
        far = stage(
            attach(full.withColumn("salt", F.pmod("class", F.lit(SALTS))), self.common_sets(full), ["cluster"], "salt")
            .select("cluster", "class", "size", "salt", F.concat(own, lost).alias("apart"), F.size(lost).alias("lost"))
            .withColumn("f", (over * F.size("apart") - under * F.col("size")).cast("bigint")), "differences")
        # Sets differ by at most |D(x)| + |D(y)|, so f(x) + f(y) <= 0 is a link; the class of least f has all such links.
        centres = far.groupBy("cluster").agg(F.min(F.struct("f", "class")).alias("c"))
        placed = stage(attach(far, centres, ["cluster"], "salt").select(
            "cluster", "class", "f", "apart", "lost", F.col("c.class").alias("centre"), (F.col("f") + F.col("c.f") > 0).alias("away")), "centred")
        star = placed.filter(~F.col("away") & (F.col("class") != F.col("centre"))).select(
            F.col("class").alias("a"), F.col("centre").alias("b"))
        met = self.shared_differences(placed)
        parts = components(star.unionByName(self.close(self.hubs_of_differences(met), placed)))
        met = stage(met.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("part", F.coalesce("part", "class")), "parted")
        return star_links(parts).unionByName(self.close(self.parts_of_differences(met), placed))

    def common_sets(self, full: DataFrame) -> DataFrame:
        """cluster, hub: the n-grams that more than half of a cluster's classes have.

        Counted on the differences from one class, whose places in more than half of them change sides.
        """
        first = stage(full.groupBy("cluster").agg(
            F.min_by("grams", F.struct("rare", -F.col("size"), "class")).alias("first"), F.count("*").alias("members")), "first")
        apart = F.concat(F.array_except("grams", "first"), F.array_except("first", "grams"))
        turned = (
            attach(full.withColumn("salt", F.pmod("class", F.lit(SALTS))), first.select("cluster", "first"), ["cluster"], "salt")
            .select("cluster", F.explode(apart).alias("g")).groupBy("cluster", "g").agg(F.count("*").alias("many"))
            .join(first.select("cluster", "members"), "cluster").filter("2 * many > members")
            .groupBy("cluster").agg(F.collect_list("g").alias("turned")))
        return first.join(turned, "cluster", "left").select("cluster", F.when(F.col("turned").isNull(), F.col("first")).otherwise(
            F.concat(F.array_except("first", "turned"), F.array_except("turned", "first"))).alias("hub"))

    def shared_differences(self, placed: DataFrame) -> DataFrame:
        """cluster, g, class, f, away, usable, rank, salt: differences at which two classes that link may first meet.

        Two classes link if f(x) + f(y) <= 2 (100 + percent) times the differences they share,
        so one with `usable` of them has partners of f <= cap = 2 (100 + percent) usable - f
        only. A pair that shares any n-gram of its own meets at one: there `usable` are those
        left, `beside` them all that the class lacks. Places lacked serve pairs that share
        nothing else: there only those left count. A place without a partner goes, which
        lowers the caps of its class; rounds go on while they take a tenth away. All at which
        a pair that links has to meet stays. Of what is left, the rarest first, a class needs
        no more than the prefix that the overlap with its least partner leaves.
        """
        twice = 2 * (100 + self.percent)
        now = stage(
            placed.select("cluster", "class", "f", "away", "lost", F.size("apart").alias("size"), F.posexplode("apart").alias("at", "g"))
            .withColumn("own", F.col("at") < F.col("size") - F.col("lost")).select(
                "cluster", "class", "f", "away", "own", F.when(F.col("own"), F.col("lost")).otherwise(0).alias("beside"), "g",
                F.lit(0).cast("bigint").alias("many"), F.lit(0).cast("bigint").alias("low")), "differing")
        of_class = Window.partitionBy("class", "own")
        usable = F.count("*").over(of_class) + F.col("beside")
        count = now.count()
        while count:
            capped = (
                now.drop("many", "low").withColumn("cap", twice * usable - F.col("f"))
                .withColumn("salt", F.pmod("class", F.lit(SALTS))))
            away = lambda c: F.when(F.col("away"), F.col(c))
            partners = capped.groupBy("cluster", "g").agg(
                F.count("*").alias("many"), F.min("f").alias("least"), F.max("cap").alias("most"),
                F.min(away("f")).alias("least_away"), F.max(away("cap")).alias("most_away")).filter("many > 1 and least_away is not null")
            now = stage(
                attach(capped, partners, ["cluster", "g"], "salt")
                .withColumn("low", F.when(F.col("away"), F.col("least")).otherwise(F.col("least_away")))
                .withColumn("high", F.when(F.col("away"), F.col("most")).otherwise(F.col("most_away")))
                .filter("low <= cap and f <= high").select("cluster", "class", "f", "away", "own", "beside", "g", "many", "low"), "differing")
            before, count = count, now.count()
            if 10 * count > 9 * before:
                break
        need = F.greatest(F.lit(1), F.ceil((F.col("f") + F.min("low").over(of_class)) / twice) - F.col("beside"))
        ranked = (
            now.withColumn("usable", usable).withColumn("need", need)
            .withColumn("rank", F.row_number().over(of_class.orderBy("many", "g"))))
        return stage(ranked.filter("rank <= usable - beside - need + 1").select(
            "cluster", "g", "class", "f", "away", "usable", "rank", F.pmod("class", F.lit(SALTS)).alias("salt")), "met")

    def may_link(self, a: str, b: str) -> Column:
        """Bounds of two places of one difference, the first that both classes share."""
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        most = 1 + F.least(x("usable") - x("rank"), y("usable") - y("rank"))
        return (x("away") | y("away")) & (x("f") + y("f") <= 2 * (100 + self.percent) * most)

    def hubs_of_differences(self, met: DataFrame) -> DataFrame:
        """Every class with the class of least f that has the same difference: a, b, f."""
        hubs = met.groupBy("cluster", "g").agg(
            F.min(F.struct("f", "class", "away", "usable", "rank")).alias("hub"), F.count("*").alias("many")).filter("many > 1")
        row = F.struct("f", "class", "away", "usable", "rank")
        both = attach(met, hubs, ["cluster", "g"], "salt").select(row.alias("x"), F.col("hub").alias("y"))
        return self.named_pairs(both.filter((F.col("x.class") != F.col("y.class")) & self.may_link("x", "y")))

    def parts_of_differences(self, met: DataFrame) -> DataFrame:
        """Pairs a, b, f of classes that have the same difference and lie in different components."""
        main = (
            met.groupBy("cluster", "g", "part").agg(F.count("*").alias("many")).groupBy("cluster", "g")
            .agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count("*").alias("parts"))
            .filter("parts > 1").select("cluster", "g", "main"))
        mixed = stage(attach(met, main, ["cluster", "g"], "salt"), "mixed")
        other = mixed.filter("part <> main")
        both = other.alias("x").join(mixed.alias("y"), (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.g") == F.col("y.g"))).filter(
            (F.col("x.part") != F.col("y.part")) & self.may_link("x", "y")
            & ((F.col("y.part") == F.col("y.main")) | (F.col("x.class") < F.col("y.class"))))
        return self.named_pairs(both)

    @staticmethod
    def named_pairs(both: DataFrame) -> DataFrame:
        return both.select(
            F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b"),
            (F.col("x.f") + F.col("y.f")).alias("f")).distinct()

    def close(self, pairs: DataFrame, placed: DataFrame) -> DataFrame:
        """The rows (a, b) of `pairs` that link: shared differences are counted per fragment of the order and summed."""
        pairs = stage(pairs, "apart_pairs")
        wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        width = 2**64 // FRAGMENTS
        cuts = [-(2**63) + i * width for i in range(1, FRAGMENTS)]
        within = lambda i: lambda g: (
            (g >= F.lit(cuts[i - 1]) if i else F.lit(True)) & (g < F.lit(cuts[i]) if i < len(cuts) else F.lit(True)))
        fragments = F.array(*(
            F.struct(F.lit(i).alias("fragment"), F.filter("apart", within(i)).alias("segment")) for i in range(FRAGMENTS)))
        segments = stage(
            placed.join(wanted, "class").select("class", F.explode(fragments).alias("s")).select("class", "s.*")
            .filter(F.size("segment") > 0), "apart_segments")
        left = segments.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("mine"))
        right = segments.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("other"))
        sums = (
            pairs.join(left, "a").join(right, ["b", "fragment"])
            .select("a", "b", "f", F.size(F.array_intersect("mine", "other")).alias("shared"))
            .groupBy("a", "b", "f").agg(F.sum("shared").alias("shared")))
        return sums.filter(F.col("f") <= 2 * (100 + self.percent) * F.col("shared")).select("a", "b")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that may still link after the part of the order that both prefixes cover."""
        whole = F.col("rare") < F.size("prefix")  # all rare n-grams of the set are in the prefix
        heads = self.classes.select(
            "class", F.slice("prefix", 1, F.least("rare", F.size("prefix"))).alias("head"),
            F.when(whole, F.lit(2**63 - 1)).otherwise(F.element_at("prefix", -1)).alias("upto"))
        of = lambda c: heads.select(F.col("class").alias(c), F.col("head").alias(f"head_{c}"), F.col("upto").alias(f"upto_{c}"))
        upto = F.least("upto_a", "upto_b")
        left = lambda c: F.col(f"size_{c}") - F.size(F.filter(f"head_{c}", lambda x: x <= F.col("upto")))
        shared = F.size(F.filter(F.array_intersect("head_a", "head_b"), lambda x: x <= F.col("upto")))
        both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("upto", upto)
        return both.filter(_enough(shared + F.least(left("a"), left("b")), F.col("size_a"), F.col("size_b"), self.percent)).select(
            "a", "b", "size_a", "size_b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The rows (a, b) of `pairs` that link, by partial overlaps of their segments."""
        pairs = stage(self.plausible(pairs), "pairs")
        segments = self.sets(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct())
        left = segments.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("mine"))
        right = segments.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("other"))
        parts = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
            "a", "b", "size_a", "size_b", F.size(F.array_intersect("mine", "other")).alias("shared"))
        sums = parts.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
        return sums.filter(_enough(F.col("shared"), F.col("size_a"), F.col("size_b"), self.percent)).select("a", "b")

    def near(self, a: str, b: str) -> Column:
        """Length and position bounds of two places of one n-gram; pairs of one dense cluster are found otherwise."""
        size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
        most = 1 + F.least(size_a - F.col(f"{a}.rank") - 1, size_b - F.col(f"{b}.rank") - 1) + F.least(f"{a}.rank", f"{b}.rank")
        apart = ~F.coalesce(F.col(f"{a}.dense") == F.col(f"{b}.dense"), F.lit(False))
        return (
            apart & (100 * F.least(size_a, size_b) >= self.percent * F.greatest(size_a, size_b))
            & _enough(most, size_a, size_b, self.percent)
        )

    def hub_pairs(self, places: DataFrame) -> DataFrame:
        """Every class with the smallest class of its n-gram and length band."""
        band = F.floor(F.log("size") / F.log(F.lit(100 / self.percent)))
        banded = places.withColumn("band", band)
        hubs = banded.groupBy("h", "band").agg(F.min(F.struct("size", "class", "rank", "dense")).alias("hub"), F.count("*").alias("many"))
        hubs = hubs.filter("many > 1").select("h", "band", "hub.*")
        near = banded.alias("x").join(hubs.alias("y"), ["h", "band"]).filter(
            (F.col("x.class") != F.col("y.class")) & self.near("x", "y"))
        return near.select(
            F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.size").alias("size_a"),
            F.col("y.size").alias("size_b")).distinct()

    def cross_pairs(self, places: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs of an n-gram's classes that lie in different components, once each."""
        placed = stage(
            places.join(parts.withColumnRenamed("node", "class"), "class", "left")
            .withColumn("part", F.coalesce("part", "class")), "placed")
        main = (
            placed.groupBy("h", "part").agg(F.count("*").alias("many")).groupBy("h")
            .agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.count("*").alias("parts"))
            .filter("parts > 1").select("h", "main")
        )
        mixed = stage(placed.join(main, "h"), "mixed")
        other = mixed.filter("part <> main")
        pairs = other.alias("x").join(mixed.alias("y"), F.col("x.h") == F.col("y.h")).filter(
            (F.col("x.part") != F.col("y.part")) & self.near("x", "y")
            & ((F.col("y.part") == F.col("y.main")) | (F.col("x.class") < F.col("y.class"))))
        flip = F.col("x.class") < F.col("y.class")
        low = lambda c: F.when(flip, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
        high = lambda c: F.when(flip, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))
        return pairs.select(
            low("class").alias("a"), high("class").alias("b"), low("size").alias("size_a"), high("size").alias("size_b")).distinct()

    def links(self) -> DataFrame:
        """Links (a, b) between classes, verified or of the stars that such links come to; their components are those of all links."""
        places = stage(self.places(), "places")
        parts = components(self.verify(self.hub_pairs(places)).unionByName(self.dense_links(places)))
        second = self.verify(self.cross_pairs(places, parts))
        return star_links(parts).unionByName(second)

    def placed(self) -> DataFrame:
        """doc_id, key, size, component_id and first_key, the key of the row that stands for the component."""
        parts = components(self.links()).withColumnRenamed("node", "class")
        placed = stage(
            self.classes.select("name", "doc_id", "key", "class", F.pmod("class", F.lit(SALTS)).alias("salt"))
            .join(parts, "class", "left").withColumn("part", F.coalesce("part", "class")), "parts")
        least = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"))
        named = attach(placed, least, ["part"], "salt").select(
            "name", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
        rows = self.rows.select("doc_id", "key", "size", "name").withColumn("salt", F.substring("key", 1, 2))
        columns = ["doc_id", "key", "size", "component_id", "first_key"]
        joined = attach(rows.filter("size > 0"), named, ["name"], "salt").select(*columns)
        alone = rows.filter("size = 0").select(
            "doc_id", "key", "size", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("first_key"))
        return joined.unionByName(alone)

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        return self.placed().select("doc_id", F.col("size").alias("n_shingles"), "component_id")

    def keep_one(self) -> DataFrame:
        """The rows of the input without all but one of each component: that of the smallest id stays."""
        keys = stage(self.placed().filter("size > 0").groupBy("key").agg(
            F.first("first_key").alias("first_key"), F.count("*").alias("many")), "kept")
        kept = without(self.source, keys.filter("key <> first_key"), self.id_column, self.text_column)
        again = keys.filter("key = first_key and many > 1").select("key")
        if again.isEmpty():
            return kept
        name = free_name(kept.columns, "key")
        keyed = kept.withColumn(name, row_key(self.id_column, self.text_column))
        repeated = again.select(F.col("key").alias(name))
        once = keyed.join(broadcast_if_small(repeated), name, "left_anti")
        return once.unionByName(keyed.join(broadcast_if_small(repeated), name, "left_semi").dropDuplicates([name])).drop(name)


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    return JaccardJoin(docs, **options).documents()
