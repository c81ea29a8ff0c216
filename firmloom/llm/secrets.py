"""Secret scan: known forms, and windows of high Shannon entropy.

Base forms are found by pattern, leftmost and non-overlapping for each kind; a match
that fails the length of its kind is dropped after it was matched, so it still uses
up its characters. The method adds spans of kind `entropy_hex` and `entropy_base64`:
the pieces of a class get the entropy of every window of `window` characters. The
window moves by one character; the counts of the leaving and the entering character
change by one and the sum of c * log2(c) follows from those two changes. A span runs
from the first window above the class's threshold to the end of the last.

Pieces of hexadecimal digits are the maximal runs of them, whatever stands beside. Pieces
of key characters are the maximal runs without "=", so a name before it is a piece of its
own; where a run holds one of `words`, its parts between "/", "_" and "-" are the pieces.
Pieces of hexadecimal digits alone belong to that class only. A piece that `allowed` or
one of `words` matches gives no span, its neighbours do; base spans stay.

All of it is one projection over the row, without a shuffle. Offsets are code
points, ends exclusive.

Defined cases: a null text is empty; an empty text has no spans, its digest is that
of the empty string; very long texts are scanned whole; rows are scanned one by one, so ties and repeated rows each
give their own result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import text_of

# The forms of the contract.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 6
# A run of the class is matched whole, so the least length can stand in the pattern; the
# look-behind only spares a second look at the rest of a run that was too short.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# class -> (maximal runs, characters, bits a character)
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 3.0),
    "entropy_base64": (
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.75),
}
ALL_HEX = r"^[0-9A-Fa-f]+$"
PART = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{20,}"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[^0-9]*$",  # words and identifiers without a digit
    r"^[0-9+/_-]*$",  # numbers, rules of dashes
)
WORDS = (
    r"(?i)example|placeholder|changeme|your_?key|xxxx",
    r"(?i)0123456789|abcdefgh",
)


def _at(matches: Column, gaps: Column, keep: Column, kind: int) -> Column:
    """array<struct<start, kind, end>> of the kept matches; gaps are the texts between them."""
    size = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    skip = F.transform(gaps, lambda g: F.length(g).cast("bigint"))
    state = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(
        F.arrays_zip(size.alias("size"), F.slice(skip, 1, F.size(size)).alias("skip")), state,
        lambda s, x: F.struct(
            (s["pos"] + x["skip"] + x["size"]).alias("pos"),
            F.concat(s["starts"], F.array(s["pos"] + x["skip"])).alias("starts")),
        lambda s: s["starts"],
    )
    spans = F.zip_with(starts, F.arrays_zip(size.alias("size"), keep.alias("keep")), lambda start, x: F.struct(
        start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["keep"].alias("keep")))
    return F.transform(
        F.filter(spans, lambda s: s["keep"]),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")


def _found(rows: DataFrame, name: str, pattern: str, kind: int, least: int = 0, group: int = 0) -> DataFrame:
    """Add `name`, the spans of a pattern whose `group` has at least `least` characters, and `<name>_text`, all matches."""
    texts = f"{name}_text"
    rows = rows.withColumn(texts, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    keep = F.transform(texts, lambda m: F.lit(True)) if not least else F.transform(
        texts, lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least)
    gaps = F.split("text", pattern, -1)
    return rows.withColumn(name, F.when(F.size(texts) > 0, _at(F.col(texts), gaps, keep, kind)).otherwise(_none()))


def hot_windows(candidate: Column, characters: str, bits: float, window: int) -> Column:
    """struct(first, last): start of the first and end of the last window of high entropy; first 0: none.

    Positions count from 1. The state carries the counts of the class's characters
    in the window and sum = sum of c * log2(c); entropy is log2(window) - sum / window.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(characters), ch))
    slots = len(characters)
    empty = F.struct(
        F.array_repeat(F.lit(0), slots).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"),
        F.lit(0).alias("first"), F.lit(0).alias("last"))
    most = (math.log2(window) - bits) * window

    def step(s, x):
        came, went = x["came"], x["went"]
        gone = F.when(went == 0, F.lit(0)).otherwise(F.get(s["counts"], went - 1))
        there = F.get(s["counts"], came - 1) - F.when(went == came, 1).otherwise(0)
        total = (
            s["sum"]
            - F.when(went == 0, F.lit(0.0)).otherwise(F.get(terms, gone) - F.get(terms, gone - 1))
            + F.get(terms, there + 1) - F.get(terms, there)
        )
        n = s["n"] + 1
        hot = (n >= window) & (total <= F.lit(most))
        counts = F.when(went == came, s["counts"]).otherwise(F.transform(
            s["counts"], lambda c, k: c + F.when(k == came - 1, 1).when(k == went - 1, -1).otherwise(0)))
        return F.struct(
            counts.alias("counts"), total.alias("sum"), n.alias("n"),
            F.when(hot & (s["first"] == 0), n - window + 1).otherwise(s["first"]).alias("first"),
            F.when(hot, n).otherwise(s["last"]).alias("last"))

    leaving = lambda all_codes: F.concat(F.array_repeat(F.lit(0), window), all_codes)
    moves = F.arrays_zip(codes.alias("came"), F.slice(leaving(codes), 1, F.size(codes)).alias("went"))
    return F.aggregate(moves, empty, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.greatest(*[text.rlike(p) for p in patterns], F.lit(False), F.lit(False))


def _pieces(runs: Column, places: Column, words: tuple[str, ...]) -> Column:
    """array<struct<text, at>>: the runs, and of those with one of `words` their parts."""
    placed = F.zip_with(runs, places, lambda run, p: F.struct(run.alias("text"), p["start"].alias("at")))

    def parts(run: Column) -> Column:
        found = F.regexp_extract_all(run["text"], F.lit(PART), F.lit(0))
        spans = _at(found, F.split(run["text"], PART, -1), F.transform(found, lambda _: F.lit(True)), 0)
        return F.when(F.size(found) > 0, F.zip_with(found, spans, lambda part, p: F.struct(
            part.alias("text"), (run["at"] + p["start"]).alias("at")))).otherwise(
            F.array().cast("array<struct<text:string,at:bigint>>"))

    return F.concat(
        F.filter(placed, lambda r: ~_matches(r["text"], words)),
        F.flatten(F.transform(F.filter(placed, lambda r: _matches(r["text"], words)), parts)))


def _entropy(rows: DataFrame, window: int, allowed: tuple[str, ...], words: tuple[str, ...]) -> DataFrame:
    """Add `entropy`: spans of both classes."""
    spans = []
    for name, (runs, characters, bits) in CLASSES.items():
        rows = _found(rows, name, runs, 0)
        texts, places, kind = F.col(f"{name}_text"), F.col(name), KINDS.index(name)
        if name == "entropy_hex":
            pieces = F.zip_with(texts, places, lambda run, p: F.struct(run.alias("text"), p["start"].alias("at")))
        else:
            pieces = F.filter(_pieces(texts, places, words), lambda p: ~p["text"].rlike(ALL_HEX))
        scanned = F.transform(
            F.filter(pieces, lambda p: ~_matches(p["text"], allowed + words)),
            lambda p: F.struct(p["at"].alias("at"), hot_windows(p["text"], characters, bits, window).alias("w")))
        hot = F.transform(F.filter(scanned, lambda s: s["w"]["first"] > 0), lambda s: F.struct(
            (s["at"] + s["w"]["first"] - 1).alias("start"), F.lit(kind).alias("kind"), (s["at"] + s["w"]["last"]).alias("end")))
        spans.append(F.when(F.size(texts) > 0, hot).otherwise(_none()))
    return rows.withColumn("entropy", F.concat(*spans))


def find_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    window: int = 20, allowed: tuple[str, ...] = ALLOWED, words: tuple[str, ...] = WORDS,
) -> DataFrame:
    """doc_id and `spans`: array<struct<start, kind, end>> by start, kind, end; `kind` indexes KINDS."""
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    rows = _found(rows, "assign", ASSIGN, 0, ASSIGN_LENGTH, 2)
    rows = _found(rows, "access", ACCESS, 1)
    rows = _found(rows, "hex", HEX, 2)
    rows = _entropy(rows, window, allowed, words)
    return rows.select(
        "doc_id", F.array_sort(F.concat("assign", "access", "hex", "entropy")).alias("spans"))


def _printed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one string."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_printed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _printed(F.col("spans")).alias("spans"),
    )
