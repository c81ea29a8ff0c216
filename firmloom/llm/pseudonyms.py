"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes its kind's validation (checksum, calendar, ranges) is read as a
number in a mixed radix: one digit per place, whose size is what the format allows
there. A keyed Feistel network over two halves of that domain permutes it, walking on
until the result lies in the domain, so the mapping is one to one within the format,
keeps its layout and its validity, and needs no table: equal values get equal
pseudonyms in every document and task. Separators and letter case stay. The kind and
what is kept (country, issuer, domain name) are part of the key of the permutation.

Kinds: e-mail local parts, IBANs (mod 97), IPv4 addresses, phone numbers, US social
security numbers, dates (ISO, dotted, slashed; 1900 to 2099) and payment cards
(Luhn). Where two candidates overlap the one first in this order counts. Slashes are
day/month, or month/day where the second number is above 12; all layouts share one
domain, so a date is linked in each of them. Digit groups before or behind a card, and
words behind an IBAN, may match with it: such a match is tried at its group borders, from
every group on. Values of the usual length (of the country, of the card's first digits)
are taken first, in the whole text, other lengths from the longest to the shortest only
in what is left; so a value is the same whatever stands beside it, unless a group and a
part of the value make up a valid value of usual length themselves.

The way back goes by the spans of `values`, not by a second search: a pseudonym beside
other groups, or a month/day date whose new day is 12 or less, could be read in two ways.

Defined cases: a null text stays null, an empty one empty, both without values; very
long texts are scanned whole; a value that fails validation stays; repeated rows give
equal rows; an empty table gives no rows; other columns are kept as they are, and the
column of values takes a name that the table does not have.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmloom.llm.common import free_name

ROUNDS = 8
START, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


class Feistel:
    """Keyed permutations of range(size), one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, size: int) -> int:
        data = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        wide = (size.bit_length() + 64 + 7) // 8
        digest, n = b"", 0
        while len(digest) < wide:
            digest += hashlib.blake2b(bytes([i, n]) + data, key=self.key, salt=hashlib.blake2b(tweak, digest_size=16).digest()).digest()
            n += 1
        return int.from_bytes(digest[:wide], "big") % size

    def permute(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        """The image of `value` in range(size); with `back` its origin."""
        a = isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        while True:
            x, y = divmod(value, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2:
                    x = (x + (-1 if back else 1) * self._round(tweak, i, y, a)) % a
                else:
                    y = (y + (-1 if back else 1) * self._round(tweak, i, x, b)) % b
            value = x * b + y
            if value < size:
                return value

    def places(self, digits: list[int], sizes: list[int], tweak: bytes, back: bool = False) -> list[int]:
        """The image of a mixed-radix number, digit by digit."""
        value, size = 0, 1
        for d, s in zip(digits, sizes, strict=True):
            value, size = value * s + d, size * s
        value, out = self.permute(value, size, tweak, back), []
        for s in reversed(sizes):
            value, d = divmod(value, s)
            out.append(d)
        return out[::-1]


def luhn_digit(payload: str) -> str:
    """The check digit that follows `payload`."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    """The two check digits of an IBAN."""
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def refill(text: str, new: str, holds: Callable[[str], bool] = str.isdigit) -> str:
    """`text` with its characters that `holds` replaced in turn by those of `new`."""
    rest = iter(new)
    return "".join(next(rest) if holds(c) else c for c in text)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _class_permuted(text: str, tweak: bytes, f: Feistel, back: bool) -> str:
    """Letters to letters and digits to digits, case kept; other characters stay."""
    kinds = [LETTERS if c.lower() in LETTERS else DIGITS for c in text if c.isascii() and c.isalnum()]
    flat = [c for c in text if c.isascii() and c.isalnum()]
    out = f.places([k.index(c.lower()) for k, c in zip(kinds, flat, strict=True)], [len(k) for k in kinds], tweak, back)
    new = "".join(k[d].upper() if c.isupper() else k[d] for k, d, c in zip(kinds, out, flat, strict=True))
    return refill(text, new, lambda c: c.isascii() and c.isalnum())


def email(m: re.Match, f: Feistel, back: bool = False) -> str | None:
    local, domain = m[0].rsplit("@", 1)
    if not any(c.isalnum() for c in local):
        return None
    shape = "".join("a" if c.lower() in LETTERS else "0" if c in DIGITS else c for c in local)
    return f"{_class_permuted(local, f'email:{shape}@{domain.lower()}'.encode(), f, back)}@{domain}"


IBAN_LENGTH = {
    c[:2]: int(c[2:]) for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
        "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()}


def _borders(text: str, marks: str) -> list[int]:
    """Ends of the prefixes that end with a group, longest first."""
    return [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] in marks)]


def iban_length(text: str) -> int | None:
    return IBAN_LENGTH.get(text[:2])


def iban_valid(text: str) -> bool:
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and iban_check(bare[:2], bare[4:]) == bare[2:4]


def iban(m: re.Match | list[str], f: Feistel, back: bool = False) -> str | None:
    bare = m[0].replace(" ", "")
    country, rest = bare[:2], bare[4:]
    if not iban_valid(m[0]):
        return None
    shape = "".join("0" if c in DIGITS else "A" for c in rest)
    new = _class_permuted(rest, f"iban:{country}{shape}".encode(), f, back)
    return refill(m[0], country + iban_check(country, new) + new, lambda c: c != " ")


def ipv4(m: re.Match, f: Feistel, back: bool = False) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if not 1 <= octets[0] <= 223 or max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    out = f.places([octets[0] - 1, *octets[1:]], [223, 256, 256, 256], b"ipv4", back)
    return ".".join(map(str, [out[0] + 1, *out[1:]]))


def phone(m: re.Match, f: Feistel, back: bool = False) -> str | None:
    plus, bare = m[0].startswith("+"), _digits(m[0])
    local = bare[1:] if len(bare) == 11 and bare[0] == "1" else bare
    if len(local) == 10 and (not plus or len(bare) == 11) and local[0] in "23456789" and local[3] in "23456789":
        least = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
        out = f.places([int(c) - n for c, n in zip(local, least, strict=True)], [10 - n for n in least], b"phone:nanp", back)
        new = "".join(str(d + n) for d, n in zip(out, least, strict=True))
        return refill(m[0], bare[: len(bare) - 10] + new)
    if not plus or not 8 <= len(bare) <= 15:
        return None
    kept, rest = bare[:2], bare[2:]
    out = f.places([int(c) for c in rest], [10] * len(rest), f"phone:{kept}:{len(rest)}".encode(), back)
    return refill(m[0], kept + "".join(map(str, out)))


def ssn(m: re.Match, f: Feistel, back: bool = False) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    out = f.places([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], b"ssn", back)
    area = out[0] + 1 + (out[0] >= 665)
    return f"{area:03d}-{out[1] + 1:02d}-{out[2] + 1:04d}"


def date_layout(text: str) -> str:
    """Order of the parts: ymd, dmy, or mdy where the second of slashed parts can be no month."""
    if "-" in text:
        return "ymd"
    return "mdy" if "/" in text and int(text[3:5]) > 12 else "dmy"


def date(m: re.Match | list[str], f: Feistel, back: bool = False, layout: str | None = None) -> str | None:
    """All layouts share one permutation of the days; `layout` is the order to read, by default that of date_layout."""
    mark = next(c for c in m[0] if not c.isdigit())
    layout = layout or date_layout(m[0])
    parts = dict(zip(layout, map(int, m[0].split(mark)), strict=True))
    try:
        at = dt.date(parts["y"], parts["m"], parts["d"]).toordinal() - START
    except ValueError:
        return None
    if not 0 <= at < DAYS:
        return None
    new = dt.date.fromordinal(START + f.permute(at, DAYS, b"date", back))
    shown = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(shown[c] for c in layout)


def card_length(text: str) -> int | None:
    """The usual number of digits of a card that begins like `text`."""
    first, second = (_digits(text[:4]) + "0")[:2]
    if first == "3":
        return {"4": 15, "7": 15, "5": 16}.get(second, 14)
    return {"1": 15, "2": 16, "4": 16, "5": 16, "6": 16}.get(first)


def card_valid(text: str) -> bool:
    bare = _digits(text)
    return 13 <= len(bare) <= 19 and bare[0] != "0" and luhn_digit(bare[:-1]) == bare[-1]


def card(m: re.Match | list[str], f: Feistel, back: bool = False) -> str | None:
    bare = _digits(m[0])
    if not card_valid(m[0]):
        return None
    rest = bare[1:-1]
    out = f.places([int(c) for c in rest], [10] * len(rest), f"card:{bare[0]}:{len(rest)}".encode(), back)
    new = bare[0] + "".join(map(str, out))
    return refill(m[0], new + luhn_digit(new))


NOT_BEFORE, NOT_AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
KINDS: dict[str, tuple[re.Pattern, Callable]] = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    "iban": (re.compile(NOT_BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?" + NOT_AFTER), iban),
    "ipv4": (re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"), ipv4),
    "phone": (re.compile(
        r"(?<![A-Za-z0-9+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9](?:[ ./()-]{0,2}[0-9]){7,14}"
        r"|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + NOT_AFTER), phone),
    "ssn": (re.compile(NOT_BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])"), ssn),
    "date": (re.compile(
        r"(?<![A-Za-z0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
        r"(?:(?![A-Za-z0-9]|[.-][0-9])|(?<=-[0-9]{2})(?=T[0-9]{2}))"), date),
    "card": (re.compile(NOT_BEFORE + r"[0-9](?:[ -]?[0-9]){12,18}" + NOT_AFTER), card),
}
ANY = re.compile("[0-9@]")
# kind -> (usual length, validation, borders of groups)
GROUPED: dict[str, tuple[Callable, Callable, str]] = {"iban": (iban_length, iban_valid, " "), "card": (card_length, card_valid, " -")}


def _grouped(kind: str, text: str, used: bytearray, usual: bool) -> Iterator[tuple[int, int]]:
    """Spans of the valid values of a grouped kind; with `usual` only those of the usual length."""
    length, valid, marks = GROUPED[kind]
    at = 0
    while m := KINDS[kind][0].search(text, at):
        ends = _borders(m[0], marks)
        if usual:
            ends = [e for e in ends if sum(c not in marks for c in m[0][:e]) == length(m[0])]
        hit = next((e for e in ends if not any(used[m.start():m.start() + e]) and valid(m[0][:e])), None)
        if hit:
            at = m.start() + hit
            yield m.start(), at
        else:
            at = next((i for i in range(m.start(), m.end()) if text[i] in marks), m.end())


def _candidates(kind: str, text: str, used: bytearray) -> Iterator[tuple[int, int]]:
    if kind in GROUPED:
        yield from _grouped(kind, text, used, True)
        yield from _grouped(kind, text, used, False)
    else:
        yield from (m.span() for m in KINDS[kind][0].finditer(text))


def find_values(text: str, f: Feistel) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the validated values, by start."""
    taken: list[tuple[int, int, str, str]] = []
    if not ANY.search(text):
        return taken
    used = bytearray(len(text))
    for kind, (_, new) in KINDS.items():
        for start, end in _candidates(kind, text, used):
            if any(used[start:end]):
                continue
            pseudonym = new([text[start:end]], f)
            if pseudonym is not None:
                used[start:end] = b"\x01" * (end - start)
                taken.append((start, end, kind, pseudonym))
    return sorted(taken)


def replace_values(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def value_spans(text: str, found: list[tuple[int, int, str, str]]) -> list[dict]:
    """What the way back needs of each value: its kind, its place in the old and in the new text, a date's layout."""
    spans, moved = [], 0
    for start, end, kind, new in found:
        spans.append({
            "kind": kind, "start": start, "end": end, "new_start": start + moved, "new_end": start + moved + len(new),
            "layout": date_layout(text[start:end]) if kind == "date" else None})
        moved += len(new) - (end - start)
    return spans


def restore_values(text: str, spans: list[dict], f: Feistel) -> str:
    """The old text of a new one and its value_spans."""
    found = []
    for s in spans:
        value = text[s["new_start"]:s["new_end"]]
        more = {"layout": s["layout"]} if s["layout"] else {}
        old = KINDS[s["kind"]][1]([value], f, True, **more)
        if old is None:
            raise ValueError(f"no pseudonym of kind {s['kind']} at {s['new_start']}")
        found.append((s["new_start"], s["new_end"], s["kind"], old))
    return replace_values(text, found)


VALUE = pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("new_start", pa.int64()), ("new_end", pa.int64()), ("layout", pa.string())])
VALUES = "array<struct<kind:string,start:bigint,end:bigint,new_start:bigint,new_end:bigint,layout:string>>"


def _mapped(docs: DataFrame, kept: list[str], inputs: list[Column], step: Callable, schema: str) -> DataFrame:
    """`rest` (the columns `kept`) and the columns that `step` makes of each batch of `inputs`, in Arrow tasks."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    rest = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias(free_name(kept, "pad")))
    packed = docs.select(rest.alias("rest"), *inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *columns.values()], names=["rest", *columns])

    return packed.mapInArrow(run, f"rest {packed.schema['rest'].dataType.simpleString()}, {schema}")


def _unpacked(done: DataFrame, columns: list[str], text_column: str) -> list[Column]:
    return [(F.col("text") if c == text_column else done["rest"].getField(c)).alias(c) for c in columns]


def pseudonymise(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """`docs` with the values of its text replaced, and as last column `values` (see VALUES), or `found_values` if
    there is one already. `restore` undoes it."""

    def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        f, texts, values = Feistel(key), [], []
        for text in batch.column("text").to_pylist():
            found = find_values(text, f) if text else []
            texts.append(replace_values(text, found) if found else text)
            values.append(value_spans(text, found) if found else [])
        return {"text": pa.array(texts, pa.string()), "values": pa.array(values, pa.list_(VALUE))}

    kept = [c for c in docs.columns if c != text_column]
    done = _mapped(docs, kept, [F.col(f"`{text_column}`").alias("text")], step, f"text string, values {VALUES}")
    return done.select(*_unpacked(done, docs.columns, text_column), F.col("values").alias(free_name(docs.columns, "values")))


def restore(done: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """What `pseudonymise` was given, from its result and the same key. The last column must be that of the values."""
    name = done.columns[-1]

    def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        f = Feistel(key)
        pairs = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
        return {"text": pa.array([restore_values(t, v, f) if v else t for t, v in pairs], pa.string())}

    inputs = [F.col(f"`{text_column}`").alias("text"), F.col(f"`{name}`").alias("spans")]
    back = _mapped(done, [c for c in done.columns[:-1] if c != text_column], inputs, step, "text string")
    return back.select(*_unpacked(back, done.columns[:-1], text_column))


def pseudonym_report(done: DataFrame) -> DataFrame:
    """doc_id, the new text, and the number of values of each kind, of a result of `pseudonymise`."""
    name = done.columns[-1]
    count = lambda k: F.size(F.filter(name, lambda v: v["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return done.select("doc_id", "text", *[count(k) for k in KINDS])
