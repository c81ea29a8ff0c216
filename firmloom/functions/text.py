"""String and date expressions over names, addresses and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmloom import lexicons as L


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, NULL when nothing is left."""
    trimmed = F.trim(col(c))
    return F.when(trimmed != "", trimmed)


def words_pattern(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def county(address: Column | str, counties: list[str] = L.COUNTIES) -> Column:
    """First county named in the address: earliest position, then the longest name."""
    text = F.lower(col(address))
    hits = F.array(*[
        F.when(text.contains(name), F.struct(
            F.position(F.lit(name), text).alias("at"),
            F.lit(-len(name)).alias("size"),
            F.lit(name).alias("name"),
        ))
        for name in counties
    ])
    return F.initcap(F.array_min(hits)["name"])


def eircode(address: Column | str, pattern: str = L.EIRCODE) -> Column:
    found = F.regexp_extract(col(address), pattern, 1)
    return F.upper(F.when(found != "", found))


def squash_ws(name: Column | str) -> Column:
    """Collapse whitespace (any script's) to single spaces; NULL when nothing is left."""
    return blank_to_null(F.regexp_replace(col(name), r"(?U)\s+", " "))


def fold_legal_name(name: Column | str, suffixes: list[str] = L.LEGAL_SUFFIXES) -> Column:
    """Matching form of a legal name: suffix words out, upper case, single spaces.

    Punctuation stays, so "LTD." leaves ".".
    """
    bare = F.regexp_replace(col(name), words_pattern(suffixes), "")
    return F.trim(F.regexp_replace(F.upper(bare), r"\s+", " "))


def fold_id(number: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(number), "[^A-Za-z0-9]", ""))


def first_token(name: Column | str) -> Column:
    return F.split_part(col(name), F.lit(" "), F.lit(1))


def parse_register_date(value: Column | str) -> Column:
    """"D Month YYYY" to ISO text; anything else passes through."""
    v = col(value)
    return F.coalesce(F.try_to_date(v, "d MMMM yyyy").cast("string"), v)


def clean_firm_name(
    name: Column | str,
    suffixes: list[str] = L.LEGAL_SUFFIXES,
    noise: list[str] = L.SECTOR_NOISE,
) -> Column:
    """Letters and digits of a name once legal and sector words are out."""
    bare = F.regexp_replace(F.lower(col(name)), words_pattern(suffixes + noise), " ")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def years_operating(iso: Column | str, as_of: Column) -> Column:
    years = F.year(as_of) - F.substring(col(iso), 1, 4).try_cast("int")
    return F.when(years >= 0, years)


def display_date(value: Column | str) -> Column:
    """"D Mon YYYY" for an ISO date, else the input."""
    v = col(value)
    return F.coalesce(F.date_format(F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd"), "d MMM yyyy"), v)


def tier(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 70, "high").when(s >= 40, "medium").otherwise("low")


def fit_label(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 70, "Strong").when(s >= 40, "Moderate").otherwise("Low")


def dimension_pct(level: Column | str, pct: Column | str) -> Column:
    lv = F.lower(col(level))
    return F.coalesce(
        col(pct).cast("double"),
        F.when(lv == "high", 90.0).when(lv == "medium", 58.0).otherwise(18.0),
    )


def dimension_bar(pct: Column) -> Column:
    """Bar width: whole percent between 2 and 100."""
    return F.greatest(F.lit(2), F.least(F.lit(100), F.round(pct).cast("int")))


def describe_authorisation(
    text: Column | str,
    labels: list[tuple[str, str]] = L.AUTHORISATIONS,
    other: str = L.AUTHORISATION_OTHER,
) -> Column:
    """Label of the first keyword (in list order) found in the text."""
    lowered = F.lower(col(text))
    return F.coalesce(*[F.when(lowered.contains(k), F.lit(v)) for k, v in labels], F.lit(other))


def host_of(url: Column | str) -> Column:
    """Lower-case host of an absolute URL, without a leading www."""
    host = F.lower(F.regexp_extract(col(url), r"^[A-Za-z]+://([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def domain_label(url: Column | str) -> Column:
    """First label of the host, letters and digits only."""
    return F.regexp_replace(F.split_part(host_of(url), F.lit("."), F.lit(1)), "[^a-z0-9]", "")
