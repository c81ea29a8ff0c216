"""Evidence from crawled pages and search hits: tables of pages in, features out.

`pages`: url, status, server, html. `search_hits`: company_id, query_no, rank,
title, url. Texts and lists are whole; a caller may pass a limit, which is then a
`row_number` filter that Spark applies before the shuffle.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmloom import lexicons as L
from firmloom.functions.people import contact_channel, is_generic_inbox, is_plausible_person, people_bearing
from firmloom.functions.similarity import partial_ratio_udf, wratio_udf
from firmloom.functions.text import (
    blank_to_null, clean_firm_name, col, describe_authorisation, display_date, domain_label, host_of,
)
from firmloom.session import cut

SITE_SCORE, BLOCKED_SCORE, ANCHOR_FLOOR, OFF_SECTOR_CAP = 30, 40, 75, 25
PAGE_SEPARATOR = "--- additional page ---"
LINK_LINE = r"^\[[^\n]*\]\(([^)\n]+)\)"


# --- Pages -----------------------------------------------------------------

ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Latin-1 characters by name; other named characters are removed with all others beyond Latin-1.
NAMED = {name: chr(code) if code < 256 else "" for name, code in name2codepoint.items()} | {"apos": "'"}


def _up_to(place: str, limit: int | None) -> Column:
    return F.lit(True) if limit is None else F.col(place) <= limit


def _start(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def decode_entities(text: Column) -> Column:
    """Character references as Latin-1 characters; those beyond are removed, unknown names stay."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def decoded(entity: Column) -> Column:
        body = F.substring(entity, F.lit(2), F.length(entity) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7))
        number = F.try_to_number(code, F.lit("9999999")).cast("int")
        return (
            F.when(~body.startswith("#"), F.coalesce(F.try_element_at(names, body), entity))
            .when(number.between(1, 255), F.char(number)).otherwise("")
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), decoded)
    between = F.split(text, ENTITY, -1)
    whole = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(ENTITY), whole).otherwise(text)


def page_text(html: Column | str, limit: int | None = None, decode: bool = True, min_chars: int = 1) -> Column:
    """Readable text of a page; NULL when fewer than `min_chars` characters remain."""
    text = F.regexp_replace(
        col(html),
        r"(?is)<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>"
        r"|<noscript\b[^>]*>.*?</noscript[^>]*>|<svg\b[^>]*>.*?</svg[^>]*>|<head\b[^>]*>.*?</head[^>]*>",
        " ",
    )
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    if decode:
        text = decode_entities(text)
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s\x{00A0}]+", " "), r"[^\x{0020}-\x{007E}\x{00A0}-\x{00FF}]", ""))
    cut = text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) >= min_chars, cut)


def is_bot_challenge(
    status: Column | str, server: Column | str, body: Column | str, markers: list[str] = L.CHALLENGE_MARKERS
) -> Column:
    """A 403 or 503 from the CDN, or whose body holds a challenge marker."""
    whole = F.lower(F.coalesce(col(body), F.lit("")))
    seen = F.lower(F.coalesce(col(server), F.lit(""))).contains(L.CHALLENGE_CDN)
    for marker in markers:
        seen = seen | whole.contains(marker)
    return F.coalesce(col(status).isin(403, 503), F.lit(False)) & seen


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute http(s) URL of a link on `base`, without fragment; NULL for other schemes."""
    h = F.trim(F.split_part(href, F.lit("#"), F.lit(1)))
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z]+:)", 1)
    path = F.split_part(F.split_part(base, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    folder = F.regexp_replace(F.when(path == origin, F.concat(path, F.lit("/"))).otherwise(path), r"[^/]*$", "")
    return (
        F.when(h == "", None)
        .when(h.rlike(r"(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(path, h))
        .otherwise(F.concat(folder, h))
    )


def page_links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """All anchors of the pages: keys, base url, position, link, anchor text."""
    anchor = r'(?is)<a\s[^>]*?href\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'
    found = F.transform(F.regexp_extract_all("html", F.lit(anchor), F.lit(0)), lambda m: F.struct(
        F.regexp_extract(m, anchor, 1).alias("href"), F.regexp_extract(m, anchor, 2).alias("label"),
    ))
    # The outer form: Catalyst would repeat the matching in a filter ahead of an inner explode.
    links = pages.select(*keys, "url", F.posexplode_outer(found).alias("position", "a")).filter("a is not null")
    label = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.label"), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return links.select(
        *keys, "url", "position", resolve_link(F.col("url"), F.col("a.href")).alias("link"), label.alias("label")
    )


def people_links(
    pages: DataFrame, keys: list[str], pattern: str = L.PEOPLE_LINKS, limit: int | None = None
) -> DataFrame:
    """Distinct same-site links of a page that promise people: keys, url, link, place."""
    links = page_links(pages, keys)
    path = F.regexp_replace("link", r"^[A-Za-z]+://[^/]*", "")
    bare = lambda u: F.regexp_replace(F.split_part(u, F.lit("#"), F.lit(1)), "/$", "")
    wanted = (
        F.col("link").isNotNull()
        & (host_of("link") == host_of("url"))
        & (bare(F.col("link")) != bare(F.col("url")))
        & F.concat_ws(" ", path, F.col("label")).rlike(pattern)
    )
    first = links.filter(wanted).groupBy(*keys, "url", "link").agg(F.min("position").alias("position"))
    order = Window.partitionBy(*keys, "url").orderBy("position")
    return first.withColumn("place", F.row_number().over(order)).filter(_up_to("place", limit)).drop("position")


def people_probes(
    sites: DataFrame, links: DataFrame, fetched: DataFrame, paths: list[str] = L.PEOPLE_PATHS, limit: int | None = None
) -> DataFrame:
    """Pages worth fetching per site: its people links, then the usual paths, less those fetched.

    `sites`: (company_id, url); `links`: (company_id, link, place); `fetched`: (company_id, url).
    """
    origin = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    usual = sites.select(
        "company_id", F.posexplode(F.array(*[F.concat(origin, F.lit(p)) for p in paths])).alias("place", "probe")
    ).withColumn("place", F.col("place") + 1000)
    linked = links.select("company_id", F.col("place").cast("int").alias("place"), F.col("link").alias("probe"))
    candidates = linked.unionByName(usual).groupBy("company_id", "probe").agg(F.min("place").alias("place"))
    fresh = candidates.join(
        fetched.select("company_id", F.col("url").alias("probe")), ["company_id", "probe"], "left_anti"
    )
    order = Window.partitionBy("company_id").orderBy("place", "probe")
    return fresh.withColumn("place", F.row_number().over(order)).filter(_up_to("place", limit))


def select_people_pages(probed: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages kept per firm: those naming people, and one contact page; else the first readable one.

    `probed`: (company_id, place, url, text). Pages of the same text count once.
    Returns (company_id, place, url, text).
    """
    readable = probed.filter("text is not null").withColumns({
        "bearing": people_bearing("text"),
        "contact": F.lower("url").contains("contact"),
    })
    once = Window.partitionBy("company_id", F.sha2("text", 256)).orderBy("place", "url")
    distinct = readable.withColumn("__copy", F.row_number().over(once)).filter("__copy = 1").drop("__copy")
    kind = (
        F.when(F.col("bearing"), 0).when(F.col("contact"), 1).otherwise(2).alias("kind")
    )
    ranked = distinct.withColumn("kind", kind)
    in_kind = Window.partitionBy("company_id", "kind").orderBy("place", "url")
    short = ranked.withColumn("__n", F.row_number().over(in_kind)).filter(_up_to("__n", limit)).filter(
        (F.col("kind") == 0) | (F.col("__n") == 1)
    )
    any_kept = F.max(F.col("kind") < 2).over(Window.partitionBy("company_id"))
    chosen = short.withColumn("__any", any_kept).filter((F.col("kind") < 2) | ~F.col("__any"))
    first = Window.partitionBy("company_id").orderBy("place", "url")
    return (
        chosen.withColumn("__n", F.row_number().over(first)).filter(_up_to("__n", limit))
        .select("company_id", "place", "url", "text")
    )


# --- Which site is the firm's ----------------------------------------------

def identity_anchor(text: Column, firm: dict[str, Column]) -> Column:
    """Whether a page carries the firm's postcode, registry number, regulator reference or street."""
    body = F.lower(F.coalesce(text, F.lit("")))
    squeezed = F.regexp_replace(body, r"\s+", "")
    squeeze = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    code = squeeze(firm["eircode"])
    number, ref = squeeze(firm["cro_number"]), squeeze(firm["cbi_reference"])
    street = F.lower(F.trim(F.split_part(F.coalesce(firm["registered_address"], F.lit("")), F.lit(","), F.lit(1))))
    return (
        ((F.length(code) == 7) & squeezed.contains(code))
        | ((F.length(number) >= 5) & body.contains(number))
        | ((F.length(ref) >= 5) & body.contains(ref))
        | ((F.length(street) >= 8) & body.contains(street))
    )


ANCHORS = ("eircode", "cro_number", "cbi_reference", "registered_address")


def site_match_score(
    candidates: DataFrame, sector_words: list[str] = L.SECTOR_WORDS, with_text: bool = True, name: str = "site_score"
) -> DataFrame:
    """Add how well a page fits its firm, 0-100.

    `candidates`: url, text, legal_name, trading_name and the anchor columns.
    Only the two string scorers run in Python, on Arrow batches.
    """
    label = domain_label("url")
    names = [clean_firm_name(n) for n in ("legal_name", "trading_name")]
    domain = F.greatest(*[
        F.when(F.coalesce(n, F.lit("")) != "", wratio_udf(label, n)).otherwise(0.0) for n in names
    ])
    usable = (label != "") & (F.greatest(*[F.length(F.coalesce(n, F.lit(""))) for n in names]) > 0)
    if not with_text:
        return candidates.withColumn(name, F.when(usable, F.bround(0.7 * domain)).otherwise(0).cast("int"))
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    body = F.greatest(*[
        F.when((F.coalesce(n, F.lit("")) != "") & (text != ""), partial_ratio_udf(n, text)).otherwise(0.0)
        for n in names
    ])
    base = F.bround(0.7 * domain + 0.3 * body)
    anchored = identity_anchor(text, {a: F.col(a) for a in ANCHORS})
    sector = F.lit(False)
    for word in sector_words:
        sector = sector | text.contains(word)
    score = (
        F.when(anchored, F.greatest(base, F.lit(ANCHOR_FLOOR)))
        .when(~sector, F.least(base, F.lit(OFF_SECTOR_CAP)))
        .otherwise(base)
    )
    return candidates.withColumn(name, F.when(usable, score).otherwise(0).cast("int"))


def guessed_sites(firms: DataFrame, pages: DataFrame) -> DataFrame:
    """The first readable page among the domains that a firm's trading name suggests.

    `firms`: (company_id, trading_name); `pages`: (url, html, ...). Returns the page's columns, its
    text and `guess`, the number of the guess. A trailing slash makes no difference.
    """
    bare = lambda c: F.regexp_replace(c, "/$", "")
    guesses = firms.select("company_id", F.posexplode(domain_guesses("trading_name")).alias("guess", "__at"))
    read = guesses.join(pages.withColumn("__at", bare(F.col("url"))), "__at").withColumn("text", page_text("html"))
    rest = [c for c in read.columns if c not in ("company_id", "__at")]
    first = read.filter("text is not null").groupBy("company_id").agg(
        F.min_by(F.struct(*rest), F.struct("guess", "url")).alias("g"))
    return first.select("company_id", *[f"g.{c}" for c in rest])


def best_site(scored: DataFrame, threshold: int = SITE_SCORE, guessed: DataFrame | None = None) -> DataFrame:
    """Best readable page per firm at or above the threshold; lowest (query, rank) among equals.

    A page of `guessed` (the columns of `scored`) is the firm's site at any score, unless
    a page of `scored` has a higher one.
    """
    rest = [c for c in scored.columns if c != "company_id"]
    fit = scored.filter((F.col("site_score") >= threshold) & F.col("text").isNotNull()).withColumn("__guess", F.lit(0))
    if guessed is not None:
        fit = fit.unionByName(guessed.select(*scored.columns).withColumn("__guess", F.lit(1)))
    order = F.struct(F.col("site_score"), "__guess", -F.col("query_no"), -F.col("rank"))
    return fit.groupBy("company_id").agg(F.max_by(F.struct(*rest), order).alias("b")).select(
        "company_id", *[f"b.{c}" for c in rest]
    )


def _not_social(url: Column) -> Column:
    hit = F.lit(False)
    for marker, _ in L.SOCIAL_HOSTS:
        hit = hit | F.lower(url).contains(marker)
    return ~hit


def cap_candidates(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct non-social result URLs per firm, in (query, rank) order."""
    first = hits.filter(_not_social(F.col("url"))).groupBy("company_id", "url").agg(
        F.min(F.struct("query_no", "rank")).alias("at"), F.min_by("title", F.struct("query_no", "rank")).alias("title")
    )
    order = Window.partitionBy("company_id").orderBy("at", "url")
    return (
        first.withColumn("place", F.row_number().over(order)).filter(_up_to("place", limit))
        .select("company_id", "place", "at.query_no", "at.rank", "title", "url")
    )


def blocked_candidates(candidates: DataFrame, threshold: int = BLOCKED_SCORE, limit: int | None = None) -> DataFrame:
    """URLs per firm that answered with a bot challenge and whose domain fits the firm's name."""
    blocked = candidates.filter(is_bot_challenge("status", "server", "html"))
    fit = site_match_score(blocked, with_text=False).filter(F.col("site_score") >= threshold)
    order = Window.partitionBy("company_id").orderBy("query_no", "rank", "url")
    few = fit.withColumn("__n", F.row_number().over(order)).filter(_up_to("__n", limit))
    return few.groupBy("company_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__n", "url"))), lambda s: s["url"]).alias("blocked")
    )


def social_platform(url: Column) -> Column:
    """Platform of the first social host marker the URL contains."""
    lowered = F.lower(url)
    return F.coalesce(*[F.when(lowered.contains(m), F.lit(p)) for m, p in L.SOCIAL_HOSTS])


def social_matches(hits: DataFrame) -> DataFrame:
    """One URL per firm and platform: the first hit naming the firm.

    `hits` carries legal_name and trading_name of its firm.
    """
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    haystack = squash(F.concat_ws(" ", "url", "title"))
    def named(column: str) -> Column:
        first = squash(F.split_part(F.trim(F.coalesce(F.col(column), F.lit(""))), F.lit(" "), F.lit(1)))
        return (F.length(first) >= 4) & haystack.contains(first)

    return (
        hits.withColumn("platform", social_platform(F.col("url")))
        .filter(F.col("platform").isNotNull() & (named("legal_name") | named("trading_name")))
        .groupBy("company_id", "platform")
        .agg(F.min_by("url", F.struct("query_no", "rank", "url")).alias("url"))
    )


def social_links(hits: DataFrame) -> DataFrame:
    """Map from platform to URL per firm; at most one entry per platform."""
    return social_matches(hits).groupBy("company_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("platform", "url")))).alias("social_links")
    )


def linkedin_hits(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Title and URL of the LinkedIn hits per firm: company_id, place, hit."""
    order = Window.partitionBy("company_id").orderBy("query_no", "rank", "url")
    return (
        hits.filter(F.lower("url").contains("linkedin.com"))
        .withColumn("place", F.row_number().over(order)).filter(_up_to("place", limit))
        .select("company_id", "place", F.concat_ws(" ", "title", "url").alias("hit"))
    )


# --- Queries for the search step -------------------------------------------

def domain_guesses(trading_name: Column | str, tlds: list[str] = L.PLAUSIBLE_TLDS) -> Column:
    """Two URLs when the trading name is itself a domain, else an empty array."""
    name = F.lower(F.trim(F.coalesce(col(trading_name), F.lit(""))))
    suffix = F.coalesce(*[F.when(name.contains(t), F.lit(t)) for t in tlds])
    core = F.regexp_replace(F.split_part(name, suffix, F.lit(1)), "[^a-z0-9-]", "")
    host = F.concat(core, suffix)
    fits = suffix.isNotNull() & (F.size(F.split(name, r"\s+")) <= 2) & (F.length(core) >= 3)
    none = F.array().cast("array<string>")
    return F.when(fits, F.array(F.concat(F.lit("https://www."), host), F.concat(F.lit("https://"), host))).otherwise(none)


def search_queries(limit: int | None = None) -> Column:
    """Ordered search phrases of a company row, those that its fields allow."""
    filled = lambda c: blank_to_null(F.col(c))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    legal, trading = filled("legal_name"), filled("trading_name")
    city = blank_to_null(F.try_element_at(F.split("registered_address", ","), F.lit(-2)))
    tried = F.array(
        F.concat(quoted(trading), F.lit(" insurance broker")),
        F.concat(quoted(legal), F.lit(" insurance")),
        F.concat(quoted(legal), F.lit(" "), filled("cro_number")),
        F.concat(quoted(legal), F.lit(" "), filled("cbi_reference")),
        F.concat(legal, F.lit(" "), filled("county")),
        F.concat(legal, F.lit(" "), city),
        F.get(domain_guesses("trading_name"), 0),
    )
    phrases = F.array_compact(tried)
    return phrases if limit is None else F.slice(phrases, 1, limit)


# --- Site text -------------------------------------------------------------

def site_document(main: DataFrame, extra: DataFrame, main_chars: int | None = None, extra_chars: int | None = None) -> DataFrame:
    """Text of the firm's site: a link line, the main page, then its people pages.

    `main`: (company_id, title, url, text); `extra`: (company_id, place, text).
    """
    parts = extra.groupBy("company_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "text"))),
            lambda p: F.concat(F.lit(f"\n{PAGE_SEPARATOR}\n"), _start(p["text"], extra_chars)),
        ).alias("parts")
    )
    head = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("url"), F.lit(")\n"))
    return main.join(parts, "company_id", "left").select(
        "company_id", "url",
        F.concat(
            head, _start(F.col("text"), main_chars),
            F.array_join(F.coalesce("parts", F.array().cast("array<string>")), ""),
        ).alias("website_text"),
    )


def digital_presence(website_text: Column | str, social: Column | None = None, blocked: Column | None = None) -> Column:
    """What the research says about a firm's web presence."""
    text = col(website_text)
    has_text = F.coalesce(F.trim(text), F.lit("")) != ""
    url = F.regexp_extract(F.coalesce(text, F.lit("")), LINK_LINE, 1)
    linked = has_text & (url != "")
    separators = (F.length(text) - F.length(F.replace(text, F.lit(PAGE_SEPARATOR), F.lit("")))) / len(PAGE_SEPARATOR)
    channel = contact_channel(text)
    blocked = F.array().cast("array<string>") if blocked is None else F.coalesce(blocked, F.array().cast("array<string>"))
    notes = (
        F.when(linked & (channel == "form_only"), "Website reachable, contact form only")
        .when(linked, "Website crawled")
        .when(has_text, None)
        .when(F.size(blocked) > 0, F.concat(
            F.lit("Website could not be read, access blocked: "), F.array_join(blocked, ", ")
        ))
        .otherwise("No verified website")
    )
    return F.struct(
        linked.alias("has_website"),
        F.when(linked, host_of(url)).alias("domain"),
        F.when(has_text, 1 + separators.cast("int")).otherwise(0).alias("pages_crawled"),
        F.when(has_text, channel).otherwise("none").alias("contact_channel"),
        (F.create_map().cast("map<string,string>") if social is None else social).alias("social"),
        notes.alias("notes"),
    )


# --- Contacts --------------------------------------------------------------

TOKEN_LETTERS = 3


def _found_in(text: str, roles: list[str], unicode_names: bool) -> tuple[Column, Column]:
    """Names with their roles, in order of the patterns and of the text, and the addresses in order of appearance."""
    body = F.coalesce(F.col(text), F.lit(""))
    upper, letter = (r"\p{Lu}", r"[\p{L}'’-]") if unicode_names else ("[A-Z]", "[A-Za-z'-]")
    person = rf"({upper}{letter}+(?: {upper}{letter}+){{1,3}})"
    role = "((?i:" + "|".join(roles) + "))"
    # One pass over the text per pattern; groups are read from the short matches.
    found = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    part = lambda m, pattern, n: F.regexp_extract(m, pattern, n)

    def people(pattern: str, name: int, role: int) -> Column:
        return F.transform(found(pattern), lambda m: F.struct(part(m, pattern, name).alias("name"), part(m, pattern, role).alias("role")))

    before = people(rf"{person}\s*[,:–-]\s*{role}\b", 1, 2)
    after = people(rf"\b{role}\s*[,:–-]\s*{person}", 2, 1)
    return F.concat(before, after), F.transform(found(L.EMAIL), lambda e: F.lower(e))


def find_contacts(
    df: DataFrame, keys: list[str], text: str, inboxes: list[str], officers: str | None = None,
    roles: list[str] = L.ROLE_WORDS, unicode_names: bool = False,
) -> DataFrame:
    """The contacts that each site text names: keys, position, name, role, detail, email.

    Emails come first, in order of appearance: an office inbox is a channel, another
    address takes the first name one of whose tokens its local part holds, or its own
    local part in title case. Names without an email follow. Without text the firm's
    officers are the contacts. `keys` are not null and name one row of `df` each.

    Names and addresses are rows. Tokens are an inverted index (row, token) with the first
    name that has one, and a local part looks all its stretches up in it, so the work
    grows with the addresses and the names of a text, not with their product.
    """
    people, emails = _found_in(text, roles, unicode_names)
    listed = F.col(officers) if officers else F.lit(None).cast("array<struct<name:string,role:string>>")
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    # Only what was found goes on; the texts are read once.
    staged = cut(df.select(
        *keys, people.alias("people"), emails.alias("emails"), F.when(empty, listed).alias("officers")))
    first = lambda column, at, item: staged.select(*keys, F.posexplode(column).alias(at, item))
    named = first("people", "at", "p").groupBy(*keys, "p.name").agg(
        F.min("at").alias("at"), F.min_by("p.role", "at").alias("role"))
    mailed = first("emails", "place", "email").groupBy(*keys, "email").agg(F.min("place").alias("place")).withColumn(
        "local", F.substring_index("email", "@", 1))

    index = (
        named.select(*keys, "at", F.explode(F.split(F.lower("name"), " ")).alias("token"))
        .filter(F.length("token") >= TOKEN_LETTERS).groupBy(*keys, "token").agg(F.min("at").alias("at"))
    )
    longest = index.groupBy(*keys).agg(F.max(F.length("token")).alias("longest"))
    starts = F.sequence(F.lit(1), F.length("local") - TOKEN_LETTERS + 1)
    stretch = lambda i: F.transform(
        F.sequence(F.lit(TOKEN_LETTERS), F.least(F.col("longest"), F.length("local") - i + 1)), lambda n: F.substring("local", i, n))
    looked = (
        mailed.filter(F.length("local") >= TOKEN_LETTERS).join(longest, keys)
        .select(*keys, "place", F.explode(F.array_distinct(F.flatten(F.transform(starts, stretch)))).alias("token"))
    )
    owners = looked.join(index, [*keys, "token"]).groupBy(*keys, "place").agg(F.min("at").alias("at"))

    who = mailed.join(owners, [*keys, "place"], "left").join(named, [*keys, "at"], "left")
    generic = is_generic_inbox("email", inboxes)
    guess = F.initcap(F.regexp_replace("local", "[._-]+", " "))
    contact = lambda name, role, detail, email: F.struct(
        name.alias("name"), role.alias("role"), detail.alias("detail"), email.alias("email"))
    none = F.lit(None).cast("string")
    by_mail = who.select(*keys, F.lit(0).alias("part"), F.col("place").alias("at"), contact(
        F.when(generic, "General enquiries").otherwise(F.coalesce("name", guess)),
        F.when(generic, "Office inbox").otherwise(F.col("role")),
        F.when(generic, "channel").when(F.col("name").isNotNull(), "person").otherwise("inferred"), F.col("email")).alias("c"))
    taken = by_mail.select(*keys, F.col("c.name").alias("name")).distinct()
    by_name = named.join(taken, [*keys, "name"], "left_anti").select(
        *keys, F.lit(1).alias("part"), "at", contact(F.col("name"), F.col("role"), F.lit("person"), none).alias("c"))
    by_office = staged.select(*keys, F.posexplode("officers").alias("at", "o")).select(
        *keys, F.lit(1).alias("part"), "at", contact(F.col("o.name"), F.col("o.role"), F.lit("officer"), none).alias("c"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "at")) - 1
    return by_mail.unionByName(by_name).unionByName(by_office).select(*keys, place.alias("position"), "c.*")


def extract_contacts(
    df: DataFrame, text: str, inboxes: list[str], officers: str | None = None, roles: list[str] = L.ROLE_WORDS,
    unicode_names: bool = False, name: str = "contacts", keys: list[str] | None = None,
) -> DataFrame:
    """`find_contacts` as a column, array<struct<name,role,detail,email>>.

    Without `keys` the rows are numbered and written to the checkpoint folder first.
    """
    own = keys or ["__row"]
    if not keys:
        df = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    rows = find_contacts(df, own, text, inboxes, officers, roles, unicode_names)
    gathered = rows.groupBy(*own).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", F.struct("name", "role", "detail", "email").alias("c")))), lambda x: x["c"]).alias("__contacts"))
    kind = gathered.schema["__contacts"].dataType
    joined = df.join(gathered, own, "left").withColumn(name, F.coalesce("__contacts", F.array().cast(kind)))
    return joined.drop("__contacts", "__row")


def contact_rows(df: DataFrame, keys: list[str], contacts: str = "contacts") -> DataFrame:
    """One row per contact: keys, position, and the contact's fields."""
    rows = df.select(*keys, F.posexplode_outer(contacts).alias("position", "c")).filter("c is not null")
    return rows.select(*keys, "position", "c.*")


def sanitise_contacts(contacts: DataFrame, junk: list[str], inboxes: list[str]) -> DataFrame:
    """Classify contact rows (company_id, position, name, email): kept, relabelled or dropped.

    Plausible people stay, one per lower-cased name. Other names with an office
    inbox become that inbox, one per address. The rest is dropped with a
    reason. Adds name_out, verdict and reason.
    """
    plausible = is_plausible_person("name", junk)
    generic = is_generic_inbox("email", inboxes)
    kind = F.when(plausible, "person").when(generic, "inbox").otherwise("dropped")
    identity = (
        F.when(plausible, F.lower(F.trim("name"))).when(generic, F.lower(F.trim("email")))
        .otherwise(F.concat(F.lit("#"), F.col("position").cast("string")))
    )
    marked = contacts.withColumns({"kind": kind, "identity": identity})
    # The first of its identity, by an aggregate: a firm's contacts never gather in one task.
    first = marked.groupBy("company_id", "kind", "identity").agg(F.min("position").alias("first_position"))
    joined = marked.join(first, ["company_id", "kind", "identity"])
    repeated = (F.col("kind") != "dropped") & (F.col("position") != F.col("first_position"))
    return joined.withColumns({
        "verdict": F.when((F.col("kind") == "dropped") | repeated, "dropped")
        .when(F.col("kind") == "inbox", "relabelled").otherwise("kept"),
        "reason": F.when(F.col("kind") == "dropped", "not a plausible person").when(repeated, "duplicate"),
        "name_out": F.when(F.col("kind") == "inbox", "General enquiries").otherwise(F.col("name")),
    }).drop("first_position", "identity", "kind")


# --- Research summary ------------------------------------------------------

def research_coverage(presence: Column, contacts: Column) -> Column:
    """Facts established and facts missing, in a fixed order."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    site = F.coalesce(presence["has_website"], F.lit(False))
    found = F.coalesce(F.size(contacts), F.lit(0)) > 0
    channel = F.coalesce(presence["contact_channel"], F.lit("none"))
    normal = F.lower(F.coalesce(F.trim("cro_status"), F.lit(""))) == "normal"
    facts = [
        (text("cro_number"), F.concat(F.lit("Registry number "), F.col("cro_number")), "Registry number"),
        (normal, F.lit("Active on the registry"), "Active registry status"),
        (text("cbi_reference"), F.concat(F.lit("Regulator reference "), F.col("cbi_reference")), "Regulator reference"),
        (text("incorporation_date"), F.concat(F.lit("Incorporated "), display_date("incorporation_date")), "Incorporation date"),
        (text("last_annual_return"), F.concat(F.lit("Annual return "), display_date("last_annual_return")), "Annual return"),
        (site, F.concat(F.lit("Website "), F.coalesce(presence["domain"], F.lit(""))), "Verified website"),
        (channel.isin("email", "phone"), F.concat(F.lit("Contact by "), channel), "Direct contact channel"),
        (found, F.concat(F.size(contacts).cast("string"), F.lit(" contacts")), "Named contacts"),
    ]
    return F.struct(
        F.array_compact(F.array(*[F.when(test, label) for test, label, _ in facts])).alias("verified"),
        F.array_compact(F.array(*[F.when(~test, F.lit(gap)) for test, _, gap in facts])).alias("missing"),
    )


def research_confidence(presence: Column, website_text: Column, authorisations: Column | None = None) -> Column:
    """Confidence in the research, 20-100."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    text = F.coalesce(website_text, F.lit(""))
    role = r"(?i)(" + "|".join(L.ROLE_WORDS) + ")"
    listed = F.lit(0) if authorisations is None else F.coalesce(F.size(authorisations), F.lit(0))
    total = (
        F.lit(20)
        + points(filled(F.col("cro_number")), 10)
        + points(F.lower(F.trim("cro_status")) == "normal", 5)
        + points(filled(F.col("cbi_reference")), 15)
        + F.least(5 * F.greatest(listed, F.lit(0)), F.lit(15))
        + points(F.trim(text) != "", 25)
        + points(presence["domain"].isNotNull(), 5)
        + points(text.rlike(role), 10)
        + points(text.rlike(L.EMAIL), 5)
        + points(filled(F.col("last_annual_return")), 5)
        + points(filled(F.col("incorporation_date")), 5)
    )
    return F.least(F.lit(100), total).cast("int")


def sources_reviewed(
    domain: Column, hits: Column, registries: list[str] = L.REGISTRY_SOURCES, title_chars: int | None = None
) -> Column:
    """Source labels: both registries, the website, then one per search hit struct<title,url>."""
    def label(hit: Column) -> Column:
        host = host_of(hit["url"])
        url = F.nullif(F.coalesce(hit["url"], F.lit("")), F.lit(""))
        title = _start(hit["title"], title_chars)
        return F.concat(F.lit("search:"), F.coalesce(F.nullif(host, F.lit("")), url, title, F.lit("")))

    none = F.array().cast("array<string>")
    site = F.when(domain.isNotNull(), F.array(F.concat(F.lit("website:"), domain))).otherwise(none)
    found = F.when(hits.isNotNull(), F.transform(hits, label)).otherwise(none)
    return F.concat(F.array(*[F.lit(r) for r in registries]), site, found)


def reconcile_presence(
    presence: Column, summary: Column, avoid: Column, maturity_reason: Column, pattern: str = L.RECONCILE_MISMATCH
) -> Column:
    """Presence corrected to "no website" when the assessment says the site is not the firm's."""
    said = F.concat_ws(" ", summary, avoid, maturity_reason)
    wrong = said.rlike(pattern) & F.coalesce(presence["has_website"], F.lit(False))
    return presence.withField(
        "has_website", F.when(wrong, F.lit(False)).otherwise(presence["has_website"])
    ).withField(
        "domain", F.when(~wrong, presence["domain"])
    ).withField(
        "notes", F.when(wrong, "Website found does not appear to be the firm's").otherwise(presence["notes"])
    )


def evidence_context(
    website_text: Column, search_results: Column, linkedin: Column, blocked: Column, authorisations: Column | None = None,
    site_chars: int | None = None, hits: int | None = None,
) -> Column:
    """Text block per firm for the assessment step: register facts, site, search, LinkedIn."""
    line = lambda label, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    listed = None
    if authorisations is not None:
        listed = F.when(F.size(authorisations) > 0, F.concat(
            F.lit("Authorisations: "), F.array_join(F.transform(authorisations, lambda a: describe_authorisation(a)), "; ")
        ))
    site = F.coalesce(F.trim(website_text), F.lit(""))
    body = (
        F.when(site != "", F.concat(F.lit("Website:\n"), _start(site, site_chars)))
        .when(F.size(blocked) > 0, F.concat(F.lit("Website: exists but blocked automated reading ("), F.array_join(blocked, ", "), F.lit(")")))
        .otherwise("Website: none verified")
    )
    bullets = lambda items: F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")
    results = F.when(F.size(search_results) > 0, F.concat(
        F.lit("Search results:\n"), bullets(search_results if hits is None else F.slice(search_results, 1, hits))
    ))
    profiles = F.when(F.size(linkedin) > 0, F.concat(F.lit("LinkedIn:\n"), bullets(linkedin)))
    parts = [
        line("Legal name", F.col("legal_name")), line("Trading name", F.col("trading_name")),
        line("Registry number", F.col("cro_number")), line("Registry status", F.col("cro_status")),
        line("Regulator reference", F.col("cbi_reference")), line("County", F.col("county")),
        line("Incorporated", display_date("incorporation_date")),
    ]
    if listed is not None:
        parts.append(listed)
    return F.concat_ws("\n", *parts, body, results, profiles)


def outreach_inputs(
    contacts: Column, narrative: Column, verified: Column, best: Column, summary_chars: int | None = None
) -> Column:
    """Inputs of the email step: recipient, context, lists, grounding text.

    `narrative` is a struct of text and array fields; `reference_points` falls
    back to the older key `reference`.
    """
    fields = narrative
    points = F.coalesce(fields["reference_points"], fields["reference"], F.array().cast("array<string>"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    summary = _start(F.coalesce(fields["executive_summary"], F.lit("")), summary_chars)
    recipient = F.when(best.isNotNull(), F.concat_ws(", ", best["name"], best["role"])).otherwise("the team")
    context = F.concat_ws(
        "\n",
        F.concat(F.lit("To: "), recipient),
        F.concat(F.lit("Firm: "), F.col("legal_name")),
        F.concat(F.lit("Angle: "), fields["recommended_angle"]),
        F.when(summary != "", F.concat(F.lit("Summary: "), summary)),
    )
    return F.struct(
        recipient.alias("recipient"), F.coalesce(F.size(contacts), F.lit(0)).alias("contact_count"),
        context.alias("context"), points.alias("reference_points"),
        listed(fields["avoid"]).alias("avoid"), listed(fields["discovery"]).alias("discovery"),
        listed(verified).alias("verified_facts"), summary.alias("summary"),
        F.concat_ws(" ", F.col("legal_name"), summary, F.array_join(points, " "), F.array_join(listed(verified), " ")).alias("grounding"),
    )
