"""Firms, search hits and crawled pages to research features, one row per firm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmloom.operators import evidence as W


def research(companies: DataFrame, hits: DataFrame, pages: DataFrame, inboxes: list[str]) -> DataFrame:
    """Site, presence, contacts, coverage, confidence and sources of every firm.

    Only pages that some firm's results or its trading name point to are parsed.
    """
    firms = companies.withColumnRenamed("id", "company_id")
    anchors = firms.select("company_id", "legal_name", "trading_name", *W.ANCHORS)
    candidates = W.cap_candidates(hits)
    served = candidates.join(pages, "url").join(anchors, "company_id").withColumn("text", W.page_text("html"))
    guesses = W.guessed_sites(firms.select("company_id", "trading_name"), pages).join(anchors, "company_id").withColumns({
        "place": F.lit(0), "query_no": F.lit(-1), "rank": F.col("guess"), "title": F.lit(None).cast("string")})
    site = W.best_site(W.site_match_score(served), guessed=W.site_match_score(guesses))
    blocked = W.blocked_candidates(served)

    links = W.people_links(
        site.select("company_id", "url").join(pages.select("url", "html"), "url"), ["company_id"]
    )
    probes = W.people_probes(site.select("company_id", "url"), links, site.select("company_id", "url"))
    probed = probes.withColumnRenamed("probe", "url").join(pages.select("url", "html"), "url").withColumn(
        "text", W.page_text("html")
    )
    document = W.site_document(site, W.select_people_pages(probed))

    named = hits.join(firms.select("company_id", "legal_name", "trading_name"), "company_id")
    hit_list = candidates.groupBy("company_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "title", "url"))),
                    lambda h: F.struct(h["title"].alias("title"), h["url"].alias("url"))).alias("hits")
    )
    rows = (
        firms.join(document.select("company_id", "website_text"), "company_id", "left")
        .join(blocked, "company_id", "left").join(W.social_links(named), "company_id", "left")
        .join(hit_list, "company_id", "left")
    )
    rows = rows.withColumn("presence", W.digital_presence("website_text", F.col("social_links"), F.col("blocked")))
    rows = W.extract_contacts(rows, "website_text", inboxes, keys=["company_id"])
    return rows.withColumns({
        "coverage": W.research_coverage(F.col("presence"), F.col("contacts")),
        "research_confidence": W.research_confidence(F.col("presence"), F.col("website_text")),
        "sources_reviewed": W.sources_reviewed(F.col("presence.domain"), F.col("hits")),
    })
