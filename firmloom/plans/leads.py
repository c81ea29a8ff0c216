"""The lead list as one plan: joins, filters, order, page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from firmloom.operators.leads import bracket_filter, lead_filter, lead_list, lead_search, lead_sort, page, status_filter


def lead_query(
    companies: DataFrame, enrichment: DataFrame, emails: DataFrame, rejections: DataFrame,
    *, county: str | None = None, min_score: int | None = None, max_score: int | None = None,
    registry_status: str | None = None, search: str | None = None, status: str | None = None,
    bracket: str | None = None, sort: str = "score", direction: str = "desc", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of leads. Everything stays in one plan, so filters reach the scans."""
    leads = lead_filter(
        lead_list(companies, enrichment, emails, rejections), county, min_score, max_score, registry_status
    )
    if search:
        leads = leads.filter(lead_search(search))
    if status:
        leads = leads.filter(status_filter(status))
    if bracket:
        leads = leads.filter(bracket_filter(bracket))
    return page(leads, lead_sort(sort, direction, strict=True), limit, offset)
