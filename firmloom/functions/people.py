"""Contact channels, inboxes and personal names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmloom import lexicons as L
from firmloom.functions.text import col

NAME_PUNCTUATION = "'’.-"


def contact_channel(text: Column | str) -> Column:
    """Best contact channel a page text offers."""
    t = F.coalesce(col(text), F.lit(""))
    return (
        F.when(t.rlike(L.EMAIL), "email")
        .when(t.rlike(L.PHONE), "phone")
        .when(t.rlike(L.FORM_WORDS), "form_only")
        .otherwise("none")
    )


def is_generic_inbox(email: Column | str, inboxes: list[str]) -> Column:
    """Whether the local part, without dots, underscores and hyphens, names an office inbox."""
    local = F.translate(F.lower(F.substring_index(F.trim(col(email)), "@", 1)), "._-", "")
    return F.coalesce(col(email).contains("@") & local.isin(inboxes), F.lit(False))


def is_plausible_person(name: Column | str, junk: list[str]) -> Column:
    """Two to five name-like tokens, none of them a word that only pages use."""
    tokens = F.split(F.trim(F.regexp_replace(col(name), r"\s+", " ")), " ")
    bare = lambda t: F.lower(F.translate(t, NAME_PUNCTUATION, ""))
    shaped = F.forall(tokens, lambda t: t.rlike(r"^\p{Lu}[\p{L}'’.-]+$"))
    clean = F.forall(tokens, lambda t: ~bare(t).isin(junk))
    return F.coalesce(F.size(tokens).between(2, 5) & shaped & clean, F.lit(False))


def people_bearing(text: Column | str, roles: list[str] = L.ROLE_WORDS) -> Column:
    """Whether a page names a role, an email address or a phone number."""
    t = col(text)
    role = r"(?i)\b(" + "|".join(roles) + r")s?\b"
    return F.coalesce(t.rlike(role) | t.rlike(L.EMAIL) | t.rlike(L.PHONE), F.lit(False))
