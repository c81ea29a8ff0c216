import datetime

import pytest
from pyspark.sql import functions as F

from firmloom.functions import documents as D
from firmloom.functions import people as P
from firmloom.functions import text as X

lit = F.lit


def test_address_parts(value):
    address = lit("12 Main St,  Mullingar, Co. Westmeath, n37 ac12")
    assert value(X.county(address), X.eircode(address)) == ("Westmeath", "N37 AC12")
    # Earliest position first; substrings count.
    assert value(X.county(lit("Downing Road, Cork"))) == "Down"
    assert value(X.county(lit("nowhere")), X.eircode(lit("W12 AC12"))) == (None, None)


def test_names(value):
    assert value(X.squash_ws(lit("  Acme   Ltd "))) == "Acme Ltd"
    assert value(X.squash_ws(lit("   "))) is None
    assert value(X.fold_legal_name(lit("Acme  Insurance Limited"))) == "ACME INSURANCE"
    assert value(X.fold_legal_name(lit("Acme Ltd."))) == "ACME ."
    assert value(X.fold_legal_name(lit("Limited"))) == ""
    assert value(X.fold_id(lit("65-43 21a"))) == "654321A"
    assert value(X.clean_firm_name(lit("O'Brien Insurance Brokers Ltd"))) == "obrien"


def test_dates(value):
    assert value(X.parse_register_date(lit("3 March 2020"))) == "2020-03-03"
    assert value(X.parse_register_date(lit("soon"))) == "soon"
    assert value(X.display_date(lit("2020-03-05"))) == "5 Mar 2020"
    assert value(X.display_date(lit("n.d."))) == "n.d."
    as_of = lit(datetime.date(2026, 1, 1))
    assert value(X.years_operating(lit("2001-05-06"), as_of), X.years_operating(lit("2030-01-01"), as_of),
                 X.years_operating(lit("x"), as_of)) == (25, None, None)


def test_scores(value):
    assert [value(X.tier(lit(s))) for s in (70, 69, 40, 39, None)] == ["high", "medium", "medium", "low", "low"]
    assert value(X.dimension_pct(lit("high"), lit(None)), X.dimension_pct(lit("x"), lit(33))) == (90.0, 33.0)
    assert value(X.dimension_bar(lit(0.4)), X.dimension_bar(lit(140.0))) == (2, 100)
    assert value(X.describe_authorisation(lit("An INSURANCE undertaking"))) == "Insurance distributor"


@pytest.mark.parametrize("text, channel", [
    ("Mail us: a.b@firm.ie or 01 234 5678", "email"), ("Ring 01 234 5678", "phone"),
    ("Use our contact form", "form_only"), ("Hello", "none"), (None, "none"),
])
def test_contact_channel(value, text, channel):
    assert value(P.contact_channel(lit(text).cast("string"))) == channel


def test_people(value):
    inbox = lambda e: value(P.is_generic_inbox(lit(e), ["info", "customerservice"]))
    assert inbox("In.Fo@firm.ie") and inbox("customer-service@firm.ie")
    assert not inbox("mary@firm.ie") and not inbox("info")
    person = lambda n: value(P.is_plausible_person(lit(n), ["about", "us", "our", "team", "insurance"]))
    assert person("Mary O'Brien") and person("Seán Ó Briain-Walsh") is False and person("Seán MacBriain-Walsh")
    for junk in ("Mary", "About Us", "mary byrne", "Our Team", "Acme Insurance", "A B C D E F", ""):
        assert not person(junk), junk


DOC = '{"summary": "text {with} braces", "n": 1}'


@pytest.mark.parametrize("response, expected", [
    (DOC, DOC),
    ("Here:\n```json\n" + '{"a": "b"}' + "\n```\nbye", '{"a": "b"}'),
    ('Template {"a": "..."} then {"a": "real"} end', '{"a": "real"}'),
    ('Says {"a": {"b": "deep"}} done', '{"b": "deep"}'),
    ('{"a": null, "b": " "}', None), ("no json", None), (None, None), ("{broken", None),
])
def test_salvage_json(value, response, expected):
    assert value(D.salvage_json(lit(response).cast("string"))) == expected


def test_required_keys(value):
    has = lambda doc, *a, **k: value(D.has_required(lit(doc), *a, **k))
    assert has('{"a": "x", "b": "y"}', ["a", "b"])
    assert not has('{"a": " "}', ["a"]) and not has('{"a": 3}', ["a"]) and not has("nope", ["a"])
    # A list never satisfies the string rule; asking for a list does.
    assert not has('{"contacts": [{"n": 1}]}', ["contacts"])
    assert has('{"contacts": [{"n": 1}]}', ["contacts"], kind="array")


def test_hoist(value):
    doc = '{"executive_summary": "", "avoid": [], "discovery": ["d"], "contacts": [{"executive_summary": "s", "avoid": ["x"], "discovery": ["n"]}]}'
    got = value(D.hoist_misplaced(lit(doc)))
    assert (got.executive_summary, got.avoid, got.discovery, got.recommended_angle) == ("s", '["x"]', '["d"]', None)


def test_lenient_json(value):
    default = F.array().cast("array<string>")
    assert value(D.parse_json_column(lit("[\"a\"]"), "array<string>", default)) == ["a"]
    assert value(D.parse_json_column(lit("[oops"), "array<string>", default)) == []
