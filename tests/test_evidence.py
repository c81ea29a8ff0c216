import pytest
from pyspark.sql import functions as F

from firmloom import lexicons as L
from firmloom.operators import evidence as W

lit = F.lit
BROKER = "Acme Cover arranges insurance for firms and families. Our brokers answer the phone every working day. " * 2


def missing():
    return F.lit(None).cast("string")


PAGE = "company_id string, query_no int, rank int, url string, text string, legal_name string, trading_name string, eircode string, cro_number string, cbi_reference string, registered_address string"


def scored(spark, *rows):
    data = [("c", 0, i, url, text, "Acme Cover Insurance Brokers Ltd", None, "N37 AC12", "654321", "C98765", "12 Mainly Street, Cork")
            for i, (url, text) in enumerate(rows)]
    return W.site_match_score(spark.createDataFrame(data, PAGE))


def test_site_score_gates(spark):
    rows = {r.url: r.site_score for r in scored(
        spark, ("https://www.acmecover.ie/", BROKER), ("https://acmecover.com/", "Wedding photography by Acme Cover in Galway. " * 4),
        ("https://zzqq.ie/", "Find us at n37ac12. " + "Cheese and wine. " * 9), ("https://zzqq.com/", None)).collect()}
    assert rows["https://www.acmecover.ie/"] >= 70
    assert rows["https://acmecover.com/"] < 30
    assert rows["https://zzqq.ie/"] >= 70
    assert rows["https://zzqq.com/"] < 30


def test_best_site(spark):
    pages = scored(spark, ("https://acmecover.ie/b", BROKER), ("https://acmecover.ie/a", BROKER), ("https://x.ie/", "nothing " * 20))
    assert [r.url for r in W.best_site(pages).collect()] == ["https://acmecover.ie/b"]
    assert W.best_site(scored(spark, ("https://zz.ie/", "nothing here " * 20))).count() == 0
    # A page that could not be read never wins, however well its domain fits.
    assert W.best_site(scored(spark, ("https://acmecoverinsurancebrokers.ie/", None))).count() == 0


@pytest.mark.parametrize("status, server, body, expected", [
    (403, "cloudflare", "", True), (503, "nginx", "x Just a moment... y", True), (404, "cloudflare", "", False),
    (200, "cloudflare", "just a moment", False), (403, "nginx", "forbidden", False), (None, None, None, False),
])
def test_bot_challenge(value, status, server, body, expected):
    assert value(W.is_bot_challenge(lit(status).cast("int"), lit(server).cast("string"), lit(body).cast("string"))) is expected


def test_page_text(value):
    body = "<p>Caf&eacute; &amp;  tea   " + "words " * 30 + "</p>"
    html = f"<head><title>t</title></head><script>x</script>{body}<svg>a<b></svg>"
    text = value(W.page_text(lit(html)))
    assert text.startswith("Café & tea words") and "<" not in text and not text.endswith("...")
    assert value(W.page_text(lit("<p>short</p>"))) == "short" and value(W.page_text(lit("<p> </p>"))) is None
    assert value(W.page_text(lit("<p>short</p>"), min_chars=101)) is None
    assert len(value(W.page_text(lit("a " * 9000)))) == 17999 and len(value(W.page_text(lit("a " * 9000), 8000))) == 8003
    entities = "&lt;b&gt; &#233;&#xE9;&Eacute; &apos;&quot;&#39; a&nbsp;b &rsquo;&#8217;&#x2019; &bogus; &amp;amp; & &; &#0;&#9999999;x"
    assert value(W.page_text(lit(entities))) == "<b> ééÉ '\"' a b &bogus; &amp; & &; x".replace("b  &", "b &")


def test_people_links(spark):
    anchors = "".join(f'<a class="n" href="{h}">{t}</a>' for h, t in [
        ("/about-us#top", "x"), ("team", "<b>Meet</b> us"), ("/news", "News"), ("https://other.ie/team", "Team"), ("mailto:a@b.ie", "contact"),
        ("/", "about"), ("http://acme.ie/staff", "s"), ("/about-us", "again"), ("/p1", "People"), ("/p2", "people"), ("/p3", "people"), ("/p4", "people")])
    pages = spark.createDataFrame([("c", "http://www.acme.ie/", anchors)], "company_id string, url string, html string")
    links = lambda **k: [r.link for r in W.people_links(pages, ["company_id"], **k).orderBy("place").collect()]
    base = "http://www.acme.ie"
    expected = [f"{base}/about-us", f"{base}/team", "http://acme.ie/staff", f"{base}/p1", f"{base}/p2", f"{base}/p3", f"{base}/p4"]
    assert links() == expected and links(limit=6) == expected[:6]


def test_probes_and_people_pages(spark):
    sites = spark.createDataFrame([("c", "http://a.ie/x?y")], "company_id string, url string")
    links = spark.createDataFrame([("c", 1, "http://a.ie/who"), ("c", 2, "http://a.ie/team")], "company_id string, place int, link string")
    fetched = spark.createDataFrame([("c", "http://a.ie/about")], "company_id string, url string")
    probes = [r.probe for r in W.people_probes(sites, links, fetched, limit=14).orderBy("place").collect()]
    assert W.people_probes(sites, links, fetched).count() == len(L.PEOPLE_PATHS)
    assert probes[:3] == ["http://a.ie/who", "http://a.ie/team", "http://a.ie/about-us"] and len(probes) == 14
    assert "http://a.ie/about" not in probes

    def kept(*pages, limit=3):
        rows = spark.createDataFrame([("c", i, u, t) for i, (u, t) in enumerate(pages)], "company_id string, place int, url string, text string")
        return [r.url for r in W.select_people_pages(rows, limit).orderBy("place").collect()]

    team = "Mary Byrne, Director. "
    assert kept(("/news", "plain"), ("/team", team), ("/contact", "where to find us"), ("/contact2", "other words"), ("/team2", team)) == ["/team", "/contact"]
    assert kept(("/x", None), ("/a", "plain a"), ("/b", "plain b")) == ["/a"]
    assert kept(*[(f"/t{i}", f"{i} {team}") for i in range(5)]) == ["/t0", "/t1", "/t2"]
    assert kept(*[(f"/t{i}", f"{i} {team}") for i in range(5)], limit=None) == [f"/t{i}" for i in range(5)]
    banner = "one banner for all pages " * 20
    assert kept(("/t0", f"{banner} Ann, Director"), ("/t1", f"{banner} Bob, Director")) == ["/t0", "/t1"]


HITS = "company_id string, query_no int, rank int, title string, url string, legal_name string, trading_name string"


def hits(spark, *rows):
    return spark.createDataFrame([("c", 0, i, t, u, "Acme Cover Ltd", None) for i, (t, u) in enumerate(rows)], HITS)


def test_social_and_linkedin(spark):
    found = hits(spark, ("Acme Cover", "https://facebook.com/acmecover"), ("Cafe", "https://facebook.com/cafe"), ("Acme", "https://ie.linkedin.com/company/acme"),
                 ("Acme two", "https://www.facebook.com/acme2"), ("Acme", "https://x.com/acme"))
    assert W.social_links(found).first().social_links == {
        "facebook": "https://facebook.com/acmecover", "linkedin": "https://ie.linkedin.com/company/acme", "twitter": "https://x.com/acme"}
    assert [r.hit for r in W.linkedin_hits(found).collect()] == ["Acme https://ie.linkedin.com/company/acme"]


def test_candidates_are_capped(spark):
    rows = [(f"t{i}", f"https://a.ie/{i % 20}") for i in range(30)] + [("s", "https://facebook.com/a"), ("box", "https://netbox.com/")]
    got = lambda **k: [r.url for r in W.cap_candidates(hits(spark, *rows), **k).orderBy("place").collect()]
    # "x.com" matches any URL holding those letters.
    assert got() == [f"https://a.ie/{i}" for i in range(20)] and got(limit=15) == got()[:15]


def test_blocked_candidates(spark):
    rows = [("c", 0, i, u, "", "Acme Cover Ltd", None, None, None, None, None) for i, u in enumerate(["https://acmecover.ie/", "https://zzqq.ie/"])]
    pages = spark.createDataFrame(rows, PAGE).withColumns({"status": lit(403), "server": lit("cloudflare"), "html": lit("")})
    assert W.blocked_candidates(pages).first().blocked == ["https://acmecover.ie/"]


def test_queries_and_domain_guesses(spark, value):
    firm = spark.createDataFrame([("Acme Ltd", " ", "77", None, "Cork", "1 Main St, Fermoy, Cork")],
                                 "legal_name string, trading_name string, cro_number string, cbi_reference string, county string, registered_address string")
    assert firm.select(W.search_queries()).first()[0] == ['"Acme Ltd" insurance', '"Acme Ltd" 77', "Acme Ltd Cork", "Acme Ltd Fermoy"]
    assert value(W.domain_guesses(lit("Quote.ie"))) == ["https://www.quote.ie", "https://quote.ie"]
    assert value(W.domain_guesses(lit("my quote site.ie"))) == [] and value(W.domain_guesses(lit("ab.ie"))) == []


def test_document_and_presence(spark, value):
    main = spark.createDataFrame([("c", "T", "https://www.acme.ie/x", "m" * 6000)], "company_id string, title string, url string, text string")
    extra = spark.createDataFrame([("c", 2, "second"), ("c", 1, "f" * 5000)], "company_id string, place int, text string")
    text = W.site_document(main, extra).first().website_text
    assert text.startswith("[T](https://www.acme.ie/x)\nmmm") and text.endswith("second") and len(text) > 9000
    p = value(W.digital_presence(lit(text + " a@b.ie")))
    assert (p.has_website, p.domain, p.pages_crawled, p.contact_channel, p.notes) == (True, "acme.ie", 3, "email", "Website crawled")
    absent = value(W.digital_presence(missing()))
    assert (absent.has_website, absent.domain, absent.pages_crawled, absent.notes) == (False, None, 0, "No verified website")
    blocked = value(W.digital_presence(missing(), blocked=F.array(lit("acme.ie"))))
    assert "acme.ie" in blocked.notes and "No verified" not in blocked.notes
    assert value(W.digital_presence(lit("[T](https://a.ie)\nget in touch"))).notes == "Website reachable, contact form only"


def contacts_of(spark, text, officers=None):
    df = spark.createDataFrame([(text, officers)], "text string, officers array<struct<name:string,role:string>>")
    return [(c.name, c.role, c.email) for c in W.extract_contacts(df, "text", ["info"], "officers").first().contacts]


def test_extract_contacts(spark):
    text = "Our team: Mary Byrne, Managing Director. Director: Sean Walsh. Write to info@a.ie, m.byrne@a.ie or pat_kelly@a.ie. info@a.ie"
    assert contacts_of(spark, text) == [
        ("General enquiries", "Office inbox", "info@a.ie"), ("Mary Byrne", "Managing Director", "m.byrne@a.ie"),
        ("Pat Kelly", None, "pat_kelly@a.ie"), ("Sean Walsh", "Director", None)]
    assert contacts_of(spark, None, [("Ann Lee", "Secretary")]) == [("Ann Lee", "Secretary", None)]
    assert contacts_of(spark, "plain", [("Ann Lee", "Secretary")]) == []


def test_contacts_of_a_long_list(spark):
    """Ten thousand names and addresses in one text: each address finds its name."""
    name = lambda i: "Ann " + "".join(chr(97 + int(d)) for d in f"{i:05d}").capitalize() + "x"
    lines = [f"{name(i)}, Director. {name(i).split()[1].lower()}.{i}@firm.ie" for i in range(10_000)]
    lines += ["Bo Walsh: Partner", "Partner: Cy Walsh", "j.walsh@firm.ie", "JO@firm.ie", "Sales@firm.ie", "sales@firm.ie"]
    df = spark.createDataFrame([("a", "\n".join(lines)), ("b", "Bo Walsh, Owner"), ("c", None)], "id string, text string")
    rows = W.find_contacts(df, ["id"], "text", ["sales"]).collect()
    found = {(r.id, r.email or r.name): (r.position, r.name, r.role, r.detail) for r in rows}
    assert all(found["a", line.split()[-1]] == (i, name(i), "Director", "person") for i, line in enumerate(lines[:10_000]))
    assert [found["a", e] for e in ("j.walsh@firm.ie", "jo@firm.ie", "sales@firm.ie", "Cy Walsh")] == [
        (10_000, "Bo Walsh", "Partner", "person"), (10_001, "Jo", None, "inferred"),
        (10_002, "General enquiries", "Office inbox", "channel"), (10_003, "Cy Walsh", "Partner", "person")]
    assert found["b", "Bo Walsh"] == (0, "Bo Walsh", "Owner", "person") and len(rows) == 10_005


def test_sanitise_contacts(spark):
    rows = [("c", 0, "Mary Byrne", "m@a.ie"), ("c", 1, "Our Team", "info@a.ie"), ("c", 2, "Read More", None), ("c", 3, "mary byrne", "x@a.ie"), ("c", 4, "Mary Byrne", None)]
    got = W.sanitise_contacts(spark.createDataFrame(rows, "company_id string, position int, name string, email string"), ["our", "team", "read", "more"], ["info"])
    assert [(r.name_out, r.verdict, r.reason) for r in got.orderBy("position").collect()] == [
        ("Mary Byrne", "kept", None), ("General enquiries", "relabelled", None), ("Read More", "dropped", "not a plausible person"),
        ("mary byrne", "dropped", "not a plausible person"), ("Mary Byrne", "dropped", "duplicate")]


def test_coverage_confidence_sources(spark):
    firm = spark.createDataFrame([("77", "Normal", "C1", "2001-02-03", None)],
                                 "cro_number string, cro_status string, cbi_reference string, incorporation_date string, last_annual_return string")
    p = W.digital_presence(lit("[T](https://a.ie)\nMary Byrne, Director m@a.ie"))
    c = firm.select(W.research_coverage(p, F.array(lit("x"))).alias("c")).first().c
    assert c.verified == ["Registry number 77", "Active on the registry", "Regulator reference C1", "Incorporated 3 Feb 2001",
                          "Website a.ie", "Contact by email", "1 contacts"] and c.missing == ["Annual return"]
    full = firm.select(W.research_confidence(p, lit("[T](https://a.ie)\nDirector m@a.ie"), F.array(lit("a"), lit("b"), lit("c"), lit("d")))).first()[0]
    assert full == 100
    bare = spark.createDataFrame([(None, None, None, None, None)], firm.schema)
    assert bare.select(W.research_confidence(W.digital_presence(missing()), missing())).first()[0] == 20
    hit = F.array(F.struct(lit("t").alias("title"), lit("https://www.b.ie/x").alias("url")), F.struct(lit("t").alias("title"), lit("").alias("url")))
    assert spark.range(1).select(W.sources_reviewed(lit("a.ie"), hit)).first()[0] == [
        "company registry", "regulator register", "website:a.ie", "search:b.ie", "search:t"]


def test_reconcile(value):
    p = W.digital_presence(lit("[T](https://a.ie)\nx"))
    fixed = value(W.reconcile_presence(p, lit("No insurance website found for the firm."), missing(), missing()))
    assert (fixed.has_website, fixed.domain) == (False, None)
    assert value(W.reconcile_presence(p, lit("Good site."), missing(), missing())).has_website is True


def test_context_and_outreach(spark):
    firm = spark.createDataFrame([("Acme", None, "7", "Normal", "C1", "Cork", None)],
                                 "legal_name string, trading_name string, cro_number string, cro_status string, cbi_reference string, county string, incorporation_date string")
    none = F.array().cast("array<string>")
    hits_ = F.array(*[lit(f"h{i}") for i in range(8)])
    text = firm.select(W.evidence_context(lit("s" * 13000), hits_, none, none)).first()[0]
    assert text.startswith("Legal name: Acme\nRegistry number: 7") and "s" * 13000 in text and "- h7" in text
    cut = firm.select(W.evidence_context(lit("s" * 13000), hits_, none, none, site_chars=12000, hits=6)).first()[0]
    assert "s" * 12000 in cut and "s" * 12001 not in cut and "- h5" in cut and "- h6" not in cut
    absent = firm.select(W.evidence_context(missing(), none, F.array(lit("p")), F.array(lit("a.ie")))).first()[0]
    assert "blocked" in absent and "a.ie" in absent and absent.endswith("LinkedIn:\n- p")
    narrative = F.struct(lit("S" * 2000).alias("executive_summary"), lit("angle").alias("recommended_angle"), none.alias("avoid"), none.alias("discovery"),
                         F.lit(None).cast("array<string>").alias("reference_points"), F.array(lit("old key")).alias("reference"))
    best = F.struct(lit("Mary Byrne").alias("name"), lit("Director").alias("role"))
    o = firm.select(W.outreach_inputs(F.array(best), narrative, F.array(lit("fact")), best).alias("o")).first().o
    assert o.recipient == "Mary Byrne, Director" and o.reference_points == ["old key"] and len(o.summary) == 2000 and "fact" in o.grounding


def test_research_plan(spark):
    from firmloom.plans.research import research

    firms = spark.createDataFrame(
        [("c", "Acme Cover Insurance Ltd", None, "77123", "Normal", "C98765", "2001-02-03", None, "12 Mainly Street, Cork", None),
         ("d", "Nobody Known Ltd", None, None, None, None, None, None, None, None)],
        "id string, legal_name string, trading_name string, cro_number string, cro_status string, cbi_reference string, incorporation_date string, "
        "last_annual_return string, registered_address string, eircode string")
    found = spark.createDataFrame([("c", 0, 0, "Acme", "https://www.acmecover.ie/"), ("c", 0, 1, "fb", "https://facebook.com/acmecover")],
                                  "company_id string, query_no int, rank int, title string, url string")
    pages = spark.createDataFrame(
        [("https://www.acmecover.ie/", 200, "nginx", f"<p>{BROKER}</p><a href='/team'>Our team</a>"),
         ("https://www.acmecover.ie/team", 200, "nginx", "<p>" + "Mary Byrne, Director. m.byrne@acmecover.ie. " * 4 + "</p>")],
        "url string, status int, server string, html string")
    rows = {r.company_id: r for r in research(firms, found, pages, ["info"]).collect()}
    acme = rows["c"]
    assert acme.presence.domain == "acmecover.ie" and acme.presence.pages_crawled == 2
    assert [(c.name, c.email) for c in acme.contacts] == [("Mary Byrne", "m.byrne@acmecover.ie")]
    assert acme.social_links == {"facebook": "https://facebook.com/acmecover"} and acme.research_confidence >= 90
    assert rows["d"].presence.notes == "No verified website" and rows["d"].contacts == []


def test_a_readable_guess_is_the_site(spark):
    from firmloom.plans.research import research

    names = ["id", "legal_name", "trading_name", "cro_number", "cro_status", "cbi_reference", "incorporation_date", "last_annual_return",
             "registered_address", "eircode"]
    firms = spark.createDataFrame(
        [("g", "Quill Holdings Ltd", "Zephyr.ie"), ("b", "Acme Cover Insurance Ltd", "acmex.com"), ("n", "Nowhere Ltd", "nowhere.ie")],
        "id string, legal_name string, trading_name string").select(
            *[n if n in ("id", "legal_name", "trading_name") else F.lit(None).cast("string").alias(n) for n in names])
    found = spark.createDataFrame([("b", 0, 0, "Acme", "https://www.acmecover.ie/"), ("g", 0, 0, "Other", "https://other.ie/")],
                                  "company_id string, query_no int, rank int, title string, url string")
    pages = spark.createDataFrame(
        [("https://www.zephyr.ie", 200, "nginx", ""), ("https://zephyr.ie/", 200, "nginx", "<p>" + "Nothing about the firm. " * 9 + "</p>"),
         ("https://other.ie/", 200, "nginx", "<p>" + "Cheese. " * 30 + "</p>"), ("https://www.acmex.com", 200, "nginx", "<p>" + "Cheese. " * 30 + "</p>"),
         ("https://www.acmecover.ie/", 200, "nginx", f"<p>{BROKER}</p>")],
        "url string, status int, server string, html string")
    rows = {r.company_id: r.presence.domain for r in research(firms, found, pages, ["info"]).collect()}
    # Below the threshold, yet the site; a result that scores higher; no readable guess.
    assert rows == {"g": "zephyr.ie", "b": "acmecover.ie", "n": None}
    guessed = W.guessed_sites(firms.withColumnRenamed("id", "company_id"), pages).orderBy("company_id").collect()
    assert [(r.company_id, r.guess, r.url) for r in guessed] == [("b", 0, "https://www.acmex.com"), ("g", 1, "https://zephyr.ie/")]
