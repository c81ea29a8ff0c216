import random
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from firmloom import schemas
from firmloom.functions.similarity import wratio
from firmloom.operators import fuzzy, identity, resolve as R, upsert as U
from firmloom.session import checkpoint_dir

SNAPSHOT = "ordinal long, " + ", ".join(f"{c} string" for c in schemas.REGISTRY_SNAPSHOT.names)


def snapshot(spark, *rows):
    return spark.createDataFrame(
        [(i, number, name, "Normal", "2001-02-03", "LTD", None, None, "66.22") for i, (number, name) in enumerate(rows)],
        SNAPSHOT,
    )


def register(spark, *rows):
    return spark.createDataFrame(
        [(i, name, number) for i, (name, number) in enumerate(rows)], "ordinal long, legal_name string, cro_number string"
    )


REGISTRY = [("654321", "Elsewhere Limited"), ("11", "Acme Insurance Brokers Limited"), ("12", "Celtic Insurance Advisors Ltd")]


def test_cascade(spark):
    firms = register(
        spark, ("Anything", "65-4321"), ("ACME  Insurance Brokers", None), ("Acme Insurance Brokers Ireland", None),
        ("Celtic Cover Insurances", "99"), ("Zenith Maritime Consulting", None), ("Limited", None),
    )
    rows = {r.ordinal: r for r in R.resolve(firms, snapshot(spark, *REGISTRY)).collect()}
    got = [(rows[i].match_method, rows[i].match_confidence, rows[i].needs_review, rows[i].cro_number) for i in range(6)]
    assert got == [
        ("exact_cro_number", 1.0, False, "654321"),
        ("exact_normalized_name", 1.0, False, "11"),
        ("fuzzy_name", 0.95, False, "11"),
        # A near miss merges nothing, and the number it came with is gone.
        ("fuzzy_name_low_confidence", 0.7521, True, None),
        ("no_match", 0.0, True, None),
        ("no_match", 0.0, True, None),
    ]
    assert rows[3].near_miss == "Celtic Insurance Advisors Ltd"


def test_empty_snapshot_is_degraded(spark):
    rows = R.resolve(register(spark, ("Acme", None)), snapshot(spark)).collect()
    assert [(r.match_method, r.degraded, r.needs_review) for r in rows] == [("no_cro_snapshot", True, True)]


def test_last_row_wins_exact_first_row_wins_fuzzy(spark):
    rows = [("1", "Acme Ltd"), ("2", "ACME Limited"), ("3", "Acme Risk One"), ("4", "Acme Risk Two")]
    firms = register(spark, ("Acme", None), ("Acme Risk Six", None))
    got = {r.ordinal: r.cro_number for r in R.resolve(firms, snapshot(spark, *rows)).collect()}
    assert got[0] == "2"
    best = {r.name: r.match for r in R.match_fuzzy(
        spark.createDataFrame([("ACME RISK XXX",)], "name string"),
        R.snapshot_by_name(snapshot(spark, ("3", "Acme Risk One"), ("4", "Acme Risk Eno")))).collect()}
    assert best == {"ACME RISK XXX": "ACME RISK ONE"}


@pytest.mark.parametrize("cell", [4096, 7])
def test_best_matches_against_brute_force(spark, cell):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABCD") for _ in range(rng.randint(2, 6)))
    # One block holds a third of all names.
    make = lambda: rng.choice(["HOT", "HOT", word(), word()]) + " " + " ".join(word() for _ in range(rng.randint(1, 4)))
    left, right = sorted({make() for _ in range(60)}), sorted({make() for _ in range(80)})
    block = lambda n: n.split()[0]
    found = fuzzy.best_matches(
        spark.createDataFrame([(block(n), n) for n in left], "block string, name string"),
        spark.createDataFrame([(block(n), n, i) for i, n in enumerate(right)], "block string, name string, ordinal long"),
        cell=cell,
    ).collect()
    expected = {}
    for n in left:
        scored = [(wratio(n, m), -i, m) for i, m in enumerate(right) if block(m) == block(n)]
        if scored and max(scored)[0] >= 60:
            expected[n] = (max(scored)[2], max(scored)[0])
    assert {r.name: (r.match, r.score) for r in found} == expected
    assert any(n.startswith("HOT") for n in expected)


def test_unblocked_only_when_the_block_is_empty(spark):
    names = R.snapshot_by_name(snapshot(spark, ("1", "Acme Zulu Zebra Quartz"), ("2", "Celtic Cover")))
    wanted = spark.createDataFrame([("ACME COVER CELTIC",), ("KELTIC COVER",)], "name string")
    got = {r.name: r.match for r in R.match_fuzzy(wanted, names).collect()}
    # The first shares its first token with one poor candidate: no fallback to better ones elsewhere.
    assert got == {"KELTIC COVER": "CELTIC COVER"}


# --- Upsert ----------------------------------------------------------------

def in_order(rows, held):
    """The fold, one row at a time."""
    number_of = {k: n for k, n in held if n is not None}
    holder = {n: k for k, n in number_of.items()}
    owners = {}
    for ordinal, name, number in rows:
        if number is not None and number in holder:
            owners[ordinal] = holder[number]
            continue
        owners[ordinal] = name
        if number is not None:
            if name in number_of:
                del holder[number_of[name]]
            number_of[name], holder[number] = number, name
    return owners


@pytest.mark.parametrize("seed, numbers, names, size, limit", [
    (0, 4, 4, 40, 1000), (1, 25, 5, 60, 7), (2, 5, 25, 60, 1000), (3, 1, 30, 40, 1000), (4, 40, 40, 80, 9),
])
def test_owners_match_the_ordered_fold(spark, seed, numbers, names, size, limit):
    rng = random.Random(seed)
    rows = [
        (i, f"k{rng.randrange(names)}", None if rng.random() < 0.15 else str(rng.randrange(numbers))) for i in range(size)
    ]
    held = list(zip(
        (f"k{i}" for i in rng.sample(range(names), min(3, names))), map(str, rng.sample(range(numbers), min(3, numbers)))))
    got = identity.owners(
        spark.createDataFrame(rows, "ordinal long, name string, number string"),
        spark.createDataFrame(held, "name string, number string"), chunk_rows=limit,
    ).collect()
    assert {r.ordinal: r.owner for r in got} == in_order(rows, held)


def test_rounds_do_not_write_the_rows_again(spark):
    rng = random.Random(5)
    names = [f"{rng.getrandbits(720):0180x}" for _ in range(300)]
    rows = [(i, rng.choice(names), str(rng.randrange(50))) for i in range(12_000)]
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = written()
    got = identity.owners(
        spark.createDataFrame(rows, "ordinal long, name string, number string"),
        spark.createDataFrame([], "name string, number string"), chunk_rows=4000).collect()
    assert {r.ordinal: r.owner for r in got} == in_order(rows, [])
    assert written() - before < 180 * len(rows)  # less than the rows, over all rounds


def test_ordinals_beyond_longs_settle_in_chunks(spark):
    rng = random.Random(6)
    rows = [(Decimal(10**20 + i), f"k{rng.randrange(6)}", None if rng.random() < 0.1 else str(rng.randrange(25))) for i in range(60)]
    held = [("k1", "3"), ("k2", "4")]
    got = identity.owners(
        spark.createDataFrame(rows, "ordinal decimal(38,0), name string, number string"),
        spark.createDataFrame(held, "name string, number string"), chunk_rows=7).collect()
    assert {r.ordinal: r.owner for r in got} == in_order(rows, held)


def test_a_missing_ordinal_rounds_no_other(spark):
    rows = [(2**53 + 1 + i, f"k{i % 3}", str(i % 4)) for i in range(20)]
    got = identity.owners(
        spark.createDataFrame([*rows, (None, "k0", "1")], "ordinal long, name string, number string"),
        spark.createDataFrame([], "name string, number string")).filter("ordinal is not null").collect()
    assert {r.ordinal: r.owner for r in got} == in_order(rows, [])


def test_numbered_companies_with_keys_of_many_orders(spark, tmp_path):
    from catalog import QUERIES

    rng = random.Random(7)
    lines = [(rng.randrange(53_900_000, 54_000_000), rng.randrange(1, 8), rng.randrange(12), rng.randrange(8),
              rng.choice([0.01, 0.05]), rng.choice("ANR"), rng.choice("FO")) for _ in range(60)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_returnflag string, l_linestatus string"),
        "customer": ([(1, "Buyer 1", 0, 1.0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "Seller 1", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "IRELAND", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    batch = {((o * 8 + n) * 100_000_000_000 + p * 10_000 + s): (f"Firm {s}", str(p) if d > 0.02 else None, flag, status) for o, n, p, s, d, flag, status in lines}
    assert min(batch) > 2**63
    want = {"Buyer 1": ("CRO1", "IRELAND", None), "Seller 1": ("CRS1", "IRELAND", None)}
    owner = in_order([(i, *batch[i][:2]) for i in sorted(batch)], [])
    for i in sorted(batch):
        _, number, county, payload = batch[i]
        want[owner[i]] = (number or want.get(owner[i], (None,))[0], county, payload)
    got = QUERIES["upsert_companies_numbered"](spark, str(tmp_path)).collect()
    assert {r.legal_name: tuple(r)[1:] for r in got} == want


def batch(spark, *rows):
    columns = "ordinal long, legal_name string, cro_number string, county string, raw_payload string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], columns).withColumn("source", F.lit("register"))


def test_upsert_companies(spark):
    empty = spark.createDataFrame([], schemas.COMPANIES)
    first = U.upsert_companies(empty, batch(
        spark, ("Acme  Ltd", None, "Cork", "p1"), ("ACME LTD", "77", None, "p2"), ("Other Ltd", "77", "Mayo", None)))
    assert [r.is_new for r in first.outcomes.orderBy("ordinal").collect()] == [True, False, False]
    row = first.companies.collect()
    assert len(row) == 1
    # Names stay, filled values replace, NULL does not, the payload always does.
    assert (row[0].legal_name, row[0].legal_name_normalized, row[0].cro_number, row[0].county, row[0].raw_payload) == (
        "Acme  Ltd", "ACME", "77", "Mayo", None)
    again = U.upsert_companies(first.companies, batch(spark, ("Acme Limited", "88", None, "p4"), ("New", "77", None, "p5")))
    assert [r.is_new for r in again.outcomes.orderBy("ordinal").collect()] == [False, True]
    assert {(r.legal_name, r.cro_number) for r in again.companies.collect()} == {("Acme  Ltd", "88"), ("New", "77")}
    assert {r.id for r in first.companies.collect()} <= {r.id for r in again.companies.collect()}


def test_upsert_contacts(spark):
    current = spark.createDataFrame(
        [("1", "c", "Mary Byrne", "Director", None, "01", None, "s", None)], schemas.CONTACTS)
    rows = [(0, "c", "Mary Byrne", None, "m@a.ie"), (1, "c", None, "Clerk", None), (2, "c", None, "Clerk", None),
            (3, "c", "Mary Byrne", "Partner", None)]
    got = U.upsert_contacts(current, spark.createDataFrame(
        rows, "ordinal long, company_id string, full_name string, role_title string, email string")).collect()
    assert sorted((r.full_name or "", r.role_title, r.email, r.phone) for r in got) == [
        ("", "Clerk", None, None), ("", "Clerk", None, None), ("Mary Byrne", "Partner", "m@a.ie", "01")]
    assert len({r.id for r in got}) == 3


VERDICT = "ordinal long, company_id string, guard_passed boolean, has_verdict boolean, qualification_score int"


def test_verdict_has_three_states(spark):
    enrichment = spark.createDataFrame([], schemas.ENRICHMENT)
    rejections = spark.createDataFrame(
        [("a", "r", "[]", 1.0, "m", None), ("z", "r", "[]", 1.0, "m", None)], schemas.ASSESSMENT_REJECTIONS)
    stored, cleared = U.replace_enrichment(enrichment, rejections, spark.createDataFrame(
        [(0, "a", None, False, 1), (1, "b", None, True, 2), (2, "c", True, True, 3), (3, "c", False, True, 4)], VERDICT))
    rows = {r.company_id: r for r in stored.collect()}
    assert {k: r.guard_passed for k, r in rows.items()} == {"a": False, "b": None, "c": False}
    assert rows["a"].signal_strength == "low" and rows["c"].qualification_score == 4 and rows["a"].guard_failures == "[]"
    assert [r.company_id for r in cleared.collect()] == ["z"]


def test_rejections_keep_the_latest(spark):
    current = spark.createDataFrame([("a", "old", "[]", 1.0, "m", None), ("b", "kept", "[]", 1.0, "m", None)], schemas.ASSESSMENT_REJECTIONS)
    new = current.filter("company_id = 'a'").drop("reason")
    batch_rows = new.withColumns({"reason": F.lit("first"), "ordinal": F.lit(0)}).unionByName(
        new.withColumns({"reason": F.lit("second"), "ordinal": F.lit(1)}))
    assert sorted((r.company_id, r.reason) for r in U.record_rejection(current, batch_rows).collect()) == [("a", "second"), ("b", "kept")]


def test_patch_contacts(spark):
    rows = [("1", "a", '{"s":"x","contacts":[]}', "2024-01-01"), ("2", "a", '{"contacts":[1],"n":{"k":[1]}}', "2024-02-01")]
    enrichment = spark.createDataFrame(rows, "id string, company_id string, narrative_assessment string, at string").withColumn(
        "generated_at", F.col("at").cast("timestamp"))
    snapshot_, done = U.patch_contacts(enrichment, spark.createDataFrame(
        [("a", '[{"name":"M"}]'), ("zz", "[]")], "company_id string, contacts string"))
    docs = {r.id: r.narrative_assessment for r in snapshot_.collect()}
    assert docs["1"] == '{"s":"x","contacts":[]}'
    assert docs["2"] == '{"n":{"k":[1]},"contacts":[{"name":"M"}]}'
    assert {r.company_id: r.patched for r in done.collect()} == {"a": True, "zz": False}


def test_evolve_schema(spark):
    old = spark.createDataFrame([("1", "Acme Ltd"), ("2", "Limited")], "id string, legal_name string")
    new = U.evolve_schema(old, schemas.COMPANIES)
    assert set(new.columns) == set(schemas.COMPANIES.names)
    assert {r.id: r.legal_name_normalized for r in new.collect()} == {"1": "ACME", "2": None}


def test_plans(spark):
    """No join of the cascade may pair everything with everything."""
    plan = R.resolve(register(spark, ("Acme", None)), snapshot(spark, *REGISTRY))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
