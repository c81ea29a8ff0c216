import os
import random
import time

import pytest
from pyspark.sql import functions as F

from catalog.lists import PAGE_COLUMNS
from firmloom.operators import ordered, upsert as U
from firmloom import schemas
from firmloom.plans.ingest import run_ingestion
from firmloom.session import checkpoint_dir, kept
from firmloom.sources import delimited as S
from firmloom.sources import layout as Y
from firmloom.sources import sinks


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_register_csv(spark, tmp_path):
    path = put(tmp_path / "r.csv", '﻿Firm Name,Trading Name,Registered Address,Reference Number\n'
               '"Acme   Brokers  Ltd",Acme,"1 Main St, Athlone, Co. Westmeath, N37 AC12",C1\n,,"x",C2\nBeta Ltd,,,C3\n')
    rows = S.scan_register(spark, path).orderBy("ordinal").collect()
    assert [(r.legal_name, r.trading_name, r.county, r.eircode, r.cbi_reference) for r in rows] == [
        ("Acme Brokers Ltd", "Acme", "Westmeath", "N37 AC12", "C1"), ("Beta Ltd", None, None, None, "C3")]
    assert rows[0].raw_row["Firm Name"] == "Acme   Brokers  Ltd"


def test_blank_name_falls_back_to_the_next_name_column(spark, tmp_path):
    path = put(tmp_path / "r.csv", "Firm Name,Trading Name\n ,Shop Front\n")
    assert [r.legal_name for r in S.scan_register(spark, path).collect()] == ["Shop Front"]


def test_tabs_latin1_and_quoted_line_breaks(spark, tmp_path):
    path = put(tmp_path / "r.txt", "Firm Name\tTrading Name\tRegistered Address\nCaf\xe9 Ltd\t\t1, 2, 3\n", "latin-1")
    assert [(r.legal_name, r.registered_address) for r in S.scan_register(spark, path).collect()] == [("Café Ltd", "1, 2, 3")]
    path = put(tmp_path / "q.csv", 'Firm Name,Registered Address\n"Acme","1 Main St\nCork"\nBeta,x\n')
    assert [(r.legal_name, r.county) for r in S.scan_register(spark, path).orderBy("ordinal").collect()] == [("Acme", "Cork"), ("Beta", None)]


def test_order_survives_splitting(spark, tmp_path):
    path = put(tmp_path / "big.csv", "Firm Name\n" + "".join(f"Firm {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = S.scan_register(spark, path)
        assert rows.rdd.getNumPartitions() > 3
        assert [r.legal_name for r in rows.orderBy("ordinal").collect()] == [f"Firm {i}" for i in range(20_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_snapshot_columns(spark, tmp_path):
    path = put(tmp_path / "s.csv", "company_num,company_status_code,COMPANY_STATUS,company_name,company_reg_date_text\n7,9,Normal,Acme,2001\n")
    rows, degraded = S.scan_snapshot(spark, path)
    row = rows.first()
    assert (row.company_num, row.company_status, row.company_name, row.company_reg_date, degraded) == ("7", "Normal", "Acme", "2001", False)
    assert S.scan_snapshot(spark, put(tmp_path / "e.csv", "company_num,company_name\n"))[1] is True


def test_latest_file(spark, tmp_path):
    for i, name in enumerate(["register_a.csv", "register_b.txt", "companies_z.csv", "note.md"]):
        put(tmp_path / name, "x")
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert S.latest_file(spark, str(tmp_path), ["*.csv", "*.txt"]).endswith("register_b.txt")


def test_columns_of_words(spark):
    at = {44.8: "ref_no", 106.7: "intermediary", 213.0: "intermediary", 243.0: "registered_as", 363.0: "registered_on", 451.0: "tied_to", 604.4: "persons_responsible", 715.8: "passporting_into", 760.0: "passporting_into"}
    row = spark.range(1).select(*[Y.column_at(F.lit(x), PAGE_COLUMNS).alias(str(i)) for i, x in enumerate(at)]).first()
    assert list(row) == list(at.values())


LINES = [  # file, page, line, ref_no, intermediary, registered_as, registered_on
    ("f", 1, 1, "Ref No", "Name", None, None), ("f", 1, 2, None, "stray", None, None),
    ("f", 1, 3, "C123", "Acme Brokers", "Retail", "3 March 2020"), ("f", 1, 4, None, "Limited", None, None),
    ("f", 1, 5, None, "t/a Acme Cover", None, None), ("f", 1, 6, None, "T/A Acme Two", None, None), ("f", 2, 1, "Ref No", "Name", None, None),
    ("f", 2, 2, None, "1 Main St", None, None), ("f", 2, 3, None, "Co. Mayo", None, None), ("f", 2, 4, "C9", "Beta", "x", "soon"),
]


def test_records_across_pages(spark):
    lines = spark.createDataFrame(
        LINES, "file string, page int, line long, ref_no string, intermediary string, registered_as string, registered_on string")
    rows = Y.record_from_lines(Y.records_from_layout(lines)).orderBy("record").collect()
    assert [(r.cbi_reference, r.legal_name, r.trading_name, r.registered_address, r.registered_on) for r in rows] == [
        ("C123", "Acme Brokers Limited", "Acme Cover, Acme Two", "1 Main St, Co. Mayo", "2020-03-03"), ("C9", "Beta", None, None, "soon")]


def test_words_to_rows(spark):
    words = [(1, 1, 110.0, 10.2, "Acme"), (1, 2, 44.8, 10.4, "C1"), (1, 3, 105.0, 9.8, "The"), (1, 4, 101.0, 12.5, "even"), (2, 5, 10.0, 10.0, "left")]
    rows = Y.rows_from_positioned_words(spark.createDataFrame(words, "page int, word_no int, x0 double, top double, text string"), PAGE_COLUMNS)
    got = {(r.page, r.line): (r.ref_no, r.intermediary) for r in rows.collect()}
    assert got == {(1, 10): ("C1", "The Acme"), (1, 12): (None, "even"), (2, 10): ("left", None)}


def test_cells(spark):
    cells = [("a", 1, ["Register of firms", ""]), ("a", 2, ["Firm Name", "Address"]), ("a", 3, ["Acme", "Cork"]), ("a", 4, ["", " "]),
             ("b", 1, ["Ref No", "Name", "Name"]), ("b", 2, ["C1", "Old", "New"]), ("b", 3, ["C2"])]
    rows = Y.rows_from_cells(spark.createDataFrame(cells, "file string, row_no int, cells array<string>"))
    assert {(r.file, r.row_no): r.row for r in rows.collect()} == {
        ("a", 3): {"Firm Name": "Acme", "Address": "Cork"}, ("b", 2): {"Ref No": "C1", "Name": "New"}, ("b", 3): {"Ref No": "C2"}}


def test_running_values_over_a_hot_key(spark):
    rows = [("hot" if i % 3 else "k" + str(i % 5), i, i % 4 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    sums = {r["at"]: r.s for r in ordered.running_sum(df, ["k"], ["at"], F.coalesce("v", F.lit(0)), "s").collect()}
    last = {r["at"]: r.p for r in ordered.previous_value(df, ["k"], ["at"], F.col("v"), "p").collect()}
    total, seen = {}, {}
    for k, at, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        assert (sums[at], last[at]) == (total[k], seen.get(k))
        seen[k] = v if v is not None else seen.get(k)


def test_raw_payload(spark):
    df = spark.createDataFrame([("a", None, 1)], "x string, y string, raw_row int")
    assert df.select(sinks.raw_payload(df.columns)).first()[0] == '{"x":"a","y":null}'


REGISTER = "Firm Name,Registered Address\nAcme Brokers Ltd,Cork\nBeta Limited,Mayo\n"
REGISTRY = "company_num,company_name,company_status,company_reg_date\n1,ACME BROKERS LIMITED,Normal,2001-01-01\n2,BETA LTD,Normal,2002-02-02\n"


def test_ingestion_end_to_end(spark, tmp_path):
    register, registry = put(tmp_path / "r.csv", REGISTER), put(tmp_path / "s.csv", REGISTRY)
    root = str(tmp_path / "tables")
    audit = run_ingestion(spark, register, registry, root, "run1").first()
    assert (audit.records_found, audit.records_new, audit.errors) == (2, 2, "[]")
    audit = run_ingestion(spark, register, registry, root, "run2").first()
    assert (audit.records_found, audit.records_new) == (2, 0)
    companies = sinks.read_snapshot(spark, root, "companies")
    assert sorted((r.legal_name, r.cro_number) for r in companies.collect()) == [("Acme Brokers Ltd", "1"), ("Beta Limited", "2")]
    assert sinks.read_snapshot(spark, root, "ingestion_runs").count() == 2


def test_one_run_twice_loses_nothing(spark, tmp_path):
    register, registry = put(tmp_path / "r.csv", REGISTER), put(tmp_path / "s.csv", REGISTRY)
    root = str(tmp_path / "tables")
    run_ingestion(spark, register, registry, root, "run1")
    audit = run_ingestion(spark, register, registry, root, "run1").first()
    assert (audit.records_found, audit.records_new) == (2, 0)
    assert sinks.read_snapshot(spark, root, "companies").count() == 2
    assert sinks.read_snapshot(spark, root, "ingestion_runs").count() == 1


def test_a_failed_write_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = lambda n: spark.createDataFrame([("r%d" % i, "s", None, None, 1, 1, "[]") for i in range(n)], schemas.INGESTION_RUNS)
    first = sinks.write_snapshot(rows(2), root, "ingestion_runs", "a")
    with monkeypatch.context() as m:
        m.setattr(sinks, "_point", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.write_snapshot(rows(5), root, "ingestion_runs", "b")
    assert sinks.read_snapshot(spark, root, "ingestion_runs").count() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        sinks._point(spark, root, "ingestion_runs", first)
    sinks.write_snapshot(rows(3), root, "ingestion_runs", "b")
    assert sinks.remove_old_versions(spark, root, "ingestion_runs", keep=1) == 1
    assert sinks.read_snapshot(spark, root, "ingestion_runs").count() == 3


def test_own_county_and_postcode_count(spark, tmp_path):
    path = put(tmp_path / "c.csv", "Firm Name,County,Eircode,Registered Address\nAcme,Cork,T12 AB34,\"1 St, Co. Mayo, F12 XY34\"\nBeta,,,\"1 St, Co. Mayo\"\n")
    assert [(r.county, r.eircode) for r in S.scan_register(spark, path).orderBy("ordinal").collect()] == [("Cork", "T12 AB34"), ("Mayo", None)]


def test_ingestion_without_snapshot_or_register(spark, tmp_path):
    root = str(tmp_path / "tables")
    audit = run_ingestion(spark, put(tmp_path / "r.csv", REGISTER), None, root, "run1").first()
    assert (audit.records_found, audit.records_new, audit.errors) == (2, 2, '["no registry snapshot"]')
    payloads = [r.raw_payload for r in sinks.read_snapshot(spark, root, "companies").collect()]
    assert len(payloads) == 2 and all('"needs_review":true' in p for p in payloads)
    audit = run_ingestion(spark, str(tmp_path / "none.csv"), None, root, "run2").first()
    assert (audit.records_found, audit.records_new) == (0, 0) and "register not read" in audit.errors
    assert sinks.read_snapshot(spark, root, "ingestion_runs").count() == 2


def test_the_second_writer_from_one_version_gets_an_error(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    write = lambda df, version, base: sinks.write_snapshot(df, root, "ingestion_runs", version, base)
    assert write(rows("a"), "v", 0).number == 1
    mine = rows("a", "A")
    assert write(rows("a", "B"), "w", 1).number == 2
    with pytest.raises(sinks.LostRace, match="made from version 1, but version 2"):
        write(mine, "x", 1)
    with pytest.raises(sinks.LostRace):
        write(mine, "x", 0)
    assert {r.id for r in sinks.read_snapshot(spark, root, "ingestion_runs").collect()} == {"a", "B"}

    came_between = []

    def add(df):
        if not came_between:  # another writer commits while this one works
            came_between.append(write(rows("a", "B", "C"), "y", 2))
        return df.select("id").unionByName(rows("D"))

    assert sinks.update_snapshot(spark, root, "ingestion_runs", "z", add).number == 4
    assert {r.id for r in sinks.read_snapshot(spark, root, "ingestion_runs").collect()} == {"a", "B", "C", "D"}
    with pytest.raises(sinks.LostRace):
        sinks.update_snapshot(spark, root, "ingestion_runs", "u", lambda df: (write(rows("E"), "t", None), df)[1], attempts=2)


def test_an_ingestion_that_lost_the_race_commits_nothing(spark, tmp_path, monkeypatch):
    from firmloom.plans import ingest as plan

    root, register = str(tmp_path / "t"), put(tmp_path / "r.csv", REGISTER)
    run_ingestion(spark, register, None, root, "run1")
    before = sinks.read_snapshot(spark, root, "companies").count()
    whole = plan.ingest

    def slow(*args):
        done = whole(*args)
        sinks.write_snapshot(sinks.read_snapshot(spark, root, "companies").limit(1), root, "companies", "other", 1)
        return done

    monkeypatch.setattr(plan, "ingest", slow)
    with pytest.raises(sinks.LostRace):
        run_ingestion(spark, register, None, root, "run2")
    assert before > 1 and sinks.read_snapshot(spark, root, "companies").count() == 1
    assert {r.id for r in sinks.read_snapshot(spark, root, "ingestion_runs").collect()} == {"run1"}


def reference_rows(spark, path, sep=","):
    """What Spark's one-task reader makes of the file."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep)
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, sep):
    rng = random.Random(4)
    text = lambda: rng.choice(["plain", "a b", "", "x" * 30, 'five" pipe', 'say "" twice'])
    inner = lambda: rng.choice(['one\ntwo', 'He said ""no""', f"a{sep}b", "\n\n", '""', "end\n", '"" \n ""', f'x""{sep}\n""y'])
    lines = [f"Firm Name{sep}Note{sep}Other"]
    for i in range(4000):
        lines.append(sep.join([f"Firm {i}", f'"{inner()}"' if rng.random() < 0.3 else text(), f'"{inner()}"' if rng.random() < 0.2 else text()]))
    lines[2000:2000] = ["", ""]
    path = put(tmp_path / "big.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        rows = S.read_delimited(spark, path)
        got = rows.orderBy("ordinal").collect()
        assert sorted((tuple(r)[:-1] for r in got), key=repr) == reference_rows(spark, path, sep)
        assert [r["Firm Name"] for r in got] == [f"Firm {i}" for i in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_breaks_in_other_encodings_and_folders(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_bytes('Firm Name,Note\r\n"Caf\xe9\r\nOne",x\r\n'.encode("latin-1"))
    (folder / "b.csv").write_bytes('Firm Name,Note\nTwo,"y\nz"\nThree,\n'.encode("latin-1"))
    rows = S.read_delimited(spark, str(folder)).orderBy("ordinal").collect()
    assert [(r["Firm Name"], r["Note"]) for r in rows] == [("Caf\xe9\nOne", "x"), ("Two", "y\nz"), ("Three", None)]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_longer_than_blocks_and_files_that_end_inside_quotes(spark, tmp_path, small_blocks):
    long = "\n".join(f'line {i} ""x"", and' for i in range(2000))
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.csv", f'\n\nFirm Name,Note\nOne,"{long}"\n\n"Two\n",b\n"Three","never\nclosed\n')
    put(tmp_path / "in" / "b.csv", f'Firm Name,Note\n"{long}",y\n' + 'Four,"p\nq"\n' * 900)
    rows = S.read_delimited(spark, str(tmp_path / "in")).orderBy("ordinal").collect()
    text = long.replace('""', '"')
    assert [(r["Firm Name"], r["Note"]) for r in rows[:2]] == [("One", text), ("Two\n", "b")]
    assert rows[2]["Firm Name"] == "Three" and rows[2]["Note"].strip('"').startswith("never\nclosed")
    assert [(r["Firm Name"], r["Note"]) for r in rows[3:]] == [(text, "y")] + [("Four", "p\nq")] * 900


def test_lines_of_a_file_are_neither_stored_nor_shuffled(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    words = [f"{rng.getrandbits(4000):01000x}" for _ in range(600)]
    path = put(tmp_path / "big.csv", "Firm Name,Note\n" + "".join(f'"{w}\n{i}",{i}\n' for i, w in enumerate(words)))
    folder = checkpoint_dir(spark).removeprefix("file:")
    stored = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    before = stored()
    rows = S.read_delimited(spark, path)
    assert sorted((int(r["Note"]), r["Firm Name"]) for r in rows.collect()) == [(i, f"{w}\n{i}") for i, w in enumerate(words)]
    assert stored() - before < os.path.getsize(path) / 4
    # A change of the splits between opening and reading is an error, no loss of rows.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    with pytest.raises(Exception, match="read them again"):
        rows.select("Note").collect()


def test_staged_writes_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = found()
    assert kept(spark.range(1000).repartition(3)).filter("id >= 0").collect()
    for _ in range(50):  # they go in the background
        if found() <= before:
            break
        time.sleep(0.2)
    assert found() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    root, schema = str(tmp_path), schemas.ASSESSMENT_REJECTIONS
    make = lambda rows: spark.createDataFrame([(k, why, "[]", 1.0, "m", None) for k, why in rows], schema)
    content = lambda: {r.company_id: r.reason for r in sinks.read_snapshot(spark, root, "assessment_rejections").collect()}

    def store(version, rows):
        batch, base = make(rows), sinks.newest(spark, root, "assessment_rejections")
        touched = sinks.touched_buckets(batch, "company_id", base, 16)
        part = sinks.read_pointer(spark, root, "assessment_rejections", base, touched)
        return touched, sinks.write_buckets(
            U.replace_rows(part, batch, ["company_id"]), root, "assessment_rejections", version, base, "company_id", touched, 16)

    want = {f"c{i}": "first" for i in range(200)}
    first, pointer = store("a", want.items())
    assert first == list(range(16)) and content() == want
    touched, second = store("b", [("c3", "second"), ("c7", "second"), ("new", "second")])
    want |= {"c3": "second", "c7": "second", "new": "second"}
    assert content() == want and 1 <= len(touched) <= 3
    # Only these were written; the pointer keeps the folders of all others.
    assert sorted(d for d in os.listdir(f"{root}/assessment_rejections/{second.folder}") if d[0] not in "._") == sorted(
        f"key_bucket={b}" for b in touched)
    assert {b for b, f in second.buckets.items() if f == pointer.folder} == {str(b) for b in range(16)} - {str(b) for b in touched}
    with pytest.raises(sinks.LostRace):
        sinks.write_buckets(make([]), root, "assessment_rejections", "x", pointer, "company_id", [0])
    # A bucket whose rows are gone has no folder.
    gone = sinks.write_buckets(make([]), root, "assessment_rejections", "c", second, "company_id", [5])
    assert gone.buckets["5"] is None
    before = content()
    assert 0 < len(before) < len(want)
    assert sinks.remove_old_versions(spark, root, "assessment_rejections", keep=1) == 2
    assert content() == before
    assert not os.path.exists(f"{root}/assessment_rejections/{pointer.folder}/key_bucket=5")


def test_spanning_lines_are_written_and_read_as_several_files(spark, monkeypatch):
    from catalog import QUERIES, storage

    monkeypatch.setattr(storage, "FILE_ROWS", 20)
    made, write = [], storage.written
    monkeypatch.setattr(storage, "written", lambda *a: made.append(write(*a)) or made[-1])
    got = QUERIES["read_spanning_lines"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert sorted((r.place, r.doc_id, r.text, r.source) for r in got) == [
        (i, str(r.doc_id), r.text.replace("\r", " "), r.source) for i, r in enumerate(docs)]
    assert len({r.name for r in spark.read.text(made[0]).selectExpr("_metadata.file_name as name").distinct().collect()}) >= 8
