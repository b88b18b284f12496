"""Sources and sinks (S1-S14): CSV by column name, headers, dates, report round trip."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest

from regiolens.sources import loader as L
from regiolens.sources import sinks as K
from regiolens.sources.synthetic import generate_sample


@pytest.fixture
def csv_dir():
    d = tempfile.mkdtemp(prefix="regiolens-csv-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n")
        f.write("01-02-2025,Bihar,Patna,800001,1,2,3\n")
        f.write("31-02-2025,Bihar,Patna,800001,4,5,6\n")  # impossible date -> NULL
    with open(os.path.join(d, "b.csv"), "w") as f:  # other column order, extra column, mixed-case header
        f.write("District,age_18_greater,State,extra,Date,age_0_5,age_5_17,Pin-Code,pincode\n")
        f.write("Gaya,9,Bihar,x,15-03-2025,7,8,0,823001\n")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not a csv\n")
    return d


def test_load_directory_by_column_name(spark, csv_dir):
    df = L.load_directory(spark, csv_dir)
    rows = {r.district: r for r in df.collect()}
    assert len(df.collect()) == 3
    g = rows["Gaya"]
    assert (g.state, g.pincode, g.age_0_5, g.age_5_17, g.age_18_greater) == ("Bihar", 823001, 7, 8, 9)
    assert g.date == dt.date(2025, 3, 15) and g.total_enrollment == 24
    assert g.day_of_week == 5 and g.year_month == dt.date(2025, 3, 1)  # Saturday = 5 (Monday = 0)
    assert "extra" in df.columns
    bad = [r for r in df.collect() if r.district == "Patna" and r.date is None]
    assert len(bad) == 1 and bad[0].year is None


def test_load_missing_raises(spark):
    with pytest.raises(FileNotFoundError):
        L.load_directory(spark, "/tmp/regiolens-does-not-exist")


def test_header_normalisation():
    assert L.normalize_header(" Age 0-5 ") == "age_0_5"
    assert L.header_mapping(["Date", "STATE", "District", "Pin Code"]) == {
        "Date": "date", "STATE": "state", "District": "district"}
    assert L.looks_compatible(["Enroll Date", "State Name", "district"])


def test_shares_zero_total(spark):
    from tests.conftest import FACT_DDL

    df = L.derive_columns(spark.createDataFrame([(1, dt.date(2025, 1, 1), "A", "B", 800001, 0, 0, 0)], FACT_DDL))
    r = df.first()
    assert (r.pct_age_0_5, r.pct_age_5_17, r.pct_age_18_greater) == (0.0, 0.0, 0.0)


def test_report_round_trip(spark, tiny_fact):
    base = tempfile.mkdtemp(prefix="regiolens-report-", dir="/tmp")
    from regiolens.operators import describe as D

    K.save_report({"coverage": D.coverage(tiny_fact)}, base, "20250101_000000")
    K.save_report({"coverage": D.coverage(tiny_fact.where("state = 'Bihar'"))}, base, "20250102_000000")
    latest = K.load_latest(spark, base, "coverage").collect()
    assert len(latest) == 1 and latest[0].num_states == 1
    out = os.path.join(base, "export")
    K.export_csv(tiny_fact.select("state", "district"), out)
    assert spark.read.option("header", True).csv(out).count() == 12


def test_synthetic_generator_is_partition_independent(spark):
    a = generate_sample(spark, 500).collect()
    b = generate_sample(spark, 500).repartition(7).orderBy("record_id").collect()
    assert a == b
    df = L.derive_columns(generate_sample(spark, 500))
    assert df.where("date IS NULL").count() == 0 and df.select("state").distinct().count() <= 10


def _lines_read(spark, run):
    """Input rows of the stages that ``run`` started."""
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = {(s.stageId(), s.attemptId()) for s in _stages(store)}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(s.inputRecords() for s in _stages(store) if (s.stageId(), s.attemptId()) not in seen)


def _stages(store):
    it = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None).iterator()
    while it.hasNext():
        yield it.next()


def test_header_probe_reads_first_lines_only(spark, tmp_path):
    for f in range(3):
        rows = "\n".join(f"0{1 + i % 9}-03-2025,Bihar,Patna,80000{i % 5},{i},1,2" for i in range(40_000))
        (tmp_path / f"f{f}.CSV").write_text("date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n" + rows + "\n")
    groups, n = _lines_read(spark, lambda: L.header_groups(spark, str(tmp_path)))
    assert list(groups.values()) == [None] and n == 0  # one header: no file is listed
    count, n = _lines_read(spark, lambda: L.load_directory(spark, str(tmp_path)).where("year = 2025").count())
    assert count == 120_000 and n <= 120_003


def test_headers_in_two_orders_and_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffdate,state,district,pincode,age_0_5,age_5_17,age_18_greater\r\n01-02-2025,A,B,1,2,3,4\r\n")
    (tmp_path / "b c.csv").write_text("state,date,district,pincode,age_18_greater,age_5_17,age_0_5\nA,02-02-2025,B,1,7,6,5\n")
    groups = L.header_groups(spark, str(tmp_path))
    assert len(groups) == 2 and sorted(len(v) for v in groups.values()) == [1, 1]
    got = {r.date: (r.age_0_5, r.age_5_17, r.age_18_greater) for r in L.load_directory(spark, str(tmp_path), file_column="f").collect()}
    assert got == {dt.date(2025, 2, 1): (2, 3, 4), dt.date(2025, 2, 2): (5, 6, 7)}


def test_unfinished_run_is_never_latest(spark, tiny_fact, tmp_path):
    base = str(tmp_path / "out")
    df = tiny_fact.groupBy("state").count()
    with pytest.raises(FileNotFoundError):
        K.load_latest(spark, base, "states")
    K.save_report({"states": df, "none": df.limit(0)}, base, "20250101_000000")
    K.save_report({"other": df}, base, "20250103_000000", fmt="parquet")
    df.where("state = 'Bihar'").write.json(f"{base}/states/run_ts=20250104_000000")  # no manifest: not finished
    os.makedirs(f"{base}/{K.MANIFESTS}/run_ts=20250105_000000")  # a manifest that was never committed
    assert K.load_latest(spark, base, "states").count() == 2
    assert {r.run_ts for r in K.load_latest(spark, base, "states").collect()} == {"20250101_000000"}
    assert K.load_latest(spark, base, "none").columns == ["state", "count", "run_ts"]  # an empty section has its schema
    assert K.load_latest(spark, base, "other").count() == 2
    K.save_report({"states": df.where("state = 'Bihar'")}, base, "20250106_000000")
    latest = K.load_latest(spark, base, "states")
    assert latest.count() == 1
    assert all("20250106_000000" in f for f in latest.inputFiles())  # old runs are not read


def test_incremental_sums_read_changed_files_only(spark, tmp_path):
    from regiolens.plans import incremental as I
    from regiolens.plans import marts

    src, root = tmp_path / "in", str(tmp_path / "mart")
    src.mkdir()
    head = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"
    write = lambda name, rows: (src / name).write_text(head + "".join(f"{d:02d}-01-2025,A,{k},800001,{v},1,1\n" for d, k, v in rows))
    with pytest.raises(FileNotFoundError):
        I.current_totals(spark, root)
    write("a.csv", [(1, "x", 10), (1, "x", 5), (2, "y", 7)])
    write("b.csv", [(1, "x", 100)])

    def same():
        want = marts.day_district_totals(L.load_directory(spark, str(src)))
        cols = want.columns
        assert sorted(map(tuple, I.current_totals(spark, root).select(*cols).collect())) == sorted(map(tuple, want.collect()))

    assert [os.path.basename(f) for f in I.refresh(spark, str(src), root)] == ["a.csv", "b.csv"]
    same()
    assert I.refresh(spark, str(src), root) == []
    same()
    write("c d.csv", [(3, "z", 1)])  # a file more
    got, n = _lines_read(spark, lambda: I.refresh(spark, str(src), root))
    assert [os.path.basename(f) for f in got] == ["c d.csv"]
    same()
    write("a.csv", [(1, "x", 20), (5, "w", 2)])  # a file replaced
    assert [os.path.basename(f) for f in I.refresh(spark, str(src), root)] == ["a.csv"]
    same()
    assert I.current_totals(spark, root).agg({"records": "sum"}).first()[0] == 4
    (src / "b.csv").unlink()  # a file gone
    assert I.refresh(spark, str(src), root) == []
    same()
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{root}/sums/gen=99")  # a refresh that broke off
    same()
