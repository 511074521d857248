"""Rejected lines, stages refreshed in part, and stages clustered by station."""

from __future__ import annotations

import glob
import gzip
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from litrewise.operators import prepare, reports
from litrewise.sources import (
    read_price_files_checked,
    read_stage,
    refresh_stage,
    write_clustered_stage,
    write_stage,
)
from litrewise.sources.incremental import FILE, MANIFEST, NEXT_MANIFEST
from litrewise.sources.rejects import line_counts

GOOD = '7;1200;R;4615000;-75000;2021-07-14 06:30:10;6;SP98;1.701'


def write_gz(path, lines):
    with gzip.open(path, "wt") as file:
        file.write("\n".join(lines) + "\n")


def test_every_line_is_accepted_or_told(spark, tmp_path):
    bad = {
        "too_few_fields": ["7;1200;R;1;2;2021-07-14 06:30:10;6;SP98", "7", ";;"],
        "too_many_fields": [GOOD + ";x", GOOD + ";;;"],
        "bad_value": [GOOD.replace("7;", "seven;", 1), GOOD.replace(";6;", ";six;")],
    }
    good = [GOOD, GOOD.replace("1.701", "abc"), GOOD.replace("2021-07-14", "not a day"), ";;;;;;;;", GOOD.replace("SP98", '"SP;98"')]
    write_gz(tmp_path / "a.csv.gz", [*good, *bad["too_few_fields"]])
    write_gz(tmp_path / "b.csv.gz", [*bad["bad_value"], "", *bad["too_many_fields"], GOOD])
    found = read_price_files_checked(spark, str(tmp_path / "*.csv.gz"), str(tmp_path / "quarantine"))
    counts = {r["outcome"]: r["n_lines"] for r in line_counts(found).collect()}
    assert counts == {"accepted": 6, "too_few_fields": 3, "too_many_fields": 2, "bad_value": 2}
    told: dict[str, list] = {}
    for r in read_stage(spark, str(tmp_path / "quarantine")).collect():
        told.setdefault(r["reason"], []).append(r["line"])
        assert r["file"].endswith(("a.csv.gz", "b.csv.gz"))
    assert {k: sorted(v) for k, v in told.items()} == {k: sorted(v) for k, v in bad.items()}
    assert "SP;98" in {r["name"] for r in found.accepted.collect()}
    assert prepare.clean_prices(found.accepted).count() == 4


def test_files_without_a_fault(spark, tmp_path):
    write_gz(tmp_path / "a.csv.gz", [GOOD])
    found = read_price_files_checked(spark, str(tmp_path / "a.csv.gz"), str(tmp_path / "q"))
    assert (found.accepted.count(), found.rejected.count()) == (1, 0)


def line(day, price, station=1):
    return f"{station};75000;R;1;2;{day} 10:00:00;1;E10;{price}"


def build(raw):
    return prepare.clean_prices(raw).select(FILE, "id", "day_date", "prix", "year")


class Folder:
    """Price files in a folder and the stage that is made of them."""

    def __init__(self, spark, tmp_path):
        self.spark, self.source, self.stage = spark, tmp_path / "in", str(tmp_path / "stage")
        self.source.mkdir()
        self.now = 1_600_000_000

    def put(self, name, *lines):
        write_gz(self.source / name, lines)
        self.now += 10
        os.utime(self.source / name, (self.now, self.now))

    def refresh(self):
        return refresh_stage(self.spark, str(self.source / "*.csv.gz"), self.stage, build)

    def files(self):
        return {(os.path.basename(os.path.dirname(f)), os.path.basename(f)) for f in glob.glob(f"{self.stage}/year=*/*.parquet")}

    def rows(self):
        return sorted((r["year"], str(r["day_date"]), r["prix"]) for r in read_stage(self.spark, self.stage).collect())

    def check(self):
        """The stage equals a full rebuild."""
        whole = self.stage + "-whole"
        refresh_stage(self.spark, str(self.source / "*.csv.gz"), whole, build)
        rebuilt = sorted((r["year"], str(r["day_date"]), r["prix"]) for r in read_stage(self.spark, whole).collect())
        for name in (MANIFEST, NEXT_MANIFEST):
            files = glob.glob(f"{whole}/{name}/*")
            assert name != MANIFEST or files
        assert self.rows() == rebuilt


@pytest.fixture
def folder(spark, tmp_path):
    made = Folder(spark, tmp_path)
    made.put("2020.csv.gz", line("2020-02-01", 1.0), line("2020-03-01", 1.1), line("2021-01-01", 1.2))
    made.put("2021.csv.gz", line("2021-02-01", 2.0))
    made.put("2022.csv.gz", line("2022-02-01", 3.0), line("bad", 9.0))
    made.put("none.csv.gz", line("bad", 1.0))
    first = made.refresh()
    assert first.values == [2020, 2021, 2022] and first.stage.count() == 5
    return made


def test_nothing_is_read_where_nothing_changed(folder):
    before = folder.files()
    again = folder.refresh()
    assert again.values == [] and again.read == [] and folder.files() == before


def test_only_years_of_a_changed_file_are_written(folder):
    before = folder.files()
    folder.put("2022.csv.gz", line("2022-02-01", 3.5), line("2022-02-02", 3.6))
    done = folder.refresh()
    assert done.values == [2022] and [os.path.basename(f) for f in done.read] == ["2022.csv.gz"]
    assert {f for f in folder.files() if f[0] != "year=2022"} == {f for f in before if f[0] != "year=2022"}
    assert not {f for f in folder.files() & before if f[0] == "year=2022"}
    folder.check()


def test_a_shared_year_keeps_the_rows_of_other_files(folder):
    folder.put("2021.csv.gz", line("2021-02-01", 2.5))
    done = folder.refresh()
    assert done.values == [2021] and {os.path.basename(f) for f in done.read} == {"2020.csv.gz", "2021.csv.gz"}
    assert (2021, "2021-01-01", 1.2) in folder.rows()
    folder.check()


def test_rows_that_move_to_another_year_leave_the_old_one(folder):
    folder.put("2022.csv.gz", line("2023-02-01", 3.0))
    assert folder.refresh().values == [2022, 2023]
    assert not [f for f in folder.files() if f[0] == "year=2022"]
    folder.check()


def test_new_and_vanished_files(folder):
    folder.put("late.csv.gz", line("2020-12-31", 7.0))
    os.remove(folder.source / "2022.csv.gz")
    assert folder.refresh().values == [2020, 2022]
    assert {r[0] for r in folder.rows()} == {2020, 2021}
    os.remove(folder.source / "none.csv.gz")
    assert folder.refresh().values == []
    folder.check()


def test_a_refresh_that_failed_is_done_again(folder, monkeypatch):
    from litrewise.sources import incremental

    folder.put("2021.csv.gz", line("2021-02-01", 2.5))
    with monkeypatch.context() as patched:
        patched.setattr(incremental, "_write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            folder.refresh()
    assert folder.refresh().values == [2021]
    folder.check()
    # Between the removal of the old manifest and the move of the next one.
    os.rename(f"{folder.stage}/{MANIFEST}", f"{folder.stage}/{NEXT_MANIFEST}")
    assert folder.refresh().values == []
    folder.put("2021.csv.gz", line("2021-02-01", 2.7))
    assert folder.refresh().values == [2021]
    folder.check()


def station_rows(spark):
    keys = spark.range(60_000).select((F.col("id") * 7919 % 3000).alias("id"), F.expr("date'2020-01-01' + cast(id % 300 as int)").alias("day_date"))
    return keys.withColumn("prix", F.rand(1)).repartition(6)


def rows_scanned(df):
    df.collect()
    stages = [df._jdf.queryExecution().executedPlan()]
    while stages:
        node = stages.pop()
        if "Scan" in node.nodeName():
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        stages += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            stages.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            stages.append(node.plan())


def test_few_row_groups_are_read_for_few_stations(spark, tmp_path):
    rows = station_rows(spark).persist()
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    write_stage(rows, plain)
    write_clustered_stage(rows, clustered, files=8, row_group_bytes=16 * 1024, expected_keys=500)
    wanted = [3, 1500, 2999]
    reports_of = [reports.station_context(read_stage(spark, p), wanted, "2020-02-01", "2020-06-01", tiebreak=["prix"]) for p in (plain, clustered)]
    assert reports_of[0].collect() == reports_of[1].collect() and reports_of[0].count() > 0
    scanned = [rows_scanned(read_stage(spark, p).filter(F.col("id").isin(wanted))) for p in (plain, clustered)]
    assert scanned[0] == 60_000 and scanned[1] < 12_000
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{clustered}/*.parquet")]
    ids = [g.row_group(i).column(0).statistics for g in groups for i in range(g.num_row_groups)]
    touched = [s for s in ids if any(s.min <= w <= s.max for w in wanted)]
    assert 0 < len(touched) <= len(ids) / 4
    # Inside the range of a row group, but in none: only the bloom filter tells.
    odd = rows.filter("id % 2 = 1")
    write_clustered_stage(odd, str(tmp_path / "odd"), files=4, expected_keys=2000)
    assert rows_scanned(read_stage(spark, str(tmp_path / "odd")).filter("id = 1500")) == 0
    rows.unpersist()
