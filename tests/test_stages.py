"""Written stages, settled data and its removal."""

from __future__ import annotations

import os

import pytest

from checks import queries
from litrewise import placement
from litrewise.sources import materialize, read_stage, register_view, write_stage

SF = "/root/testdata/sf0.001"


def frame(spark):
    return spark.createDataFrame([(1, "98"), (2, "95"), (3, "0098")], "id int, name string")


def test_partitioned_stage_keeps_its_schema(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return frame(spark)

    first = materialize(spark, path, build, partition_by=["name"])
    again = materialize(spark, path, build, partition_by=["name"])
    assert first.dtypes == again.dtypes and len(built) == 1
    assert sorted(r["name"] for r in again.collect()) == ["0098", "95", "98"]
    materialize(spark, path, build, refresh=True)
    assert len(built) == 2


def test_errors_are_not_taken_for_a_missing_stage(spark, tmp_path):
    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        materialize(spark, str(tmp_path / "none"), fails)


def test_overwrite_and_foreign_stage(spark, tmp_path):
    path = str(tmp_path / "s")
    write_stage(frame(spark), path)
    write_stage(frame(spark).limit(1), path)
    assert read_stage(spark, path).count() == 1
    frame(spark).write.parquet(str(tmp_path / "plain"))
    assert read_stage(spark, str(tmp_path / "plain")).count() == 3


def test_view(spark):
    register_view(frame(spark), "names")
    assert spark.sql("select count(*) n from names").first()["n"] == 3


def settled(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    return {f for f in os.listdir(root) if not f.startswith(".")}


def test_settled_data_is_removed(spark):
    before = settled(spark)
    with placement.settled_within(spark):
        df = placement.settle(frame(spark))
        assert df.count() == 3 and settled(spark) - before
    assert settled(spark) == before
    with pytest.raises(ZeroDivisionError), placement.settled_within(spark):
        placement.settle(frame(spark))
        1 / 0
    assert settled(spark) == before


@pytest.mark.parametrize("name", ["features_full", "model_lr", "split_dynamic", "join_national_avg"])
def test_plans_leave_nothing_behind(spark, name):
    before = settled(spark)
    with placement.settled_within(spark):
        queries.registered()[name](spark, SF).count()
    assert settled(spark) == before


def test_a_folder_must_be_named(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(placement, "folder_root", lambda _: None)
    with pytest.raises(RuntimeError):
        placement.shared_folder(spark)


def test_a_named_folder_serves_where_none_is_set(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            applicationId, master = "app-without-folder", "local[2]"

    assert placement.folder_root(Session) is None
    placement.name_folder(Session, "/somewhere")
    assert placement.shared_folder(Session).startswith("/somewhere/")
