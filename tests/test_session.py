import os
from pathlib import Path

from fathomix.session import intermediates, materialize, release, shared_folder


def tables(spark):
    return {p for p in os.listdir(shared_folder(spark).removeprefix("file:")) if p.startswith("table-")}


def test_intermediate_tables_live_in_the_shared_folder_and_go(spark):
    before = tables(spark)
    kept = materialize(spark.range(5))
    with intermediates():
        inside = materialize(spark.range(7))
        assert inside.count() == 7 and len(tables(spark) - before) == 2
    assert len(tables(spark) - before) == 1 and kept.count() == 5
    release(kept)
    assert tables(spark) == before


def test_no_machine_local_temporary_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert Path(shared_folder(spark).removeprefix("file:")).is_relative_to(configured.removeprefix("file:"))
