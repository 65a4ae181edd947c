import random
from datetime import datetime, timedelta

import pytest

from fathomix.operators.constraints import Bounds
from fathomix.operators.nested import flatten
from fathomix.sources import enveloped
from fathomix.sources.tables import NESTED_SCHEMA

START = datetime(2021, 3, 1)


@pytest.fixture(scope="module")
def nested(spark):
    draw = random.Random(6)
    data = []
    for t in range(60):
        lat, lon, day = draw.uniform(-80, 80), draw.uniform(-170, 170), draw.randint(0, 300)
        profiles = [(START + timedelta(days=day, hours=h) if draw.random() < 0.9 else None,
                     draw.choice([lat + h / 10, None, float("nan")]) if draw.random() < 0.3 else lat + h / 10,
                     lon + h / 10, [(1.0, 2.0, 3.0)] * draw.randint(0, 2)) for h in range(draw.randint(0, 4))]
        data.append(("d", f"t{t}", profiles if t else None))
    return spark.createDataFrame(data, NESTED_SCHEMA)


BOUNDS = [None, Bounds(), Bounds(min_time="2021-05-01", max_time="2021-06-01"), Bounds(min_time="2021-09-01", max_time="2021-05-01", max_lat=3.0),
          Bounds(min_time="2021-08-01"), Bounds(max_time="2021-03-20"), Bounds(min_lat=40.0, max_lat=-5.0, min_lon=0.0), Bounds(max_lon=-100.0),
          Bounds(min_lat=89.0)]


def test_same_rows_from_fewer_files(spark, nested, tmp_path, rows_of):
    path = str(tmp_path / "store")
    enveloped.store_nested(nested, path, files=12)
    everything = len(enveloped.files_in(spark, path, None))
    for bounds in BOUNDS:
        found = enveloped.flatten_stored(spark, path, ["time", "latitude", "depth"], bounds)
        assert rows_of(found) == rows_of(flatten(nested, ["time", "latitude", "depth"], bounds)), bounds
    assert everything >= 8
    assert len(enveloped.files_in(spark, path, Bounds(min_time="2021-05-01", max_time="2021-05-10"))) < everything
    assert enveloped.files_in(spark, path, Bounds(min_lat=89.0)) == []
    with pytest.raises(ValueError, match="cannot read"):
        enveloped.flatten_stored(spark, path, ["time"], Bounds(min_time="soon"))


def test_empty_table(spark, nested, tmp_path):
    path = str(tmp_path / "store")
    enveloped.store_nested(nested.limit(0), path)
    assert enveloped.flatten_stored(spark, path, ["time"], Bounds(min_lat=0.0)).count() == 0
