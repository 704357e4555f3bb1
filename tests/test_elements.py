"""Arrays by element against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselwork.sources import elements
from tesselwork.sources.repository import Repository, RepositoryError


def table(spark, values):
    return spark.createDataFrame([([int(x) for x in i], float(v)) for i, v in np.ndenumerate(values)], "index array<bigint>, value double")


def dense(session, path, shape, box=None):
    out = np.full(shape, -1.0)
    for r in elements.read(session, path, box).collect():
        assert out[tuple(r["index"])] == -1.0
        out[tuple(r["index"])] = r.value
    return out


def test_regions_and_appends_off_chunk_borders(spark, tmp_path):
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    s = repo.session()
    elements.create(s, "/a", [5, 7], [2, 3], "<f4", 9.0)
    want = np.arange(35.0).reshape(5, 7)
    elements.write(s, "/a", table(spark, want))
    elements.write(s, "/a", table(spark, np.full((2, 3), 100.0)), [1, 2])
    want[1:3, 2:5] = 100
    s.commit("one")
    t = repo.session()
    elements.append(t, "/a", table(spark, np.full((4, 7), 7.0)), 0, 4)
    want = np.concatenate([want, np.full((4, 7), 7.0)])
    t.commit("two")
    r = repo.session(read_only=True)
    assert (dense(r, "/a", (9, 7)) == want).all()
    part = dense(r, "/a", (9, 7), [(1, 6), (3, 50)])
    assert (part[1:6, 3:] == want[1:6, 3:]).all() and (part == -1).sum() == 63 - 20
    with pytest.raises(Exception, match="outside the array"):
        elements.write(repo.session(), "/a", table(spark, np.zeros((1, 1))), [9, 0])


def test_fill_ties_and_nulls(spark, tmp_path):
    repo = Repository.create(spark, f"file://{tmp_path}/repo")
    s = repo.session()
    elements.create(s, "/n", [300], [200], "<i8", 4)
    rows = spark.createDataFrame([([0], 5.0), ([0], 6.0), ([1], None)], "index array<bigint>, value double")
    elements.write(s, "/n", rows)
    elements.write(s, "/n", rows.where("false"))
    s.commit("one")  # 1600 bytes: a payload table
    r = repo.session(read_only=True)
    got = {x["index"][0]: x.value for x in elements.read(r, "/n").collect()}
    assert len(got) == 200 and got.pop(0) == 6 and set(got.values()) == {4}
    s = repo.session()
    s.add_array("/plain", [4], [2])
    with pytest.raises(RepositoryError):
        elements.write(s, "/plain", rows)
    with pytest.raises(RepositoryError):
        elements.create(s, "/bad", [4], [2, 2])
    assert elements.read(r, "/n", [(0, 2)]).agg(F.sum("value")).first()[0] == 10
