"""Two-view geometries merged: the best row of a pair, ties among its copies, and no work on the others."""

from manyview.operators import matching

SCHEMA = "file int, i long, j long, inliers int, config string, f array<double>, e array<double>, h array<double>, q array<double>, t array<double>"
EYE, NO = [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [1.0, 0.0, 0.0, 0.0]


def row(file, i, j, inliers, config="a", h=EYE, f=EYE):
    return (file, i, j, inliers, config, list(map(float, f)), list(map(float, f)), list(map(float, h)), NO, [1.0, 2.0, 3.0])


def test_best_row_of_a_pair(spark):
    shear = [1.0, 2, 0, 0, 1, 0, 0, 0, 1]
    rows = [row(2, 1, 2, 30), row(1, 2, 1, 30, "b", shear, shear), row(1, 2, 1, 30, "a", EYE), row(0, 1, 2, 29)]
    # Rows that can't win are not brought to one direction: this matrix has no inverse to be taken.
    rows += [row(0, 2, 1, k % 20, h=[1.0, 2.0, 3.0]) for k in range(500)]
    rows += [row(5, 4, 3, 7, h=shear)]
    got = {(r["i"], r["j"]): r for r in matching.merge_two_view(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert set(got) == {(1, 2), (3, 4)}
    assert (got[1, 2]["inliers"], got[1, 2]["config"]) == (30, "b")
    assert got[1, 2]["h"] == [1.0, -2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] == got[3, 4]["h"]
    assert got[1, 2]["f"] == [1.0, 0.0, 0.0, 2.0, 1.0, 0.0, 0.0, 0.0, 1.0] and got[1, 2]["t"] == [-1.0, -2.0, -3.0]
