"""Isolated points: the neighbour search is made once for the threshold and the filter."""

from manyview.operators import filters


def test_one_search(spark, monkeypatch):
    searched, find = spark.sparkContext.accumulator(0), filters.nearest_neighbor_distances

    def counted(df, *cols):
        nn = find(df, *cols)

        def count(batches):
            for b in batches:
                searched.add(len(b))
                yield b

        return nn.mapInPandas(count, nn.schema)

    monkeypatch.setattr(filters, "nearest_neighbor_distances", counted)
    rows = [(i, float(i), 0.0, 0.0, 1.0) for i in range(20)] + [(20, 100.0, 0.0, 0.0, 1.0), (21, 1.0, 0.0, 0.0, 0.0)]
    got = filters.not_isolated(spark.createDataFrame(rows, "point_id long, x double, y double, z double, w double"), 1.5, 50.0).collect()
    assert sorted(r["point_id"] for r in got) == [*range(20), 21]
    assert searched.value == 21
