"""Cells give what a full search gives; few probes give most of it."""

import numpy as np

from talusgrid.operators import cells, vector


def test_cells_equal_a_full_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(900)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, rows[7][1]), (1003, [-x for x in rows[7][1]])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 900, 60)] + [(2000, (-centres[0]).tolist()), (2001, [0.0] * 16), (2002, None)], "query_id long, vector array<double>")
    index = cells.build(vectors, str(tmp_path / "cells"), 12)
    want = vector.neighbours(vectors, queries, 7)
    told = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 5)) for r in df.collect())
    for probes in (1, 3):
        found, probed = cells.search(index, queries, 7, probes)
        assert told(found.select("query_id", "id", "score", "rank")) == told(want)
    assert max(r.probed for r in probed.where("query_id < 900").collect()) < 12
    near, _ = cells.search(index, queries.where("query_id < 900"), 7, 1, exact=False)
    both = {(r.query_id, r.id) for r in near.collect()} & {(r.query_id, r.id) for r in want.collect()}
    assert len(both) >= 0.9 * 7 * 15
    found, _ = cells.search(index, queries.limit(0), 7)
    assert found.count() == 0
    # more neighbours than there are vectors
    found, _ = cells.search(index, queries.where("query_id = 0"), 2000)
    assert found.count() == 902
