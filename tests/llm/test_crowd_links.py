"""Links that a crowd of near copies makes in the many buckets it meets in."""

import numpy as np
from pyspark.sql import functions as F

from echograin.llm import minhash


def test_buckets_of_a_crowd_name_the_same_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[:385]], rng.integers(0, 1 << 63, 15, dtype=np.uint64)])) for _ in range(200)]
    ids, sizes, signs = np.arange(200), np.array([len(x) for x in sets]), minhash.signatures(minhash.minima(sets))
    links = set()
    for _ in range(minhash.BANDS):
        some = np.sort(rng.permutation(200)[:60])
        found, passed = minhash.lead(ids[some], sizes[some], signs[some])
        assert passed  # the rest is left to the second pass
        ends = {x for pair in found for x in pair}
        assert ends == set(some.tolist())
        links |= {tuple(sorted(pair)) for pair in found}
    assert len(links) < 10 * len(ids)


def test_components_are_merged_by_further_links(spark):
    found = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (9, 2), (5, 5), (6, 5)], "id long, component long")
    more = spark.createDataFrame([(4, 9), (6, 7), (8, 30)], "a long, b long")
    got = minhash._merged(found, more).select("id", F.col("component")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (4, 1), (5, 5), (6, 5), (7, 5), (8, 8), (9, 1), (30, 8)]
