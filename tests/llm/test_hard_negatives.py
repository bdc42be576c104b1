"""Hard negatives against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from learnlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, id string, tile int, key binary"


def brute_force(rows, mining, asks):
    """``rows``: (id, label, vector), all usable and of distinct ids."""
    whole = [(i, label, [int(x) for x in np.floor(np.array(v, float) * mining.scale)]) for i, label, v in rows]
    out = []
    for anchor, label, vector in whole:
        if not asks(anchor):
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(vector, v, strict=True)), i, other == label)
            for i, other, v in whole
            if i != anchor and len(v) == len(vector)
        )
        for score, positive, _ in [s for s in scored if s[2]][: mining.positives]:
            inside = [(-s, i) for s, i, same in scored if not same and -30 * score <= -100 * s <= -90 * score]
            for rank, (s, i) in enumerate(inside[: mining.negatives], 1):
                out.append((anchor, positive, rank, i, -score, s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "s", "i", 3, b"k") for i, label, v in rows], SCHEMA)


def random_rows(number, size, seed, step=1 / 256, spread=8):
    random = np.random.default_rng(seed)
    values = random.integers(-spread, spread + 1, (number, size)) * step
    return [(int(i), int(random.integers(0, 3)), v.tolist()) for i, v in enumerate(values)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("spread", [1, 8])  # few different scores: many ties, and scores of zero
def test_negatives_by_brute_force(spark, scratch, seed, spread):
    rows = random_rows(120, 6, seed, spread=spread)
    rows += [(1000 + i, label, v) for i, label, v in rows[:20]]  # copies under other ids
    rows += [(2000 + i, i % 3, [0.5] * 3) for i in range(9)]  # another dimension
    mining = hn.Mining()
    got = hn.mine(table(spark, rows), scratch, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, mining, lambda i: i % 10 == 0)


def test_rows_that_take_no_part(spark, scratch):
    rows = random_rows(30, 4, 3)
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, 1, [1.0] * 4), (100, None, [1.0] * 4), (200, 1, None), (300, 1, [1.0, None, 1.0, 1.0]),
        (400, 1, [nan] * 4), (500, 2, [inf] * 4), (600, 2, []),
    ]
    got = hn.mine(table(spark, rows + odd + rows[:5]), scratch, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, hn.Mining(), lambda i: i % 10 == 0)
    assert hn.mine(table(spark, odd), scratch, F.col("vec_id") >= 0).collect() == []
    assert hn.mine(table(spark, rows).limit(0), scratch, F.col("vec_id") >= 0).collect() == []


def test_of_rows_with_one_id_the_smallest_counts(spark, scratch):
    rows = random_rows(20, 4, 4)
    twice = [(3, rows[3][1] + 1, [9.0] * 4), (10, rows[10][1] + 1, [9.0] * 4)]
    got = hn.mine(table(spark, twice + rows), scratch, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, hn.Mining(), lambda i: i % 5 == 0)


@pytest.mark.parametrize("step", [2.0**30, 2.0**300])
def test_scores_beyond_64_bits_do_not_crash(spark, scratch, step):
    rows = random_rows(40, 4, 5, step=step)
    got = hn.mine(table(spark, rows), scratch, F.col("vec_id") % 10 == 0).collect()
    assert all(-(2**63) <= r["negative_score"] < 2**63 for r in got)


@given(st.lists(st.tuples(*[st.integers(-(2**63), 2**63 - 1)] * 3, st.booleans()), max_size=20))
@settings(max_examples=200, deadline=None)
def test_keys_sort_as_their_rows(rows):
    keys = sorted(hn.packed_key(*row) for row in rows)
    assert [hn.unpacked_key(k) for k in keys] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_results_do_not_depend_on_tiles(spark, scratch):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asks = F.col("vec_id") % 100 == 0
    once = hn.mine(data, scratch, asks).collect()
    tiles = hn.mine(data, scratch, asks, mining=hn.Mining(tile=7)).collect()
    assert sorted(once) == sorted(tiles) and once
