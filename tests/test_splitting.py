"""Binomial splitting: totals, ranges, the distribution, and the SQL twin's levels."""

import math

import numpy as np
import pytest

from stampline.functions import splitting as sp
from stampline.operators import resampling as rs


@pytest.mark.parametrize("size", [1, 2, 3, 37, 1000, 4097])
def test_totals_are_exact_and_ranges_agree(size):
    keys = sp.replicate_keys(3, 0, 40)
    whole = sp.Tree(size, keys).counts(0, size)
    assert whole.shape == (size, 40) and (whole.sum(axis=0) == size).all() and (whole >= 0).all()
    tree = sp.Tree(size, keys)
    for lo in range(0, size, max(1, size // 7)):
        hi = min(size, lo + max(1, size // 7) + 3)
        assert (tree.counts(lo, hi) == whole[lo:hi]).all()
    assert (sp.Tree(size, sp.replicate_keys(3, 10, 5)).counts(0, size) == whole[:, 10:15]).all()


def test_counts_are_those_of_draws_with_replacement():
    drawn = sp.Tree(50, sp.replicate_keys(1, 0, 4000)).counts(0, 50)
    mean, cov = drawn.mean(axis=1), np.cov(drawn)
    assert abs(mean - 1).max() < 0.08
    assert abs(np.diag(cov) - (1 - 1 / 50)).max() < 0.12
    off = cov[~np.eye(50, dtype=bool)]
    assert abs(off.mean() + 1 / 50) < 0.002 and abs(off).max() < 0.1
    share = [(drawn == k).mean() for k in range(4)]
    want = [math.comb(50, k) * 0.02 ** k * 0.98 ** (50 - k) for k in range(4)]
    assert share == pytest.approx(want, abs=0.005)


@pytest.mark.parametrize("c,left,size", [(0, 1, 2), (1, 1, 2), (7, 2, 5), (40, 20, 41), (3000, 1, 3)])
def test_shares_invert_the_distribution(c, left, size):
    p = left / size
    u = np.random.default_rng(0).random(500)
    cum = np.cumsum([math.exp(math.lgamma(c + 1) - math.lgamma(k + 1) - math.lgamma(c - k + 1) + k * math.log(p)
                              + (c - k) * math.log(1 - p)) for k in range(c)])
    got = sp.shares(u[None, :], np.full((1, 500), c), left, size)[0]
    assert (got == np.searchsorted(cum, u, "right")).all()


def test_tables_in_pieces(monkeypatch):
    u, c = np.random.default_rng(1).random((30, 20)), np.random.default_rng(2).integers(0, 90, (30, 20))
    want = sp.shares(u, c, 3, 7)
    monkeypatch.setattr(sp, "TABLE", 50)
    assert (sp.shares(u, c, 3, 7) == want).all()


def test_hundred_million_entities_from_any_range():
    size = 10 ** 8
    tree = sp.Tree(size, sp.replicate_keys(5, 0, 20))
    here = tree.counts(77_777_700, 77_777_900)
    assert here.shape == (200, 20) and abs(here.mean() - 1) < 0.1
    assert (tree.counts(77_777_900, 77_777_950) == sp.Tree(size, sp.replicate_keys(5, 0, 20)).counts(77_777_900, 77_777_950)).all()


def test_weights_do_not_depend_on_partitions_or_passes(spark):
    df = spark.range(700).withColumnRenamed("id", "entity")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            draws = rs.entity_draws(df, "entity", 9, 2)
            whole = {r.entity: list(r.w) for r in draws.table.collect()}
            late = {r.entity: list(r.w) for r in draws.part(4, 5).table.collect()}
            assert all(late[e] == [1, *w[5:]] for e, w in whole.items())
            seen.append(whole)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and {len(w) for w in seen[0].values()} == {10}
    assert np.array(list(seen[0].values())).sum(axis=0).tolist() == [700] * 10


def test_no_row_per_draw_and_no_shuffle_in_the_plan(spark):
    draws = rs.entity_draws(spark.range(50).withColumnRenamed("id", "entity"), "entity", 30, 1)
    plan = draws.table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_no_entities(spark):
    none = spark.createDataFrame([], "entity long")
    draws = rs.entity_draws(none, "entity", 3)
    assert draws.n_entities == 0 and draws.table.count() == 0
