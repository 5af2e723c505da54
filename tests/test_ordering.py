"""Permutations are bijections, and counts without draws are those of draws."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.functions import permute, resampling
from siftwright.operators import curate, metrics


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 10, 16, 17, 99, 100, 101, 1000, 65_537])
def test_every_place_is_taken_once(n):
    for seed in (0, 42):
        got = permute.permuted(np.arange(n), n, seed)
        assert (np.sort(got) == np.arange(n)).all()
    if n > 900:
        assert np.abs(np.corrcoef(np.arange(n), permute.permuted(np.arange(n), n, 42))[0, 1]) < 0.1
        assert (permute.permuted(np.arange(n), n, 42) != permute.permuted(np.arange(n), n, 43)).mean() > 0.9


def test_large_numbers_stay_in_range():
    n = (1 << 61) + 12_345
    a, b = permute.bases(n)
    assert a * b >= n and a < 1 << 31 and b < 1 << 31
    x = np.unique(np.random.default_rng(1).integers(0, n, 10_000))
    got = permute.permuted(x, n, 7)
    assert len(np.unique(got)) == len(x) and got.min() >= 0 and got.max() < n


def test_halves_and_dev_set(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, "x").otherwise("y").alias("lang")).repartition(5)
    placed = curate.dev_by_place(curate.halves_by_place(curate.placed(rows, "id", "lang")), 20).toPandas()
    for lang, part in placed.groupby("lang"):
        assert sorted(part["place"]) == list(range(len(part))) and part["forward"].sum() == len(part) // 2 and (part["part"] == "dev").sum() == 20, lang
    with pytest.raises(Exception, match="not between"):
        spark.range(1).select(permute.shuffled_place(F.lit(9), F.lit(9), 1)).collect()
    assert spark.range(1).select(permute.shuffled_place(F.lit(None), F.lit(9), 1)).first()[0] is None


def test_counts_add_up_and_are_binomial():
    n, resamples = 300, 2000
    counts = np.stack(list(resampling.multiplicities(0, n, np.full(resamples, n), 5)))
    assert (counts.sum(axis=0) == n).all() and counts.min() == 0
    # mean 1, variance 1 - 1/n, and the covariance of two segments -1/n
    assert abs(counts.mean() - 1) < 1e-9 and abs(counts.var(axis=1).mean() - (1 - 1 / n)) < 0.02
    assert abs(np.corrcoef(counts[3], counts[200])[0, 1]) < 0.08 and abs((counts == 0).mean() - (1 - 1 / n) ** n) < 0.01
    u = (np.arange(1000) + 0.5) / 1000
    k = resampling.binomial(u, np.full(1000, 12), 0.25)
    assert abs(k.mean() - 3) < 0.01 and k.max() <= 12 and (np.diff(k) >= 0).all()


def test_blocks_are_bounded():
    assert resampling.block_size(10) == resampling.BLOCK and resampling.block_size(10**10) == -(-(10**10) // 4096)
    draws = resampling.block_draws(1000, 50, 3, 90)
    assert draws.shape == (12, 50) and (draws.sum(axis=0) == 1000).all() and abs(draws[:11].mean() - 90) < 5 and abs(draws[11].mean() - 10) < 3


def test_bootstrap_over_blocks_agrees_with_one_block(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0.05, 1, 4000)
    diffs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, diff double").repartition(6)
    error = values.std() / np.sqrt(len(values)) * 100
    for block in (resampling.BLOCK, 500):
        got = metrics.multinomial_bootstrap(diffs, 400, block=block).first()
        assert got["n"] == 4000 and got["delta"] == pytest.approx(values.mean() * 100)
        assert got["ci_lo"] == pytest.approx(values.mean() * 100 - 1.96 * error, abs=0.5 * error) and got["ci_hi"] == pytest.approx(values.mean() * 100 + 1.96 * error, abs=0.5 * error)
    with pytest.raises(Exception, match="without gaps"):
        metrics.multinomial_bootstrap(diffs.filter("i <> 5"), 10).collect()
