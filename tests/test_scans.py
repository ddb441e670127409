"""Running values in levels against plain loops, and features whose windows take levels."""

import random

import pytest
from pyspark.sql import functions as F

from tremorline.features.registry import efficient, extract_features
from tremorline.operators import scans
from tremorline.operators.filling import fill_gaps
from tremorline.operators.indexing import index_series
from tremorline.operators.rolling import expanding
from tremorline.operators.sampling import every_nth_rolled


def table(spark, rng, size=120):
    rows = []
    for key, share in (("a", 1.0), ("b", 0.4), ("c", 0.02)):
        for n in range(int(size * share)):
            rows.append((key, n, rng.choice([None, rng.randint(-9, 9)]), [rng.randint(0, 9)] * rng.randint(0, 2)))
    return rows, spark.createDataFrame(rows, "k string, n long, v long, l array<long>").repartition(5)


@pytest.mark.parametrize("block", [4096, 50, 7, 2])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_loops(spark, block, exclusive):
    rows, df = table(spark, random.Random(block))
    folds = {how: (F.col("v"), how) for how in ("sum", "min", "max", "last")} | {"gather": (F.col("l"), "gather")}
    got = scans.running(df, ["k"], ["n"], F.col("n"), 120, folds, exclusive, block).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [x for x in rows if x[0] == r.k and (x[1] < r.n or (x[1] == r.n and not exclusive))]
        known = [x[2] for x in seen if x[2] is not None]
        assert (r["sum"], r["min"], r["max"]) == ((sum(known), min(known), max(known)) if known else (None,) * 3)
        assert r["last"] == (known[-1] if known else None)
        assert sorted(r["gather"] or []) == sorted(e for x in seen for e in x[3])


def test_running_without_keys(spark):
    _, df = table(spark, random.Random(1))
    rows = df.filter("k = 'a'").drop("k")
    got = scans.running(rows, [], ["n"], F.col("n"), 120, {"s": (F.lit(1), "sum")}, False, 5).collect()
    assert all(r.s == r.n + 1 for r in got) and len(got) == 120


@pytest.mark.parametrize("block", [4096, 50, 7, 2])
def test_largest_equals_sorting(spark, block):
    rng = random.Random(2)
    rows = [(k, n, float(rng.randint(0, 30))) for k in "ab" for n in range(100 if k == "a" else 9) for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "k string, n long, v double")
    got = scans.running_largest(df, ["k"], "n", 100, "v", 4, block).collect()
    assert len(got) == 109
    for r in got:
        top = sorted((v for k, n, v in rows if k == r.k and n <= r.n), reverse=True)[:4]
        assert [r.m1, r.m2, r.m3, r.m4] == top + [None] * (4 - len(top))


def test_features_do_not_depend_on_levels(make_series, monkeypatch):
    """Windows with step 1, scanned in one level and in four."""
    rng = random.Random(3)
    data = {i: ([rng.gauss(0, 1) for _ in range(n)], [float(rng.randint(0, 3)) for _ in range(n)]) for i, n in ((1, 45), (2, 20))}
    skipped = ("augmented_dickey_fuller", "fft", "friedrich", "max_langevin", "change_quantiles", "cwt")
    names = [n for n in efficient() if not n.startswith(skipped)]

    def found():
        frames = expanding(index_series(make_series(data)), 3, 1)
        rows = extract_features(frames, names).collect()
        sampled = sorted(map(str, every_nth_rolled(frames, 10).drop("time_end").collect()))
        return {(r["id"], r["end"], r["kind"], r["feature"]): r["value"] for r in rows}, sampled

    one, sampled = found()
    monkeypatch.setattr(scans, "BLOCK", 4)
    four, sampled_again = found()
    assert set(one) == set(four) and len(one) == len(names) * 2 * (42 + 17) and sampled == sampled_again
    for key, value in one.items():
        assert four[key] == (value if value is None else pytest.approx(value, rel=1e-6, abs=1e-6)), key


def test_global_fill_in_levels(spark, make_series, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 2)
    monkeypatch.setattr("tremorline.operators.filling.BLOCK_ROWS", 3)
    rng = random.Random(4)
    values = [rng.choice([None, float(i)]) for i in range(60)]
    rows = [(i % 3, i, v, None if i < 50 else 1.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, time long, x double, y double").repartition(4)
    got = {r.time: (r.x, r.y) for r in fill_gaps(df, scope="global").collect()}
    known = None
    for i, v in enumerate(values):
        known = known if v is None else v
        assert got[i] == (known, None if i < 50 else 1.0)
