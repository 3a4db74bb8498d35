import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.dominance import dominance, levels, sale_points, slots, unfold


def brute(points):
    """(n, w) above each (slot, level, weight), by comparing all pairs in blocks of one point against all."""
    known = np.array([p for p in points if p[0] is not None and p[1] is not None], np.int64).reshape(-1, 3)
    out = []
    for s, v, _ in points:
        if s is None or v is None:
            out.append((None, None))
        else:
            over = (known[:, 0] < s) & (known[:, 1] > v)
            out.append((int(over.sum()), int(known[over, 2].sum())))
    return out


def check(spark, points, **options):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i long, slot long, level long, weight long").repartition(3)
    got = sorted((r.i, r.n_above, r.w_above) for r in dominance(df, **options).collect())
    assert got == [(i, *a) for i, a in enumerate(brute(points))]


def test_sales(spark, sf_dir):
    rows = sale_points(spark.read.parquet(f"{sf_dir}/sales.parquet"))
    points = [(r.slot, r.level, r.weight) for r in rows.orderBy("sale_id").collect()]
    got = [(r.n_above, r.w_above) for r in dominance(rows).orderBy("sale_id").collect()]
    assert got == brute(points)


def test_points_of_a_sale(spark, sf_dir):
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    told = {r.sale_id: r for r in sales.collect()}
    got = {r.sale_id: r for r in sale_points(sales).collect()}
    assert set(got) == set(told)
    for i, r in told.items():
        assert got[i].weight == 1 + zlib.crc32(str(i).encode()) % 5
        assert got[i].slot == (None if r.sold_at is None else (r.sold_at - datetime(1970, 1, 1)) // timedelta(minutes=1))
        assert got[i].level == (None if r.total is None else int(np.floor(100 * r.total + 0.5)))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_slots_do_not_depend_on_the_zone(spark, zone):
    # 2:30 on that day does not exist in New York.
    rows = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:59.9' AS a, timestamp_ntz'1969-12-31 23:59:59' AS b, timestamp'2024-03-10 02:30:59Z' AS c, cast(null AS timestamp_ntz) AS d")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = rows.select(*(slots(F.col(c), rows.schema[c].dataType).cast("long").alias(c) for c in "abcd")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    minute = (datetime(2024, 3, 10, 2, 30) - datetime(1970, 1, 1)) // timedelta(minutes=1)
    assert tuple(got) == (minute, -1, minute, None)


def test_levels(spark):
    rows = spark.createDataFrame([(0.005,), (1.25,), (-0.011,), (None,), (float("nan"),)], "v double")
    assert [r.x for r in rows.select(levels(F.col("v")).alias("x")).collect()] == [1, 125, -1, None, None]


@pytest.mark.parametrize("band,rows_a_task", [(9, 1 << 17), (2, 50), (3, 7), (1, 1000)])
def test_random_points(spark, band, rows_a_task):
    rng = np.random.default_rng(band)
    points = [(int(s), int(v), int(w)) for s, v, w in zip(rng.integers(-40, 200, 600), rng.integers(0, 50, 600), rng.integers(1, 6, 600))]
    points += [(None, 5, 1), (7, None, 1), (None, None, 1)] + [points[0]] * 40
    check(spark, points, band=band, rows_a_task=rows_a_task)


def test_one_slot_holds_a_third_and_one_level_another(spark):
    rng = np.random.default_rng(3)
    points = [(100, int(v), 2) for v in rng.integers(0, 400, 300)] + [(int(s), 200, 3) for s in rng.integers(0, 400, 300)]
    points += [(int(s), int(v), 1) for s, v in rng.integers(0, 400, (300, 2))] + [(100, 200, 5)] * 100
    check(spark, points, band=4, rows_a_task=60)


def test_few_rows_and_far_slots(spark):
    check(spark, [(5, 5, 1)])
    check(spark, [(5, 5, 1), (5, 6, 1), (6, 5, 4), (6, 6, 1)])
    check(spark, [(-(10**9), 9, 1), (0, 8, 2), (10**9, 7, 3), (10**9, 10, 3)])


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "slot long, level long, weight long")
    assert dominance(df).count() == 0
    df = spark.createDataFrame([(1, 5, 1), (2, 3, 1)], "slot long, level long, weight long")
    df = df.selectExpr("*", *(f"'x' AS `{c}`" for c in ("n", "w", "s", "band", "task", "child", "row", "kind", "a.b")))
    out = dominance(df)
    assert out.columns == df.columns + ["n_above", "w_above"]
    assert sorted((r.slot, r.n_above, r.w_above, r["a.b"]) for r in out.collect()) == [(1, 0, 0, "x"), (2, 1, 1, "x")]


def test_unfold_counts_inside_a_head():
    rng = np.random.default_rng(0)
    place, level, n = rng.integers(0, 256, 500), rng.integers(0, 20, 500), rng.integers(1, 4, 500)
    order = np.lexsort((-place, -level, place >> 4))
    place, level, n = place[order], level[order], n[order]
    got, _ = unfold(place, 4, n, n)
    for i in range(500):
        own = (place >> 4 == place[i] >> 4) & (place < place[i]) & (level > level[i])
        assert got[i] == n[own].sum()


def test_many_ranges_give_what_few_give(spark):
    df = spark.range(60_000).selectExpr("pmod(xxhash64(id), 5000) AS slot", "pmod(xxhash64(id, 'l'), 3000) AS level", "1L AS weight")
    sums = dominance(df, rows_a_task=4_000)
    assert sums.agg(F.sum("n_above")).first()[0] == dominance(df).agg(F.sum("n_above")).first()[0]
