"""Recurrence dates that are far apart."""

import datetime

from pyspark.sql import functions as F

from benefica.functions import dates


def test_fifth_weekday_of_february_comes_again(spark):
    rule = {"type": "monthly", "interval": 12, "nth": 5, "weekday": "Sun"}  # 29 February is a Sunday every 28 years
    day = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        dates.next_occurrence(day("2004-02-29"), rule).alias("a"), dates.next_occurrence(day("2088-02-29"), rule).alias("b"),
        *[x.alias(k) for x, k in zip(dates.cycle_range(day("2005-02-01"), rule), "cd")]).first()
    leap = [datetime.date(y, 2, 29) for y in range(2004, 2200) if y % 4 == 0 and y % 100]
    sundays = [d for d in leap if d.weekday() == 6]
    after = lambda s: next(d for d in sundays if d > datetime.date.fromisoformat(s))
    assert (row.a, row.b) == (after("2004-02-29"), after("2088-02-29"))
    assert row.c == after("2005-02-01") and row.d == after(row.c.isoformat()) - datetime.timedelta(1)


def test_recurrence_spreads_a_small_file_over_the_cores(spark):
    from benefica.plans import load

    out = load()["h18_recurrence"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
