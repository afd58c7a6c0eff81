"""As-of joins against plain loops."""

import datetime as dt
import random

from corpusmill.operators.asof import as_of, cutoffs_as_of


def test_as_of_equals_plain_loops_with_a_hot_key(spark):
    rng = random.Random(1)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    keys = ["hot"] * 6 + ["a", "b", None, "only rows"]
    rows = [(i, rng.choice(keys), rng.choice([None, *range(200)])) for i in range(1500)] + [(7, "hot", 5), (7, "hot", 5)]
    history = [(k, t, rng.randrange(1000)) for k, t in {(rng.choice(["hot", "hot", "b", "c"]), rng.randrange(0, 200, 9)) for _ in range(60)}] + [(None, 3, 1), ("a", None, 2), ("b", 50, 1), ("b", 50, 99999)]
    r = spark.createDataFrame(rows, "id long, k string, t int")
    h = spark.createDataFrame(history, "k string, since int, value long").repartition(3)
    got = sorted(((x.id, x.k, x.t, x.found.value if x.found else None) for x in as_of(r, h, ["k"], "t", "since", "value").collect()), key=repr)
    want = []
    for i, k, t in rows:
        near = [(s, str(v), v) for kk, s, v in history if k is not None and kk == k and s is not None and t is not None and s <= t]
        want.append((i, k, t, max(near)[2] if near else None))
    assert got == sorted(want, key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert as_of(r.limit(0), h, ["k"], "t", "since").count() == 0 and as_of(r, h.limit(0), ["k"], "t", "since").where("found is not null").count() == 0


def test_cutoffs_as_of(spark):
    d = dt.date
    h = spark.createDataFrame([("final", "EB-2", "all", d(2026, 5, 1), "2020-01-01"), ("final", "EB-2", "all", d(2026, 7, 1), "C"), ("final", "EB-2", "india", d(2026, 5, 1), "U")], "chart string, category string, area string, month date, cell string")
    asked = [(1, "all", d(2026, 4, 30)), (2, "all", d(2026, 5, 31)), (3, "all", d(2026, 6, 1)), (4, "all", d(2026, 7, 9)), (5, "india", d(2026, 5, 2)), (6, "china", d(2026, 5, 2))]
    a = spark.createDataFrame([(i, "final", "EB-2", area, on, d(2019, 1, 1)) for i, area, on in asked], "id long, chart string, category string, area string, on date, priority date")
    got = {r.id: (r.month, r.cell, r.timing, r.status) for r in cutoffs_as_of(a, h).collect()}
    assert got == {
        1: (None, None, "none", "UNCONFIRMED"), 2: (d(2026, 5, 1), "2020-01-01", "current", "CURRENT"), 3: (d(2026, 5, 1), "2020-01-01", "stale", "CURRENT"),
        4: (d(2026, 7, 1), "C", "current", "CURRENT"), 5: (d(2026, 5, 1), "U", "current", "NOT CURRENT"), 6: (None, None, "none", "UNCONFIRMED"),
    }
