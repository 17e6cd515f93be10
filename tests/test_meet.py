"""Intervals of all widths meet in one join."""

import random

from assaylake.operators import intervals


def test_meet_is_one_join(spark):
    rng = random.Random(8)

    def some(n, widths):
        out = []
        for i in range(n):
            start = rng.randrange(-3000, 5000)
            out.append((i, "xy"[rng.random() < 0.3], start, start + rng.choice(widths)))
        return out

    for one, two in (([0, 3, 9], [0, 7]), ([1, 10, 90, 700, 6000], [2, 50, 90, 4000, 1 << 40]), ([5], [600, 5000]), ([600, 5000], [5])):
        a, b = some(70, one), some(60, two)
        x, y = (spark.createDataFrame(t, "k long, c string, start long, end long").coalesce(1) for t in (a, b))
        for touch in (True, False):
            met = intervals.meet(x, y, ["c"], 8, touch)
            over = (lambda p, q: p <= q) if touch else (lambda p, q: p < q)
            want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and over(p[2], q[3]) and over(q[2], p[3]))
            assert sorted((r.a.k, r.b.k) for r in met.collect()) == want
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (") == 1 and "Union" not in plan and plan.count("Generate explode(sequence") == 2
