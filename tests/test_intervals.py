import random

import pytest

from factloom.operators import intervals

SCHEMA = "g string, start long, end long, gap_from string"


def swept(rows):
    """Gaps and periods by one sweep per group."""
    out_gaps, out_periods, groups = [], [], {}
    for g, s, e, _ in rows:
        s, e = (-10**15 if s is None else s), (10**15 if e is None else e)
        if g is not None and e > s:
            groups.setdefault(g, []).append((s, e))
    for g, spans in groups.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out_gaps += [(g, a[1], b[0]) for a, b in zip(merged, merged[1:])]
        out_periods += [(g, i, None if s == -10**15 else s, None if e == 10**15 else e) for i, (s, e) in enumerate(merged, 1)]
    return sorted(out_gaps), sorted(out_periods, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_groups_match_a_sweep(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in ["a", "b", "c", None]:
        for _ in range(rng.choice([1, 5, 60])):
            s, n = rng.randrange(0, 400_000), rng.choice([-5, 0, 10, 3_000, 90_000])
            rows.append((g, None if rng.random() < 0.03 else s, None if rng.random() < 0.03 else s + n, "x"))
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want_gaps, want_periods = swept(rows)
    assert sorted(map(tuple, intervals.gaps(df, ["g"]).collect())) == want_gaps
    assert sorted(map(tuple, intervals.periods(df, ["g"]).collect()), key=str) == want_periods


def test_touching_nested_and_unbounded(spark):
    rows = [("a", 0, 10, ""), ("a", 10, 20, ""), ("a", 2, 3, ""), ("b", None, 5, ""), ("b", 7, None, ""), ("c", None, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in intervals.gaps(df, ["g"]).collect()] == [("b", 5, 7)]
    assert sorted(map(tuple, intervals.periods(df, ["g"]).collect())) == [("a", 1, 0, 20), ("b", 1, None, 5), ("b", 2, 7, None), ("c", 1, None, None)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert intervals.gaps(df, ["g"]).count() == 0 and intervals.periods(df, ["g"]).count() == 0


def test_overlap_counts_match_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        s, n = rng.randrange(0, 300_000), rng.choice([-1, 0, 1, 90_000, 400])
        rows.append((rng.choice(["a", "a", "b", None]), None if rng.random() < 0.1 else s, None if rng.random() < 0.1 else s + n, str(i)))
    rows += rows[:10]
    inf = 10**15
    spans = [(g, -inf if s is None else s, inf if e is None else e, i) for g, s, e, i in rows]
    spans = [x for x in spans if x[0] is not None and x[2] > x[1]]
    want = sorted((i, sum(g == h and s < f and t < e for h, t, f, _ in spans)) for g, s, e, i in spans)
    got = intervals.overlap_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), ["g"])
    assert sorted((r["gap_from"], r["n_overlapping"]) for r in got.collect()) == want
    assert intervals.overlap_counts(spark.createDataFrame([], SCHEMA), ["g"]).count() == 0
