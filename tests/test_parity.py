"""Counts of multiset differences, and matches of frames dealt to many tasks."""

import re
from collections import Counter

from framestride.operators import lookup
from framestride.plans import catalogue

FRAMES = "episode_index bigint, frame_index bigint, timestamp double"


def test_only_counts_both_differences_in_one_pass(spark):
    a = [(1, "x"), (1, "x"), (1, "x"), (2, "y"), (None, "z"), (None, "z"), (4, None)]
    b = [(1, "x"), (2, "y"), (2, "y"), (None, "z"), (5, None), (6, "w")]
    da, db = (spark.createDataFrame(r, "k bigint, v string") for r in (a, b))
    found = catalogue._only(da, db, "k", "p", "q")
    less = lambda x, y: sum((Counter(x) - Counter(y)).values())
    assert tuple(found.first()) == (less(a, b), less(b, a)) == (da.exceptAll(db).count(), db.exceptAll(da).count())
    assert tuple(catalogue._only(da.limit(0), db.limit(0), "k", "p", "q").first()) == (0, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("LogicalRDD|LocalRelation", plan)) == 2  # each side is computed once


def test_matches_of_many_frames_are_dealt_to_more_tasks(spark, monkeypatch):
    rows = [(e, f, float(f)) for e in range(6) for f in range(5) for _ in range(1 + (e * f) % 3)] + [(None, 1, 0.5), (1, None, 0.5)]
    frames = spark.createDataFrame(rows, FRAMES)
    asked = spark.createDataFrame([(e, f) for e in range(7) for f in range(6)] * 2 + [(None, 1)], "episode_index bigint, frame_index bigint")
    want = sorted(map(tuple, lookup.matches(asked, frames).collect()), key=str)
    monkeypatch.setattr(lookup, "TASK_ROWS", 5)
    dealt = lookup.matches(asked, frames, len(rows))
    assert sorted(map(tuple, dealt.collect()), key=str) == want and len(want) == 43
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    pieces = -(-len(rows) // 5)
    assert pieces > 4 and len(re.findall(rf"hashpartitioning\([^()]*, {pieces}\)", plan)) >= 2 and "BroadcastHashJoin" not in plan
    counted = Counter(r[:2] for r in rows)
    assert {r[:2]: r[3] for r in want if r[0] is not None} == {(e, f): counted[(e, f)] for e in range(7) for f in range(6)}
