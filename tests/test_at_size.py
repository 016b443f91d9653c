"""What showed on larger tables only, on small ones made for it."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from oracle import rows

from trackwright.functions import flight
from trackwright.functions.homography import TEMPLATE, court_homographies
from trackwright.operators import court_search
from trackwright.operators.folds import each_block, gap_sections, kept_chain
from trackwright.operators.series import lerp_gaps
from trackwright.plans import ORACLES, QUERIES


def compare(spark, path, name, **tables):
    """The query's rows over tables against its SQL's."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.to_parquet(f"{path}/{table}.parquet", index=False, coerce_timestamps="us")
        con.sql(f"create view {table} as select * from read_parquet('{path}/{table}.parquet')")
    got, want = rows(QUERIES[name](spark, str(path)).toPandas()), rows(con.sql(ORACLES[name]).df())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return got


def events(values):
    """One row for each value of each user: values is a list of lists."""
    flat = [(u, v) for u, own in enumerate(values) for v in own]
    n = len(flat)
    return pd.DataFrame({
        "event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(n), unit="s"), "user_id": [u for u, _ in flat],
        "event_type": "view", "value": [v for _, v in flat], "props": "{}",
    })


def test_a_bend_of_just_the_limit_is_one(spark, tmp_path):
    ends = [(191.7, 84.22, 16.57, 339.27, 327.65), (341.15, 64.66, 174.65, 329.39, 287.0), (44.52, 34.7, 80.81, 139.77, 376.81)]
    got = compare(spark, tmp_path, "airborne_flags", events=events([[a, 9.0, b, c, d, 7.0, e] for a, b, c, d, e in ends]))
    assert sum(row[0] for row in got) == len(ends)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def runs_of(spark, videos):
    rows = [(v, i % 2 == 1, 3 * i, 3) for v in range(videos) for i in range(6)]
    return spark.createDataFrame(rows, "video_id bigint, value boolean, first bigint, n bigint")


def test_short_videos_are_folded_without_a_call_for_each(spark):
    lengths = runs_of(spark, 500)
    cuts = lengths.where("value").selectExpr("video_id", "first", "first + n - 1 as until")
    sections, kept = gap_sections(lengths, 4), kept_chain(cuts, "first", "until", 5)
    for found in (sections, kept):
        assert "FlatMapGroupsInPandas" not in plan(found)
    assert Counter((r.start, r.end) for r in sections.collect()) == {(0, 10): 500, (12, None): 500}
    assert Counter(r["first"] for r in kept.collect()) == {9: 500}


def test_blocks_go_on_across_batches():
    rows = pd.DataFrame({"video_id": ["a"] * 3 + ["b"] * 4, "part": [0, 0, 1, 0, 0, 0, 2], "x": range(7)})
    want = [("a", 0, [0, 1]), ("a", 1, [2]), ("b", 0, [3, 4, 5]), ("b", 2, [6])]
    for size in (1, 2, 3, 7):
        assert list(each_block(rows.iloc[i : i + size] for i in range(0, 7, size))) == want
    assert list(each_block(iter([rows.iloc[:0]]))) == []


def test_steps_are_fitted_many_at_once(spark):
    seen = [(v, k, i, float(x) + v, float(y) + 2 * k) for v in range(3) for k in range(4) for i, (x, y) in enumerate(TEMPLATE) if not (v == 2 and i > 3)]
    found = court_homographies(spark.createDataFrame([*seen, (9, 0, 1, 1.0, None)], "video_id bigint, step_idx int, point int, x double, y double"))
    assert "FlatMapGroupsInPandas" not in plan(found)
    got = {(r.video_id, r.step_idx): r for r in found.collect()}
    assert len(got) == 12
    for (v, k), r in got.items():
        if v == 2:
            assert r.h is None and r.error is None
        else:
            assert r.error < 1e-6
            assert np.allclose(r.h, [1, 0, v, 0, 1, 2 * k, 0, 0, 1], atol=1e-6)


def test_each_different_flight_is_solved_once(spark):
    rows = [(i, 1.5, 1.0 + (i % 3) / 10, 20.0 + i % 3) for i in range(300)] + [(300, None, 1.0, 20.0), (301, 1.5, float("nan"), 20.0)]
    found = flight.launches(spark.createDataFrame(rows, "id int, h double, s double, d double"), "h", "s", "d")
    assert found.columns == ["id", "h", "s", "d", "speed_mps", "angle_deg"]
    assert "HashAggregate" in plan(found)
    got = {r.id: (r.speed_mps, r.angle_deg) for r in found.collect()}
    speed, angle = flight.launch(np.full(3, 1.5), np.array([1.0, 1.1, 1.2]), np.array([20.0, 21.0, 22.0]))
    assert len(got) == 302 and all(got[i] == (speed[i % 3], angle[i % 3]) for i in range(300))
    assert got[300] == got[301] == (None, None)


def test_few_hypotheses_are_scored_and_the_best_is_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    lines = np.concatenate([rng.uniform(0, 600, (9, 2, 2)), court_search.MODEL_POINTS[court_search.MODEL_LINES[:4]] * 1.5 + rng.normal(0, 1, (4, 2, 2))])
    scored, whole = [], court_search.scores
    monkeypatch.setattr(court_search, "scores", lambda h, own: scored.append(len(h)) or whole(h, own))
    got = court_search.best_in_block(lines, 0, 10_000)
    seen, model = court_search.pairs(len(lines)), court_search.pairs(len(court_search.MODEL_LINES))
    number = np.arange(len(seen) * len(model))
    ends = lambda of, which: np.swapaxes(of[which], 1, 2).reshape(len(which), 4, 2)
    h = court_search.homographies(ends(court_search.MODEL_POINTS[court_search.MODEL_LINES], model[number // len(seen)]), ends(lines, seen[number % len(seen)]))
    every = whole(h, lines)
    assert (got[0], got[1]) == (every.max(), every.argmax())
    assert (every <= court_search.bounds(h, lines) + 1e-6).all()
    assert sum(scored) < len(number) / 10


def test_two_values_are_filled_in_one_pass(spark):
    rows = [("v", 0, None, 1.0), ("v", 1, 2.0, None), ("v", 2, None, None), ("v", 3, 6.0, 7.0), ("v", 4, None, None)]
    df = spark.createDataFrame(rows, "video_id string, frame bigint, x double, y double")
    assert [(r.x, r.y) for r in lerp_gaps(df, "x", "y").orderBy("frame").collect()] == [(2, 1), (2, 3), (4, 5), (6, 7), (6, 7)]
