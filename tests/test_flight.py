import numpy as np
import pytest
from oracle import SF

from trackwright.functions import flight
from trackwright.plans import QUERIES
from trackwright.session import table


def lands(speed, angle, height, step=4e-3):
    """Time and distance of one throw, with plain loops."""

    def slope(s):
        pull = flight._PULL * (s[2] ** 2 + s[3] ** 2) ** 0.5
        return [s[2], s[3], -pull * s[2], -flight.GRAVITY - pull * s[3]]

    state, time = [0.0, height, speed * np.cos(np.radians(angle)), speed * np.sin(np.radians(angle))], 0.0
    while True:
        k1 = slope(state)
        k2 = slope([x + step / 2 * d for x, d in zip(state, k1, strict=True)])
        k3 = slope([x + step / 2 * d for x, d in zip(state, k2, strict=True)])
        k4 = slope([x + step * d for x, d in zip(state, k3, strict=True)])
        after = [x + step / 6 * (a + 2 * b + 2 * c + d) for x, a, b, c, d in zip(state, k1, k2, k3, k4, strict=True)]
        if after[1] <= 0:
            part = state[1] / (state[1] - after[1])
            return time + part * step, state[0] + part * (after[0] - state[0])
        state, time = after, time + step


def test_launches_land_as_given_or_are_null(spark):
    """Rows without a launch: no flight of 0.1 s goes 20 m from 1.5 m (at 100 m/s at most), and a missing value."""
    rows = [(1.5, 1.0, 20.0), (1.5, 1.49, 29.8), (0.5, 0.8, 12.0), (2.8, 6.0, 30.0), (1.5, 0.1, 20.0), (None, 1.0, 20.0)]
    flights = spark.createDataFrame(rows, "h double, s double, m double")
    got = {(r.h, r.s): r for r in flight.launches(flights, "h", "s", "m").collect()}
    for h, s, m in rows[:4]:
        assert lands(got[h, s].speed_mps, got[h, s].angle_deg, h) == pytest.approx((s, m), abs=1e-4)
    for h, s, _ in rows[4:]:
        assert got[h, s].speed_mps is None
        assert got[h, s].angle_deg is None


def test_query_solves_every_event(spark):
    rows = QUERIES["launch_speeds"](spark, SF).collect()
    assert sorted(r.event_id for r in rows) == sorted(r.event_id for r in table(spark, SF, "events").select("event_id").collect())
    assert all(r.speed_mps is not None for r in rows)
    for r in rows[::100]:
        assert lands(r.speed_mps, r.angle_deg, r.height) == pytest.approx((r.seconds, r.metres), abs=1e-4)
