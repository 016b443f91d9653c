"""From a request to sections and sampled speeds of one or more videos."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import boxes, segments, series
from ..operators.tracking import ball, players, world
from ..operators.tracking.runner import track
from ..session import materialise
from ..sources.detections import send_all

#: Features that a request may name, and those that each needs (fixed values).
FEATURES = {
    "DeadTimeDetection": [],
    "MatchSectioning": ["DeadTimeDetection"],
    "TrackBallSpeed": ["MatchSectioning", "DeadTimeDetection"],
    "TrackPlayerSpeed": ["MatchSectioning", "DeadTimeDetection"],
    "ClassifyShotType": ["MatchSectioning", "DeadTimeDetection"],
}


class RequestError(ValueError):
    pass


def validate(request: dict) -> dict:
    """The request with whole-number video_id; RequestError names what is wrong."""
    problems = []
    try:
        video_id = int(request.get("video_id"))
    except (TypeError, ValueError):
        video_id = None
        problems.append("video_id is not a whole number")
    url = urlparse(str(request.get("video_url", "")))
    if url.scheme not in ("http", "https") or not url.netloc:
        problems.append("video_url is not a url")
    features = request.get("features") or []
    problems += [f"unknown feature {f}" for f in features if f not in FEATURES]
    problems += [f"{f} needs {n}" for f in features if f in FEATURES for n in FEATURES[f] if n not in features]
    if problems:
        raise RequestError("; ".join(problems))
    return {"video_id": video_id, "video_url": request["video_url"], "features": features}


def request_problems(requests: DataFrame) -> DataFrame:
    """requests (video_id, video_url, features) with no_id, no_url, unknown (features) and missing (what the features need)."""
    named = F.coalesce("features", F.array().cast("array<string>"))
    needs = F.create_map(*(x for f, n in FEATURES.items() for x in (F.lit(f), F.array(*map(F.lit, n)).cast("array<string>"))))
    needed = F.array_distinct(F.flatten(F.transform(named, lambda f: F.coalesce(needs[f], F.array().cast("array<string>")))))
    return requests.withColumns({
        "no_id": F.col("video_id").cast("string").try_cast("bigint").isNull(), "no_url": ~F.coalesce(F.col("video_url").rlike("^https?://[^/?#]+"), F.lit(False)),
        "unknown": F.array_except(named, F.array(*map(F.lit, FEATURES))), "missing": F.array_except(needed, named),
    })


@dataclass(frozen=True)
class Analysis:
    facts: DataFrame
    sections: DataFrame
    ball_speeds: DataFrame
    player_speeds: DataFrame
    seconds: dict[str, float]
    #: Rows that each written result has, counted by Spark as it was written.
    rows: dict[str, int] = field(default_factory=dict)


def analyze(detections: DataFrame, videos: DataFrame, homography: tuple[float, ...], court: tuple[tuple[float, float], ...], fps: float = 30.0, step: float = 0.5) -> Analysis:
    """detections: video_id, frame, kind (ball, player), det, x1..y2, conf; videos: video_id, total_frames."""
    began, seconds, rows = perf_counter(), {}, {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        """df written, and its rows observed on the way."""
        seen = Observation(name)
        written = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        rows[name] = seen.get["rows"]
        return written

    spine = videos.select("video_id", F.explode(F.expr("sequence(0L, total_frames - 1)")).alias("frame"))
    of = lambda kind: spine.join(detections.where(F.col("kind") == kind), ["video_id", "frame"], "left")
    balls = track(of("ball"), lambda: ball.BallTracker(ball.BallSettings(homography, court, fps)), ball.SCHEMA).where("is_active")
    persons = track(of("player"), lambda: players.PlayerTracker(players.PlayerSettings(homography)), players.SCHEMA)
    common = ["video_id", "frame", "track_id", "x1", "y1", "x2", "y2"]
    tracked = balls.select(*common, F.lit("ball").alias("kind"), F.lit("ball").alias("label")).unionByName(
        persons.select(*common, F.lit("player").alias("kind"), "label")
    ).withColumn("det", F.col("track_id"))
    tracked = counted(tracked, "tracks")
    moving = track(tracked, lambda: world.WorldSpeed(world.WorldSettings(homography, fps)), world.SCHEMA)
    both = tracked.join(moving.select("video_id", "frame", "kind", "track_id", "kmh"), ["video_id", "frame", "kind", "track_id"], "left")
    x, y = ((F.col("x1") + F.col("x2")) / 2), ((F.col("y1") + F.col("y2")) / 2)
    facts = spine.join(boxes.frame_facts(both.withColumns({"x": x, "y": y})), ["video_id", "frame"], "left")
    facts = counted(facts, "frame-facts")
    seconds["tracking"] = perf_counter() - began

    began = perf_counter()
    sections = segments.rally_sections(facts, F.col("ball_x").isNotNull(), F.col("ball_kmh"), segments.Rally(fps=fps))
    sections = counted(sections, "sections")
    seconds["sections"] = perf_counter() - began

    began = perf_counter()
    ball_speeds = counted(series.smooth_speed(facts, "ball_kmh", fps, step), "ball-speeds")
    one = lambda p: series.smooth_speed(facts, f"{p}_kmh", fps, step, high=16).withColumn("player", F.lit(p))
    player_speeds = counted(one("p1").unionByName(one("p2")), "player-speeds")
    seconds["speeds"] = perf_counter() - began
    return Analysis(facts, sections, ball_speeds, player_speeds, seconds, rows)


def answer(request: dict, load: Callable[[dict], dict], post: Callable[[str, str], int] | None = None) -> Analysis:
    """A whole request: validate, load what analyze needs (a dict of its arguments, from a detector's tables), run, and send the results.

    The three results are sent to sections, ball_speeds and player_speeds; speeds of videos that have none are not sent.
    """
    found = analyze(**load(validate(request)))
    if post:
        ends = ["start_index", "start_time", "end_index", "end_time"]
        for rows, path, columns, order, known in (
            (found.sections, "sections", ends, ["section_idx"], None),
            (found.ball_speeds, "ball_speeds", ["frame", "smooth"], ["frame"], "smooth"),
            (found.player_speeds, "player_speeds", ["player", "frame", "smooth"], ["player", "frame"], "smooth"),
        ):
            began = perf_counter()
            send_all(rows, post, path, columns, order, known).collect()
            found.seconds[f"send {path}"] = perf_counter() - began
    return found


#: Routes of the request interface.
ROUTES: dict[str, Callable] = {"analyze": answer, "validate": validate}


def dispatch(route: str, request: dict, *args, **settings) -> Analysis | dict:
    if route not in ROUTES:
        raise RequestError(f"unsupported task {route}")
    return ROUTES[route](request, *args, **settings)
