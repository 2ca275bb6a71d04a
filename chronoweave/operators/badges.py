"""Badges: streaks of activity, scored from the result of a fixed list of operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.model import DAY, SECOND, span
from chronoweave.plans.spec import Op


class BadgeError(ValueError):
    """Not worth another try."""


def within(name: str, source: str, window: str = "24h") -> Op:
    return Op(id=name, op="HasExistedWithin", source=source, equals="true", params={"window": window})


def longest(of: str) -> Op:
    return Op(id="result", op="LongestConsecutiveTrueDuration", params={"sourceOperationId": of})


@dataclass(frozen=True)
class Badge:
    ops: tuple[Op, ...]
    required_ns: int


# The badges' operations and thresholds. The streak maintainer asks for Not, which never gives true time,
# so it can't be earned as it stands; the weekend warrior's window is four weeks in hours.
BADGES = {
    "streak_maintainer": Badge(
        (
            Op(id="paid", op="HasExisted", source="payment_successful", equals="true"),
            Op(id="not_due", op="Not", of=Op(id="due", op="HasExisted", source="payment_due", equals="true")),
            Op(id="streak", op="AND", condition_all=("paid", "not_due")),
            longest("streak"),
        ),
        14 * DAY,
    ),
    "daily_engagement": Badge((within("open", "app_open"), within("interact", "user_interaction"), within("view", "content_view"), Op(id="daily", op="OR", condition_any=("open", "interact", "view")), longest("daily")), 7 * DAY),
    "topic_dominator": Badge((within("liked", "comment_liked"), within("replied", "comment_replied"), Op(id="active", op="OR", condition_any=("liked", "replied")), longest("active")), 3 * DAY),
    "feature_pioneer": Badge((within("used", "new_feature_used"), within("again", "new_feature_used"), Op(id="both", op="AND", condition_all=("used", "again")), longest("both")), 3 * DAY),
    "weekend_warrior": Badge((within("weekend", "weekend_activity", "672h"), longest("weekend")), 28 * DAY),
}


def validate(user_id: str, badge: str, start_ns: int, end_ns: int) -> None:
    if not user_id:
        raise BadgeError("user id is required")
    if not badge:
        raise BadgeError("badge type is required")
    if not start_ns:
        raise BadgeError("start time is required")
    if end_ns < start_ns:
        raise BadgeError("end time is before start time")


def score(results: DataFrame, required_ns: int) -> DataFrame:
    """Rows (timeline_id, value in seconds) to user_id, result, progress and earned."""
    need = required_ns / SECOND
    return results.select(F.col("timeline_id").alias("user_id"), F.col("value").alias("result"), F.least(F.lit(1.0), F.col("value") / need).alias("progress"), (F.col("value") >= need).alias("earned"))


def score_numeric(results: DataFrame, required_ns: int) -> DataFrame:
    """A numeric timeline is scored by its longest interval."""
    best = results.groupBy("timeline_id").agg((F.max(span(F.col("start_ns"), F.col("end_ns"))) / SECOND).alias("value"))
    return score(best, required_ns)


def evaluate(events: DataFrame, badge: str, now_ns: int | None = None) -> DataFrame:
    """The badge for every timeline (user) of events: user_id, badge_type, earned, progress, result, and with now_ns earned_at_ns (null unless earned)."""
    from chronoweave.plans.planner import Planner

    if badge not in BADGES:
        raise BadgeError(f"unknown badge type: {badge}")
    b = BADGES[badge]
    track = Planner(events).run(b.ops).track
    scored = score_numeric(track.df, b.required_ns) if track.kind == "numeric" else score(track.df, b.required_ns)
    at = [F.when(F.col("earned"), F.lit(now_ns)).cast("long").alias("earned_at_ns")] if now_ns is not None else []
    return scored.select("user_id", F.lit(badge).alias("badge_type"), "earned", "progress", "result", *at)
