"""Typed settings: named knobs with defaults, aliases and clamps, read from any mapping (an environment, or a session's conf)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.newsloom."
_TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    feed_entries_limit: int = 10
    max_posts_per_run: int = 1
    item_max_retries: int = 3
    item_retry_minutes: int = 45
    dedup_window_hours: int = 48
    dedup_sim_threshold: float = 0.80
    recent_limit: int = 300
    auto_tags_max: int = 5
    internal_links_max: int = 4
    page_text_chars: int = 15_000
    review_min_sources: int = 5
    review_max_sources: int = 10
    cache_min_verified_points: int = 2
    cache_max_merged_points: int = 6
    cache_max_failed_refreshes: int = 2
    post_status: str = "draft"
    base_url: str = ""
    auto_tags: bool = True
    evidence_cache: bool = True


#: least and most of a knob
BOUNDS = {
    "feed_entries_limit": (1, 100), "max_posts_per_run": (1, 20), "item_max_retries": (0, 10), "item_retry_minutes": (1, 1440), "dedup_window_hours": (1, 720), "dedup_sim_threshold": (0.0, 1.0),
    "recent_limit": (1, 10_000), "auto_tags_max": (0, 5), "internal_links_max": (0, 10), "page_text_chars": (1000, 100_000), "review_min_sources": (1, 20), "review_max_sources": (1, 40),
    "cache_min_verified_points": (1, 6), "cache_max_merged_points": (1, 12), "cache_max_failed_refreshes": (1, 5),
}


def read(values: Mapping[str, str]) -> Settings:
    """Settings of upper-case names; blank and unreadable values leave the default, numbers are clamped to their bounds."""
    found: dict[str, object] = {}
    for f in fields(Settings):
        raw = str(values.get(f.name.upper()) or "").strip()
        if not raw:
            continue
        if isinstance(f.default, bool):
            found[f.name] = raw.lower() in _TRUE
        elif isinstance(f.default, int | float):
            try:
                number = type(f.default)(raw)
            except ValueError:
                continue
            low, high = BOUNDS[f.name]
            found[f.name] = min(max(number, low), high)
        else:
            found[f.name] = raw
    return Settings(**found)


def of_session(spark: SparkSession) -> Settings:
    """Settings of the session's conf, by names like ``spark.newsloom.feed_entries_limit``."""
    return read({f.name.upper(): spark.conf.get(PREFIX + f.name, "") for f in fields(Settings)})


def report(settings: Settings) -> dict[str, str]:
    """What may be logged: every knob as text, none of them secret."""
    return {f.name: str(getattr(settings, f.name)) for f in fields(Settings)}
