"""Finding columns of sources whose names vary."""

from __future__ import annotations

from pyspark.sql import DataFrame

CANDIDATES = {
    "channel_name": ["channel_name", "title", "name", "display_name"],
    "channel_description": ["channel_description", "description", "about", "bio", "channel_about", "profile_description", "channel_text"],
    "video_id": ["video_id", "id", "video"],
    "video_title": ["video_title", "title", "name"],
    "video_description": ["description", "video_description", "caption", "text", "body"],
    "video_tags": ["tags", "keywords", "video_tags"],
}


def first_existing_column(df: DataFrame, candidates: list[str], override: str | None = None) -> str | None:
    """The first candidate that the frame has, whatever its case; an override must exist."""
    have = {c.lower(): c for c in reversed(df.columns)}
    if override:
        if override.lower() not in have:
            raise ValueError(f"no column {override!r} among {df.columns}")
        return have[override.lower()]
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)
