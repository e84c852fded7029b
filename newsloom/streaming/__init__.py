"""Incremental forms of the recency buffer, of the click counts and of the popularity counts."""

from newsloom.streaming.click_counts import ClickCounts
from newsloom.streaming.last_rows import current_buffers, last_rows, run_to_versions, shard_buffers
from newsloom.streaming.popularity_state import PopularityState

__all__ = ["ClickCounts", "PopularityState", "current_buffers", "last_rows", "run_to_versions", "shard_buffers"]
