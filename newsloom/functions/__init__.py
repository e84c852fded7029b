"""Column expressions: no Python code runs on rows here."""

from newsloom.functions.scalars import (
    RANK_DIGITS,
    best_first,
    epoch_micros,
    file_label,
    log_read_score,
    min_max,
    rank_discount,
    truncated_share,
    unit_hash,
    weighted_score,
)
from newsloom.functions.vectors import cosine, dot, l2_normalise, l2_norm

__all__ = [
    "RANK_DIGITS",
    "best_first",
    "cosine",
    "dot",
    "epoch_micros",
    "file_label",
    "l2_norm",
    "l2_normalise",
    "log_read_score",
    "min_max",
    "rank_discount",
    "truncated_share",
    "unit_hash",
    "weighted_score",
]
