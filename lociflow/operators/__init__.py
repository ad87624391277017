"""Operators on pairs: each maps PairsFrames to PairsFrames (or tables); few of them run a job of their own."""

from .coverage import coverage, filter_by_coverage
from .dedup import dedup
from .order import concat, merge, sort
from .rows import flip, mark_duplicates, phase, restrict, sample, split_pairs, split_sam
from .scaling import scaling
from .select import remove_columns, select, subset_chroms
from .stats import by_tile, merge_stats, stats

__all__ = [
    "by_tile", "concat", "coverage", "dedup", "filter_by_coverage", "flip", "mark_duplicates", "merge", "merge_stats", "phase",
    "remove_columns", "restrict", "sample", "scaling", "select", "sort", "split_pairs", "split_sam", "stats", "subset_chroms",
]
