"""Readers and writers: text, gzip, Parquet, Arrow streams, SAM."""

from .pairs import open_pairs, write_pairs

__all__ = ["open_pairs", "write_pairs"]
