"""Columns of contact pairs: names, types, sentinels.  Types follow from names alone."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: The eight standard columns.
STANDARD = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type"]
#: An unmapped side; there are no nulls in pairs.
NO_CHROM, NO_POS, NO_STRAND = "!", 0, "-"
NO_FRAGMENT = (-1, 0, 0)
#: Separators inside a packed sam column; "." stands for no record.
FIELD_SEP, RECORD_SEP, NO_SAM = "\x19", "\x19NEXT_SAM\x19", "."
DUPLICATE = "DD"

# fixed values: columns (base names without the side's digit) that hold integers
INTEGERS = frozenset(
    ["pos", "pos5", "pos3", "mapq", "read_len", "matched_bp", "algn_ref_span", "algn_read_span", "dist_to_5", "dist_to_3", "walk_pair_index", "rfrag", "rfrag_start", "rfrag_end", "AS", "XS", "NM"]
)


def base_name(column: str) -> str:
    """mapq1 -> mapq; names without a side stay."""
    m = re.fullmatch(r"(.*\D|.*[35])([12])", column)
    return m[1] if m and (m[1] in INTEGERS or column not in INTEGERS) else column


def type_of(column: str) -> T.DataType:
    return T.IntegerType() if column in INTEGERS or base_name(column) in INTEGERS else T.StringType()


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, type_of(c)) for c in columns])
