"""Pairs files.

The format follows the extension: .parquet/.pq, .arrow/.ipc, otherwise tab-separated text
(.gz and .bz2 through Spark's codecs).  The header travels as metadata of the first column
and as a sidecar `_pairs_header.json` in a Parquet directory; headers that other programs
put in a Parquet footer (key pairs_header, a JSON list) are read as well.

rid is the row's place: (file number << 40) + number within the file.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame
from ..schema import type_of

SIDECAR = "_pairs_header.json"
_FILE = 1 << 40


def format_of(path: str) -> str:
    name = path.lower()
    return "parquet" if name.endswith((".parquet", ".pq")) else "arrow" if name.endswith((".arrow", ".ipc")) else "text"


def expand(paths: list[str]) -> list[str]:
    """Wildcards, sorted; a pattern without match stays, for the reader to report."""
    return [f for p in paths for f in (sorted(glob.glob(p)) or [p])]


def read_header(path: str) -> list[str]:
    """Header lines of a file on a file system that the driver sees; no row is read."""
    kind = format_of(path)
    if kind == "parquet":
        side = os.path.join(path, SIDECAR)
        if os.path.isdir(path):
            if os.path.exists(side):
                with open(side, encoding="utf-8") as f:
                    return json.load(f)
            path = min(glob.glob(os.path.join(path, "*.parquet")))
        import pyarrow.parquet as pq

        schema = pq.read_schema(path)
        return _from_metadata(schema.metadata or {}, schema.names)
    if kind == "arrow":
        import pyarrow as pa

        schema = pa.ipc.open_stream(path).schema
        return _from_metadata(schema.metadata or {}, schema.names)
    opener = gzip.open if path.endswith(".gz") else bz2.open if path.endswith(".bz2") else open
    out = []
    with opener(path, "rt", encoding="utf-8", newline="\n") as f:
        for line in f:
            if not line.startswith("#") or out and out[-1].startswith("#columns:"):
                break
            out.append(line.rstrip("\n"))
    return out


def _from_metadata(meta: dict[bytes, bytes], names: list[str]) -> list[str]:
    if b"pairs_header" in meta:
        return json.loads(meta[b"pairs_header"])
    keep = {k.decode(): v.decode("utf-8", "replace") for k, v in meta.items()}
    return H.make(names, assembly=keep.get("genome_assembly")) if not keep.get("columns") else H.make(keep["columns"].split())


def _typed(line: Column, names: list[str]) -> list[Column]:
    parts = F.split(line, "\t", -1)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).cast(type_of(n)).alias(n) for i, n in enumerate(names)]


def parse_lines(lines: DataFrame, names: list[str], value: str = "value", keep: list[str] = ()) -> DataFrame:
    """Columns of tab-separated lines: nothing is quoted, empty fields stay empty, no nulls."""
    return lines.select(*_typed(F.col(value), names), *keep)


def read_text(spark: SparkSession, path: str, names: list[str] | None = None, header: list[str] | None = None) -> PairsFrame:
    """A text file with its rows numbered in file order, over all splits of it."""
    head = read_header(path) if header is None else header
    names = names or H.columns(head)
    if not names:
        raise ValueError("the header has no #columns line")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    # a split's first id and its number of lines: one small row per split
    splits = lines.groupBy("_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("_b").alias("_s"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = lines.join(splits, F.col("_b") == F.col("_s")).withColumn("rid", F.col("_m") - F.col("_first") + F.col("_before") - len(head))
    return PairsFrame(parse_lines(rows.where("rid >= 0"), names, keep=["rid"]), H.set_columns(head, names), "rid")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> PairsFrame:
    df = spark.read.parquet(path)
    names = [c for c in df.columns if columns is None or c in columns]
    meta = df.schema[0].metadata.get("pairs_header")
    head = json.loads(meta) if meta else read_header(path)
    files = sorted(df.inputFiles())
    number = F.lit(0) if len(files) == 1 else F.array_position(F.array(*map(F.lit, files)), F.col("_metadata.file_path")) - 1
    rid = number.cast("long") * _FILE + F.col("_metadata.row_index")
    return PairsFrame(df.select(*names, rid.alias("rid")), H.set_columns(head, names), "rid")


def read_arrow(spark: SparkSession, path: str) -> PairsFrame:
    """An Arrow stream, record batch by record batch on the driver: for exchange, not for bulk."""
    import pyarrow as pa

    with pa.ipc.open_stream(path) as reader:
        head, table = _from_metadata(reader.schema.metadata or {}, reader.schema.names), reader.read_all()
    table = table.append_column("rid", pa.array(range(table.num_rows), pa.int64())).replace_schema_metadata(None)
    return PairsFrame(spark.createDataFrame(table), head, "rid")


def open_pairs(spark: SparkSession, path: str, columns: list[str] | None = None) -> PairsFrame:
    kind = format_of(path)
    if kind == "parquet":
        return read_parquet(spark, path, columns)
    return read_arrow(spark, path) if kind == "arrow" else read_text(spark, path)


def to_lines(pairs: PairsFrame) -> DataFrame:
    return pairs.df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in pairs.columns]).alias("value"))


def write_pairs(pairs: PairsFrame, path: str, single: bool = True, mode: str = "overwrite") -> None:
    """Write in the format of the extension.

    Text: with single, one file with its header, made of the sorted parts one after the
    other; otherwise a directory of headerless parts with the header beside them."""
    head = H.set_columns(pairs.header, pairs.columns)
    kind = format_of(path)
    if kind == "parquet":
        first = pairs.columns[0]
        df = pairs.df.select(*pairs.columns).withMetadata(first, {"pairs_header": json.dumps(head)})
        df.write.mode(mode).parquet(path)
        if "://" not in path:
            with open(os.path.join(path, SIDECAR), "w", encoding="utf-8") as f:
                json.dump(head, f)
    elif kind == "arrow":
        import pyarrow as pa

        table = pairs.df.select(*pairs.columns).toArrow().replace_schema_metadata({"pairs_header": json.dumps(head)})
        with pa.ipc.new_stream(path, table.schema) as out:
            out.write_table(table)
    elif not single:
        to_lines(pairs).write.mode(mode).text(path)
        with open(os.path.join(path, SIDECAR), "w", encoding="utf-8") as f:
            json.dump(head, f)
    else:
        opener = gzip.open if path.endswith(".gz") else bz2.open if path.endswith(".bz2") else open
        with opener(path, "wt", encoding="utf-8", newline="\n") as f:
            f.writelines(x + "\n" for x in head)
            f.writelines(r.value + "\n" for r in to_lines(pairs).toLocalIterator(prefetchPartitions=True))


def export_parquet(pairs: PairsFrame, path: str) -> None:
    """One Parquet file with the header in its footer, partition by partition: for other programs."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    head = H.set_columns(pairs.header, pairs.columns)
    schema = pa.schema([(c, pa.int32() if type_of(c).simpleString() == "int" else pa.string()) for c in pairs.columns], metadata={"pairs_header": json.dumps(head)})
    with pq.ParquetWriter(path, schema, compression="snappy") as out:
        rows = []
        for r in pairs.df.select(*pairs.columns).toLocalIterator(prefetchPartitions=True):
            rows.append(r.asDict())
            if len(rows) >= 100_000:
                out.write_table(pa.Table.from_pylist(rows, schema=schema))
                rows = []
        out.write_table(pa.Table.from_pylist(rows, schema=schema))


def transfer_header(pairs: PairsFrame, header: list[str]) -> PairsFrame:
    """Another file's header on these rows; its columns must be as many, and name them."""
    names = H.columns(header)
    if names is None or len(names) != len(pairs.columns):
        raise ValueError("the header's columns do not fit")
    return set_columns(pairs, names, header)


def set_columns(pairs: PairsFrame, names: list[str], header: list[str] | None = None) -> PairsFrame:
    """Rename columns by position; types follow the new names."""
    if len(names) != len(pairs.columns):
        raise ValueError(f"{len(names)} names for {len(pairs.columns)} columns")
    cols = [F.col(f"`{o}`").cast(type_of(n)).alias(n) for o, n in zip(pairs.columns, names)]
    df = pairs.df.select(*cols, *([pairs.rid] if pairs.rid else []))
    return pairs.with_df(df, H.set_columns(pairs.header if header is None else header, names))
