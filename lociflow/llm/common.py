"""What the operators share: tables in the cluster's folder, connected components, hot-key blocks.

Nothing here collects rows of the corpus.  Intermediate results go, as Parquet, to the
folder of ``spark.checkpoint.dir`` (all executors see it), so a lost executor costs the
re-run of its tasks only.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the session names none and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lociflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lociflow_path = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the tables written inside go when each is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by shared_table that nothing reads any more."""
    path = getattr(df, "_lociflow_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def memory_freed() -> None:
    """Give what Python has freed back to the system, where its allocator can (glibc)."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold_of(doc_id, folds: int):
    """crc32 of the id's decimal text modulo folds (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def by_place(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """docs with columns named c0, c1 ... by place, and the new names of the used ones.

    So operators that add columns of their own work whatever the others are called."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(u)}" for u in used]


def map_text(base: DataFrame, text: str, compute, added: str, drop_text: bool = True, rows: int = 512) -> DataFrame:
    """base with further columns computed from its text column.

    compute(list of texts) returns one list or array per column of `added` (a DDL schema).
    All other columns pass by as Arrow data untouched, whatever they hold; names may clash."""
    names = base.columns
    flat = base.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)
    new = T.StructType.fromDDL(added)
    keep = [i for i in range(len(names)) if not (drop_text and i == at)]
    schema = T.StructType([flat.schema[i] for i in keep] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new)])
    kinds = [to_arrow_type(f.dataType) for f in new]
    labels = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                got = compute(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in keep] + [pa.array(c, k) for c, k in zip(got, kinds)], names=labels
                )

    return flat.mapInArrow(run, schema).toDF(*[names[i] for i in keep], *new.names)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component), component = smallest id.

    Alternating large-star and small-star rounds; each round is two pre-aggregated minima
    and two joins, so no vertex's neighbours are ever gathered in one task.  Every round's
    edges are a shared table.  Isolated ids do not appear; loops and null ends are ignored.
    """
    cur = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    cur, seen = shared_table(cur, "edges"), None
    while True:
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a vertex hands its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = shared_table(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(cur)
        cur = new
    tops = cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with through pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def pair_blocks(rows: DataFrame, key: str, ident: str, limit: int, weight: str | None = None) -> DataFrame:
    """Deal the rows of each key into blocks so that any two rows of a key meet in one group.

    Keys of up to ``limit`` rows are one group.  A larger key is cut into
    ceil(rows / limit) blocks by the hash of ``ident``; each pair of blocks is a group of
    its own, so no group holds more than about two blocks.  Adds lo, hi (the group within
    the key) and blk (the row's block): rows of a group with lo < hi need comparing only
    across its blocks.  With ``weight``, a column's sum takes the place of the number of
    rows.  Only the large keys are joined to the rows; their table is
    written first, so Spark knows its size and broadcasts it or not.
    """
    n = rows.groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("_n")).where(F.col("_n") > limit)
    hot = shared_table(n.withColumn("_b", F.ceil(F.col("_n") / limit).cast("int")).select(key, "_b"), "hot-keys")
    cut = rows.join(hot, key, "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
    cut = cut.withColumn("blk", F.pmod(F.xxhash64(ident), F.col("_b")).cast("int"))
    return (
        cut.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("lo", F.least("blk", "_j"))
        .withColumn("hi", F.greatest("blk", "_j"))
        .drop("_b", "_j")
    )


def whole_groups(links):
    """For mapInPandas over rows sorted by group: calls links with whole groups, several at a time."""

    def run(batches):
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["group"].to_numpy() == pdf["group"].iat[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield links(pdf.iloc[:cut].reset_index(drop=True))
        if rest is not None and len(rest) > 1:
            yield links(rest)

    return run
