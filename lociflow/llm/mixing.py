"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key scaled by its quality weight, key = -ln(u) / w with
u from the md5 of seed and id, so reruns agree.  A source's target is met by complete
epochs of all its documents first; the words left over go to the documents with the
smallest keys, until the prefix sum of their sizes reaches the budget (the document at
the edge gives only the words still needed).

Scale: keys are mapped, in order, to bins; only counts per (source, bin) are gathered, and
only the documents of the one bin in which a source's budget ends are ever sorted.  A
source that holds a third of all rows costs no more than the others.

Defined results: null or empty texts have size 0 and give no words; a null source is a
source of its own (last in order); null ids draw the key of the empty id; equal keys are
ordered by id, then text hash; rows that repeat are documents of their own, so equal rows
may share the place at the edge: they then give the same number of words each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, by_place, shared_table

BINS = 4096
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column) -> Column:
    """From 0.25 to 1: short documents are drawn more seldom."""
    return F.lit(0.25) + F.lit(0.75) * F.least(size, F.lit(200)).cast("double") / F.lit(200.0)


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, share: float = 1.5, weights=WEIGHTS, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): share of all words dealt by weight, no target above
    most * source_size; what is above goes to the others by weight until none is above.

    Sources that fill up do so in the order of most * size / weight, so the level at which
    the rest stand comes from one ordered pass over the sources (one row each)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long"))
    full = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("w_after", F.sum("w").over(after))
    s = s.withColumn("place", F.row_number().over(full))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    # if this source and those after it share what the fuller ones leave
    level = (F.lit(share) * F.col("total") - F.lit(most) * F.col("size_before")) / F.col("w_after")
    s = s.withColumn("level", level)
    fits = F.col("level") * F.col("w") <= F.lit(most) * F.col("source_size")
    s = s.withColumn("first", F.min(F.when(fits, F.struct("place", "level"))).over(Window.partitionBy()))
    target = F.least(F.coalesce(F.col("first.level") * F.col("w"), F.lit(most) * F.col("source_size")), F.lit(most) * F.col("source_size"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, most: float = 2.0, seed: int = 1, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken (words, repeats counted),
    epochs (complete passes) and part (words beyond them)."""
    size = word_count(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("_h"))
    base = shared_table(base, "mix-sizes")
    key = sampling_key(F.col("_id"), quality_weight(F.col("size")), seed)
    keyed = base.withColumn("_key", key).withColumn("_bin", F.floor(F.lit(float(BINS)) * F.col("_key") / (F.col("_key") + 1.0)))
    bins = shared_table(keyed.groupBy("source", "_bin").agg(F.sum("size").alias("words")), "mix-bins")
    goal = shared_table(targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights, most), "mix-targets")
    same = bins.alias("b").join(goal.alias("g"), F.expr("b.source <=> g.source")).select("b.*", "g.source_size", "g.target")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    same = same.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("before", F.coalesce(upto, F.lit(0)))
    edge = same.where("before < left and before + words >= left").select(
        F.col("source").alias("s"), F.col("_bin").alias("edge_bin"), (F.col("left") - F.col("before")).alias("edge_words")
    )
    plan = goal.alias("g").join(edge.alias("e"), F.expr("g.source <=> e.s"), "left")
    plan = plan.withColumn("epochs", epochs).select("source", "source_size", "target", "epochs", F.coalesce("edge_bin", F.lit(-1)).alias("edge_bin"), F.coalesce("edge_words", F.lit(0)).alias("edge_words"))
    plan = shared_table(plan, "mix-plan")  # of known size: one row per source
    rows = keyed.alias("k").join(plan.alias("p"), F.expr("k.source <=> p.source")).select("k.*", "p.source_size", "p.target", "p.epochs", "p.edge_bin", "p.edge_words")
    out = ["_id", "source", "_h", "size", "source_size", "target", "epochs"]
    sure = rows.where("_bin <> edge_bin").select(*out, F.when(F.expr("_bin < edge_bin"), F.col("size")).otherwise(F.lit(0)).alias("part"))
    order = Window.partitionBy("source").orderBy("_key", "_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    # only the documents of the bins at the edge
    room = F.col("edge_words") - F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = rows.where("_bin = edge_bin").withColumn("part", F.greatest(F.lit(0), F.least("size", room))).select(*out, "part")
    all_ = sure.unionByName(at_edge)
    return all_.select(
        F.col("_id").alias(id_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", F.col("part").cast("long").alias("part"), "source", "_h",
    )


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """The mix itself, with the columns of docs: each document once per complete epoch, and
    once more if at least half of its words are taken beyond them (texts are never cut).

    Documents without words are part of complete epochs only."""
    names = docs.columns
    docs, (id_col, text_col, source_col) = by_place(docs, id_col, text_col, source_col)
    got = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    times = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    # equal rows (same id, source and text) may differ in what they give at the edge: each gets the least
    n = got.groupBy(F.col(id_col).alias("_i"), F.col("source").alias("_s"), "_h").agg(F.min(times).alias("_times"))
    left = docs.withColumn("_hash", F.xxhash64(text_col))
    on = F.col(id_col).eqNullSafe(F.col("_i")) & F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_h"))
    return left.join(n, on).where("_times > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns).toDF(*names)


ORACLE = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), k as (
  select *, -ln(((('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0)
    / (0.25 + 0.75 * least(size, 200)::double / 200.0) as key from d
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, sum(source_size) over () as total from s
), l as (
  select *, row_number() over (order by source_size / w, source nulls last) as place, (1.5 * total - 2.0 * coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as level from w
), t as (
  select source, source_size, least(coalesce((select arg_min(level, place) from l where level * w <= 2.0 * source_size) * w, 2.0 * source_size), 2.0 * source_size)::double as target from l
), g as (
  select *, round(target)::bigint as budget, case when source_size > 0 then round(target)::bigint // source_size else 0 end as epochs from t
), o as (
  select k.doc_id, k.size, g.source_size, g.target, g.epochs, g.budget - g.epochs * g.source_size as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from k join g on k.source is not distinct from g.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from o
"""
