"""One query per operator over the contact view, with its DuckDB equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import header as H
from ..frame import PairsFrame, number_in_order
from ..operators import (
    by_tile, concat, coverage, dedup, filter_by_coverage, flip, mark_duplicates, merge, merge_stats, phase, remove_columns, restrict,
    sample, scaling, select, sort, split_pairs, split_sam, stats, subset_chroms,
)
from ..operators.scaling import distance_edges
from ..schema import STANDARD
from ..shared import shared_dir
from ..sources.pairs import parse_lines, set_columns, to_lines
from .demo import CHROMS, CONTACTS, ORDER, contacts, numbered, packed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COLS = ", ".join(STANDARD)
PAIRS = f"with base as ({CONTACTS}), pairs as (select {COLS}, row_number() over (order by {', '.join(ORDER)}) - 1 as rid from base)"


def query(name: str, oracle: str | None = None, pairs: str = PAIRS):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = f"{pairs} {oracle}" if pairs else oracle
        return f

    return add


# --- order


def _places(p: PairsFrame) -> DataFrame:
    """readID and place of the rows as the operator put them: how an order is compared."""
    return number_in_order(p.df.select("readID"), "place")


@query("sort_default", "select readID, (row_number() over (order by chrom1, chrom2, pos1, pos2, pair_type, rid) - 1)::bigint as place from pairs")
def _sort(spark, sf):
    return _places(sort(numbered(spark, sf)))


@query("sort_extra_col", "select readID, (row_number() over (order by chrom1, chrom2, pos1, pos2, pair_type, strand2, rid) - 1)::bigint as place from pairs")
def _sort_extra(spark, sf):
    return _places(sort(numbered(spark, sf), ["strand2"]))


def _halves(spark, sf) -> list[PairsFrame]:
    p = numbered(spark, sf)
    return [select(p, "strand2 == '+'")[0], select(p, "strand2 != '+'")[0]]


_HALVES = "h as (select *, case when strand2 = '+' then 0 else 1 end as src from pairs)"


@query("merge_two", f", {_HALVES} select readID, (row_number() over (order by chrom1, chrom2, pos1, pos2, pair_type, src, rid) - 1)::bigint as place from h")
def _merge(spark, sf):
    return _places(merge(_halves(spark, sf)))


@query("concat_two", f", {_HALVES} select readID, src from h")
def _concat(spark, sf):
    return concat(_halves(spark, sf)).df.select("readID", F.shiftright("rid", 48).cast("int").alias("src"))


# --- select

_CONDITIONS = {
    "select_eq": ("pair_type == 'UU'", "pair_type = 'UU'"),
    "select_bool_tree": ("(chrom1 == chrom2 and pos1 > 50) or (strand1 == '-' and not pair_type == 'UU')", "(chrom1 = chrom2 and pos1 > 50) or (strand1 = '-' and not pair_type = 'UU')"),
    "select_chained": ("100 < pos1 <= 900", "100 < pos1 and pos1 <= 900"),
    "select_not": ("not chrom1 == '!'", "not chrom1 = '!'"),
    "select_in": ("chrom1 in ['chr1', 'chr3'] and pos2 not in (1, 2, 3)", "chrom1 in ('chr1', 'chr3') and pos2 not in (1, 2, 3)"),
    "select_arith": ("abs(pos1 - pos2) > 500 and pos1 % 2 == 0", "abs(pos1 - pos2) > 500 and pos1 % 2 = 0"),
    "select_csv": ("csv_match(pair_type, 'UU,NU')", "pair_type in ('UU', 'NU')"),
    "select_wildcard": ("wildcard_match(pair_type, '?R') or wildcard_match(readID, '1*_7')", "pair_type like '_R' or readID like '1%\\_7' escape '\\'"),
    "select_regex": ("regex_match(chrom1, 'chr[1-3]')", "regexp_full_match(chrom1, 'chr[1-3]')"),
    "select_region": ("region_match(chrom1, pos1, 'chr2', 100, 1500)", "chrom1 = 'chr2' and pos1 between 100 and 1500"),
    "select_region_open": ("region_match(chrom1, pos1, 'chr2', 500)", "chrom1 = 'chr2' and pos1 >= 500"),
    "select_python": ("len(readID) > 12 and readID.endswith('9') and int(readID[0]) + 1 > 3", "length(readID) > 12 and readID like '%9' and cast(readID[1] as int) + 1 > 3"),
}
for _name, (_python, _sql) in _CONDITIONS.items():
    query(_name, f"select {COLS} from base where {_sql}", f"with base as ({CONTACTS})")(lambda spark, sf, c=_python: select(contacts(spark, sf), c)[0].df)


@query("select_rest", f"select {COLS} from base where not (chrom1 = chrom2 and pos1 > 50)", f"with base as ({CONTACTS})")
def _rest(spark, sf):
    return select(contacts(spark, sf), "chrom1 == chrom2 and pos1 > 50")[1].df


@query("chrom_subset", f"select {COLS} from base where chrom1 in ('chr1', 'chr2') and chrom2 in ('chr1', 'chr2')", f"with base as ({CONTACTS})")
def _subset(spark, sf):
    return subset_chroms(contacts(spark, sf), ["chr1", "chr2"]).df


@query("remove_columns", "select readID, chrom1, pos1, chrom2, pos2 from base", f"with base as ({CONTACTS})")
def _remove(spark, sf):
    return remove_columns(contacts(spark, sf), ["strand1", "strand2", "pair_type"]).df


# --- dedup

_EXACT = ", k as (select *, min(rid) over (partition by chrom1, chrom2, strand1, strand2, pos1, pos2{extra}) as keeper from pairs where chrom1 <> '!' and chrom2 <> '!')"


def _near(r: int, method: str) -> str:
    far = f"greatest(abs(a.pos1 - b.pos1), abs(a.pos2 - b.pos2)) <= {r}" if method == "max" else f"abs(a.pos1 - b.pos1) + abs(a.pos2 - b.pos2) <= {r}"
    return f"""
, m as (select *, pos1 // {r} as bk from pairs where chrom1 <> '!' and chrom2 <> '!')
, e as (select a.rid as u, b.rid as v from m a join (select *, unnest([bk - 1, bk, bk + 1]) as nb from m) b
  on a.chrom1 = b.chrom1 and a.chrom2 = b.chrom2 and a.strand1 = b.strand1 and a.strand2 = b.strand2 and a.bk = b.nb where a.rid <> b.rid and {far})
, w as (select * from (with recursive t(n, root) as (select rid, rid from m union select e.v, t.root from t join e on e.u = t.n where t.root < e.v) select n, min(root) as keeper from t group by n))
, k as (select m.*, w.keeper from m join w on w.n = m.rid)
"""


@query("dedup_exact", _EXACT.format(extra="") + " select readID from k where rid = keeper")
def _dedup_exact(spark, sf):
    return dedup(numbered(spark, sf), 0).pairs.df.select("readID")


@query("dedup_exact_dups", _EXACT.format(extra="") + " select readID, 'DD' as pair_type from k where rid <> keeper")
def _dedup_exact_dups(spark, sf):
    return dedup(numbered(spark, sf), 0).dups.df.select("readID", "pair_type")


@query("dedup_exact_extra_col", _EXACT.format(extra=", pair_type") + " select readID from k where rid = keeper")
def _dedup_exact_extra(spark, sf):
    return dedup(numbered(spark, sf), 0, extra=["pair_type"]).pairs.df.select("readID")


@query("dedup_near_max", _near(3, "max") + " select readID, rid = keeper as kept from k")
def _dedup_max(spark, sf):
    return dedup(numbered(spark, sf), 3).classed.where("is_mapped").select("readID", (~F.col("is_dup")).alias("kept"))


@query("dedup_near_sum", _near(3, "sum") + " select readID, rid = keeper as kept from k")
def _dedup_sum(spark, sf):
    return dedup(numbered(spark, sf), 3, "sum").classed.where("is_mapped").select("readID", (~F.col("is_dup")).alias("kept"))


@query("dedup_near_parents", _near(3, "max") + " select k.readID, p.readID as parent_readID, 'DD' as pair_type from k join pairs p on p.rid = k.keeper where k.rid <> k.keeper")
def _dedup_parents(spark, sf):
    return dedup(numbered(spark, sf), 3, keep_parent_id=True).dups.df.select("readID", "parent_readID", "pair_type")


@query("dedup_near_dups_in_main", _near(3, "max") + " select readID, case when rid <> keeper then 'DD' else pair_type end as pair_type from k")
def _dedup_main(spark, sf):
    return dedup(numbered(spark, sf), 3).classed.where("is_mapped").select("readID", "pair_type")


@query("dedup_unmapped", f"select {COLS} from pairs where chrom1 = '!' or chrom2 = '!'")
def _dedup_unmapped(spark, sf):
    return dedup(numbered(spark, sf), 3).unmapped.df.select(*STANDARD)


@query("dedup_by_tile", _near(3, "max") + ", t as (select k.*, 'FC:' || k.pos2 % 4 || ':' || k.pos2 % 7 as tile from k) select t.tile, u.tile as parent_tile, count(*)::bigint as dup_count from t join t u on u.rid = t.keeper where t.rid <> t.keeper group by all")
def _by_tile(spark, sf):
    p = numbered(spark, sf)
    tiled = F.concat(F.lit("I:1:FC:"), (F.col("pos2") % 4).cast("string"), F.lit(":"), (F.col("pos2") % 7).cast("string"), F.lit(":"), F.col("readID"))
    return by_tile(dedup(p.with_df(p.df.withColumn("readID", tiled)), 3, keep_parent_id=True).dups.df)


# --- coverage


def _cov(method: str, d: int) -> str:
    total = "max(n) + 1" if method == "max" else "sum(n) + 1"
    return f"""
, m as (select * from pairs where chrom1 <> '!' and chrom2 <> '!')
, ends as (select rid, 1 as s, chrom1 as c, pos1 as p from m union all select rid, 2, chrom2, pos2 from m)
, spot as (select c, p, count(*) as n from ends group by c, p)
, around as (select a.c, a.p, sum(b.n) as n from spot a join spot b on a.c = b.c and b.p between a.p - {d} and a.p + {d} group by a.c, a.p)
, cov as (select rid, ({total})::bigint as coverage from (select e.rid, x.n - 1 as n from ends e join around x on e.c = x.c and e.p = x.p) group by rid)
"""


@query("coverage_max", _cov("max", 2) + " select readID, coverage from cov join m using (rid)")
def _cov_max(spark, sf):
    p = numbered(spark, sf)
    return coverage(p.df, "rid", 2).join(p.df.select("readID", F.col("rid").alias("_r")), "_r").select("readID", "coverage")


@query("coverage_sum", _cov("sum", 2) + " select readID, coverage from cov join m using (rid)")
def _cov_sum(spark, sf):
    p = numbered(spark, sf)
    return coverage(p.df, "rid", 2, "sum").join(p.df.select("readID", F.col("rid").alias("_r")), "_r").select("readID", "coverage")


@query("coverage_low", _cov("max", 2) + f" select {COLS} from cov join m using (rid) where coverage <= 700")
def _cov_low(spark, sf):
    return filter_by_coverage(numbered(spark, sf), 700, 2).low.df.select(*STANDARD)


@query("coverage_high", _cov("max", 2) + f" select {COLS} from cov join m using (rid) where coverage > 700")
def _cov_high(spark, sf):
    return filter_by_coverage(numbered(spark, sf), 700, 2).high.df.select(*STANDARD)


@query("coverage_mark_multi", _cov("max", 2) + " select readID, 'DD' as pair_type from cov join m using (rid) where coverage > 700")
def _cov_mark(spark, sf):
    return filter_by_coverage(numbered(spark, sf), 700, 2, mark_multi=True).high.df.select("readID", "pair_type")


# --- rows


def _flip_sql(order: list[str]) -> str:
    ranks = ", ".join(f"('{c}', {i})" for i, c in enumerate(["!", *order]))
    return f""", r(c, k) as (values {ranks})
, f as (select pairs.*, coalesce(a.k, -1) as k1, coalesce(b.k, -1) as k2 from pairs left join r a on a.c = chrom1 left join r b on b.c = chrom2)
, g as (select *, case when k1 >= 0 and k2 >= 0 then k1 < k2 or (k1 = k2 and pos1 <= pos2) when k1 >= 0 or k2 >= 0 then k1 >= 0 else chrom1 < chrom2 or (chrom1 = chrom2 and pos1 <= pos2) end as ok from f)
select readID, case when ok then chrom1 else chrom2 end as chrom1, case when ok then pos1 else pos2 end as pos1, case when ok then chrom2 else chrom1 end as chrom2, case when ok then pos2 else pos1 end as pos2,
 case when ok then strand1 else strand2 end as strand1, case when ok then strand2 else strand1 end as strand2, case when ok then pair_type else pair_type[2] || pair_type[1] end as pair_type from g"""


@query("flip", _flip_sql(["chr3", "chr1", "chr2", "chr5", "chr4"]))
def _flip(spark, sf):
    return flip(contacts(spark, sf), ["chr3", "chr1", "chr2", "chr5", "chr4"]).df


@query("flip_unannotated", _flip_sql(["chr3", "chr1"]))
def _flip_some(spark, sf):
    return flip(contacts(spark, sf), ["chr3", "chr1"]).df


BED = [(c, s, min(s + 137, 2000)) for c in list(CHROMS)[:4] for s in range(0, 2000, 137)]
_SITES = ", ".join(f"('{c}', {k}, {a}, {b})" for c in list(CHROMS)[:4] for k, (a, b) in enumerate(zip([0, *[e + 1 for x, _, e in BED if x == c]], [e + 1 for x, _, e in BED if x == c])))
_SIDE = "coalesce(f{s}.k, -1)::int as rfrag{s}, coalesce(f{s}.a, 0)::int as rfrag_start{s}, coalesce(f{s}.b, 0)::int as rfrag_end{s}"


@query("restrict", f", f(c, k, a, b) as (values {_SITES}) select readID, {_SIDE.format(s=1)}, {_SIDE.format(s=2)} from pairs asof left join f f1 on f1.c = chrom1 and pos1 >= f1.a asof left join f f2 on f2.c = chrom2 and pos2 >= f2.a")
def _restrict(spark, sf):
    return restrict(contacts(spark, sf), BED).df.drop("chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type")


@query("markasdup", "select readID, 'DD' as pair_type from pairs")
def _mark(spark, sf):
    return mark_duplicates(contacts(spark, sf)).df.select("readID", "pair_type")


_PACKED = """, x as (select *, case when chrom1='!' then [] else [concat_ws(chr(9), readID, '65', chrom1, pos1::varchar, 'Yt:Z:UU')] end as s1,
  case when pos2 % 2 = 0 then [concat_ws(chr(9), readID, '129', chrom2, pos2::varchar, 'Yt:Z:UU'), concat_ws(chr(9), readID, '2177', chrom2, pos2::varchar, 'Yt:Z:UU')] else [concat_ws(chr(9), readID, '129', chrom2, pos2::varchar, 'Yt:Z:UU')] end as s2 from pairs)"""


@query("markasdup_sam", _PACKED + " select readID, array_to_string(list_transform(s2, lambda r: array_to_string([string_split(r, chr(9))[1], (string_split(r, chr(9))[2]::int | 1024)::varchar, string_split(r, chr(9))[3], string_split(r, chr(9))[4], 'Yt:Z:DD'], chr(25))), chr(25) || 'NEXT_SAM' || chr(25)) as sam2 from x")
def _mark_sam(spark, sf):
    p = contacts(spark, sf)
    return mark_duplicates(p.with_df(packed(p.df))).df.select("readID", "sam2")


@query("split_sam", _PACKED + " select side::int as side, (k - 1)::int as k, line from (select 1 as side, generate_subscripts(s1, 1) as k, unnest(s1) as line from x union all select 2, generate_subscripts(s2, 1), unnest(s2) from x)")
def _split_sam(spark, sf):
    p = contacts(spark, sf)
    return split_sam(p.with_df(packed(p.df)))[1].select("side", "k", "line")


@query("split_pairs", f"select {COLS} from pairs")
def _split_pairs(spark, sf):
    p = contacts(spark, sf)
    return split_pairs(p.with_df(packed(p.df))).df


@query("sample_seeded")
def _sample(spark, sf):
    return sample(numbered(spark, sf), 0.25, 42).df


@query("phase")
def _phase(spark, sf):
    p = contacts(spark, sf)
    df = p.df
    for s in "12":
        chrom = F.when(F.col(f"chrom{s}") == "!", "!").otherwise(F.concat(f"chrom{s}", F.when(F.col("pos2") % 2 == 0, "_pat").otherwise("_mat")))
        df = df.withColumn(f"chrom{s}", chrom).withColumn(f"AS{s}", F.lit(50)).withColumn(f"XS{s}", (F.col("pos2") % 3 * 25).cast("int"))
        df = df.withColumn(f"XB{s}", F.concat(F.lit("chr1_mat,+10,50M,0,"), F.col(f"XS{s}").cast("string"), F.lit(",0;")))
    return phase(p.with_df(df), ("_pat", "_mat"), clean=True).df


# --- scaling and stats

_EDGES = distance_edges()
_BINS = ", ".join(f"({a}, {b})" for a, b in zip(_EDGES, _EDGES[1:]))
_REGIONS = ", ".join(f"('{c}', {n})" for c, n in CHROMS.items())
_GRID = f""", bins(a, b) as (values {_BINS}), reg(c, n) as (values {_REGIONS}), st(s) as (values ('+'), ('-'))
, inside as (select p.* from pairs p join reg r1 on r1.c = chrom1 and pos1 < r1.n join reg r2 on r2.c = chrom2 and pos2 < r2.n)"""
_CIS = _GRID + """, n as (select chrom1 as c, strand1, strand2, bins.a, count(*) as n from inside join bins on abs(pos2 - pos1) >= bins.a and abs(pos2 - pos1) < bins.b where chrom1 = chrom2 group by all)
select reg.c as chrom1, s1.s as strand1, s2.s as strand2, bins.a::bigint as min_dist, bins.b::bigint as max_dist, coalesce(n.n, 0)::bigint as n_pairs{area}
from reg, bins, st s1, st s2 left join n on n.c = reg.c and n.strand1 = s1.s and n.strand2 = s2.s and n.a = bins.a where bins.a < reg.n"""


@query("scaling_cis", _CIS.format(area=""))
def _scaling_cis(spark, sf):
    return scaling(contacts(spark, sf)).cis.select("chrom1", "strand1", "strand2", "min_dist", "max_dist", "n_pairs")


@query("scaling_trans", _GRID + """, n as (select chrom1, chrom2, strand1, strand2, count(*) as n from inside where chrom1 <> chrom2 group by all)
select r1.c as chrom1, r2.c as chrom2, s1.s as strand1, s2.s as strand2, coalesce(n.n, 0)::bigint as n_pairs, (r1.n::double * r2.n) as n_bp2
from reg r1 join reg r2 on r1.c <> r2.c cross join st s1 cross join st s2 left join n on n.chrom1 = r1.c and n.chrom2 = r2.c and n.strand1 = s1.s and n.strand2 = s2.s""")
def _scaling_trans(spark, sf):
    return scaling(contacts(spark, sf)).trans.select("chrom1", "chrom2", "strand1", "strand2", "n_pairs", "n_bp2")


@query("scaling_areas", _CIS.format(area=", (greatest(reg.n - bins.a, 0)::double ** 2 / 2 - greatest(reg.n - bins.b, 0)::double ** 2 / 2) as n_bp2"))
def _scaling_areas(spark, sf):
    return scaling(contacts(spark, sf)).cis.select("chrom1", "strand1", "strand2", "min_dist", "max_dist", "n_pairs", "n_bp2")


def _stats(spark, sf, keys: str, **how) -> DataFrame:
    return stats(contacts(spark, sf), **how).where(keys)


@query("stats_pair_types", "select 'pair_types/' || pair_type as key, count(*)::bigint as value from pairs group by all")
def _stats_types(spark, sf):
    return _stats(spark, sf, "key like 'pair_types/%'").select("key", "value")


@query("stats_chrom_freq", "select 'chrom_freq/' || chrom1 || '/' || chrom2 as key, count(*)::bigint as value from pairs where chrom1 <> '!' and chrom2 <> '!' group by all")
def _stats_chroms(spark, sf):
    return _stats(spark, sf, "key like 'chrom_freq/%'").select("key", "value")


@query("stats_totals", """, t as (select count(*) as total, count(*) filter (chrom1 = '!' and chrom2 = '!') as total_unmapped, count(*) filter ((chrom1 = '!') <> (chrom2 = '!')) as total_single_sided_mapped,
 count(*) filter (chrom1 <> '!' and chrom2 <> '!') as total_mapped, 0::bigint as total_dups, count(*) filter (chrom1 <> '!' and chrom2 <> '!') as total_nodups,
 count(*) filter (chrom1 = chrom2 and chrom1 <> '!') as cis, count(*) filter (chrom1 <> chrom2 and chrom1 <> '!' and chrom2 <> '!') as trans from pairs)
select key, value from (unpivot t on * into name key value value)""")
def _stats_totals(spark, sf):
    return _stats(spark, sf, "key like 'total%' or key in ('cis', 'trans')").select("key", "value")


@query("stats_dist_hist", f", bins(a, b) as (values {_BINS}) select 'dist_freq/' || a || '-' || b || '/' || strand1 || strand2 as key, count(*)::bigint as value from pairs join bins on abs(pos2 - pos1) >= a and abs(pos2 - pos1) < b where chrom1 = chrom2 and chrom1 <> '!' group by all")
def _stats_dist(spark, sf):
    return _stats(spark, sf, "key like 'dist_freq/%'").select("key", "value")


@query("stats_filtered", "select 'cis' as filter, 'total' as key, count(*) filter (chrom1 = chrom2)::bigint as value from pairs union all select 'far', 'total', count(*) filter (abs(pos1 - pos2) > 500)::bigint from pairs")
def _stats_filtered(spark, sf):
    return _stats(spark, sf, "key = 'total'", filters={"cis": "chrom1 == chrom2", "far": "abs(pos1 - pos2) > 500"})


@query("stats_subset", "select 'total' as key, count(*)::bigint as value from pairs where chrom1 in ('chr1', 'chr2') and chrom2 in ('chr1', 'chr2') union all select 'chromsizes/' || c, 30000 from (values ('chr1'), ('chr2')) v(c)")
def _stats_subset(spark, sf):
    return _stats(spark, sf, "key = 'total' or key like 'chromsizes/%'", chroms=["chr1", "chr2"], with_chromsizes=True).select("key", "value")


@query("stats_merge", "select 'pair_types/' || pair_type as key, (2 * count(*))::bigint as value from pairs group by all")
def _stats_merge(spark, sf):
    one = stats(contacts(spark, sf))
    return merge_stats([one, one]).where("key like 'pair_types/%'").select("key", "value")


@query("header_set_columns", "select readID, chrom1 as chromA1, pos1 from base", f"with base as ({CONTACTS})")
def _set_columns(spark, sf):
    names = ["readID", "chromA1", *STANDARD[2:]]
    got = set_columns(contacts(spark, sf), names)
    H.validate(got.header, names)
    return got.df.select("readID", "chromA1", "pos1")


@query("text_round_trip", f"select {COLS} from base", f"with base as ({CONTACTS})")
def _text(spark, sf):
    """Lines of text written to the shared folder and parsed again."""
    p = contacts(spark, sf)
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    to_lines(p).write.text(path)
    return parse_lines(spark.read.text(path), STANDARD)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: near-duplicate removal, then pairs per chromosome pair."""
    kept = dedup(numbered(spark, sf_dir), 3).pairs.df
    return kept.groupBy("chrom1", "chrom2").agg(F.count("*").alias("n_pairs")).orderBy("chrom1", "chrom2")
