"""Line dedup with a log-template tree, in DataFrame functions but for the search for similar lines.

A line is its tokens, between blanks; tokens that hold a digit, an address or a link are
variable fields (`<*>`) from the start.  Lines that share a quarter of their tokens, place
by place, with a line of another document (or are equal to one) are parsed by a tree of
fixed depth, as log lines are:

* level one is the token count, the next `depth` levels are the leading tokens.  A token
  that stands at its level, below its token count, in `BRANCH` documents or more is a branch
  of its own, all rarer ones (names and other fields at the front) share the branch `<*>`;
* a leaf holds all lines of one path.  Its templates come from counts per place: a line's
  token stays if it stands in over half of the leaf's documents at that place, else it
  becomes `<*>`; a leaf that mixes several templates is told apart by the finer template,
  which keeps tokens that stand in `BRANCH` documents there.  A template must keep
  `SIMILAR` of its tokens, so any two of its lines agree in at least as many.

Lines that share no quarter, but agree in `SIMILAR` of their tokens, place by place, with any
other line are found exactly (line_pairs): their differences are too few to touch all blocks of tokens.  Each
group of lines so linked is one more leaf, without leading tokens; its templates come after
those of the tree.

A line takes the first that recurs of its leaf's template, the finer one, and itself.  A
template recurs if it stands in three documents that are unlike each other; two are enough
for lines of `LONG_TOKENS` tokens or `LONG_CHARS` characters and more that are equal, and
lines of one or two tokens and fewer than `SHORT_CHARS` characters must also stand, as they
are, in `SHORT_DOCS` different texts.  The first occurrence (smallest id, then position) stays, all
others are dropped.  Documents are alike from `ALIKE` on (Jaccard similarity of the pairs of
neighbouring clauses, between ASCII punctuation marks and line ends, measured on the `SKETCH`
smallest hashes; exact up to that many pairs), so copies of one document, exact or near, do not make its lines
recur: they are left to the near-dedup operators.  The document with the smallest hash
represents those alike; each next one represents what is unlike all before.

Blank lines, and lines of variable fields alone (rows of numbers), never match.  Null texts
stay null, texts without line ends are one line, a text may end up empty.  Rows that agree
in id and text get the same result; null ids sort after all others.  No row is ever dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import line_pairs
from .common import by_place, components, drop_table, pair_blocks, shared_table, shuffles_removed, whole_groups

#: Leading tokens that are levels of the tree.
DEPTH = 3
#: Parts of a line, one of which must be shared for the line to be parsed.
QUARTERS = 4
#: Documents in which a token must stand to be a branch, or a constant of the finer template.
BRANCH = 3
#: Share of its tokens that a template must keep.
SIMILAR = (3, 5)
#: Lines of fewer tokens share a quarter if they agree in SIMILAR of them: there are more parts than differences.
UNSURE = next(n for n in range(QUARTERS, 1000) if n - -(-n * SIMILAR[0] // SIMILAR[1]) >= QUARTERS)
#: Rows of a shared key that meet in one group.
BLOCK = 2048
#: Tokens or characters from which a line recurs in two unlike documents.
LONG_TOKENS = 8
LONG_CHARS = 48
#: Lines below these must stand in so many texts.
SHORT_TOKENS, SHORT_CHARS, SHORT_DOCS = 3, 12, 20
#: Similarity from which documents count as copies, and the hashes it is measured on.
ALIKE = (3, 5)
SKETCH = 64
#: What stands between clauses.
CLAUSE = "[.,;:!?\\n]"
ANY = "<*>"
_SPACE = r"[\x20\x09-\x0D]+"
_UNEVEN = r"[\x09-\x0D]"
_HINT = r"[0-9@:]"
_SPECIAL = r"[\x09-\x0D0-9@:]"
_VARIABLE = r"(?<![^\x20])(?:[^\x200-9@/]*+[0-9@]|[a-z]++://)[^\x20]*+"
_SHORT, _PLAIN, _LONG = 0, 1, 2
_OUT, _IN, _OPEN = 0, 1, 2


def _masked(line: Column) -> Column:
    """The line with single blanks and its variable fields as wildcards; patterns run only where they can match."""
    special = line.contains("  ") | line.rlike(_SPECIAL)  # one scan settles most lines
    even = F.trim(F.when(line.contains("  ") | line.rlike(_UNEVEN), F.regexp_replace(line, _SPACE, " ")).otherwise(line))
    masked = F.when(even.rlike(_HINT), F.regexp_replace(even, _VARIABLE, ANY)).otherwise(even)
    return F.when(special, masked).otherwise(F.trim(line))


def _digest(text: Column) -> Column:
    """60 bits of the md5, as a positive long."""
    return _number(F.substring(F.md5(text), 1, 15))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(id, h, pos, x, n, kind, lead, parts) for each line that may match.

    Only hashes leave this step: x of the masked line, lead of its leading tokens, parts of
    its quarters (null: no constant token); h is the text's."""
    text = F.col(text_col)
    # the digest below the explode, so that it is taken once per text
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), _digest(text).alias("h"), F.split(text, "\n").alias("lines"))
    # outer: a split is never empty, and the plain form would split again to filter on that
    rows = rows.select("id", "h", F.posexplode_outer("lines").alias("pos", "line"))
    # a one-row explode keeps the patterns from being evaluated once for each use
    rows = rows.select("id", "h", "pos", F.explode(F.array(_masked(F.col("line")))).alias("masked"))
    masked, length = F.col("masked"), F.length("masked")
    rows = rows.where((masked != "") & _constant(masked)).withColumn("n", length - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1)
    n = F.col("n")
    kind = F.when((n >= LONG_TOKENS) | (length >= LONG_CHARS), _LONG).when((n < SHORT_TOKENS) & (length < SHORT_CHARS), _SHORT).otherwise(_PLAIN)
    first = lambda text, count: F.call_function("substring_index", text, F.lit(" "), count)
    cuts = [F.floor(n * F.lit(i) / F.lit(QUARTERS)).cast("int") for i in range(QUARTERS + 1)]
    parts = [first(first(masked, hi), lo - hi) for lo, hi in zip(cuts, cuts[1:])]
    lead = first(masked, F.lit(depth))
    # no lambdas, which are interpreted
    rows = rows.select("id", "h", "pos", F.xxhash64("masked").alias("x"), "n", kind.cast("byte").alias("kind"), F.split(lead, " ").alias("lead"), *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    tokens = [F.get("lead", F.lit(i)) for i in range(depth)]
    lead = [F.when(t != ANY, F.xxhash64(t)) for t in tokens]
    pieces = [(F.lit(i), F.col(f"p{i}")) for i in range(QUARTERS)]
    parts = [F.when((p != "") & _constant(p), F.xxhash64(i, "n", p)) for i, p in pieces]
    return rows.select("id", "h", "pos", "x", "n", "kind", F.array(*lead).alias("lead"), F.array(*parts).alias("parts"))


def _constant(tokens: Column) -> Column:
    """Is there a token that is no wildcard?"""
    return ~tokens.contains(ANY) | (F.trim(F.replace(tokens, F.lit(ANY), F.lit(""))) != "")


def _shared(lines: DataFrame) -> DataFrame:
    """(x) of the lines that share a part with a line of another document."""
    keyed = lines.select("x", "h", F.explode("parts").alias("part")).where("part is not null")
    shared = keyed.groupBy("part").agg((F.min("h") < F.max("h")).alias("_m")).where("_m").select("part")
    # a table of its own, so that the join's sides are plain shuffles and a very common line can be split
    return shared_table(keyed.join(shared, "part", "left_semi").select("x").distinct(), "line-shared")


def _pairs(docs: DataFrame, text_col: str) -> DataFrame:
    """(chunk, size, bytes, lines): the masked lines that quarters may miss, many to a row (line_pairs)."""
    return docs.select(text_col).mapInArrow(line_pairs.chunks(UNSURE), "chunk long, size long, bytes long, lines binary")


def _agreeing(chunks: DataFrame, shared: DataFrame, stars: bool = False) -> DataFrame:
    """(x, y) of different lines that agree in SIMILAR of their tokens, where one is not in shared.

    stars: only as many of these links as connect the same lines."""
    chunks = shared_table(chunks, "line-chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, (size // line_pairs.BUCKET).bit_length())
    dealt = chunks.mapInArrow(line_pairs.deal(bits), "bucket long, chunk long, data binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    answers = shared_table(dealt.mapInArrow(line_pairs.answer, "bucket long, chunk long, data binary"), "line-answers")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("got"))
    both = chunks.join(answers, "chunk").select("bytes", "lines", "got")
    found = both.mapInArrow(line_pairs.survivors(bits), "x long, n int, a binary, c binary").dropDuplicates(["x"])
    found = found.join(shared.withColumn("_s", F.lit(True)), "x", "left").select("x", F.col("_s").isNull().alias("rest"), "n", "a", "c")
    found = shared_table(found, "line-found")
    drop_table(chunks)
    keys = shared_table(found.select("x", "rest", "n", "a", "c").mapInArrow(line_pairs.keys, "key long, x long, rest boolean"), "line-keys")
    # only keys that a line outside shared has
    open_ = keys.groupBy("key").agg(F.max("rest").alias("_r"), (F.min("x") < F.max("x")).alias("_m")).where("_r and _m").select("key")
    met = shared_table(keys.join(open_, "key", "left_semi").select("key", "x"), "line-open")
    drop_table(keys)
    keys = pair_blocks(met, "key", "x", BLOCK).join(found, "x")
    keys = keys.select(F.xxhash64("key", "lo", "hi").alias("group"), "x", "rest", (F.col("lo") < F.col("hi")).alias("cross"), "blk", "n", "a")
    keys = keys.repartition("group").sortWithinPartitions("group", "x")
    return keys.mapInPandas(whole_groups(line_pairs.links(stars)), "x long, y long").distinct()


def _linked(docs: DataFrame, lines: DataFrame, shared: DataFrame, text_col: str) -> DataFrame:
    """As _leaves, for lines that agree with one outside shared: leaf is the group of links."""
    links = shared_table(_agreeing(_pairs(docs, text_col), shared, stars=True), "line-links")
    groups = shared_table(components(links, "x", "y"), "line-groups")
    forms = _forms(lines.join(groups.select(F.col("id").alias("x")), "x", "left_semi"), "n", "kind")
    forms = shared_table(forms, "line-ends").join(groups.select(F.col("id").alias("x"), F.xxhash64("component").alias("leaf")), "x")
    size = forms.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).where(F.col("leaf_docs") >= BRANCH)
    return forms.withColumn("own", F.array().cast("array<boolean>")).join(size, "leaf")


def _forms(lines: DataFrame, *columns: str) -> DataFrame:
    """(x, *columns, at, docs) per distinct line: one place where it stands, and its documents."""
    place = F.min(F.struct("h", "pos", "id"))
    forms = lines.groupBy("x").agg(*[F.first(c).alias(c) for c in columns], place.alias("at"))
    docs = lines.select("x", "h").distinct().groupBy("x").agg(F.count("*").alias("docs"))
    return forms.join(docs, "x")


def _at_place(docs: DataFrame, forms: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """(x, *columns, line) per distinct line, the line read where it stands."""
    places = forms.groupBy(F.col("at.id").alias("at_id"), F.col("at.h").alias("at_h"))
    places = places.agg(F.collect_list(F.struct("x", "at.pos", *columns)).alias("at"))  # of one document
    texts = docs.select(F.col(id_col).alias("_id"), _digest(F.col(text_col)).alias("_dh"), F.col(text_col).alias("text"))
    found = texts.join(shared_table(places, "line-places"), F.col("_id").eqNullSafe(F.col("at_id")) & (F.col("_dh") == F.col("at_h")))
    found = found.select(F.split("text", "\n").alias("text"), "at")
    found = found.select(F.explode(F.transform("at", lambda f: F.struct(f.alias("f"), F.get("text", f["pos"]).alias("line")))).alias("z"))
    # a text may stand in several rows
    return found.select("z.f.*", "z.line").dropDuplicates(["x"])


def _leaves(lines: DataFrame, depth: int) -> DataFrame:
    """(x, n, kind, docs, at, own, leaf, leaf_docs) per distinct line.

    own: which leading tokens are branches of their own; at: one place where the line
    stands; leaf_docs: null where the leaf has nothing to generalise."""
    forms = shared_table(_forms(lines, "n", "kind", "lead"), "line-forms")
    tokens = forms.select("n", "docs", F.posexplode("lead").alias("i", "t")).where("t is not null")
    branches = tokens.groupBy("n", "i", "t").agg(F.sum("docs").alias("_d")).where(F.col("_d") >= BRANCH)
    branches = shared_table(branches.select("n", "i", "t"), "line-branches")
    own = []
    for i in range(depth):
        level = branches.where(F.col("i") == i).select("n", F.col("t").alias(f"t{i}"), F.lit(True).alias(f"own{i}"))
        forms = forms.withColumn(f"t{i}", F.get("lead", F.lit(i))).join(level, ["n", f"t{i}"], "left")
        own.append(F.coalesce(F.col(f"own{i}"), F.lit(False)))
    path = F.xxhash64("n", *[F.when(own[i], F.col(f"t{i}")) for i in range(depth)])
    forms = shared_table(forms.select("x", "n", "kind", "docs", "at", F.array(*own).cast("array<boolean>").alias("own"), path.alias("leaf")), "line-leaves")
    size = forms.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("leaf_docs") >= BRANCH))
    return forms.join(size.drop("_n"), "leaf", "left")


def _templates(docs: DataFrame, forms: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(x, ids): (id, kind) of the templates a line may take, the most general first."""
    found = _at_place(docs, forms.where("leaf_docs is not null"), ["leaf", "docs", "leaf_docs", "own"], id_col, text_col)
    tokens = found.select("x", "leaf", "docs", "leaf_docs", "own", F.posexplode_outer(F.split(_masked(F.col("line")), " ")).alias("i", "v"))
    own = F.coalesce(F.get("own", F.col("i")), F.lit(False))
    # a token is out (a wildcard), in (a branch) or open; only hashes and numbers go on
    state = F.when(F.col("v") == ANY, _OUT).when(own, _IN).when(F.col("i") < depth, _OUT).otherwise(_OPEN)
    here, any_ = F.xxhash64("i", "v"), F.xxhash64("i", F.lit(ANY))
    tokens = tokens.select("x", F.xxhash64("leaf", "i", "v").alias("k"), here.alias("here"), any_.alias("any"), state.cast("byte").alias("state"), "docs", "leaf_docs")
    tokens = shared_table(tokens, "line-tokens")
    counts = tokens.where(F.col("state") == _OPEN).groupBy("k").agg(F.sum("docs").alias("vd"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    tokens = tokens.join(counts.drop("_n"), "k", "left")
    vd = F.coalesce("vd", "docs")
    constant = {"wide": 2 * vd > F.col("leaf_docs"), "fine": vd >= BRANCH, "exact": F.lit(True)}
    aggs = []
    for name, keep in constant.items():
        keep = F.when(F.col("state") == _OPEN, keep).otherwise((F.col("state") == _IN) if name != "exact" else F.lit(True))
        aggs += [F.bit_xor(F.when(keep, F.col("here")).otherwise(F.col("any"))).alias(name), F.count_if(keep).alias(f"{name}_n")]
    got = tokens.groupBy(F.col("x").alias("_x")).agg(F.count("*").alias("_n"), *aggs)
    out = forms.join(got, F.col("x") == F.col("_x"), "left")
    exact = F.coalesce(F.xxhash64("_n", "exact") * F.when(F.col("_n") > 0, 1), F.xxhash64("x", F.lit(1)))
    option = lambda t, kind: F.struct(t.alias("t"), kind.cast("byte").alias("kind"))
    # as it is, a long line needs two unlike documents only
    ids = []
    for name in ("wide", "fine"):
        t = F.xxhash64("_n", name)
        kept = F.col(f"{name}_n") * SIMILAR[1] >= F.col("_n") * SIMILAR[0]
        ids.append(F.when(t == exact, option(exact, F.col("kind"))).when(kept, option(t, F.lit(_PLAIN))))
    ids.append(F.when((F.col("docs") > 1) | (F.col("_n") > 0), option(exact, F.col("kind"))))
    out = out.where((F.col("kind") != _SHORT) | (F.col("docs") >= SHORT_DOCS))
    return out.select("x", F.array_distinct(F.array_compact(F.array(*ids))).alias("ids")).where(F.size("ids") > 0)


def _sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, s) for each distinct text: the smallest hashes of its pairs of neighbouring clauses."""
    text = F.col(text_col)
    clauses = docs.where(text.isNotNull()).select(_digest(text).alias("h"), F.split(text, CLAUSE).alias("c"))
    digits = lambda t: F.substring(F.md5(t), 1, 15)
    several = F.size("c") - 1
    pairs = F.zip_with(F.slice("c", F.lit(1), several), F.slice("c", F.lit(2), several), lambda a, b: digits(F.concat(a, F.lit("\n"), b)))
    pairs = F.when(several > 0, pairs).otherwise(F.array(digits(F.get("c", F.lit(0)))))
    # digits sort as their numbers do
    return clauses.select("h", F.transform(F.slice(F.sort_array(F.array_distinct(pairs)), 1, SKETCH), _number).alias("s")).dropDuplicates(["h"])


def _unlike(a: str, b: str) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) * ALIKE[1] < F.size(union) * ALIKE[0]


def _recurring(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(t) of the templates that stand in enough unlike documents; rows: (t, h, kind).

    Each round takes the first document left as a representative and leaves those unlike
    it: as many comparisons as rows, however many documents a template has."""
    rows = rows.groupBy("t", "h").agg(F.max("kind").alias("kind"))
    several = rows.groupBy("t").agg((F.min("h") < F.max("h")).alias("_m")).where("_m").select("t")
    left = shared_table(rows.join(several, "t", "left_semi").join(sketches, "h"), "line-documents")
    found = []
    for least in (_LONG, _SHORT):
        first = left.groupBy("t").agg(F.min(F.struct("h", "s")).alias("_f")).select("t", F.col("_f.s").alias("_s"))
        left = shared_table(left.join(first, "t").where(_unlike("s", "_s")).select("t", "h", "kind", "s"), "line-unlike")
        found.append(left.where(F.col("kind") >= least).select("t"))
    return found[0].union(found[1]).distinct()


def _drops(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(_id, _dh, _at): the lines that go, for each document that loses some."""
    paths = shared_table(_lines(docs, id_col, text_col, depth), "line-paths")
    shared = _shared(paths)
    linked = shared_table(_linked(docs, paths, shared, text_col), "line-linked")
    slim = paths.drop("parts")
    lines = shared_table(slim.join(shared, "x", "left_semi"), "line-parsed")
    more = linked.join(shared, "x", "left_anti").select("x")
    more = shared_table(slim.join(more, "x", "left_semi"), "line-more")
    drop_table(paths)
    maybe = _templates(docs, _leaves(lines, depth), id_col, text_col, depth).withColumn("k", F.lit(0))
    maybe = maybe.union(_templates(docs, linked, id_col, text_col, 0).withColumn("k", F.lit(1)))
    maybe = maybe.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("o"))
    maybe = shared_table(maybe.select("x", F.array_distinct(F.flatten("o.ids")).alias("ids")), "line-templates")
    lines = lines.union(more)
    rows = lines.select("x", "h").join(maybe, "x").select("h", F.explode("ids").alias("o")).select("h", "o.*")
    often = _recurring(rows, _sketches(docs, text_col))
    options = maybe.select("x", F.posexplode("ids").alias("k", "o")).select("x", "k", "o.t").join(often, "t")
    taken = shared_table(options.groupBy("x").agg(F.min(F.struct("k", "t")).alias("_o")).select("x", F.col("_o.t").alias("t")), "line-taken")
    hit = shared_table(lines.select("id", "h", "pos", "x").join(taken, "x").select("id", "h", "pos", "t"), "line-hits")
    first = hit.groupBy("t").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h", "pos")).alias("first"))
    same = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h")) & (F.col("first.pos") == F.col("pos"))
    drops = hit.join(first, "t").where(~same).groupBy("id", "h").agg(F.collect_set("pos").alias("_at"))
    return shared_table(drops.select(F.col("id").alias("_id"), F.col("h").alias("_dh"), "_at"), "line-drops")


def dedup_lines(docs: DataFrame, depth: int = DEPTH, id_col="doc_id", text_col="text") -> DataFrame:
    """docs, with lines of recurring templates taken out of text_col, plus _dropped (their number)."""
    names = docs.columns
    docs, (id_col, text_col) = by_place(docs, id_col, text_col)
    with shuffles_removed(docs.sparkSession):
        drops = _drops(docs, id_col, text_col, depth)
    work = docs.withColumn("_h", _digest(F.col(text_col)))
    joined = work.join(drops, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_dh")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("_at"), i)), "\n")
    text = F.when(F.col("_at").isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, text).withColumn("_dropped", F.coalesce(F.size("_at"), F.lit(0))).select(*docs.columns, "_dropped").toDF(*names, "_dropped")


#: The tree for whole tables in one process: templates are the strings themselves.  The groups of
#: similar lines that share no quarter are not in it.
ORACLE = """
with d as (
  select doc_id, text, ('0x' || substr(md5(text), 1, 15))::bigint as h from documents where text is not null
), l as (
  select doc_id, h, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from d
), m as (
  select distinct doc_id, h, pos, list_transform(string_split(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' '),
    lambda t: case when regexp_matches(t, '^([^0-9@/]*[0-9@]|[a-z]+://)') then '<*>' else t end) as tokens from l
), k as (
  select *, len(tokens) as n, array_to_string(tokens, ' ') as x from m where tokens <> [''] and len(list_filter(tokens, lambda t: t <> '<*>')) > 0
), w as (
  select x, any_value(tokens) as tokens, any_value(n) as n, count(distinct h) as docs,
    case when any_value(n) >= 8 or length(x) >= 48 then 2 when any_value(n) < 3 and length(x) < 12 then 0 else 1 end as kind from k group by x
), q as (
  select x, g, n, tokens[(n * g // 4 + 1):(n * (g + 1) // 4)] as part from w, range(4) r(g)
), qk as (
  select q.g, q.n, q.part from q join k on k.x = q.x where len(list_filter(q.part, lambda t: t <> '<*>')) > 0 group by all having count(distinct k.h) > 1
), f as (
  select w.*, tokens[1] as a1, tokens[2] as a2, tokens[3] as a3 from w where x in (select q.x from q join qk on q.g = qk.g and q.n = qk.n and q.part = qk.part)
), f3 as (
  select *, case when a1 <> '<*>' and sum(docs) over (partition by n, a1) >= 3 then a1 end as b1,
    case when a2 <> '<*>' and sum(docs) over (partition by n, a2) >= 3 then a2 end as b2,
    case when a3 <> '<*>' and sum(docs) over (partition by n, a3) >= 3 then a3 end as b3 from f
), leaf as (
  select *, sum(docs) over (partition by n, b1, b2, b3) as leaf_docs, dense_rank() over (order by n, b1, b2, b3) as leaf from f3
), tok as (
  select x, n, docs, leaf, leaf_docs, [b1, b2, b3] as own, unnest(tokens) as v, generate_subscripts(tokens, 1) as i from leaf
), cnt as (
  select *, sum(docs) over (partition by leaf, i, v) as vd from tok
), pat as (
  select x, n, string_agg(case when own[i] is not null or (i > 3 and 2 * vd > leaf_docs) then v else '<*>' end, ' ' order by i) as wide,
    string_agg(case when own[i] is not null or (i > 3 and vd >= 3) then v else '<*>' end, ' ' order by i) as fine from cnt group by x, n
), opt as (
  select x, n, wide as t, 1 as k from pat union all select x, n, fine, 2 from pat union all select x, n, x, 3 from pat
), cand as (
  select opt.*, case when opt.t = opt.x then leaf.kind else least(leaf.kind, 1) end as kind from opt join leaf using (x) where (leaf.kind > 0 or leaf.docs >= 20)
    and (opt.t = opt.x or 5 * len(list_filter(string_split(opt.t, ' '), lambda t: t <> '<*>')) >= 3 * opt.n)
), rows_ as (
  select t, h, max(kind) as kind from (select distinct x, h from k) join cand using (x) group by t, h
), s as (
  select h, list_sort(list_distinct(list_transform(range(greatest(len(c) - 1, 1)), lambda i: ('0x' || substr(md5(concat_ws(chr(10), c[i + 1], c[i + 2])), 1, 15))::bigint)))[1:64] as s
  from (select h, string_split_regex(any_value(text), '[.,;:!?\\n]') as c from d group by h)
), r0 as (
  select t, h, kind, s from rows_ join s using (h)
), r1 as (
  select r0.* from r0 join (select t, arg_min(s, h) as a from r0 group by t) using (t)
  where 5 * len(list_intersect(list_sort(list_distinct(s || a))[1:64], list_intersect(s, a))) < 3 * len(list_sort(list_distinct(s || a))[1:64])
), r2 as (
  select r1.* from r1 join (select t, arg_min(s, h) as a from r1 group by t) using (t)
  where 5 * len(list_intersect(list_sort(list_distinct(s || a))[1:64], list_intersect(s, a))) < 3 * len(list_sort(list_distinct(s || a))[1:64])
), often as (
  select t from r1 where kind = 2 union select t from r2
), taken as (
  select x, arg_min(t, k) as t from cand where t in (select t from often) group by x
), hit as (
  select k.doc_id, k.h, k.pos, taken.t from k join taken using (x)
), fst as (
  select t, min(struct_pack(n := doc_id is null, d := doc_id, h := h, p := pos)) as first from hit group by t
), drops as (
  select distinct hit.doc_id, hit.h, hit.pos from hit join fst using (t) where not (hit.doc_id is not distinct from fst.first.d and hit.h = fst.first.h and hit.pos = fst.first.p)
), a as (
  select doc_id, h, list(pos) as at from drops group by all
)
select d.doc_id, case when a.at is null then d.text else array_to_string(list_transform(list_filter(
    list_zip(string_split(d.text, chr(10)), range(len(string_split(d.text, chr(10))))), lambda x: not list_contains(a.at, x[2])), lambda x: x[1]), chr(10)) end as text,
  coalesce(len(a.at), 0)::bigint as n_dropped
from documents d left join a on d.doc_id is not distinct from a.doc_id and ('0x' || substr(md5(d.text), 1, 15))::bigint = a.h
"""
