"""Text operators against brute force, and on awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from lociflow.llm import html_extract, langid, line_dedup, line_pairs, mixing, simhash, spbpe, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _h string, score double, pos int"
LONG = " ".join(f"word{i % 977}" for i in range(30000))


def awkward(spark, rows=None):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    base = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t ", None, None, 3), (None, "some words here", "en", "b", 15),
        (4, LONG, "en", "b", len(LONG)), (5, "same text twice over", "de", "b", 20), (5, "same text twice over", "de", "b", 20),
        (6, "same text twice over", "de", None, 20), (7, "12345 !!!", "fr", "c", 9), (8, "été \U0001f600 ▁x", "fr", "c", 8),
    ]
    return spark.createDataFrame([(*r, 1, "x", 0.5, 2) for r in (base if rows is None else rows)], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- SimHash


def brute_fp(text, width=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, ids, bits):
    lab = list(range(len(fps)))
    near = [[j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= bits] for i in range(len(fps))]
    while True:
        new = [min(lab[j] for j in near[i]) for i in range(len(fps))]
        if new == lab:
            break
        lab = new
    low = collections.defaultdict(list)
    for i, x in zip(ids, lab):
        low[x].append(i)
    return [min((i for i in low[x] if i is not None), default=None) for x in lab]


def variants(n=60):
    rng = np.random.default_rng(5)
    out = []
    for g in range(n // 6):
        base = [f"w{x}" for x in rng.integers(0, 4000, 120)]
        for k in range(6):
            w = list(base)
            for p in rng.integers(0, len(w), k // 2):
                w[p] = f"x{rng.integers(0, 99)}"
            out.append((g * 6 + k, " ".join(w), "en", "s", 0))
    return out


def test_simhash_equals_brute_force(spark):
    df = awkward(spark).union(awkward(spark, [(100 + i, *r) for i, *r in variants()]))
    rows = df.select("doc_id", "text").collect()
    want = dict(collections.Counter((r.doc_id, brute_fp(r.text), c) for r, c in zip(rows, components([brute_fp(r.text) for r in rows], [r.doc_id for r in rows], 4))))
    got = collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == want


def test_pigeonhole_keys_lose_no_pair():
    rng = np.random.default_rng(1)
    keys = [set(k) for k in simhash.pigeonhole_keys(4)]
    for _ in range(500):
        wrong = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not (k & wrong) for k in keys)


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    nodes = [(i, i, (i).to_bytes(8, "big")) for i in range(64)]
    df = spark.createDataFrame(nodes, "rep long, fp long, sig binary")
    edges = simhash._close_pairs(df, simhash.pigeonhole_keys(4), 1, None).collect()
    from lociflow.llm.common import components as comps

    got = {r.id: r.component for r in comps(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(64), 0)


def test_keep_one(spark):
    rows = variants(24)
    df = awkward(spark, rows + [(500, rows[0][1], "en", "s", 0), (500, rows[0][1], "en", "s", 0), (501, "quite another text", "en", "s", 0), (501, "b text", "en", "s", 0), (None, "null id", "en", "s", 0)])
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    ids = collections.Counter(r.doc_id for r in got.collect())
    assert ids[501] == 1 and ids[500] == 0 and ids[None] == 1 and max(ids.values()) == 1
    assert {0, 6, 12, 18} <= set(ids) and simhash.keep_one(awkward(spark, [])).count() == 0


def jaccard_components(texts, ids, least, width=5):
    ws = [words((t or "").lower()) for t in texts]
    sets = [frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset() for w in ws]
    lab = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    return [min(i for i, y in zip(ids, lab) if y == x) for x in lab]


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_near_duplicates_equal_exact_similarity(spark, monkeypatch, block):
    """Copies with ever more words changed: those below 0.8 are linked through others only; blocks change nothing."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(8)
    rows = [(900, None, "en", "s", 0), (901, " ", "en", "s", 0), (902, "one two", "en", "s", 0), (903, "one  Two", "en", "s", 0)]
    for g in range(6):
        base = [f"g{g}w{x}" for x in rng.integers(0, 4000, 300)]
        for k in range(12):
            w = list(base)
            for p in rng.choice(300, k * 2, replace=False):
                w[p] = f"x{rng.integers(0, 10**6)}"
            rows.append((g * 20 + k, " ".join(w), "en", "s", 0))
    docs = awkward(spark, rows)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    ids = [r[0] for r in rows]
    assert got == dict(zip(ids, jaccard_components([r[1] for r in rows], ids, 0.8)))
    assert len(set(got.values())) > 12  # far copies are not linked


def test_alike_components_equal_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(60)]
    near = [[j for j, b in enumerate(sets) if i == j or len(a) and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b))] for i, a in enumerate(sets)]
    lab = list(range(60))
    for _ in range(60):
        lab = [min(lab[j] for j in near[i]) for i in range(60)]
    assert simhash.alike_components(sets, 0.5).tolist() == lab


def test_near_copies_of_eight_tenths_are_found(spark):
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for g in range(60):
        w = [f"v{x}" for x in rng.integers(0, 9000, 300)]
        near = list(w)
        at = int(rng.integers(0, 260))
        near[at : at + 20] = [f"n{x}" for x in rng.integers(0, 9000, 20)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(near))]
        pairs.append((2 * g, 2 * g + 1))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len(set(got.values())) >= 60


# --- mixing


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 90)), "en", ["a", "b", "c", None, "d"][int(rng.integers(0, 5))], 0) for i in range(400)]
    df = awkward(spark).union(awkward(spark, [(1000 + i, *r) for i, *r in rows]))
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by, goal, sizes = collections.Counter(), {}, collections.Counter()
    for r in got:
        by[r.source] += r.taken
        sizes[r.source] += r["size"]
        goal[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(sizes[r.source] == r.source_size for r in got)
    # water level by plain iteration
    names = sorted((s for s in goal if s is not None)) + [None] * (None in goal)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(2 * sizes[s] for s in capped)
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    for s in names:
        want = 2 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free)
        assert goal[s] == pytest.approx(want) and abs(by[s] - want) <= 1


def test_mixed_documents_repeat_whole_texts(spark):
    df = awkward(spark)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and mixing.mixed_documents(awkward(spark, [])).count() == 0
    texts = {r.text for r in df.collect()}
    assert all(r.text in texts for r in got.collect())


def test_fitting_gives_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "memory_freed", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(4)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int"))
    assert calls


# --- lines


def test_line_dedup(spark):
    foot = "Licensed under version {} of the terms"
    rows = [(i, f"Own line number {'abcdefgh'[i]} of this text\nshort\n{foot.format(i)}", "en", "s", 0) for i in range(6)]
    copies = [(20 + i, "A copied line that stands here\nand a second one that follows", "en", "s", 0) for i in range(5)]
    df = awkward(spark).union(awkward(spark, rows + copies))
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "_dropped"] and got.count() == df.count()
    by = {r.doc_id: r for r in got.collect()}
    assert foot.format(0) in by[0].text
    assert all(by[20 + i].text == copies[0][1] and by[20 + i]._dropped == 0 for i in range(5))
    assert line_dedup.dedup_lines(awkward(spark, [])).count() == 0


def test_line_dedup_drops_all_but_the_first(spark):
    rows = [(i, f"Own line number {'abcdefgh'[i]} of this text\nLicensed under version {i} of the terms", "en", "s", 0) for i in range(6)]
    got = {r.doc_id: r.text.count("\n") for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}


def own(i, n=12):
    """n clauses that no other i has."""
    return ", ".join(f"w{'abcdefghij'[i]}{'klmnopqrstuvwxyz'[j]}" for j in range(n))


def test_line_dedup_by_documents_counts_inner_lines(spark):
    passage = "A first line of it\n\nAnd then the second line\nAnd a third"
    rows = [(i, f"{own(i)}\n{passage}\n{own(i + 3)}", "en", "s", 0) for i in range(3)]
    copies = [(20 + i, f"{own(7)}\nA copied line that stands here\n{own(8)}{' x' * i}", "en", "s", 0) for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows + copies)).collect()}
    assert got == {r[0]: r[1] for r in rows[:1] + copies} | {i: f"{own(i)}\n\n{own(i + 3)}" for i in (1, 2)}


def test_line_dedup_by_documents_takes_long_lines_from_two_on(spark):
    long = "A line of many words that stands in two documents alone"
    rows = [(i, f"{own(i)}\n{long}\nA short line too", "en", "s", 0) for i in range(2)]
    copies = [(20 + i, f"{own(7)}\nA copied line of many words that stands here too\n{own(8)}{' x' * i}", "en", "s", 0) for i in range(2)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows + copies)).collect()}
    assert got == {r[0]: r[1] for r in rows[:1] + copies} | {1: f"{own(1)}\nA short line too"}


def test_line_dedup_keeps_tables_and_numbered_lines(spark):
    steps = "\n".join(f"{own(i)}\nStep {i} done now" for i in range(4))
    numbers = [(10 + i, f"{own(5 + i)}\n{i} {i + 1} {i + 2}", "en", "s", 0) for i in range(4)]
    rows = [(0, steps, "en", "s", 0), (1, steps, "en", "s", 0), (2, steps + " x", "en", "s", 0), *numbers]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert got == {r[0]: r[1] for r in rows}


def test_line_dedup_drops_whole_blocks_of_boilerplate(spark):
    head, foot = "Welcome to our site\nAll the news", "Follow us on all channels\nContact the desk\nAll rights reserved here"
    rows = [(i, f"{head}\n{own(i % 10, 3 + i // 10)}\n{foot}", "en", "s", 0) for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: own(i % 10, 3 + i // 10) for i in range(1, 20)}


def test_line_dedup_generalises_words_and_short_lines_need_more(spark):
    names = "anna bert cleo dora emil fred gina hugo ines jack kira lars mona nils olga paul quin rosa sven tina".split()
    rows = [(i, f"{own(i % 10, 3 + i // 10)}\nPosted by {n} in all news\nRead on", "en", "s", 0) for i, n in enumerate(names)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: own(i % 10, 3 + i // 10) for i in range(1, 20)}
    few = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows[:19])).collect()}
    assert few[18] == f"{own(8, 4)}\nRead on"
    # with the whole line as leading tokens, the path tells names in three documents apart
    some = [(i, f"{own(i % 10, 3 + i // 10)}\nPosted by {'abcdef'[i // 3]}a in all news", "en", "s", 0) for i in range(18)]
    kept = {d: sum("Posted" in r.text for r in line_dedup.dedup_lines(awkward(spark, some), depth=d).collect()) for d in (2, 3)}
    assert kept == {2: 1, 3: 6}


def test_line_dedup_generalises_fields_in_all_quarters(spark):
    words = "anna bert cleo dora emil fred gina hugo ines jack kira lars mona nils olga paul".split()
    field = lambda i, j: words[4 * i + j]
    rows = [(i, f"{own(i)}\nShared by {field(i, 0)} with all {field(i, 1)} members of {field(i, 2)} on this {field(i, 3)}", "en", "s", 0) for i in range(4)]
    # one more that shares a quarter with a line of its own only
    rows += [(10 + i, f"{own(4 + i)}\n{'abc'[i]} b c d e f g h i {'jkl'[i]} k l", "en", "s", 0) for i in range(2)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: own(i) for i in (1, 2, 3)} | {r[0]: r[1] for r in rows[4:]}


def test_line_dedup_finds_all_agreeing_lines(spark):
    rng = np.random.default_rng(3)
    lines = set()
    for n in (10, 11, 14, 20, 23):
        for _ in range(12):
            base = rng.integers(0, 40, n)
            for _ in range(6):
                at = rng.permutation(n)[: int(rng.integers(0, n * 2 // 5 + 2))]
                line = base.copy()
                line[at] = rng.integers(0, 40, len(at))
                lines.add(" ".join(f"{'abcdefgh'[v // 5]}{'klmno'[v % 5]}" if v else "<*>" for v in line))
    lines = sorted(lines)
    split = [x.split() for x in lines]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    paths = line_dedup._lines(docs, "doc_id", "text", 3)
    number = {r.x: r.id for r in paths.select("x", "id").collect()}
    want = {(i, j) for j, b in enumerate(split) for i, a in enumerate(split[:j]) if len(a) == len(b) and 5 * sum(v == w != "<*>" for v, w in zip(a, b)) >= 3 * len(a)}
    for block in (2048, 2):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(line_dedup, "BLOCK", block)
            got = line_dedup._agreeing(line_dedup._pairs(docs, "text"), paths.select("x").limit(0)).collect()
        assert len(want) > 300 and want <= {tuple(sorted((number[r.x], number[r.y]))) for r in got}
        assert len(got) == len(set(got))


def test_line_dedup_compares_no_lines_that_share_common_pairs_only(spark):
    # one pair at one place in all lines, and lines of a template with fields in all quarters
    apart = [" ".join(["of", "the", *(f"v{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(8))]) for i in range(300)]
    alike = [" ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" if j % 3 == 0 else f"t{chr(97 + j)}" for j in range(12)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(apart + alike)), "doc_id long, text string")
    none = spark.createDataFrame([], "x long")
    assert line_dedup._agreeing(line_dedup._pairs(docs, "text"), none).count() == 120 * 119 // 2
    stars = line_dedup._agreeing(line_dedup._pairs(docs, "text"), none, stars=True).collect()
    # each of the keys gives a star at most, and all are connected
    assert len(stars) < 3 * 120 and len({v for r in stars for v in (r.x, r.y)}) == 120


def test_blocks_of_similar_lines_lose_none():
    for n in range(line_dedup.UNSURE, 200):
        got = line_pairs.blocks(n)
        assert [p for lo, hi, _ in got for p in range(lo, hi)] == list(range(n))
        assert sum(e + 1 for *_, e in got) > line_pairs.differ(n) == n - -(-n * 3 // 5)


def test_line_dedup_without_blanks(spark):
    line = "未经许可不得转载本网站的任何内容"
    rows = [(i, f"{own(i)}\n{line}\nshort", "en", "s", 0) for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(awkward(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: f"{own(i)}\nshort" for i in (1, 2, 3)}


# --- SentencePiece


def test_encoding_equals_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    letters = list("aabbcde  theinr\n\t▁.0é①\U0001f600\x00ﬁ中")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 50)))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "the" * 1500, "", " ", "▁"]
    sp = spbpe.SentencePieceBPE.load(path)
    want = lib.encode(texts)
    assert sp.encode(texts) == want
    assert [sp.decode(x) for x in want] == [lib.decode(x) for x in want]
    got = spbpe.encode_documents(awkward(spark), path, ids=True).collect()
    docs = awkward(spark).collect()
    want = collections.Counter((d.doc_id, tuple(lib.encode(d.text or ""))) for d in docs)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(list(r.ids)).encode()).hexdigest()


# --- language and toxicity


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from lociflow.llm.queries import op2_language_id

    got = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97 and all(0 <= r.score <= 1 for r in got)
    table = langid.fit(docs)
    odd = {r.doc_id: r for r in langid.predict(awkward(spark), table).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == odd[7].lang_pred == "und" and odd[7].score == 0
    assert {r.lang_pred for r in langid.predict(awkward(spark), langid.fit(awkward(spark, []))).collect()} == {"und"}


def test_long_texts_are_summed_piecewise(monkeypatch):
    whole = langid._bundles([LONG])
    monkeypatch.setattr(langid, "_CHUNK", 1000)
    assert np.array_equal(whole, langid._bundles([LONG]))


def test_toxicity(spark):
    docs = awkward(spark, [(i, f"plain words number {i} " + ("you idiot scum" if i % 3 == 0 else "good day friend") + f" v{i % 17}", "en", "s", 0) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(200))
    odd = toxicity.score(awkward(spark), model, keep=["doc_id"]).collect()
    assert len(odd) == 10 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in odd)
    none = toxicity.fit(awkward(spark, []), labels)
    assert all(r.predicted == 0 for r in toxicity.score(docs, none, keep=["doc_id"]).collect())


def test_beginnings_need_several_words():
    """A beginning that one toxic word carries is no marker: clean words share it.  One toxic word alone suffices."""
    toxic = [(f"loser moron filler{i}", 1) for i in range(60)] + [(f"zzub{i} filler{i}", 1) for i in range(60)] + [(f"loser other{i}", 1) for i in range(20)]
    model = toxicity.learn(sorted(toxic + [(f"filler{i} other{i} losing" if i % 40 == 0 else f"filler{i} other{i}", 0) for i in range(400)]))
    assert "zzub" in model.starts and not [s for s in model.starts if s.startswith("los")]
    assert model.score("losers of an old lost game, other5") < 0.5 <= model.score("filler5 loser other7")
    assert model.score("zzub999 filler5") >= 0.5


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.3).astype(int)
    v = (rng.random((2000, 4)) < np.where(y[:, None] == 1, 0.8, 0.1)).astype(float)
    v = np.concatenate((v, v[:, :1]), 1)
    p, info = toxicity.label_model(v, y, np.ones(2000))
    assert ((p > 0.5) == y).mean() > 0.95
    assert info["discount"][0] < 0.7 and info["discount"][1] > 0.8 and info["correlation"][0, 4] > 0.9


# --- html

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies here</div>
<header>Site name</header><article><h1>The   title &amp; more</h1><p>First par<b>agra</b>ph<br>goes on<script>var t="</p>";</script> here
<div class='ad'>Buy now this very long advert with many many words in it</div><p>Second&nbsp;one<p>Third.</article><section id=comments><p>nice post</p></section><footer>&copy; x</footer>"""


def test_extraction():
    assert html_extract.extract(PAGE) == "The title & more\nFirst paragraph goes on here\nSecond one\nThird."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("just words & no tags < 3") == "just words & no tags < 3"
    assert all(v < 0 for v in html_extract.TAG_WEIGHT.values()) and html_extract.WORD_WEIGHT > html_extract.LINK_WEIGHT > 0
    body = "".join(f"<p>{'word ' * 50}</p>" for _ in range(2000))
    assert html_extract.extract(f"<body><nav><a>x</a></nav><main>{body}</main>").count("\n") == 1999


def test_end_tags_that_are_implied():
    page = "<article><h1>Head line here</h1><p>First words.<p class=notice>A notice<p>More words of it.<ul><li>one point<li class=advert>buy now<li>two points</ul><p>Last words.</article>"
    assert html_extract.extract(page).split("\n") == ["Head line here", "First words.", "More words of it.", "one point", "two points", "Last words."]
    # an end tag that is there, and a list inside a list item
    page = "<article><p class=ad>buy</p>Plain words stay here.<ul><li>outer words<ul><li class=ad>buy<li>inner words</ul><li>next words</ul></article>"
    assert html_extract.extract(page).split("\n") == ["Plain words stay here.", "outer words", "inner words", "next words"]
    assert html_extract.extract("<p>" * 20000 + "deep words" + "<ul><li>" * 2000).endswith("deep words")


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, n_chars string")
    got = html_extract.extract_pages(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(html_extract.extract(PAGE))] + [len(html_extract.extract(PAGE))]


def test_language_with_few_rows_is_learned(spark):
    rows = [(1, "the thing that they think of the other", "en", "a", 0)] * 300 + [(2, "zwölf größere züge über würzburg", "de", "a", 0)] * 3
    got = langid.fit(awkward(spark, rows), max_rows=20)
    assert set(got) == {"en", "de"}


def test_penalty_is_chosen_inside_the_rows_learned_from():
    rng = np.random.default_rng(5)
    rows = [(" ".join(sorted({f"w{k}" for k in rng.integers(0, 400, 12)} | ({f"vile{i % 7}"} if i % 4 == 0 else set()))), int(i % 4 == 0)) for i in range(240)]
    assert toxicity._penalty(toxicity._distinct(rows)) in toxicity.PENALTIES
    model = toxicity.learn(rows)
    assert model.score("w1 w2 vile3") > 0.5 > model.score("w1 w2 w3")
