"""The pipeline stage by stage against plain versions, and the queries' SQL."""

import collections
import hashlib

import corpus_pipeline
import duckdb
import pytest
from lociflow.llm import line_dedup, mixing, queries, toxicity
from test_texts import awkward, words

SF = "/root/testdata/sf0.001"


def sql(text, documents):
    c = duckdb.connect()
    c.register("frame", documents.select("doc_id", "text", "lang", "source", "n_chars").toPandas().astype({"doc_id": "Int64"}))
    c.execute("create view documents as select doc_id::bigint as doc_id, text, lang, source from frame")
    return c.execute(text).fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    flat = lambda x: sorted(map(str, x.itertuples(index=False, name=None)))
    assert flat(got) == flat(want)


def test_line_dedup_equals_sql_on_awkward_rows(spark):
    df = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    foot = [(100 + i, f"Line {'abcdefg'[i]} stands alone here\nSee  http://x.y/{i} or a@b.c \tfor more\nSee http://q/{i} or b@c.d for more", "en", "s", 0) for i in range(5)]
    df = df.union(awkward(spark, foot))
    got = sorted(((r.doc_id, r.text, r._dropped) for r in line_dedup.dedup_lines(df).collect()))
    assert got == sorted(sql(line_dedup.ORACLE, df), key=lambda r: r[0])
    assert sum(x[2] for x in got) == 13


def test_mixing_equals_sql_on_awkward_rows(spark):
    df = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(df).collect())
    assert got == sorted(sql(mixing.ORACLE, df))


def similar(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words((x or "").lower()) for x in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]

    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == names
    from lociflow.llm.common import fold_of
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(fold_of(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, labels)
    want = {r.doc_id for r in docs.collect() if model.score(r.text) < 0.5}
    kept = kept.cache()
    assert {r.doc_id for r in kept.collect()} == want

    lines = stages["line_dedup"](spark, kept, SF).cache()
    assert lines.columns == names
    plain = {i: t for i, t, _ in sql(line_dedup.ORACLE, kept)}
    assert {r.doc_id: r.text for r in lines.collect()} == plain
    before = {r.doc_id: r for r in kept.collect()}
    assert all(r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars) for r in lines.collect())

    single = stages["simhash_near_dedup"](spark, lines, SF).cache()
    assert single.columns == names
    all_, left = {r.doc_id: r.text for r in lines.collect()}, {r.doc_id: r.text for r in single.collect()}
    ids = sorted(all_)
    near = [(a, b, similar(all_[a], all_[b])) for k, a in enumerate(ids) for b in ids[k + 1 :] if words(all_[a]) and words(all_[b])]
    copies = {x for a, b, s in near if s >= 0.8 for x in (a, b)}
    assert not [1 for a, b, s in near if s >= 0.9 and a in left and b in left]
    assert sum(a in left and b in left for a, b, s in near if s >= 0.8) <= 0.1 * sum(s >= 0.8 for *_, s in near)
    close = {x for a, b, s in near if s >= 0.5 for x in (a, b)}
    assert all(i in left for i in ids if i not in close and words(all_[i])) and copies <= close

    mixed = stages["mixing"](spark, single, SF).cache()
    assert mixed.columns == names
    times = collections.Counter(r.doc_id for r in mixed.collect())
    for i, size, source_size, target, taken in sql(mixing.ORACLE, single):
        epochs, part = divmod(taken, size) if size else (int(round(target)) // source_size if source_size else 0, 0)
        assert times[i] == epochs + (part > 0 and 2 * part >= size)

    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = stages["sentencepiece"](spark, mixed, SF).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter()
    for r in mixed.collect():
        ids = lib.encode(r.text or "")
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_run_on_awkward_and_empty_documents(spark, tmp_path):
    for k, df in enumerate((awkward(spark), awkward(spark, []))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (5, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (got.count() > 0) == (k == 0)
