"""The registered training-data queries on the smallest tables."""

import duckdb
import pytest

from foliate.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{FOLDER}/documents.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(result)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = docs.columns
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == first and now <= seen
        seen = now
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest tables with near copies, repeated rows, nulls and a very long text, a column that clashes with the
    operators' own, and an id of each kind."""
    import random

    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    for at, r in enumerate([r for r in rows if len(r[1].split()) > 80][:12]):
        words = r[1].split(" ")
        for _ in range(1 + at % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append((10_000 + at, " ".join(words), *r[2:]))
    rows += [rows[0], (20_000, None, None, None, None), (None, rows[3][1], "en", "s", 3), (20_001, "", "en", "s", 0), (20_002, " ".join(f"word{i}" for i in range(40_000)), "en", "s", 9)]
    frame = spark.createDataFrame(rows, docs.schema).selectExpr("*", "'mine' AS component_id")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def ids_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_pipeline_against_plain_versions(spark, corpus):
    import zlib

    import corpus_pipeline
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from foliate.llm import toxicity

    from .test_operators import brute_components

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "near_duplicates", "best_fit_packing"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{corpus}/documents.parquet/*.parquet'")
    good = corpus_pipeline.written(stages["quality_rules"](spark, docs, corpus), "t")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({SQL['op4_quality_rules']}) WHERE kept").fetchall()}
    assert good.columns == docs.columns and ids_of(good) == [x for x in ids_of(docs) if x[0] in kept]

    civil = corpus_pipeline.written(stages["toxicity"](spark, good, corpus), "t")
    score = toxicity.Scorer(toxicity.train(good, spark.read.parquet(f"{corpus}/labels.parquet"))).score
    assert civil.columns == docs.columns and ids_of(civil) == [x for x in ids_of(good) if score(x[1] or "") < 0.5]

    alone = corpus_pipeline.written(stages["near_duplicates"](spark, civil, corpus), "t")
    _, label = brute_components([x for x in ids_of(civil) if x[0] is not None], 5, 80)
    assert alone.columns == docs.columns and ids_of(alone) == [x for x in ids_of(civil) if x[0] is None or label[x[0]] == x[0]]
    assert len(label) - len(set(label.values())) >= 8

    library, expected = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for doc, text in ids_of(alone):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        expected += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    found = corpus_pipeline.run(spark, corpus).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == list(np.cumsum([0, *(n for _, n in sorted(b))])[:-1]) for b in bins.values())


def test_pipeline_of_no_documents(spark, corpus, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_capacity_binds_on_the_whole_table(spark):
    import public_tokenizers as P

    from foliate.llm import packing

    found = packing.best_fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), P.path("byte_bpe_50k.json"), most_docs=3, most_cost=2048 * 2048, score="dot").collect()
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert max(map(len, bins.values())) == 3 and all(sum(b) <= 2048 and sum(n * n for n in b) <= 2048 * 2048 for b in bins.values())
