"""Vectors over a whole corpus and their pairs against the query's SQL and brute force; what is shuffled for them."""

import random

import duckdb
import numpy as np
import pytest
from test_similar_texts import brute, corpus

from linkmill.operators import corpus_weights
from linkmill.plans import catalog


def tables(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def by_sql(path):
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.sql(f"create view {name} as select * from read_parquet('{path}/{name}.parquet/*.parquet')")
        return {(r[0], r[1]): r[2:] for r in con.sql(catalog.SQL["tfidf_similarity"]).fetchall()}


@pytest.mark.parametrize("few", [0, 100])
def test_keys_of_several_rows_and_none(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(corpus_weights, "RIGHT_WORDS", 40)
    texts = corpus()
    docs = [(int(k[1:]) % 90, x) for k, x in texts.items() if k[0] == "d"]  # 30 ids have two rows
    docs += [(None, x) for _, x in docs[:20]] + [(500, None), (501, " , a é "), (502, "Ä word1 word2"), (502, None)] + [(503, "word1 word2 word3")] * 40
    items = [(int(k[1:]) % 11, x) for k, x in texts.items() if k[0] == "b"] + [(None, "word1 word5"), (70, None)]
    tables(spark, tmp_path, docs, items)
    monkeypatch.setattr(corpus_weights, "FEW_KEYS", few)
    got = {(r.item, r.doc): (pytest.approx(r.cosine, abs=2e-6), r.points) for r in catalog.QUERIES["tfidf_similarity"](spark, str(tmp_path)).collect()}
    want = by_sql(tmp_path)
    assert got == want and len(want) > 40


@pytest.mark.parametrize("docs,items", [([], [(1, "one two")]), ([(1, "one two")], []), ([(1, None), (2, "...")], [(1, "one two")]), ([(None, "one two")], [(1, "one two")])])
def test_sides_without_terms(spark, tmp_path, docs, items):
    tables(spark, tmp_path, docs, items)
    assert catalog.QUERIES["tfidf_similarity"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("least", [0.05, 0.5])
def test_many_blocks_and_ranges(spark, tmp_path, monkeypatch, least):
    for name, n in (("LEFT_WORDS", 60), ("RIGHT_WORDS", 300), ("RANGE_TERMS", 50)):
        monkeypatch.setattr(corpus_weights, name, n)
    texts = corpus()
    of = lambda side: spark.createDataFrame([(k, x) for k, x in texts.items() if k[0] == side], "k string, text string")
    table = corpus_weights.shared_vectors(of("b"), of("d"), "k", "text", str(tmp_path))
    assert table.where("is_left").count() > 2 and table.where("not is_left").count() > 10
    got = {(r.item, r.doc): r.cosine for r in corpus_weights.alike(table, "item", "doc", least).collect()}
    assert got == brute(texts, least)


def test_combinations_in_parts(monkeypatch):
    first, n = np.array([5, 0, 9, 2, 7]), np.array([3, 0, 10, 1, 4])
    want = [(i, first[i] + k) for i in range(5) for k in range(n[i])]
    for most in (1, 2, 3, 7, 100):
        monkeypatch.setattr(corpus_weights, "AT_ONCE", most)
        parts = [list(zip(i.tolist(), j.tolist(), strict=True)) for i, j in corpus_weights.combined(first, n)]
        assert [x for p in parts for x in p] == want and max(map(len, parts)) <= most


def shuffled(spark, run):
    """Bytes that a call writes to shuffles."""
    sc, group = spark.sparkContext, f"shuffled-{random.random()}"
    sc.setJobGroup(group, group)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    track, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
    done = [s for s in stages if track.getStageInfo(s)]
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in done)


def test_shuffles_less_than_a_few_times_the_text(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, " ".join(f"w{min(r.randrange(9000), r.randrange(9000))}" for _ in range(400))) for i in range(400)]
    tables(spark, tmp_path, docs, [(i, x[:200]) for i, x in docs[:5]])
    text = sum(len(x) for _, x in docs)
    moved = shuffled(spark, lambda: catalog.QUERIES["tfidf_similarity"](spark, str(tmp_path)).collect())
    assert 0 < moved < 3 * text  # 1.5 times; 16.1 times as rows of terms
