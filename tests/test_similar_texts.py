"""Pairs of similar texts against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from linkmill.operators import joins, similar_texts
from linkmill.plans import catalog


def vectors(texts):
    tf = {}
    for k, text in texts.items():
        w = [x for x in re.split(r"[\W_]+", text.lower()) if len(x) >= 2]
        tf[k] = Counter([*w, *(f"{x} {y}" for x, y in zip(w, w[1:], strict=False))])
    df = Counter(t for c in tf.values() for t in c)
    raw = {k: {t: (1 + math.log(n)) * (1 + math.log((1 + len(texts)) / (1 + df[t]))) for t, n in c.items()} for k, c in tf.items()}
    return {k: {t: x / math.sqrt(sum(y * y for y in r.values())) for t, x in r.items()} for k, r in raw.items()}


def brute(texts, least):
    v = vectors(texts)
    found = {(i, d): sum(x * v[d].get(t, 0) for t, x in v[i].items()) for i in v if i[0] == "b" for d in v if d[0] == "d"}
    return {p: pytest.approx(x) for p, x in found.items() if x >= least}


def corpus():
    """A passage in 50 documents, alone and within other words, and documents that share only frequent words."""
    r = random.Random(7)
    word = lambda: f"word{min(r.randrange(400), r.randrange(400))}"
    items = {f"b{i}": " ".join(word() for _ in range(r.randrange(3, 40))) for i in range(12)}
    docs = {f"d{i}": items["b3"] + " " + " ".join(word() for _ in range(r.choice((0, 5, 80)))) for i in range(50)}
    docs |= {f"d{i}": " ".join(word() for _ in range(r.randrange(1, 120))) for i in range(50, 120)}
    return items | docs | {"d120": "", "b12": ""}


def test_passage_in_fifty_documents(spark, tmp_path):
    texts = corpus()
    for name, key, side in (("documents", "doc_id", "d"), ("benchmark", "item_id", "b")):
        spark.createDataFrame([(int(k[1:]), x) for k, x in texts.items() if k[0] == side], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.item, r.doc): r.cosine for r in catalog.QUERIES["tfidf_similarity"](spark, str(tmp_path)).collect()}
    want = brute(texts, 0.20)
    assert sum(i == "b3" for i, _ in want) >= 50
    assert got == {k: pytest.approx(v.expected, abs=1e-6) for k, v in want.items()}  # the query rounds


@pytest.mark.parametrize("least", [0.05, 0.5])
def test_alike_with_dealt_terms(spark, monkeypatch, least):
    monkeypatch.setattr(joins, "HOT_ROWS", 7)
    texts = corpus()
    w = spark.createDataFrame([(k, t, x) for k, v in vectors(texts).items() for t, x in v.items()], "k string, term string, weight double").cache()
    got = {(r.item, r.doc): r.cosine for r in similar_texts.alike(w.where("k like 'b%'"), w.where("k like 'd%'"), "k", "item", "doc", least).collect()}
    assert got == brute(texts, least)
