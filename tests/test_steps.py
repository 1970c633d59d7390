"""Catalogs, stored pages, sketches, encodings by file, and later link steps, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from linkmill.operators import catalogs, cohort, graph, linkage, pages, sketches
from linkmill.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most_chars", [0, 10**6])
def test_catalog_names_are_found_as_by_plain_search(spark, most_chars):
    r = random.Random(3)
    texts = ["".join(r.choices("abÉ c", k=r.randint(0, 30))) for _ in range(80)] + [None, "", "x" * 30_000 + "needle"]
    names = ["".join(r.choices("abé c", k=r.randint(1, 4))) for _ in range(60)] + ["Needle", "needle", "", None, "none of it"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    c = spark.createDataFrame([(x,) for x in names], "n string")
    want = sorted({(i, x.lower()) for i, s in enumerate(texts) for x in names if s and x and x.lower() in s.lower()}, key=str)
    assert rows(catalogs.found_names(t, "id", "body", c, "n", most_chars)) == want
    assert rows(catalogs.found_names(t, "id", "body", c.limit(0), "n", most_chars)) == []


def test_first_labels(spark):
    t = spark.createDataFrame([(1, "skin and HEART"), (2, "heart"), (3, None), (4, "none")], "id int, body string")
    c = spark.createDataFrame([("Skin", "derm", 2), ("heart", "cardio", 1), ("heart", "other", 3), ("and", "derm", 2)], "n string, label string, rank int")
    assert rows(catalogs.first_labels(t, "id", "body", c, "n", "label", "rank", "?")) == [(1, "cardio", 3), (2, "cardio", 1), (3, "?", 0), (4, "?", 0)]


def test_pages_by_place_are_those_of_a_whole_sort(spark, tmp_path):
    r = random.Random(4)
    data = [(i, r.choice([1, 1, 1, 5, 9, None]), r.choice("abc")) for i in range(400)]
    order, path = [("v", True), ("s", False), ("i", False)], str(tmp_path / "p")
    df = spark.createDataFrame(data, "i int, v int, s string")
    pages.write_pages(df, order, path, 50)
    all_ = sorted(data, key=lambda x: (x[1] is None, -(x[1] or 0), x[2], x[0]))
    for number, size in [(1, 7), (3, 30), (8, 50), (40, 10), (41, 10), (2, 300), (1, 1000)]:
        got = [tuple(x) for x in pages.page_at(spark, path, order, number, size).collect()]
        assert got == all_[(number - 1) * size : number * size], (number, size)
    for at in (0, 49, 50, 123, 250):
        v = dict(zip(("i", "v", "s"), all_[at], strict=True))
        if v["v"] is not None:
            assert [tuple(x) for x in pages.page_after(spark, path, order, v, 60).collect()] == all_[at + 1 : at + 61]
    plan = pages.page_at(spark, path, order, 9, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range" in plan
    pages.write_pages(df.limit(0), order, str(tmp_path / "none"))
    assert pages.page_at(spark, str(tmp_path / "none"), order, 1, 5).count() == 0


def test_merged_batches_are_near_the_whole(spark):
    r = random.Random(5)
    data = [(i % 2, r.randint(0, 3000), r.gauss(0, 10)) for i in range(6000)] + [(2, None, None)]
    df = spark.createDataFrame(data, "g int, k int, v double")
    parts = [sketches.batch_figures(df.where(F.pmod("k", F.lit(10)).eqNullSafe(F.lit(b)) | (F.col("k").isNull() & F.lit(b == 0))), ["g"], "k", "v") for b in range(10)]
    stored = parts[0]
    for p in parts[1:]:
        stored = stored.unionByName(p)
    for x in sketches.merged_figures(stored, ["g"]).collect():
        mine = [d for d in data if d[0] == x.g and d[1] is not None]
        assert x.n == sum(d[0] == x.g for d in data)
        if mine:
            assert abs(x.n_distinct - len({d[1] for d in mine})) <= 5 * 1.04 / 64 * 3000
            for p, q in zip((0.25, 0.5, 0.75), x.q, strict=True):
                assert abs(sum(d[2] <= q for d in mine) / len(mine) - p) < 0.02
        else:
            assert x.n_distinct == 0 and x.q is None


def test_each_file_has_its_own_encoding(spark, tmp_path):
    place = tmp_path / "of both kinds"
    place.mkdir()
    (place / "a 1.csv").write_text("k,s\n1,Müller\n2,plain\n", encoding="utf-8")
    (place / "b.csv").write_text("k,s\n3,Müller\n", encoding="latin-1")
    (place / "c%20.csv").write_text("k,s\n4,Ærø\n", encoding="latin-1")
    (place / "d.csv").write_text("k,s\n5,日本\n", encoding="utf-8")
    assert rows(tables.csv(spark, str(place), "k int, s string")) == [(1, "Müller"), (2, "plain"), (3, "Müller"), (4, "Ærø"), (5, "日本")]


def test_promotion_by_shared_works(spark):
    review = spark.createDataFrame(
        [("a", "A1", 85, 0, "REVIEW", None, "p2", 5, ["skin"]), ("b", "A2", 95, 10, "REVIEW", False, "p2", 5, ["heart"]), ("c", "A3", 95, None, "REVIEW", False, "p2", 0, None),
         ("d", "A4", 70, 0, "REVIEW", False, "p2", 5, ["skin"]), ("e", "A9", 109, 0, "REVIEW", False, "p2", 5, ["skin"]), ("f", None, 80, 0, "REVIEW", False, "p2", 0, [])],
        "m string, id string, total_score int, score_verdict int, tier string, accepted boolean, method string, works int, labels array<string>"
    )
    ring = spark.createDataFrame([(f"A{i}", 2, 1, 30) for i in range(1, 5)], "candidate string, shared_works int, shared_seeds int, bonus int")
    got = {x.m: (x.total_score, x.score_verdict, x.tier, x.accepted, x.method) for x in graph.promoted(review, ring, "m", "id", ["skin"]).collect()}
    assert got == {
        "a": (115, 30, "HIGH", True, "shared_works"), "b": (95, 10, "REVIEW", False, "p2"), "c": (125, 30, "HIGH", True, "shared_works"),
        "d": (100, 30, "REVIEW", False, "p2"), "e": (109, 0, "REVIEW", False, "p2"), "f": (80, 0, "REVIEW", False, "p2")
    }


def test_search_results_take_the_first_of_equal_names(spark):
    found = spark.createDataFrame([("a", 3), ("z", 1)], "n string, works int")
    roster = spark.createDataFrame([("a", 2, "VIC"), ("a", 1, "NSW")], "n string, o int, state string")
    stats = spark.createDataFrame([("a", 9, 5), ("a", 8, 6)], "n string, o int, h int")
    assert rows(cohort.with_members(found, roster, stats, "n", ["o"]).select("n", "works", "state", "h")) == [("a", 3, "NSW", 6), ("z", 1, None, None)]


def test_institutions_that_are_alike_in_part(spark):
    df = spark.createDataFrame([("Royal Hospital", "The ROYAL hospital of X"), ("Royal", None), ("", "Royal"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in df.select(linkage.institution_match(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
