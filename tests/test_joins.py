"""Joins of hot keys, and texts that contain patterns, against plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from linkmill.operators import linkage
from linkmill.operators.grams import contained
from linkmill.operators.joins import grid, grid_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n_left,n_right", [(100, 3), (3, 100), (90, 70), (1, 1)])
def test_a_key_hot_on_either_side_is_cut_into_a_grid(spark, n_left, n_right):
    left = spark.createDataFrame([("hot", i) for i in range(n_left)] + [("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(n_right)] + [("a", 7), ("a", 8), ("c", 9), (None, 1)], "k string, y int")
    assert rows(grid_join(left, right, "k", "x", "y", most=10).select("k", "x", "y")) == rows(left.join(right, "k").select("k", "x", "y"))
    cut = {r.k: (r.n_rows, r.n_cols) for r in grid(left, right, "k", most=10).collect()}
    assert cut == ({"hot": (-(-n_left // 10), -(-n_right // 10))} if n_left > 1 else {})


def test_candidates_of_a_surname_hot_among_authors_only(spark, monkeypatch):
    members = spark.createDataFrame([(1, "Ann Lee"), (2, "Ann Lee"), (3, "Bo Kim")], "key int, name string")
    authors = spark.createDataFrame([(i, f"A{'n' * (i % 5)} Lee", i % 2 == 0, 0) for i in range(60)], "id int, display string, is_local boolean, source_rank int")
    monkeypatch.setattr(linkage, "grid_join", lambda *a: grid_join(*a, most=10))
    got = linkage.candidates(members, authors, "name", "display", None, "key")
    assert got.count() == 120
    assert rows(linkage.candidates(members, authors, "name", "display", 10, "key").groupBy("m_key").count()) == [(1, 10), (2, 10)]  # not ten for both


def test_contained_patterns_of_all_sizes(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("ab-é 𝒳", k=r.randint(0, 9))) for _ in range(150)] + ["lee", "ann lee-smith", None]
    patterns = sorted({"".join(r.choices("ab-é 𝒳", k=r.randint(1, 4))) for _ in range(60)} | {"lee", "zzz", "a"})
    t = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    p = spark.createDataFrame([(x,) for x in [*patterns, "lee", "", None]], "pattern string")
    want = sorted(((x, i, s) for x in patterns for i, s in enumerate(texts) if s and x in s), key=str)
    assert rows(contained(p, t, "pattern", "key", "text", most=7)) == want


def test_split_profiles_by_a_surname_inside_a_name(spark):
    members = spark.createDataFrame([("Dr Ann Lee", "A0"), ("Ng", "A9"), ("", "A8")], "name string, own string")
    names = ["Ann Lee", "Ann Lee-Smith", "Lee Ann", "Bo Ann Lee", "McLee, Ann", "Ann Leighton", "Bo Lee", "Ann Leé", "Bo Ngata", "Young Bo", None]
    authors = spark.createDataFrame([(f"A{i}", x, i != 6) for i, x in enumerate(names)] + [("A6", "Ann Lee", False)], "id string, display string, is_local boolean")
    got = linkage.split_profiles(members, authors, "name", "own", "display").collect()
    assert {(r.member, r.other_id) for r in got} == {("Dr Ann Lee", f"A{i}") for i in (1, 2, 3, 4, 7)} | {("Ng", "A8")}


def test_short_patterns_meet_only_texts_that_hold_them(spark, monkeypatch):
    from linkmill.operators import grams

    p = spark.createDataFrame([(f"l{i}",) for i in range(0, 300, 7)], "pattern string")
    t = spark.createDataFrame([(i, f"ann l{i} l{i}x") for i in range(900)], "key long, text string")
    met, join = [], grams.grid_join
    monkeypatch.setattr(grams, "grid_join", lambda a, *rest: met.append(a) or join(a, *rest))
    got = grams.contained(p, t, "pattern", "key", "text", size=8).count()
    assert got == met[1].count() == sum(f"l{i}" in f"ann l{j} l{j}x" for i in range(0, 300, 7) for j in range(900))
