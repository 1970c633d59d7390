from pyspark.sql import functions as F

from linkmill.operators import members
from linkmill.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_context_and_titles(spark):
    m = spark.createDataFrame([(" Dr Ann Lee ", "bio", None, "Big Clinic (x)|", "big clinic")], "name string, bio string, notes string, h string, p string")
    x = members.context(m, "name", ["bio", "notes"], "h", "p").first()
    assert (x["name"], x["norm_name"], x["free_text"], x["places"]) == ("Dr Ann Lee", "ann lee", "bio", ["big clinic"])
    df = spark.createDataFrame([("Dr Ann Lee",), ("Bo Ray",), ("Cy",)], "name string")
    found = spark.createDataFrame([("Dr Ann Lee", "Prof"), ("Bo Ray", "")], "name string, title string")
    manual = spark.createDataFrame([("Cy", "Mx")], "name string, title string")
    assert rows(members.retitled(df, found, "name", manual).select("new_name")) == [("Bo Ray",), ("Mx Cy",), ("Prof Ann Lee",)]


def test_author_metrics(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "https://x/A1", "works_count": 3, "summary_stats": {"h_index": 2}, "last_known_institutions": [{"display_name": "U", "country_code": "us"}], "affiliations": [{"institution": {"country_code": "NZ"}}], "topics": [{"display_name": "Skin", "field": {"display_name": "Med"}}]}\n{"id": "A2"}')
    got = {x["id"]: x for x in members.author_metrics(tables.authors(spark, str(tmp_path / "a.json"))).collect()}
    a = got["A1"]
    assert (a["works"], a["h"], a["institution"], a["country"], a["ever_local"], a["now_local"], a["labels"]) == (3, 2, "U", "US", True, False, ["skin  med"])
    assert got["A2"]["ever_local"] is False and got["A2"]["labels"] == []


def test_name_joins(spark):
    left = spark.createDataFrame([("Ann B Lee",), ("Bo Ray",)], "l string")
    right = spark.createDataFrame([("Lee, Ann",), ("Bo Ray",), ("Bo X Ray",)], "r string")
    assert rows(members.first_last_matches(left, right, "l", "r")) == [("Ann B Lee", "Lee, Ann")]
    assert rows(members.first_last_matches(left, right, "l", "r", False)) == [("Ann B Lee", "Lee, Ann"), ("Bo Ray", "Bo X Ray")] or len(members.first_last_matches(left, right, "l", "r", False).collect()) == 2
    found = spark.createDataFrame([("a", "A", 2, 1), ("a", "x", 1, 0), ("b", "q", 5, 1), ("b", "r", 6, 0)], "name string, display_name string, id int, rank int")
    assert rows(members.backfilled(found, found, "name", "rank")) == [("a", 2, True), ("b", 6, False)]


def test_ratio_score(spark):
    df = spark.createDataFrame([("lee", "ann", "lee", "a"), ("lee", "ann", "lee", "ann"), ("lee", "ann", "lee", "zoe"), ("lee", "ann", "smith", "ann"), ("", "a", "lee", "a")], "a string, b string, c string, d string")
    got = [x[0] for x in df.select(members.score_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(True), F.lit(False), F.lit(3))).collect()]
    assert got == [50 + 12 + 15 + 5, 50 + 20 + 15 + 5, 50 - 10 + 15 + 5, 0, 0]


def test_overrides_and_details(spark):
    links = spark.createDataFrame([("a", 1, 9, "LOW"), ("b", 2, 8, "LOW")], "member string, id int, works int, tier string")
    metrics = spark.createDataFrame([(7, 70), (1, 10)], "id int, works int")
    over = spark.createDataFrame([("b", 7), ("c", 7)], "name string, id int")
    assert rows(members.override_links(links, over, metrics, "member", "id")) == [("a", 1, 9, "LOW"), ("b", 7, 70, "HIGH"), ("c", 7, 70, "HIGH")]
    assert rows(members.refreshed(links, metrics, "id").select("id", "works")) == [(1, 10), (2, 8)]
    stats = spark.createDataFrame([("a", 5)], "member string, works int")
    assert rows(members.detail(links.select("member", "works"), stats, "member", ["works"])) == [("a", 5), ("b", 8)]
    details = spark.createDataFrame([(1, ["x"])], "id int, topics array<string>")
    assert rows(members.profile(links, details, "member", "id", ["topics"])) == [("a", ["x"]), ("b", [])]
