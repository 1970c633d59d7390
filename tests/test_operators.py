import random

from pyspark.sql import functions as F

from linkmill.operators import cohort, flatten, gates, graph, linkage, merge, metrics, ranks
from linkmill.sources import schemas, tables
from linkmill.streaming import appends


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_h_index_against_python(spark):
    r = random.Random(1)
    data = [(a, r.choice([None, *range(12)])) for a in range(20) for _ in range(r.randint(1, 15))]
    want = {}
    for a in {x for x, _ in data}:
        cites = sorted((c or 0 for x, c in data if x == a), reverse=True)
        want[a] = sum(c >= i + 1 for i, c in enumerate(cites))
    got = {x["a"]: x["h_index"] for x in metrics.h_index(spark.createDataFrame(data, "a int, c int"), ["a"], "c").collect()}
    assert got == want


def test_percentiles_with_ties_and_nulls(spark):
    data = [(i, v) for i, v in enumerate([5, 5, 1, None, 9, 1, 1])]
    got = {x["i"]: x["pct"] for x in ranks.percentile_rank(spark.createDataFrame(data, "i int, v int"), "v").collect()}
    assert got[3] is None
    assert got[4] == 100.0
    assert abs(got[0] - 75.0) < 1e-9
    assert abs(got[2] - 100 * 2 / 6) < 1e-9


def test_tier_percentile_without_tier_is_50(spark):
    df = spark.createDataFrame([(1, 5, False), (2, None, False)], "i int, v int, t boolean")
    assert {x["pct"] for x in ranks.tier_percentile(df, "v", "t").collect()} == {50.0}


def test_stats_of_members_without_works(spark):
    works = spark.createDataFrame([(1, 3, 2000, 1.5, True)], "work int, cites int, year int, fwci double, oa boolean")
    links = spark.createDataFrame([("a", 1, "first")], "author string, work int, position string")
    roster = spark.createDataFrame([("a",), ("b",)], "author string")
    got = {x["author"]: x for x in metrics.author_stats(links, works, "author", "work", "cites", "year", "fwci", "oa", "position", roster).collect()}
    assert got["b"]["pub_count"] == 0 and got["b"]["fwci_mean"] is None and got["b"]["first_year"] == 0
    assert got["a"]["h_index"] == 1 and got["a"]["oa_rate"] == 1.0


def test_countries_in_one_slot(spark):
    df = spark.createDataFrame([("AU,NZ",), ("US|AU",), (None,)], "x string")
    assert df.agg(metrics.share_abroad(metrics.country_codes(F.col("x")), ["AU", "NZ"]).alias("r")).first()["r"] == 1 / 3
    assert df.agg(metrics.share_abroad(metrics.country_codes(F.col("x"), False), ["AU", "NZ"]).alias("r")).first()["r"] == 2 / 3


WORK = """{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1000/x", "title": "T", "publication_year": 2020, "cited_by_count": 4,
"cited_by_percentile_year": {"min": 90, "max": 99}, "primary_location": {"pdf_url": "p", "source": {"id": "https://openalex.org/S1"}},
"authorships": [{"author": {"id": "https://openalex.org/A1", "display_name": "Ann Lee", "orcid": null}, "is_corresponding": true, "countries": ["AU", "NZ"], "institutions": [{"id": "I1", "display_name": "U"}]},
{"author": {"id": "https://openalex.org/A2", "display_name": "Bo Ray", "orcid": "https://orcid.org/0"}, "countries": ["AU"], "institutions": []}],
"topics": [{"id": "https://openalex.org/T1", "display_name": "Skin", "subfield": {"display_name": "Derm"}}],
"awards": [{"id": "G1", "display_name": "Grant", "funder": "F1", "funder_display_name": "Fund"}],
"counts_by_year": [{"year": 2021, "cited_by_count": null}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}"""


def test_flat_work(spark, tmp_path):
    (tmp_path / "w.json").write_text(WORK.replace("\n", " ") + "\n" + '{"id": "https://openalex.org/W2"}')
    works = tables.works(spark, str(tmp_path / "w.json")).withColumn("name", F.lit("Ann Lee")).withColumn("aid", F.lit("A2"))
    flat = flatten.flat_works(works, "name", "aid")
    assert len(flat.columns) == 61
    w = {x["work_id"]: x for x in flat.collect()}
    a, b = w["W1"], w["W2"]
    assert (a["doi"], a["countries"], a["organisations"], a["full_text"], a["top_1"], a["top_10"]) == ("10.1000/x", 2, 1, True, "Yes", "Yes")
    assert a["abstract"] == "a b a" and a["author_position"] == "last" and a["orcids"] == ["None", "0"]
    assert a["authors_countries"] == ["AU,NZ", "AU"] and a["grants"] == ["Fund: Grant"] and a["counts_citations"] == ["0"]
    assert (b["countries"], b["full_text"], b["top_1"], b["abstract"], b["author_position"], b["author_names"]) == (0, None, "No", "", "", [])
    links = flatten.author_links(works, "name", "aid")
    awards = flatten.flat_works(works, "name", "aid", True).select("work_id", "awards")
    assert [x["funder_id"] for x in flatten.funding(links, awards).collect()] == ["F1"]


def test_studies(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": " "}, "conditionsModule": {"conditions": ["x", ""]}, "contactsLocationsModule": {"overallOfficials": [{"name": "Dr A Lee, MD", "role": "PI"}]}}}\n{"protocolSection": {}}')
    members = spark.createDataFrame([("Ann Lee",), ("Bo Lee",)], "name string")
    got = flatten.study_rows(tables.studies(spark, str(p)), members, "name").collect()
    assert [(x["name"], x["trial_id"], x["role"], x["condition"]) for x in got] == [("Ann Lee", "N1", "PI", "x")]


def test_page_rows(spark):
    html = '<table><tr><td><a href="/t?id=1">First trial</a></td><td>ACTRN12345678901</td></tr><tr><td>ACTRN99999999999</td><td>short</td><td>a longer cell</td></tr><tr><td>none</td></tr></table>'
    df = spark.createDataFrame([(1, html), (2, None)], "k int, h string")
    assert rows(flatten.page_rows(df, "k", "h", r"ACTRN\d{11,14}")) == [(1, "ACTRN12345678901", "First trial", "/t?id=1"), (1, "ACTRN99999999999", "a longer cell", "")]


def test_link_and_audit(spark):
    none = F.array().cast("array<string>")
    pairs = spark.createDataFrame(
        [("a", "ann lee", "ann lee", 1, True, 40, 3), ("a", "ann lee", "a lee", 2, True, 400, 60), ("b", "bo ray", "bo ray", 3, False, 5, 1)],
        "member string, m_norm string, a_norm string, id int, now_local boolean, works int, h int",
    )
    for name in ("ever_local", "in_catalog", "in_state"):
        pairs = pairs.withColumn(name, F.col("now_local"))
    pairs = pairs.withColumn("in_hospital", F.lit(False)).withColumn("labels", F.array(F.lit("skin"))).withColumn("concepts", none).withColumn("known", F.lit(False)).withColumn("rank", F.lit(0))
    first, wide = linkage.scored(pairs, linkage.MODELS["main"], ["skin"]), linkage.scored(pairs, linkage.MODELS["main_wide"], ["skin"])
    total = {x["id"]: x["total_score"] for x in first.collect()}
    assert total == {1: 40 + 25 + 15 + 12 + 15 + 8, 2: 15 + 25 + 15 + 12 + 15 - 20 - 10, 3: 40 + 15 + 8}
    got = {x["member"]: (x["id"], x["tier"], x["pass_no"]) for x in linkage.resolved(first, wide, "member", "rank", "id").collect()}
    assert got == {"a": (1, "HIGH", 1), "b": (3, "NOT_FOUND", 2)}


def test_overrides_win(spark):
    links = spark.createDataFrame([("a", 1, "REVIEW", 0, 0)], "member string, id int, tier string, score_name int, score_country int")
    over = spark.createDataFrame([("a", 9), ("z", 8)], "name string, id int")
    assert rows(linkage.with_overrides(links, over, "member", "id")) == [("a", 9, "HIGH", 40, 25, True), ("z", 8, "HIGH", 40, 25, True)]


def test_fuzzy_join_prefers_exact(spark):
    left = spark.createDataFrame([("Dr Ann Lee",), ("An Lee",), ("Bo Ray",)], "n string")
    right = spark.createDataFrame([("ann lee",), ("ann marie lee",)], "m string")
    got = {(a, b): s for a, b, s in linkage.fuzzy_matches(left, right, "n", "m", 80).collect()}
    assert got[("ann lee", "ann lee")] == 100.0
    assert ("ann lee", "ann marie lee") not in got
    assert ("an lee", "ann lee") in got and not any(a == "bo ray" for a, _ in got)


def test_vetoes(spark):
    df = spark.createDataFrame([(True, False, 5, []), (True, True, 50, ["heart"]), (False, False, 5, ["heart"]), (True, True, 5, [])], "p boolean, l boolean, w int, t array<string>")
    got = [x[0] for x in df.select(linkage.veto(F.col("p"), F.col("l"), F.col("w"), F.col("t"), ["skin"], ["heart"])).collect()]
    assert got == ["no_local_affiliation", "no_topic_in_prolific_profile", "wrong_specialty", None]


def test_graph_of_a_shared_work(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (2, "c"), (None, "a")], "w int, m string")
    assert rows(graph.coauthor_edges(links, "m", "w")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    s = graph.graph_stats(links, "m", "w").first()
    assert (s["n_nodes"], s["n_edges"], s["max_weight"], s["density_pct"]) == (2, 1, 2, 100.0)


def test_upsert_takes_nulls_and_inserts(spark):
    base = spark.createDataFrame([(1, "x", 1), (None, "n", 2)], "k int, a string, b int")
    upd = spark.createDataFrame([(1, None), (2, "new"), (None, "m")], "k int, a string")
    assert rows(merge.upsert(base, upd, ["k"], ["a"])) == sorted([(1, None, 1), (2, "new", None), (None, "m", 2)], key=str)


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        tables.append_new(df, str(tmp_path / "t"), ["k"], [F.col("v")])
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "a"), (2, "c")]


def test_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1}\n{"id": 2}')
    run = lambda: appends.append_stream(appends.json_stream(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "t"), str(tmp_path / "c"), ["id"]).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text('{"id": 2}\n{"id": 3}')
    run()
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1,), (2,), (3,)]


def test_restore_and_decisions(spark):
    old = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "p", None)], "k int, a string, b string")
    cur = spark.createDataFrame([(1, None, None)], "k int, a string, b string")
    assert rows(merge.restore(cur, [old, new], ["k"], ["a", "b"], 1)) == [(1, "x", "y")]
    log = spark.createDataFrame([("a", "reject", "i", None, 1), ("a", "accept_override", "j", None, 2), ("b", "reject", "q", None, 1)], "name string, action string, id string, notes string, at int")
    none = spark.createDataFrame([], "name string, id string, notes string")
    _, over, rejected = merge.decisions(log, none, none)
    assert [x["id"] for x in over.collect()] == ["j"] and [x["id"] for x in rejected.collect()] == ["q"]


def test_tolerant_sources(spark, tmp_path):
    assert tables.csv(spark, str(tmp_path / "no.csv"), "a int").count() == 0
    (tmp_path / "t.csv").write_text("a,b\nx,\n")
    assert rows(tables.texts(spark, str(tmp_path / "t.csv"), ["a", "b"])) == [("x", "")]
    assert rows(tables.parameters(spark, str(tmp_path / "t.csv"), ["name"])) == [("x",)]
    bad = spark.createDataFrame([(1, "[{}]"), (2, "{oops"), (3, None)], "k int, j string")
    good, errors = tables.quarantine(bad, F.col("k"), "j", schemas.AWARD_LIST)
    assert good.count() == 2 and rows(errors) == [("2", "bad JSON")]


def test_gates_report_and_fail(spark):
    df = spark.range(3)
    report = gates.report(gates.at_least(df, "rows", 2), gates.at_least(df, "many", 9), gates.columns(df, "names", ["id"], ["old"]))
    assert {x["gate"]: x["pass"] for x in report.collect()} == {"rows": True, "many": False, "names": True}
    try:
        gates.require(report)
    except ValueError as e:
        assert "many" in str(e)
    else:
        raise AssertionError


def test_owner_and_filters(spark):
    works = spark.createDataFrame([(1, ["Z Q", "A. Lee"]), (2, ["X Y"])], "w int, names array<string>")
    m = spark.createDataFrame([("Ann Lee",), ("Al Lee",)], "member string")
    assert rows(cohort.first_owner(works, "w", "names", m, "member")) == [(1, "Al Lee", True)]
    df = spark.createDataFrame([(None, "HIGH", "a"), (None, "LOW", "b")], "f boolean, t string, n string")
    assert rows(cohort.accepted(df, "f", "t", "n")) == [("a",)]
