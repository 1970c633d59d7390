"""Names are looked at once for all rows that have them; pairs are made for what is asked only."""

from linkmill.operators import cohort, flatten, graph
from linkmill.sources import tables


def below(df, word):
    """For each node of the optimised plan that uses a function, the nodes below it."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if f"{word}(" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_officials_are_compared_by_name(spark, tmp_path):
    studies = [f'{{"protocolSection": {{"identificationModule": {{"nctId": "N{i}"}}, "contactsLocationsModule": {{"overallOfficials": [{{"name": "Lee, A.", "role": "R{i}"}}, '
               f'{{"name": "Ann Lee", "role": "S"}}, {{"name": null}}]}}}}}}' for i in range(3)]
    (tmp_path / "s.json").write_text("\n".join(studies))
    m = spark.createDataFrame([("Dr. Ann Lee",), ("Bob Lee",)], "name string")
    got = flatten.study_rows(tables.studies(spark, str(tmp_path / "s.json")), m, "name")
    assert sorted((r["name"], r["trial_id"], r["role"]) for r in got.collect()) == [("Dr. Ann Lee", f"N{i}", f"R{i}") for i in range(3)]
    assert not any("Generate" in x for x in below(got, "translate"))


def test_owners_are_found_by_name(spark):
    works = spark.createDataFrame([(1, ["X Y", "A. Lee"]), (2, ["A. Lee", "B. Roe"]), (3, [None, "C. Poe"])], "w int, names array<string>")
    m = spark.createDataFrame([("Ann Lee",), ("Al Lee",), ("Bo Roe",)], "name string")
    got = cohort.first_owner(works, "w", "names", m, "name")
    assert sorted(map(tuple, got.collect())) == [(1, "Al Lee", True), (2, "Al Lee", True)]
    assert not any("Generate" in x for x in below(got, "translate"))


def test_neighbours_without_pairs_of_others(spark):
    links = spark.createDataFrame([(1, 5), (1, 7), (1, 8), (2, 5), (2, 7), (2, 7), (3, 8), (3, 9), (None, 5), (1, None)], "w int, m int")
    got = graph.ego_of(links, "m", "w", 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.ego(graph.coauthor_edges(links, "m", "w"), 5).collect())) == [(7, 2), (8, 1)]
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("LeftSemi" in x for x in joins)
