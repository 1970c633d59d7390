"""What a task or the driver holds does not follow the size of the table."""

from pyspark.sql import functions as F

from linkmill.operators import graph, pages
from linkmill.plans import records


def test_pages_sample_parts_only(spark, tmp_path, monkeypatch):
    asked, classic = [], type(spark.range(1))
    whole = classic.repartitionByRange
    monkeypatch.setattr(classic, "repartitionByRange", lambda df, n, *by: asked.append(n) or whole(df, n, *by))
    monkeypatch.setattr(pages, "PART_ROWS", 500)
    df = spark.range(2000).select(((F.col("id") * 7) % 1000).alias("x"), F.col("id").alias("y"))
    pages.write_pages(df, [("x", True), ("y", False)], str(tmp_path / "p"), 20)
    assert asked == [4]  # 100 before, one a range
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/p/directory").collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 20
    want = sorted(((r.x, r.y) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    for number in (1, 17, 39, 40):
        got = pages.page_at(spark, str(tmp_path / "p"), [("x", True), ("y", False)], number, 50)
        assert [tuple(r) for r in got.collect()] == want[50 * number - 50 : 50 * number]
    last = dict(zip("xy", want[1899]))
    assert [tuple(r) for r in pages.page_after(spark, str(tmp_path / "p"), [("x", True), ("y", False)], last, 50).collect()] == want[1900:1950]


def test_edges_follow_the_links(spark, monkeypatch):
    links = spark.range(3000).select((F.col("id") % 5).alias("w"), F.col("id").alias("m"))
    monkeypatch.setattr(graph, "TASK_ROWS", 100_000)
    edges = graph.coauthor_edges(links, "m", "w")
    assert edges.rdd.getNumPartitions() == 9  # 898,500 pairs; as many as the session's shuffle partitions before
    assert edges.count() == 5 * 600 * 599 // 2


def test_landed_records_are_compressed(spark):
    rows = spark.read.json(records.landed(spark.range(10).select(F.col("id").cast("string").alias("x"))))
    assert rows.count() == 10 and all(f.endswith(".gz") for f in rows.inputFiles())
