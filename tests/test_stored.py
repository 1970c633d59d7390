"""Stored tables (text index, ledger, snapshots), repeated updates, and similarity within groups, against plain versions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkmill.operators import ledger, merge, similar_texts, snapshots, text_index


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Text index


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(1)
    texts = ["".join(r.choices("abcA é", k=r.randint(0, 40))) for _ in range(200)] + ["x𝒳y%_\\", "", None, "the end " * 3000]
    df = spark.createDataFrame([*enumerate(texts), (500, "abc cab"), (500, "other")], "id int, t string")
    text_index.write_index(df, "id", "t", str(tmp_path / "i"), block_texts=30)
    for q in ["ABC", "abca", "a", "", "é ", "𝒳y%", "_\\", "nowhere", "END THE end", "b cab a", "cab"]:
        want = df.where(F.contains(F.lower("t"), F.lit(q.lower())))
        assert rows(text_index.search(spark, str(tmp_path / "i"), q).select("key")) == rows(want.select("id")), q
    text_index.write_index(df.limit(0), "id", "t", str(tmp_path / "none"))
    assert text_index.search(spark, str(tmp_path / "none"), "abc").count() == 0


def test_search_reads_the_postings_asked_for(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(300)], "id int, t string")
    text_index.write_index(df, "id", "t", str(tmp_path / "i"), block_texts=50)
    found = text_index.search(spark, str(tmp_path / "i"), "number 77")
    assert rows(found.select("key")) == [(77,)]
    assert plan(found).count("EqualTo(gram,") == text_index.LISTS and re.search(r"PartitionFilters: \[[^\]]*folder", plan(found))


# Ledger


TABLES = {"a": ("k string, v int", ["k"]), "b": ("k string, n int, w int", ["k", "n"])}


def breaks():
    raise InterruptedError


def test_a_batch_counts_in_all_tables_or_none_and_once(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path), TABLES, buckets=4)
    a = lambda *x: spark.createDataFrame(list(x), TABLES["a"][0])
    b = lambda *x: spark.createDataFrame(list(x), TABLES["b"][0])
    assert rows(book.read("a")) == []
    assert book.commit("1", {"a": a(("x", 2), ("x", 1), (None, 5)), "b": b(("x", None, 1))})
    with pytest.raises(InterruptedError):
        book.commit("2", {"a": a(("y", 9)), "b": b(("y", 1, 9))}, before_mark=breaks)
    assert rows(book.read("a")) == [("x", 1), (None, 5)] and rows(book.read("b")) == [("x", None, 1)]
    assert book.commit("2", {"a": a(("y", 3), ("x", 7), (None, 6)), "b": b(("x", None, 2), ("x", 2, 2))})
    assert not book.commit("2", {"a": a(("z", 0))})
    assert rows(book.read("a")) == [("x", 1), ("y", 3), (None, 5)] and rows(book.read("b")) == [("x", 2, 2), ("x", None, 1)]
    before = rows(book.read("a"))
    book.merge_batches("all")
    assert rows(book.read("a")) == before and book.batches()[0] == {"all"}
    assert not book.commit("1", {"a": a(("z", 0))}) and book.commit("3", {"a": a(("x", 0), ("z", 1)), "b": b()})
    assert rows(book.read("a")) == sorted([*before, ("z", 1)], key=str)


def test_a_small_batch_reads_its_own_buckets(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path), TABLES, buckets=16)
    book.commit("1", {"a": spark.createDataFrame([(str(i), i) for i in range(500)], TABLES["a"][0])})
    some = book.read("a", [3])
    assert 0 < some.count() < 100 and re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*3", plan(some))


def test_batches_are_merged_after_some(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path), {"a": TABLES["a"]}, buckets=2, merge_after=3)
    for i in range(5):
        assert book.commit(str(i), {"a": spark.createDataFrame([("x", i), (str(i), i)], TABLES["a"][0])})
        assert len(book.batches()[0]) < 3
    assert rows(book.read("a")) == sorted([("x", 0), *((str(i), i) for i in range(5))], key=str)
    assert not book.commit("0", {"a": spark.createDataFrame([("new", 0)], TABLES["a"][0])})


def test_decisions_fan_out(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path), ledger.DECISIONS, buckets=2)
    log = lambda *x: spark.createDataFrame(list(x), "decision string, name string, action string, id string, notes string, at string").withColumn("at", F.col("at").cast("timestamp"))
    first = log(("1", "Ann", "accept_override", "A1", "", "2020-01-02"), ("2", "Ann", "accept_override", "A2", "", "2020-01-01"), ("3", "Bob", "reject", "B1", "", "2020-01-01"),
                ("4", "Bob", "reject", " ", "", "2020-01-01"), ("5", "Cy", "defer", None, None, None))
    assert ledger.record_decisions(book, "1", first)
    assert ledger.record_decisions(book, "2", log(("6", "Ann", "accept_override", "A3", "", "2019-01-01"), ("7", "Bob", "reject", "B1", "x", "2020-01-05"), ("8", "Bob", "reject", "B2", "", "2020-01-05")))
    assert rows(book.read("overrides").select("name", "id")) == [("Ann", "A2")]
    assert rows(book.read("rejected").select("name", "id")) == [("Bob", "B1"), ("Bob", "B2")]
    assert book.read("decisions").count() == book.read("evidence").count() == 8


# Snapshots


def test_restore_takes_the_latest_finished_version_with_enough_columns(spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path), ["k"])
    table = lambda *x: spark.createDataFrame(list(x), "k int, a string, b string, c string")
    now = table((1, None, None, "now"), (2, None, None, None), (3, None, None, None), (4, None, None, None))
    assert rows(s.restore(now, ["a", "b", "c"], 1)) == rows(now)
    assert s.save(table((1, "a1", "b1", "c1"), (2, "a1", "b1", None), (3, None, None, "c1")), "first") == 1
    assert s.save(table((1, "a2", None, None), (2, "a2", None, "c2"), (2, None, None, None)).drop("b"), "second") == 2
    with pytest.raises(InterruptedError):
        s.save(table((1, "broken", "broken", "broken")), "third", before_mark=breaks)
    assert rows(s.restore(now, ["a", "b", "c"], 1)) == [(1, "a1", "b1", "now"), (2, "a2", None, "c2"), (3, None, None, None), (4, None, None, None)]
    assert [tuple(r) for r in s.log().select("version", "n_keys", "reason").orderBy("version").collect()] == [(1, 3, "first"), (2, 2, "second")]
    assert s.save(now, "again") == 3
    with pytest.raises(ValueError, match="version 9"):
        s.read(9)


# Repeated updates


def test_repeated_updates_leave_one_row_a_key(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "c", 0)], "k int, s string, n int")
    upd = spark.createDataFrame([(1, "x", 3, 1), (1, "y", 9, 2), (2, None, 4, 1), (2, "z", 0, 2), (4, "p", 1, 1), (4, "q", None, 2)], "k int, s string, n int, at int")
    assert rows(merge.upsert(base, upd, ["k"], ["s", "n"], order=["at"])) == [(1, "y", 9), (2, "z", 0), (3, "c", 0), (4, "q", None)]
    assert rows(merge.upsert(base, upd, ["k"], ["s"], insert=False)) == [(1, "y", 5), (2, "z", None), (3, "c", 0)]
    assert rows(merge.fill_missing(base, upd, ["k"], ["s", "n"], order=["at"])) == [(1, "a", 5), (2, "z", 4), (3, "c", 0)]
    assert rows(merge.fill_missing(base, upd, ["k"], ["s", "n"])) == [(1, "a", 5), (2, "z", 4), (3, "c", 0)]
    assert rows(merge.keep_greatest(base, upd, ["k"], ["n"])) == [(1, "a", 9), (2, None, 4), (3, "c", 0)]
    assert rows(merge.rebuilt(base.select("k", "s"), upd.select("k", "n"), "k", {})) == [(1, "a", 9), (2, None, 4), (3, "c", None)]


# Similarity within groups


def plain_similarity(texts, most):
    words = [re.findall(r"[^\W]{2,}", t.lower()) for t in texts]
    counts = [Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]) for w in words]
    total = sum(counts, Counter())
    kept = sorted(total, key=lambda x: (-total[x], x))[:most]
    idf = {x: 1 + math.log((1 + len(texts)) / (1 + sum(x in k for k in counts))) for x in kept}
    v = [{x: (1 + math.log(k[x])) * idf[x] for x in kept if x in k} for k in counts]
    length = [math.sqrt(sum(x * x for x in d.values())) for d in v]
    return max((sum(v[0][x] * d[x] for x in v[0] if x in d) / (length[0] * n) if n and length[0] else 0.0 for d, n in zip(v[1:], length[1:], strict=True)), default=None)


@pytest.mark.parametrize("most", [8000, 12])
def test_group_similarity_is_that_of_each_group_alone(spark, most):
    r = random.Random(6)
    words = ["skin", "Skin", "a", "the", "of_it", "naïve", "cancer", "2020", "b2"]
    groups = {g: [" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(r.randint(2, 6))] for g in range(12)}
    data = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    data += [(90, 1, "no own text"), (91, 0, "alone"), (92, 0, None), (92, 1, "x y"), (93, 0, "own"), (93, 1, " "), (94, 0, "one"), (94, 1, "zzz")]
    df = spark.createDataFrame(data, "g int, i int, t string")
    got = {x.g: (x.n_texts, round(x.similarity, 9), x.points) for x in similar_texts.group_similarity(df, "g", "i", "t", most).collect()}
    want = {g: (len(ts), s := round(plain_similarity(ts, most), 9), 15 if s >= 0.35 else 8 if s >= 0.2 else 0) for g, ts in groups.items()} | {94: (2, 0.0, 0)}
    assert got == want


def test_trigrams_are_lists_before_they_are_moved(spark, monkeypatch):
    monkeypatch.setattr(text_index, "TASK_GRAMS", 5)
    texts = {1: "abcabc", 2: "ab", 3: "xéc\n😀abc", 4: "", 5: "bca"}
    df = spark.createDataFrame([(k, v, k % 2) for k, v in texts.items()] + [(3, "abc", 1), (None, "abc", 0)], "key long, low string, block int")
    got = text_index.lists_by_gram(df)
    want = {(v[i : i + 3], k % 2) for k, v in texts.items() for i in range(len(v) - 2)}
    assert {(r.gram, r.block): r["keys"] for r in got.collect()} == {(g, b): [k for k, v in texts.items() if g in v and k % 2 == b] for g, b in want}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
