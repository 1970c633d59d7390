"""Benchmark items without an id contaminate documents as others do."""

import hashlib

import pytest

from linkmill.llm import decontaminate


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_items_with_null_ids_are_searched(spark, block_bytes):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    docs = spark.createDataFrame([(1, f"so {a} it is"), (2, f"{b} and {a}"), (3, "nothing of it"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, a), (7, b), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.search_benchmark(docs, items, ["doc_id"], block_bytes=block_bytes).collect()}
    assert {d: (r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for d, r in got.items()} == {1: (23, 20, 0, [], True), 2: (41, 40, 1, [7], True), 3: (3, 0, 0, [], False), 4: (0, 0, 0, [], False)}
    assert got[1].items_sha256 == got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
