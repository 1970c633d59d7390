"""Online packing into a bounded number of open windows, against the plain tokenizer and the rules of the method."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkmill.llm import queries as Q
from linkmill.llm import tokens, windows
from linkmill.llm.windows import OpenWindows, tokens_in

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def item(name, n, start=0):
    return [(name, n, 0, np.arange(start, start + n, dtype="<u4"))]


def names(window):
    return [(p[0], p[2], len(p[3])) for p in window]


def test_best_fit_then_the_fullest_goes():
    w = OpenWindows(10, 2)
    assert not list(w.put(item("a", 6))) and not list(w.put(item("b", 7)))
    assert [names(x) for x in w.put(item("c", 3))] == [[("b", 0, 7), ("c", 0, 3)]]  # the fullest that takes it, which is full now
    assert not list(w.put(item("d", 8)))
    assert [names(x) for x in w.put(item("e", 5))] == [[("d", 0, 8), ("e", 0, 2)]]  # none takes it: the fullest is topped up
    assert [names(x) for x in w.left()] == [[("a", 0, 6), ("e", 2, 3)]]  # and the rest goes where it fits best
    assert [names(x) for x in w.put(item("f", 25))] == [[("f", 0, 10)], [("f", 10, 10)]]
    assert [names(x) for x in w.close()] == [[("a", 0, 6), ("e", 2, 3), ("f", 20, 1)], [("f", 21, 4)]]


def test_windows_stay_bounded_and_nothing_needs_padding():
    r, w, out, total = random.Random(1), OpenWindows(64, 5), [], 0
    for i in range(2000):
        n = r.choice([1, 2, 3, 20, 40, 63, 64, 65, 200])
        total += n
        out += w.put(item(i, n))
        assert len(list(w.left())) <= 5 and len(w.held) == len(w.gaps)
    assert all(tokens_in(x) == 64 for x in out)
    last = list(w.close())
    sizes = [tokens_in(x) for x in last]
    assert sum(map(tokens_in, out)) + sum(sizes) == total
    assert all(n & (n - 1) == 0 for n in sizes) and sum(n for n in sizes if n < 64) < 64
    of = defaultdict(list)
    for x in [*out, *last]:
        for name, _, start, ids in x:
            of[name].append((start, ids))
    for parts in of.values():
        parts.sort(key=lambda p: p[0])
        assert np.concatenate([p[1] for p in parts]).tolist() == list(range(sum(len(p[1]) for p in parts)))


def checked(got, texts, limit=windows.LIMIT, end=windows.END):
    """got: rows of the query. Each id of each text is in exactly one piece, and places in sequences are gapless."""
    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    want = defaultdict(list)
    for k, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        want[k, len(ids)].append(ids)
    of, at = defaultdict(list), defaultdict(list)
    for x in got:
        of[x.doc_id, x.doc_tokens].append(x)
        at[x.sequence_id].append((x.offset, x.length))
    assert set(of) == set(want)
    for k, parts in of.items():
        parts.sort(key=lambda x: x.start)
        same = len(want[k])
        for ids in want[k][:1] if same == 1 else []:
            begin = 0
            for x in parts:
                assert x.start == begin and x.ids_crc32 == zlib.crc32(ids[begin : begin + x.length].tobytes())
                begin += x.length
            assert begin == len(ids)
        assert sum(x.length for x in parts) == same * k[1]
    for places in at.values():
        places.sort()
        assert [p[0] for p in places] == np.cumsum([0, *(p[1] for p in places[:-1])]).tolist()
        n = sum(p[1] for p in places)
        assert 0 < n <= limit and (n == limit or n & (n - 1) == 0)
    return at


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = Q.op13_packing(spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    at = checked(got, texts)
    total = sum(x.length for x in got)
    assert len(at) <= total // windows.LIMIT + bin(total % windows.LIMIT).count("1")


@pytest.mark.parametrize("parts", [1, 7, 70])
def test_leftovers_of_many_partitions_merge_in_steps(spark, monkeypatch, parts):
    monkeypatch.setattr(windows, "MERGED", 4)
    r = random.Random(parts)
    texts = [(i, " ".join(r.choices(["one", "two", "three"], k=r.randint(0, 90)))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    checked(windows.pack_online(df, limit=64, most_open=3).collect(), texts, limit=64)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "a b c"), (3, "a b"), (3, "a b"), (4, "x " * 50_000), (5, " \t\n "), (6, "x <|endoftext|> y")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOC).selectExpr("*", "1 as key", "2 as start", "3 as part", "4 as ids", "5 as offset")
    got = windows.pack_online(df, with_ids=True).collect()
    checked(got, texts)
    assert all(zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length for x in got)
    assert windows.pack_online(spark.createDataFrame([], DOC)).count() == 0


def test_text_keys(spark):
    got = windows.pack_online(spark.createDataFrame([("a", "x y"), (None, "z")], "name string, text string"), key="name").collect()
    assert {x.name for x in got} == {"a", None}
