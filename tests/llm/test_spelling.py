"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linkmill.llm import queries as Q
from linkmill.llm import spelling
from linkmill.llm.common import written

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def near(a, b):
    """One code point inserted, deleted or replaced, by trying all places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain(v):
    by_size = {}
    for w in v:
        by_size.setdefault(len(w), []).append(w)
    partners = {w: [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, ()) if near(w, x)] for w in v}
    best = {w: min(p, key=lambda x: (-v[x], x)) if p else None for w, p in partners.items()}
    form = {w: b if b and v[b] >= 2 * v[w] else None for w, b in best.items()}
    out = set()
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, v[w], len(partners[w]), v[form[w]] if form[w] else None))
    return out


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = list(map(tuple, Q.op11_spelling_variants(spark, sf).collect()))
    want = plain(vocabulary(docs))
    assert len(got) == len(want) and set(got) == want
    assert any(f for _, f, *_ in got) and any(f and r != f for _, f, r, *_ in got)


@pytest.mark.parametrize("cell_weight", [200, 3000])
def test_many_cells_odd_letters_and_long_words(spark, cell_weight):
    r = random.Random(5)
    words = {"".join(r.choices("abéß", k=r.randint(5, 8))) for _ in range(500)}
    words |= {"".join(r.sample("abcdef", 6)) for _ in range(300)}  # equal vectors: no cut divides them
    long = "".join(r.choices("xyz", k=62))
    words |= {long[:k] + "q" * d for k in range(60, 63) for d in range(5)}
    words |= {"t" * 300, "t" * 299 + "u", "t" * 301, "日本語日本語", "日本語日本", "日本語日本人", "𝒳abcde", "abcde"}
    v = {w: r.randint(3, 40) for w in sorted(words)}
    df = written(spark.createDataFrame(list(v.items()), "word string, n long"), "test-words")
    got = {x.word: (x.n, x.n_near, x.near_n, x.near_word) for x in spelling.near_words(df, cell_weight).collect()}
    cells = spelling.cells_of(df, cell_weight)
    assert cells.slices if cell_weight == 200 else len(cells.nodes) > len(cells.roots)
    assert set(got) == set(v)
    for w in v:
        p = [x for x in v if near(w, x)]
        best = min(p, key=lambda x: (-v[x], x)) if p else None
        assert got[w] == (v[w], len(p), v.get(best), best)


def test_one_edit_and_distance():
    r = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(r.choices("ab", k=r.randint(1, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == near(a, b)
        if near(a, b):
            assert np.abs(np.subtract(*spelling.letter_counts([a, b]))).sum() <= 2


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, "12 34"), (None, "Straße STRAßE straße strasse"), (4, "straße " * 9), (4, "straße " * 9), (5, "strase " * 4 + "a" * 70_000), (6, "ÀÉÎÕü× " * 7 + "àéîõü× " * 3)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOC).selectExpr("*", "1 as word", "2 as run", "3 as h", "4 as id", "5 as n")
    got = list(map(tuple, spelling.variant_forms(df).collect()))
    want = plain(vocabulary(docs))
    assert len(got) == len(want) and set(got) == want
    assert spelling.variant_forms(spark.createDataFrame([], DOC)).count() == 0
    with pytest.raises(ValueError, match="circles"):
        spelling.variant_forms(df, ratio=1)


def test_chains_lead_to_the_last_form(spark):
    pairs = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w7")]
    got = spelling.roots_of(written(spark.createDataFrame(pairs, "word string, form string"), "test-forms")).collect()
    assert {(r.word, r.root) for r in got} == {(w, "w20") for w, _ in pairs}
