"""The number of links of each document against brute force."""

import random

import numpy as np
import pytest

from linkmill.llm import jaccard


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_copies(seed):
    """Groups of near copies that differ, some of them several times, and single texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(60)}"
    texts = [None, "", "one", "one", "ONE"]
    for _ in range(6):
        base = [word() for _ in range(r.choice((12, 40, 90)))]
        for _ in range(r.randrange(3, 14)):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = word()
            texts += [" ".join(copy)] * r.choice((1, 1, 3))
    return list(enumerate(texts + [" ".join(word() for _ in range(30)) for _ in range(20)]))


@pytest.mark.parametrize(("seed", "rare"), [(1, 128), (2, 1), (3, 3)])
def test_number_of_links(spark, seed, rare):
    data = near_copies(seed)
    sets = [shingles(t) for _, t in data]
    want = {i: sum(j != i and 100 * len(x & y) >= 75 * len(x | y) > 0 for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    got = jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), rare=rare).collect()
    assert {x.doc_id: x.n_links for x in got} == want
    assert len(got) == len(data) and max(want.values()) > 5


def test_documents_from_a_shared_pool(spark):
    """300 texts of about 1,200 n-grams, each made of 30 of 60 passages: all n-grams are frequent, few pairs are alike."""
    r = random.Random(5)
    pool = [" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(60)]
    texts = []
    for _ in range(290):
        texts.append(r.sample(pool, 30))
    for i in range(10):  # near copies: two passages replaced
        copy = list(texts[i * 7])
        copy[3], copy[11] = r.sample(pool, 2)
        texts.append(copy)
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t) for _, t in data]
    want = {i: sum(j != i and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df).collect()
    assert {x.doc_id: x.n_links for x in got} == want
    assert sum(want.values()) >= 20


@pytest.mark.parametrize("shortest", [1, 2, 3])
def test_combinations_cover_all_that_two_sets_may_share(shortest):
    """Two sets share `shortest` frequent tokens or more: some combination is in the index of both, whatever the weights."""
    r = random.Random(shortest)
    sizes = {name: r.choice((5, 40, 90)) for name in range(9)}
    for _ in range(300):
        both = {n: r.randint(1, 3) for n in r.sample(range(9), r.randint(1, 3))}
        if sum(both.values()) < shortest:
            continue
        keys = []
        for _ in range(2):
            own = {n: r.randint(1, 3) for n in r.sample(range(9), 3) if n not in both} | both
            names = sorted(({"size": sizes[n], "name": n, "near": True, "weight": w} for n, w in own.items()), key=lambda x: (x["size"], x["name"]))
            keys.append({k[:3] for k in jaccard.combinations(names, 2, shortest)})
        assert keys[0] & keys[1]


def test_combinations_of_alike_tokens_are_few():
    """A thousand tokens with the same postings count as one."""
    names = [{"size": 200, "name": n, "near": True, "weight": 1000} for n in range(4)]
    assert len(list(jaccard.combinations(names, 128, 3))) == 10


def test_overlaps():
    import numpy as np

    r = np.random.default_rng(3)
    x, y = ([np.unique(r.integers(0, 3000, r.integers(1, 400)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    assert jaccard.overlaps(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    same = jaccard.overlaps(x, x)
    assert all(same[i, j] == len(np.intersect1d(x[i], x[j])) for i in range(7) for j in range(7) if i != j)


def test_sketches_never_lose_a_pair():
    r = np.random.default_rng(3)
    for n in (1, 7, 90, 1200, 9000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.0, 0.5, 0.86, 0.95, 1.0):
            b = np.unique(np.concatenate([a[: int(len(a) * share)], r.integers(0, 2**63, n - int(n * share)).astype(np.uint64)]))
            x, y = (np.array(jaccard.sketch(s), np.int64).view(np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_pairs_of_a_shared_pool_are_mostly_left_out_before_verification(spark, monkeypatch):
    """Twice the documents of one pool: the pairs whose whole sets are compared don't grow with the square."""
    r, seen, plain = random.Random(7), [], jaccard.written

    def counted(df, label, keep=False):
        out = plain(df, label, keep)
        if label in ("pairs", "close-pairs"):
            seen.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    pool = [" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(60)]
    data = [(i, " ".join(r.sample(pool, 30))) for i in range(240)]
    verified = []
    for n in (120, 240):
        seen.clear()
        got = jaccard.near_duplicates(spark.createDataFrame(data[:n], "doc_id long, text string").repartition(3))
        assert got.where("n_links > 0").count() == 0
        verified.append({x: sum(k for label, k in seen if label == x) for x in ("pairs", "close-pairs")})
    assert verified[1]["pairs"] > 1000 and verified[1]["close-pairs"] <= 2.2 * max(verified[0]["close-pairs"], 10)


def test_a_large_group_makes_no_combinations(spark, monkeypatch):
    """Near copies of one text and texts that share some of its passages: the index doesn't hold the group's combinations."""
    r, rows, plain = random.Random(4), {}, jaccard.written

    def counted(df, label, keep=False):
        out = plain(df, label, keep)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    pool = [" ".join(f"w{r.randrange(5000)}" for _ in range(20)) for _ in range(10)]
    group = []
    for _ in range(60):
        copy = " ".join(pool).split()
        copy[r.randrange(200)] = f"w{r.randrange(5000)}"
        group.append(" ".join(copy))
    others = [" ".join(r.sample(pool, 8)) for _ in range(12)]
    linked = [" ".join(pool[:9]), " ".join([*pool[1:], "last one"])]
    data = list(enumerate(group + others + linked))
    sets = [shingles(t) for _, t in data]
    want = {i: sum(j != i and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)}
    got = jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), rare=2).collect()
    assert {x.doc_id: x.n_links for x in got} == want
    assert min(want[i] for i in (72, 73)) >= 50 and max(want[i] for i in range(60, 72)) < 12
    assert rows["combinations"] <= 2 * rows["open"] < rows["postings"]


def test_word_hashes_tell_all_words_apart():
    texts = [b" a  B\x0bc\x0c\r\n\t d ", b"", None, "ÉTé \xa0x ab c a bc".encode(), b"a\x1cb a\x00 a ba"]
    h, sizes = jaccard.word_hashes(texts)
    words = [w for t in texts for w in (t or b"").lower().split()]
    assert sizes == [len((t or b"").lower().split()) for t in texts]
    assert len(h) == len(words) and len({*zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
    assert jaccard.word_hashes([])[1] == [] and jaccard.word_hashes([None, b" "])[1] == [0, 0]
