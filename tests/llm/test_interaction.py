"""Filter orders by decision diagrams against plain counting."""

import itertools
import random
import re

from linkmill.llm import interaction

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    good, toxic = {}, {}
    for i, q, t in (x for x in labels if x[0] is not None):
        good[i], toxic[i] = good.get(i, 0) or int(q == 1), toxic.get(i, 0) or int(t == 1)
    smallest = {}
    for i, text, *_ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    parts = {}
    for i, text, _, source, *_ in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        failed = "".join(
            f for f, yes in zip(
                "ABCDE", [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                          any(c in "#$%&*|" for c in t), i is not None and i > smallest[t]], strict=True
            ) if yes
        )
        parts.setdefault(source or "", []).append((failed, good.get(i, 0), toxic.get(i, 0)))
    out = []
    for part, marks in parts.items():
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = marks
            for f in order:
                removed[order, f] = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
        for (order, f), gone in removed.items():
            step = order.index(f) + 1
            kept = sum(not set(m[0]) & set(order[:step]) for m in marks)
            fails = sum(f in m[0] for m in marks)
            out.append(
                (part, order, step, kept, len(gone), fails - len(gone), sum(m[0] == f for m in marks), sum(m[1] for m in gone),
                 sum(m[2] for m in gone), sum(len(g) for (_, x), g in removed.items() if x == f))
            )
    return sorted(out)


def test_plain_changes_visit_every_order_once():
    for n in range(6):
        order = list(range(n))
        seen = {tuple(order)}
        for i in interaction.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swaps_keep_sums_and_share_nodes():
    r = random.Random(4)
    counts = {m: (r.randint(0, 2), r.randint(0, 1), 0) for m in range(32) if r.random() < 0.5}
    d = interaction.Diagram(5, counts)
    for i in [0, 3, 1, 2, 0, 2, 3, 1, 1, 0]:
        d.swap(i)
        assert d.sums[d.root] == tuple(map(sum, zip(*counts.values(), strict=True)))
        fresh = interaction.Diagram(5, {sum((m >> v & 1) << at for at, v in enumerate(d.order)): c for m, c in counts.items()})
        assert [len(t) for t in d.tables] == [len(t) for t in fresh.tables]  # as small as one built in this order
        assert [x[1:] for x in d.path()] == [x[1:] for x in fresh.path()]


def documents(r):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choices(words, k=r.choice([0, 10, 49, 50, 60, 120]))) for _ in range(60)]
    texts = [t.upper() if r.random() < 0.1 else t for t in texts] + ["A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "é " * 60, " \t\v\n"]
    texts = [t + r.choice(["", "", " #", "|", "$"]) for t in texts]
    docs = [(i, r.choice([*texts, None, ""]), "en", r.choice(["hot", "hot", "s1", None, ""]), 0) for i in range(300)]
    return [*docs, *docs[:5], (None, "same", "en", "s1", 0), (None, "same", "en", "s1", 0), (900, "same", "en", "s1", 0), (901, "same", "en", "hot", 0), (902, "x y " * 40_000, "en", "long", 0)]


def test_audit_of_odd_rows_is_that_of_plain_counting(spark):
    r = random.Random(3)
    docs = documents(r)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as mask", "'x' as part", "2 as key", "3 as n", "'w' as words")
    got = interaction.filter_audit(df, spark.createDataFrame(labels, LABEL).selectExpr("*", "'x' as part")).collect()
    assert sorted(map(tuple, got)) == plain(docs, labels)


def test_audit_of_nothing(spark):
    assert interaction.filter_audit(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).count() == 0
    got = interaction.filter_audit(spark.createDataFrame([(1, None, None, None, None)], DOC), spark.createDataFrame([], LABEL)).collect()
    assert len(got) == 600 and {x.part for x in got} == {""} and {x.kept for x in got} == {0, 1}


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 0, 3, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 0, 2)], "part string, mask int, n long, good long, toxic long")
    got = {(x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.shapley) for x in interaction.audit(masks, 2).collect()}
    assert got == {("AB", 1): (3, 6, 0, 2, 8), ("AB", 2): (3, 0, 4, 0, 4), ("BA", 1): (5, 4, 0, 0, 4), ("BA", 2): (3, 2, 4, 2, 8)}
