import random

import pytest
from pyspark.sql import functions as F

from linkmill.functions import names as N
from linkmill.functions import similarity as S
from linkmill.functions import vocab as V


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Dr Jürgen Müller", "jurgen muller"),
        ("Cameron, Ian D.", "ian d cameron"),
        ("Dr Prof Ann Lee MBBS", "ann lee"),
        ("A/Prof (Ann) O'Lee", "ann o lee"),
        ("First Last, PhD", "first last"),
        ("ß ø", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_normalise_name(spark, raw, want):
    assert one(spark, N.normalise_name(F.col("a")), a=raw) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [("ian cameron", ["ian", "i"]), ("ian david cameron", ["ian", "i", "david", "d"]), ("i d cameron", ["i", "d"]), ("cameron", ["cameron", "c"]), ("", [])],
)
def test_first_tokens(spark, name, want):
    assert one(spark, N.first_tokens(F.col("a")), a=name) == want


def test_gate(spark):
    gate = N.names_gate(F.col("a"), F.col("b"))
    assert one(spark, gate, a="ian cameron", b="i cameron") is True
    assert one(spark, gate, a="yan zhang", b="yi zhang") is True  # they share the initial y
    assert one(spark, gate, a="yan zhang", b="bo zhang") is False
    assert one(spark, gate, a="", b="x") is False


def test_small_texts(spark):
    assert one(spark, N.valid_doi(F.col("a")), a=" https://doi.org/10.1234/ab ") == "10.1234/ab"
    assert one(spark, N.valid_doi(F.col("a")), a="11.1/x") is None
    assert one(spark, N.pipe_patterns(F.col("a")), a="Big Clinic (x)|big clinic|ab|") == ["big clinic"]
    assert one(spark, N.tri_bool(F.col("a")), a=" Yes ") is True
    assert one(spark, N.tri_bool(F.col("a")), a="maybe") is None
    assert one(spark, N.best_date(F.col("a"), F.col("b")), a=" ", b="2020-01-02T03") == "2020-01-02"
    assert one(spark, N.year_of(F.col("a")), a="x") is None
    assert one(spark, N.slug(F.col("a")), a="  Ann O'Lee ") == "ann-o-lee"
    assert one(spark, N.works_bonus(F.length("a")), a="abc") == 12
    assert one(spark, N.keyword_match(F.col("a"), F.col("b"), {"NSW": ["sydney"]}), a="nsw", b="Uni Sydney") is True
    assert one(spark, N.keyword_match(F.col("a"), F.col("b"), {"NSW": ["sydney"]}), a="Kent", b="of kent") is True


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratio_is_lcs(spark):
    r = random.Random(3)
    pairs = [("".join(r.choices("abc ", k=r.randint(0, 20))), "".join(r.choices("abc ", k=r.randint(0, 20)))) for _ in range(60)]
    pairs += [("a" * 70 + "b", "b" + "a" * 66), ("ab" * 31, "ba" * 31), ("x" * 62, "x" * 62)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.lcs(F.col("a"), F.col("b")).alias("n"))
    for a, b, n in df.collect():
        assert n == lcs(a, b), (a, b)


def test_token_ratios(spark):
    sets = S.token_set_ratio(F.col("a"), F.col("b"))
    assert one(spark, sets, a="ian cameron", b="ian david cameron") == 100.0
    assert one(spark, sets, a="", b="x") == 0.0
    assert one(spark, S.token_sort_ratio(F.col("a"), F.col("b")), a="b a", b="a b") == 100.0
    assert one(spark, S.partial_ratio(F.col("a"), F.col("b")), a="cam", b="ian cameron") == 100.0


def test_vocabulary(spark):
    assert one(spark, V.hits(F.col("a"), ["skin"]), a=" | | ") is False
    assert one(spark, V.hits(F.col("a"), ["skin"]), a="x|Skin care") is True
    rules = [("one", ["aa"]), ("two", ["a"])]
    assert one(spark, V.first_rule(F.col("a"), rules), a="aab") == "one"
    assert one(spark, V.first_rule(F.col("a"), rules), a=None) is None
    assert one(spark, V.all_off(F.array("a"), ["skin"], ["heart"]), a="heart") is True
    assert one(spark, V.flag_labels(F.col("a"), {"x": "X"}), a="x; y") == ["X"]
