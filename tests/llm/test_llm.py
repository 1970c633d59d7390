"""The operators for training data against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkmill.llm import blocks, components, decontaminate, jaccard, packing, quality, rollup, sharding, substrings, tokens, topk, urlfilter, warc
from linkmill.llm import queries as Q
from linkmill.llm.common import WordHashes, deltas, undeltas, window_hashes, written

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(r, n, vocabulary=40, most=60):
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(r.choices(words, k=r.randint(0, most))) for _ in range(n)]


@pytest.fixture
def odd(spark):
    """Null and empty texts, a null and a repeated id, equal rows, a very long text, columns with clashing names."""
    data = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x " * 50_000), (5, " \t\n ")]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOC).withColumn("key", F.lit(7)).withColumn("n", F.lit("clash")).withColumn("uid", F.lit(1)).withColumn("score", F.lit("s"))


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOC)


def test_window_hashes_depend_on_the_words_only():
    h = WordHashes().of([b"a", b"b", b"c", b"a", b"b", b"c", b"a"])
    w = window_hashes(h, 3)
    assert w[0] == w[3] and w[1] == w[4] and len(set(w.tolist())) == 3
    assert len(window_hashes(h[:2], 3)) == 0
    u = np.unique(w)
    assert (undeltas(deltas(u)) == u).all()


# Sharding


def test_shards_fit_and_only_large_buckets_split(spark):
    r = random.Random(2)
    data = [(i, r.randint(0, 400)) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, size int")
    got = sharding.assign_shards(df, "doc_id", F.col("size"), 2000, step_bits=1).collect()
    assert len(got) == 600
    held = collections.defaultdict(int)
    for x in got:
        held[(x["depth"], x["shard"], x["page"])] += x["n_bytes"]
    assert max(held.values()) <= 2000
    for depth, shard, _ in held:  # the bucket one bit shorter does not fit
        if depth:
            assert sum(b for (d, s, _), b in held.items() if d >= depth - 1 and s >> (d - depth + 1) == shard >> 1) > 2000


def test_shards_of_one_key(spark):
    df = spark.createDataFrame([(7, 100)] * 50 + [(8, 5000), (None, 1), (9, None)], "doc_id long, size int")
    got = sharding.assign_shards(df, "doc_id", F.col("size"), 1000).collect()
    held = collections.Counter()
    for x in got:
        held[(x["depth"], x["shard"], x["page"])] += x["n_bytes"]
    assert len(got) == 53 and max(v for k, v in held.items()) == 5000
    assert sorted(held.values())[-2] <= 1000
    assert sharding.assign_shards(df.limit(0), "doc_id", F.col("size"), 10).count() == 0


def test_written_shards_keep_all_rows(spark, odd, tmp_path):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(docs, "doc_id", F.octet_length("text"), 1000, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="unique"):
        sharding.write_shards(odd, "doc_id", F.octet_length("text"), 1000, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "s")).select(*docs.columns)) == rows(docs)


# Search


def test_nearest_against_brute_force(spark):
    r = random.Random(5)
    data = [(i % 290, [r.gauss(0, 1) for _ in range(32)]) for i in range(300)] + [(i, [1.0] * 32) for i in range(300, 330)] + [(None, [1.0] * 32), (400, None)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    codes = topk.sign_codes(df, "id", "v")
    got = topk.nearest(codes, codes.where("id % 20 = 0"), 7, index_rows=50, query_rows=6)
    bits = [(i, np.array(v) > 0) for i, v in data if v]
    want = []
    for i, q in bits:
        if i is not None and i % 20 == 0:
            near = sorted((int((q != v).sum()), math.inf if j is None else j) for j, v in bits if j != i)[:7]
            want += [(i, k + 1, None if j == math.inf else j, d) for k, (d, j) in enumerate(near)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert topk.nearest(codes.limit(0), codes.limit(0), 3).count() == 0
    longer = topk.sign_codes(spark.createDataFrame([(i, [1.0] * 48) for i in (1000, 1001)], "id long, v array<float>"), "id", "v")
    both = topk.nearest(codes.unionByName(longer), longer, 7)
    assert rows(both) == [(1000, 1, 1001, 0), (1001, 1, 1000, 0)]


# Token counts


@pytest.mark.parametrize("compact_after", [16, 1, 2])
def test_rollup_is_additive_and_idempotent(spark, tmp_path, compact_after):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, seq int"
    roll = rollup.Rollup(spark, str(tmp_path / "r"), compact_after=compact_after)
    first = spark.createDataFrame([(1, "a", "en", "v", 5, 0), (2, "a", "en", "v", 7, 0), (2, "a", "en", "v", 8, 1), (None, None, "de", "v", 1, 0)], schema)
    second = spark.createDataFrame([(1, None, None, "v", None, 0), (2, "b", "en", "v", 9, 0), (9, None, None, "v", None, 0)], schema)
    assert roll.totals().count() == 0
    assert roll.commit(1, first) is True
    assert rows(roll.totals()) == [("a", "en", "v", 2, 13), (None, "de", "v", 1, 1)]
    assert roll.commit(2, second) is True and roll.commit(2, second) is False and roll.commit(1, first) is False
    assert rows(roll.totals()) == [("b", "en", "v", 1, 9), (None, "de", "v", 1, 1)]
    broken = second.withColumn("bucket", F.lit(0))  # a batch that broke off
    broken.write.mode("overwrite").partitionBy("bucket").parquet(str(tmp_path / "r/records/batch=3"))
    assert roll.commit(3, spark.createDataFrame([], schema)) is True
    assert rows(roll.totals()) == [("b", "en", "v", 1, 9), (None, "de", "v", 1, 1)]
    assert roll.base() == {16: 0, 1: 3, 2: 2}[compact_after]
    assert roll.commit(4, spark.createDataFrame([(2, "b", "en", "v", 4, 0), (1, "a", "en", "v", 1, 0)], schema)) is True
    assert rows(roll.totals()) == [("a", "en", "v", 1, 1), ("b", "en", "v", 1, 4), (None, "de", "v", 1, 1)]


def test_a_batch_reads_one_base_and_the_batches_after_it(spark, tmp_path):
    schema = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, seq int"
    roll = rollup.Rollup(spark, str(tmp_path / "r"), compact_after=3)
    for b in range(5):
        roll.commit(b, spark.createDataFrame([(i, "s", "l", "v", i + b, 0) for i in range(20)], schema))
    files = roll._held(roll.committed(), F.lit(True)).inputFiles()
    assert {f.split("/r/")[1].split("/bucket=")[0] for f in files} == {"base/upto=3", "records/batch=3", "records/batch=4"}
    assert rows(roll.totals()) == [("s", "l", "v", 20, sum(i + 4 for i in range(20)))]


def test_token_counts_query(spark):
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"))
    toxic = {x["doc_id"] for x in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    want, docs = collections.Counter(), collections.Counter()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if d["doc_id"] not in toxic:
            want[(d["source"], d["lang"], "byte_bpe_50k")] += len(encode(d["text"] or "")) + 1
            docs.update((d["source"], d["lang"], v) for v in ("byte_bpe_50k", "white_space"))
            want[(d["source"], d["lang"], "white_space")] += len((d["text"] or "").encode().split())
    got = Q.QUERIES["op3_token_counts"](spark, SF).collect()
    assert {tuple(x)[:3]: (x["n_docs"], x["n_tokens"]) for x in got} == {k: (docs[k], n) for k, n in want.items()}


def test_both_libraries_give_the_same_ids():
    a, b = (tokens.encoder(tokens.vocabulary(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    for t in ["", "  a", "it's we'll", "a\n\n b", "<|endoftext|> x", "日本 é ü x", "a \x00\x85 b", "ÀÉ!!! 123 4.5"]:
        assert a(t).tolist() == b(t).tolist(), t


# Near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(data):
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least.setdefault(find(i), []).append(d)
    low = lambda ids: min((d for d in ids if d is not None), default=None)
    return sorted(((d, len(sets[i]), low(least[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(data)), key=str)


@pytest.mark.parametrize(("seed", "rare"), [(1, 16), (2, 1), (3, 2)])
def test_jaccard_against_brute_force(spark, seed, rare):
    r = random.Random(seed)
    base = texts(r, 25, 400, 90) + ["Same   Line\nof five words here", "same line of five words here", "one two", "ONE two", "one"]
    data = [t for t in base]
    for _ in range(150):  # copies with a few words changed, in chains
        w = r.choice(data).split()
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        data.append(" ".join(w[: len(w) - r.randint(0, 3)]))
    r.shuffle(data)
    data = list(enumerate(data)) + [(None, data[0]), (500, None), (500, "")]
    df = spark.createDataFrame([(d, t) for d, t in data], "doc_id long, text string")
    got = jaccard.near_duplicates(df, rare=rare)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == linked(data)
    firsts = [x for x in got.collect() if x["is_first"] and x["n_shingles"]]
    assert len(firsts) == len({x["component_id"] for x in firsts})


def test_jaccard_edges(spark, odd, none):
    got = rows(jaccard.near_duplicates(odd).select("doc_id", "n_shingles", "component_id"))
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 1, 4), (5, 0, 5)], key=str)
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.distinct_documents(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 2, 3, 4, 5]


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 99)], "a long, b long")
    assert dict(components.components(edges).collect()) == {i: 0 if i <= 20 else 21 for i in range(41)} | {99: 99, 100: 99}


# URL filters


def test_urls_in_blocks_and_edges(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de", "http://net", "ftp://x.net/", None, "", "no-scheme.net/", "http://example.com:80/de/", "http://sub.example.com/de/#f", "http://u.org/fr/", "://net/a"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rules = urlfilter.rule_table(spark, Q.RULES)
    one = rows(urlfilter.judge_urls(pages, rules))
    assert one == rows(urlfilter.judge_urls(pages, rules, block_bytes=100))
    by = {x[0]: x[1:] for x in one}
    assert by[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[1] == ("example.net", "/de", "net/", "block")
    assert by[2] == ("net", "", None, "allow") and by[4] == ("", "", None, "allow") and by[6] == ("", "", None, "allow")
    assert by[7][2] is None and by[8][2] == "example.com/de/" and by[9] == ("u.org", "/fr/", "org/fr/", "allow") and by[10][2] == "net/"
    assert len(one) == 12 and urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {x["verdict"] for x in urlfilter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def digest_array(tmp_path, rules):
    keys = urlfilter.digests_of([f"{h}\n{p}".encode() for h, p, _ in rules])
    order = np.argsort(keys, kind="stable")
    keys[order].tofile(tmp_path / "r.u64")
    with pa.ipc.new_file(str(tmp_path / "r.arrow"), urlfilter.STRINGS) as f:
        f.write_table(pa.Table.from_pylist([dict(zip(("host", "path", "verdict"), rules[i], strict=True)) for i in order], urlfilter.STRINGS))
    return urlfilter.DigestArray(str(tmp_path / "r.u64"), str(tmp_path / "r.arrow"))


def test_equal_digests_are_confirmed(monkeypatch, tmp_path):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda key, seed: 5)
    a = digest_array(tmp_path, [("a", "/", "block"), ("b", "/", "allow"), ("b", "/", "block")])
    assert [a.rule(i) if i >= 0 else None for i in a.find([b"b\n/", b"c\n/", b"a\n/"])] == [("b", "/", "block"), None, ("a", "/", "block")]


def test_digests_are_mapped_and_those_of_spark(spark, tmp_path):
    keys = ["net\n/", "a.b\n/" + "x" * 70, "é\n/ü", "h\n" + "p" * 31, "h\n" + "p" * 30]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k")).collect()
    assert [r[0] for r in got] == urlfilter.digests_of([k.encode() for k in keys]).tolist()
    a = digest_array(tmp_path, [(f"h{i}", "/", "block") for i in range(500)])
    assert isinstance(a.digests, np.memmap) and (np.diff(a.digests) > 0).all() and a.lengths == [1]
    assert [a.rule(i)[0] for i in a.find([b"h7\n/", b"h499\n/"])] == ["h7", "h499"]


def test_many_rules_in_several_arrays(spark):
    r = random.Random(9)
    rules = [(f"h{i}.{r.choice(['net', 'org'])}", r.choice(["/", "/a/", "/a/b"]), r.choice(["allow", "block"])) for i in range(300)] + [("net", "/", "block"), ("org", "/a", "allow")]
    urls = [f"http://x.h{r.randint(0, 320)}.{r.choice(['net', 'org'])}{r.choice(['', '/', '/a/', '/a/b/c'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules), block_bytes=8_000).collect()}
    for i, u in enumerate(urls):
        host, _, rest = u.removeprefix("http://").partition("/")
        path = f"/{rest}" if "/" in u.removeprefix("http://") else ""
        fits = [x for x in rules if (host == x[0] or host.endswith(f".{x[0]}")) and path.startswith(x[1])]
        best = max(fits, key=lambda x: (len(x[0]) + len(x[1]), len(x[0]), x[0] + x[1], x[2]), default=None)
        assert got[i] == ((best[0] + best[1], best[2]) if best else (None, "allow")), u


# Packing


def fewest(lengths, limit):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        g = min(fit) if fit else limit
        n += not fit
        if fit:
            gaps.remove(g)
        if g - x:
            gaps.append(g - x)
    return n


def test_sweep_takes_the_smallest_slot_that_fits():
    r = random.Random(4)
    for _ in range(300):
        items = collections.Counter(r.randint(1, 12) for _ in range(r.randint(0, 15)))
        slots = collections.Counter(r.randint(1, 12) for _ in range(r.randint(0, 15)))
        sizes = sorted(slots.elements())
        moves = packing.sweep(items, slots)
        taken = [at for _, n, first in moves for at in range(first, first + n)]
        assert len(set(taken)) == len(taken) and all(sizes[at] >= n for n, k, first in moves for at in range(first, first + k))
        free, want = sizes.copy(), []  # the largest first: which items find a slot at all
        for x in sorted(items.elements(), reverse=True):
            if any(s >= x for s in free):
                free.remove(min(s for s in free if s >= x))
                want.append(x)
        assert sorted(x for n, k, _ in moves for x in [n] * k) == sorted(want)
        assert all(k <= items[n] for n, k, _ in moves)


@pytest.mark.parametrize(("seed", "limit", "most"), [(1, 50, 50), (2, 1024, 400), (3, 10, 4)])
def test_packing_needs_hardly_more_than_best_fit(spark, seed, limit, most):
    r = random.Random(seed)
    lengths = [r.randint(1, most) for _ in range(400)] + [limit] * 3
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long").repartition(3)
    got = packing.placed(spark, df, limit).collect()
    filled = collections.Counter()
    for x in got:
        filled[x.sequence_id] += lengths[x.uid]
    assert sorted(x.uid for x in got) == list(range(len(lengths)))
    assert max(filled.values()) <= limit and len(filled) <= fewest(lengths, limit) * 1.005 + 1


def test_packing_query(spark):
    """Ids, pieces and places of all documents, by the plain tokenizer."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for x in Q.op6_best_fit_packing(spark, SF).collect():
        got[x.doc_id].append((x.piece, x.start, x.length, x.ids_crc32))
        seqs[x.sequence_id].append((x.offset, x.length))
    for key, text in docs.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for i, (piece, start, length, crc) in enumerate(sorted(got.pop(key))):
            assert (piece, start) == (i, at) and crc == zlib.crc32(ids[at : at + length].tobytes())
            assert length == 1024 or i == 0
            at += length
        assert at == len(ids)
    assert not got
    for v in seqs.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))]
        assert sum(n for _, n in v) <= 1024
    lengths = [n for v in seqs.values() for _, n in v]
    assert len(seqs) <= fewest(lengths, 1024) * 1.005 + 1


def test_packing_edges(spark, odd, none):
    path = tokens.vocabulary("byte_bpe_50k.json")
    encode = tokens.encoder(path)
    got = packing.pack(odd, path=path, with_ids=True).collect()
    seqs = collections.defaultdict(list)
    for x in got:
        seqs[x["sequence_id"]].append((x["offset"], x["length"]))
        assert zlib.crc32(x["ids"]) == x["ids_crc32"] and len(x["ids"]) == 4 * x["length"]
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    long = sorted((x for x in got if x["doc_id"] == 4), key=lambda x: x["piece"])
    want = np.append(encode("x " * 50_000), 2).astype("<u4").tobytes()
    assert b"".join(x["ids"] for x in long) == want and {x["length"] for x in long[1:]} == {1024}
    assert sorted(x["length"] for x in got if x["doc_id"] in (1, 2)) == [1, 1] and sum(x["doc_id"] == 3 for x in got) == 2
    assert packing.pack(none).count() == 0


# WARC


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 60
    data = [(3, "u3", big), (1, "u1", big), (2, "u\r\n2", "small"), (5, "u5", "small"), (4, None, None), (6, "u6", ""), (7, "WARC-Type: response", big), (7, "again", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("id", F.lit(1))
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    archive = warc.read_archive(spark, path)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(3, 120, sha(big), "revisit", 1), (1, 120, sha(big), "response", None), (2, 5, sha("small"), "response", None), (5, 5, sha("small"), "response", None)]
    want += [(4, 0, sha(""), "response", None), (6, 0, sha(""), "response", None), (7, 120, sha(big), "revisit", 1), (7, 120, sha(big), "revisit", 1)]
    assert rows(warc.parsed(warc.records(archive))) == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for x in warc.records(archive).collect():
        head, _, body = bytes(x["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1") and body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields["Content-Length"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert fields["WARC-Target-URI"] != "u2" and "\n" not in fields["WARC-Target-URI"]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body[:-4]).hexdigest()
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.parsed(warc.records(warc.read_archive(spark, str(tmp_path / "b")))).count() == 0


def test_a_page_without_an_id_revisits_the_smallest_id(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "x" * 200), (7, "u", "x" * 200), (5, "u", "x" * 200), (None, "u", "y" * 200)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.parsed(warc.records(warc.read_archive(spark, str(tmp_path / "a")))).select("page_id", "record_type", "refers_to")
    assert rows(got) == sorted([(None, "revisit", 5), (7, "revisit", 5), (5, "response", None), (None, "response", None)], key=str)


# Classifier


def test_gradients():
    r = np.random.default_rng(0)
    m = quality.GatedAttention(seed=1)
    x, count, y = r.normal(size=(7, quality.FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, count)[0]
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for name, g in m.gradients(x, count, y).items():
        flat = np.atleast_1d(m.p[name]).ravel().copy()
        for i in r.choice(len(flat), min(3, len(flat)), replace=False):
            ends = []
            for step in (1e-5, -1e-5):
                moved = flat.copy()
                moved[i] += step
                m.p[name] = moved.reshape(np.shape(g))
                ends.append(loss())
            m.p[name] = flat.reshape(np.shape(g))
            assert abs((ends[0] - ends[1]) / 2e-5 - np.ravel(g)[i]) < 1e-5, name


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["held_out"]]
    assert sum(x["predicted"] == x["quality"] for x in held) >= 0.93 * len(held)
    good, bad = ([x["score"] for x in held if x["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_classifier_edges(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)  # no document has one label: the first weights, one score each
    got = quality.score(odd, model, ["doc_id", "score"]).collect()
    assert len(got) == odd.count() and {x["score_of_row"] for x in got} == {"s"} and all(0 <= x["score"] <= 1 for x in got)
    assert len({x["score"] for x in got if x["doc_id"] in (1, 2)}) == 1
    assert quality.score(none, model, ["doc_id"]).count() == 0
    assert {x["score"] for x in quality.score(odd, {}, ["doc_id"]).collect()} == {0.5}
    trained = quality.fit(odd, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (5, 1)], "doc_id long, quality int"))
    assert all(0 <= x["score"] <= 1 for x in quality.score(odd, trained, ["doc_id"]).collect())


def test_the_sample_passes_over_what_does_not_fit():
    sizes = [(1, 0, 40), (2, 1, 1), (3, 0, 2), (4, 1, 3), (5, 1, 50), (6, 0, 4)]
    assert quality.within_bound(sizes, 100) == [1, 2, 3, 4, 5, 6]
    assert quality.within_bound(sizes, 50) == [1, 2, 3, 4, 6]
    assert quality.within_bound(sizes, 11) == [2, 3, 4, 6]  # the first by order is too large, later ones follow
    assert quality.within_bound(sizes, 3) == [2, 3]
    with pytest.raises(ValueError, match="most_passages"):
        quality.within_bound(sizes, 2)
    assert quality.within_bound([(1, 0, 1), (2, 0, 1)], 10) == []


def test_one_text_over_the_bound_leaves_the_model_as_it_is(spark):
    r = random.Random(8)
    data = [(i, " ".join(r.choices(["good", "fine", "well"] if i % 2 else ["bad", "junk", "spam"], k=r.randint(5, 40)))) for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    plain = quality.fit(docs, known, most_passages=500)
    assert plain
    for huge in range(100, 104):  # wherever its id comes by hash
        more = docs.unionByName(spark.createDataFrame([(huge, "bad " * 64 * 600)], "doc_id long, text string"))
        got = quality.fit(more, known.unionByName(spark.createDataFrame([(huge, 0)], "doc_id long, quality int")), most_passages=500)
        assert all(np.array_equal(got[k], v) for k, v in plain.items())
    scores = {x["doc_id"]: x["score"] for x in quality.score(docs, plain, ["doc_id"]).collect()}
    assert all((scores[i] > 0.5) == bool(y) for i, y in labels)


# Decontamination


def searched(text, items, width=13):
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words_of((t or "").encode())
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination_against_brute_force(spark, block):
    r = random.Random(7)
    items = list(enumerate(texts(r, 8, 3, 30))) + [(20, "w1 w2"), (21, "w1"), (22, ""), (23, None), (24, "W1-W2"), (10, "w0 w0 w0")]
    docs = list(enumerate(texts(r, 40, 3, 40))) + [(90, None), (91, ""), (91, "w2! w1? W2,w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("items", F.lit(0))
    got = decontaminate.search_benchmark(df, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_bytes=block)
    want = []
    for d, t in docs:
        n, hit, found = searched(t, items)
        want.append((d, n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert rows(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == sorted(want, key=str)
    assert decontaminate.search_benchmark(df.limit(0), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).count() == 0


# Substrings


def test_substrings_against_brute_force(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = texts(r, 12, 30, 80) + [f"{t}\n{passage} {u}" for t, u in zip(texts(r, 6), texts(r, 6), strict=True)] + ["z " * 80, None, "", " ".join(f"p{i}" for i in range(35)), " ".join(f"p{i}" for i in range(34)), "Ünï  word"]
    data = list(enumerate(docs)) + [(3, docs[3]), (None, passage)]
    words = [(t or "").encode().split() for _, t in data]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (d, _), w in zip(data, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("sizes", F.lit(1))
    got = substrings.remove_repeats(df, ["doc_id"])
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == sorted(want, key=str)
    for x in got.collect():
        assert x["n_removed"] == sum(x["spans"][1::2]) - sum(x["spans"][::2])
    assert substrings.remove_repeats(df.limit(0), ["doc_id"]).count() == 0


def test_blocks_keep_rows_in_order(spark, odd):
    table = blocks.packed(odd, "text", ["doc_id"], block_bytes=20)
    got = [(d, None if t is None else t.decode()) for b in table.collect() for d, t in zip(b["c_doc_id"], blocks.texts_of(b["blob"], b["sizes"]), strict=True)]
    assert sorted(got, key=str) == sorted([(x["doc_id"], x["text"]) for x in odd.collect()], key=str)


# Pipeline


CLASHES = """score k y text_ uid key n m c near far members copies block_id place sizes blob s1 s2 spans n_words n_removed
    kept_text kept_sha256 n_hit n_items items items_sha256 contaminated length piece start ids rank part nth gap row range base counts""".split()


@pytest.mark.parametrize("n_stage", range(4))
def test_stages_keep_clashing_columns(spark, n_stage):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    docs = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES)).unionByName(
        spark.createDataFrame([(None, None), (7_000, "")], "doc_id long, text string"), allowMissingColumns=True
    )
    out = P.STAGES[n_stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    for x in out.collect():
        assert all(x[c] == (f"{c}{x['doc_id']}" if x["doc_id"] is not None and x["doc_id"] < 40 else None) for c in CLASHES)
    assert out.count() > 10


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = {x["doc_id"]: x for x in docs.collect()}
    steps = [docs]
    for name, stage in P.STAGES:
        steps.append(written(stage(spark, steps[-1], SF), name.replace(" ", "-")))
    for s in steps[:5]:
        assert s.columns == docs.columns
    kept = [{x["doc_id"]: x["text"] for x in s.collect()} for s in steps[:5]]
    bad = {x["doc_id"] for x in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & set(kept[1])) <= 0.05 * len(bad) and len(kept[1]) > 0.7 * len(data)
    groups = linked(sorted(kept[1].items()))
    assert set(kept[2]) == {d for d, n, c in groups if d == c or not n}
    words = {d: (t or "").encode().split() for d, t in kept[2].items()}
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    assert set(kept[3]) == set(kept[2])
    for d, w in words.items():
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert kept[3][d].encode().split() == [x for j, x in enumerate(w) if j not in gone]
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    lines = [" ".join(w.decode() for w in decontaminate.words_of((t or "").encode())[i : i + 13]) for _, t in items for i in range(max(1, len(decontaminate.words_of((t or "").encode())) - 12))]
    for d in set(kept[3]) - set(kept[4]):
        text = " ".join(w.decode() for w in decontaminate.words_of(kept[3][d].encode()))
        assert any(x in text for x in lines)
    packed = steps[5].collect()
    assert {x["doc_id"] for x in packed} == set(kept[4])
    total = collections.Counter()
    for x in packed:
        total[x["sequence_id"]] += x["length"]
    assert max(total.values()) <= 1024
