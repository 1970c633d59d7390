"""TF-IDF vectors of texts over a whole corpus, and the pairs of similar ones of two sides.

A text's length needs the frequency of each of its terms over all texts. Terms therefore move as sorted 64-bit hashes of
blocks of texts, each once a block, to ranges of hash values, and only their counts move back. Of a text's terms those
that the other side has too are kept. Two terms are taken for one with a chance of 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block ends with the text that brings it to so many words, on the left side (which meets each block of the right) and the right one.
LEFT_WORDS, RIGHT_WORDS = 100_000, 1_000_000
#: So many combinations of two rows are made at once.
AT_ONCE = 2_000_000
#: So many terms a range of hash values holds about, over all blocks.
RANGE_TERMS = 2_000_000
#: Up to so many keys of several rows are broadcast.
FEW_KEYS = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> Column:
    """The words of two characters or more, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) >= 2)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), "zstd", asbytes=True)


def unsqueezed(blob: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def deltas(ascending: np.ndarray) -> bytes:
    return squeezed(np.diff(ascending, prepend=np.uint64(0)))


def undeltas(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueezed(blob, np.uint64, n), dtype=np.uint64)


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from those of the words."""
    h = first * ODD + second
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def one_per_key(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (k, s, w) of one key as one, 0 before the words of each: pairs don't reach from one to the next."""
    many = counts.where("n > 1 and k is not null").select(F.col("k").alias("of"), F.col("s").alias("on"))
    many = F.broadcast(many) if many.count() <= FEW_KEYS else many
    same = (F.col("k") == F.col("of")) & (F.col("s") == F.col("on"))
    apart = F.transform(F.collect_list("w"), lambda w: F.concat(F.array(F.lit(0).cast("long")), w))
    merged = rows.join(many, same, "left_semi").groupBy("k", "s").agg(F.flatten(apart).alias("w"))
    return rows.join(many, same, "left_anti").unionByName(merged)


def blocks(rows: DataFrame, path: str) -> DataFrame:
    """Texts (k, s, w: word hashes) of one side s (null: no key), many in a row, written to path: block_id, is_left (s), keys,
    sizes (words of each text), n_words, own (the block's different hashes, ascending), n_own, seq (places in own)."""
    schema = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("is_left", T.BooleanType()), T.StructField("keys", T.ArrayType(rows.schema["k"].dataType))])
    for name, kind in (("sizes", T.ArrayType(T.IntegerType())), ("n_words", T.IntegerType()), ("own", T.BinaryType()), ("n_own", T.IntegerType()), ("seq", T.BinaryType())):
        schema.add(name, kind)

    def pack(batches):
        seq, total, left, kind = 0, 0, None, None
        keys: list = []
        parts: list[np.ndarray] = []

        def row():
            nonlocal seq, total
            own, places = np.unique(np.concatenate(parts), return_inverse=True)
            cols = [(TaskContext.get().partitionId() << 24) + seq, left, keys, [len(p) for p in parts], total, deltas(own), len(own), squeezed(places.astype(np.uint32))]
            types = [pa.int64(), pa.bool_(), pa.list_(kind), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=schema.names)
            seq, total = seq + 1, 0
            keys.clear()
            parts.clear()
            return out

        for b in batches:
            kind = b.column("k").type
            w = b.column("w")
            at, hashes = w.offsets.to_numpy(), w.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (k, s) in enumerate(zip(b.column("k").to_pylist(), b.column("s").to_pylist(), strict=True)):
                if parts and (s != left or total >= (LEFT_WORDS if left else RIGHT_WORDS)):
                    yield row()
                left = s
                keys.append(k)
                parts.append(hashes[at[i] : at[i + 1]].copy())
                total += len(parts[-1])
        if parts:
            yield row()

    rows.mapInArrow(pack, schema).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def counted(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's different terms, ascending, and for each text and term of it: text, place of the term, count."""
    h = undeltas(row["own"], row["n_own"])[unsqueezed(row["seq"], np.uint32, row["n_words"])]
    text = np.repeat(np.arange(len(row["sizes"])), row["sizes"])
    word = h != 0
    pair = (text[1:] == text[:-1]) & word[1:] & word[:-1]
    terms, at = np.unique(np.concatenate([h[word], paired(h[:-1], h[1:])[pair]]), return_inverse=True)
    each = np.concatenate([text[word], text[1:][pair]])
    code, n = np.unique(each * max(len(terms), 1) + at, return_counts=True)
    text, at = np.divmod(code, max(len(terms), 1))
    return terms, text, at, n


def frequencies(table: DataFrame, n_ranges: int) -> DataFrame:
    """(block_id, parts): for each part of a block's terms, in their order, in how many texts of all blocks they are, and
    whether both sides have them. Texts without a key count as one, and their blocks get nothing."""

    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                terms, _, at, _ = counted(row)
                n = np.bincount(at, minlength=len(terms)).astype(np.uint32)
                part = ((terms >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
                cut = [*np.flatnonzero(np.diff(part)) + 1, len(terms)]
                out = [(int(part[x]), row["block_id"], row["is_left"], int(x), int(y - x), deltas(terms[x:y]), squeezed(n[x:y])) for x, y in zip([0, *cut], cut, strict=False) if y > x]
                kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["range", "block_id", "is_left", "base", "n", "terms", "counts"])

    def count(pdf):
        parts = [undeltas(t, n) for t, n in zip(pdf["terms"], pdf["n"], strict=True)]
        own = np.concatenate([unsqueezed(c, np.uint32, n) for c, n in zip(pdf["counts"], pdf["n"], strict=True)])
        kind = pdf["is_left"].map({True: 0, False: 1}).fillna(2).astype(int).to_numpy()
        side = np.repeat(kind, pdf["n"])
        terms, at = np.unique(np.concatenate(parts), return_inverse=True)
        sides = np.zeros((3, len(terms)), bool)
        sides[side, at] = True
        total = (np.bincount(at, np.where(side < 2, own, 0)) + sides[2])[at].astype(np.uint64)
        both = sides[:2].all(axis=0)[at]
        cuts = np.cumsum(pdf["n"].to_numpy())[:-1]
        out = pdf[["block_id", "base", "n"]].copy()
        out["counts"] = [squeezed(x) for x in np.split(total, cuts)]
        out["both"] = [squeezed(x) for x in np.split(both, cuts)]
        return out[kind < 2]

    sent = table.mapInArrow(send, "range int, block_id long, is_left boolean, base int, n int, terms binary, counts binary")
    back = sent.groupBy("range").applyInPandas(count, "block_id long, base int, n int, counts binary, both binary")
    return back.groupBy("block_id").agg(F.collect_list(F.struct("base", "n", "counts", "both")).alias("parts"))


def shared_vectors(left: DataFrame, right: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """The vectors of the texts of both sides, a row for each block, written to path: is_left, keys, norms (lengths over all
    terms), n_terms, terms (those that both sides have, ascending), n_texts (in how many texts of all each is), n_rows,
    texts, places, counts (the text, the term's place and its count in the text, of each row).

    Terms are words and pairs of words, weights (1 + ln tf) * (1 + ln((1 + n) / (1 + df))) over all texts of both sides.
    Rows with one key on one side are one text, which is brought together in one task; those without a key are one that
    only counts."""
    spark = left.sparkSession
    side = lambda df, is_left: df.select(F.col(key).alias("k"), F.when(F.col(key).isNotNull(), is_left).alias("s"), F.col(text).alias("t"))
    both = side(left, F.lit(True)).unionByName(side(right, F.lit(False)))
    counts = both.groupBy("k", "s").agg(F.count("*").alias("n"))
    n_all, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0))).first()
    rows = both.select("k", "s", F.transform(words("t"), lambda w: F.xxhash64(w)).alias("w"))
    table = blocks(one_per_key(rows, counts) if most > 1 else rows, f"{path}/blocks")
    n_words = table.agg(F.sum(F.col("n_words").cast("long"))).first()[0] or 0
    n_ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n_words // RANGE_TERMS + 1)
    schema = T.StructType([T.StructField("is_left", T.BooleanType()), T.StructField("keys", T.ArrayType(left.schema[key].dataType)), T.StructField("norms", T.ArrayType(T.DoubleType()))])
    for name in ("n_terms", "terms", "n_texts", "n_rows", "texts", "places", "counts"):
        schema.add(name, T.IntegerType() if name in ("n_terms", "n_rows") else T.BinaryType())

    def weigh(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                terms, of, at, n = counted(row)
                df, shared = np.zeros(len(terms), np.uint64), np.zeros(len(terms), bool)
                for p in row["parts"]:
                    here = slice(p["base"], p["base"] + p["n"])
                    df[here], shared[here] = unsqueezed(p["counts"], np.uint64, p["n"]), unsqueezed(p["both"], bool, p["n"])
                x = raw(n, df, n_all)(at)
                norms = np.sqrt(np.bincount(of, x * x, len(row["keys"])))
                place, kept = np.cumsum(shared) - 1, shared[at]
                own = [v[kept].astype(np.uint32) for v in (of, place[at], n)]
                cols = [row["is_left"], row["keys"], norms.tolist(), int(shared.sum()), deltas(terms[shared]), squeezed(df[shared]), len(own[0]), *map(squeezed, own)]
                types = [pa.bool_(), b.column("keys").type, pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=schema.names)

    table.join(frequencies(table, n_ranges), "block_id").mapInArrow(weigh, schema).write.parquet(f"{path}/vectors")
    return spark.read.parquet(f"{path}/vectors").withColumn("n_all", F.lit(n_all).cast("long"))


def raw(counts: np.ndarray, df: np.ndarray, n_all: int):
    """The weights of rows with these counts, from the places of their terms."""
    idf = 1 + np.log((1 + n_all) / (1 + df.astype(float)))
    return lambda at: (1 + np.log(counts)) * idf[at]


def vectors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's terms, and for each row of it: text, place of the term, weight."""
    terms, df = undeltas(row["terms"], row["n_terms"]), unsqueezed(row["n_texts"], np.uint64, row["n_terms"])
    of, at, n = (unsqueezed(row[x], np.uint32, row["n_rows"]).astype(np.int64) for x in ("texts", "places", "counts"))
    return terms, of, at, raw(n, df, row["n_all"])(at) / np.array(row["norms"], float)[of]


def combined(first: np.ndarray, n: np.ndarray):
    """(i, j): each i with the n[i] values from first[i] on as j, so many at once that memory stays bounded."""
    ends = np.cumsum(n)
    total = int(n.sum())
    for start in range(0, total, AT_ONCE):
        stop = min(start + AT_ONCE, total)
        a, b = np.searchsorted(ends, [start, stop - 1], "right")
        here = np.minimum(ends[a : b + 1], stop) - np.maximum(ends[a : b + 1] - n[a : b + 1], start)
        i = np.repeat(np.arange(a, b + 1), here)
        yield i, first[i] + np.arange(start, stop) - (ends - n)[i]


def similar(left: dict, right: dict, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left text, right text, cosine) of pairs of two blocks with a cosine of at least `least`.

    In one order of the terms of both, those of most pairs last, each text leaves out as many at its end as cannot reach
    `least` alone: their part of its length is smaller, or the products with the other side's largest weights are. Where
    two texts share none of the terms that are left, all shared ones lie at the end of one of the two."""
    sides = [vectors(left), vectors(right)]
    _, *where = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    n = len(where[0])
    pairs = np.ones(n)
    for (terms, _, at, _), w in zip(sides, where, strict=True):
        pairs *= np.bincount(at, minlength=len(terms))[w]
    rank = np.empty(n, np.int64)
    rank[np.argsort(pairs, kind="stable")] = np.arange(n)
    rows, top = [], []
    for (terms, of, at, x), w in zip(sides, where, strict=True):
        to = np.full(len(terms), -1)
        to[w] = rank
        kept = to[at] >= 0
        code, x = of[kept] * n + to[at[kept]], x[kept]
        order = np.argsort(code)
        rows.append((code[order], x[order]))
        top.append(np.zeros(n))
        np.maximum.at(top[-1], to[at[kept]], x)
    prefix = []
    for (code, x), other in zip(rows, reversed(top), strict=True):
        of, term = np.divmod(code, max(n, 1))
        end = np.searchsorted(of, of, "right")
        rest = lambda v: (s := np.append(np.cumsum(v[::-1])[::-1], 0))[:-1] - s[end]  # noqa: B023, E731
        kept = np.minimum(np.sqrt(np.maximum(rest(x * x), 0)), rest(x * other[term])) >= least - 1e-9
        prefix.append((of[kept], term[kept]))
    (a, ta), (b, tb) = prefix
    by_term = np.argsort(ta, kind="stable")
    a, ta, n_right = a[by_term], ta[by_term], len(right["keys"])
    first = np.searchsorted(ta, tb)
    found = [np.unique(a[j] * n_right + b[i]) for i, j in combined(first, np.searchsorted(ta, tb, "right") - first)]
    a, b = np.divmod(np.unique(np.concatenate(found)) if found else np.empty(0, np.int64), max(n_right, 1))
    (code_a, xa), (code_b, xb) = rows
    first, cosine = np.searchsorted(code_a, a * n), np.zeros(len(a))
    for i, j in combined(first, np.searchsorted(code_a, (a + 1) * n) - first):
        want = b[i] * n + code_a[j] % n
        at = np.minimum(np.searchsorted(code_b, want), len(code_b) - 1)
        cosine += np.bincount(i, np.where(code_b[at] == want, xa[j] * xb[at], 0.0), len(a))
    kept = cosine >= least
    return a[kept], b[kept], cosine[kept]


def alike(table: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, cosine): all pairs of a left and a right text of shared_vectors() with a cosine of at least `least` (> 0).
    Each block of the left meets each of the right."""
    of = lambda is_left, name: table.where(F.col("is_left") == is_left).select(F.struct("*").alias(name))
    kind = table.schema["keys"].dataType.elementType

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, y, cosine = similar(row["l"], row["r"], least)
                keys = [pa.array([row[s]["keys"][i] for i in at], batch.column(s).type.field("keys").type.value_type) for s, at in (("l", x), ("r", y))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(cosine)], names=[a, b, "cosine"])

    schema = T.StructType([T.StructField(a, kind), T.StructField(b, kind), T.StructField("cosine", T.DoubleType())])
    return of(False, "r").crossJoin(of(True, "l")).mapInArrow(meet, schema)
