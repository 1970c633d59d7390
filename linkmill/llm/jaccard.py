"""Exact Jaccard join of documents on word n-grams, by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import blocks as B
from linkmill.llm.common import BASE, bounded_batches, mixed, partitions, passing_tables, thrifty, window_hashes, written
from linkmill.llm.components import components

WIDTH, PERCENT = 5, 75
#: A token that more sets than this have in their prefixes belongs to the frequent class.
RARE = 128
#: Frequent tokens combine in twos up to RARE * STEP sets, beyond that in threes.
STEP, MOST_COMBINED = 16, 3
#: Rounds that link each posting to one document of it, before all its pairs are looked at.
STAR_ROUNDS = 2
#: Rounds that leave out postings which can't help to find a link between components.
OPEN_ROUNDS = 2
#: Longs of a set's sketch, whose bits are the parities of its members' counts by hash.
SKETCH_LONGS = 32
#: Members of sets, at most about, in one block when the links of a component are counted.
BLOCK_MEMBERS = 250_000
BYTE_VALUES = mixed(np.arange(256, dtype=np.uint64), 11)


def word_hashes(texts: list) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of all words, A-Z lower-cased, and how many words each text has.

    A word's hash is the mixed sum of a value for each byte times a power of the odd base for its place, for all
    words at once: a dictionary of words costs more where a third of a block's words are new."""
    low = pc.ascii_lower(pa.array([t or b"" for t in texts], pa.binary()).view(pa.string()))
    parts = pc.ascii_split_whitespace(low)
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # a white end gives an empty word
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[parts.offsets.to_numpy()]).tolist()
    words = words.filter(some)
    if not len(words):
        return np.empty(0, np.uint64), sizes
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(lengths.max(), BASE))
        return mixed(np.add.reduceat(BYTE_VALUES[raw] * power[place], starts), 5), sizes


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The distinct word n-grams of each text as ascending 64-bit hashes; a shorter text is one n-gram."""
    flat, sizes = word_hashes(texts)
    h, first, out = window_hashes(flat, width), 0, []
    for n in sizes:
        if n >= width:
            out.append(np.unique(h[first : first + n - width + 1]))
        elif n:
            out.append(mixed(window_hashes(flat[first : first + n], n), n))
        else:
            out.append(np.empty(0, np.uint64))
        first += n
    return out


def sketch(members: np.ndarray) -> list[int]:
    """Bits that tell of each of so many buckets whether it has an odd number of members.

    Two sets' sketches differ in no more bits than the sets do in members, so a pair whose sketches differ in too many
    can't be similar."""
    odd = np.bincount((mixed(members, 3) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def needed_alike(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with a similar one of n or more."""
    return -(-2 * n * percent // (100 + percent))


def _signed(sets: list[np.ndarray]) -> dict:
    """Sizes and two sums over mixed members: equal sets have equal ones, others differ but by 128-bit chance."""
    with np.errstate(over="ignore"):
        sums = [[int(mixed(s, k).sum(dtype=np.uint64).view(np.int64)) for s in sets] for k in (1, 2)]
    return {"n": [len(s) for s in sets], "s1": sums[0], "s2": sums[1]}


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
    rare: int = RARE
) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, is_first, n_links.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set has its distinct
    n-grams of `width` words, the whole sequence as one where it has fewer words, nothing without
    words. Two rows link when 100 * overlap >= percent * union; empty sets link with nothing.
    component_id is the smallest key that a row reaches by links, its own included; is_first marks
    one row of each component (of rows with the smallest key one). Null keys are never the smallest.
    n_links is the number of other rows that a row links with, those with an equal set included.

    1. Rows are packed into blocks; rows with equal sets form a class, and one of each class goes on.
    2. The frequency of each n-gram over all rows is counted by ranges of hash values. N-grams in
       ascending frequency give each set its order; sets that are similar enough share k n-grams in
       the prefixes that are k - 1 longer than one shared n-gram needs. k is 3 (MOST_COMBINED).
    3. N-grams that no other class has are left out. Postings are linked as stars first; verified links
       merge, and what may still link different components meets on rare n-grams or on combinations
       of frequent ones, each pair verified on the whole sets.
    4. All links lie within components, where they are counted by blocks; a class's links count as many
       times as the other class has rows. Pairs are never listed.

    distinct_documents() needs the components alone and leaves out step 4.
    """
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    named = _named(_packed(keyed, "key", "text", ["key"], width), "key", width, percent, rare, every=True)
    return named.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id", "is_first", "n_links")


def distinct_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
    rare: int = RARE
) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() marks as the first of their component."""
    table = _packed(docs, key, text, [c for c in docs.columns if c != text], width)
    block = F.shiftright("uid", B.PLACE_BITS)
    place = (F.col("uid") - F.shiftleft(block, B.PLACE_BITS)).cast("int").alias("place")
    kept = _named(table, key, width, percent, rare).where("is_first").select(block.alias("block_id"), place)
    kept = kept.groupBy("block_id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return B.unpacked(table.join(kept, "block_id"), docs.schema, text)


def _packed(docs: DataFrame, key: str, text: str, carry: list[str], width: int) -> DataFrame:
    def signed(texts):
        return _signed(shingle_sets(texts, width))

    return B.packed(docs, text, carry, signed, "n array<int>, s1 array<long>, s2 array<long>")


def _named(table: DataFrame, key: str, width: int, percent: int, rare: int, every: bool = False) -> DataFrame:
    """Per row of the blocks: uid, key, n, component_id, is_first, n_links (null without every link)."""
    fields = F.arrays_zip(F.col(f"c_{key}").cast("array<bigint>").alias("key"), "n", "s1", "s2")
    rows = table.select("block_id", F.posexplode(fields).alias("place", "x"))
    rows = rows.select((F.shiftleft("block_id", B.PLACE_BITS) + F.col("place")).alias("uid"), "x.*")
    first = F.min(F.struct(F.col("key").isNull(), "key", "uid"))
    with passing_tables(table.sparkSession):
        classes = rows.where("n > 0").groupBy("n", "s1", "s2")
        classes = written(
            classes.agg(
                F.min("uid").alias("uid"), F.min("key").alias("least"), first.alias("first"),
                F.count("*").alias("copies")
            ),
            "classes"
        )
        sets = _indexed(table.sparkSession, table, classes, width, percent)
        labels = written(components(_links(sets, percent, rare)), "components")
        labelled = classes.join(labels.select(F.col("v").alias("uid"), "c"), "uid", "left").withColumn("c", F.coalesce("c", "uid"))
        n_links = F.lit(None).cast("long")
        if every:
            counted = written(link_counts(labels, sets.select("uid", "copies", "members"), percent), "link-counts")
            labelled, n_links = labelled.join(counted, "uid", "left"), F.coalesce("linked", F.lit(0)) + F.col("copies") - 1
        groups = labelled.groupBy("c").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        groups = written(groups.select("c", "component_id", F.col("first.uid").alias("first_uid")), "groups")
        named = labelled.join(groups, "c").select("n", "s1", "s2", "component_id", "first_uid", n_links.alias("n_links"))
        named = written(named, "named", keep=True)
    is_first = (F.col("uid") == F.col("first_uid")).alias("is_first")
    filled = rows.where("n > 0").join(named, ["n", "s1", "s2"]).select("uid", "key", "n", "component_id", is_first, "n_links")
    none = F.lit(0 if every else None).cast("long").alias("n_links")
    empty = rows.where("n = 0").select("uid", "key", "n", F.col("key").alias("component_id"), F.lit(True).alias("is_first"), none)
    return filled.unionByName(empty)


def _indexed(spark: SparkSession, table: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Of each class that may have a partner: uid, copies, n, m, near, far, members, sketch.

    near and far are the n-grams of its prefix that another class has too: near those that it can share
    with a set of its size or more, far the others. members is the whole set, m how many of these
    another class has: no overlap is larger, so a class with too few of them is left out."""
    total = table.agg(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).first()[0] or 0
    n_ranges = B.n_ranges(total, partitions(spark))

    def hashed(batches):
        for b in batches:
            for block, sizes, blob in zip(*(b.column(c).to_pylist() for c in ("block_id", "sizes", "blob")), strict=True):
                sets = shingle_sets(B.texts_of(blob, sizes), width)
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                if len(h):
                    yield B.range_batch(list(B.by_range(block, h, n_ranges, n)))

    thin = table.select("block_id", "sizes", "blob")
    counts = B.totals(thin.mapInArrow(thrifty(hashed), B.RANGES), 2)
    place = F.expr(f"cast(uid & {(1 << B.PLACE_BITS) - 1} as int)").alias("place")
    reps = classes.select(F.shiftright("uid", B.PLACE_BITS).alias("block_id"), place, "copies")
    reps = reps.groupBy("block_id").agg(F.collect_list(F.struct("place", "copies")).alias("reps"))
    arrow = pa.schema(
        [
            ("uid", pa.int64()), ("copies", pa.int64()), ("n", pa.int32()), ("m", pa.int32()),
            ("near", pa.list_(pa.int64())), ("far", pa.list_(pa.int64())), ("members", pa.binary()), ("sketch", pa.list_(pa.int64()))
        ]
    )

    def prefixes(batches):
        for b in batches:
            for row in b.to_pylist():
                sets = shingle_sets(B.texts_of(row["blob"], row["sizes"]), width)
                _, at = np.unique(np.concatenate(sets), return_inverse=True)
                df = np.maximum(B.counts_of(row["parts"], int(at.max(initial=-1)) + 1), 1)[at]
                ends = np.cumsum([len(s) for s in sets])
                out = []
                for r in row["reps"]:
                    s = sets[r["place"]]
                    n = len(s)
                    f = df[ends[r["place"]] - n : ends[r["place"]]]
                    also = (f > r["copies"]) | (f == 65535)  # counts stop there
                    m = int(also.sum())
                    if m < needed(n, percent):
                        continue
                    prefix = np.lexsort((s, f))[: n - needed(n, percent) + MOST_COMBINED]
                    others = also[prefix]
                    shared = s[prefix[others]].view(np.int64)
                    near = int(others[: n - needed_alike(n, percent) + MOST_COMBINED].sum())
                    if len(shared):
                        uid = (row["block_id"] << B.PLACE_BITS) + r["place"]
                        out.append((uid, r["copies"], n, m, shared[:near], shared[near:], s.tobytes(), sketch(s)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    schema = "uid long, copies long, n int, m int, near array<long>, far array<long>, members binary, sketch array<long>"
    return written(B.with_totals(thin, counts).join(reps, "block_id").mapInArrow(thrifty(prefixes), schema), "sets")


def _largest(n: str, m: str, percent: int) -> Column:
    """The largest set that one of n, of which m n-grams are in other sets, can be similar to."""
    by_shared = F.floor(F.col(m) * (100 + percent) / percent) - F.col(n)
    return F.least(by_shared, F.floor(F.col(n) * 100 / percent))


def _links(sets: DataFrame, percent: int, rare: int) -> DataFrame:
    """Verified links (a, b), enough of them to connect all that is connected.

    The stars of the first round have the set that shares the largest part of its n-grams as their hub,
    those of later rounds another one for each token. What they leave unlinked is looked at in full."""
    flagged = lambda c, near: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(near).alias("near")))
    both = F.explode(F.concat(flagged("near", True), flagged("far", False))).alias("t")
    post = written(sets.select("uid", "n", "m", both).select("uid", "n", "m", "t.*"), "postings")
    size = post.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    post = written(post.join(written(size, "tokens"), "token").drop("size"), "postings")
    links = tested = comp = None
    now = post.withColumn("c", F.col("uid"))
    for n_round in range(STAR_ROUNDS):
        rank = F.col("m") / F.col("n") if n_round == 0 else F.xxhash64("token", "uid", F.lit(n_round)) / F.lit(2.0**63)
        hub = F.struct(
            rank.alias("rank"), (-F.col("uid")).alias("u"), F.col("uid").alias("hu"), F.col("n").alias("hn"),
            F.col("m").alias("hm"), F.col("c").alias("hc")
        )
        ends = now.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(hub).alias("x"))
        ends = written(ends.where("lo < hi").select("token", "x.hu", "x.hn", "x.hm", "x.hc"), "hubs")
        sized = F.col("hn").between(F.ceil(F.col("n") * percent / 100), _largest("n", "m", percent)) & (F.col("n") <= _largest("hn", "hm", percent))
        at = now.join(ends, "token").where((F.col("c") != F.col("hc")) & sized)
        found, tested = _verified(at.select(F.least("uid", "hu").alias("a"), F.greatest("uid", "hu").alias("b")).distinct(), tested, sets, percent)
        if found is None and n_round:
            break
        if found is not None:
            links = found if links is None else links.unionByName(found)
            comp = components(links)
            now = post.join(comp, post["uid"] == comp["v"], "left")
            now = written(now.select("token", "uid", "n", "m", "near", F.coalesce("c", "uid").alias("c")), "postings")
    for _ in range(OPEN_ROUNDS):
        now = _open(now, percent)
    near, rest = _apart(now, percent)
    live = _met(_combined(_open(rest, percent), percent, rare))
    outside = near.unionByName(live.where("c != top").select("uid", F.col("top").alias("c"))).distinct()
    for found in (_to_largest(outside, comp, sets, percent), _verified(_others(live, percent), tested, sets, percent)[0]):
        if found is not None:
            links = found if links is None else links.unionByName(found)
    return links if links is not None else post.sparkSession.createDataFrame([], "a long, b long")


def _open(now: DataFrame, percent: int) -> DataFrame:
    """The postings whose set may have a partner outside its component at their token.

    The smaller set of a pair has the token near, of equal ones both have. So a token is of use where
    components differ, to a set with the token near or larger than the least that has it near, if
    the least is no larger than a partner may be and the largest no smaller."""
    least = F.min(F.when(F.col("near"), F.col("n")))
    of = now.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), least.alias("least"), F.max("n").alias("most"))
    of = written(of.where("lo < hi and least is not null").select("token", "least", "most"), "tokens")
    useful = (F.col("near") | (F.col("n") > F.col("least"))) & (F.col("least") <= _largest("n", "m", percent))
    useful = useful & (F.col("most") >= F.ceil(F.col("n") * percent / 100))
    return written(now.join(of, "token").where(useful).select("token", "uid", "n", "m", "near", "c"), "open")


def _apart(now: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(uid, c) of sets that may link with one of the component c, and the postings of all other pairs.

    At a token the component with most sets, if it has several, needs no combinations: each other set there is
    a candidate for the component as a whole, if that has as many of the set's tokens as similar sets share, at sizes
    that may be. Where at none of the tokens that two sets share one is of that component, both are among the
    postings outside of it. So the many combinations of a large group's tokens are never made."""
    least = F.min(F.when(F.col("near"), F.col("n")))
    has = now.groupBy("token", "c").agg(F.count("*").alias("here"), least.alias("least"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    has = written(has, "token-components")
    top = has.groupBy("token").agg(F.max(F.struct("here", "c")).alias("t"))
    top = written(top.select("token", F.when(F.col("t.here") > 1, F.col("t.c")).alias("top")), "largest")
    rest = written(now.join(top, "token").where("top is null or c != top"), "rest")
    pairs = rest.where("top is not null").select("uid", F.col("top").alias("c")).distinct()
    both = pairs.join(now.select("uid", "token", "n", "m", "near"), "uid").join(has, ["token", "c"])
    may = (F.col("near") | (F.col("n") > F.col("least"))) & (F.col("fewest") <= _largest("n", "m", percent))
    both = both.where(may & (F.col("most") >= F.ceil(F.col("n") * percent / 100)))
    enough = F.col("shared") >= F.least(F.lit(MOST_COMBINED), F.ceil(F.col("n") * percent / 100))
    near = both.groupBy("uid", "c", "n").agg(F.count("*").alias("shared")).where(enough).select("uid", "c")
    return written(near, "near-largest"), rest.drop("top")


def _combined(now: DataFrame, percent: int, rare: int) -> DataFrame:
    """The index: t1, t2, t3 (0 for none), uid, n, m, c, near.

    Tokens with the very same postings are alike: they go under one name with their number as weight,
    which leaves the same pairs. A rare token is a key of its own. A frequent one is combined with
    itself, where its weight allows, and with the frequent ones after it in the order of size and name:
    in twos, or in threes if more than rare * STEP sets have it. Sets that are similar share MOST_COMBINED
    tokens of their prefixes, or all that they need if that is less, which is why short combinations of
    the smallest sets are kept too."""
    alike = now.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("uid", "near")).alias("name"))
    named = now.join(written(alike, "alike"), "token").groupBy("uid", "n", "m", "c", "name", "near").agg(
        F.max("size").alias("size"), F.count("*").alias("weight")
    )
    named = written(named, "names")
    few = named.where(F.col("size") <= rare).select(
        F.col("name").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("t3"), "uid", "n",
        "m", "c", "near"
    )
    many = named.where(F.col("size") > rare).groupBy("uid", "n", "m", "c")
    many = many.agg(F.array_sort(F.collect_list(F.struct("size", "name", "near", "weight"))).alias("names"))
    kinds = {
        "t1": pa.int64(), "t2": pa.int64(), "t3": pa.int64(), "uid": pa.int64(), "n": pa.int32(), "m": pa.int32(),
        "c": pa.int64(), "near": pa.bool_()
    }

    def combine(batches):
        for b in batches:
            for row in b.to_pylist():
                rest = [row[k] for k in ("uid", "n", "m", "c")]
                found = combinations(row["names"], rare, min(MOST_COMBINED, needed(row["n"], percent)))
                while part := list(islice(found, 50_000)):
                    columns = [*zip(*part, strict=True)]
                    columns[3:3] = [[v] * len(part) for v in rest]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    schema = "t1 long, t2 long, t3 long, uid long, n int, m int, c long, near boolean"
    return written(few.unionByName(bounded_batches(many).mapInArrow(thrifty(combine), schema)), "combinations")


def combinations(names: list[dict], rare: int, shortest: int) -> Iterator[tuple[int, int, int, bool]]:
    """(t1, t2, t3, near) for the frequent names of one set, in ascending order; see _combined()."""
    for i, x in enumerate(names):
        k = 2 if x["size"] <= rare * STEP else MOST_COMBINED
        if shortest == 1:
            yield x["name"], 0, 0, x["near"]
        for j in range(i if x["weight"] > 1 else i + 1, len(names)):
            y = names[j]
            near = x["near"] and y["near"]
            if k == 2 or shortest <= 2:
                yield x["name"], y["name"], 0, near
            if k == 3:
                used = 1 + (i == j)
                for z in names[j if y["weight"] > used else j + 1 :]:
                    yield x["name"], y["name"], z["name"], near and z["near"]


def _met(index: DataFrame) -> DataFrame:
    """The rows of the index at keys of several components, with top, the component that has most rows of the key.

    The smaller set of a pair has its key among its near n-grams, of equal ones both have."""
    key = ["t1", "t2", "t3"]
    least = F.min(F.when(F.col("near"), F.col("n")))
    sizes = index.groupBy(*key, "c").agg(F.count("*").alias("members"), least.alias("least"))
    top = sizes.groupBy(*key).agg(F.max(F.struct("members", "c")).alias("t"), F.count("*").alias("parts"), F.min("least").alias("least"))
    top = top.where("parts > 1 and least is not null").select(*key, F.col("t.c").alias("top"), "least")
    return written(index.join(written(top, "largest"), key).where("near or n > least"), "live")


def _to_largest(outside: DataFrame, comp: DataFrame | None, sets: DataFrame, percent: int, block_members: int = BLOCK_MEMBERS) -> DataFrame | None:
    """Links between documents and a component, the largest of one of their keys (outside: uid, c), one at least where there is any.

    A document is compared with all of that component, whose sets are dealt into blocks as in link_counts(); so a
    large component gives a row for each document and block, not for each pair."""
    left = written(outside, "outside")
    tops = left.select("c").distinct()
    right = tops.select(F.col("c").alias("uid"), "c")
    if comp is not None:
        right = right.unionByName(comp.join(tops, "c").select(F.col("v").alias("uid"), "c")).distinct()
    members = sets.select("uid", "members")
    weight = lambda df, name: df.groupBy("c").agg(F.ceil(F.sum(F.length("members") / 8) / block_members).cast("int").alias(name))
    left, right = left.join(members, "uid"), right.join(members, "uid")
    blocks = written(weight(left, "n_left").join(weight(right, "n_right"), "c"), "component-blocks")
    groups = partitions(sets.sparkSession)
    small = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    group = F.when(small, F.pmod(F.xxhash64("c"), F.lit(groups))).otherwise(F.col("c"))
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, is_left, i, j: df.join(blocks, "c").select(
        small.alias("small"), group.alias("g"), i.alias("i"), j, F.lit(is_left).alias("is_left"), "c", "uid", "members"
    )
    rows = side(left, True, own("n_left"), every("n_right").alias("j")).unionByName(side(right, False, every("n_left"), own("n_right").alias("j")))

    def compare(pdf):
        import pandas as pd

        done = []
        for _, one in pdf.groupby("c", sort=False):
            x, y = one[one["is_left"]], one[~one["is_left"]]
            if len(x) and len(y):
                link = _alike([np.frombuffer(m, np.uint64) for m in x["members"]], [np.frombuffer(m, np.uint64) for m in y["members"]], percent)
                some = link.any(axis=1)
                done.append(pd.DataFrame({"a": x["uid"].to_numpy()[some], "b": y["uid"].to_numpy()[link.argmax(axis=1)[some]]}))
        return pd.concat(done) if done else pd.DataFrame({"a": [], "b": []}).astype("int64")

    links = written(rows.groupBy("small", "g", "i", "j").applyInPandas(compare, "a long, b long"), "links")
    return None if links.isEmpty() else links


def _others(live: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a key and of which neither is the key's largest."""
    key = ["t1", "t2", "t3"]
    rows = live.where("c != top")
    side = lambda s: rows.select(*key, *(F.col(x).alias(x + s) for x in ("uid", "n", "m", "c", "near")))
    near = ((F.col("na") > F.col("nb")) | F.col("neara")) & ((F.col("nb") > F.col("na")) | F.col("nearb"))
    sized = (F.col("nb") <= _largest("na", "ma", percent)) & (F.col("na") <= _largest("nb", "mb", percent))
    pairs = side("a").join(side("b"), key).where((F.col("ca") < F.col("cb")) & near & sized)
    return pairs.select(F.least("uida", "uidb").alias("a"), F.greatest("uida", "uidb").alias("b")).distinct()


def _verified(pairs: DataFrame, tested: DataFrame | None, sets: DataFrame, percent: int):
    """The pairs not tested before that are links (None if there are none), and all that are tested now.

    Sketches, a small part of the sets, meet first; what they leave is verified on the whole sets."""
    pairs = written(pairs, "pairs")
    if tested is not None:
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    of = lambda x: sets.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    sizes = F.col("na") + F.col("nb")
    may = (100 + percent) * (sizes - differ) >= 2 * percent * sizes  # half of sizes - differ is the most that they share
    close = written(pairs.join(of("a"), "a").join(of("b"), "b").where(may).select("a", "b"), "close-pairs")
    both = close.join(sets.select(F.col("uid").alias("a"), F.col("members").alias("ma")), "a")
    both = both.join(sets.select(F.col("uid").alias("b"), F.col("members").alias("mb")), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both_n = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both_n >= percent * (len(u) + len(v) - both_n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(bounded_batches(both).select("a", "b", "ma", "mb").mapInArrow(thrifty(verify), "a long, b long"), "links")
    tested = pairs if tested is None else tested.unionByName(pairs)
    return (None if links.isEmpty() else links), tested


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of `left` shares with each other of `right`: products of 0-1 matrices by slices of members."""
    a, b = np.concatenate(left), np.concatenate(right)
    if left is right:  # members of one set only are of no use; a set's overlap with itself isn't asked for
        shared, n_sets = np.unique(a, return_counts=True)
        shared = shared[n_sets > 1]
    else:
        shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    wide = max(256, (1 << 20) // max(len(left), len(right)))
    places = []
    for flat, sets in ((a, left), (b, right)):
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        ok = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok], len(sets)))
    for start in range(0, len(shared), wide):
        m = []
        for row, at, n in places:
            part = (at >= start) & (at < start + wide)
            m.append(np.zeros((n, min(wide, len(shared) - start)), np.float32))
            m[-1][row[part], at[part] - start] = 1
        out += m[0] @ m[1].T
    return out


def _alike(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of x are similar enough to which of y; the diagonal has no meaning where y is x."""
    shared = overlaps(x, y)
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    return 100 * shared >= percent * (sizes - shared)


def link_counts(labels: DataFrame, sets: DataFrame, percent: int = PERCENT, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """uid, linked: how many rows the classes stand for that each class links with.

    Links lie within components (labels: v, c). A component's sets are dealt by hash into blocks of about
    block_members members; every two blocks of it meet in a group that counts their links by matrix
    products and gives one row a set, so pairs are never rows. Small components share a group."""
    rows = labels.select(F.col("v").alias("uid"), "c").join(sets, "uid").withColumn("weight", F.length("members") / 8)
    size = rows.groupBy("c").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    size = written(size.where("n > 1").select("c", F.ceil(F.col("weight") / block_members).cast("int").alias("blocks"), "weight"), "component-sizes")
    total = size.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0
    groups = max(partitions(sets.sparkSession), int(total // block_members) + 1)
    own = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("uid"), F.col("blocks"))).cast("int")
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("c"), F.lit(groups))).otherwise(F.col("c"))
    rows = rows.drop("weight").join(size.drop("weight"), "c").withColumn("own", own).withColumn("g", group)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.col("blocks") == 1, "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
        "c", "uid", "copies", "members"
    )
    rows = rows.toDF("small", "g", "i", "j", "own", "c", "uid", "copies", "members")

    def count(pdf):
        import pandas as pd

        done = []
        for _, one in pdf.groupby("c", sort=False):
            i, j = one["i"].iat[0], one["j"].iat[0]
            left, right = one[one["own"] == i], one[one["own"] == j]
            if len(left) == 0 or len(right) == 0:
                continue
            x = [np.frombuffer(m, np.uint64) for m in left["members"]]
            y = x if i == j else [np.frombuffer(m, np.uint64) for m in right["members"]]
            link = _alike(x, y, percent)
            if i == j:
                np.fill_diagonal(link, False)
            sides = [(left, link @ right["copies"].to_numpy())] + ([] if i == j else [(right, link.T @ left["copies"].to_numpy())])
            done += [pd.DataFrame({"uid": side["uid"].to_numpy(), "linked": n}) for side, n in sides]
        return pd.concat(done) if done else pd.DataFrame({"uid": [], "linked": []}).astype("int64")

    counted = rows.groupBy("small", "g", "i", "j").applyInPandas(count, "uid long, linked long")
    return counted.groupBy("uid").agg(F.sum("linked").alias("linked"))
