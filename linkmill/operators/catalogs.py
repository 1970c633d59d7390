"""Which names of a catalog lie in which texts, for catalogs of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.operators.grams import contained
from linkmill.operators.joins import grid_join

#: Characters of a catalog that one automaton may hold; tasks hold some 50 bytes for each.
AUTOMATON_CHARS = 4_000_000


def found_names(texts: DataFrame, key: str, text: str, catalog: DataFrame, name: str, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(key, name): each name of the catalog, lower case, with each text that holds it without regard to case, once.

    A catalog of up to most_chars characters, which is counted first, becomes an Aho-Corasick automaton in each task, so
    a text is read once however many names there are. A larger one meets the texts by its rarest trigrams.
    Null and empty names are left out, null texts hold none; texts has one row a key."""
    names = catalog.select(F.lower(F.col(name)).alias("name")).where("name != ''").distinct()
    rows = texts.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
    if (names.agg(F.sum(F.length("name"))).first()[0] or 0) > most_chars:
        return contained(names, rows, "name", "key", "low").select(F.col("key").alias(key), F.col("name").alias(name))
    patterns = texts.sparkSession.sparkContext.broadcast([r.name for r in names.collect()])  # most_chars at most

    def search(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns.value:
            automaton.add_word(p, p)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column("low").to_pylist()):
                mine = {p for _, p in automaton.iter(t)} if t and len(automaton) else ()
                at += [i] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=["key", "name"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(search, f"key {kind}, name string").select(F.col("key").alias(key), F.col("name").alias(name))


def first_labels(texts: DataFrame, key: str, text: str, catalog: DataFrame, name: str, label: str, rank: str, otherwise: str | None = None) -> DataFrame:
    """(key, label, n_names): the label of the catalog's row with the smallest rank (then label) whose name the text
    holds, and how many names it holds. A name may have several rows; texts without a name get `otherwise` and 0."""
    found = found_names(texts, key, text, catalog, name)
    labels = catalog.select(F.lower(F.col(name)).alias("_name"), F.col(label).alias("_label"), F.col(rank).alias("_rank"))
    found = grid_join(found.withColumnRenamed(name, "_name"), labels, "_name", key, "_label")
    best = found.groupBy(key).agg(F.min(F.struct("_rank", "_label")).alias("_b"), F.count_distinct("_name").alias("n_names"))
    out = texts.select(key).join(best, key, "left")
    none = F.lit(otherwise).cast(catalog.schema[label].dataType)
    return out.select(key, F.when(F.col("_b").isNotNull(), F.col("_b._label")).otherwise(none).alias(label), F.coalesce("n_names", F.lit(0)).alias("n_names"))
