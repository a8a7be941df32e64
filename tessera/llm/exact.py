"""Exact duplicates by deterministic block naming, with DataFrame functions only.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Whether two texts are equal is never decided by a hash:

1. A text whose (length, 64-bit hash) nobody shares can equal no other text, as
   equal texts share both; it is its own class.
2. The others are cut into blocks of ``block`` characters. Distinct blocks are dealt to
   partitions, sorted there and numbered: each gets an integer name of its own.
3. Adjacent names are paired and the distinct pairs sorted and numbered in turn (a
   name without partner is paired with nothing), until each text has one name.
   Two texts have one name at the end if and only if all their characters agree.

A class with millions of members costs no more than its text: blocks and pairs are
pre-aggregated before they are shuffled, and the join that hands out names splits
its large partitions.

Of equal texts, the row with the most code points in the original text stays, then
the smallest doc_id.

Defined results: null counts as empty; empty texts are equal to each other; rows
that repeat a doc_id are rows of their own, and if the class's best row is repeated
in full, each of these rows is marked kept (they cannot be told apart); a null
doc_id sorts last; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames

BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _named(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` with ``name``: the place of its key among the sorted distinct keys of its
    partition, with the partition's number above. Equal keys share a partition, so
    names are equal exactly where keys are, and no task or driver sees all keys."""
    ranked = parts.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return parts.join(frames.stored(ranked), keys)


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, size, name) for each (row, size, norm), size being the length of norm:
    equal size and name, equal norm."""
    last = F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) / block).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("norm"), i * block + 1, F.lit(block)))
    # Stored, as they are read twice: what comes before deals out the whole corpus.
    blocks = frames.stored(texts.select("row", "size", last.alias("last"), F.posexplode(cut).alias("at", "part")))
    named = frames.stored(_named(blocks, ["part"]).select("row", "size", "last", "at", "name"))
    longest = named.agg(F.max("last")).first()[0] or 0
    roots = [named.filter("last = 0")]
    # Texts of one length have equally many names, so they reach their last name in the same level.
    for _ in range(longest.bit_length()):
        pairs = named.filter("last > 0").groupBy("row", "size", F.expr("last div 2").cast("int").alias("last"), F.expr("at div 2").cast("int").alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        named = frames.stored(_named(pairs, ["a", "b"]).select("row", "size", "last", "at", "name"))
        roots.append(named.filter("last = 0"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out.select("row", "size", "name").distinct()


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256,
    n_chars."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    base = base.withColumn("size", F.length("norm")).withColumn("hash", F.xxhash64("norm"))
    facts = frames.stored(base.select("doc_id", "n_chars", "size", "hash", F.sha2("norm", 256).alias("text_sha256")))
    shared = frames.stored(facts.groupBy("size", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("size", "hash"))
    mine = frames.stored(facts.join(shared, ["size", "hash"]))
    # The text is dealt by document, so a class of any size is spread over all tasks.
    ids = mine.select("doc_id", "size", "hash").distinct()
    same = base["doc_id"].eqNullSafe(ids["doc_id"]) & (base["size"] == ids["size"]) & (base["hash"] == ids["hash"])
    texts = base.join(ids, same, "left_semi").select(F.struct("doc_id", F.sha2("norm", 256).alias("sha")).alias("row"), "size", "norm")
    named = identities(texts, block).select(F.col("row.doc_id").alias("_id"), F.col("row.sha").alias("_sha"), "name")
    of = mine["doc_id"].eqNullSafe(named["_id"]) & (mine["text_sha256"] == named["_sha"])
    members = frames.stored(mine.join(named, of).select("doc_id", "n_chars", "text_sha256", "size", "name"))
    # Stored first, so that the joins on it deal both sides anew and can split a large class.
    best = frames.stored(members.groupBy("size", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus"), "doc_id")).alias("best")))
    copies = members.join(best, ["size", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == F.col("best.n_chars"))).alias("kept"), "text_sha256", "n_chars")
    alone = facts.join(shared, ["size", "hash"], "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_chars")
    return alone.unionByName(copies)


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, single: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay. Rows alike in doc_id and text are one document
    and all stay, or, if ``single``, one of them, whatever else they hold."""
    facts = exact_duplicates(docs, doc_id, text, block)
    keys = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n")]

    def of(rows: DataFrame, own: DataFrame) -> Column:
        return rows[doc_id].eqNullSafe(own["_id"]) & (F.sha2(normalised(rows[text]), 256) == own["_sha"]) & (F.length(F.coalesce(rows[text], F.lit(""))) == own["_n"])

    gone = facts.filter(~F.col("kept")).select(*keys).distinct()
    left = docs.join(gone, of(docs, gone), "left_anti")
    if not single:
        return left
    # Texts are only shuffled once more where rows repeat at all.
    again = frames.stored(facts.filter("kept").select(*keys).groupBy("_id", "_sha", "_n").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if again.isEmpty():
        return left
    once = left.join(again, of(left, again), "left_anti")
    return once.unionByName(left.join(again, of(left, again), "left_semi").dropDuplicates([doc_id, text]))
