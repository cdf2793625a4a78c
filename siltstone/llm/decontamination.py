"""Benchmark decontamination by size-partitioned MinHash containment search, in built-in Spark functions only.

A benchmark item is a short set of word shingles, a document a long one, so their similarity is tiny even if the
document holds the whole item; containment must be asked. Items are partitioned by set size (powers of two), and each
partition has its sketch length: the k least hashes of an item's shingles, k = u - ceil(t u) + 1 for the partition's
largest size u. A document that contains a share t or more of an item lacks too few shingles to miss all k of them, so
looking up all of a document's shingle hashes in the sketches finds every leak. Found pairs are verified on the
shingles themselves.

The sketches are broadcast where their counted size allows (`most_broadcast` rows), else joined by a shuffle. Texts
are read twice: once for their hashes, and again for the few documents that a candidate names, which a bitmap of their
ids picks before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import SALTS, bitmap_of, keep, sift, table, without

WIDTH, NUM, DEN = 5, 80, 100


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _bound(w: Column, made) -> Column:
    """made(w) with w evaluated once a row, not once an element."""
    return F.flatten(F.transform(F.array(w), made))


def _hashes(w: Column, width: int) -> Column:
    """Hashes of all shingles in order, repeats included."""
    one = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return _bound(w, lambda w: F.when(F.size(w) >= width, one(w)).otherwise(F.array().cast("array<bigint>")))


def _shingles(w: Column, width: Column) -> Column:
    one = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.concat_ws(" ", F.slice(w, i, width)))
    return F.array_distinct(_bound(w, lambda w: F.when(F.size(w) >= width, one(w)).otherwise(F.array().cast("array<string>"))))


def leaks(docs: DataFrame, items: DataFrame, num: int = NUM, den: int = DEN, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: pairs with den * n_shared >= num * n_item_shingles.

    docs(doc_id, text, ...), items(item_id, text, ...). An item with 1 to 4 words is one shingle, its whole sequence,
    looked for anywhere in a document; items without words match nothing, nor do documents without words. Repeated rows
    and ids give one pair, with the largest share of its rows. Null ids are kept as an id. Other columns are ignored;
    an empty table gives no pairs.
    """
    listed = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    listed = listed.withColumn("width", F.least(F.lit(WIDTH), F.size("w")))
    listed = listed.select("item_id", "width", _shingles(F.col("w"), F.col("width")).alias("shingles"), "w").withColumn("n", F.size("shingles"))
    listed = keep(listed, "items")
    widths = sorted(r.width for r in listed.select("width").distinct().collect())  # five values at most
    if not widths:
        nothing = docs.where("false").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", items.schema["item_id"].dataType), ("n_item_shingles", "long"), ("n_shared", "long"), ("containment", "double"))])
        return nothing
    index = None
    for width in widths:
        size_class = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
        largest = F.pow(F.lit(2.0), size_class + 1).cast("int") - 1
        sketch = F.slice(F.array_sort(F.array_distinct(_hashes(F.col("w"), width))), F.lit(1), largest - F.ceil(largest * num / den).cast("int") + 1)
        own = listed.where(F.col("width") == width).select("item_id", F.explode(sketch).alias("hash"))
        index = own if index is None else index.unionAll(own)
    index = keep(index, "sketches")
    if index.count() <= most_broadcast:
        index = F.broadcast(index)
    # shingles of different widths have different hashes, or meet and aren't verified
    asked = _bound(words(F.col("text")), lambda w: F.concat(*[_hashes(w, width) for width in widths]))
    found = keep(docs.select("doc_id", F.explode(asked).alias("hash")).join(index, "hash").select("doc_id", "item_id").distinct(), "candidates")
    wanted = found.join(listed.withColumnRenamed("item_id", "listed_id"), found["item_id"].eqNullSafe(F.col("listed_id"))).select(F.col("doc_id").alias("found_id"), "item_id", "width", "shingles", "n")
    wanted = wanted.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = F.xxhash64("doc_id")
    texts = sift(docs.select("doc_id", "text"), named, bitmap_of(found, named)).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    both = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["found_id"]) & (texts["salt"] == wanted["turn"]))
    shared = F.size(F.array_intersect("shingles", _shingles(words(F.col("text")), F.col("width"))))
    pairs = both.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"), shared.cast("long").alias("n_shared"))
    pairs = pairs.where(F.col("n_shared") * den >= F.col("n_item_shingles") * num)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", "b.containment")


def clean(docs: DataFrame, items: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs without the rows of an id that leaks an item; all columns stay as they are, whatever their names."""
    return without(docs, F.col("doc_id"), keep(leaks(docs.select("doc_id", "text"), items, num, den).select("doc_id").distinct(), "leaking"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: all documents against all benchmark items; see leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = "select {id}, unnest(list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width} - 1], ' ')))) as s from {source} where len(w) >= {width}"
#: all shingles of documents against all of the items, counted
OP7_SQL = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from benchmark),
ds as ({_SHINGLES.format(id="doc_id", width=WIDTH, source="d")}),
bs as ({_SHINGLES.format(id="item_id", width=WIDTH, source="b")}),
n as (select item_id, count(*) as n_item_shingles from bs group by item_id),
m as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles as containment
from m join n using (item_id) where n_shared * {DEN} >= n_item_shingles * {NUM}
"""
