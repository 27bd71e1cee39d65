"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A test item is contained in a document if at least ``CONTAINMENT`` of its distinct shingles (``SHINGLE`` consecutive
words, lower-cased runs of letters and digits) occur in the document, however long that is.

* Items are partitioned by size: a class holds the items with a number of shingles in one power of two.  An item's sketch
  are its smallest shingle hashes, floor((1 - CONTAINMENT) * largest size of the class) + 1 of them: a
  document that holds enough of the item misses at most as many shingles as leave one of the sketch in it.  The
  sketch is therefore a sure filter, and its largest hash bounds what a document has to offer: other shingles of
  the document are dropped right after hashing.
* Shingles that pass meet the sketches in an equi-join.  The sketch table is broadcast only if its counted rows stay
  under ``BROADCAST_ROWS``; beyond that it is shuffled, with pre-aggregated documents' rows.
* Candidate pairs are written to the shared folder and counted: up to ``BROADCAST_ROWS`` of them are broadcast, so only the
  texts of candidates move; beyond that both sides are shuffled.  A pair is verified by the item's shingles that
  are among the document's, as strings; a document's shingles are hashed once a pair.

Defined results: items under ``SHINGLE`` words have one shingle, the whole sequence; an item without words, a null
item and a null or empty text match nothing; rows that repeat a doc_id are verified each for itself; rows of the
benchmark with the same id and the same words are one item, other texts under that id (or without one) are items of their own, each
reported by its id; null ids are reported as null; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meltfield.llm._batches import written

SHINGLE, CONTAINMENT = 5, 0.8
#: Rows of the sketch table (a hash, an item, two counts: under 100 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def words(text):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: str, one: str, size: int = SHINGLE) -> str:
    """SQL for an array over the word array ``w``: ``one`` of the ``size`` words from each position ``i``."""
    return f"case when size({w}) >= {size} then transform(sequence(0, size({w}) - {size}), i -> {one}) else array() end"


def _hash(w: str, size: int = SHINGLE) -> str:
    return "xxhash64(" + ", ".join(f"{w}[i + {k}]" for k in range(size)) + ")"


def _joined(w: str, size: int = SHINGLE) -> str:
    return f"array_join(slice({w}, i + 1, {size}), ' ')"


def items_with_sketches(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items ``(item_id, content, words, n_shingles, shingles)``, ``words`` the length of a shingle, and their sketches ``(h, item_id, content, n_shingles, size_class, words)``.

    An item is its id and its words: ``content`` is a 128-bit hash of them.
    """
    w = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where("size(w) > 0")
    w = w.withColumn("content", F.unhex(F.md5(F.array_join("w", " "))))
    def pairs(n):
        return _shingles("w", f"struct({_hash('w', n)} as h, {_joined('w', n)} as s, {n} as words)", n)

    by_length = "case " + " ".join(f"when size(w) = {n} then {pairs(n)}" for n in range(1, SHINGLE)) + f" else {pairs(SHINGLE)} end"
    each = w.select("item_id", "content", F.explode(F.expr(by_length)).alias("x")).select("item_id", "content", "x.h", "x.s", "x.words").distinct()
    items = each.groupBy("item_id", "content").agg(F.first("words").alias("words"), F.count("*").alias("n_shingles"), F.array_sort(F.collect_list("s")).alias("shingles"))
    own = items.select(F.col("item_id").alias("own_id"), F.col("content").alias("own_content"), "n_shingles")
    sized = each.join(own, F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content")))
    sized = sized.withColumn("size_class", F.ceil(F.log2("n_shingles")).cast("int"))
    classes = items.groupBy(F.ceil(F.log2("n_shingles")).cast("int").alias("own_class")).agg(F.max("n_shingles").alias("largest"))
    sized = sized.join(F.broadcast(classes), F.col("size_class") == F.col("own_class"))  # a row for each power of two: 64 at most
    sketch = F.floor((1 - F.lit(CONTAINMENT)) * F.col("largest") + 1e-9) + 1
    ranked = sized.withColumn("k", sketch).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "content").orderBy("h", "s")))
    return items, ranked.where("rank <= k").select("h", "item_id", "content", "n_shingles", "size_class", "words")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shingles LONG, n_found LONG, containment DOUBLE)`` of every contained item of every row."""
    return _verified(docs, benchmark, doc_id, text, item_id, item_text).drop("text_sha")


def _verified(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``contaminated`` with ``text_sha``, the SHA-256 of the row's text: with the doc_id it says which row was verified."""
    items, sketches = items_with_sketches(benchmark, item_id, item_text)
    items, sketches = written(items, "items"), written(sketches, "sketches")
    # the largest hash that a sketch holds, for each length of shingle
    highest = {r["words"]: r["high"] for r in sketches.groupBy("words").agg(F.max("h").alias("high")).collect()}  # five rows at most
    small = sketches.count() <= BROADCAST_ROWS
    # 64 bits of the text keep the rows under one id apart in the search; every row that is met is verified by itself
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    if not highest:
        item_kind = items.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, n_shingles long, n_found long, text_sha binary, containment double")
    # shingles of a document that a sketch may hold; shorter ones only if an item is that short
    w = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    offered = F.expr("concat(" + ", ".join(f"filter({_shingles('w', _hash('w', n), n)}, h -> h <= {high}L)" for n, high in sorted(highest.items())) + ")")
    # the words stay below the explode: a column used above it would be copied to every shingle; the outer explode keeps the
    # optimizer from inferring a filter on the array, which would rebuild the words for every shingle; its null rows join nothing
    probes = w.select("doc_id", "text_hash", F.size("w").alias("n_words"), offered.alias("offered")).select("doc_id", "text_hash", "n_words", F.explode_outer("offered").alias("h"))
    build = sketches.withColumnRenamed("h", "sketch_h")
    if small:
        build = F.broadcast(build)
    else:
        probes = probes.groupBy("doc_id", "text_hash", "h").agg(F.max("n_words").alias("n_words"))
    # a document with n words has at most n shingles, so larger classes cannot be contained in it
    candidates = probes.join(build, (F.col("h") == F.col("sketch_h")) & (F.col("n_words") >= F.lit(CONTAINMENT) * F.col("n_shingles"))).select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), F.col("item_id").alias("c_item"), F.col("content").alias("c_content")).distinct()
    candidates = written(candidates, "candidates")
    met = F.broadcast(candidates) if candidates.count() <= BROADCAST_ROWS else candidates
    texts = texts.join(met, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_hash") == F.col("c_hash")))
    joined = texts.join(items.withColumnRenamed("item_id", "own_item"), F.col("c_item").eqNullSafe(F.col("own_item")) & (F.col("c_content") == F.col("content")))
    # bound to a lambda's variable, the words are made once for each pair; the explode keeps them from being made again for the filter
    held = joined.select("doc_id", F.col("c_item").alias("item_id"), "n_shingles", "shingles", "words", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha"), F.array(words(F.col("text"))).alias("texts"))
    own = "case " + " ".join(f"when words = {n} then {_shingles('w', _joined('w', n), n)}" for n in sorted(highest)) + " end"
    found = F.expr(f"filter(transform(texts, w -> struct(n_shingles, size(array_intersect(shingles, {own})) as n_found)), x -> x.n_found >= {CONTAINMENT} * x.n_shingles)")
    counted = held.select("doc_id", "item_id", "text_sha", F.explode_outer(found).alias("x")).where("x is not null").select("doc_id", "item_id", "x.n_shingles", F.col("x.n_found").cast("long").alias("n_found"), "text_sha")
    return counted.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no test item, whatever other rows with the same doc_id hold."""
    bad = written(_verified(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_sha").alias("bad_sha")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    same_text = F.unhex(F.sha2(docs["text"].cast("binary"), 256)) == bad["bad_sha"]
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & same_text, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return found.select("doc_id", "item_id", "n_shingles", "n_found", F.round("containment", 6).alias("containment"))


#: The same rows in DuckDB: every shingle of every document against every shingle of every item.
ORACLE_SQL = f"""
with d as (select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from documents),
b as (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from benchmark),
i as (select row_number() over () as item, item_id, w, least(len(w), {SHINGLE}) as n from b where len(w) > 0),
ds as (select distinct row, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as s from d, (select distinct n from i) where len(w) >= n),
bs as (select distinct item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as s from i),
c as (select item, count(*) as n_shingles from bs group by item),
f as (select row, item, count(*) as n_found from ds join bs using (n, s) group by row, item)
select doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) as containment
from f join c using (item) join d using (row) join i using (item) where n_found >= {CONTAINMENT} * n_shingles
"""
