"""Benchmark decontamination over a distributed positional inverted index, with built-in functions only.

The index holds a posting (document, position, term) for every occurrence in the corpus of a term that some
benchmark item has; nothing is sampled. For each window of an item the corpus frequencies order its terms. The
posting list of the rarest one, moved back by the term's place in the window, gives possible starts; the list of
the second rarest, moved likewise, is intersected with them; what is left is intersected with all other lists.
Every join with postings has the document in its key, so that neither a common term nor a passage that a third of
the documents share gathers in one task.

Defined results: null and empty texts have no words; a very long text has as many postings as words that the benchmark has;
benchmark rows without words match nothing; of terms that tie in rarity the first by name and place counts as rarer; rows that
repeat a doc_id are judged each by its own text and each returned (a document is known by a 64-bit hash of id and text); an item
whose id is null counts under the empty string; columns other than doc_id and text (item_id and text) are ignored, so that clashing
names do no harm; an empty table gives an empty result, and with an empty benchmark nothing matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.llm.common import Scratch, ascii_lower, bounded_broadcast, bounded_joins, sha256_joined, words_of

WINDOW = 10
#: How far, in words, the three rarest terms of a window may stand from their places in a proximity match.
SLOP = 2


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, len, item, off, word): each distinct window once for each of its words and items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(words_of(F.col("text")), ascii_lower).alias("w"))
    n = F.size("w")
    starts = F.when(n > window, F.sequence(F.lit(0), n - window)).when(n > 0, F.array(F.lit(0)))
    wins = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, window).alias("w")).distinct()
    return wins.select(F.xxhash64(F.array_join("w", " ")).alias("win"), F.size("w").alias("len"), "item", F.posexplode("w").alias("off", "word"))


def build_index(documents: DataFrame, words: DataFrame) -> DataFrame:
    """Postings (doc, pos, term) of the given distinct words; a row with term null holds a document's id and length.

    ``doc`` is a hash of id and text, so that rows with one id and different texts stay apart.
    """
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), words_of(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "doc", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "raw"))
    rows = rows.select("doc", "pos", "doc_id", "n_words", ascii_lower(F.col("raw")).alias("word"))
    known = words.select("word", F.xxhash64("word").alias("term")).union(words.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast("long").alias("term")))
    first = F.col("pos") == 0
    return rows.join(bounded_broadcast(known), "word").select("doc", (F.col("pos") - 1).alias("pos"), "term", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_words")).alias("n_words"))


def ranked_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(win, len, off, term, rank): a window's places from its rarest term in the corpus (rank 1) to its commonest."""
    seen = index.filter("term is not null").groupBy("term").agg(F.count("*").alias("seen"))
    places = windows.select("win", "len", "off", "word", F.xxhash64("word").alias("term")).distinct()
    order = Window.partitionBy("win").orderBy(F.coalesce("seen", F.lit(0)), "word", "off")
    return places.join(seen, "term", "left").withColumn("rank", F.row_number().over(order)).select("win", "len", "off", "term", "rank")


def _second(ranked: DataFrame) -> DataFrame:
    """One row a window: the places of its three rarest terms (null where it has fewer)."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return ranked.filter("rank <= 3").groupBy("win", "len").agg(*[at(r, c).alias(f"{c}{r}") for r in (1, 2, 3) for c in ("off", "term")])


def candidates(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(doc, win, len, start, off3, term3, delta): starts where the two rarest terms stand, the second at most ``slop`` words off its place."""
    first = index.select("doc", "pos", F.col("term").alias("term1")).join(bounded_broadcast(anchors), "term1").withColumn("start", F.col("pos") - F.col("off1")).drop("pos", "term1", "off1")
    width = 2 * slop + 1
    place = F.col("start") + F.col("off2")
    cell = lambda c: F.floor(c / width)
    alone = first.filter("term2 is null").select("doc", "win", "len", "start", "off3", "term3", F.lit(0).alias("delta"))
    pairs = first.filter("term2 is not null").withColumn("cell", F.explode(F.array_distinct(F.array(cell(place - slop), cell(place + slop)))))
    seconds = bounded_broadcast(anchors.select("term2").filter("term2 is not null").distinct())
    other = index.select("doc", F.col("term").alias("term2"), F.col("pos").alias("pos2")).join(seconds, "term2", "left_semi").withColumn("cell", cell(F.col("pos2")))
    near = pairs.join(other, ["doc", "term2", "cell"]).withColumn("delta", F.col("pos2") - F.col("start") - F.col("off2")).filter(F.abs("delta") <= slop)
    return alone.union(near.select("doc", "win", "len", "start", "off3", "term3", "delta"))


def exact_matches(index: DataFrame, ranked: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, win, len, start): the candidates at which every word of the window stands at its place."""
    starts = found.filter("delta = 0 and start >= 0").select("doc", "win", "start").distinct()
    places = starts.join(bounded_broadcast(ranked.select("win", "len", "off", "term")), "win").withColumn("pos", F.col("start") + F.col("off"))
    there = places.join(index.select("doc", "pos", "term"), ["doc", "pos", "term"], "left_semi")
    return there.groupBy("doc", "win", "len", "start").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("len")).drop("n")


def proximity_matches(index: DataFrame, ranked: DataFrame, found: DataFrame, slop: int) -> DataFrame:
    """(doc, win): windows whose three rarest terms (all, of shorter ones) stand within ``slop`` words of their places."""
    close = found.select("doc", "win", F.col("start"), "off3", "term3").distinct()
    alone = close.filter("term3 is null").select("doc", "win")
    width = 2 * slop + 1
    cell = lambda c: F.floor(c / width)
    place = F.col("start") + F.col("off3")
    asked = close.filter("term3 is not null").withColumn("cell", F.explode(F.array_distinct(F.array(cell(place - slop), cell(place + slop)))))
    thirds = bounded_broadcast(ranked.filter("rank = 3").select(F.col("term").alias("term3")).distinct())
    other = index.select("doc", F.col("term").alias("term3"), F.col("pos").alias("pos3")).join(thirds, "term3", "left_semi").withColumn("cell", cell(F.col("pos3")))
    return alone.union(asked.join(other, ["doc", "term3", "cell"]).filter(F.abs(F.col("pos3") - F.col("start") - F.col("off3")) <= slop).select("doc", "win")).distinct()


@bounded_joins
def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """The index, and (doc, n_hit, items, n_near_items) of the documents with any match."""
    scratch = Scratch(spark)
    windows = scratch.table(benchmark_windows(benchmark, window))
    index = scratch.table(build_index(documents, windows.select("word").distinct()))
    ranked = scratch.table(ranked_terms(windows, index))
    postings = index.filter("term is not null").select("doc", "pos", "term")
    found = scratch.table(candidates(postings, _second(ranked), slop))
    exact = scratch.table(exact_matches(postings, ranked, found))
    near = proximity_matches(postings, ranked, found, slop)
    items = bounded_broadcast(windows.select("win", "item").distinct())
    words = exact.select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    named = exact.select("doc", "win").distinct().join(items, "win").select("doc", "item").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    nears = near.join(items, "win").select("doc", "item").distinct().groupBy("doc").agg(F.count("*").alias("n_near_items"))
    report = scratch.table(words.join(named, "doc", "full").join(nears, "doc", "full"))
    scratch.keep(index, report)
    return index, report


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_near_items counts the items with a proximity match, exact ones included.
    """
    index, report = matches(spark, documents, benchmark, window, slop)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<string>")
    return (
        index.filter("term is null").join(report.hint("merge"), "doc", "left")
        .select("doc_id", "n_words", zero("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), sha256_joined(F.coalesce("items", none)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near_items"))
    )


def drop_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows that hold an exact match."""
    _, report = matches(spark, documents, benchmark)
    hit = report.filter("n_hit > 0").select(F.col("doc").alias("_contaminated"))
    return documents.join(bounded_broadcast(hit), F.xxhash64(documents["doc_id"], documents["text"]) == F.col("_contaminated"), "left_anti")
