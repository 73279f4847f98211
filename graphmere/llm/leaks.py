"""Evaluation texts inside training text, found with a stored positional inverted index.

The index holds a posting (word, doc, pos) for every word of the documents. Each task writes a segment of its own,
sorted by word, so that nothing is shuffled to make it; a reader of a few words skips the rest of each segment by its
statistics. A further evaluation set reads the index, and of the documents only the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmere.operators.joins import spread_join
from graphmere.session import scratch, sized, stage

RUN = 13
#: So many words at most are pushed down to the segments' statistics by name.
LOOKED_UP = 10
#: Up to so many rows a table is broadcast; beyond, the joins shuffle.
SMALL_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def write_index(documents: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings (word, doc, pos) of all documents to ``path`` and return them."""
    every = documents.select(F.col(ident).alias("doc"), F.posexplode(words(F.col(text))).alias("pos", "word")).select("word", "doc", "pos")
    every.sortWithinPartitions("word", "doc", "pos").write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(every.schema).parquet(path)


def of_words(index: DataFrame, table: DataFrame) -> DataFrame:
    """The postings of the words in ``table`` (word, ...) with its columns.

    ``table`` should be staged. A long table is shuffled, with frequent words spread.
    """
    some = [r["word"] for r in table.select("word").distinct().limit(LOOKED_UP + 1).collect()]
    if len(some) <= LOOKED_UP:
        index = index.filter(F.col("word").isin(some))
    small = sized(table, SMALL_ROWS)
    return index.join(small, "word") if small is not table else spread_join(index, table, "word", "inner")


def item_windows(terms: DataFrame, frequency: DataFrame, run: int = RUN) -> DataFrame:
    """(item, start, first, second): for each window of ``run`` words the places of its two rarest terms.

    An item with fewer words than ``run`` is one window. ``terms`` has (item, pos, word, length).
    """
    ranked = terms.join(frequency, "word", "left").select("item", "pos", "length", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("pos").alias("at")).alias("t"))
    span = Window.partitionBy("item").orderBy("pos").rowsBetween(Window.currentRow, run - 1)
    two = F.slice(F.sort_array(F.collect_list("t").over(span)), 1, 2)
    ranked = ranked.withColumn("two", two).filter((F.col("pos") + run <= F.col("length")) | ((F.col("pos") == 0) & (F.col("length") < run)))
    return ranked.select("item", F.col("pos").alias("start"), F.col("two")[0]["at"].alias("first"), F.try_element_at("two", F.lit(2))["at"].alias("second"))


def find_leaks(documents: DataFrame, items: DataFrame, index: DataFrame | None = None, run: int = RUN, slack: int = 0, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, words): documents that hold a passage of an item.

    kind 'phrase': ``run`` consecutive words of the item, or all of them if it has fewer, stand in the document;
    'proximity': at least the two rarest terms of one window stand there, and their distance differs from that in
    the item by at most ``slack`` words, with any words between. ``words`` is the longest run in common at one
    alignment. Items without words are never found; null and empty texts have no words; repeated rows of one id
    count once; an item of one word is found by it; further columns are ignored; empty tables give an empty result.

    The terms' frequencies are counted over all documents, in the ``index`` of :func:`write_index` (by default a new
    one). Of it the rarest two terms of every window are read; their lists, adjusted by the place in the item, are
    intersected by (item, document, offset).
    """
    if index is None:
        index = write_index(documents, scratch(documents.sparkSession, "postings"), doc_id, text)
    held = stage(items.filter(f"{text} is not null").groupBy(F.col(item_id).alias("item")).agg(F.min(text).alias("t")).select("item", words(F.col("t")).alias("w")).filter("size(w) > 0"))
    terms = held.select("item", F.size("w").alias("length"), F.posexplode("w").alias("pos", "word"))
    # Counted before anything is joined, so that a frequent word is one row.
    frequency = index.groupBy("word").agg(F.count("*").alias("df")).join(sized(stage(terms.select("word").distinct()), SMALL_ROWS), "word", "left_semi")
    windows = stage(item_windows(terms, stage(frequency), run))
    places = windows.select("item", F.explode(F.array_compact(F.array("first", "second"))).alias("at")).distinct()
    anchors = stage(terms.join(places, (terms["item"] == places["item"]) & (terms["pos"] == places["at"])).select(terms["item"], "word", "at"))
    found = of_words(index, anchors).select("doc", "item", (F.col("pos") - F.col("at")).alias("offset"), "at")
    per_item = sized(stage(windows.groupBy("item").agg(F.collect_set(F.struct("first", "second")).alias("windows"))), SMALL_ROWS // 20)
    candidates = stage(_aligned(found, per_item) if slack == 0 else _near(found, per_item, slack))
    wanted = sized(stage(candidates.select("doc").distinct()), SMALL_ROWS)
    texts = documents.join(wanted, documents[doc_id] == wanted["doc"], "left_semi").select(F.col(doc_id).alias("doc"), words(F.col(text)).alias("dw"))
    pairs = texts.join(sized(candidates, SMALL_ROWS), "doc").join(sized(held, SMALL_ROWS // 20), "item")
    checked = pairs.select("doc", "item", F.size("w").alias("n"), _longest_run().alias("words"))
    best = checked.groupBy("doc", "item").agg(F.max("words").alias("words"), F.first("n").alias("n"))
    kind = F.when(F.col("words") >= F.least(F.lit(run), F.col("n")), "phrase").otherwise("proximity")
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), kind.alias("kind"), "words")


def _aligned(found: DataFrame, per_item: DataFrame) -> DataFrame:
    """(doc, item, offset) where both terms of a window stand at one offset."""
    aligned = found.groupBy("doc", "item", "offset").agg(F.collect_set("at").alias("ats"))
    both = F.exists("windows", lambda w: F.array_contains("ats", w.first) & (w.second.isNull() | F.array_contains("ats", w.second)))
    return aligned.join(per_item, "item").filter(both).select("doc", "item", "offset")


def _near(found: DataFrame, per_item: DataFrame, slack: int) -> DataFrame:
    """(doc, item, offset) of first terms whose second term stands within ``slack`` of their offset.

    Offsets are cut into blocks; a hit near the end of one is also put into the next, so that no pair is lost.
    """
    size = 8 * slack
    block = F.floor(F.col("offset") / size)
    blocks = F.array_distinct(F.array(block, F.floor((F.col("offset") + slack) / size)))
    hits = found.select("doc", "item", F.explode(blocks).alias("block"), F.struct("at", "offset").alias("h"))
    grouped = hits.groupBy("doc", "item", "block").agg(F.collect_set("h").alias("hits")).join(per_item, "item")
    paired = lambda h, w: (h.at == w.first) & (w.second.isNull() | F.exists("hits", lambda o: (o.at == w.second) & (F.abs(o.offset - h.offset) <= slack)))
    firsts = F.filter("hits", lambda h: F.exists("windows", lambda w: paired(h, w)))
    return grouped.select("doc", "item", F.explode(firsts).alias("h")).select("doc", "item", "h.offset").distinct()


def _longest_run() -> Column:
    """Longest run of equal words of ``w`` and of ``dw`` moved by ``offset``."""
    same = F.transform("w", lambda x, i: F.try_element_at("dw", F.nullif(F.greatest(i + F.col("offset") + 1, F.lit(0)), F.lit(0))).eqNullSafe(x))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc: Column, hit: Column) -> Column:
        now = F.when(hit, acc.now + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc.best, now).alias("best"))

    return F.aggregate(same, zero, step, lambda acc: acc.best)
