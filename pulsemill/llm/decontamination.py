"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, text, position) for every occurrence of a benchmark term in the documents, over whole
texts, and a posting of its end for each document, whose position is the number of words; it is a stored table. A benchmark
item becomes its windows of `window` words. For each window the two rarest terms are looked up; their posting lists,
shifted by the terms' offsets, are intersected on (window, text, start). What is left is compared word for word with the
texts concerned, so matches are exact. `proximity_matches` takes the lists of the rarest few, intersects them with some slack
where the postings lie, and counts the window's words near their places there.

Sizes. The term list, windows and term counts grow with the benchmark alone; they are broadcast only if they have under
`BROADCAST_ROWS` rows, by count, and shuffled otherwise. Lists of hot terms are never gathered: the lookups are joins over
the postings where they lie, or, if the windows are too many for that, salted joins. Of the texts only those with
candidates move, if these are few by count; a text's candidates are at most what it holds itself. Texts are told apart by
two hashes of id and text; equal rows give equal candidates, which become one before anything is gathered.

Edge cases: null and empty texts have no words and no hits; items without words have no window; items under `window` words
are one window; equal windows of several items count for each; repeated rows get equal results; null ids are ids like any
other; other columns are never read, whatever their names, and `kept` returns them as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, bounded, by_position, cleaned, named_back, row_keys, stored, table, words_of

WINDOW = 10
SALTS = 32
WHOLE = " "  # stands for the end of a text; no word has a blank


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, phrase, size) for each distinct window, and (wid, item) for each item that has it, ids as strings; both stored."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w"))
    each = each.select("item", F.array_join("w", " ").alias("phrase"), F.size("w").alias("size"))
    owners = stored(each.select(F.xxhash64("phrase", "size").alias("wid"), "phrase", "size", "item").distinct(), "windows")
    return stored(owners.select("wid", "phrase", "size").distinct(), "phrases"), owners.select("wid", "item")


def window_terms(windows: DataFrame) -> DataFrame:
    """wid, size, place (from 0), term for each word of each window."""
    split = windows.select("wid", "size", F.posexplode(F.split("phrase", " ")).alias("place", "word"))
    return split.select("wid", "size", "place", F.xxhash64("word").alias("term"))


def postings(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored index, as (term, a, b, pos) for each occurrence of a window's term, and (doc_id, a, b, n_words) for each row."""
    spark = docs.sparkSession
    whole = F.xxhash64(F.lit(WHOLE))
    terms = window_terms(windows).select("term").union(spark.range(1).select(whole.alias("term"))).distinct()
    keyed = docs.select("doc_id", *row_keys(), F.concat(words_of(F.col("text")), F.array(F.lit(WHOLE))).alias("w"))  # once a text, not once a word
    split = keyed.select("doc_id", "a", "b", F.posexplode("w").alias("pos", "word"))
    rows = split.select(F.xxhash64("word").alias("term"), F.when(F.col("word") == WHOLE, F.col("doc_id")).alias("doc_id"), "a", "b", "pos")
    index = stored(rows.join(bounded(stored(terms, "terms")), "term", "left_semi"), "postings")
    ends = index.where(F.col("term") == whole).select("doc_id", "a", "b", F.col("pos").cast("long").alias("n_words"))
    return index.where(F.col("term") != whole).select("term", "a", "b", "pos"), ends


def ranked_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """wid, size, place, term, n, rank: each window's words by falling rarity; n, its occurrences in the documents, may be 0."""
    counts = bounded(stored(index.groupBy("term").agg(F.count("*").alias("n")), "counts"))  # a row a benchmark term
    terms = window_terms(windows).join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return terms.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("n", "place")))


def looked_up(index: DataFrame, lists: DataFrame, width: int = 1) -> DataFrame:
    """Postings (term, a, pos and others) with each row of their term in `lists`, which is stored; `width` as in `bounded`."""
    if lists.count() * width <= BROADCAST_ROWS:
        return index.join(F.broadcast(lists), "term")
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot term's postings go to SALTS tasks
    return index.withColumn("salt", F.pmod(F.xxhash64("a", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def shifted(index: DataFrame, lists: DataFrame, *more: str) -> DataFrame:
    """Starts (a, b, start) that the postings of each row of `lists` (wid, term, place) allow; `lists` is stored."""
    return looked_up(index, lists).select("wid", "a", "b", (F.col("pos") - F.col("place")).alias("start"), *more)


def candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, a, b, start): the intersection of the shifted lists of each window's two rarest terms."""
    ranked = ranked_terms(windows, index).withColumn("least", F.min("n").over(Window.partitionBy("wid")))
    rarest = stored(ranked.where("least > 0 AND rank <= 2").select("wid", "size", "term", "place", "rank"), "rarest")
    first = shifted(index, rarest.where("rank = 1"), "size").where("start >= 0")
    second = shifted(index, rarest.where("rank = 2")).where("start >= 0")
    both = first.where("size > 1").join(second, ["wid", "a", "b", "start"], "left_semi")
    return both.union(first.where("size = 1").select(both.columns)).select("wid", "a", "b", "start").distinct()


def texts_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of the stored `lists` (a, b and others) with the words w of their text."""
    rows = docs.select("text", *row_keys()).join(bounded(lists.select("a", "b")), ["a", "b"], "left_semi")
    texts = rows.dropDuplicates(["a", "b"]).select("a", "b", words_of(F.col("text")).alias("w"))
    return texts.join(lists, ["a", "b"])


def exact_hits(docs: DataFrame, index: DataFrame, windows: DataFrame) -> DataFrame:
    """a, b, hits (array of start, size, wid) for the texts that hold a window; stored."""
    near = candidates(index, windows).join(bounded(windows), "wid")
    lists = stored(near.groupBy("a", "b").agg(F.collect_list(F.struct("start", "size", "wid", "phrase")).alias("near")), "candidates")
    same = F.filter("near", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["size"]), " ") == c["phrase"])
    hits = F.transform(same, lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), c["wid"].alias("wid")))
    return stored(texts_of(docs, lists).select("a", "b", hits.alias("hits")).where(F.size("hits") > 0), "hits")


@cleaned
def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`."""
    docs = docs.select("doc_id", "text")
    windows, owners = item_windows(items, window)
    index, ends = postings(docs, windows)
    hits = exact_hits(docs, index, windows)
    spots = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1))))
    held = hits.select("a", "b", F.explode(F.array_distinct(F.col("hits.wid"))).alias("wid")).join(owners, "wid").select("a", "b", "item").distinct()
    names = held.groupBy("a", "b").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    found = hits.select("a", "b", F.size(spots).cast("long").alias("n_hit")).join(names, ["a", "b"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ends.join(found, ["a", "b"], "left").select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def kept(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of `docs` without any window of `items`, all columns."""
    windows, _ = item_windows(items)
    rows = docs.select("doc_id", "text")
    index, _ = postings(rows, windows)
    hits = exact_hits(rows, index, windows).select("a", "b")
    held = docs.select(*by_position(docs), *row_keys())
    return held.join(bounded(hits), ["a", "b"], "left_anti").select(*named_back(docs.columns))


def rare_lists(windows: DataFrame, ranked: DataFrame) -> DataFrame:
    """A row for each posting list to follow: wid, size, need, phrase, term, place, others (array of rank, place, word), last; stored.

    `ranked` has the need of each window. If m = size - need words may miss, two at least of the m + 2 rarest are near in any
    match, so one of the m + 1 rarest is; their lists are followed. `others` are the rest of the m + 2, `last` is the last.
    """
    rare = ranked.where("n > 0 AND rank <= size - need + 2").join(windows.select("wid", "phrase"), "wid")
    rare = rare.withColumn("word", F.get(F.split("phrase", " "), F.col("place")))
    each = F.array_sort(F.collect_list(F.struct("rank", "place", "word", "term"))).alias("rare")
    own = rare.groupBy("wid", "size", "need", "phrase").agg(each).select("*", F.explode("rare").alias("own")).where("own.rank <= size - need + 1")
    others = F.filter("rare", lambda o: o["rank"] != F.col("own.rank"))
    last = F.get(F.filter("rare", lambda o: o["rank"] == F.col("size") - F.col("need") + 2), F.lit(0))
    return stored(own.select("wid", "size", "need", "phrase", "own.term", "own.place", others.alias("others"), last.alias("last")), "rarest")


@cleaned
def proximity_matches(docs: DataFrame, items: DataFrame, slack: int = 2, least: float = 0.8, window: int = WINDOW) -> DataFrame:
    """doc_id, phrase, start, n_near: windows of which enough words lie near their places in a text, the best start of each.

    Of a window of s words ceil(least * s) must be near; words that no document has count as missing. A start is where a
    posting of one of the rarest words (`rare_lists`) puts the phrase, and a word is near if it occurs at most `slack` words
    from its place from there. Of several starts the one with most words near is given, then the first; it may be negative
    if the first words miss.

    Shifted lists are intersected, and the words counted, where the postings lie, over the words around each: what moves is
    a row a match, not one for each posting and window.
    """
    docs = docs.select("doc_id", "text")
    windows, _ = item_windows(items, window)
    index, ends = postings(docs, windows)
    need = lambda size: F.greatest(F.ceil(F.round(F.lit(float(least)) * size, 9)).cast("int"), F.lit(1))
    lists = rare_lists(windows, ranked_terms(windows, index).withColumn("need", need(F.col("size"))))
    reach = window - 1 + 2 * slack
    split = docs.select(*row_keys(), words_of(F.col("text")).alias("w")).select("a", "b", "w", F.posexplode("w").alias("pos", "word"))
    split = split.select("a", "b", "w", "pos", F.xxhash64("word").alias("term")).join(bounded(stored(lists.select("term").distinct(), "followed")), "term", "left_semi")
    base = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("w", base + 1, F.col("pos") + reach + 1 - base)
    at = looked_up(split.select("term", "a", "b", "pos", base.alias("base"), around.alias("around")), lists, 8)

    def there(place: Column, word: Column) -> Column:
        """Whether a word is near a place of the text."""
        low = F.greatest(place - slack - F.col("base"), F.lit(0))
        return F.array_contains(F.slice("around", low + 1, F.greatest(place + slack + 1 - F.col("base") - low, F.lit(0))), word)

    first = F.col("pos") - F.col("place")
    most = max(s - max(math.ceil(round(least * s, 9)), 1) + 2 for s in range(1, window + 1))
    other = [F.get("others", F.lit(k)) for k in range(min(most, window) - 1)]
    met = [F.coalesce(there(first + o["place"], o["word"]), F.lit(False)) for o in other]
    at = at.where(reduce(Column.__or__, met, F.col("need") == 1))
    last_at = F.filter(F.sequence(first - slack, first + slack), lambda s: F.get("around", s + F.col("last.place") - F.col("base")) == F.col("last.word"))
    starts = at.select("a", "b", "wid", "size", "need", "phrase", "base", "around", F.explode(F.array_union(F.array(first), last_at)).alias("start"))
    near = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: there(F.col("start") + i, F.get(F.split("phrase", " "), i)))
    each = starts.select("a", "b", "wid", "phrase", "start", "need", F.size(near).alias("n_near")).where("n_near >= need")
    best = each.groupBy("a", "b", "wid", "phrase").agg(F.min(F.struct((-F.col("n_near")).alias("fewer"), "start")).alias("c"))
    told = best.select("a", "b", "phrase", F.col("c.start").cast("long").alias("start"), (-F.col("c.fewer")).cast("long").alias("n_near"))
    return ends.join(told, ["a", "b"]).select("doc_id", "phrase", "start", "n_near")


ORACLE = r"""
WITH words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT size FROM windows)
  WHERE i + size - 1 <= len(w)),
hits AS (SELECT rid, i, g.size, item_id FROM grams g JOIN windows USING (phrase, size)),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN spots USING (rid) LEFT JOIN named USING (rid)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-passages of the benchmark: eight of ten words within two words of their places."""
    return proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
