"""SimHash near-duplicate detection with a Gray-order hierarchical index.

A document's 64-bit fingerprint has a bit set where over half of its 4-word shingle hashes (XXH64, seed 42) have it set.
Two fingerprints link at `distance` or fewer differing bits; documents of one connected component are near-duplicates.

Search. The 64 bits are cut into `distance + r` blocks; any linked pair agrees on at least r of them, so each
fingerprint is dealt to one group for every choice of r blocks and no link is lost. r follows the number of distinct
fingerprints, so a group keeps about a thousand of them at any corpus size. Inside a group fingerprints are sorted by
Gray rank and a tree is built over runs of neighbours: a node holds the bits that all below it share, less those that its
ancestors hold already. A search adds up the differing bits from the root downwards and leaves a whole group as soon as
the sum exceeds `distance`. A group of over `slice_rows` fingerprints is cut by its other bits in the same way, as a linked
pair agrees on one of `distance + 1` blocks of those too, and again if need be, after the classes that need no comparison
are taken off (see `_classes`); so the rows dealt grow with the fingerprints, not with their pairs. Only what agrees on
nearly all bits that way and is still too large is cut into slices, and each pair of slices is a group of its own. No task
gets an unbounded group. A group yields the edges of its own spanning forest, not its pairs, and the forests are joined by
alternating large-star and small-star steps over tables; the rows of a hub are joined by broadcast, where they lie.

Edge cases: null or empty texts and texts without words have fingerprint zero and link like any other; a null id never
names a component unless no other id is in it; repeated rows each get a result row; an empty table gives no rows;
columns other than the id and text are never read by `components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, by_position, cleaned, named_back, stored, table, text_bytes, with_least, workspace

DISTANCE = 4
SHINGLE = 4
FANOUT = 8
SLICE_ROWS = 8192
PIVOTS = 8
CUTS = 3  # how often a group is cut by further bits
FRONTIER = 2_000_000
BIT_ROWS = 65_536


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of one UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), BIT_ROWS):
        part = hashes[a : a + BIT_ROWS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_column(text: Column, size: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t, size) for t in text_bytes(texts)), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Trees over the fingerprints of many groups at once; `group` and then Gray rank give the order of the leaves."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), group))
        self.order, self.codes, self.group = order, codes[order], group[order]
        both, any_, owner = self.codes, self.codes, self.group
        levels = [(both, np.full(len(codes), ~np.uint64(0)), None)]
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(first) == len(owner):
                break
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(place % fanout == 0)
            both, any_, owner = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(any_, starts), owner[starts]
            levels.append((both, ~(both ^ any_), starts))
        self.levels = []  # from the leaves up: shared bits, their mask less the parent's, first child
        for k, (pattern, mask, starts) in enumerate(levels):
            if k + 1 < len(levels):
                up = levels[k + 1][2]
                above = np.repeat(levels[k + 1][1], np.diff(np.r_[up, len(pattern)]))
                own = mask & ~above
            else:
                own = mask
            self.levels.append((pattern, own, starts))
        self.last = [np.arange(len(codes))]  # last leaf below each node of a level
        for _, _, starts in self.levels[1:]:
            self.last.append(self.last[-1][np.r_[starts[1:], len(self.last[-1])] - 1])

    def search(self, a: int, b: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of leaf positions of one group at `most` or fewer differing bits, for i in [a, b)."""
        pattern, own, _ = self.levels[-1]
        query = np.arange(a, b)
        roots = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        node = np.searchsorted(roots, query, "right") - 1
        spent = np.bitwise_count((self.codes[query] ^ pattern[node]) & own[node]).astype(np.int16)
        for k in range(len(self.levels) - 1, 0, -1):
            starts = self.levels[k][2]
            pattern, own, _ = self.levels[k - 1]
            size = np.diff(np.r_[starts, len(pattern)])
            keep = spent <= most
            query, node, spent = query[keep], node[keep], spent[keep]
            many = size[node]
            at = np.repeat(np.cumsum(many) - many, many)
            child = np.repeat(starts[node], many) + np.arange(len(at)) - at
            query, spent = np.repeat(query, many), np.repeat(spent, many)
            keep = self.last[k - 1][child] > query
            query, child, spent = query[keep], child[keep], spent[keep]
            spent = spent + np.bitwise_count((self.codes[query] ^ pattern[child]) & own[child])
            node = child
        keep = (spent <= most) & (node > query)
        return query[keep], node[keep]


def forest(codes: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest code of its component in its group) for all codes that are not the smallest themselves."""
    index = GrayIndex(codes, group)
    n = len(codes)
    parent = np.arange(n)
    first = np.flatnonzero(np.r_[True, index.group[1:] != index.group[:-1]])
    size = np.repeat(np.diff(np.r_[first, n]), np.diff(np.r_[first, n]))
    cost = np.cumsum(size)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + FRONTIER, "right")))
        i, j = index.search(a, b, most)
        while len(i):
            i, j = parent[i], parent[j]
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            np.minimum.at(parent, j, i)
            while (parent[parent] != parent).any():
                parent = parent[parent]
        a = b
    # the smallest code of a component, as a signed number like in SQL, as its root: groups then agree on roots more often
    by = np.lexsort((index.codes.view(np.int64), parent))
    heads = np.flatnonzero(np.r_[True, parent[by][1:] != parent[by][:-1]]) if n else np.zeros(0, int)
    root = np.repeat(index.codes[by][heads], np.diff(np.r_[heads, n]))
    code = index.codes[by]
    apart = code != root
    return code[apart], root[apart]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _runs(bits: list[int], parts: int) -> list[int]:
    """The bit numbers as masks of `parts` runs."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << x for x in bits[i:j]) for i, j in zip(cuts, cuts[1:])]


def group_masks(distance: int, chosen: int) -> list[int]:
    """A mask for each choice of `chosen` out of distance + chosen bit blocks; linked codes are equal under one at least."""
    return [sum(picked) for picked in combinations(_runs(list(range(64)), distance + chosen), chosen)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """The mask with one of distance + 1 runs of the other bits; linked codes that are equal under it are so under one of these."""
    return [mask | run for run in _runs([k for k in range(64) if not mask >> k & 1], distance + 1)]


def chosen_blocks(distinct: int) -> int:
    """How many blocks a group agrees on: 12, 21, 27 or 32 bits, so groups stay near a thousand fingerprints."""
    return 1 if distinct < 1 << 22 else 2 if distinct < 1 << 31 else 3 if distinct < 1 << 37 else 4


def _classes(rows: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Rows (fp, mask, bits) of hot groups with their class, null for none, and sure edges (a, b) that join each class; stored.

    Such a group may be near copies of one text, so many of its pairs are settled without a comparison: fingerprints within
    half the distance of the group's majority bits all link to each other, and those within the distance of a pivot link
    to it. Each of these classes is joined by a star around its smallest member, so hubs are always on one side.
    """
    key = ["mask", "bits"]
    bit = lambda k: F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(bit(k)).alias(f"n{k}") for k in range(64)], *[F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    middle = F.lit(0).cast("long")
    for k in range(64):
        middle = middle.bitwiseOR(F.shiftleft(F.when(2 * F.col(f"n{k}") > F.col("n"), F.lit(1)).otherwise(F.lit(0)).cast("long"), k))
    facts = stored(sums.select(*key, middle.alias("middle"), F.array(*[f"p{k}" for k in range(PIVOTS)]).alias("pivots")), "hot-facts")
    apart = lambda x: F.bit_count(F.col("fp").bitwiseXOR(x))
    kind = F.when(apart(F.col("middle")) <= distance // 2, 1)
    for k in range(PIVOTS):
        kind = kind.when(apart(F.col("pivots")[k]) <= distance, k + 2)
    told = rows.join(bounded(facts), key).select("fp", *key, kind.alias("kind"), F.get("pivots", kind - 2).alias("pivot"))
    known = stored(told.select("fp", *key, F.when(F.col("kind").isNotNull(), F.xxhash64(*key, "kind")).alias("class"), "pivot"), "hot-rows")
    heads = stored(known.where("class IS NOT NULL").groupBy("class").agg(F.min("fp").alias("b"), F.first("pivot").alias("pivot")), "heads")  # PIVOTS + 1 a hot group at most
    stars = known.join(bounded(heads.select("class", "b")), "class").select(F.col("fp").alias("a"), "b")
    sure = stars.union(heads.where("pivot IS NOT NULL").select(F.col("pivot").alias("a"), "b")).where("a <> b")
    return known.select("fp", *key, "class"), sure


def _slices(known: DataFrame, slice_rows: int) -> DataFrame:
    """Rows (fp, part) in which every two fingerprints of a group meet that aren't of one class."""
    key = ["mask", "bits"]
    known = known.withColumn("class", F.coalesce("class", F.lit(0)))
    sizes = known.groupBy(*key, "class").agg(F.ceil(F.count("*") * 2 / slice_rows).cast("int").alias("slices"))
    sizes = sizes.groupBy(*key).agg(F.collect_list(F.struct("class", "slices")).alias("all"))  # a group's classes: a few, PIVOTS + 1 for each cut
    met = known.join(sizes, key)
    own = F.filter("all", lambda c: c["class"] == F.col("class"))[0]["slices"]
    mine = F.xxhash64("class", F.pmod(F.xxhash64("fp"), own))
    others = F.flatten(F.transform(F.filter("all", lambda c: (c["class"] != F.col("class")) | (c["class"] == 0)), lambda c: F.transform(F.sequence(F.lit(0), c["slices"] - 1), lambda s: F.xxhash64(c["class"], s.cast("long")))))
    each = met.select("fp", *key, mine.alias("mine"), F.explode(others).alias("other"))
    return each.select("fp", F.xxhash64(*key, F.least("mine", "other"), F.greatest("mine", "other")).alias("part"))


def dealt(nodes: DataFrame, distance: int = DISTANCE, slice_rows: int = SLICE_ROWS, cuts: int = CUTS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows (fp, part) in which linked fingerprints meet, and edges (a, b) already known; lists of tables."""
    spark = nodes.sparkSession
    masks = group_masks(distance, chosen_blocks(nodes.count()))
    rows = nodes.select("fp", F.lit(None).cast("long").alias("class"), F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    parts, sure = [], []
    for cut in range(cuts + 1):
        rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        if cut:
            rows = stored(rows, "finer")
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.count("class").alias("classed"))
        settled = (F.col("classed") == F.col("n")) & (F.col("low") == F.col("high"))  # one class: nothing to find
        odd = stored(sizes.where(settled | (F.col("n") > slice_rows)).select("mask", "bits", settled.alias("settled")) if cut else sizes.where(F.col("n") > slice_rows).select("mask", "bits", F.lit(False).alias("settled")), "hot-keys")
        parts.append(rows.join(bounded(odd), ["mask", "bits"], "left_anti").select("fp", F.xxhash64("mask", "bits").alias("part")))
        hot = odd.where("NOT settled").select("mask", "bits")
        if hot.isEmpty():
            break
        known, edges = _classes(rows.join(bounded(hot), ["mask", "bits"]).select("fp", "mask", "bits").distinct(), distance)
        sure.append(edges)
        if cut == cuts:
            parts.append(_slices(known, slice_rows))
            break
        finer = [(_signed(m), _signed(f)) for m in masks for f in finer_masks(m, distance)]
        masks = sorted({f for m in masks for f in finer_masks(m, distance)})
        table_of = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))  # distance + 1 rows for each mask: thousands at most
        rows = known.join(table_of, "mask").select("fp", "class", F.col("finer").alias("mask"))
    return parts, sure


def links(nodes: DataFrame, distance: int = DISTANCE, slice_rows: int = SLICE_ROWS, cuts: int = CUTS) -> DataFrame:
    """Spanning edges (a, b) between the distinct `fp` of `nodes`; their components are those of all links."""
    parts, sure = dealt(nodes, distance, slice_rows, cuts)

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(codes, group):
            a, b = forest(codes.view(np.uint64), group, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held_codes, held_group = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held_codes = np.r_[held_codes, batch["fp"].to_numpy()]
            held_group = np.r_[held_group, batch["part"].to_numpy()]
            cut = int(np.searchsorted(held_group, held_group[-1])) if len(held_group) else 0
            if cut >= 16_384:
                yield out(held_codes[:cut], held_group[:cut])
                held_codes, held_group = held_codes[cut:], held_group[cut:]
        if len(held_codes):
            yield out(held_codes, held_group)

    met = reduce(DataFrame.union, parts)
    found = met.repartition("part").sortWithinPartitions("part").mapInArrow(spanned, "a long, b long")
    return reduce(DataFrame.union, sure, found)


def joined_forests(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes but the smallest."""

    def star(e: DataFrame, n: int) -> DataFrame:
        """Edges (a, b) with m, the smallest b of their a."""
        return with_least(e, "a", e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), n)

    def large_star(e: DataFrame, n: int) -> DataFrame:
        both = e.union(e.select("b", "a"))
        return star(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))

    def small_star(e: DataFrame, n: int) -> DataFrame:
        out = star(e, n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        return out.select("x.a", "x.b").where("a != b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(now)
    while seen[0]:
        now = stored(small_star(large_star(now, seen[0]), seen[0]), "edges")
        last, seen = seen, state(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


@cleaned
def fingerprint_components(prints: DataFrame, distance: int = DISTANCE, slice_rows: int = SLICE_ROWS, cuts: int = CUTS) -> DataFrame:
    """(fp, label) for each distinct fingerprint of the stored table `prints`; label is the component's smallest fingerprint."""
    nodes = stored(prints.select("fp").distinct(), "nodes")
    labels = joined_forests(links(nodes, distance, slice_rows, cuts))
    return nodes.join(labels, nodes.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("label"))


@cleaned
def components(docs: DataFrame, distance: int = DISTANCE, slice_rows: int = SLICE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, `fp` as long, and `component_id`, the smallest id that links reach from it."""
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    labelled = fingerprint_components(prints, distance, slice_rows)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    named = stored(least.join(labelled, "fp"), "named")
    rows = prints.count()
    roots = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    by_print = with_least(named.select("fp", "label", F.col("n").alias("copies")), "label", roots, rows).select("fp", "component_id", F.col("copies").alias("n"))
    found = with_least(prints, "fp", stored(by_print, "components"), rows)
    return found.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one of the smallest id (nulls last), the first of equal ids.

    Only keys move: the rows that go are joined to the stored rows, by broadcast if they are few by count.
    """
    names = docs.columns
    held = stored(docs.select(*by_position(docs), fingerprint_column(F.col(text_col)).alias("fp"), F.monotonically_increasing_id().alias("rid")), "held")
    prints = held.select(F.col(f"c{names.index(id_col)}").alias("doc_id"), "fp", "rid")
    with workspace(docs.sparkSession):
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
        least = prints.groupBy("fp").agg(F.min(rank).alias("least"))
        chosen = least.join(fingerprint_components(prints, distance), "fp").groupBy("label").agg(F.min("least").alias("least")).select("least.rid")
        gone = stored(prints.select("rid").join(chosen, "rid", "left_anti"), "gone", outer=True)
    return held.join(bounded(gone), "rid", "left_anti").select(*named_back(names))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
