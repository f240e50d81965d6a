"""Katz back-off language model over the corpus, and its score of every document.

Pn(w|c) = d(r) r / c(c.) for a gram cw seen r times in training, else a(c) Pn-1(w|c'), where c' is c without its first word;
after a context that training doesn't have (from order 3 on: fewer than `least_context` times) it is Pn-1(w|c'). P1(w) =
d(r) r / N for known words, and the mass that its discounts free for the unknown word. Counts up to K are discounted by
Good-Turing over smoothed counts of counts, and a(c) is what the discounts of c free over the Pn-1 mass of all words not
seen after c. That mass is added up from whole counts and freed shares, never as one less a sum, so each distribution sums
to one to the last digits, also where nearly all mass is seen. A context never reaches before the start of its document.

Layout. Documents are tokenized once into chunks: distinct word hashes, token places, training counts. Every order then
works by request and answer. A chunk sends its distinct grams with their training counts, a bucket adds the counts of all
chunks, keeps them as one row of a table that has a file a bucket, and answers each chunk in the order of its request; only
distinct grams of a chunk travel, so the commonest gram is one entry a chunk. A gram is known by the number of its context
(a gram of the order below) and of its last word. Order 1 answers word numbers and counts; every other order numbers and
counts of grams, and for contexts of unseen grams the sums behind their back-off weight. All that is whole numbers. The
chunk turns them into probabilities, token by token, and the recursion runs there, order by order. Grams are dealt by
context; a context with over `HOT_SHARE` of a bucket's tokens is dealt by gram instead, and its sums are added over
buckets (there are at most buckets / HOT_SHARE such contexts). Numbers of chunks and buckets follow the number of tokens, each bucket is a
task of its own, and chunks and answers are stored bucketed by chunk number, so an answer moves once and is joined where it
lies, however often it is read. A row a chunk and bucket travels, so with many of both, `chunk_tokens` and `bucket_entries`
should grow with the root of the number of tokens (64 million each at 100 TB). All tables but the scores are removed, those
of an order as soon as it is answered.

Edge cases: null and empty texts are one end token; documents with a null id are scored but neither learned from nor held
out; repeated rows each count and get a row; with nothing to learn from every token gets probability 1 for the only
(unknown) word; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Folders
from .common import cleaned, owned, scratch_path, stored, table, text_bytes, workspace

FOLDS, HELD_OUT = 7, 2
ORDER = 2
LEAST_CONTEXT = 1
K = 5  # counts over K aren't discounted
CHUNK_TOKENS = 1 << 19
CHUNK_BYTES = 3_300_000  # about CHUNK_TOKENS of text, for the number of files only
BUCKET_ENTRIES = 1 << 20
LEAST_BUCKETS = 12
HOT_SHARE = 0.25
SLICE_BYTES = 1 << 20
BLANKS = b" \t\n\v\f\r"
#: Not words, as they hold a blank.
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")


# ---- numbers as compact blobs


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, or floats, by byte plane, compressed."""
    if x.dtype.kind != "f":
        top = int(x.max()) if len(x) else 0
        x = x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.str[1:].encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread(blob: bytes) -> np.ndarray:
    """Back as 64-bit numbers."""
    kind = np.dtype(blob[:2].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2:]), np.uint8)
    found = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
    return found if kind.kind == "f" else found.astype(np.uint64)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def spread_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(spread(blob), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.uint64)
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def distinct_grams(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order, and the place of each given one among them."""
    if not len(word):
        return context, word, np.zeros(0, np.int64)
    bits, low = int(word.max()).bit_length(), context.min()
    if int(context.max() - low).bit_length() + bits <= 64 and bits < 64:
        found, place = np.unique((context - low) << np.uint64(bits) | word, return_inverse=True)
        return (found >> np.uint64(bits)) + low, found & np.uint64((1 << bits) - 1), place
    order = np.lexsort((word, context))  # both don't fit in one number
    c, w = context[order], word[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return c[new], w[new], place


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])


# ---- discounts


def slope(n: np.ndarray) -> float:
    """Of log n[r] over log r, r = 1..K + 1, by least squares; each r weighs n[r], as the variance of log n[r] is 1 / n[r]."""
    r = np.flatnonzero(n[1 : K + 2]) + 1
    if len(r) < 2:
        return 0.0
    x, y, w = np.log(r), np.log(n[r]), n[r] / n[r].sum()
    x = x - w @ x
    return float(w @ (x * y) / (w @ (x * x)))


def discounts(n: np.ndarray) -> np.ndarray:
    """d[0..K + 1] from counts of counts n[0..K + 1] (n[r]: grams seen r times); the last is 1 and stands for all over K.

    Good-Turing in Katz's form, over counts of counts smoothed to a power of r: copies raise single n[r], which as they are
    give discounts outside 0..1. A power under -1 gives discounts between 0 and 1 for every r. A level whose counts of counts
    don't fall that fast (most grams in copies, or under two different counts) has no Good-Turing estimate below its counts; it
    is discounted by n1 / (n1 + 2 n2), or a half.
    """
    d = np.ones(K + 2)
    n = n.astype(float)
    r = np.arange(1, K + 1)
    b = slope(n)
    if b < -1:
        tail = (K + 1.0) ** (b + 1)
        d[1 : K + 1] = (((r + 1) / r) ** (b + 1) - tail) / (1 - tail)
    else:
        d[1 : K + 1] = 1 - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5) / r
    return d


class Unigrams(NamedTuple):
    tokens: int
    distinct: int
    discount: np.ndarray
    total: int  # denominator
    unknown: float

    @staticmethod
    def of(tokens: int, distinct: int, n: np.ndarray) -> Unigrams:
        d = discounts(n)
        freed = float(((1 - d[: K + 1]) * np.arange(K + 1) * n[: K + 1]).sum())
        # nothing freed: one more event, the unknown word's
        return Unigrams(tokens, distinct, d, tokens, freed / tokens) if freed > 0 else Unigrams(tokens, distinct, d, tokens + 1, 1 / (tokens + 1))

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discount[np.minimum(count, K + 1).astype(np.int64)] * count / self.total, self.unknown)


def shares(d: np.ndarray) -> np.ndarray:
    """What one gram of each count 1..K frees, in tokens."""
    return (1 - d[1 : K + 1]) * np.arange(1, K + 1)


class Sums(NamedTuple):
    """Of each context, whole numbers: tokens after it, grams by count 1..K, and of the words seen after it the
    counts in the order below, added up, and their number by that count 1..K. Good-Turing discounts every count up to K, so
    a context without such grams frees nothing: it is bare."""

    total: np.ndarray
    small: np.ndarray  # (contexts, K)
    used: np.ndarray
    under: np.ndarray  # (contexts, K)

    @staticmethod
    def of(counts: np.ndarray, lower: np.ndarray, first: np.ndarray) -> Sums:
        """From the counts of grams, and those of their lower grams, in runs that begin at `first`."""
        counts, lower = counts.astype(np.int64), np.where(counts > 0, lower, 0).astype(np.int64)
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
        each = lambda x: np.stack([add((x == r).astype(np.int64)) for r in range(1, K + 1)], 1)
        return Sums(add(counts), each(counts), add(lower), each(lower))


def weights(sums: Sums, bare: np.ndarray, d: np.ndarray, lower_total: np.ndarray | int, lower_d: np.ndarray) -> np.ndarray:
    """Back-off weights of contexts.

    `lower_total` is the denominator of the order below. In a bare context nothing is freed, as all counts are over K;
    one more event stands for all unseen words then.
    """
    freed = np.where(bare, 1.0, sums.small @ shares(d))
    unseen = (lower_total - sums.used + sums.under @ shares(lower_d)) / lower_total
    with np.errstate(divide="ignore", invalid="ignore"):
        return freed / (sums.total + bare) / unseen


# ---- chunks of tokenized documents


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows under a schema of `name type, name type, ...`."""
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, and of the end."""
    out, at, n = [], 0, len(text)
    while at < n:
        to = min(n, at + SLICE_BYTES)
        while to < n and text[to] not in BLANKS:
            to += 1
        words = text[at:to].lower().split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = to
    out.append(np.array([END], np.uint64))
    return np.concatenate(out)


#: Two rows a chunk: tokens by place in the list of its words, and that list, which is needed for order 1 only.
CHUNK_SCHEMA = "kind int, chunk long, ids binary, flags binary, sizes binary, places binary, start long, words binary, counts binary, n_words long, n_tokens long, n_learned long, n_docs_learned long"
TOKENS, WORDS = 0, 1


def chunked(chunk_tokens: int) -> Callable:
    """Rows of doc_id, fold and text as chunks."""
    return lambda batches: _chunked(batches, chunk_tokens)


def _chunked(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    flags: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal number, size
        number += 1
        sizes = np.array([len(x) for x in held], np.uint32)
        learn = np.array(flags, np.uint8) & 1
        words, places = np.unique(np.concatenate([*held, np.array([START], np.uint64)]), return_inverse=True)
        places = places[:-1].astype(np.uint32)
        counts = np.bincount(places, np.repeat(learn, sizes), len(words)).astype(np.uint32)
        start = int(np.searchsorted(words, np.uint64(START)))
        tokens = (TOKENS, number, np.array(ids, np.int64).tobytes(), np.array(flags, np.uint8).tobytes(), squeeze(sizes), squeeze(places), start, None, None, len(words), len(places), int(counts.sum()), int(learn.sum()))
        listed = (WORDS, number, None, None, None, None, None, squeeze_sorted(words), squeeze(counts), None, None, None, None)
        ids.clear(), flags.clear(), held.clear()
        size = 0
        return _batch([tokens, listed], CHUNK_SCHEMA)

    for batch in batches:
        for doc, fold, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), text_bytes(batch[2])):
            ids.append(0 if doc is None else doc)
            flags.append(4 if doc is None else 2 if fold == HELD_OUT else 1)
            held.append(word_hashes(text))
            size += len(held[-1])
            if size >= chunk_tokens:
                yield row()
    if ids:
        yield row()


def stored_by_chunk(rows: DataFrame, buckets: int, outer: bool = False, kinds: bool = False) -> tuple[DataFrame, str]:
    """Written bucketed by chunk and read back, so that joins by chunk move nothing; and the folder. With `kinds` each kind has a folder in it."""
    spark = rows.sparkSession
    name, path = f"katz_{uuid.uuid4().hex}", scratch_path(spark, "katz")

    def remove() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        Folders(spark).remove(path)

    owned(spark, path, outer, remove)
    writer = rows.write.option("compression", "uncompressed").option("path", path).bucketBy(buckets, "chunk").sortBy("chunk")
    (writer.partitionBy("kind") if kinds else writer).saveAsTable(name)
    return spark.table(name), path


# ---- order 1


def range_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _spans(first: np.ndarray, size: int) -> list[tuple[int, int]]:
    return list(zip(first.tolist(), [*first[1:].tolist(), size]))


WORD_REQUEST = "bucket int, chunk long, words binary, counts binary"


def word_requests(buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(batch["chunk"].to_pylist(), batch["words"], batch["counts"]):
                words, counts = spread_sorted(words.as_py()), spread(counts.as_py())
                bucket = range_bucket(words, buckets)
                rows = [(int(bucket[a]), chunk, squeeze_sorted(words[a:b]), squeeze(counts[a:b])) for a, b in _spans(starts_of(bucket), len(words))]
                yield _batch(rows, WORD_REQUEST)

    return send


def by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    """All rows of a task, by bucket; each task has one bucket."""
    found: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault(row["bucket"], []).append(row)
    return found


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[: K + 2].tolist()


WORD_TABLE = "bucket int, chunk long, numbers binary, counts binary, n long, known long, often array<long>"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's row of the word table (chunk null), and an answer to each chunk."""
    for bucket, asked in by_bucket(batches).items():
        words = [spread_sorted(x["words"]) for x in asked]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([spread(x["counts"]) for x in asked]), len(distinct)).astype(np.uint64)
        rows = [(bucket, None, squeeze_sorted(distinct), squeeze(total), len(distinct), int((total > 0).sum()), _counts_of_counts(total))]
        ends = np.cumsum([0, *map(len, words)])
        for x, a, b in zip(asked, ends[:-1], ends[1:]):
            mine = place[a:b]
            rows.append((bucket, x["chunk"], squeeze_sorted(mine.astype(np.uint64)), squeeze(total[mine]), len(mine), None, None))
        yield _batch(rows, WORD_TABLE)


# ---- the orders above


class Plan(NamedTuple):
    """What all tasks know of the model; the lists have an entry for each order, from 1 on."""

    words: Unigrams
    docs: int  # learned from
    order: int
    least: int  # contexts of order 3 and up need so many tokens
    buckets: int  # of each order from 2 on
    hot: float  # contexts of more tokens are dealt by gram
    bases: tuple[np.ndarray, ...]  # number of the first gram of each bucket
    hot_sums: tuple[np.ndarray, ...]  # of each order, none for the first
    d: tuple[np.ndarray, ...]

    def least_of(self, n: int) -> int:
        """How often a gram of order n - 1 must occur to be a context of order n."""
        return 1 if n < 3 else self.least


class Grams(NamedTuple):
    """A chunk's distinct grams of one order by bucket, context and word, in runs of one context."""

    at: np.ndarray  # tokens that have one
    place: np.ndarray  # of each such token's gram
    context: np.ndarray
    word: np.ndarray
    bucket: np.ndarray
    first: np.ndarray  # where runs begin
    run: np.ndarray  # of each gram


class Chunk:
    """A chunk's tokens with all that is known of them up to some order."""

    def __init__(self, row: dict, plan: Plan):
        self.plan, self.number = plan, row["chunk"]
        sizes, places = spread(row["sizes"]).astype(np.int64), spread(row["places"]).astype(np.int64)
        answers = sorted(row["a1"], key=lambda x: x["bucket"])
        number = np.concatenate([spread_sorted(x["numbers"]) + plan.bases[0][x["bucket"]] for x in answers])
        counts = np.concatenate([spread(x["counts"]) for x in answers])
        self.doc_ids, self.flags = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["flags"], np.uint8)
        self.first = np.r_[0, np.cumsum(sizes)][:-1]
        self.learned = np.repeat(self.flags & 1, sizes)
        self.since = np.arange(len(places)) - np.repeat(self.first, sizes)  # words before it in its document
        self.word, self.count = number[places], counts[places]
        self.start = number[row["start"]]
        self.p = plan.words.probability(self.count)
        # of each token's gram in the highest order known so far: count, number, and of its context tokens after it, and if nothing is freed
        self.seen, self.id = self.count, self.word
        self.total = np.full(len(places), plan.words.tokens, np.uint64)
        self.bare = np.zeros(len(places), np.uint8)
        for n in range(2, plan.order + 1):
            if f"a{n}" in row:
                self._answer(n, row[f"a{n}"] or [])

    def grams(self, n: int) -> tuple[Grams, np.ndarray]:
        """Grams of order n, to be called when the order below is known; and the tokens after each token's context."""
        before = lambda x: np.r_[x[:1], x[:-1]]
        context, total = before(self.id), before(self.seen)
        if n == 2:
            context[self.first], total[self.first] = self.start, self.plan.docs
        else:
            total[self.since < n - 2] = 0
        at = np.flatnonzero(total >= self.plan.least_of(n))
        context, word, place = distinct_grams(context[at], self.word[at])
        follow = np.zeros(len(context), np.uint64)
        follow[place] = total[at]
        buckets = np.uint64(self.plan.buckets)
        bucket = mixed(np.where(follow > self.plan.hot, mixed(context) ^ word, context)) % buckets
        order = np.argsort(bucket.astype(np.uint16) if self.plan.buckets <= 1 << 16 else bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        context, word, bucket = context[order], word[order], bucket[order]
        first = starts_of(bucket, context)
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(context)]))
        return Grams(at, rank[place], context, word, bucket, first, run), total

    def request(self, n: int) -> pa.RecordBatch:
        g, total = self.grams(n)
        counts = np.bincount(g.place, self.learned[g.at], len(g.context)).astype(np.uint64)
        lower, of = np.zeros(len(g.context), np.uint64), np.zeros(len(g.context), np.uint64)
        lower[g.place], of[g.place] = self.seen[g.at], total[g.at]
        hot = (of[g.first] > self.plan.hot).astype(np.uint8)
        runs = np.diff(np.r_[g.first, len(g.context)])
        cuts = np.searchsorted(g.first, starts := starts_of(g.bucket))
        rows = []
        for (a, b), (i, j) in zip(_spans(starts, len(g.context)), _spans(cuts, len(g.first))):
            rows.append((int(g.bucket[a]), self.number, squeeze_sorted(g.context[g.first[i:j]]), squeeze(runs[i:j]), squeeze(g.word[a:b]), squeeze(counts[a:b]), squeeze(lower[a:b]), squeeze(hot[i:j])))
        return _batch(rows, GRAM_REQUEST)

    def _answer(self, n: int, answers: list[dict]) -> None:
        g, total = self.grams(n)
        plan, told = self.plan, sorted(answers, key=lambda x: x["bucket"])
        join = lambda key: np.concatenate([spread(x[key]) for x in told]) if told else np.zeros(0, np.uint64)
        counts, bare = join("counts"), join("bare").astype(bool)
        ids = np.zeros(len(counts), np.uint64)
        if n < plan.order and told:
            ids[counts >= plan.least_of(n + 1)] = np.concatenate([spread_sorted(x["ids"]) + plan.bases[n - 1][x["bucket"]] for x in told])
        # of each run: tokens after its context, and after the context of the order below
        after, below = np.zeros(len(g.first), np.int64), np.ones(len(g.first), np.int64)
        after[g.run[g.place]] = total[g.at]
        below[g.run[g.place]] = plan.words.total if n == 2 else self.total[g.at].astype(np.int64) + self.bare[g.at]
        need = np.logical_or.reduceat(counts == 0, g.first) if len(counts) else np.zeros(0, bool)
        table = lambda key: np.concatenate([spread(x[key]).reshape(K, -1) for x in told], axis=1).T.astype(np.int64) if told else np.zeros((0, K), np.int64)
        sums = Sums(after, np.zeros((len(after), K), np.int64), np.zeros(len(after), np.int64), np.zeros((len(after), K), np.int64))
        sums.used[need], sums.small[need], sums.under[need] = join("used"), table("small"), table("under")
        whole, of = plan.hot_sums[n - 1], g.context[g.first].astype(np.int64)
        if len(whole):  # of the hot contexts each bucket has but a part
            at = np.minimum(np.searchsorted(whole[:, 0], of), len(whole) - 1)
            runs, at = np.flatnonzero(whole[at, 0] == of), at[whole[at, 0] == of]
            sums.used[runs], sums.small[runs], sums.under[runs] = whole[at, 1], whole[at, 2 : 2 + K], whole[at, 2 + K :]
            bare[runs] = whole[at, 2 : 2 + K].sum(1) == 0
        d = plan.d[n - 1]
        weight = weights(sums, bare, d, below, plan.d[n - 2])
        seen, run = counts[g.place], g.run[g.place]
        known = d[np.minimum(seen, K + 1).astype(np.int64)] * seen / (total[g.at] + bare[run])
        self.p[g.at] = np.where(seen > 0, known, weight[run] * self.p[g.at])
        self.seen, self.id, self.bare = np.zeros_like(self.seen), np.zeros_like(self.id), np.zeros_like(self.bare)
        self.seen[g.at], self.id[g.at], self.bare[g.at], self.total = seen, ids[g.place], bare[run], total


GRAM_REQUEST = "bucket int, chunk long, contexts binary, runs binary, words binary, counts binary, lower binary, hot binary"
#: A bucket's grams (chunk null), with its part of the sums of hot contexts, and its answer to each chunk.
GRAM_TABLE = "bucket int, chunk long, contexts binary, runs binary, words binary, counts binary, lower binary, n long, often array<long>, ids binary, bare binary, used binary, small binary, under binary, parts array<array<long>>"


def gram_requests(n: int, plan: Plan) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield Chunk(batch.slice(k, 1).to_pylist()[0], plan).request(n)

    return send


def count_grams(n: int, plan: Plan) -> Callable:
    """A bucket's row of the gram table, and an answer to each chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, asked in by_bucket(batches).items():
            runs = [spread(x["runs"]).astype(np.int64) for x in asked]
            contexts = [spread_sorted(x["contexts"]) for x in asked]
            context, word, place = distinct_grams(np.concatenate([np.repeat(c, r) for c, r in zip(contexts, runs)]), np.concatenate([spread(x["words"]) for x in asked]))
            counts = np.bincount(place, np.concatenate([spread(x["counts"]) for x in asked]), len(word)).astype(np.uint64)
            lower = np.zeros(len(word), np.uint64)
            lower[place] = np.concatenate([spread(x["lower"]) for x in asked])
            first = starts_of(context)
            own = context[first]
            hot = np.zeros(len(first), bool)
            hot[np.searchsorted(own, np.concatenate(contexts))] = np.concatenate([spread(x["hot"]) for x in asked])
            run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(word)]))
            sums = Sums.of(counts, lower, first)
            bare = sums.small.sum(1) == 0
            parts = np.c_[own[hot].astype(np.int64), sums.used[hot], sums.small[hot], sums.under[hot]].tolist()
            none = (None,) * 5
            yield _batch([(bucket, None, squeeze_sorted(own), squeeze(np.diff(np.r_[first, len(word)])), squeeze(word), squeeze(counts), squeeze(lower), len(word), _counts_of_counts(counts), *none, parts)], GRAM_TABLE)
            ends = np.cumsum([0, *(int(r.sum()) for r in runs)])
            for x, a, b in zip(asked, ends[:-1], ends[1:]):
                places = place[a:b]
                mine, of = counts[places], run[places]
                begin = starts_of(of)
                mine_of = of[begin]
                need = mine_of[np.logical_or.reduceat(mine == 0, begin)]
                ids = places[mine >= plan.least_of(n + 1)].astype(np.uint64) if n < plan.order else np.zeros(0, np.uint64)
                told = (squeeze_sorted(ids), squeeze(bare[mine_of].astype(np.uint8)), squeeze(sums.used[need]), squeeze(sums.small[need].T.ravel()), squeeze(sums.under[need].T.ravel()))
                yield _batch([(bucket, x["chunk"], *none[:3], squeeze(mine), *none[:3], *told, None)], GRAM_TABLE)

    return count


# ---- scores

SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def document_scores(plan: Plan) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = Chunk(batch.slice(k, 1).to_pylist()[0], plan)
                base = np.log10((c.count + 1.0) / (plan.words.tokens + plan.words.distinct + 1.0))
                add = lambda x, c=c: np.add.reduceat(x, c.first)
                sizes = np.diff(np.r_[c.first, len(c.word)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.doc_ids, mask=c.flags == 4), pa.array(c.flags == 2), pa.array(sizes), pa.array(add((c.count > 0).astype(np.int64))), pa.array(np.full(len(sizes), plan.words.tokens)), pa.array(add(base)), pa.array(add(np.log10(c.p)))],
                    [x.split()[0] for x in SCORE_SCHEMA.split(", ")],
                )

    return score


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


HOT_SUMS = ["used", *(f"n{r}" for r in range(1, K + 1)), *(f"m{r}" for r in range(1, K + 1))]


def hot_sums(level: DataFrame) -> np.ndarray:
    """Rows of context and HOT_SUMS, by context: the whole sums of the hot contexts, of which each bucket has a part."""
    p = F.col("p")
    parts = level.where("chunk IS NULL").select(F.explode("parts").alias("p")).groupBy(p[0].alias("context"))
    rows = parts.agg(*[F.sum(p[k]).alias(c) for k, c in enumerate(HOT_SUMS, 1)]).collect()  # at most buckets / HOT_SHARE
    return np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, len(HOT_SUMS) + 1)


def base_numbers(rows: list, buckets: int) -> np.ndarray:
    """The number of the first gram of each bucket, from rows of bucket and n."""
    base = np.zeros(buckets + 1, np.uint64)
    for r in rows:
        base[r["bucket"] + 1] = r["n"]
    return np.cumsum(base, dtype=np.uint64)


@cleaned
def katz_scores(docs: DataFrame, order: int = ORDER, least_context: int = LEAST_CONTEXT, chunk_tokens: int = CHUNK_TOKENS, bucket_entries: int = BUCKET_ENTRIES, hot_share: float = HOT_SHARE) -> DataFrame:
    """A score for each row of `docs` (doc_id, text) under the model of those outside the held-out fold."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunk_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_BUCKETS, size * CHUNK_TOKENS // (CHUNK_BYTES * chunk_tokens))
    both, folder = stored_by_chunk(rows.mapInArrow(chunked(chunk_tokens), CHUNK_SCHEMA), chunk_buckets, kinds=True)
    chunks = both.where(F.col("kind") == TOKENS)
    size = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_learned", "n_docs_learned")]).first()

    buckets = max(LEAST_BUCKETS, -(-size["n_words"] // bucket_entries))
    asked = both.where(F.col("kind") == WORDS).select("chunk", "words", "counts").mapInArrow(word_requests(buckets), WORD_REQUEST)
    with workspace(spark):
        words = stored(asked.repartitionById(buckets, "bucket").mapInArrow(count_words, WORD_TABLE), "words")
        ones = words.where("chunk IS NULL").select("bucket", "n", "known", "often").collect()  # one row a bucket
        answers = words.where("chunk IS NOT NULL").select("chunk", "bucket", "numbers", "counts")
        answers, _ = stored_by_chunk(answers.repartition(chunk_buckets, "chunk"), chunk_buckets, outer=True)
    Folders(spark).remove(f"{folder}/kind={WORDS}")
    often = np.sum([r["often"] for r in ones], axis=0) if ones else np.zeros(K + 2, int)
    unigrams = Unigrams.of(size["n_learned"], sum(r["known"] for r in ones), often)
    above = max(LEAST_BUCKETS, -(-size["n_tokens"] // bucket_entries))
    plan = Plan(unigrams, size["n_docs_learned"], order, least_context, above, max(1000.0, hot_share * size["n_learned"] / above), (base_numbers(ones, buckets),), (np.zeros((0, len(HOT_SUMS) + 1), np.int64),), (unigrams.discount,))

    def listed(answers: DataFrame, n: int) -> DataFrame:
        columns = [c for c in answers.columns if c != "chunk"]
        return answers.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(f"a{n}"))

    answered = chunks.select("chunk", "ids", "flags", "sizes", "places", "start").join(listed(answers, 1), "chunk")
    for n in range(2, order + 1):
        with workspace(spark):
            asked = answered.mapInArrow(gram_requests(n, plan), GRAM_REQUEST)
            level = stored(asked.repartitionById(above, "bucket").mapInArrow(count_grams(n, plan), GRAM_TABLE), f"grams-{n}")
            del asked
            spark._jvm.System.gc()  # Spark removes the shuffle once nothing refers to it
            ones = level.where("chunk IS NULL").select("bucket", "n", "often").collect()  # one row a bucket
            d = discounts(np.sum([r["often"] for r in ones], axis=0) if ones else np.zeros(K + 2, int))
            plan = plan._replace(bases=(*plan.bases, base_numbers(ones, above)), hot_sums=(*plan.hot_sums, hot_sums(level)), d=(*plan.d, d))
            answers = level.where("chunk IS NOT NULL").select("chunk", "bucket", "counts", "ids", "bare", "used", "small", "under")
            answers, _ = stored_by_chunk(answers.repartition(chunk_buckets, "chunk"), chunk_buckets, outer=True)
        answered = answered.join(listed(answers, n), "chunk", "left")
    return answered.mapInArrow(document_scores(plan), SCORE_SCHEMA)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
