"""Packing along a space-filling curve.

A document's tokens make a hashed count vector; a fixed random projection takes it to a few dimensions and the Hilbert
index of that point is the document's key. Documents are range-sorted by key, so like documents are neighbours on the
curve, and laid end to end; the line is cut every `length` tokens. All sequences but the last are full.

The sort moves keys and lengths only. Each range partition sums its own lengths, the totals of the partitions (one number
each) are added up, and the resulting offsets are joined to the stored token ids by row.

Edge cases: a null or empty text is its end token alone; equal keys are ordered by id, then by row; repeated rows are
documents of their own; null ids are kept; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_bytes

LENGTH = 1024
DIMENSIONS = 4
BITS = 15
BUCKETS = 1 << 14
SEED = 20_011
END = 0
BLANK_RUN = 100_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids as `tokenizers` gives them for this file without special tokens added.

    Where the file is a plain byte-level BPE whose ids are the ranks of its merges, the ids are computed by tiktoken from
    the same merges, which takes a fifth of the time; any other file goes to `tokenizers` itself.
    """
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    whole: list[Tokenizer] = []

    def slow(text: str) -> list[int]:
        if not whole:  # most workers never need it
            whole.append(Tokenizer.from_file(path))
        return whole[0].encode(text, add_special_tokens=False).ids

    vocab, letters, special = model.get("vocab", {}), _byte_letters(), spec.get("added_tokens", [])
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = (
        model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("byte_fallback") and not model.get("ignore_merges")
        and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in special)
        and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(special) <= 1
    )
    if not plain:
        return slow
    import public_tokenizers
    import tiktoken

    marks = {t["content"]: t["id"] for t in special}
    ranks = {bytes(letters[c] for c in piece): k for piece, k in vocab.items() if piece not in marks}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
    mark, mark_id = next(iter(marks.items()), (None, None))
    blanks = re.compile(r"\s{%d}" % BLANK_RUN)

    def ids(text: str) -> list[int]:
        if len(text) > BLANK_RUN and blanks.search(text):
            return slow(text)  # the faster library's pattern overflows its stack on long runs of blanks
        if mark is None or mark not in text:
            return fast.encode_ordinary(text)
        parts = [fast.encode_ordinary(part) for part in text.split(mark)]
        return sum(([mark_id, *part] for part in parts[1:]), parts[0])

    return ids


@lru_cache(maxsize=1)
def projection(size: int) -> np.ndarray:
    """For each id the integer coordinates of its hash bucket."""
    buckets = np.random.Generator(np.random.PCG64(SEED)).normal(0, 64, (BUCKETS, DIMENSIONS)).round().astype(np.int32)
    hashed = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    return buckets[hashed.astype(np.int64)]


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, d) with d * bits <= 63, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flip = np.where(x[d - 1] & q, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> k) & 1)
    return key




def tokenized(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, curve key, n tokens with the end token, ids as little-endian 16- or 32-bit numbers; stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path or vocabulary_path())
        weights = projection(1 << 18)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys, sizes, blobs = [], [], []
                for text in text_bytes(part.column(2)):
                    ids = np.array([*ids_of(text.decode(errors="replace")), END], np.uint32)
                    keys.append(ids)
                    sizes.append(len(ids))
                    blobs.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"w" + ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(curve_keys(keys, weights)), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["rid", "doc_id", "curve", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(encode, "rid long, doc_id long, curve long, n long, ids binary"), "tokens")


def curve_keys(many: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """`curve_key` of each document, with the curve computed for all at once."""
    place = np.zeros((len(many), DIMENSIONS))
    for row, ids in enumerate(many):
        total = np.zeros(DIMENSIONS, np.int64)
        for a in range(0, len(ids), 1 << 18):
            total += weights.take(ids[a : a + (1 << 18)], 0, mode="wrap").sum(0, dtype=np.int64)
        place[row] = np.tanh(total / (16.0 * len(ids)))
    grid = np.minimum(((place + 1) * (1 << (BITS - 1))).astype(np.int64), (1 << BITS) - 1)
    return hilbert_index(grid, BITS)


def unpacked(blob: bytes) -> np.ndarray:
    """Ids of a stored blob; one of odd size holds 32-bit numbers after a letter."""
    return np.frombuffer(blob, "<u4", offset=1) if len(blob) % 2 else np.frombuffer(blob, "<u2")


def line_offsets(rows: DataFrame) -> DataFrame:
    """(rid, line_start): where each row begins when all are laid end to end in the order of (curve, doc_id, rid)."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            n = batch["n"].to_numpy()
            ends = np.cumsum(n) + so_far
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["part"], pa.array(ends - n), batch["n"]], ["rid", "part", "local", "n"])
            so_far = int(ends[-1]) if len(ends) else so_far

    keys = rows.select("rid", "doc_id", "curve", "n").repartitionByRange("curve", "doc_id", "rid").sortWithinPartitions("curve", "doc_id", "rid")
    local = stored(keys.select("rid", F.spark_partition_id().alias("part"), "n").mapInArrow(running, "rid long, part int, local long, n long"), "line")
    totals = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    base = rows.sparkSession.createDataFrame(starts, "part int, base long")
    return local.join(F.broadcast(base), "part").select("rid", (F.col("base") + F.col("local")).alias("line_start"))


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; with `keep_ids` also its token ids."""
    rows = tokenized(docs, path, id_col, text_col)
    placed = rows.join(line_offsets(rows), "rid").select("doc_id", "n", "ids", "line_start")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                at = part["line_start"].to_numpy()
                n = part["n"].to_numpy()
                first, last = at // length, (at + n - 1) // length
                many = last - first + 1
                row = np.repeat(np.arange(len(n)), many)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
                begin = np.maximum(seq * length, at[row])
                size = np.minimum((seq + 1) * length, at[row] + n[row]) - begin
                start = begin - at[row]
                ids = [unpacked(x.as_py()) for x in part["ids"]]
                pieces = [ids[r][s : s + k].astype("<u4") for r, s, k in zip(row, start, size)]
                crc = [zlib.crc32(p.tobytes()) for p in pieces]
                columns = [part["doc_id"].take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length)]
                if keep_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    schema = ", ".join(f"{x} long" for x in names) + ", ids array<int>" * keep_ids
    return placed.mapInArrow(cut, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
