"""Language identification by Bayesian fusion of evidence.

Four pieces of evidence are multiplied: the likelihood of the text (byte 4-grams, hashed, per language), the probability
of the declared markup language and of the address suffix given the language, and a host prior. The text model learns from
the share of each language's declared documents, chosen by hash, that makes `max_rows`, over their whole texts. Every
declared language with a text to learn from is a class; weights are kept for the grams it was seen with only. Posteriors and
tables have a number a class, so they grow with the number of languages. The other tables are grouped sums, over all rows,
of the text model's posteriors: declared x language, suffix x language, and language by host, smoothed towards its suffix,
which is smoothed towards all rows. From each sum a row's own posterior is taken off before the sum is used for that row,
so no text counts twice. Sums are combined before the shuffle, so one host with most rows costs no more than any other;
they are broadcast if they are small, by count, and joined by shuffle otherwise, never collected.

Edge cases: a null or empty text, or one without letters, has no likelihood and is undetermined (`und`) unless another
evidence is there, and is never kept by `kept`; null hosts, suffixes and declarations are evidence "none"; ties go to the
language first in alphabetical order; repeated rows each get a row; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, by_position, byte_blocks, cleaned, flat_text, named_back, stored, table

MAX_ROWS = 2_000
GRAM_BUCKETS = 1 << 16
SCALE = 1024
TEMPER = 0.1
STRENGTH = 20.0
MIN_POSTERIOR = 0.5
BLOCK = 1 << 20
ENTRIES = 1 << 19  # weights looked up at once
MERGE = 1 << 21  # grams held before equal ones are added up
LETTER = r"[A-Za-z\x{80}-\x{10ffff}]"  # as in LOWERED


def _lowered() -> np.ndarray:
    """Bytes with A-Z lower-cased and all other ASCII that is no letter as a blank."""
    to = np.arange(256, dtype=np.uint32)
    to[:128] = 32
    for c in range(97, 123):
        to[c] = to[c - 32] = c
    return to


LOWERED = _lowered()


def gram_buckets(flat: np.ndarray, at: int = 0, to: int | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash bucket of the 4 bytes from each place in [at, to) on; after the end of its text there are blanks.

    `ends` are the places where texts end; without any, `flat` is one text.
    """
    to = len(flat) if to is None else to
    n = to - at
    b = np.full(n + 3, 32, np.uint32)
    seen = LOWERED[flat[at : to + 3]]
    b[: len(seen)] = seen
    gram = b[:n].copy()
    stops = np.zeros(0, int) if ends is None else ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, to + 3, "left")] - at
    for j in (1, 2, 3):
        after = b[j : n + j].copy()
        for t in range(j):
            over = stops - 1 - t
            after[over[(over >= 0) & (over < n)]] = 32
        gram |= after << np.uint32(8 * j)
    return gram * np.uint32(0x9E3779B1) >> np.uint32(16)


def _letters(block: np.ndarray) -> np.ndarray:
    return LOWERED[block] != 32


class TextModel(NamedTuple):
    """Log probabilities times SCALE, in whole numbers: of grams a language wasn't seen with, and by how much the others are over that."""

    languages: tuple[str, ...]
    unseen: np.ndarray  # (languages,)
    start: np.ndarray  # (buckets + 1,): a bucket's first entry
    place: np.ndarray  # (entries,): the language
    over: np.ndarray  # (entries,)

    @staticmethod
    def of(languages: tuple[str, ...], gram: np.ndarray, count: np.ndarray) -> TextModel:
        """From the counts of grams, numbered language * GRAM_BUCKETS + bucket."""
        place, bucket = np.divmod(gram, GRAM_BUCKETS)
        # add-one within a language
        total = np.bincount(place, count, len(languages)) + GRAM_BUCKETS
        scaled = lambda x: np.round(SCALE * np.log(x)).astype(np.int32)
        unseen = scaled(1 / total)
        order = np.lexsort((place, bucket))
        start = np.r_[0, np.cumsum(np.bincount(bucket, minlength=GRAM_BUCKETS))]
        return TextModel(languages, unseen, start, place[order].astype(np.int32), (scaled((count + 1.0) / total[place]) - unseen[place])[order])

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) log likelihoods and (rows,) numbers of letter bytes."""
        flat, ends = flat_text(texts)
        n = len(self.languages)
        out = np.zeros((len(ends) - 1, n), np.int64)
        letters = np.zeros(len(ends) - 1, np.int64)
        for a, b in byte_blocks(flat, ends, BLOCK):
            for at in range(ends[a], ends[b], BLOCK):
                to = min(ends[b], at + BLOCK)
                seen = _letters(flat[at:to])
                row = np.repeat(np.arange(a, b), np.diff(np.clip(ends[a : b + 1], at, to)))[seen]
                if not len(row):
                    continue
                letters[a:b] += np.bincount(row - a, minlength=b - a)
                gram, count = np.unique(row * GRAM_BUCKETS + gram_buckets(flat, at, to, ends)[seen], return_counts=True)
                row, bucket = np.divmod(gram, GRAM_BUCKETS)
                many = self.start[bucket + 1] - self.start[bucket]
                upto = np.cumsum(many)
                cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(ENTRIES, upto[-1], ENTRIES)), len(row)])
                for i, j in zip(cuts[:-1], cuts[1:]):
                    m = many[i:j]
                    entry = np.repeat(self.start[bucket[i:j]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    low, high = row[i], row[j - 1] + 1
                    cell = np.repeat((row[i:j] - low) * n, m) + self.place[entry]
                    out[low:high] += np.bincount(cell, self.over[entry] * np.repeat(count[i:j], m), (high - low) * n).reshape(-1, n).astype(np.int64)
        return (out + letters[:, None] * self.unseen) / SCALE, letters


def trained(docs: DataFrame, text_col: str, declared_col: str, max_rows: int = MAX_ROWS) -> TextModel:
    """Gram weights for every declared language that has a text with letters."""
    rows = docs.select(F.lower(F.substring_index(F.trim(F.col(declared_col)), "-", 1)).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where((F.length("lang") > 0) & F.col("text").rlike(LETTER)).withColumn("h", F.xxhash64("text"))
    # copies are one text, so a language of few texts keeps them all
    texts = {r["lang"]: r["texts"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()}
    languages = tuple(sorted(texts))
    if not languages:
        return TextModel.of(("und",), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # of each language the share by hash that makes max_rows; no order, so no task that sees a whole language
    shares = docs.sparkSession.createDataFrame([(x, k, min(1.0, max_rows / max(1, texts[x]))) for k, x in enumerate(languages)], "lang string, place int, share double")
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 31)) < F.col("share") * (1 << 31))
    sample = sample.dropDuplicates(["place", "h"]).select("place", "text")

    def counted(batches):
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            flat, ends = flat_text(batch["text"])
            parts, size = [grams], len(grams)
            added = [counts]

            def merge():
                nonlocal parts, added, size
                distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
                parts, added, size = [distinct], [np.bincount(at, np.concatenate(added), len(distinct)).astype(np.int64)], len(distinct)

            for k, place in enumerate(batch["place"].to_pylist()):
                for at in range(ends[k], ends[k + 1], BLOCK):
                    to = min(ends[k + 1], at + BLOCK)
                    gram, count = np.unique(gram_buckets(flat, at, to, ends)[_letters(flat[at:to])], return_counts=True)
                    parts.append(place * GRAM_BUCKETS + gram.astype(np.int64)), added.append(count)
                    size += len(gram)
                    if size > len(parts[0]) + MERGE:
                        merge()
            merge()
            grams, counts = parts[0], added[0]
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "count"])

    tasks = max(4, -(-len(languages) * max_rows // 2_000))  # the sample grows with the languages
    got = sample.repartition(tasks).mapInArrow(counted, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).toArrow()
    return TextModel.of(languages, got["gram"].to_numpy(), got["count"].to_numpy())


def text_posterior(text: Column, model: TextModel) -> Column:
    """array<double>: posterior of each language from the text alone, tempered; empty where there are no letters."""
    n = len(model.languages)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        score, letters = model.likelihoods(texts)
        score = TEMPER * (score - score.max(1, initial=-np.inf, keepdims=True)) if n else score
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        have = letters > 0
        offsets = np.r_[0, np.cumsum(np.where(have, n, 0))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(p[have].ravel()))

    return of(text)


def _sums(rows: DataFrame, by: list[str], name: str = "all") -> DataFrame:
    """Summed posteriors by group, as the array `name`, and the number of texts, `name`_texts."""
    each = rows.where(F.size("p") > 0).select(*by, F.posexplode("p").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"), F.max("n").alias(f"{name}_texts"))
    return listed.select(*by, F.col("kv.v").alias(name), f"{name}_texts")


@cleaned
def identified(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str | Column = "source", suffix_col: str | Column | None = None, id_cols: list[str] | tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`id_cols`, language, posterior, text_language, text_posterior for each row of `docs`.

    Without a `suffix_col` the suffix is what follows the last dot of the host, if it has one.
    """
    model = trained(docs, text_col, declared_col)
    n = len(model.languages)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    none = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    host = none(as_column(host_col))
    suffix = F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("") if suffix_col is None else none(as_column(suffix_col))
    declared = F.lower(F.substring_index(F.trim(F.col(declared_col)), "-", 1))
    given = F.when(declared.isin(*model.languages), declared).otherwise(F.when(F.length(declared) > 0, "other").otherwise(""))
    rows = stored(docs.select(*[F.col(c).alias(f"id{k}") for k, c in enumerate(id_cols)], given.alias("declared"), host.alias("host"), suffix.alias("suffix"), text_posterior(F.col(text_col), model).alias("p")), "evidence")
    found = _sums(rows, []).first()
    everything = F.array(*[F.lit(float(x)) for x in (found["all"] if found and found["all"] else [0.0] * n)])
    sums = lambda by, of, name: bounded(stored(_sums(rows.where(of), by, name), name), n)
    fused = rows.join(sums(["declared"], F.lit(True), "said"), "declared", "left").join(sums(["suffix"], F.col("suffix") != "", "near"), "suffix", "left")
    fused = fused.join(sums(["host", "suffix"], F.col("host") != "", "here"), ["host", "suffix"], "left").withColumn("all", everything)

    informed = F.size("p") > 0
    none_left = F.array_repeat(F.lit(0.0), n)
    own = fused.withColumns({"own": F.when(informed, F.col("p")).otherwise(none_left), "ones": F.when(informed, 1).otherwise(0)})
    # every sum without the row's own share
    less = lambda c: F.zip_with(F.coalesce(c, none_left), F.col("own"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    texts_of = lambda c: F.coalesce(f"{c}_texts", F.lit(0)) - F.col("ones")
    left = own.select("*", less("all").alias("all_less"), less("said").alias("said_less"), less("near").alias("near_less"), less("here").alias("here_less"))
    smoothed = lambda c, prior: F.zip_with(f"{c}_less", prior, lambda x, p: (x + STRENGTH * p) / (F.greatest(texts_of(c), F.lit(0)) + STRENGTH))
    prior = F.transform("all_less", lambda x: (x + 1.0) / (F.lit(float(found["all_texts"] if found and found["all_texts"] else 0)) - F.col("ones") + n))
    start = left.withColumn("start", smoothed("here", smoothed("near", prior)))
    # P(declared | language), with one pseudo-row spread over all values a declaration can have
    said = F.zip_with("said_less", "all_less", lambda x, y: F.log((x + 1.0) / (y + (n + 2))))
    told = F.when(F.col("declared") != "", said).otherwise(none_left)
    texts = F.when(informed, F.col("p")).otherwise(F.array_repeat(F.lit(1.0), n))
    parts = start.select(
        *[f"id{k}" for k in range(len(id_cols))], informed.alias("informed"), (F.col("declared") != "").alias("declares"), (F.col("host") != "").alias("hosted"), texts.alias("p"),
        F.zip_with(F.zip_with("start", texts, lambda a, b: F.log(a) + F.log(F.greatest(b, F.lit(1e-300)))), told, lambda a, b: a + b).alias("log"),
    )
    top = F.array_max("log")
    norm = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    names = F.array(*map(F.lit, model.languages))
    pick = lambda c: names[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1]
    known = F.col("informed") | F.col("declares") | F.col("hosted")
    return parts.select(
        *[F.col(f"id{k}").alias(c) for k, c in enumerate(id_cols)],
        F.when(known, pick("log")).otherwise("und").alias("language"), F.when(known, 1 / norm).otherwise(0.0).alias("posterior"),
        F.when(F.col("informed"), pick("p")).otherwise("und").alias("text_language"), F.when(F.col("informed"), F.array_max("p")).otherwise(0.0).alias("text_posterior"),
    )


def kept(docs: DataFrame, least: float = MIN_POSTERIOR) -> DataFrame:
    """Rows of `docs` (doc_id, text, lang, source and any others) whose text has a language of at least posterior `least`."""
    told = ("doc_id", "text", "lang", "source")  # rows that agree on these get the same decision
    held = docs.select(*by_position(docs), F.xxhash64(*told).alias("a"), F.xxhash64(*told[::-1]).alias("b"))
    of = {c: f"c{docs.columns.index(c)}" for c in told}
    found = identified(held, of["text"], of["lang"], of["source"], id_cols=["a", "b"])
    rejected = stored(found.where((F.col("text_language") == "und") | (F.col("posterior") < least)).select("a", "b").distinct(), "rejected")
    return held.join(bounded(rejected), ["a", "b"], "left_anti").select(*named_back(docs.columns))  # the texts stay where they are if few are rejected


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw pages: markup language from the html tag, suffix and host from the address."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    rows = pages.select("page_id", plain.alias("text"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]+)", 1).alias("lang"), host.alias("source"), F.substring_index(host, ".", -1).alias("suffix"))
    return identified(rows, suffix_col="suffix", id_cols=["page_id"])
