import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pulsemill.llm import simhash_dedup as sd
from pulsemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] * bool(words)
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows, most=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    seen, label = set(), {}
    nodes = sorted(set(prints))
    for p in nodes:
        if p in seen:
            continue
        todo, group = [p], {p}
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in group and bin(x ^ y).count("1") <= most:
                    group.add(y)
                    todo.append(y)
        seen |= group
        ids = [d for (d, _), q in zip(rows, prints) if q in group and d is not None]
        for y in group:
            label[y] = min(ids) if ids else None
    return sorted(((d, f"{p:016x}", label[p]) for (d, _), p in zip(rows, prints)), key=str)


def ours(df):
    return sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op4_simhash"](spark, SF).collect()), key=str)
    assert got == plain_components([tuple(r) for r in docs])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (None, "one two"), (None, "alone here"), (7, "É é"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "word " * 30000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, label string")
    assert ours(sd.components(docs)) == plain_components(rows)
    assert sd.components(docs.limit(0)).count() == 0
    kept = sd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 4, None, 7, 8, 9], key=str)
    assert sd.keep_one(docs.limit(0)).count() == 0


def test_chains_and_hot_groups_are_sliced(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)]
    hot = [int(base[0]) ^ i for i in range(200)]
    hot += [int(base[1]) ^ sum(1 << int(k) for k in rng.choice(40, rng.integers(0, 5), replace=False)) for _ in range(300)]  # one ball, and a fringe
    codes = sorted(set(near + hot))
    nodes = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    want = {}
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if bin(a ^ b).count("1") <= 4 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for c in codes:
        want.setdefault(root(c), set()).add(c)
    for slice_rows, cuts in ((16, 0), (16, 1), (16, 3), (100, 2), (8192, 3)):
        got = {}
        for r in sd.fingerprint_components(nodes, slice_rows=slice_rows, cuts=cuts).collect():
            got.setdefault(r.label, set()).add(r.fp & (1 << 64) - 1)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_rows_dealt_grow_with_a_hot_group(spark):
    """Fingerprints that agree on one block and on little else, and two tight groups far apart."""
    rng = np.random.default_rng(7)
    many = []
    for n in (4000, 8000, 16000):
        unlike = rng.integers(0, 1 << 51, n, dtype=np.int64) << 12
        flips = (1 << rng.integers(20, 60, (n, 2))).sum(1)
        two = np.where(np.arange(n) % 2, flips, flips ^ (0xFFFFFFF << 24))
        for codes in (unlike, two):
            nodes = sd.stored(spark.createDataFrame([(int(c),) for c in np.unique(codes)], "fp long"), "nodes")
            parts, _ = sd.dealt(nodes, slice_rows=512)
            many.append(sum(p.count() for p in parts) / nodes.count())
    assert max(many) < 30, many  # rows dealt for each fingerprint


def test_masks_keep_every_link():
    rng = np.random.default_rng(8)
    for chosen in (1, 2, 3):
        masks = sd.group_masks(4, chosen)
        finer = {m: sd.finer_masks(m, 4) for m in masks}
        for _ in range(300):
            apart = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
            same = [m for m in masks if not apart & m]
            assert same and all(any(not apart & f for f in finer[m]) for m in same)


def test_hubs_are_joined_by_broadcast(spark):
    star = [(k, 0) for k in range(1, 3000)] + [(k + 10_000, k) for k in range(1, 3000)] + [(50_000 + k, 90_000) for k in range(500)]
    got = {r.node: r.label for r in sd.joined_forests(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(1, 3000), *range(10_001, 13_000)]} | {k: 50_000 for k in [*range(50_001, 50_500), 90_000]}


def test_clashing_names(spark):
    clash = ["__key", "__h", "near_id", "near_h", "media_type", "fp", "rid", "c0", "least", "label", "n"]
    rows = [(d, t, *[f"{c}{d}" for c in clash]) for d, t in ((1, "a b c d e"), (2, "a b c d e"), (3, "quite other words in here"), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    kept = sd.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] != 2), key=str)
    assert ours(sd.components(docs)) == plain_components([r[:2] for r in rows])


def test_every_block_choice_keeps_all_links(spark, monkeypatch):
    rng = np.random.default_rng(5)
    codes = [int(x) for x in rng.integers(0, 1 << 63, 30, dtype=np.uint64)]
    pairs = [c ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False)) for c in codes]
    nodes = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes + pairs], "fp long")
    for chosen in (2, 3):
        monkeypatch.setattr(sd, "chosen_blocks", lambda n, k=chosen: k)
        assert sd.joined_forests(sd.links(nodes)).count() == 30


def test_gray_rank():
    n = np.arange(1024, dtype=np.uint64)
    assert (sd.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_long_text_counts_bits_in_parts(monkeypatch):
    text = " ".join(f"w{zlib.crc32(bytes([k % 251, k % 7]))}" for k in range(5000)).encode()
    want = sd.fingerprint(text)
    monkeypatch.setattr(sd, "BIT_ROWS", 64)
    assert sd.fingerprint(text) == want == plain_fingerprint(text.decode())


def test_fingerprint_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)
