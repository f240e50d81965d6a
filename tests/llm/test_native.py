import collections
import datetime as dt
import hashlib
import math
import random
import re
import time

import duckdb
import pytest

from pulsemill.llm import common
from pulsemill.llm import decontamination as dc
from pulsemill.llm import license_scan as ls
from pulsemill.llm import url_filter as uf
from pulsemill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    rows = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).values.tolist()))
    assert cols == sorted(b.columns) and rows(a) == rows(b) and len(a)


def test_no_python_on_the_main_path(spark, monkeypatch):
    """In the plan of any table that the native queries write."""
    plans = []

    def noted(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, *args, **kwargs)

    stored = common.stored
    for module in (common, dc, ls, uf):
        monkeypatch.setattr(module, "stored", noted)
    for name in ("op5_url_filter", "op6_decontamination", "op8_license_scan", "benchmark_proximity"):
        plans.clear()
        QUERIES[name](spark, SF)
        assert len(plans) > 2 and not any(re.search("Python|Pandas|MapInArrow", p) for p in plans), name


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                if tuple(w[k : k + size]) in windows and k + size <= len(w):
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


LONG = "a b c d e f g h i j k l"
ITEMS = [(1, LONG), (10, LONG), (2, "short Item"), (3, None), (4, ""), (5, "x x x x x x x x x x x"), (6, "ÜBER straße 9"), (2, "other one of the same id"), (7, "Single")]
DOCS = [(1, None), (2, ""), (3, "!!! ..."), (4, f"start {LONG} and a b c d e f g h i j again SHORT-item"), (5, "x " * 40), (None, "c d e f g h i j k l"), (6, "Über ÜBER straße 9 single"), (6, "Über ÜBER straße 9 single"), (7, "a b c d e f g h i j"[2:]), (8, "short of item"), (9, ("w " * 5000) + "short item")]


def test_contamination(spark):
    docs = spark.createDataFrame([(*r, "p", 1) for r in DOCS], "doc_id long, text string, h string, pos int")
    items = spark.createDataFrame([(*r, "q") for r in ITEMS], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in dc.contamination(docs, items).collect()), key=str)
    assert got == plain_contamination(DOCS, ITEMS)
    kept = dc.kept(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 8]
    assert dc.contamination(docs.limit(0), items).count() == 0 and dc.kept(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in dc.contamination(docs, items.limit(0)).collect())


def test_clashing_names_and_repeated_rows(spark):
    clash = ["__h", "near_id", "near_h", "a", "b", "c0", "fp", "rid", "near", "hits", "wid"]
    rows = [(d, t, *[f"{c}{d}" for c in clash]) for d, t in DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dc.kept(docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] in (1, 2, 3, 7, 8)]
    many = spark.createDataFrame([(5, LONG + " " + LONG)] * 20_000 + [(6, "short item")], "doc_id long, text string").repartition(4)
    got = dc.contamination(many, items).groupBy("doc_id", "n_hit", "n_items").count().collect()
    assert sorted(map(tuple, got)) == [(5, 24, 2, 20_000), (6, 2, 1, 1)]


def plain_proximity(docs, items, slack, least):
    windows = sorted({tuple(w[k : k + 10]) for w in (words(t) for _, t in items) if w for k in range(max(1, len(w) - 9))})
    n = collections.Counter(x for _, t in docs for x in words(t))
    out = []
    for d, t in docs:
        w = words(t)
        for phrase in windows:
            need = max(1, math.ceil(round(least * len(phrase), 9)))
            rare = sorted(range(len(phrase)), key=lambda k: (n[phrase[k]], k))[: len(phrase) - need + 2]
            found = []
            for start in {p - k for k in rare for p, x in enumerate(w) if x == phrase[k]}:
                there = sum(x in w[max(0, start + k - slack) : max(0, start + k + slack + 1)] for k, x in enumerate(phrase))
                if there >= need:
                    found.append((-there, start))
            if found:
                out.append((d, " ".join(phrase), min(found)[1], -min(found)[0]))
    return sorted(out, key=str)


def test_proximity(spark):
    docs = [(1, "zebra then came a quagga"), (2, "zebra came the quagga"), (3, "quagga and zebra"), (4, "zebra " + "of " * 30 + "quagga"), (None, "a b c d x f g h i j"), (5, "b a c d e f g h i j k"), (5, "b a c d e f g h i j k"), (6, "y y d e f g h i j k l"), (7, None), (8, "came"), (9, "b c d e f g zz h i j k l" * 3)]
    items = [(1, "zebra came quagga"), (2, LONG), (3, "came"), (4, ""), (5, "never seen words")]
    rows = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, start string")
    given = spark.createDataFrame(items, "item_id long, text string")
    for slack, least in ((0, 1.0), (1, 1.0), (2, 0.8), (3, 0.5)):
        got = sorted((tuple(r) for r in dc.proximity_matches(rows, given, slack, least).collect()), key=str)
        assert got == plain_proximity(docs, items, slack, least), (slack, least)
    assert dc.proximity_matches(rows.limit(0), given).count() == 0 and dc.proximity_matches(rows, given.limit(0)).count() == 0


def test_proximity_moves_only_what_meets(spark, monkeypatch):
    """Words of a window that occur often, but never near one another, leave no rows on the way; no list is too long."""
    made = {}

    def noted(df, name, *args, **kwargs):
        made[name] = (out := stored(df, name, *args, **kwargs)).count()
        return out

    stored = common.stored
    for module in (common, dc):
        monkeypatch.setattr(module, "stored", noted)
    lone = [(k, " ".join(f"{x} " + "of " * 30 for x in LONG.split() * 50)) for k in range(4)]
    draw = random.Random(7)
    some = [(9 + k, " ".join(draw.choice("abcdefghijklmn") if draw.random() < 0.3 else x for x in LONG.split() * 3)) for k in range(20)]
    items = [(1, LONG), (2, "n m a b")]
    rows = spark.createDataFrame(lone + some, "doc_id long, text string")
    given = spark.createDataFrame(items, "item_id long, text string")
    assert dc.proximity_matches(rows.where("doc_id < 9"), given.where("item_id = 1")).count() == 0
    assert made.pop("postings") > 2400 and sum(made.values()) < 200
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)  # lists by shuffle
    got = sorted((tuple(r) for r in dc.proximity_matches(rows, given).collect()), key=str)
    assert got == plain_proximity(lone + some, items, 2, 0.8) and len(got) > 20


def test_proximity_query(spark):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    got = sorted((tuple(r) for r in QUERIES["benchmark_proximity"](spark, SF).collect()), key=str)
    some = {d for d, *_ in got}
    few = [r for r in docs if r[0] in some][:5]
    assert got and {r[0] for r in got} >= {d for d, _, hit, *_ in plain_contamination(docs, items) if hit}
    held = {(d, p): (s, k) for d, p, s, k in got}
    for d, t in few:
        w = words(t)
        for (e, phrase), (start, near) in held.items():
            if e == d:
                assert near == sum(x in w[max(0, start + k - 2) : max(0, start + k + 3)] for k, x in enumerate(phrase.split(" "))) >= 0.8 * len(phrase.split(" "))


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


ENTRIES = [("ads", "host", "bad.com", "add", day(10)), ("ads", "host", "bad.com", "remove", day(20)), ("ads", "host", "bad.com", "add", day(30)), ("spam", "host", "com", "add", day(40)), ("ads", "path", "ok.org/x/y", "add", day(0)), ("ads", "host", "tie.net", "remove", day(5)), ("ads", "host", "tie.net", "add", day(5)), ("ads", "host", None, "add", day(0)), ("ads", "host", "null.net", "add", None), ("ads", "host", "bad.com", "add", day(10))]


def plain_rules(url, at):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", url or "")
    if not m or at is None:
        return []
    host, parts = m[1].lower().rstrip("."), [x for x in (m[2] or "").split("/") if x]
    keys = {("host", ".".join(host.split(".")[k:])) for k in range(len(host.split(".")))} | {("path", host + "/" + "/".join(parts[:k])) for k in range(1, len(parts) + 1)}
    out = set()
    for name, kind, key in {e[:3] for e in ENTRIES}:
        log = sorted((e[4], e[3] == "remove") for e in ENTRIES if e[:3] == (name, kind, key) and e[4] and e[4] <= at)
        if (kind, key) in keys and log and not log[-1][1]:
            out.add(f"{name}:{kind}:{key}")
    return sorted(out)


def test_url_filter(spark):
    captures = [(k, u, day(d)) for u in ("http://bad.com/", "https://u@sub.BAD.com:80/p?q#r", "http://notbad.com", "http://ok.org/x/y/z", "http://ok.org/x//y", "http://ok.org/xx/y", "http://tie.net.", "http://null.net/a", "nonsense", "") for k, d in enumerate((0, 10, 19, 20, 29, 30, 40))]
    captures += [(None, None, day(50)), (1, "http://bad.com/", None), (0, "http://bad.com/", day(10)), (0, "http://bad.com/", day(10))]
    rows = spark.createDataFrame([(*c, "k") for c in captures], "capture_id long, url string, day date, key string")
    entries = spark.createDataFrame([(*e, "u") for e in ENTRIES], "list string, kind string, key string, action string, day date, url string")
    got = sorted((tuple(r) for r in uf.filtered(rows, entries).collect()), key=str)
    want = sorted(((i, u, bool(r), len(r), " ".join(r)) for i, u, d in captures for r in [plain_rules(u, d)]), key=str)
    assert got == want
    assert uf.filtered(rows.limit(0), entries).count() == 0
    assert not any(r.blocked for r in uf.filtered(rows, entries.limit(0)).collect())


def test_licenses(spark):
    mit = dict(ls.TEMPLATES)["MIT-grant"]
    w = mit.split()
    rows = [(1, None), (2, ""), (3, "Released under the MIT license"), (4, "intro words " * 100 + mit + " end"), (5, " ".join(w[: int(len(w) * 0.9)])), (6, " ".join(w[: len(w) // 2])), (7, "released UNDER, the mit-license! " * 3), (7, "released UNDER, the mit-license! " * 3), (None, "Licensed under CC BY-NC 4.0."), (8, "no licence text in here at all")]
    docs = spark.createDataFrame([(*r, "m", 1.0) for r in rows], "doc_id long, text string, license string, s double")
    got = sorted(((r.doc_id, r.license, round(r.containment, 3), r.first_word) for r in ls.scanned(docs, ls.template_table(spark)).collect()), key=str)
    assert (3, "MIT", 1.0, 0) in got and (4, "MIT-grant", 1.0, 200) in got and (None, "CC-BY-NC-4.0", 1.0, 0) in got
    assert got.count((7, "MIT", 1.0, 0)) == 2
    assert {(d, n) for d, n, _, _ in got} == {(3, "MIT"), (4, "MIT-grant"), (5, "MIT-grant"), (7, "MIT"), (None, "CC-BY-NC-4.0")}
    assert ls.scanned(docs.limit(0), ls.template_table(spark)).count() == 0
    assert ls.scanned(docs, ls.template_table(spark).limit(0)).count() == 0


def test_band_settings():
    assert (1 - 0.4 / 3.1) ** ls.BANDS < 3e-10


def test_licenses_are_found_at_every_offset(spark):
    """A notice with 20 words put into it, and a whole license text with words left out, wherever they stand."""
    isc = dict(ls.TEMPLATES)["ISC-grant"].split()
    rows = [(k, " ".join(f"x{i}" for i in range(k)) + " " + " ".join(isc[:15] + ["or", "not"] * 10 + isc[15:]) + " end") for k in range(64)]
    whole = dict(ls.templates())["LGPL-3-whole"].split()
    rows += [(100 + k, "start " * k + " ".join(w for i, w in enumerate(whole) if i % 120)) for k in (0, 700)]
    rows += [(200, " ".join(isc[:15] + [f"y{i}" for i in range(200)] + isc[15:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in ls.scanned(docs, ls.template_table(spark)).collect()}
    for k in range(64):
        assert got[k, "ISC-grant"].first_word == k and 0.8 <= got[k, "ISC-grant"].containment < 0.9
    assert got[100, "LGPL-3-whole"].containment > 0.9 and got[800, "LGPL-3-whole"].first_word >= 700
    assert (200, "ISC-grant") not in got


def test_long_urls(spark):
    rows = [(1, "http://bad.com/" + "a/" * 500_000, day(12)), (2, "http://" + "a." * 300_000 + "bad.com/x", day(12)), (3, "http://ok.org/x/y/" + "b" * 1_000_000, day(12))]
    captures = spark.createDataFrame(rows, "capture_id long, url string, day date")
    entries = spark.createDataFrame(ENTRIES, "list string, kind string, key string, action string, day date")
    uf.filtered(captures.limit(0), entries).collect()
    start = time.perf_counter()
    got = sorted((r.capture_id, r.rules) for r in uf.filtered(captures, entries).collect())
    assert got == [(1, "ads:host:bad.com"), (2, "ads:host:bad.com"), (3, "ads:path:ok.org/x/y")] and time.perf_counter() - start < 10


def test_filter_with_a_salted_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(map(tuple, uf.filtered_pages(pages).collect()))
    monkeypatch.setattr(uf, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, uf.filtered_pages(pages).collect())) == want and any(r[2] for r in want)


def test_lookup_with_a_salted_join(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.contamination(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, dc.contamination(docs, items).collect())) == want and any(r[5] for r in want)
