import zlib

import corpus_pipeline as cpl
from pulsemill.llm import decontamination, language_id, quality_classifier
from pulsemill.llm.common import cleaned, scratch_root, stored, table, workspace
from pulsemill.sources.files import Folders

from .test_native import plain_contamination
from .test_simhash_dedup import plain_components

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, start = docs.columns, docs.count()
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    out = stored(cpl.language(spark, docs, SF), "t1")
    assert out.columns == names and out.count() == start  # all have a language
    docs = out
    out = stored(cpl.quality(spark, docs, SF), "t2")
    model = quality_classifier.trained(docs.select("doc_id", "text"), table(spark, SF, "labels"))
    scores = docs.select("doc_id", quality_classifier.score_column(docs["text"], model).alias("s")).collect()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scores if r.s >= 0.3}
    held = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    kept = {d for d, _ in rows(out)}
    assert sum((d in kept) == bool(q) for d, q in held.items()) / len(held) > 0.95

    docs = out
    out = stored(cpl.near_duplicates(spark, docs, SF), "t3")
    assert out.columns == names
    assert sorted(d for d, _ in rows(out)) == sorted({c for _, _, c in plain_components(rows(docs))})

    docs = out
    out = stored(cpl.benchmark_passages(spark, docs, SF), "t4")
    items = rows(table(spark, SF, "benchmark").withColumnRenamed("item_id", "doc_id"))
    clean = {d for d, _, _, _, _, bad in plain_contamination(rows(docs), items) if not bad}
    assert out.columns == names and {d for d, _ in rows(out)} == clean
    pieces = cpl.packing(spark, out, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == clean


def test_run_and_repeat(spark):
    sf = "/root/testdata/sf0.001"
    one, two = (sorted(map(tuple, cpl.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset").collect())) for _ in range(2))
    assert one == two and one


def test_stages_on_empty_and_odd_rows(spark):
    odd = spark.createDataFrame([(None, "Some plain words in a row, and a few more of them here.", None, None, None), (5, None, "en", "src1", 0), (5, None, "en", "src1", 0), (6, "The words of this text are like those of any other text.", "en", "src1", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in cpl.STAGES:
            out = stage(spark, docs, SF).collect()
            assert docs is odd or not out, name
    assert len(language_id.kept(odd).collect()) == 2
    assert len(decontamination.kept(odd, table(spark, SF, "benchmark")).collect()) == 4


def test_every_stage_keeps_columns_of_any_name(spark):
    clash = ["__key", "__h", "near_id", "near_h", "media_type", "fp", "rid", "a", "b", "c0"]
    texts = ["The words of this text are like those of any other text here.", "Another text that has some more words in it than the first one has."]
    rows = [(k, t, "en", "src1", len(t), *[f"{c}{k}" for c in clash]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))
    for name, stage in cpl.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows), name
        if name != "quality":
            assert out.count() == 2, name
    assert {r.doc_id for r in cpl.packing(spark, docs, SF).collect()} == {0, 1}


def test_scratch_tables_go_with_their_owner(spark):
    files, root = Folders(spark), scratch_root(spark)
    names = lambda: set(files.names(root))
    before = names()
    with workspace(spark):
        stored(spark.range(3), "inner")
        with workspace(spark):
            kept = stored(spark.range(4), "kept", outer=True)
            stored(spark.range(5), "gone")
        assert kept.count() == 4 and len(names() - before) == 2
    assert names() == before
    two = cleaned(lambda rows: stored(rows, "way").where("id > 0"))
    two.__wrapped__.__name__ = "two"
    assert two(spark.range(3)).count() == 2 and len(names() - before) == 1


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
