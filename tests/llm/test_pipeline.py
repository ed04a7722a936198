import os

import pytest

import corpus_pipeline
from hexnet.llm import common, decontaminate, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    ids, had = {r[0] for r in docs.select("doc_id").collect()}, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, docs, SF), "t")
        assert docs.columns == corpus_pipeline.COLUMNS
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() <= had, name
        ids, had = now, docs.count()
        if name == "benchmark decontamination":
            assert not decontaminate.report(docs, common.table(spark, SF, "benchmark")).where("contaminated").count()
        if name == "SimHash near-dedup":
            groups = simhash.classes(before, 5, simhash.WIDE)
            assert {r[0] for r in groups.select("component_id").distinct().collect()} == now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 2048


def _folder(spark, tmp_path, rows):
    """Tables with the rows given as documents, a clashing column besides."""
    folder = str(tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, root long"
    spark.createDataFrame([(d, t, "en", None, 1, 5, 0.5, 7) for d, t in rows], kinds).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        common.table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_awkward_rows(spark, tmp_path):
    text = common.table(spark, SF, "documents").join(common.table(spark, SF, "labels"), "doc_id").where("quality = 1 and toxic = 0").orderBy("doc_id").limit(40).collect()
    passage = common.table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(r.doc_id, r.text) for r in text]
    long = "\n".join(r.text for r in text) * 3
    rows += [(None, rows[3][1]), (90_001, None), (90_002, ""), (90_003, "  \n"), (90_004, long), (rows[0][0], rows[0][1]), (90_005, rows[1][1]), (90_006, rows[2][1] + " " + passage), (90_007, rows[5][1]), (90_007, rows[6][1] + " another end")]
    folder, kept = _folder(spark, tmp_path, rows), {}
    docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, folder), "t")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    near, clean, packed = kept["SimHash near-dedup"], kept["benchmark decontamination"], kept["best-fit packing"]
    assert set(clean) <= set(near) and set(packed) == set(clean) and 90_006 not in clean
    assert near.count(rows[0][0]) <= 1 and 90_005 not in near and sum(d in near for d in (90_001, 90_002, 90_003)) <= 1
    assert sorted(map(str, kept["best-fit packing"])) == sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect())


def test_empty_table(spark, tmp_path):
    folder = _folder(spark, tmp_path, [])
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, folder), "t")
        assert docs.count() == 0


def test_near_duplicates_against_brute_force(spark):
    docs = common.table(spark, SF, "documents").collect()
    sets = {}
    for r in docs:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if not x and not y or len(x & y) >= 0.8 * len(x | y):
                a1, b1 = top(a), top(b)
                up[max(a1, b1)] = min(a1, b1)
    kept = corpus_pipeline.near_duplicates(spark, common.table(spark, SF, "documents"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({top(d) for d in ids})
