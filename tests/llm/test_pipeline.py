"""The pipeline's stages against brute force on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import decontaminate, jaccard, quality
from revlens.llm.store import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test"))
    return out


def test_columns(steps):
    for df in steps[:5]:
        assert df.columns == steps[0].columns
    assert steps[5].columns == [*steps[0].columns, "slot", "shard"]


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_each_stage_applies_its_decisions(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judge(steps[0], labels).filter("kept").collect()}
    assert set(ids(steps[1])) == kept and 0 < len(kept) < steps[0].count()

    texts = {r["doc_id"]: r["text"] for r in steps[1].collect()}
    sets = {}
    for i, t in texts.items():
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert set(ids(steps[2])) == set(group.values())

    hit = {r["doc_id"] for r in decontaminate.contaminated(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i in ids(steps[2]) if any(x in texts[i].lower() for x in items)} <= hit
    assert set(ids(steps[3])) == set(ids(steps[2])) - hit
    assert set(ids(steps[4])) <= set(ids(steps[3]))
    assert sorted(ids(steps[5])) == sorted(ids(steps[4]))


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[5].collect()))


def test_rows_that_repeat_an_id(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, rows, SF)
    assert sorted(map(str, ids(left))) == ["1", "1", "None"]
    assert jaccard.similar_sets(rows).filter("doc_id IS NULL AND component_id IS NULL").count() == 1


def test_other_texts_under_an_id_are_documents_of_their_own(spark, tmp_path):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    item = "an item of the benchmark with enough words to be found in any text that holds it"
    rows = [(1, a), (2, a), (2, b), (3, item + " " + a), (3, b + " other words"), (None, a), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"mark": F.lit("m"), "row": F.lit("r"), "top": F.lit("t"), "block": F.lit("own")})
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert (2, a) not in got and {(1, a), (2, b), (None, a)} <= set(got) and got.count((4, None)) == 2
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()]
    assert (3, item + " " + a) not in left and len(left) == len(rows) - 1
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == docs.columns and {r["block"] for r in mixed.collect()} == {"own"}
    none = docs.limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
