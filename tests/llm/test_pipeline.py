"""The pipeline on the smallest tables: each stage judged on its own input."""

import pytest

import corpus_pipeline as C
from altscore.llm import pii, simhash
from altscore.llm.common import staged
from fixtures import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", d)]
    for name, stage in C.STAGES:
        d = staged(stage(spark, d, SF), f"test-{name}")
        out.append((name, d))
    return dict(out)


def test_stages(steps):
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    cols = steps["documents"].columns
    assert all(d.columns == cols for n, d in steps.items() if n != "best_fit_packing")


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = steps["documents"].join(steps["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() == 0


def test_one_of_each_group_stays(steps):
    d = simhash.near_duplicates(steps["toxicity"]).collect()
    assert sorted(r.doc_id for r in steps["simhash_near_dedup"].collect()) == sorted({r.component_id for r in d})


def test_no_base_span_is_left(steps):
    assert steps["pii"].count() == steps["simhash_near_dedup"].count()
    assert pii.detect(steps["pii"], pii.Trees()).where("size(base) > 0").count() == 0


def test_everything_mixed_is_packed(steps):
    got = steps["best_fit_packing"].where("piece = 0").groupBy("doc_id").count()
    want = steps["mixing"].groupBy("doc_id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_equals_the_stages(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = C.run(spark, SF).select(key).collect(), steps["best_fit_packing"].select(key).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("kind", ["edges", "empty"])
def test_stages_on_odd_and_empty_tables(spark, tmp_path, kind):
    """Nulls, empty and very long texts, repeated rows, clashing column names, no rows."""
    made = edge_docs(spark) if kind == "edges" else no_docs(spark)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (None, 0), (7, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES[:-1]:
        out = staged(stage(spark, d, str(tmp_path)), f"odd-{name}")
        assert out.columns == d.columns and out.dtypes == d.dtypes
        if name == "toxicity":
            assert out.count() == d.count()
        d = out
    packed = C.STAGES[-1][1](spark, d, str(tmp_path))
    assert packed.where("piece = 0").count() == d.count() and (d.count() > 0) == (kind == "edges")
