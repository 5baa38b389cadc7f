"""Each stage on awkward rows; what it keeps, brute force keeps."""

import brute
import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import _components, language_id, packing

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_awkward_and_empty(spark, awkward, nothing, table_dir, empty_dir, name):
    for docs, top in ((awkward, table_dir), (nothing, empty_dir)):
        out = STAGES[name](spark, docs, top)
        n = len(out.collect())
        if name == "packing":
            assert "sequence_id" in out.columns
        else:
            assert out.columns == docs.columns and n <= docs.count()


def test_stages_against_brute_force(spark):
    top = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{top}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in STAGES["language_id"](spark, docs, top).collect()}
    assert len(kept) > 0.97 * len(texts)
    got = {r.doc_id: brute.sha(r.text) for r in STAGES["line_dedup"](spark, docs, top).collect()}
    assert got == {x[0]: x[3] for x in brute.lines(texts)}
    got = {r.doc_id for r in STAGES["ngram_jaccard_join"](spark, docs, top).collect()}
    assert got == {i for i, (_, c, _) in brute.jaccard(texts, 5, 80).items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    got = {r.doc_id for r in STAGES["decontamination"](spark, docs, top).collect()}
    assert got == {x[0] for x in brute.contamination(texts, items) if not x[5]}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    fill = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] != 1024 for r in fill) <= 1


P = " ".join(f"word{i}" for i in range(40))
Q = " ".join(f"other{i}" for i in range(40))
SHARED = [(1, P), (1, P), (2, P), (3, Q + " x"), (3, P + " y"), (4, Q), (None, P + " z"), (None, "alone it stands"), (None, "alone it stands"), (5, ""), (5, ""), (None, None)]


def test_one_of_each_group_where_ids_are_shared_or_null(spark):
    docs = spark.createDataFrame(SHARED, "doc_id long, text string").repartition(3)
    got = STAGES["ngram_jaccard_join"](spark, docs, None).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, P), (3, Q + " x"), (None, "alone it stands"), (5, ""), (5, ""), (None, None)], key=repr)


def test_clean_rows_stay_where_ids_are_shared_or_null(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(P.split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(SHARED, "doc_id long, text string").repartition(3)
    got = STAGES["decontamination"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([r for r in SHARED if not (r[1] or "").startswith("word0 ")], key=repr)


def test_batches_of_stages_are_of_bounded_bytes(spark, awkward, table_dir):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for name, stage in STAGES.items():
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
            stage(spark, awkward.limit(1), table_dir)
            texts = spark.range(0, 9000, 1, 1).select(F.expr("repeat('abcdefgh ', 200)").alias("text"))
            sizes = [r.b for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["b"]) for b in batches), "b long").collect()]
            assert sum(sizes) > 16_000_000 and max(sizes) < 4_100_000, name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_a_worker_lets_go_of_another_operators_cache():
    packing.encoder(packing.tokenizer_path()).encode("some words of a text")
    assert packing.encoder.cache_info().currsize == 1
    list(language_id.small([pa.record_batch({"text": ["one", "two"]})], "text"))
    assert packing.encoder.cache_info().currsize == 0


def test_components_on_many_partitions_are_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = _components.components(spark.range(1, 1000).selectExpr("id AS a", "id - 1 - id % 10 % 3 % 2 AS b").filter("a % 100 > 1"))
        rows = {r.node: r.root for r in found.collect()}
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        for key, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), before, strict=True):
            spark.conf.set(key, value)
    up = list(range(-2, 1001))
    for a in range(1, 1000):
        if a % 100 > 1:
            b, top = a - 1 - a % 10 % 3 % 2, lambda x: x if up[x + 2] == x else top(up[x + 2])
            x, y = sorted((top(a), top(b)))
            up[y + 2] = x
    top = lambda x: x if up[x + 2] == x else top(up[x + 2])
    assert rows == {n: top(n) for n in rows} and len(rows) > 900
