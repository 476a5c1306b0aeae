"""The pipeline's stages against brute-force versions of their decisions."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import zlib  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from .test_operators import SlowFtrl, brute_classes, brute_equal, brute_hits, brute_mix, corpus  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [r for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 as score", "'k' as kept", "2 as _gone", "3 as taken", "4 as _keep_0", "'s' as first_slot").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[10][1]), (2, "nothing of this stands anywhere")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    stages = dict(pipeline.STAGES)
    assert ids(stages["exact_dedup"](spark, docs, sf_dir)) == sorted({r[1] for r in brute_equal(rows)})  # of repeated rows one
    assert ids(stages["near_dedup"](spark, docs, sf_dir)) == sorted(r[0] for r in brute_classes(rows, 5)[0] if r[3])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = []
    for i, t in rows:
        n, hit, _ = brute_hits(t, bench)
        if not hit or 20 * len(hit) < n:
            kept.append(i)
    assert ids(stages["decontaminate"](spark, docs, sf_dir)) == sorted(kept)


def test_quality_stage(spark, sf_dir):
    """What slow updates on the training rows reject goes, no other document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    slow = SlowFtrl()
    for _ in range(2):
        for _, i, t in sorted((order[i], i, (t or "").encode()) for i, t in data if i in y):
            slow.learn(t.decode(), y[i])
    scores = [(i, slow.probability(t or "")) for i, t in data]
    got = ids(dict(pipeline.STAGES)["quality"](spark, docs, sf_dir))
    assert got == sorted(i for i, x in scores if x >= 0.7) and 0 < len(got) < len(data)


def test_mixing_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [tuple(r)[:5] for r in docs.collect()]
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, sf_dir)
    size, total, target, taken, first = brute_mix(data)
    want = sorted((r[0], n, total[r[3]], round(target[r[3]], 6), t, f) for r, n, t, f in zip(data, size, taken, first) if t)
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken, r.first_slot) for r in mixed.collect()) == want
    assert {"document_taken", "document_first_slot", "kept", "_keep_0", "text"} <= set(mixed.columns)


def test_odd_tables(spark, sf_dir, tmp_path):
    """Nulls everywhere, empty and very long texts, repeated rows, ties: every stage gives whole rows of its input."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    odd = [(None, None, None, None, None), (1, None, None, None, None), (1, "", "x", None, 0), (2, long, None, "s", None), (2, long, None, "s", None), (3, long + " end", None, "s", 1), (4, "tie", "x", "t", 3), (5, "tie", "x", "t", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(odd, schema)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        got = [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()]
        assert all(r in odd for r in got), name
    stages = dict(pipeline.STAGES)
    assert ids(stages["near_dedup"](spark, docs, str(tmp_path)).where("doc_id is not null")) == [1, 1, 2, 2, 4]
    assert ids(stages["exact_dedup"](spark, docs, str(tmp_path))) == [1, 2, 3, 4]
    assert sum(r.taken for r in stages["mixing"](spark, docs, str(tmp_path)).collect()) > 0


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "taken"} <= set(out.columns)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
