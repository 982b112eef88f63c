import corpus_pipeline
import public_tokenizers
from crossbook.llm import decontamination, jaccard, packing, pii, quality


def test_stages_in_order_and_effective(spark, make, corpus, tmp_path):
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    item = text("item", 15)
    rows = [(1, text("p", 80)), (2, text("p", 79) + " end"), (3, "too short"), (4, text("q", 60) + "\n" + item), (5, item * 1 + " " + item + " " + text("item", 15) * 2), (6, text("m", 70) + " mail a@b.cd")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
    assert 3 not in seen[0] and 2 not in seen[1] and 1 in seen[1]
    assert "item3" not in seen[2][4] and "q59" in seen[2][4] and "[EMAIL]" in seen[3][6]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(seen[3]) and len({r.sequence_id for r in out}) == 1


def test_run_is_the_stages_by_hand(spark, make, corpus, tmp_path):
    docs = make(corpus)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, corpus[1][1]), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = pii.redacted(decontamination.decontaminated(jaccard.deduplicated(quality.filtered(docs)), bench))
    want = packing.pieces(kept, public_tokenizers.path("word_bpe_49k.json"))
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(want)
