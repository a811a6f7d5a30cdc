"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
from thermaline.llm import common, op2_byte_bpe, op3_decontaminate, op10_jaccard_join

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers

    docs = common.table(spark, DATA, "documents")
    bench = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = common.materialise(stage(spark, docs, DATA))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        elif name == "exact_dedup":
            assert after == set({t: d for d, t in sorted(before.items())}.values())
        elif name == "jaccard_join":
            assert after == {d for d, (_, c) in op10_jaccard_join.brute(list(before.items()), 5, 80).items() if c == d}
        elif name == "decontamination":
            assert after == {d for d, r in op3_decontaminate.brute(list(before.items()), bench).items() if not r[4]}
        else:
            path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
            assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()} == op2_byte_bpe.brute(list(before.items()), path, public_tokenizers.PATTERN)


def test_stages_at_the_edges(spark, odd):
    """Nulls, empty and repeated rows, clashing and dotted names, and no rows at all."""
    prose = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").limit(40)
    rest = [odd[c] for c in odd.columns if c not in ("doc_id", "text", "lang")]
    some = prose.unionByName(prose.limit(3)).select(prose["doc_id"] + 1000, "text", "lang").toDF("doc_id", "text", "lang")
    docs = common.union(odd, some.crossJoin(odd.select(*rest).limit(1)).select(*odd.columns)).withColumn("a.b", odd["doc_id"]).withColumn("my col", odd["lang"])
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            before = sorted((r.doc_id, r.text) for r in now.where("doc_id IS NOT NULL AND text IS NOT NULL").collect())
            now = common.materialise(stage(spark, now, DATA))
            if name == "byte_bpe":
                assert sorted(r.doc_id for r in now.where("doc_id IS NOT NULL").collect()) == [d for d, _ in before]
                continue
            assert now.columns == docs.columns
            after = [(r.doc_id, r.text) for r in now.where("doc_id IS NOT NULL").collect()]
            assert set(after) <= set(before) and (name == "language_id" or len(after) == len(set(after)))
        if start is docs:
            assert len(before) > 30
