"""The pipeline's stages on odd rows and on an empty table."""

import corpus_pipeline
from tests.llm.test_operators import documents, empty, texts

ALL = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs, seen = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "test")
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ALL
    kept = {r.doc_id for r in seen["quality rules"]}
    assert {4, 5, 6, 16} <= kept and not kept & {0, 1, 2, 3, 7, 14, 15}  # 7 is all in capitals
    after = [r.doc_id for r in seen["MinHash near-dedup"]]
    assert 4 in after and not {5, 6} & set(after) and after.count(4) == 1
    whole = {r.doc_id: r.text for r in seen["suffix-array dedup"]}
    assert whole[16] == texts()[16] and all(r.n_chars == len(r.text) for r in seen["suffix-array dedup"])
    last = seen["SentencePiece encoding and decoding"]
    assert last and all(r.n_pieces == len(r.piece_ids) for r in last)


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), "test")
        assert docs.count() == 0
