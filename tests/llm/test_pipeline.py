"""The pipeline against the same stages worked out by hand."""

from test_corpus_operators import links_by_hand, windows_by_hand

import corpus_pipeline
from lectern.llm import bpe, quality, secrets
from lectern.llm.common import documents, table
from lectern.llm.queries import ORACLES, QUERIES, tokenizer


def test_pipeline(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality.trained(docs, labels)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    left = [(d, t) for d, t in left if model.score(quality.grams().of(t or "")) >= 0.5]
    groups = links_by_hand(left, 5, 80, 100)
    left = [(d, t) for d, t in left if groups[d][1] == d]
    leaks = {d for d, _ in windows_by_hand(left, [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])}
    left = [(d, secrets.redact(t)) for d, t in left if d not in leaks]
    tok = bpe.coder(tokenizer("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: tok.encode(t) for d, t in left}
    assert 0.5 * docs.count() < len(got) < docs.count()


def test_stages_keep_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() <= odd.count()
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_one_query_for_each_operator(spark, sf_dir):
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
