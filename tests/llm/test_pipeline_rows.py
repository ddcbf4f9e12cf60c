"""The pipeline's stages on rows of all kinds: null and empty texts, ties, repeated rows, a very long text, clashing names."""

from collections import Counter

import pytest

import corpus_pipeline as P
from lectern.llm import secrets
from lectern.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, ids string, kept string, TIE int"
BASE = " ".join(f"w{i}" for i in range(120))
LONG = " ".join(f"wort{i % 977} mit{i % 13}" for i in range(40_000))
SECRET = "Zugang: password = abcdefgh1234567 und mehr"


def rows(spark, sf_dir):
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    texts = [(1, BASE), (2, BASE), (2, BASE), (3, BASE + " ende"), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, "kurz"), (8, "anders kurz"), (None, BASE), (None, None), (9, SECRET), (9, SECRET), (10, f"davor {item} danach")]
    return [(d, t, "de", None, None if t is None else len(t), "x", 0.5, "i", "k", 3) for d, t in texts]


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    all_rows = rows(spark, sf_dir)
    docs = spark.createDataFrame(all_rows, SCHEMA).repartition(3)
    return all_rows, docs


def taken(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_similar(spark, sf_dir, made):
    all_rows, docs = made
    out = P.keep_one_of_similar(spark, docs, sf_dir)
    assert out.columns == docs.columns
    want = Counter((d, t) for d, t, *_ in all_rows if not (d in (2, 3) or (d, t) == (9, SECRET))) + Counter([(9, SECRET)])
    assert taken(out) == want


def test_decontaminate(spark, sf_dir, made):
    all_rows, docs = made
    out = P.keep_uncontaminated(spark, docs, sf_dir)
    assert out.columns == docs.columns and taken(out) == Counter((d, t) for d, t, *_ in all_rows if d != 10)


def test_secrets(spark, sf_dir, made):
    all_rows, docs = made
    out = P.redact_secrets(spark, docs, sf_dir)
    got = Counter((r.doc_id, r.text, r.n_chars, r.score, r.TIE) for r in out.collect())
    change = lambda t: None if t is None else secrets.redact(t)
    assert out.columns == docs.columns and got == Counter((d, change(t), None if t is None else len(change(t)), 0.5, 3) for d, t, *_ in all_rows)
    assert change(SECRET) == "Zugang: [SECRET] und mehr"


def test_quality(spark, sf_dir, made):
    all_rows, docs = made
    out = P.keep_good(spark, docs, sf_dir)
    got, had = taken(out), Counter((d, t) for d, t, *_ in all_rows)
    # rows of the same text are judged alike, and those that stay stay as often as they were
    assert out.columns == docs.columns and all(n == had[k] for k, n in got.items())
    judged = {}
    for d, t in had:
        judged.setdefault(t or "", set()).add((d, t) in got)
    assert all(len(v) == 1 for v in judged.values())


def test_encode(spark, sf_dir, made):
    all_rows, docs = made
    out = P.encode(spark, docs, sf_dir).collect()
    had = Counter(d for d, *_ in all_rows)
    assert Counter(r.doc_id for r in out) == had
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (4, 5)) and all(r.n_tokens > 10_000 for r in out if r.doc_id == 7)
