import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from weftline.llm import ranking
from weftline.llm.ranking import Heap, Shard, search, terms, wand

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, best=10):
    """Ranks by scoring every document for every item."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 100 - 75 + 75 * n * total // length
            score = sum(r * floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(words(text)).items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def check(docs, items, docs_df, items_df, **options):
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search(docs_df, items_df, **options).collect()), key=repr)
    assert got == brute(docs, items, options.get("best", 10))
    return got


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"shard_docs": 17, "items_a_block": 7}, {"shard_terms": 500, "best": 3}])
def test_documents(spark, sf_dir, documents, rows, items, options):
    check(rows, items, documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), **options)


def test_odd_rows(spark, odd):
    asked = [(1, "Hello hello WORLD words"), (2, None), (3, ""), (None, "lang END"), (4, "É Ä ß 日本語 x"), (5, "nothing-of-it"), (1, "Hello hello WORLD words"), (6, "hello"), (6, "password hunter2hunter2")]
    df = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS rank", "2 AS `a.b`", "3 AS item")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = check(docs, list(dict.fromkeys(asked)), odd, df)
    assert {r[2] for r in got if r[0] is None} == {5, 6} and sum(r[0] == 4 and r[2] == 7 for r in got) == 2


def test_ties_go_to_the_smaller_id_in_any_order(spark):
    docs = [(i, "same words here" if i % 3 else "other text") for i in range(200, 0, -1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = check(docs, [(1, "same words")], df, spark.createDataFrame([(1, "same words")], "item_id long, text string"), shard_docs=9)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]


def test_empty(spark, odd):
    asked = spark.createDataFrame([(1, "hello")], "item_id long, text string")
    assert search(odd.limit(0), asked).count() == 0
    none = search(odd, asked.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms():
    for text in ("Straße-Nr.5 ÉCOLE École", "a_b\x00c\x7fd\u0080e  f", "日本語、テキスト", ""):
        assert [t.decode() for t in terms(text.encode())] == words(text)


def test_wand_skips_what_cannot_enter():
    """Of 20,000 documents few are scored, and the heap is the one that scoring all gives."""
    rng = np.random.default_rng(1)
    n = rng.integers(20, 400, 20_000)
    rows, seen = [], []
    for k in range(len(n)):
        own = np.unique(np.minimum(rng.zipf(1.3, 30), 300) - 1)
        rows.append(own)
        seen.append(rng.integers(1, 5, len(own)))
    ends, term, tf = np.cumsum([len(r) for r in rows]), np.concatenate(rows), np.concatenate(seen)
    shard = Shard(n, ends, term, tf, len(n), int(n.sum()), 300)
    df = np.bincount(term, minlength=300)
    weights = np.array([ranking.weight(int(d), len(n)) for d in df])
    asked = np.array([0, 1, 2, 5, 40, 90, 150, 299])
    heap = Heap()
    scored = wand(shard, asked, weights[asked], list(range(len(n))), heap)
    m = 25 + 75 * n * len(n) // n.sum()
    totals = np.zeros(len(n), np.int64)
    for t in asked:
        docs, _ = shard.list_of(t)
        own = tf[np.flatnonzero(term == t)].astype(np.int64)
        totals[docs] += weights[t] * (10**9 * own // (1000 * own + 8 * m[docs]))
    best = sorted(((-s, i) for i, s in enumerate(totals.tolist())))[:10]
    assert [(-s, i) for s, i in heap.held] == best
    assert scored < 2_000
