"""The pipeline against a plain version that takes the classifier's and the scanner's decisions as given."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from weftline.llm import quality, secrets, simhash
from weftline.llm.bpe import BYTE_BPE
from weftline.llm.tokens import load_tokenizer


def test_stages():
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"] and C.ORACLE_SQL is None


def test_run(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.classify(documents, labels).collect() if r.predicted}
    docs = {r.doc_id: r.text for r in documents.collect() if r.doc_id in good}
    last = {}
    for i in sorted(docs):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in docs[i])] = i
    docs = {i: docs[i] for i in sorted(last.values())}
    ids, words = list(docs), {}
    for i, t in docs.items():
        found = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        words[i] = {" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))}
    share = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])
    similar = {r.doc_id: r.component_id for r in simhash.similar_documents(documents.where(documents.doc_id.isin(ids))).collect()}
    for a in range(len(ids)):
        for b in range(a):
            if share(ids[a], ids[b]) >= 0.9:
                assert similar[ids[a]] == similar[ids[b]]
    for i, c in similar.items():
        assert c == i or max(share(i, j) for j in ids if j != i and similar[j] == c) > 0.7
    group = similar
    texts = {i: secrets.redact(docs[i], secrets.find_spans(docs[i])[1]) for i in ids if group[i] == i}
    library, want = load_tokenizer(BYTE_BPE), {}
    for i, t in texts.items():
        want[i] = [*library.encode(t, add_special_tokens=False).ids, 2]
    got = C.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, want.values()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, sf_dir, odd, k):
    name, stage = C.STAGES[k]
    for docs in (odd.withColumn("n_chars", odd.doc_id), odd.limit(0)):
        out = stage(spark, docs, sf_dir)
        out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
