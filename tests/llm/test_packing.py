import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.packing import CAPACITY, Packer, pack_documents, piece_bounds
from weftline.llm.tokens import vocabulary_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 10))
def test_packer_is_bounded_best_fit(lengths, open_bins):
    packer, free = Packer(20, open_bins), {}
    for n in lengths:
        fitting = [f for f in free.values() if f >= n]
        bin_, offset = packer.place(n)
        if fitting:  # the tightest of the open bins
            assert free[bin_] == min(fitting) and offset == 20 - free[bin_]
        else:
            assert bin_ not in free and offset == 0
        free[bin_] = free.get(bin_, 20) - n
        if not free[bin_]:
            del free[bin_]
        if len(free) > open_bins:  # one of the fullest has closed
            gone = [b for b in free if b not in {x for held in packer.by_free for x in held}]
            assert len(gone) == 1 and free[gone[0]] == min(free.values())
            del free[gone[0]]
        assert packer.opened == len(free) <= open_bins


def test_piece_bounds():
    assert piece_bounds(1, 4) == [(0, 1)] and piece_bounds(4, 4) == [(0, 4)] and piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)]


def check(df, rows):
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    sequences, seen = {}, {}
    got = pack_documents(df).collect()
    for r in got:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4")) == r.ids_crc32 for x in want[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: sum(map(len, x)) for i, x in want.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return got, sequences


def test_documents(documents, rows):
    got, sequences = check(documents, rows)
    assert sum(r.length for r in got) / (CAPACITY * len(sequences)) > 0.97


def test_odd_rows(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert pack_documents(odd.limit(0)).count() == 0
