"""Token ids of whole texts, by the tokenizers library over distinct pieces.

A byte-level BPE with the usual pre-tokenizer never lets a token reach across a single space that stands between
two visible characters: the space always begins a new pre-token, and what follows is cut without regard to what came
before. So a batch is cut at spaces, each distinct piece is encoded once by the library, and the ids of all
occurrences are gathered from that table. Texts with other white space around a space keep that part in one piece, so
the ids are those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds the memory of a worker whatever the partition holds.
UNIT_BYTES = 16 << 20


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary of that name lies on this machine; a path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """The library's tokenizer, without truncation and padding, and without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def units(batches, column: str = "text", most: int = UNIT_BYTES):
    """Joins Arrow batches to tables of about `most` bytes of text, and cuts larger batches by rows."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)[at:]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            rows = max(1, int(np.searchsorted(ends, most - size, "right"))) if size < most else 0
            if rows:
                held.append(batch.slice(at, rows))
                size += int(ends[rows - 1])
                at += rows
            if size >= most or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def strings(column) -> pa.Array:
    """One chunk of large strings, with null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The concatenated runs values[start : start + length]."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at += np.repeat(starts - (ends - lengths), lengths)
    return values[at]


#: White space as str.isspace has it, for RE2; a space beside one of these is no safe cut.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LOOSE = rf"^$|^{_BLANK}|{_BLANK}$"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def cut(texts: pa.Array) -> tuple[pa.Array, int, np.ndarray, np.ndarray]:
    """Distinct pieces (the first so many are a space and one word), the piece of each occurrence, and the end of
    each text's occurrences. Joining a text's pieces gives the text.
    """
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    bounds -= bounds[0]
    counts = np.diff(bounds)
    loose = pc.match_substring_regex(words, _LOOSE).to_numpy(zero_copy_only=False)
    rough = (np.add.reduceat(loose[codes], bounds[:-1]) > 0) & (counts > 1)
    forms = 2 * codes
    forms[bounds[:-1]] += 1  # the first word of a text has no space before it
    used = np.zeros(2 * len(words), bool)
    used[forms[np.repeat(~rough, counts)] if rough.any() else forms] = True
    spaced, first = np.flatnonzero(used[0::2]), np.flatnonzero(used[1::2])
    place = np.zeros(2 * len(words), np.int64)
    place[2 * spaced] = np.arange(len(spaced))
    place[2 * first + 1] = len(spaced) + np.arange(len(first))
    nothing, space = pa.scalar("", words.type), pa.scalar(" ", words.type)
    pieces = [pc.binary_join_element_wise(space, words.take(pa.array(spaced)), nothing), words.take(pa.array(first))]
    of, n = place[forms], len(spaced) + len(first)
    if rough.any():
        seen: dict[str, int] = {}
        parts, whole = np.split(of, bounds[1:-1]), counts.copy()
        for row in np.flatnonzero(rough).tolist():
            own = _SAFE.split(texts[row].as_py())
            own[1:] = [" " + p for p in own[1:]]
            parts[row] = np.fromiter((n + seen.setdefault(p, len(seen)) for p in own), np.int64, len(own))
            whole[row] = len(own)
        of, counts = np.concatenate(parts), whole
        pieces.append(pa.array(list(seen), words.type))
    return pa.concat_arrays(pieces), len(spaced), of, np.cumsum(counts)


def encode_pieces(name: str, pieces: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces one after another, and how many each has, by the library.

    Plain pieces (a space and a word) are encoded many to a string, and told apart at the tokens that begin with a
    space, of which each has one; the others are encoded one by one.
    """
    tokenizer, opens = load_tokenizer(name), _opening(name)
    ids, lengths = np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(plain)
    for k in range(0, len(rows), _TOGETHER):
        own = rows[k : k + _TOGETHER]
        joined = "".join(pieces.take(pa.array(own)).to_pylist())
        got = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(opens[got])
        if len(at) != len(own) or at[0] != 0:  # a vocabulary that joins otherwise
            plain = plain.copy()
            plain[own] = False
            continue
        lengths[own] = np.diff(np.append(at, len(got)))
        runs.append((own, got))
    rows = np.flatnonzero(~plain)
    for k in range(0, len(rows), _TOGETHER):
        own = rows[k : k + _TOGETHER]
        found = [x.ids for x in tokenizer.encode_batch_fast(pieces.take(pa.array(own)).to_pylist(), add_special_tokens=False)]
        lengths[own] = [len(x) for x in found]
        runs.append((own, np.fromiter((i for x in found for i in x), np.uint32, int(lengths[own].sum()))))
    if runs:
        order = np.concatenate([own for own, _ in runs])
        ids = np.concatenate([got for _, got in runs])
        starts = np.empty(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        ids = gather(starts, lengths, ids)
    return ids, lengths


@lru_cache(maxsize=4)
def _opening(name: str) -> np.ndarray:
    """For each id, whether its token begins with a space."""
    vocabulary = load_tokenizer(name).get_vocab(with_added_tokens=True)
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
    return opens


class Known:
    """Ids of pieces that this worker has met, up to a number of pieces and bytes; packed, so they take some 20 MB."""

    most, most_bytes = 400_000, 16 << 20

    def __init__(self):
        self.words, self.ids, self.lengths = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def of(self, pieces: pa.Array, plain: np.ndarray, fresh) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece; fresh(pieces, plain) gives those of pieces not met yet."""
        place = pc.index_in(pieces, value_set=self.words)
        new = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        place = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        found = pieces.take(pa.array(new))
        ids, lengths = fresh(found, plain[new])
        place[new] = len(self.words) + np.arange(len(new))
        every_ids, every = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        starts = np.cumsum(every) - every
        own = every[place]
        result = gather(starts[place], own, every_ids), own
        if len(self.words) + len(new) <= self.most and self.words.nbytes + found.nbytes <= self.most_bytes:
            self.words, self.ids, self.lengths = pa.concat_arrays([self.words, found]), every_ids, every
        return result


_known: dict[str, Known] = {}
#: Pieces that go to the library as one string.
_TOGETHER = 2_000


def spread(pieces_of: np.ndarray, ends: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text ends."""
    starts = np.cumsum(lengths) - lengths
    own = lengths[pieces_of]
    total = np.concatenate(([0], np.cumsum(own)))
    return gather(starts[pieces_of], own, ids), total[ends]


def encode(texts, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (uint32, one after another) and where each text's ids end."""
    texts = strings(texts)
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    pieces, spaced, pieces_of, ends = cut(texts)
    known = _known.setdefault(name, Known())
    ids, lengths = known.of(pieces, np.arange(len(pieces)) < spaced, lambda some, plain: encode_pieces(name, some, plain))
    return spread(pieces_of, ends, ids, lengths)
