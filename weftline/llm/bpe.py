"""BPE encoding by a pair occurrence index, and decoding.

All distinct words of a batch lie in one array of symbols, linked to their neighbours. An index maps each pair that a
merge exists for to all its positions. Ranks that occur are applied in ascending order, each at all its positions at
once; a merge changes the pairs to its left and right, and only their lists are updated. Words do not touch, so taking
the least rank of the batch is taking the least rank of each word that holds it, which is how BPE is defined.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .tokens import Known, cut, gather, load_tokenizer, spread, strings, units, vocabulary_path

BYTE_BPE = "byte_bpe_50k.json"
#: Bytes of text that are encoded at once.
UNIT = 4 << 20


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next unused one."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """A vocabulary's merges as arrays; pairs are keyed by left * size + right."""

    size: int
    first: np.ndarray  # id of each byte
    last: np.ndarray  # id of each byte at the end of a word
    keys: np.ndarray  # sorted
    ranks: np.ndarray
    made: np.ndarray  # by rank
    sides: np.ndarray  # by rank: left and right
    special: dict
    spelled: list  # bytes of each id

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(maxsize=4)
def load_merges(name: str) -> Merges:
    with open(vocabulary_path(name), encoding="utf-8") as file:
        told = json.load(file)
    model, letters = told["model"], byte_letters()
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    size = max(*vocab.values(), *special.values(), 0) + 1
    sides = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
    made = np.array([vocab[a.removesuffix(suffix) + b if suffix and not b else a + b] for a, b in pairs], np.int64)
    keys = sides[:, 0] * size + sides[:, 1]
    order = np.argsort(keys, kind="stable")
    back = {c: b for b, c in enumerate(letters)}
    spelled = [b""] * size
    for token, i in vocab.items():
        spelled[i] = bytes(back[c] for c in token) if not suffix and all(c in back for c in token) else token.encode()
    for token, i in special.items():
        spelled[i] = token.encode()
    first = np.array([vocab[c] for c in letters], np.int64)
    last = np.array([vocab[c + suffix] for c in letters], np.int64)
    return Merges(size, first, last, keys[order], order.astype(np.int64), made, sides, special, spelled)


def merge_words(merges: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), lengths
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    symbol = merges.first[data]
    tips = ends[lengths > 0] - 1
    symbol[tips] = merges.last[data[tips]]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[tips] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray):
        """Enters positions in the lists of their pairs' ranks."""
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        borders = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate(([0], borders))].tolist(), np.split(at, borders), strict=True):
            held = index.get(rank)
            if held is None:
                index[rank] = [part]
                heapq.heappush(active, rank)
            else:
                held.append(part)

    at = np.flatnonzero(after >= 0)
    ranks = merges.rank_of(symbol[at], symbol[after[at]])
    if (ranks >= 0).any():
        enter(at[ranks >= 0], ranks[ranks >= 0])
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        left, right = merges.sides[rank]
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        # Positions go stale when a merge takes one of their symbols.
        to = after[at]
        good = (symbol[at] == left) & (to >= 0) & (symbol[to] == right)
        at = at[good]
        if not len(at):
            continue
        if left == right:
            at = np.unique(at)
            # In a run of one symbol every other pair, from the left.
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            place = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(chained, 0, place))
            at = at[(place - begin) % 2 == 0]
        elif len(lists) > 1:
            at = np.unique(at)
        to = after[at]
        symbol[at] = merges.made[rank]
        symbol[to] = -1
        beyond = after[to]
        after[at] = beyond
        after[to] = -1
        some = beyond >= 0
        before[beyond[some]] = at[some]
        ahead = before[at]
        near = np.unique(np.concatenate([ahead[ahead >= 0], at[some]]))
        if len(near):
            ranks = merges.rank_of(symbol[near], symbol[after[near]])
            found = ranks >= 0
            if found.any():
                enter(near[found], ranks[found])
    alive = symbol >= 0
    return symbol[alive].astype(np.uint32), np.bincount(word[alive], minlength=len(words))


def _pretoken_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def encode_pieces(name: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces one after another, and how many each has, by merges over their distinct words."""
    merges, library, pattern = load_merges(name), load_tokenizer(name).pre_tokenizer, _pretoken_pattern()
    seen: dict = {}
    of, counts = [], np.zeros(len(pieces), np.int64)

    def words_of(text: str):
        if text.isascii() or max(text) < "ɐ":
            return pattern.findall(text)
        # Letters beyond Latin: the library's own notion of a letter.
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    for k, piece in enumerate(pieces.to_pylist()):
        n = len(of)
        for part, special in _parts(piece, merges.special):
            if special is not None:
                of.append(seen.setdefault(special, len(seen)))
            else:
                of.extend([seen.setdefault(w, len(seen)) for w in words_of(part)])
        counts[k] = len(of) - n
    keys = list(seen)
    ids, lengths = merge_words(merges, [b"" if isinstance(w, int) else w.encode() for w in keys])
    marks = [i for i, w in enumerate(keys) if isinstance(w, int)]
    if marks:
        ids = np.insert(ids, (np.cumsum(lengths))[marks], [keys[i] for i in marks]).astype(np.uint32)
        lengths[marks] = 1
    return _by_piece(np.array(of, np.int64), counts, ids, lengths)


@lru_cache(maxsize=8)
def _special_pattern(special: tuple[str, ...]):
    """Any of the special strings, the longest first where several begin at one place."""
    import re

    return re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None


def _parts(text: str, special: dict):
    """The text cut at special strings, the leftmost first: (part, None) or (string, its id)."""
    pattern = _special_pattern(tuple(special))
    at = 0
    for found in pattern.finditer(text) if pattern else ():
        if found.start() > at:
            yield text[at : found.start()], None
        yield found[0], special[found[0]]
        at = found.end()
    if at < len(text):
        yield text[at:], None


def _by_piece(of, counts, ids, lengths):
    out, ends = spread(of, np.cumsum(counts), ids, lengths)
    return out, np.diff(ends, prepend=0)


_known: dict[str, Known] = {}


def encode(texts, name: str = BYTE_BPE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (uint32, one after another) and where each text's ids end."""
    texts = strings(texts)
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    pieces, spaced, of, ends = cut(texts)
    ids, lengths = _known.setdefault(name, Known()).of(pieces, np.arange(len(pieces)) < spaced, lambda some, _: encode_pieces(name, some))
    return spread(of, ends, ids, lengths)


@lru_cache(maxsize=4)
def _spelling(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spelled = load_merges(name).spelled
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(ids: np.ndarray, ends: np.ndarray, name: str = BYTE_BPE) -> list[str]:
    """The texts of the ids; bytes that are no UTF-8 become U+FFFD."""
    data, starts, lengths = _spelling(name)
    own = lengths[ids]
    raw = gather(starts[ids], own, data).tobytes()
    stops = np.concatenate(([0], np.cumsum(own)))[ends].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def encode_documents(docs: DataFrame, name: str = BYTE_BPE, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row; null texts count as empty and have none.

    With `decoded` a third column, text, is what decoding those ids gives. Special strings inside a text become their
    ids, as in the library. Rows that repeat an id give a row each; other columns are ignored; an empty table gives no
    rows. Memory is bounded by units of some 4 MB of text; one text is the least unit.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches):
        for table in units(batches, most=UNIT):
            ids, ends = encode(table["text"], name)
            raw, stops = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            packed = pa.array([raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], pa.binary())
            columns = {"doc_id": table["doc_id"].combine_chunks(), "ids": packed}
            if decoded:
                columns["text"] = pa.array(decode(ids, ends, name), pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary" + ", text string" * decoded)


def decode_documents(encoded: DataFrame, name: str = BYTE_BPE) -> DataFrame:
    """doc_id, ids and the decoded text of every row of ids; null ids decode to an empty text."""
    prepare(encoded.sparkSession)
    rows = encoded.select("doc_id", F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))

    def run(batches):
        for batch in batches:
            held = batch.column("ids").to_pylist()
            ids = np.frombuffer(b"".join(held), "<u4")
            texts = decode(ids, np.cumsum([len(x) // 4 for x in held], dtype=np.int64), name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary, text string")

