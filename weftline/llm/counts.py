"""Token counts by finite-state transducers.

Two deterministic machines count a tokenizer's tokens without making them:

- The segment machine reads classes of characters and tells where words begin. A text is read in chunks at once: for
  each chunk the map from every state at its beginning to the state at its end is computed, the maps are composed by a
  parallel prefix scan, and so each chunk's true beginning is known and its marks can be written.
- The word machine reads a word's bytes. It is compiled from the merge table: its states are the tokens that may be
  pending, and its transitions are annotated with the number of tokens that become final. All distinct words of a batch
  go through it in step.

A text's count is the sum of what the word machine emits on the words that the segment machine marks.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .bpe import Merges, _parts, load_merges
from .tokens import strings, units

WORD_BPE = "word_bpe_49k.json"
CHUNK = 256

# Classes of characters; the single letters are those of the contractions 's 't 'm 'd 're 've 'll.
SPACE, NUMBER, OTHER, QUOTE, LETTER, SOLO, R, E, V, L = range(10)
# States: between words, in letters, in other marks, after a quote that begins a word, and after that and r, v or l.
BETWEEN, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
#: Outputs: a word begins here; a word began at the character before.
HERE, BEFORE = 1, 2


def segment_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by state and class, of
    's|'t|'re|'ve|'m|'ll|'d|letters|one number|other marks, with white space dropped."""
    to = np.zeros((7, 10), np.uint8)
    out = np.zeros((7, 10), np.uint8)
    begin = {SPACE: (BETWEEN, 0), NUMBER: (BETWEEN, HERE), OTHER: (OTHERS, HERE), QUOTE: (QUOTED, HERE)} | {c: (LETTERS, HERE) for c in (LETTER, SOLO, R, E, V, L)}
    for c, (state, mark) in begin.items():
        to[:, c], out[:, c] = state, mark
        for q in (QUOTED_R, QUOTED_V, QUOTED_L):
            # The quote stood alone: a word of letters began at the letter after it.
            to[q, c], out[q, c] = (LETTERS, BEFORE) if c >= LETTER else (state, mark | BEFORE)
    out[LETTERS, LETTER:] = 0
    to[OTHERS, [OTHER, QUOTE]], out[OTHERS, [OTHER, QUOTE]] = OTHERS, 0
    to[QUOTED, [OTHER, QUOTE]], out[QUOTED, [OTHER, QUOTE]] = OTHERS, 0
    to[QUOTED, SOLO], out[QUOTED, SOLO] = BETWEEN, 0
    for c, q, last in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        to[QUOTED, c], out[QUOTED, c] = q, 0
        to[q, last], out[q, last] = BETWEEN, 0
    return to, out


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 if x >= 0xD800 else x for x in m.span())
            table[a:b] = kind
    for chars, kind in (("'", QUOTE), ("stmd", SOLO), ("r", R), ("e", E), ("v", V), ("l", L)):
        table[[ord(c) for c in chars]] = kind
    return table


def compose(maps: np.ndarray) -> np.ndarray:
    """Row k: the state in which chunk k begins, for each state at the very beginning; by a parallel prefix scan."""
    before = np.concatenate([np.arange(maps.shape[1], dtype=maps.dtype)[None], maps[:-1]])
    step = 1
    while step < len(before):
        # before[k] covers the 2 * step maps that end at k
        before[step:] = np.take_along_axis(before[step:], before[:-step].astype(np.int64), 1)
        step *= 2
    return before


def marks(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """For each character whether a word begins there."""
    to, out = segment_machine()
    n, width = len(classes), to.shape[1]
    rows = -(-n // chunk)
    steps = np.zeros(rows * chunk, np.uint8)
    steps[:n] = classes
    steps = np.ascontiguousarray(steps.reshape(rows, chunk).T)
    flat, marked = to.ravel(), out.ravel()
    maps = np.tile(np.arange(len(to), dtype=np.uint8), (rows, 1))
    for column in steps:
        maps = flat[maps * np.uint8(width) + column[:, None]]
    state = compose(maps)[:, BETWEEN]
    written = np.empty_like(steps)
    for k, column in enumerate(steps):
        at = state * np.uint8(width) + column
        written[k] = marked[at]
        state = flat[at]
    flags = written.T.ravel()[:n]
    begins = (flags & HERE) > 0
    begins[:-1] |= (flags[1:] & BEFORE) > 0
    return begins


class Joints:
    """What the merges say of tokens: which BPE can leave at all, and which two it can leave side by side.

    A sequence of tokens is what BPE makes of its text if and only if that holds for every two neighbours, since the
    first merge across any joint depends on the tokens on its two sides alone.
    """

    NEVER = 1 << 40

    def __init__(self, merges: Merges):
        self.size = merges.size
        self.rank = dict(zip((merges.sides[:, 0] * merges.size + merges.sides[:, 1]).tolist(), range(len(merges.sides)), strict=True))
        self.sides = dict(zip(merges.made.tolist(), map(tuple, merges.sides.tolist()), strict=True))
        self.time = {token: rank for rank, token in enumerate(merges.made.tolist())}
        if len(self.time) < len(merges.made) or any(max(self.time.get(a, -1), self.time.get(b, -1)) >= self.time[t] for t, (a, b) in self.sides.items()):
            raise ValueError("each token must have one merge, of tokens that earlier merges make")
        self._edges: tuple[dict, dict] = ({}, {})
        self.left_over = set(merges.first.tolist()) | set(merges.last.tolist())
        for token, (a, b) in self.sides.items():
            if a in self.left_over and b in self.left_over and self.first_across(a, b) == (a, b):
                self.left_over.add(token)

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand in turn at an edge (0 left, 1 right) while the token is being merged."""
        found = self._edges[side].get(token)
        if found is None:
            below = self._edge(self.sides[token][side], side) if token in self.sides else []
            found = self._edges[side][token] = [*below, token]
        return found

    def first_across(self, a: int, b: int) -> tuple[int, int] | None:
        """The two tokens that BPE first merges across the joint of a and b; None if it never does."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            rank = self.rank.get(left[i] * self.size + right[j], self.NEVER)
            grows_left = self.time[left[i + 1]] if i + 1 < len(left) else self.NEVER
            grows_right = self.time[right[j + 1]] if j + 1 < len(right) else self.NEVER
            # Of equal ranks the place further left goes first.
            if rank < grows_left and rank <= grows_right:
                return left[i], right[j]
            if grows_left == grows_right == self.NEVER:
                return None
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1


class WordMachine:
    """The deterministic transducer of a vocabulary's merges; it reads a word's bytes, the last one as the word's end.

    A state is the list of places where a token may have begun: for each, what was read since (a node of the tree of
    token spellings), the token before it, and how many tokens there are up to it beyond those already emitted. With a
    letter every place moves down the tree, and exactly one of the tokens that are then complete can follow the token
    before it: that one is the last token of what BPE makes of the word up to here, and a new place begins. A transition
    emits the tokens that all places that are left have in common, the end of a word emits the rest and leads back to the
    beginning. States are built from the merges when a transition is first taken. Beyond a bound on their number, all are
    dropped but those that words are in, so results never depend on the bound.
    """

    most_states, stepped = 150_000, 64
    END, NONE = 256, (1 << 20) - 1

    def __init__(self, name: str):
        self.merges = load_merges(name)
        if (self.merges.first == self.merges.last).any() or self.merges.size > self.NONE:
            raise ValueError("the word machine needs a vocabulary that marks the ends of words, of under 2 ** 20 tokens")
        self.joints = Joints(self.merges)
        self._spell()
        self._reset()

    def _spell(self) -> None:
        """The tree of the spellings of all tokens that BPE can leave."""
        letters = {t: (k,) for k, t in enumerate([*self.merges.first.tolist(), *self.merges.last.tolist()])}
        for token, (a, b) in self.joints.sides.items():
            letters[token] = letters[a] + letters[b]
        self.children: dict[int, int] = {}
        self.token_at, self.grows = [-1], [True]
        for token in self.joints.left_over:
            node = 0
            for letter in letters[token]:
                self.grows[node] = True
                to = self.children.setdefault(node << 9 | letter, len(self.grows))
                if to == len(self.grows):
                    self.grows.append(False)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = token

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.keys, self.targets, self.emits = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._number((self.NONE << 12,))

    def _number(self, places: tuple) -> int:
        found = self.numbers.setdefault(places, len(self.states))
        if found == len(self.states):
            self.states.append(places)
        return found

    def _transition(self, key: int) -> tuple[int, int]:
        """Target and emitted tokens of a state's step; a place is node << 32 | token before << 12 | tokens up to it."""
        state, letter = key >> 9, key & 511
        kept, last, count = [], -1, 0
        for place in self.states[state]:
            node = self.children.get(place >> 32 << 9 | letter)
            if node is None:
                continue
            token, before = self.token_at[node], place >> 12 & self.NONE
            if last < 0 <= token and (before == self.NONE or self.joints.first_across(before, token) is None):
                last, count = token, (place & 4095) + 1
            if self.grows[node]:
                kept.append(node << 32 | place & 0xFFFFFFFF)
        if letter >= self.END:
            return 0, count
        kept.append(last << 12 | count)
        least = min(place & 4095 for place in kept)
        return self._number(tuple(place - least for place in kept)), least

    def _add(self, keys: np.ndarray, steps: list[tuple[int, int]]) -> None:
        """Enters transitions, by ascending keys that are not there."""
        told = np.array(steps, np.int32).reshape(-1, 2)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.targets, self.emits = np.insert(self.keys, place, keys), np.insert(self.targets, place, told[:, 0]), np.insert(self.emits, place, told[:, 1])

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Where the transitions are held, -1 for those not built yet."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _keep(self, states: np.ndarray) -> np.ndarray:
        """Drops all states but these beyond the bound; returns their new numbers."""
        if len(self.states) <= self.most_states:
            return states
        used, back = np.unique(states, return_inverse=True)
        held = [self.states[s] for s in used.tolist()]
        self._reset()
        return np.array([self._number(places) for places in held], np.int64)[back]

    def count(self, words: pa.Array) -> np.ndarray:
        """Tokens of each distinct, non-empty word; all words go forward a letter at a time, long ones end alone."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        starts, ends = offsets[:-1], offsets[1:]
        letters = np.frombuffer(words.buffers()[2] or b"", np.uint8).astype(np.int16)
        letters[ends - 1] += self.END
        counts, state, rows = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        for k in range(self.stepped):
            rows = rows[ends[rows] - starts[rows] > k]
            if not len(rows):
                return counts
            state[rows] = self._keep(state[rows])
            key = state[rows] << 9 | letters[starts[rows] + k]
            at = self._find(key)
            if (at < 0).any():
                new = np.unique(key[at < 0])
                self._add(new, [self._transition(x) for x in new.tolist()])
                at = self._find(key)
            state[rows] = self.targets[at]
            counts[rows] += self.emits[at]
        rows = rows[ends[rows] - starts[rows] > self.stepped]
        # A long word may drop the states, so those that others wait in are held themselves.
        for row, places in [(row, self.states[s]) for row, s in zip(rows.tolist(), state[rows].tolist(), strict=True)]:
            counts[row] += self._finish(self._number(places), letters[starts[row] + self.stepped : ends[row]])
        return counts

    def _finish(self, state: int, letters: np.ndarray) -> int:
        total, known, new = 0, {}, {}
        for k in range(0, len(letters), 1 << 16):
            for letter in letters[k : k + (1 << 16)].tolist():
                key = state << 9 | letter
                step = known.get(key)
                if step is None:
                    at = int(self._find(np.array([key]))[0])
                    step = (int(self.targets[at]), int(self.emits[at])) if at >= 0 else new.setdefault(key, self._transition(key))
                    known[key] = step
                state, emitted = step
                total += emitted
                if len(self.states) > self.most_states:
                    state, known, new = int(self._keep(np.array([state]))[0]), {}, {}
        if new:
            keys = sorted(new)
            self._add(np.array(keys, np.int64), [new[x] for x in keys])
        return total


_machines: dict[str, WordMachine] = {}


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # Lower-casing is letter by letter: no final form of sigma.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(texts, name: str = WORD_BPE) -> np.ndarray:
    """The number of tokens of each text, as the library has it."""
    if name not in _machines:
        _machines[name] = WordMachine(name)
    machine = _machines[name]
    special = machine.merges.special
    held = strings(texts).to_pylist()
    counts = np.zeros(len(held), np.int64)
    parts, of = [], []
    for k, text in enumerate(held):
        if "<|" in text and any(s in text for s in special):
            for part, found in _parts(text, special):
                if found is not None:
                    counts[k] += 1
                else:
                    parts.append(_normal(part))
                    of.append(k)
        else:
            parts.append(_normal(text))
            of.append(k)
    if not parts:
        return counts
    joined = "\n".join(parts) + "\n"  # white space: no word reaches across
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = class_table()[points]
    begins = marks(classes)
    breaks = np.flatnonzero(begins | (classes == SPACE))
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(width)))
    data = joined.encode()
    # Every break begins a run: a word, or a white-space character. The text before the first break is empty.
    offsets = np.append(at[breaks], len(data)).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(breaks), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = runs.filter(pa.array(begins[breaks])).dictionary_encode()
    of_word = machine.count(coded.dictionary)
    emitted = np.zeros(len(breaks) + 1, np.int64)
    emitted[1:][begins[breaks]] = of_word[coded.indices.to_numpy()]
    total = np.cumsum(emitted)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    upto = total[np.searchsorted(breaks, ends)]
    np.add.at(counts, np.array(of), np.diff(upto, prepend=0))
    return counts


def count_documents(docs: DataFrame, name: str = WORD_BPE, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; null texts count as empty and have none.

    Special strings inside a text count as one token, as the library has them. Other columns are ignored; an empty
    table gives no rows. Memory is bounded by units of some 4 MB of text; one text is the least unit.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches):
        for table in units(batches, most=4 << 20):
            texts = strings(table["text"])
            n = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), n, pa.array(count_tokens(texts, name))], names=["doc_id", "n_bytes", "n_tokens"])

    found = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
