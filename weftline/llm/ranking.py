"""Ranked lexical search: the ten best documents of each item of a query set, by WAND in shards of the documents.

One pass over the texts writes, for each document, its number of terms and how often each term of the query set occurs in
it; document frequencies and lengths over all documents come from that table. A second pass gathers its rows into shards.
For each term of a shard it takes the maximal impact, and with it what the term can add to a score at most. An item's lists
are then walked in the order of that bound: a list is left unread once what is left cannot reach the item's heap
threshold, a document is a pivot only if the bounds of the lists that hold it reach it together, and pivots are scored from
the highest bound down, until none that is left can enter the heap. Heaps go on from shard to shard of a task, and those of
the tasks are merged by Spark. No bound discards a document that belongs to the ten: the result is exact.

The query set is asked in blocks of a bounded size, of which each is broadcast.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise, prepare
from .tokens import gather, strings, units

BEST = 10
#: Bounds of a block of the query set; what a block's items hold in terms is broadcast.
ITEMS_A_BLOCK, BYTES_A_BLOCK = 1_000, 4 << 20
#: A shard closes at so many documents or so many of their terms.
SHARD_DOCS, SHARD_TERMS = 1 << 14, 1 << 21
#: Bytes of text that are cut into terms at once.
UNIT = 8 << 20
#: Pivots that are scored before the threshold is looked at again.
PIVOTS = 64

# Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(df: int, n: int) -> int:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of a term that df of n documents hold."""
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (number of terms), and the numbers and counts of the vocabulary's terms in each row of docs."""
    rows = docs.select("doc_id", "text")
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = sent.value
        for table in units(batches, most=UNIT):
            texts = strings(table["text"])
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
            data = (texts.buffers()[2] or pa.py_buffer(b""))[at[0] : at[-1]].to_pybytes().translate(_FOLD)
            n, found, times, ends = [], [], [], [0]
            for a, b in zip(at, at[1:]):
                own = data[a - at[0] : b - at[0]].split()
                n.append(len(own))
                for term, tf in Counter(own).items():
                    if (k := known.get(term)) is not None:
                        found.append(k)
                        times.append(tf)
                ends.append(len(found))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, terms array<int>, times array<int>")


class Shard:
    """Documents in inverted form: for each term the rows that hold it, in order, with their impacts."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, length: int, vocabulary: int):
        m = 100 - 75 + 75 * n * total // max(1, length)
        row = np.repeat(np.arange(len(n)), np.diff(np.r_[0, ends]))
        order = np.argsort(term, kind="stable")
        self.docs, tf = row[order], tf[order].astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.sizes = np.bincount(term, minlength=vocabulary)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.most, self.rows = np.zeros(vocabulary, np.int64), len(n)
        held = np.flatnonzero(self.sizes)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impacts, self.begins[held])

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.begins[term], self.begins[term] + self.sizes[term])
        return self.docs[own], self.impacts[own]


class Heap:
    """The best (score, id) so far; of equal scores the smaller id is better, and no id is the worst."""

    def __init__(self, size: int = BEST):
        self.size, self.held, self.threshold = size, [], 1

    def add(self, found: list) -> None:
        worth = lambda e: (-e[0], e[1] is None, e[1] or 0)
        self.held = sorted(self.held + found, key=worth)[: self.size]
        if len(self.held) == self.size:
            self.threshold = max(1, self.held[-1][0])


def wand(shard: Shard, asked: np.ndarray, factors: np.ndarray, ids, heap: Heap) -> int:
    """Adds a shard's documents to an item's heap; asked are its terms, factors their weights times their repeats.

    Gives the number of documents that were scored.
    """
    bound = factors * shard.most[asked]
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    asked, factors, bound = asked[order], factors[order], bound[order]
    left = np.cumsum(bound[::-1])[::-1]  # what a list and those after it can add together
    walked = int(np.searchsorted(-left, -heap.threshold, "right"))  # lists that can begin a pivot
    if not walked:
        return 0
    # Bounds of the documents that these lists hold.
    reach = np.zeros(shard.rows, np.int64)
    own = asked[:walked]
    np.add.at(reach, gather(shard.begins[own], shard.sizes[own], shard.docs), np.repeat(bound[:walked], shard.sizes[own]))
    rest = left[walked] if walked < len(asked) else 0
    pivots = np.flatnonzero((reach > 0) & (reach + rest >= heap.threshold))
    for k in range(walked, len(asked)):  # lists that only add to pivots; these fall away as the rest shrinks
        docs, _ = shard.list_of(asked[k])
        place = np.minimum(np.searchsorted(docs, pivots), len(docs) - 1)
        reach[pivots[docs[place] == pivots]] += bound[k]
        pivots = pivots[reach[pivots] + (left[k + 1] if k + 1 < len(asked) else 0) >= heap.threshold]
    pivots = pivots[np.argsort(-reach[pivots], kind="stable")]
    scored = 0
    for at in range(0, len(pivots), PIVOTS):
        some = pivots[at : at + PIVOTS]
        some = np.sort(some[reach[some] >= heap.threshold])
        if not len(some):
            break
        score = np.zeros(len(some), np.int64)
        for term, factor in zip(asked.tolist(), factors.tolist()):
            docs, impacts = shard.list_of(term)
            place = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            score += factor * np.where(docs[place] == some, impacts[place], 0)
        scored += len(some)
        enter = np.flatnonzero(score >= heap.threshold)
        heap.add([(int(score[k]), ids[some[k]]) for k in enter.tolist()])
    return scored


def shards(batches, total: int, length: int, vocabulary: int, most_docs: int, most_terms: int):
    """(ids, Shard) of the rows that count_terms gives, as they come."""
    held, docs, size = [], 0, 0
    for batch in _ended(batches):
        if batch is not None and batch.num_rows:
            held.append(batch)
            docs += batch.num_rows
            size += len(batch.column("terms").flatten())
        if held and (batch is None or docs >= most_docs or size >= most_terms):
            table = pa.Table.from_batches(held).combine_chunks()
            column = table["terms"].chunk(0)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            flat = (table[c].chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "times"))
            yield table["doc_id"].to_pylist(), Shard(table["n"].to_numpy(), ends, *flat, total, length, vocabulary)
            held, docs, size = [], 0, 0


def _ended(batches):
    yield from batches
    yield None


def search(docs: DataFrame, items: DataFrame, best: int = BEST, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score: for each item the `best` documents of docs with a score above 0.

    A null text has no terms, whether a document's or an item's; an item without terms, or whose terms no document
    holds, has no rows. Equal scores rank by ascending doc_id, a null id last. Every row of docs is a document, so
    rows that repeat an id rank each. Rows of items that repeat both id and text are one item; an id with several texts
    is asked with each of them. Empty tables give no rows. Other columns do not matter, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // items_a_block), -(-size // BYTES_A_BLOCK))
    found = [_search(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), best, shard_docs, shard_terms) for k in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        kinds = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.select('doc_id').dtypes)['doc_id']}, score long"
        return spark.createDataFrame([], kinds)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(docs: DataFrame, block: DataFrame, best: int, shard_docs: int, shard_terms: int) -> DataFrame | None:
    """search() of a block of items, which the driver reads: its size is bounded."""
    spark = docs.sparkSession
    asked, vocabulary = [], {}
    for item_id, text in block.collect():
        own = Counter(terms(text.encode("utf-8", "surrogatepass")))
        if own:
            asked.append((item_id, [vocabulary.setdefault(t, len(vocabulary)) for t in own], list(own.values())))
    if not asked:
        return None
    table = materialise(count_terms(docs, vocabulary))
    total, length = table.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most a row for each term of the block.
    df = {r.term: r["count"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator()}
    weights = np.array([weight(df.get(k, 0), total) for k in range(len(vocabulary))], np.int64)
    lists = [(np.array(t, np.int64), weights[t] * np.array(repeats, np.int64)) for _, t, repeats in asked]
    sent = spark.sparkContext.broadcast(lists)
    size = len(vocabulary)

    def run(batches):
        heaps = [Heap(best) for _ in sent.value]
        for ids, shard in shards(batches, total, length, size, shard_docs, shard_terms):
            for (own, factors), heap in zip(sent.value, heaps):
                wand(shard, own, factors, ids, heap)
        rows = [(k, i, s) for k, heap in enumerate(heaps) for s, i in heap.held]
        if rows:
            k, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, kind), pa.array(s, pa.int64())], names=["item", "doc_id", "score"])

    of = table.schema["doc_id"].dataType
    kind = pa.int64() if isinstance(of, T.LongType) else pa.int32() if isinstance(of, T.IntegerType) else pa.string()
    merged = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    heads = table.mapInArrow(run, f"item int, doc_id {of.simpleString()}, score long")
    ranked = materialise(heads.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= best))
    discard(table)
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _, _) in enumerate(asked)], T.StructType([T.StructField("item", T.IntegerType()), block.schema["item_id"]]))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
