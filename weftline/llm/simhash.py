"""SimHash near-deduplication over vantage-point trees, for exact pairs.

1. Each text gets a 64-bit fingerprint of its word shingles; equal fingerprints become one point.
2. A fingerprint is read in bands of bits. Two that differ in 4 bits at most differ in one bit at most in one of four
   bands, so each band has a tree of its own and a search radius of one. Trees are placed by a sample: at a node, points
   nearer to its vantage point than the sample's median go inside. A point lives in one shard of each tree, and visits
   every later shard that may hold points within the radius: by the triangle inequality it leaves out a side only where
   its own distance to the vantage point differs from the border by more than the radius. Of two points that are linked
   in a band the one in the earlier shard visits the other, so no pair is lost.
3. A shard is dealt out as a grid of blocks of its own points and blocks of all points that are there, so a task has a
   bounded number of rows whatever the shard. In it a finer tree over whole fingerprints prunes in the same way; what is
   left is compared bit by bit. Links become a forest at once: a task returns at most one edge for each of its rows.
4. The forests of all tasks are contracted to components, round by round, in tables of the shared folder.

similar_documents() compares whole shingle sets. Fingerprints and the trees propose links, which are verified; what they
leave apart is found by prefixes of the sets.

Distances in a band of 16 bits crowd around 8, so a level of a tree prunes about a third of the visits: they grow with
about the power 1.45 of the number of distinct fingerprints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, prepare

SEED, WORDS, RADIUS = 42, 4, 4
#: Bands of a fingerprint, each with a tree of its own.
BANDS = 4
#: The points that a shard should hold, and the most rows of a block; a task has two blocks.
SHARD, TASK_ROWS = 32_768, 32_768
#: The sample that places the vantage points: so many, or a few for each shard up to a bound. It changes the work only.
SAMPLE, SAMPLE_A_SHARD, MOST_SAMPLE = 4_096, 8, 1 << 20
LEAF = 128
#: Rows that are routed at once.
ROUTED = 8_192
_BLOCK = 1 << 20
#: Similar texts: words of a shingle, and the least share of common distinct shingles. Rows of one shingle that meet all
#: others of it in a task.
SIMILAR_WORDS, SIMILARITY, SIMILAR_SHARD = 5, 0.8, 4_096
#: Frequent shingles of a sample of texts, which come last in the order of shingles. The order changes the work only.
FREQUENT, FREQUENT_SAMPLE = 1 << 18, 16_384
#: From so many texts with a shingle on, they are compared with a few of them first: a text with so many at most.
CROWD, ASKED = 8, 3
#: Rows of one shingle that a block of its crowd has.
CROWD_ROWS = 512
#: Words of 64 bits that tell by parity which shingles a set has.
PARITIES = 8
_SLICE = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS):
    """The XXH64 hashes of a text's word shingles, repeats included, in slices of bounded length.

    A-Z are lower-cased; words are what is between ASCII white space; fewer words than a shingle's make one shingle.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    ends = ends.tolist()[min(words, len(found)) - 1 :]
    joined = b" ".join(found)
    for k in range(0, len(ends), _SLICE):
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + _SLICE], ends[k : k + _SLICE])], "<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of the hashes of all shingles (repeats included) a bit is 1 if set in over half; no words: zero."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        ones += _bit_counts(hashes)
        n += len(hashes)
    return _majority(ones, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row; null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def far(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


@dataclass
class Node:
    vantage: int
    border: int
    inner: Node | int
    outer: Node | int


def build(sample: np.ndarray, depth: int, seed: int = 0) -> Node | int:
    """A tree whose leaves are numbered from left to right; a part that no vantage point can split is one leaf."""
    rng, leaves = np.random.default_rng(seed), iter(range(1 << 62))

    def grow(points, left):
        if not left or len(points) < 2:
            return next(leaves)
        tried = rng.choice(points, min(8, len(points)), replace=False)
        # The widest spread of distances prunes best.
        vantage = max(tried, key=lambda v: (float(far(points, v).std()), int(v)))
        d = far(points, vantage)
        border = int(np.median(d))
        inside = d <= border
        if inside.all():
            border = int(d.max()) - 1
            inside = d <= border
        if inside.all() or not inside.any():
            return next(leaves)
        return Node(int(vantage), border, grow(points[inside], left - 1), grow(points[~inside], left - 1))

    return grow(np.sort(sample), depth)


def route(tree: Node | int, points: np.ndarray, radius: int = RADIUS, later: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of each point in its own shard and in those that it visits: the later ones, or all."""
    out = []

    def go(node, rows, home):
        if not len(rows):
            return
        if not isinstance(node, Node):
            out.append((rows, np.full(len(rows), node, np.int64), home))
            return
        d = far(points[rows], np.uint64(node.vantage)).astype(np.int64)
        near = d - radius <= node.border
        go(node.inner, rows[near], home[near] & (d[near] <= node.border))
        wide = d + radius > node.border
        go(node.outer, rows[wide], home[wide] & (d[wide] > node.border))

    go(tree, np.arange(len(points)), np.ones(len(points), bool))
    rows, shards, home = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    if not later:
        return rows, shards, home
    own = np.zeros(len(points), np.int64)
    own[rows[home]] = shards[home]
    kept = shards >= own[rows]
    return rows[kept], shards[kept], home[kept]


class Forest:
    """Sets of numbers 0 to n - 1, each named by its least member."""

    def __init__(self, n: int):
        self.parent, self.held, self.count = np.arange(n), [], 0

    def link(self, a: np.ndarray, b: np.ndarray):
        new = self.parent[a] != self.parent[b]
        if new.any():
            self.held.append((a[new], b[new]))
            self.count += int(new.sum())
            if self.count > 100_000:
                self.settle()

    def settle(self) -> np.ndarray:
        while self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.count = [], 0
            while True:
                x, y = self.parent[a], self.parent[b]
                differ = x != y
                if not differ.any():
                    break
                a, b, x, y = a[differ], b[differ], x[differ], y[differ]
                np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = self.parent[self.parent]
                    if (up == self.parent).all():
                        break
                    self.parent = up
        return self.parent


def link_shard(points: np.ndarray, home: np.ndarray, radius: int = RADIUS, seed: int = 0, asking: np.ndarray | None = None) -> np.ndarray:
    """The least row that each row is linked with, through links between home rows and those asking (all, if not given)."""
    forest, rng = Forest(len(points)), np.random.default_rng(seed)
    stack = [(np.flatnonzero(home), np.arange(len(points)) if asking is None else asking)]
    while stack:
        own, asking = stack.pop()
        if not len(own) or not len(asking):
            continue
        if len(own) > LEAF:
            values = points[own]
            vantage = values[rng.integers(len(own))]
            d = far(values, vantage).astype(np.int64)
            border = int(np.median(d))
            inside = d <= border
            if inside.all():
                border = int(d.max()) - 1
                inside = d <= border
            if inside.any() and not inside.all():
                # All within half the radius of the vantage point are linked with each other: one forest edge each.
                ball = own[d <= radius // 2]
                if len(ball) > 1:
                    forest.link(ball[1:], np.full(len(ball) - 1, ball[0]))
                e = far(points[asking], vantage).astype(np.int64)
                stack.append((own[inside], asking[e - radius <= border]))
                stack.append((own[~inside], asking[e + radius > border]))
                continue
        width = max(1, _BLOCK // max(1, min(len(own), _BLOCK)))
        for j in range(0, len(own), _BLOCK):
            part = own[j : j + _BLOCK]
            for k in range(0, len(asking), width):
                some = asking[k : k + width]
                at, to = np.nonzero(far(points[some][:, None], points[part][None, :]) <= radius)
                at, to = some[at], part[to]
                forest.link(at[at != to], to[at != to])
    return forest.settle()


def band(points: np.ndarray, k: int, bands: int) -> np.ndarray:
    """The k-th of so many parts of each fingerprint."""
    first, last = 64 * k // bands, 64 * (k + 1) // bands
    return points >> np.uint64(first) & np.uint64((1 << last - first) - 1)


def plant(points: DataFrame, n: int, shard: int, bands: int, sample: int = SAMPLE) -> list[Node | int]:
    """For each band a tree that splits n points (fp) into shards of about the given size, over a sample of them; a
    single shard needs no bands."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    if not depth:
        return [0]
    wanted = min(MOST_SAMPLE, max(sample, SAMPLE_A_SHARD << depth))
    share = min(1_000_000_000, int(1_000_000_000 * wanted / n) + 1)
    some = points.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1_000_000_000)) < share).select("fp").limit(2 * wanted).toArrow()["fp"].to_numpy().view(np.uint64)
    return [build(band(some, k, bands), depth, seed=k) for k in range(bands)]


_EDGE = "a_rep long, a_fp long, b_rep long, b_fp long"
#: What a row is to its task: one that asks, one that is asked, or both.
_ASKS, _ASKED, _BOTH = 0, 1, 2


def _edges(frame: pd.DataFrame, least: np.ndarray) -> pd.DataFrame:
    fps, reps = frame["fp"].to_numpy(), frame["rep"].to_numpy()
    tied = np.flatnonzero(least != np.arange(len(least)))
    up = least[tied]
    return pd.DataFrame({"a_rep": reps[tied], "a_fp": fps[tied], "b_rep": reps[up], "b_fp": fps[up]})


def grid(routed: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Deals the rows (band, shard, home, rep, fp) of a table out to tasks: adds part, of the asked, asks, of those that
    ask, and role. A pair of an asked row and one that asks meets in one task; a task has about 2 * rows at most."""
    held = routed.groupBy("band", "shard").agg(F.count(F.when(F.col("home"), 1)).alias("own"), F.count(F.lit(1)).alias("every")).where("own > 0")
    blocks = lambda c: F.ceil(F.col(c) / rows).cast("int")
    dealt = routed.join(held.select("band", "shard", blocks("own").alias("parts"), blocks("every").alias("askers")), ["band", "shard"])
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("q", F.pmod(F.xxhash64("fp", F.lit("asks")), F.col("askers")).cast("int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = dealt.where("home").select("band", "shard", F.col("p").alias("part"), each("askers").alias("asks"), "q", "rep", "fp")
    asked = asked.select("band", "shard", "part", "asks", F.when(F.col("q") == F.col("asks"), _BOTH).otherwise(_ASKED).alias("role"), "rep", "fp")
    asking = dealt.select("band", "shard", each("parts").alias("part"), F.col("q").alias("asks"), F.lit(_ASKS).alias("role"), "rep", "fp", "home", "p")
    return asked.unionByName(asking.where("NOT (home AND part = p)").drop("home", "p"))


def links(points: DataFrame, radius: int = RADIUS, bands: int = BANDS, sample: int = SAMPLE, shard: int = SHARD, rows: int = TASK_ROWS) -> DataFrame:
    """Edges a_rep, a_fp, b_rep, b_fp (b before a) that connect all points (rep, fp) with linked fingerprints, a table."""
    trees = plant(points, points.count(), shard, bands, sample)

    def visit(batches):
        for table in _joined(batches, ROUTED):
            fps = table["fp"].to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                at, shards, home = route(tree, band(fps, k, bands), radius // bands)
                taken = table.take(pa.array(at)).combine_chunks()
                columns = [pa.array(np.full(len(at), k, np.int32)), pa.array(shards), pa.array(home), *(taken[c].combine_chunks() for c in ("rep", "fp"))]
                yield pa.RecordBatch.from_arrays(columns, names=["band", "shard", "home", "rep", "fp"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rep", "fp"], ignore_index=True)
        role = frame["role"].to_numpy()
        least = link_shard(frame["fp"].to_numpy().view(np.uint64), role != _ASKS, radius, asking=np.flatnonzero(role != _ASKED))
        return _edges(frame, least)

    routed = materialise(points.select("rep", "fp").mapInArrow(visit, "band int, shard long, home boolean, rep long, fp long"))
    out = materialise(grid(routed, rows).groupBy("band", "shard", "part", "asks").applyInPandas(join, _EDGE).distinct())
    discard(routed)
    return out


def _joined(batches, rows: int):
    """Arrow batches as tables of so many rows at least, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    parts = [np.unique(x) for x in shingle_hashes(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def parities(members: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITIES classes of hashes whether a set has an odd number of them, in words of 64 bits.

    Where two sets differ in k members, their parities differ in k bits at most.
    """
    odd = np.bincount((members % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def share(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common members of two shingle sets; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def prefix(members: np.ndarray, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set in an order of all shingles, so many that similar sets have one of them in common.

    The order is that of the hashes; after all others come the frequent ones (ascending), by their ranks.
    """
    n = len(members) - int(np.ceil(similarity * len(members) - 1e-9)) + 1 if len(members) else 0
    at = np.searchsorted(frequent, members)
    often = np.zeros(len(members), bool)
    inside = at < len(frequent)
    often[inside] = frequent[at[inside]] == members[inside]
    rare = members[~often]
    if n <= len(rare):
        return rare[:n]
    late = members[often]
    return np.concatenate([rare, late[np.argsort(rank[at[often]])]])[:n]


def _frequent(rows: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample have, ascending, and their ranks, the most frequent last."""
    n = rows.count()
    drawn = int(1_000_000 * sample / max(1, n)) + 1
    some = rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) < drawn).select("text").limit(2 * sample)

    def run(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], names=["shingle"])

    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1")
    held = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(held)
    return held[order], len(held) - order


_PARITY = [f"m{k}" for k in range(PARITIES)]


def shingle_prefixes(docs: DataFrame, words: int, similarity: float, sample: int = FREQUENT_SAMPLE) -> DataFrame:
    """doc_id, size, digest of the set of distinct shingles, its prefix (binary), its fingerprint sim and its parities m0
    to m7 for every row; null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    frequent, rank = _frequent(rows, words, sample)

    def run(batches):
        for batch in batches:
            size, digest, first, sim, odd = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                members = shingle_set(text, words)
                size.append(len(members))
                digest.append(_digest(members))
                first.append(prefix(members, similarity, frequent, rank).tobytes())
                sim.append(_majority(sum((_bit_counts(members[k : k + _SLICE]) for k in range(0, len(members), _SLICE)), np.zeros(64, np.int64)), len(members)))
                odd.append(parities(members))
            bits = np.array(odd, np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.binary()),
                 pa.array(np.array(sim, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITIES))],
                names=["doc_id", "size", "digest", "prefix", "sim", *_PARITY])

    kinds = ", ".join(f"{m} long" for m in ("sim", *_PARITY))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, size long, digest binary, prefix binary, {kinds}")


def _may_be_similar(x: str, y: str, similarity: float):
    """A condition that all similar sets meet, by the sizes and parities in columns of two prefixes."""
    differ = sum((F.bit_count(F.col(x + m).bitwiseXOR(F.col(y + m))) for m in _PARITY), F.lit(0))
    return differ <= (F.col(f"{x}size") + F.col(f"{y}size")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _digest(members: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(members.tobytes())


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b: fp of points) whose distinct shingles, compared as sets, are common to that share."""
    both = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    asked = materialise(both.join(points.select("fp", "rep", "digest"), "fp"))
    # Sets are made anew from the texts of the pairs alone. Rows that repeat an id may differ: the digest tells.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rep"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            found = [shingle_set(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["rep", "digest", "members"])

    made = rows.join(asked.select("rep").distinct(), "rep", "left_semi").mapInArrow(run, "rep long, digest binary, members binary")
    sets = materialise(made.join(asked, ["rep", "digest"]).groupBy("fp").agg(F.first("members").alias("members")))
    discard(asked)

    def compare(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [share(*(np.frombuffer(z[k].as_buffer(), np.uint64) for z in (x, y))) >= similarity for k in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("fp").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))
    out = materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    discard(sets)
    return out


def _crowds(shared: DataFrame) -> DataFrame:
    """token, fp, size and weight of the rows of frequent shingles; the weight tells how frequent a text's are."""
    crowds = shared.where(F.col("n") >= CROWD).select("token", "fp", "size", "n")
    return crowds.join(crowds.groupBy("fp").agg((F.sum("n") / F.max("size")).alias("weight")), "fp")


def _crowded(crowds: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts with a few of those that have many shingles in common with them.

    Centres of a shingle are the text whose shingles are the most frequent for its size, which is most like the others
    of a group of copies, and one at random.
    """
    step = float(-np.log(similarity))
    out = None
    for shift in (0.0, 0.5):
        # Extremes combine before they meet, and rows join them in blocks, so a hot shingle fills no task.
        blocks = F.ceil(F.col("n") / CROWD_ROWS).cast("long")
        rows = crowds.withColumn("class", F.floor(F.log("size") / step + shift)).withColumn("block", F.pmod(F.xxhash64("fp"), blocks))
        centres = [F.max(F.struct(of.alias("h"), "fp"))["fp"] for of in (F.col("weight"), F.xxhash64("fp"))]
        found = rows.groupBy("token", "class").agg(F.array_distinct(F.array(*centres)).alias("centres"), F.max("n").alias("n"))
        found = found.select("token", "class", "centres", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
        some = rows.join(found, ["token", "class", "block"]).select("fp", "size", F.explode("centres").alias("centre"))
        out = some if out is None else out.unionByName(some)
    out = out.where("fp <> centre").groupBy("fp", "size", "centre").count()
    out = out.where(F.col("count") * 2 >= F.col("size") * (1 - similarity))  # both shifts count, so a quarter to half of the prefix
    # The centres of a text are no more than the shingles in its prefix.
    most = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), F.xxhash64("centre").alias("h"), "centre"))), 1, ASKED)
    out = out.groupBy("fp").agg(most.alias("most")).select("fp", F.explode("most.centre").alias("centre"))
    return out.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))


def _proposed(points: DataFrame, shared: DataFrame, similarity: float, **options) -> DataFrame:
    """Pairs (a, b) of texts that may be similar: those that fingerprints link, and texts in crowds with a few of them.

    A text is in a bounded number of pairs that it proposes, so a group of copies costs its size and not its square.
    """
    alike = materialise(points.groupBy("sim").agg(F.min("fp").alias("rep")))
    equal = points.select("sim", "fp").join(alike, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    trees = links(alike.select("rep", F.col("sim").alias("fp")), **options)
    linked = trees.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))
    crowds = materialise(_crowds(shared))
    pairs = materialise(equal.unionByName(linked).unionByName(_crowded(crowds, similarity)).distinct())
    discard(crowds)
    discard(alike)
    discard(trees)
    for x in "ab":
        pairs = pairs.join(points.select(F.col("fp").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("size", *_PARITY))), x)
    return pairs.where(_may_be_similar("a_", "b_", similarity)).select("a", "b")


def candidates(shared: DataFrame, similarity: float, shard: int) -> DataFrame:
    """Pairs (a, b) of texts in different groups (label) that may be similar: every pair that is one is among them.

    shared has for each shingle (token) its greatest group (main) and the number of rows outside it (others). Two texts
    of the greatest group need no comparison, so the rows outside it meet all rows: a group of copies, however large,
    costs its size and not its square. They are dealt out in blocks, each of which meets all rows.

    Texts meet at a shingle that is in both prefixes, if their sizes and parities allow it. Before the first one that
    they share, at places p and q, they have nothing in common, so they share no more than the lesser rest. Of all
    common shingles those that are in one's prefix but not in the other's come after the latter, so beyond the common
    ones in the prefixes no more are left than follow a prefix.
    """
    blocks = F.ceil(F.col("others") / shard).cast("long")
    told = ("fp", "size", "place", "label", *_PARITY)
    x = shared.where("label <> main").select("token", F.pmod(F.xxhash64("fp"), blocks).alias("block"), *(F.col(c).alias(f"x_{c}") for c in told))
    y = shared.where("others > 0").select(
        "token", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), (F.col("label") == F.col("main")).alias("y_main"),
        *(F.col(c).alias(f"y_{c}") for c in told))
    # Of two rows outside the greatest group each meets the other; one of the meetings counts.
    met = (F.col("x_label") != F.col("y_label")) & F.expr("y_main OR x_fp < y_fp")
    less, more = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    met &= (less >= more * similarity - 1e-6) & _may_be_similar("x_", "y_", similarity)
    rest = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    found = x.join(y, ["token", "block"]).where(met).select(
        F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b"), (less + more).alias("both"), more.alias("more"), rest.alias("rest"))
    found = found.groupBy("a", "b", "both", "more").agg(F.count(F.lit(1)).alias("count"), F.max("rest").alias("rest"))
    least = F.col("both") * (similarity / (1 + similarity)) - 1e-6
    found = found.where((F.col("rest") >= least) & (F.col("count") + F.ceil(F.col("more") * similarity - 1e-9) - 1 >= least))
    return found.select("a", "b")


def main_groups(shared: DataFrame) -> DataFrame:
    """token, main (the group, by label, that has the most rows of it) and others (its rows outside that group)."""
    by = shared.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    return by.groupBy("token").agg(F.max(F.struct("m", "label"))["label"].alias("main"), (F.sum("m") - F.max("m")).alias("others"))


def similar_links(docs: DataFrame, similarity: float, words: int, sample: int = FREQUENT_SAMPLE, shard: int = SIMILAR_SHARD, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, size, digest), their distinct shingle sets as points (fp, rep, size, digest), and edges that
    connect all points which share enough of their shingles.

    Texts that fingerprints link or that have a frequent shingle are compared with a few of each other first, so that a
    group of near copies becomes one component; after that only pairs between components are looked at.
    """
    found = materialise(shingle_prefixes(docs, words, similarity, sample))
    grouped = found.groupBy("size", "digest").agg(
        F.coalesce(F.min("doc_id").cast("long"), F.lit(_LAST)).alias("rep"), *(F.first(c).alias(c) for c in ("prefix", "sim", *_PARITY)))
    points = materialise(grouped.withColumn("fp", F.monotonically_increasing_id()))

    def tokens(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            times = np.array([len(x) for x in found], np.int64)
            for k in range(0, len(found), 100):
                some = times[k : k + 100]
                taken = batch.select(["fp", "size"]).take(pa.array(np.repeat(np.arange(k, k + len(some)), some)))
                place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                columns = [pa.array(np.concatenate(found[k : k + 100])), *taken.columns, pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "fp", "size", "place"])

    # Rows of a shingle are counted before they meet, and joined from tables, so that one with a third of them is split.
    each = materialise(points.select("fp", "size", "prefix").mapInArrow(tokens, "token long, fp long, size long, place int"))
    times = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(each.join(times, "token"))
    discard(each)
    near = materialise(_proposed(points, shared, similarity, **options))
    first = verified(near, points, docs, words, similarity)
    discard(near)
    labels = components(first)
    told = materialise(points.select("fp", *_PARITY).join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    discard(labels)
    # Shingles of one component only are left out before the parities join.
    placed = materialise(shared.join(told.select("fp", "label"), "fp"))
    discard(shared)
    apart = placed.join(main_groups(placed).where("others > 0"), "token")
    named = materialise(apart.drop("label").join(told, "fp"))
    discard(placed)
    discard(told)
    rest = materialise(candidates(named, similarity, shard))
    discard(named)
    second = verified(rest, points, docs, words, similarity)
    discard(rest)
    a, b = (points.select(F.col("fp").alias(x), F.col("rep").alias(f"{x}_rep")) for x in "ab")
    edges = first.unionByName(second).join(a, "a").join(b, "b")
    return found, points, edges.select("a_rep", F.col("a").alias("a_fp"), "b_rep", F.col("b").alias("b_fp"))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of the edges (a, b), a table in the shared folder.

    Each round maps every node to the least of its neighbours and itself, follows that map four times, and carries the
    edges over to the images. Nodes that are no local minimum vanish, so rounds grow with the logarithm of the longest
    chain. Nothing is collected.
    """
    spark = edges.sparkSession
    live = materialise(edges.where(F.col("a") != F.col("b")).distinct())
    labels = None
    while True:
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = materialise(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        for _ in range(2):
            up = step.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = materialise(step.join(up, "to").select("node", F.col("top").alias("to")))
            discard(step)
            step = jumped
        if labels is None:
            grown = step.select("node", F.col("to").alias("label"))
        else:
            up = step.select(F.col("node").alias("label"), F.col("to").alias("top"))
            grown = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        grown = materialise(grown)
        a = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = live.join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
        moved = materialise(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        for old in (live, step, labels):
            if old is not None:
                discard(old)
        live, labels = moved, grown
        if live.isEmpty():
            discard(live)
            return labels


_LAST = (1 << 63) - 1


def _labelled(points: DataFrame, edges: DataFrame) -> DataFrame:
    """rep, fp and component_id of every point."""
    pair = lambda x: F.struct(F.col(f"{x}_rep").alias("rep"), F.col(f"{x}_fp").alias("fp")).alias(x)
    labels = components(edges.select(pair("a"), pair("b")))
    tops = labels.select(F.col("node.rep").alias("rep"), F.col("node.fp").alias("fp"), F.col("label.rep").alias("top"))
    out = materialise(points.join(tops, ["rep", "fp"], "left").select("rep", "fp", F.nullif(F.coalesce("top", "rep"), F.lit(_LAST)).alias("component_id")))
    discard(labels)
    return out


def near_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) for every row of docs.

    Null texts count as empty; texts without words share the fingerprint zero and are linked like any others. Rows
    that repeat an id are all returned. Null ids count as larger than all others; a component of them alone has a null
    component_id. Other columns are ignored; an empty table gives no rows. The document ids must be whole numbers.
    """
    found = materialise(fingerprints(docs, words))
    points = materialise(found.groupBy("fp").agg(F.coalesce(F.min("doc_id").cast("long"), F.lit(_LAST)).alias("rep")).select("rep", "fp"))
    edges = links(points, radius)
    groups = _labelled(points, edges).select("fp", "component_id")
    discard(points)
    discard(edges)
    # A fingerprint with a third of all rows is split by the adaptive skew join: both sides come straight from tables.
    out = found.join(groups, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (least doc_id reachable) for every row of docs, over links between texts that share at
    least `similarity` of their distinct word shingles. All such pairs are linked, and no others: sets are compared by
    the shingles' 64-bit hashes.

    Nulls, repeated ids and other columns are treated as by near_dedup.
    """
    found, points, edges = similar_links(docs, similarity, words)
    groups = _labelled(points.select("rep", "fp"), edges)
    named = materialise(points.select("rep", "fp", "size", "digest").join(groups, ["rep", "fp"]).select("size", "digest", "component_id"))
    discard(points)
    discard(groups)
    return found.select("doc_id", "size", "digest").join(named, ["size", "digest"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that are not similar to one with a smaller id, over any number of links, with all their columns.

    Rows without an id stay; rows that repeat an id stay or go together. Null texts count as empty, and texts without a
    shingle are similar to none but their like. Other columns may have any names; an empty table gives no rows.
    """
    gone = similar_documents(docs, words, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
