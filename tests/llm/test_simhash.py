import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weftline.llm import simhash as S


def brute(points, radius=4):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(S.far(points[i + 1 :], points[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(points))])


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    near = [x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for x in base[:150] for k in (1, 3, 4, 5)]
    cluster = [base[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(300)]
    return np.unique(np.concatenate([base, near, cluster]).astype(np.uint64))


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(rows):
    for text in ["", None, " \t ", "One", "a b c", "A b\tC\nd e", "É\x85x y z é", "x " * 70_000, *(t for _, t in rows[:40])]:
        assert S.fingerprint(text) == slow_fingerprint(text)


def test_one_shard(points):
    assert (S.link_shard(points, np.ones(len(points), bool)) == brute(points)).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 7])
def test_shards_lose_no_pair(points, depth):
    tree = S.build(np.random.default_rng(1).choice(points, 200, replace=False), depth)
    rows, shards, home = S.route(tree, points)
    assert sorted(rows[home]) == list(range(len(points)))
    forest = S.Forest(len(points))
    for shard in np.unique(shards):
        own = np.sort(rows[shards == shard])
        forest.link(own, own[S.link_shard(points[own], np.isin(own, rows[home & (shards == shard)]))])
    assert (forest.settle() == brute(points)).all()


def test_bands_lose_no_pair(points):
    for bands in (2, 4, 5):
        forest = S.Forest(len(points))
        for k in range(bands):
            parts = S.band(points, k, bands)
            tree = S.build(np.random.default_rng(k).choice(parts, 200, replace=False), 4, seed=k)
            rows, shards, home = S.route(tree, parts, 4 // bands)
            for shard in np.unique(shards):
                own = np.sort(rows[shards == shard])
                forest.link(own, own[S.link_shard(points[own], np.isin(own, rows[home & (shards == shard)]))])
        assert (forest.settle() == brute(points)).all()
        assert (sum(S.band(points, k, bands).astype(object) << 64 * k // bands for k in range(bands)) == points.astype(object)).all()


@pytest.mark.parametrize("n", [3_000, 6_000, 12_000])
def test_tasks_have_bounded_rows(spark, n):
    """One shard with half of all points, which all others visit: the largest task stays the same as the input grows."""
    routed = spark.range(n).selectExpr("0 AS band", "CAST(0 AS long) AS shard", "id % 2 = 0 AS home", "id AS rep", "id AS fp")
    dealt = S.grid(routed, rows=500).groupBy("band", "shard", "part", "asks").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    assert dealt[0] < 1_300 and dealt[1] == -(-n // 1_000) * -(-n // 500)


def test_parities_bound_differences():
    rng = np.random.default_rng(8)
    for n, k in ((10, 3), (400, 40), (3_000, 100)):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 64, k, dtype=np.uint64)]))
        assert 0 < int(np.bitwise_count((S.parities(a) ^ S.parities(b)).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_degenerate_trees():
    same = np.full(50, 7, np.uint64)
    assert S.build(same, 5) == 0
    assert (S.link_shard(same, np.ones(50, bool)) == 0).all()
    assert len(S.link_shard(np.zeros(0, np.uint64), np.zeros(0, bool))) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.label for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def check(df, rows, **options):
    prints = np.array([S.fingerprint(t) for _, t in rows], np.uint64)
    root = brute(prints)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((repr(i), format(int(p), "016x"), repr(least.get(r))) for (i, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in S.near_dedup(df).collect()) == want


def test_documents(documents, rows):
    check(documents, rows)


def test_many_shards(documents, rows, monkeypatch):
    links = S.links
    monkeypatch.setattr(S, "links", lambda points, radius: links(points, radius, sample=64, shard=20, rows=10))
    check(documents, rows)


def test_odd_rows(odd):
    check(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert S.near_dedup(odd.limit(0)).count() == 0
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 3, 5, None, 7, 7, 9, 10]))


def shingle_set(text, words=5):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def edited(rng, words, share):
    """A copy in which some words are replaced."""
    return " ".join(f"new{rng.integers(1 << 40)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("shard", [10_000, 16])
def test_similar_documents(spark, monkeypatch, shard):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(40):
        words = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(60, 900)))]
        texts += [" ".join(words), *(edited(rng, words, s) for s in (0.004, 0.008, 0.2))]
    big = [f"w{i}" for i in range(400)]
    texts += [edited(rng, big, 0.004) for _ in range(150)] + ["", None, "a b", "a b", "a c"]
    links = S.similar_links
    monkeypatch.setattr(S, "similar_links", lambda p, s, r: links(p, s, r, sample=64, shard=shard))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    sets = [shingle_set(t) for t in texts]
    share = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i in range(len(texts)):
        for j in range(i):
            s = share(sets[i], sets[j])
            if s >= 0.9:
                assert got[i] == got[j], (i, j, s)
    for i, c in got.items():
        assert c == i or max(share(sets[i], sets[j]) for j in range(len(texts)) if j != i and got[j] == c) > 0.7
    kept = sorted(r.doc_id for r in S.keep_one(df).collect())
    assert kept == sorted({c for c in got.values()})


def test_similar_odd_rows(odd):
    assert S.similar_documents(odd).count() == odd.count()
    assert S.similar_documents(odd.limit(0)).count() == 0


def exact_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_links_are_those_of_exact_sets(spark):
    """Pairs on both sides of the threshold, near enough to it that an estimate decides wrongly."""
    texts = []
    for k in range(60):
        common = [f"c{k}.{i}" for i in range(1004)]
        # n shingles more in each of two texts: 1000 / (1000 + 2 n) is 0.8 at n = 125.
        n = 121 + k % 9
        texts += [" ".join(common + [f"{side}{k}.{i}" for i in range(n)]) for side in "xy"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = exact_components(texts)
    assert 0 < sum(i != c for i, c in want.items()) < 60
    assert {r.doc_id: r.component_id for r in S.similar_documents(df).collect()} == want


def test_repeats_do_not_hide_a_copy(spark):
    """Texts of one shingle set that repeat a line a different number of times, and pairs that differ in one line of it."""
    rng, texts = np.random.default_rng(4), []
    for k in range(20):
        head, line = ([f"{c}{rng.integers(1 << 40)}" for _ in range(n)] for c, n in (("h", 300), ("l", 12)))
        other = line[:-1] + [f"x{rng.integers(1 << 40)}"]
        texts += [" ".join(head + line * n) for n in (2, 40)] + [" ".join(head + line + other * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = exact_components(texts)
    assert set(want.values()) == set(range(0, 60, 3))
    assert {r.doc_id: r.component_id for r in S.similar_documents(df).collect()} == want


def test_crowds_and_frequent_shingles(spark, monkeypatch):
    """Many texts that share half their shingles, copies among them, a crowd of copies on both sides of the threshold."""
    rng, texts = np.random.default_rng(6), []
    half = [f"f{i}" for i in range(60)]
    for k in range(80):
        words = half + [f"w{rng.integers(1 << 40)}" for _ in range(60)]
        texts += [" ".join(words)] + [" ".join(words[:n]) for n in (90, 104)][: k % 3]
    base = [f"b{i}" for i in range(150)]
    texts += [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05) for _ in range(25)]
    links = S.similar_links
    for sample, shard in ((64, 4), (S.FREQUENT_SAMPLE, S.SIMILAR_SHARD)):
        monkeypatch.setattr(S, "CROWD_ROWS", shard)
        monkeypatch.setattr(S, "similar_links", lambda d, s, w: links(d, s, w, sample=sample, shard=shard))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in S.similar_documents(df).collect()} == exact_components(texts)


def test_a_crowd_costs_its_size(spark):
    """Rows of one group never meet each other: candidates are those of all pairs across groups, whatever the blocks."""
    rng = np.random.default_rng(8)
    rows = []
    for token in range(3):
        for fp in range(120):
            label = fp if fp % 10 == token else 1_000  # a dozen texts of their own, the others one group
            rows.append((token, fp, 10 + int(rng.integers(3)), int(rng.integers(2)), label, *[0] * S.PARITIES))
    sizes = {fp: size for _, fp, size, *_ in rows[:120]}
    rows = [(t, fp, sizes[fp], *rest) for t, fp, _, *rest in rows]
    kinds = "token long, fp long, size long, place int, label long, " + ", ".join(f"{m} long" for m in S._PARITY)
    shared = spark.createDataFrame(rows, kinds)
    mains = S.main_groups(shared)
    assert sorted(mains.collect()) == [(t, 1_000, 12) for t in range(3)]
    want = {}
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[0] == y[0] and x[4] != y[4] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2]):
                pair = min(x[1], y[1]), max(x[1], y[1])
                n, rest = want.get(pair, (0, 0))
                want[pair] = n + 1, max(rest, min(x[2] - x[3], y[2] - y[3]))
    least = lambda a, b: (sizes[a] + sizes[b]) * 0.8 / 1.8 - 1e-6
    kept = {(a, b) for (a, b), (n, rest) in want.items() if rest >= least(a, b) and n + np.ceil(max(sizes[a], sizes[b]) * 0.8) - 1 >= least(a, b)}
    assert kept
    for shard in (1, 5, 1_000):
        got = S.candidates(shared.join(mains, "token"), 0.8, shard)
        assert sorted(tuple(r) for r in got.collect()) == sorted(kept)
    plan = got._jdf.queryExecution().optimizedPlan().toString() + S._crowded(S._crowds(shared.withColumn("n", S.F.lit(120))), 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
