import hashlib

from pyspark.sql import functions as F

from weftline.llm.exact_dedup import exact_dedup, keep_one, normalise


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    rank = lambda i: (i is not None, i or 0)
    return {t: (max(g, key=rank), len(g)) for t, g in groups.items()}


def check(df, rows, **options):
    groups = brute(rows)
    got = exact_dedup(df, **options).collect()
    want = sorted(((i, *groups[lower(t)]) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups)
    return got


def test_documents(documents, rows):
    for r in check(documents, rows):
        assert r.kept == (r.doc_id == r.keep_id)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = check(odd, rows)
    digests = {(r.doc_id, r.text_sha256) for r in got}
    assert digests == {(i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows}


def test_unequal_texts_never_meet_even_with_equal_digests(documents, rows):
    check(documents, rows, digest=lambda c: F.lit("same"))


def test_any_number_of_salts(documents, rows):
    for salts in (1, 7, 500):
        check(documents, rows, salts=salts)


def test_empty(odd):
    assert exact_dedup(odd.limit(0)).count() == 0
    assert keep_one(odd.limit(0)).count() == 0


def test_keep_one(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 6, 7, 8, 9, 10, 11]


def test_no_python_in_the_plan(documents):
    plan = exact_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_shuffled_by_salt_once(documents):
    found = exact_dedup(documents)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1


def test_ids_of_a_large_group_stay_with_their_salts(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        found = exact_dedup(spark.range(1_000_000).selectExpr("id AS doc_id", "'the same text' AS text"))
        tasks = found.groupBy(F.spark_partition_id().alias("p"), "keep_id", "group_size").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.keep_id, r.group_size) for r in tasks} == {(999_999, 1_000_000)}
    # 64 salts fall on 64 partitions by hash, a few of them on one.
    assert len(tasks) >= 30 and max(r["count"] for r in tasks) < 120_000 and sum(r["count"] for r in tasks) == 1_000_000


def test_normalise_is_ascii_only(spark):
    assert spark.range(1).select(normalise(F.lit("ÀÉİ AbZ"))).first()[0] == "ÀÉİ abz"
