"""Comparing a Spark query with its SQL in DuckDB."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def same(df, con, sql):
    """Asserts equal columns and equal rows in any order."""
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, told.fetchall())


def values(spark, column, texts):
    """A column expression's values over the given texts (or tuples a, b, ...), in order."""
    texts = [t if isinstance(t, tuple) else (t,) for t in texts]
    names = [chr(97 + k) for k in range(len(texts[0]))]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def plain_crawl(starts, replies, links, max_depth=10):
    """A queue that is worked off one address at a time: visited (url: depth, source) and failed (url: depth).

    replies: url to (final_url, status, content_type); links: a page's addresses in order, by the address that answered.
    """
    queue, at = [(u, 0) for u in dict.fromkeys(starts)], 0
    waiting, visited, failed = {u for u, _ in queue}, {}, {}
    while at < len(queue):
        url, depth = queue[at]
        at += 1
        waiting.discard(url)
        if url in visited or depth > max_depth:
            continue
        reply = replies.get(url)
        if reply is None or reply[1] is None or reply[1] >= 400:
            failed[url] = depth
            continue
        final = reply[0] or url
        for x in (url, final):
            visited.setdefault(x, (depth, url))
        if "text/html" not in reply[2]:
            continue
        for to in links.get(final, ()):
            if to not in visited and to not in failed and to not in waiting:
                queue.append((to, depth + 1))
                waiting.add(to)
    return visited, failed
