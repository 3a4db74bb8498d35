"""The queries of this subpackage by name, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dedup

    return near_dedup(read_table(spark, sf_dir, "documents"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import from_media, to_media

    return from_media(to_media(read_table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_conversations, read_back

    text = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.array_join("losses", "").alias("loss"), "formatted",
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    back = encode_documents(read_table(spark, sf_dir, "documents"), decoded=True)
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import count_documents

    return count_documents(read_table(spark, sf_dir, "documents"))


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .arrow_files import store_documents

    return store_documents(read_table(spark, sf_dir, "documents"))


def op11_dominance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dominance import dominance, sale_points

    return dominance(sale_points(read_table(spark, sf_dir, "sales"))).select(
        "sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_rules import judge

    return judge(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_secret_scan, op3_best_fit_packing, op4_simhash_near_dedup, op5_ogg_media, op6_quality_classifier, op7_chat_format,
    op8_bpe_encode_decode, op9_token_counts, op10_arrow_token_files, op11_dominance_counts,
    op12_ranked_search, op13_quality_rules)}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The checksum of an id's decimal digits, a bit at a time.
_CRC32 = """xor(list_reduce(
    list_transform(string_split(coalesce(sale_id::VARCHAR, ''), ''), lambda c: CASE WHEN c = '' THEN NULL ELSE ascii(c)::BIGINT END),
    lambda x, b: CASE WHEN b IS NULL THEN x ELSE list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, b)) END,
    4294967295::BIGINT), 4294967295::BIGINT)"""
_TERMS = f"regexp_extract_all({_NORMAL}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_ESCAPED = r"replace(replace(x, '\', '\b'), '<', '\l')"

ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op7_chat_format": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        r AS (
            SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w <> role, true) AS begins FROM c
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
            length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length({_ESCAPED.replace("x", "text")}) + CASE WHEN begins THEN 6 + length(replace({_ESCAPED.replace("x", "role")}, '>', '\\g')) + 1 + 8 ELSE 6 END)::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id
    """,
    "op11_dominance_counts": f"""
        WITH s AS (
            SELECT row_number() OVER () AS k, sale_id, floor(floor(epoch(sold_at)) / 60)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 1)::BIGINT AS level, 1 + {_CRC32} % 5 AS weight
            FROM sales),
        above AS (SELECT q.k, count(*) AS n, sum(p.weight) AS w FROM s q JOIN s p ON p.slot < q.slot AND p.level > q.level GROUP BY q.k)
        SELECT sale_id, slot, level, CASE WHEN slot + level IS NOT NULL THEN coalesce(n, 0) END AS n_sales, CASE WHEN slot + level IS NOT NULL THEN coalesce(w, 0) END::BIGINT AS n_rows
        FROM s LEFT JOIN above USING (k)
    """,
    "op12_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
        n AS (SELECT k, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
        whole AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM n),
        i AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
        f AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), whole),
        s AS (
            SELECT item_id, doc_id, k, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * total) // length)))))::BIGINT AS score
            FROM i JOIN w USING (term) JOIN f USING (term) JOIN n USING (k), whole GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
}
