"""Which of many literal patterns a text contains, by one automaton over all of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare

#: Patterns of one automaton, and their bytes; both bound what is broadcast. More patterns are asked in more passes.
PATTERNS_AT_ONCE, BYTES_AT_ONCE = 100_000, 8 << 20


def matches(rows: DataFrame, patterns: DataFrame, key: str, text: str = "text", at_once: int = PATTERNS_AT_ONCE) -> DataFrame:
    """key and pattern for each row of rows and each of the patterns (pattern) that its text contains, once for each pair.

    An automaton is built once for a block of patterns and walked once over each text, so the time follows the texts and
    what is found, not texts times patterns. Null texts and null patterns match nothing; the empty pattern is in every text.
    Patterns that repeat count once; rows that repeat a key give their matches each. Other columns do not matter.
    """
    spark = prepare(rows.sparkSession)
    told = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    asked = patterns.where("pattern IS NOT NULL").select("pattern").distinct()
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    blocks = max(1, -(-count // at_once), -(-size // BYTES_AT_ONCE))
    kind = told.schema["key"].dataType.simpleString()
    out = spark.createDataFrame([], f"key {kind}, pattern string")
    for k in range(blocks):
        block = [r.pattern for r in asked.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()]  # a bounded block
        if block:
            out = out.unionByName(told.mapInArrow(_walk(spark.sparkContext.broadcast(block)), f"key {kind}, pattern string"))
    return out.withColumnRenamed("key", key)


def _walk(sent):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern in filter(None, sent.value):
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        always = [""] if "" in sent.value else []
        for batch in batches:
            row, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = always + list(dict.fromkeys(p for _, p in automaton.iter(text)) if len(automaton) else ())
                row += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), pa.array(found, pa.string())], names=["key", "pattern"])

    return run
