r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where adjacent turns have one role, and concatenated:

    <turn role>text<part>text</turn>\n

`<` never occurs in an escaped text, so none can imitate a mark: `\` becomes `\b` and `<` becomes `\l`, reversibly (in
roles also `>` becomes `\g`). `loss_spans` holds the byte ranges (start, length) of the assistants' texts in the UTF-8
form of the output, parts apart, so that neither marks nor anything between two texts is under the mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template.
OPEN, OPENED, PART, CLOSE = "<turn ", ">", "<part>", "</turn>\n"
#: Offsets are summed within blocks of this many turns and over blocks, so the work is not the square of the turns.
_BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each length, the sum of those before it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, lambda sums: let(
        F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))),
        lambda base: F.transform(lengths, lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + _total(
            F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK))))),
    ))


def _pieces(turns: Column) -> Column:
    """For each sorted turn what stands before, in and after its text, and whether the text is under the mask."""
    def piece(t, i):
        begins = (i == 0) | (F.get(turns, i - 1).role != t.role)
        ends = (i == F.size(turns) - 1) | (F.get(turns, i + 1).role != t.role)
        return F.struct(
            F.when(begins, F.concat(F.lit(OPEN), t.role, F.lit(OPENED))).otherwise(F.lit(PART)).alias("before"),
            t.text.alias("text"), F.when(ends, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"), t.loss.alias("loss"))

    return F.transform(turns, piece)


def _output(pieces: Column) -> Column:
    lengths = F.transform(pieces, lambda p: (F.octet_length(p.before) + F.octet_length(p.text) + F.octet_length(p.after)).cast("long"))
    at = let(lengths, _before)
    spans = let(at, lambda at: F.transform(
        F.filter(F.transform(pieces, lambda p, i: F.struct(p.loss.alias("loss"), (F.get(at, i) + F.octet_length(p.before)).alias("start"), F.octet_length(p.text).cast("long").alias("length"))), lambda s: s.loss),
        lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))))
    return F.struct(F.array_join(F.transform(pieces, lambda p: F.concat(p.before, p.text, p.after)), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start long, length long>>.

    Turns are taken by turn, then role, then text, so ties and repeated rows have one order; a null turn comes first.
    Null roles and texts count as empty. Rows with a null conv_id form one conversation. Extra columns are ignored,
    and an empty table gives an empty result. Escaping is done on the rows, before they are collected; only the
    concatenation, which is one value of the result, needs a conversation in one place.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.struct(
        F.col("turn"), F.replace(escape(role), F.lit(">"), F.lit("\\g")).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"), (role == loss_role).alias("loss")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns"))
    out = let(F.sort_array("turns"), lambda sorted_turns: let(_pieces(sorted_turns), _output))
    return held.select("conv_id", out.alias("out")).select("conv_id", "out.formatted", "out.loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> as they were, and losses array<string>, from the output alone."""
    def turn(body):
        role = F.replace(unescape(F.substring_index(F.substr(body, F.lit(len(OPEN) + 1)), OPENED, 1)), F.lit("\\g"), F.lit(">"))
        texts = F.split(F.substr(body, F.locate(OPENED, body) + 1), PART, -1)
        return let(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    bodies = F.split("formatted", CLOSE, -1)
    turns = let(bodies, lambda b: F.flatten(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), turn)))
    losses = let(F.encode("formatted", "UTF-8"), lambda raw: F.transform("loss_spans", lambda s: unescape(
        F.decode(F.substring(raw, (s.start + 1).cast("int"), s.length.cast("int")), "UTF-8"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), losses.alias("losses"))
