"""robots.txt: groups of rules by a state machine over a file's lines, and answers from a trie of a host's rules.

The rules are those that the Python standard library's parser follows. A group is a run of agents with what comes after
them, and ends at an empty line or at the next agent; a group that an empty line ends before any directive is lost. The
first group that names the agent counts, or else the first for all. Of its rules the first that begins the address's path
decides. Rules and addresses are compared in one form: unescaped, then escaped again.
"""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse, urlunparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..session import prepare

START, AGENTS, DIRECTIVES = range(3)
#: Directives after which the next agent begins a group.
_CLOSING = ("allow", "disallow", "crawl-delay", "request-rate")


def canonical_rule(value: str) -> str:
    """The form in which a rule's path, already unescaped, is compared."""
    return quote(urlunparse(urlparse(value)))


def canonical_target(url: str) -> str:
    """Path, parameters, query and fragment of an address in the form that rules have."""
    parts = urlparse(unquote(url))
    return quote(urlunparse(("", "", parts.path, parts.params, parts.query, parts.fragment))) or "/"


def groups(text: str) -> list[tuple[list[str], list[tuple[bool, str]]]]:
    """(agents, rules) of each group of a file in order, rules as (allow, path)."""
    found, state, agents, rules = [], START, [], []

    def close():
        nonlocal state, agents, rules
        if state == DIRECTIVES:
            found.append((agents, rules))
        state, agents, rules = START, [], []

    for line in text.splitlines():
        if not line:
            close()
        name, colon, value = line.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), unquote(value.strip())
        if name == "user-agent":
            if state == DIRECTIVES:
                close()
            agents.append(value)
            state = AGENTS
        elif name in _CLOSING and state != START:
            state = DIRECTIVES
            if name in ("allow", "disallow"):
                rules.append((name == "allow" or value == "", canonical_rule(value)))
    close()
    return found


def parse_robots(robots: DataFrame) -> DataFrame:
    """Rules (host, agent, part, general, seq, allow, prefix) of robots texts (host, text), a row for each agent of a group
    and each of its rules.

    part is the number of the group. A group that names `*` is general: it counts for those that no other group names. A
    group without rules has a row with a null prefix for each agent. A null text has no rows.
    """
    prepare(robots.sparkSession)
    rows = robots.where(F.col("text").isNotNull()).select(F.lower("host").alias("host"), "text")
    columns = {"host": pa.string(), "agent": pa.string(), "part": pa.int32(), "general": pa.bool_(), "seq": pa.int32(), "allow": pa.bool_(), "prefix": pa.string()}

    def run(batches):
        for batch in batches:
            out = []
            for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part, (agents, rules) in enumerate(groups(text)):
                    for agent in dict.fromkeys(a.lower() for a in agents):
                        told = [(k, allow, path) for k, (allow, path) in enumerate(rules)] or [(None, None, None)]
                        out += [(host, agent, part, "*" in agents, *rule) for rule in told]
            arrays = zip(*out) if out else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(list(a), t) for a, t in zip(arrays, columns.values())], names=list(columns))

    return rows.mapInArrow(run, "host string, agent string, part int, general boolean, seq int, allow boolean, prefix string")


class Trie:
    """Rules by the characters of their paths; answers take one walk along an address, however many rules there are."""

    def __init__(self, rules):
        self.root = {}
        for seq, allow, prefix in rules:
            node = self.root
            for c in prefix:
                node = node.setdefault(c, {})
            node[None] = min((seq, allow), node.get(None, (seq, allow)))

    def allows(self, target: str) -> bool:
        node, best = self.root, self.root.get(None)
        for c in target:
            node = node.get(c)
            if node is None:
                break
            if (rule := node.get(None)) is not None and (best is None or rule < best):
                best = rule
        return best is None or best[1]


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Adds robots_ok to urls: what the rules (see parse_robots) of the address's host say to the agent.

    Null addresses and those without a host, or whose host has no rules, are allowed. The agent's group is chosen once a
    host and its rules are folded to one row, so the join adds no rows and both of its sides are plain tables.
    """
    prepare(urls.sparkSession)
    name = agent.split("/")[0].lower()
    own = rules.where(F.col("general") | F.contains(F.lit(name), F.col("agent")))
    chosen = own.groupBy("host").agg(F.min(F.struct("general", "part")).alias("first"))
    group = own.join(chosen, "host").where("general = first.general AND part = first.part").select("host", "seq", "allow", "prefix").distinct()
    folded = group.where("prefix IS NOT NULL").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("seq", "allow", "prefix"))).alias("rules"))
    columns = [F.struct(*(F.col(f"`{c}`") for c in urls.columns)).alias("row"), F.col(f"`{url}`").alias("url"), F.lower(U.netloc(F.col(f"`{url}`"))).alias("host")]
    rows = urls.select(*columns).join(folded, "host", "left").select("row", "url", "host", "rules")

    def run(batches):
        for batch in batches:
            tries, answers = {}, []
            for at, host, found in zip(batch.column("url").to_pylist(), batch.column("host").to_pylist(), batch.column("rules"), strict=True):
                if not found.is_valid or not at:
                    answers.append(True)
                    continue
                if host not in tries:
                    tries[host] = Trie((r["seq"], r["allow"], r["prefix"]) for r in found.as_py())
                answers.append(tries[host].allows(canonical_target(at)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(answers, pa.bool_())], names=["row", "robots_ok"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("robots_ok", T.BooleanType())])).select("row.*", "robots_ok")
