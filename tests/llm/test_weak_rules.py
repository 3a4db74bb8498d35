import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.weak_rules import RULES, Rule, estimate, judge, measures, places

WORD = re.compile("[^\x20\x09-\x0d]+")
LETTERS = {chr(c) for c in range(128) if chr(c).isalpha()}


def brute_measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_ended_lines": sum(bool(re.search("[.!?:\"'…。！？»”][ \t\x0b\x0c\r]*$", line)) for line in lines),
        "n_distinct_words": len(set(words)), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_marks": sum(33 <= ord(c) < 127 and c not in LETTERS for c in text)}


def brute_votes(m):
    ratio = lambda a, b: a / b if b else None
    values = [
        m["n_words"], ratio(m["word_chars"], m["n_words"]), ratio(m["n_symbols"], m["n_words"]), ratio(m["n_repeat_words"], m["n_words"]),
        ratio(m["n_dup_lines"], m["n_lines"]) if m["n_lines"] >= 5 else None, ratio(m["n_capitals"], m["word_chars"]), ratio(m["n_marks"], m["word_chars"]),
        ratio(m["n_ended_lines"], m["n_lines"]) if m["n_lines"] >= 5 else None, m["n_distinct_words"] / m["n_words"] ** 0.75 if m["n_words"] >= 20 else None]
    return "".join("0" if v is None else "-" if not r.bad_below <= v <= r.bad_above else "+" if r.good_from <= v <= r.good_to else "0" for r, v in zip(RULES, values))


def brute_posterior(votes, shares, bad):
    like = np.array([s * math.prod({"-": b, "+": 1 - b, "0": 1}[v] for v, b in zip(votes, row)) for s, row in zip(shares, bad)])
    return like / like.sum()


def brute_estimate(patterns, rules, rounds=40, tolerance=1e-3):
    shares = [0.8] + [0.2 / rules] * rules
    bad = [[0.02] * rules] + [[0.9 if k == j else 0.3 for k in range(rules)] for j in range(rules)]
    for _ in range(rounds):
        p = {v: n * brute_posterior(v, shares, bad) for v, n in patterns.items()}
        new = [(sum(x[c] for x in p.values()) + 1) / (sum(patterns.values()) + rules + 1) for c in range(rules + 1)]
        rate = lambda c, k: (sum(x[c] for v, x in p.items() if v[k] == "-") + 1) / (sum(x[c] for v, x in p.items() if v[k] != "0") + 2)
        told = [[rate(c, k) for k in range(rules)] for c in range(rules + 1)]
        moved = np.abs(np.array([*new, *sum(told, [])]) - np.array([*shares, *sum(bad, [])])).max()
        shares, bad = new, told
        if moved < tolerance:
            break
    return shares, bad


def check(df, rows):
    """The verdicts of judge against measures, votes and estimation in plain Python."""
    told = [(i, t, brute_measures(t)) for i, t in rows]
    votes = [brute_votes(m) for *_, m in told]
    shares, bad = brute_estimate(Counter(votes), len(RULES)) if rows else ([], [])
    want = []
    for (i, _, m), v in zip(told, votes):
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        good = brute_posterior(v, shares, bad)[0]
        want.append((i, *(m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, not failed and bool(good >= 0.5), v, round(good, 4)))
    got = [(*tuple(r)[:-1], round(r.posterior, 4)) for r in judge(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_documents(documents, rows):
    assert any(not r[6] and not r[7] for r in check(documents, rows))


def test_odd_rows(odd):
    got = check(odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert len(got) == 13 and not any(r[7] for r in got if r[1] < 50)


def test_empty(odd):
    assert judge(odd.limit(0)).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", "x a b c y a b c z", "a b c\nd a  b\tc", "a b a b a", "aa b c a ab c a bb c", "a b c " * 3_000, " ".join(f"w{k}" for k in range(5_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in measures(df).collect():
        want = brute_measures(texts[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_estimation_finds_the_accuracies_that_made_the_votes(spark):
    rng = np.random.default_rng(5)
    n, rates = 20_000, np.array([[0.02, 0.03, 0.01, 0.05], [0.9, 0.6, 0.1, 0.1], [0.1, 0.85, 0.1, 0.2], [0.1, 0.2, 0.9, 0.7], [0.15, 0.1, 0.2, 0.95]])
    kind = rng.choice(5, n, p=[0.7, 0.1, 0.08, 0.07, 0.05])
    bad, silent = rng.random((n, 4)) < rates[kind], rng.random((n, 4)) < 0.1
    votes = Counter("".join(row) for row in np.where(silent, "0", np.where(bad, "-", "+")).tolist())
    found = estimate(spark.createDataFrame(list(votes.items()), "votes string, n long"), 4, rounds=60, tolerance=1e-4)
    assert abs(found.shares[0] - 0.7) < 0.05 and np.abs(np.array(found.says_bad[0]) - rates[0]).max() < 0.03
    good = {v: brute_posterior(v, found.shares, found.says_bad)[0] for v in votes}
    right = sum((good["".join(row)] >= 0.5) == (k == 0) for row, k in zip(np.where(silent, "0", np.where(bad, "-", "+")).tolist(), kind))
    best = {v: brute_posterior(v, [0.7, 0.1, 0.08, 0.07, 0.05], rates)[0] for v in votes}
    most = sum((best["".join(row)] >= 0.5) == (k == 0) for row, k in zip(np.where(silent, "0", np.where(bad, "-", "+")).tolist(), kind))
    assert right >= most - 0.005 * n


def test_votes_and_their_places(spark):
    rule = Rule("x", "v", good_from=2, good_to=3, bad_below=1, bad_above=4)
    df = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (3.5,), (4.1,), (None,)], "v double")
    assert [r[0] for r in df.select(rule.vote()).collect()] == ["-", "0", "+", "0", "-", "0"]
    assert spark.range(1).select(places(F.lit("-0+-"))).first()[0] == [1, 5, 9, 10]


def test_one_bad_vote_is_weighed_and_not_final(spark):
    """A rule that says bad of a tenth of what all others call good weighs little; agreement decides."""
    votes = {"++++": 800, "-+++": 90, "----": 60, "+---": 50}
    found = estimate(spark.createDataFrame(list(votes.items()), "votes string, n long"), 4)
    post = {r.votes: r.p for r in spark.createDataFrame(list(votes.items()), "votes string, n long").select("votes", F.get(found.posterior(places(F.col("votes"))), 0).alias("p")).collect()}
    assert post["++++"] > 0.9 and post["----"] < 0.1 and post["+---"] < 0.1


def test_no_python_in_the_plan(documents):
    plan = judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_too_many_rules(documents):
    with pytest.raises(ValueError):
        judge(documents, RULES * 2)


