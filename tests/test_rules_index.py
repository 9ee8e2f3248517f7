"""Rules meet texts by the literals their patterns need."""

import random
import re

from weftgraph.operators.match import required_literal, rule_entities


def test_literals_that_every_match_holds():
    want = {"Licensed under": "licensed under", r"\+1 \([0-9]{3}\)": "+1 (", "[a-z0-9]+@mail[0-9]": "@mail", "a|b": "", "(?i)Key: (foo|bar)baz": "key: ", "ab?c": "a", "abc*": "ab", "ab{2,3}c": "ab", "x{0,2}yz": "yz", r"\bword\b": "word", "[]a]bc": "bc", r"\Qa.b\E": "", "(?x) a b": "", "[^|]a": "a", "": "", "é12": "12", "ab+?c": "ab"}
    assert {p: required_literal(p) for p in want} == want


def test_a_match_always_holds_the_literal():
    rng = random.Random(2)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "C", r"\.", ".", "[ab]", "(ab|c)", "(?:b)", "a?", "b*", "c+", "a{2}", "b{0,1}", "^", r"\d", "(a)?", "[^a]"]) for _ in range(rng.randint(1, 6)))
        literal = required_literal(pattern)
        for _ in range(5):
            text = "".join(rng.choice("abC.1") for _ in range(8))
            m = re.search(pattern, text)
            assert not m or literal in m.group().lower(), (pattern, text)


def test_rows_and_plan(spark):
    docs = spark.createDataFrame([(1, "call KEY: 12 now"), (1, "KEY: 7"), (2, None), (3, ""), (None, "x9 y9"), (4, "key: none"), (5, "ke" * 50_000 + "KEY: 5")], "doc_id long, text string")
    rules = spark.createDataFrame([("key", "KEY: [0-9]", "a"), ("ikey", "(?i)key: .", "a"), ("free", "[a-z][0-9]", "b"), ("short", "y9", "b"), ("never", "zebra", "c")], "rule string, pattern string, domain string")
    out = rule_entities(docs, rules)
    got = sorted(((r.doc_id or 0, r.rule, r.hits, r.first_hit) for r in out.collect()))
    assert got == [(0, "free", 2, "x9"), (0, "short", 1, "y9"), (1, "ikey", 1, "KEY: 1"), (1, "ikey", 1, "KEY: 7"), (1, "key", 1, "KEY: 1"), (1, "key", 1, "KEY: 7"), (4, "ikey", 1, "key: n"), (5, "ikey", 1, "KEY: 5"), (5, "key", 1, "KEY: 5")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
