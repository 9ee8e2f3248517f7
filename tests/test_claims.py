"""Claims by phrases, against the pattern that tries every place of a sentence."""

import random
import re
import time

from pyspark.sql import functions as F

from weftgraph.operators import match
from weftgraph.operators.match import PHRASES, evidence_windows, extract_claims


def plain(text):
    out = []
    words = r"\w+(?:\s+\w+)*"
    for phrase, relation in PHRASES:
        m = re.search(rf"({words})\s+{phrase}\s+({words})", text, re.IGNORECASE)
        if m and re.search(rf"\b{phrase}\b", text, re.IGNORECASE):
            name = lambda x: x.strip().lower().replace(" ", "_")[:50]
            out.append((name(m[1]), relation, name(m[2])))
    return out


def test_as_the_plain_pattern(spark):
    rng = random.Random(5)
    some = ["heat", "the flow", "causes", "Depends on", "depends", "on", "increases with", "is directly proportional to", "-", ",", "straße", "x2", "decreases  with", "(a)", "_"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in extract_claims(evidence_windows(docs, None), [r for _, r in PHRASES]).where("not generic").collect():
        got.setdefault(r.doc_id, []).append((r.subject, r.relation, r.object))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, t in enumerate(texts) if (x := plain(t))}


def test_a_long_sentence_takes_no_quadratic_time(spark):
    docs = spark.createDataFrame([(1, "word " * 60_000 + "causes it"), (2, "word " * 60_000)], "doc_id long, text string")
    began = time.time()
    rows = extract_claims(evidence_windows(docs, None), ["causes"]).where("not generic").collect()
    assert [r.object for r in rows] == ["it"] and time.time() - began < 60


def test_scopes_as_told_word_by_word(spark):
    rng, words = random.Random(5), ["the", "and", "with", "then", "No"]
    texts = ["".join(rng.choice(["the", "The", "and", "with", "then", "x", "thee", "é", "no"]) + rng.choice([" ", "-", "\n", "7 "]) for _ in range(rng.randint(0, 7))) for _ in range(400)] + [None, "", "the and", "the a b and"]
    tokens = lambda t: [w for w in re.split("[^a-z]+", (t or "").lower()) if w]
    want = [i for i, t in enumerate(texts) if any(len({*tokens(t)[j : j + 3]} & {*words}) > 1 for j in range(len(tokens(t))))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in match.scoping_claims(docs, words).collect()) == want and 20 < len(want) < 400
    assert match.scoping_claims(docs, ["the"]).count() == match.scoping_claims(docs, []).count() == 0


def test_a_long_text_is_read_once(spark):
    """Forty texts of 20,000 words: work by word and text, not by its square."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("the a b c "), F.repeat(F.lit("word "), 20_000), F.lit("and")).alias("text"))
    began = time.time()
    assert match.scoping_claims(docs, ["the", "and"]).count() == 0
    assert time.time() - began < 20
