"""Phrases against a fold of regular expressions and against plain search."""

import random
import re

import pytest

from loomery.operators import phrases


def test_a_thousand_phrases_equal_a_fold_of_regexes(spark):
    """Values that hold no word of a phrase, and phrases that don't overlap, so that the order of the fold does not matter."""
    rng = random.Random(1)
    pairs = {f"a{i} b{i}" + (f" c{i}" if i % 2 else ""): f"<{i}>" for i in range(1000)}
    rows = []
    for i in range(60):
        words = [rng.choice([f"a{n} b{n}", f"A{n} B{n} c{n}", f"a{n}", f"xa{n} b{n}", f"b{n} c{n}"]) for n in rng.choices(range(1000), k=30)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(100, None), (101, ""), (102, "é a1 b1 c1é a1 b1.")]
    got = {r.id: r.t for r in phrases.rewritten(spark.createDataFrame(rows, "id long, t string"), "t", spark.createDataFrame(list(pairs.items()), "phrase string, value string")).collect()}
    for i, t in rows:
        for p in sorted(pairs, key=len, reverse=True):
            t = None if t is None else re.sub(rf"(?i)\b{p}\b", pairs[p], t)
        assert got[i] == t


def test_leftmost_longest():
    rng = random.Random(2)
    for _ in range(300):
        pairs = {" ".join(rng.choices("abc", k=rng.randint(1, 3))): str(i) for i in range(5)}
        text = " ".join(rng.choices("abcd", k=12))
        out, at = [], 0
        words = text.split()
        while at < len(words):
            n = max((len(p.split()) for p in pairs if words[at : at + len(p.split())] == p.split()), default=0)
            out.append(pairs[" ".join(words[at : at + n])] if n else words[at])
            at += n or 1
        assert phrases.Phrases(pairs).rewritten(text) == " ".join(out)


def test_bad_phrases_and_too_many(spark):
    with pytest.raises(ValueError):
        phrases.Phrases({"?": "x"})
    with pytest.raises(ValueError):
        phrases.rewritten(spark.createDataFrame([("a",)], "t string"), "t", spark.createDataFrame([("a", "b"), ("c", "d")], "phrase string, value string"), most=1)
