"""The pipeline as a whole against its stages and plain versions of them, and each stage on odd input."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm.mixing import op4_mixing
from loomery.llm.packing import tokenizer_path
from loomery.llm.quality_classifier import op10_quality_classifier
from loomery.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage makes of the one before it."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs.collect())
    return out


def test_run_gives_the_pieces_of_its_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == PIECE
    # how partitions are cut decides which pieces meet in a sequence, not which tokens there are
    tokens = lambda rows: Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    rows = got.collect()
    assert tokens(rows) == tokens(steps[5]) and sum(r["length"] for r in rows) == sum(r["length"] for r in steps[5])


def test_quality_keeps_what_the_classifier_predicts(spark, steps):
    good = {r["doc_id"] for r in op10_quality_classifier(spark, SF).collect() if r["predicted"] == 1}
    assert plain(steps[1]) == plain(r for r in steps[0] if r["doc_id"] in good)


def test_dedup_keeps_one_of_each_group(steps):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) > 5 else frozenset([tuple(w)] if w else [])

    sets = {r["doc_id"]: shingles(r["text"]) for r in steps[1]}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    assert plain(steps[2]) == plain(r for r in steps[1] if top(r["doc_id"]) == r["doc_id"])
    assert len(steps[2]) < len(steps[1])


def test_personal_data_is_masked_and_nothing_else_changes(steps):
    before = {r["doc_id"]: r for r in steps[2]}
    assert len(steps[3]) == len(before)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    changed = 0
    for r in steps[3]:
        old = before[r["doc_id"]]
        assert (r["lang"], r["source"]) == (old["lang"], old["source"]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert not email.search(r["text"] or "")
        changed += r["text"] != old["text"]
        if not re.search("[0-9@=:]", old["text"] or ""):
            assert r["text"] == old["text"]
    assert 0 < changed < len(before)


def test_mix_takes_what_the_operator_plans(spark, steps, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(steps[3], spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"{folder}/documents.parquet")
    plan = {r["doc_id"]: r["taken"] for r in op4_mixing(spark, folder).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = Counter()
    for r in steps[4]:
        taken[r["doc_id"]] += size(r["text"])
    assert {i: n for i, n in plan.items() if n} == {i: n for i, n in taken.items() if n}


def test_pieces_hold_every_token_once(spark, steps):
    encoder, copies = Encoder(tokenizer_path()), Counter((r["doc_id"], r["text"]) for r in steps[4])
    want = Counter()
    for (doc, text), n in copies.items():
        want[doc] += n * (len(encoder.encode([text or ""])[0]) + 1)
    got, sequences = Counter(), defaultdict(list)
    for r in steps[5]:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("at", range(5), ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_input(spark, at):
    """Nulls in any column, repeated rows, an empty and a very long text, names of working columns; then an empty table."""
    name, stage = corpus_pipeline.STAGES[at]
    clash = ["turn", "many", "copies", "row", "node", "kept_doc", "kept_times", "score", "rank", "component", "key", "fp", "size", "bucket", "found", "kept"]
    text = "mail me at joan@mail.example.com or call +1 555 010 2000 " + " ".join(f"word{i} and" for i in range(40))
    rows = [(1, text, "en", "a", 10), (1, text, "en", "a", 10), (2, None, None, None, None), (None, None, None, None, None), (None, text, "en", None, 3), (3, "", "fr", "b", 0), (4, "go " * 60_000, "en", "a", 1), (5, text + " tail", None, "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(i) for i, c in enumerate(clash)})
    got = stage(spark, df, SF)
    out = got.collect()
    if name == "packing":
        assert got.columns == PIECE and sum(r["start"] == 0 for r in out) == len(rows)
    else:
        assert got.columns == df.columns and len(out) <= 2 * len(rows)
        assert all(r[c] == i for r in out for i, c in enumerate(clash))
    if name == "pii":
        assert len(out) == len(rows) and not any("@" in (r["text"] or "") for r in out)
    if name == "dedup":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["text"]) == [(False, 1), (False, 4)]
    assert stage(spark, df.limit(0), SF).collect() == []
