"""Groups of spelling variants: words at one edit, found by the rarest of their bigrams.

One edit breaks two bigrams of a word at most, so of two near words one of the three rarest bigrams of either is among those of the
other, at the same place counted from the front (the edit is behind it) or from the end (the edit is before it).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import each, set_batches
from loomery.session import materialize, table, written

#: [A-Za-zÀ-ÿ]+ in UTF-8, after A-Z are lower-cased
RUN = re.compile(rb"(?:[a-z]+|\xC3[\x80-\xBF])+")
_OTHER = re.compile(rb"[^a-z\x80-\xBF\xC3]")
PIECE, HELD, RARE = 1 << 20, 200_000, 3


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in parts of about a size that cut no run."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def spoilt(run: bytes, before: bytes, modulus: int) -> bytes:
    """The run without one of its code points where the modulus divides the crc32 of `before` and the run."""
    h = zlib.crc32(run, zlib.crc32(before))
    if h % modulus:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def _counted(least: int, modulus: int):
    """Words of at least so many code points, and how often each is in the texts of a part of the partition."""

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for x in batches:
            for doc, text in zip(x.column(0).to_pylist(), each(x.column(1)), strict=True):
                before = f"{'' if doc is None else doc}:".encode()
                for piece in pieces(text.lower()):
                    for word, n in Counter(RUN.findall(piece)).items():
                        word = spoilt(word, before, modulus)
                        if len(word) >= 2 * least or len(word.decode()) >= least:
                            counts[word] += n
                    if len(counts) > HELD:
                        yield batch(counts)
                        counts = Counter()
        yield batch(counts)

    return run


def words_of(docs: DataFrame, least_chars: int = 5, least_n: int = 3, modulus: int = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: distinct words of the texts and how often they occur."""
    texts = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    found = texts.mapInArrow(_counted(least_chars, modulus), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring letters is in the distinct words. The alphabet (26 + 64 letters) bounds it: 8,100 entries."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).toLocalIterator()}


def rarest(word: str, counts: dict[str, int], rare: int = RARE) -> list[int]:
    """Where the rarest bigrams of a word begin, in the order of (count, bigram, place). If the last of them comes again at the next
    place, that is one of them too: its twin in a near word may have moved by one."""
    order = sorted((counts.get(g, 0), g, i) for i, g in enumerate(map("".join, zip(word, word[1:], strict=False))))
    found = [i for _, _, i in order[:rare]]
    if len(order) > rare and order[rare][1] == order[rare - 1][1] and order[rare][2] == order[rare - 1][2] + 1:
        found.append(order[rare][2])
    return found


def meeting_keys(word: str, at: int) -> Iterator[tuple[str, int]]:
    """Under what a word with a rare bigram at a place meets those at one edit that have it at the same place from the front or
    from the end; with each, 0 if the word is the shorter of the two or equally long, 1 if it is the longer.

    The side without the edit is in the key whole, and of the other side the half without the edit, so groups stay small however
    frequent a bigram is.
    """
    for role in (0, 1):
        n = len(word) - role
        front, back, half = word[: at + 2], word[at + 2 :], (n - at - 2) // 2
        if n >= at + 2:
            yield f"{n} f {front} {back[:half]}", role
            yield f"{n} g {front} {back[half + role :]}", role
        front, back, half = word[:at], word[at:], (at - role) // 2
        if at >= role:
            yield f"{n} b {back} {front[:half]}", role
            yield f"{n} c {back} {front[half + role :]}", role


def _keyed(counts: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 1000):
                part = x.slice(lo, 1000)
                keys, roles, at = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for key, role in {k for place in rarest(word, counts) for k in meeting_keys(word, place)}:
                        keys.append(xxhash.xxh64_intdigest(key) - (1 << 63))
                        roles.append(role)
                        at.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), *(c.take(pa.array(at, pa.int64())) for c in part.columns)], ["key", "role", "word", "n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every two distinct words at exactly one edit, once from either end. Groups under one key are joined
    by sort and merge with the edit distance as a condition of the join, so no pair is listed that isn't near."""
    keyed = words.select("word", "n").mapInArrow(_keyed(bigram_counts(words)), "key long, role byte, word string, n long")
    a, b = (keyed.select("key", *(F.col(c).alias(s + c) for c in ("role", "word", "n"))) for s in "ab")
    once = (F.col("arole") < F.col("brole")) | ((F.col("arole") + F.col("brole") == 0) & (F.col("aword") < F.col("bword")))
    met = a.hint("merge").join(b, (a["key"] == b["key"]) & once & (F.levenshtein("aword", "bword", 1) == 1))
    pairs = met.select("aword", "an", "bword", "bn").distinct()
    ends = F.explode(F.array(F.struct(F.col("aword").alias("word"), F.col("an").alias("n"), F.col("bword").alias("near"), F.col("bn").alias("near_n")),
                             F.struct(F.col("bword").alias("word"), F.col("bn").alias("n"), F.col("aword").alias("near"), F.col("an").alias("near_n"))))
    return pairs.select(ends.alias("x")).select("x.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Each round doubles the steps, and a form is twice as frequent as its word at
    least, so rounds grow with the logarithm of a logarithm of the counts."""
    forms = materialize(forms)
    state = forms.select("word", F.col("form").alias("root"))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialize(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, modulus: int = 97, times: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each distinct word of the texts.

    A word's form is its most frequent near word (ties: the first in code-point order), if that is `times` as frequent at least; its
    root is the last form. Null texts have no word; a null id is an empty one in the crc32 that spoils runs; repeated rows count
    again; texts of any length are read in pieces of PIECE bytes, words of any length are compared whole; an empty table, or one
    without words, returns no rows; other columns are ignored. Words need three bigrams, so four code points at least.
    """
    if least_chars < RARE + 1:
        raise ValueError("words of fewer than four code points have no three bigrams")
    words = written(words_of(docs, least_chars, least_n, modulus, key, text))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = written(words.join(near, "word", "left"))
    fits = -F.col("best.less") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    roots = _roots(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_batches(spark)
    return spelling_variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, bits),
spoilt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spoilt GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
pairs AS (
  SELECT a.word, b.word AS near FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
  UNION SELECT holes.word, less FROM holes JOIN words w ON w.word = less
  UNION SELECT less, holes.word FROM holes JOIN words w ON w.word = less),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n
  FROM pairs JOIN (SELECT word AS near, n FROM words) w USING (near) GROUP BY 1),
forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL
  SELECT s.word, f.form, step + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n
FROM forms LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY 1) USING (word)
"""
