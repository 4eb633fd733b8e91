"""Language-model scores: prediction by partial matching over bytes, and a unigram base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import by_key, held_out, raw, slices, small_batches
from loomery.session import table, written

ORDER = 4  # bytes of context, 2 to 7; a gram is a context and the byte after it
END = 0xFF  # no byte of UTF-8; stands before and after a text
CHUNK, PART, WAIT, HOLD, ROWS, GROUP = 32 << 20, 1_000_000, 500_000, 160 << 20, 100_000, 1_000_000

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(every gram of each text and of its end, as an integer; how many each text has)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    pad = bytes([END]) * order
    buffer = np.frombuffer(pad.join([b"", *texts, b""]), np.uint8)
    found = np.zeros(len(buffer) - order, np.uint64)
    for i in range(order + 1):
        found = (found << np.uint64(8)) | buffer[i : len(buffer) - order + i]
    # of each text: its bytes and the first byte after it
    starts = np.concatenate([[0], np.cumsum(sizes + order - 1)])[:-1]
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return found[at], sizes


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, then the end as an empty token."""
    return [*text.lower().split(), b""]


class _Counts:
    """Words and grams of one chunk; equal grams are put together before many wait."""

    def __init__(self):
        self.words: Counter = Counter()
        self.grams = [np.zeros(0, np.uint64)]
        self.n = [np.zeros(0, np.int64)]

    def add(self, found: np.ndarray, n: np.ndarray) -> None:
        self.grams.append(found)
        self.n.append(n)
        if sum(map(len, self.grams[1:])) > max(WAIT, len(self.grams[0])):
            self.settle()

    def settle(self) -> None:
        found, at = np.unique(np.concatenate(self.grams), return_inverse=True)
        self.grams, self.n = [found], [np.bincount(at, np.concatenate(self.n), len(found)).astype(np.int64)]

    def weight(self) -> int:
        """Bytes, about."""
        return 200 * len(self.words) + 16 * sum(map(len, self.grams))


def _gather(order: int, hold: int):
    """chunk, word or gram, n (how often training texts of the chunk have it; 0 where only held-out ones do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Counts] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk in list(held):
                own = held.pop(chunk)
                own.settle()
                n, m = len(own.words), len(own.grams[0])
                word = pa.array([*own.words.keys(), *[None] * m], pa.binary())
                gram = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(own.grams[0].view(np.int64))])
                count = pa.concat_arrays([pa.array(list(own.words.values()), pa.int64()), pa.array(own.n[0])])
                rows = pa.RecordBatch.from_arrays([pa.array(np.full(n + m, chunk)), word, gram, count], ["chunk", "word", "gram", "n"])
                del own, word, gram, count
                for lo in range(0, n + m, ROWS):
                    yield rows.slice(lo, ROWS)

        for x in batches:
            chunks, out = x.column(0).to_numpy(), x.column(2).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.binary_length(x.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + order + 1
            rank = np.lexsort((out, chunks))
            for lo, hi in _runs(chunks[rank], out[rank], size[rank]):
                rows = rank[lo:hi]
                chunk, aside = int(chunks[rows[0]]), bool(out[rows[0]])
                part = raw(x.column(3).take(pa.array(rows)))
                own = held.setdefault(chunk, _Counts())
                for t in part:
                    own.words.update(dict.fromkeys(tokens(t), 0) if aside else tokens(t))
                found, n = np.unique(grams(part, order)[0], return_counts=True)
                own.add(found, n * (not aside))
                # what a task holds is bounded, over all of its chunks; the same key may come more than once
                if sum(c.weight() for c in held.values()) > hold:
                    yield from flush()
        yield from flush()

    return run


def _runs(chunks: np.ndarray, held: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of one chunk and one side, of about PART bytes."""
    if len(chunks):
        cuts = [0, *(np.flatnonzero((chunks[1:] != chunks[:-1]) | (held[1:] != held[:-1])) + 1).tolist(), len(chunks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for lo, hi in slices(sizes[a:b], PART):
                yield a + lo, a + hi


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, values, n)


class Level:
    """Contexts of one length: their symbols' counts, and what they exclude one level below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: distinct, sorted; context bytes and a symbol."""
        self.keys, self.counts = keys, counts
        self.contexts, self.at = np.unique(keys >> np.uint64(8), return_inverse=True)
        n = len(self.contexts)
        self.total, self.distinct = _sums(self.at, counts, n), _sums(self.at, np.ones(len(keys)), n)
        self.excluded = np.zeros(n)

    @staticmethod
    def _find(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(held):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        return np.where(held[at] == wanted, at, -1)

    def symbol(self, grams_: np.ndarray) -> np.ndarray:
        return self._find(self.keys, grams_)

    def context(self, contexts: np.ndarray) -> np.ndarray:
        return self._find(self.contexts, contexts)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def log_probabilities(found: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Natural log-probability of the last byte of each gram after the others: escape method D, symbol and update exclusion.

    found: grams (distinct); counts: how often training has them (0: not); of any two-byte context the caller gives all grams
    or none. pairs: 256 x 256, after how many different bytes training has a byte after a byte. A symbol counts in the
    longest context as often as it was seen and in a shorter one once for each longer context that has it. At each length,
    from `order` down, a context that was seen gives a symbol (count - 1/2)/total and the escape distinct/(2 total), all
    without the symbols of the longer context; below length 0 the bytes never seen are equal.
    """
    seen = counts > 0
    levels: dict[int, Level] = {}
    keys, sums = found[seen], counts[seen].astype(np.float64)
    for m in range(order, 1, -1):
        own, at = np.unique(keys & _mask(m + 1), return_inverse=True)
        keys, sums = own, _sums(at, sums if m == order else np.ones(len(at)), len(own))
        levels[m] = Level(keys, sums)
    one = pairs.astype(np.float64)
    zero = (one > 0).sum(axis=0).astype(np.float64)
    for m in range(order, 1, -1):
        x = levels[m]
        shorter = x.keys & _mask(m)
        below = levels[m - 1].counts[levels[m - 1].symbol(shorter)] if m > 2 else one[(shorter >> np.uint64(8)).astype(np.int64), (shorter & np.uint64(255)).astype(np.int64)]
        x.excluded = _sums(x.at, below, len(x.contexts))
    out, done = np.zeros(len(found)), np.zeros(len(found), bool)
    gone_total, gone_distinct = np.zeros(len(found)), np.zeros(len(found))

    def step(total, distinct, count):
        """count: of the symbol in this context, 0 if it was not seen there."""
        nonlocal done
        t, d = total - gone_total, distinct - gone_distinct
        here = ~done & (distinct > 0) & (d > 0)
        hit, miss = here & (count > 0), here & (count == 0)
        out[hit] += np.log((count[hit] - 0.5) / t[hit])
        out[miss] += np.log(d[miss] / (2 * t[miss]))
        done = done | hit

    for m in range(order, 1, -1):
        x, g = levels[m], found & _mask(m + 1)
        ctx, sym = x.context(g >> np.uint64(8)), x.symbol(g)
        is_, own = ctx >= 0, lambda v, i: np.where(i >= 0, v[i], 0.0) if len(v) else np.zeros(len(i))
        step(own(x.total, ctx), own(x.distinct, ctx), own(x.counts, sym))
        gone_total = np.where(is_, own(x.excluded, ctx), 0.0)
        gone_distinct = np.where(is_, own(x.distinct, ctx), 0.0)
    last, byte = ((found >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (found & np.uint64(255)).astype(np.int64)
    step(one.sum(axis=1)[last], (one > 0).sum(axis=1).astype(np.float64)[last], one[last, byte])
    gone_total, gone_distinct = ((one > 0) * zero).sum(axis=1)[last], (one > 0).sum(axis=1).astype(np.float64)[last]
    step(np.full(len(found), zero.sum()), np.full(len(found), float((zero > 0).sum())), zero[byte])
    out[~done] -= math.log(max(1, 256 - int((zero > 0).sum())))
    return out


def _trie(pairs: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 2, GROUP):
            found = rows.column(0).to_numpy().view(np.uint64)
            logs = log_probabilities(found, rows.column(1).to_numpy(), pairs, order)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(logs)], ["gram", "value"])

    return run


def _score(n: int, v: int, order: int):
    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()
        words = model.filter(pc.is_valid(model.column("word")))
        counts = dict(zip(words.column("word").to_pylist(), words.column("value").to_pylist(), strict=True))
        trie = model.filter(pc.is_valid(model.column("gram")))
        index, first = np.unique(trie.column("gram").to_numpy(), return_index=True)
        values, index = trie.column("value").to_numpy()[first], pd.Index(index)
        del words, trie
        size, base, known, total = [], [], [], []
        body = docs.column("text").combine_chunks()
        sizes = pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False).astype(np.int64) + order + 1
        for lo, hi in slices(sizes, PART):
            texts = raw(body.slice(lo, hi - lo))
            for t in texts:
                c = np.array(list(map(counts.__getitem__, tokens(t))))
                size.append(len(c))
                known.append(int((c > 0).sum()))
                base.append(float(np.log10((c + 1) / (n + v + 1)).sum()))
            found, many = grams(texts, order)
            at = index.get_indexer(found.view(np.int64))
            if (at < 0).any():
                raise ValueError("the input changed between two passes over it")
            total += (np.add.reduceat(values[at], np.cumsum(many) - many) / math.log(10)).tolist()
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(size), n)), pa.array(base, pa.float64()), pa.array(total, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, out, order: int = ORDER, chunk_bytes: int = CHUNK, key: str = "doc_id", text: str = "text", hold: int = HOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the bytes and the end).

    out: true for rows that nothing is learned from. Neither vocabulary nor trie is ever whole in one place: texts are taken
    in chunks (by block of a file; a block of more than chunk_bytes by hash of its rows), a chunk's distinct words and grams
    are counted once, the counts of all chunks are added up by shuffle, the trie is worked out by groups of grams with the
    same two bytes of context, and what a chunk needs of either comes back to it beside its texts. Shorter contexts are 256 x
    256 numbers; hold: bytes of counts that a task keeps before it writes them. Null texts count as empty (only the end is coded); repeated rows stay; an empty table returns no rows; with
    nothing to learn from every byte has probability 1/256. The input must not change during the run.
    """
    spark = docs.sparkSession
    block = F.xxhash64(F.input_file_name(), F.expr("input_file_block_start()"))
    own = docs.select(F.col(key).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text).cast("string").alias("text"), block.alias("block"), F.greatest(F.lit(1), F.expr("input_file_block_length()")).alias("length"))
    # most bytes of text that a byte of a block stands for (all of the table, where it is not made of files)
    most = own.groupBy("block", "length").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max(F.col("n") / F.col("length"))).first()[0] or 0.0
    parts = F.greatest(F.lit(1), F.ceil(F.col("length") * F.lit(float(most) / chunk_bytes)))
    own = own.select(F.xxhash64("block", F.pmod(F.xxhash64("doc_id", "text"), parts)).alias("chunk"), "doc_id", "held_out", "text")
    with small_batches(spark):
        kept = written(own.mapInArrow(_gather(order, hold), "chunk long, word binary, gram long, n long"))
    words, codes = kept.filter("word is not null"), kept.filter("gram is not null")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("n")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    trie = written(codes.groupBy("gram").agg(F.sum("n").alias("n")))
    three = trie.filter("n > 0").select(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).distinct()
    low = three.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.count("*").alias("n")).toArrow()
    pairs = np.zeros(65536, np.int64)
    pairs[low.column("pair").to_numpy()] = low.column("n").to_numpy()
    context = F.shiftright("gram", 8).bitwiseAND(65535).alias("context")
    logs = trie.select("gram", "n", context).repartition("context").sortWithinPartitions("context").mapInArrow(_trie(pairs.reshape(256, 256), order), "gram long, value double")
    model = words.select("chunk", "word").join(counts, "word").select("chunk", "word", F.lit(None).cast("long").alias("gram"), F.col("n").cast("double").alias("value"))
    model = model.unionByName(codes.select("chunk", "gram").join(logs, "gram").select("chunk", F.lit(None).cast("binary").alias("word"), "gram", "value"))
    return own.groupBy("chunk").cogroup(model.groupBy("chunk")).applyInArrow(_by_chunk(_score(n, v, order)), SCHEMA)


def _by_chunk(score):
    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        return score(docs, model)

    return run


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))
