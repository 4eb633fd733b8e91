"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Sets are compared within groups that share a rare shingle, which no pair at the least similarity escapes. In every group the
Gray-order index over SimHash fingerprints gives the candidate pairs, an exact bound on differing shingles drops what cannot reach the
similarity, and what is left joins families. Whole sets come together by family, once a node, and all links are verified there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import by_key, each, is_marked, marks, place, slices
from loomery.llm.gray_index import GrayIndex, gray_rank
from loomery.operators.components import connected_components, local_roots
from loomery.session import materialize, written

SEED, SHINGLE, LEAST = 42, 5, (4, 5)
#: Bits of 64 in which two fingerprints may differ. Of two sets at 0.8 a bit differs with chance 0.15, so by the binomial law one pair
#: in 90 billion differs in more than 32; of the smallest sets (4 of 5 shingles, 0.19) one in 200 million.
DIFFER = 32
BUCKETS, CROWD, ROUNDS, SLICE, SET_SLICE, ROWS = 1 << 18, 64, 2, 2048, 1 << 20, 200_000



def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased words' shingles; one for all words of a shorter text, none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    each_word = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))
    n = len(words) - shingle + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(shingle):
        mixed = (mixed ^ each_word[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def digest(found: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles."""
    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0])


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(46)).astype(np.int64)


def _print(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, as a signed number in an array."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 8192):
        ones += np.unpackbits(found[i : i + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)


def _parity(found: np.ndarray) -> bytes:
    """For each of hashed places, a power of two at least as many as shingles, whether an odd number of them fell there. Two sets differ
    in no fewer shingles than such bitmaps in bits."""
    places = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def _named(shingle: int):
    """Row key, set name, size, fingerprint and parity bitmap of each text; then how many shingles of the partition fell in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(BUCKETS, np.int64), ["doc_id", "row", "node", "size", "fp", "bits", "bucket", "n"]
        none = lambda n: pa.nulls(n, pa.int64())
        for x in batches:
            nodes, sizes, prints, bits = [], [], [], []
            for t in each(x.column("text")):
                found = shingles(t, shingle)
                nodes.append(digest(found))
                sizes.append(len(found))
                prints.append(int(_print(found)[0]))
                bits.append(_parity(found))
                np.add.at(counts, _bucket(found), 1)
            known = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("row"), *known, none(x.num_rows), none(x.num_rows)], names)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([*[none(len(at))] * 5, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(counts[at])], names)

    return run


def _keys(common: np.ndarray, shingle: int):
    """The rarest |x| - ceil(0.8 |x|) + 1 shingles of each set: two sets at 0.8 or more share one of them.

    Rare is by counts of hashed buckets, ties by hash: any order will do as long as all texts use the same one. A shingle
    alone in its bucket is in no other text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for x in batches:
            keys, nodes = [], []
            for t in each(x.column("text")):
                found = shingles(t, shingle)
                node, n = digest(found), len(found)
                if not n or node in seen:
                    continue
                seen.add(node)
                count = common[_bucket(found)]
                first = np.lexsort((found, count))[: n + LEAST[0] * n // -LEAST[1] + 1]
                first = first[count[first] > 1]
                keys.append(found[first].view(np.int64))
                nodes.append(np.full(len(first), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes)], ["key", "node"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each key (rows: key, node, sorted) that several have. Copies share most of their keys, so a group is named by its nodes
    and stands once."""
    for rows in by_key(batches, 0, ROWS):
        key, node = (rows.column(i).to_numpy() for i in range(2))
        other = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # several tasks may name a node
        key, node = key[other], node[other]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes, name = np.diff(np.append(starts, len(key))), np.add.reduceat(node, starts)
        once = np.zeros(len(starts), bool)
        once[np.unique(name, return_index=True)[1]] = True
        many = np.repeat(once & (sizes > 1), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[many]), pa.array(node[many])], ["key", "node"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity."""
    return LEAST[1] * np.minimum(a, b) >= LEAST[0] * np.maximum(a, b)


class _Bitmaps:
    """Bitmaps of sets one behind the other, in words of 64 bits."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        held = column.to_pylist()
        self.words, self.width = np.frombuffer(b"".join(held), np.uint64), np.array([len(x) // 8 for x in held])
        self.first = np.cumsum(self.width) - self.width

    def _rows(self, of: np.ndarray, width: int, skip: int = 0) -> np.ndarray:
        return self.words[self.first[of][:, None] + np.arange(skip, skip + width)]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which bitmaps a[i] and b[i] differ. Sizes that are alike have as many places or twice as many, which are folded."""
        narrow, wide = np.where(self.width[a] <= self.width[b], a, b), np.where(self.width[a] <= self.width[b], b, a)
        out = np.zeros(len(a), np.int64)
        for width in np.unique(self.width[narrow]).tolist():
            for times in (1, 2):
                at = np.flatnonzero((self.width[narrow] == width) & (self.width[wide] == times * width))
                for lo, hi in slices(np.full(len(at), width), 1 << 21):
                    i = at[lo:hi]
                    bits = self._rows(narrow[i], width) ^ self._rows(wide[i], width)
                    if times == 2:
                        bits ^= self._rows(wide[i], width, width)
                    out[i] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return out


def _close(apart: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity: at 0.8 they differ in a ninth of both at most."""
    return (LEAST[1] + LEAST[0]) * apart <= (LEAST[1] - LEAST[0]) * (size + other)


def _near(differ: int):
    """Stars of the candidates of each group (rows: group, sorted; own slice, whether there are two, node, size, fp, bits): pairs that
    the Gray index gives, of sizes and bitmaps that can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 0, ROWS):
            group, own, both, node, size, code = (rows.column(i).to_numpy() for i in range(6))
            code, bits = code.view(np.uint64), _Bitmaps(rows.column(6))
            order = np.lexsort((gray_rank(code), group))
            group, own, both, node, size, code = (v[order] for v in (group, own, both, node, size, code))
            root = np.arange(len(node))
            for a, b in GrayIndex(group, code).pairs(differ):
                near = (~both[a] | (own[a] != own[b])) & _alike(size[a], size[b])
                a, b = a[near], b[near]
                for lo in range(0, len(a), ROWS):
                    x, y = a[lo : lo + ROWS], b[lo : lo + ROWS]
                    new = root[x] != root[y]
                    x, y = x[new], y[new]
                    near = _close(bits.apart(order[x], order[y]), size[x], size[y])
                    root = local_roots(np.concatenate([np.arange(len(node)), x[near]]), np.concatenate([root, y[near]]), len(node))
            far = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    return run


def _linked(differ: int):
    """Stars of what is similar in each group (rows: group, sorted; own slice, whether there are two, node, fp, found). A pair that
    others link already is not verified, so most of a family of copies is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 0, 256):
            group, own, both, node, code = (rows.column(i).to_numpy() for i in range(5))
            code = code.view(np.uint64)
            order = np.lexsort((gray_rank(code), group))
            group, own, both, node, code = (v[order] for v in (group, own, both, node, code))
            found = rows.column(5).combine_chunks()
            flat, cuts = found.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(found.offsets.to_numpy())))
            size = np.diff(cuts)[order]
            root = np.arange(len(node))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for a, b in GrayIndex(group, code).pairs(differ):
                near = (~both[a] | (own[a] != own[b])) & _alike(size[a], size[b])
                a, b = a[near], b[near]
                for lo in range(0, len(a), 4096):
                    x, y = a[lo : lo + 4096], b[lo : lo + 4096]
                    root = local_roots(np.arange(len(node)), root, len(node))
                    new = root[x] != root[y]
                    for i, j in zip(x[new].tolist(), y[new].tolist(), strict=True):
                        p, q = top(i), top(j)
                        if p != q and _reaches(flat[cuts[order[i]] : cuts[order[i] + 1]], flat[cuts[order[j]] : cuts[order[j] + 1]]):
                            root[max(p, q)] = min(p, q)
            root = local_roots(np.arange(len(node)), root, len(node))
            far = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    return run


def _dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """group, own, both, node of rows (family, node, size): each family is dealt in slices of weight `most`, each two of them a group,
    so that each pair that sizes allow is in one. Families of more than four slices are first cut in overlapping bands of size."""
    parts = lambda *by: rows.groupBy(*by).agg(F.greatest(F.ceil(F.sum(weight) / most), F.least(F.lit(4), F.ceil(16 * F.sum(weight) / most))).cast("int").alias("parts"))
    level = F.floor(F.log("size") / math.log(1.26)).cast("int")  # a fourth more is one level at most
    band = F.when(F.col("parts") > 4, F.array(level, level - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.join(parts("family"), "family").select("family", "node", "size", F.explode(band).alias("band"))
    cut = rows.join(parts("family", "band"), ["family", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    return cut.select(F.xxhash64("family", "band", "one", "two").alias("group"), "own", (F.col("one") != F.col("two")).alias("both"), "node")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group")


def _met(rows: DataFrame, info: DataFrame, differ: int) -> DataFrame:
    """a, b: candidates among rows (key, node) that no star has found. Nodes that keys connect are one family, which is dealt in slices."""
    family = connected_components(rows.select("node", "key")).withColumnRenamed("component", "family")
    own = materialize(rows.select("node").distinct().join(family, "node").join(info.select("node", "size"), "node"))
    cut = _dealt(own, F.lit(1), SLICE).join(info, "node").select("group", "own", "both", "node", "size", "fp", "bits")
    return materialize(_by_group(cut).mapInArrow(_near(differ), "a long, b long"))


def _open(rows: DataFrame, family: DataFrame) -> DataFrame:
    """rows (key, node) with the family of each node; keys whose nodes are all of one family go."""
    known = rows.join(family, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return known.join(known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "key")


def _leads(rows: DataFrame) -> DataFrame:
    """a, b: of each key the node with the most crowded keys, and each other one that is not of its family. The text that others were
    made of has all of its keys in common with them, a copy also has keys of its own. Aggregations only: no group comes together
    in a task."""
    times = rows.groupBy("node").agg(F.count("*").alias("times"))
    best = F.max(F.struct("times", F.col("node").alias("lead"), F.col("component").alias("family")))
    leads = rows.join(times, "node").groupBy("key").agg(best.alias("x")).select("key", "x.lead", "x.family")
    return rows.join(leads, "key").filter("component <> family").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if not x.num_rows:
            continue
        size, other = x.column("size").to_numpy(), x.column("other").to_numpy()
        x = x.filter(pa.array(_alike(size, other)))
        size, other, at = x.column("size").to_numpy(), x.column("other").to_numpy(), np.arange(x.num_rows)
        bits = _Bitmaps(pa.concat_arrays([x.column("x"), x.column("y")]))
        yield x.select(["a", "b"]).filter(pa.array(_close(bits.apart(at, at + len(at)), size, other)))


def _sets(wanted: np.ndarray, shingle: int):
    """node, found: the sets of texts (at, text) whose place is marked, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for x in batches:
            x = x.filter(pa.array(is_marked(wanted, x.column("at").to_numpy())))
            for lo in range(0, x.num_rows, 256):
                nodes, found = [], []
                for t in each(x.column("text").slice(lo, 256)):
                    one = shingles(t, shingle)
                    node = digest(one)
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        found.append(one.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    return run


def _reaches(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _verified(texts: DataFrame, family: DataFrame, info: DataFrame, differ: int, shingle: int) -> DataFrame:
    """node, component: what verified links of the families reach. Only the sets of their nodes move, not the texts."""
    own = materialize(family.withColumnRenamed("component", "family").join(info.select("node", "size", "fp", "at"), "node"))
    wanted = marks(own.select("at"))
    sets = texts.select(place("doc_id", "row").alias("at"), "text").mapInArrow(_sets(wanted, shingle), "node long, found array<long>")
    sets = written(sets.join(own.select("node", "fp"), "node"))  # several tasks may bring a set, which is linked with itself then
    cut = _dealt(own.select("family", "node", "size"), F.col("size"), SET_SLICE).join(sets, "node").select("group", "own", "both", "node", "fp", "found")
    return materialize(connected_components(materialize(_by_group(cut).mapInArrow(_linked(differ), "a long, b long"))))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, differ: int = DIFFER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), component for each row: texts whose sets of shingles have a Jaccard similarity of
    LEAST or more are linked, and components are what links reach.

    Equal sets are one node. Nodes meet by their rarest shingles, which holds every pair at LEAST or more, and a group of nodes is looked
    at once, however many shingles it shares. In each group the Gray index gives the pairs of fingerprints at `differ` bits or
    fewer; those whose sizes and parity bitmaps can reach LEAST are candidates, of which a group returns stars. Groups of more than CROWD
    nodes first compare all with one node a round, so that a large group of near copies is one star; what then is of several families
    is cut into slices, each two of which meet in a task of bounded size. Components of the candidates are families: no link
    leaves one. Each node's set goes to its family (a large one is dealt in slices again), where the Gray index's pairs are verified;
    this returns stars, too, so no pair is left out and none is listed. Null texts and texts without a
    word are one node; repeated rows stay; an empty table gives no rows.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("row"), F.col(text).cast("string").alias("text"))
    named = written(texts.mapInArrow(_named(shingle), "doc_id long, row long, node long, size long, fp long, bits binary, bucket long, n long"))
    rows = named.filter("bucket is null").select("doc_id", "row", "node")
    counted = named.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    if not len(counted):
        return rows.withColumnRenamed("node", "component")
    common = np.zeros(BUCKETS, np.int64)
    common[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    keyed = texts.select("text").mapInArrow(_keys(common, shingle), "key long, node long")
    groups = written(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_groups, "key long, node long").distinct())
    # what is known of a node's set, and the place of one of its rows, which is aggregated where the rows lie: copies of one text never meet
    same = named.filter("bucket is null").groupBy("node").agg(*[F.max(c).alias(c) for c in ("size", "fp")], F.max("bits").alias("bits"), F.min(place("doc_id", "row")).alias("at"))
    info = written(same.join(groups.select("node").distinct(), "node", "left_semi"))
    shared = groups.join(groups.groupBy("key").agg(F.count("*").alias("n")), "key")
    small = shared.filter(F.col("n") <= CROWD).select(F.col("key").alias("group"), F.lit(0).alias("own"), F.lit(False).alias("both"), "node")
    edges = materialize(_by_group(small.join(info, "node").select("group", "own", "both", "node", "size", "fp", "bits")).mapInArrow(_near(differ), "a long, b long").distinct())
    family = materialize(connected_components(edges))
    crowds = materialize(shared.filter(F.col("n") > CROWD).select("key", "node"))
    for _ in range(ROUNDS):
        crowds = materialize(_open(crowds.select("key", "node"), family))
        if crowds.isEmpty():
            break
        met = _leads(crowds).join(info.select(F.col("node").alias("a"), "size", "fp", F.col("bits").alias("x")), "a")
        met = met.join(info.select(F.col("node").alias("b"), F.col("size").alias("other"), F.col("fp").alias("fq"), F.col("bits").alias("y")), "b")
        met = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= differ).select("a", "b", "size", "other", "x", "y")
        edges = edges.unionByName(materialize(met.mapInArrow(_compared, "a long, b long")))
        family = materialize(connected_components(edges))
    else:
        rest = materialize(_open(crowds.select("key", "node"), family))
        family = materialize(connected_components(edges.unionByName(_met(rest, info, differ))))
    return rows.join(_verified(texts, family, info, differ, shingle), "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
