"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS, "secret")
HASHED, TRAIN_DOCS, CHARS, STEPS, SEED, SURE = 4096, 2000, 20_000, 150, 31, 0.9
TOLERANCE, MOST_ROUNDS, RIDGE = 1e-3, 200, 1e-5
BLANKS = " \t\n\x0b\x0c\r"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|.", re.DOTALL)
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\x20\t]*[=:][\x20\t]*\"?([a-z0-9+/_-]{16,})")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: what precedes it as far as it may, so a long run without @ is passed once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns that pass their tests, by start and then by kind."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def active_words(text: str) -> list[tuple[int, int]]:
    """Spans of the words with a digit or @; every kind has one of them, so other words carry no label."""
    out, end = [], 0
    for m in _ACTIVE.finditer(text):
        start = m.start()
        while start > end and text[start - 1] not in BLANKS:
            start -= 1
        end = m.end()
        out.append((start, end))
    return out


def _shape(word: str) -> str:
    """Runs of letters as a, of digits by their number, other signs as they are; many runs are a mixture of some length."""
    runs = [m[0] for m in _RUN.finditer(word)]
    if len(runs) > 16:
        return f"mixed{min(len(word) // 8, 9)}{'@' in word}"
    return "".join(("d" * len(r) if len(r) < 5 else str(min(len(r), 20))) if r[0].isascii() and r[0].isdigit() else "a" if r[0].isalpha() else r for r in runs)


def _features(word: str, before: str, kinds: set[str]) -> list[int]:
    """Hashed features of one word: its shape, its ends, how many digits and which signs, the word before, fixed patterns."""
    n = sum("0" <= c <= "9" for c in word)
    shape = _shape(word)
    bare = word.strip("<>()[]{},;:.!?\"'#$%&*")
    named = [f"k{bare.isalnum() and not bare.isdigit()}{min(len(bare) // 8, 6)}", f"s{shape}", f"n{min(n, 20)}", f"f{shape[:2]}", f"l{shape[-2:]}", f"r{n / len(word):.1f}", f"p{before}", *(f"c{c}{min(word.count(c), 4)}" for c in "@.-+()/:=" if c in word), f"a{any(c.isalpha() for c in word)}", *(f"b{k}" for k in kinds)]
    return [zlib.crc32(x.encode()) % HASHED for x in named]


def _digits(word: str) -> str:
    return "".join(c for c in word if "0" <= c <= "9")


def _keys(word: str, before: str) -> set[str]:
    """What repeated or similar mentions share: the last seven digits, also over two words, the name before an @, a long word.
    before: the active word just before, if nothing else stands between."""
    out, digits = set(), _digits(word)
    if len(digits) >= 7:
        out.add(f"d{digits[-7:]}")
    elif digits and len(both := _digits(before) + digits) >= 7:
        out.add(f"d{both[-7:]}")
    bare = word.strip("<>()[]{},;:.!?\"'#$%&*").lower()
    name = bare.partition("@")[0]
    if len(name) >= 5 and any(c.isalpha() for c in name):
        out.add(f"n{name}")
    return out


@dataclass
class Graph:
    """Active words of several texts as one graph: chain links between neighbours; skip links from every mention of a key to
    one variable of the key, so that any two mentions in a text are two links apart, however far and many they are."""

    of: np.ndarray
    spans: list[tuple[int, int]]
    features: np.ndarray
    first: np.ndarray  # of each word, its first feature
    chain: np.ndarray
    skip: np.ndarray  # word, key variable (numbered after the words)
    hubs: int
    alone: np.ndarray  # no active word just before (column 0), just after (1)


def graph(texts: list[str], bases: list[list[Span]]) -> Graph:
    of, spans, features, first, chain, skip, alone, hubs = [], [], [], [], [], [], [], 0
    for t, (text, base) in enumerate(zip(texts, bases, strict=True)):
        mentions: dict[str, list[int]] = {}
        before, at = -1, 0
        for start, end in active_words(text):
            i = len(spans)
            word = text[start:end]
            near = before >= 0 and start - before <= 8 and not text[before:start].strip(BLANKS)
            if near:
                chain.append((i - 1, i))
                alone[-1][1] = False
            alone.append([not near, True])
            while at < len(base) and base[at][2] <= start:
                at += 1
            kinds = {k for k, a, b in base[at : at + 8] if a < end and b > start}
            first.append(len(features))
            # a few words before this one say what it is
            lead = text[max(0, start - 24) : start].split()[-1:] or [""]
            features += _features(word, "" if near else lead[0].lower(), kinds)
            for key in _keys(word, text[slice(*spans[-1])] if near else ""):
                own = mentions.setdefault(key, [])
                if not own or own[-1] != i:
                    own.append(i)
            of.append(t)
            spans.append((start, end))
            before = end
        for own in mentions.values():
            if len(own) > 1:
                skip += [(i, hubs) for i in own]
                hubs += 1
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(of, np.int64), spans, np.array(features, np.int64), np.array(first, np.int64), pairs(chain), pairs(skip) + [0, len(spans)], hubs, np.array(alone, bool).reshape(-1, 2))


class Messages:
    """Loopy sum-product on a graph; messages stay between calls, so that small changes of a model take few rounds."""

    def __init__(self, g: Graph, k: int = len(LABELS)):
        links = np.concatenate([g.chain, g.skip])
        self.n, self.m, self.chains = len(g.spans) + g.hubs, len(links), len(g.chain)
        self.u, self.v = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        self.back = np.concatenate([np.arange(self.m) + self.m, np.arange(self.m)])
        self.order = np.argsort(self.v, kind="stable")
        self.at = np.flatnonzero(np.diff(self.v[self.order], prepend=-1))
        self.sent = np.zeros((2 * self.m, k))

    def _belief(self, node: np.ndarray) -> np.ndarray:
        out = node.copy()
        if self.m:
            out[self.v[self.order][self.at]] += np.add.reduceat(self.sent[self.order], self.at, axis=0)
        return out

    def run(self, node: np.ndarray, trans: np.ndarray, skip: np.ndarray, rounds: int) -> np.ndarray:
        """Beliefs after `rounds` rounds, or earlier if no message changes by more than TOLERANCE. All messages go at once, half
        damped."""
        self.sides = [(slice(0, self.chains), trans), (slice(self.chains, self.m), skip), (slice(self.m, self.m + self.chains), trans.T), (slice(self.m + self.chains, 2 * self.m), skip.T)]
        for _ in range(rounds if self.m else 0):
            out = self._belief(node)[self.u] - self.sent[self.back]
            out -= out.max(axis=1, keepdims=True)
            new = np.empty_like(self.sent)
            for part, pair in self.sides:
                new[part] = np.log(np.exp(out[part]) @ np.exp(pair) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            step = np.abs(new - self.sent).max()
            self.sent = (self.sent + new) / 2
            if step < TOLERANCE:
                break
        return self._belief(node)

    def pairs(self, belief: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected number of meetings of two labels over all chain links, and over all skip links."""
        out = []
        for part, pair in self.sides[:2]:
            back = slice(part.start + self.m, part.stop + self.m)
            a, b = belief[self.u[part]] - self.sent[back], belief[self.v[part]] - self.sent[part]
            a, b = np.exp(a - a.max(axis=1, keepdims=True)), np.exp(b - b.max(axis=1, keepdims=True))
            kernel = np.exp(pair)
            whole = ((a @ kernel) * b).sum(axis=1, keepdims=True)
            out.append((a / whole).T @ b * kernel)
        return out[0], out[1]


@dataclass
class SkipChain:
    weights: np.ndarray  # feature x label
    trans: np.ndarray
    skip: np.ndarray  # label of a mention x label of its key

    def nodes(self, g: Graph) -> np.ndarray:
        out = np.zeros((len(g.spans) + g.hubs, len(LABELS)))
        if len(g.spans):
            # words that are not active are O: their chain links are terms of the node
            out[: len(g.spans)] = np.add.reduceat(self.weights[g.features], g.first, axis=0) + g.alone[:, :1] * self.trans[0] + g.alone[:, 1:] * self.trans[:, 0]
        return out

    def marginals(self, g: Graph, rounds: int = MOST_ROUNDS) -> np.ndarray:
        """Of each word. Messages pass until they settle; a graph with loops in which they never do ends after `rounds`."""
        belief = Messages(g).run(self.nodes(g), self.trans, self.skip, rounds)[: len(g.spans)]
        return _shares(belief)


def _shares(belief: np.ndarray) -> np.ndarray:
    p = np.exp(belief - belief.max(axis=1, keepdims=True)) if len(belief) else belief
    return p / p.sum(axis=1, keepdims=True) if len(p) else p


def _labels(g: Graph, spans: list[list[Span]]) -> np.ndarray:
    """Label of each active word: the kind of the first span it overlaps, else 0."""
    out, at, t = np.zeros(len(g.spans), np.int64), 0, -1
    for i, (a, b) in enumerate(g.spans):
        if g.of[i] != t:
            t, at = int(g.of[i]), 0
        while at < len(spans[t]) and spans[t][at][2] <= a:
            at += 1
        out[i] = next((LABELS.index(k) for k, s, e in spans[t][at : at + 8] if s < b and a < e), 0)
    return out


def _variant(kind: str, mention: str, rng: random.Random) -> str:
    """The mention as the fixed patterns do not know it."""
    if kind == "email":
        name, _, host = mention.partition("@")
        return rng.choice([f"{name} @{host}", f"{name}@ {host}", f"{name}@{host.partition('.')[0]}", f"{name}@{host.replace('.', ',')}"])
    if kind == "phone":
        own = re.sub(r"^\+[0-9]{1,3}[\x20.-]*", "", mention)
        return rng.choice([own, re.sub("[^0-9]+", ".", own).strip("."), re.sub("[^0-9]+", "/", own).strip("/"), f"00{mention[1:]}", re.sub("[^0-9]+", "-", own).strip("-")])
    if kind == "ip":
        return mention.replace(".", rng.choice("-,_"))
    if kind == "card":
        digits = _digits(mention)
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return rng.choice([".", "/", "_"]).join(groups)
    return mention


def planted(text: str, rng: random.Random) -> tuple[str, list[Span]]:
    """A text made of this one, with the spans that a reader would mark: some mentions are written otherwise, some come again
    far away in another form or with a number right behind, and numbers that mean nothing stand among them."""
    seeds = sorted(base_spans(text) + [("secret", *m.span(1)) for m in _SECRET.finditer(text)], key=lambda s: s[1])
    out, spans, n, end, own = [], [], 0, 0, []

    def put(piece: str, kind: str = "") -> None:
        nonlocal n
        if kind:
            spans.append((kind, n, n + len(piece)))
        out.append(piece)
        n += len(piece)

    for kind, a, b in seeds:
        if a < end:
            continue
        put(text[end:a])
        own.append((kind, text[a:b]))
        put(_variant(kind, text[a:b], rng) if rng.random() < 0.3 else text[a:b], kind)
        if rng.random() < 0.2:
            put(f" {rng.randint(1, 9999)}")
        end = b
    put(text[end:])
    words = text.split()
    filler = lambda: put(" " + " ".join(rng.choices(words, k=rng.randint(2, 8))) + " ") if words else put(" ")
    for kind, mention in own:
        if rng.random() < 0.6:
            filler()
            put(_variant(kind, mention, rng), kind)
    for _ in range(rng.randint(0, 3)):
        x, y, z = rng.randint(1, 12), rng.randint(1, 28), rng.randint(1950, 2040)
        filler()
        put(rng.choice([f"{z}-{x:02d}-{y:02d}", f"{y}.{x}.{z}", f"{x}.{y}", f"{x}.{y}.{x}", f"{z}", f"{z * y},{y}", f"#{z * x * y}", f"{z}/{x}", f"{rng.getrandbits(40)}", f"{x}:{y:02d}", f"{y}%", f"@{words[0] if words else 'x'}"]))
    put(" ")
    return "".join(out), spans


def fit(texts: list[str], steps: int = STEPS, seed: int = SEED) -> SkipChain:
    """Likelihood of the labels of the texts and of one planted version of each, with loopy message passing at every step.

    Word weights, chain and skip potentials are learned together: observed minus expected meetings of labels, the expected
    ones from messages that go on from step to step. The label of a key in training is that of most of its mentions.
    """
    rng = random.Random(seed)
    marked = [(t, sorted(base_spans(t) + [("secret", *m.span(1)) for m in _SECRET.finditer(t)], key=lambda s: s[1])) for t in texts]
    marked += [planted(t, rng) for t in texts]
    g = graph([t for t, _ in marked], [base_spans(t) for t, _ in marked])
    k = len(LABELS)
    model = SkipChain(np.zeros((HASHED, k)), np.zeros((k, k)), np.zeros((k, k)))
    if not g.spans:
        return model
    y = _labels(g, [s for _, s in marked])
    want = np.eye(k)[y]
    votes = np.zeros((g.hubs, k))
    np.add.at(votes, g.skip[:, 1] - len(y), want[g.skip[:, 0]])
    key = np.concatenate([y, votes.argmax(axis=1)])
    met_chain, met_skip = np.zeros((k, k)), np.zeros((k, k))
    np.add.at(met_chain, (y[g.chain[:, 0]], y[g.chain[:, 1]]), 1)
    np.add.at(met_skip, (key[g.skip[:, 0]], key[g.skip[:, 1]]), 1)
    order = np.argsort(g.features, kind="stable")
    starts = np.flatnonzero(np.diff(g.features[order], prepend=-1))
    word = np.repeat(np.arange(len(y)), np.diff(np.append(g.first, len(g.features))))[order]
    moments = [np.full_like(x, 1e-8) for x in (model.weights, model.trans, model.skip)]
    messages = Messages(g)
    for step in range(steps):
        belief = messages.run(model.nodes(g), model.trans, model.skip, 8 if step == 0 else 3)
        p = _shares(belief[: len(y)])
        chain, skip = messages.pairs(belief)
        miss = p - want
        weights = RIDGE * model.weights
        weights[g.features[order][starts]] += np.add.reduceat(miss[word], starts, axis=0) / len(y)
        trans = (chain - met_chain) / len(y) + RIDGE * model.trans
        trans[0] += (g.alone[:, :1] * miss).sum(axis=0) / len(y)
        trans[:, 0] += (g.alone[:, 1:] * miss).sum(axis=0) / len(y)
        for x, grad, moment in zip((model.weights, model.trans, model.skip), (weights, trans, (skip - met_skip) / len(y) + RIDGE * model.skip), moments, strict=True):
            moment += grad**2
            x -= 0.3 * grad / np.sqrt(moment)
    return model


def find(texts: list[str], model: SkipChain, sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the fixed patterns, all spans) of each text; a span is added where no fixed one overlaps it."""
    base = [base_spans(t) for t in texts]
    g = graph(texts, base)
    p = model.marginals(g)
    label = np.where(p.max(axis=1, initial=0) >= sure, p.argmax(axis=1), 0) if len(p) else np.zeros(0, np.int64)
    added: list[list[Span]] = [[] for _ in texts]
    joined = {int(b) for b in g.chain[:, 1]}
    for i in np.flatnonzero(label).tolist():
        t, (a, b), kind = int(g.of[i]), g.spans[i], LABELS[label[i]]
        word = texts[t][a:b]
        a, b = a + len(word) - len(word.lstrip("<([{\"'")), b - (len(word) - len(word.rstrip(",.;:!?>)]}\"'#$%&*")))
        own = added[t]
        if any(s < b and a < e for _, s, e in base[t]):
            continue
        if i in joined and label[i - 1] == label[i] and kind in ("card", "phone") and own and own[-1][0] == kind and own[-1][2] >= g.spans[i - 1][0]:
            own[-1] = (kind, own[-1][1], b)
        elif a < b:
            own.append((kind, a, b))
    order = lambda s: (s[1], LABELS.index(s[0]))
    return [(own, sorted(own + more, key=order)) for own, more in zip(base, added, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def train(docs: DataFrame, most: int = TRAIN_DOCS, key: str = "doc_id", text: str = "text", chars: int = CHARS) -> SkipChain:
    """Fits on at most `most` different rows with a digit or @, those that come first by hash of id and text; of a longer text a
    window of `chars` characters, its place by that hash. The driver gets no more than most x chars characters. Labels are the
    fixed patterns and what planted() writes into the sample."""
    at = F.xxhash64(F.lit(SEED), F.col(key).cast("string"), F.col(text).cast("string"))
    own = docs.select(F.col(text).cast("string").alias("text"), at.alias("at")).filter(F.col("text").rlike("[0-9@]"))
    last = own.select("at").distinct().orderBy("at").limit(most).agg(F.max("at")).first()[0]
    if last is None:
        return fit([])
    start = F.pmod("at", F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1
    got = own.filter(F.col("at") <= last).groupBy("at").agg(F.first(F.substring("text", start.cast("int"), F.lit(chars))).alias("text")).toArrow().sort_by("at")
    return fit(got.column("text").to_pylist())


def _batches(x: pa.RecordBatch, at: int, model: SkipChain) -> Iterator[tuple[list[str], list[tuple[list[Span], list[Span]]]]]:
    for lo in range(0, x.num_rows, 512):
        texts = [t or "" for t in x.column(at).slice(lo, 512).to_pylist()]
        yield texts, find(texts, model)


def _report(model: SkipChain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [f for _, part in _batches(x, 1, model) for f in part]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            personal, secret = ([joined([s for s in every if (s[0] in KINDS) == wanted]) for _, every in found] for wanted in (True, False))
            yield pa.RecordBatch.from_arrays([x.column(0), *counts, *(pa.array(c, pa.string()) for c in (digests, personal, secret))], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "secrets"])

    return run


def personal_data(docs: DataFrame, model: SkipChain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (by the fixed patterns), base_sha256, spans (all of those kinds) and secrets (spans
    of keys and tokens, which no fixed pattern finds) for each row of docs.

    Null texts count as empty; repeated rows stay; an empty table returns no rows; other columns are ignored.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_report(model), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, secrets string")


def masked(text: str, spans: list[Span]) -> str:
    """text with [KIND] in place of each span; of spans that overlap the first one's kind stands for all."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _masks(model: SkipChain, at: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            nulls = x.column(at).is_null().to_pylist()
            new = [masked(t, every) for texts, part in _batches(x, at, model) for t, (_, every) in zip(texts, part, strict=True)]
            columns = list(x.columns)
            columns[at] = pa.array([None if n else t for n, t in zip(nulls, new, strict=True)], pa.string())
            if chars >= 0:
                columns[chars] = pa.array([None if n else len(t) for n, t in zip(nulls, new, strict=True)], pa.int64()).cast(x.schema.types[chars])
            yield pa.RecordBatch.from_arrays(columns, x.schema.names)

    return run


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data and secrets masked, and n_chars (of its own type) of the new texts.

    Null texts and their n_chars become null; repeated rows stay; an empty table gives no rows; other columns stay.
    """
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    return docs.mapInArrow(_masks(train(docs), at, chars), docs.schema)
