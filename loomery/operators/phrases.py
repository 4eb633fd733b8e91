"""Any number of phrases found or rewritten in one pass: leftmost first, of those the longest, whole words, in any case."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
MOST = 1_000_000  # phrases that are sent to the tasks


class Phrases:
    """A phrase is looked up by its first word and then by its number of words, longest first, so a text costs its words times the
    few lengths that begin with each, whatever the number of phrases."""

    def __init__(self, pairs: dict[str, str]) -> None:
        self.pairs: dict[str, str] = {}
        self.lengths: dict[str, list[int]] = {}
        for phrase, value in pairs.items():
            low = phrase.lower()
            words = WORD.findall(low)
            if not words or not (WORD.match(low) and WORD.match(low[-1])):
                raise ValueError(f"a phrase begins and ends with a word: {phrase!r}")
            self.pairs[low] = value
            own = self.lengths.setdefault(words[0], [])
            if len(words) not in own:
                own.append(len(words))
                own.sort(reverse=True)

    def matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, value) of each phrase, from left to right, none within another."""
        low = text.lower()
        if len(low) != len(text):  # a letter that grows in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans = [m.span() for m in WORD.finditer(low)]
        i = 0
        while i < len(spans):
            start = spans[i][0]
            for n in self.lengths.get(low[start : spans[i][1]], ()):
                if i + n <= len(spans) and (value := self.pairs.get(low[start : spans[i + n - 1][1]])) is not None:
                    yield start, spans[i + n - 1][1], value
                    i += n - 1
                    break
            i += 1

    def rewritten(self, text: str) -> str:
        out, at = [], 0
        for start, end, value in self.matches(text):
            out += [text[at:start], value]
            at = end
        return "".join([*out, text[at:]])


def rewritten(df: DataFrame, text: str, phrases: DataFrame, most: int = MOST) -> DataFrame:
    """df with its texts rewritten: phrases(phrase, value), one value a phrase (the first in order where there are more). Null texts stay
    null. The phrases go to every task, so there may be `most` at most; more are an error."""
    rows = phrases.groupBy(F.lower("phrase").alias("phrase")).agg(F.min("value").alias("value")).limit(most + 1).toArrow()
    if len(rows) > most:
        raise ValueError(f"more than {most} phrases")
    known = df.sparkSession.sparkContext.broadcast(Phrases(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                new = pa.array([None if t is None else known.value.rewritten(t) for t in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, part.schema.field(at).with_type(pa.string()), new)

    return df.withColumn(text, F.col(text).cast("string")).mapInArrow(run, df.withColumn(text, F.col(text).cast("string")).schema)
