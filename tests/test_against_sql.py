"""Queries against their SQL on small odd tables."""

import datetime as dt

import duckdb
import pytest

from loomery import catalog


@pytest.fixture
def compared(spark, tmp_path):
    """compared(query, table=(rows, schema)): the rows of the query and of its SQL over these tables, sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        columns = ", ".join(sorted(df.columns))
        want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr), sorted(want, key=repr)

    return run


def events(kinds, seconds):
    """An event of user 1 for each pair of kind and seconds, then each once more for a null user."""
    start = dt.datetime(2024, 1, 1)
    rows = [(None if s is None else start + dt.timedelta(seconds=s), u, k) for u in (1, None) for k, s in zip(kinds, seconds, strict=True)]
    return [(i, at, u, k, 1.0, "") for i, (at, u, k) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_repeat_abuse_counts_seconds_as_its_sql(compared):
    """Seconds are rounded, halves to the even one: 0.6 is 1, 200000.4 is 200000, 0.5 is 0, 1.5 is 2."""
    got, want = compared("gr16_repeat_abuse", events=events("aaaabbbbccc", [0.6, 100, 200000.4, 200000.6, 0.5, 100, 199999.5, 200000.5, 1.5, 100, 200001.4]))
    assert got == want and {r for r, _ in want} == {True, False}


def test_repeat_abuse_of_odd_intents(compared):
    kinds = ["click", "Click", "click ", None, "", " ", "\t", "  "] * 4
    got, want = compared("gr16_repeat_abuse", events=events(kinds, [None if i % 9 == 8 else i for i in range(32)]))
    assert got == want and None in {r for r, _ in want}


def test_same_meaning_counts_seconds_as_its_sql(compared):
    got, want = compared("gr16_same_meaning", events=events("aaaaabbbbb", [0.6, 1, 2, 3, 600000.4, 0.5, 1, 2, 3, 599999.5]))
    assert got == want and {r for r, _ in want} == {True, False}


def test_same_meaning_of_odd_intents(compared):
    """Case and blanks make another meaning; null is one of its own."""
    kinds = ["click", "Click", "click ", None, "", " ", "\t"] * 6
    got, want = compared("gr16_same_meaning", events=events(kinds, [None if i % 9 == 8 else i for i in range(42)]))
    assert got == want and {r for r, _ in want} == {True, False}


def test_part_containment_of_repeated_urls(compared):
    urls = ["http://m.example.org/en/1", "http://m.example.org/en/1", "http://x/fr/en", "http://x/fr/en", "http://en.x//", "", None]
    got, want = compared("j09_part_containment", pages=([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string"))
    assert got == want and len(want) == 6
