"""Digest trees against a full join of all files."""

import random

from loomery.sources import digests


def plain(old, new):
    return sorted((p, "added" if p not in old else "removed" if p not in new else "modified") for p in old.keys() | new.keys() if old.get(p) != new.get(p))


def test_difference_equals_the_full_join_and_looks_only_where_folders_differ(spark):
    rng = random.Random(1)
    old = {f"d{rng.randrange(12)}/e{rng.randrange(12)}/f{i}.yaml": f"h{i}" for i in range(3000)} | {"top.md": "x", "d0/g/deep/er/file": "y"}
    frame = lambda files: spark.createDataFrame(list(files.items()), "path string, hash string")
    first = digests.tree(frame(old))
    new = dict(old)
    for p in rng.sample(sorted(old), 5):
        new[p] = "changed"
    for p in rng.sample(sorted(old), 3):
        new.pop(p)
    new |= {"d0/e0/new.yaml": "n", "fresh/a/b": "n", "top.md": "z"}
    found = digests.Difference(first, digests.tree(frame(new)))
    assert sorted(map(tuple, found.found.collect())) == plain(old, new)
    assert found.compared < 700
    same = digests.Difference(first, digests.tree(frame(old)))
    assert same.found.collect() == [] and same.compared <= 14


def test_trees_of_nothing(spark):
    frame = lambda files: spark.createDataFrame(files, "path string, hash string")
    none, one = digests.tree(frame([])), digests.tree(frame([("a/b", "h"), (None, "x")]))
    assert digests.Difference(none, none).found.collect() == []
    assert [tuple(r) for r in digests.Difference(none, one).found.collect()] == [("a/b", "added")]
    assert [tuple(r) for r in digests.Difference(one, none).found.collect()] == [("a/b", "removed")]
