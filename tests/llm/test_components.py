"""Connected components against a union-find, and the size of what a group of near copies makes."""

import random

import pytest

from barsmith.llm import components, jaccard_join


def union_find(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for node, key in rows:
        if node is not None and key is not None:
            root[find(("n", node))] = find(("k", key))
    groups = {}
    for node, key in rows:
        if node is not None and key is not None:
            groups.setdefault(find(("n", node)), set()).add(node)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def found(spark, rows):
    got = components.connected_components(spark.createDataFrame(rows, "node long, key long")).collect()
    assert len({r["node"] for r in got}) == len(got)  # a row for each node
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert all(c in g for c, g in groups.items())
    return sorted(sorted(g) for g in groups.values())


r = random.Random(5)
GRAPHS = {
    "path": [(i + d, i) for i in range(300) for d in (0, 1)],
    "star": [(0, 0)] + [(i, 0) for i in range(1, 200)] + [(-i, i) for i in range(1, 200)] + [(i, i) for i in range(1, 200)],
    "random": [(r.getrandbits(63) % 400 - 200, r.getrandbits(63) % 350) for _ in range(600)],
    "nothing": [],
    "nulls": [(None, 1), (1, None), (2, 1), (3, 1), (3, 1), (2**63 - 1, 7), (-(2**63), 7), (5, 9)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_equals_union_find(spark, name):
    assert found(spark, GRAPHS[name]) == union_find(GRAPHS[name])


def test_a_group_of_near_copies_makes_no_square(spark, monkeypatch):
    """2,000 near copies of one text: nothing that is written has more rows than the sets have keys."""
    r, sizes, write = random.Random(8), [], components.stored

    def counted(df, name):
        out = write(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(components, "stored", counted)
    monkeypatch.setattr(jaccard_join, "stored", counted)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(2000):
        at = r.randrange(60)
        texts.append(" ".join([*words[:at], f"x{r.random()}", *words[at + 1 :]]))
    got = jaccard_join.similarity_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got.select("component_id").distinct().count() == 1
    keys = max(n for name, n in sizes if name == "keys")
    assert keys < 2000 * 60 and all(n <= keys for name, n in sizes if name in ("members", "moves", "components", "roots"))
