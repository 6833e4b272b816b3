from __future__ import annotations

import random
from collections import defaultdict

import pytest
from compare import rows

from locusframe.operators import hierarchy


def brute(links):
    """Depths by walking, loops by mutual reach."""
    edges = {(p, c) for p, c in links if p is not None and c is not None}
    selfs = {p for p, c in edges if p == c}
    edges = {e for e in edges if e[0] != e[1]}
    below, above, nodes = defaultdict(set), defaultdict(set), set(selfs)
    for p, c in edges:
        below[p].add(c)
        above[c].add(p)
        nodes |= {p, c}

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for z in below[todo.pop()]:
                if z not in seen:
                    seen.add(z)
                    todo.append(z)
        return seen

    r = {n: reach(n) for n in nodes}
    out = {(n, min(m for m in r[n] if n in r[m]), -1) for n in nodes if n in r[n]}
    loop = {n for n, _, _ in out}
    out |= {(n, n, -1) for n in selfs - loop}
    for root in (n for n in nodes if not above[n]):
        step = {root}
        d = 0
        while step:
            out |= {(n, root, d) for n in step}
            step, d = {c for n in step for c in below[n] if c not in loop}, d + 1
    return out


def random_links(seed):
    random.seed(seed)
    n = 40
    links = [(f"a{random.randint(0, n)}", f"a{random.randint(0, n)}") for _ in range(34)]
    links += [(f"z{i}", f"z{i + 1}") for i in range(45)] + [(f"y{i}", f"y{(i + 1) % 5}") for i in range(5)]
    return [*links, ("y3", "w1"), ("w1", "w2"), ("w1", "a1"), ("q", "q"), ("k", "k"), ("k", "k2"), (None, "x"), ("x", None), ("z3", "z9"), ("hub", "leaf")] + [("hub", f"h{i}") for i in range(30)] + links[:3]


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    links = random_links(seed)
    f = hierarchy.decompose(spark.createDataFrame(links, "p string, c string"), "p", "c")
    assert set(rows(hierarchy.hierarchy_rows(f))) == brute(links)
    # a chain is at most log2(n) light steps from its top, and its positions are dense
    assert f.labels.groupBy("chain", "pos").count().filter("count > 1").count() == 0
    paths = {r["node"]: r["path"] for r in hierarchy.tree_paths(f).collect()}
    assert paths["z45"].split("/")[0] in ("z0", "z9") and paths["z2"] == "z0/z1/z2"
    below = rows(hierarchy.descendants(f, spark.createDataFrame([("hub",), ("z0",), ("w1",)], "node string")))
    assert {d for n, d in below if n == "hub"} == {"leaf"} | {f"h{i}" for i in range(30)}
    assert {d for n, d in below if n == "z0"} >= {f"z{i}" for i in range(1, 9)}


@pytest.mark.parametrize("seed", [1])
def test_paths_and_descendants_over_joints(spark, seed):
    links = random_links(seed)
    links += [("r1", "j"), ("r2", "j"), ("j", "k1"), ("k1", "m"), ("r2", "m"), ("m", "n")]
    f = hierarchy.decompose(spark.createDataFrame(links, "p string, c string"), "p", "c")
    edges = {(p, c) for p, c in links if p and c and p != c}
    want = {x for x in brute(links) if x[2] >= 0}
    got = rows(hierarchy.tree_paths(f))
    assert {(n, t, d) for n, t, d, _ in got if (t, t, 0) in want} == want and len(got) == len({x[:3] for x in got})
    for n, t, d, path in got:
        steps = path.split("/")
        assert (steps[0], steps[-1], len(steps)) == (t, n, d + 1) and set(zip(steps, steps[1:])) <= edges
    below = defaultdict(set)
    for p, c in edges:
        below[p].add(c)
    pairs = set()
    for n in {x for e in edges for x in e}:
        todo, seen = [n], set()
        while todo:
            for c in below[todo.pop()] - seen:
                seen.add(c)
                todo.append(c)
        pairs |= {(n, c) for c in seen - {n}}
    found = rows(hierarchy.descendants(f, f.nodes.select("node")))
    assert set(found) == pairs and len(found) == len(pairs)


def test_components_against_mutual_reach(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(75)] + [(100 + i, 101 + i) for i in range(40)] + [(140, 100), (300, 300), (400, 401)]
    below = defaultdict(set)
    for a, b in edges:
        below[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for z in below[todo.pop()] - seen:
                seen.add(z)
                todo.append(z)
        return seen

    far = {n: reach(n) for n in {x for e in edges for x in e}}
    want = {(n, min(m for m in far[n] if n in far[m])) for n in far if n in far[n]}
    assert set(rows(hierarchy._components(spark.createDataFrame(edges, "a long, b long")))) == want


def test_empty(spark):
    f = hierarchy.decompose(spark.createDataFrame([], "p string, c string"), "p", "c")
    assert hierarchy.hierarchy_rows(f).count() == 0
