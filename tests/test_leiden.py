"""Leiden communities: as tables and in one task, against Louvain and a plain modularity."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.operators import embedding, leiden


def planted(groups, size, inside, outside, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)]


def ring_of_cliques(n, k):
    inside = [(c * k + a, c * k + b, 1.0) for c in range(n) for a in range(k) for b in range(a + 1, k)]
    return inside + [(c * k, (c * k + k + 1) % (n * k), 1.0) for c in range(n)]


def plain_modularity(edges, com, gamma=1.0):
    total = 2 * sum(w for *_, w in edges)
    inner = sum(2 * w for a, b, w in edges if com[a] == com[b])
    size = {}
    for a, b, w in edges:
        for x in (a, b):
            size[com[x]] = size.get(com[x], 0.0) + w
    return inner / total - gamma * sum(s * s for s in size.values()) / total**2


def connected(edges, com):
    near = {}
    for a, b, _ in edges:
        if com[a] == com[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(com.values()):
        members = [x for x in com if com[x] == c]
        seen, todo = {members[0]}, [members[0]]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        if len(seen) < len(members):
            return False
    return True


GRAPHS = {"planted": planted(4, 30, 0.3, 0.02, 1), "cliques": ring_of_cliques(12, 5), "loose": planted(3, 25, 0.15, 0.05, 2)}


@pytest.mark.parametrize(("name", "in_task"), [("loose", 0), ("planted", 150), *((n, 10_000) for n in GRAPHS)])
def test_not_below_louvain(spark, name, in_task):
    edges = GRAPHS[name]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {10_000})
    e = spark.createDataFrame([(b, a, w) if (a + b) % 3 else (a, b, w) for a, b, w in edges], "src long, dst long, w double")
    found = leiden.leiden(e, spark.createDataFrame([(x,) for x in nodes], "obs_id long"), in_task=in_task)
    com = {r["obs_id"]: r["cluster"] for r in found.collect()}
    assert com.pop(10_000) == -1 and len(com) == len(nodes) - 1
    assert connected(edges, com)
    q = plain_modularity(edges, com)
    assert q >= plain_modularity(edges, embedding.louvain(edges)) - 1e-9
    assert leiden.modularity(e, found).first()[0] == pytest.approx(q, abs=1e-12)
    sizes = [sum(c == k for c in com.values()) for k in range(len(set(com.values())))]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(com)


def test_words_as_ids_and_no_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcxyzq"], "obs_id string")
    for in_task in (0, 100):
        assert {r["obs_id"]: r["cluster"] for r in leiden.leiden(e, nodes, in_task=in_task).collect()} == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1, "q": -1}
    assert {r["cluster"] for r in leiden.leiden(e.where("false"), nodes).collect()} == {-1}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 14), st.integers(0, 14)).filter(lambda p: p[0] < p[1]), min_size=1, max_size=50), st.sampled_from([0.5, 1.0, 2.0]))
def test_in_memory(pairs, gamma):
    edges = [(a, b, 1.0) for a, b in sorted(pairs)]
    com = leiden.in_memory(edges, gamma)
    alone = {x: x for a, b, _ in edges for x in (a, b)}
    assert com.keys() == alone.keys()
    assert plain_modularity(edges, com, gamma) >= plain_modularity(edges, alone, gamma) - 1e-9
