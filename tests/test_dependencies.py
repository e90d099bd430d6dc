import random

from skein.operators import dependencies


def brute(edges):
    ids = sorted({x for e in edges for x in e})
    after = {i: {t for s, t in edges if s == i} for i in ids}
    reach = {}
    for i in ids:
        seen, todo = set(), [i]
        while todo:
            for t in after[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        reach[i] = seen
    component = {i: max([j for j in reach[i] if i in reach[j]] + [i]) for i in ids}
    links = {(component[s], component[t]) for s, t in edges if component[s] != component[t]}
    depth = {}

    def layer(c):
        if c not in depth:
            depth[c] = max((layer(t) + 1 for s, t in links if s == c), default=0)
        return depth[c]

    far = lambda a, b: any(x == a and (t == b or far(t, b)) for x, t in links)
    kept = {(s, t) for s, t in links if not any(x == s and m != t and far(m, t) for x, m in links)}
    return {i: (component[i], layer(component[i])) for i in ids}, kept


def ring(n, at=0):
    return [(at + i, at + (i + 1) % n) for i in range(n)]


_R = random.Random(3)
GRAPHS = {
    "chain and shortcuts": [(i, i + 1) for i in range(8)] + [(0, 5), (2, 4), (9, 0), (9, 3)],
    "rings": ring(5) + ring(3, 10) + ring(2, 20) + [(2, 11), (12, 20), (0, 20), (30, 30), (31, 0)],
    "sparse": [(_R.randrange(25), _R.randrange(25)) for _ in range(30)],
    "dense": [(_R.randrange(14), _R.randrange(14)) for _ in range(45)],
}


def test_against_plain_search(spark):
    """All graphs side by side."""
    edges = [(s + 100 * k, t + 100 * k) for k, graph in enumerate(GRAPHS.values()) for s, t in graph]
    df = spark.createDataFrame([*edges, (None, 1), edges[0]], "source_id int, target_id int")
    view = dependencies.dependency_view(df)
    members, kept = brute(edges)
    assert {r["id"]: (r["component"], r["layer"]) for r in view["members"].collect()} == members
    assert {(r["source"], r["target"]) for r in view["links"].collect()} == kept
    sizes = [c for c, _ in members.values()]
    assert {r["component"]: r["size"] for r in view["circles"].collect()} == {c: sizes.count(c) for c in sizes if sizes.count(c) > 1}


def test_nothing(spark):
    assert dependencies.dependency_view(spark.createDataFrame([], "source_id int, target_id int"))["members"].isEmpty()
