import itertools
import random

import pytest

from skein.operators.patterns import Hop, Node, Pattern, chain, join_order, matches


def brute(nodes, edges, pattern):
    """All assignments of ids to names whose hops all hold, by trying every one."""
    fits = lambda n, i: (n.type is None or nodes[i][0] == n.type) and (n.where is None or nodes[i][1] > 1)
    steps = {}
    for hop, name in zip(pattern.hops, pattern.names(), strict=True):
        mine = [(e, s, t) for e, (k, s, t) in edges.items() if hop.types is None or k in hop.types]
        if (hop.least, hop.most) == (1, 1):
            steps[name] = [(s, t, e) for e, s, t in mine]
            continue
        pairs, now = {}, {(i, i) for i in {x for _, s, t in mine for x in (s, t)}}
        for k in range(1, hop.most + 1):
            now = {(a, t) for a, b in now for _, s, t in mine if s == b}
            for p in now if k >= hop.least else ():
                pairs.setdefault(p, k)
        steps[name] = [(a, b, k) for (a, b), k in pairs.items()]
    rows = [{}]
    for hop, name in zip(pattern.hops, pattern.names(), strict=True):
        rows = [r | {hop.source: s, hop.target: t, name: e} for r in rows for s, t, e in steps[name] if r.get(hop.source, s) == s and r.get(hop.target, t) == t and (hop.source != hop.target or s == t)]
    single = [n for h, n in zip(pattern.hops, pattern.names(), strict=True) if (h.least, h.most) == (1, 1)]
    rows = [r for r in rows if all(r[a] != r[b] for a, b in itertools.combinations(single, 2))]
    rows = [r for r in rows if all((i in nodes and fits(n, i)) or (n.type is None and n.where is None) for m, n in pattern.nodes.items() for i in [r[m]])]
    return sorted(tuple(map(str, (r[c] for c in (*pattern.nodes, *pattern.names())))) for r in rows)


PATTERNS = {
    "path": chain(["A", "t", None, "u", "B"]),
    "any": chain([None, None, "A"]),
    "star": Pattern({"m": Node("A"), "x": Node("B"), "y": Node(None, "size > 1"), "z": Node()}, [Hop("m", "x", ("t",)), Hop("m", "y", ("t", "u")), Hop("z", "m")]),
    "triangle": Pattern({"a": Node(), "b": Node(), "c": Node()}, [Hop("a", "b", ("t",)), Hop("b", "c", ("t",)), Hop("c", "a", ("t",))]),
    "square with a tail": Pattern({"a": Node("A"), "b": Node(), "c": Node(), "d": Node(), "e": Node("B")}, [Hop("a", "b"), Hop("b", "c", ("u",)), Hop("d", "c", ("t",)), Hop("a", "d"), Hop("c", "e")]),
    "loop": Pattern({"a": Node(), "b": Node("B")}, [Hop("a", "a"), Hop("a", "b")]),
    "two edges at once": Pattern({"a": Node(), "b": Node()}, [Hop("a", "b", ("t",), "one"), Hop("a", "b", None, "two")]),
    "walk": Pattern({"a": Node("A"), "b": Node("B", "size > 1"), "c": Node()}, [Hop("a", "b", ("t",), "steps", 1, 3), Hop("b", "c", ("u",))]),
    "closed walk": Pattern({"a": Node("A")}, [Hop("a", "a", None, "steps", 2, 4)]),
}


@pytest.mark.parametrize("name", PATTERNS)
def test_against_all_assignments(spark, name):
    rng = random.Random(7)
    nodes = {f"n{i}": (rng.choice("ABC"), rng.randrange(4)) for i in range(16)}
    edges = {f"e{i}": (rng.choice("tu"), rng.choice([*nodes, "n0", "gone"]), rng.choice([*nodes, "n0"])) for i in range(70)}
    n = spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id string, type string, size int")
    e = spark.createDataFrame([(i, *v) for i, v in edges.items()], "id string, type string, source_id string, target_id string")
    p = PATTERNS[name]
    found = matches(n, e, p)
    assert found.columns == [*p.nodes, *p.names()]
    want = brute(nodes, edges, p)
    assert sorted(tuple(map(str, r)) for r in found.collect()) == want and want
    assert matches(n, e.limit(0), p).isEmpty()


def test_order_and_refusals(spark):
    # the smallest table first, then what closes a circle, then what meets least
    assert join_order([(100, {"a": 10, "b": 10}), (5, {"b": 5, "c": 5}), (1000, {"c": 2, "d": 9}), (50, {"b": 5, "c": 4})]) == [1, 3, 0, 2]
    with pytest.raises(ValueError, match="hang together"):
        Pattern({"a": Node(), "b": Node(), "c": Node()}, [Hop("a", "b")]).tree()
    nodes = spark.createDataFrame([("x", "A"), ("y", "B")], "id string, type string")
    edges = spark.createDataFrame([], "id string, type string, source_id string, target_id string")
    assert [r["a"] for r in matches(nodes, edges, Pattern({"a": Node("B")})).collect()] == ["y"]
