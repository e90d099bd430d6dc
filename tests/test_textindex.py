import math
import random
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from skein.operators import textindex
from skein.operators.textindex import TextIndex, build
from skein.plans.tables import shared_dir


def brute(docs, query, k):
    split = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in docs}
    average = sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = []
    for d, ws in split.items():
        tf, score = Counter(ws), 0.0
        for w in set(re.findall("[a-z0-9]+", query.lower())):
            if tf[w]:
                score += math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average))
        if score:
            out.append((-round(score, 6), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


def test_search_equals_scoring_everything(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(300, None), (301, "Rare Word, rare word"), (302, "rare")]
    folder = str(tmp_path / "index")
    build(spark.createDataFrame(docs, "id int, content string"), folder, chunk=16, buckets=4)
    queries = [(0, "w1"), (1, "rare W1 w2"), (2, "unknown"), (3, ""), (4, "w1 w2 w3 w4 w5 rare"), (5, "w7 w7 w9")] + [(6 + i, " ".join(rng.choice(pool) for _ in range(4))) for i in range(8)]
    table = spark.createDataFrame(queries, "id int, text string")
    index = TextIndex(spark, folder)
    for few in (500, 0):
        monkeypatch.setattr(textindex, "FEW_WORDS", few)
        found = {}
        for r in index.search(table, k=5).orderBy("query", "place").collect():
            found.setdefault(r["query"], []).append((r["doc"], r["score"]))
        want = {q: b for q, t in queries if (b := brute(docs, t, 5))}
        assert found.keys() == want.keys()
        for q, rows in want.items():
            assert [d for d, _ in found[q]] == [d for d, _ in rows] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(found[q], rows, strict=True))


def test_only_promising_chunks_are_scored(spark, tmp_path, monkeypatch):
    docs = [(i, "common " * (1 + i % 3) + "filler " * 20) for i in range(400)] + [(1000 + i, "common rare rare rare") for i in range(8)]
    folder = str(tmp_path / "index")
    build(spark.createDataFrame(docs, "id int, content string"), folder, chunk=16, buckets=2)
    asked = []
    scored = TextIndex._scored
    monkeypatch.setattr(TextIndex, "_scored", lambda self, wanted, words: (asked.append(wanted.count()), scored(self, wanted, words))[1])
    rows = TextIndex(spark, folder).search(spark.createDataFrame([(1, "common rare")], "id int, text string"), k=3)
    assert [r["doc"] for r in rows.orderBy("place").collect()] == [1000, 1001, 1002]
    assert asked[0] == 1 and asked[1] <= 2  # of 26 chunks
    postings = spark.read.parquet(f"{folder}/postings")
    assert postings.groupBy("word", "chunk").count().where("count > 1").isEmpty() and postings.select(F.max(F.size("postings"))).first()[0] <= 16


def test_requests_search_the_index(spark, tmp_path):
    from skein.plans.api import Api
    from skein.plans.service import Service
    from skein.plans.views import Engine

    nodes = spark.createDataFrame([("a", "T", "card payments"), ("b", "T", "card"), ("c", "T", "other")], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "t", "a", "b")], "id string, type string, source_id string, target_id string")
    build(nodes, str(tmp_path / "index"), "id", "name", buckets=2)
    version = [1]
    one = Api(Service(nodes, edges), Engine(), {}, index=TextIndex(spark, str(tmp_path / "index")), version=lambda: version[0])
    ask = lambda user, **args: one.execute({"field": "search", "args": args}, user)
    first = ask("u", text="card payments")
    assert [r["id"] for r in first["data"].collect()] == ["a", "b"] and not first["cache_hit"]
    assert ask("u", text="card payments")["cache_hit"] and not ask("v", text="card payments")["cache_hit"]
    version[0] = 2
    assert not ask("u", text="card payments")["cache_hit"]
    assert {r["id"] for r in one.execute({"field": "impact", "args": {"start": "a", "depth": 2}})["data"].collect()} >= {"b"}


def test_rows_with_one_id_are_scored_together(spark, tmp_path):
    docs = [(1, "rare a"), (2, "a b"), (2, "a a"), (2, "a c d"), (2, None), (None, "a d"), (3, "c c"), (4, "")]
    folder = str(tmp_path / "index")
    build(spark.createDataFrame(docs, "id int, content string"), folder, chunk=1, buckets=2)
    met = Counter()
    for d, t in docs:
        for w in (t or "").split():
            met[d, len(t.split()), w] += 1
    average, df = sum(len((t or "").split()) for _, t in docs) / len(docs), Counter(w for _, _, w in met)
    want = {}
    for query in (["a"], ["c", "d", "rare"]):
        scores = Counter()
        for (d, n, w), tf in met.items():
            if w in query:
                scores[d] += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average))
        want[" ".join(query)] = [d for _, _, d in sorted((-round(s, 6), d is None, d) for d, s in scores.items())]
    asked = spark.createDataFrame([(q, q) for q in want], "id string, text string")
    found = {}
    for r in TextIndex(spark, folder).search(asked, k=9).orderBy("query", "place").collect():
        found.setdefault(r["query"], []).append(r["doc"])
    assert found == want and found["a"].count(2) == 1


def test_building_keeps_no_copy_of_the_texts(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(100))) for i in range(1000)]
    stored = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    before = stored()
    build(spark.createDataFrame(docs, "id int, content string"), str(tmp_path / "index"), chunk=100, buckets=2)
    assert stored() - before < sum(len(t) for _, t in docs) / 10
