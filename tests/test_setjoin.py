import math
import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from skein.operators import resolution, setjoin
from skein.plans.tables import settled, shared_dir


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder.removeprefix("file://")) for f in files)


def test_signatures_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 63, 64, 65, 300, 1500):
        a = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        for keep in (0.2, 0.7, 0.95, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < keep], rng.integers(0, 1 << 62, size // 3 + 1, dtype=np.uint64)]))
            real = len(np.setxor1d(a, b))
            assert setjoin.differing(setjoin.signature(a), setjoin.signature(b)) <= real
            assert setjoin.differing(setjoin.signature(b), setjoin.signature(a)) <= real


def _families(spark, n):
    rng = random.Random(4)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}x" for i in range(20)]
        rows += [(f"{f}-{k}", f"t{f % 2}", " ".join(rng.sample(base, 18) + ["common"])) for k in range(n)]
    return spark.createDataFrame(rows, "id string, type string, name string"), {r[0]: (r[1], frozenset(r[2].split())) for r in rows}


def test_families_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 4)
    df, sets = _families(spark, 25)
    members = {r["id"]: r["rep"] for r in resolution.class_members(df).collect()}
    reps = sorted(set(sets) - set(members))
    near = lambda a, b: sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.67
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if near(a, b)}
    found = [(r["a"], r["b"]) for r in resolution.similar_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_sets_without_near_ones_are_not_written(spark):
    """Long names that nothing is near leave less than a byte for each token in the shared folder."""
    rng = random.Random(8)
    rows = [(str(i), "t", " ".join(f"w{rng.randrange(10**9)}x" for _ in range(2000))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, type string, name string")
    before = _bytes(shared_dir(spark))
    assert resolution.similar_links(df).isEmpty()
    assert _bytes(shared_dir(spark)) - before < 60 * 2000


def test_components_read_the_links_once(spark, monkeypatch):
    real, given = resolution.components, []
    monkeypatch.setattr(resolution, "components", lambda links: (given.append(links), real(links))[1])
    df, sets = _families(spark, 5)
    assert resolution.candidate_blocks(df).select(F.count_distinct("component")).first()[0] == 3
    assert all(getattr(links, "_folder", None) for links in given)


def test_near_sets_of_frequent_tokens_meet_often_enough():
    """No token is rare: two sets of similarity 0.67 and more still share four keys, and others of the same words hardly any."""
    rng, least, pool, strangers = np.random.default_rng(5), 0.67, np.unique(np.random.default_rng(6).integers(1, 1 << 62, 4000, dtype=np.uint64)), []

    def keys(x, start, largest):
        starts = setjoin.size_classes(least, largest)
        reach = len(x) - math.ceil(least * len(x) - 1e-9) + setjoin._together(max(s for s in starts if s <= len(x)), least)
        found = setjoin.meeting_keys(x[:reach], np.arange(min(reach, len(x)), dtype=np.int32), 0, len(x), start, least)
        assert len(found[0]) == len(found[1])
        return set(found[0].tolist())

    for size in (1, 2, 3, 8, 12, 13, 40, 200, 900):
        for _ in range(40):
            a = np.sort(rng.choice(pool, size, replace=False))
            b = np.union1d(rng.permutation(a)[: math.ceil(size * rng.uniform(0.67, 1))], rng.choice(pool, rng.integers(0, size // 3 + 1), replace=False))
            both = len(np.intersect1d(a, b))
            small, large = sorted((a, b), key=len)
            start = max(s for s in setjoin.size_classes(least, len(small)) if s <= len(small))
            if both / (len(a) + len(b) - both) >= least:
                shared = keys(small, start, 2000) & keys(large, start, 2000)
                assert len(shared) >= min(setjoin.TOGETHER, both)
            other = np.sort(rng.choice(pool, size, replace=False))
            strangers += [len(keys(a, c, 2000) & keys(other, c, 2000)) for c in [max(s for s in setjoin.size_classes(least, size) if s <= size)] if size == 200]
    assert np.mean(strangers) < setjoin.TOGETHER


def test_rounds_by_size_lose_no_pair(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}x" for i in range(60)]
    rows = [(str(i), "t", " ".join(rng.sample(words[: rng.choice([6, 20, 60])], k))) for i in range(160) for k in [rng.choice([1, 2, 3, 5, 6])]]
    base = rng.sample(words, 40)
    rows += [(f"x{i}", "t", " ".join(rng.sample(base, rng.randrange(26, 41)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, type string, name string")
    sets = {i: frozenset(name.split()) for i, _, name in rows}
    reps = sorted({s: min(i for i in sets if sets[i] == s) for s in sets.values()}.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.67}
    monkeypatch.setattr(setjoin, "FEW", 1)
    found = [(r["a"], r["b"]) for r in resolution.similar_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_settled_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {os.path.join(at, f) for folder in folders for at, _, files in os.walk(folder) for f in files if f.startswith("shuffle_")}
    before = held()
    settled(spark.range(50_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(20_000))).count(), "counts")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before
