import hashlib
import io
import re
import struct
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import common, exact_dedup, induced, language, media, minhash, mixing, pieces, quality, rangecoder, repeats, tokens, warc
from skein.llm.common import new_path

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


# --- 1: mixing ------------------------------------------------------------------------------------


def water(sizes: dict, weights: dict, cap: int = 3) -> dict:
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        weight = sum(w for s, w in weights.items() if s not in full)
        over = {s for s in sizes if s not in full and weight and left * weights[s] / weight > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else (left * weights[s] / weight if weight else 0.0) for s in sizes}
        full |= over


def test_mixing_targets_and_totals(docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    goal = water(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = Counter()
    for r in out:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        assert r["target"] == pytest.approx(goal[source[r["doc_id"]]])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, g in goal.items():
        reach = {0}  # a source of few documents may not be able to come nearer
        for d, n in size.items():
            if source[d] == s:
                reach = {x + k * n for x in reach for k in range(4)}
        assert abs(taken[s] - g) <= min(abs(x - g) for x in reach) + max(0.02 * g, 20)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, out))


def test_mixing_edges(nothing, doubled, docs):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert mixing.mix(doubled).count() == doubled.count()
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    assert made.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


# --- 2: exact dedup ---------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(docs, rows, bits):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    out = got(exact_dedup.exact_groups(docs, bits=bits))
    assert len(out) == len(rows)
    for text, ids in groups.items():
        for d in ids:
            assert out[d][:4] == (min(ids), len(ids), d == min(ids), hashlib.sha256(text.encode()).hexdigest())


def test_exact_groups_with_large_ones(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 2)
    want = {}
    for r in rows:
        want.setdefault(SPACE.sub(" ", r[1] or ""), []).append(r[0])
    out = got(exact_dedup.exact_groups(docs))
    assert {d: out[d][:2] for d in out} == {d: (min(ids), len(ids)) for ids in want.values() for d in ids}


def test_exact_edges(nothing, doubled, docs, rows):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.exact_groups(doubled).count() == doubled.count()
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({SPACE.sub(" ", r[1] or "") for r in rows})


# --- 3: quality ---------------------------------------------------------------------------------------


def test_quality_learns_and_handles_edges(spark, docs, rows, nothing, doubled):
    junk = [(10_000 + i, " | ".join(f"w{j}!!" for j in range(5 + i % 7)), None, None, None, "", "", "", "", "") for i in range(200)]
    good = [(20_000 + i, r[1], None, None, None, "", "", "", "", "") for i, r in enumerate(rows * 3) if r[1] and len(r[1]) > 50]
    both = spark.createDataFrame(junk + good, docs.schema)
    labels = spark.createDataFrame([(r[0], 0) for r in junk] + [(r[0], 1) for r in good] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(both, labels)
    out = got(quality.scored(both, model))
    held = [d for d in out if zlib.crc32(str(d).encode()) % 5 == 0]
    right = [(out[d][1] == 1) == (d >= 20_000) for d in held]
    assert len(held) > 30 and sum(right) / len(right) > 0.97
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in out.values())
    empty = quality.train(nothing, labels)
    assert {r["score"] for r in quality.scored(docs, empty).collect()} == {0.5}
    assert quality.scored(nothing, model).count() == 0 and quality.scored(doubled, model).count() == doubled.count()
    assert quality.kept_documents(both, labels).columns == both.columns


# --- 4: ids -----------------------------------------------------------------------------------------------


def test_quality_features_and_trees_against_plain_python():
    texts = ["Hello, world! Hello you", "", "a  b\tb\n| é É 9#", "word", " \n "]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    x = quality.features(offsets, np.frombuffer(data, np.uint8), minhash.Powers())
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*@"]
    for row, t in zip(x, texts, strict=True):
        b = t.encode()
        counts = [sum(c in g for c in b) for g in groups]
        beyond = sum(c >= 128 for c in b)
        counts += [len(b) - sum(counts) - beyond, beyond]
        words = b.lower().split()
        raw, n = b.split(), max(1, len(words))
        tail = [np.log1p(len(b)), np.log1p(len(words)), (len(b) - counts[3] - counts[4]) / n, 1 - len(set(words)) / n, sum(p == q for p, q in zip(words, words[1:])) / n, sum(65 <= w[0] <= 90 for w in raw) / n, sum(not (chr(w[-1]).isascii() and chr(w[-1]).isalpha() or w[-1] >= 128) for w in raw) / n]
        assert row == pytest.approx([c / max(1, len(b)) for c in counts] + tail, abs=1e-6)
    rng = np.random.default_rng(5)
    x = rng.random((400, 6)).astype(np.float32)
    y = (x[:, 0] + 0.2 * rng.random(400) > 0.6).astype(float)
    model = quality.fit(x, y)

    def one(v):
        logit = model.start
        for split, threshold, leaf in zip(model.split, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(split):
                node = 2 * node + (2 if v[split[node]] > threshold[node] else 1)
            logit += leaf[node - len(split)]
        return 1 / (1 + np.exp(-logit))

    assert model.score(x) == pytest.approx([one(v) for v in x]) and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 127, 128, 300, 40_000):
        for ids in (rng.integers(0, 49408, n), np.full(n, 49407), rng.integers(0, 3, n), np.arange(n) % 7):
            block = rangecoder.encode(ids.astype(np.uint16), 49408)
            back, used = rangecoder.decode(block + b"more")
            assert used == len(block) and (back == ids).all()
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_ids_equal_the_library(spark, docs, rows, nothing, doubled):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.tokenizer_file())
    start, want = 0, {}
    for r in sorted(rows):
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = new_path(spark, "ids")
    tokens.write_ids(docs, path)
    assert got(tokens.read_ids(spark, path)) == want
    for odd in (nothing, doubled):
        path = new_path(spark, "ids")
        tokens.write_ids(odd, path)
        assert tokens.read_ids(spark, path).count() == odd.count()


def test_cuts_equal_the_library():
    import random
    import unicodedata

    words, rng = tokens.WordIds(tokens.tokenizer_file()), random.Random(4)
    texts = ["he left.”", "'yes,' he said", "</p>", "a -> b", 'a="b">', "end)—then", "wow!'", "cool!😀", "x.»", "(“x”)", "Don'ts 'S ''s 'tis 5's it'LL x'ſ", '<a href="x">it\'s</a><br/>', "İ. İx", "x²½ 3.14", "a<|endoftext|>B <|ENDOFTEXT|>'S", "J\u030c H\u0331 e\u0301. \u0301a", "a\u00a0.\u2028.\x1c.\x85.", "日本語。テスト 가\u11a8", "\u212a'\u212a ªº ŉ ß."]
    signs = "aaBsStTdreLlvm''''.,!<>=|-\"()/0129²½ \t\n\x1c\x00\u00a0\u0301\u030cJéÉİıſŒ«»“”’—…😀日。αΩя\u200d\u2028ªº×÷"
    texts += ["".join(rng.choices(signs[: rng.choice((30, 50, len(signs)))], k=rng.randrange(40))) for _ in range(4000)]
    texts += [unicodedata.normalize("NFD", t) for t in texts[:300]]
    for _ in range(2):  # learnt, and remembered
        found = words.encode(texts)
        assert [t for t, ids in zip(texts, found, strict=True) if ids.tolist() != words.model.encode(t, add_special_tokens=False).ids] == []


def test_bits_of_mixed_orders():
    """Ids with structure of each order take fewer bits than order 0 alone says; noise takes hardly more."""
    rng = np.random.default_rng(6)
    follow = rng.integers(0, 500, 500)
    chain = np.zeros(60_000, np.int64)
    for i in range(1, len(chain)):
        chain[i] = follow[chain[i - 1]] if rng.random() < 0.9 else rng.integers(0, 500)
    noise = rng.integers(0, 500, 60_000)
    for ids, low, high in ((chain, 1.0, 6.0), (noise, 8.9, 12.0)):
        _, counts = np.unique(ids, return_counts=True)
        entropy = -(counts / len(ids) * np.log2(counts / len(ids))).sum()
        block = rangecoder.encode(ids.astype(np.uint16), 49408)
        bits = 8 * len(block) / len(ids)
        assert (rangecoder.decode(block)[0] == ids).all() and low < bits < high
        assert bits < entropy if ids is chain else bits < entropy + 2.5


# --- 5: language -----------------------------------------------------------------------------------------


def test_language(spark, nothing, doubled):
    import random

    rng = random.Random(1)
    pools = {"aa": ["bado", "kuli", "mena"], "bb": ["xyrth", "qwelz", "zzork"], "cc": ["éteau", "çaille", "îlesse"]}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(rng.randrange(3, 60))), k) for i, k in enumerate(list(pools) * 60)]
    extra = [(9000, None, "aa"), (9001, "12 !?", "bb"), (9002, "", None), (9003, "bado kuli", None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    model = language.train(df)
    out = got(language.identified(df, model))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(out[r[0]][0] == r[2] for r in held)
    assert [out[i][0] for i in (9000, 9001, 9002, 9003)] == ["und", "und", "und", "aa"]
    assert all(0 <= v[1] <= 1 for v in out.values())
    assert language.train(nothing) is None
    assert {r["lang_pred"] for r in language.identified(doubled, None).collect()} == {"und"}
    assert language.identified(nothing, model).count() == 0


def test_language_vectors_and_cosines_against_plain_python():
    texts = ["Ab c", "É é", "", "12!", "xyz xyz"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    got_counts = language.vectors(offsets, np.frombuffer(data, np.uint8))
    u32 = lambda x: x & 0xFFFFFFFF
    for row, t in zip(got_counts, texts, strict=True):
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in t.replace("É", "é").encode()]
        want = Counter()
        for x, y in zip(b, b[1:]):
            if x or y:
                want[u32((x << 8 | y) * 2654435761) >> 20] += 1
        for x, y, z in zip(b, b[1:], b[2:]):
            if y:
                want[u32(((x << 16 | y << 8 | z) ^ 0x5BD1E995) * 2246822519) >> 20] += 1
        assert {i: n for i, n in enumerate(row) if n} == dict(want)
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (40, language.DIMS))
    model = language.fit(counts, ["a", "b"] * 20)
    pick, score, rejected = model.predict(counts)
    for i, x in enumerate(counts):
        v = np.sqrt(x) * model.idf
        cos = [float(v @ c) / np.linalg.norm(v) for c in model.centres]
        best = {k: max(c for c, w in zip(cos, model.whose, strict=True) if w == k) for k in (0, 1)}
        assert pick[i] == max(best, key=best.get) and abs(score[i] - 1 / (1 + np.exp(-language.SHARPNESS * abs(best[0] - best[1])))) < 1e-3


# --- 6: near duplicates -------------------------------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows, k, percent=80):
    sets, up = {r[0]: shingles(r[1], k) for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(docs, rows, words):
    assert got(minhash.near_groups(docs, words=words)) == near_components(rows, words)


def test_near_groups_of_a_large_family(spark):
    """Many variants around the threshold: pivots alone do not find every link."""
    import random

    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(2, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_groups(df, words=4)) == near_components(rows, 4)


def test_near_edges(nothing, doubled, docs):
    assert minhash.near_groups(nothing).count() == 0
    assert minhash.near_groups(doubled).count() == doubled.count()
    assert minhash.kept_documents(docs).columns == docs.columns


def test_near_groups_of_repeated_and_missing_ids(spark):
    import random

    rng = random.Random(3)
    a, b, c, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, a + " z"), (5, b + " y"), (9, b + " q"), (9, b + " q"), (20, c), (None, c + " k"), (None, e), (None, e), (None, None), (30, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in minhash.near_groups(df, words=4).collect())
    assert out == sorted(
        [(1, 57, 1, True), (5, 58, 1, False), (5, 58, 1, False), (9, 58, 1, False), (9, 58, 1, False), (20, 57, 20, True)]
        + [(-1, 58, 20, False), (-1, 57, -1, True), (-1, 57, -1, True), (-1, 0, -1, True), (30, 0, 30, True), (5, 0, 5, True)]
    )
    stay = sorted((r["doc_id"] or -1, r["text"] or "") for r in minhash.kept_documents(df, words=4).collect())
    assert stay == sorted([(1, a), (5, ""), (20, c), (-1, e), (-1, e), (-1, ""), (30, "")])


# --- bounds of samples, and clashing names ----------------------------------------------------------------


def test_samples_stay_bounded(spark, monkeypatch):
    """Repeated and missing ids, and far more rows than a sample may have."""
    from pyspark.sql import functions as F

    pages = spark.range(600).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://h").alias("url"), F.concat(F.lit("<p>"), F.repeat(F.col("id").cast("string"), 50)).alias("html"))
    hot = pages.union(pages.limit(1).crossJoin(spark.range(400)).select("page_id", "url", "html"))
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    taken = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, samples: taken.append(samples) or warc.zstandard.ZstdCompressionDict(b"x" * 64))
    warc.trained(hot)
    sizes = [len(s) for s in taken[0]]
    assert len(set(taken[0])) == len(sizes) and 5_000 < sum(sizes) < 20_000 + 600 * len(sizes)

    monkeypatch.setattr(quality, "MAX_ROWS", 50)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    docs = spark.range(400).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    quality.train(docs, labels)
    quality.train(docs, labels.where("doc_id = 7"))
    assert seen == [50, 50]

    monkeypatch.setattr(language, "MAX_ROWS", 40)
    monkeypatch.setattr(language, "fit", lambda x, names: names)
    rows = [(i, f"wort nummer {i}" if i > 300 else "wort", "de" if i % 3 else "fr") for i in range(2000)]
    names = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert Counter(names) == {"de": 20, "fr": 20}


def test_clashing_names(spark, docs):
    from pyspark.sql import functions as F

    names = ["_size", "_copy", "_sha_of", "_key", "_row", "_id", "_of", "_th", "_words", "_text", "row", "rep", "th"]
    more = docs.select("doc_id", "text", "source", *[F.lit(f"keep {n}").alias(n) for n in names])
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for out in (mixing.mixed(more), exact_dedup.kept_documents(more), minhash.kept_documents(more), quality.kept_documents(more, labels)):
        assert out.columns == more.columns
        assert out.select(*names).distinct().collect() == [tuple(f"keep {n}" for n in names)]


def test_repeated_pages_have_ids_of_their_own(spark):
    long = "<p>" + "x" * 200
    rows = [(1, "u", long), (1, "u", long), (1, "v", "other"), (2, "u", long), (None, None, long)]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, b"")
    text = b""
    for r in spark.read.format("binaryFile").load(path).select("content").collect():
        data = bytes(r[0])
        text += warc.zstandard.ZstdDecompressor().stream_reader(data[8:], read_across_frames=True).read()
    ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(ids) == 5 and len(set(ids)) == 5
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", text)) <= set(ids)
    out = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    assert out == {(1, "response", None): 3, (2, "revisit", 1): 1, (None, "revisit", 1): 1}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 40, 400, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: int(len(a) * 0.9)], rng.integers(0, 2**63, len(a) // 10, dtype=np.uint64))))
        s = minhash.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert (s != minhash.EMPTY).all()
        if n >= 40:
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((s[0] == s[1]).mean() - j) < 0.17


# --- 7: pieces ----------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, docs, rows, nothing, doubled):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_file())
    for giant in (pieces.GIANT, 64):
        out = {r["doc_id"]: np.frombuffer(r["ids"], np.uint16).tolist() for r in pieces.encoded(docs, giant=giant).collect()}
        assert out == {r[0]: library.encode(r[1] or "") for r in rows}
    trip = pieces.round_trip(docs).collect()
    assert len(trip) == len(rows) and all(r["lossless"] for r in trip)
    assert pieces.round_trip(nothing).count() == 0 and pieces.round_trip(doubled).count() == doubled.count()


def test_every_row_of_large_batches_comes_once(spark):
    """More rows in a batch than any operator works on at once."""
    df = spark.range(1500).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id AS page_id", "'u' AS url", "concat('<p>', id) AS html").coalesce(1)
    ids = list(range(1500))
    for stored in (False, True):
        out = pieces.round_trip(df, stored=stored).collect()
        assert sorted(r["doc_id"] for r in out) == ids and all(r["lossless"] for r in out)
    path = new_path(spark, "ids")
    tokens.write_ids(df, path)
    assert sorted(r["doc_id"] for r in tokens.read_ids(spark, path).collect()) == ids
    for rows in (media.sniff(media.store_samples(df), carry=("n_bytes",)), repeats.dedup_passages(df), minhash.near_groups(df), language.identified(df, None), quality.scored(df, quality.fit(np.zeros((0, 20)), np.zeros(0)))):
        assert sorted(r["doc_id"] for r in rows.collect()) == ids
    path = new_path(spark, "warc")
    warc.write_archives(df, path, b"")
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).collect()) == ids


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random(s) < 0.5, 0.0, -np.inf) for s in ((3, 4), (4, 2), (2, 5)))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


# --- 8: repeated passages -----------------------------------------------------------------------------------


def without_repeats(rows, depth):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + depth] for _, b in data for i in range(len(b) - depth + 1))
    out = {}
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - depth + 1):
            if count[b[i : i + depth]] > 1:
                gone[i : i + depth] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, rows, hot, monkeypatch):
    if hot == 1:  # every shared key is hot and heavy
        monkeypatch.setattr(common, "HEAVY", 2)
        monkeypatch.setattr(common, "MOST_HEAVY", 5)
    assert got(repeats.dedup_passages(docs, hot=hot)) == without_repeats(rows, repeats.DEPTH)


def test_repeats_of_a_passage_in_many_texts(spark):
    """One key with many different runs: the passage's edges differ in every text, and some of these repeat again."""
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    sides = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = [(i, f"{word()} {rng.choice(sides)} {passage} {rng.choice(sides)[: rng.randrange(4, 60)]} {word()}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.dedup_passages(df, hot=3)) == without_repeats(rows, repeats.DEPTH)


def test_heavy_keys_join_as_others_do(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 3").withColumn("more", F.col("k") * 2)
    want = sorted(map(tuple, rows.join(keys, ["k"]).select("k", "id", "n", "more").collect()))
    for heavy, most in ((10_000, 5), (20, 1), (1, 100)):
        monkeypatch.setattr(common, "HEAVY", heavy)
        monkeypatch.setattr(common, "MOST_HEAVY", most)
        assert sorted(map(tuple, common.joined(rows, keys, ["k"], keys, "n").select("k", "id", "n", "more").collect())) == want


def test_repeats_of_short_depth(docs, rows):
    assert got(repeats.dedup_passages(docs, depth=40, gram=8)) == without_repeats(rows, 40)


def test_repeats_edges(nothing, doubled):
    assert repeats.dedup_passages(nothing).count() == 0
    assert repeats.dedup_passages(doubled).count() == doubled.count()


def test_induced_sorting_against_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(150):
        k, depth = rng.choice([1, 2, 3, 26]), rng.choice([1, 2, 5, 20])
        contents = [bytes(rng.randrange(k) + 97 for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 8))]
        count = Counter(c[i : i + depth] for c in contents for i in range(len(c) - depth + 1))
        want = [[count[c[i : i + depth]] > 1 for i in range(len(c) - depth + 1)] for c in contents]
        assert [f.tolist() for f in induced.repeated_in(contents, depth, memory=rng.choice([1, 1 << 20]))] == want


# --- 9: WARC ----------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    page = "<html>" + "body text " * 40 + "</html>"
    rows = [(5, "http://a/", page), (2, "http://b/ x\n", page), (9, None, page), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 5000), (None, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, warc.trained(pages))
    out = sorted(map(tuple, warc.read_archives(spark, path).collect()), key=str)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = 2 if h == page and p != 2 else None
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first else "response", first))
    assert out == sorted(want, key=str)
    content = spark.read.format("binaryFile").load(path).first()["content"]
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and len(content) > 8 + size
    path = new_path(spark, "warc")
    none = pages.limit(0)
    warc.write_archives(none, path, warc.trained(none))
    assert warc.read_archives(spark, path).count() == 0


# --- 10: media ----------------------------------------------------------------------------------------------------


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def flac() -> bytes:
    def crc(data, bits, poly):
        r = 0
        for byte in data:
            r ^= byte << (bits - 8)
            for _ in range(8):
                r = (r << 1 ^ (poly if r >> (bits - 1) else 0)) & ((1 << bits) - 1)
        return r

    def frame(number, subframes):
        head = bytes([0xFF, 0xF8, 0x60, len(subframes) - 1 << 4 | 0x02, number, 15])  # 16 samples of 8 bits
        bits = "".join(subframes)
        body = head + bytes([crc(head, 8, 0x07)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        return body + crc(body, 16, 0x8005).to_bytes(2, "big")

    constant, verbatim = "0" + "000000" + "0" + "00000101", "0" + "000001" + "0" + "01000001" * 16
    rice = lambda n, k: "".join("0" * (i % 4) + "1" + "10" * (k // 2) for i in range(n))
    fixed = "0" + "001010" + "0" + "00000001" * 2 + "00" + "0001" + "0010" + rice(6, 2) + "1111" + "00011" + "101" * 8
    lpc = "0" + "100000" + "1" + "01" + "000001" + "0100" + "00000" + "00001" + "01" + "0000" + "00100" + rice(15, 4)
    info = struct.pack(">HH", 16, 16) + bytes(6) + (8000 << 44 | 1 << 41 | 7 << 36 | 48).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80\0\0\x22" + info + frame(0, [constant, verbatim]) + frame(1, [fixed, lpc]) + frame(2, [lpc, constant])


def test_media_of_one_type_follow_each_other():
    import io
    import zipfile

    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in files.items():
                z.writestr(name, body)
        return out.getvalue()

    part = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer <<>>\nstartxref\n9\n%%EOF"
    revised = part + b"\n2 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer <<>>\nstartxref\n80\n%%EOF"
    holder = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + part + b"\nendstream\nendobj\nstartxref\n9\n%%EOF"
    kinds = {"application/pdf": [part, revised, holder], "application/zip": [archive(a=b"one"), archive(a=b"x" * 99, b=archive(c=b"in"))], "audio/flac": [flac(), flac()], "image/png": [png()]}
    finder = media.automaton()
    every = [(k, b) for k, blobs in kinds.items() for b in blobs]
    for blobs in (every, every[::-1], [every[0], every[-1], every[0]], [every[5], every[6]], [every[3], every[4], every[3]]):
        data, want = b"x", []
        for kind, blob in blobs:
            want.append((kind, len(data), len(blob)))
            data += blob + b"\r\n"
        assert media.identify(data, finder) == (media.UNKNOWN, want)
    assert media.identify(flac(), finder)[0] == "audio/flac"
    assert media.identify(b"x" + flac()[:-1], finder)[1][0][2] < len(flac()) - 1  # a frame that is cut off does not count


def test_media_identify_and_carve(spark):
    gif = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd\x12\xff\0\x34\xff\xd9"
    finder = media.automaton()
    assert media.identify(png(), finder) == ("image/png", [])
    assert media.identify(b"..." + png() + b"--" + gif + jpeg, finder) == (media.UNKNOWN, [("image/png", 3, len(png())), ("image/gif", 5 + len(png()), len(gif)), ("image/jpeg", 5 + len(png()) + len(gif), len(jpeg))])
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.identify(bytes(broken), finder)[0] == media.UNKNOWN
    assert media.identify(media.to_wav(b"abc"), finder)[0] == "audio/wav"
    df = spark.createDataFrame([(1, bytearray(gif), "image/png"), (2, None, None), (3, bytearray(b""), "x")], "doc_id long, media binary, declared_type string")
    out = {r["doc_id"]: (r["media_type"], r["corrected"]) for r in media.sniff(df).collect()}
    assert out == {1: ("image/gif", True), 2: (media.UNKNOWN, True), 3: (media.UNKNOWN, True)}


def test_media_samples(docs, rows, nothing, doubled):
    out = {r["doc_id"]: r for r in media.sniff(media.store_samples(docs), carry=("n_bytes",)).collect()}
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        o = out[r[0]]
        assert (o["n_bytes"], o["payload_bytes"], o["payload_sha256"], o["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        made = io.BytesIO()
        with wave.open(made, "wb") as out_file:  # another writer of the same format
            out_file.setnchannels(1), out_file.setsampwidth(1), out_file.setframerate(media.RATE), out_file.writeframes(p)
        w = made.getvalue()
        assert (o["media_bytes"], o["media_sha256"], o["corrected"]) == (len(w), hashlib.sha256(w).hexdigest(), True)
        crossings = sum((x >= 128) != (y >= 128) for x, y in zip(p, p[1:]))
        assert o["feature"] == f"audio/wav;channels=1;rate={media.RATE};bits=8;frames={len(p)};embedded=0;mean={sum(p) // len(p)};power={sum((x - 128) ** 2 for x in p) // len(p)};crossings={crossings}"
    assert media.store_samples(nothing).count() == 0
    assert media.sniff(media.store_samples(doubled)).count() == doubled.count()
