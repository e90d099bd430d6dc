"""Spelling variants, passages and fill-in-the-middle against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import fmindex, infill, passages, spelling
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_counts(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, form[w], counts.get(form[w]), root(w), len(near[w])) for w, n in counts.items()}


def variants_of(df):
    return {r["word"]: (r["n"], r["form"], r["form_n"], r["root"], r["n_near"]) for r in df.collect()}


def spelled(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(4, 11))) for _ in range(40)] + ["straße", "Ünder", "aaaaaa", "aaaaab", "abababab"]
    out = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcX") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "1"]).join(words), None, None, None, "s", "n", "k", "d", "z"))
    return out


def test_word_counts_and_variants(spark, rows):
    some = spelled() + [(None, "Missing missing missing ids", *[None] * 8), (7, None, *[None] * 8), (8, "", *[None] * 8)] + list(rows)
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    counts = brute_counts(some)
    found = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert found == counts and len(counts) > 200
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute_variants(counts)
    assert sum(v[1] is not None for v in want.values()) > 30
    for meet in (1, 4, 1000):
        assert variants_of(spelling.variants(words, meet=meet)) == want


def test_hot_segments(spark):
    """All words share their first half; keys are cut until only real neighbours meet, and chains of forms reach their end."""
    rng = random.Random(9)
    words = {"commonstart" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))): rng.randrange(3, 3000) for _ in range(500)}
    words |= {"q" * k: 3 * 2**k for k in range(1, 20)}
    words |= {w: 3 for w in ("中bcde", "中bcdf", "\U0001f600bcde", "z" * 3000, "z" * 3001)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants_of(spelling.variants(df, meet=8)) == brute_variants(words)


def test_words_of_odd_tables(spark, nothing, doubled):
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0
    some = [tuple(r) for r in doubled.collect()]
    counts = brute_counts(some)
    assert variants_of(spelling.variants(spelling.word_counts(doubled))) == brute_variants(counts)


# --- passages ----------------------------------------------------------------------------------------------


def brute_passages(rows, depth):
    """(doc, words, words removed, digest of the rest) of every row."""
    least = {}
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - depth + 1):
            key = tuple(w[i : i + depth])
            least[key] = min(least.get(key, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - depth + 1):
            if least[tuple(w[i : i + depth])] < (float("inf") if doc is None else doc):
                gone[i : i + depth] = True
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def found_passages(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def with_passages(rows):
    """Texts that share passages between changing words, repeat a passage inside, and differ in case or white space alone."""
    rng = random.Random(2)
    shared = prose(rng, 120)
    more = [f"{prose(rng, rng.randrange(0, 30))} {shared} {prose(rng, rng.randrange(0, 30))}" for _ in range(40)]
    more += [f"{shared}\n\n{shared}", shared.upper(), shared.replace(" ", "\t\n"), " ".join(shared.split()[:60]), "la " * 400, "la " * 130]
    return rows + [(1000 + (i * 7) % 50, t, *rows[0][2:]) for i, t in enumerate(more)]


@pytest.mark.parametrize(("depth", "gram", "hot"), [(50, 8, 2048), (50, 8, 2), (12, 4, 3), (5, 2, 0)])
def test_passages(spark, rows, depth, gram, hot):
    some = with_passages(rows)
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    want = brute_passages(some, depth)
    assert sum(r[2] for r in want) > 3000
    assert found_passages(passages.dedup_passages(docs, depth, gram, hot=hot)) == want


def test_passages_in_many_shards_and_stretches(spark, rows, monkeypatch):
    some = with_passages(rows)
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    for name, value in (("SHARD", 2000), ("PIECE", 4096), ("STRETCH", 300), ("SMALL_IDS", 0)):
        monkeypatch.setattr(passages, name, value)
    out = passages.dedup_passages(docs, give_text=True)
    assert found_passages(out) == brute_passages(some, 50)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out.collect())


def test_passages_of_odd_tables(spark, nothing, doubled):
    assert passages.dedup_passages(nothing).count() == 0
    some = [tuple(r) for r in doubled.collect()]
    assert found_passages(passages.dedup_passages(doubled)) == brute_passages(some, 50)
    signed = [(-5 + i % 3, r[1], *r[2:]) for i, r in enumerate(some)] + [(2**63 - 1, r[1], *r[2:]) for r in some[:5]]
    assert found_passages(passages.dedup_passages(spark.createDataFrame(signed, SCHEMA), 10, 3)) == brute_passages(signed, 10)


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_index_against_scan(depth):
    rng = np.random.default_rng(depth)
    for symbols in (2, 5, 300):
        sequences = [rng.integers(1, symbols + 1, rng.integers(depth, 40)) for _ in range(25)]
        owners = rng.integers(-3, 9, 25)
        flat = np.concatenate(sequences)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sequences])))
        index = fmindex.FmIndex(np.insert(flat, offsets[1:], 0), np.repeat(owners, [len(s) + 1 for s in sequences]), depth)
        least = {}
        for s, o in zip(sequences, owners, strict=True):
            for i in range(len(s) - depth + 1):
                least[tuple(s[i : i + depth])] = min(least.get(tuple(s[i : i + depth]), 99), o)
        want = [least[tuple(s[i : i + depth])] if i + depth <= len(s) else fmindex.NONE for s in sequences for i in range(len(s))]
        assert index.least_owners(flat, offsets).tolist() == want


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(4)
    for symbols, n in ((1, 10), (2, 64), (37, 1000), (256, 129)):
        s = rng.integers(0, symbols, n)
        tree = fmindex.WaveletTree(s, symbols)
        for c in range(symbols):
            at = np.arange(n + 1)
            assert tree.rank(np.full(n + 1, c), at).tolist() == [0, *np.cumsum(s == c).tolist()]


# --- fill in the middle ------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_infill(doc, text):
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark, rows, nothing):
    odd = ["<P", "a<S", "S> b <", "x <P> y", " lead", "trail \n", "  x", "\U0001f600 \U0001f601\t", "<<<", "M>"]
    some = list(rows) + [(5000 + 20 * j + i, t, *rows[0][2:]) for j in range(8) for i, t in enumerate(odd)] + [(None, "no id here", *rows[0][2:]), (1, "again", *rows[0][2:])]
    out = infill.restored(infill.transformed(spark.createDataFrame(some, SCHEMA).repartition(3))).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in out), key=str)
    assert got == sorted((brute_infill(r[0], r[1] or "") for r in some), key=str)
    assert {r["form"] for r in out} == {"plain", "spm", "psm"}
    assert sorted(r["restored"] for r in out) == sorted(r[1] or "" for r in some)
    assert infill.restored(infill.transformed(nothing)).count() == 0


def test_draws_and_shares(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('one two three four five ', id) as text")
    forms = {r["form"]: r["count"] for r in infill.transformed(docs).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 1600) < 150 and abs(forms["psm"] - 400) < 90
    assert infill.transformed(docs, rate=0).where("form <> 'plain'").isEmpty()
    assert infill.transformed(docs, rate=100, spm_rate=0).where("form <> 'psm'").isEmpty()


# --- heads without ends ------------------------------------------------------------------------------------


def test_many_heads_take_time_in_proportion():
    """Local headers and end records that never fit, PDF heads without an end mark, heads that share one end."""
    import io
    import time
    import zipfile

    from skein.llm import media

    finder = media.automaton()
    began = time.process_time()
    for junk in (b"PK\3\4aaPK\5\6" * 40_000, b"%PDF-1.4 " * 40_000, b"PK\3\4" * 80_000 + b"PK\5\6" + b"\0" * 18):
        assert media.identify(junk, finder)[1] == []
    assert time.process_time() - began < 20
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "some text")
        z.writestr("b", "%PDF-1.4 %%EOF")
    archive = out.getvalue()
    lead = b"PK\3\4aaPK\5\6" * 1000
    assert ("application/zip", len(lead), len(archive)) in media.identify(lead + archive + lead, finder)[1]
    both = b"x%PDF-1.4 a %PDF-1.5 b %%EOF tail %%EOF"
    assert media.identify(both, finder)[1] == [("application/pdf", 1, both.index(b" tail") - 1)]
