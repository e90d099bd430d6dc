import math

import pytest
from pyspark.sql import functions as F

from skein.functions import documents, quality
from skein.functions import text as tx
from skein.operators import evaluation, resolution, search


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    assert column(spark, ["  The  Éclair-Bar! ", "", "!!", "a_b", None], tx.normalise_name) == ["the éclair bar", "", "", "a_b", None]
    assert column(spark, ["The cards and the Banks of as", "cards card", "gas", ""], tx.salient_tokens) == [["card", "bank"], ["card"], ["gas"], []]


def test_coverage_prose(spark):
    said = ["full", " PARTIAL ", "not covered", "uncovered", "full, no limits", "limited", "fully supported", "maybe", "", None]
    assert column(spark, said, tx.normalise_coverage) == ["full", "partial", "none", "full", "none", "partial", "full", None, None, None]
    assert column(spark, ["uncovered", "discovered"], lambda c: tx.normalise_coverage(c, strict=True)) == ["none", None]


def fnv(s):
    h = 2166136261
    for ch in s:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h


def test_hashes_and_labels(spark):
    assert column(spark, ["", "a", "hello", "漢é"], tx.fnv1a) == [fnv(s) for s in ("", "a", "hello", "漢é")]
    assert all(-1 <= x <= 1 for x in column(spark, ["abc"], tx.hashed_embedding)[0])
    assert column(spark, [0.8, 0.5, 0.1, None], tx.confidence_label, "double") == ["High (80%)", "Medium (50%)", "Low (10%)", None]
    assert column(spark, ["someFieldName", "snake_case-x"], tx.humanise_field) == ["Some Field Name", "Snake Case X"]
    assert column(spark, ["2024-03-01T12:00:00Z", "soon", None], tx.format_date) == ["2024-03-01", "soon", "—"]
    assert column(spark, ["automated", "x", None], tx.decision_type) == ["automated", "automated", "automated"]
    ids = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string").select(tx.document_id(F.lit("t"), F.col("x"), F.col("y"))).distinct()
    assert ids.count() == 2


def test_sections_and_chunks(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\ntext\n```\n# no\n```\n## Two ##x\nend"), (2, "plain"), (3, None)], "id int, content string")
    out = [tuple(r) for r in documents.sections(docs).orderBy("id", "index").collect()]
    assert out == [(1, 0, 1, "One", 1, 6, 6, 30), (1, 1, 2, "Two ##x", 6, 8, 30, 44), (2, 0, 1, "", 0, 1, 0, 5), (3, 0, 1, "", 0, 1, 0, 0)]
    whole = {(r["id"], r["index"]): r["content"] for r in documents.sections(docs, content=True).collect()}
    assert whole[(1, 1)] == "## Two ##x\nend" and whole[(2, 0)] == "plain"
    titled = spark.createDataFrame([(1, "## Two ##\n# One #\n#"), (2, "plain"), (3, "### C\n## B")], "id int, content string")
    assert {r["id"]: r["title"] for r in documents.first_titles(titled).collect()} == {1: "One", 2: None, 3: "C"}
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n\n\n\n" + "c" * 30
    chunks = [r["content"] for r in documents.paragraph_chunks(spark.createDataFrame([(1, text)], "id int, content string"), size=70, overlap=5).orderBy("index").collect()]
    assert chunks == ["a" * 30 + "\n\n" + "b" * 30, "b" * 5 + "\n\n" + "c" * 30]
    giant = documents.paragraph_chunks(spark.createDataFrame([(1, "x" * 250), (2, ""), (3, None)], "id int, content string"), size=100, overlap=10).collect()
    assert {r["id"] for r in giant} == {1} and [len(r["content"]) for r in sorted(giant, key=lambda r: r["index"])] == [100, 100, 70]
    fits = documents.paragraph_chunks(spark.createDataFrame([(1, "  a \n\n\n\n b  ")], "id int, content string")).collect()
    assert [r["content"] for r in fits] == ["a \n\n\n\n b"]
    records = spark.createDataFrame([(1, '[{"id": "q", "v": 1}, {"v": 2}, {"id": 7}, 3]'), (2, '{"a": 1}')], "id int, s string").withColumn("structured", F.parse_json("s"))
    assert [r["location"] for r in documents.record_units(records).orderBy("index").collect()] == ["Record: q", "Record 2", "Record 3", "Record 4"]


def test_pieces_against_strings(spark):
    """Random texts, against putting the strings themselves together."""
    import random

    def packed(text, size, overlap):
        text = text.strip()
        if len(text) <= size:
            return [text] * bool(text)
        parts, out, queue = [p for p in text.split("\n\n") if p.strip()], [], ""
        while parts:
            take = 0
            while take < len(parts) and len("\n\n".join([queue] * bool(queue) + parts[: take + 1])) <= size:
                take += 1
            body = "\n\n".join([queue] * bool(queue) + parts[:take])
            parts = parts[take:]
            if not body:
                step = max(1, size - overlap)
                out += [parts[0][i : i + size] for i in range(0, len(parts[0]), step)]
                parts, queue = parts[1:], ""
            elif not parts:
                out.append(body)
                queue = ""
            else:
                out.append(body)
                queue = (body[-overlap:] + "\n\n" if overlap else "") + parts.pop(0)
        return out + [queue] * bool(queue)

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "\U0001f600", " ", "\n", "\n\n", "\n\n", "word", "\u2003"]) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += ["x" * 90 + "\n\n" + "y" * 5 + "\n\n" + "z" * 90, "\n\n" * 40, " ", "a\n\n" * 50]
    for size, overlap in ((20, 5), (20, 0), (7, 7), (30, 45)):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
        out = {i: [] for i in range(len(texts))}
        for r in documents.paragraph_chunks(df, size=size, overlap=overlap).orderBy("id", "index").collect():
            out[r["id"]].append(r["content"])
        assert out == {i: packed(t, size, overlap) for i, t in enumerate(texts)}


def test_target_types(spark):
    rows = spark.createDataFrame([(["b", "a", "b", None, "c", "a"],), ([],), (None,)], "t array<string>")
    assert [r["t"] for r in rows.select(tx.target_types(F.col("t")).alias("t")).collect()] == [["b", "a", "c"], [], None]


def test_batches_and_verdicts(spark):
    """Batches are cut from all types together, so one number and name mean one batch's subjects only."""
    subjects = spark.createDataFrame([(f"{t}{i:03d}", t, f"n{i % 50:02d}") for t in "AB" for i in range(100)], "id string, type string, name string")
    batches = resolution.classification_batches(subjects, spark.createDataFrame([("A000",)], "subject string"), size=7).collect()
    order = sorted((r for r in batches), key=lambda r: (r["name"], r["id"]))
    assert len(order) == 199 and [r["batch"] for r in order] == [i // 7 for i in range(199)]
    table = spark.createDataFrame([(0, "a1", "A", "x"), (1, "b1", "B", "x"), (1, "a2", "A", "y")], "batch int, id string, type string, name string")
    said = resolution.verdict_subjects(spark.createDataFrame([(0, "x"), (1, "z")], "batch int, name string"), table).collect()
    assert [r["subject"] for r in said] == ["a1"]


def test_documents_related_by_entities(spark):
    mentions = [("d1", "e"), ("d2", "e"), ("d3", "e"), ("d1", "f"), ("d3", "f2"), ("d4", "g")] + [(f"d{i}", "hot") for i in range(1, 40)]
    rows = spark.createDataFrame(mentions, "document string, id string")
    remap = spark.createDataFrame([("f2", "f")], "id string, survivor string")
    ties = {(r["document"], r["id"]): r["documents"] for r in resolution.cross_document_relationships(rows, remap).collect()}
    assert ties[("d3", "f")] == 2 and ties[("d2", "e")] == 3 and ties[("d9", "hot")] == 39 and ("d4", "g") not in ties
    pairs = {(r["document"], r["other_document"]): r["n"] for r in resolution.related_documents(rows, remap, most=10).collect()}
    assert pairs == {("d1", "d2"): 2, ("d1", "d3"): 3, ("d2", "d3"): 2}
    assert resolution.related_documents(rows, remap).count() == 39 * 38 // 2


def test_document_chunks(spark):
    rows = [
        ("a", None, "x" * 30, "plaintext", None),
        ("b", "Title", '[{"z": "é", "id": "q"}, {"v": [1]}]', "structured", None),
        ("c", None, '{"k": 1}', "structured", None),
        ("d", "D", "all", "markdown", [("s-0", "One", "p" * 25), ("s-1", "Two", "  "), ("s-2", "Three", "short")]),
        ("e", None, None, "plaintext", None),
    ]
    docs = spark.createDataFrame(rows, "id string, title string, content string, content_type string, sections array<struct<id:string,title:string,content:string>>")
    out = {r["id"]: (r["section_id"], r["section_title"], r["location"], r["content"]) for r in documents.document_chunks(docs, 20, 4).collect()}
    assert out["a::chunk-0"] == (None, "Document", "Section: Document (part 1)", "x" * 20) and out["a::chunk-1"][2:] == ("Section: Document (part 2)", "x" * 14)
    assert "".join(v[3] for k, v in out.items() if k.startswith("b")).count("é") == 1 and out["b::chunk-0"][2].startswith("Record: q (part 1)")
    assert out["c::chunk-0"] == (None, "Document", "Section: Document", '{\n  "k": 1\n}')
    assert out["d::chunk-0"] == ("s-0", "One", "Section: One (part 1)", "p" * 20) and out["d::chunk-2"] == ("s-2", "Three", "Section: Three", "short")
    assert not any(k.startswith("e") for k in out)


def test_quality(spark):
    dims = {k: F.lit(v) for k, v in {"accuracy": 0.8, "completeness": 1.0, "consistency": 1.0, "timeliness": 1.0, "provenance": 1.0, "confidence": 0.9}.items()}
    row = spark.range(1).select(quality.composite(dims).alias("c"), quality.policy(quality.composite(dims)).alias("p"), quality.timeliness(F.lit(100.0), F.lit("Service")).alias("t"), quality.timeliness(F.lit(None).cast("double"), F.lit("X")).alias("n"), quality.consistency(F.lit(2)).alias("k"), quality.alerts({"a": F.lit(0.3), "b": F.lit(0.5), "c": F.lit(0.9)}).alias("a"), quality.extraction_confidence(F.lit(0.9), F.lit("regulatory"), F.lit(0.5)).alias("e")).first()
    assert row["c"] == pytest.approx(0.94) and row["p"] == "auto-publish" and row["t"] == pytest.approx(math.exp(-2)) and row["n"] == 1 and row["k"] == 0.5
    assert [tuple(a) for a in row["a"]] == [("a", "critical"), ("b", "warning")] and row["e"] == pytest.approx(0.9)
    assert column(spark, [0.95, 0.85, 0.6, 0.1], quality.bucket, "double") == ["excellent", "good", "acceptable", "poor"]


@pytest.fixture(scope="module")
def entities(spark):
    rows = [("1", "T", "Card Payment", 0.5, ["a"], 1), ("2", "T", "card  payment!", 0.9, ["b", "a"], 2), ("3", "U", "Card Payment", 0.1, [], 3), ("4", "T", None, 0.2, ["c"], 4), ("5", "T", " ", 0.3, ["d"], 5), ("6", "T", "Card Payments Hub", 0.4, ["e"], 6), ("7", "T", "Unrelated Thing", 0.4, ["e"], 7)]
    return spark.createDataFrame(rows, "id string, type string, name string, confidence double, evidence array<string>, ord int")


def test_exact_resolution(entities):
    survivors, remap = resolution.resolve_exact(entities)
    out = {r["id"]: (r["confidence"], r["evidence"], r["members"]) for r in survivors.collect()}
    assert out["1"] == (0.9, ["a", "b"], 2) and set(out) == {"1", "3", "4", "5", "6", "7"}
    assert [tuple(r) for r in remap.collect()] == [("2", "1")]


def test_remapped_edges(spark, entities):
    _, remap = resolution.resolve_exact(entities)
    edges = spark.createDataFrame([("e1", "t", "2", "6", ["x"]), ("e2", "t", "1", "6", ["y", "x"]), ("e3", "t", "1", "2", ["z"]), ("e4", "u", "6", "2", [])], "id string, type string, source_id string, target_id string, evidence array<string>")
    assert {tuple(map(str, r)) for r in resolution.remap_edges(edges, remap).collect()} == {("t", "1", "6", "e1", "['x', 'y']"), ("u", "6", "1", "e4", "[]")}


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(8)
    pool = [f"w{a}{b}" for a in "abcdefgh" for b in "xyz"] + ["card"] * 10
    rows = [(f"{i:03d}", rng.choice("TU"), " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))), 0.5, [], i) for i in range(250)]
    df = spark.createDataFrame(rows, "id string, type string, name string, confidence double, evidence array<string>, ord int")
    sets = {r[0]: (r[1], frozenset(t for t in r[2].split() if len(t) >= 3)) for r in rows}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], i)
    reps = sorted(classes.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if sets[a][0] == sets[b][0] and sets[a][1] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.67}
    assert {(r["a"], r["b"]) for r in resolution.similar_pairs(df).collect()} == want
    blocks = resolution.candidate_blocks(df, most=4).collect()
    sizes = {}
    for r in blocks:
        sizes.setdefault((r["component"], r["block"]), []).append(r["id"])
    assert all(2 <= len(v) <= 5 for v in sizes.values()) and len({r["id"] for r in blocks}) == len(blocks)


def test_embeddings_query_against_brute_force(spark, tmp_path):
    from skein.registry import queries

    rows = [(i, name) for i, name in enumerate(["", "lime chocolate", "Größe 7", *(f"part {k} of {k * 7}" for k in range(300))])] + [(900, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")

    def one(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h / 4294967295 * 2 - 1

    out = {(r["p_partkey"], r["i"]): r["value"] for r in queries()["hashed_embeddings"](spark, str(tmp_path)).collect()}
    assert {k for k, _ in out} == {k for k, _ in rows} and out[(900, 3)] is None
    for k, name in rows[:-1]:
        assert [out[(k, i)] for i in range(16)] == pytest.approx([one(f"{i}:{name}") for i in range(16)], abs=1e-5)
    pair = spark.createDataFrame([("a😀",)], "t string").select(tx.utf16_units(F.col("t"))).first()[0]
    assert pair == [97, 0xD83D, 0xDE00]


def test_blocking_query_links_all_different_texts(spark, tmp_path):
    import random

    from skein import registry

    rng = random.Random(9)
    pool = ["card", "cards", "Card,", "bank", "Banks", "loan", "the", "as", "hub", "risk", "fund"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 8))) for _ in range(120)] + ["only here words", "Words, here: ONLY", "the of as", None]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def bag(t):
        words = [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) >= 3 and w != "the"]
        return frozenset(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words)

    sets = {str(i): (lang, bag(t)) for i, t, lang in rows if t is not None}
    ids = sorted(sets)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][0] == sets[b][0] and sets[a][1] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= 0.67}
    out = registry.blocking_pairs_jaccard(spark, str(tmp_path)).collect()
    of = {r["b"]: r["a"] for r in out if r["kind"] == "member"}
    near = {(r["a"], r["b"]) for r in out if r["kind"] == "pair"}
    rep = {i: of.get(i, i) for i in ids}
    assert {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][1] and (rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in near)} == want
    assert not set(of) & set(of.values()) and len(out) == len({(r["a"], r["b"]) for r in out}) and all(r["similarity"] == 1 for r in out if r["kind"] == "member")


def test_groups(spark, entities):
    groups = spark.createDataFrame([("g1", ["1", "6", "6", "zz"]), ("g2", ["7"]), ("g3", ["6", "7"])], "group string, ids array<string>")
    members = resolution.adjudicated(groups, entities)
    assert {tuple(r) for r in members.collect()} == {("g1", "1"), ("g1", "6")}
    merged, remap = resolution.merge_groups(entities, members.withColumn("canonical", F.lit("Card Hub")))
    hub = {r["id"]: r for r in merged.collect()}
    assert hub["1"]["name"] == "Card Hub" and hub["1"]["aliases"] == ["Card Payment", "Card Payments Hub"] and hub["1"]["confidence"] == 0.5
    assert [tuple(r) for r in remap.collect()] == [("6", "1")] and len(hub) == 6


def test_verdicts(spark, entities):
    rows = [("1", "placed", "why", 3, 1.7), ("2", "placed", " ", 3, 0.5), ("3", "else", "why", 3, 0.5), ("4", "rejected", "why", 9, None)]
    out = {r["subject"]: (r["id"], r["level"], r["confidence"]) for r in resolution.valid_verdicts(spark.createDataFrame(rows, "subject string, disposition string, rationale string, level int, confidence double")).collect()}
    assert out == {"1": ("cls-1", 3, 1.0), "4": ("cls-4", None, 0.5)}


def test_scores(spark):
    p = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("C", 9), ("A", 1)], "kind string, k int")
    g = spark.createDataFrame([("A", 1), ("A", 3), ("B", 1)], "kind string, k int")
    out = {r["kind"]: tuple(r)[1:4] for r in evaluation.precision_recall(p, g, ["kind", "k"], "kind").collect()}
    assert out == {None: (2, 2, 1), "A": (1, 1, 1), "B": (1, 0, 0)}
    judged = spark.createDataFrame([(0.9, True), (0.85, False), (0.1, False)], "confidence double, correct boolean")
    assert evaluation.band_precision(judged).first()["band_precision"] == 0.5
    assert evaluation.calibration(judged).first()["calibration"] == pytest.approx(1 - (0.1 + 0.85 + 0.1) / 3)
    claims = spark.createDataFrame([("a", "full", 0.9, 1), ("a", "none", 0.9, 2), ("b", "full", 0.5, 3), ("c", "partial", 0.9, 4)], "capability string, coverage string, confidence double, ord int")
    gold = spark.createDataFrame([("a", "full"), ("b", "none"), ("c", "partial"), ("d", "full")], "capability string, coverage string")
    assert tuple(evaluation.coverage_scores(claims, gold).first()) == (0.5, 0.5, 1.0, 0.5)


def test_search(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "id string, embedding array<double>")
    assert [(r["id"], round(r["score"], 4)) for r in search.vector_top(rows, [1.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 0.7071), ("c", 0.0)]
    names = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", "cat")], "id string, name string")
    assert [r["id"] for r in search.keyword_top(names, "Red FOX", 5).collect()] == ["a", "b"]
    one = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    two = spark.createDataFrame([("b", 9.0), ("c", 1.0)], "id string, score double")
    assert [r["id"] for r in search.fused([one, two], 3).collect()] == ["b", "a", "c"]
    assert search.route("hybrid")["merge"] == "reciprocalRankFusion"
    with pytest.raises(ValueError, match="no such kind"):
        search.route("x")
