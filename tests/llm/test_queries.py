"""The registered queries over small tables: columns and rows of the contracts."""

import hashlib
import zlib

import pytest

from skein.llm import registry
from tests.llm.test_operators import got, near_components, without_repeats

COLUMNS = {
    "op1_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_sentencepiece": {"doc_id": "bigint", "n_pieces": "bigint", "ids_crc32": "bigint", "lossless": "boolean"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op12_passages": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op13_infill": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.fixture(scope="module")
def tables(spark, docs, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], int(i % 4 > 0), 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(r[0], f"http://h/{r[0]}", r[1]) for r in rows], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, tables, rows, name):
    df = registry.queries()[name](spark, tables)
    kinds = dict(df.dtypes)
    assert COLUMNS[name].items() <= kinds.items()
    found = got(df.select(*COLUMNS[name]))
    assert set(found) == {r[0] for r in rows} and df.count() == len(rows)
    if name == "op6_minhash":
        assert found == near_components(rows, 4)
    if name == "op8_suffix_dedup":
        assert found == without_repeats(rows, 200)
    if name in ("op3_quality", "op5_language"):
        mod, out = (5, 0) if name == "op3_quality" else (4, 2)
        assert all(v[0] == (zlib.crc32(str(d).encode()) % mod == out) for d, v in found.items())
    if name == "op9_warc":
        first = {}
        for r in sorted(rows):
            first.setdefault((r[1] or "").encode(), r[0])
        for r in rows:
            b = (r[1] or "").encode()
            head = first[b] if len(b) >= 100 and first[b] != r[0] else None
            assert found[r[0]] == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if head is not None else "response", head)
