"""Fill-in-the-middle examples: documents cut in prefix, middle and suffix at token boundaries, reordered behind markers.

A text is decoded to an array of UTF-32 code points. Comparing the class (white space or not) of
neighbouring code points gives the ends of all tokens at once (``flatnonzero``): a token is a word with
the white space before it, and white space at the end of a text is a token of its own. Two ranks drawn
from the document's id choose the ends of prefix and middle, and the three slices are encoded again.
Draws depend on the seed and the id alone, so reruns and any partitioning agree.

``restored`` rebuilds the text from an output and its form. A text that contains a marker stays plain, and
no marker can arise where a piece meets one, as a marker's first character occurs nowhere else in it.

Cases: null text counts as empty and stays plain; a text of white space is one token; a missing doc_id draws
as an empty one, so all such rows share their draws; rows that repeat a doc_id share them too, each over its
own text; an empty table gives an empty result; other columns are ignored. A text is held whole, at about 14
bytes a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Rows of an Arrow batch that are worked on at a time.
ROWS = 256


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def token_ends(points: np.ndarray) -> np.ndarray:
    """Where each token ends (excluded); the last is the text's length."""
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.append(ends, len(points))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def example(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output) of a document; rates are percents."""
    points = codepoints(text)
    ends = token_ends(points)
    a, b, chosen, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or chosen % 100 >= rate:
        return len(ends), "plain", None, None, text
    low, high = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
    cut = lambda rank: int(ends[rank - 1]) if rank else 0
    first, second = cut(low), cut(high)
    prefix, middle, suffix = piece(points[:first]), piece(points[first:second]), piece(points[second:])
    if order % 100 < spm_rate:
        return len(ends), "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def original(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    lead, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(lead):
        raise ValueError(f"no output of form {form}: {output[:40]!r}")
    head, _, rest = output[len(lead) :].partition(inner)
    tail, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [example(k, t or "", seed, rate, spm_rate) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], [key, "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(make, f"`{key}` bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """``transformed``'s rows with the text that is rebuilt from output and form."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = batch.schema.get_field_index("output"), batch.schema.get_field_index("form")
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [original(o, f) for o, f in zip(part.column(output).to_pylist(), part.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.large_string())], [*part.schema.names, "restored"])
        give_back()

    kinds = ", ".join(f"`{n}` {k}" for n, k in outputs.dtypes)
    return outputs.mapInArrow(make, f"{kinds}, restored string")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle examples of all documents, by digests of the outputs and of the texts rebuilt from them."""
    out = restored(transformed(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents
), d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t
), c AS (
  SELECT *, len(tok) AS n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(tok[1:a], '') AS prefix, array_to_string(tok[a + 1:b], '') AS middle,
    array_to_string(tok[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
