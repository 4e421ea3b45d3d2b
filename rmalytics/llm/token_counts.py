"""Token counts of whole documents; huge ones by overlap resynchronisation.

A document of more than ``chunk`` characters is encoded in overlapping chunks
with offsets. Two neighbouring chunks are spliced at a place in their overlap
where both have a token start and where the tokenizer's pre-tokenizer always
cuts (see ``ByteBpe``); what lies left of it is taken from the left chunk, the
rest from the right one. Where the overlap holds no such place it is doubled,
and at last the left chunk grows, so that a document without any stable place
is encoded whole. Shorter documents are summed over their parts between stable
places, each distinct part encoded once for a run of rows.

Edge cases: null text counts as empty (0 tokens, 0 bytes); a null id stays
null; repeated rows give a row each; special strings inside texts are handled
as the library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rmalytics.llm import _bpe
from rmalytics.llm._text import pieces, sums_by_row

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256


def _stable(text: str, at: int) -> bool:
    return text[at].isspace() and not text[at - 1].isspace()


def resynchronised_count(bpe: _bpe.ByteBpe, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, encoded chunk by chunk."""

    def starts(a: int, b: int) -> np.ndarray:
        return a + np.array([x for x, _ in bpe.lib.encode(text[a:b], add_special_tokens=False).offsets], dtype=np.int64)

    if not bpe.cuttable:
        return len(starts(0, len(text)))
    count, kept, end = 0, 0, min(chunk, len(text))
    left = starts(kept, end)
    while end < len(text):
        splice, wide = None, overlap
        while splice is None and end - wide > kept:
            a, b = end - wide, min(end - wide + max(chunk, 2 * wide), len(text))
            right = starts(a, b)
            common = np.intersect1d(left[left > a], right[right < end])
            splice = next((int(x) for x in common[::-1] if _stable(text, int(x))), None)
            wide *= 2
        if splice is None:  # nothing stable since the last splice: a longer left chunk
            end = min(kept + 2 * (end - kept), len(text))
            left = starts(kept, end)
            continue
        count += int((left < splice).sum())
        kept, end, left = splice, b, right[right >= splice]
    return count + len(left)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe.load(path)
        for batch in batches:
            ids = batch.column(0)
            for a, b, buf, off in pieces(batch.column(1)):
                size = np.diff(off)
                huge = np.flatnonzero(size > chunk)
                s, e, rows = bpe.parts(buf, off)
                plain = np.ones(len(s), dtype=bool)
                for r in huge:
                    plain[rows[r] : rows[r + 1]] = False
                each = np.zeros(len(s), dtype=np.int64)
                codes = bpe.counts.codes(buf, s[plain], e[plain])
                each[plain] = np.array(bpe.counts.items, dtype=np.int64)[codes] if len(codes) else 0
                n = sums_by_row(each, rows)
                for r in huge:
                    n[r] = resynchronised_count(bpe, buf[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"), chunk, overlap)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = out.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
