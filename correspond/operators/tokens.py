"""Tokens of a tokenizer: how many a text has, and texts cut at their boundaries."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts -> for each one the places (start, end) of its tokens in its characters, in order.
Offsets = Callable[[list[str]], list[list[tuple[int, int]]]]


def tokenizer_offsets(tokenizer_json: str) -> Offsets:
    """Of a tokenizer in the tokenizers library's format, given as its JSON text, without special tokens."""
    held: list = []

    def of(texts: list[str]) -> list[list[tuple[int, int]]]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_str(tokenizer_json))
        return [held[0].encode(t, add_special_tokens=False).offsets for t in texts]

    return of


def _kept(batches: Iterator[pa.RecordBatch], text: str, offsets: Offsets, most: int = 256):
    """Slices of batches with their texts' offsets; a null text has no token."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            texts = [t or "" for t in part.column(text).to_pylist()]
            yield part, texts, offsets(texts)


def token_counts(rows: DataFrame, text: str, name: str, offsets: Offsets) -> DataFrame:
    """rows with the number of tokens of a column, for budgets (retrieval.within_budget, batches)."""

    def of(batches):
        for part, _, found in _kept(batches, text, offsets):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(f) for f in found], pa.int64())], [*part.schema.names, name])

    rows = rows.drop(name)
    return rows.mapInArrow(of, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def token_chunks(docs: DataFrame, offsets: Offsets, size: int = 1500, overlap: int = 150) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, chunk, n_tokens, start, end, text): pieces of `size` tokens, each `overlap` tokens into the one before, cut at the tokens' places in the original characters.

    A last piece that the one before holds whole is none. Texts without a token have no piece; a character that several tokens share goes to both pieces that its tokens are in.
    """
    step = size - overlap
    kind = T.StructType([docs.schema["doc_id"]]).add("chunk", "integer").add("n_tokens", "integer").add("start", "integer").add("end", "integer").add("text", "string")

    def of(batches):
        for part, texts, found in _kept(batches, "text", offsets):
            ids, rows = [], []
            for k, (text, spans) in enumerate(zip(texts, found, strict=True)):
                for n, first in enumerate(range(0, max(1, len(spans) - overlap), step) if spans else ()):
                    own = spans[first : first + size]
                    a, b = own[0][0], max(e for _, e in own)
                    ids.append(k)
                    rows.append((n, len(own), a, b, text[a:b]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(np.array(ids, np.int64))), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], kind.names)

    return docs.select("doc_id", F.col("text")).mapInArrow(of, kind)
