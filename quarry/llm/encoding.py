"""BPE encoding and decoding of whole texts (see ``bpe`` for the method)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_vocabulary, encoded_blocks, encoder


def encode(docs: DataFrame, vocabulary: str | None = None, decode: bool = False, speculate: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, and with ``decode`` the text made from the ids.

    ``ids`` are little-endian unsigned 32-bit integers.  Rows stay where they are: no
    shuffle, memory bounded by one block of rows.  Null and empty texts have no ids;
    repeated rows are encoded one by one; a null doc_id stays null; columns other than
    doc_id and text are ignored; a text of any length is encoded whole.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        import itertools

        first = next(batches, None)
        if first is None:
            return
        token_text = encoder(path, speculate).token_text.__getitem__
        for keys, ids, ends in encoded_blocks(itertools.chain([first], batches), path, speculate):
            data = ids.astype("<u4").tobytes()
            cuts = (ends * 4).tolist()
            columns = {"doc_id": keys.cast(pa.int64()), "n_tokens": pa.array(ends[1:] - ends[:-1], pa.int64()), "ids": pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())}
            if decode:
                listed, cuts = ids.tolist(), ends.tolist()
                columns["decoded"] = pa.array([b" ".join(map(token_text, listed[a:b])) for a, b in zip(cuts, cuts[1:])], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Add ``decoded`` to rows with ``ids``: token texts joined by single spaces, as a
    vocabulary without a decoder has it.  Null ids give null."""
    import numpy as np

    path = vocabulary or default_vocabulary()

    def run(batches):
        for batch in batches:
            get = encoder(path).token_text.__getitem__
            texts = [None if x is None else b" ".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "decoded"])

    plain = encoded.drop("decoded")
    return plain.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in plain.dtypes)}, decoded string")
