"""Language-model scoring: an interpolated modified Kneser-Ney model counted in Spark over the whole training
corpus, stored as sorted hash arrays that workers map into memory (see ``kneser_ney``). The order is three.

Cases: null and empty texts consist of the end token; a null id counts as training; texts of any length are
scored whole; repeated rows count and are scored each for itself; without training texts every token has the
probability 1 / (V + 1) with V = 0; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks
from .kneser_ney import KneserNey, tokens, train

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def crc_mod(col, n: int):
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def score_texts(docs: DataFrame, model: KneserNey) -> DataFrame:
    """For (doc_id, held_out, text): sums over each text's tokens."""
    total, v = model.n_tokens, model.n_words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in chunks(batch.column(2), 2 * CHUNK_BYTES):
                h, at = tokens(data, offsets)
                c, p = model.levels(h, at)
                sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731,B023
                cols = [np.diff(at), sums((c > 0).astype(np.int64)), np.full(len(at) - 1, total, np.int64),
                        sums(np.log10((c + 1) / (total + v + 1))), sums(np.log10(p))]
                part = batch.slice(i, len(at) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, SCHEMA)


def lm_scores(docs: DataFrame, modulus: int = 7, rest: int = 2, id_col="doc_id", text_col="text", order: int = 3) -> DataFrame:
    """Train on documents whose crc32(id) modulo ``modulus`` is not ``rest``; score all."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (crc_mod(docs[id_col], modulus) == rest).alias("held_out"), docs[text_col].cast("string").alias("text"))
    model = train(rows.where("not held_out"), order=order)
    return score_texts(rows, model)
