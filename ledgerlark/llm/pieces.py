"""Sentence-piece ids by a table of distinct chunks, and back to text (op 7).

Row by row, no shuffle.  Null text: the empty text, which has the begin and end ids only.  Texts are encoded whole, whatever
their length; equal texts have equal ids; repeated rows and null ids are each returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import map_texts, table, texts


def encode(docs: DataFrame, model: str, begin_id: int = 1, end_id: int = 2) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, as the library encodes it."""
    first, last = tokens.packed([begin_id]), tokens.packed([end_id])

    def work(ids: list, text: list[str]) -> dict:
        return {"doc_id": ids, "ids": [np.frombuffer(first + tokens.piece_ids(model, t) + last, "<i4") for t in text]}

    return map_texts(texts(docs), work, "doc_id long, ids array<int>")


def digests(docs: DataFrame, model: str, begin_id: int = 1, end_id: int = 2) -> DataFrame:
    """Encode, decode and keep only lengths and digests."""
    first, last = tokens.packed([begin_id]), tokens.packed([end_id])

    def work(ids: list, text: list[str]) -> dict:
        got = [first + tokens.piece_ids(model, t) + last for t in text]
        back = [tokens.piece_text(model, np.frombuffer(x, "<u4").tolist()) for x in got]
        return {
            "doc_id": ids, "n_tokens": [len(x) // 4 for x in got], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in got],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
        }

    return map_texts(texts(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokens.vocabulary("piece_bpe_32k.model"))
