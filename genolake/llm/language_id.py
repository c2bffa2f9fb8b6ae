"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, ship, text_column
from .embedding import BUCKETS, Model, gather, letter_ngrams, sample, scorer, train

#: Rows that the model is trained on, at most (about).
TRAIN_ROWS = 3000


def fit(docs: DataFrame, learn: Column, most: int = TRAIN_ROWS) -> Model:
    """A model of the lang values of the rows of docs for which learn holds and text and lang are not null."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").alias("label"), learn.alias("learn")).where("learn and text is not null and label is not null")
    return train(*gather(sample(rows, "doc_id", most), letter_ngrams, BUCKETS))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model, letter_ngrams)
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            found = []
            for a, b, letters in zip(starts.tolist(), ends.tolist(), batch.column("letters").to_pylist(), strict=True):
                chance = of(data[a:b]) if letters and model.classes else None
                found.append(("und", 0.0) if chance is None else (model.classes[int(chance.argmax())], float(chance.max())))
            low = pa.array([s < model.floor for _, s in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), low], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Returns (doc_id, held_out, lang_pred, score, rejected), a row per row of docs (doc_id, text, lang; other columns are
    ignored). Learns from rows whose crc32(doc_id) mod 4 is not 2; a prediction uses the whole text and nothing else.

    lang_pred: a learned value, or `und` with score 0 if the text is null or has no letter, or nothing could be learned.
    score: the calibrated probability of lang_pred. rejected: the score is under the floor that 99 % of right predictions
    on rows kept from training pass. A null doc_id counts as held out; an empty table gives no rows."""
    ship(docs.sparkSession)
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(True))
    model = fit(docs, ~held_out, most)
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
