"""Quality classifier: supervised hashed word and character n-gram embeddings, averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, ship, text_column
from .embedding import WORDS_AND_NGRAMS, Model, gather, sample, scorer, train, words_and_ngrams

#: Rows that the model is trained on, at most (about).
TRAIN_ROWS = 4000
#: A document counts as good from this score on.
GOOD = 0.3


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of labels.quality, from rows whose crc32(doc_id) mod 5 is not 0. The labelled rows are sampled first, and the
    sample, whose size is bounded by `most`, is broadcast to the texts."""
    usable = labels.where("doc_id is not null and quality is not null").where(crc_of_id(F.col("doc_id")) % 5 != 0)
    usable = sample(usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")), "doc_id", most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    return train(*gather(rows, words_and_ngrams, WORDS_AND_NGRAMS))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model, words_and_ngrams)
        good = model.classes.index(1) if 1 in model.classes else None
        for batch in batches:
            data, starts, ends = text_column(batch.column("text"))
            found = [0.0 if good is None else float(of(data[a:b])[good]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, good: float = GOOD) -> DataFrame:
    """Returns (doc_id, held_out, score, predicted), a row per row of docs (doc_id, text; other columns are ignored).

    score: the probability that quality is 1, from the whole text and nothing else; a null text is empty and scored like
    any text (by the bias alone). predicted: 1 if score >= good, else 0. Labels repeated for a doc_id count once, the least
    of them. Without a usable label of 1 every score is 0. A null doc_id counts as held out; an empty table gives no rows."""
    ship(docs.sparkSession)
    model = fit(docs, labels, most)
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(True))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= good, 1).otherwise(0))
