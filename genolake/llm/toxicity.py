"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores and offending offsets.

Tokens are runs of letters, digits and bytes of other scripts. Labelled tokens are learned from: either given (spans of texts), or taken from
labels of documents, where beginnings, ends and whole words that stand in toxic texts only mark the tokens. A document's score is a logistic
function of its tokens' marginals, fitted on rows that the field was not trained on."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import crc_of_id, discard, each_text, ship, staged, text_column
from .hashing import BYTE, SEGMENT, prefix_sums, shingle_set, stretches

#: Labelled rows that are learned from, at most (about), by label.
TRAIN_ROWS = {1: 2000, 0: 4000}
#: Chains with and without toxic tokens that the field is trained on, at most, and tokens in one.
CHAINS, TOKENS = {True: 4000, False: 6000}, 48
#: Marking features that are kept, the strongest first.
MARKS = 20_000
#: A document counts as toxic from this score on.
TOXIC = 0.3
#: Marginals under LOW add nothing to a document's score; the greatest one counts as a logit within LOGIT.
LOW, LOGIT = 0.2, 8.0
BITS = 17
BEGIN, END = (3, 4, 5, 6, 7, 8), (3, 4, 5)
#: Kinds of features: the word, its beginnings, its ends, the words beside it.
KINDS = 1 + len(BEGIN) + len(END) + 2
OWN = KINDS - 2
_PART = np.zeros(256, bool)
_PART[128:] = _PART[48:58] = _PART[65:91] = _PART[97:123] = True


def _lower(text: np.ndarray) -> np.ndarray:
    """A-Z and two-byte Latin capitals as small letters."""
    out = text + ((text >= 65) & (text < 91)) * np.uint8(32)
    latin = np.flatnonzero(text[:-1] == 0xC3) + 1
    low = text[latin]
    out[latin] = low + ((low >= 0x80) & (low <= 0x9E) & (low != 0x97)) * np.uint8(32)
    return out


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes * np.uint64(0x9FB21C651E98DF25 + 2 * kind)) >> np.uint64(64 - BITS)).astype(np.int32) + np.int32(kind << BITS)


def tokens(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, word hash, own features) of the tokens of one text, piece by piece; offsets are bytes, features (tokens, OWN)."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + SEGMENT, n)
        while end < n and _PART[text[end]]:  # a piece ends where no token does
            gaps = np.flatnonzero(~_PART[text[end : end + SEGMENT]])
            end = end + int(gaps[0]) if len(gaps) else min(end + SEGMENT, n)
        part = _lower(text[at:end])
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = _PART[part]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            sums = prefix_sums(BYTE[part])
            word = stretches(sums, start, stop)
            own = [_bucket(word, 0)]
            for k, size in enumerate((*BEGIN, *END)):
                a, b = (start, np.minimum(start + size, stop)) if k < len(BEGIN) else (np.maximum(stop - size, start), stop)
                own.append(np.where(stop - start > size, _bucket(stretches(sums, a, b), k + 1), -1))
            yield start + at, stop + at, word, np.stack(own, axis=1)
        at = end


def whole(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, features) of all tokens of a text; features (tokens, KINDS), -1 for none."""
    found = list(tokens(text))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, KINDS), np.int32)
    start, stop, word, own = (np.concatenate(x) for x in zip(*found, strict=True))
    beside = np.full((len(word), 2), -1, np.int32)
    beside[1:, 0] = _bucket(word[:-1], OWN)
    beside[:-1, 1] = _bucket(word[1:], OWN + 1)
    return start, stop, np.concatenate([own, beside], axis=1)


@dataclass
class Model:
    """weights of the features, the chain, and the logistic function of (logit of the greatest marginal, log of expected toxic tokens)."""

    weights: np.ndarray
    bias: float
    chain: crf.Chain
    scale: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0]))

    def marginals(self, features: np.ndarray, begins: np.ndarray) -> np.ndarray:
        values = np.append(self.weights, np.float32(0))  # -1 finds the 0 at the end
        return self.chain.marginals(values[features].sum(axis=1) + self.bias, begins)

    def score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + facts @ self.scale[1:], -500, 500)))


def facts_of(marginals: np.ndarray) -> list[float]:
    """What a document's score is a function of."""
    if not len(marginals):
        return [-LOGIT, 0.0]
    most = float(marginals.max())
    # what long clean texts add up to by many small chances counts for nothing
    return [min(max(math.log(most + 1e-9) - math.log(1 - most + 1e-9), -LOGIT), LOGIT), math.log1p(float(marginals[marginals >= LOW].sum()))]


def _tagged(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, end, marginal) of each text; short texts' chains are scanned together."""
    waiting, held = [], 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        size = np.array([len(w[1]) for w in waiting])
        begins = np.zeros(int(size.sum()), bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        chance = model.marginals(np.concatenate([w[3] for w in waiting]), begins)
        for (text, start, stop, _), own in zip(waiting, np.split(chance, np.cumsum(size)[:-1]), strict=True):
            yield text, start, stop, own

    for text in each_text(batch.column("text")):
        waiting.append((text, *whole(text)))
        held += len(waiting[-1][1])
        if held > 200_000 or len(waiting) > 2000:
            yield from flush()
            waiting, held = [], 0
    if waiting:
        yield from flush()


def _spans(text: np.ndarray, start: np.ndarray, stop: np.ndarray, chance: np.ndarray, floor: float) -> list[dict]:
    """Runs of tokens whose marginal is at least floor, by code points."""
    hit = np.concatenate([[0], (chance >= floor).astype(np.int8), [0]])
    first, last = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1) - 1
    if not len(first):
        return []
    points = np.cumsum((text & 0xC0) != 0x80)
    return [{"start": int(points[start[a]] - 1), "end": int(points[stop[b] - 1]), "score": float(chance[a : b + 1].max())} for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def _score(model: Model, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, spans = [], []
            for text, start, stop, chance in _tagged(batch, model):
                facts.append(facts_of(chance))
                spans.append(_spans(text, start, stop, chance, floor))
            score = model.score(np.array(facts).reshape(-1, 2))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "score", "spans"])

    return run


def _facts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [facts_of(chance) for *_, chance in _tagged(batch, model)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(facts, pa.list_(pa.float64()))], ["label", "facts"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct own features, and the least hash of its shingles, which near copies share."""
    for batch in batches:
        seen, key = [], []
        for text in each_text(batch.column("text")):
            parts = list(tokens(text))
            seen.append(np.unique(np.concatenate([p[3].ravel() for p in parts])) if parts else np.zeros(0, np.int32))
            grams = shingle_set(np.concatenate([p[2] for p in parts]), 3) if parts else np.zeros(1, np.uint64)
            key.append(int(grams[0].view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(key, pa.int64()), pa.array([s[s >= 0] for s in seen], pa.list_(pa.int32()))], ["label", "key", "seen"])


def marks_of(rows: DataFrame, most: int = MARKS) -> np.ndarray:
    """Features that mark toxic tokens: five texts of label 1 or more hold them, few of label 0, by a margin that chance gives once in
    60,000. rows: (text, label). Of texts with the same least shingle hash (near copies) one counts."""
    seen = staged(rows.select("text", "label").mapInArrow(_features, "label int, key long, seen array<int>").dropDuplicates(["label", "key"]), "features")
    n = {r.label: r.n for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        discard(seen)
        return np.zeros(0, np.int32)
    share = n[1] / sum(n.values())
    a, b = F.col("a"), F.col("b")
    found = seen.select("label", F.explode("seen").alias("feature")).groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).where("a >= 5")
    chance = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / max(1 - share, 1e-9))).otherwise(0)
    found = found.where((a * (1 - share) >= 30 * b * share) & (chance >= 11) if share < 1 else F.lit(True))
    out = np.array([r.feature for r in found.orderBy(chance.desc(), "feature").limit(most).collect()], np.int32)
    discard(seen)
    return np.sort(out)


def _chains(marks: np.ndarray, size: int = TOKENS):
    """Pieces of `size` tokens of texts (text, label, inside: array of marked code point spans, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(each_text(batch.column("text"))):
                label, given = batch.column("label")[i].as_py(), batch.column("inside")[i].as_py()
                start, stop, features = whole(text)
                if given is None:
                    inside = np.isin(features[:, :OWN], marks).any(axis=1) & bool(label)
                else:
                    points, inside = np.cumsum((text & 0xC0) != 0x80), np.zeros(len(start), bool)
                    for span in given:
                        inside |= (points[start] - 1 < span["end"]) & (points[stop - 1] > span["start"]) if len(start) else False
                at = range(0, len(start), size)
                # an unmarked piece of a toxic text may hold what no mark found
                keep = [k for k in at if given is not None or not label or inside[k : k + size].any()]
                if keep:
                    cut = [features[k : k + size].astype("<i4").tobytes() for k in keep]
                    rows = {"toxic": [bool(inside[k : k + size].any()) for k in keep], "features": cut, "inside": [inside[k : k + size].astype(np.uint8).tobytes() for k in keep]}
                    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("toxic", pa.bool_()), ("features", pa.binary()), ("inside", pa.binary())]))

    return run


def train_chains(rows: DataFrame, marks: np.ndarray | None = None, most: dict[bool, int] = CHAINS) -> Model:
    """A field from rows (text, label, inside): `inside` lists the toxic spans (start, end; code points), or is null, and then the
    marks say which tokens of a text of label 1 are toxic. At most `most` pieces with and without toxic tokens are learned from."""
    cut = staged(rows.select("text", "label", "inside").mapInArrow(_chains(np.zeros(0, np.int32) if marks is None else marks), "toxic boolean, features binary, inside binary"), "chains")
    order = F.xxhash64("features", "inside")
    got = [cut.where(F.col("toxic") == toxic).orderBy(order, "features").limit(most[toxic]).select("features", "inside").toArrow() for toxic in (True, False)]
    discard(cut)
    if not len(got[0]):
        return Model(np.zeros(KINDS << BITS, np.float32), -crf.LIMIT, crf.Chain())
    inside = [np.frombuffer(x, np.uint8) for t in got for x in t.column("inside").to_pylist()]
    features = np.frombuffer(b"".join(x for t in got for x in t.column("features").to_pylist()), "<i4").reshape(-1, KINDS)
    begins = np.zeros(len(features), bool)
    begins[np.cumsum([0, *map(len, inside[:-1])])] = True
    return Model(*crf.train(features, np.concatenate(inside).astype(np.int64), begins, KINDS << BITS))


def calibrate(model: Model, rows: DataFrame, weight: dict[int, float]) -> Model:
    """Fits the logistic function on rows (text, label); weight: how many rows each row of a label stands for."""
    got = rows.select("text", "label").mapInArrow(_facts(model), "label int, facts array<double>").collect()
    y = np.array([r.label for r in got], float)
    if not 0 < y.sum() < len(y):
        model.scale = np.array([-30.0 if not y.sum() else 30.0, 0, 0])
        return model
    x = np.column_stack([np.ones(len(y)), np.array([r.facts for r in got])])
    w = np.where(y == 1, weight.get(1, 1.0), weight.get(0, 1.0))
    w = w / w.mean()
    at = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope, curve = x.T @ (w * (p - y)) + 1e-2 * at, (x.T * (w * p * (1 - p))) @ x + 1e-2 * np.eye(3)
        at = at - np.clip(np.linalg.solve(curve, slope), -2, 2)
    model.scale = at
    return model


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] = TRAIN_ROWS) -> Model:
    """A model of labels.toxic, from rows whose crc32(doc_id) mod 4 is not 2. Labelled rows are sampled by label, at most about `most` of
    each, by a hash of doc_id and text; three in four train the field, the others the score."""
    usable = labels.where("doc_id is not null and toxic is not null").where(crc_of_id(F.col("doc_id")) % 4 != 2)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where("label in (0, 1)")
    # a row of labels for each id, so ids are drawn first, and of the rows of one id, however many, one by its text
    n = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    rate = F.when(F.col("label") == 1, most[1] / max(n.get(1, 1), 1)).otherwise(most[0] / max(n.get(0, 1), 1)) * 1_000_000
    drawn = usable.where(draw < rate)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    rows = staged(rows.withColumn("inside", F.lit(None).cast("array<struct<start:int,end:int>>")).withColumn("kept_back", F.pmod(F.xxhash64("text"), F.lit(4)) == 0), "labelled")
    learn = rows.where("not kept_back")
    model = train_chains(learn, marks_of(learn))
    got = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = calibrate(model, rows.where("kept_back"), {k: n[k] / got[k] for k in got})
    discard(rows)
    return model


def tag(docs: DataFrame, model: Model, toxic: float = TOXIC, floor: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, spans, predicted) by a fitted model; see score_toxicity."""
    ship(docs.sparkSession)
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(True))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(_score(model, floor), f"doc_id {kind}, held_out boolean, score double, spans array<struct<start:int,end:int,score:double>>")
    return scored.withColumn("predicted", F.when(F.col("score") >= toxic, 1).otherwise(0))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: dict[int, int] = TRAIN_ROWS, toxic: float = TOXIC) -> DataFrame:
    """Returns (doc_id, held_out, score, spans, predicted), a row per row of docs (doc_id, text; other columns are ignored).

    score: the chance that toxic is 1, from the whole text and nothing else; a null or empty text has no token and gets the score of
    a text without toxic tokens. spans: runs of tokens with a marginal of 0.5 or more (start, end in code points, end exclusive, and
    the greatest marginal). predicted: 1 if score >= toxic, else 0. Of labels repeated for a doc_id the greatest counts, of its
    repeated rows one is learned from. Without a label of 1 scores are next to 0. A null doc_id counts as held out; an empty table gives no rows.
    A task holds about forty times its longest text in memory."""
    ship(docs.sparkSession)
    return tag(docs, fit(docs, labels, most), toxic)
