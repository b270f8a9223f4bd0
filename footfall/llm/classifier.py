"""Quality of whole texts: logistic regression over hashed word n-grams, learnt by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import blocks, checksums, work

BITS = 20  # of the feature space
SAMPLE = 6000  # labelled texts that train the model, at most
SAMPLE_FEATURES = 20_000_000  # and their distinct features together, at most
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.01, 0.0
THRESHOLD = 0.3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_KIND, WORD_KIND, SIGN_KIND = 0, 1, 2
KIND = np.full(256, SIGN_KIND, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD_KIND
KIND[[9, 10, 11, 12, 13, 32]] = SPACE_KIND
REPEATS = (b"= =", b"= _ =")  # names of a word that stands one word before as well, and two words before
SPARSE = "doc_id bigint, n_features bigint, places array<int>, values array<float>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words: runs of letters and digits (every byte past ASCII is a letter), or of other signs."""
    kind = KIND[data]
    spans = [blocks.spans_of(kind == which, offsets) for which in (WORD_KIND, SIGN_KIND)]
    starts, ends, doc = (np.concatenate(parts) for parts in zip(*spans, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], doc[order]


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse rows of texts: places of features, their values, and how many each text has.

    Features are the words in lower case, pairs of neighbours joined by a space, and for a word that
    stands one or two words before as well the name of that repeat, whatever the word. A feature's
    place is the CRC-32 of its bytes modulo the size of the space, its value 1 + ln(count), and rows have length 1.
    """
    data, offsets = blocks.utf8(texts)
    data, n = LOWER[data], len(offsets) - 1
    starts, ends, doc = tokens(data, offsets)
    single = checksums.registers(data, starts, ends)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    between = checksums.step(single[pair], np.uint32(checksums.SPACE))
    double = checksums.registers(data, starts[pair + 1], ends[pair + 1], between)
    hashed, owners = [~single, ~double], [doc, doc[pair]]
    for distance, name in enumerate(REPEATS, 1):
        same = np.flatnonzero((doc[distance:] == doc[:-distance]) & (single[distance:] == single[:-distance]))
        hashed.append(np.full(len(same), zlib.crc32(name), np.uint32))
        owners.append(doc[same])
    place = (np.concatenate(hashed) & np.uint32((1 << bits) - 1)).astype(np.int64)
    key, count = np.unique(np.concatenate(owners) << bits | place, return_counts=True)
    owner = key >> bits
    value = 1 + np.log(count)
    length = np.sqrt(np.bincount(owner, value * value, minlength=n))
    return (key & (1 << bits) - 1).astype(np.int32), (value / length[owner]).astype(np.float32), np.bincount(owner, minlength=n)


@dataclass
class Model:
    """Weights of the places, and the bias."""

    weights: np.ndarray
    bias: float

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def score(self, texts: pa.Array) -> np.ndarray:
        """The chance of label 1 for each text: a sparse dot product each; without features the bias alone."""
        place, value, counts = features(texts, self.bits)
        owner = np.repeat(np.arange(len(counts)), counts)
        logit = self.bias + np.bincount(owner, self.weights[place] * value, minlength=len(counts))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


class Leader:
    """Follow-the-regularised-leader with a learning rate per coordinate; coordinates with |z| <= L1 weigh nothing."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        """One example; ``at`` holds each place once."""
        own = self.weights(at)
        chance = 1 / (1 + np.exp(-np.clip(own @ value, -500, 500)))
        gradient = (chance - label) * value
        more = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * own
        self.n[at] = more


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """The model of sparse rows, each seen once an epoch in an order of its own; without rows all scores are 0.5."""
    leader, bias = Leader((1 << bits) + 1), 1 << bits
    examples = [(np.append(place, bias), np.append(value, 1.0).astype(np.float64)) for place, value in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            leader.learn(*examples[i], float(labels[i]))
    weights = leader.weights(slice(None))
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the id's CRC-32 as text leaves no remainder by 5: labels of these rows are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurizer(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.text_blocks(batches):
            place, value, counts = features(block.column("text"), bits)
            columns = [block.column("doc_id"), pa.array(counts, pa.int64()), blocks.lists(place, counts, pa.int32()), blocks.lists(value, counts, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "places", "values"])

    return run


def training_rows(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_FEATURES, bits: int = BITS
) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Sparse rows and labels of at most ``sample`` labelled documents with at most ``most`` features together.

    Those with the least hashes of their ids are taken, in that order, none held out. Of an
    id with several labels the greatest counts, with several texts the least text.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    marks = work.written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(marks.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most ``sample`` ids
    rows = work.written(chosen.mapInArrow(_featurizer(bits), SPARSE), "sparse")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sized = rows.select("doc_id", F.sum("n_features").over(order).alias("so_far")).where(F.col("so_far") <= most)
    table = rows.join(sized, "doc_id").join(marks, "doc_id").orderBy("so_far", "doc_id").select("places", "values", "quality").toArrow()
    found = []
    for batch in table.to_batches():
        place, value = batch.column("places"), batch.column("values")
        ends = place.offsets.to_numpy()
        flat, own = place.values.to_numpy(), value.values.to_numpy()
        found += [(flat[a:b], own[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return found, table.column("quality").to_numpy()


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, one row per row of ``docs``; no shuffle.

    NULL and empty texts have the score of the bias; a missing id is not held out; a very long text is a block of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the feature space

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.text_blocks(batches):
            score = shared.value.score(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on a bounded sample of the labelled rows, then scores all ``docs``."""
    return scored(docs, train(*training_rows(docs, labels, sample)))
