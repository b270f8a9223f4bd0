"""Toxicity of whole texts: a recurrent network over word and character inputs scores all overlapping windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks, work
from footfall.llm import recurrent as net

WINDOW, STRIDE = 32, 24  # words
PREFIXES, SUFFIXES = (4, 5, 6), (3, 4, 5)  # bytes at the ends of a word that are inputs
INPUTS = 8
SAMPLE = 1500  # labelled texts of each class that train the model, at most
LEAST_TEXTS = 4  # training texts that an input must occur in
ROUNDS, RESCORE, BATCH, RATE = 12, 4, 128, 0.02  # windows are scored again every RESCORE rounds
TOGETHER = 1024  # windows scored at once
TRAINING_BLOCK = 1 << 20  # characters of training texts that are taken apart at once
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Per word of all texts the hashes of its inputs (word, prefixes, suffixes), its text, and the number of texts."""
    data, offsets = blocks.utf8(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    starts, ends, doc = blocks.spans_of(IN_WORD[data], offsets)
    hasher = blocks.Hasher(data)
    columns = [hasher(starts, ends)]
    for k, size in enumerate((*PREFIXES, *SUFFIXES), 1):
        a, b = (starts, np.minimum(ends, starts + size)) if k <= len(PREFIXES) else (np.maximum(starts, ends - size), ends)
        columns.append(blocks.mix(hasher(a, b) + np.uint64(k)))  # a prefix is not the same input as a suffix
    return np.stack(columns, axis=1) if len(starts) else np.zeros((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.uint64), doc, len(offsets) - 1


def windows_of(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, size and text of each window; they overlap, cover every word, and a text without words has an empty one."""
    size = np.bincount(doc, minlength=n)
    count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(n), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(size) - size)[owner] + nth * STRIDE
    return start, np.clip(size[owner] - nth * STRIDE, 0, WINDOW), owner


def words_in_blocks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of all texts by ascending hash, with their inputs; per word of a text its place there, and its text.

    Texts are taken apart block by block and words repeat, so that the inputs of all words
    are never held at once.
    """
    blocks_of, start, room = [], 0, 0
    for i, text in enumerate(texts):
        room += len(text or "")
        if room >= TRAINING_BLOCK or i + 1 == len(texts):
            blocks_of.append((start, i + 1))
            start, room = i + 1, 0
    inputs, words, doc = [np.zeros((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in blocks_of:
        columns, own, _ = words_of(pa.array(texts[low:high], pa.string()))
        inputs.append(columns[np.unique(columns[:, 0], return_index=True)[1]])
        words.append(columns[:, 0].copy())
        doc.append(own + low)
    inputs = np.concatenate(inputs)
    inputs = inputs[np.unique(inputs[:, 0], return_index=True)[1]]
    return inputs, np.searchsorted(inputs[:, 0], np.concatenate(words)), np.concatenate(doc)


@dataclass
class Model:
    keys: np.ndarray  # known inputs, ascending hashes
    vectors: np.ndarray  # one row each, and a last one of zeros for unknown inputs
    params: net.Params
    scale: tuple[float, float]

    def inputs(self, columns: np.ndarray) -> np.ndarray:
        """The vector of each word: the sum of those of its inputs."""
        x = np.zeros((len(columns), INPUTS), np.float32)
        for column in columns.T:
            x += self.vectors[self.places(column)]
        return x

    def places(self, column: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, column)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == column, at, len(self.keys)) if len(self.keys) else np.zeros(len(column), np.int64)

    def window_logits(self, distinct: np.ndarray, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The logit of each window; ``which`` has the place of each word among the ``distinct`` ones."""
        # words repeat: the input's part of the gates is computed once for each distinct word
        x = self.inputs(distinct)
        x = np.concatenate((x, np.zeros((1, INPUTS), np.float32)))
        which = np.append(which, len(x) - 1)
        gates = {d: x @ self.params[f"W{d}"] + self.params[f"c{d}"] for d in "fb"}
        out = np.empty(len(start), np.float32)
        for low in range(0, len(start), TOGETHER):
            s, k = start[low : low + TOGETHER], size[low : low + TOGETHER]
            step = np.arange(max(1, int(k.max())))[:, None]
            mask = (step < k).astype(np.float32)
            at = which[np.minimum(s + step, len(which) - 1)]
            out[low : low + TOGETHER] = net.forward(gates["f"][at], gates["b"][at], mask, self.params)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        columns, doc, n = words_of(texts)
        start, size, owner = windows_of(doc, n)
        _, first, which = np.unique(columns[:, 0], return_index=True, return_inverse=True)
        logits = self.window_logits(columns[first], which, start, size)
        return self.chance(np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(n))))

    def chance(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * logit.astype(np.float64) + self.scale[1])))


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model | None:
    """The model of labelled texts; None without texts of both classes.

    An input's first number starts as its smoothed log odds over the training texts, the
    others at random; all of them train with the network. Every window of a clean
    text is a clean example; of a toxic text, only the window that scores highest at the time
    is a toxic one.
    """
    goal = np.asarray(toxic, np.float32)
    if not len(goal) or goal.min() == goal.max():
        return None
    rng = np.random.default_rng(seed)
    distinct, which, doc = words_in_blocks(texts)
    n, width = len(texts), distinct.shape[1]
    keys, count, bad = [], [], []
    for column in distinct.T:
        own, number = np.unique(column, return_inverse=True)
        input_, text = np.divmod(np.unique(number[which] * n + doc), n)  # each input once a text
        times = np.bincount(input_, minlength=len(own))
        keep = times >= LEAST_TEXTS
        keys.append(own[keep])
        count.append(times[keep])
        bad.append(np.bincount(input_, goal[text], minlength=len(own))[keep])
    keys, count, bad = np.concatenate(keys), np.concatenate(count), np.concatenate(bad)
    order = np.argsort(keys)
    keys, count, bad = keys[order], count[order], bad[order]
    odds = np.log((bad + 0.5) / (goal.sum() + 1)) - np.log((count - bad + 0.5) / (n - goal.sum() + 1))
    vectors = (rng.standard_normal((len(keys) + 1, INPUTS)) * 0.05).astype(np.float32)
    vectors[:-1, 0] = np.clip(odds * count / (count + LEAST_TEXTS), -4, 4) / 2
    vectors[-1] = 0
    params = net.new_params(INPUTS, rng)
    model = Model(keys, vectors, params, (1.0, 0.0))
    start, size, of = windows_of(doc, n)
    places = np.stack([model.places(c) for c in distinct.T], axis=1)
    places = np.concatenate((places, np.full((1, width), len(keys))))
    which = np.append(which, len(distinct))  # what stands after the last word of a window is no known input
    pull = vectors[places, 0].sum(axis=1).astype(np.float64)[which]
    sums = np.concatenate(([0.0], np.cumsum(np.maximum(pull, 0))))
    value = sums[start + size] - sums[start]
    adam = net.Adam(RATE)
    clean = np.flatnonzero((goal[of] == 0) & (size > 0))
    for round_ in range(ROUNDS):
        best = np.lexsort((value, of))
        best = best[np.append(of[best][1:] != of[best][:-1], True)]  # of each text the window of the highest value
        toxic_rows = best[(goal[of[best]] == 1) & (size[best] > 0)]
        hard = clean[np.argsort(-value[clean])[: len(toxic_rows)]]
        rows = np.concatenate((toxic_rows, hard, rng.choice(clean, min(len(clean), 2 * len(toxic_rows)), replace=False)))
        rng.shuffle(rows)
        for low in range(0, len(rows), BATCH):
            some = rows[low : low + BATCH]
            step = np.arange(WINDOW)[:, None]
            mask = (step < size[some]).astype(np.float32)
            at = places[which[np.where(mask > 0, start[some] + step, len(which) - 1)]]
            x = vectors[at].sum(axis=2)
            grads, dx, _ = net.gradients(x, mask, goal[of[some]], params)
            adam.update(params, grads)
            touched, inverse = np.unique(at, return_inverse=True)
            change = np.zeros((len(touched), INPUTS), np.float32)
            np.add.at(change, inverse.reshape(-1), np.repeat(dx.reshape(-1, INPUTS), width, axis=0))
            vectors[touched] -= RATE * change
            vectors[-1] = 0
        if round_ % RESCORE == RESCORE - 1:
            value = model.window_logits(distinct, which[:-1], start, size)
    highest = np.maximum.reduceat(value, np.searchsorted(of, np.arange(n))).astype(np.float64)
    model.scale = _scaled(highest, goal)
    return model


def _scaled(logit: np.ndarray, goal: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the text's highest logit, both classes weighing the same."""
    a, b = 1.0, 0.0
    weight = np.where(goal == 1, 0.5 / goal.sum(), 0.5 / (len(goal) - goal.sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        g = np.array([(weight * (p - goal) * logit).sum() + 1e-3 * (a - 1), (weight * (p - goal)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * logit * logit).sum() + 1e-3, (s * logit).sum()], [(s * logit).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(float(a), 0.05), float(b)


def held_out(doc_id: str = "doc_id"):
    """Whether the id's CRC-32 as text leaves no remainder by 5: labels of these rows are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """At most ``sample`` labelled texts of each class, those with the least hashes of their ids, none held out."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):
        part = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    chosen = work.written(chosen, "sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    return rows.column("text").to_pylist(), rows.column("toxic").to_numpy()


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, one row per row of ``docs``; no shuffle.

    The score of a text is that of its highest window. NULL and empty texts are scored as one
    empty window; without a model every score is 0; a missing id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.text_blocks(batches):
            own = shared.value
            score = own.score(block.column("text")) if own is not None else np.zeros(block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on a bounded sample of the labelled rows, then scores all ``docs``."""
    return scored(docs, train(*training_texts(docs, labels, sample)))
