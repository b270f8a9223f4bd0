"""Importance resampling towards a target: hashed word features, array-scored weights, exact ranks by a parallel sort."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import blocks, checksums, work

BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
OVERSAMPLE = 32  # regular samples for each segment of the sort
ROW_BITS = 33  # of ``monotonically_increasing_id``: the rest is the partition
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

FEATURES = "doc_id bigint, n_features bigint, buckets array<smallint>"
SCORED = "doc_id bigint, n_features bigint, weight bigint, score bigint"
Blocks = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def word_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of all texts, and the number of words of each text."""
    data, offsets = blocks.utf8(texts)
    data = LOWER[data]
    starts, ends, doc = blocks.spans_of(IN_WORD[data], offsets)
    hashed = checksums.crc32(data, starts, ends) % np.uint32(buckets)
    return hashed.astype(np.int16), np.bincount(doc, minlength=len(offsets) - 1)


def _featurizer(buckets: int) -> Blocks:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.text_blocks(batches):
            hashed, counts = word_buckets(block.column("text"), buckets)
            columns = [block.column("doc_id"), pa.array(counts, pa.int64()), blocks.lists(hashed, counts, pa.int16())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "buckets"])

    return run


def features(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, buckets) of every whole text: one bucket for each word, repeats counted."""
    if buckets > 2**15:
        raise ValueError("bucket numbers are kept as 16-bit integers")
    return texts.mapInArrow(_featurizer(buckets), FEATURES)


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. Tasks add up their own rows; one number a bucket and task is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = featured.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log odds of each bucket in the target against the source, smoothed by one, rounded down."""
    buckets, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def gumbel(doc_id: int | None, seed: str = SEED) -> int:
    """Thousandths of the document's own draw from a Gumbel distribution, rounded down."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, seed: str) -> Blocks:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("n_features").to_numpy()
            hashed = batch.column("buckets").flatten().to_numpy(zero_copy_only=False)
            sums = np.concatenate(([0], np.cumsum(gain[hashed])))
            ends = np.cumsum(count)
            weight = (sums[ends] - sums[ends - count]) // np.maximum(count, 1)
            own = np.array([gumbel(None if i == work.NO_ID else i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), batch.column("n_features"), pa.array(weight), pa.array(weight + own)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "score"])

    return run


def scored(featured: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score): the floored mean gain of a document's features, and that plus its draw."""
    return featured.mapInArrow(_scorer(gain, seed), SCORED)  # the gains have one number a bucket


def _place(name: str) -> tuple:
    return F.shiftright(name, ROW_BITS), F.col(name).bitwiseAND(F.lit(2**ROW_BITS - 1))


def _divider(keys: Sequence[str], splitters: list[tuple]) -> Blocks:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            # a batch is part of a sorted run, so each splitter is looked up in it, not each row among the splitters
            cuts = [bisect_left(rows, s) for s in splitters]
            segment = np.searchsorted(cuts, np.arange(batch.num_rows), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    return run


def with_ranks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (1, 2, 3, ...) in ascending order of integer columns without NULL, and ``n_rows``, the number of all rows.

    Parallel sorting by regular sampling. Tasks write sorted runs; every run gives each
    so-many-th of its rows as a sample, at most 32 for each shuffle partition and one for each run in all;
    every 32nd sample is a splitter; segments between splitters are exchanged and merged where
    they arrive, and counts of the segments before turn places into ranks. A row's place in its run
    is the last key, so equal rows are split between segments as well. Columns named place, seat, segment
    or part must not be among those of ``rows``.
    """
    spark = rows.sparkSession
    n_segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = work.written(rows.sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "runs")
    order = [*keys, "place"]
    stride = max(1, runs.count() // (n_segments * OVERSAMPLE))
    regular = runs.where(_place("place")[1] % stride == 0).select(order).toArrow()
    samples = sorted(zip(*(regular.column(k).to_pylist() for k in order), strict=True))
    splitters = samples[OVERSAMPLE::OVERSAMPLE]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", segment int"
    divided = runs.mapInArrow(_divider(order, splitters), schema)
    merged = divided.repartitionById(len(splitters) + 1, F.col("segment")).sortWithinPartitions("segment", *order)
    segments = work.written(merged.withColumn("seat", F.monotonically_increasing_id()), "segments")
    part, nth = _place("seat")
    counts = segments.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a segment
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("n_rows"))
    return (
        segments.withColumn("part", part)
        .join(F.broadcast(offsets), "part")  # bounded by the number of segments
        .withColumn("rank", F.col("before") + nth + 1)
        .drop("place", "segment", "seat", "part", "before")
    )


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (NULL where it is not drawn).

    ``target`` is any table with ``text``. A missing text has no words and weight 0; of a missing id the draw
    hashes the empty text, and it comes before all ids; repeated rows are drawn each on its own, equal
    scores and ids by fewer features first. Texts are read once and whole, a very long one in a block of its
    own; after that only bucket numbers (2 bytes a word) and short rows are written and shuffled.
    Without any text in ``target`` all gains favour rare buckets alike; without documents there is no row.
    """
    featured = work.written(features(work.keyed_texts(docs), buckets), "features")
    wanted = features(target.select(F.lit(0).cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), buckets)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))
    rows = work.written(scored(featured, gain, seed), "scored")
    able = F.col("n_features") >= least_words
    ranks = with_ranks(rows.where(able).withColumn("falling", -F.col("score")), ["falling", "doc_id", "n_features"])
    drawn = F.col("rank") <= F.expr(f"n_rows * {int(percent)} div 100")
    shown = [work.id_or_none().alias("doc_id"), "n_features", "weight", "score"]
    rest = rows.where(~able).select(*shown, F.lit(None).cast("bigint").alias("rank"))
    return ranks.select(*shown, F.when(drawn, F.col("rank")).alias("rank")).unionByName(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with their own columns."""
    chosen = resampled(docs, target, **options).where("rank IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi")
