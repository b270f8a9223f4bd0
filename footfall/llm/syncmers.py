"""Document fingerprints from closed syncmers, and their positional likeness."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm import blocks, work

K, S = 24, 8  # bytes in a k-mer, and in the substrings that choose it

Prints = list[tuple[np.ndarray, np.ndarray]]


def syncmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and text numbers of the closed syncmers of each text.

    A k-mer is one if the least hash of its substrings of length ``S`` is that of the
    first or of the last: a property of the k-mer alone, whatever stands around it.
    """
    n = len(data)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hasher = blocks.Hasher(data)
    at = np.arange(n - S + 1)
    inner = hasher(at, at + S)
    width, least = K - S + 1, inner
    span = 1
    while span < width:  # least of the last ``span`` values, doubled while it fits
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    starts = np.arange(n - K + 1)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    chosen = (inner[: len(starts)] == least) | (inner[width - 1 :] == least)
    chosen &= starts + K <= offsets[doc + 1]
    starts = starts[chosen]
    return starts, hasher(starts, starts + K), doc[chosen]


def fingerprints(texts: pa.Array) -> Prints:
    """Per text the hashes of all its syncmers in order of their place, and the byte where each stands.

    Equal texts have equal anchors and an edit changes only the anchors inside it. A text without
    a syncmer has one anchor, its own hash at 0; an empty text has none.
    """
    data, offsets = blocks.utf8(texts)
    at, value, doc = syncmers(data, offsets)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    whole = blocks.Hasher(data)(offsets[:-1], offsets[1:])
    prints: Prints = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            prints.append((value[a:b] >> np.uint64(24), at[a:b] - offsets[i]))
        elif offsets[i] < offsets[i + 1]:
            prints.append((whole[i : i + 1] >> np.uint64(24), np.zeros(1, np.int64)))
        else:
            prints.append((value[:0], at[:0]))
    return prints


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of 6 bytes an anchor: 40 bits of its hash, and its distance from the one before, the first from 0.

    A distance above 254 is 255 once for each 255 in it, followed by the rest: five zero bytes stand before each 255.
    """
    value, at = print_
    gap = np.diff(at, prepend=0)
    more = gap // 255
    row = np.arange(len(at)) + np.cumsum(more)
    out = np.zeros((len(at) + int(more.sum()), 6), np.uint8)
    out[:, 5] = 255
    out[row, :5] = value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    out[row, 5] = gap % 255
    return base64.b64encode(out.tobytes()).decode()


def chain(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences.

    What agrees at either end is counted at once; the rest, less what only one side has, goes row by row
    through the bits of a whole number.
    """
    found, n = 0, min(len(a), len(b))
    for _ in range(2):
        differ = np.flatnonzero(a[:n] != b[:n])
        same = int(differ[0]) if len(differ) else n
        found, n = found + same, n - same
        a, b = a[same:][::-1], b[same:][::-1]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    if not len(a):
        return found
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for x in b.tolist():
        hit = row & where[x]
        row = (row + hit | row - hit) & every
    return found + len(a) - row.bit_count()


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of anchors, repeats included, that two texts have in common in the same order, 0 to 1.

    Those on the longest chain that rises in both texts count, of all that either text has; two
    empty texts are alike.
    """
    a, b = one[0], other[0]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    values, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    times = [np.bincount(x, minlength=len(values)) for x in (number[: len(a)], number[len(a) :])]
    return chain(a, b) / int(np.maximum(*times).sum())


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


COLUMNS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part in ascending order, closed by a borrowed copy of the row that follows the part."""
    held: tuple | None = None  # part, doc_id, text, fingerprint of the row that still lacks its successor
    for block in blocks.text_blocks(batches):
        texts = block.column("text").to_pylist()
        prints = fingerprints(block.column("text"))
        borrowed = block.column("borrowed").to_pylist()
        rows = list(zip(block.column("part").to_pylist(), block.column("doc_id").to_pylist(), texts, prints, strict=True))
        pairs = []
        for row, is_borrowed in zip(rows, borrowed, strict=True):
            if held is not None and held[0] == row[0]:
                pairs.append((held, row))
            held = None if is_borrowed else row
        if pairs:
            edits = [edited_text(a[2], b[2]) for a, b in pairs]
            edited = fingerprints(pa.array(edits, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits]),
                    pa.array([as_text(a[3]) for a, _ in pairs]),
                    pa.array([as_text(x) for x in edited]),
                    pa.array([likeness(a[3], x) for (a, _), x in zip(pairs, edited, strict=True)]),
                    pa.array([likeness(a[3], b[3]) for a, b in pairs]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _parts(texts: DataFrame) -> DataFrame:
    """The texts with the number of their range of ids: four ranges for each shuffle partition of the session."""
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = texts.withColumn("number", F.col("doc_id").cast("double"))
    cuts = numbers.approxQuantile("number", [i / parts for i in range(1, parts)], 0.25 / parts)
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="number", outputCol="part").transform(numbers)
    return dealt.select(F.col("part").cast("int").alias("part"), "doc_id", "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document, the first after the last.

    Rows are dealt once, by ranges of ids; each range also gets a copy of the first row
    of the next one, so a document meets its successor without a global sort in one
    task. Ties of an id are ordered by text and equal rows follow one another; a missing
    id comes first; NULL text is empty. A single row is its own successor; an empty
    table gives an empty result; other columns are ignored.
    """
    dealt = _parts(work.keyed_texts(docs))
    heads = work.written(dealt.groupBy("part").agg(F.min("doc_id").alias("doc_id")), "heads")
    first = dealt.join(heads, ["part", "doc_id"]).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    first = work.written(first, "first")  # one row a range
    order = Window.orderBy("part")
    last = F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = first.select("part", F.coalesce(F.lag("part").over(order), last).alias("before"))
    lent = first.join(before, "part").select(F.col("before").alias("part"), "doc_id", "text", F.lit(True).alias("borrowed"))
    rows = dealt.withColumn("borrowed", F.lit(False)).unionByName(lent)
    ordered = rows.repartition("part").sortWithinPartitions("part", "borrowed", "doc_id", "text")
    return ordered.mapInArrow(_compare, COLUMNS).withColumn("doc_id", work.id_or_none())
