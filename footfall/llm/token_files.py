"""Token ids in ORC files: run-length coded integers, row indexes and Bloom filters on the document id."""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm import blocks, work

END_ID = 2
CACHE_ENTRIES = 500_000
MARKS = ".,!?;:"
TOGETHER = 1000  # words that go through the merges in one call
FILES = "doc_id bigint, row bigint, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


class Encoder:
    """The ids of texts from a tokenizer file, chunk by chunk.

    The tokenizer drops white space and joins nothing across it, so the ids of a text
    are those of its chunks between spaces and line ends, one after another; a chunk is
    encoded once while it is kept. Chunks of letters alone are one word each to
    the tokenizer: they go through its merges together, split again at the pieces
    that end a word. All others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        ids = self.whole.encode_batch(list(MARKS), add_special_tokens=False)
        self.marks = {mark: np.array(own.ids, "<u4").tobytes() for mark, own in zip(MARKS, ids, strict=True)}
        self.mark_of = np.zeros(256, np.int64)
        self.mark_of[[ord(mark) for mark in MARKS]] = np.arange(1, len(MARKS) + 1)

    @staticmethod
    def plain(chunk: str) -> str | None:
        """The chunk as the tokenizer normalises it, if it is letters before and after; else None."""
        if chunk.isalpha() and "Σ" not in chunk:  # its lower case depends on what follows in Python alone
            low = unicodedata.normalize("NFC", chunk).lower()
            if low.isalpha() and unicodedata.is_normalized("NFC", low):
                return low
        return None

    def _words(self, words: list[str]) -> None:
        """Adds words of letters in lower case, many in one call; a piece that ends a word ends its ids."""
        joined = [" ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        for at, found in enumerate(self.words.encode_batch_fast(joined)):
            ids = np.array(found.ids, np.int64)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            coded = ids.astype("<u4").tobytes()
            some = words[at * TOGETHER : (at + 1) * TOGETHER]
            self.known.update((word, coded[a:b]) for word, a, b in zip(some, [0, *ends], ends, strict=False))

    def _others(self, chunks: list[str]) -> None:
        """Adds any chunks; a word with a mark after it is that word and the mark, which the tokenizer parts."""
        rest, plain, words = [], [], {}
        for chunk in chunks:
            mark = chunk[-1:] if chunk[-1:] in self.marks else ""
            low = self.plain(chunk[:-1] if mark else chunk)
            if low is None:
                rest.append(chunk)
            else:
                plain.append((chunk, low, mark))
                if low not in self.known:
                    words[low] = None
        for chunk, coded in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[chunk] = np.array(coded.ids, "<u4").tobytes()
        self._words(list(words))
        for chunk, low, mark in plain:
            self.known[chunk] = self.known[low] + self.marks.get(mark, b"")

    def _coded(self, words: list[str], others: list[str]) -> list[bytes]:
        """The ids of words and of other chunks, learnt where they are new."""
        known = self.known
        new, rest = [w for w in words if w not in known], [c for c in others if c not in known]
        if len(known) + len(new) + len(rest) > CACHE_ENTRIES:
            known.clear()
            new, rest = words, others
        self._words(new)
        self._others(rest)
        return [known[c] for c in words] + [known[c] for c in others]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after another, and their number for each text.

        The different chunks of a block are found once. Those of ASCII letters, with or
        without a mark after them, are split and put in lower case as bytes; ids are then
        gathered for all places together.
        """
        spaced = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
        chunked = pc.split_pattern(spaced, " ")
        ends = chunked.offsets.to_numpy() - chunked.offsets[0].as_py()
        places = chunked.flatten().dictionary_encode()
        data, offsets = blocks.utf8(places.dictionary)
        size = np.diff(offsets)
        low = data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        mark = np.zeros(len(size), np.int64)
        some = np.flatnonzero(size)
        mark[some] = self.mark_of[data[offsets[1:][some] - 1]]
        letters = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
        stem = size - (mark > 0)
        plain = (stem > 0) & (letters[offsets[1:]] - letters[offsets[:-1]] == stem)
        inside = np.repeat(plain, size)
        inside[offsets[1:][plain & (mark > 0)] - 1] = False
        begins = np.concatenate(([0], np.cumsum(stem[plain])))
        words = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(low[inside].tobytes()))
        words = words.dictionary_encode()
        names = words.dictionary.to_pylist()
        others = places.dictionary.filter(pa.array(~plain)).to_pylist()
        coded = [b"", *self.marks.values(), np.array([END_ID], "<u4").tobytes(), *self._coded(names, others)]
        last, first = len(self.marks) + 1, len(self.marks) + 2
        entry = np.empty(len(size), np.int64)
        entry[plain] = first + words.indices.to_numpy()
        entry[~plain] = first + len(names) + np.arange(len(others))
        mark[~plain] = 0
        chosen = places.indices.to_numpy()
        items = np.insert(np.stack((entry[chosen], mark[chosen]), axis=1).reshape(-1), 2 * ends[1:], last)
        length = np.array([len(c) // 4 for c in coded])
        begin = np.cumsum(length) - length
        values = blocks.gathered(np.frombuffer(b"".join(coded), "<u4").astype(np.int32), begin[items], length[items])
        until = np.concatenate(([0], np.cumsum(length[items])))[2 * ends[1:] + np.arange(1, len(ends))]
        return values, np.diff(until, prepend=0)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that the next task finds its chunks; a task has one core, so it starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _encoder(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for block in blocks.text_blocks(batches):
            values, counts = encoder(path).encode(block.column("text"))
            ids = blocks.lists(values, counts, pa.int32())
            rows = pa.array(np.arange(row, row + block.num_rows))
            row += block.num_rows
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), rows, ids], ["doc_id", "row", "ids"])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes every whole text and writes ORC files in ascending (doc_id, text) order.

    One shuffle, by ranges of the id: the ids of a file, a stripe and a row group are
    a range of their own, so footers and row indexes prune a lookup before its Bloom
    filter is asked. ``part`` numbers the files, ``row`` the rows of a file. A missing
    text is empty (the end id alone); a missing id comes first; repeated rows stay.
    """
    ordered = work.keyed_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(_encoder(tokenizer), FILES)
    # the end id of each text is part of its list, so no text has an empty one
    coded.withColumn("part", F.spark_partition_id()).write.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, row, ids, part); with ``doc_ids``, only files, stripes and row groups that may hold them are read."""
    rows = spark.read.schema(f"{FILES}, part int").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _digester(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        data = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kept = [batch.column(c) for c in ("doc_id", "row", "part")]
        counts = pa.array(np.diff(ends).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*kept, counts, pa.array(sums, pa.int64())], ["doc_id", "row", "part", "n_tokens", "ids_crc32"])


def digests(files: DataFrame) -> DataFrame:
    """Per document of :func:`read_ids`: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the ids before it in its file to those of the files before; only
    one row per file meets in one task, and rows without their ids are shuffled.
    """
    counted = work.written(
        files.mapInArrow(_digester, "doc_id bigint, row bigint, part int, n_tokens bigint, ids_crc32 bigint"), "digests"
    )
    totals = counted.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return (
        counted.withColumn("before", before)
        .join(offsets, "part")
        .select(work.id_or_none().alias("doc_id"), (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
