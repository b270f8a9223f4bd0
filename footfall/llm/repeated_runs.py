"""Removal of runs of lines that repeat an earlier passage, by winnowing over line hashes.

Texts are cut into short lines by their content. Every window of consecutive grams of lines gives its
least hash as a fingerprint; fingerprints that two texts share lead to the passages, which are extended both
ways as far as any earlier text goes on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks, work

GRAM_WORDS = 8  # words that a hashed gram of lines holds at least
WINDOW = 4  # consecutive grams of which one is a fingerprint
BREAK_WINDOW = 4  # any so many consecutive words of a line break or sentence have a break after one of them
MIN_WORDS = 30  # shorter repeats stay
TEXT_BYTES = 1 << 19  # of texts that are cut into lines at once, for the same reason as the next
STORED_LINES = 1 << 16  # of stored texts that are held at once; their arrays fit into a core's cache
FILTER_BITS = 26  # of a broadcast filter of hashes at most: 8 MB, whatever their number
SENTENCE_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])
TABLE = "doc_id bigint, version bigint, hashes binary, sizes binary, prints array<bigint>, own array<int>"
END = pa.struct([("line", pa.int32()), ("edge", pa.int64()), ("pair", pa.int64())])
ENDS = "array<struct<line: int, edge: bigint, pair: bigint>>"
FOUND = f"doc_id bigint, version bigint, sizes binary, lines array<int>, ends {ENDS}"


def gram_spans(sizes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First line and end of the grams, and how many of them run forward.

    Forward from each line, and then backward from each line, a gram is the shortest run
    of lines of one text with ``GRAM_WORDS`` words or more.
    """
    ends = np.cumsum(sizes)
    begins, line = ends - sizes, np.arange(len(sizes))
    of_word = np.append(np.repeat(line, sizes), len(sizes))  # the line of each word, and one past the last
    until = of_word[np.minimum(begins + (GRAM_WORDS - 1), len(of_word) - 1)]
    ok = until < len(sizes)
    ok[ok] = doc[until[ok]] == doc[ok]
    since = of_word[np.maximum(ends - GRAM_WORDS, 0)]
    back = ends >= GRAM_WORDS
    back[back] = doc[since[back]] == doc[back]
    return np.concatenate((line[ok], since[back])), np.concatenate((until[ok], line[back])) + 1, int(ok.sum())


Grams = tuple[np.ndarray, np.ndarray, np.ndarray, int]


class Lines:
    """The lines of the texts of a block: short runs of words that the content alone cuts off.

    A line ends at a line break, at the end of a sentence, and after the word of the least hash, the first of equals,
    of any ``BREAK_WINDOW`` consecutive words between those. So a passage in two texts is cut
    alike in both, but for up to a window at either end where it is part of a longer sentence, and a
    line has at most 2 * ``BREAK_WINDOW`` - 1 words.

    ``first`` and ``last`` are the word numbers that bound each line, ``doc`` its text, ``sizes`` its
    words, ``hashes`` a 32-bit hash of them; a gram has two lines or more, so its hash rests on 64 bits.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = blocks.utf8(texts)
        data, self.n = self.data, len(self.offsets) - 1
        self.starts, self.ends, word_doc = blocks.words(data, self.offsets)
        words = len(self.starts)
        breaks = np.concatenate(([0], np.cumsum(data == blocks.NEWLINE)))
        new = np.ones(words, bool)
        new[1:] = (
            (word_doc[1:] != word_doc[:-1])
            | (breaks[self.starts[1:]] > breaks[self.ends[:-1]])
            | SENTENCE_END[data[self.ends[:-1] - 1]]
        )
        hashes = blocks.Hasher(data)(self.starts, self.ends)
        new[1:] |= self._breaks(new, hashes)[:-1]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], words)[: len(self.first)]
        self.doc = word_doc[self.first]
        self.sizes = self.last - self.first
        self.counts = np.bincount(self.doc, minlength=self.n)
        self.hashes = blocks.Hasher(hashes)(self.first, self.last) >> np.uint64(32)

    @staticmethod
    def _breaks(new: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """After which words a sentence is broken; ``new`` marks the first word of each sentence."""
        sentence = np.cumsum(new) - 1
        at = np.arange(max(0, len(new) - BREAK_WINDOW + 1))
        at = at[sentence[at + BREAK_WINDOW - 1] == sentence[at]]  # windows that stay inside a sentence
        after = np.zeros(len(new), bool)
        after[least_of(hashes, at, BREAK_WINDOW)] = True
        return after

    def grams(self) -> Grams:
        """:func:`gram_spans` and, in third place, the hash of each gram."""
        start, end, forward = gram_spans(self.sizes, self.doc)
        return start, end, blocks.Hasher(self.hashes)(start, end), forward

    def fingerprints(self, grams: Grams | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints of each text, and its number: the least forward gram of each window.

        The last windows of a text are shorter, so a text with any gram has a fingerprint. ``grams`` are those of
        :meth:`grams`, if they are there already.
        """
        start, _, value, forward = grams or self.grams()
        value, owner = value[:forward], self.doc[start[:forward]]
        least = np.arange(forward)
        for step in range(1, WINDOW):
            other = np.minimum(np.arange(forward) + step, forward - 1)
            better = (owner[other] == owner) & (value[other] < value[least])
            least = np.where(better, other, least)
        chosen = np.zeros(forward, bool)
        chosen[least] = True
        least = np.flatnonzero(chosen)
        value, owner = value[least], owner[least]
        new = ~_later(value, owner)
        return value[new], owner[new]


def least_of(values: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Where the least of ``width`` values from each place stands, the first of equals."""
    least = at.copy()
    for step in range(1, width):
        least = np.where(values[at + step] < values[least], at + step, least)
    return least


def covered(lines: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines lie in some of the spans."""
    change = np.bincount(start, minlength=lines + 1) - np.bincount(end, minlength=lines + 1)
    return np.cumsum(change[:-1]) > 0


def _later(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which grams, given in order of their place, repeat an earlier one of the same text."""
    key = value + blocks.mix(doc.astype(np.uint64))  # equal for equal grams of a text, and hardly ever else
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    some = np.flatnonzero(pc.is_in(pa.array(key), pa.array(twice)).to_numpy(zero_copy_only=False))
    order = some[np.lexsort((some, value[some], doc[some]))]
    later = np.zeros(len(value), bool)
    v, d = value[order], doc[order]
    later[order[1:]] = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    return later


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values of each text as bytes, which pass between tasks and files as they are."""
    cuts = np.concatenate(([0], np.cumsum(counts * values.itemsize))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(packed: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many each text has."""
    _, cuts, data = packed.buffers()
    cuts = np.frombuffer(cuts, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, np.diff(cuts) // size


def _surveyed(block: pa.RecordBatch) -> pa.RecordBatch:
    lines = Lines(block.column("text"))
    start, end, value, forward = grams = lines.grams()
    prints, print_doc = lines.fingerprints(grams)
    again = np.concatenate([_later(value[part], lines.doc[start[part]]) for part in (slice(0, forward), slice(forward, None))])
    own = np.flatnonzero(covered(len(lines.sizes), start[again], end[again]))
    first = np.cumsum(lines.counts) - lines.counts
    count = lambda doc: np.bincount(doc, minlength=lines.n)
    return pa.RecordBatch.from_arrays(
        [
            block.column("doc_id"),
            block.column("version"),
            _packed(lines.hashes.astype(np.uint32), lines.counts),
            _packed(lines.sizes.astype(np.uint8), lines.counts),
            blocks.lists(blocks.signed(prints), count(print_doc), pa.int64()),
            blocks.lists((own - first[lines.doc[own]]).astype(np.int32), count(lines.doc[own]), pa.int32()),
        ],
        ["doc_id", "version", "hashes", "sizes", "prints", "own"],
    )


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks.text_blocks(batches, TEXT_BYTES):
        yield _surveyed(block)  # its arrays are gone before the next block


class Stored:
    """The lines of many stored texts, one after another, and their grams."""

    def __init__(self, hashes: pa.BinaryArray, sizes: pa.BinaryArray):
        flat, self.counts = _unpacked(hashes, np.uint32)
        self.flat, words = flat.astype(np.uint64), _unpacked(sizes, np.uint8)[0].astype(np.int64)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.start, self.end, self.forward = gram_spans(words, self.row)
        self.value = blocks.Hasher(self.flat)(self.start, self.end)
        self.owner = self.row[self.start]


def line_pairs(hashes: np.ndarray) -> np.ndarray:
    """A value of each two consecutive lines, whose lower bits serve a filter."""
    return hashes[:-1] * np.uint64(blocks.BASE) + hashes[1:]


def _of_rows(values: pa.Array, row: np.ndarray, rows: int) -> pa.ListArray:
    """The values as a list for each row; they stand in order of their rows."""
    counts = np.bincount(row, minlength=rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _found(batch: pa.RecordBatch, line: np.ndarray, row: np.ndarray, ends: list[np.ndarray], end_row: np.ndarray) -> pa.RecordBatch:
    """A row of ``FOUND`` for each row of a batch: its lines, and its ends by line, gram and pair."""
    ends = pa.StructArray.from_arrays([pa.array(x, kind.type) for x, kind in zip(ends, END, strict=True)], fields=list(END))
    lists = [_of_rows(pa.array(line, pa.int32()), row, batch.num_rows), _of_rows(ends, end_row, batch.num_rows)]
    keys = ["doc_id", "version", "sizes"]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *lists], [*keys, "lines", "ends"])


def _slices(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``STORED_LINES`` lines, so that memory stays bounded."""
    for batch in batches:
        lines = sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in names) // 4
        block = np.cumsum(lines) // STORED_LINES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                yield batch.slice(low, high - low)


def _extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of a text and an earlier one: the lines of the text in grams that the earlier one has too,
    and the grams that go one line on from those lines, at either end, with that line
    and the pair of lines that such a gram has at its own outer end."""
    for batch in _slices(batches, "hashes", "source_hashes"):
        own = Stored(batch.column("hashes"), batch.column("sizes"))
        source = Stored(batch.column("source_hashes"), batch.column("source_sizes"))
        of_pair = lambda text: text.value + blocks.mix(text.owner.astype(np.uint64))
        shared = pc.is_in(pa.array(of_pair(own)), pa.array(of_pair(source))).to_numpy(zero_copy_only=False)
        inside = covered(len(own.row), own.start[shared], own.end[shared])
        start, end, n = own.start, own.end, own.forward
        before = np.flatnonzero(~inside[start[:n]] & inside[start[:n] + 1])  # a gram has two lines at least
        after = np.flatnonzero(~inside[end[n:] - 1] & inside[end[n:] - 2]) + n
        gram = np.concatenate((before, after))
        line = np.concatenate((start[before], end[after] - 1))
        first = np.cumsum(own.counts) - own.counts
        pair = line_pairs(own.flat)[np.concatenate((start[before], end[after] - 2))]
        order = np.argsort(own.owner[gram], kind="stable")
        gram, line, pair = gram[order], line[order], pair[order]
        hit = np.flatnonzero(inside)
        ends = [line - first[own.row[line]], blocks.signed(own.value[gram]), blocks.signed(pair)]
        yield _found(batch, hit - first[own.row[hit]], own.row[hit], ends, own.owner[gram])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text each of its lines once, and the ends, each once, whose line is not one of them."""
    for batch in batches:
        counts = pc.binary_length(batch.column("sizes")).to_numpy().astype(np.int64)
        first, rows = np.cumsum(counts) - counts, np.arange(batch.num_rows)
        row_of = lambda name: np.repeat(rows, pc.list_value_length(batch.column(name)).to_numpy())
        inside = np.zeros(counts.sum(), bool)
        inside[batch.column("lines").flatten().to_numpy() + first[row_of("lines")]] = True
        ends, row = batch.column("ends").flatten(), row_of("ends")
        line, edge, pair = (ends.field(k).to_numpy() for k in range(len(END)))
        order = np.flatnonzero(~inside[line + first[row]])
        order = order[np.lexsort((pair[order], edge[order], line[order], row[order]))]
        keys = np.stack([x[order] for x in (row, line, edge, pair)])
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        order = order[new]
        hit = np.flatnonzero(inside)
        hit_row = np.repeat(rows, counts)[hit]
        yield _found(batch, hit - first[hit_row], hit_row, [line[order], edge[order], pair[order]], row[order])


def _merged(rows: DataFrame) -> DataFrame:
    """One row of ``FOUND`` for each text, stored."""
    texts = rows.groupBy("doc_id", "version").agg(
        F.any_value("sizes").alias("sizes"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("lines", "ends"))
    )
    return work.written(texts.mapInArrow(_merge, FOUND), "found")


class Some:
    """A filter of 64-bit values of bounded size: lets all of them through, and few others.

    Its bits are made by an aggregate and are 8 MB at most for any number of values; with more values it
    only lets more rows through, which the joins behind it drop. For few values it is folded, to 256 bits or more
    for each, as every executor keeps a copy on its disk.
    """

    def __init__(self, values: DataFrame, column: str):
        bit = F.col(column).bitwiseAND(F.lit(2**FILTER_BITS - 1))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
        words = values.select(F.shiftright(bit, 6).alias("word"), one.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        rows = words.toArrow()
        size = 1 << min(FILTER_BITS - 6, (4 * rows.num_rows).bit_length())
        bits = np.zeros(size, np.uint64)
        np.bitwise_or.at(bits, rows.column("word").to_numpy() % size, rows.column("mask").to_numpy().view(np.uint64))
        self.any = rows.num_rows > 0
        self.bits = values.sparkSession.sparkContext.broadcast(bits)


def passed(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = values.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1


def _prints_in(table: DataFrame, some: Some) -> DataFrame:
    """(doc_id, print) of the fingerprints that the filter lets through."""
    shared = some.bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, ids = batch.column("prints"), batch.column("doc_id").to_numpy()
            values = prints.flatten().to_numpy(zero_copy_only=False)
            hit = passed(shared.value, values)
            owner = np.repeat(ids, np.diff(prints.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(values[hit])], ["doc_id", "print"])

    return table.select("doc_id", "prints").mapInArrow(run, "doc_id bigint, print bigint")


def _grams_in(table: DataFrame, edges: Some, pairs: Some) -> DataFrame:
    """(doc_id, edge) of the grams of all texts that the filters let through.

    Grams are made only at pairs of lines that begin or end a sought one. A sought gram that runs forward in its text
    runs forward in every text that has its lines, and so does one that runs backward, so the pair at its own end is enough.
    """
    shared_edges, shared_pairs = edges.bits, pairs.bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "hashes"):
            value, row = grams_at(batch.column("hashes"), batch.column("sizes"), shared_pairs.value)
            hit = passed(shared_edges.value, value)
            ids = batch.column("doc_id").to_numpy()[row[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(value[hit])], ["doc_id", "edge"])

    return table.select("doc_id", "hashes", "sizes").mapInArrow(run, "doc_id bigint, edge bigint")


def grams_at(hashes: pa.BinaryArray, sizes: pa.BinaryArray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of the grams of stored texts whose outer two lines a filter of pairs lets through.

    They are those of :func:`gram_spans`, forward from the first line of such a pair and backward from the second one.
    """
    flat, counts = _unpacked(hashes, np.uint32)
    flat = flat.astype(np.uint64)
    at = np.flatnonzero(passed(pairs, line_pairs(flat)))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, texts = np.cumsum(_unpacked(sizes, np.uint8)[0], dtype=np.int64), np.cumsum(counts)
    line_of = lambda word: np.searchsorted(ends, word, side="right")
    row_of = lambda line: np.searchsorted(texts, line, side="right")
    until = line_of(np.append(0, ends)[at] + (GRAM_WORDS - 1))
    row, ok = row_of(at), until < len(flat)
    ok &= row_of(until) == row
    last = at + 1
    since = line_of(np.maximum(ends[last] - GRAM_WORDS, 0))
    last_row = row_of(last)
    back = (ends[last] >= GRAM_WORDS) & (row_of(since) == last_row)
    value = blocks.Hasher(flat)(np.concatenate((at[ok], since[back])), np.concatenate((until[ok], last[back])) + 1)
    return blocks.signed(value), np.concatenate((row[ok], last_row[back]))


def _parted(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ids a filter of those in ``found`` lets through, and the others, none of which is there."""
    shared = Some(found, "doc_id").bits

    @F.arrow_udf("boolean")
    def held(ids):
        return pa.array(passed(shared.value, ids.to_numpy()))

    some = held(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(work.NO_ID)))
    return docs.where(some), docs.where(~some)


def _extended(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row of ``FOUND`` per pair; only texts that are part of a pair are shuffled, once for both sides."""
    wanted = pairs.select("doc_id").union(pairs.select("source"))
    columns = ["doc_id", "version", "hashes", "sizes"]
    texts, _ = _parted(table.select(columns), wanted)
    both = pairs.select(F.col("doc_id").alias("later"), "source").hint("merge")  # few pairs would else go to all texts, unshuffled
    both = both.join(texts.alias("a"), F.col("source") == F.col("a.doc_id")).join(texts.alias("b"), F.col("later") == F.col("b.doc_id"))
    # all columns of both, so that Spark finds their shuffles equal
    both = both.select(*(F.col(f"b.{c}") for c in columns), *(F.col(f"a.{c}").alias(f"source_{c}") for c in columns))
    return work.written(both.mapInArrow(_extend, FOUND), "extended")


def _first_pairs(table: DataFrame) -> DataFrame:
    """(doc_id, source): texts with a fingerprint that an earlier text has, and the least id that has it.

    Fingerprints are counted first; only those of two texts or more are shuffled with their texts.
    """
    counted = table.select("doc_id", F.explode("prints").alias("print")).groupBy("print")
    first = counted.agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last")
    first = work.written(first.select("print", "source"), "prints")
    met = _prints_in(table, Some(first, "print")).join(first, "print").where("doc_id > source")
    return work.written(met.select("doc_id", "source").distinct(), "pairs")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines, sizes): per text the numbers of its lines in repeated grams; texts without any are absent.

    ``version`` is a hash of the text, ``sizes`` has the words of each of its lines. A fingerprint counts against the least document
    id that has it, so a passage of any number of documents costs one comparison each; the
    comparison extends the match over every gram that the two texts share. Where it ends, another
    earlier text may go on: the grams that reach one line further, to a line that no text compared so far covers, are looked up among
    all grams, and their least texts are compared in turn, until no earlier text goes on anywhere. So a run of ``MIN_WORDS`` words of
    lines in some earlier text, which holds a whole window of grams, is found as far as it goes,
    whatever texts its fingerprints led to.
    """
    texts = work.keyed_texts(docs).withColumn("version", F.xxhash64("text"))
    table = work.written(texts.mapInArrow(_survey, TABLE), "lines")
    no_ends = F.array().cast(ENDS).alias("ends")
    own = table.where(F.size("own") > 0).select("doc_id", "version", "sizes", F.col("own").alias("lines"), no_ends)
    pairs = compared = _first_pairs(table)
    early = late = _merged(own if pairs.isEmpty() else own.unionByName(_extended(table, pairs)))
    keys = ["doc_id", "version"]
    while not (pairs := _further_pairs(table, late, compared)).isEmpty():
        compared = compared.unionByName(pairs)
        across = _extended(table, pairs)
        before, _ = _parted(early, across)  # few texts go on: only they are merged again
        before = before if late is early else before.unionByName(late)
        late = _merged(across.unionByName(before.withColumn("ends", no_ends)))
    if late is not early:
        some, rest = _parted(early, late)
        early = rest.unionByName(some.join(late.select(keys), keys, "left_anti")).unionByName(late)
    return early.select("doc_id", "version", "lines", "sizes")


def _further_pairs(table: DataFrame, found: DataFrame, compared: DataFrame) -> DataFrame:
    """(doc_id, source): texts with an end that an earlier text has, and the least id that has it, if not compared yet."""
    ends = found.select("doc_id", F.inline("ends"))
    first = _grams_in(table, Some(ends, "edge"), Some(ends, "pair")).groupBy("edge").agg(F.min("doc_id").alias("source"))
    more = ends.select("doc_id", "edge").join(first, "edge").where("doc_id > source").select("doc_id", "source").distinct()
    return work.written(more.join(compared, ["doc_id", "source"], "left_anti"), "pairs")


def _cut(block: pa.RecordBatch, min_words: int) -> pa.RecordBatch:
    marks = block.column("__lines")
    hit = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
    texts, removed = block.column("text").to_pylist(), np.zeros(block.num_rows, np.int64)
    if len(hit):
        data, offsets = blocks.utf8(block.column("text").take(pa.array(hit)))
        starts, _, _ = blocks.words(data, offsets)
        sizes, counts = _unpacked(block.column("__sizes").take(pa.array(hit)), np.uint8)
        last = np.cumsum(sizes, dtype=np.int64)  # the first word after each line
        first = last - sizes
        bounds = np.concatenate(([0], np.cumsum(counts)))
        own = marks.take(pa.array(hit))
        marked = np.zeros(len(sizes), bool)
        marked[own.flatten().to_numpy() + np.repeat(bounds[:-1], pc.list_value_length(own).to_numpy())] = True
        cut = np.zeros(len(data), bool)
        for low, high, doc in zip(*blocks.spans_of(marked, bounds), strict=True):
            words = last[high - 1] - first[low]
            if words < min_words:
                continue
            word = last[high - 1]  # the first word after the run
            same = word < len(starts) and starts[word] < offsets[doc + 1]
            cut[starts[first[low]] : starts[word] if same else offsets[doc + 1]] = True
            removed[hit[doc]] += words
        for k, row in enumerate(hit):
            a, b = offsets[k], offsets[k + 1]
            if removed[row]:
                rest = data[a:b][~cut[a:b]].tobytes().decode("utf-8")
                texts[row] = rest if rest.strip(" \t\n\v\f\r") else ""
    names = [c for c in block.schema.names if c not in ("__lines", "__sizes")]
    columns = [pa.array(texts, pa.string()) if c == "text" else block.column(c) for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*names, "__removed"])


def _cutter(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.text_blocks(batches, TEXT_BYTES):
            yield _cut(block, min_words)

    return run


def remove_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` with the later repeats of runs of lines cut from ``text``; ``removed`` names a count of the words cut.

    A run repeats if all its lines lie in grams (at least 8 words of whole lines) that
    an earlier text holds: one with a lesser id, or the same text further up. Runs of fewer than
    ``min_words`` words stay. White space between words does not count. Every row stays: a text that
    is repeated as a whole becomes empty; of a passage inside a longer sentence up to 2 * ``BREAK_WINDOW`` - 1 words at its ends may stay; NULL stays NULL, a missing id counts as the
    least, texts with one id are not compared with each other, and repeated rows get
    the same result. Columns other than ``doc_id`` and ``text`` pass through. Only texts with such lines are
    shuffled and cut, and the few others that a filter takes for them.
    """
    found = repeated_lines(docs)
    some, rest = _parted(docs, found)
    keys = some.withColumns(
        {"__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(work.NO_ID)), "__version": F.xxhash64(F.coalesce("text", F.lit("")))}
    )
    found = found.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("lines").alias("__lines"), F.col("sizes").alias("__sizes"))
    joined = keys.join(found, ["__id", "__version"], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__lines", "__sizes")
    schema = docs.withColumn("__removed", F.lit(0).cast("bigint")).schema
    cut = joined.mapInArrow(_cutter(min_words), schema).unionByName(rest.withColumn("__removed", F.lit(0).cast("bigint")))
    count = [F.col("__removed").alias(removed)] if removed else []
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns if c != removed), *count)
