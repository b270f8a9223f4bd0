"""N-best segmentation into sentence pieces, and back to text."""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks, lattice

BEST = 3
CACHE_ENTRIES = 500_000
BATCH = 2000  # chunks searched at once
TEXT_BYTES = 1 << 20  # of texts whose segmentations are held at once
NO_LOSS = 1 << 62
SPACE_MARK = "▁"
#: What a byte of a character outside the vocabulary costs more than the least piece.
UNKNOWN_PENALTY = 10
FRACTIONS = 1 << 20
Paths = list[tuple[int, list[int]]]


class Pieces:
    """The pieces of a model file with their scores, as weights of the edges of a lattice.

    Scores are whole numbers here, so that equal sums are equal: those of the file where all
    of them are whole, else in units of 1 / ``FRACTIONS``. A character that no
    piece has alone becomes its UTF-8 bytes. A space is the space mark; the mark itself,
    where a text holds it, becomes bytes, so that decoding gives the text back.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = (model.get_score(i) for i in range(model.get_piece_size()))
        unit = 1 if all(score.is_integer() for score in scores) else FRACTIONS
        self.piece_of: dict[str, tuple[int, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.piece_of[piece] = (i, round(model.get_score(i) * unit))
                self.bytes_of.append(piece.replace(SPACE_MARK, " ").encode())
        self.longest = max(map(len, self.piece_of))
        self.byte_score = min(score for _, score in self.piece_of.values()) - UNKNOWN_PENALTY * unit
        joined = {c for piece in self.piece_of if len(piece) > 1 for c in piece}
        #: White space that joins no piece stands alone; no piece goes on after a space mark that follows a letter.
        alone = "".join(c for c in "\n\t\r\v\f" if c not in joined)
        if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece in self.piece_of):
            raise ValueError("pieces that hold a space inside are not supported")
        self.alone = np.isin(np.arange(256), [ord(c) for c in alone])
        self.letters = frozenset(piece.replace(SPACE_MARK, " ") for piece in self.piece_of if len(piece) == 1)
        self.table = lattice.PieceTable(self.piece_of, SPACE_MARK)

    def edges(self, text: str, start: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, score, ids) of the edges that leave a position of a chunk."""
        found = False
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            piece = text[start:end]
            entry = None if "▁" in piece else self.piece_of.get(piece.replace(" ", SPACE_MARK))
            if entry:
                found |= end == start + 1
                yield end, entry[1], (entry[0],)
        if not found:
            coded = text[start].encode("utf-8", "surrogatepass")
            yield start + 1, self.byte_score * len(coded), tuple(self.byte_id[b] for b in coded)

    def best_paths(self, text: str, best: int) -> Paths:
        """The ``best`` segmentations of a chunk with the highest scores, as (score, ids), in falling order.

        Forward, Viterbi scores say how well each position can be reached from the
        start. Backward, an A* search from the end adds to a partial path the exact
        score of its best completion, so complete paths leave the queue in order.
        Among equals the path nearest to its completion comes first, then the one
        found first.
        """
        n = len(text)
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        reach: list[int | None] = [None] * (n + 1)
        reach[0] = 0
        for start in range(n):
            here = reach[start]
            for end, score, ids in self.edges(text, start):
                into[end].append((start, score, ids))
                if reach[end] is None or here + score > reach[end]:
                    reach[end] = here + score
        queue: list = [(-reach[n], n, 0, 0, None)]
        order = itertools.count(1)
        paths: Paths = []
        while queue and len(paths) < best:
            _, at, _, behind, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                paths.append((behind, ids))
                continue
            for start, score, ids in into[at]:
                total = behind + score
                heapq.heappush(queue, (-(total + reach[start]), start, next(order), total, (ids, path)))
        return paths

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "surrogatepass")


@functools.cache
def load(path: str) -> Pieces:
    return Pieces(path)


class Segmenter:
    """Segmentations of whole texts; chunks between spaces are segmented once while they are kept.

    They are kept in arrays without an object for each, as every worker that waits for a task holds its own.
    """

    def __init__(self, pieces: Pieces, best: int):
        self.pieces, self.best = pieces, best
        self._clear()

    def _clear(self) -> None:
        #: Chunk c is ``known[c]``; ``keys`` are hashes of the chunks in rising order, ``place`` says whose.
        self.known, self.keys, self.place = pa.array([], pa.large_string()), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: The paths of chunk c are ``first[c]`` to ``first[c + 1]``, the ids of path p ``begin[p]`` to ``begin[p + 1]``.
        self.first, self.begin = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, new: pa.Array, keys: np.ndarray) -> np.ndarray:
        """Segments new chunks, short ones of known characters many at a time, the others one by one; gives their numbers."""
        short, others, pieces = [], [], self.pieces
        for i, chunk in enumerate(new.to_pylist()):
            if len(chunk) <= lattice.LONGEST_CHUNK and pieces.letters.issuperset(chunk):
                short.append((len(chunk), i, chunk))
            else:
                others.append((i, chunk))
        short.sort()
        order = np.array([i for _, i, _ in short] + [i for i, _ in others], np.int64)
        short, others = [chunk for _, _, chunk in short], [chunk for _, chunk in others]
        found = [
            lattice.best_paths(pieces.table, short[low : low + BATCH], pieces.longest, self.best)
            for low in range(0, len(short), BATCH)
        ]
        for chunk in others:
            paths = pieces.best_paths(chunk, self.best)
            sizes = [len(ids) for _, ids in paths]
            found.append(([len(paths)], [score for score, _ in paths], sizes, [i for _, ids in paths for i in ids]))
        code = np.empty(len(new), np.int64)
        code[order] = np.arange(len(self.known), len(self.known) + len(new))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        rising = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[rising])
        self.keys, self.place = np.insert(self.keys, at, keys[rising]), np.insert(self.place, at, code[rising])
        if found:
            count, score, size, ids = (np.concatenate([f[k] for f in found]) for k in range(4))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(count)))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size)))
            self.score = np.concatenate((self.score, score))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        return code

    def look_up(self, chunks: pa.Array, keys: np.ndarray) -> np.ndarray:
        """The numbers of the chunks that are kept, -1 for the others; of an equal key, the chunk itself decides."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        same = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        code, place = np.full(len(chunks), -1, np.int64), self.place[at[same]]
        equal = pc.equal(self.known.take(pa.array(place)), chunks.take(pa.array(same))).to_numpy(zero_copy_only=False)
        code[same[equal]] = place[equal]
        return code

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the chunks of all texts, all of them learnt, and where those of each text end.

        A chunk begins with a text, a character that stands alone, the character after one,
        or a space that follows none. All of these are single bytes.
        """
        data, offsets = blocks.utf8(texts)
        alone, space = self.pieces.alone[data], data == 32
        begins = alone | space
        begins[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        cuts = np.append(starts, len(data))
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        places = chunks.dictionary_encode()
        different = places.dictionary
        text, ends = blocks.utf8(different)
        keys = blocks.Hasher(text)(ends[:-1], ends[1:])
        code = self.look_up(different, keys)
        new = np.flatnonzero(code < 0)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self._clear()
            new = np.arange(len(different))
        if len(new):
            code[new] = self.learn(different.take(pa.array(new)), keys[new])
        return code[places.indices.to_numpy()], np.searchsorted(starts, offsets)

    def segment(self, text: str) -> list[tuple[int, bytes]]:
        """The best segmentations of a text as (score, ids in 32 bits), in falling order."""
        _, _, found = self.segment_all(pa.array([text]))
        return [(score, b"".join(parts)) for score, parts in found[0]]

    def segment_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, list]]]]:
        """The ids of the best segmentation of all texts, their number for each text, and the best
        segmentations of each text as (score, parts of the ids in 32 bits), in falling order.

        No piece crosses the end of a chunk, so the lattice of a text is the chain of
        those of its chunks: a segmentation loses, against the best one, the sum of
        what its chunks lose.
        """
        code, ends = self.codes(texts)
        path = self.first[code]
        size = self.begin[path + 1] - self.begin[path]
        ids = blocks.gathered(self.ids, self.begin[path], size)
        until = np.concatenate(([0], np.cumsum(size)))
        total = np.concatenate(([0], np.cumsum(self.score[path])))
        least = np.full(len(code), NO_LOSS)
        more = np.flatnonzero(self.first[code + 1] - path > 1)
        least[more] = self.score[path[more]] - self.score[path[more] + 1]
        coded = memoryview(ids.astype("<u4").tobytes())
        found = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            base, low, high = int(total[b] - total[a]), int(until[a]) * 4, int(until[b]) * 4
            results = [(base, [coded[low:high]])]
            for loss, chosen in self._least_sums(code[a:b], least[a:b]):
                parts, at = [], low
                for i, other in sorted(chosen):
                    parts += [coded[at : int(until[a + i]) * 4], self.ids[self.begin[other] : self.begin[other + 1]].astype("<u4").tobytes()]
                    at = int(until[a + i + 1]) * 4
                results.append((base - loss, [*parts, coded[at:high]]))
            found.append(results)
        return ids, until[ends[1:]] - until[ends[:-1]], found

    def _least_sums(self, code: np.ndarray, least: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """The ``best - 1`` least losses of a text, each with the places and paths that differ from the best one.

        As many least single losses are enough to build them. Places are added one after
        another, and only the least sums so far are kept.
        """
        rest = self.best - 1
        if rest < 1 or not len(least):
            return []
        limit = np.partition(least, rest - 1)[rest - 1] if len(least) > rest else NO_LOSS
        places = np.flatnonzero((least <= limit) & (least < NO_LOSS))
        places = places[np.argsort(least[places], kind="stable")[:rest]].tolist()
        singles = []
        for i in places:
            low, high = self.first[code[i]], self.first[code[i] + 1]
            singles += [(int(self.score[low] - self.score[p]), i, int(p)) for p in range(low + 1, high)]
        of_place: dict[int, list[tuple[int, int]]] = {}
        for loss, i, p in heapq.nsmallest(rest, singles):
            of_place.setdefault(i, []).append((loss, p))
        sums: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
        for i, others in of_place.items():
            sums += [(total + loss, [*chosen, (i, p)]) for total, chosen in sums for loss, p in others]
            sums = heapq.nsmallest(rest + 1, sums)
        return sums[1:] if sums[0][1] == [] else [s for s in sums if s[1]][:rest]


_segmenters: dict[tuple[str, int], Segmenter] = {}


def segmenter(path: str, best: int) -> Segmenter:
    """One per worker process, so that its chunks serve the next task too."""
    if (path, best) not in _segmenters:
        _segmenters[path, best] = Segmenter(load(path), best)
    return _segmenters[path, best]


def _encoded(own: Segmenter, block: pa.RecordBatch) -> pa.RecordBatch:
    values, counts, found = own.segment_all(block.column("text"))
    ids = blocks.lists(values, counts, pa.int32())
    flat = [path for paths in found for path in paths]
    sizes = np.array([sum(map(len, parts)) // 4 for _, parts in flat], np.int64)
    coded = memoryview(b"".join([part for _, parts in flat for part in parts]))
    cuts = np.concatenate(([0], np.cumsum(sizes * 4))).tolist()
    segmentations = pa.StructArray.from_arrays(
        [
            pa.array([score for score, _ in flat], pa.int64()),
            pa.array(sizes),
            pa.array([zlib.crc32(coded[a:b]) for a, b in itertools.pairwise(cuts)], pa.int64()),
            blocks.lists(np.frombuffer(coded, "<u4").astype(np.int32), sizes, pa.int32()),
        ],
        ["score", "n_tokens", "ids_crc32", "ids"],
    )
    ends = np.concatenate(([0], np.cumsum([len(paths) for paths in found]))).astype(np.int32)
    ranked = pa.ListArray.from_arrays(pa.array(ends), segmentations)
    return pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text"), ids, ranked], ["doc_id", "text", "ids", "best"])


def _encoder(path: str, best: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path, best)
        for block in blocks.text_blocks(batches, TEXT_BYTES):
            yield _encoded(own, block)  # what a block needed on the way is gone before the next one
            blocks.release()

    return run


RANKED = "best array<struct<score: bigint, n_tokens: bigint, ids_crc32: bigint, ids: array<int>>>"
ENCODED = f"doc_id bigint, text string, ids array<int>, {RANKED}"
CHECKED = f"doc_id bigint, {RANKED}, decoded string, round_trip boolean"


def encode(docs: DataFrame, model: str, best: int = BEST) -> DataFrame:
    """(doc_id, text, ids, best): the best segmentation of every whole text, and the ``best`` best ones with their ids.

    No shuffle. A text has fewer segmentations where its lattice has fewer paths; NULL and
    empty texts have one, empty, of score 0. Ids and rows pass through as they are,
    other columns are left out. A worker keeps ``CACHE_ENTRIES`` chunks at most.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encoder(model, best), ENCODED)


def decoder(model: str):
    """A column function from ids to text."""

    @F.pandas_udf("string")
    def decode(ids):
        pieces = load(model)
        return ids.map(lambda own: pieces.decode(own.tolist()))

    def of(ids: Column) -> Column:
        return decode(ids)

    return of


def _decoded(table: pa.Array, batch: pa.RecordBatch) -> pa.RecordBatch:
    paths = batch.column("best")
    ids = paths.values.field("ids")
    taken = table.take(ids.values)  # the bytes of all segmentations, one after another
    cuts = np.frombuffer(taken.buffers()[1], np.int64)[ids.offsets.to_numpy()]
    decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), taken.buffers()[2]])
    first = paths.offsets.to_numpy()
    row = np.repeat(np.arange(len(paths)), np.diff(first))
    text = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
    right = pc.equal(decoded, text.take(pa.array(row))).to_numpy(zero_copy_only=False)
    same = np.logical_and.reduceat(right, first[:-1])  # a text has a segmentation at least
    again = decoded.take(pa.array(first[:-1])).cast(pa.string())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), paths, again, pa.array(same)], ["doc_id", "best", "decoded", "round_trip"])


def _checked(model: str, best: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = segmenter(model, best), pa.array(load(model).bytes_of, pa.large_binary())
        for block in blocks.text_blocks(batches, TEXT_BYTES):
            yield _decoded(table, _encoded(own, block))
            blocks.release()

    return run


def encode_and_decode(docs: DataFrame, model: str, best: int = BEST) -> DataFrame:
    """(doc_id, n_tokens, ids, best, decoded, round_trip): as :func:`encode`, with all segmentations decoded again from their ids.

    ``decoded`` is the text that the best one gives; ``round_trip`` says whether every one of them gives the text back.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_checked(model, best), CHECKED)
    first = F.col("best")[0]
    return rows.select("doc_id", first["n_tokens"].alias("n_tokens"), first["ids"].alias("ids"), "best", "decoded", "round_trip")
