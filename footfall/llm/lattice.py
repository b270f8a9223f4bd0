"""The N-best search over many short lattices at once: forward Viterbi, then A* from the end, one step of each a round."""

from __future__ import annotations

import numpy as np

from footfall.llm import blocks

LONGEST_CHUNK = 24
NONE = np.iinfo(np.int64).min // 4
SLOT_BITS = ((0, 20), (20, 16), (36, 16), (48, 16))  # low bit and width of the hash bits that choose a slot, in turn


class PieceTable:
    """Finds pieces by the hash of their code points, for arrays of hashes."""

    def __init__(self, pieces: dict[str, tuple[int, int]], mark: str):
        names = list(pieces)
        points = np.array([ord(c) for name in names for c in name], np.uint64)
        ends = np.cumsum([len(name) for name in names])
        self.mark = mark
        self.keys = blocks.Hasher(blocks.mix(points))(ends - [len(name) for name in names], ends)
        self.ids = np.array([pieces[name][0] for name in names], np.int64)
        self.scores = np.array([pieces[name][1] for name in names], np.int64)
        self.slots, left = [], np.arange(len(names))
        for low, width in SLOT_BITS:
            slot = self._slot(self.keys[left], low, width)
            table = np.full(1 << width, -1, np.int64)
            table[slot[::-1]] = left[::-1]
            self.slots.append((low, width, table))
            left = left[table[slot] != left]
        if len(left):
            raise ValueError("two pieces share all slots")

    @staticmethod
    def _slot(keys: np.ndarray, low: int, width: int) -> np.ndarray:
        return ((keys >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the pieces, -1 for none."""
        low, width, table = self.slots[0]
        found = table[self._slot(keys, low, width)]
        other = np.flatnonzero((found >= 0) & (self.keys[found] != keys))  # the slot is another piece's
        found[other] = -1
        for low, width, table in self.slots[1:]:
            at = table[self._slot(keys[other], low, width)]
            here = (at >= 0) & (self.keys[at] == keys[other])
            found[other[here]] = at[here]
        return found

    def edges(self, chunks: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and ids by (chunk, end, length of the piece), and the lengths of the chunks."""
        sizes = np.array([len(c) for c in chunks])
        most = int(sizes.max())
        reach = min(longest, most)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        points[points == ord(self.mark)] = 0x110000  # a mark in the text is no space
        points[points == 32] = ord(self.mark)
        hasher = blocks.Hasher(blocks.mix(points))
        begin = np.cumsum(sizes) - sizes
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        start = np.arange(len(points)) - begin[chunk]
        scores = np.full((len(chunks), most + 1, reach + 1), NONE, np.int64)
        ids = np.zeros((len(chunks), most + 1, reach + 1), np.int32)
        for length in range(1, reach + 1):
            at = np.flatnonzero(start + length <= sizes[chunk])
            place = self.find(hasher(at, at + length))
            at, place = at[place >= 0], place[place >= 0]
            scores[chunk[at], start[at] + length, length] = self.scores[place]
            ids[chunk[at], start[at] + length, length] = self.ids[place]
        return scores, ids, sizes


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def best_paths(table: PieceTable, chunks: list[str], longest: int, best: int) -> Found:
    """The ``best`` segmentations of each chunk in falling order of score; every chunk has one.

    Returned as the number of paths of each chunk, the score and the number of ids of each
    path, and the ids of all of them.
    """
    scores, ids, sizes = table.edges(chunks, longest)
    n, reach_of = len(chunks), scores.shape[2] - 1
    forward = np.full((n, scores.shape[1]), NONE, np.int64)
    forward[:, 0] = 0
    for end in range(1, scores.shape[1]):
        for length in range(1, min(reach_of, end) + 1):
            np.maximum(forward[:, end], forward[:, end - length] + scores[:, end, length], out=forward[:, end])
    room = 64
    key = np.full((n, room), NONE, np.int64)  # of open entries: score of the best completion, then nearness, then age
    place, behind = np.zeros((n, room), np.int64), np.zeros((n, room), np.int64)
    parent, piece = np.full((n, room), -1, np.int32), np.zeros((n, room), np.int32)
    used, paths = np.ones(n, np.int64), np.zeros(n, np.int64)
    ended = np.full((n, best), -1, np.int64)
    place[:, 0] = sizes
    key[:, 0] = 0
    live = np.arange(n)
    while len(live):
        top = key[live].argmax(axis=1)
        open_ = key[live, top] > NONE
        live, top = live[open_], top[open_]
        key[live, top] = NONE
        at, total = place[live, top], behind[live, top]
        done = at == 0
        finished = live[done]
        ended[finished, paths[finished]] = top[done]
        paths[finished] += 1
        going, at, total, top = live[~done], at[~done], total[~done], top[~done]
        if used.max() + reach_of > room:
            grow = lambda a, fill: np.concatenate((a, np.full(a.shape, fill, a.dtype)), axis=1)
            key, place, behind, parent, piece = grow(key, NONE), grow(place, 0), grow(behind, 0), grow(parent, -1), grow(piece, 0)
            room *= 2
        gains = scores[going, at, ::-1]  # by falling length: the earliest start first
        row, column = np.nonzero(gains > NONE)
        length, count = reach_of - column, np.bincount(row, minlength=len(going))
        own, start = going[row], at[row] - length
        new = used[own] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        total = total[row] + gains[row, column]
        ahead = forward[own, start]
        key[own, new] = np.where(ahead > NONE // 2, ((total + ahead) << 20) - (start << 14) - new, NONE)
        place[own, new], behind[own, new], parent[own, new] = start, total, top[row]
        piece[own, new] = ids[own, at[row], length]
        used[going] += count
        live = live[paths[live] < best]
    return _collected(ended, paths, behind, parent, piece)


def _collected(ended, paths, behind, parent, piece) -> Found:
    row, rank = np.nonzero(ended >= 0)
    node = ended[row, rank]
    total = behind[row, node]
    columns, live = [], np.arange(len(row))
    counts = np.zeros(len(row), np.int64)
    while len(live):
        up = parent[row[live], node[live]]
        live, up = live[up >= 0], up[up >= 0]
        column = np.zeros(len(row), "<u4")
        column[live] = piece[row[live], node[live]]
        columns.append(column)
        counts[live] += 1
        node[live] = up
    matrix = np.stack(columns, axis=1)
    return paths, total, counts, matrix[np.arange(matrix.shape[1]) < counts[:, None]]
