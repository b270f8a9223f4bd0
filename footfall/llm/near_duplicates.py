"""Near-duplicate classes by weighted MinHash over word shingles, with every candidate verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import blocks, work
from footfall.llm.components import components

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 8, 64  # a pair at 0.8 shares no band with probability (1 - 0.8**8)**64, below 8e-6
DEVIATIONS = 4.5  # a pair at 0.8 agrees in too few registers with probability below 4e-6
BLOCK = 512  # members of a bucket that are compared with as many others at a time


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct shingles of each text: text number, hash and count, ordered by text and hash.

    A text of fewer than ``WORDS`` words is one shingle, one without words none.
    """
    data, offsets = blocks.utf8(texts)
    starts, ends, doc = blocks.words(data, offsets)
    word = blocks.Hasher(data)(starts, ends)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    grams = blocks.sequence_hashes(word, WORDS)
    whole = doc[: len(grams)] == doc[WORDS - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, owner = [grams[whole]], [doc[: len(grams)][whole]]
    first = np.cumsum(size) - size
    for length in range(1, WORDS):
        short = np.flatnonzero(size == length)
        if len(short):
            items = [word[first[short] + j] * np.uint64(2 * j + 3) for j in range(length)]
            hashes.append(blocks.mix(np.sum(items, axis=0, dtype=np.uint64)))
            owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes))), n


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """BagMinHash: ``size`` values for each of n bags of weighted elements.

    The weight axis of an element is cut at 0, 1, 2, 4, 8 and so on. Each cell holds a
    Poisson process whose rate is its length and whose points carry a level inside the
    cell and a register; the points at levels up to the weight count, so bags share
    the points up to the lesser weight. A register keeps its earliest point: two
    bags agree on it with their weighted Jaccard similarity. Points come in time order,
    so a process ends once it passes the latest register of its bag; this is looked
    at in growing steps, as later points change nothing.
    """
    cells = [(0, 1)] + [(2**j, 2**j) for j in range(int(np.log2(weights.max())) + 1 if len(weights) else 0)]
    part = [(np.flatnonzero(weights > low), low, length, i) for i, (low, length) in enumerate(cells)]
    item = np.concatenate([p[0] for p in part])
    low, length, cell = (np.concatenate([np.full(len(p[0]), p[k], np.int64) for p in part]) for k in (1, 2, 3))
    seed = blocks.mix(hashes[item] + cell.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    owner, room, time = doc[item], weights[item] - low, np.zeros(len(item))
    kept = np.full((n, size), np.inf)
    flat, point, look = kept.reshape(-1), 0, 1
    while len(owner):
        draw = blocks.mix(seed + np.uint64((point * 0x9E3779B97F4A7C15) % 2**64))
        point += 1
        time = time - np.log(_uniform(draw)) / length
        draw = blocks.mix(draw)
        register = ((draw >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % length
        counts = level < room
        np.minimum.at(flat, owner[counts] * size + register[counts], time[counts])
        if point < look:
            continue
        look = point + 1 + point // 4
        last = np.zeros(n)
        present = np.flatnonzero(np.bincount(owner, minlength=n))
        last[present] = kept[present].max(axis=1)
        go = time < last[owner]
        owner, room, time, seed, length = owner[go], room[go], time[go], seed[go], length[go]
    return kept


def _sign(registers: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.text_blocks(batches):
            doc, hashes, weights, n = shingles(block.column("text"))
            values = blocks.mix(signatures(doc, hashes, weights, n, registers).view(np.uint64)).astype(np.uint8)
            total = np.bincount(doc, weights, minlength=n).astype(np.int64)
            sketches = pa.array([row.tobytes() for row in values], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("copy"), pa.array(total), sketches],
                ["doc_id", "copy", "n_shingles", "sketch"],
            )

    return run


def _banded(kept: DataFrame, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, band, key): two documents have a key in common where all bytes of a band agree."""
    each = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    key = F.xxhash64(F.substring("sketch", F.col("band") * rows + 1, F.lit(rows)), "band")
    return each.select("doc_id", "n_shingles", "band", key.alias("key"))


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset of shingles as a set: the k-th occurrence of a shingle is an element of its own."""
    for block in blocks.text_blocks(batches):
        doc, hashes, weights, n = shingles(block.column("text"))
        item = np.repeat(np.arange(len(doc)), weights)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(weights) - weights, weights)
        bag = blocks.mix(hashes[item] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        counts = np.bincount(doc, weights, minlength=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), blocks.lists(blocks.signed(bag), counts, pa.int64())], ["doc_id", "bag"])


def _least(similarity: float, registers: int) -> float:
    """Registers that a pair at ``similarity`` agrees in, less ``DEVIATIONS`` standard deviations."""
    return registers * similarity - DEVIATIONS * (registers * similarity * (1 - similarity)) ** 0.5


def _bytes(sketches: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, registers)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float, registers: int) -> DataFrame:
    """The pairs whose signatures agree in enough registers, a byte of each compared."""
    least = _least(similarity, registers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_bytes(batch.column(c), registers) for c in ("sketch_a", "sketch_b"))
            some = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(some) for c in ("a", "b")], ["a", "b"])

    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def _bags_of(wanted: DataFrame, texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, bag) of the documents whose ids are wanted."""
    wanted = wanted.select("doc_id").distinct().join(chosen, "doc_id")
    needed = texts.withColumn("copy", F.md5("text")).join(wanted, ["doc_id", "copy"], "left_semi")
    needed = needed.dropDuplicates(["doc_id", "copy"]).select("doc_id", "text")
    return work.written(needed.mapInArrow(_bags, "doc_id bigint, bag array<bigint>"), "bags")


def _verified(pairs: DataFrame, texts: DataFrame, chosen: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets of shingles overlap by at least ``similarity``."""
    bags = _bags_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), texts, chosen)
    both = pairs.join(bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a")), "a").join(
        bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b")), "b"
    )
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    either = F.size("bag_a") + F.size("bag_b") - shared
    return both.where(shared >= similarity * either).select("a", "b")


def near_duplicate_classes(
    docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """(doc_id, class_id, class_size): documents linked, over any chain, by a weighted Jaccard similarity of
    their five-word shingles of at least ``similarity``; ``class_id`` is the least id of the class.

    Equal texts collapse to the least id before any comparison. In each band the
    members of a bucket are compared with its least one; then, where members of a
    bucket are still in different components, the signatures of every such pair are
    compared, block by block, inside tasks. So each pair that shares a band is compared
    or already in one class, and a bucket of copies costs one comparison a member.
    Pairs whose whole signatures agree enough are verified on their shingles; of those of
    a block only the ones that join what no other has joined become rows. Texts without a word are classes of
    their own. Rows with the same id count once, by their greatest text; a missing id
    is an id of its own; other columns are ignored.
    """
    texts = work.keyed_texts(docs)
    registers = rows * bands
    signed = texts.withColumn("copy", F.md5("text")).mapInArrow(
        _sign(registers), "doc_id bigint, copy string, n_shingles bigint, sketch binary"
    )
    signed = work.written(signed, "signatures")
    ids = signed.groupBy("doc_id").agg(F.max("copy").alias("copy"))
    ids = signed.join(ids, ["doc_id", "copy"], "left_semi").select("doc_id", "copy", "n_shingles").distinct()
    heads = ids.where("n_shingles > 0").groupBy("copy").agg(F.min("doc_id").alias("head"), F.count("*").alias("n_rows"))
    heads = work.written(heads, "heads")
    chosen = heads.select(F.col("head").alias("doc_id"), "copy")
    kept = signed.join(chosen, ["doc_id", "copy"], "left_semi").dropDuplicates(["doc_id"])
    kept = work.written(kept.select("doc_id", "n_shingles", "sketch"), "kept")
    banded = _banded(kept, rows, bands)
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = work.written(banded.join(buckets.select("key", "first"), "key"), "buckets")
    stars = work.written(
        shared.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs"
    )
    likely = work.written(_likely(stars, kept, similarity, registers), "likely")
    links = work.written(_verified(likely, texts, chosen, similarity), "verified")
    labels = components(links)
    near = work.written(_near(shared, labels, kept, similarity, rows, bands), "near")
    more = _linked(near, kept, _bags_of(near, texts, chosen), similarity, rows, bands)
    labels = components(links.union(work.written(more, "more")))
    heads = heads.join(labels, F.col("head") == F.col("node"), "left")
    heads = work.written(heads.select("copy", F.coalesce("component", "head").alias("class"), "n_rows"), "heads")
    ids = work.written(ids.select("doc_id", "copy"), "ids")
    classes = _looked_up(ids, heads, "copy", "n_rows").select("doc_id", F.coalesce("class", "doc_id").alias("class"))
    classes = work.written(classes, "classes")
    sizes = work.written(classes.groupBy("class").agg(F.count("*").alias("class_size")), "sizes")
    return _looked_up(classes, sizes, "class", "class_size").select(
        work.id_or_none().alias("doc_id"), work.id_or_none("class").alias("class_id"), "class_size"
    )


def _looked_up(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left joined with ``table``, which has a row a key and in ``size`` the rows of that key.

    Keys with more rows than a partition's share are fewer than the partitions: those
    are broadcast, so no task gets all rows of a key. Both tables are stored ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.lit(rows.count() // parts)
    large = F.broadcast(table.where(F.col(size) > share).withColumn("__large", F.lit(True)))
    marked = rows.join(large, key, "left")
    rest = marked.where("__large is null").select(*rows.columns).join(table.where(F.col(size) <= share), key, "left")
    return marked.where("__large").drop("__large").unionByName(rest)


class _Group:
    """Two parts of a bucket, or one part with itself: its members in turn and their likely partners.

    A pair is compared in the first band that it shares and in no other bucket.
    """

    def __init__(self, group: pa.Table, similarity: float, rows: int, bands: int):
        self.low, self.high, self.band = (group.column(c)[0].as_py() for c in ("low", "high", "band"))
        self.ids, self.size, self.part = (group.column(c).to_numpy() for c in ("doc_id", "n_shingles", "part"))
        _, self.kind = np.unique(group.column("class").to_numpy(), return_inverse=True)
        self.shape, self.similarity = (bands, rows), similarity
        self.sketch = _bytes(group.column("sketch"), rows * bands)

    def partners(self, i: int) -> np.ndarray:
        """Members of another class, in ``kind`` as it is now, that may be linked to the i-th one."""
        n = len(self.ids)
        others = np.arange(i + 1, n) if self.low == self.high else np.flatnonzero((self.part == self.high) & (self.part[i] == self.low))
        least, most = np.minimum(self.size[i], self.size[others]), np.maximum(self.size[i], self.size[others])
        others = others[(least >= self.similarity * most) & (self.kind[others] != self.kind[i])]
        same = self.sketch[others] == self.sketch[i]
        likely = same.sum(axis=1) >= _least(self.similarity, same.shape[1])
        first = same[likely].reshape(-1, *self.shape).all(axis=2).argmax(axis=1) == self.band
        return others[likely][first]


def _grouped(inside, similarity: float, rows: int, bands: int):
    """A function of Arrow batches, sorted by (key, low, high), that applies ``inside`` to each whole group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            new = np.zeros(max(0, table.num_rows - 1), bool)
            for c in ("key", "low", "high"):
                new |= np.diff(table.column(c).to_numpy()) != 0
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(start, end - start)
                yield from inside(part, _Group(part, similarity, rows, bands))
            rest = table.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield from inside(rest, _Group(rest, similarity, rows, bands))

    return run


def _members(group: pa.Table, own: _Group) -> Iterator[pa.RecordBatch]:
    """The members that have a likely partner."""
    some = np.zeros(len(own.ids), bool)
    for i in range(len(own.ids)):
        found = own.partners(i)
        some[found] = True
        some[i] |= len(found) > 0
    if some.any():
        yield from group.drop_columns("sketch").filter(pa.array(some)).to_batches()


def _forest(group: pa.Table, own: _Group) -> Iterator[pa.RecordBatch]:
    """Verified links, each of which joins two classes of the group that were still apart."""
    bags, links = group.column("bag").combine_chunks(), []
    ends, values = bags.offsets.to_numpy(), bags.values.to_numpy()
    bag = [np.sort(values[low:high]) for low, high in zip(ends[:-1], ends[1:], strict=True)]
    for i in range(len(bag)):
        for j in own.partners(i).tolist():
            if own.kind[i] == own.kind[j]:
                continue
            shared = len(np.intersect1d(bag[i], bag[j], assume_unique=True))
            if shared >= own.similarity * (len(bag[i]) + len(bag[j]) - shared):
                own.kind[own.kind == own.kind[j]] = own.kind[i]
                links.append(sorted((int(own.ids[i]), int(own.ids[j]))))
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


GROUP = "key bigint, low int, high int, band int, doc_id bigint, n_shingles bigint, class bigint, part int"


def _near(shared: DataFrame, labels: DataFrame, kept: DataFrame, similarity: float, rows: int, bands: int) -> DataFrame:
    """Members of buckets that have a likely partner of another component, a row for each group of the two.

    A bucket of n members is cut into parts of about ``BLOCK`` by a hash of the id, and
    each two parts meet in one group, so that no task holds a bucket and no pair is a
    row.
    """
    placed = shared.join(labels, shared.doc_id == labels.node, "left")
    placed = placed.select("key", "band", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("class"))
    placed = work.written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n"))
    mixed = mixed.where("least < most").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    members = placed.join(mixed, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    members = members.join(kept.select("doc_id", "sketch"), "doc_id")
    members = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    members = members.select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        "band", "doc_id", "n_shingles", "class", "part", "sketch",
    )
    return _by_group(members).mapInArrow(_grouped(_members, similarity, rows, bands), GROUP)


def _by_group(members: DataFrame) -> DataFrame:
    return members.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "doc_id")


def _linked(near: DataFrame, kept: DataFrame, bags: DataFrame, similarity: float, rows: int, bands: int) -> DataFrame:
    """Links (a, b) between members of a group, fewer than it has members."""
    members = near.join(kept.select("doc_id", "sketch"), "doc_id").join(bags, "doc_id")
    return _by_group(members).mapInArrow(_grouped(_forest, similarity, rows, bands), "a bigint, b bigint")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document has the least id of its near-duplicate class; its repeated rows stay."""
    classes = near_duplicate_classes(docs, similarity)
    others = work.written(classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__other")), "others")
    return docs.join(others, docs["doc_id"].eqNullSafe(others["__other"]), "left_anti")


def one_wordless_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with, of equal texts without a word, only the rows of the least id; rows with words pass through.

    NULL counts as the empty text. Only ids and texts of the wordless rows are grouped, each task's
    rows first, and rows meet the ids that stay by their own id, so no task gets all copies of a text.
    """
    text, id_ = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(work.NO_ID))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    rest = docs.where(wordless)
    heads = rest.groupBy(F.md5(text).alias("__copy")).agg(F.min(id_).alias("__id"))
    heads = work.written(heads, "wordless")
    kept = rest.join(heads, (id_ == F.col("__id")) & (F.md5(text) == F.col("__copy")), "left_semi")
    return docs.where(~wordless).unionByName(kept)
