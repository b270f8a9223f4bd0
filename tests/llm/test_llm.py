"""The corpus operators against brute force, on small tables and on their edge cases."""

import base64
import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from footfall.llm import (
    blocks,
    catalog,
    lattice,
    mixing,
    near_duplicates,
    personal_data,
    pieces,
    quality,
    repeated_runs,
    sharding,
    syncmers,
    token_files,
    toxicity,
    work,
)
from footfall.llm import recurrent as net
from footfall.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MODEL = catalog.tokenizer_file("piece_bpe_32k.model")
TOKENIZER = catalog.tokenizer_file("word_bpe_49k.json")
PASSAGE = " ".join(f"passage{i}" + ("." if i % 11 == 10 else "") for i in range(66))


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) + draw.choice(["", "", "", "."]) for _ in range(n))


def edge_rows():
    long = prose(1, 6000)
    near = prose(2, 200).split(" ")
    texts = {
        0: prose(3, 120),
        1: prose(3, 120),
        2: " ".join(near),
        3: " ".join([*near[:100], "changed", *near[101:]]),
        4: "",
        5: None,
        6: long,
        7: long + " tail",
        8: "two words",
        9: "two words",
        10: prose(4, 60) + " " + PASSAGE + " " + prose(5, 40),
        11: prose(6, 50) + "\n" + PASSAGE + "\n" + prose(7, 30),
        12: "Write to a.b@c.example.com_d@e.fr or +1 (988) 555-2485, 4539 1488 0343 6467; 10.0.0.255 1.2.3.999",
        13: "x " * 400,
        14: "A same line here\nA same line here\n \nother #*$ | <b> é日本 \U0001f600",
        15: "1" * 3000 + " " + "a" * 3000 + "@ " + "5 " * 2000,
    }
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 2}", len(t or "")) for i, t in texts.items()]
    rows += [(None, prose(8, 30), None, None, None), (2, texts[2], "en", "src0", 1), (10**12, "one more text", "de", None, 3)]
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    frame = spark.createDataFrame(edge_rows(), SCHEMA)
    extra = {c: F.lit(1) for c in ("part", "copy", "version", "lines", "ids", "score", "shard", "topic", "tokens", "n_words", "class_id")}
    return frame.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r["text"] for r in catalog.documents(spark, SF).collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- pieces -------------------------------------------------------------------


def all_paths(model, text):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
        else:
            for end, more, own in model.edges(text, at):
                go(end, score + more, ids + list(own))

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat\nsat", "  doucs ▁x", "éù日本 a", "aa aa aa", "", " ", "\n\n a", "\U0001f600 ab"])
def test_best_segmentations_are_those_of_all_paths(text):
    own = pieces.Segmenter(pieces.load(MODEL), 4)
    found, wanted = own.segment(text), all_paths(own.pieces, text)
    assert [score for score, _ in found] == [score for score, _ in wanted[:4]]
    assert len({coded for _, coded in found}) == len(found)
    for score, coded in found:
        ids = np.frombuffer(coded, "<u4").tolist()
        assert own.pieces.decode(ids) == text and (score, ids) in wanted


def test_batched_search_equals_the_plain_one(small):
    model = pieces.load(MODEL)
    found = {c for t in small.values() for c in re.findall(r" *[^ \n\t\r\v\f]+|[\n\t\r\v\f]| +", t)}
    chunks = sorted(c for c in found if len(c) <= lattice.LONGEST_CHUNK and model.letters.issuperset(c))[::40]
    count, score, size, ids = (x.tolist() for x in lattice.best_paths(model.table, chunks, model.longest, 3))
    for chunk, paths in zip(chunks, count, strict=True):
        for wanted in model.best_paths(chunk, 3)[:paths] + [None] * (len(model.best_paths(chunk, 3)) - paths):
            n = size.pop(0)
            assert (score.pop(0), ids[:n]) == wanted
            del ids[:n]


def test_many_segmentations_of_a_text_of_many_chunks():
    text = "aa bb aa\tab ba"
    own = pieces.Segmenter(pieces.load(MODEL), 50)
    found, wanted = own.segment(text), all_paths(own.pieces, text)
    assert [score for score, _ in found] == [score for score, _ in wanted[:50]] and len({c for _, c in found}) == len(found)
    assert all((score, np.frombuffer(coded, "<u4").tolist()) in wanted for score, coded in found)


def test_pieces_over_edge_cases(spark, edges):
    rows = pieces.encode_and_decode(edges, MODEL).collect()
    assert len(rows) == edges.count() and all(r["round_trip"] for r in rows)
    for r in rows:
        assert r["best"][0]["n_tokens"] == r["n_tokens"] == len(r["ids"])
        assert r["best"][0]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert [b["score"] for b in r["best"]] == sorted((b["score"] for b in r["best"]), reverse=True)
    assert pieces.encode_and_decode(empty(spark), MODEL).count() == 0
    back = pieces.encode(edges, MODEL).withColumn("again", pieces.decoder(MODEL)("ids")).collect()
    assert all((r["text"] or "") == r["again"] for r in back)


def test_every_best_segmentation_is_given_and_decoded(spark, edges, monkeypatch):
    own = pieces.Segmenter(pieces.load(MODEL), pieces.BEST)
    rows = pieces.encode_and_decode(edges, MODEL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edges.select("doc_id", "text").collect()}
    assert max(len(r["best"]) for r in rows) == pieces.BEST
    for r in rows:
        assert r["decoded"] in [t for i, t in texts.items() if i == r["doc_id"]] or r["doc_id"] is None
        wanted = [(score, np.frombuffer(coded, "<u4").tolist()) for score, coded in own.segment(r["decoded"])]
        assert [(b["score"], b["ids"]) for b in r["best"]] == wanted and r["ids"] == r["best"][0]["ids"]
        for b in r["best"]:
            assert own.pieces.decode(b["ids"]) == r["decoded"] and b["n_tokens"] == len(b["ids"])
            assert b["ids_crc32"] == zlib.crc32(np.array(b["ids"], "<u4").tobytes())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the cat sat", None]})
    right = pieces.Segmenter.segment_all

    def wrong(self, texts):  # the last segmentation of the first text loses an id
        ids, counts, found = right(self, texts)
        score, parts = found[0][-1]
        found[0][-1] = (score, [b"".join(parts)[4:]])
        return ids, counts, found

    monkeypatch.setattr(pieces.Segmenter, "segment_all", wrong)
    (out,) = pieces._checked(MODEL, 3)([batch])
    assert out.column("round_trip").to_pylist() == [False, True] and out.column("decoded").to_pylist() == ["the cat sat", ""]


# --- near duplicates ----------------------------------------------------------


def test_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(0)
    a, b = draw.integers(0, 50, 400), draw.integers(0, 80, 400)
    b[:320] = a[:320]
    (ua, xa), (ub, xb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    ca, cb = dict(zip(ua, xa, strict=True)), dict(zip(ub, xb, strict=True))
    true = sum(min(ca.get(k, 0), cb.get(k, 0)) for k in {*ca, *cb}) / sum(max(ca.get(k, 0), cb.get(k, 0)) for k in {*ca, *cb})
    same = []
    for seed in range(40):
        h = blocks.mix(np.concatenate((ua, ub)).astype(np.uint64) + np.uint64(1000 * seed))
        owner = np.repeat([0, 1], [len(ua), len(ub)])
        s = near_duplicates.signatures(owner, h, np.concatenate((xa, xb)), 2, 128)
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - true) < 0.02


def test_classes_equal_brute_force(spark, small, edges):
    for docs, texts in ((catalog.documents(spark, SF), small), (edges, {work.NO_ID if r[0] is None else r[0]: r[1] for r in edge_rows()})):
        found = {work.NO_ID if r["doc_id"] is None else r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
        wanted = {i: None if c == work.NO_ID else c for i, c in brute.classes(texts).items()}
        assert found == wanted
    assert near_duplicates.near_duplicate_classes(empty(spark)).count() == 0
    kept = near_duplicates.one_of_each(edges)
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert kept.columns == edges.columns and ids.count("2") == 2 and not {"1", "3", "7", "9"} & {*ids} and {"0", "None", "4", "5"} <= {*ids}


def test_large_buckets_are_compared_in_parts(spark, monkeypatch):
    base, draw = prose(31, 90).split(" "), random.Random(5)
    texts = {}
    for i in range(60):
        text = list(base)
        for at in draw.sample(range(90), draw.choice((0, 1, 2, 4))):
            text[at] = f"w{draw.randrange(6)}"
        texts[i] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    wanted = brute.classes(texts)
    assert 1 < len({*wanted.values()}) < 60
    for block in (3, near_duplicates.BLOCK):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()} == wanted


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 499), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 499: 499, 500: 499}


# --- token files --------------------------------------------------------------


def test_token_files_round_trip(spark, edges, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    odd = [(20, "A<|endoftext|>b ΑΣ Σας İx it's 3.5 naïve"), (21, "Café \x1c x y\tz\r\nÅngström")]
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, TOKENIZER)
    rows = token_files.digests(token_files.read_ids(spark, path)).collect()
    texts = sorted(((work.NO_ID if i is None else i), t or "") for i, t in docs.collect())
    at, wanted = 0, []
    for i, text in texts:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [2], "<u4")
        wanted.append((None if i == work.NO_ID else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in rows), key=key) == sorted(wanted, key=key)
    one = token_files.read_ids(spark, path, [11])
    assert one.count() == 1 and "doc_id" in one._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    token_files.write_ids(empty(spark), str(tmp_path / "none"), TOKENIZER)
    assert token_files.digests(token_files.read_ids(spark, str(tmp_path / "none"))).count() == 0


# --- toxicity -----------------------------------------------------------------


def test_gradients_are_right():
    draw = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in net.new_params(4, draw, 3).items()}
    x, goal = draw.standard_normal((5, 6, 4)), np.array([0, 1, 1, 0, 1, 0.0])
    mask = (np.arange(5)[:, None] < np.array([5, 3, 1, 5, 2, 4])).astype(float)
    grads = net.gradients(x, mask, goal, params)[0]
    for name, value in params.items():
        at = tuple(s // 2 for s in value.shape)
        loss = []
        for step in (1e-4, -1e-4):
            changed = params | {name: value.copy()}
            changed[name][at] += step
            loss.append(net.gradients(x, mask, goal, changed)[2])
        assert abs((loss[0] - loss[1]) / 2e-4 - grads[name][at]) < 1e-4, name


def test_windows_cover_every_word():
    doc = np.repeat([0, 2, 3], [5, 100, 32])
    start, size, owner = toxicity.windows_of(doc, 5)
    seen = np.concatenate([np.arange(a, a + k) for a, k in zip(start, size, strict=True)])
    assert {*seen} == {*range(len(doc))} and all((doc[a : a + k] == o).all() for a, k, o in zip(start, size, owner, strict=True))
    assert sorted(set(owner)) == [0, 1, 2, 3, 4]


def test_toxicity_on_held_out_labels(spark, edges):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = catalog.documents(spark, sf).join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.train(*toxicity.training_texts(docs, labels))
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 500 and right >= 0.95 * len(rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    marked = toxicity.scored(edges, model).collect()
    assert len(marked) == edges.count() and len({r["score"] for r in marked if r["doc_id"] in (4, 5)}) == 1
    assert toxicity.scored(empty(spark), model).count() == 0
    none = toxicity.toxicity(edges, spark.createDataFrame([(1, 0), (None, 1)], "doc_id bigint, toxic int")).collect()
    assert {r["score"] for r in none} == {0.0}


# --- repeated runs ------------------------------------------------------------


def test_later_repeats_are_cut(spark, edges):
    cut = repeated_runs.remove_repeated_runs(edges, removed="gone")
    rows = {}
    for r in cut.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    before = {r[0]: r[1] for r in edge_rows()}
    assert len(rows[2]) == 2 and rows[2][0]["text"] == rows[2][1]["text"] == before[2]
    assert rows[0][0]["text"] == before[0] and rows[1][0]["text"] == "" and rows[5][0]["text"] is None
    assert "passage30" in rows[10][0]["text"] and not any(f"passage{i} " in rows[11][0]["text"] for i in range(11, 66))
    assert prose(6, 50).rsplit(" ", 2)[0] in rows[11][0]["text"]
    assert rows[12][0]["text"] == before[12] and rows[None][0]["text"] == prose(8, 30)
    for r in itertools.chain.from_iterable(rows.values()):
        assert r["gone"] == len(brute.WORD.findall(before[r["doc_id"]] or "")) - len(brute.WORD.findall(r["text"] or ""))
    assert repeated_runs.remove_repeated_runs(empty(spark)).count() == 0


def test_every_repeated_run_of_two_grams_is_found(spark, small):
    """Against all grams of all earlier texts: what remains twice is shorter than the guarantee."""
    cut = {r["doc_id"]: r["text"] for r in repeated_runs.remove_repeated_runs(catalog.documents(spark, SF)).collect()}
    seen = set()
    for i in sorted(cut):
        own = set()
        lines = [[m[0] for m in line] for line in brute.lines_of(cut[i])]
        for a in range(len(lines)):
            run = []
            for line in lines[a:]:
                run += line
                if len(run) >= 60:
                    own.add(tuple(run))
                    break
        assert not own & seen
        seen |= own
    assert sum(cut[i] != small[i] for i in cut) > 0


def test_lines_of_stored_texts_are_held_a_slice_at_a_time():
    texts = pa.array([prose(i, 300) for i in range(900)] + ["", "short"])
    block = pa.RecordBatch.from_arrays([pa.array(range(902)), pa.array(range(902)), texts], ["doc_id", "version", "text"])
    (rows,) = pa.Table.from_batches(repeated_runs._survey([block])).combine_chunks().to_batches()
    lines = repeated_runs.Lines(texts)
    parts = [repeated_runs.Stored(x.column("hashes"), x.column("sizes")) for x in repeated_runs._slices([rows], "hashes")]
    assert sum(len(part.counts) for part in parts) == 902 and np.array_equal(np.concatenate([part.counts for part in parts]), lines.counts)
    assert max(len(part.row) for part in parts) < 80_000 < len(lines.sizes)
    start, _, value, forward = lines.grams()
    stored = {(i, v) for part, base in zip(parts, np.cumsum([0] + [len(x.counts) for x in parts]), strict=False) for i, v in zip((part.owner + base).tolist(), part.value.tolist(), strict=True)}
    assert stored == {(i, v) for i, v in zip(lines.doc[start].tolist(), value.tolist(), strict=True)}


def test_blocks_leave_nothing_behind():
    """When a block of texts is done, a worker holds its caches and no array of that block any more."""
    texts = [prose(200 + i, 9000) for i in range(8)]
    columns = [pa.array(range(8)), pa.array(texts), pa.array([0] * 8)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "version"])
    for run in (repeated_runs._survey, pieces._checked(MODEL, 3)):
        for _ in range(2):  # the first time fills caches
            held = []

            def given(held=held):
                for _ in range(2):
                    held.append(tracemalloc.get_traced_memory()[0])
                    yield batch

            tracemalloc.start()
            rows = run(given())
            while next(rows, None) is not None:
                pass
            tracemalloc.stop()
        assert held[1] - held[0] < 0.1 * batch.nbytes, held


def test_a_waiting_worker_holds_little():
    """Kept chunks are arrays without an object for each, and powers go with their batch."""
    words = [f"{random.Random(i).getrandbits(60):x}" for i in range(20_000)]
    own = pieces.Segmenter(pieces.load(MODEL), 3)
    own.segment("some words before")
    tracemalloc.start()
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(words)])], ["text"])
    arrow = pa.total_allocated_bytes()
    for block in blocks.text_blocks([texts]):
        own.segment_all(block.column("text"))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert not blocks._powers
    assert held < 300 * len(words), held / len(words)


def test_chunks_with_equal_keys_are_not_mixed_up():
    own = pieces.Segmenter(pieces.load(MODEL), 3)
    chunks = pa.array(["some", "other", "words"], pa.large_string())
    assert sorted(own.learn(chunks, np.array([7, 5, 7], np.uint64)).tolist()) == [0, 1, 2]
    asked = pa.array(["other", "else", "words", "some"], pa.large_string())
    found = own.look_up(asked, np.array([5, 5, 9, 7], np.uint64)).tolist()
    assert own.known[found[0]].as_py() == "other" and found[1:3] == [-1, -1]
    assert found[3] == -1 or own.known[found[3]].as_py() == "some"


def test_texts_without_repeats_are_not_shuffled(spark):
    rows = [(i, prose(400 + i, 60)) for i in range(1, 41)] + [(None, prose(401, 60)), (50, None), (51, prose(402, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    some, rest = repeated_runs._parted(docs, repeated_runs.repeated_lines(docs))
    assert {r["doc_id"] for r in some.collect()} == {1, 51}  # a missing id is the least
    assert rest.count() == len(rows) - 2
    cut = {r["doc_id"]: r["text"] for r in repeated_runs.remove_repeated_runs(docs).collect()}
    assert cut == dict(rows) | {1: "", 51: ""}


def test_lines_are_found_once(monkeypatch):
    """A block's grams are hashed once, and the cutter takes the lines that the survey stored."""
    calls, grams = [], repeated_runs.Lines.grams
    monkeypatch.setattr(repeated_runs.Lines, "grams", lambda self: calls.append(1) or grams(self))
    text = PASSAGE + " and\nmore words. " + PASSAGE
    block = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "x y"]), pa.array([0, 0])], ["doc_id", "text", "version"])
    (found,) = repeated_runs._survey([block])
    assert len(calls) == 1
    monkeypatch.setattr(repeated_runs, "Lines", None)
    marks = [pa.array([found.column("own")[0].as_py(), None], pa.list_(pa.int32())), found.column("sizes")]
    (cut,) = repeated_runs._cutter(30)([pa.RecordBatch.from_arrays([*block.columns, *marks], [*block.schema.names, "__lines", "__sizes"])])
    assert cut.column("text").to_pylist() == [PASSAGE + " and\nmore words. ", "x y"] and cut.column("__removed").to_pylist() == [66, 0]


def test_later_rounds_merge_only_texts_that_go_on(spark, monkeypatch):
    """Texts with a repeat of their own are merged once, whatever number of rounds others take."""
    stored, written = [], repeated_runs.work.written

    def spy(frame, name):
        out = written(frame, name)
        stored.extend([out.count()] if name == "found" else [])
        return out

    monkeypatch.setattr(repeated_runs.work, "written", spy)
    draw = random.Random(3)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(n)) + " "
    rows = [(i, prose(500 + i, 40) + ". " + prose(500 + i, 40)) for i in range(60)]
    for k in range(100, 200, 10):  # a passage in the last two, parts of it in those before
        parts = [words(14) for _ in range(5)]
        rows += [(k + j, words(9) + part + words(9)) for j, part in enumerate(parts)]
        rows += [(k + j, words(20) + "".join(parts) + words(20)) for j in (5, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = {r["doc_id"]: r["text"] for r in repeated_runs.remove_repeated_runs(docs).collect()}
    assert len(stored) > 1 and stored[0] >= 60 and max(stored[1:]) <= 20, stored
    assert all(len(cut[i].split(" ")) < 60 for i in range(60)) and all(cut[k + 5] == dict(rows)[k + 5] for k in range(100, 200, 10))
    assert all(len(cut[k + 6].split(" ")) < 56 for k in range(100, 200, 10))


def test_equal_rows_with_a_repeat_of_their_own_stay_as_many(spark):
    text = PASSAGE + ". " + PASSAGE
    docs = spark.createDataFrame([(1, text), (1, text), (2, prose(12, 50))], "doc_id bigint, text string")
    cut = repeated_runs.remove_repeated_runs(docs).collect()
    assert sorted(r["doc_id"] for r in cut) == [1, 1, 2]
    (left,) = {r["text"] for r in cut if r["doc_id"] == 1}
    assert len(left) < len(text) * 0.6


def test_a_filter_of_few_values_is_small_and_lets_all_of_them_through(spark):
    draw = np.random.default_rng(5)
    for n in (0, 1, 300):
        values = draw.integers(-(2**63), 2**63, n)
        bits = repeated_runs.Some(spark.createDataFrame([(int(x),) for x in values], "value bigint"), "value").bits.value
        assert bits.nbytes <= 64 * n + 64 and repeated_runs.passed(bits, values).all()
        assert repeated_runs.passed(bits, draw.integers(-(2**63), 2**63, 10_000)).mean() < 0.02


def test_grams_are_made_at_the_pairs_of_lines_sought():
    texts = pa.array([prose(i, n) for i, n in enumerate((200, 0, 5, 9, 40, 1, 300))] + ["a. " * 30, ""])
    block = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts, pa.array([0] * len(texts))], ["doc_id", "text", "version"])
    (rows,) = repeated_runs._survey([block])
    whole = repeated_runs.Stored(rows.column("hashes"), rows.column("sizes"))
    wanted = sorted(zip(blocks.signed(whole.value).tolist(), whole.owner.tolist(), strict=True))
    every = np.full(2 ** (repeated_runs.FILTER_BITS - 6), 2**64 - 1, np.uint64)
    value, row = repeated_runs.grams_at(rows.column("hashes"), rows.column("sizes"), every)
    assert sorted(zip(value.tolist(), row.tolist(), strict=True)) == wanted and len(wanted) > 100
    pairs = repeated_runs.line_pairs(whole.flat)
    for gram in (0, whole.forward // 2, whole.forward, len(whole.value) - 1):  # the first two forward, the others backward
        pair = int(pairs[whole.start[gram] if gram < whole.forward else whole.end[gram] - 2]) & (2**repeated_runs.FILTER_BITS - 1)
        some = np.zeros_like(every)
        some[pair >> 6] = np.uint64(1) << np.uint64(pair & 63)
        value, row = repeated_runs.grams_at(rows.column("hashes"), rows.column("sizes"), some)
        assert (blocks.signed(whole.value)[gram], whole.owner[gram]) in set(zip(value.tolist(), row.tolist(), strict=True))
        assert len(value) < len(wanted) / 4


def test_fingerprints_hold_the_least_gram_of_each_window():
    lines = repeated_runs.Lines(pa.array([prose(9, 300), "", prose(10, 17), "short"]))
    start, end, value, forward = lines.grams()
    prints, owner = lines.fingerprints()
    picked = set(prints.tolist())
    for a in range(forward):
        window = [x for x in range(a, min(forward, a + repeated_runs.WINDOW)) if lines.doc[start[x]] == lines.doc[start[a]]]
        least = min(value[window])
        assert least in picked
        picked_here = {value[x] for x in window} & picked
        assert least == min(picked_here)
    wanted = {min(value[x] for x in range(a, min(forward, a + repeated_runs.WINDOW)) if lines.doc[start[x]] == lines.doc[start[a]]) for a in range(forward)}
    assert picked == wanted and len(picked) < 0.6 * forward  # window minima and nothing else
    for a, b in zip(start, end, strict=True):
        assert lines.sizes[a:b].sum() >= repeated_runs.GRAM_WORDS and lines.doc[a] == lines.doc[b - 1]


def test_single_lines_and_passages_in_long_lines_are_found(spark):
    draw = random.Random(61)
    words = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(12)) for _ in range(n))
    texts, shared = {}, {}
    for k in range(60):  # one sentence of 51 words between others, then 51 words inside a line without a stop
        passage = words(51)
        for side in (0, 1):
            i = 2 * k + side
            near = ". " if k < 40 else " "
            texts[i] = f"{words(20)}. {words(20)}{near}{passage}{near}{words(20)}. {words(20)}."
            shared[i] = passage.split(" ")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    cut = {r["doc_id"]: r["text"] for r in repeated_runs.remove_repeated_runs(docs).collect()}
    for i, text in cut.items():
        left = set(text.replace(".", "").split(" ")) & {*shared[i]}
        assert (text == texts[i]) if i % 2 == 0 else len(left) <= (0 if i < 80 else 4 * (repeated_runs.BREAK_WINDOW - 1)), i


def test_a_part_shared_with_one_and_the_rest_with_another_is_found(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) + ". " for x, n in (("a", 10), ("b", 20), ("c", 5)))
    texts = [(1, a + b + "other end here."), (2, a + b + c), (3, "some start. " + a + b + c + "and the tail.")]
    rows = repeated_runs.remove_repeated_runs(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows}[3] == "some start. and the tail."


def plain_grams(lines):
    """(first line, end, words, whether forward) of the shortest runs of enough words from and up to each line."""
    n, out = repeated_runs.GRAM_WORDS, []
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            words = sum(lines[a:b], ())
            if len(words) >= n:
                out.append((a, b, words, True))
                break
        for b in range(a, -1, -1):
            words = sum(lines[b : a + 1], ())
            if len(words) >= n:
                out.append((b, a + 1, words, False))
                break
    return out


def test_lines_that_go_are_those_of_earlier_grams(spark, small):
    """Against the grams of each earlier text: nothing else goes, and every run of enough words is found."""
    found = {r["doc_id"]: {*r["lines"]} for r in repeated_runs.repeated_lines(catalog.documents(spark, SF)).collect()}
    before, runs = {}, 0
    for i in sorted(small):
        own = repeated_runs.Lines(pa.array([small[i]], pa.string()))
        words = brute.WORD.findall(small[i] or "")
        lines = [tuple(words[a:b]) for a, b in zip(own.first, own.last, strict=True)]
        assert all(len(line) < 2 * repeated_runs.BREAK_WINDOW for line in lines)
        grams, earlier, here = plain_grams(lines), set(), set()
        for a, b, text, forward in sorted(grams, key=lambda g: g[:2]):
            if (text, forward) in here:
                earlier.update(range(a, b))
            here.add((text, forward))
        for other, theirs in before.values():
            for a, b, text, _ in grams:
                if text not in theirs:
                    continue
                earlier.update(range(a, b))
                for at in theirs[text]:  # as far as the lines agree, both ways
                    low, high = 0, 0
                    while low < min(a, at) and lines[a - low - 1] == other[at - low - 1]:
                        low += 1
                    while a + high < len(lines) and at + high < len(other) and lines[a + high] == other[at + high]:
                        high += 1
                    if sum(map(len, lines[a - low : a + high])) >= repeated_runs.MIN_WORDS:
                        assert {*range(a - low, a + high)} <= found[i]
                        runs += 1
        assert found.get(i, set()) <= earlier
        where = {}
        for a, _, text, _ in grams:
            where.setdefault(text, set()).add(a)
        before[i] = lines, where
    assert runs > 5


@pytest.mark.parametrize("length", [38, 51, 80])
def test_runs_between_changed_words_are_found_whatever_text_has_them(spark, length):
    """A passage that lies whole in one earlier text, while texts before it share parts of it alone."""
    draw = random.Random(length)
    words = lambda n: ["".join(draw.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    rows, passages = [], {}
    for k in range(30):
        passage = words(length)
        for j in range(3):  # parts, which the fingerprints may lead to first
            at = draw.randrange(length - 14)
            rows.append((10 * k + j, " ".join(words(9) + passage[at : at + 14] + words(9))))
        rows.append((10 * k + 5, " ".join(words(20) + passage + words(20))))
        rows.append((10 * k + 6, " ".join(words(25) + passage + words(15))))
        passages[10 * k + 6] = passage
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = {r["doc_id"]: r["text"] for r in repeated_runs.remove_repeated_runs(docs).collect()}
    whole = dict(rows)
    for i, text in cut.items():
        if i not in passages:
            assert text == whole[i]
            continue
        left = {*text.split(" ")} & {*passages[i]}
        assert len(left) <= 2 * repeated_runs.BREAK_WINDOW - 1 and len(text.split(" ")) >= 40


# --- personal data ------------------------------------------------------------


def test_base_spans_equal_the_plain_patterns(spark, edges):
    odd = ["a@b.c_d@e.f", "x@y_z@q.r", "1.2.3.4.5.6.7.8", "+1+1 234 567 890", "4539  1488 0343 6467", "45391488034364670000", "+1 ((((", "é +49 30 1234567."]
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 100)), "doc_id bigint, text string"))
    docs = docs.union(catalog.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text"))
    texts = docs.collect()
    rows = personal_data.personal_data(docs).collect()
    found = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows)
    assert found == sorted((i or -1, *brute.base_row(t)) for i, t in texts)
    assert personal_data.personal_data(empty(spark)).count() == 0


def test_classifier_adds_what_the_patterns_miss(spark):
    texts = [f"mail me{i}@mail.example.com or phone +1 (30{i % 10}) 555-1234 now" for i in range(60)]
    texts += ["please call 212-555-0199 today", "contact bob (at) example (dot) com please", "version 212-555-0199x"]
    rows = {r["doc_id"]: r for r in personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows[60]["spans"] == "phone:12:24" and rows[61]["spans"] == "email:8:34" and rows[62]["spans"] == ""


def test_candidates_equal_plain_loops(spark):
    draw = random.Random(5)
    parts = ["a@b.co", " ", "x", "1.2.3.4", "4111 1111 1111 1111", "+49 (0) 1234 56789", ",", "\n", "bob [at] site dot com", "bob (at) site (dot) com"]
    parts += ["555-123-4567", "1:2:3:4:5:6:7:8", " phone ", " order ", "\U0001f600", "999999999999", " \u00e9 ", "y" * 70 + "@" + "z" * 80 + ".museum"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 3, 10, 60]))) for _ in range(300)]
    texts += ["".join(draw.choice(parts) for _ in range(6000)), "w" * 90 + " (at) " + "v" * 70 + " (dot) " + "u" * 30, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    columns = ("kind", "start", "end", "base", "context", "before", "after")
    rows = {r["doc_id"]: sorted(tuple(x[c] for c in columns) for x in r["spans"]) for r in personal_data.candidates(docs).collect()}
    for i, text in enumerate(texts):
        want = brute.candidate_rows(text, personal_data.LOOSE, personal_data.CUES, personal_data.COUNTER_CUES, personal_data.CONTEXT)
        assert rows[i] == want, (i, [x for x in zip(rows[i], want) if x[0] != x[1]][:3])


def test_a_text_of_very_many_addresses(spark):
    n = 60_000
    text = " ".join(f"name{i}@site{i}.com" for i in range(n))
    begun = time.monotonic()
    row = personal_data.personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row["n_email"], row["n_added"]) == (n, 0) and row["base_sha256"] == brute.base_row(text)[-1]
    assert time.monotonic() - begun < 120


# --- syncmers -----------------------------------------------------------------


def test_syncmers_are_chosen_by_their_edges():
    text = prose(11, 80).encode()
    data, offsets = blocks.utf8(pa.array([text.decode(), "short", prose(12, 60)]))
    at, _, doc = syncmers.syncmers(data, offsets)
    hasher = blocks.Hasher(data)
    found = set(at[doc == 0].tolist())
    for i in range(len(text) - syncmers.K + 1):
        inner = [int(hasher(np.array([j]), np.array([j + syncmers.S]))[0]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        assert (i in found) == (min(inner) in (inner[0], inner[-1]))
    assert not (doc == 1).any()


def test_compare_with_next(spark, edges):
    rows = {}
    for r in syncmers.compare_with_next(edges).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    ordered = sorted(((work.NO_ID if i is None else i), t or "") for i, t, *_ in edge_rows())
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = hashlib.sha256(syncmers.edited_text(text, following).encode()).hexdigest()
        own = rows[None if i == work.NO_ID else i]
        assert any(r["edited_sha256"] == edited and r["n_chars"] == len(text) for r in own)
    assert rows[0][0]["fingerprint"] == rows[1][0]["fingerprint"] and rows[0][0]["near_next"] == 1.0
    assert rows[2][0]["near_edited"] > 0.4 and rows[7][0]["near_next"] == 0.0 and rows[4][0]["near_next"] == 1.0
    one = syncmers.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abca").hexdigest() and one[0]["near_next"] == 1.0
    assert syncmers.compare_with_next(empty(spark)).count() == 0


def test_likeness_follows_edits_that_shift():
    draw = random.Random(71)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda new, j: max(new, row[j + 1], row[j] + (x == b[j])), initial=0))  # noqa: B023
        assert syncmers.chain(np.array(a, np.uint64), np.array(b, np.uint64)) == row[-1]
    for seed in range(72, 82):
        words = prose(seed, 300).split(" ")
        changed = [w + "longer" if i in (60, 150, 240) else w for i, w in enumerate(words)]
        one, other = syncmers.fingerprints(pa.array([" ".join(words), " ".join(changed)]))
        assert syncmers.likeness(one, other) >= len(np.intersect1d(one[0], other[0])) / len(np.union1d(one[0], other[0])) - 0.05


def test_fingerprints_cover_long_texts():
    passage, far = prose(81, 100), prose(82, 30_000)
    texts = [passage + " " + far, prose(83, 30_000) + " " + passage, far + " \n" + "x" * 2000 + prose(84, 9)]
    one, other, third = prints = syncmers.fingerprints(pa.array(texts))
    shared = len(syncmers.fingerprints(pa.array([passage]))[0][0])
    assert syncmers.likeness(one, other) >= 0.9 * shared / (len(one[0]) + len(other[0])) > 0
    assert syncmers.likeness(one, third) > 0.9
    for value, at in prints:
        rows = np.frombuffer(base64.b64decode(syncmers.as_text((value, at))), np.uint8).reshape(-1, 6)
        place = np.cumsum(rows[:, 5].astype(np.int64))
        own = rows[:, 5] < 255
        coded = (rows[own, :5].astype(np.uint64) << np.array([32, 24, 16, 8, 0], np.uint64)).sum(axis=1, dtype=np.uint64)
        assert (coded == value).all() and (place[own] == at).all()
    gaps = base64.b64decode(syncmers.as_text((np.array([7, 8], np.uint64), np.array([600, 855]))))
    assert gaps == bytes([0] * 5 + [255]) * 2 + bytes([0] * 4 + [7, 90]) + bytes([0] * 5 + [255]) + bytes([0] * 4 + [8, 0])


# --- quality, mixing, sharding ------------------------------------------------


def test_quality_statistics_equal_brute_force(spark, edges):
    docs = edges.select("doc_id", "text").union(catalog.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text"))
    rows = quality.judged(docs).collect()
    found = sorted((r["doc_id"] or -1, *(r[c] for c in quality.STATS), r["base_failed"]) for r in rows)
    assert found == sorted((r["doc_id"] or -1, *brute.quality_row(r["text"])) for r in docs.collect())
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.judged(empty(spark)).count() == 0 and quality.kept_documents(empty(spark)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.1"
    docs = catalog.documents(spark, sf)
    rows = quality.judged(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert quality.kept_documents(docs).columns == docs.columns


def test_raking_meets_the_targets(spark):
    cells = [(f"s{i}", f"l{j}", f"t{k}", 10 + (i * 7 + j * 5 + k * 3) % 11) for i in range(3) for j in range(2) for k in range(2)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"s0": 5, "s1": 3, "s2": 2}, "lang": {"l0": 1, "l1": 1}, "topic": {"t0": 0.3, "t1": 0.7}}
    weight = {c[:3]: float(c[3]) for c in cells}
    for _ in range(200):
        for d, name in enumerate(mixing.DIMENSIONS):
            total = {v: sum(w for c, w in weight.items() if c[d] == v) for v in targets[name]}
            weight = {c: w * targets[name][c[d]] / sum(targets[name].values()) / total[c[d]] for c, w in weight.items()}
    rows = mixing.raked(frame, targets).collect()
    assert all(abs(r["weight"] - weight[r["source"], r["lang"], r["topic"]]) < 1e-5 for r in rows) and len(rows) == len(cells)


def test_mixing_decisions(spark, edges):
    rows = mixing.sampled(edges, all_rows=True).collect()
    assert len(rows) == edges.count() and max(r["probability"] for r in rows) <= 1 + 1e-9
    for r in rows:
        digest = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        assert r["drawn"] == (int(digest[:12], 16) / 2**48 < r["probability"])
    kept = mixing.sampled(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r["drawn"] for r in rows)
    assert mixing.sampled(empty(spark)).count() == 0


def test_mixing_draws_a_share_of_all_tokens(spark):
    """The share is met at every size and by every cell's goal, and a rare cell that is much sought comes several times."""
    for sf in ("sf0.01", "sf0.1"):
        rows = mixing.sampled(catalog.documents(spark, f"/root/testdata/{sf}"), all_rows=True, share=0.5)
        rest = F.col("probability") - F.floor("probability")
        kept, hoped, tokens, variance = rows.where("tokens > 0").agg(
            F.sum(F.col("tokens") * F.col("draws")), F.sum(F.col("tokens") * F.col("probability")),
            F.sum("tokens"), F.sum(F.col("tokens") * F.col("tokens") * rest * (1 - rest)),
        ).first()
        assert abs(hoped / tokens - 0.5) < 1e-6 and abs(kept - hoped) < 3 * variance**0.5, (sf, kept, hoped, variance**0.5)
    cells = [(i, "word " * 20, "en", "common", 5) for i in range(900)] + [(i, "word " * 20, "de", "rare", 5) for i in range(900, 1000)]
    docs = spark.createDataFrame(cells, SCHEMA)
    even = {"source": {"common": 1, "rare": 1}, "lang": {"en": 1, "de": 1}, "topic": {"prose": 1}}
    drawn = mixing.sampled(docs, even, share=0.5).groupBy("source", "doc_id").count().collect()
    times = {s: [r["count"] for r in drawn if r["source"] == s] for s in ("common", "rare")}
    assert {*times["rare"]} == {2, 3} and {*times["common"]} == {1} and len(times["rare"]) == 100
    assert abs(sum(times["rare"]) / 250 - 1) < 0.1 and abs(sum(times["common"]) / 250 - 1) < 0.15


def test_mixing_draws_a_share_with_no_document_twice(spark):
    cells = [("a", "en", "t", 100, 0.5), ("b", "en", "t", 300, 0.3), ("c", "en", "t", 1000, 0.15), ("d", "en", "t", 3000, 0.05)]
    wanted = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint, weight double").withColumn("rate", F.expr("weight / tokens"))
    for tokens in (50.0, 400.0, 1500.0, 4300.0):
        scale = mixing._capped_scale(wanted, tokens, tokens)
        assert abs(sum(n * min(1, scale * w / n) for *_, n, w in cells) - tokens) < 1e-6 * tokens
    docs = catalog.documents(spark, "/root/testdata/sf0.01")
    rows = mixing.sampled(docs, all_rows=True, share=0.5, once=True).where("tokens > 0")
    hoped, tokens, most = rows.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens"), F.max("draws")).first()
    assert abs(hoped / tokens - 0.5) < 1e-6 and most == 1


def test_mixing_decisions_look_at_each_text_once(spark):
    """Topics and tokens come from what the first pass stored; the documents are not read again."""
    rows = mixing.sampled(catalog.documents(spark, SF), all_rows=True, share=0.5)
    assert rows.inputFiles() and not any("documents.parquet" in f for f in rows.inputFiles())


def test_mixing_and_placement_keep_columns_of_any_name(spark, edges, tmp_path):
    extra = {c: F.lit(c) for c in ("topic", "tokens", "probability", "draws", "draw", "row", "slot", "__topic", "__slot", "__shard", "a.b")}
    docs = edges.withColumns(extra | {"kept": F.create_map(F.lit("k"), F.lit(1))})
    assert mixing.sampled(docs, share=1.0).columns == docs.columns
    plain = {(r["doc_id"], r["draws"]) for r in mixing.sampled(edges, all_rows=True, share=1.0).collect()}
    assert {(r["doc_id"], r["draws"]) for r in mixing.sampled(docs, all_rows=True, share=1.0).collect()} == plain
    assert mixing.sampled(empty(spark), share=1.0).count() == 0
    placed = sharding.place(docs)
    assert placed.columns == [*(c for c in docs.columns if c != "shard"), "shard"] and placed.where("slot = 'slot'").count() == edges.count()
    sharding.write_shards(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == edges.count()


def test_lookup_table_is_even_and_stable():
    table = sharding.lookup_table(sharding.SHARDS)
    counts = np.bincount(table)
    assert len(table) == sharding.SLOTS and counts.max() - counts.min() <= 1
    names = [sharding.SHARDS[i] for i in table]
    less = [sharding.SHARDS[1:][i] for i in sharding.lookup_table(sharding.SHARDS[1:])]
    moved = sum(a != b for a, b in zip(names, less, strict=True) if a != sharding.SHARDS[0])
    assert moved < 0.08 * len(table)
    # the definition, turn by turn
    small, want = ("a", "b", "c"), [None] * 7
    orders = {n: [(int(hashlib.md5(n.encode()).hexdigest()[:8], 16) + j * (int(hashlib.md5(n.encode()).hexdigest()[8:16], 16) % 6 + 1)) % 7 for j in range(7)] for n in small}
    while None in want:
        for n in small:
            free = [s for s in orders[n] if want[s] is None]
            if free:
                want[free[0]] = n
    assert [small[i] for i in sharding.lookup_table(small, 7)] == want
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 8)


def test_placement(spark, duck, edges, tmp_path):
    placed = sharding.place(edges)
    assert placed.count() == edges.count() and {*placed.columns} == {*edges.columns}
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "hashpartitioning" not in plan
    sharding.write_shards(edges, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == edges.count()
    connection = duck("sf0.01")
    connection.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    wanted = connection.execute(catalog.oracle_sql()["op10_sharding"]).fetchall()
    found = catalog.op10_sharding(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


# --- pipeline -----------------------------------------------------------------


def test_pipeline_stages_pass_on_what_they_keep(spark, edges):
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = work.written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    assert all(r["round_trip"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = work.written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_pipeline_keeps_one_of_each_and_no_long_repeat(spark):
    docs = catalog.documents(spark, "/root/testdata/sf0.01")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    kept = work.written(kept, "kept")
    cut = work.written(corpus_pipeline.line_dedup(spark, kept, SF), "cut")
    assert cut.count() == kept.count() and cut.where(F.length("text") != F.col("n_chars")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cut, SF).collect()}
    classes = brute.classes(dict(list(texts.items())[:250]))
    part = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, cut.where(F.col("doc_id").isin(*classes)), SF).collect()}
    assert part == {*classes.values()} and left <= {*texts}


def test_pipeline_passes_on_one_emptied_copy(spark):
    passage = prose(51, 300)
    texts = [(i, passage) for i in range(40)] + [(50, None), (51, " \n"), (52, " \n"), (53, prose(52, 100)), (None, " \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = work.written(stage(spark, docs, SF), name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not (r["text"] or "").strip()]
    assert sorted(rows, key=str) == [(1, ""), (None, " \n")]
    assert near_duplicates.one_wordless_of_each(empty(spark)).count() == 0


def test_registered():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names if n[2].isdigit()] == [f"op{i}" for i in range(1, 14)] and "pipeline" in entry_points.queries()


def test_links_of_a_block_are_fewer_than_its_members():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 60, replace=False).astype(np.int64)
    bags, n = [], 40
    for i in range(n):  # neighbours differ by one item, so all are linked over chains
        bag = base.copy()
        bag[: i % 7] += 10**7 + i
        bags.append(bag)
    table = pa.table(
        {
            "key": [1] * n, "low": [0] * n, "high": [0] * n, "band": [0] * n, "doc_id": list(range(n)),
            "n_shingles": [60] * n, "class": list(range(n)), "part": [0] * n, "sketch": [bytes(512)] * n,
            "bag": [b.tolist() for b in bags],
        }
    )
    run = near_duplicates._grouped(near_duplicates._forest, 0.8, 8, 64)
    links = [tuple(r.values()) for b in run(table.to_batches(max_chunksize=7)) for r in b.to_pylist()]
    linked = [(i, j) for i in range(n) for j in range(i) if len({*bags[i]} & {*bags[j]}) >= 0.8 * len({*bags[i]} | {*bags[j]})]
    assert len(linked) > n and set(links) <= {(j, i) for i, j in linked}
    label = list(range(n))

    def top(i):
        return i if label[i] == i else top(label[i])

    for i, j in linked:
        label[top(i)] = top(j)
    classes = len({top(i) for i in range(n)})
    assert len(links) == n - classes


def test_rows_of_large_keys_are_looked_up(spark):
    rows = work.written(spark.range(300).selectExpr("id as doc_id", "if(id < 250, 'a', concat('b', id)) as copy"), "rows")
    table = rows.where("doc_id <> 299").groupBy("copy").agg(F.count("*").alias("n"), F.min("doc_id").alias("head"))
    found = near_duplicates._looked_up(rows, work.written(table, "table"), "copy", "n").collect()
    assert sorted((r["doc_id"], r["head"]) for r in found) == [(i, None if i == 299 else 0 if i < 250 else i) for i in range(300)]
