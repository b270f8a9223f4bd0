"""Importance resampling, the quality classifier and the Merkle manifest against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.llm import catalog, checksums, classifier, manifest, resampling
from tests.compare import differences
from tests.conftest import TESTDATA
from tests.llm import plain
from tests.llm.test_llm import SCHEMA, SF, edge_rows, empty

CLASHES = ("n_features", "buckets", "weight", "score", "rank", "place", "places", "values", "segment", "part", "tree", "digest", "claim", "position", "total", "block", "held_out", "quality")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def views(duck):
    connection = duck("sf0.01")
    for name in ("documents", "benchmark", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/sf0.01/{name}.parquet'")
    return connection


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, views, name):
    frame = catalog.queries()[name](spark, f"{TESTDATA}/sf0.01")
    assert differences(frame, views.execute(catalog.oracle_sql()[name])) == ""


def test_checksums_of_spans():
    draw = random.Random(3)
    spans = [bytes(draw.randrange(256) for _ in range(draw.choice((0, 1, 3, 8, 39, 40, 41, 500)))) for _ in range(300)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    assert checksums.crc32(data, starts, ends).tolist() == [zlib.crc32(s) for s in spans]
    half = (starts + ends) // 2
    assert (~checksums.registers(data, half, ends, checksums.registers(data, starts, half))).tolist() == [zlib.crc32(s) for s in spans]
    assert len(checksums.crc32(data, starts[:0], ends[:0])) == 0


# --- importance resampling ----------------------------------------------------


def test_resampling_over_edge_cases(spark, edges):
    target = spark.createDataFrame([("a same line here two words",), (None,), ("",)], "text string")
    wanted = plain.resampled([(r[0], r[1]) for r in edge_rows()], ["a same line here two words", None, ""])
    assert rows_of(resampling.resampled(edges, target)) == wanted
    assert resampling.resampled(empty(spark), target).count() == 0
    nothing = plain.resampled([(r[0], r[1]) for r in edge_rows()], [])
    assert rows_of(resampling.resampled(edges, target.limit(0))) == nothing


def test_drawn_documents_keep_their_columns(spark, edges):
    target = spark.createDataFrame([("words",)], "text string")
    chosen = {r["doc_id"] for r in resampling.resampled(edges, target, percent=50).collect() if r["rank"]}
    found = resampling.drawn_documents(edges, target, percent=50)
    assert found.columns == edges.columns and {r["doc_id"] for r in found.collect()} == chosen - {None} and len(chosen) > 3


@pytest.mark.parametrize("kind", ["spread", "one key", "few keys", "falling"])
def test_ranks_are_exact_whatever_the_keys(spark, kind):
    draw, n = random.Random(9), 6000
    first = {"spread": lambda i: draw.randrange(10**9), "one key": lambda i: 7, "few keys": lambda i: draw.randrange(3), "falling": lambda i: -i}[kind]
    rows = [(first(i), draw.randrange(5), i) for i in range(n)]
    frame = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").repartition(5)
    found = resampling.with_ranks(frame, ["a", "b"]).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, n + 1)) and {r["n_rows"] for r in found} == {n}
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["rank"])] == sorted(r[:2] for r in rows)


def test_equal_keys_are_split_between_segments(spark, monkeypatch):
    """A third and more of all rows with one key must not meet in one segment."""
    frame = spark.range(8000).select(F.lit(1).alias("a"), "id").repartition(4)
    seen = {}
    written = resampling.work.written

    def spy(rows, name):
        seen[name] = written(rows, name)
        return seen[name]

    monkeypatch.setattr(resampling.work, "written", spy)
    resampling.with_ranks(frame, ["a"]).count()
    sizes = [r["count"] for r in seen["segments"].groupBy("segment").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 8000 / len(sizes)


# --- quality classifier -------------------------------------------------------


def test_scores_equal_a_plain_loop():
    draw = np.random.default_rng(1)
    model = classifier.Model(draw.standard_normal(1 << 12).astype(np.float32), 0.25)
    texts = [r[1] for r in edge_rows()] + ["THE!! the!! The ", "é É é", "a a a b a b", "x" * 3000 + " " + "y " * 3000]
    found = model.score(pa.array(texts, pa.string()))
    assert np.allclose(found, [plain.chance(t, model.weights.astype(float), 0.25) for t in texts], atol=1e-5)
    assert len(model.score(pa.array([], pa.string()))) == 0


def test_training_follows_the_rule():
    draw = random.Random(4)
    rows = [(np.array(sorted(draw.sample(range(60), 8)), np.int32), np.array([draw.random() for _ in range(8)], np.float32)) for _ in range(40)]
    labels = np.array([int(r[0].min() < 6) for r in rows])
    model = classifier.train(rows, labels, bits=6, epochs=2, seed=5)
    rng = np.random.default_rng(5)
    order = [int(i) for _ in range(2) for i in rng.permutation(len(rows))]
    pairs = [[*zip(p.tolist(), v.tolist(), strict=True), (64, 1.0)] for p, v in rows]
    wanted = plain.leader(pairs, labels.tolist(), order, classifier.ALPHA, classifier.BETA, classifier.L1, classifier.L2)
    assert np.allclose(model.weights, [wanted.get(i, 0.0) for i in range(64)], atol=1e-6) and abs(model.bias - wanted[64]) < 1e-9
    assert classifier.train([], np.zeros(0), bits=6).score(pa.array(["a", None])).tolist() == [0.5, 0.5]


def test_quality_on_held_out_labels(spark):
    sf = f"{TESTDATA}/sf0.1"
    docs, labels = catalog.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    found = classifier.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in found if r["quality"] == 1]
    assert len(found) > 700 and sum(r["predicted"] == r["quality"] for r in found) >= 0.98 * len(found)
    assert sum(r["predicted"] for r in good) >= 0.99 * len(good)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = catalog.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    lies = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    swapped = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert rows_of(classifier.quality(docs, labels)) == rows_of(classifier.quality(swapped, lies))
    held = {r["doc_id"] for r in docs.where(classifier.held_out()).collect()}
    assert held == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_the_sample_is_bounded(spark):
    docs, labels = catalog.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    every, _ = classifier.training_rows(docs, labels)
    assert len(classifier.training_rows(docs, labels, sample=20)[0]) == 20
    most = sum(len(p) for p, _ in every) // 2
    some, marks = classifier.training_rows(docs, labels, most=most)
    assert 0 < len(some) < len(every) and sum(len(p) for p, _ in some) <= most and len(marks) == len(some)


def test_quality_over_edge_cases(spark, edges):
    labels = spark.createDataFrame([(0, 1), (0, 0), (13, 0), (2, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    found = classifier.quality(edges, labels).collect()
    assert len(found) == edges.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert classifier.quality(empty(spark), labels).count() == 0
    assert {r["score"] for r in classifier.quality(edges, labels.limit(0)).collect()} == {0.5}


# --- Merkle manifest ----------------------------------------------------------


@pytest.mark.parametrize("levels", range(1, 13))
def test_layout_places_every_node_once(levels):
    places = np.concatenate([manifest.places(d, levels) for d in range(levels)])
    assert sorted(places.tolist()) == list(range((1 << levels) - 1)) and places[0] == 0
    assert manifest.address(levels - 1, [3], levels)[0] == manifest.places(levels - 1, levels)[3] if levels > 2 else True


def test_layout_keeps_subtrees_together():
    """Of 8 levels each of the 16 trees below the middle lies in one run of 15."""
    for tree in range(16):
        nodes = [manifest.address(4 + d, np.arange(1 << d) + (tree << d), 8) for d in range(4)]
        assert sorted(np.concatenate(nodes).tolist()) == list(range(15 + 15 * tree, 30 + 15 * tree))


@pytest.mark.parametrize("height", [1, 2, 10])
def test_proofs_over_edge_cases(spark, edges, height):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in edge_rows()]
    rows += [{"doc_id": i, "text": f"t{i % 3}", "lang": "", "source": None, "n_chars": None if i % 2 else 2**63 - 1} for i in range(100, 137)]
    rows += [{"doc_id": 500, "text": "same", "lang": "Z", "source": "s", "n_chars": 4}] * 5
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    frame = frame.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)
    assert rows_of(manifest.manifest(frame, manifest.tampered(), height).proofs()) == plain.proofs(rows)


def test_root_depends_on_every_field(spark):
    row = (1, "text", "en", "src", 4)
    variants = [row, (2, *row[1:]), (1, "", *row[2:]), (1, None, *row[2:]), (*row[:2], None, *row[3:]), (*row[:3], None, 4), (*row[:4], None)]
    found = {manifest.manifest(spark.createDataFrame([v, (9, "x", "fr", "s", 1)], SCHEMA)).root().first()["root"] for v in variants}
    assert len(found) == len(variants)
    none = manifest.manifest(empty(spark))
    assert none.root().count() == 0 and none.proofs().count() == 0
