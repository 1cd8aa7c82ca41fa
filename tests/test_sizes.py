"""Whole results where a table outgrows what one task or message may hold."""

import math
import random
import sys
import zlib

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from heliograph import catalog
from heliograph.functions import batches
from heliograph.operators import chunking, dense, fusion, graph, hooks, lexical, local
from heliograph.plans import rag


@pytest.mark.parametrize("cells", [40, 1000])
def test_graph_in_blocks_of_queries(spark, monkeypatch, cells):
    r = random.Random(5)
    held = {c: sorted({f"e{r.randrange(30)}" for _ in range(r.randrange(1, 6))}) for c in range(60)}
    m = spark.createDataFrame([(c, e) for c, es in held.items() for e in es], "chunk_id long, entity string")
    n = spark.createDataFrame([(60,)], "n long")
    asked = spark.createDataFrame([(f"q{i}", f"e{(7 * i + j) % 33}") for i in range(9) for j in range(2)], "query_id string, entity string")
    stats = graph.entity_stats(m, n)
    scores, activation = graph.diffuse(m, stats, graph.seeds(asked, stats))
    near = lambda rows: {tuple(x[:2]): round(x[2], 9) for x in rows}
    want, total = near(scores.collect()), {x[0]: x[1] for x in activation.groupBy("query_id").agg(F.sum("activation")).collect()}
    shares = {(q, e): round(a / total[q], 9) for q, e, a in activation.collect() if a}
    monkeypatch.setattr(graph, "SENT_CELLS", cells)  # more entities times queries than that
    monkeypatch.setattr(graph, "PACK", 16)
    monkeypatch.setattr(graph, "diffuse", lambda *a: pytest.fail("joins queries with chunks"))
    _, got, chunks = graph.explain(m, n, asked)
    assert near(got.select("query_id", "entity", "activation").collect()) == shares
    assert near(chunks.select("query_id", "chunk_id", "score").collect()) == want
    odd = m.select("chunk_id").filter("chunk_id % 2 = 1")
    best = {(x.query_id, x.rank): x.chunk_id for x in graph.search(m, n, asked, 4, odd).collect()}
    for q in {q for q, _ in want}:
        order = sorted((-s, c) for (p, c), s in want.items() if p == q and c % 2 and s > 1e-12)[:4]
        assert [best.get((q, i + 1)) for i in range(len(order))] == [c for _, c in order]


def test_lead_context_needs_no_join(spark, tmp_path):
    docs = spark.createDataFrame([(1, "First one here. " + "word and more words. " * 60), (2, None), (3, "short")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.ctx3_lead_context(spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.chunk_id: r.context for r in got.collect()}
    assert rows["1::0"] == "" and rows["1::1"] == "First one here." and rows["3::0"] == ""


def test_containing_texts_are_found_where_they_are(spark, monkeypatch):
    texts = ["x" * 9 + "æøå lang tekst her" + "y" * 5, "æøå lang tekst her", "", None, "ab", "æøå lang", " tekst her", "abæøå lang tekst heræøå lang tekst her"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = [(10, "æøå lang tekst her"), (11, "ab"), (12, "lang tekst"), (13, None), (14, "lang tekst"), (15, "not there at all")]
    want = sorted((i, j) for i, t in enumerate(texts) for j, b in items if t is not None and b is not None and b in t)
    found = catalog._containing(docs, spark.createDataFrame(items, "item_id long, b string"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == want


def test_hashing_vectors_shuffle_one_row_a_text(spark):
    rows = spark.createDataFrame([("a", "Red red blue"), ("b", None), ("c", "12 ærlig"), ("a", "blue")], "id string, text string")
    found = dense.hashing_vectors(rows, 16)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    for i, words in {"a": ["red", "red", "blue", "blue"], "b": [], "c": ["12", "rlig"]}.items():
        v = [0.0] * 16
        for w in words:
            v[zlib.crc32(w.encode()) % 16] += 1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        assert found.filter(F.col("id") == i).first().v == [x / n for x in v]


def test_routing_counts_once_with_the_search(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "the tower stood" if i else "zephyr") for i in range(900)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "zephyr winds"), (2, "tower"), (3, "unknown")], "query_id long, query string")
    index, calls, plain = lexical.LexicalIndex.build(chunks), [], local.statistics
    monkeypatch.setattr(local, "statistics", lambda *a: calls.append(1) or plain(*a))
    index.bm25(q, 3)
    got = {r.query_id: r.reason for r in fusion.route(q, index).collect()}
    assert got == {1: f"rare term (idf {math.log(1 + 899.5 / 1.5):.1f})", 2: "balanced", 3: "balanced"} and calls == [1]


def test_answers_search_once(spark):
    chunks = spark.createDataFrame([(1, 1, "The tower stood. It fell."), (2, 2, "A bridge.")], "chunk_id long, doc_id long, text string")
    q = spark.createDataFrame([(1, "tower"), (2, "absent")], "query_id long, query string")
    p = rag.Pipeline(chunks, {"bm25": rag.bm25_ranker(lexical.LexicalIndex.build(chunks))})
    got = p.answer(q)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert {r.query_id: r.answer for r in got.collect()}[1] == "The tower stood."


class Held(dict):
    """A chunk that knows how many of its kind its worker holds."""

    live = 0

    def __init__(self, **x):
        Held.live += 1
        super().__init__(**x | {"start_char": Held.live})

    def __del__(self):
        Held.live -= 1


def test_chunkers_hold_a_piece_of_a_batch(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text")).coalesce(1)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers have no tests to import
    try:
        got = chunking.chunk(docs, lambda t: [Held(text=t, start_char=0, end_char=len(t), section="")])
        rows = got.select("doc_id", "text", "start_char").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert sorted((r.doc_id, r.text) for r in rows) == [(i, "word " * 200) for i in range(2000)]
    assert max(r.start_char for r in rows) < 1000  # two pieces at most, where the batch has 2000 texts


def test_models_get_a_piece_of_a_batch(spark):
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("word "), 200).alias("text")).coalesce(1)
    got = hooks.sparse_encode(chunks, lambda texts: [{"chars": float(sum(map(len, texts)))} for _ in texts]).collect()
    assert sorted(r.chunk_id for r in got) == list(range(2000))
    assert max(r.weight for r in got) <= batches.PIECE


def test_entities_are_found_in_pieces(spark):
    chunks = spark.createDataFrame([(1, "He met Anna Maria there."), (2, None)], "chunk_id long, text string")
    m = graph.mentions(chunks)
    assert ", 204" in m._jdf.queryExecution().optimizedPlan().toString()  # an iterator UDF, which divides what it gets
    assert "anna maria" in {r.entity for r in m.collect()}


def test_lexical_scoring_reads_a_batch_in_pieces(spark, monkeypatch):
    texts = [f"the tower stood {i % 7} " * (1 + i % 5) if i % 4 else None for i in range(60)]
    asked = local.Asked.of(pa.table({"query_id": [1, 2], "query": ["tower 3", "standing 5 5"]}), "english")
    whole = local._postings(pa.array(texts), asked, "english")
    read = []
    monkeypatch.setattr(local, "cuts", lambda sizes, most: read.append(batches.cuts(sizes, 300)) or read[-1])
    for got, want in zip(local._postings(pa.array(texts), asked, "english"), whole):
        assert got.dtype == want.dtype and got.tolist() == want.tolist()
    assert len(read[0]) > 5 and [x.stop for x in read[0]][-1] == 60
    assert [len(x) for x in local._postings(pa.array([], pa.string()), asked, "english")] == [0] * 4
