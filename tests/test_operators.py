"""Operators on small hand-built rows."""

import math

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import vectors as X
from quirefold.operators import caching, chunking, ranking, selection


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, modes", [("Show sample code and risks", ["examples", "risks"]), ("What is X?", ["overview"]), ("compare steps", ["comparison", "steps"]), ("", ["overview"])])
def test_answer_modes(spark, value, modes):
    assert one(spark, value, T.answer_modes) == modes


@pytest.mark.parametrize("value, guards", [("use C++ not C# v2.1", ["c#", "c++", "not", "v2 1"]), ("plain words", []), ("-no- x", ["no"])])
def test_symbolic_guards(spark, value, guards):
    assert one(spark, value, T.symbolic_guards) == guards


def test_normalize(spark):
    assert one(spark, "  a\u0007 b \t\r\nc\r\r\n", T.normalize) == "a b\nc"
    composed = spark.createDataFrame([("é",), (None,)], "x string").select(T.nfc()("x").alias("y")).collect()
    assert [r["y"] for r in composed] == ["é", None]


@pytest.mark.parametrize("line, chapter, section", [("Chapter IV: On x", "Chapter IV: On x", None), ("section 3. y", None, "section 3. y"), ("Chapters of life", None, None), ("", None, None)])
def test_heading(spark, line, chapter, section):
    h = one(spark, "\n" + line + "\nmore", T.heading)
    assert (h["chapter"], h["section"]) == (chapter, section)


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], -1.0), ([1.0], [1.0, 2.0], -1.0), ([float("nan"), 1.0], [1.0, 0.0], -1.0), ([3.0, 4.0], [4.0, 3.0], 0.96), (None, [1.0], -1.0)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, want double").select(X.cosine(F.col("a"), F.col("b")).alias("c"), "want").collect()
    assert all(math.isclose(r["c"], r["want"]) for r in got)
    assert one(spark, "", lambda c: X.hashed_embedding(c, 4)) == [1.0, 0.0, 0.0, 0.0]
    e = one(spark, "one two two", lambda c: X.hashed_embedding(c, 16))
    assert math.isclose(sum(x * x for x in e), 1.0)


def test_fusion_orders_only(spark):
    rows = [(1, "a", 0, 0.9), (1, "b", 1, 0.5), (1, "b", 0, 0.2), (1, "c", 5, 0.99)]
    got = ranking.fuse(spark.createDataFrame(rows, "query_id int, evidence_id string, rank int, score double").repartition(3)).orderBy("position").collect()
    assert [r["evidence_id"] for r in got] == ["b", "a", "c"]
    assert got[0]["score"] == 0.5 and math.isclose(got[0]["fused"], round(1 / 62 + 1 / 61, 9))


def chunks(spark, pages, policy=chunking.Policy(50, 5, 2), tokenizer="word"):
    d = spark.createDataFrame([("b", *p) for p in pages], "book_id string, page_no int, text string").repartition(3)
    return chunking.chunk_windows(d, policy, tokenizer).orderBy("chunk_order").collect()


def test_chunks_cover_without_gap(spark):
    pages = [(1, "Chapter 1: x\n" + " ".join(f"w{i}" for i in range(200))), (2, "   "), (3, " ".join(f"v{i}" for i in range(30))), (4, "Section 2. y\nz z z")]
    found = chunks(spark, pages)
    for a, b in zip(found, found[1:]):
        assert a["token_start"] < b["token_start"] and a["token_end"] < b["token_end"]
        assert b["token_start"] in (a["token_end"], a["token_end"] - 5)
    assert found[-1]["section"] == "Section 2. y" and found[-1]["token_start"] == found[-2]["token_end"]
    assert all(c["token_end"] - c["token_start"] <= 50 and c["page_end"] - c["page_start"] < 2 for c in found)
    assert len({c["chunk_id"] for c in found}) == len(found) and [c["chunk_order"] for c in found] == list(range(len(found)))
    assert chunks(spark, pages) == found
    words = " ".join(t for _, t in pages).split()
    assert all(c["passage"] == " ".join(words[c["token_start"] : c["token_end"]]) for c in found)
    changed = chunks(spark, [*pages[:3], (4, "Section 2. y\nz z Z")])
    assert [a["chunk_id"] == b["chunk_id"] for a, b in zip(found, changed)] == [True] * (len(found) - 1) + [False]


def test_chunk_exact_window_has_no_tail(spark):
    found = chunks(spark, [(1, " ".join("x" for _ in range(50)))])
    assert [(c["token_start"], c["token_end"]) for c in found] == [(0, 50)]
    assert chunks(spark, [(1, ""), (2, None)]) == []


def test_chunk_boundary_clears_structure(spark):
    found = chunks(spark, [(1, "Chapter 1\na b"), (2, None), (3, "c d")])
    assert [(c["chapter"], c["passage"]) for c in found] == [("Chapter 1", "Chapter 1 a b"), ("", "c d")]


def test_chunks_of_characters_keep_page_breaks(spark):
    found = chunks(spark, [(1, "abc"), (2, "de"), (4, "fghij")], chunking.Policy(6, 2, 2), "char")
    assert [(c["page_start"], c["page_end"], c["token_start"], c["token_end"], c["passage"]) for c in found] == [(1, 2, 0, 6, "abc\nde"), (4, 4, 6, 12, "fghij")]


def test_window_bounds():
    every = chunking.Policy(10, 3, 99)
    assert chunking.window_bounds([0], [1], [24], every) == [(0, 10), (7, 17), (14, 24)]
    # A window no longer than the overlap is not overlapped, and two page numbers at most are reached.
    assert chunking.window_bounds([5, 7, 9], [1, 2, 4], [7, 9, 15], chunking.Policy(10, 4, 2)) == [(5, 9), (9, 15)]
    assert chunking.window_bounds([0, 6, 12], [1, 2, 3], [6, 12, 14], chunking.Policy(10, 2, 1)) == [(0, 6), (6, 12), (12, 14)]


def test_pack_shards():
    assert chunking.pack_shards([5, 5, 5, 20, 1], 2, 12) == [0, 0, 1, 2, 3]
    assert chunking.pack_shards([], 2, 12) == []


def test_selection(spark):
    c = spark.createDataFrame([("b", 1, "title", "s1", False), ("b", 1, "title", "s2", False), ("b", 2, "title", "s1", False), ("b", 2, "title", "s2", False), ("b", 3, "title", "s1", False), ("b", 4, "index", "s1", False), ("b", 4, "index", "s2", True)], "book_id string, ordinal int, reason string, signal string, keep boolean")
    found = selection.ranges(selection.votes(c).where("excluded"))
    assert [(r["start"], r["end"], r["reason"]) for r in found.collect()] == [(1, 2, "title")]
    totals = spark.createDataFrame([("b", 4), ("x", 9)], "book_id string, total int")
    assert {r["book_id"]: r["fallback"] for r in selection.fail_open(found, totals, 8, 0.25).collect()} == {"b": "excluded_ratio", "x": "none"}


def test_cache_lookup(spark):
    keys = "profile string, question_hash string, passage_hash string, topic_hash string, guard_hash string"
    axis, near, far = [1.0, 0.0], [1.0, 0.05], [0.0, 1.0]
    stored = [(1, 0, False, axis, "m", "q1", "p", "t", "g"), (2, 0, False, axis, "m", "q1", "p", "t", "g"), (3, 5, False, near, "m", "q2", "p", "t", "g"), (4, 5, True, axis, "m", "q3", "x", "t", "g"), (5, 9, False, None, "m", "q4", "y", "t", "g")]
    asked = [
        (10, 6, axis, "m", "q1", "p", "t", "g", (1, "hit")),
        (11, 6, axis, "m", "q9", "p", "t", "g", (3, "negative_hit")),  # the newer of two that fit
        (12, 6, far, "m", "q9", "p", "t", "g", (None, "semantic_mismatch")),
        (13, 6, axis, "m", "q9", "p", "t", "other", (None, "miss")),
        (14, 12, axis, "m", "q1", "p", "t", "g", (3, "negative_hit")),  # its own entry has expired
        (15, 6, axis, "m", "q9", "x", "t", "g", (None, "miss")),  # only what was not relevant is reused so
        (16, 10, axis, "m", "q9", "y", "t", "g", (None, "miss")),
        (17, 0, axis, "m", "q1", "p", "t", "g", (None, "miss")),  # stored at the same time, not before
        (18, 6, axis, "m", None, None, "t", "g", (None, "miss")),
        (19, 6, None, "m", "q9", "p", "t", "g", (None, "semantic_mismatch")),
    ]
    kept = caching.entries(spark.createDataFrame(stored, f"entry_id int, asked_at int, relevant boolean, embedding array<double>, {keys}").repartition(3), 10)
    assert {r["entry_id"] for r in kept.collect()} == {1, 3, 4, 5}
    got = caching.lookup(spark.createDataFrame([a[:-1] for a in asked], f"request_id int, asked_at int, embedding array<double>, {keys}").repartition(3), kept)
    assert {r["request_id"]: (r["entry_id"], r["outcome"]) for r in got.collect()} == {a[0]: a[-1] for a in asked}
    assert caching.lookup(got.sparkSession.createDataFrame([], f"request_id int, asked_at int, embedding array<double>, {keys}"), kept).count() == 0


def test_cache_lookup_joins_no_texts(spark, sf):
    from quirefold.catalogue import QUERIES

    def joins(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = [node.output().mkString(",")] if node.nodeName() == "Join" else []
        return own + [x for c in children for x in joins(c)]

    found = joins(QUERIES["assessment_cache_lookup"](spark, sf)._jdf.queryExecution().optimizedPlan())
    assert found and not [x for x in found if "text#" in x]
