"""Search strings and contracts on small hand-built rows."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.functions import websearch
from quirefold.operators import chunking
from quirefold.plans import contracts, lifecycle


@pytest.mark.parametrize("text, groups", [
    ("a b", [[(False, ["a"])], [(False, ["b"])]]),
    ('"a b" -c', [[(False, ["a", "b"])], [(True, ["c"])]]),
    ("a or b c", [[(False, ["a"]), (False, ["b"])], [(False, ["c"])]]),
    ('or x -"y z', [[(False, ["x"])], [(True, ["y", "z"])]]),
    ("!! ,", []), ("", []),
])
def test_search_terms(text, groups):
    assert websearch.terms(text) == groups


@pytest.mark.parametrize("text, found", [("one two", {1, 2}), ('"one two"', {1}), ("one -two", set()), ("three or one", {1, 2, 3}), ("-one", {3}), ("", set()), ("ONE Two", {1, 2})])
def test_search_matches(spark, text, found):
    d = spark.createDataFrame([(1, "One two"), (2, "two; one"), (3, "three")], "id int, text string")
    assert {r["id"] for r in d.where(websearch.matches(T.words(F.col("text")), text)).collect()} == found


def test_keyed_fingerprint_is_hmac(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").collect()
    want = {f"{r['conv_id']}-{r['turn']}": hmac.new(b"fixture-key", f"question\0{r['text']}".encode(), hashlib.sha256).hexdigest() for r in rows}
    got = contracts.keyed_fingerprint(lambda n: spark.read.parquet(f"{sf}/{n}.parquet")).collect()
    assert {r["query_id"]: r["mac"] for r in got} == want


def test_anchored_rate_limit_equals_a_loop(spark, sf):
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    times: dict[str, list] = {}
    for r in table("events").select("user_id", "ts").collect():
        times.setdefault(f"book-{r['user_id']}", []).append(r["ts"])
    want = {}
    for book, ts in times.items():
        opened, n, windows, rejected = None, 0, 0, 0
        for x in sorted(ts):
            if opened is None or (x - opened).total_seconds() >= 3600:
                opened, n, windows = x, 0, windows + 1
            n += 1
            rejected += n > 2
        want[book] = (len(ts), windows, rejected)
    assert {r["book_id"]: (r["n_events"], r["windows"], r["rejected"]) for r in lifecycle.rate_limit_anchored(table).collect()} == want


def test_selected_evidence_fits_and_is_known(spark, sf):
    from quirefold.catalogue import QUERIES

    picked = QUERIES["evidence_select"](spark, sf).collect()
    fused = {(r["query_id"], r["evidence_id"]) for r in QUERIES["rrf_fusion"](spark, sf).collect()}
    by_query: dict[int, list] = {}
    for r in picked:
        by_query.setdefault(r["query_id"], []).append(r)
    for rows in by_query.values():
        assert sorted(r["place"] for r in rows) == list(range(len(rows))) and len({r["evidence_id"] for r in rows}) == len(rows) <= 8
    assert {(r["query_id"], r["evidence_id"]) for r in picked} <= fused


def test_every_reason_of_a_chunk(spark):
    sha = hashlib.sha256(b"some words").hexdigest()
    good = {"batch_id": "b1", "line": 0, "book_id": "book-1", "chunk_id": "c:1", "chunk_order": 8, "text": b"some words", "chapter": b"", "section": None, "content_sha256": sha, "page_start": 2, "page_end": 3, "token_start": 5, "token_end": 9} | dict.fromkeys(chunking.VERSIONS, "v1")
    wrong = [
        {"book_id": "book-2"}, {"chunk_id": "c/1\n"}, {"text": None}, {"text": b"\xff"}, {"chapter": b"\xc3"}, {"section": b"\xe2\x82"}, {"content_sha256": sha[1:]},
        {"page_start": 0}, {"page_end": 1}, {"page_end": 5}, {"chunk_order": None}, {"token_end": 5}, {"token_end": 16}, *[{v: "v2"} for v in chunking.VERSIONS],
    ]
    cases = [({}, None), ({"batch_id": "b9"}, "book_mismatch"), ({"chunk_id": "x" * 257}, "invalid_chunk_id"), ({"chunk_id": "c:1\n"}, "invalid_chunk_id"), ({"text": b"", "page_start": 0}, "empty_text"), ({"token_end": 15}, None)]
    cases += list(zip(wrong, chunking.CHUNK_REASONS, strict=True))
    rows = [tuple((good | change | {"batch_id": change.get("batch_id", "b1")}).values()) for change, _ in cases]
    types = {"line": "int", "chunk_order": "int", "page_start": "int", "page_end": "int", "token_start": "int", "token_end": "int", "text": "binary", "chapter": "binary", "section": "binary"}
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ", ".join(["case int", *[f"{n} {types.get(n, 'string')}" for n in good]]))
    for c in ("text", "chapter", "section"):
        d = d.withColumn(c, F.col(c).cast("string"))
    d = d.withColumn("line", F.col("case")).withColumn("chunk_order", F.col("chunk_order") + F.col("case"))
    work = spark.createDataFrame([("b1", "book-1", 8, 4, 10, *["v1"] * 5)], ", ".join(["batch_id string", "book_id string", "first_order int", "manifest_pages int", "maximum_tokens int", *[f"{v} string" for v in chunking.VERSIONS]]))
    got = {r["line"]: r["reason"] for r in chunking.chunk_reasons(d, work).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    assert chunking.chunk_reasons(d.limit(0), work).count() == 0


@pytest.mark.parametrize("name,reasons", [("layout_classify", []), ("layout_reasons", ["dedication_ornamental"])])
def test_layout_rules_are_those_of_the_sql(spark, tmp_path, name, reasons):
    from quirefold.catalogue import ORACLE, QUERIES

    from .compare import connect, same

    words = " ".join(["word"] * 6)
    text = "\n".join([words] * 4 + ["To ersh."] * 4)
    spark.createDataFrame([(7, text, "en", "src")], "doc_id long, text string, lang string, source string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert [r for r in got["reason"] if r != "title"] == reasons
    same(got, connect(str(tmp_path)).execute(ORACLE[name]).df())
