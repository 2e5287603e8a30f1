"""What is moved, held and read as tables grow."""

import pyarrow as pa
import pytest
from oracle import SF

from quern.operators import lexicon as L
from quern.operators import ranking as R
from quern.plans import corpus as D
from quern.plans.catalogue import QUERIES
from quern.sources import readers

CHUNKS = "chunk_id long, file_path string, chunk_index int, heading string, content string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def chunks(spark):
    texts = ["b a b", "", None, "Éa ea, b", "..", "c " * 30]
    return spark.createDataFrame([(k, f"/{k}", 0, "a" if k % 2 else "", t) for k, t in enumerate(texts)], CHUNKS)


def test_vectors_are_stored_without_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "_stores", {})
    assert QUERIES["stored_units_audit"](spark, SF).count() == 0
    assert [key[2] for key in D._stores] == ["embeddings"]


def test_fused_lists_move_no_other_chunks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if chunks were many
    try:
        for name in ("rrf_fuse", "hybrid_search", "hybrid_methods"):
            assert "SortMergeJoin" not in plan(QUERIES[name](spark, SF)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_keeps_rows_without_a_chunk(spark, chunks):
    rows = spark.createDataFrame([(0, 1.0), (77, 0.5)], "chunk_id long, score double")
    index = R.SearchIndex(None, None, chunks)
    assert sorted((r["chunk_id"], r["file_path"]) for r in index.looked_up(rows, "left").collect()) == [(0, "/0"), (77, None)]
    assert [r["chunk_id"] for r in index.looked_up(rows).collect()] == [0]


@pytest.mark.parametrize("at_once", [1, 500_000])
def test_postings_are_grouped_without_a_shuffle(spark, chunks, monkeypatch, at_once):
    monkeypatch.setattr(L, "TOKENS_AT_ONCE", at_once)
    p = L.postings(chunks)
    assert "Exchange" not in plan(p)
    want = [("a", 0, "content", [1], 1, 3), ("a", 1, "heading", [0], 1, 1), ("a", 3, "heading", [0], 1, 4), ("a", 5, "heading", [0], 1, 31), ("b", 0, "content", [0, 2], 2, 3)]
    want += [("b", 3, "content", [2], 1, 4), ("c", 5, "content", list(range(30)), 30, 31), ("ea", 3, "content", [0, 1], 2, 4)]
    assert sorted(tuple(r) for r in p.collect()) == want


def test_tokens_of_an_index_are_made_once(spark, monkeypatch):
    """Statistics come from the stored postings, and no range is sampled for them."""
    monkeypatch.setattr(D, "_stores", {})
    seen = []
    monkeypatch.setattr(D, "postings", lambda c: seen.append(L.postings(c)) or seen[-1])
    index = D.indexed(spark, SF)
    (store,) = D._stores.values()
    assert "lengths" not in store.named() and len(seen) == 1
    words = index.postings.selectExpr("sum(tf) as w").first()["w"]
    assert tuple(index.stats.first()) == (D.chunks(spark, SF).count(), words)


def test_frequencies_shuffle_sums_only(spark, chunks):
    df = L.document_frequencies(chunks)
    text = plan(df)
    assert text.count("Exchange") == 1 and "Expand" not in text
    assert sorted(tuple(r) for r in df.collect()) == [("a", 4, 4), ("b", 2, 3), ("c", 1, 30), ("ea", 1, 2)]


def test_refresh_sorts_no_postings(spark, chunks):
    new = L.refreshed(L.postings(chunks), chunks.where("chunk_id = 0"), chunks.where("chunk_id = 5"))
    assert "Sort" not in plan(new)
    assert sorted((r["term"], r["chunk_id"]) for r in new.collect()) == [("a", 1), ("a", 3), ("a", 5), ("a", 5), ("b", 3), ("c", 5), ("c", 5), ("ea", 3)]


def test_conversion_holds_few_contents(spark, monkeypatch):
    """A worker gives its results piece by piece, and a null content is empty."""
    monkeypatch.setattr(readers, "BYTES_AT_ONCE", 10)
    rows = spark.createDataFrame([(f"/{k}.html", None if k == 3 else b"x" * 6) for k in range(8)], "path string, content binary").coalesce(1)
    taken = {}

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            taken["run"] = run
            return rows.mapInArrow(run, schema)

    got = readers.convert(Rows(), lambda content, suffix, ocr: content.decode() + "!").collect()
    assert sorted((r["path"], r["text"], r["status"]) for r in got) == [(f"/{k}.html", "!" if k == 3 else "xxxxxx!", "ok") for k in range(8)]
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(8)], "content": [b"x" * 6] * 8})
    assert max(len(x) for x in taken["run"](iter([batch]))) == 2
