"""Indexing, search and upkeep from files to hits."""

import base64
import json

import pytest

from quern import cli
from quern.api import Config, Engine
from quern.embedders import BATCH, Rejected, Unavailable, faulty_hash_embedder, hash_embedder, outcomes, plain_http, vectors_of
from quern.operators import lexicon as L
from quern.operators import ranking as R
from quern.operators import vectors as V
from quern.plans import queryparse as Q
from quern.sources import readers
from quern.sources.store import Store


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "notes"
    (root / "sub" / ".git").mkdir(parents=True)
    (root / "a.md").write_text("# Rivers\nThe heron waits beside slow water, patient through the grey morning.")
    (root / "sub" / "b.txt").write_text("Bread needs flour, salt and time; the heron does not care for bread at all.")
    (root / "sub" / ".git" / "c.txt").write_text("never read this file")
    (root / ".hidden.txt").write_text("Hidden notes mention granite and basalt, and little else of any interest here.")
    return root


def test_walk(corpus):
    names = sorted(p[0].removeprefix(str(corpus)) for p in readers.walk(str(corpus), (".md", ".txt"), (".git",)))
    assert names == ["/.hidden.txt", "/a.md", "/sub/b.txt"]


def test_life_of_a_store(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),)), hash_embedder(8))
    first = e.index()
    assert (first["files"], first["chunks"], first["embedded"]) == (3, 3, 3)
    assert e.index()["up_to_date"]
    hits = e.search("heron").rows.collect()
    assert {h["path"].rsplit("/", 1)[1] for h in hits} == {"a.md", "b.txt"} and all(h["mtime"] for h in hits)
    assert [h["heading"] for h in e.search("rivers").rows.collect()] == ["Rivers"]
    assert e.search("heron", prefix=str(corpus / "sub")).rows.count() == 1
    both = e.search("heron", both=True)
    assert not both.degraded and {m for h in both.rows.collect() for m in h["methods"]} == {"fts", "semantic"}
    (corpus / "a.md").unlink()
    (corpus / "d.md").write_text("## New\nA fresh page about herons and rivers, long enough to be embedded too.")
    again = e.index()
    assert (again["files"], again["removed"]) == (1, 1)
    assert e.store.table("chunks").count() == e.store.table("lengths").count() == e.store.table("embeddings").count() == 3
    assert e.store.table("postings").where("term = 'patient'").count() == 0
    status = e.status().first()
    assert (status["files"], status["chunks"], status["embeddings"]) == (3, 3, 3)
    e.store.remove_root(str(corpus))
    assert e.store.table("files").count() == e.store.table("postings").count() == 0


def test_index_reads_what_changed(spark, corpus, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),)), hash_embedder(8))
    e.index()
    before, read = e.store.named(), []
    own = readers.read_bytes
    monkeypatch.setattr(readers, "read_bytes", lambda spark, paths: read.extend(paths) or own(spark, paths))
    assert e.index()["up_to_date"] and not read
    after = e.store.named()
    assert {n for n in after if after[n] != before[n]} == {"meta"}  # other tables are named again, not copied
    (corpus / "a.md").write_text("# Lakes\nA heron again, and this time it stands in a lake for most of the day.")
    e.index()
    assert read == [str(corpus / "a.md")]


def test_a_run_that_dies_leaves_the_generation_before(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),)), None, commit=1)

    class Died(Exception):
        pass

    read, calls = e.read, []

    def dies(paths):
        calls.append(paths)
        if len(calls) == 3:
            raise Died
        return read(paths)

    e.read = dies
    with pytest.raises(Died):
        e.index()
    assert e.store.table("files").count() == e.store.table("chunks").count() == 2  # what was committed
    e.read = read
    again = e.index()
    assert again["files"] == 1 and e.store.table("files").count() == 3
    assert len(e.store.generations()) == 2  # older ones are removed


def test_writers_cannot_share_a_generation(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    meta = spark.createDataFrame([("k", "v")], "key string, value string")
    b.generations = lambda: []
    a.write({"meta": meta})
    with pytest.raises(RuntimeError):
        b.write({"meta": meta})
    assert a.table("meta").count() == 1


def test_documents_and_images(spark, corpus, tmp_path):
    (corpus / "t.csv").write_text("name,stone\nfirst,granite from the northern quarry and other places")
    (corpus / "broken.doc").write_bytes(b"x")
    (corpus / "away.pdf").write_bytes(b"x")
    (corpus / "big.png").write_bytes(b"p" * 9000)
    (corpus / "small.png").write_bytes(b"p" * 100)

    def converter(content, suffix, ocr):
        if suffix == ".pdf":
            raise readers.ReaderUnavailable
        raise ValueError

    make = lambda images: Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),), images=images), None, converter, lambda content, suffix, ocr: "A photograph of basalt columns beside the sea, with people.")
    make(()).index()
    e = make((str(corpus),))
    e.index()
    names = {r["path"].rsplit("/", 1)[1] for r in e.store.table("files").collect()}
    assert names == {"a.md", "b.txt", ".hidden.txt", "t.csv", "broken.doc", "big.png"}
    assert {h["path"].rsplit("/", 1)[1] for h in e.search("granite OR basalt").rows.collect()} == {".hidden.txt", "t.csv", "big.png"}


QUERIES = ["heron", "heron water", '"slow water"', "wat*", "slow + wat*", "NEAR(heron water, 4)", "heron NOT bread", "heading : rivers", "^the", "(heron OR bread) AND water", "{heading content} : rivers OR salt", '""']


def test_index_and_scan_agree(spark):
    texts = ["The heron waits beside slow water, slow water", "bread and salt and water", "a heron begins", "Slow rivers. Water. A heron", "", "waterways: the heron, the bread"]
    c = spark.createDataFrame([(k, f"/d{k % 2}/{k}.txt", 0, "Rivers" if k == 2 else "", t) for k, t in enumerate(texts)], "chunk_id long, file_path string, chunk_index int, heading string, content string")
    lengths = L.document_lengths(c)
    stats = lengths.selectExpr("count(*) as n", "sum(len_content + len_heading) as words")
    index, rows = R.SearchIndex(L.postings(c), stats, c), L.tokenised(c)
    for q in QUERIES:
        for prefix in (None, "/d1"):
            a, b = (sorted((r["chunk_id"], round(r["score"], 9)) for r in x.collect()) for x in (index.best(q, 10, prefix), R.run_query(rows, q, 10, prefix)))
            assert a == b, q
    assert index.best("heron AND (", 10) is None and index.search("heron", 0).count() == 0
    assert {r["chunk_id"] for r in index.search("heron nothere").collect()} == {0, 2, 3, 5}
    assert len(Q.parse("heron water").parts) == 2


def test_replies_of_embedding_servers():
    listed = json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert vectors_of(listed, True) == [[1.0], [2.0]] and vectors_of('{"embeddings": [[3.0]]}', False) == [[3.0]]
    for bad in ("<html>", "{}", "[]"):
        with pytest.raises(Unavailable):
            vectors_of(bad, True)
    assert plain_http("http://a.example/v1") and not plain_http("https://a.example") and not plain_http("http://localhost:1")


def test_search_tries_the_embedder_again(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr("quern.embedders.time.sleep", lambda s: None)
    failures = iter([True])
    good = hash_embedder(8)

    def flaky(texts):
        if next(failures, False):
            raise Unavailable
        return good(texts)

    e = Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),)), good)
    e.index()
    e.embedder = flaky
    assert e.search("heron", semantic=True).rows.first()["method"] == "semantic"


def test_missing_root_is_protected(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),)), None)
    e.index()
    corpus.rename(tmp_path / "away")
    e.index()
    assert e.store.table("files").count() == 3
    assert e.search("heron", both=True).degraded


def test_transient_failures_mark_files(spark, corpus, tmp_path):
    (corpus / "e.txt").write_text("DOWN " + "words that wait for another run of the index " * 2)
    e = Engine(spark, str(tmp_path / "store"), Config(directories=(str(corpus),)), faulty_hash_embedder(8), retries=0)
    e.index()
    marked = e.store.table("files").where("mtime_ns = -1").collect()
    assert [m["path"].rsplit("/", 1)[1] for m in marked] == ["e.txt"]


def test_outcomes():
    texts = ["ok %d" % k for k in range(7)] + ["POISON x", "DOWN y"]
    calls, waits = [], []

    def embedder(ts):
        calls.append(len(ts))
        return faulty_hash_embedder(4)(ts)

    got = outcomes(embedder, texts, 1, waits.append)
    assert [s for s, _ in got] == ["ok"] * 7 + ["permanent", "transient"]
    assert max(calls) == BATCH and waits == [2]
    with pytest.raises(Rejected):
        faulty_hash_embedder(4)(["POISON"])
    with pytest.raises(Unavailable):
        faulty_hash_embedder(4)(["DOWN"])


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0])], "chunk_id long, vector array<float>")
    ids = lambda df: [r["chunk_id"] for r in df.collect()]
    assert ids(V.top_k(rows, [1.0, 0.0], 3)) == ids(V.top_k_batch(rows, [1.0, 0.0], 3)) == [1, 3, 2]
    assert ids(V.top_k(rows, [1.0, 0.0], 0)) == ids(V.top_k(rows, [0.0, 0.0], 3)) == []
    assert ids(V.top_k(rows, [1.0, 0.0], 3, rows.where("chunk_id = 3"))) == [3]


def test_converters(spark):
    rows = spark.createDataFrame([("/a.csv", b"x,y\n1,2"), ("/b.pdf", b""), ("/c.png", b""), ("/d.doc", b"")], "path string, content binary")
    seen = []

    def converter(content, suffix, ocr):
        if suffix == ".png":
            raise readers.ReaderUnavailable
        if suffix == ".doc":
            raise ValueError
        return "## **Scanned** \nwords enough to count as real text" if ocr else "![page](1.png)"

    got = {r["path"]: (r["status"], r["text"]) for r in readers.convert(rows, converter).collect()}
    assert got["/a.csv"] == ("ok", "| x | y |\n| --- | --- |\n| 1 | 2 |")
    assert got["/b.pdf"] == ("ok", "## Scanned\nwords enough to count as real text")
    assert got["/c.png"][0] == "unavailable" and got["/d.doc"][0] == "error" and not seen


def test_vision():
    body = readers.vision_request(b"abc", "image/png", "m", "read")
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,YWJj"
    assert readers.vision_text(json.dumps({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]})) == "ab"
    for bad in ("<html>", "{}", '{"choices": []}', '{"error": 1}'):
        with pytest.raises(readers.ReaderUnavailable):
            readers.vision_text(bad)


def test_vision_reader():
    import http.server
    import threading

    codes = {b"good": 200, b"odd": 422, b"busy": 503}

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = base64.b64decode(body["messages"][0]["content"][1]["image_url"]["url"].split(",")[1])
            self.send_response(codes[content])
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "read it" if self.headers["Authorization"] == "Bearer k" else "NO_TEXT"}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    read = readers.vision_reader(url, "m", "k")
    assert read(b"good", ".png", False) == "read it" and readers.vision_reader(url, "m")(b"good", ".png", False) == ""
    with pytest.raises(ValueError):
        read(b"odd", ".png", False)
    for content, suffix in ((b"busy", ".png"), (b"good", ".tif"), (b"x" * (readers.MOST_RAW + 1), ".png")):
        with pytest.raises(readers.ReaderUnavailable):
            read(content, suffix, False)
    server.shutdown()
    with pytest.raises(readers.ReaderUnavailable):
        readers.vision_reader("http://127.0.0.1:9", "m")(b"good", ".png", False)


def test_cli(spark, corpus, tmp_path, capsys):
    home = ["--home", str(tmp_path / "home")]
    assert cli.main([*home, "add-dir", str(tmp_path / "none")]) == 1
    assert cli.main([*home, "index"]) == 1
    assert cli.main([*home, "add-dir", str(corpus)]) == 0
    assert cli.main([*home, "index"]) == 0
    capsys.readouterr()
    assert cli.main([*home, "search", "heron", "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main([*home, "search", "granite"]) == 0
    assert ".hidden.txt" in capsys.readouterr().out
    assert cli.main([*home, "config", "set", "nope", "1"]) == 1
    assert cli.main([*home, "config", "set", "workers", "1001"]) == 1 and cli.main([*home, "config", "set", "ocr_engine", "vision"]) == 0
    assert cli.main([*home, "config", "set", "ocr_url", "http://a.example"]) == 0 and "HTTPS" in capsys.readouterr().err
    assert cli.main([*home, "status", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 3
    assert cli.main([*home, "remove-dir", "notes"]) == 0
