import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioflow.plans import providers, sinks
from folioflow.plans.config import DigestConfig
from folioflow.plans.pipeline import DigestPipeline
from folioflow.plans.providers import WRITERS, clipped, named
from folioflow.plans.render import EMPTY
from folioflow.sources import readers
from folioflow.streaming.digests import stream_digests

CORPUS = [(1, "Graph routing for lesions", "We study graph routing for lesions.", ["a/b"]), (2, "Cooking", "Soup.", ["c"]), (3, "None", "", ["a/b"])]
PAPERS = [(i, f"Paper {i} on {'graph routing' if i % 3 == 0 else 'soup'} <b>", ["A B", "C D"], f"Abstract {i}. More & more.", f"http://x/{i}", "Text\nUniversity of X" if i % 2 else None) for i in range(1, 13)]
CORPUS_SCHEMA = "corpus_id long, title string, abstract string, paths array<string>"
PAPER_SCHEMA = "id long, title string, authors array<string>, abstract string, url string, full_text string"


def test_config(monkeypatch):
    monkeypatch.setenv("DIGEST_N", "5")
    c = DigestConfig.load({"topk": "x", "max_pinned": "${DIGEST_N}", "pin_keywords": [" A "]}, {"topk": 3})
    assert (c.k, c.cap, c.keywords) == (3, 5, ["a"])
    with pytest.raises(TypeError):
        DigestConfig(include_path="2026/**")
    with pytest.raises(ValueError):
        DigestConfig(overflow="other")


def test_pipeline(spark):
    corpus, papers = spark.createDataFrame(CORPUS, CORPUS_SCHEMA), spark.createDataFrame(PAPERS, PAPER_SCHEMA)
    run = DigestPipeline(DigestConfig(include_path=["a/*"], pin_keywords=["paper 11"], max_papers=3))
    html = run.run(corpus, papers)
    assert html.index("Pinned</h2>") < html.index("Paper 11") < html.index("Recommended</h2>")
    assert html.count("class='paper'") == 4 and "<b>Pinned</b>" in html and "&lt;b&gt;" in html and "University of X" in html
    chosen = run.chosen(run.scored(papers, run.library(corpus))).collect()
    assert {r.id for r in chosen} <= {11, 3, 6, 9, 12}
    assert run.run(corpus.where("false"), papers) is None and run.run(corpus, papers.where("false")) is None
    assert DigestPipeline(DigestConfig(send_empty=True)).run(corpus, papers.where("false")) == EMPTY
    assert DigestPipeline(DigestConfig(debug=True, debug_rows=2)).run(corpus, papers).count("class='paper'") == 2


def test_a_failing_model_gives_the_abstract(spark):
    class Broken:
        def write(self, prompt):
            raise RuntimeError

    WRITERS["broken"] = Broken
    try:
        run = DigestPipeline(DigestConfig(max_papers=2), writer="broken", organisations="broken")
        rows = run.enriched(run.chosen(run.scored(spark.createDataFrame(PAPERS, PAPER_SCHEMA), spark.createDataFrame(CORPUS, CORPUS_SCHEMA)))).collect()
        assert all(r.tldr == r.abstract and r.affiliations is None for r in rows) and len(rows) == 2
    finally:
        del WRITERS["broken"]
    with pytest.raises(ValueError):
        named(WRITERS, "broken")
    assert clipped("a b  c d", 2) == "a b" and clipped("a b", 5) == "a b"


class Server:
    sent: list = []
    fail: tuple = ()

    def __init__(self, kind):
        self.kind = kind

    def __call__(self, host, port, timeout=None):
        if self.kind in Server.fail:
            raise OSError
        return self

    def starttls(self):
        if "tls" in Server.fail:
            raise OSError

    def login(self, *a):
        pass

    def send_message(self, mail):
        Server.sent.append((self.kind, mail["From"], mail["To"], mail))

    def close(self):
        pass


@pytest.mark.parametrize("fail, kind", [((), "plain"), (("tls",), "ssl"), (("tls", "ssl"), "plain")])
def test_mail(monkeypatch, fail, kind):
    Server.sent, Server.fail = [], fail
    monkeypatch.setattr(sinks.smtplib, "SMTP", Server("plain"))
    monkeypatch.setattr(sinks.smtplib, "SMTP_SSL", Server("ssl"))
    sinks.send_mail("<p>ä</p>", "a@x.test", "Zoë <b@x.test>", "x.test", 25, "pw", title="Neues über")
    assert [(k, of, to) for k, of, to, _ in Server.sent] == [(kind, "Digest <a@x.test>", "Zoë <b@x.test>")]
    mail = Server.sent[0][3]
    assert mail.get_content().strip() == "<p>ä</p>" and mail["Subject"].startswith("Neues über ") and b"=?utf-8?" in mail.as_bytes()
    if kind == "plain" and fail:
        with pytest.raises(ConnectionError):
            sinks.send_mail("x", "a@x.test", "b@x.test", "x.test", 25, "pw", clear=False)
    assert sinks.subject(datetime.date(2026, 3, 4)).endswith("2026/03/04")


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"key": "K1", "data": {"name": "root", "parentCollection": False}}, {"key": "K2", "data": {"name": "child", "parentCollection": "K1"}}]))
    assert {(r.collection_key, r.parent_collection) for r in readers.read_collections(spark, str(tmp_path / "c.json")).collect()} == {("K1", None), ("K2", "K1")}
    (tmp_path / "l.json").write_text(json.dumps([{"data": {"itemType": "journalArticle", "title": "T", "abstractNote": "A", "dateAdded": "2026-01-02T03:04:05Z", "collections": ["K2"]}}, {"data": {"itemType": "book", "title": "B", "abstractNote": "A", "dateAdded": "x", "collections": []}}]))
    assert [(r.title, r.added_date.year, r.collections) for r in readers.read_library(spark, str(tmp_path / "l.json")).collect()] == [("T", 2026, ["K2"])]
    (tmp_path / "p.json").write_text(json.dumps({"messages": [], "collection": [{"doi": "1", "title": "T", "authors": "A; B", "abstract": "x", "date": "2026-01-01", "category": "c", "version": "2"}]}))
    assert [(r.doi, r.item_date, r.server) for r in readers.read_preprints(spark, str(tmp_path / "p.json"), "biorxiv").collect()] == [("1", "2026-01-01", "biorxiv")]
    feed = '<feed xmlns:arxiv="http://a"><title>ok</title><entry><id>oai:x.org:1</id><title>T</title><summary>S</summary><arxiv:announce_type>new</arxiv:announce_type></entry><entry><id>2</id><title>U</title></entry></feed>'
    (tmp_path / "f.xml").write_text(feed)
    assert [(r.ord, r.id, r.announce_type) for r in readers.read_feed(spark, str(tmp_path / "f.xml")).orderBy("ord").collect()] == [(0, "oai:x.org:1", "new"), (1, "2", None)]
    (tmp_path / "e.xml").write_text("<feed><title>Feed error for query: x</title></feed>")
    with pytest.raises(ValueError):
        readers.read_feed(spark, str(tmp_path / "e.xml"))


def test_live_source_and_registry(spark, tmp_path):
    page = tmp_path / "page.json"
    page.write_text(json.dumps({"collection": [{"doi": "1", "title": "T"}, {"doi": "2", "title": None}]}))
    spark.dataSource.register(readers.PreprintSource)
    rows = spark.read.format("preprints").option("pages", f"file://{page}").option("server", "biorxiv").load().collect()
    assert [(r.doi, r.title) for r in rows] == [("1", "T"), ("2", None)]
    assert readers.source("feed") is readers.read_feed
    with pytest.raises(ValueError):
        readers.source("nowhere")


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert readers.retried(call, 5, lambda n: 30.0 * (n + 1), sleep=waits.append) == "ok" and waits == [30.0, 60.0]
    with pytest.raises(KeyError):
        readers.retried(lambda: {}["x"], 5, may_retry=lambda e: isinstance(e, OSError), sleep=waits.append)


def test_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    df = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:00:05"), (2, "2026-01-01 01:00:00")], "id long, t string").selectExpr("id", "to_timestamp(t) t")
    df.write.parquet(str(source))
    query = stream_digests(spark.readStream.schema(df.schema).parquet(str(source)), "t", "id", lambda b, n: seen.extend(r.id for r in b.collect()), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted(seen) == [1, 2]


def test_settings_from_files(tmp_path, monkeypatch):
    monkeypatch.setenv("FOLIO_DAYS", "7")
    (tmp_path / "base.json").write_text(json.dumps({"topk": 4, "categories": {"a": ["x"], "b": {"c": 1, "d": "at ${FOLIO_DAYS} days"}}, "language": "${NO_SUCH_NAME:German}", "max_pinned": "${NO_SUCH_NAME}"}))
    (tmp_path / "custom.toml").write_text('topk = 9\n[categories.b]\nc = 2\n')
    c = DigestConfig.read(str(tmp_path / "base.json"), str(tmp_path / "custom.toml"))
    assert (c.k, c.language, c.categories) == (9, "German", {"a": ["x"], "b": {"c": 2, "d": "at 7 days"}}) and c.max_pinned is None
    assert DigestConfig.read(str(tmp_path / "base.json"), str(tmp_path / "none.json")).k == 4
    with pytest.raises(ValueError):
        (tmp_path / "x.ini").write_text("")
        DigestConfig.read(str(tmp_path / "x.ini"))


def test_full_texts_are_fetched_for_the_chosen_only(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def page(i):
        seen.add(1)
        return f"<html><body><p>Fetched {i}</p>\n<p>University of Y</p></body></html>" if i != 3 else None

    corpus, papers = spark.createDataFrame(CORPUS, CORPUS_SCHEMA), spark.createDataFrame(PAPERS, PAPER_SCHEMA).withColumn("full_text", F.when(F.col("id") == 6, "its own").otherwise(F.lit(None).cast("string")))
    run = DigestPipeline(DigestConfig(max_papers=4, include_path=["a/*"]), fetch=lambda few: few.withColumn("html", page("id")))
    rows = {r.id: r for r in run.enriched(run.chosen(run.scored(papers, run.library(corpus)))).collect()}
    assert len(rows) == 4 and seen.value == 4
    for i, r in rows.items():
        assert r.full_text == ("its own" if i == 6 else None) if i in (3, 6) else f"Fetched {i}" in r.full_text
        assert not {"html", "pdf", "archive"} & set(r.asDict())


def test_api_models_over_a_transport():
    asked = []

    def transport(url, body, headers):
        asked.append((url, body, headers))
        if url.endswith("/embeddings"):
            return {"data": [{"embedding": [float(len(t)), 1.0], "index": i} for i, t in reversed(list(enumerate(body["input"])))]}
        return {"choices": [{"message": {"content": "said " + body["messages"][-1]["content"]}}]}

    vectors = providers.ApiEmbedder("http://api.test/v1/", "k", "m", transport).embed(["a", "bbb"])
    assert vectors.tolist() == [[1.0, 1.0], [3.0, 1.0]] and asked[0][0] == "http://api.test/v1/embeddings" and asked[0][2] == {"Authorization": "Bearer k"}
    writer = providers.ApiWriter("http://api.test/v1", "k", "m", transport, role="a helper", max_tokens=5)
    assert writer.write("hello") == "said hello" and asked[1][1] == {"model": "m", "max_tokens": 5, "messages": [{"role": "system", "content": "a helper"}, {"role": "user", "content": "hello"}]}
    with pytest.raises(ValueError):
        providers.checked_vectors([[1.0, 2.0]], 2)
    with pytest.raises(TypeError):
        providers.register_model({}, "x", int, "embed")
    registry: dict = {}
    providers.register_model(registry, "hash", providers.HashEmbedder, "embed")
    assert registry["hash"] is providers.HashEmbedder
    with pytest.raises(RuntimeError):
        providers.LocalEmbedder("none")


def test_prompts_are_clipped_by_the_tokens_of_a_tokenizer():
    class Letters:
        def encode(self, text):
            return [ord(c) for c in text]

        def decode(self, ids):
            return "".join(map(chr, ids))

    assert clipped("a bc d", 3, Letters()) == "a b" and clipped("ab", 3, Letters()) == "ab"


def test_feed_projection_and_helpers(spark, tmp_path):
    feed = (
        '<feed><title>ok</title><entry><id>1</id><title>T</title><author><name>Ann Boe</name></author><author><name>B Coe</name></author><link href="http://x.test/abs/1" rel="alternate" type="text/html"/>'
        '<link href="http://x.test/pdf/1v2" rel="related" type="application/pdf" title="pdf"/><category term="cs.LG"/><category term="cs.AI"/></entry>'
        '<entry xmlns:dc="http://dc"><id>2</id><title>U</title><dc:creator>Ann Boe, B Coe</dc:creator><link href="http://x.test/abs/2"/></entry><entry><id>3</id></entry></feed>'
    )
    (tmp_path / "f.xml").write_text(feed)
    rows = readers.read_feed(spark, str(tmp_path / "f.xml")).orderBy("ord").collect()
    assert [(r.authors, r.url, r.pdf_url, r.categories) for r in rows] == [
        (["Ann Boe", "B Coe"], "http://x.test/abs/1", "http://x.test/pdf/1v2", ["cs.LG", "cs.AI"]),
        (["Ann Boe", "B Coe"], "http://x.test/abs/2", "http://x.test/pdf/2", []),
        ([], None, None, []),
    ]
    assert readers.feed_query(["cs.LG", "cs.AI"]) == "cs.LG+cs.AI" and [len(x.split(",")) for x in readers.in_batches([str(i) for i in range(45)])] == [20, 20, 5]
    slow = OSError()
    slow.code = 429
    waits, fails = [], [slow, slow]
    assert readers.retried(lambda: "ok" if not fails else (_ for _ in ()).throw(fails.pop()), 5, readers.growing, readers.too_many, waits.append) == "ok" and waits == [30.0, 60.0]
    with pytest.raises(OSError):
        readers.retried(lambda: (_ for _ in ()).throw(OSError("other")), 5, readers.growing, readers.too_many, waits.append)


def test_records_are_converted_or_left_out(spark):
    def convert(row):
        if row["mode"] == "raises":
            raise RuntimeError
        return None if row["mode"] == "none" else {"title": row["title"].upper(), "n": len(row["title"])}

    df = spark.createDataFrame([("a", "ok"), ("b", "raises"), ("c", "none"), ("dd", "ok")], "title string, mode string").coalesce(1)
    assert [(r.title, r.n) for r in readers.converted(df, convert, "title string, n int").collect()] == [("A", 1), ("DD", 2)]
    assert readers.converted(df.where("false"), convert, "title string, n int").count() == 0
    assert [n for n, _ in readers.gathered(["x", "nowhere"], {"x": lambda: df})] == ["x"]


def test_live_library_is_read_page_by_page(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            at, n = int(q["start"][0]), int(q["limit"][0])
            body = json.dumps([{"key": str(i)} for i in range(at, min(23, at + n))]).encode()
            self.send_response(200)
            self.send_header("Total-Results", "23")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(readers.LibrarySource)
        rows = spark.read.format("library").option("url", f"http://127.0.0.1:{server.server_port}/items").option("page", 10).load()
        assert sorted(int(json.loads(r.item)["key"]) for r in rows.collect()) == list(range(23)) and rows.rdd.getNumPartitions() == 3
    finally:
        server.shutdown()
