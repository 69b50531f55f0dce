"""Queries of the library, the ranking and the digest."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.globs import glob_match
from folioflow.operators import corpus as C
from folioflow.operators import feeds
from folioflow.operators.bm25 import best_of, bm25
from folioflow.operators.pages import html_text
from folioflow.operators.pinning import pin
from folioflow.operators.ranking import top_n, topk_mean
from folioflow.operators.tex import expand_archives
from folioflow.plans.config import DigestConfig
from folioflow.plans.pipeline import DigestPipeline
from folioflow.plans.providers import written
from folioflow.plans.render import EMPTY, block, page
from folioflow.tables import table

KEYWORDS = ["dosage", "protein"]
INCLUDE, IGNORE = ["2022/**", "202?/survey", "Projects/*"], ["**/[[]done[]]", "2024/*"]
BM25_QUERY = "tensor matching on sensor networks, tensor"
GOOD_VEC = "vec IS NOT NULL AND len(vec) = 64 AND list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AND NOT isnan(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) AND NOT isinf(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE)))"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "abstract_vectors")
    return v.where("kind = 'paper'").select(F.col("ref_id").alias("id"), "vec"), v.where("kind = 'corpus'").select("vec")


def _scores(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    papers, library = _vectors(spark, d)
    return topk_mean(papers, library, k).select("id", F.round("score", 6).alias("score"))


def rank_topk_mean(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def rank_topk1(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, 1)


def rank_topk_ge_n(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, 1_000_000)


def rank_empty_corpus(spark: SparkSession, d: str) -> DataFrame:
    papers, library = _vectors(spark, d)
    return topk_mean(papers, library.where("false"))


def topn_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_scores(spark, d), 100)


def _score_sql(k: int) -> str:
    return f"""
        WITH good AS (SELECT kind, ref_id, vec::DOUBLE[] AS v FROM abstract_vectors WHERE {GOOD_VEC}),
        sims AS (SELECT p.ref_id AS id, list_cosine_similarity(p.v, c.v) AS sim FROM good p, good c WHERE p.kind = 'paper' AND c.kind = 'corpus'),
        best AS (SELECT id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS r FROM sims),
        scores AS (SELECT id, round(avg(sim) * 10, 6) AS score FROM best WHERE r <= {k} GROUP BY id)"""


def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.embedding_text(F.col("title"), F.col("abstract")).alias("said"))


def pin_keyword_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.matches_any(F.col("title"), F.col("abstract"), KEYWORDS).alias("is_match"))


def _pinned(spark: SparkSession, d: str, overflow: str) -> DataFrame:
    papers = table(spark, d, "papers").select(F.col("paper_id").alias("id"), "score", T.matches_any(F.col("title"), F.col("abstract"), KEYWORDS).alias("is_match"))
    return pin(papers, "is_match", 20, 100, overflow).select("id", "score", "is_match", "pinned", "section", F.col("position").cast("long").alias("position"))


def pin_cap_overflow_compat(spark: SparkSession, d: str) -> DataFrame:
    return _pinned(spark, d, "compat")


def pin_cap_overflow_by_score(spark: SparkSession, d: str) -> DataFrame:
    return _pinned(spark, d, "by_score")


def digest_sections(spark: SparkSession, d: str) -> DataFrame:
    return _pinned(spark, d, "compat").groupBy("section").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.round(F.max("score"), 6).alias("best"))


_MATCH = "(contains(lower(coalesce(title, '') || chr(10) || coalesce(abstract, '')), 'dosage') OR contains(lower(coalesce(title, '') || chr(10) || coalesce(abstract, '')), 'protein'))"


def _pin_sql(overflow: str) -> str:
    ahead = "is_match DESC, " if overflow == "compat" else ""
    shown = "is_match" if overflow == "compat" else "pinned"
    return f"""
        WITH c AS (SELECT paper_id AS id, score, {_MATCH} AS is_match FROM papers),
        e AS (SELECT *, is_match AND row_number() OVER (PARTITION BY is_match ORDER BY score DESC NULLS LAST, id) <= 20 AS pinned FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY pinned ORDER BY {ahead}score DESC NULLS LAST, id) AS fr FROM e),
        g AS (SELECT id, score, is_match, pinned, CASE WHEN {shown} THEN 'pinned' ELSE 'recommended' END AS section FROM f WHERE pinned OR fr <= 100),
        placed AS (SELECT *, row_number() OVER (ORDER BY section, score DESC NULLS LAST, id) AS position FROM g)"""


def corpus_paths_recursive(spark: SparkSession, d: str) -> DataFrame:
    return C.collection_paths(table(spark, d, "collections"))


_PATHS_SQL = """
        WITH RECURSIVE t AS (SELECT collection_key, coalesce(collection_name, '') AS name, CASE WHEN parent_collection IN (SELECT collection_key FROM collections) THEN parent_collection END AS parent FROM collections),
        w AS (SELECT collection_key, name AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.collection_key, w.path || '/' || t.name FROM w JOIN t ON t.parent = w.collection_key)"""


def item_collections_join(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", F.when(F.col("collection_key").isNotNull(), F.array("collection_key")).otherwise(F.array().cast("array<string>")).alias("keys"))
    joined = C.with_paths(documents, "keys", corpus_paths_recursive(spark, d), "doc_id")
    return joined.select("doc_id", F.array_join("paths", " | ").alias("paths"))


def _library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_papers").select("corpus_id", "paths")


def corpus_include_glob(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_paths(_library(spark, d), include=INCLUDE).select("corpus_id")


def corpus_ignore_glob(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_paths(_library(spark, d), ignore=IGNORE).select("corpus_id")


def corpus_include_ignore(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_paths(_library(spark, d), INCLUDE, IGNORE).select("corpus_id")


def path_matches(spark: SparkSession, d: str) -> DataFrame:
    paths = _library(spark, d).select("corpus_id", F.posexplode("paths").alias("at", "path"))
    return paths.select("corpus_id", "at", *[glob_match(F.col("path"), p).alias(n) for n, p in (("below", "2022/**"), ("second", "*/survey"))])


# The same patterns without look-ahead, written by hand.
_IN = r"regexp_full_match(p, '2022/(([^/.][^/]*)/)*([^/.][^/]*)?|202[^/]/survey|Projects/[^/.][^/]*')"
_OUT = r"regexp_full_match(p, '(([^/.][^/]*)/)*\[done\]|2024/[^/.][^/]*')"
_HAS = "coalesce(list_bool_or(list_transform(paths, lambda p: {})), false)"


def non_empty_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.with_abstract(table(spark, d, "corpus_papers")).select("corpus_id")


def announce_type_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "new").when(F.col("event_type") == "click", "cross").when(F.col("event_type") == "error", None).otherwise("replace")
    return feeds.announced(table(spark, d, "events").withColumn("kind", kind), "kind", True).select("event_id")


def latest_date_then_category(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.latest(table(spark, d, "preprint_items"), "item_date")
    return feeds.in_categories(rows, "category", ["Neurology", "cardiology", "nephrology", "zoology", "genomics", "epidemiology"]).select("item_id")


def preprint_projection(spark: SparkSession, d: str) -> DataFrame:
    return feeds.preprint_papers(table(spark, d, "preprint_items")).select(F.col("ord").alias("item_id"), "url", F.array_join("authors", "|").alias("authors"))


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").select(F.col("paper_id").alias("ord"), "title")
    items = table(spark, d, "preprint_items").select(F.col("item_id").alias("ord"), "title")
    library = table(spark, d, "corpus_papers").select(F.col("corpus_id").alias("ord"), "title")
    return feeds.united(("papers", papers), ("preprints", items), ("library", library)).select(F.col("source_no").cast("int").alias("source_no"), "ord", "title")


def debug_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").orderBy("paper_id").limit(10).select("paper_id", "title")


def id_lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "abstract_vectors").where("kind = 'paper'").select(F.col("ref_id").alias("paper_id"), "vec_id")
    return feeds.looked_up(ids, table(spark, d, "papers").select("paper_id", "title"), "paper_id")


def author_split_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "preprint_items").select("item_id", F.array_join(T.split_names(F.col("authors")), "|").alias("names"), F.size(T.split_names(F.col("authors"))).alias("n"))


def author_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.shown_authors(F.col("authors")).alias("shown"))


def affiliation_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.shown_affiliations(F.col("affiliations")).alias("shown"))


def affiliation_parse(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Here they are: "), F.to_json("affiliations"), F.lit(" as asked"))
    return table(spark, d, "papers").select("paper_id", F.array_join(F.array_sort(T.listed(answer)), "|").alias("names"))


def score_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.shown_score(F.col("score")).alias("shown"))


def star_rating(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.stars(F.col("score")).alias("stars"))


def url_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.source_url(F.col("pdf_url")).alias("source_url"), T.html_url(F.col("url")).alias("html_url"))


def id_prefix_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.feed_id(F.col("url")).alias("bare"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def bm25_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "lang")
    return best_of(bm25(documents, "lang", "doc_id", "text", BM25_QUERY)).select(F.col("group").alias("lang"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def tex_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tex_clean(F.col("text")).alias("clean"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.summary_prompt(F.col("title"), F.col("abstract"), F.col("full_text")).alias("prompt"), T.affiliation_prompt(F.col("full_text")).alias("asked"))


def fulltext_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select("paper_id", T.first_text(F.col("full_text"), F.col("tldr"), F.col("abstract")).alias("said"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source = 'html_page'").select("doc_id", html_text(F.col("text")).alias("said"))


def tar_main_tex(spark: SparkSession, d: str) -> DataFrame:
    @F.udf("binary")
    def packed(text: str) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, body in (("main.tex", text), ("intro.tex", "An introduction.\n"), ("sample.tex", r"\begin{document}no\end{document}")):
                info = tarfile.TarInfo(name)
                info.size = len(body.encode())
                tar.addfile(info, io.BytesIO(body.encode()))
        return out.getvalue()

    sources = table(spark, d, "documents").where("source = 'tex_source' and text is not null").select("doc_id", packed("text").alias("archive"), F.lit("An introduction").alias("title"))
    return expand_archives(sources, "doc_id", "archive", "title").select(F.col("id").alias("doc_id"), "main_path", "text")


def tldr_offline(spark: SparkSession, d: str) -> DataFrame:
    top = _pinned(spark, d, "compat").select(F.col("id").alias("paper_id"))
    papers = table(spark, d, "papers").join(top, "paper_id", "left_semi")
    asked = T.summary_prompt(F.col("title"), F.col("abstract"), F.lit(None).cast("string"))
    return papers.select("paper_id", F.coalesce(written(asked, "first_sentence", 4000), "abstract").alias("tldr"))


def affiliations_offline(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").where("full_text is not null")
    return papers.select("paper_id", F.array_join(T.listed(written(T.affiliation_prompt(F.col("full_text")), "capital_lines", 2000)), "|").alias("names"))


def digest_html(spark: SparkSession, d: str) -> DataFrame:
    top = _pinned(spark, d, "compat")
    papers = table(spark, d, "papers").select(F.col("paper_id").alias("id"), "title", "authors", "affiliations", "tldr", "pdf_url")
    shown = block(F.col("title"), F.col("authors"), F.col("affiliations"), F.col("score"), F.col("tldr"), F.col("pdf_url"), F.col("pinned"))
    return page(top.join(papers, "id").select("section", "position", shown.alias("block")))


def digest_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline on papers and library texts with the offline models: the survivors in their order."""
    run = DigestPipeline(DigestConfig(pin_keywords=KEYWORDS, include_path=["202*/**", "Projects/**"]))
    papers = table(spark, d, "papers").select(F.col("paper_id").alias("id"), "title", "authors", "abstract", "url", "full_text")
    library = run.library(table(spark, d, "corpus_papers"))
    return run.enriched(run.chosen(run.scored(papers, library))).select(F.col("id").alias("paper_id"), "section", "position", "tldr")


_NAMES = """
    rank_topk_mean rank_topk1 rank_topk_ge_n rank_empty_corpus topn_recommendations embedding_texts pin_keyword_match pin_cap_overflow_compat pin_cap_overflow_by_score digest_sections
    corpus_paths_recursive item_collections_join corpus_include_glob corpus_ignore_glob corpus_include_ignore path_matches non_empty_filter announce_type_filter latest_date_then_category
    preprint_projection union_sources debug_limit id_lookup_inner author_split_join author_truncate affiliation_truncate affiliation_parse score_display star_rating url_rewrite id_prefix_strip
    tokenize_counts bm25_best_per_group tex_clean prompt_build fulltext_fallback html_to_text tar_main_tex tldr_offline affiliations_offline digest_html digest_end_to_end"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = "regexp_replace(@, '^" + _WS + "+|" + _WS + "+$', '', 'g')"
_TERMS = ["tensor", "matching", "on", "sensor", "networks"]
def _safe(text: str) -> str:
    """SQL of a text for HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{raw}', '{safe}')"
    return text


_AUTHORS_SQL = "coalesce(CASE WHEN len(authors) <= 5 THEN array_to_string(authors, ', ') ELSE array_to_string(list_concat(list_concat(authors[1:3], ['...']), authors[-2:]), ', ') END, '')"
_PLACES_SQL = "CASE WHEN affiliations IS NULL THEN 'Unknown Affiliation' ELSE coalesce(array_to_string(affiliations[1:5], ', '), '') || CASE WHEN len(affiliations) > 5 THEN ', ...' ELSE '' END END"
_PAGE_SQL = f""", b AS (SELECT section, position, '<div class=''paper''><h3>' || CASE WHEN placed.pinned THEN '<b>Pinned</b> ' ELSE '' END || {_safe("coalesce(title, '')")} || '</h3><p>' || {_safe(_AUTHORS_SQL)} || '</p><p><i>' || {_safe(_PLACES_SQL)}
        || '</i></p><p>Relevance: ' || coalesce(printf('%.1f', placed.score), 'Unknown') || '</p><p>' || {_safe("coalesce(tldr, '')")} || '</p><a href=''' || {_safe("coalesce(pdf_url, '')")} || '''>PDF</a></div>' AS block FROM placed JOIN papers ON placed.id = papers.paper_id),
        s AS (SELECT section, string_agg(block, '' ORDER BY position) AS blocks FROM b GROUP BY section)
        SELECT CASE WHEN count(*) = 0 THEN '{EMPTY}' ELSE '<html><body>' || coalesce('<h2>Pinned</h2>' || max(blocks) FILTER (WHERE section = 'pinned'), '') || coalesce('<h2>Recommended</h2>' || max(blocks) FILTER (WHERE section = 'recommended'), '') || '</body></html>' END AS html FROM s"""
ORACLE = {
    "rank_topk_mean": _score_sql(10) + " SELECT * FROM scores",
    "rank_topk1": _score_sql(1) + " SELECT * FROM scores",
    "rank_topk_ge_n": _score_sql(1_000_000) + " SELECT * FROM scores",
    "rank_empty_corpus": f"SELECT ref_id AS id, 0.0::DOUBLE AS score FROM abstract_vectors WHERE kind = 'paper' AND {GOOD_VEC}",
    "topn_recommendations": _score_sql(10) + ", r AS (SELECT *, (row_number() OVER (ORDER BY score DESC, id))::INT AS rank FROM scores) SELECT * FROM r WHERE rank <= 100",
    "embedding_texts": f"SELECT paper_id, {_STRIP.replace('@', "coalesce(title, '') || chr(10) || coalesce(abstract, '')")} AS said FROM papers",
    "pin_keyword_match": f"SELECT paper_id, {_MATCH} AS is_match FROM papers",
    "pin_cap_overflow_compat": _pin_sql("compat") + " SELECT * FROM placed",
    "pin_cap_overflow_by_score": _pin_sql("by_score") + " SELECT * FROM placed",
    "digest_sections": _pin_sql("compat") + " SELECT section, count(*) AS n, min(position) AS first_position, round(max(score), 6) AS best FROM placed GROUP BY section",
    "corpus_paths_recursive": _PATHS_SQL + " SELECT collection_key, path FROM w",
    "item_collections_join": _PATHS_SQL + " SELECT doc_id, coalesce(path, '') AS paths FROM documents d LEFT JOIN w ON d.collection_key = w.collection_key",
    "corpus_include_glob": f"SELECT corpus_id FROM corpus_papers WHERE {_HAS.format(_IN)}",
    "corpus_ignore_glob": f"SELECT corpus_id FROM corpus_papers WHERE NOT {_HAS.format(_OUT)}",
    "corpus_include_ignore": f"SELECT corpus_id FROM corpus_papers WHERE {_HAS.format(_IN)} AND NOT {_HAS.format(_OUT)}",
    "path_matches": r"""SELECT corpus_id, (i - 1)::INT AS "at", regexp_full_match(p, '2022/(([^/.][^/]*)/)*([^/.][^/]*)?') AS below, regexp_full_match(p, '[^/.][^/]*/survey') AS second FROM (SELECT corpus_id, unnest(paths) AS p, generate_subscripts(paths, 1) AS i FROM corpus_papers)""",
    "non_empty_filter": "SELECT corpus_id FROM corpus_papers WHERE abstract <> ''",
    "announce_type_filter": "SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'error')",
    "latest_date_then_category": "SELECT item_id FROM preprint_items WHERE item_date = (SELECT max(item_date) FROM preprint_items) AND category IN ('neurology', 'cardiology', 'nephrology', 'zoology', 'genomics', 'epidemiology')",
    "preprint_projection": f"SELECT item_id, 'https://www.' || server || '.org/content/' || doi || 'v' || item_version || '.full.pdf' AS url, array_to_string(list_transform(string_split(authors, ';'), lambda x: {_STRIP.replace('@', 'x')}), '|') AS authors FROM preprint_items",
    "union_sources": "SELECT 0 AS source_no, paper_id AS ord, title FROM papers UNION ALL SELECT 1, item_id, title FROM preprint_items UNION ALL SELECT 2, corpus_id, title FROM corpus_papers",
    "debug_limit": "SELECT paper_id, title FROM papers ORDER BY paper_id LIMIT 10",
    "id_lookup_inner": "SELECT p.paper_id, v.vec_id, p.title FROM abstract_vectors v JOIN papers p ON v.ref_id = p.paper_id WHERE v.kind = 'paper'",
    "author_split_join": f"SELECT item_id, array_to_string(list_transform(string_split(authors, ';'), lambda x: {_STRIP.replace('@', 'x')}), '|') AS names, len(string_split(authors, ';'))::INT AS n FROM preprint_items",
    "author_truncate": "SELECT paper_id, coalesce(CASE WHEN len(authors) <= 5 THEN array_to_string(authors, ', ') ELSE array_to_string(list_concat(list_concat(authors[1:3], ['...']), authors[-2:]), ', ') END, '') AS shown FROM papers",
    "affiliation_truncate": "SELECT paper_id, CASE WHEN affiliations IS NULL THEN 'Unknown Affiliation' ELSE coalesce(array_to_string(affiliations[1:5], ', '), '') || CASE WHEN len(affiliations) > 5 THEN ', ...' ELSE '' END END AS shown FROM papers",
    "affiliation_parse": "SELECT paper_id, CASE WHEN contains(array_to_string(affiliations, '|'), ']') THEN NULL ELSE array_to_string(list_sort(list_distinct(affiliations)), '|') END AS names FROM papers",
    "score_display": "SELECT paper_id, coalesce(printf('%.1f', score), 'Unknown') AS shown FROM papers",
    "star_rating": "SELECT paper_id, CASE WHEN score IS NULL OR score <= 6 THEN '' WHEN score >= 8 THEN repeat('★', 5) ELSE repeat('★', (ceil((score - 6) / 0.2::DOUBLE)::INT // 2)) || repeat('☆', ceil((score - 6) / 0.2::DOUBLE)::INT % 2) END AS stars FROM papers",
    "url_rewrite": "SELECT paper_id, replace(pdf_url, '/pdf/', '/src/') AS source_url, replace(url, '/abs/', '/html/') AS html_url FROM papers",
    "id_prefix_strip": r"SELECT paper_id, regexp_replace(url, '^oai:[a-zA-Z.]+:', '') AS bare FROM papers",
    "tokenize_counts": "SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS token FROM documents) GROUP BY token",
    "bm25_best_per_group": "WITH t AS (SELECT lang, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+'), lambda x: lower(x)) AS w FROM documents), f AS (SELECT lang, doc_id, len(w)::DOUBLE AS l, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS f{i}" for i, t in enumerate(_TERMS))
    + " FROM t), s AS (SELECT lang, count(*)::DOUBLE AS n, avg(l) AS a, "
    + ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END)::DOUBLE AS n{i}" for i in range(len(_TERMS)))
    + " FROM f GROUP BY lang), q AS (SELECT f.lang, f.doc_id, "
    + " + ".join(f"{2 if t == 'tensor' else 1}::DOUBLE * ln((s.n - s.n{i} + 0.5::DOUBLE) / (s.n{i} + 0.5::DOUBLE) + 1::DOUBLE) * f.f{i} * 2.5::DOUBLE / (f.f{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.l / greatest(s.a, 1::DOUBLE)))" for i, t in enumerate(_TERMS))
    + " AS score FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM q) SELECT lang, doc_id, round(score, 6) AS score FROM r WHERE k = 1",
    "tex_clean": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%[^\n]*\n', chr(10), 'g'), '(?s)\\begin\{comment\}.*?\\end\{comment\}', '', 'g'), '(?s)\\iffalse.*?\\fi', '', 'g'), '\n+', chr(10), 'g'), '\\\\', '', 'g'), '[ \t\r\f]{3,}', ' ', 'g') AS clean FROM documents""",
    "prompt_build": """SELECT paper_id, CASE WHEN coalesce(length(abstract), 0) = 0 AND coalesce(length(full_text), 0) = 0 THEN 'No text to summarise.' ELSE 'Summarise this paper in one sentence of English.' || chr(10) || chr(10)
        || CASE WHEN length(title) > 0 THEN 'Title:' || chr(10) || title || chr(10) || chr(10) ELSE '' END || CASE WHEN length(abstract) > 0 THEN 'Abstract:' || chr(10) || abstract || chr(10) || chr(10) ELSE '' END
        || CASE WHEN length(full_text) > 0 THEN 'Text:' || chr(10) || full_text || chr(10) || chr(10) ELSE '' END END AS prompt,
        'List the authors'' organisations as a JSON array of strings, in the order of the authors.' || chr(10) || chr(10) || full_text AS asked FROM papers""",
    "tldr_offline": _pin_sql("compat") + r""", p AS (SELECT paper_id, CASE WHEN coalesce(length(abstract), 0) = 0 THEN 'No text to summarise.' ELSE 'Summarise this paper in one sentence of English.' || chr(10) || chr(10)
        || CASE WHEN length(title) > 0 THEN 'Title:' || chr(10) || title || chr(10) || chr(10) ELSE '' END || 'Abstract:' || chr(10) || abstract || chr(10) || chr(10) END AS prompt FROM papers JOIN placed ON placed.id = papers.paper_id),
        a AS (SELECT paper_id, prompt, regexp_matches(prompt, '(?s)Abstract:\n.*?\n\n') AS has, """ + _STRIP.replace("@", r"regexp_extract(prompt, '(?s)Abstract:\n(.*?)\n\n', 1)") + """ AS said FROM p)
        SELECT paper_id, CASE WHEN NOT has THEN left(prompt, 100) WHEN regexp_matches(said, '(?s)^.*?[.!?]""" + _WS + """') THEN regexp_extract(said, '(?s)^(.*?[.!?])""" + _WS + """', 1) ELSE said END AS tldr FROM a""",
    "digest_html": _pin_sql("compat") + _PAGE_SQL,
    "fulltext_fallback": "SELECT paper_id, coalesce(nullif(full_text, ''), nullif(tldr, ''), nullif(abstract, '')) AS said FROM papers",
}
