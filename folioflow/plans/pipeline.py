"""The whole digest: filter the library, score, pin, choose, enrich the chosen, render."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import affiliation_prompt, embedding_text, first_text, listed, matches_any, summary_prompt
from folioflow.lineage import cut
from folioflow.operators.corpus import filter_paths, with_abstract
from folioflow.operators.pinning import pin
from folioflow.operators.ranking import topk_mean
from folioflow.plans.config import DigestConfig
from folioflow.plans.fulltext import full_text
from folioflow.plans.providers import Tokens, embedded, written
from folioflow.plans.render import EMPTY, block, page

log = logging.getLogger(__name__)


class DigestPipeline:
    """corpus: corpus_id, title, abstract, paths. candidates: id, title, authors, abstract, url, full_text.

    Candidates may also have what was landed of them: archive (binary), html
    (string) and pdf (binary). fetch, a function of the chosen papers, may add
    these columns: it runs after the choice, so nothing is fetched in vain.
    tokens: makes the tokenizer that prompts are clipped by.
    """

    def __init__(self, config: DigestConfig, embedder: str = "hash", writer: str = "first_sentence", organisations: str = "capital_lines", dim: int = 64, fetch: Callable[[DataFrame], DataFrame] | None = None, tokens: Callable[[], Tokens] | None = None):
        self.config, self.embedder, self.writer, self.organisations, self.dim, self.fetch, self.tokens = config, embedder, writer, organisations, dim, fetch, tokens

    def library(self, corpus: DataFrame) -> DataFrame:
        return filter_paths(with_abstract(corpus), self.config.include_path, self.config.ignore_path)

    def scored(self, candidates: DataFrame, library: DataFrame) -> DataFrame:
        """candidates with score; those without a vector of their own have 0."""
        text = embedding_text(F.col("title"), F.col("abstract"))
        asked = candidates.select("id", embedded(text, self.embedder).alias("vec"))
        base = library.select(embedded(text, self.embedder).alias("vec"))
        scores = topk_mean(asked, base, self.config.k, self.dim)
        return candidates.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

    def chosen(self, scored: DataFrame) -> DataFrame:
        """The survivors, before anything dear is done with them."""
        c = self.config
        tagged = scored.withColumn("is_match", matches_any(F.col("title"), F.col("abstract"), c.keywords))
        n = 1 << 31 if c.max_papers is None else max(0, c.max_papers)
        return pin(tagged, "is_match", c.cap, min(n, (1 << 31) - 1 - c.cap), c.overflow)

    def enriched(self, chosen: DataFrame) -> DataFrame:
        """Full texts, summaries (the abstract where the model fails) and organisations of the survivors, computed once."""
        few = cut(chosen).repartition(self.config.enrich_tasks)
        few = self.fetch(few) if self.fetch else few
        landed = {"archive": "binary", "html": "string", "pdf": "binary"}
        if set(landed) & set(few.columns):  # only papers without a full text go through the tiers, each once
            open_ = F.coalesce(F.length("full_text"), F.lit(0)) == 0
            tier = [F.when(open_, F.col(c)) if c in few.columns else F.lit(None).cast(kind) for c, kind in landed.items()]
            few = cut(few.withColumn("full_text", first_text(F.col("full_text"), full_text(*tier, F.col("title"), self.config.extract_seconds))).drop(*landed))
        asked = summary_prompt(F.col("title"), F.col("abstract"), F.col("full_text"), self.config.language)
        told = few.withColumn("tldr", F.coalesce(written(asked, self.writer, self.config.summary_tokens, self.tokens), "abstract"))
        told = told.withColumn("affiliations", listed(written(affiliation_prompt(F.col("full_text")), self.organisations, self.config.affiliation_tokens, self.tokens)))
        return cut(told)

    def run(self, corpus: DataFrame, candidates: DataFrame) -> str | None:
        """The page, or None where nothing is to be sent."""
        library = cut(self.library(corpus))
        if library.isEmpty():
            log.error("no library items are left; nothing is sent")
            return None
        if self.config.debug:
            candidates = candidates.orderBy("id").limit(self.config.debug_rows)
        if candidates.isEmpty():
            return EMPTY if self.config.send_empty else None
        digest = self.enriched(self.chosen(self.scored(candidates, library)))
        shown = digest.withColumn("block", block(F.col("title"), F.col("authors"), F.col("affiliations"), F.col("score"), F.col("tldr"), F.col("url"), F.col("pinned")))
        return page(shown).first()["html"]
