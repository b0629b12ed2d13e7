"""The engine as one object: build, open, look up, search, extend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import TAGS
from textmill.operators import postings as po
from textmill.operators import search as se
from textmill.operators import simhash as sh
from textmill.operators import words as wo
from textmill.session import cut_lineage
from textmill.sources import index_store as store
from textmill.sources.index_store import IndexOptions
from textmill.sources.json_pages import first_urls

NO_SUMMARY = "No summary is available."


class Engine:
    """An opened index: the newest build at ``path``, or ``tables`` that were never written. ``summarize`` is an optional callable from
    a page's text to a summary."""

    def __init__(self, spark: SparkSession, path: str | None, summarize: Callable[[str], str] | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.path, self.summarize = spark, path, summarize
        self.opened = store.newest(spark, path) if tables is None else None
        tables = tables or store.load(spark, self.opened)
        self.postings, self.norms, self.documents = (tables[t] for t in ("postings", "norms", "documents"))
        self.vectors = tables["vectors"].select("doc_id", "token", "n")
        self._surface, self._hashes = tables["vectors"], tables.get("hashes")
        facts = tables["manifest"].first()
        self.page_count, self.name, self.options = facts.n_docs, facts.name, IndexOptions(*(facts[k] for k in IndexOptions.__dataclass_fields__))

    @staticmethod
    def build(spark: SparkSession, pages: DataFrame, path: str | None, options: IndexOptions | None = None, *, load_existing: bool = False, persist: bool = True, lexicon: DataFrame | None = None) -> Engine:
        """Index pages (doc_id, path, url, content); rows without content are skipped, a new build at ``path`` replaces an older one.

        ``load_existing``: open what is at ``path`` if there is a complete build. ``persist=False``: write no index; the tables live in the
        checkpoint folder and end with the session. ``lexicon`` (token): the forms that are lemmas, instead of the collection's own
        vocabulary. Tag counts and vectors come from one parse."""
        if load_existing and path and store.builds(spark, path):
            return Engine(spark, path)
        options = options or IndexOptions()
        docs, hashes = pages.where(F.col("content").isNotNull()), None
        if options.drop_near_duplicates:
            hashes = sh.simhashes(docs, "doc_id", "content")
            docs = docs.join(sh.kept(hashes), "doc_id", "left_semi")
        return Engine._made(spark, path if persist else None, options, Engine._counts(docs, options), docs.select("doc_id", "path", "url"), hashes, lexicon)

    @staticmethod
    def _counts(docs: DataFrame, options: IndexOptions) -> DataFrame:
        return po.plain_postings(po.word_frequencies(docs, "doc_id", "content")) if options.plain_text else po.tag_frequencies(docs, "doc_id", "content")

    @staticmethod
    def _made(spark: SparkSession, path: str | None, options: IndexOptions, counts: DataFrame, documents: DataFrame, hashes: DataFrame | None, lexicon: DataFrame | None) -> Engine:
        """An index of surface tag counts, which are counted once and kept in the checkpoint folder. With lemmas the vectors keep the
        tag counts, from which lemmas are made anew."""
        counts = cut_lineage(counts)
        vectors = surface = counts.select("doc_id", "token", F.col("tf").alias("n"))
        indexed = counts
        if options.lemmatize:
            lemmas = wo.lemma_map(counts.select("token").distinct(), lexicon)
            sums = [F.sum(c).alias(c) for c in (*(f"f_{t}" for t in TAGS), "tf")]
            indexed = counts.join(lemmas, "token").groupBy("doc_id", F.col("lemma").alias("token")).agg(*sums)
            surface = counts.withColumnRenamed("tf", "n")
        norms = po.norms(vectors)
        if path:
            store.save(path, options, indexed, surface, norms, documents, hashes)
            return Engine(spark, path)
        tables = {"postings": indexed, "vectors": surface, "norms": norms, "documents": documents} | ({"hashes": hashes} if hashes is not None else {})
        tables = {k: cut_lineage(t) for k, t in tables.items()}
        return Engine(spark, None, None, tables | {"manifest": store.facts(options, tables["documents"])})

    def extended(self, pages: DataFrame, path: str | None, lexicon: DataFrame | None = None) -> Engine:
        """A new index at ``path`` (that of this one, if you like; None: not written) of this one's documents and more pages (ids not used
        before): what a build of all of them with this index's options gives. Lemmas are found over the old and new vocabulary (or the
        lexicon), near duplicates over old and new pages (also those left out before). df and page count are counted anew."""
        old, documents, hashes = self.postings, self.documents, None
        docs = pages.where(F.col("content").isNotNull())
        if self.options.lemmatize:
            if "f_other" not in self._surface.columns:
                raise ValueError("the index holds no tag counts of surface forms; build it anew")
            old = self._surface.withColumnRenamed("n", "tf")
        if self.options.drop_near_duplicates:
            known = self._hashes if self._hashes is not None else store.load_hashes(self.spark, self.opened)
            hashes = known.unionByName(sh.simhashes(docs, "doc_id", "content"))
            kept = sh.kept(hashes)
            old, documents, docs = (t.join(kept, "doc_id", "left_semi") for t in (old, documents, docs))
        counts = old.unionByName(Engine._counts(docs, self.options))
        return Engine._made(self.spark, path, self.options, counts, documents.unionByName(docs.select("doc_id", "path", "url")), hashes, lexicon)

    def tokens(self) -> DataFrame:
        return self.postings.select("token").distinct()

    def items(self) -> DataFrame:
        """(token, df, postings), nested."""
        return po.nested_entries(self.postings)

    def lookup(self, *tokens: str) -> DataFrame:
        """Postings of tokens; unknown ones have none. The filter reaches the Parquet scan."""
        if not all(isinstance(t, str) for t in tokens):
            raise TypeError("tokens are strings")
        return self.postings.where(F.col("token").isin(*tokens))

    def document_frequencies(self) -> DataFrame:
        return po.document_frequencies(self.postings)

    def statistics(self) -> DataFrame:
        return po.statistics(self.documents, self.postings)

    def path_of(self, doc_id: int) -> DataFrame:
        return self.documents.where(F.col("doc_id") == doc_id).select("path")

    def url_of(self, doc_id: int) -> DataFrame:
        return first_urls(self.documents).where(F.col("doc_id") == doc_id).select("url")

    def id_of_url(self, url: str) -> DataFrame:
        return first_urls(self.documents.where(F.col("url") == url)).select("doc_id")

    def id_of_path(self, path: str) -> DataFrame:
        return self.documents.where(F.col("path") == path).select("doc_id")

    def partition_statistics(self) -> DataFrame:
        """Smallest and greatest token and postings of every file of a written index."""
        return po.partition_statistics(self.postings)

    def search(self, queries: DataFrame | str, mode: str = "tokens", depth: int = se.DEPTH, spellcheck: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, tfidf, cosine, url, path) of one query text or a table (query_id, text); empty queries find nothing.
        ``spellcheck``: unknown terms are corrected from the index's vocabulary first (slower; not in mode "strict").

        With few terms (always for one short text) only their postings are read: the terms are a filter that prunes the sorted
        files. For one text the at most ``depth`` documents that are ranked prune the vectors in the same way."""
        single = isinstance(queries, str)
        if single:
            queries = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(queries).alias("text"))
        if spellcheck and mode != "strict":
            queries = se.respelled(queries, self._vocabulary())
        asked = queries
        if self.options.lemmatize and mode != "strict":
            asked = self._lemmatized(queries)
        postings, vectors, norms, documents = self.postings, self.vectors, self.norms, self.documents
        postings = se.of_terms(postings, se.query_terms(asked, mode))
        best = se.top(se.matches(asked, postings, po.document_frequencies(postings), F.lit(self.page_count), mode), depth)
        if single:
            rows = best.collect()
            best = self.spark.createDataFrame(rows, best.schema)
            near = F.col("doc_id").isin(*(r.doc_id for r in rows)) if rows else F.lit(False)
            vectors, norms, documents = vectors.where(near), norms.where(near), self._with_own_url(near)
        else:
            documents = first_urls(documents, "doc_id", "path")
        return se.with_urls(se.rerank(best, queries, vectors, norms), documents)

    def _vocabulary(self) -> DataFrame:
        """(token, df) of surface forms and, with lemmas, also of these: what a query's terms may be."""
        dfs = self.document_frequencies()
        if not self.options.lemmatize:
            return dfs
        return dfs.unionByName(po.document_frequencies(self.vectors)).groupBy("token").agg(F.max("df").alias("df"))

    def _with_own_url(self, chosen) -> DataFrame:
        """(url, doc_id, path) of the chosen documents that are the first of their url."""
        urls = self.documents.where(chosen & (F.col("url") != "")).select("url").distinct()
        return first_urls(self.documents.join(urls, "url", "left_semi"), "doc_id", "path").where(chosen)

    def _lemmatized(self, queries: DataFrame) -> DataFrame:
        """Queries with each term as the lemma under which it is indexed: a term that isn't indexed itself is replaced by its
        best candidate that is."""
        known = self.tokens().withColumnRenamed("token", "form")
        asked = se.query_terms(queries).select("query_id", "token")
        tried = asked.select("query_id", "token", F.explode(F.array_append(wo.lemma_candidates(F.col("token")), F.col("token"))).alias("form")).join(known, "form", "left_semi")
        best = tried.groupBy("query_id", "token").agg(F.min(F.struct(F.length("form"), "form"))["form"].alias("form"))
        forms = asked.join(best, ["query_id", "token"], "left").select("query_id", F.coalesce("form", "token").alias("form"))
        return forms.groupBy("query_id").agg(F.array_join(F.collect_set("form"), " ").alias("text"))

    def summary(self, doc_id: int, pages: DataFrame) -> str:
        """The callback's summary of a page, or a fixed message without a callback or page."""
        row = pages.where(F.col("doc_id") == doc_id).select("content").first()
        return self.summarize(row.content) if self.summarize and row and row.content else NO_SUMMARY

    def drop(self) -> None:
        """Remove the index's files, of all its builds."""
        if self.path:
            store.remove(self.spark, self.path)
