"""The engine: files or blocks in, clones out."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.config import EngineConfig
from kindred.operators import clusters as C, embed as E, search as Q
from kindred.operators.index import CloneIndex
from kindred.operators.pairs import block_pairs
from kindred.session import cut, release, ship, sweep
from kindred.sources import files as files_


#: Different texts of a task that tokenises them.
TEXTS = 4096


class CloneEngine:
    """Indexes blocks and answers queries; every result is a DataFrame.

    The TF-IDF model (document frequencies and count) is frozen with the index and saved beside it, so a query never changes
    later results and a loaded index answers as the one that was saved.
    """

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.index: CloneIndex | None = None
        self._df: DataFrame | None = None
        self._df_cut = True
        self._n = 0
        ship(spark)

    def index_files(self, files: DataFrame, parser: str = "lines") -> DataFrame:
        """Parse and index (path, content, language); returns the block rows."""
        p = self.config.parser
        return self.index_blocks(files_.block_rows(files_.parse_files(files, parser, p), p.min_tokens))

    def index_directory(self, root: str, parser: str = "lines") -> DataFrame:
        return self.index_files(files_.read_files(self.spark, root, self.config.parser), parser)

    def index_blocks(self, blocks: DataFrame, written: bool = False) -> DataFrame:
        """Index block rows (block_id, content, language, ...); replaces what was indexed.

        ``written``: the rows come from a table as they are, and are read again rather than copied unless ids repeat.
        """
        blocks = self._unique(blocks, written)
        c = self.config
        e = c.embedding
        if e.model == "mock":
            vectors = E.mock_embed(blocks, c.lsh.dimension)
        else:
            self._n = blocks.count()
            most = int(e.max_df_ratio * self._n) if e.max_df_ratio < 1 else None
            df = E.text_frequencies(blocks, e.ngrams)
            self._df = df.where(F.col("df") >= e.min_df) if most is None else df.where((F.col("df") >= e.min_df) & (F.col("df") <= most))
            self._df_cut = False
            if e.idf == "online":
                vectors = E.project(E.online_weights(cut(E.term_rows(blocks, e.ngrams))), c.lsh.dimension)
            else:
                vectors = E.embed_texts(blocks, c.lsh.dimension, df, self._n, e.ngrams, e.min_df, most)
        made = cut(vectors)
        index = CloneIndex.build(made, c.lsh, blocks)
        hashed = cut(index.vectors)
        release(made)
        from kindred.operators.index import bucket_rows

        self.index = replace(index, vectors=hashed, buckets=bucket_rows(hashed))
        return blocks

    def clone_clusters(self, blocks: DataFrame, min_similarity: float | None = None, written: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(blocks, members, clusters) of block rows by all pairs of their vectors, without an index, so that no pair is missed.

        Each different text is tokenised once and texts of the same keys share a vector; copies count in frequencies, sizes and means.
        """
        least = self.config.summary_similarity if min_similarity is None else min_similarity
        c, e = self.config, self.config.embedding
        if e.model == "mock" or e.idf == "online":
            blocks = self.index_blocks(blocks, written)
            classes = C.copy_classes(self.index.vectors)
            same = self.index.vectors.select("block_id", "embedding").join(classes.select("embedding", F.col("block_id").alias("class_id")), "embedding").select("class_id", "block_id")
        else:
            blocks = self._unique(blocks, written)
            n = blocks.count()
            keyed = blocks.select("block_id", F.sha2(F.col("content").cast("string"), 256).alias("key"), "language")
            texts = cut(keyed.groupBy("key", "language").agg(F.min("block_id").alias("text_id"), F.count(F.lit(1)).alias("copies")))
            parts = max(2 * self.spark.sparkContext.defaultParallelism, math.ceil(texts.count() / TEXTS))
            dealt = blocks.repartition(parts, "block_id").join(texts.select(F.col("text_id").alias("block_id"), "copies").repartition(parts, "block_id").hint("shuffle_hash"), "block_id")
            if texts.where("text_id IS NULL").limit(1).count():  # a text of the row without id alone
                dealt = dealt.unionByName(blocks.where("block_id IS NULL").withColumn("copies", F.lit(1).cast("long")))
            chunks = E.coded_texts(dealt)
            sweep(self.spark)
            most = int(e.max_df_ratio * n) if e.max_df_ratio < 1 else None
            df = E.coded_frequencies(chunks, e.ngrams)
            vectors = E.embed_coded(chunks, c.lsh.dimension, df, n, e.ngrams, e.min_df, most)
            sweep(self.spark)
            alike = chunks.select(F.explode(F.arrays_zip("ids", "digests")).alias("x")).select(F.col("x.ids").alias("text_id"), F.col("x.digests").alias("digest"))
            first = alike.groupBy("digest").agg(F.min("text_id").alias("class_id"))
            known = texts.join(alike.join(first, "digest"), "text_id").select("key", "language", "class_id")
            own = keyed.where("block_id IS NOT NULL").join(known, keyed.key.eqNullSafe(known.key) & keyed.language.eqNullSafe(known.language))
            same = cut(own.select("class_id", "block_id"))
            size = same.groupBy(F.col("class_id").alias("block_id")).agg(F.count(F.lit(1)).alias("members"))
            classes = cut(vectors.join(size, "block_id").select("block_id", "embedding", F.array("members", F.expr("members * (members - 1) div 2")).alias("hashes"), "members"))
            release(chunks)
        nodes = cut(C.linked_nodes(block_pairs(classes, least, 0, None, None, True), classes))
        members = same.join(nodes.select(F.col("block_id").alias("class_id"), "cluster_id"), "class_id").select("cluster_id", "block_id")
        return blocks, members, C.node_clusters(nodes)

    def _unique(self, blocks: DataFrame, written: bool) -> DataFrame:
        if not written or blocks.groupBy("block_id").count().where("count > 1").limit(1).count():
            return cut(blocks.dropDuplicates(["block_id"]))
        return blocks

    def _frequencies(self) -> DataFrame:
        """(term, df), written when a query or save first asks for it."""
        if not self._df_cut:
            self._df, self._df_cut = cut(self._df), True
        return self._df

    def _vectors_of(self, snippets: DataFrame) -> DataFrame:
        """(query_id, embedding) of (query_id, content, language) by the frozen model; a query's own terms count once more."""
        rows = snippets.select(F.col("query_id").alias("block_id"), "content", "language")
        if self.config.embedding.model == "mock":
            return E.mock_embed(rows, self.config.lsh.dimension).withColumnRenamed("block_id", "query_id")
        tf = E.term_rows(rows, self.config.embedding.ngrams)
        df = tf.join(self._frequencies(), "term", "left").select("block_id", "term", "tf", (F.coalesce("df", F.lit(0)) + 1).alias("df"))
        weighted = df.select("block_id", "term", (E.S.tf_weight(F.col("tf")) * E.S.idf_smooth(F.lit(float(self._n + 1)), F.col("df"))).alias("weight"))
        return E.project(weighted, self.config.lsh.dimension).withColumnRenamed("block_id", "query_id")

    def query(self, code: str | DataFrame, language: str = "typescript", k: int | None = None, min_similarity: float | None = None, **filters) -> DataFrame:
        """Blocks like a snippet, or like each row of (query_id, content, language)."""
        rows = self.spark.createDataFrame([("query", code, language)], "query_id string, content string, language string") if isinstance(code, str) else code
        c = self.config
        return Q.query_clones(self.index, self._vectors_of(rows), k or c.max_results, c.min_similarity if min_similarity is None else min_similarity, **filters)

    def find_similar(self, block_id: str, k: int | None = None, min_similarity: float | None = None) -> DataFrame:
        return Q.find_similar(self.index, block_id, k or self.config.max_results, self.config.min_similarity if min_similarity is None else min_similarity)

    def clone_pairs(self, min_similarity: float | None = None, per_source: int | None = 50) -> DataFrame:
        return Q.clone_pairs(self.index, self.config.min_similarity if min_similarity is None else min_similarity, per_source)

    def clusters(self, min_similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(clusters, members)."""
        pairs = cut(self.clone_pairs(min_similarity, None))
        members = C.cluster_members(pairs)
        return C.clusters(pairs, members), members

    def summary(self) -> DataFrame:
        found, _ = self.clusters(self.config.summary_similarity)
        return C.scan_summary(self.index.blocks, found)

    def stats(self) -> DataFrame:
        return self.index.stats()

    def get_block(self, block_id: str) -> DataFrame:
        return self.index.blocks.where(F.col("block_id") == block_id)

    def all_blocks(self) -> DataFrame:
        return self.index.blocks

    def has_block(self, block_id: str) -> bool:
        return self.index.has(block_id)

    def remove_block(self, block_id: str) -> None:
        self.index = self.index.remove(self.spark.createDataFrame([(block_id,)], "block_id string"))

    def remove_file(self, path: str) -> None:
        self.index = self.index.remove(self.index.blocks.where(F.col("file_path") == path).select("block_id"))

    def clear(self) -> None:
        self.index = self.index.clear()

    def size(self) -> int:
        return self.index.size() if self.index else 0

    def save(self, path: str) -> None:
        self.index.save(path)
        if self._df is not None:
            self._frequencies().withColumn("n_docs", F.lit(self._n)).write.mode("overwrite").parquet(f"{path}/vocabulary")

    def load(self, path: str) -> CloneEngine:
        self.index = CloneIndex.load(self.spark, path)
        self.config = replace(self.config, lsh=self.index.config)
        if self.config.embedding.model != "mock":
            stored = self.spark.read.parquet(f"{path}/vocabulary")
            self._df, self._df_cut, self._n = stored.select("term", "df"), True, (stored.select("n_docs").first() or [0])[0]
        return self
