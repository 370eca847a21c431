"""Mixing sources to target weights, by systematic sampling.

Each source is to supply ``weight`` of a mix as large as the corpus, in tokens. A document of source s
has the expected number of copies ``e = min(weight * corpus / tokens of s, max_repeats)``. The
documents of a source stand in a fixed order; ``P`` is the prefix sum of their expected copies plus one
random offset in [0, 1), and a document is emitted once for each integer boundary that its step
crosses: ``floor(P) - floor(P - e)`` times, which is the floor or the ceiling of e and never more than
``max_repeats``.

The order is by size class, then by a hash, so that copies are spread evenly over sizes and the token
share comes out close to its target, unless single documents are a large part of their source; the
share that came out and its relative error are reported. The prefix sum has two levels: documents are counted per source
and bucket (size class and hash, at most ``SIZE_CLASSES * HASHES`` buckets a source), the buckets'
counts are summed over the bounded table, and documents are ranked only inside their bucket. No task
holds a source, however hot.

Token counts are taken once and written to the shared folder, since both the totals and the copies
need them.

Defined results: letter case, spaces, hyphens and underscores in a source name don't count; documents
with a null or unlisted source count for the corpus, but are never emitted; documents without tokens
(null and empty texts) take their turn and add nothing; a source without tokens gives nothing; of two
target rows for one source the greater weight stands; null weights and repeats are 0; an empty corpus
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.llm.bpe import PATTERN, VOCABULARY, token_counts
from sentrymill.sources.tables import checkpointed, small_rows

HASHES = 256
SIZE_CLASSES = 64
TARGET_BOUND = 10_000


def folded_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


class Mixture:
    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        source: str = "source",
        vocabulary: str = VOCABULARY,
        pattern: str = PATTERN,
        seed: int = 42,
    ):
        self.key, self.seed = key, seed
        self._total: int | None = None
        tagged = documents.select(
            F.struct(F.col(key).alias("key"), folded_source(F.col(source)).alias("source")).alias("head"), F.col(text).alias("text")
        )
        counted = token_counts(tagged, "head", "text", vocabulary, pattern)
        self.counts = checkpointed(counted.select(F.col("head.key").alias(key), F.col("head.source").alias("source"), "n_tokens"))
        self.targets = targets.select(
            folded_source(F.col("source")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("most")
        ).groupBy("source").agg(F.max("weight").alias("weight"), F.max_by("most", "weight").alias("most"))

    def _corpus(self) -> int:
        """All tokens: one number on the driver."""
        if self._total is None:
            self._total = int(self.counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
        return self._total

    def plan(self) -> DataFrame:
        """source, weight, most, documents, tokens, corpus, expected: one row per target source (bounded by the targets)."""
        by_source = self.counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
        joined = self.targets.join(by_source, "source", "left").withColumn("corpus", F.lit(self._corpus()))
        filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "tokens")})
        ratio = F.when(F.col("tokens") > 0, F.col("weight") * F.col("corpus") / F.col("tokens")).otherwise(F.lit(0.0))
        return filled.withColumn("expected", F.least(ratio, F.col("most").cast("double")))

    def _small_plan(self) -> DataFrame:
        """The plan as a table of the driver: a row per target source, of which there are at most ``TARGET_BOUND``."""
        plan = self.plan()
        return plan.sparkSession.createDataFrame(small_rows(plan, TARGET_BOUND), plan.schema)

    def copies(self) -> DataFrame:
        """(key, source, n_tokens, copies) of every document emitted at least once."""
        plan = F.broadcast(self._small_plan().where("expected > 0").select("source", "expected"))
        size = F.least(F.floor(F.log2(F.col("n_tokens") + 1) * 3), F.lit(SIZE_CLASSES - 1)).cast("int")
        mixed = F.xxhash64(F.lit(self.seed), F.col(self.key))
        placed = self.counts.join(plan, "source").withColumns(
            {"mixed": mixed, "bucket": size * HASHES + F.shiftrightunsigned(mixed, 56).cast("int")}
        )
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            placed.groupBy("source", "bucket")
            .agg(F.count("*").alias("n"))
            .select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        )
        inside = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("mixed", self.key))
        ranked = placed.withColumn("inside", inside).join(offsets, ["source", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
        first = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.col("source")), 11).cast("double") / float(1 << 53)

        step = lambda r: F.floor(F.col("expected") * r + first)
        out = ranked.withColumn("copies", (step(F.col("rank")) - step(F.col("rank") - 1)).cast("int"))
        return out.where("copies > 0").select(self.key, "source", "n_tokens", "copies")

    def mix(self) -> DataFrame:
        """(key, source, copy): one row per copy, numbered from 1."""
        return self.copies().select(self.key, "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))

    def shares(self) -> DataFrame:
        """Per target source: what it should and does supply, in tokens and as a share of the mix."""
        supplied = self.copies().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("supplied"), F.sum("copies").alias("copies"))
        joined = self.plan().join(supplied, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("supplied", "copies")})
        total = F.sum("supplied").over(Window.partitionBy(F.lit(1)))  # over the bounded targets
        wanted = F.col("weight") * F.col("corpus")
        return joined.select(
            "source",
            F.col("weight").alias("target_weight"),
            F.col("most").alias("max_repeats"),
            "documents",
            "tokens",
            "copies",
            "supplied",
            F.round(F.when(total > 0, F.col("supplied") / total), 6).alias("share_of_mix"),
            F.round(F.when(F.col("corpus") > 0, F.col("supplied") / F.col("corpus")), 6).alias("share_of_target_size"),
            (F.col("weight") * F.col("corpus") > F.col("tokens") * F.col("most")).alias("short"),
            F.round(F.when(wanted > 0, F.col("supplied") / wanted - 1), 6).alias("relative_error"),
        )

    def limits(self) -> DataFrame:
        """Per source of the mix: whether each document has the floor or the ceiling of the expected copies, and none more than allowed."""
        plan = self._small_plan().select("source", "expected", "most")
        held = self.counts.join(self.copies().select(self.key, F.col("source").alias("s"), "copies"), self.key, "left").join(F.broadcast(plan), "source")
        copies = F.coalesce("copies", F.lit(0))
        even = copies.between(F.floor("expected"), F.ceil("expected"))
        return held.groupBy("source").agg(F.count("*").alias("documents"), F.bool_and(even).alias("even"), F.bool_and(copies <= F.col("most")).alias("within_cap"))
