"""Template residue and error-page text.

Segments (sentences, lines) of all documents go through two prefix trees of fixed depth over masked
tokens: values and slots become masks.

*Templates.* The leaf of a segment is chosen by its number of tokens, its first words and its last
token. Segments of a leaf that are alike are merged into one template, in which what differs is
masked. Each mined template is classified once, by general features of its words (``residue_words``):
junk, neutral (title, page furniture), content, or unsure. Verdicts are then propagated through the
documents: a junk template most of whose documents with it have real content besides is quoted there,
and convicts none; an unsure template acquits, as content does, unless nearly all of its documents have
junk and no content. A document is found if a junk template convicts it and nothing acquits it.

*Unresolved slots.* A second tree counts how many segments pass through a node, and how many have a
slot as their next token. A slot counts where the corpus fills that place with values: at its node
fewer than ``SLOT_SHARE`` of the segments have a slot. Where texts explain or log a slot, nearly every
segment of the node has one, so that it is no residue. A slot alone in its segment (the value of a
label, a line of its own) is compared with what follows the segment before it elsewhere, and is residue
anyway in a text without any content. Slots in code, quotes and addresses are not looked at; three
slots in one segment are residue whatever the corpus has.

One Python pass over the texts writes four narrow parts to the shared folder: slot tree counts (summed
per task before they are written), slots, segments (per task once, with their number of documents) and
the distinct segments of each document. Mining exchanges the distinct segments by leaf and reads each
leaf as a sorted stream, so repeats of a hot segment cost one row per task. All later steps are joins
and sums on 8-byte hashes, in which those with more than a ``HOT``-th of all rows are salted. Only
documents that have junk at all take part in the propagation, each as one row with its distinct
segments. Nothing is collected.

Defined results: null, empty and blank texts are never found; texts and segments of any length are
read whole; repeated documents get the same verdict and count each; documents with a null or repeated key are
judged each by itself, and the key found if one of them is; an
empty table gives an empty result; further columns are ignored. On a corpus too small to fill a place
with values a slot there isn't found unless three stand in one segment or one is alone in its segment
and the text has no content.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.residue_text import BARE, MANY, START, Leaf, leaf, marked, masked, place, segments
from sentrymill.llm.residue_words import CONTENT, JUNK, UNSURE, verdict
from sentrymill.sources.tables import checkpointed, scratch, spread

SLOT_SHARE = 0.4
QUOTED_SHARE = 0.5
JOINED_SHARE = 0.8
HOT, SALTS = 4_096, 64
_HELD = 200_000
_HELD_CHARS = 16_000_000
_KNOWN_CHARS = 400
_PARTS = "part string, key {kind}, h bigint, n bigint, other bigint, template string"


def _hash(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >= 1 << 63 else h


def _scan(key_type: pa.DataType):
    schema = pa.schema(
        [("part", pa.string()), ("key", key_type), ("h", pa.int64()), ("n", pa.int64()), ("other", pa.int64()), ("template", pa.string())]
    )

    def block(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def edges(part: str, keys: list, hashes: list[int], documents: list[int] | None) -> pa.RecordBatch:
        n = len(hashes)
        other = pa.array(documents, pa.int64()) if documents is not None else pa.nulls(n, pa.int64())
        columns = [pa.repeat(pa.scalar(part), n), pa.array(keys, key_type), pa.array(hashes, pa.int64()), pa.nulls(n, pa.int64()), other, pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        through: Counter = Counter()
        slotted: Counter = Counter()
        counted: Counter = Counter()  # documents of each distinct segment, by hash, and its text
        text_of: dict[int, str] = {}
        passed: Counter = Counter()  # segments, whose nodes are counted when the counts are written
        known: dict[str, tuple] = {}
        start_of_text, many = _hash(START), _hash(MANY)
        chars = 0
        document = TaskContext.get().partitionId() << 33  # a number of its own for each document, since keys can be null or repeated

        def held() -> list[tuple]:
            for keys, n in passed.items():
                for k in keys:
                    through[k] += n
            rows = [("tree", None, h, n, slotted.get(h, 0), None) for h, n in through.items()]
            rows += [("tree", None, h, 0, n, None) for h, n in slotted.items() if h not in through]
            rows += [("segment", None, h, n, _hash(leaf(text_of[h].split(" "))), text_of[h]) for h, n in counted.items()]
            for c in (through, slotted, counted, text_of, passed):
                c.clear()
            return rows

        def looked_up(segment: str) -> tuple:
            found = known.get(segment)
            if found is None:
                template, keys, at = masked(segment)
                after = place(template)
                found = (_hash(template), template, tuple(_hash(k) for k in keys), [_hash(k) for k in at if k != BARE], BARE in at, after and _hash(after))
                if len(segment) <= _KNOWN_CHARS:
                    if len(known) >= _HELD:
                        known.clear()
                    known[segment] = found
            return found

        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                b = whole.slice(start, 1_024)
                at_keys, at_hashes, at_documents, slot_keys, slot_hashes = [], [], [], [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    document += 1
                    own: dict[int, str] = {}
                    lookups: set[int] = set()
                    worded: set[int] = set()
                    at_place, taken, bare = start_of_text, False, set()
                    for segment in segments(marked(text)):
                        h, template, keys, at, alone, after = looked_up(segment)
                        own[h] = template
                        passed[keys] += 1
                        if at:
                            slotted.update(at)
                            lookups.update(at)
                        if not taken:  # a run of masks is one filling of its place
                            through[at_place] += 1
                        if alone:
                            bare.add(at_place)
                        taken = after is None
                        if not taken:
                            at_place = after
                            worded.add(h)
                    if bare:
                        slotted.update(bare)
                        lookups.update(bare)
                        if all(verdict(own[h]) != CONTENT for h in worded):
                            lookups.add(many)
                    counted.update(own.keys())
                    for h, template in own.items():
                        if h not in text_of:
                            text_of[h] = template
                            chars += len(template)
                    at_keys += [key] * len(own)
                    at_hashes += own
                    at_documents += [document] * len(own)
                    slot_keys += [key] * len(lookups)
                    slot_hashes += lookups
                yield edges("document", at_keys, at_hashes, at_documents)
                yield edges("slot", slot_keys, slot_hashes, None)
                if len(through) + len(passed) + len(counted) > _HELD or chars > _HELD_CHARS:
                    rest, chars = held(), 0
                    for first in range(0, len(rest), 20_000):
                        yield block(rest[first : first + 20_000])
        rest = held()
        for first in range(0, len(rest), 20_000):
            yield block(rest[first : first + 20_000])

    return run


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, template, h, n), sorted by leaf and template, to one row (h, n, t, docs, verdict) per segment."""
    at, tree = None, Leaf()
    members: list[list[int]] = []  # h, n, template of each distinct segment of the leaf

    def mined() -> pa.RecordBatch:
        docs = [0] * len(tree.templates)
        for _, n, k in members:
            docs[k] += n
        texts = [" ".join(t) for t in tree.templates]
        ids, verdicts = [_hash(f"{at} {k} {t}") for k, t in enumerate(texts)], [verdict(t, list(m.values())) for t, m in zip(texts, tree.masked)]
        rows = [(h, n, ids[k], docs[k], verdicts[k]) for h, n, k in members]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["h", "n", "t", "docs", "verdict"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        for number, text, h, n in zip(*(b.column(i).to_pylist() for i in range(4))):
            if number != at:
                if members:
                    held.append(mined())
                at, tree, members = number, Leaf(), []
            if members and members[-1][0] == h:
                members[-1][1] += n
            else:
                members.append([h, n, tree.add(text)])
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if members:
        yield mined()


def _salt(hot, spread_by: str):
    return F.when(hot, F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))


def _salts(hot):
    return F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def _with_templates(edges: DataFrame, segments: DataFrame, total: int) -> DataFrame:
    """Edges joined to segments (h, n, ...) on h. Segments with at least a ``HOT``-th of all edges, at most ``HOT``
    ones, are known to each task, so that their edges are spread over ``SALTS`` tasks."""
    hot = F.col("n") * HOT >= F.lit(total)
    few = F.broadcast(segments.where(hot).select("h", F.lit(True).alias("hot")))
    salted = edges.join(few, "h", "left").withColumn("salt", _salt(F.col("hot"), "document")).drop("hot")
    return salted.join(segments.withColumn("salt", _salts(hot)), ["h", "salt"]).drop("salt")


class Residue:
    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text"):
        from pyspark.sql.pandas.types import to_arrow_type

        spark = documents.sparkSession
        self.key = key
        kind = documents.schema[key].dataType
        texts = documents.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
        path = scratch(spark, "residue")
        schema = _PARTS.format(kind=kind.simpleString())
        spread(texts).mapInArrow(_scan(to_arrow_type(kind)), schema).write.partitionBy("part").parquet(path)
        self._parts = spark.read.schema(schema).parquet(path)

    def _part(self, name: str, *columns: str) -> DataFrame:
        return self._parts.where(F.col("part") == name).select(*columns)

    def unresolved(self) -> DataFrame:
        """Keys of documents with a slot where the corpus has values."""
        tree = self._part("tree", "h", "n", "other").groupBy("h").agg(F.sum("n").alias("n"), F.sum("other").alias("slotted"))
        open_nodes = tree.where("slotted > 0").where(F.col("slotted") < SLOT_SHARE * F.greatest("n", F.lit(1)))
        many = F.col("h") == _hash(MANY)
        slots = self._part("slot", "key", "h")
        return slots.where(~many).join(open_nodes.select("h"), "h", "left_semi").select("key").unionByName(slots.where(many).select("key")).distinct()

    def templates(self) -> DataFrame:
        """h, n, t, docs, verdict: each distinct segment and its number of documents, with the template it was mined into, that one's number of documents and its verdict."""
        partitions = self._parts.sparkSession.sparkContext.defaultParallelism * 2  # little data, much work a row
        rows = self._part("segment", F.col("other").alias("leaf"), "template", "h", "n")
        streams = rows.repartition(partitions, "leaf").sortWithinPartitions("leaf", "template")
        return streams.mapInArrow(_mine, "h bigint, n bigint, t bigint, docs bigint, verdict bigint")

    def empty_of_content(self) -> DataFrame:
        """Keys of documents that have nothing but filler, errors and notices besides titles and furniture."""
        segments = checkpointed(self.templates())
        total = segments.agg(F.sum("n")).first()[0] or 0
        edges = self._part("document", "key", F.col("other").alias("document"), "h")
        junk = segments.where(F.col("verdict") == JUNK).select("h", "n")
        with_junk = _with_templates(edges.drop("key"), junk, total).select("document").distinct()
        near = _with_templates(edges.join(with_junk, "document", "left_semi"), segments, total)
        has = lambda v: F.exists("templates", lambda t: t["verdict"] == v)
        by_document = checkpointed(
            near.groupBy("document").agg(F.first("key").alias("key"), F.collect_set(F.struct("t", "docs", "verdict", "h")).alias("templates"))
            .select("key", "document", "templates", (~has(CONTENT)).alias("clean"))
        )
        # What a template is, by the documents it stands in: quoted, or in unsure ones real content. A document counts
        # once for each of its segments, as it does in docs.
        standing = by_document.select("clean", F.explode("templates").alias("t")).select("t.*", F.col("clean").cast("int").alias("clean")).where(F.col("verdict").isin(JUNK, UNSURE))
        means = standing.groupBy("t").agg(F.max("docs").alias("docs"), F.avg("clean").alias("share"), F.sum("clean").alias("clean"), F.max("verdict").alias("verdict"))
        means = means.select(
            "t",
            ((F.col("verdict") == JUNK) & (F.col("share") >= QUOTED_SHARE)).alias("convicts"),
            ((F.col("verdict") == UNSURE) & (F.col("clean") < JOINED_SHARE * F.col("docs"))).alias("acquits"),
            _salts(F.col("docs") * HOT >= F.lit(total)).alias("salt"),
        )
        open_ = by_document.where("clean").select("key", "document", F.explode("templates").alias("x")).select("key", "document", "x.*")
        salted = open_.withColumn("salt", _salt(F.col("docs") * HOT >= F.lit(total), "document"))
        final = salted.join(means, ["t", "salt"]).groupBy("document").agg(F.first("key").alias("key"), F.max("convicts").alias("convicted"), F.max("acquits").alias("acquitted"))
        return final.where(F.col("convicted") & ~F.col("acquitted")).select("key")

    def found(self) -> DataFrame:
        """Keys of all residue documents, each once."""
        return self.unresolved().unionByName(self.empty_of_content()).distinct().withColumnRenamed("key", self.key)


def without_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that aren't residue, whole. Of documents with a null or repeated key only those whose own text is residue are left out."""
    whole = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text"))
    gone = Residue(documents.select(whole.alias("__d"), F.col(text).alias("text")), "__d", "text").found()
    return documents.join(gone, whole.eqNullSafe(gone["__d"]), "left_anti")
