"""Exact dedup by deterministic block naming (DataFrame operators only).

Texts are normalised (each run of ASCII white space becomes one space) and cut into blocks of BLOCK_BYTES bytes.
Every distinct block gets an integer name, its place in the sorted order of its partition.  Adjacent names are
then paired, every distinct pair gets a name in the same way, and so on until each document has one name.  Two
documents get the same name at the same level exactly when their texts are equal.

Names come from comparing whole blocks.  What rows carry to fetch them is a fingerprint of 16 bytes; when the
distinct blocks have been named, all of them are checked for fingerprints that two blocks share, and if there is
one, other fingerprints are taken and the naming starts again.  So blocks move once, pre-aggregated, and levels
move (uid, width, pos, name) only.  A block, pair or text that very many rows have is one row of the names, and
the join that hands it out is one of two written tables, which adaptive execution splits over tasks.

Defined cases: a null or empty text is the empty text, one block; repeated rows (same doc_id, same text) are
members of a group like any other and one of them is kept; of equal texts that tie in doc_id the row read first
stays; a null doc_id sorts last; texts of any length are read whole; an empty table gives an empty result; further
columns are ignored, and ``keep_first`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, durable, filled, row_uid

BLOCK_BYTES = 512


def normalised(text: str = "text"):
    return F.regexp_replace(filled(text), f"{SPACE_CLASS}+", " ")


def _names(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``name``: different in every row, by sorted place."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _blocks(block_bytes: int):
    """The blocks of a binary column ``bytes``, in order; one at least."""
    size = F.greatest(F.octet_length("bytes"), F.lit(1))
    places = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / F.lit(block_bytes)))
    return F.transform(places, lambda i: F.substring(F.col("bytes"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)))


def _fingerprint(seed: int) -> list:
    return [F.xxhash64(F.lit(2 * seed + k), "block").alias(f"f{k}") for k in (0, 1)]


def _first_level(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """(uid, doc_id, text_sha256) of every row; (uid, width, pos, name) of every block; the greatest width."""
    texts = docs.select("doc_id", F.encode(normalised(), "UTF-8").alias("bytes"))
    cut = texts.select("doc_id", "bytes", _blocks(block_bytes).alias("blocks"))
    # the outer forms of explode: the others make the optimiser infer a filter that cuts a text anew for every block
    seed = 0
    while True:
        names = _names(cut.select(F.explode_outer("blocks").alias("block")).select(*_fingerprint(seed), "block").distinct(), ["block"]).select("f0", "f1", "name")
        names = durable(names)
        if names.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        seed += 1
    # a document's rows are made in one pass, so that its number is drawn once (before its blocks are unfolded); what
    # is said once goes with block 0
    rows = cut.select(row_uid().alias("uid"), "doc_id", F.sha2("bytes", 256).alias("sha"), F.size("blocks").alias("width"), "blocks")
    rows = rows.select("uid", "doc_id", "sha", "width", F.posexplode_outer("blocks").alias("pos", "block"))
    head = F.col("pos") == 0
    posts = durable(rows.select(
        "uid", F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("sha")).alias("text_sha256"), "width", "pos", *_fingerprint(seed),
    ))
    base = posts.where(head).select("uid", "doc_id", "text_sha256")
    most = posts.agg(F.max("width")).first()[0] or 1
    return base, posts.select("uid", "width", "pos", "f0", "f1").join(names.hint("merge"), ["f0", "f1"]).select("uid", "width", "pos", "name"), most


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, text_sha256, level, name): rows with the same (level, name) have equal texts."""
    base, current, width = _first_level(docs, block_bytes)
    level, done = 0, []
    while True:
        if width > 1:
            current = durable(current)
        done.append(current.where("width = 1").select("uid", F.lit(level).alias("level"), "name"))
        if width <= 1:
            break
        half = F.col("pos").bitwiseAND(1)
        pairs = durable(
            current.where("width > 1").groupBy("uid", "width", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"))
            .withColumn("width", F.shiftright(F.col("width") + 1, 1))
        )
        names = durable(_names(pairs.select("left", "right").distinct(), ["left", "right"]))
        current = pairs.join(names.hint("merge"), ["left", "right"]).select("uid", "width", "pos", "name")
        level, width = level + 1, (width + 1) // 2
    ids = done[0]
    for x in done[1:]:
        ids = ids.unionByName(x)
    return base.hint("merge").join(ids, "uid")


def _grouped(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of every row: its doc_id and digest, its group's first row and size, and whether it is that row."""
    ids = durable(identities(docs, block_bytes))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "uid"))
    groups = durable(ids.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")))
    return ids.join(groups.hint("merge"), ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.  Of equal texts the smallest doc_id stays."""
    return _grouped(docs, block_bytes)


def keep_first(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = durable(exact_dedup(docs.select("doc_id", "text"), block_bytes))
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    own = [f"__c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, own, strict=True))
    rows = docs.toDF(*own).withColumn("_sha", F.sha2(F.encode(normalised(place["text"]), "UTF-8"), 256)).withColumn("_id", F.col(place["doc_id"]))
    same = lambda x, y: x["_id"].eqNullSafe(y["_id"]) & (x["_sha"] == y["_sha"])
    held = rows.join(kept, same(rows, kept), "left_semi")
    # the same doc_id with the same text again: of these rows, and only of these, one is picked
    twice = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = durable(twice.join(kept, ["_sha"], "left_semi").select("_id", "_sha"))
    if not twice.isEmpty():
        again = held.join(twice, same(held, twice), "left_semi").groupBy("_id", "_sha").agg(*[F.first(F.struct(c)).alias(c) for c in own])
        again = again.select("_sha", "_id", *[F.col(c)[c].alias(c) for c in own])
        held = held.join(twice, same(held, twice), "left_anti").select("_sha", "_id", *own).unionByName(again)
    return held.select(*[F.col(c).alias(n) for n, c in place.items()])


SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept,
       sha256(norm) as text_sha256
from t
"""
