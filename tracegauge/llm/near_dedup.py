"""MinHash near-dedup by a signature-coordinate inverted join.

A document's signature has COORDINATES minima of its hashed word shingles.  Documents are posted under each
(coordinate, value), a posting coordinate being ROWS minima in a row; they collide in every minimum that they
share.  At the threshold similarity s a posting coordinate agrees with probability s ** ROWS.  Let a pair at the
threshold share fewer than p lists with a probability of MISS at most (``least_postings``: p is 4 at 0.85 and 2 at
0.80); by the prefix rule a document then need not be posted in its p - 1 longest lists, as a pair that shares p lists
still meets in another.  Pairs with fewer collisions than five standard deviations below the expected ones are
given up.

Documents with equal shingle sets are one class from the start.  A list never becomes all its pairs:

1. each list links its members to a pivot, the member that collides most; collisions are counted, and what is
   above the match threshold is confirmed on the full sets.  Confirmed links give components; all counted
   pairs give families, which hold one component or more;
2. families of several components are compared block by block (BLOCK members a side) on the full sets; a task
   gives out only links that join components that it hasn't joined yet;
3. in lists that hold several families, collisions between members of different families are counted block by
   block, and only pairs above the match threshold leave a task; they are confirmed on the full sets.

Blocks hold members of one component (or family) where it has BLOCK of them, and such blocks are not compared with
blocks of the same one.  So of a family of n members that are joined but for r of them, 2 n r / BLOCK rows are moved;
n * n / BLOCK are only where nothing is joined.  What is given out grows with the documents and with links that no
pivot shows.

Defined cases: a text without words, or null, has no set and is linked with nothing; fewer words than a
shingle count as one shingle; repeated rows are in one class; a row without doc_id has a component_id only
if it is linked with a row that has one, and isn't kept; lists of equal length are ranked by their coordinate;
texts of any length are read whole; an empty table gives an empty result; further columns are ignored, and
``keep_first`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, arrow_map, durable
from .components import components
from .textkit import Chunk, add_columns, by_chunk, mix

WORDS = 3
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES, ROWS = 128, 4
#: The probability that a pair at the threshold goes unseen because it shares too few lists.
MISS = 2e-6
#: A pair at the threshold may lose as many collisions as five standard deviations.
DEVIATIONS = 5
BLOCK = 512
#: Tables made from whole signatures, sets or sketches get so many times the tasks of narrow ones.
WIDE = 8


def least_postings(percent: int) -> int:
    """The most lists that a pair at the threshold shares all but certainly (1 at least)."""
    n, p = COORDINATES // ROWS, (percent / 100) ** ROWS
    fewer, k = 0.0, 0
    while fewer + (more := comb(n, k) * p**k * (1 - p) ** (n - k)) <= MISS:
        fewer, k = fewer + more, k + 1
    return max(1, k)


def least_matches(percent: int) -> int:
    s = percent / 100
    return int(COORDINATES * s - DEVIATIONS * (COORDINATES * s * (1 - s)) ** 0.5)


_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin."""
    h = c.word_hashes()
    x, at = c.windows(h, words)
    of = c.doc[at]
    few = np.flatnonzero((c.words > 0) & (c.words < words))
    if len(few):  # the whole sequence as one
        own = []
        with np.errstate(over="ignore"):
            for d in few:
                v = np.uint64(c.words[d])
                for w in h[c.word_at[d] : c.word_at[d] + c.words[d]]:
                    v = mix(np.array([v * np.uint64(0xA0761D6478BD642F) + w]))[0]
                own.append(v)
        x, of = np.append(x, np.array(own, np.uint64)), np.append(of, few)
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = (np.diff(x) != 0) | (np.diff(of) != 0)
    x, of = x[new], of[new]
    return x, np.searchsorted(of, np.arange(c.n + 1))


def _names(x: np.ndarray, cut: np.ndarray, some: np.ndarray) -> np.ndarray:
    """A name for each set: its size and two sums of independent mixes."""
    names = np.full(len(cut) - 1, None, object)
    if len(some):
        with np.errstate(over="ignore"):
            one = np.add.reduceat(mix(x + np.uint64(0x632BE59BD9B4E019)), cut[some])
            two = np.add.reduceat(mix(x ^ np.uint64(0x9FB21C651E98DF25)), cut[some])
        for d, p, q in zip(some.tolist(), one.tolist(), two.tolist(), strict=True):
            names[d] = f"{cut[d + 1] - cut[d]:x}-{p:016x}{q:016x}"
    return names


def _signature_kernel(words: int) -> Callable:
    """n_shingles, name, ``posts`` (COORDINATES / ROWS values of 8 bytes) and ``sketch`` (2 bytes of each minimum)."""

    def run(c: Chunk) -> dict:
        x, cut = shingle_sets(c, words)
        size = np.diff(cut)
        some = np.flatnonzero(size)
        posts, sketch = np.zeros((len(some), COORDINATES // ROWS), np.uint64), np.zeros((len(some), COORDINATES), np.uint16)
        if len(some):
            with np.errstate(over="ignore"):
                for k in range(COORDINATES):
                    least = np.minimum.reduceat((x ^ _SEEDS[2 * k]) * _SEEDS[2 * k + 1], cut[some])
                    least = mix(least)
                    sketch[:, k] = least.astype(np.uint16)
                    posts[:, k // ROWS] = mix(posts[:, k // ROWS] + least)
        out = {"n_shingles": size, "name": _names(x, cut, some)}
        for name, values in (("posts", posts), ("sketch", sketch)):
            raw = np.full(c.n, None, object)
            for i, d in enumerate(some):
                raw[d] = values[i].tobytes()
            out[name] = raw
        return out

    return by_chunk(run)


def _set_kernel(words: int) -> Callable:
    def run(c: Chunk) -> dict:
        x, cut = shingle_sets(c, words)
        sets = np.full(c.n, None, object)
        for d, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            sets[d] = x[a:b].tobytes()
        return {"set": sets, "name": _names(x, cut, np.flatnonzero(np.diff(cut)))}

    return by_chunk(run)


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs (a, b) with the value of either side, x and y."""
    left = table.select(F.col("class").alias("a"), F.col(value).alias("x"))
    right = table.select(F.col("class").alias("b"), F.col(value).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "x", "y"))
            on = pa.array([linked(p.as_py(), q.as_py(), percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(on), b.filter(on)], ["a", "b"])

    return arrow_map(_both(pairs, sets, "set"), run, "a long, b long")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _count_matches(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) with enough collisions."""

    def run(batches):
        for batch in batches:
            on = pa.array((_sketches(batch.column("x")) == _sketches(batch.column("y"))).sum(1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(on) for c in ("a", "b")], ["a", "b"])

    return arrow_map(_both(pairs, classes, "sketch"), run, "a long, b long")


def _grouped(compare: Callable[[pa.Table], np.ndarray]) -> Callable:
    """A function over batches sorted by ``key`` that hands whole keys to ``compare``; a key that goes on in the
    next batch waits for it (block pairs have at most about 2 x BLOCK rows)."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        pairs = compare(rows)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held = rows.slice(cut)
            if cut:
                yield out(rows.slice(0, cut))
        if held is not None and len(held):
            yield out(held)

    return run


def _collisions_across(matches: int) -> Callable:
    """Pairs of different families with enough collisions.  Row i is compared with row i + 1, i + 2 and so on of
    its block pair, for all block pairs at once."""

    def compare(rows: pa.Table) -> np.ndarray:
        key, one, side, node, family = (rows[c].to_numpy() for c in ("key", "one", "side", "class", "family"))
        x, found, i = _sketches(rows["sketch"]), [], np.arange(len(rows))
        for lag in range(1, len(x)):
            i = i[i + lag < len(x)]
            i = i[key[i] == key[i + lag]]
            if not len(i):
                break
            j = i + lag
            want = (family[i] != family[j]) & ((one[i] == 1) | (side[i] != side[j]))
            p, q = i[want], j[want]
            on = (x[p] == x[q]).sum(1) >= matches
            found.append(np.stack([node[p[on]], node[q[on]]], 1))
        return np.unique(np.sort(np.concatenate(found), 1), axis=0) if found else np.empty((0, 2), np.int64)

    return compare


def _links_within(percent: int) -> Callable:
    """In each block pair of a family: links on the full sets that join components which the task hasn't joined."""

    def compare(rows: pa.Table) -> np.ndarray:
        key = rows["key"].to_numpy()
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
        out = [_block(rows.slice(i, j - i), percent) for i, j in zip(edge, np.append(edge[1:], len(key)), strict=True)]
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)

    return compare


def _block(rows: pa.Table, percent: int) -> np.ndarray:
    one, side, node, component = (rows[c].to_numpy() for c in ("one", "side", "class", "component"))
    sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), size)
    _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
    on = times[word] > 1  # a shingle of one document meets no other
    of, word = of[on], np.unique(word[on], return_inverse=True)[1]
    left = np.arange(len(sets)) if one[0] else np.flatnonzero(side == 0)
    right = left if one[0] else np.flatnonzero(side == 1)
    both = np.zeros((len(left), len(right)), np.float32)
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(word, kind="stable")
    of, word = of[order], word[order]
    for base in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
        i, j = np.searchsorted(word, (base, base + 4096))
        w, d = word[i:j] - base, of[i:j]
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        l, r = row_l[d] >= 0, row_r[d] >= 0
        x[row_l[d[l]], w[l]] = 1
        y[row_r[d[r]], w[r]] = 1
        both += x @ y.T
    union = size[left][:, None] + size[right][None, :] - both
    p, q = np.nonzero((100 * both >= percent * union) & (component[left][:, None] != component[right][None, :]))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    out = []
    for i, j in zip(left[p].tolist(), right[q].tolist(), strict=True):
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((node[i], node[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def _block_pairs(members: DataFrame, group: list[str], label: str, keep: list[str], n: int) -> DataFrame:
    """Every member once for each block pair of its group that it belongs to: (key, one, side, class, keep).

    A label with BLOCK members or more in the group has blocks of its own, which aren't paired with each other; the
    members of all other labels share the group's first blocks.
    """
    labels = durable(members.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n")), n)
    up = lambda c: F.ceil(c / BLOCK).cast("int")
    # the labels that have blocks of their own are at most one for every BLOCK members of a group
    before = Window.partitionBy(*group).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    large = labels.where(F.col("n") >= BLOCK).select(*group, label, up(F.col("n")).alias("own_blocks"), F.coalesce(F.sum(up(F.col("n"))).over(before), F.lit(0)).cast("int").alias("first"))
    rest = F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0))
    whole = durable(labels.groupBy(*group).agg(up(rest).alias("rest_blocks"), F.sum(F.when(F.col("n") >= BLOCK, up(F.col("n"))).otherwise(0)).cast("int").alias("large_blocks")), n)
    # written tables on both sides, so that a very large group's members are split over tasks
    rows = members.join(durable(large, n).hint("merge"), [*group, label], "left").join(whole.hint("merge"), group)
    has_own, h = F.col("own_blocks").isNotNull(), F.xxhash64("class")
    begin = F.col("rest_blocks") + F.col("first")
    rows = rows.withColumn("own", F.when(has_own, begin + F.pmod(h, F.col("own_blocks"))).otherwise(F.pmod(h, F.greatest("rest_blocks", F.lit(1)))).cast("int"))
    every = F.sequence(F.lit(0), F.col("rest_blocks") + F.col("large_blocks") - 1)
    others = F.filter(every, lambda x: ~has_own | (x < begin) | (x >= begin + F.col("own_blocks")))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select(
        F.xxhash64(*group, F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        (F.col("own") == F.col("other")).cast("int").alias("one"), (F.col("own") > F.col("other")).cast("int").alias("side"), "class", *keep,
    )


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest doc_id reachable."""
    matches = least_matches(percent)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("name", T.StringType()), T.StructField("posts", T.BinaryType()), T.StructField("sketch", T.BinaryType())]
    signed = durable(add_columns(docs, lambda: _signature_kernel(words), fields, ["doc_id"]))
    classes = durable(
        signed.where(F.col("name").isNotNull()).groupBy("name")
        .agg(F.min("doc_id").alias("low"), F.first("posts").alias("posts"), F.first("sketch").alias("sketch"))
        .withColumn("class", F.monotonically_increasing_id()),
        WIDE * signed.count(),
    )
    count = classes.count()
    # lists with two members or more; each document leaves its longest ones
    lists = COORDINATES // ROWS
    values = F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda i: F.substring("posts", i * 8 + 1, F.lit(8)))
    posts = classes.select("class", F.posexplode(values).alias("coordinate", "value")).select(
        "class", "coordinate", F.conv(F.hex("value"), 16, -10).cast("long").alias("value")
    )
    long = durable(posts.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("length")).where("length > 1"), WIDE * count)
    # the order of lists is the same for all, longest last; what a class shares with nobody comes before
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("length"), F.desc("coordinate")))
    total = F.sum("length").over(Window.partitionBy("class"))
    shared = durable(
        posts.join(long, ["coordinate", "value"]).withColumn("rank", rank).withColumn("central", total)
        .where(F.col("rank") >= least_postings(percent)).drop("rank", "length"),
        WIDE * count,
    )
    n = shared.count()
    pivots = durable(shared.groupBy("coordinate", "value").agg(F.max(F.struct("central", "class")).alias("pivot")), n)
    pairs = (
        shared.join(pivots, ["coordinate", "value"])
        .select(F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b")).where("a <> b").distinct()
    )
    counted = durable(_count_matches(pairs, classes, matches), WIDE * n)
    family = components(counted, n)
    across = _across_families(shared, family, classes, matches, n)
    wanted = counted.union(across).select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = _sets(docs, wanted.join(classes, "class"), words, n)
    edges = durable(_confirm(counted, sets, percent), WIDE * n)
    component = components(edges, n)
    more = durable(_within_families(family, component, sets, percent, n).union(_confirm(across, sets, percent)), WIDE * n)
    if not more.isEmpty():
        component = components(edges.union(more), n)
    of_class = classes.select("name", "class", "low").join(component, F.col("class") == F.col("node"), "left")
    of_class = durable(of_class.select("name", "low", F.coalesce("component", "class").alias("component")), count)
    least = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    named = durable(of_class.join(least, "component").select("name", "component_id"), count)
    rows = signed.select("doc_id", "n_shingles", "name")
    return rows.where("name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")).union(
        rows.join(named, "name").select("doc_id", "n_shingles", "component_id")
    )


def _across_families(shared: DataFrame, family: DataFrame, classes: DataFrame, matches: int, n: int) -> DataFrame:
    """Pairs of different families in one list with enough collisions."""
    rows = durable(_labelled(shared, family, "family"), n)
    mixed = rows.groupBy("coordinate", "value").agg(F.min("family").alias("p"), F.max("family").alias("q")).where("p <> q")
    # written first, so that both join sides are shuffles and a large group's rows can be split over tasks
    members = durable(rows.join(durable(mixed.select("coordinate", "value"), n), ["coordinate", "value"]), n)
    dealt = _block_pairs(members, ["coordinate", "value"], "family", ["family"], n).join(classes.select("class", "sketch"), "class")
    dealt = dealt.select("key", "one", "side", "class", "family", "sketch").repartition("key").sortWithinPartitions("key")
    return durable(arrow_map(dealt, _grouped(_collisions_across(matches)), "a long, b long").distinct(), WIDE * n)


def _within_families(family: DataFrame, component: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links that join components of one family."""
    members = durable(_labelled(family.select(F.col("node").alias("class"), F.col("component").alias("family")), component, "component"), n)
    mixed = members.groupBy("family").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q")
    members = durable(members.join(durable(mixed.select("family"), n), "family"), n)
    dealt = _block_pairs(members, ["family"], "component", ["component"], n).join(sets, "class")
    dealt = dealt.select("key", "one", "side", "class", "component", "set").repartition("key").sortWithinPartitions("key")
    return arrow_map(dealt, _grouped(_links_within(percent)), "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of each class as ``name``; a class without links is its own."""
    at = labels.select(F.col("node").alias("class"), F.col("component").alias(name))
    return rows.join(at, "class", "left").withColumn(name, F.coalesce(name, "class"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int, n: int) -> DataFrame:
    """(class, set) of the wanted classes, from any row that has the class's smallest doc_id and its set."""
    wanted = durable(wanted.select(F.col("low").alias("_low"), F.col("name").alias("_name"), "class"), n)
    size = wanted.agg(F.sum(F.octet_length("_name") + 48)).first()[0] or 0  # two numbers and what a row adds
    small = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted.hint("merge")
    rows = docs.select("doc_id", "text").join(small, F.col("doc_id").eqNullSafe(F.col("_low")))
    made = add_columns(rows, lambda: _set_kernel(words), [T.StructField("name", T.StringType()), T.StructField("set", T.BinaryType())], ["class", "_name"])
    # a repeated doc_id gives the set more than once
    return durable(made.where(F.col("name") == F.col("_name")).groupBy("class").agg(F.first("set").alias("set")), WIDE * n)


def near_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    found = near_components(docs)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows whose doc_id is the smallest of its component, with all their columns; rows without one stay."""
    kept = near_components(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
