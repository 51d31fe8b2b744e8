"""Near-duplicate texts: one-permutation MinHash, banded buckets, star-shaped candidate edges.

Every text's five-word shingles are hashed once; the hash's top bits choose one of ``BINS`` bins, and
each bin keeps its least hash. Empty bins take the value of the first filled bin in a random order of
their own (optimal densification). ``BANDS`` bands of ``ROWS`` bins are the buckets.

Equal shingle sets form a class first, so copies never meet in a bucket. In a bucket every class is
compared with two hubs only, and candidates are confirmed on their full sets. Classes of a bucket that
do not end up in one component are looked at again, with an exact prefix filter over shingles that
components share (see ``prefix_groups``). In the groups of those keys stars go on, from hubs of the
smallest components, until every pair of components has been compared; so no pair that shares a
bucket is lost.

A pair at similarity s shares a bucket with probability ``1 - (1 - s**4)**32``: 0.999995 at 0.75.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import LOWER, as_bytes, free_name, given_back, named, stored
from tidings.llm.quality_rules import word_hashes, word_memory

SHINGLE = 5
BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: Least similarity of a link, in per cent.
SIMILAR = 75
#: Ratio of neighbouring classes of set sizes.
SIZE_STEP = 1.05
#: Hubs of the smallest components that a group compares with its other members in one round.
HUBS = 256
#: Texts that are sketched at a time.
SKETCHED_ROWS = 1000
#: Bits of one bit map of Spark, and most maps that are sent to the rows of a table (64 MB).
MAP_BITS, MARKS = 1 << 15, 1 << 14

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
#: For each bin the order in which it looks for a filled bin.
PROBES = np.array([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _N
    h = (h ^ (h >> _HALF)) * _N
    return h ^ (h >> _HALF)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(SHINGLE, len(words))
    rolled = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        rolled = rolled * _M + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(rolled))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified bins of each set; sets are not empty."""
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bins = (flat >> np.uint64(57)).astype(np.int64)
    least = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * BINS + bins, flat)
    filled = np.zeros(len(least), bool)
    filled[owner * BINS + bins] = True
    out = least.copy()
    empty = np.flatnonzero(~filled)
    for probe in range(BINS):
        if not len(empty):
            break
        source = empty // BINS * BINS + PROBES[empty % BINS, probe]
        found = filled[source]
        out[empty[found]] = least[source[found]]
        empty = empty[~found]
    return out.reshape(len(sets), BINS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _N, parts.shape[:2]).copy()
    for i in range(ROWS):
        keys = _mixed(keys * _M + parts[:, :, i])
    return keys.view(np.int64)


SKETCH = "struct<n:bigint,k1:bigint,k2:bigint,bands:array<bigint>>"


def sketched_rows(texts: pa.Array) -> pa.Array:
    """Sketches of some texts."""
    sets = [shingle_set(t) for t in as_bytes(texts)]
    some = [s for s in sets if len(s)]
    bands = band_keys(signatures(some)) if some else np.zeros((0, BANDS), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    keys = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64)
    keys = keys.reshape(-1, 2).view(np.int64)
    ends = np.r_[0, np.cumsum(np.where(sizes > 0, BANDS, 0))].astype(np.int32)
    arrays = [
        pa.array(sizes),
        pa.array(keys[:, 0]),
        pa.array(keys[:, 1]),
        pa.ListArray.from_arrays(ends, pa.array(bands.ravel())),
    ]
    return pa.StructArray.from_arrays(arrays, names=["n", "k1", "k2", "bands"])


def sketch(text: Column) -> Column:
    """Set size, 128-bit key of the set and band keys (none for a text without words)."""

    @F.arrow_udf(SKETCH)
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in given_back(batches, word_memory()):
            parts = [sketched_rows(batch.slice(i, SKETCHED_ROWS)) for i in range(0, max(1, len(batch)), SKETCHED_ROWS)]
            yield pa.concat_arrays(parts)

    return sketched(text)


def shingles(text: Column) -> Column:
    """The full set of a text column, as sorted hashes."""

    @F.arrow_udf("array<bigint>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in given_back(batches, word_memory()):
            parts = [listed_sets(batch.slice(i, SKETCHED_ROWS)) for i in range(0, max(1, len(batch)), SKETCHED_ROWS)]
            yield pa.concat_arrays(parts)

    return listed(text)


def listed_sets(texts: pa.Array) -> pa.Array:
    """The sets of some texts."""
    sets = [shingle_set(t).view(np.int64) for t in as_bytes(texts)]
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def confirmed(edges: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    pairs = edges.join(one, "a").join(two, "b")
    near = pairs.where(100 * F.least("na", "nb") >= similar * F.greatest("na", "nb"))
    common = F.size(F.array_intersect("sa", "sb"))
    shared = near.select("a", "b", (F.col("na") + F.col("nb")).alias("both"), common.alias("i"))
    return shared.where(100 * F.col("i") >= similar * (F.col("both") - F.col("i"))).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its least node.

    Every node joins its least neighbour, the graph shrinks to those, and so on until no edge is left:
    stars take one step, and every step at least halves the nodes of a component. Steps are tables.
    """
    steps: list[DataFrame] = []
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        step = stored(least.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "hooks")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        rest = edges.join(left, "a").join(right, "b").where("ta <> tb")
        between = rest.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = stored(between.distinct(), "rest")
        if edges.isEmpty():
            break
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = steps.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    return found.select("node", F.col("to").alias("component"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after the links (a, b) between nodes."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    edges = stored(between.distinct(), "links")
    if edges.isEmpty():
        return labels
    moved = connected(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    after = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(after, "labels")


def open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of groups that hold several components, with their components; both roles must be left."""
    placed = groups.join(labels, "node")
    ends = ["component", "role"] if "role" in groups.columns else ["component"]
    each = [x for c in ends for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    split = placed.groupBy("bucket").agg(*each)
    for c in ends:
        split = split.where(F.col(f"lo_{c}") < F.col(f"hi_{c}"))
    return stored(placed.join(split.select("bucket"), "bucket"), "open")


def prefix_groups(nodes: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(bucket, node, role) by exact candidate keys for the nodes (node, component).

    All nodes order their shingles alike: those of one component only first, then the rarest. Sets of
    sizes m and n that are similar have ``need = ceil(similar * (m + n) / (100 + similar))`` shingles in
    common, so one common shingle is among the first ``m - need + 1`` and ``n - need + 1`` of them. The
    smaller set (role 0) is keyed by shingle and its own class of sizes, the larger (role 1) by shingle
    and every class its partner may be in, so a pair across components meets in its roles.
    """
    each = sets.join(nodes, "node").select("node", "component", "n", F.explode("shingles").alias("shingle"))
    ends = each.groupBy("shingle").agg(
        F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    across = ends.where("lo < hi").select("shingle", "f")
    own = Window.partitionBy("node")
    common = each.join(across, "shingle").withColumn("at", F.row_number().over(own.orderBy("f", "shingle")))
    common = common.withColumn("at", F.col("at") + F.col("n") - F.count("*").over(own))
    least = F.ceil(F.col("n") * similar / 100)
    prefix = common.where(F.col("at") <= F.col("n") - least + 1)
    step = math.log(SIZE_STEP)
    size = F.floor(F.log("n") / step)
    lowest = F.floor(F.log(F.col("n") * similar / 100) / step - 1e-9)
    role = F.transform(F.sequence(lowest, size), lambda c: F.struct(c.alias("class"), F.lit(1).alias("role")))
    roles = F.concat(role, F.array(F.struct(size.alias("class"), F.lit(0).alias("role"))))
    keys = prefix.withColumn("least", least).select("node", "n", "at", "least", "shingle", F.inline(roles))
    partner = F.greatest("least", F.ceil(F.exp(F.col("class") * step) * (1 - 1e-9)))
    partner = F.when(F.col("role") == 0, F.col("n")).otherwise(partner)
    need = F.ceil((F.col("n") + partner) * similar / (100 + similar))
    keys = keys.where(F.col("at") <= F.col("n") - need + 1)
    return stored(keys.select(F.xxhash64("shingle", "class").alias("bucket"), "node", "role"), "prefixes")


def edges_between(rows: DataFrame) -> DataFrame:
    """The distinct unordered pairs (a, b) of node and hub."""
    pair = rows.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return stored(pair.distinct(), "edges")


def further_edges(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from hubs of each group's smallest components, and the groups without those hubs.

    A hub is the least node of its component in the group; it meets the group's nodes of all other
    components in the other role, and then leaves the group.
    """
    parts = open_.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.min("node").alias("hub"))
    smallest = Window.partitionBy("bucket").orderBy("size", "hub")
    hubs = parts.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= HUBS)
    hubs = stored(hubs.select("bucket", F.col("hub").alias("node")), "hubs")
    star = open_.join(hubs, ["bucket", "node"]).select(
        "bucket", F.col("node").alias("hub"), F.col("component").alias("own"), (1 - F.col("role")).alias("role")
    )
    edges = edges_between(open_.join(star, ["bucket", "role"]).where("component <> own"))
    return edges, open_.join(hubs, ["bucket", "node"], "left_anti").select("bucket", "node", "role")


def resolved(buckets: DataFrame, labels: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Labels after every bucket's components have been compared."""
    left = open_groups(buckets, labels)
    if left.isEmpty():
        return labels
    left = open_groups(prefix_groups(left.select("node", "component").distinct(), sets, similar), labels)
    while not left.isEmpty():
        edges, rest = further_edges(left)
        labels = merged(labels, confirmed(edges, sets, similar))
        left = open_groups(rest, labels)
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR
) -> DataFrame:
    """Set size, component and verdict of every row.

    Rows are linked if their shingle sets' similarity reaches ``similar`` per cent; ``component_id`` is
    the least id that links reach. Null, empty and wordless texts have no shingles and no links. Texts
    that share an id may share its component. A row without an id takes the component of its exact
    copies, else none, and then stays. Repeated rows are each returned; other columns are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(named(id_col).cast("bigint").alias("id"), named(text_col).alias("text"))
    own = F.when(F.col("s.n") == 0, F.xxhash64("id"))
    sketches = stored(
        rows.select("id", sketch(F.col("text")).alias("s")).select(
            "id", "s.n", F.coalesce(own, "s.k1").alias("k1"), "s.k2", "s.bands"
        ),
        "sketches",
    )
    classes = sketches.groupBy("n", "k1", "k2").agg(F.min("id").alias("node"))
    placed = sketches.drop("bands").join(classes, ["n", "k1", "k2"], "left").select("id", "n", "node")

    # One row per class and band; copies of a set are dropped where they meet their class.
    chosen = sketches.where("n > 0").join(
        classes.where("n > 0 AND node IS NOT NULL").withColumnRenamed("node", "id"), ["n", "k1", "k2", "id"]
    )
    members = chosen.select(F.explode("bands").alias("bucket"), F.col("id").alias("node"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    buckets = stored(members.join(shared, "bucket"), "buckets")
    nodes = stored(buckets.select("node").distinct(), "nodes")
    sets = rows.join(nodes, F.col("id") == F.col("node"), "left_semi").select(
        F.col("id").alias("node"), shingles(F.col("text")).alias("shingles")
    )
    # Another text of a node's id may have no words. That is asked of the stored sets: asked before, Spark would
    # list the sets of all rows below the join for it, and the nodes' once more above.
    sets = stored(sets.select("node", F.size("shingles").alias("n"), "shingles"), "sets").where("n > 0")

    hubs = buckets.select("node", F.explode(F.array("lo", "hi")).alias("hub")).where("node <> hub")
    labels = nodes.select("node", F.col("node").alias("component"))
    labels = merged(labels, confirmed(edges_between(hubs), sets, similar))
    labels = resolved(buckets.where("node <> lo AND node <> hi").select("bucket", "node"), labels, sets, similar)
    component = F.coalesce("component", "node")
    return placed.join(labels, "node", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is null or not in the only column of ``ids``, a table of different ids.

    The ids' hashes are marked in bit maps of two bytes an id, ``MARKS`` in all at most, which go to the
    rows. A row that finds no mark stays where it is; only the others are joined with the ids.
    """
    (key,) = ids.columns
    at, part, marks = (free_name(docs, x) for x in ("_at", "_part", "_marks"))
    parts = min(max(1, math.ceil(16 * ids.count() / MAP_BITS)), MARKS)

    def placed(rows: DataFrame, value: Column) -> DataFrame:
        place = F.pmod(F.xxhash64(value), F.lit(parts * MAP_BITS))
        rows = rows.withColumn(at, place)
        return rows.withColumn(part, F.floor(F.col(at) / MAP_BITS)).withColumn(at, F.col(at) % MAP_BITS)

    maps = placed(ids, F.col(key)).groupBy(part).agg(F.bitmap_construct_agg(at).alias(marks))
    value = named(id_col).cast("bigint")
    seen = placed(docs, value).join(F.broadcast(maps), part, "left")
    octet = F.substring(marks, F.floor(F.col(at) / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(octet), 16, 10).cast("int"), (F.col(at) % 8).cast("int"))
    marked = value.isNotNull() & F.coalesce(bit == 1, F.lit(False))
    own = [named(c) for c in docs.columns]
    rest = seen.where(marked).select(*own)
    return seen.where(~marked).select(*own).union(rest.join(ids, value == F.col(key), "left_anti"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One row of every component, with all columns.

    Rows without an id stay. Of rows equal in id and text one stays; other texts of a kept id stay too.
    Only rows of a dropped or repeated id, and a sixteenth of the others, are shuffled whole.
    """
    verdicts = near_duplicates(docs, id_col, text_col, similar).select(named(id_col).alias("id"), "kept")
    counted = verdicts.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m"), F.max("kept").alias("kept"))
    key, text = free_name(docs, "_kept"), free_name(docs, "_text")
    ids = stored(counted.where("m > 1 OR NOT kept").withColumnRenamed("id", key), "apart")

    out = without(docs, id_col, ids.select(key))
    again = ids.where("m > 1 AND kept")
    if not again.isEmpty():
        rows = docs.join(again.select(key), named(id_col).cast("bigint") == F.col(key), "left_semi")
        hashed = rows.withColumn(text, F.sha2(named(text_col), 256))
        out = out.union(hashed.dropDuplicates([id_col, text]).drop(text))
    return out
