"""N-gram Jaccard self-join with token-combination prefixes, and the classes of near duplicates it links.

A document's set holds the hashes of its five-word shingles. Equal sets are one class and are joined once. Shingles are
counted over all classes and ordered rare first; two sets that are similar enough must share a token early in that
order (prefix filter). Prefixes are extended by g tokens, so at least g + 1 tokens are shared in them: either one of
these is rare, and the rare token alone is an index key, or all are frequent, and then two of them fall into one of g
hash classes: pairs of frequent tokens of one hash class are the other keys. The number of keys grows with the prefix,
not with its square, and common passages bring nobody together whose text is not mostly common.

Keys only say which sets to compare: sets that are connected by keys form a cluster, and within clusters exact
intersections decide. A cluster is cut into blocks of bounded size that all hold the cluster's hub; after that, only sets
that share a key with a set of another component than their own have to meet the blocks where such sets are. No pair list
is ever made, and no group is gathered whole.

Before that, most sets are cleared by the part of the hash space below ZONE alone: a set with more tokens there that no
other set has than a similar set could lack has no partner. Only the others, the suspects, are counted in full, and only
their sets are kept; every link is between suspects.

Null and empty texts, and those without words, have no shingles and are linked with nothing. Rows with equal ids, null
ids and equal texts are all kept; a component's id is its least non-null doc_id, and ids must be numbers. Very long texts are
read whole, as one set each; tokens of equal counts are ordered by their hash. An empty table gives no rows; extra
columns are untouched by :func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, discarded, raw, released, space_words, stored, table
from .components import connected_components

SHINGLE, PERCENT = 5, 80
#: Tokens found in more sets than this are frequent.
FREQUENT = 8
#: Share of the hash space that is counted for all sets.
ZONE = np.uint64(int(0.3 * 2**64))
#: Sets and tokens in one block of a cluster.
BLOCK_SETS, BLOCK_TOKENS = 2_000, 2_000_000
#: Below so many candidates their ids are broadcast (16 MB), else joined by a shuffle.
BROADCAST_IDS = 1_000_000

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[3]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; of a shorter text, one hash for all its words."""
    words = space_words(text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(w) - size + 1
    s = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        s = s * MIX[0] + w[k : k + n] * MIX[k % 5] + np.uint64(k)
    return np.unique(_mixed(s))


def _class_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - 2**63


def need(n: int, percent: int = PERCENT) -> int:
    """The least intersection of a set of n with a similar one."""
    return -(-n * percent // 100)


def level(n: int) -> int:
    return (n // 32).bit_length()


def levels(n: int, percent: int = PERCENT) -> tuple[int, ...]:
    """Levels at which a set of n can meet a similar one: that of the larger of the two."""
    return tuple(sorted({level(n), level(n * 100 // percent)}))


def prefix(n: int, lv: int, percent: int = PERCENT) -> int:
    """Length of the prefix extended by 2**lv tokens."""
    return min(n, n - need(n, percent) + 1 + (1 << lv))


def _first_pass(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set_key (null where empty), n and zone (tokens below ZONE) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keys, sizes, zones = [], [], []
            for text in batch["_text"]:
                s = shingles(text.as_py())
                keys.append(_class_key(s) if len(s) else None)
                sizes.append(len(s))
                zones.append(int(np.searchsorted(s, ZONE)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(zones, pa.int64())], names=["doc_id", "text_hash", "set_key", "n", "zone"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), raw(F.col("text")).alias("_text"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, set_key long, n long, zone long")


def _pairs(sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    tokens = np.concatenate([s for _, s in sets]) if sets else np.empty(0, dtype=np.uint64)
    keys = np.repeat(np.array([k for k, _ in sets], dtype=np.int64), [len(s) for _, s in sets])
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(keys)], names=["token", "set_key"])


def _zone_postings(docs: DataFrame) -> DataFrame:
    """(token, set_key) of all tokens below ZONE of sets that can have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sets = [s for s in (shingles(text.as_py()) for text in batch["_text"]) if need(len(s)) > 3]
            yield _pairs([(_class_key(s), s[: np.searchsorted(s, ZONE)]) for s in sets])

    return docs.select(raw(F.col("text")).alias("_text")).mapInArrow(run, "token long, set_key long")


def _all_postings(sets: DataFrame) -> DataFrame:
    """(token, set_key) of all tokens of ``sets`` (set_key, tokens as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            yield _pairs(list(zip(batch["set_key"].to_pylist(), _sets_of(batch["tokens"]), strict=True)))

    return sets.select("set_key", "tokens").mapInArrow(run, "token long, set_key long")


def _keys(shared: DataFrame) -> DataFrame:
    """(set_key, key): index keys of sets, from n and their tokens that other sets have too (structs of token and df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            lists = batch["shared"]
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            token = flat.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
            df = flat.field("df").to_numpy(zero_copy_only=False)
            owners, keys = [], []
            for i, (set_key, n) in enumerate(zip(batch["set_key"].to_pylist(), batch["n"].to_pylist(), strict=True)):
                t, d = token[ends[i] : ends[i + 1]], df[ends[i] : ends[i + 1]]
                order = np.lexsort((t, d))
                t, d = t[order], d[order]
                rank = np.arange(n - len(t), n)  # tokens of its own stand before the shared ones
                lv = levels(n)
                out = [t[(d <= FREQUENT) & (rank < prefix(n, lv[-1]))]]
                for v in lv:
                    f = t[(d > FREQUENT) & (rank < prefix(n, v))]
                    part = (f >> np.uint64(20)) % np.uint64(1 << v)
                    by = np.lexsort((f, part))
                    f, part = f[by], part[by]
                    for step in range(1, len(f)):
                        a = np.flatnonzero(part[step:] == part[:-step])
                        if not len(a):
                            break
                        out.append(_mixed(f[a] * MIX[0] + f[a + step] * MIX[2] + np.uint64(v)))
                own = np.concatenate(out)
                owners.append(np.full(len(own), set_key, dtype=np.int64))
                keys.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners) if owners else np.empty(0, np.int64)), pa.array(np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64))], names=["set_key", "key"])

    return shared.mapInArrow(run, "set_key long, key long")


class Overlaps:
    """Intersections of a query set with every set of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def similar(self, s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Positions of the sets of the block that link with ``s``."""
        low, high = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        each = high - low
        at = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
        both = np.bincount(self.owner[at], minlength=len(self.n))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + self.n - both)))


def _linked(sets: list[np.ndarray]) -> list[int]:
    """For each set of a block, the position of the first set of its component; the hub stands first."""
    root = np.arange(len(sets))
    block = Overlaps(sets)
    for i in range(len(sets)):
        if i and root[i] == 0:  # all that link with it are found by those outside the hub's component
            continue
        near = np.append(block.similar(sets[i]), i)
        roots = np.unique(root[near])
        root[np.isin(root, roots)] = roots[0]
    return root.tolist()


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=np.uint64) for x in column]


def _within_blocks(members: DataFrame) -> DataFrame:
    """(cluster, set_key, root): links of sets within a group of blocks; root is a set key."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("cluster", "ascending"), ("block", "ascending"), ("set_key", "ascending")]).combine_chunks()
        cluster, block, keys = (rows[c].to_numpy() for c in ("cluster", "block", "set_key"))
        sets = _sets_of(rows["tokens"])
        cuts = [0, *(np.flatnonzero((cluster[1:] != cluster[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(keys)]
        roots = np.empty(len(keys), dtype=np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            order = np.arange(a, b)
            hub = np.flatnonzero(keys[a:b] == cluster[a])
            if len(hub):
                order[[0, hub[0]]] = order[[hub[0], 0]]
            root = np.array(_linked([sets[i] for i in order]))
            roots[order] = keys[order[root]]
        return pa.table({"cluster": cluster, "set_key": keys, "root": roots})

    return members.groupBy("task").applyInArrow(run, "cluster long, set_key long, root long")


def _across_blocks(pairs: DataFrame) -> DataFrame:
    """(a, b): links of sets outside the hub's component (query) with the sets of another block."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        keys, query = rows["set_key"].to_numpy(), rows["query"].to_numpy()
        sets = _sets_of(rows["tokens"])
        own = np.flatnonzero(query == 0)
        a, b = [], []
        if len(own):
            block = Overlaps([sets[i] for i in own])
            for q in np.flatnonzero(query == 1):
                near = keys[own[block.similar(sets[q])]]
                a += [keys[q]] * len(near)
                b += near.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("cluster", "query_block", "block").applyInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (set_key, min_id, n) with tokens (as bytes), made again from the texts of the rows with these ids."""
    ids = wanted.select(F.col("min_id").alias("_id")).distinct()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    narrow = narrow.join(ids, F.coalesce("doc_id", F.lit(-1)) == F.col("_id"), "left_semi").select(raw(F.col("text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sets = [s for s in (shingles(text.as_py()) for text in batch["_text"]) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_class_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "tokens"])

    sets = narrow.mapInArrow(run, "set_key long, tokens binary")
    return wanted.join(sets, "set_key").groupBy("set_key", "min_id", "n").agg(F.first("tokens").alias("tokens"))


def _links_across(sets: DataFrame, large: DataFrame, keys: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, key): links between different blocks of the clusters in ``large`` (set_key, n, cluster, block).

    What isn't connected yet can only be linked through a key that sets of several components have: a set outside its
    hub's component meets the blocks in which a set has such a key in common with it."""
    root = connected_components(linked)
    at = keys.join(large, "set_key").join(root, F.col("set_key") == F.col("node"), "left")
    at = at.select("set_key", "n", "key", "cluster", "block", F.coalesce("component", "set_key").alias("root"))
    several = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    at = stored(at.join(several, "key"), "open-keys")
    hubs = large.select(F.col("cluster").alias("node")).distinct().join(root, "node").select(F.col("node").alias("cluster"), F.col("component").alias("hub_root"))
    asking = at.join(hubs, "cluster", "left").where("root <> coalesce(hub_root, cluster)").select("set_key", "n", "key", "cluster", F.col("block").alias("own"))
    meetings = asking.join(at.select("key", "block").distinct(), "key").where("block <> own").select("set_key", "n", "cluster", "block").distinct()
    meetings = stored(meetings, "meetings")
    parts = meetings.groupBy("cluster", "block").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    meetings = meetings.join(parts, ["cluster", "block"]).withColumn("query_block", F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("parts")))
    meetings = meetings.select("cluster", "block", "query_block", "set_key")
    queries = meetings.join(sets.select("set_key", "tokens"), "set_key").withColumn("query", F.lit(1))
    asked = meetings.select("cluster", "block", "query_block").distinct()
    blocks = asked.join(sets.select("cluster", "block", "set_key", "tokens"), ["cluster", "block"]).withColumn("query", F.lit(0))
    links = _across_blocks(queries.unionByName(blocks))
    return links.select(F.col("a").alias("node"), F.col("b").alias("key")).union(links.select(F.col("b").alias("node"), F.col("b").alias("key")))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, component_id: a row for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = stored(_first_pass(docs), "shingles")
    first = F.first("n").alias("n"), F.first("zone").alias("zone")
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("min_id"), *first)

    # sets with more tokens of their own than a similar set could lack are done with
    postings = _zone_postings(docs).repartition("token")
    own = postings.groupBy("token").agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("other")).where("set_key = other")
    own = own.groupBy("set_key").agg(F.count("*").alias("own"))
    lack = F.col("n") - F.ceil(F.col("n") * PERCENT / F.lit(100))
    suspects = classes.join(own, "set_key", "left").where((F.ceil(F.col("n") * PERCENT / F.lit(100)) > 3) & (F.coalesce("own", F.lit(0)) <= lack))
    sets = stored(_sets(docs, stored(suspects.select("set_key", "min_id", "n"), "suspects")), "sets")

    # in how many of them each token is; what only one has brings nobody together
    held = stored(_all_postings(sets), "postings")
    counts = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = held.join(counts, "token").groupBy("set_key").agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    keys = stored(_keys(shared.join(sets.select("set_key", "n"), "set_key")), "keys")
    discarded(held)

    clusters = connected_components(keys.select(F.col("set_key").alias("node"), "key")).select(F.col("node").alias("set_key"), F.col("component").alias("cluster"))
    sized = sets.select("set_key", "n").join(clusters, "set_key")
    totals = sized.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    sized = sized.join(totals, "cluster").select("set_key", "n", "cluster", "blocks", F.pmod(F.xxhash64("set_key"), F.col("blocks")).alias("block"))
    sized = stored(sized, "clusters")
    many = sized.count()
    sets = sets.select("set_key", "tokens").join(sized.drop("n"), "set_key")

    # each block with the cluster's hub; small clusters share tasks
    tasks = F.concat_ws("/", F.when(F.col("blocks") > 1, F.col("cluster")), F.when(F.col("blocks") > 1, F.col("block")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(max(8, many // 500)))))
    hubs = sets.where((F.col("set_key") == F.col("cluster")) & (F.col("blocks") > 1)).withColumn("own", F.col("block"))
    hubs = hubs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> own").drop("own")
    roots = stored(_within_blocks(sets.unionByName(hubs).withColumn("task", tasks).drop("blocks")), "roots")

    linked = roots.select(F.col("set_key").alias("node"), F.col("root").alias("key"))
    if not sized.where("blocks > 1").isEmpty():
        linked = linked.unionByName(_links_across(sets, sized.where("blocks > 1"), keys, linked))
    labels = connected_components(linked)
    discarded(keys)
    named = classes.join(labels, F.col("set_key") == F.col("node"), "left").select("set_key", "id", F.coalesce("component", "set_key").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_set = named.select("set_key", "label").join(least, "label").select("set_key", "component_id")
    out = rows.select("doc_id", "text_hash", "n", "set_key").join(of_set, "set_key", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_key", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of its least doc_id, and of rows equal in id and text one. Rows
    without shingles or without an id all stay."""
    found = similarity_classes(docs)
    go = found.where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct("*").alias("_row"))  # packed, so that no column's name can clash
    rows = rows.select("_row", F.col("_row.doc_id").cast("long").alias("_id"), F.xxhash64("_row.text").alias("_text"))
    kept = rows.join(go, (F.col("_id") == F.col("_gone")) & (F.col("_text") == F.col("_hash")), "left_anti")
    again = found.where("n_shingles > 0 AND doc_id = component_id").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    if again.isEmpty():
        return kept.select("_row.*")
    several = F.col("_id") == F.col("_again")
    once = kept.join(again, several, "left_semi").dropDuplicates(["_id", "_text"])
    return kept.join(again, several, "left_anti").unionByName(once).select("_row.*")


def op7_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the size of its set and its component; edge cases: see the module's text."""
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
