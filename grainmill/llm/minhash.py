"""Near-duplicates by an inverted join over MinHash signature coordinates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, components, dropped, matched, staged
from .words import MULT, WordHasher, distinct, mix


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, given the hashes of its words; with fewer words than
    width, one of them all."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    out = words[: n - width + 1].copy()
    for k in range(1, width):
        out = mix(out * MULT + words[k : n - width + 1 + k])
    return distinct(mix(out + np.uint64(width)))


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the k coordinates."""
    s = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * MULT)
    return s[:k] | np.uint64(1), s[k:]


def signature(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest permuted hash for each coordinate; its low bits hold the coordinate, so equal numbers mean coordinate and value."""
    out = np.empty(len(mult), np.uint64)
    for k in range(len(mult)):
        out[k] = (shingles * mult[k] + add[k]).min()
    bits = np.uint64((1 << (len(mult) - 1).bit_length()) - 1)
    return (out & ~bits) | np.arange(len(mult), dtype=np.uint64)


def _sign(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (mult, add) = WordHasher(), permutations(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, k1, k2, sigs = [], [], [], []
                for words in hasher.split(part.column(1)):
                    s = shingle_hashes(words, width)
                    n.append(len(s))
                    key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16)
                    k1.append(int.from_bytes(key[:8], "little", signed=True))
                    k2.append(int.from_bytes(key[8:], "little", signed=True))
                    sigs.append(signature(s, mult, add).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def links_within(ids: list[int], sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Links (ids) that join what can be joined between documents marked left and those marked right.

    Collisions of signature coordinates are counted through inverted lists; pairs with fewer than `least` are skipped, as are
    pairs already joined. The others are compared on their full sets, the most alike first: 100 * |a & b| >= percent * |a | b|.
    """
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lists: dict[int, list[int]] = defaultdict(list)
    for i, row in enumerate(sigs.tolist()):
        for v in row:
            lists[v].append(i)
    out = []
    matches = np.zeros((len(ids), len(ids)), np.int16)
    for at in lists.values():
        if len(at) > 1:
            matches[np.ix_(at, at)] += 1
    a, b = np.nonzero(np.triu(matches >= least, 1))
    keep = (left[a] & right[b]) | (left[b] & right[a])
    a, b = a[keep], b[keep]
    order = np.argsort(-matches[a, b], kind="stable")
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if (rx := find(x)) == (ry := find(y)):
            continue
        s, t = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
        if 100 * len(s) < percent * len(t):
            continue
        at = np.searchsorted(t, s)
        at[at == len(t)] = len(t) - 1
        both = int((t[at] == s).sum())
        if 100 * both >= percent * (len(s) + len(t) - both):
            root[max(rx, ry)] = min(rx, ry)
            out.append((ids[x], ids[y]))
    return out


def _verify(width: int, k: int, least: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        mult, add = permutations(k)
        ids = table.column("doc_id").to_pylist()
        sets = [shingle_hashes(words, width) for words in WordHasher().split(table.column("text"))]
        sigs = np.array([signature(s, mult, add) for s in sets])
        block, i, j = np.array(table.column("block").to_pylist()), key[1].as_py(), key[2].as_py()
        found = links_within(ids, sets, sigs, block == i, block == j, least, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, coordinates: int = 32, least: int = 17, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicates: a row for each document with id, n_shingles, component_id (the smallest id reachable over
    links, its own included) and kept (id = component_id).

    A link joins documents whose sets of `width`-word shingles have 100 * intersection >= percent * union.

    1. Documents with the same set become one; the smallest id stands for it.
    2. Each set posts its signature under every (coordinate, value). A pair at the limit agrees in 85 % of the 32 coordinates
       on average and in fewer than `least` = 17 with a probability of about one in a million. So two linked sets share one of
       their coordinates - least + 1 rarest postings (prefix filter by corpus frequency); only those are joined, and a set
       whose rarest postings nobody shares is done. Frequent lines and passages fill frequent lists, which no prefix reaches.
    3. Sets that share a prefix posting form candidate clusters, found from stars (each list to its smallest member), never
       from pairs. A cluster of up to `block` sets is compared in one task, a larger one block against block, so a task holds
       at most two blocks. There, collisions are counted over inverted lists, pairs under `least` or already joined are
       skipped, and the rest is confirmed on full sets.
    4. The links (at most two blocks less one per task) are closed to components.

    Texts without words have an empty set and are alone. Null ids are not allowed to link: such rows are alone, with a null
    component. Rows that repeat an id are one document: they have one component, whether their texts are copies or differ; each has
    the n_shingles of its own text. An empty table gives an empty result. Other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total, distinct = src.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if total > distinct:
        how = {"percent": percent, "width": width, "coordinates": coordinates, "least": least, "block": block}
        return _by_rows(src, **how).withColumnRenamed("doc_id", id_col)
    signed = staged(src.mapInArrow(_sign(width, coordinates), "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>"), "signed")
    sets = staged(signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    reps = signed.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0")

    posted = reps.select("doc_id", F.explode("sig").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    prefix = coordinates - least + 1
    ranked = posted.join(shared, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("p"))
    room = F.lit(prefix - coordinates) + F.size("p")  # postings that nobody shares are the rarest and use up the prefix first
    postings = staged(ranked.where(room > 0).select("doc_id", F.explode(F.slice("p", F.lit(1), room)).alias("x")).select("doc_id", "x.token"), "postings")

    collected(docs.sparkSession)
    heads = postings.groupBy("token").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("token", "b")
    stars = postings.join(heads, "token").select(F.col("doc_id").alias("a"), "b")
    clusters = components(stars)
    blocks = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = clusters.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A merge join at every size: which texts are asked for grows with the corpus and is never broadcast.
    texts = placed.hint("merge").join(src, placed["node"] == src["doc_id"]).select("component", "blocks", "block", "doc_id", "text")
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    tasks = texts.select("component", "block", "doc_id", "text", F.explode(other).alias("t")).select("component", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "block", "doc_id", "text")
    # As many tasks as the session asks for, not as few as the bytes would: comparing takes far longer than reading.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = staged(tasks.repartition(spread, "component", "i", "j").groupBy("component", "i", "j").applyInArrow(_verify(width, coordinates, least, percent), "a long, b long"), "links")
    groups = components(links).select(F.col("node").alias("rep"), "component")
    dropped(postings, clusters, links)

    named = sets.join(groups, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    cols = ["doc_id", "n_shingles", "k1", "k2"]
    joins = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    grouped = matched(signed.where(joins).select(*cols), named, ["k1", "k2"], "n", signed.count()).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where(~joins).select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    out = grouped.unionByName(alone)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _by_rows(src: DataFrame, **how) -> DataFrame:
    """near_duplicates() where ids repeat: each distinct (id, text) is a node, and the nodes of one id are linked, since they are
    one document. An id's rows have one component; n_shingles is of the row's own text."""
    rows = src.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = staged(near_duplicates(rows.where("key is not null").dropDuplicates(["key"]).select(F.col("key").alias("doc_id"), "text"), **how), "rows")
    own = staged(rows.where("key is not null").select("doc_id", "key").distinct(), "own")
    first = own.groupBy("doc_id").agg(F.min("key").alias("b"))
    edges = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(own.join(first, "doc_id").select(F.col("key").alias("a"), "b"))
    groups = components(edges)
    placed = own.join(groups, own["key"] == groups["node"], "left").select("doc_id", "key", F.coalesce("component", "key").alias("component"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(names, "component").select("key", "component_id").join(found.select(F.col("doc_id").alias("key"), "n_shingles"), "key")
    null = near_duplicates(src.where("doc_id is null"), **how)
    known = rows.where("key is not null").select("doc_id", "key").join(named, "key").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return known.unionByName(null)
