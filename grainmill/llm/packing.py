"""Best-fit packing of token sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Texts with this string go to the tokenizers library itself, which may read it as one special id.
SPECIAL = "<|endoftext|>"
#: Characters in a worker's memory of encoded words, which is emptied when full, and in the longest part that it keeps.
CACHE, LONGEST = 4_000_000, 64

PIECES = "doc_id long, row long, n_ids long, head long, lengths array<int>, crcs array<long>, ids array<binary>"


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizers file (byte-level BPE).

    A text is cut before each single space between two non-space characters, where the file's pre-tokenizer cuts as well,
    and each part is encoded once and remembered; a text with other white space next to a space is encoded whole.
    """

    def __init__(self, path: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Fixed value: the pre-tokenizer's pattern of this vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def __call__(self, text: str) -> bytes:
        from array import array

        if SPECIAL in text:
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        parts = text.split(" ")
        if any(p == "" or p[0].isspace() or p[-1].isspace() for p in parts):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        if self.held > CACHE:
            self.seen.clear()
            self.held = 0
        seen, out = self.seen, [array("I", self.fast.encode_ordinary(parts[0])).tobytes()]
        for p in parts[1:]:
            got = seen.get(p)
            if got is None:
                got = array("I", self.fast.encode_ordinary(" " + p)).tobytes()
                if len(p) <= LONGEST:
                    seen[p] = got
                    self.held += len(p)
            out.append(got)
        return b"".join(out)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for text in part.column(2).to_pylist():
                    ids = encode(text) + end
                    n = len(ids) // 4
                    head = n % capacity or capacity
                    cuts = [0, *range(head, n + 1, capacity)]
                    pieces = [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
                    rows.append((n, head, [len(p) // 4 for p in pieces], [zlib.crc32(p) for p in pieces], pieces if with_ids else None))
                n, head, lengths, crcs, ids = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(lengths, pa.list_(pa.int32())), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.binary()))],
                    names=["doc_id", "row", "n_ids", "head", "lengths", "crcs", "ids"],
                )

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indexes into sizes. Each item goes to the open bin with the least room that holds it."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # the rooms that occur, sorted
    by_room: dict[int, list[int]] = {}

    def put(room: int, b: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(b)

    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append([i])
            put(capacity - sizes[i], len(bins) - 1)
            continue
        room = rooms[at]
        b = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.pop(at)
        bins[b].append(i)
        put(room - sizes[i], b)
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: by the sum of the sizes, and by those over half of the capacity, no two of which share a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each of which must raise the sum of squared fills, until bins empty.

    The underfull bins give, the least full first, and all other underfull ones receive. Moving a document, or exchanging one
    for one, two for one or one for two, raises the squared fill when the receiver ends fuller than either was before. Rounds
    go on until none changes anything or the least possible number of bins is reached; the sum of squares grows by whole
    numbers, so they end. What two bins can do depends on their sizes alone; pairs of contents that had nothing to do are
    remembered and not tried again.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    least, idle = least_bins([sizes[i] for b in bins for i in b], capacity), set()
    content = lambda b: tuple(sorted(sizes[i] for i in bins[b]))
    changed = True
    while changed:
        changed = False
        live = [b for b in range(len(bins)) if bins[b]]
        if len(live) <= least:
            break
        under = [b for b in live if fill[b] < capacity]
        by_content: dict[tuple, list[int]] = {}
        for b in sorted(under, key=lambda b: (-fill[b], b)):
            by_content.setdefault(content(b), []).append(b)
        for give in sorted(under, key=lambda b: (fill[b], b)):
            own = content(give) if bins[give] else ()
            for like, takers in list(by_content.items()):
                if not bins[give]:
                    break
                if (own, like) in idle:
                    continue
                for take in takers:
                    if take == give or not bins[take] or content(take) != like or not bins[give]:
                        continue
                    step = _step(bins[give], bins[take], fill[give], fill[take], sizes, capacity)
                    if not step:
                        idle.add((own, like))
                        break
                    while step and bins[give]:
                        out, back = step
                        bins[give] = [i for i in bins[give] if i not in out] + back
                        bins[take] = [i for i in bins[take] if i not in back] + out
                        moved = sum(sizes[i] for i in out) - sum(sizes[i] for i in back)
                        fill[give] -= moved
                        fill[take] += moved
                        changed = True
                        step = _step(bins[give], bins[take], fill[give], fill[take], sizes, capacity)
                    own = content(give)
    return [b for b in bins if b]


def _step(give: list[int], take: list[int], fg: int, ft: int, sizes: list[int], capacity: int) -> tuple[list[int], list[int]] | None:
    """The move, one-for-one, two-for-one or one-for-two exchange from give to take that fits and most raises the squared fill;
    None if none does. Documents of one size stand for each other, and a bin has few different sizes (45 add up to more than
    1024), so the pairs are few: each looks up the largest size on the other side that fits."""
    room, best, found = capacity - ft, max(0, fg - ft), None  # moving d > fg - ft from give to take raises fg^2 + ft^2
    mine, theirs = _by_size(give, sizes), _by_size(take, sizes)
    ours, others = sorted(mine), sorted(theirs)
    for s in ours:
        if best < s <= room:
            best, found = s, ([mine[s][0]], [])
    if found and best == room:
        return found

    def largest(table: list[int], most: int) -> int:
        at = bisect_right(table, most)
        return table[at - 1] if at else 0

    for t in others:  # one of give for one of take
        s = largest(ours, t + room)
        if best < s - t:
            best, found = s - t, ([mine[s][0]], [theirs[t][0]])
    for back in _pairs(theirs):  # one of give for two of take
        total = sum(sizes[i] for i in back)
        s = largest(ours, total + room)
        if best < s - total:
            best, found = s - total, ([mine[s][0]], back)
    for out in _pairs(mine):  # two of give for the smallest of take that makes them fit
        total = sum(sizes[i] for i in out)
        at = bisect_left(others, total - room)
        if at < len(others) and best < total - others[at]:
            best, found = total - others[at], (out, [theirs[others[at]][0]])
    return found


def _by_size(own: list[int], sizes: list[int]) -> dict[int, list[int]]:
    """Two documents at most of each size."""
    out: dict[int, list[int]] = {}
    for i in own:
        if len(out.setdefault(sizes[i], [])) < 2:
            out[sizes[i]].append(i)
    return out


def _pairs(by_size: dict[int, list[int]]) -> Iterator[list[int]]:
    for s, a in by_size.items():
        if len(a) > 1:
            yield a
        for t, b in by_size.items():
            if t < s:
                yield [a[0], b[0]]


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        heads = table.column("head").to_pylist()
        rest = [i for i, h in enumerate(heads) if h < capacity]
        sizes = [heads[i] for i in rest]
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        where: dict[int, tuple[int, int]] = {}
        for n, b in enumerate(bins):
            at = 0
            for j in sorted(b):
                where[rest[j]] = (n, at)
                at += sizes[j]
        top, seq, off = len(bins), [], []
        base = key[0].as_py() << 40
        for i, lengths in enumerate(table.column("lengths").to_pylist()):
            s, o = [], []
            for k in range(len(lengths)):
                if k == 0 and i in where:
                    s.append(base + where[i][0])
                    o.append(where[i][1])
                else:
                    s.append(base + top)
                    o.append(0)
                    top += 1
            seq.append(s)
            off.append(o)
        return pa.table({**{c: table.column(c) for c in ("doc_id", "lengths", "crcs", "ids")}, "seqs": pa.array(seq, pa.list_(pa.int64())), "offs": pa.array(off, pa.list_(pa.int64()))})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, group: int = 16_384, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most `capacity` tokens: a row for each piece with id, piece, start, length,
    ids_crc32 (of the ids as unsigned little-endian 32-bit numbers), sequence_id, offset and, with_ids, ids (those bytes).

    Each text is encoded and closed by end_id. Only a text longer than capacity is cut, into full pieces and a shorter first
    one; full pieces are sequences of their own. The first pieces are packed in groups of about `group` documents that share
    a hash of the id: best-fit decreasing, then local_search. A group costs at most one underfull sequence, so the loss does
    not grow with the input, and no task holds more than a group. tokenizer: a byte-level BPE file of the tokenizers library,
    with its ranks beside it as .tiktoken.

    Null text is empty: one piece, the end id alone. Repeated rows are packed once each; null ids are allowed. An empty
    table gives an empty result. Other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    cut = staged(src.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), PIECES), "pieces")
    groups = max(1, -(-cut.count() // group))
    keyed = cut.withColumn("grp", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "row"), F.lit(groups)))
    done = keyed.groupBy("grp").applyInArrow(_pack(capacity), "doc_id long, lengths array<int>, crcs array<long>, ids array<binary>, seqs array<long>, offs array<long>")
    nth = lambda c: F.element_at(c, F.col("piece") + 1)
    out = done.select("*", F.posexplode("lengths").alias("piece", "length"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.element_at("lengths", 1) + (F.col("piece") - 1) * F.lit(capacity))
    cols = [F.col("doc_id").alias(id_col), "piece", start.cast("long").alias("start"), F.col("length").cast("long").alias("length"), nth("crcs").alias("ids_crc32"), nth("seqs").alias("sequence_id"), nth("offs").alias("offset")]
    return out.select(*cols, *([nth("ids").alias("ids")] if with_ids else []))
