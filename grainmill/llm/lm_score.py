"""Language-model scores by a weighted backoff automaton over smoothed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, crc_mod
from .words import MULT, WordHasher, distinct, mix

#: The end of a text as a token: no word hashes to it but by accident.
END = np.uint64(0x656E64)
#: Bytes of text that stand for a token where parts are sized.
TOKEN_BYTES = 6
#: Taken off the count of every n-gram of two tokens or more; the mass goes to the shorter context.
DISCOUNT = 0.5
#: Keys that a task sums at once.
PART_KEYS = 3_000_000
#: The engine's limit on the buckets of a table.
MOST_BUCKETS = 100_000

TOKENS = "g long, ids array<long>, held array<boolean>, ends array<int>, vocab binary, tokens binary"
BLOBS = "part int, g long, keys binary, a binary, b binary, c binary"
FOUND = "g long, round int, part int, keys binary, a binary, b binary, c binary, n_all long, n_distinct long"


def tokens_of(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts on end, each text's words and then END, and where each text ends."""
    h, ends = hasher(texts)
    return np.insert(h, ends, END), ends + np.arange(1, len(ends) + 1)


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers as their bytes, plane by plane without the planes of zeros: small numbers take little."""
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    some = planes.any(1)
    head = len(x).to_bytes(7, "little") + bytes([int(np.packbits(some)[0])])
    return head + pa.compress(planes[some].tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes | None) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    n, some = int.from_bytes(blob[:7], "little"), np.unpackbits(np.array([blob[7]], np.uint8)).astype(bool)
    planes = np.zeros((8, n), np.uint8)
    planes[some] = np.frombuffer(pa.decompress(blob[8:], decompressed_size=int(some.sum()) * n, codec="zstd"), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def packed_keys(x: np.ndarray) -> bytes:
    """Sorted keys as the gaps between them."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes | None) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


class Index:
    """Finds numbers in a sorted table of distinct random ones by their leading bits, a few steps each."""

    def __init__(self, table: np.ndarray):
        self.table, bits = table, max(1, len(table).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bounds = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Index of each x in the table, -1 where it is not there."""
        out = np.full(len(x), -1, np.int32)
        if not len(self.table):
            return out
        at = self.bounds[x >> self.shift]
        left = np.arange(len(x), dtype=np.int32)
        while len(left):
            inside = at < len(self.table)
            if not inside.all():
                x, at, left = x[inside], at[inside], left[inside]
            found = self.table[at]
            same = found == x
            out[left[same]] = at[same]
            on = found < x
            x, at, left = x[on], at[on] + 1, left[on]
        return out


def _keys(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order, the key of the n-gram that ends at each token: odd for single tokens, even for longer ones, 0 where
    the text has fewer than n tokens so far."""
    begins = np.concatenate([[0], ends[:-1]])
    at = np.arange(len(tokens)) - np.repeat(begins, ends - begins)
    out = [tokens | np.uint64(1)]
    for n in range(2, order + 1):
        key = np.zeros(len(tokens), np.uint64)
        key[1:] = mix(out[-1][:-1] * MULT + tokens[1:] + np.uint64(n)) & ~np.uint64(1)
        key[at < n - 1] = 0
        out.append(key)
    return out


def packed_bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.packbits(x).tobytes(), codec="zstd", asbytes=True)


def unpacked_bits(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.unpackbits(np.frombuffer(pa.decompress(blob[8:], decompressed_size=-(-n // 8), codec="zstd"), np.uint8), count=n).astype(bool)


def _counts(keys: list[np.ndarray], learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each is at a place to learn from. Key 0 is none."""
    k, c = np.unique(np.concatenate([x[learnt & (x != 0)] for x in keys]), return_counts=True)
    other = distinct(np.concatenate([x[~learnt & (x != 0)] for x in keys]))
    other = other[Index(k)(other) < 0]
    every = np.concatenate([k, other])
    by = np.argsort(every, kind="stable")
    return every[by], np.concatenate([c, np.zeros(len(other), np.int64)])[by]


def _blobs(g: int, parts: int, keys: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows of BLOBS: the sorted keys and what belongs to them, cut into ranges of equal width."""
    width = -(-(1 << 64) // parts)
    cuts = np.searchsorted(keys, np.array([k * width for k in range(1, parts)], np.uint64))
    out = []
    for part, (lo, hi) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])):
        if lo < hi:
            out.append((part, g, packed_keys(keys[lo:hi]), *(packed(x[lo:hi]) for x in columns), *[None] * (3 - len(columns))))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    part, g, *blobs = zip(*rows) if rows else ((),) * 6
    return pa.table({"part": pa.array(part, pa.int32()), "g": pa.array(g, pa.int64()), **{name: pa.array(x, pa.binary()) for name, x in zip(("keys", "a", "b", "c"), blobs)}})


def _grouped(group_tokens: int):
    """Texts as they come in groups of about group_tokens tokens, a row for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, base, nth, held_back, size = WordHasher(), TaskContext.get().partitionId() << 24, 0, [], 0

        def made() -> pa.RecordBatch:
            tokens = np.concatenate([t for _, t, _ in held_back])
            shift = np.cumsum([0, *(len(t) for _, t, _ in held_back)])
            ends = np.concatenate([e + s for (_, _, e), s in zip(held_back, shift)])
            docs = pa.Table.from_batches([b for b, _, _ in held_back])
            vocab, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.argsort(-n, kind="stable")  # frequent words have small numbers, which pack well
            vocab, at = vocab[rank], np.argsort(rank)[at]
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if not isinstance(x, pa.Array) else x)
            ids, held = (docs.column(c).combine_chunks() for c in ("doc_id", "held_out"))
            return pa.RecordBatch.from_arrays([pa.array([base + nth], pa.int64()), one(ids, None), one(held, None), one(ends, pa.int32()), pa.array([packed(vocab)]), pa.array([packed(at)])], names=["g", "ids", "held", "ends", "vocab", "tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, ends = tokens_of(part.column(2), hasher)
                held_back.append((part.select(["doc_id", "held_out"]), tokens, ends))
                size += len(tokens)
                if size >= group_tokens:
                    yield made()
                    nth, held_back, size = nth + 1, [], 0
        if held_back:
            yield made()

    return run


class Group:
    """A group's tokens, and what is known of its n-grams from the tables of rounds found so far."""

    def __init__(self, row: dict, found: pa.Table | None, order: int, least: int = 1):
        self.g, self.ids, self.ends = row["g"], row["ids"], np.array(row["ends"], np.int64)
        self.held = np.array(row["held"], bool)
        self.vocab, self.at = unpacked(row["vocab"]), unpacked(row["tokens"]).astype(np.int64)
        self.keys = _keys(self.vocab[self.at], self.ends, order)
        self.learnt = np.repeat(~self.held, np.diff(self.ends, prepend=0))
        if found is None:
            return
        by = found.sort_by([("round", "ascending"), ("part", "ascending")]).to_pylist()
        self.rounds = {n: [r for r in by if r["round"] == n] for n in range(order + 1)}
        join = lambda n, f, c: np.concatenate([np.empty(0, np.uint64), *(f(r[c]) for r in self.rounds[n])])
        self.state = [join(0, unpacked, c).astype(np.int64) for c in ("a", "b", "c")]
        # Of each round: the sorted keys that are kept, counts, and whether this group owns them. The first has words and pairs, each later one n-grams of one length.
        self.known, self.cache = {}, {}
        for n in range(2, order + 1):
            if not self.rounds[n]:
                self.known[n] = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))
                continue
            a, kept = join(n, unpacked, "a").astype(np.int64), np.concatenate([unpacked_bits(r["keys"]) for r in self.rounds[n]])
            sent = self.keys[:2] if n == 2 else [self.keys[n - 1][self.asked(n, least)]]
            sent = distinct(np.concatenate(sent))
            self.known[n] = (sent[sent != 0][kept], a >> 1, (a & 1).astype(bool))

    def places(self, n: int, least: int) -> np.ndarray:
        """For each token the index in its round of the n-gram that ends there, -1 where it isn't kept."""
        if n not in self.cache:
            index = Index(self.known[max(2, n)][0])
            if n == 1:
                self.cache[n] = index(self.vocab | np.uint64(1))[self.at]
            else:
                ask = self.asked(n, least)
                out = np.full(len(ask), -1, np.int32)
                out[ask] = index(self.keys[n - 1][ask])
                self.cache[n] = out
        return self.cache[n]

    def asked(self, n: int, least: int) -> np.ndarray:
        """Where an n-gram ends that may be kept: of three tokens or more, only those whose shorter ones both are."""
        ask = self.keys[n - 1] != 0
        if n > 2:
            shorter = self.places(n - 1, least) >= 0
            ask &= shorter
            ask[1:] &= shorter[:-1]
        return ask

    def arcs(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that this group owns, as indexes in their round, and a place of each."""
        at, (_, _, own) = self.places(n, least), self.known[n]
        where = np.full(len(own), -1, np.int32)
        here = np.nonzero(at >= 0)[0]
        where[at[here]] = here  # any place of an n-gram tells its tokens
        gram = np.nonzero(own & (where >= 0))[0]
        return gram, where[gram]

    def contexts(self, order: int, least: int) -> list[tuple[int, np.ndarray]]:
        """For each round below the last the indexes of contexts that this group adds an arc to or falls back from."""
        out = {n: np.zeros(len(self.known[n][0]), bool) for n in range(2, max(3, order))}
        for n in range(2, order + 1):
            context = self.places(n - 1, least)
            _, pos = self.arcs(n, least)
            falls = np.nonzero((self.places(n, least)[1:] < 0) & (self.keys[n - 1][1:] != 0) & (context[:-1] >= 0))[0]
            mark = out[max(2, n - 1)]
            mark[context[pos - 1]] = True
            mark[context[falls]] = True
        return [(n, np.nonzero(mark)[0]) for n, mark in out.items()]


def _first(parts: int):
    """Words and pairs of each group, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = Group(row, None, 2)
                keys, c = _counts(group.keys, group.learnt)
                yield from _table(_blobs(group.g, parts, keys, c)).to_batches()

    return run


def _longer(n: int, order: int, least: int, parts: int):
    """n-grams of each group whose shorter ones are kept, with their counts."""

    def run(key: tuple, tokens: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in tokens.to_pylist():
            group = Group(row, found, n, least)
            keys, c = _counts([np.where(group.asked(n, least), group.keys[n - 1], np.uint64(0))], group.learnt)
            rows += _blobs(group.g, parts, keys, c)
        return _table(rows)

    return run


def _summed(n: int, least: int):
    """Counts of a part's keys over all groups, given back to each group that sent them, in the order of its keys: which are kept
    (n-grams seen `least` times or more, and every known word), and their counts. The first group that learns from one owns it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("g").to_pylist()
        each = [unpacked_keys(r["keys"]) for r in rows]
        every = np.concatenate(each)
        whose = np.repeat(np.arange(len(rows)), [len(x) for x in each])
        counts = np.concatenate([unpacked(r["a"]) for r in rows]).astype(np.int64)
        by = np.argsort(every, kind="stable")  # groups stay in order within a key
        k, c, whose = every[by], counts[by], whose[by]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.nonzero(new)[0]
        total = np.add.reduceat(c, at)
        word = (k[at] & np.uint64(1)) == 1
        kept = (total >= least) | (word & (total > 0))
        learns = np.nonzero(c > 0)[0]
        which = np.cumsum(new) - 1
        own = np.zeros(len(k), bool)
        own[learns[np.unique(which[learns], return_index=True)[1]]] = True
        value = np.empty(len(k), np.int64)
        value[by] = np.where(kept[which], total[which] * 2 + own, -1)
        out, upto = [], np.cumsum([0, *(len(x) for x in each)])
        for i, r in enumerate(rows):
            v = value[upto[i] : upto[i + 1]]
            has = v >= 0
            out.append({"g": r["g"], "round": n, "part": r["part"], "keys": packed_bits(has), "a": packed(v[has])})
        if out:
            out[0] |= {"n_all": int(total[word].sum()), "n_distinct": int((word & (total > 0)).sum())}
        return pa.Table.from_pylist(out, schema=pa.schema([("g", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "a", "b", "c")), ("n_all", pa.int64()), ("n_distinct", pa.int64())]))

    return run


def _states(order: int, least: int, parts: int):
    """For each context that a group has, sums over the arcs that the group owns: how many, their counts, the counts of their
    last n - 1 tokens."""

    def run(key: tuple, tokens: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in tokens.to_pylist():
            group = Group(row, found, order, least)
            sums = {n: np.zeros((3, len(group.known[n][0])), np.int64) for n in group.known}
            for n in range(2, order + 1):
                gram, pos = group.arcs(n, least)
                low = max(2, n - 1)
                context, shorter = group.places(n - 1, least)[pos - 1], group.places(n - 1, least)[pos]
                for k, x in enumerate((np.ones(len(gram)), group.known[n][1][gram], group.known[low][1][shorter])):
                    sums[low][k] += np.bincount(context, x, minlength=sums[low].shape[1]).astype(np.int64)
            picked = group.contexts(order, least)
            keys = np.concatenate([group.known[n][0][i] for n, i in picked])
            by = np.argsort(keys)
            rows += _blobs(group.g, parts, keys[by], *(np.concatenate([sums[n][k][i] for n, i in picked])[by] for k in range(3)))
        return _table(rows)

    return run


def _state_sums(key: tuple, table: pa.Table) -> pa.Table:
    """The sums of a part's contexts over all groups, given back to each group that has them, in the order of its keys."""
    rows = table.sort_by("g").to_pylist()
    each = [unpacked_keys(r["keys"]) for r in rows]
    k, at = np.unique(np.concatenate(each), return_inverse=True)
    sums = []
    for c in ("a", "b", "c"):
        total = np.zeros(len(k), np.int64)
        np.add.at(total, at, np.concatenate([unpacked(r[c]) for r in rows]).astype(np.int64))
        sums.append(total[at])
    upto = np.cumsum([0, *(len(x) for x in each)])
    out = [{"g": r["g"], "round": 0, "part": r["part"], **{c: packed(s[upto[i] : upto[i + 1]]) for c, s in zip(("a", "b", "c"), sums)}} for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, schema=pa.schema([("g", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "a", "b", "c")), ("n_all", pa.int64()), ("n_distinct", pa.int64())]))


def _backs(group: Group, order: int, least: int, n_all: int, n_distinct: int) -> dict[int, np.ndarray]:
    """For each round the weight of the failure arc of each of its n-grams: 0 where it has no arcs of its own."""
    picked = group.contexts(order, least)
    keys = np.concatenate([group.known[n][0][i] for n, i in picked])
    by = np.argsort(keys)
    sums = np.empty((3, len(keys)), np.int64)
    for k, x in enumerate(group.state):
        sums[k, by] = x
    out, at = {n: np.zeros(len(group.known[n][0])) for n in group.known}, 0
    for n, i in picked:
        m, c, lower = sums[:, at : at + len(i)]
        at += len(i)
        keys_n, count, _ = group.known[n]
        low = np.zeros(len(count), np.int64)  # of each n-gram, the count of its last tokens but the first
        here = group.places(n, least)
        pos = np.nonzero(here >= 0)[0]
        low[here[pos]] = group.known[max(2, n - 1)][1][group.places(n - 1, least)[pos]]
        word = (keys_n[i] & np.uint64(1)) == 1
        left = 1 - (c - DISCOUNT * m) / np.maximum(count[i], 1)
        free = 1 - np.where(word, (lower + 0.1 * m) / (n_all + 0.1 * (n_distinct + 1)), (lower - DISCOUNT * m) / np.maximum(low[i], 1))
        back = np.log10(np.maximum(left, 1e-12) / np.maximum(free, 1e-12))
        out[n][i] = np.where(m > 0, back, 0.0)
    return out


def _scored(order: int, least: int, n_all: int, n_distinct: int):
    def run(key: tuple, tokens: pa.Table, found: pa.Table) -> pa.Table:
        parts = []
        for row in tokens.to_pylist():
            group = Group(row, found, order, least)
            backs = _backs(group, order, least, n_all, n_distinct)
            at = group.places(1, least)
            size = len(at)
            pick = lambda x, i: np.where(i >= 0, x[np.maximum(i, 0)], 0) if len(x) else np.zeros(len(i), x.dtype)
            count = pick(group.known[2][1], at)
            known = count > 0
            score = alone = np.log10((count + 0.1) / (n_all + 0.1 * (n_distinct + 1)))
            for n in range(2, order + 1):
                # By arcs of n tokens: along the arc where it is kept; else down the failure arc, if the context is a state.
                context, back = np.ones(size), np.zeros(size)
                context[1:] = np.maximum(count[:-1], 1)
                back[1:] = pick(backs[max(2, n - 1)], at[:-1])
                at = group.places(n, least)
                count = pick(group.known[n][1], at)
                within = group.keys[n - 1] != 0
                score = np.where(at >= 0, np.log10(np.maximum(count - DISCOUNT, DISCOUNT) / context), np.where(within, score + back, score))
            begins = np.concatenate([[0], group.ends[:-1]])
            total = lambda x: pa.array(np.add.reduceat(x, begins))
            parts.append(pa.table({"doc_id": pa.array(group.ids, pa.int64()), "held_out": pa.array(group.held), "n_tokens": pa.array(group.ends - begins, pa.int64()), "n_known": total(known.astype(np.int64)), "base_score": total(alone), "score": total(score)}))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def score_texts(docs: DataFrame, folds: int = 10, order: int = 3, least: int = 2, group_tokens: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model).

    Learns from the texts whose crc32(id as text) mod folds is not 0. Words are A-Z lower-cased runs without ASCII white
    space; each text ends with one token more. Every token is counted, as a 63-bit hash; base_score is the smoothed unigram
    log10 probability. The model: every n-gram up to `order` that occurs `least` times or more, at every size of the corpus,
    so it grows with the corpus.

    p(w | h) = (count(h w) - DISCOUNT) / count(h) for a kept n-gram; the mass that is left goes to the shorter context, in
    proportion to its probabilities, so that each state's probabilities sum to one. States are the contexts of kept n-grams,
    arcs the n-grams, and a failure arc with the weight of falling there leads to the next shorter context.

    States and arcs are rows of tables and are never gathered. Texts become groups of about group_tokens tokens as they are
    read (a longer text is a group of its own), kept as numbers of the group's words. A group sends its distinct n-grams with
    their counts to the tasks that sum ranges of n-gram hashes, packed as sorted gaps; which of them are kept comes back,
    with their counts. Words and pairs go first; an n-gram of three tokens or more goes only if both its shorter ones were kept,
    which loses none. The first group that learns from an n-gram owns it and adds it to its context; the sums (whole numbers,
    so order does not matter) give the weights of failure arcs. A frequent n-gram is one entry per group.

    Null text is empty: one end token. Repeated rows count and score each; null ids are trained on as the empty id. An empty
    table gives an empty result. Other columns are not read.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, folds) == 0).alias("held_out"), text.alias("text"))
    spark = docs.sparkSession
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * size // (TOKEN_BYTES * PART_KEYS)))
    buckets = max(1, min(MOST_BUCKETS, -(-size // (TOKEN_BYTES * group_tokens))))
    tokens = Buckets(spark, "tokens", buckets, "g").add(src.mapInArrow(_grouped(group_tokens), TOKENS))
    found = Buckets(spark, "ngrams", buckets, "g")
    summed = lambda df, how: found.add(df.groupBy("part").applyInArrow(how, FOUND))

    def beside(own, schema: str) -> DataFrame:
        return tokens.read().groupBy("g").cogroup(found.read().groupBy("g")).applyInArrow(own, schema)

    summed(tokens.read().mapInArrow(_first(parts), BLOBS), _summed(2, least))
    n_all, n_distinct = found.read().agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    for n in range(3, order + 1):
        summed(beside(_longer(n, order, least, parts), BLOBS), _summed(n, least))
    summed(beside(_states(order, least, parts), BLOBS), _state_sums)
    out = beside(_scored(order, least, n_all, n_distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    tokens.close()
    found.close()
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

