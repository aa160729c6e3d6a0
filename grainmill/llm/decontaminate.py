"""Benchmark decontamination: CGK embedding of edit distance, bit-sampling LSH over item-sized windows, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, beside
from .words import MULT, WordHasher, distinct, mix

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))
#: Words of windows embedded at once in a worker, and windows at most.
BATCH_WORDS, BATCH = 200_000, 1_000
#: Bytes of texts searched at once in a worker.
CHUNK = 6_000_000


def allowed(n: int, percent: int) -> int:
    """Edits of words that an item of n words may take."""
    return n * (100 - percent) // 100


def cgk(strings: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sampled places of CGK embeddings (Chakraborty, Goldenberg, Koucky, 2016) of rows of equal length: (places of a
    repetition, repetitions, rows), for places of each repetition, (repetitions, places).

    A pointer walks along each row; output j is the symbol under it, and the pointer moves on where a random bit of (j,
    symbol), drawn anew for each repetition, says so. Two rows with few edits fall into step again after each edit, so their
    outputs differ in few places. Past the row's end the symbol is 0. Only the outputs at the places are kept.
    """
    rows, n = strings.shape
    reps, bits = places.shape
    flat = np.concatenate([strings, np.zeros((rows, 1), np.uint64)], axis=1).ravel()
    at = np.tile(np.arange(rows) * (n + 1), reps)
    end = at + n
    out = np.empty((bits, reps, rows), np.uint64)
    wanted = {int(j): np.nonzero(places == j) for j in np.unique(places)}
    number = np.arange(1, reps + 1, dtype=np.uint64)
    for j in range(int(places.max()) + 1):
        x = flat[at]
        if j in wanted:
            rep, bit = wanted[j]
            out[bit, rep] = x.reshape(reps, rows)[rep]
        salts = mix((np.uint64(j * reps) + number) * MULT)
        at = np.minimum(at + (((x ^ np.repeat(salts, rows)) * MULT) >> np.uint64(63)).astype(np.int64), end)
    return out


def sample_keys(strings: np.ndarray, reps: int, bits: int) -> np.ndarray:
    """LSH keys, (reps, rows): `bits` sampled places of each embedding, hashed together."""
    rows, n = strings.shape
    steps = 2 * n
    rng = np.random.default_rng(n)
    places = np.array([rng.choice(steps, min(bits, steps), replace=False) for _ in range(reps)])
    e = cgk(strings, places)
    key = np.repeat(np.arange(1, reps + 1, dtype=np.uint64)[:, None], rows, 1)
    for x in e:
        key = mix(key * MULT + x)
    return key


def repetitions(n: int, percent: int, bits: int, recall: float, trials: int | None = None, samples: int = 64) -> int:
    """How often to sample so that an item with the most edits allowed is met with the recall wished for.

    Measured: random rows of n symbols take allowed(n) random edits, and each pair's keys are compared `samples` times. Pairs
    agree in different shares p of the times (early edits cost more), so the least r is taken for which the mean over the
    pairs of 1 - (1 - p)^r reaches the recall; the mean p would promise too much. Then r grows until its own
    tables meet the share of these pairs.
    """
    k = allowed(n, percent)
    if not k:
        return 1
    trials = trials or max(100, min(800, 400_000 // n))  # shares of long rows vary less
    rng = np.random.default_rng(97 + n)
    a = rng.integers(1, 2**62, (trials, n)).astype(np.uint64)
    b = np.empty_like(a)
    for t in range(trials):
        row = a[t].tolist()
        for _ in range(k):
            kind, at = rng.integers(3), int(rng.integers(len(row)))
            if kind == 0:
                row[at] = int(rng.integers(1, 2**62))
            elif kind == 1:
                row.pop(at)
            else:
                row.insert(at, int(rng.integers(1, 2**62)))
            row = row or [1]
        b[t] = (row + rng.integers(1, 2**62, n).tolist())[:n]  # the window goes on into other text, or is cut
    def agree(reps: int) -> np.ndarray:
        size = max(1, min(25, BATCH_WORDS // n))
        return np.concatenate([(sample_keys(a[t : t + size], reps, bits) == sample_keys(b[t : t + size], reps, bits)).sum(0) for t in range(0, trials, size)])

    away = 1 - (agree(samples) + 0.5) / (samples + 1)
    r, missed = 1, away.copy()
    while missed.mean() > 1 - recall:
        r, missed = r + 1, missed * away
    while np.mean(agree(r) > 0) < recall:  # by the very tables that r gives
        r += 1
    return r


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of text with the least word edit distance to item: the first end that has it, and
    the last start for that end. Sellers' algorithm, a row of the table at a time."""

    def row_by_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for i, x in enumerate(a, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = row_by_row(item, text, True)
    end = int(row.argmin())
    back = row_by_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class Finder:
    """The items' LSH tables, by length of the item in words."""

    def __init__(self, items: list[tuple[int, str]], percent: int, bits: int, recall: float, most_reps: int):
        hasher = WordHasher()
        by_n: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            if len(w := hasher.one(text)):
                by_n[len(w)].append((item, w))
        often = Counter(x for own in by_n.values() for _, w in own for x in set(w.tolist()))
        self.classes, self.vocab, rare_sets = [], [], []
        for n, own in sorted(by_n.items()):
            rows, k = np.array([w for _, w in own]), allowed(n, percent)
            b = max(1, min(bits, n // 2))
            while (r := repetitions(n, percent, b, recall)) > most_reps and b > 1:
                b -= 1
            tables = []
            for keys in sample_keys(rows, r, b).tolist():
                t: dict[int, list[int]] = defaultdict(list)
                for i, key in enumerate(keys):
                    t[key].append(i)
                tables.append((np.array(sorted(t), np.uint64), dict(t)))
            # k edits leave at least r - k of any r words of an item in the window: here of its rarest, by items that have them.
            r = min(n, 2 * k + 2)
            rare_sets.append({x for w in rows.tolist() for x in sorted(w, key=lambda x: (often[x], x))[:r]})
            self.vocab.append(np.unique(rows))
            self.classes.append((n, k, b, r - k, [x for x, _ in own], rows, tables))
        self.rare = np.array(sorted(set().union(*rare_sets)), np.uint64)
        self.member = np.array([np.isin(self.rare, np.array(sorted(x), np.uint64)) for x in rare_sets])

    def __call__(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) for texts on end in words, text t ending before ends[t]. The best window of each item in each text."""
        if not len(words) or not self.classes:
            return
        ids = np.searchsorted(self.rare, words)
        ids[ids == len(self.rare)] = 0
        marks = np.nonzero(self.rare[ids] == words)[0]
        ids = ids[marks]
        starts = np.concatenate([[0], ends[:-1]])
        whose = np.repeat(np.arange(len(ends)), ends - starts)
        limit = ends[whose]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for c, (n, k, b, least, names, rows, tables) in enumerate(self.classes):
            hits = marks[self.member[c][ids]]
            if len(hits) < least:
                continue
            first, last = hits[: len(hits) - least + 1], hits[least - 1 :]
            ok = (last - first < n) & (whose[first] == whose[last])
            spans = [np.arange(max(z - n + 1, starts[whose[a]]), a + 1) for a, z in zip(first[ok].tolist(), last[ok].tolist())]
            near = distinct(np.concatenate(spans)) if spans else np.empty(0, np.int64)
            met: dict[tuple[int, int], set[int]] = {}
            size = max(1, min(BATCH, BATCH_WORDS // n))
            for lo in range(0, len(near), size):
                pos = near[lo : lo + size]
                idx = pos[:, None] + np.arange(n)
                inside = idx < limit[pos][:, None]
                windows = np.where(inside, words[np.minimum(idx, len(words) - 1)], np.uint64(0))
                whole = self.vocab[c]
                of = np.searchsorted(whole, windows)
                of[of == len(whole)] = 0
                enough = (whole[of] == windows).sum(1) >= n - k
                pos, windows = pos[enough], windows[enough]
                if not len(pos):
                    continue
                for (keys, t), got in zip(tables, sample_keys(windows, len(tables), b)):
                    where = np.searchsorted(keys, got)
                    where[where == len(keys)] = 0
                    for i in np.nonzero(keys[where] == got)[0].tolist():
                        for x in t[int(got[i])]:
                            met.setdefault((int(whose[pos[i]]), x), set()).add(int(pos[i]))
            for (text, x), at in met.items():
                for lo, hi in _stretches(sorted(at), n + k):
                    lo, hi = max(lo - k, int(starts[text])), min(hi + n + k, int(ends[text]))
                    d, begin, end = nearest(rows[x], words[lo:hi])
                    found = (d, lo + begin - int(starts[text]), lo + end - int(starts[text]))
                    if d <= k and found < best.get((text, names[x]), (k + 1,)):
                        best[text, names[x]] = found
        for (text, item), (d, begin, end) in sorted(best.items()):
            yield text, item, begin, end, d


def _stretches(at: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of places that lie no more than gap apart."""
    first = last = at[0]
    for p in at[1:]:
        if p - last > gap:
            yield first, last
            first = p
        last = p
    yield first, last


def _find(finders: list[Shared], field: str | None):
    """Columns src, leaks so far and (unless src has it as field) text; the items found are put after the leaks so far. With
    several blocks of items a task unpacks one at a time, for each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, one = WordHasher(), finders[0].get() if len(finders) == 1 else None
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [field]) if field else batch.column(2)
            hits, sizes = batch.column(1).to_pylist(), np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            for finder in finders:
                find, base = one or finder.get(), 0
                while base < len(texts):
                    below = sizes[base - 1] if base else 0
                    upto = max(base + 1, int(np.searchsorted(sizes, below + CHUNK, "right")))
                    for t, item, start, end, d in find(*hasher(texts.slice(base, upto - base))):
                        hits[base + t].append({"item_id": item, "start": start, "end": end, "edits": d})
                    base = upto
                del find
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, kind), *batch.columns[2:]], names=batch.schema.names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, percent: int = 80, bits: int = 2, recall: float = 0.99, most_reps: int = 32, item_block: int = 2_000, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The columns in keep (all, if None) of every document, and leaks: an array of (item_id, start, end, edits), the best
    window of each benchmark item that the text holds with word edit distance <= (100 - percent) % of the item's words.

    Words are A-Z lower-cased runs without ASCII white space; start and end count words. Windows of the item's length start
    at every word of every text; those with too few of the rarest words of any item of that length are passed over, which loses nothing.
    The others are embedded by CGK and looked up under `bits` sampled places, as often as the measured collision rate asks
    for to meet `recall` at the most edits allowed (fewer places where that would take more than most_reps tables); then the
    edit distance is computed exactly.

    The items go to the workers in blocks of item_block items or block_chars characters; one pass over the texts serves all, and a
    task holds one block at a time. An item is never cut, so the longest one bounds a block from below. Null, empty and wordless items match nothing; null texts hold nothing; repeated rows are judged alike; an empty
    table gives an empty result. Extra columns pass through; one named leaks gives way to the new one.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).orderBy("i", "t")
    src, cols, inside = beside(docs, docs.columns if keep is None else keep, text_col, "leaks")
    out = src.withColumn("leaks", F.array().cast(LEAKS)).select("src", "leaks", *([] if inside else ["text"]))

    finders: list[Shared] = []
    block: list[tuple[int, str]] = []
    size = 0

    def close() -> None:
        finders.append(Shared(spark, Finder(block, percent, bits, recall, most_reps)))

    for row in items.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if len(block) >= item_block or size >= block_chars:
            close()
            block, size = [], 0
    if block:
        close()
    if finders:
        out = out.mapInArrow(_find(finders, text_col if inside else None), out.schema)
    return out.select(*(F.col("src")[c].alias(c) for c in cols), "leaks")
