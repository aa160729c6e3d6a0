"""Toxicity scores by non-negative positive-unlabelled learning over words and fragments of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, beside, crc_mod, dropped, staged
from .words import MULT, mix

#: Fragments: so many bytes on end of a word, with the gap before or behind it. Two kinds more: whole words, pairs of neighbours.
LENGTHS = (4, 5, 6, 8)
KINDS = len(LENGTHS) + 2
#: Each fragment is three features: there; there twice; there three times and in one of DENSE words or more often.
LEVELS, DENSE = 3, 150
#: Features that are less than so many times as common among positives tell of language and length rather than of toxicity.
LIFT = 3
#: Bytes of text hashed at once; its arrays take about 60 MB.
BLOCK = 1 << 20
#: Rows read at once.
SLICE = 512
#: Tasks that share the fragments of the positive sample by hash.
PARTS = 8
BITS = 22

Hits = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Fragments:
    """64-bit hashes of fragments, words and pairs of words of whole columns of texts.

    Letters are lower-cased; the digits and signs that commonly stand for letters are read as those letters; all other ASCII
    characters are gaps. Hashes are differences of running sums of a polynomial, so a block is a few array operations.
    """

    def __init__(self):
        table = np.full(256, 32, np.uint8)
        for at in (*range(48, 58), *range(97, 123), *range(128, 256)):
            table[at] = at
        # Signs that stand for letters.
        for sign, letter in zip(b"013457@$", b"oieastas"):
            table[sign] = letter
        self.table, self.value = table, mix(np.arange(1, 257, dtype=np.uint64) * MULT)
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            base = 0xD6E8FEB86659FD93
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))

    def __call__(self, texts: pa.Array, within: bool = False, kinds: tuple[int, ...] = tuple(range(KINDS))) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, hashes, places, ends of the texts) for each of the kinds and each block of the texts, repeats included. A place lies in the
        text whose end is the first above it. Hashes of fragments across gaps are left out if `within`; who looks up known
        ones need not: no known fragment has these."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        t = pc.binary_join_element_wise(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        if not len(t):
            return
        off = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        data = self.table[np.frombuffer(t.buffers()[2], np.uint8)[off[0] : off[-1]]]
        ends, at, last = off[1:] - off[0], 0, None
        while at < len(data):
            end = self._gap(data, at)
            d = np.concatenate([[np.uint8(32)], data[at:end]])
            self._powers(len(d))
            run, gap = np.zeros(len(d) + 1, np.uint64), d == 32
            run[1:] = self.value[d]
            run[1:] *= self.up[: len(d)]
            np.cumsum(run, out=run)
            for kind, n in enumerate(LENGTHS):
                if kind not in kinds or len(d) < n:
                    continue
                h, place = run[n:] - run[:-n], np.arange(at, at + len(d) - n + 1)
                h *= self.down[: len(d) - n + 1]
                if within:
                    gaps = np.cumsum(gap)
                    ok = gaps[n - 2 : len(d) - 1] == gaps[: len(d) - n + 1]
                    h, place = h[ok], place[ok]
                yield kind, h, place, ends
                del h, place  # before the next kind's arrays are made
            at, begin = end, at
            if KINDS - 1 not in kinds and KINDS - 2 not in kinds:
                continue
            first, behind = np.nonzero(~gap[1:] & gap[:-1])[0] + 1, np.nonzero(~gap[:-1] & gap[1:])[0] + 1
            words = mix((run[behind] - run[first]) * self.down[first] + (behind - first).astype(np.uint64) * MULT)
            place = first + (begin - 1)
            if KINDS - 2 in kinds:
                yield KINDS - 2, words, place, ends
            if KINDS - 1 not in kinds:
                continue
            if last is not None:  # a pair may cross the blocks
                words, place = np.concatenate([last[:1], words]), np.concatenate([last[1:].view(np.int64), place])
            text = np.searchsorted(ends, place, "right")
            yield KINDS - 1, mix(words[:-1] * MULT + words[1:])[text[:-1] == text[1:]], place[1:][text[:-1] == text[1:]], ends
            if len(words):
                last = np.array([words[-1], place[-1:].view(np.uint64)[0]], np.uint64)

    @staticmethod
    def _gap(data: np.ndarray, at: int) -> int:
        """Where a block from `at` on ends: behind a gap."""
        step = BLOCK
        while at + step < len(data):
            gaps = np.nonzero(data[at + step - BLOCK : at + step] == 32)[0]
            if len(gaps):
                return at + step - BLOCK + int(gaps[-1]) + 1
            step += BLOCK
        return len(data)

    def inside(self, texts: pa.Array, kind: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, texts) of all fragments of a kind whose hash falls to `part`, repeats included."""
        hashes, found = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, h, place, ends in self(texts, True, (kind,)):
            own = (h >> np.uint64(40)) % np.uint64(parts) == part
            hashes.append(h[own])
            found.append(np.searchsorted(ends, place[own], "right"))
        return np.concatenate(hashes), np.concatenate(found)

    def words_in(self, texts: pa.Array) -> np.ndarray:
        """How many words each text has."""
        out = np.zeros(len(texts), np.int64)
        for _, _, place, ends in self(texts, kinds=(KINDS - 2,)):
            out += np.bincount(np.searchsorted(ends, place, "right"), minlength=len(texts))
        return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _counted(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (text, code) and how often each is there."""
    size = int(code.max()) + 1 if len(code) else 1
    return _counted_keys(text * size + code, size)


def _counted_keys(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_counted() of pairs as text * size + code, which are sorted in place: hits are many, and copies of them take most of a
    task's memory."""
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.nonzero(new)[0]
    return *np.divmod(key[at], size), np.diff(np.append(at, len(key)))


def levels_of(text: np.ndarray, code: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature) for fragments that are n times in a text of so many words."""
    twice, dense = n >= 2, (n >= 3) & (n * DENSE >= words[text])
    return np.concatenate([text, text[twice], text[dense]]), np.concatenate([code * LEVELS, code[twice] * LEVELS + 1, code[dense] * LEVELS + 2])


class Known:
    """Looks up known fragments: for each kind its sorted hashes; a fragment's code counts on from kind to kind."""

    def __init__(self, kinds: np.ndarray, hashes: np.ndarray):
        self.hashes, self.size = [hashes[kinds == kind] for kind in range(KINDS)], len(hashes)
        self.by: list[tuple[np.ndarray, np.ndarray, int]] | None = None

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each kind its hashes, which leading bits they have, and the code of the first; made where they are used."""
        if self.by is None:
            self.by, at = [], 0
            for own in self.hashes:
                seen = np.zeros(1 << BITS, bool)
                seen[(own >> np.uint64(64 - BITS)).astype(np.int64)] = True
                self.by.append((own, seen, at))
                at += len(own)
        return self.by

    def __call__(self, fragments: Fragments, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, feature) of the texts."""
        keys, words, tables = [np.empty(0, np.int64)], np.zeros(len(texts), np.int64), self._tables()
        for kind, h, place, ends in fragments(texts):
            if kind == KINDS - 2:
                words += np.bincount(np.searchsorted(ends, place, "right"), minlength=len(texts))
            own, seen, base = tables[kind]
            if not len(own):
                continue
            near = np.nonzero(seen[(h >> np.uint64(64 - BITS)).view(np.int64)])[0]
            at = np.searchsorted(own, h[near])
            at[at == len(own)] = 0
            hit = own[at] == h[near]
            keys.append(np.searchsorted(ends, place[near[hit]], "right") * self.size + at[hit] + base)
            del h, place, near, at, hit
        key = np.concatenate(keys)
        keys.clear()
        return levels_of(*_counted_keys(key, self.size), words)


def _document_counts(parts: int):
    """For each fragment of a part of all hashes, in how many of the texts it is at each level; those in fewer than two are left out."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts, part, fragments = table.column("text"), int(key[0].as_py()), Fragments()
        words = fragments.words_in(texts)
        out: dict[str, list[np.ndarray]] = {c: [np.empty(0, np.int64)] for c in ("kind", "h", "p0", "p1", "p2")}
        for k in range(KINDS):
            h, text = fragments.inside(texts, k, part, parts)
            code, at = np.unique(h, return_inverse=True)
            text, which, n = _counted(text, at)
            _, feature = levels_of(text, which, n, words)
            counts = np.bincount(feature, minlength=len(code) * LEVELS).reshape(-1, LEVELS)
            more = counts[:, 0] > 1
            for c, x in zip(out, (np.full(len(code), k), code.view(np.int64), *counts.T)):
                out[c].append(x[more].astype(np.int64))
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    return run


def _unlabelled_counts(known: Shared):
    """One row with the number of texts that have each feature, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, fragments = known.get(), Fragments()
        total = np.zeros(know.size * LEVELS, np.int32)
        for part in _sliced(batches):
            np.add.at(total, know(fragments, part.column(0))[1], 1)  # in place: there are far more features than a slice has
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["u"])

    return run


def _rows(known: Shared):
    """toxic, id, and the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, fragments = known.get(), Fragments()
        for part in _sliced(batches):
            text, feature = know(fragments, part.column(2))
            by = np.lexsort((feature, text))
            at = np.searchsorted(text[by], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature[by], pa.int32()))], names=["toxic", "doc_id", "at"])

    return run


class Sparse:
    """Rows of presences, as pairs (row, column)."""

    def __init__(self, rows: list[np.ndarray], dims: int):
        self.n, self.dims = len(rows), dims
        self.row, self.col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def mean_grad(self, d: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.col, d[self.row], minlength=self.dims), d.sum()) / self.n


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], dims: int, prior: float, steps: tuple[int, int] = (200, 200), rate: float = 0.1, decay: float = 1e-6, beta: float = 0.01) -> tuple[np.ndarray, float]:
    """A linear scorer by the non-negative risk estimator (Kiryo et al., 2017), full-batch Adam: first with the logistic loss,
    which pulls from any start, then with the sigmoid loss, which is bounded, so that a few rows far out can't hold it back.

    risk = prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)). Where the second part falls under -beta, the step goes up its
    gradient instead, which keeps the model from fitting the unlabelled rows as negatives one by one. A presence counts
    1 / sqrt(presences of a mean positive), so the first steps don't saturate the loss however many features there are.
    """
    scale = 1 / np.sqrt(max(1.0, np.mean([len(r) for r in pos])))
    xp, xu = Sparse(pos, dims), Sparse(unl, dims)
    w, b, m, v = np.zeros(dims), 0.0, np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, sum(steps) + 1):
        zp, zu = (np.clip(x.dot(w) * scale + b, -30, 30) for x in (xp, xu))
        fp, fu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        if t <= steps[0]:
            lp, lu, up, uu, plus = np.logaddexp(0, zp), np.logaddexp(0, zu), fp, fu, fp - 1
        else:
            lp, lu, up, uu, plus = fp, fu, fp * (1 - fp), fu * (1 - fu), fp * (fp - 1)
        negative = xu.mean_grad(uu) - prior * xp.mean_grad(up)
        g = prior * xp.mean_grad(plus) + negative if lu.mean() - prior * lp.mean() >= -beta else -negative
        g[:dims] = g[:dims] * scale + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:dims], b - step[dims]
    return w * scale, float(b)


def best_cut(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The score to cut at: the middle of the widest range of cuts that have the least non-negative risk under the 0-1 loss,
    prior * P(positive < cut) + max(0, P(unlabelled >= cut) - prior * P(positive >= cut))."""
    at = np.unique(np.concatenate([fp, fu]))
    if len(at) < 2:
        return float(at[0]) + 1e-6
    cuts = (at[1:] + at[:-1]) / 2
    p, u = np.sort(fp), np.sort(fu)
    hit = 1 - np.searchsorted(p, cuts) / len(p)
    risk = prior * (1 - hit) + np.maximum(0, 1 - np.searchsorted(u, cuts) / len(u) - prior * hit)
    least = np.nonzero(risk <= risk.min() + 1e-12)[0]
    runs = np.split(least, np.nonzero(np.diff(least) > 1)[0] + 1)
    lo, hi = max(((at[r[0]], at[r[-1] + 1]) for r in runs), key=lambda r: (r[1] - r[0], -r[0]))
    return float((lo + hi) / 2)


class Model:
    """A weight for each feature of the known fragments, and a bias. Without fragments every text scores alike, below a half."""

    def __init__(self, kinds=(), hashes=(), weights=(), bias: float = -2.0):
        self.known = Known(np.array(kinds, np.int64), np.array(hashes, np.uint64))
        self.weights, self.bias = np.array(weights, np.float64), bias

    def __call__(self, fragments: Fragments, texts: pa.Array) -> np.ndarray:
        text, feature = self.known(fragments, texts)
        z = self.bias + np.bincount(text, self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _score(model: Shared, field: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, fragments = model.get(), Fragments()
        for part in _sliced(batches):
            texts = pc.struct_field(part.column(0), [field]) if field else part.column(1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(fragments, texts), pa.float64())], names=["src", "score"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 4_000, max_unlabelled: int = 12_000, folds: int = 5, tune: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A Model learnt from labelled rows whose crc32(id as text) mod folds is not 0.

    Positives: at most max_positive rows confirmed toxic. Unlabelled: at most max_unlabelled rows of the same table, their
    labels unread. Both are the first by hash of the id, a sample that does not depend on partitions; everything learnt is
    bounded by it. The class prior is the share of toxic rows among all labelled rows of these folds.

    Features: every fragment, word and pair of neighbouring words (three levels each) whose gain in log-likelihood for
    positives against unlabelled text is more than one of so many tested would have by chance, and which is LIFT times as
    common among positives or more; their number is not capped.
    Every `tune`-th row of the sample is left out of the fit and sets the cut instead, by the same risk under the 0-1 loss.

    Null texts and texts without any feature have nothing against them. Repeated label rows count once, toxic if any says
    so; null labels and null ids are not read. Without positives, or if no feature stands out, the model is constant.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != 0)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model()
    first = lambda df, k: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    picked = first(known.where("toxic = 1"), max_positive).withColumn("toxic", F.lit(1)).unionByName(first(known, max_unlabelled).withColumn("toxic", F.lit(0)))
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The sample has at most max_positive + max_unlabelled ids, so its side is broadcast.
    rows = staged(text.join(F.broadcast(picked), "doc_id").select("toxic", "doc_id", "text"), "sample")
    try:
        return _trained(rows, toxic / n, tune)
    finally:
        dropped(rows)


def _trained(rows: DataFrame, prior: float, tune: int) -> Model:
    spark = rows.sparkSession
    n, m = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n or not m:
        return Model()
    spread = rows.where("toxic = 1").select(F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "text")
    counts = staged(spread.groupBy("part").applyInArrow(_document_counts(PARTS), "kind long, h long, p0 long, p1 long, p2 long"), "fragments")
    tests = max(1, counts.count()) * LEVELS
    best = F.col("p0") * F.log((F.col("p0") + 0.5) * (m + 1) / (0.5 * (n + 1)))  # the gain if no unlabelled text had it
    table = counts.where(best > float(np.log(tests + 1))).toArrow().sort_by([("kind", "ascending"), ("h", "ascending")])
    dropped(counts)
    kinds, hashes = table.column("kind").to_numpy(), table.column("h").to_numpy().view(np.uint64)
    by = np.lexsort((hashes, kinds))
    kinds, hashes = kinds[by], hashes[by]
    p = np.stack([table.column(f"p{k}").to_numpy()[by] for k in range(LEVELS)], 1)
    if not len(kinds):
        return Model()
    found = rows.where("toxic = 0").select("text").coalesce(8).mapInArrow(_unlabelled_counts(Shared(spark, Known(kinds, hashes))), "u binary").collect()
    u = sum(np.frombuffer(r["u"], np.int32).astype(np.int64) for r in found).reshape(-1, LEVELS)
    ratio = ((p + 0.5) / (n + 1)) / ((u + 0.5) / (m + 1))
    chosen = (p * np.log(ratio) > np.log(tests + 1)) & (ratio >= LIFT)
    some = chosen.any(1)
    if not some.any():
        return Model()
    kinds, hashes, chosen = kinds[some], hashes[some], chosen[some].ravel()
    column = np.cumsum(chosen) - 1
    table = rows.select("toxic", "doc_id", "text").mapInArrow(_rows(Shared(spark, Known(kinds, hashes))), "toxic int, doc_id long, at array<int>").toArrow()
    flat = [(t, i, column[f][chosen[f]]) for t, i, f in zip(table.column("toxic").to_pylist(), table.column("doc_id").to_pylist(), (np.asarray(x.values, np.int64) for x in table.column("at")))]
    flat.sort(key=lambda r: (r[0], r[1] * 0x9E3779B97F4A7C15 % 2**64, r[1]))
    pos, unl = ([f for t, _, f in flat if t == kind] for kind in (1, 0))
    apart = tune if min(len(pos), len(unl)) >= 10 * tune else 0
    fit = lambda x: [r for k, r in enumerate(x) if not apart or k % apart]
    own = lambda x: [r for k, r in enumerate(x) if not apart or not k % apart]
    w, b = fit_nnpu(fit(pos), fit(unl), int(chosen.sum()), prior)
    of = lambda x: Sparse(own(x), len(w)).dot(w) + b
    b -= best_cut(of(pos), of(unl), prior)
    weights = np.zeros(len(chosen))
    weights[chosen] = w
    return Model(kinds, hashes, weights, min(b, -0.5))  # a text with none of the fragments has nothing against it


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and score (0 to 1) for every whole text; the model is bounded by the sample it was learnt from.

    Null and empty texts have the score of no fragments; very long texts are read in blocks; repeated rows score alike; an
    empty table gives an empty result; a column named score gives way to the new one.
    """
    src, cols, inside = beside(docs, keep, text_col, "score")
    out = src.mapInArrow(_score(Shared(docs.sparkSession, model), text_col if inside else None), T.StructType([src.schema["src"], T.StructField("score", T.DoubleType())]))
    return out.select(*(F.col("src")[c].alias(c) for c in cols), "score")
