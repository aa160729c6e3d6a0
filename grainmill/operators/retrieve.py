"""Exact top-k retrieval over a vector table, citations and context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, squeeze_ws, token_count, trim_ws

#: Vectors of a cell on average, cells at most, and queries and vectors that are scored at once.
CELL, CELLS, QUERY_BLOCK, TILE = 4_096, 1_024, 1_024, 1_024
#: Scores count to 12 digits. One that is less than another by more than this is less when both are rounded.
SLACK = 2e-12


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow column of lists at length one, and their lengths."""
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    x /= np.where(n == 0, 1, n)[:, None]
    return x, n


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the k highest scores of each row, ties in order of columns. Changes s."""
    if k > 8:
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(s, at, 1)
    found, rows = [], np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        at = s.argmax(1)
        found.append((at, s[rows, at]))
        s[rows, at] = -np.inf
    return np.stack([a for a, _ in found], 1), np.stack([b for _, b in found], 1)


class _Cells:
    """Cells around some of the vectors (pivots): a vector lies in the cell of its nearest one, and a query visits the cells that
    can hold one of its k nearest. Pivots alike share their vectors by a hash, so a vector of many copies fills no single cell.

    The k-th nearest pivot bounds the distance u of the k-th nearest vector from above, and a cell is no nearer to a query than the
    hyperplane halfway between the query's nearest pivot and the cell's; those farther than u are left out. Cell 0 has vectors of
    length 0, which score 0 with all queries.
    """

    def __init__(self, pivots: np.ndarray, k: int, salts: int):
        self.k, self.salts, self.all = k, salts, pivots
        self.pivots, self.w = np.unique(pivots, axis=0, return_counts=True) if len(pivots) else (pivots, np.ones(1, np.int64))
        self.start = 1 + np.cumsum(self.w) - self.w
        self.n = (1 + self.w.sum().item()) * salts
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * self.pivots @ self.pivots.T))

    def of_vectors(self, x: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, keys): a row for each salt."""
        rows = np.flatnonzero(np.isfinite(n))
        cell = np.ones(len(rows), np.int64)
        if len(self.pivots):
            at = (x[rows] @ self.pivots.T).argmax(1)
            cell = self.start[at] + h[rows] % self.w[at]
        cell[n[rows] == 0] = 0
        return np.repeat(rows, self.salts), (cell[:, None] * self.salts + np.arange(self.salts)).ravel()

    def of_queries(self, x: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, keys, least score of the k nearest): a row for each cell to visit."""
        rows = np.flatnonzero(np.isfinite(n))
        x, least = x[rows], np.full(len(rows), -np.inf)
        visit = np.ones((len(rows), 1 + len(self.w)), bool)
        if len(self.all) >= self.k:
            least = np.partition(x @ self.all.T, -self.k, axis=1)[:, -self.k] - SLACK
            d = np.maximum(0, 2 - 2 * x @ self.pivots.T)
            near = d.argmin(1)
            u = np.sqrt(np.maximum(0, 2 - 2 * least))
            visit[:, 1:] = d - d[np.arange(len(d)), near][:, None] <= 2 * u[:, None] * self.apart[near] + 1e-9
            visit[n[rows] == 0] = True
            visit[:, 0] = least <= 0
        q, c = np.nonzero(visit)
        w, first = np.where(c > 0, self.w[c - 1], 1), np.where(c > 0, self.start[c - 1], 0)
        part = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        q, cell = np.repeat(q, w), np.repeat(first, w) + part
        return rows[q], cell * self.salts + h[rows[q]] % self.salts, least[q]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 3, where: Column | None = None, query_id: str = "query_id", vector_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vector_id, score, rank): the k nearest vectors of each query by cosine, ties by vector id.

    Ids are strings or whole numbers and keep their kind. `where` filters the vectors before ranking. Vectors are dealt to cells
    and each query is sent to the cells that can hold one of its k nearest (see _Cells), where it is multiplied with all their
    vectors, a tile at a time. Exact: where vectors lie so that no cell can be left out, all pairs are scored. What is shuffled are
    the vectors, and each query and k rows of results for each cell that it visits; the driver gets the pivots alone. A task holds
    the vectors of one cell and a batch of queries.
    """
    if k < 1:
        raise ValueError("top_k must be positive")

    def named(df: DataFrame, col: str, new: str) -> DataFrame:
        kind = "string" if dict(df.dtypes)[col] == "string" else "long"
        return df.select(F.col(col).cast(kind).alias(new), F.col(embedding).alias("e")).where(F.col("e").isNotNull() & F.col(new).isNotNull())

    kept, asked = named(vectors.where(where) if where is not None else vectors, vector_id, "v"), named(queries, query_id, "q")
    q_kind, v_kind = dict(asked.dtypes)["q"], dict(kept.dtypes)["v"]
    e_kind = "array<float>" if {dict(df.dtypes)["e"] for df in (kept, asked)} == {"array<float>"} else "array<double>"
    hashed = lambda df, col: df.select(col, F.col("e").cast(e_kind).alias("e"), F.pmod(F.xxhash64(F.lit(2), col), F.lit(1 << 30)).alias("h"))
    n = kept.count()
    m = min(CELLS, n // CELL)
    pivots = np.zeros((0, 0))
    if m > 1:
        some = kept.where(F.pmod(F.xxhash64(F.lit(1), "v"), F.lit(n)) < m).select(F.col("e").cast("array<double>").alias("e")).toArrow().column(0).combine_chunks()
        if len(some):
            x, length = _units(some)
            pivots = x[np.isfinite(length) & (length > 0)]
    cells = _Cells(pivots, k, 1 + min(63, asked.count() // (16 * CELL * max(1, len(pivots)))))
    names = ["key", "q", "v", "e", "least"]
    schema = f"key long, q {q_kind}, v {v_kind}, e {e_kind}, least double"
    kinds = {"string": pa.string(), "bigint": pa.int64()}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                yield part, *_units(part.column(1)), part.column(2).to_numpy()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, length, h in parts(batches):
            rows, keys = cells.of_vectors(x, length, h)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(rows), kinds[q_kind]), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.nulls(len(rows), pa.float64())], names=names)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, length, h in parts(batches):
            rows, keys, least = cells.of_queries(x, length, h)
            for at in range(0, len(rows), 16 * QUERY_BLOCK):
                own = slice(at, at + 16 * QUERY_BLOCK)
                r = pa.array(rows[own])
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), part.column(0).take(r), pa.nulls(len(r), kinds[v_kind]), part.column(1).take(r), pa.array(least[own])], names=names)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, the vectors of a key before its queries."""
        now, ids, y = None, [], []
        for batch in batches:
            key, query = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if a == b:
                    continue
                if key[a] != now:
                    now, ids, y = key[a], [], []
                part = batch.slice(a, b - a)
                if not query[a]:
                    ids.append(part.column(2))
                    y.append(_units(part.column(3))[0])
                    continue
                if not len(ids):
                    continue
                if isinstance(ids, list):
                    ids = pa.concat_arrays(ids)
                    by = pc.sort_indices(ids)
                    ids, y = ids.take(by), np.concatenate(y)[by.to_numpy()]
                    if now < cells.salts:  # all score 0
                        ids, y = ids[:k], y[:k]
                for at in range(0, part.num_rows, QUERY_BLOCK):
                    yield from scored(part.slice(at, QUERY_BLOCK), ids, y)

    def scored(part: pa.RecordBatch, ids: pa.Array, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, least = _units(part.column(3))[0], part.column(4).to_numpy()
        c, s = [], []
        for at in range(0, len(y), TILE):
            own = x @ y[at : at + TILE].T
            col, best = _best(np.round(own, 12, out=own), k)
            c.append(col + at)
            s.append(best)
        c, s = np.concatenate(c, 1), np.concatenate(s, 1)
        if len(y) > TILE:
            by = np.argsort(-s, axis=1, kind="stable")[:, :k]
            c, s = np.take_along_axis(c, by, 1), np.take_along_axis(s, by, 1)
        q, i = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        if len(q):
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(q)), ids.take(pa.array(c[q, i])), pa.array(s[q, i])], names=["q", "v", "s"])

    rows = hashed(kept, "v").mapInArrow(dealt, schema).unionByName(hashed(asked, "q").mapInArrow(sent, schema))
    found = rows.repartition(min(cells.n, 512), "key").sortWithinPartitions("key", F.col("q").isNotNull()).mapInArrow(nearest, f"q {q_kind}, v {v_kind}, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(query_id), F.col("v").alias(vector_id), F.col("s").alias("score"), "rank")


def of_source(vectors: DataFrame, source: str | None, known: tuple[str, ...]) -> DataFrame:
    """The vectors of a source, all without one; a source that is not known is an error, not an empty result."""
    if source is not None and source not in known:
        raise ValueError(f"Unknown source {source!r}")
    return vectors if source is None else vectors.where(F.col("source") == source)


def pack_context(ranked: DataFrame, question: str, passages: dict[str, str], max_context: int = 1200, max_input: int = 4096, overhead: int = 0) -> DataFrame:
    """Pack the records of each question, in rank order, into its context; a record that does not fit is skipped and later,
    smaller ones are still tried.

    ranked: a row for each question and record; passages names its columns rank, id, source, score, label and text. Token
    counts are of functions.text.token_count, which adds up over passages set apart by white space. Returns the question
    column, context, used (array of id, source, score, citation), skipped (array of ids), context_tokens, input_tokens and
    over_budget (the question alone exceeds max_input; nothing is used then). A question's records are the k retrieved.
    """
    if max_context < 1 or max_input < 1:
        raise ValueError("Budgets must be positive")
    c = {k: F.col(v) for k, v in passages.items()}
    body = F.concat(F.lit("] "), c["label"], F.lit(" ("), c["id"].cast("string"), F.lit(")\n"), F.coalesce(c["text"], F.lit("")))
    item = F.struct(c["rank"].alias("rank"), c["id"].alias("id"), c["source"].alias("source"), c["score"].alias("score"), body.alias("body"), token_count(F.concat(F.lit("[1"), body)).alias("n"))
    own = ranked.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(ranked.select(c["id"].alias("id"), c["source"].alias("source"), c["score"].alias("score")).dtypes)
    used_t = f"array<struct<id:{kind['id']},source:{kind['source']},score:{kind['score']},citation:int>>"
    asked = token_count(question) + overhead
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("context"), F.array().cast(used_t).alias("used"), F.array().cast(f"array<{kind['id']}>").alias("skipped"))

    def step(a: Column, x: Column) -> Column:
        k = F.size(a["used"]) + 1
        total = a["n"] + x["n"]
        fits = (total <= max_context) & (total + asked <= max_input)
        sep = F.when(a["context"] == "", "").otherwise("\n\n")
        took = F.struct(total.alias("n"), F.concat(a["context"], sep, F.lit("["), k.cast("string"), x["body"]).alias("context"), F.concat(a["used"], F.array(F.struct(x["id"].alias("id"), x["source"].alias("source"), x["score"].alias("score"), k.alias("citation")))).alias("used"), a["skipped"].alias("skipped"))
        left = F.struct(a["n"].alias("n"), a["context"].alias("context"), a["used"].alias("used"), F.concat(a["skipped"], F.array(x["id"])).alias("skipped"))
        return F.when(fits, took).otherwise(left)

    out = own.withColumn("r", F.aggregate("items", start, step))
    return out.select(question, F.col("r.context").alias("context"), F.col("r.used").alias("used"), F.col("r.skipped").alias("skipped"), F.col("r.n").alias("context_tokens"), (F.col("r.n") + asked).alias("input_tokens"), (asked > max_input).alias("over_budget"))


def pack_with_tokenizer(ranked: DataFrame, question: str, passages: dict[str, str], load, max_context: int = 1200, max_input: int = 4096) -> DataFrame:
    """pack_context() with a tokenizer that does not add up: every proposed context is counted whole, and so are its messages.

    load() gives (count, count_messages) in a task: functions of a text and of (question, context) to a number of tokens. A
    blank question, or one that alone exceeds max_input, stops the job: it is never cut. Returns the question column, context,
    used, skipped, context_tokens and input_tokens; ids, sources and scores as strings, strings and doubles.
    """
    if max_context < 1 or max_input < 1:
        raise ValueError("Budgets must be positive")
    c = {k: F.col(v) for k, v in passages.items()}
    item = F.struct(c["rank"].cast("long").alias("rank"), c["id"].cast("string").alias("id"), c["source"].alias("source"), c["score"].cast("double").alias("score"), c["label"].alias("label"), F.coalesce(c["text"], F.lit("")).alias("text"))
    own = ranked.groupBy(question).agg(F.array_sort(F.collect_list(item)).alias("items"))
    used = pa.list_(pa.struct([("id", pa.string()), ("source", pa.string()), ("score", pa.float64()), ("citation", pa.int32())]))

    def one(asked: str, items: list[dict], count, count_messages) -> tuple:
        if not (asked or "").strip() or count_messages(asked, "") > max_input:
            raise ValueError("a question is blank or exceeds the input budget")
        context, took, left = "", [], []
        for x in items:
            more = f"{context}{chr(10) * 2 if context else ''}[{len(took) + 1}] {x['label']} ({x['id']})\n{x['text']}"
            if count(more) > max_context or count_messages(asked, more) > max_input:
                left.append(x["id"])
            else:
                context = more
                took.append({"id": x["id"], "source": x["source"], "score": x["score"], "citation": len(took) + 1})
        return context, took, left, count(context), count_messages(asked, context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = None
        for batch in batches:
            tools = tools or load()
            rows = [one(a, i, *tools) for a, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            context, took, left, n, m = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(context, pa.string()), pa.array(took, used), pa.array(left, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=[question, "context", "used", "skipped", "context_tokens", "input_tokens"])

    return own.mapInArrow(run, f"`{question}` string, context string, used array<struct<id:string,source:string,score:double,citation:int>>, skipped array<string>, context_tokens long, input_tokens long")


def source_label(source) -> Column:
    """The name under which a source is shown."""
    return F.when(F.col(source) == "stackoverflow", "Stack Overflow").otherwise("IBM TechQA")


def citations(retrieved: DataFrame, used: DataFrame, on: list[str], title: str, question: str) -> DataFrame:
    """retrieved with a label, [n] where the record is cited and [retrieved only] where not, and a display title."""
    made = retrieved.join(used.select(*on, "citation"), on, "left")
    shown = F.coalesce(F.nullif(trim_ws(F.col(title)), F.lit("")), F.col(question))
    return made.withColumn("label", F.coalesce(F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("]")), F.lit("[retrieved only]"))).withColumn("shown", squeeze_ws(shown))


def rag_prompt(context: Column, question: Column) -> Column:
    """Messages for a question with its context; without any the context says so."""
    body = F.concat(F.lit("Context:\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit("(none fits)")), F.lit("\n\nQuestion:\n"), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit("Answer from the context and cite it by number.").alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def require_queries(queries: DataFrame, text: str) -> None:
    if not queries.where(is_blank(text)).isEmpty():
        raise ValueError("A query must not be blank")
