"""The registered queries of the library's own operators, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judge, overlap, text, vectors
from ..operators import audit, curate, metrics, retrieve, select, validate
from ..sources import index

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces. The engine's regular expressions know no \v in \s, no look-around and other escapes for code points.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_INLINE = r"[ \t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(x: str) -> str:
    x = f"replace(replace(coalesce({x}, ''), '\\n', chr(10)), chr(13) || chr(10), chr(10))"
    x = f"regexp_replace({_trim(x)}, '{_BREAK}', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '{_INLINE}*\\n{_INLINE}*', chr(10), 'g')"
    return _trim(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _fold(x: str) -> str:
    source, target, many = text._folding()
    one = f"replace(translate({x}, '{source}', '{target}'), 'ß', 'ss')"
    full = functools.reduce(lambda y, m: f"replace({y}, '{m[0]}', '{m[1]}')", [m for m in many if m[0] != "ß"], one)
    return f"case when regexp_matches({x}, '[{''.join(a for a, _ in many if a != 'ß')}]') then {full} else {one} end"


def _key(x: str) -> str:
    return _trim(f"regexp_replace({_fold(_clean(x))}, '{_WS}+', ' ', 'g')")


def _count(x: str) -> str:
    return f"len(regexp_extract_all({_fold(x)}, '{_TOKEN}'))"


_COS = "list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))"
_TOPK = f"""
 with vec as (select vec_id, embedding::double[] e from embeddings), q as (select * from vec where vec_id % 20 = 0)
 select q.vec_id query_id, v.vec_id, {_COS} s, row_number() over (partition by q.vec_id order by round({_COS}, 12) desc, v.vec_id) rk
 from q, vec v WHERE_ qualify rk <= 3"""


# ---- retrieval -------------------------------------------------------------------------------------------------------


def _queries_of(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"select query_id, vec_id, round(s, 4) score, rk \"rank\" from ({_TOPK.replace('WHERE_', '')})")
def retrieve_topk(spark, sf_dir):
    """The three nearest vectors of each vector whose id is divisible by 20, by cosine."""
    e = table(spark, sf_dir, "embeddings")
    return retrieve.top_k(_queries_of(e), e, 3).select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _with_source(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang"), "vec_id")


@query(f"select query_id, vec_id, round(s, 4) score, rk \"rank\" from ({_TOPK.replace('WHERE_', 'join documents d on d.doc_id = v.vec_id where d.lang = ' + chr(39) + 'en' + chr(39))})")
def retrieve_topk_filtered(spark, sf_dir):
    """Top-k among vectors of English documents only; the filter comes before ranking."""
    queries = _queries_of(table(spark, sf_dir, "embeddings"))
    return retrieve.top_k(queries, _with_source(spark, sf_dir), 3, where=F.col("lang") == "en").select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _packed(spark, sf_dir, budget: int = 600):
    e = _with_source(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    hits = retrieve.top_k(_queries_of(table(spark, sf_dir, "embeddings")), e, 3).join(docs, "vec_id")
    hits = hits.withColumn("label", F.upper("source")).withColumn("question", F.concat(F.lit("question "), F.col("query_id").cast("string")))
    names = {"rank": "rank", "id": "vec_id", "source": "source", "score": "score", "label": "label", "text": "text"}
    return hits, retrieve.pack_context(hits, "question", names, max_context=budget)


_HITS = f"""
 hits as (select h.query_id, h.vec_id, h.s, h.rk, d.source, d.text, {_count("'[1] ' || upper(d.source) || ' (' || h.vec_id || ')' || chr(10) || d.text")}::bigint n
 from ({_TOPK.replace('WHERE_', 'join documents d on d.doc_id = v.vec_id')}) h join documents d on d.doc_id = h.vec_id),
 own as (select query_id, list({{'id': vec_id, 'n': n, 'src': source}} order by rk) items from hits group by query_id),
 packed as (select query_id, list_reduce(list_prepend({{'n': 0::bigint, 'used': []::bigint[], 'srcs': []::varchar[], 'skipped': []::bigint[]}},
  list_transform(items, lambda x: {{'n': x.n, 'used': [x.id], 'srcs': [x.src], 'skipped': []::bigint[]}})),
  lambda a, x: case when a.n + x.n <= 600 then {{'n': a.n + x.n, 'used': a.used || x.used, 'srcs': a.srcs || x.srcs, 'skipped': a.skipped}}
   else {{'n': a.n, 'used': a.used, 'srcs': a.srcs, 'skipped': a.skipped || x.used}} end) r from own)"""


@query(f"with {_HITS.strip()} select 'question ' || query_id question, r.n context_tokens, coalesce(array_to_string(r.used, ','), '') used_ids, coalesce(array_to_string(r.skipped, ','), '') skipped_ids from packed")
def context_pack(spark, sf_dir):
    """Retrieved texts packed into a context of 600 tokens."""
    _, packed = _packed(spark, sf_dir)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return packed.select("question", "context_tokens", ids(F.transform("used", lambda u: u["id"])).alias("used_ids"), ids("skipped").alias("skipped_ids"))


@query(f"with {_HITS.strip()} select h.query_id, h.vec_id, coalesce('[' || nullif(list_position(p.r.used, h.vec_id), 0) || ']', '[retrieved only]') label from hits h join packed p using (query_id)")
def retrieve_citations(spark, sf_dir):
    """Each retrieved record with its citation number, or as retrieved only."""
    hits, packed = _packed(spark, sf_dir)
    used = packed.select("question", F.explode("used").alias("u")).select("question", F.col("u.id").alias("vec_id"), "u.citation")
    return retrieve.citations(hits, used, ["question", "vec_id"], "source", "text").select("query_id", "vec_id", "label")


@query(f"with {_HITS.strip()} select count(*) questions, round(avg(len(r.used)), 6) mean_used, round(avg(r.n), 6) mean_context_tokens from packed")
def retrieval_diagnostics(spark, sf_dir):
    return metrics.retrieval_diagnostics(_packed(spark, sf_dir)[1])[0]


@query(f"with {_HITS.strip()} select source, count(*) n from (select unnest(r.srcs) source from packed) group by source")
def used_sources(spark, sf_dir):
    """How often each source was used in a context."""
    return metrics.retrieval_diagnostics(_packed(spark, sf_dir)[1])[1]


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 4) squared, round(list_sum(list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])))), 4) total from embeddings")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("unit", vectors.l2_normalize("embedding"))
    return v.select("vec_id", F.round(vectors.dot("embedding", "embedding"), 4).alias("squared"), F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# ---- text ------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, length({_clean('text')})::bigint n, sha256({_clean('text')}) digest from documents")
def clean_text(spark, sf_dir):
    c = text.clean_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.sha2(c, 256).alias("digest"))


@query(f"select doc_id, sha256({_key('text')}) digest from documents")
def text_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.text_key("text"), 256).alias("digest"))


_PAIRS = "(select conv_id, turn, text a, lead(text) over (partition by conv_id order by turn) b from conversations)"


def _turn_pairs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"])


@query(f"with p as (select conv_id, turn, {_clean('a')} t, {_clean('b')} b, {_key('a')} ka, {_key('b')} kb from {_PAIRS} where b is not null) select conv_id, turn, sha256(case when t <> '' and b <> '' and ka <> kb then t || chr(10) || chr(10) || b when b <> '' then b else t end) digest from p")
def join_question(spark, sf_dir):
    """Each turn joined with the next as title and body."""
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.sha2(text.join_question("a", "b"), 256).alias("digest"))


@query(f"select doc_id, {_count('text')}::bigint tokens from documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count("text").alias("tokens"))


def _rouge(pairs: str) -> str:
    """CTEs that end in rg(conv_id, turn, f1) for the pairs (conv_id, turn, a, b): the table of common subsequences of a against b, a
    row of it for each token of b in turn."""
    return f"""
 tk as (select conv_id, turn, regexp_extract_all({_fold("coalesce(b, '')")}, '{_TOKEN}') p, regexp_extract_all({_fold("coalesce(a, '')")}, '{_TOKEN}') r from {pairs}),
 tr as (select conv_id, turn, unnest(r) t, generate_subscripts(r, 1) j from tk), sz as (select conv_id, turn, p, len(p) m, len(r) n from tk),
 lcs as (select 0 i, conv_id, turn, j, t, 0 v from tr union all
  select i + 1, conv_id, turn, j, t, greatest(v, max(case when t = w then before + 1 else 0 end) over (partition by conv_id, turn order by j)) from
  (select l.*, s.p[l.i + 1] w, coalesce(lag(l.v) over (partition by l.conv_id, l.turn order by l.j), 0) before from lcs l join sz s on s.conv_id = l.conv_id and s.turn = l.turn where l.i < s.m)),
 top as (select l.conv_id, l.turn, max(l.v) v from lcs l join sz s on s.conv_id = l.conv_id and s.turn = l.turn and l.i = s.m group by all),
 rg as (select s.conv_id, s.turn, case when coalesce(v, 0) = 0 then 0 else 2 * (v / m) * (v / n) / (v / m + v / n) end f1 from sz s left join top t on t.conv_id = s.conv_id and t.turn = s.turn)"""


@query(f"with recursive pr as (select * from {_PAIRS} where b is not null), {_rouge('pr')} select conv_id, turn, round(f1, 6) rouge_l_f1 from rg")
def rouge_l(spark, sf_dir):
    """ROUGE-L F1 of each turn against the next."""
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(overlap.rouge_l_f1("b", "a"), 6).alias("rouge_l_f1"))


_VECTORS = "list_transform(range(0, 8), lambda i: {}.embedding[8 * i + 1:8 * i + 8]::double[])"
_BEST = "list_sum(list_transform({0}, lambda s: list_max(list_transform({1}, lambda t: list_dot_product(s, t))))) / 8"


@query(
    f"with v as (select l.vec_id, {_VECTORS.format('l')} x, {_VECTORS.format('r')} y from embeddings l join embeddings r on r.vec_id = l.vec_id + 1), "
    f"b as (select vec_id, {_BEST.format('x', 'y')} p, {_BEST.format('y', 'x')} r from v) select vec_id, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) f1 from b"
)
def greedy_match(spark, sf_dir):
    """Greedy matching F1 of each vector with the next, cut whole into eight token vectors of eight numbers."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("x"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return both.select("vec_id", F.round(overlap.greedy_match_f1("x", "y"), 6).alias("f1"))


_ANSWERS = [
    (1, "I don't know."), (2, "I don’t know, sorry"), (3, "There is insufficient context here"), (4, "No relevant information was provided."), (5, "Restart the router"),
    (6, "  "), (7, "We are unable to determine the cause"), (8, "I do not have enough information"), (9, "knowing is half"), (10, "no information provided"),
]


@query(
    "with f(id, answer) as (values " + ", ".join(f"({i}, '{a.replace(chr(39), chr(39) * 2)}')" for i, a in _ANSWERS) + "), n as (select id, " + _trim(f"regexp_replace(replace({_fold('answer')}, '’', ''''), '{_WS}+', ' ', 'g')") + " x from f) "
    "select id::bigint id, x = '' or " + " or ".join("regexp_matches(x, '" + p.replace("'", "''") + "')" for p in text.ABSTENTIONS) + " abstained from n"
)
def abstention(spark, sf_dir):
    df = spark.createDataFrame(_ANSWERS, "id long, answer string")
    return df.select("id", text.is_abstention("answer").alias("abstained"))


# A judge's outputs made of the turns: clean, inside other words, a score as text, out of range, cut off, or none.
_SHORT = "left(regexp_replace(text, '[^a-z]', '', 'g'), 12)"
_SAID = (
    f"(select *, case turn % 6 when 0 then '{{\"score\": ' || length(text) % 5 || ', \"reason\": \"' || {_SHORT} || '\"}}' when 1 then 'Here: {{\"a\": 1}} {{\"score\": ' || length(text) % 5 || ', \"reason\": \" ' || {_SHORT} || ' \"}} done' "
    f"when 2 then '{{\"score\": \"3\", \"reason\": \"' || {_SHORT} || '\"}}' when 3 then '{{\"score\": ' || length(text) % 9 || ', \"reason\": \"' || {_SHORT} || '\"}}' when 4 then '{{\"score\": ' || length(text) % 3 || ', \"reason\": \"' || {_SHORT} else 'none' end said from conversations)"
)


def _said(spark, sf_dir) -> DataFrame:
    short = F.left(F.regexp_replace("text", "[^a-z]", ""), F.lit(12))
    n = lambda k: (F.length("text") % k).cast("string")
    kinds = [
        ('{"score": %s, "reason": "%s"}', n(5)),
        ('Here: {"a": 1} {"score": %s, "reason": " %s "} done', n(5)),
        ('{"score": "%s", "reason": "%s"}', F.lit("3")),
        ('{"score": %s, "reason": "%s"}', n(9)),
        ('{"score": %s, "reason": "%s', n(3)),
    ]
    said = functools.reduce(lambda rest, k: F.when(F.col("turn") % 6 == k[0], F.format_string(k[1][0], k[1][1], short)).otherwise(rest), list(enumerate(kinds)), F.lit("none"))
    return table(spark, sf_dir, "conversations").withColumn("said", said)


def _judged(x: str) -> str:
    """Score and reason as a struct, of the first candidate that is an object with both."""
    ok = "json_type(c::json) = 'OBJECT' and json_type(c::json, '$.score') in ('UBIGINT', 'BIGINT') and (c::json ->> '$.score')::int between 0 and 4 and json_type(c::json, '$.reason') = 'VARCHAR'"
    reason = _trim("(c::json ->> '$.reason')")
    return f"list_transform(list_filter([{x}] || regexp_extract_all({x}, '\\{{.*?\\}}', 0, 's'), lambda c: case when json_valid(c) then coalesce({ok}, false) else false end), lambda c: {{'score': (c::json ->> '$.score')::int, 'reason': {reason}}})[1]"


_PART = r"""regexp_extract({0}, '^\s*\{{\s*"score"\s*:\s*([0-4])\s*,\s*"reason"\s*:\s*"', 1)"""


@query(f"select conv_id, turn, coalesce(d.score, -1) score, coalesce(d.reason, '') reason, d is not null read from (select conv_id, turn, {_judged('said')} d from {_SAID})")
def judge_parse(spark, sf_dir):
    """Decisions read from outputs of every kind."""
    df = _said(spark, sf_dir).withColumn("d", judge.parse_judge("said"))
    return df.select("conv_id", "turn", F.coalesce("d.score", F.lit(-1)).alias("score"), F.coalesce("d.reason", F.lit("")).alias("reason"), F.col("d").isNotNull().alias("read"))


@query(
    f"with s as {_SAID}, p as (select l.conv_id, l.turn, l.said x, r.said y from s l join s r on r.conv_id = l.conv_id), j as (select *, {_judged('x')} a, {_judged('y')} b, nullif({_PART.format('x')}, '') pa, nullif({_PART.format('y')}, '') pb from p), "
    "o as (select conv_id, turn, coalesce(a.score, b.score, case when pa = pb then pa::int end) score, case when a is not null or b is not null then false when pa = pb then true end recovered, case when a is not null then false when b is not null or pa = pb then true end retried from j) "
    "select conv_id, turn, coalesce(score, -1) score, coalesce(recovered, false) recovered, coalesce(retried, true) retried, count(*) n from o group by all"
)
def judge_recover(spark, sf_dir):
    """Every output with every other of its conversation as its retry."""
    s = _said(spark, sf_dir).select("conv_id", "turn", "said")
    d = s.join(s.select("conv_id", F.col("said").alias("retry")), "conv_id").withColumn("d", judge.judge_or_recover("said", "retry"))
    return d.groupBy("conv_id", "turn", F.coalesce("d.score", F.lit(-1)).alias("score"), F.coalesce("d.recovered", F.lit(False)).alias("recovered"), F.coalesce("d.retried", F.lit(True)).alias("retried")).agg(F.count("*").alias("n"))


# ---- deduplication, caps, selection, splits --------------------------------------------------------------------------


@query(f"select min(doc_id) doc_id from documents group by {_key('text')}")
def dedup_prompt(spark, sf_dir):
    return select.first_per_key(table(spark, sf_dir, "documents"), [text.key_digest("text")], "doc_id").select("doc_id")


@query(f"with c as (select conv_id, string_agg({_key('text')}, chr(31) order by turn) k from conversations group by conv_id) select min(conv_id) conv_id from c group by k")
def dedup_conversation(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.text_key("text").alias("k")))).alias("t"))
    return select.first_per_key(turns, [F.transform("t", lambda t: t["k"])], "conv_id").select("conv_id")


@query(f"select doc_id from documents qualify row_number() over (partition by {_key('text')} order by doc_id) <= 2")
def response_cap(spark, sf_dir):
    """At most two documents for each text."""
    return select.cap_per_key(table(spark, sf_dir, "documents").select("doc_id", "text"), [text.key_digest("text")], 2, [F.col("doc_id")]).select("doc_id")


@query("select doc_id, lang from documents qualify row_number() over (partition by lang order by doc_id) <= 8")
def language_cap(spark, sf_dir):
    """At most eight documents for each language."""
    return select.cap_per_key(table(spark, sf_dir, "documents"), [F.col("lang")], 8, [F.col("doc_id")]).select("doc_id", "lang")


@query("select doc_id, lang, n \"round\" from (select doc_id, lang, row_number() over (partition by lang order by sha256('42:' || doc_id), doc_id) n from documents) order by n, lang limit 300")
def round_robin_select(spark, sf_dir):
    """300 documents dealt over the languages in turn."""
    return select.round_robin(table(spark, sf_dir, "documents"), "lang", "doc_id", 300, 42).select("doc_id", "lang", F.col("round").cast("long").alias("round"))


@query(
    "with s as (select lang, count(*) total, sum(count(*)) over () n from documents group by lang), q as (select lang, total, floor(total * 90 / n) f, round(total * 90 / n - floor(total * 90 / n), 9) r from s), "
    "w as (select lang, f + (row_number() over (order by r desc, lang) <= 90 - sum(f) over ())::int quota from q), d as (select doc_id, lang, row_number() over (partition by lang order by sha256('7:' || doc_id), doc_id) k from documents) "
    "select doc_id, d.lang, case when k <= quota then 'benchmark' else 'validation' end split from d join w using (lang)"
)
def stratified_split(spark, sf_dir):
    return select.stratified_split(table(spark, sf_dir, "documents"), "lang", "doc_id", 90, 7, ("validation", "benchmark")).select("doc_id", "lang", "split")


@query("select doc_id, case when row_number() over (order by sha256('42:' || doc_id), doc_id) <= floor(0.1 * count(*) over ()) then 'validation' else 'train' end split from documents")
def seeded_split(spark, sf_dir):
    return select.seeded_split(table(spark, sf_dir, "documents"), "doc_id", 0.1, 42).select("doc_id", "split")


@query("select floor(event_id / 64)::bigint batch, count(*) n, min(event_id) lo from events group by 1")
def batching(spark, sf_dir):
    return select.batched(table(spark, sf_dir, "events"), "event_id", 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"))


# ---- curation --------------------------------------------------------------------------------------------------------


def _topic_sql(x: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({x}, '{w}')" for w in words) + f" then '{t}'" for t, words in curate.TOPICS.items()) + " else 'other' end"


@query(f"select {_topic_sql('x')} topic, lang, count(*) n from (select {_fold('text')} x, lang from documents) group by 1, 2")
def topic_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(curate.topic("text").alias("topic"), "lang").agg(F.count("*").alias("n"))


_WORDS = f"case when {_trim('text')} = '' then 0 else len(string_split({_trim('regexp_replace(text, ' + chr(39) + _WS + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ')) end"


@query(f"select case when text is null or {_trim('text')} = '' then 'empty' when {_WORDS} < 20 then 'too_short' when toxic = 1 then 'toxic' when length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{P}}\\s]', '', 'g')) > 0.02 * length(text) then 'noise' when quality = 0 then 'low_quality' else 'kept' end reason, count(*) n from documents left join labels using (doc_id) group by 1")
def removal_funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    noise = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\p{P}\s]", "")) > 0.02 * F.length("text")
    rules = [("empty", text.is_blank("text")), ("too_short", text.word_count("text") < 20), ("toxic", F.col("toxic") == 1), ("noise", noise), ("low_quality", F.col("quality") == 0)]
    return audit.funnel(docs, rules)


_REWRITES = [("number", r"[0-9]+", "#"), ("bar", r" \| ", " "), ("article", r"\bthe\b", "a")]


@query("with a as (select doc_id, text t0, regexp_replace(text, '[0-9]+', '#', 'g') t1 from documents), b as (select *, regexp_replace(t1, ' \\| ', ' ', 'g') t2 from a), f as (select unnest(list_filter([case when regexp_matches(t0, '[0-9]+') then 'number' end, case when regexp_matches(t1, ' \\| ') then 'bar' end, case when regexp_matches(t2, '\\bthe\\b') then 'article' end], lambda x: x is not null)) flag from b) select flag, count(*) n from f group by flag")
def rewrite_flags(spark, sf_dir):
    return curate.rewrite(table(spark, sf_dir, "documents"), "text", _REWRITES).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


_ALIASES = ("Èenai", "The th")


def _curated() -> str:
    """CTEs that end in cu(id, a, b): the pairs that the curation keeps, without the cap on identity."""
    has = lambda x, words: "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"
    squeezed = lambda x: _trim(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")
    return f"""
 pr as (select conv_id * 10000 + turn id, a, b, {_trim('b')} tb, {_fold('b')} fb from {_PAIRS} where b is not null),
 ok as (select id, a, b, {_key('a')} ka, {_key('b')} kb from pr where not (tb = '' or regexp_matches(tb, '^[a-z]+(?:_[a-z]+)+$') or len(string_split({squeezed('b')}, ' ')) < 3 or {has('fb', curate.REFUSALS)} or {has('b', _ALIASES)}
  or {has('fb', curate.BYPASS)} or {has('fb', curate.ARTIFACTS)} or {squeezed('fb')} in {curate.GENERIC} or length(regexp_replace(b, '[\\p{{L}}\\p{{N}}\\p{{P}}\\s]', '', 'g')) > 0.2 * length(b))),
 e1 as (select * from ok qualify row_number() over (partition by ka, kb order by id) = 1), e2 as (select * from e1 qualify row_number() over (partition by ka order by id) = 1),
 cu as (select id, a, b from e2 qualify row_number() over (partition by kb order by id) <= 1)"""


@query(f"with {_curated().strip()} select id, {_topic_sql('f')} topic from (select id, {_fold('a')} f from cu)")
def curate_records(spark, sf_dir):
    """Adjacent turns as prompt and response, through rules, deduplication and caps."""
    pairs = _turn_pairs(spark, sf_dir).withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    return curate.curate(pairs, "id", "a", "b", response_cap=1, aliases=_ALIASES).select("id", curate.topic("a").alias("topic"))


@query(f"with {_curated().strip()}, i as (select id, contains(b, 'é') own from cu) select id, own from i qualify not own or row_number() over (partition by own order by id) <= 8")
def identity_cap(spark, sf_dir):
    """The same with at most eight records in all that bear a mark of identity."""
    pairs = _turn_pairs(spark, sf_dir).withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    own = F.contains(F.col("b"), F.lit("é"))
    return curate.curate(pairs, "id", "a", "b", response_cap=1, identity=own, identity_cap=8, aliases=_ALIASES).select("id", own.alias("own"))


@query("select doc_id from documents join labels using (doc_id) where quality >= 1 and toxic >= 0")
def score_filter(spark, sf_dir):
    return curate.score_filter(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), 1, 0, "quality", "toxic").select("doc_id")


# ---- validation ------------------------------------------------------------------------------------------------------


@query(
    "with t as (select *, lag(role) over (partition by conv_id order by turn) p from conversations), g as (select conv_id, bool_or(role not in ('system','user','assistant')) r1, bool_or(role = 'system' and p is not null) r2, "
    "bool_or(role <> 'system' and case when p is null or p = 'system' then role <> 'user' else role = p end) r3, bool_or(trim(text) = '') r4, arg_max(role, turn) <> 'assistant' r5, count(distinct turn) <> max(turn) - min(turn) + 1 or count(*) <> count(distinct turn) r6 from t group by conv_id) "
    "select conv_id, unnest(list_filter([case when r1 then 'role_domain' end, case when r2 then 'system_not_first' end, case when r3 then 'roles_do_not_alternate' end, case when r4 then 'blank_content' end, case when r5 then 'no_final_assistant' end, case when r6 then 'turn_gap' end], lambda x: x is not null)) rule from g"
)
def validate_conversations(spark, sf_dir):
    return validate.conversation_rules(table(spark, sf_dir, "conversations"))


@query("select doc_id::varchar id, unnest(list_filter([case when trim(text) = '' then 'blank_question' end, case when quality is null then 'blank_answer' end], lambda x: x is not null)) rule from documents left join labels using (doc_id)")
def validate_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return validate.question_rules(d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("quality").cast("string").alias("answer")))


@query(f"select count(*) n, max({_count('text')})::bigint longest, count(*) filter ({_count('text')} > 1024) \"over\" from documents")
def over_length(spark, sf_dir):
    return validate.over_length(table(spark, sf_dir, "documents"), text.token_count("text"), 1024)


# ---- audits and profiles ---------------------------------------------------------------------------------------------


_SPLIT = "(select *, row_number() over (order by sha256('42:' || doc_id), doc_id) <= floor(0.1 * count(*) over ()) held from documents)"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = select.seeded_split(table(spark, sf_dir, "documents"), "doc_id", 0.1, 42)
    return d.where("split = 'train'").drop("split"), d.where("split = 'validation'").drop("split")


@query(f"select sha256(k) key from (select {_key('text')} k from {_SPLIT} where not held intersect select {_key('text')} from {_SPLIT} where held)")
def prompt_overlap(spark, sf_dir):
    """Texts that both sides of a seeded split hold."""
    train, held = _halves(spark, sf_dir)
    return audit.shared_keys(train, held, text.key_digest("text"))


@query(f"with k as (select distinct {_key('text')} k, source from documents), s as (select distinct source from documents) select a.source a, b.source b, count(x.k) shared from s a join s b on a.source < b.source left join (select l.k, l.source ls, r.source rs from k l join k r on l.k = r.k and l.source < r.source) x on x.ls = a.source and x.rs = b.source group by 1, 2")
def split_leakage(spark, sf_dir):
    """Texts shared by each pair of sources."""
    return audit.pairwise_overlap(table(spark, sf_dir, "documents"), "source", text.key_digest("text"))


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def benchmark_contained(spark, sf_dir):
    """Documents that hold a benchmark text to the letter."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    return audit.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), items)


@query(f"select doc_id from {_SPLIT} where not held and {_key('text')} in (select {_key('text')} from {_SPLIT} where held)")
def benchmark_overlap(spark, sf_dir):
    """Documents to train on whose text is that of a held-out one."""
    return audit.exact_overlap(*_halves(spark, sf_dir)).select("doc_id")


@query("with l as (select doc_id from documents except select doc_id from labels), r as (select doc_id from labels except select doc_id from documents) select (select count(*) from l) only_left, (select count(*) from r) only_right, (select count(*) from l) = 0 and (select count(*) from r) = 0 equal")
def id_set_equality(spark, sf_dir):
    return audit.id_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"select lang, measure, count(v) n, min(v) min, median(v) median, round(avg(v), 6) mean, quantile_disc(v, 0.95) p95, max(v) max from (select lang, 'chars' measure, length(text)::bigint v from documents union all select lang, 'tokens', {_count('text')}::bigint from documents) group by lang, measure")
def length_profile(spark, sf_dir):
    return audit.length_profile(table(spark, sf_dir, "documents"), ["lang"], {"chars": F.length("text"), "tokens": text.token_count("text")})


@query(f"select sha256(k) \"value\", n from (select {_key('text')} k, count(*) n from documents group by 1 order by n desc, k limit 15)")
def top_values(spark, sf_dir):
    top = audit.top_values(table(spark, sf_dir, "documents"), text.text_key("text"), 15)
    return top.select(F.sha2("value", 256).alias("value"), "n")


@query("select term, count(*) filter (k > 0) rows_with, sum(k)::bigint occurrences from (select 'token' term, len(regexp_extract_all(text, 'token'))::bigint k from documents union all select 'bar', len(regexp_extract_all(text, ' \\| ')) from documents union all select 'digits', len(regexp_extract_all(text, '[0-9]+')) from documents) group by term")
def term_occurrences(spark, sf_dir):
    return audit.term_occurrences(table(spark, sf_dir, "documents"), "text", {"token": "token", "bar": r" \| ", "digits": "[0-9]+"})


@query("select roles, count(*) n from (select string_agg(role, '/' order by turn) roles from conversations group by conv_id) group by roles")
def role_sequences(spark, sf_dir):
    return audit.role_sequences(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("select quality, toxic, count(*) n from labels group by 1, 2")
def label_frequency(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


_NORMAL = _trim(f"regexp_replace(replace(f, '’', ''''), '{_WS}+', ' ', 'g')")
_ABSTAINS = "(x = '' or " + " or ".join("regexp_matches(x, '" + p.replace("'", "''") + "')" for p in text.ABSTENTIONS) + ")"


@query(
    f"with recursive pr as (select p.*, s.role, s.said from {_PAIRS} p join {_SAID} s using (conv_id, turn) where b is not null), {_rouge('pr')}, "
    f"x as (select conv_id, turn, {_NORMAL} x from (select conv_id, turn, {_fold('b')} f from pr)), j as (select pr.conv_id, pr.turn, role, {_judged('said')} d, {_ABSTAINS} abstained from pr join x on x.conv_id = pr.conv_id and x.turn = pr.turn) "
    "select role, count(*) n, round(avg(f1), 6) mean_rouge_l, round(avg(d.score), 6) mean_judge, round(avg(d.score) / 4 * 100, 6) judge_percent, round(avg(abstained::int) * 100, 6) abstention_percent, count(*) filter (d is null) retries, 0::bigint recovered from j join rg using (conv_id, turn) group by role"
)
def metrics_summary(spark, sf_dir):
    """Each turn's answer, the next turn, scored by ROUGE-L, abstention and a judge's output, by role."""
    pairs = _turn_pairs(spark, sf_dir).join(_said(spark, sf_dir).select("conv_id", "turn", "role", "said"), ["conv_id", "turn"])
    d = metrics.score_answers(pairs, "b", "a").withColumn("d", judge.parse_judge("said"))
    return metrics.summary(d, F.col("rouge_l_f1"), F.col("d.score"), F.col("abstained"), retried=F.col("d").isNull(), by=["role"])


@query("select conv_id, count(*) saved, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) contiguous from conversations group by conv_id")
def checkpoint_prefix(spark, sf_dir):
    return audit.contiguous_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def incremental_index(spark, sf_dir):
    """Documents that the vector table lacks."""
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return index.unindexed(table(spark, sf_dir, "documents"), have, "doc_id").select("doc_id")


@query("select event_type, count(*) n, sum(json_extract(props, '$.k')::bigint)::bigint k, count(*) filter (json_extract(props, '$.none') is not null) missing from events group by event_type")
def json_roundtrip(spark, sf_dir):
    """props decoded, encoded and decoded again."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long, none long"))
    e = e.withColumn("again", F.from_json(F.to_json("p"), "k long, none long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("again.k").alias("k"), F.count_if(F.col("again.none").isNotNull()).alias("missing"))


@query("select count(*) \"rows\", sha256(string_agg(h, '' order by item_id)) digest from (select item_id, sha256(item_id || chr(31) || text) h from benchmark)")
def file_fingerprint(spark, sf_dir):
    """A digest of the benchmark's rows in order of id."""
    b = table(spark, sf_dir, "benchmark")
    return b.agg(F.count("*").alias("rows"), audit.table_fingerprint(b, ["item_id", "text"]).alias("digest"))


@query("select lang, source, count(*) n, grouping(lang)::bigint g_lang, grouping(source)::bigint g_source from documents group by grouping sets ((lang, source), (lang), ())")
def topic_distribution(spark, sf_dir):
    """Counts by language and source with their sums."""
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count("*").alias("n"), F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"))


@query("select d.doc_id position, d.text <> '' answered, l.quality, l.toxic from documents d join labels l using (doc_id)")
def positional_join(spark, sf_dir):
    """Stage results joined by their explicit position."""
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), (F.col("text") != "").alias("answered"))
    return answers.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "position"), "position").select("position", "answered", "quality", "toxic")


from . import checks  # noqa: E402, F401  (registers its queries here)
