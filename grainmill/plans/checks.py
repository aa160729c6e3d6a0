"""Registered queries of loaders, gates, sinks, rendering and audits, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import audit, chat, retrieve
from ..sources import files, loaders
from .queries import _HITS, _PAIRS, _TOPK, _clean, _count, _halves, _key, _packed, _queries_of, _trim, _turn_pairs, query, table

_MESSAGES = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query("select item_id::varchar id, 'heldout' split, true answerable, sha256(text) question, sha256(text) answer from benchmark")
def load_benchmark(spark, sf_dir):
    """The benchmark as JSON lines, loaded with its count and digest checked."""
    rows, path = table(spark, sf_dir, "benchmark"), loaders.own_folder(spark, "benchmark")
    files.write_jsonl(rows.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("text").alias("reference_answer"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata")), path)
    found = loaders.load_general(spark, path, rows.count(), loaders.digest(spark, path))
    return found.select("id", "split", "answerable", F.sha2("question", 256).alias("question"), F.sha2("answer", 256).alias("answer"))


@query("select item_id::varchar id, case when item_id % 2 = 0 then 'train' else 'dev' end split, item_id % 3 <> 0 answerable, case when item_id % 3 <> 0 then sha256(text) else '' end answer from benchmark")
def load_partly_answerable(spark, sf_dir):
    """The same where each third question has no answer."""
    rows, path = table(spark, sf_dir, "benchmark"), loaders.own_folder(spark, "benchmark")
    can = F.col("item_id") % 3 != 0
    made = rows.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(can, F.col("text")).alias("answer"), F.struct(can.alias("answerable"), F.when(F.col("item_id") % 2 == 0, "train").otherwise("dev").alias("original_split")).alias("metadata"))
    files.write_jsonl(made, path)
    found = loaders.load_answerable(spark, path, rows.count(), loaders.digest(spark, path))
    return found.select("id", "split", "answerable", F.coalesce(F.sha2("answer", 256), F.lit("")).alias("answer"))


@query(f"select sha256(a) prompt, sha256(b) completion, false thinking, {_count("'<|im_start|>user' || chr(10) || a || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || b || '<|im_end|>' || chr(10)")}::bigint tokens from {_PAIRS} where b is not null")
def load_training(spark, sf_dir):
    """Adjacent turns as training rows in JSON lines, loaded with keys and turns checked, and their rendered lengths."""
    message = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    path = loaders.own_folder(spark, "training")
    files.write_jsonl(_turn_pairs(spark, sf_dir).select(message("user", "a").alias("prompt"), message("assistant", "b").alias("completion")), path)
    rows = loaders.load_training(spark, path)
    return rows.select(F.sha2(F.col("prompt")[0]["content"], 256).alias("prompt"), F.sha2(F.col("completion")[0]["content"], 256).alias("completion"), F.col("chat_template_kwargs.enable_thinking").alias("thinking"), chat.message_tokens(F.concat("prompt", "completion")).alias("tokens"))


@query(f"with {_HITS.strip()} select row_number() over (order by query_id) - 1 \"position\", query_id::varchar id, 'question ' || query_id question, r.n context_tokens from packed")
def retrieval_artifact(spark, sf_dir):
    """Packed contexts written as an artifact, and read back as one that is fresh."""
    from pyspark.sql import Window

    _, packed = _packed(spark, sf_dir)
    q = F.split("question", " ")[1]
    records = packed.select((F.row_number().over(Window.orderBy(q.cast("long"))) - 1).cast("long").alias("position"), q.alias("id"), "question", "context_tokens")
    folder, settings = loaders.own_folder(spark, "artifact"), loaders.retrieval_configuration({"corpus_sha256": "c"}, "b", top_k=3, max_context_tokens=600)
    loaders.write_artifact(records, settings, folder)
    have = spark.read.parquet(f"{folder}/records")
    return loaders.read_artifact(spark, folder, settings, have.select("position", "id", "question"))


@query("select doc_id, lang, n_chars from documents")
def results_sink(spark, sf_dir):
    """Results written where nothing was, and read back."""
    folder = loaders.own_folder(spark, "results")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    loaders.write_results(rows, {"rows": rows.count()}, folder)
    return files.read_jsonl(spark, f"{folder}/predictions", "doc_id long, lang string, n_chars long")


@query(f"select conv_id, sha256(r) digest, {_count('r')}::bigint tokens from (select conv_id, string_agg({_MESSAGES}, '' order by turn) r from conversations group by conv_id)")
def chat_render(spark, sf_dir):
    """Conversations as one text each, and its length in tokens. A conversation is one row here, as a model reads it."""
    turns = F.array_sort(F.collect_list(F.struct("turn", chat.role_of("role").alias("role"), F.col("text").alias("content"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("m"))
    return rows.select("conv_id", F.sha2(chat.render("m"), 256).alias("digest"), chat.message_tokens("m").alias("tokens"))


@query(f"select doc_id, case when lang = 'en' then 'Stack Overflow' else 'IBM TechQA' end label, sha256(case when lang = 'de' then lang else {_trim("regexp_replace(left(text, 60), '[\\s]+', ' ', 'g')")} end) shown, case when doc_id % 2 = 0 then source else '' end url, 'false' thinking, regexp_extract(source || '.' || lang, '[^.]*$') suffix from documents")
def display_fields(spark, sf_dir):
    """Labels, titles with their fallback, optional fields, constants and suffixes, as the answer page shows them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "stackoverflow").otherwise("techqa").alias("source"), F.when(F.col("lang") == "de", F.col("lang")).otherwise(" ").alias("title"), F.left("text", F.lit(60)).alias("question"), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("url"), F.col("source"))).alias("metadata"), F.concat_ws(".", "source", "lang").alias("name"))
    shown = retrieve.citations(d, d.select("doc_id", F.lit(1).alias("citation")), ["doc_id"], "title", "question").withColumn("c", chat.constant_struct(enable_thinking=False))
    return shown.select("doc_id", retrieve.source_label("source").alias("label"), F.sha2("shown", 256).alias("shown"), F.coalesce(chat.optional("metadata", "url"), F.lit("")).alias("url"), F.col("c.enable_thinking").cast("string").alias("thinking"), chat.suffix("name").alias("suffix"))


@query("select row_number() over (order by sha256('11:' || doc_id), doc_id) - 1 \"position\", doc_id from documents qualify row_number() over (order by sha256('11:' || doc_id), doc_id) <= 100")
def audit_sample(spark, sf_dir):
    """A hundred documents in seeded order."""
    return loaders.audit_sample(table(spark, sf_dir, "documents"), "doc_id", 100, 11).select(F.col("position").cast("long").alias("position"), "doc_id")


_HELD = "(select *, row_number() over (order by sha256('42:' || doc_id), doc_id) <= floor(0.1 * count(*) over ()) held from documents)"


@query(
    f"with d as (select *, {_key('text')} k from {_HELD}), t as (select * from d where not held), c as (select count(*) c from t group by k) select 'blank_prompt' \"check\", count(*) filter ({_trim('text')} = '') n from t union all select 'blank_response', count(*) filter (trim(lang) = '') from t "
    "union all select 'repeated_id', count(*) - count(distinct doc_id) from t union all select 'repeated_prompt', count(*) filter (c > 1) from c union all select 'held_out_prompt', (select count(distinct k) from t where k in (select k from d where held))"
)
def post_audit(spark, sf_dir):
    """What is wrong with documents taken as they are for training: copies, and copies of held-out ones."""
    train, held = _halves(spark, sf_dir)
    return loaders.post_audit(train, "doc_id", "text", "lang", held)


@query("select list_sort(list(doc_id)) missing from (select doc_id from labels where doc_id not in (select vec_id from embeddings))")
def missing_ids(spark, sf_dir):
    """Labelled documents that have no vector, sorted, in one row."""
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return loaders.missing(table(spark, sf_dir, "labels"), have, "doc_id")


@query("select doc_id, case when length(text) <= 320 then text else left(text, 160) || ' ... ' || right(text, 160) end preview from documents order by doc_id limit 3")
def previews(spark, sf_dir):
    """The first three documents, long ones as their two ends."""
    d = table(spark, sf_dir, "documents").withColumn("preview", text.preview("text"))
    return loaders.previews(d, "doc_id", ["doc_id", "preview"])


_SPLITS = "case conv_id % 3 when 0 then 'train' when 1 then 'validation' else 'benchmark' end"


@query(
    f"with c as (select conv_id, {_SPLITS} s, string_agg({_key('text')}, chr(31) order by turn) conversation, arg_min({_key('text')}, turn) prompt from conversations group by conv_id), l as (select 'conversation' kind, s, conversation k from c union select 'prompt', s, prompt from c), "
    "p as (select * from (values ('benchmark', 'train'), ('benchmark', 'validation'), ('train', 'validation')) v(a, b), (values ('conversation'), ('prompt')) w(kind)) select p.kind, p.a, p.b, count(y.k) shared from p left join l x on x.kind = p.kind and x.s = p.a left join l y on y.kind = p.kind and y.s = p.b and y.k = x.k group by all"
)
def split_overlaps(spark, sf_dir):
    """Shared prompts and shared conversations of three splits, pair by pair."""
    turns = F.array_sort(F.collect_list(F.struct("turn", text.text_key("text").alias("k"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    c = c.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("benchmark")), (F.col("conv_id") % 3 + 1).cast("int")))
    kinds = {"conversation": F.array_join(F.transform("t", lambda t: t["k"]), "\x1f"), "prompt": F.col("t")[0]["k"]}
    found = [audit.pairwise_overlap(c, "split", key).select(F.lit(kind).alias("kind"), "a", "b", "shared") for kind, key in kinds.items()]
    return found[0].unionByName(found[1])


@query(f"select query_id, vec_id, round(1 - 2 * (1 - s) / sqrt(2), 4) score from ({_TOPK.replace('WHERE_', '')})")
def relevance_scores(spark, sf_dir):
    """Top-k with scores on the scale of squared distances."""
    e = table(spark, sf_dir, "embeddings")
    return retrieve.top_k(_queries_of(e), e, 3).select("query_id", "vec_id", F.round(vectors.relevance("score"), 4).alias("score"))


@query(f"select doc_id, length({_clean('text')})::bigint n from documents where lang = 'en' order by doc_id")
def string_ids(spark, sf_dir):
    """Nearest document of itself under string ids: an id finds its own row, whatever its kind."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    # Two circles: on the first alone, ids that are 2,136,283 apart score 1 to 12 digits.
    on = lambda a: [F.cos(a), F.sin(a)]
    e = d.select(F.concat(F.lit("techqa-"), F.col("doc_id").cast("string")).alias("id"), F.array(*on(F.col("doc_id") / 1e4), *on(F.col("doc_id"))).alias("embedding"))
    own = retrieve.top_k(e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "vec_id"), 1)
    found = own.where(F.col("query_id") == F.col("vec_id")).select(F.substring_index("vec_id", "-", -1).cast("long").alias("doc_id"))
    # The length before the join, so that no text is shuffled.
    return d.select("doc_id", F.length(text.clean_text("text")).cast("long").alias("n")).join(found, "doc_id")
