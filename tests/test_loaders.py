"""Loaders, gates, sinks, the retrieval artifact, rendering, and retrieval with ids and tokenizers of any kind."""

import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import audit, chat, metrics, retrieve, select, validate
from grainmill.plans import evaluate, models
from grainmill.sources import files, loaders
from grainmill.sources.stages import StageStore


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def row(i, **more):
    return {"id": str(i), "question": f"q{i}", "reference_answer": f"a{i}", "metadata": {}, **more}


def test_benchmark_gates(spark, tmp_path):
    path = lines(tmp_path / "b.jsonl", [row(i) for i in range(3)])
    digest = loaders.digest(spark, path)
    assert {r["split"] for r in loaders.load_general(spark, path, 3, digest).collect()} == {"heldout"}
    with pytest.raises(validate.ValidationError, match="Expected 4 rows"):
        loaders.load_general(spark, path, 4)
    with pytest.raises(validate.ValidationError, match="not the file expected"):
        loaders.load_general(spark, path, 3, "0" * 64)
    with pytest.raises(FileNotFoundError):
        loaders.load_general(spark, str(tmp_path / "none"), 3)
    for bad in (row(0, question=" "), row(1)):
        with pytest.raises(validate.ValidationError):
            loaders.load_general(spark, lines(tmp_path / "bad.jsonl", [bad, row(1)]), 2)


def test_digest_is_that_of_the_bytes(spark, tmp_path):
    import hashlib

    path = lines(tmp_path / "x.jsonl", [row(1)])
    assert loaders.digest(spark, path) == hashlib.sha256((tmp_path / "x.jsonl").read_bytes()).hexdigest()


def test_partly_answerable_gates(spark, tmp_path):
    good = [{"id": "1", "question": "q", "answer": "a", "metadata": {"answerable": True, "original_split": "train"}}, {"id": "2", "question": "q", "answer": None, "metadata": {"answerable": False, "original_split": "dev"}}]
    assert loaders.load_answerable(spark, lines(tmp_path / "g", good), 2).count() == 2
    for bad in ({"answer": None}, {"metadata": {"answerable": True, "original_split": "test"}}, {"metadata": {"answerable": False, "original_split": "dev"}}):
        with pytest.raises(validate.ValidationError):
            loaders.load_answerable(spark, lines(tmp_path / "b", [{**good[0], **bad}, good[1]]), 2)


def test_training_loader_names_the_line(spark, tmp_path):
    turn = lambda p, c: {"prompt": [{"role": "user", "content": p}], "completion": [{"role": "assistant", "content": c}]}
    assert loaders.load_training(spark, lines(tmp_path / "g", [turn("a", "b"), "", turn("c", "d")])).first()["chat_template_kwargs"]["enable_thinking"] is False
    for bad, at in (("{", 3), ({**turn("x", "y"), "extra": 1}, 3)):
        with pytest.raises(validate.ValidationError, match=f"line {at}"):
            loaders.load_training(spark, lines(tmp_path / "b", [turn("a", "b"), "", bad]))
    with pytest.raises(validate.ValidationError, match="empty"):
        loaders.load_training(spark, lines(tmp_path / "e", ["", " "]))
    with pytest.raises(validate.ValidationError):
        loaders.load_training(spark, lines(tmp_path / "r", [turn("a", " ")]))


def test_results_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, answer string")
    folder = str(tmp_path / "run")
    assert loaders.write_results(df, {"n": 1}, folder) == 1 and files.read_json(spark, f"{folder}/metrics") == {"n": 1}
    with pytest.raises(FileExistsError):
        loaders.write_results(df, {}, folder)
    loaders.write_results(df, {"n": 2}, folder, resumes=f"{folder}/checkpoint")
    with pytest.raises(validate.ValidationError):
        loaders.write_results(df, {}, folder, resumes=str(tmp_path / "running/checkpoint"))


def test_artifact_freshness(spark, tmp_path):
    records = spark.createDataFrame([(0, "a", "qa", [1, 2]), (1, "b", "qb", [])], "position long, id string, question string, used array<long>")
    folder, conf = str(tmp_path / "art"), loaders.retrieval_configuration({"corpus_sha256": "c"}, "b", top_k=3)
    loaders.write_artifact(records, conf, folder)
    assert loaders.read_artifact(spark, folder, conf, records).count() == 2
    with pytest.raises(validate.ValidationError, match="stale"):
        loaders.read_artifact(spark, folder, {**conf, "top_k": 4}, records)
    for other in (records.where("position = 0"), records.withColumn("question", F.lit("q")), records.withColumn("position", 1 - F.col("position"))):
        with pytest.raises(validate.ValidationError, match="order"):
            loaders.read_artifact(spark, folder, conf, other)
    with pytest.raises(FileNotFoundError):
        loaders.read_artifact(spark, str(tmp_path / "none"), conf, records)
    with pytest.raises(KeyError):
        loaders.looked_up(spark.createDataFrame([("z",)], "id string"), records)
    with pytest.raises(validate.ValidationError):
        loaders.same_length(a=records, b=records.limit(1))


def test_gates(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    validate.unique_keys(a, F.col("k"), "train")
    with pytest.raises(validate.ValidationError, match="repeats 2"):
        validate.unique_keys(a.unionByName(a), F.col("k"), "train")
    with pytest.raises(validate.ValidationError, match="share 1"):
        validate.no_overlap(a, b, F.col("k"), ("train", "validation"))
    with pytest.raises(validate.ValidationError):
        validate.provenance_gate({"audit": {"passed": True}, "train_sha256": "1", "benchmark_sha256": "2"}, {"train": "1", "benchmark": "2"}, {"train": "/p", "benchmark": "/p"})
    with pytest.raises(ValueError, match="Unknown source"):
        retrieve.of_source(a, "web", loaders.SOURCES)
    with pytest.raises(ValueError):
        retrieve.require_queries(spark.createDataFrame([(" ",)], "q string"), "q")
    with pytest.raises(validate.ValidationError):
        validate.require_count(a, 3)
    bad = spark.createDataFrame([(1, [("user", "hi")]), (2, [("robot", " ")]), (3, [])], "id long, messages array<struct<role:string,content:string>>")
    assert {tuple(r) for r in validate.chat_batch_rules(bad, "id").collect()} == {(2, "role_domain"), (2, "blank_content"), (3, "empty")}


def test_chat(spark):
    df = spark.createDataFrame([(1, [("system", "be kind"), ("user", "hi")], {"url": "u"}, " x "), (2, [], {}, None)], "id long, m array<struct<role:string,content:string>>, metadata map<string,string>, out string")
    got = df.select(chat.render("m", generation=True), chat.optional("metadata", "url"), chat.decoded("out"), chat.message_tokens("m")).collect()
    assert got[0][0] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n" and got[0][1] == "u" and got[0][2] == "x"
    assert got[1][0] == "<|im_start|>assistant\n" and got[1][1] is None and got[1][2] == "" and got[1][3] == 0
    assert [r[0] for r in spark.createDataFrame([("Human",), ("USER",), ("system",), ("bot",), (None,)], "r string").select(chat.role_of("r")).collect()] == ["user", "user", "system", "assistant", "assistant"]
    made = df.withColumn("rendered", chat.render("m"))
    assert validate.template_rules(made, "id", "m", "rendered").isEmpty()
    assert [tuple(r) for r in validate.template_rules(made.withColumn("rendered", F.lit("[INST] hi")), "id", "m", "rendered").orderBy("id", "rule").collect()] == [(1, "content_dropped"), (1, "foreign_template"), (2, "foreign_template")]


def test_top_k_of_any_ids_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(90, 5)), 1)
    x[40:60] = x[0]  # ties
    for name in (lambda i: i, lambda i: f"techqa-{i}"):
        df = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], ["vec_id", "embedding"]).repartition(5)
        got = retrieve.top_k(df.withColumnRenamed("vec_id", "query_id"), df, 4).collect()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(u @ u.T, 12)
        want = {(name(q), name(v), k + 1) for q in range(90) for k, v in enumerate(sorted(range(90), key=lambda v: (-s[q, v], name(v)))[:4])}
        assert {(g["query_id"], g["vec_id"], g["rank"]) for g in got} == want


def test_packing_with_a_tokenizer(spark):
    """Counts that don't add up: a token for each run of three characters of the whole context."""
    rows = [("what?", r, f"id-{r}", "stackoverflow", 1.0 / r, "Stack Overflow", "x" * n) for r, n in enumerate([30, 400, 20], 1)]
    df = spark.createDataFrame(rows, "question string, rank int, id string, source string, score double, label string, text string")
    names = {"rank": "rank", "id": "id", "source": "source", "score": "score", "label": "label", "text": "text"}
    load = lambda: (lambda t: -(-len(t) // 3), lambda q, c: -(-len(q + c) // 3) + 4)
    got = retrieve.pack_with_tokenizer(df, "question", names, load, max_context=60, max_input=70).first()
    assert [u["id"] for u in got["used"]] == ["id-1", "id-3"] and got["skipped"] == ["id-2"] and got["context_tokens"] == -(-len(got["context"]) // 3)
    assert got["context"].startswith("[1] Stack Overflow (id-1)\n") and "\n\n[2] Stack Overflow (id-3)\n" in got["context"]
    with pytest.raises(Exception, match="input budget"):
        retrieve.pack_with_tokenizer(df, "question", names, load, max_input=4).collect()


def test_masked_scores_and_empty_benchmarks(spark):
    df = spark.createDataFrame([("a", "b"), (" ", "b"), (None, "b")], "l string, r string")
    assert [r[0] for r in df.select(metrics.masked_pairs(df, "l", "r", lambda a, b: F.lit(0.5))).collect()] == [0.5, 0.0, 0.0]
    with pytest.raises(ValueError):
        metrics.summary(df.limit(0), F.lit(1.0), F.lit(1), F.lit(False))


def test_rag_prompt(spark):
    got = spark.createDataFrame([("", "q"), ("c", "q")], "c string, q string").select(retrieve.rag_prompt(F.col("c"), F.col("q"))).collect()
    assert "(none fits)" in got[0][0][1]["content"] and got[1][0][1]["content"] == "Context:\nc\n\nQuestion:\nq"


def test_retries_are_stored(spark, tmp_path):
    ex = spark.createDataFrame([(i, f"id{i}", "q", "r") for i in range(5)], "position long, id string, question string, reference string")
    calls = []

    def judge(df):
        calls.append(sorted(r[0] for r in df.select("position").collect()))
        good = F.concat(F.lit('{"score": 2, "reason": "'), F.col("position").cast("string"), F.lit('"}'))
        return df.select("position", (F.when(F.col("position") == 3, F.lit("no JSON")).otherwise(good) if len(calls) == 1 else good).alias("value"))

    answers = models.generator(models.first_words())
    for _ in range(2):
        results, summary = evaluate.evaluate(ex, StageStore(spark, str(tmp_path / "run"), {}), answers, judge)
        assert summary.first()["retries"] == 1 and results.where("judge_retried").first()["position"] == 3
    assert calls == [[0, 1, 2, 3, 4], [3]]  # the second run finds both stages complete


def test_cuts_by_hash_prefix_equal_a_full_ranking(spark):
    import hashlib

    rows = [(i, "abc"[i % 3] if i % 50 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string")
    h = lambda i: (hashlib.sha256(f"5:{i}".encode()).hexdigest(), i)
    groups = {}
    for i, g in rows:
        groups.setdefault(g, []).append(i)
    got = {r["id"] for r in select.stratified_split(df, "g", "id", 100, 5).where("split = 'part'").collect()}
    quota = {r["g"]: r["quota"] for r in select.largest_remainder(df, "g", 100).collect()}
    assert got == {i for g, own in groups.items() for i in sorted(own, key=h)[: quota[g]]} and len(got) == 100
    picked = select.round_robin(df, "g", "id", 50, 5).collect()
    assert len(picked) == 50 and all(r["id"] == sorted(groups[r["g"]], key=h)[r["round"] - 1] for r in picked)


def test_audits(spark):
    d = spark.createDataFrame([(1, "a", "r"), (2, "A ", "r"), (3, " ", None)], "id long, p string, r string")
    got = {r["check"]: r["n"] for r in loaders.post_audit(d, "id", "p", "r", d.where("id = 1")).collect()}
    assert got == {"blank_prompt": 1, "blank_response": 1, "repeated_id": 0, "repeated_prompt": 1, "held_out_prompt": 1}
    assert [r["position"] for r in loaders.audit_sample(d, "id", 2, 1).orderBy("position").collect()] == [0, 1]
    assert loaders.missing(d, d.where("id > 1"), "id").first()["missing"] == [1]
    assert audit.sums_digest(*audit.content_fingerprint(d.limit(0), ["id"]).sparkSession.createDataFrame(d.collect(), d.schema).agg(*audit.content_sums(["id"])).first()) == audit.content_fingerprint(d, ["id"]).first()["digest"]
