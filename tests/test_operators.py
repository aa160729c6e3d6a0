"""Operators on small fixtures, recorded distributions and the shared tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from grainmill.functions import text
from grainmill.operators import audit, curate, metrics, retrieve, select, validate
from grainmill.plans import evaluate, models, queries
from grainmill.sources import files, loaders
from grainmill.sources.index import VectorTable
from grainmill.sources.stages import StageStore
from grainmill.streaming.index_stream import corpus_stream, index_stream

SF = "/root/testdata/sf0.01"
# Recorded sizes: topic totals of 3,000 rows and the 1,000 of them that went to the benchmark.
VALIDATION = [159, 90, 61, 162, 111, 185, 12, 181, 86, 156, 65, 121, 162, 154, 135, 160]
BENCHMARK = [80, 45, 31, 81, 56, 92, 6, 90, 43, 78, 33, 60, 81, 77, 67, 80]
NAMES = "cloud_servers databases developer_tools email_outlook enterprise_apps hardware_drivers linux network_vpn office other_it performance recovery_storage security_identity software teams windows".split()


def test_largest_remainder_recorded(spark):
    totals = [(n, i) for n, a, b in zip(NAMES, VALIDATION, BENCHMARK) for i in range(a + b)]
    df = spark.createDataFrame(totals, "topic string, i long")
    got = {r["topic"]: r["quota"] for r in select.largest_remainder(df, "topic", 1000).collect()}
    assert got == dict(zip(NAMES, BENCHMARK))


def test_round_robin_water_fills(spark):
    sizes = {"a": 3, "b": 50, "c": 20, "d": 7}
    df = spark.createDataFrame([(g, f"{g}{i}") for g, n in sizes.items() for i in range(n)], "g string, id string")
    for n in (1, 10, 31, 33, 79, 80, 200):
        got = {r["g"]: r["count"] for r in select.round_robin(df, "g", "id", n, 42).groupBy("g").count().collect()}
        want, left = dict.fromkeys(sizes, 0), n
        while left and any(want[g] < sizes[g] for g in sizes):
            for g in sorted(sizes):
                if left and want[g] < sizes[g]:
                    want[g] += 1
                    left -= 1
        assert got == {g: c for g, c in want.items() if c}


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    one = {r["id"]: r["split"] for r in select.seeded_split(df.repartition(1), "id", 0.1, 42).collect()}
    many = {r["id"]: r["split"] for r in select.seeded_split(df.repartition(13, "g"), "id", 0.1, 42).collect()}
    assert one == many and sum(s == "validation" for s in one.values()) == 50
    with pytest.raises(ValueError):
        select.batched(df, "id", 0)


def test_context_packing(spark):
    rows = [("q", 1, "a", "w " * 5), ("q", 2, "b", "w " * 9), ("q", 3, "c", "w " * 3), ("none", 1, "a", "w " * 50)]
    df = spark.createDataFrame(rows, "question string, rank int, id string, text string").withColumn("source", F.lit("s")).withColumn("score", F.lit(1.0)).withColumn("label", F.lit("L"))
    names = {k: k for k in ("rank", "id", "source", "score", "label", "text")}
    got = {r["question"]: r for r in retrieve.pack_context(df, "question", names, max_context=26).collect()}
    assert [u["id"] for u in got["q"]["used"]] == ["a", "c"] and got["q"]["skipped"] == ["b"] and got["q"]["used"][1]["citation"] == 2
    assert got["none"]["used"] == [] and got["none"]["context"] == ""
    check = spark.createDataFrame([(got["q"]["context"],)], "c string").select(text.token_count("c")).first()[0]
    assert check == got["q"]["context_tokens"] <= 26
    with pytest.raises(ValueError):
        retrieve.pack_context(df, "question", names, max_context=0)


def test_top_k_ties_and_filter(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)] + [(9, None), (10, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["vec_id"] for r in retrieve.top_k(q, v.repartition(5), 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r["vec_id"] for r in retrieve.top_k(q, v, 2, where=F.col("vec_id") > 2).orderBy("rank").collect()] == [3, 4]
    assert retrieve.top_k(q.limit(0), v, 2).count() == 0
    with pytest.raises(ValueError):
        retrieve.top_k(q, v, 0)


def test_chat_rules(spark):
    m = lambda *x: [{"role": r, "content": c} for r, c in x]
    rows = [
        (1, m(("system", "s"), ("user", "u")), m(("assistant", "a"))),
        (2, m(("user", "u"), ("system", "s")), m(("assistant", "a"))),
        (3, m(("user", "u"), ("user", "u")), m(("assistant", "a"))),
        (4, m(("user", " ")), m(("assistant", "a"))),
        (5, m(("user", "u")), m(("assistant", "a"), ("assistant", "b"))),
        (6, m(("user", "u")), m(("user", "a"))),
        (7, [], m(("assistant", "a"))),
    ]
    df = spark.createDataFrame(rows, f"id long, {files.TRAINING}")
    got = {}
    for r in validate.chat_rules(df, "id").collect():
        got.setdefault(r["id"], set()).add(r["rule"])
    assert 1 not in got
    assert "roles_do_not_alternate" in got[2] and "roles_do_not_alternate" in got[3] and "blank_content" in got[4] and "one_completion" in got[5] and "no_final_assistant" in got[6] and "empty_prompt" in got[7]
    with pytest.raises(validate.ValidationError):
        validate.require_none(validate.chat_rules(df, "id"))


def test_question_rules(spark):
    rows = [("a", "q", None, "train", False), ("b", "q", "x", "dev", True), ("b", "q", "x", "dev", True), ("c", "", "x", "test", True), ("d", "q", None, "dev", True), ("e", "q", "x", "dev", False), (None, "q", "x", "dev", None)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, split string, answerable boolean")
    got = {(r["id"], r["rule"]) for r in validate.question_rules(df, answerable=False).collect()}
    assert got == {("b", "repeated_id"), ("c", "blank_question"), ("c", "split_domain"), ("d", "answer_missing"), ("e", "answer_not_null"), (None, "blank_id"), (None, "no_flag")}


def test_overlap_is_symmetric(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9)], "s string, k long")
    got = {(r["a"], r["b"]): r["shared"] for r in audit.pairwise_overlap(df, "s", F.col("k")).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}


def test_curate(spark):
    rows = [(1, "p1", "a good answer here"), (2, "P1 ", "a good answer here"), (3, "p1", "another good answer"), (4, "p2", "network_issue"), (5, "p3", "no"), (6, "p4", "a good answer here"), (7, "p5", None), (8, "p6", "turn off antivirus and go on")]
    df = spark.createDataFrame(rows, "id long, p string, r string")
    assert sorted(r["id"] for r in curate.curate(df, "id", "p", "r", response_cap=5).collect()) == [1, 6]
    assert sorted(r["id"] for r in curate.curate(df, "id", "p", "r", response_cap=1).collect()) == [1]


def test_metrics(spark):
    df = spark.createDataFrame([("a b", "a b", 4), ("I don't know", "x", 0), ("", "x", 2)], "a string, r string, j int")
    s = metrics.summary(metrics.score_answers(df, "a", "r"), F.col("rouge_l_f1"), F.col("j"), F.col("abstained")).first()
    assert (s["n"], round(s["mean_rouge_l"], 6), s["mean_judge"], s["judge_percent"], round(s["abstention_percent"], 3)) == (3, 0.333333, 2.0, 50.0, 66.667)


def test_jsonl_round_trip_and_rejects(spark, tmp_path):
    df = spark.createDataFrame([("1", "q", "a", {"u": "x"}), ("2", "ü", None, None)], files.BENCHMARK)
    assert files.write_jsonl(df, str(tmp_path / "out")) == 2
    assert sorted(files.read_jsonl(spark, str(tmp_path / "out"), files.BENCHMARK).collect()) == sorted(df.collect())
    (tmp_path / "bad.jsonl").write_text('{"id":"1","question":"q"}\n\n{"id":"2"}\nnope\n[1]\n{"id":"3","question":"q","x":1}\n')
    rows, rejects = files.read_jsonl_checked(spark, str(tmp_path / "bad.jsonl"), "id string, question string")
    assert [r["id"] for r in rows.collect()] == ["1"]
    assert sorted(r["reason"] for r in rejects.collect()) == ["missing key", "not JSON", "not an object", "unknown key"]
    files.write_json(spark, {"b": 1, "a": "ü"}, str(tmp_path / "m"))
    assert files.read_json(spark, str(tmp_path / "m")) == {"a": "ü", "b": 1}
    assert files.file_digests(spark, str(tmp_path / "bad.jsonl")).first()["sha256"]


def test_vector_table_and_stream(spark, tmp_path):
    made = lambda lo, hi: spark.createDataFrame([(str(i), "s" + str(i % 2), "t", "q", "c", f"text number {i}", None) for i in range(lo, hi)], files.CORPUS)
    t, embed = VectorTable(spark, str(tmp_path / "index")), models.embedder(models.hashed_words(16))
    with pytest.raises(FileNotFoundError):
        t.read()
    m = t.build(made(0, 6), embed, {"collection": "c"})
    assert m["documents"] == 6 and m["embedding_dimension"] == 16 and t.manifest() == m
    assert t.build(made(0, 6), embed, {"collection": "c"}) == m
    made(4, 9).write.json(str(tmp_path / "in"))
    index_stream(corpus_stream(spark, str(tmp_path / "in"), files.CORPUS), t, embed, {"collection": "c"}, str(tmp_path / "cp")).awaitTermination()
    assert t.count() == 9 and t.lookup(["8"]).count() == 1
    q = models.ask(spark.createDataFrame([("1", "text number 3")], "id string, text string"), embed, template="").withColumnRenamed("id", "query_id")
    best = retrieve.top_k(q, t.read().withColumnRenamed("id", "vec_id"), 1).first()
    assert best["vec_id"] == "3" and best["score"] > 0.999
    assert t.build(made(0, 2), embed, {"collection": "c"}, rebuild=True)["documents"] == 2


def test_evaluation_resumes(spark, tmp_path):
    ex = spark.createDataFrame([(i, f"id{i}", f"what is {i}", f"it is {i}" if i % 2 else None) for i in range(7)], "position long, id string, question string, reference string")
    calls = []

    def counted(model):
        def run(df):
            calls.append(df.count())
            return model(df)

        return run

    gen, jud = models.generator(models.first_words()), models.generator(models.fixed_judge())
    store = StageStore(spark, str(tmp_path / "run"), {"a": 1})
    store.append("answer", gen(ex.where("position < 3").select("position", F.col("question").alias("prompt"))))
    results, summary = evaluate.evaluate(ex, store, counted(gen), jud, commit=2)
    assert calls == [2, 2] and results.count() == 7
    s = summary.first()
    assert s["n"] == 7 and s["retries"] == 0
    with pytest.raises(validate.ValidationError):
        StageStore(spark, str(tmp_path / "run"), {"a": 2})
    store.append("judge", spark.createDataFrame([(99, "x")], "position long, value string"))
    with pytest.raises(validate.ValidationError):
        store.read("judge")
    store.finish()
    assert not os.path.exists(tmp_path / "run")


def test_provenance_gate():
    good = {"audit": {"passed": True}, "train_sha256": "1", "validation_sha256": "2", "split_overlap_checks": {"train/validation": {"prompt": 0}}}
    validate.provenance_gate(good, {"train": "1", "validation": "2"})
    for bad in ({**good, "audit": {}}, {**good, "train_sha256": "9"}, {**good, "split_overlap_checks": {"x": {"prompt": 1}}}):
        with pytest.raises(validate.ValidationError):
            validate.provenance_gate(bad, {"train": "1", "validation": "2"})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.sql(queries.ORACLES[name])
    cols = sorted(want.columns)
    rounded = lambda rows, names: sorted(json.dumps([round(r[names.index(c)], 6) if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in cols], default=str) for r in rows)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert rounded([tuple(r) for r in df.collect()], df.columns) == rounded(want.fetchall(), want.columns)


def test_top_k_over_cells_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieve, "CELL", 40)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 4)), rng.integers(-1, 2, size=(500, 4)), np.repeat(rng.normal(size=(1, 4)), 200, 0)])
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    df = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(x)], "vec_id string, embedding array<double>").repartition(3)
    ids = np.array([f"v{i}" for i in range(len(x))])
    for k in (1, 3, 12):
        got = {}
        for r in retrieve.top_k(df.withColumnRenamed("vec_id", "query_id"), df, k).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        s = np.round(unit @ unit.T, 12)
        assert got == {q: [(s[i, j], ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i, q in enumerate(ids)}


def test_top_k_plans_alike_for_any_number_of_queries(spark):
    plans = []
    for n in (10, 6000):
        df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
        plan = retrieve.top_k(df.withColumnRenamed("vec_id", "query_id"), df, 1)._jdf.queryExecution().executedPlan().toString()
        plans.append((plan.count("MapInArrow"), plan.count("Exchange")))
    assert plans[0] == plans[1]


def test_string_ids_find_themselves_far_along(spark, tmp_path):
    rows = [(i, "text", "en") for i in (0, 1, 2_136_283, 5_419_351)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r[0] for r in queries.QUERIES["string_ids"](spark, str(tmp_path)).collect()) == [i for i, _, _ in rows]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["split_leakage", "response_cap", "dedup_prompt", "prompt_overlap", "benchmark_overlap"])
def test_keys_are_grouped_by_digest(spark, name):
    """What is shuffled by a key holds no text."""
    made = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    lines = made.toString().splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "hashpartitioning(" in x and "doc_id" not in x.split("hashpartitioning(")[1].split("]")[0]]
    assert "sha2" in made.toString() and not any("text#" in x.split("sha2")[0] and "Project" in x and "sha2" not in x for x in below)


def test_over_length_counts_once(spark):
    made = plan(queries.QUERIES["over_length"](spark, SF))
    assert made.count("regexp_count") + made.count("regexp_extract_all") == 1


def test_topic_and_rules_fold_once(spark):
    df = spark.createDataFrame([("VPN İ",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(curate.topic("t")).collect()] == ["network", "other", "other"]
    assert plan(df.select(curate.topic("t").alias("x"))).count("lower(") == 1
    pairs = spark.createDataFrame([(1, "q", "Outside MY Area, sorry"), (2, "q", "a good long answer"), (3, "r", "It depends. "), (4, "s", None)], "id long, a string, b string")
    kept = curate.curate(pairs, "id", "a", "b")
    assert [r["id"] for r in kept.collect()] == [2]
    assert plan(kept).count("lower(") <= 6  # in each of the two reads, of the rules and the keys


def test_post_audit_reads_each_text_once(spark):
    d = spark.createDataFrame([(1, "a", "r"), (2, "A ", " "), (2, " ", None), (4, "b", "r")], "id long, p string, r string")
    h = spark.createDataFrame([(9, "B", "r"), (9, "c", "r"), (9, "c", "r")], "id long, p string, r string")
    got = {r["check"]: r["n"] for r in loaders.post_audit(d, "id", "p", "r", h).collect()}
    assert got == {"blank_prompt": 1, "blank_response": 2, "repeated_id": 1, "repeated_prompt": 1, "held_out_prompt": 1}
    assert {r["n"] for r in loaders.post_audit(d.limit(0), "id", "p", "r", h).collect()} == {0}
    assert plan(loaders.post_audit(d, "id", "p", "r", h)).count("lower(") == 2


def test_length_profile_plans_no_search_for_odd_characters(spark):
    made = plan(queries.QUERIES["length_profile"](spark, SF))
    assert "RLIKE" not in made and made.count("regexp_extract_all") == 1


def test_scores_held_at_once_are_few():
    """A worker has several blocks of this size at a time."""
    import numpy as np

    assert retrieve.QUERY_BLOCK * retrieve.TILE * 8 <= 8 << 20
    s = np.array([[1.0, 3.0, 3.0, 2.0, 3.0]])
    for k in (1, 2, 3, 5, 9):
        at, best = retrieve._best(s.copy(), k)
        assert at.tolist() == [[1, 2, 4, 3, 0][:k]] and best.tolist() == [[3.0, 3.0, 3.0, 2.0, 1.0][:k]]


def test_copies_of_a_vector_fill_no_single_cell():
    """What a worker holds is the vectors of a cell."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat([[0.6, 0.8, 0.0]], 20_000, 0), rng.normal(size=(20_000, 3))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    cells = retrieve._Cells(x[rng.permutation(len(x))[:100]], 3, 1)
    rows, keys = cells.of_vectors(x, np.ones(len(x)), rng.integers(0, 1 << 30, len(x)))
    assert len(rows) == len(x) and np.bincount(keys).max() < 8 * len(x) / 100
