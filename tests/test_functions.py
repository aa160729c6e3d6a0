"""Column functions against plain Python, traps included."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.functions import judge, overlap, text, vectors

# Text, the cleaned text, and the key.
TRAPS = [
    (None, "", ""),
    ("", "", ""),
    ("a\\nb", "a\nb", "a b"),
    ("a\r\nb", "a\nb", "a b"),
    ("a\rb", "a\nb", "a b"),
    ("a\r\r\nb", "a\nb", "a b"),
    ("a\r\r\r\nb", "a\n\nb", "a b"),
    ("a\x0bb\x0cc", "a\nb\nc", "a b c"),
    ("a\x85b\u2028c", "a\nb\nc", "a b c"),
    ("\ta \t b\t", "a b", "a b"),
    ("a\n\n\n\nb", "a\n\nb", "a b"),
    ("a\n \n \n\nb", "a\n\nb", "a b"),
    ("\xa0a\xa0", "a", "a"),
    ("a\xa0b", "a\xa0b", "a b"),
    ("a \u3000\n\xa0 b", "a\nb", "a b"),
    ("Straße STRASSE", "Straße STRASSE", "strasse strasse"),
    ("ΣΑΣ σας", "ΣΑΣ σας", "σασ σασ"),
    ("\u2003x\u3000", "x", "x"),
    ("İ", "İ", "i\u0307"),
    ("µ ſ ŉ ﬃ", "µ ſ ŉ ﬃ", "μ s ʼn ffi"),
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean_text_and_key(spark):
    texts = [x for x, _, _ in TRAPS]
    assert column(spark, texts, text.clean_text) == [c for _, c, _ in TRAPS]
    assert column(spark, texts, text.text_key) == [k for _, _, k in TRAPS]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=list("ab ß\\n\n\r\t\x0b\x1c\x85\xa0\u2028\u3000"), max_size=12), min_size=20, max_size=60))
def test_clean_text_fuzzed(spark, values):
    """What cleaning promises of any text: it is clean already, has one kind of break, no blanks at the ends of lines or in a
    row, at most one empty line together, and all its other characters."""
    once = column(spark, values, text.clean_text)
    assert column(spark, once, text.clean_text) == once
    for before, after in zip(values, once):
        assert not re.search("[\r\t\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|  |\n{3}|\\A\\s|\\s\\Z", after)
        assert all(line == line.strip() for line in after.split("\n"))
        assert re.sub(r"\s", "", before.replace("\\n", "")) == re.sub(r"\s", "", after)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=8), min_size=20, max_size=60))
def test_casefold_is_the_full_folding(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert column(spark, values, text.casefold) == [v.casefold() for v in values]


def test_is_blank(spark):
    assert column(spark, [None, "", " \t\u3000\x85", "\x00", " a "], text.is_blank) == [True, True, True, False, False]


def test_join_question(spark):
    df = spark.createDataFrame([("T", "t "), ("", "b"), ("t", ""), ("t", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.join_question("a", "b")).collect()] == ["t", "b", "t", "t\n\nb", ""]


def test_tokens_and_rouge(spark):
    pairs = [("", "a"), ("a b c", "a b c"), ("c b a", "a b c"), ("x", "y"), ("The cat, sat", "the cat sat."), ("Straße", "STRASSE"), (None, "a")]

    def rouge(p, r):
        p, r = (re.findall(r"\w+|[^\w\s]", (x or "").casefold()) for x in (p, r))
        n = overlap.lcs(p, r)
        return 2 * (n / len(p)) * (n / len(r)) / (n / len(p) + n / len(r)) if p and r and n else 0.0

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, p string, r string")
    got = [r[0] for r in df.orderBy("i").select(overlap.rouge_l_f1("p", "r")).collect()]
    assert all(abs(g - rouge(*p)) < 1e-12 for g, p in zip(got, pairs))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    assert overlap.lcs(a, b) == row[-1]


def test_abstention(spark):
    says = ["I don’t know", "i do not have enough context", "cannot answer", "insufficient information", "no information was provided", "", None, "éi do not know", "all good"]
    assert column(spark, says, text.is_abstention) == [True, True, True, True, True, True, True, False, False]


def test_judge(spark):
    says = ['{"score": 3, "reason": " ok "}', 'x ```{"score": 4, "reason": "b"}```', '{"score": true, "reason": "x"}', '{"score": "3", "reason": "x"}', '{"score": 3.0, "reason": "x"}', '{"score": -1, "reason": "x"}', '{"score": 2, "reason": 1}', '[{"score": 1, "reason": "in a list"}]', '{"a":1}{"score": 0, "reason": "y"}', "", None]
    got = column(spark, says, judge.parse_judge)
    assert [g and (g["score"], g["reason"]) for g in got] == [(3, "ok"), (4, "b"), None, None, None, None, None, (1, "in a list"), (0, "y"), None, None]
    df = spark.createDataFrame([('{"score": 2, "reason": "cut', '{"score": 2, "reason": "also'), ('{"score": 2, "reason": "cut', '{"score": 1, "reason": "also'), ("bad", '{"score": 1, "reason": "r"}')], "a string, b string")
    got = [r[0] for r in df.select(judge.judge_or_recover("a", "b")).collect()]
    assert [g and (g["score"], g["recovered"], g["retried"]) for g in got] == [(2, True, True), None, (1, False, True)]


def test_vectors(spark):
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], vectors.l2_normalize, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    assert abs(df.select(overlap.greedy_match_f1("a", "b")).first()[0] - 2 * 0.5 * 1 / 1.5) < 1e-12



def test_preview(spark):
    x = "a" * 200 + "b" * 200
    assert column(spark, ["short", x], text.preview) == ["short", "a" * 160 + " ... " + "b" * 160]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_casefold_of_every_code_point_in_a_small_plan(spark):
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(points[i : i + 50]) for i in range(0, len(points), 50)] + [" Ǆ", "ß"]
    assert column(spark, texts, text.casefold) == [x.casefold() for x in texts]
    # One call for each character that folds to several, or a regular expression of them, takes most of the time of the queries.
    made = plan(spark.createDataFrame([("a",)], "v string").where(F.length("v") > 0).select(text.casefold("v").alias("x")))
    assert made.count("replace(") < 5 and "RLIKE" not in made


def test_text_key_squeezes_once(spark):
    odd = ["a\\nb", " \\n\\r\\n A\x85  b\\n", "\x1f", "\\\\n", "\\r\\n", "a \t\x0b　 b", None, "  x  "]
    clean = lambda x: text.squeeze_ws(text.casefold(text.clean_text(x)))
    assert column(spark, odd, text.text_key) == column(spark, odd, clean)
    made = plan(spark.createDataFrame([("a",)], "v string").select(text.text_key("v").alias("x")))
    assert made.count("regexp_replace") == 1


def test_token_count_of_folded_text(spark):
    odd = ["", None, "The cat, sat!", "İstanbul ŉ ﬃ", "a_b 1\x85_", "ͅ", "\U00010400x"]
    assert column(spark, odd, text.token_count) == [0, 0, 5, 5, 3, 1, 1]
    made = plan(spark.createDataFrame([("a",)], "v string").select(text.token_count("v").alias("x")))
    assert made.count("replace(") < 5 and "RLIKE" not in made
