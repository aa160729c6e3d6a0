"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest

import corpus_pipeline
from grainmill.llm import chat_format, common, decontaminate, line_dedup, lm_score, minhash, packing, quality_rules, secrets, toxicity, url_filter
from grainmill.llm import queries as q

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
LINE = "a line that many documents share"
ROWS = [
    (1, LINE + "\nown one"), (2, LINE + "\nown two"), (3, LINE.upper() + " \nown three"), (4, None), (5, ""), (6, " \n\t"), (7, LONG), (7, LONG), (None, LINE), (8, "x" * 50_000),
    (9, "one two three four five six seven"), (10, "One two three four five six seven"), (11, "tiny"), (12, "tiny"), (13, 'token = "abcdef0123456789abcdef0123456789"'), (14, "<|endoftext|> a\r\nb  c é ß 漢字"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, id string, at int, src string, kept string, score string, spans string, g string, h string, piece string, leaks string, line_count string, in_row int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i == 2 else "s", len(t or ""), *["?"] * 3, 1, *["?"] * 9, 2) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (99, 1, 1), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")


def both(docs, run):
    full, none = run(docs), run(docs.limit(0))
    assert none.columns == full.columns and none.count() == 0
    return full.collect()


def test_packing(docs):
    rows = both(docs, lambda d: packing.pack(d, q.tokenizer_path(), capacity=64))
    assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    one = {r["doc_id"]: r for r in rows}
    assert one[4]["length"] == one[5]["length"] == 1
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert sum(r["doc_id"] == 7 and r["piece"] == 0 for r in rows) == 2


def test_packing_is_exact_on_odd_text():
    from array import array

    from tokenizers import Tokenizer

    enc, exact = packing.Encoder(q.tokenizer_path()), Tokenizer.from_file(q.tokenizer_path())
    for t in [x for _, x in ROWS if x is not None] + ["a  b", " a", "a ", "a \n b", "a\n\n b", "it's 's 12 3½ \x1c x", "a\u3000b \xa0c", "e\u0301 \u200d x"]:
        assert list(array("I", enc(t))) == exact.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_exchanges_empty_a_sequence_that_best_fit_leaves(spark):
    """Six texts of 5, 2, 13, 14, 4 and 2 tokens: best fit leaves three sequences of 20 tokens, an exchange makes it two."""
    sizes = [5, 2, 13, 14, 4, 2]
    assert len(packing.best_fit(sizes, 20)) == 3
    docs = spark.createDataFrame([(i, " ".join(["the"] * (n - 1))) for i, n in enumerate(sizes)], "doc_id long, text string")
    rows = packing.pack(docs, q.tokenizer_path(), capacity=20).collect()
    assert sorted(r["length"] for r in rows) == sorted(sizes) and len({r["sequence_id"] for r in rows}) == 2


def test_local_search_takes_two_for_one_from_full_bins_of_small_texts():
    """Bins of many small texts: every pair of sizes is tried, whatever the number of texts."""
    sizes = [1] * 40 + [30] + [29, 30]
    bins = packing.local_search([list(range(40)), [40], [41, 42]], sizes, 60)
    assert sorted(i for b in bins for i in b) == list(range(43)) and len(bins) == packing.least_bins(sizes, 60) == 3
    at = packing._step([0, 1, 2], [3, 4], 9, 8, [5, 3, 1, 4, 4], 10)
    assert at is not None and at[0] and sum([5, 3, 1, 4, 4][i] for i in at[0]) - sum([5, 3, 1, 4, 4][i] for i in at[1]) == 2


def test_token_memory_is_bounded_by_characters():
    enc = packing.Encoder(q.tokenizer_path())
    enc("a " + "漢字" * 500_000 + " b")
    assert all(len(k) <= packing.LONGEST for k in enc.seen) and enc.held <= packing.CACHE


def test_local_search_never_loses_items():
    import random

    r = random.Random(5)
    sizes = [r.randint(1, 100) for _ in range(400)]
    start = [[i] for i in range(400)]
    bins = packing.local_search(start, sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins) and len(bins) < 400
    fit = packing.local_search(packing.best_fit(sizes, 100), sizes, 100)
    assert len(fit) <= -(-sum(sizes) // 100) + 4


def test_quality(docs, labels):
    rows = both(docs, lambda d: quality_rules.quality_rules(d, labels))
    assert len(rows) == len(ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)


def test_quality_guarantee():
    import random

    assert abs(quality_rules.binomial_tail(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert quality_rules.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    grid = quality_rules.RULES["symbols_per_word"][2]
    assert quality_rules.select_cutoff([0] * len(grid) + [50], [5] * len(grid) + [5], grid, 0.01, 0.0025, 10) is None
    r, bad = random.Random(3), 0
    for _ in range(200):  # rate of false rejections at the cutoff that is chosen, over repeated holdouts
        x = [r.random() * 3 for _ in range(800)]
        good = [sum(v > c for v in x) for c in grid] + [len(x)]
        c = quality_rules.select_cutoff(good, [1000 * (i + 1) for i in range(len(grid))] + [10**6], grid, 0.05, 0.05, 0)
        bad += c is not None and 1 - c / 3 > 0.05
    assert bad <= 200 * 0.05 + 10


def test_near_duplicates(docs):
    rows = both(docs, minhash.near_duplicates)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert got[10]["component_id"] == 9 and got[12]["component_id"] == 11 and not got[12]["kept"]
    assert got[4]["n_shingles"] == got[5]["n_shingles"] == got[6]["n_shingles"] == 0 and got[5]["kept"] and got[5]["component_id"] == 5
    assert got[None]["kept"] and got[8]["n_shingles"] == 1


def test_near_duplicates_in_blocks(spark):
    """A cluster of many blocks gives the same components as brute force."""
    import random

    r = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = base[:]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(150)] = f"m{i}x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, block=16).collect()}
    assert got == dict(enumerate(comp))
    assert 1 < len(set(comp)) < 120


def test_components_by_small_plans(spark, monkeypatch):
    """No round plans one star inside the other, which took the driver's memory; a chain, a star and a ring are closed all the same."""
    real, joins = common.staged, []

    def counted(df, name, by=None):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return real(df, name, by)

    monkeypatch.setattr(common, "staged", counted)
    chain, hub, ring = [(i, i + 1) for i in range(12)], [(100, 100 + k) for k in range(1, 40)], [(200, 201), (201, 202), (202, 200)]
    got = common.components(spark.createDataFrame(chain + hub + ring, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(13)] + [(i, 100) for i in range(100, 140)] + [(i, 200) for i in range(200, 203)]
    assert 0 < max(joins) <= 3


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.COM/en/1", "https://a.example.com/en/", "http://www.example.com/en/x?y#z", "http://x.net/es/9", "ftp://h/" + "s/" * 5000, "http://x.net/es", "http://a.b?c://d/e"]
    df = spark.createDataFrame([(i, u, "?", "?") for i, u in enumerate(urls)] + [(4, urls[4], "?", "?")], "page_id long, url string, host string, seg string")
    rows = both(df, lambda d: url_filter.filter_urls(d, q.URL_RULES))
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(urls) + 1
    assert [got[i]["host"] for i in range(4)] == [""] * 4 and got[0]["verdict"] == "allow"
    assert (got[4]["rule"], got[4]["verdict"]) == ("example.com/en/", "block") and got[6]["rule"] == "www.example.com/en/" and got[7]["rule"] == "net/es/"
    assert got[9]["rule"] is None and (got[10]["host"], got[10]["path"]) == ("a.b", "")


def test_url_templates_reject_by_labels(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}", 1 if i % 2 else 0) for i in range(60)] + [(100 + i, f"http://h.org/{'spam' if i % 2 else 'news'}/{900 + i}", None) for i in range(10)] + [(200, "http://other.org/spam/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, [], label_col="bad").collect()}
    assert [got[100 + i] for i in range(10)] == ["allow", "block"] * 5 and got[200] == "allow"


def test_toxicity(docs, labels):
    model = toxicity.train_toxicity(docs, labels)
    rows = both(docs, lambda d: toxicity.score_toxicity(d, model, d.columns))
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r["doc_id"], r["score"]) == r["score"]  # repeated rows score alike
    assert by[4] == by[5] == by[6] < 0.5  # null, empty and blank texts have nothing against them
    none = toxicity.train_toxicity(docs.limit(0), labels)
    assert none.known.size == 0 and {r["score"] for r in toxicity.score_toxicity(docs, none, ["doc_id"]).collect()} == {by[4]}


def test_fragments_do_not_depend_on_blocks(monkeypatch):
    """Texts longer than a block, nulls, blanks and letters of several bytes have the fragments of a plain enumeration."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    texts = [LONG[:9000], None, "", " \n", "é" * 500 + " Straße idiot 1d10t ID!OT", "x" * 700, "a b", LONG[:9000]]

    def found(block):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        out = Counter()
        for kind, h, place, ends in toxicity.Fragments()(pa.array(texts), within=True):
            out.update(zip([kind] * len(h), h.tolist(), np.searchsorted(ends, place, "right").tolist()))
        return out

    def plain(text):
        table = toxicity.Fragments().table
        words = bytes(table[np.frombuffer((text or "").lower().encode(), np.uint8)]).split()
        whole = [b" " + w + b" " for w in words]
        grams = [len({w[i : i + n] for w in whole for i in range(len(w) - n + 1)}) for n in toxicity.LENGTHS]
        return grams + [len(set(words)), len(set(zip(words, words[1:])))]

    whole = found(1 << 20)
    assert found(64) == found(512) == whole
    for t, text in enumerate(texts):
        assert [sum(k == kind and d == t for k, _, d in whole) for kind in range(toxicity.KINDS)] == plain(text)


def test_hits_of_known_fragments_are_counted_in_little_memory():
    """Where every fragment is known, a slice takes a bounded number of bytes for each of its hits."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts, f = pa.array([" ".join(f"{chr(97 + (i * k) % 26)}{chr(97 + k % 23)}w{'xyzv'[k % 4]}r{chr(97 + i % 25)}" for k in range(250)) for i in range(512)]), toxicity.Fragments()
    each = [np.unique(np.concatenate([h for _, h, _, _ in f(texts, True, (k,))])) for k in range(toxicity.KINDS)]
    known = toxicity.Known(np.repeat(np.arange(toxicity.KINDS), [len(h) for h in each]), np.concatenate(each))
    hits = sum(len(h) for k in range(toxicity.KINDS) for _, h, _, _ in f(texts, True, (k,)))
    known(f, texts)
    tracemalloc.start()
    text, feature = known(f, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) == len(feature) and 0 <= feature.min() and feature.max() < known.size * toxicity.LEVELS
    assert peak / hits < 56


def test_nnpu_separates_without_negatives():
    import numpy as np

    r = np.random.default_rng(0)
    xp = (r.random((100, 5)) < [0.6, 0.6, 0.1, 0.1, 0.1]).astype(np.float32)
    xp[:, 0] = 1
    xu = (r.random((1000, 5)) < [0.02, 0.02, 0.1, 0.1, 0.1]).astype(np.float32)
    xu[:100] = xp
    at = lambda x: [np.nonzero(r)[0] for r in x]
    w, b = toxicity.fit_nnpu(at(xp), at(xu), 5, 0.1)
    hit = 1 / (1 + np.exp(-(xu @ w + b))) >= 0.5
    assert hit[:100].mean() > 0.95 and hit[100:].mean() < 0.1


@pytest.mark.parametrize("kind", ["ending", "disguise", "pair"])
def test_toxicity_finds_what_no_single_word_shows(spark, kind):
    """Held-out recall and false alarms where bad words are never twice the same: stems with any ending, spellings with signs,
    pairs of harmless words."""
    import random
    import zlib

    r = random.Random(kind)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    common = [word() for _ in range(400)]

    def bad():
        if kind == "ending":
            return r.choice(["vexor", "grumil", "tharn", "ploskit"]) + word()
        if kind == "pair":
            return r.choice([common[7] + " " + common[300], common[19] + " " + common[41]])
        return "".join({"i": "1", "o": "0", "e": "3"}.get(c, c) if r.random() < 0.6 else c for c in r.choice(["moronic", "pisgod"]))

    rows = []
    for i in range(2400):
        words = [r.choice(common) if r.random() < 0.8 else word() for _ in range(r.randint(30, 400))]
        for _ in range(3 if i % 8 == 0 else 0):
            words.insert(r.randrange(len(words)), bad())
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_toxicity(df, df)
    got = [x for x in toxicity.score_toxicity(df, model, ["doc_id", "toxic"]).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    share = lambda toxic: sum(x["score"] >= 0.5 for x in got if x["toxic"] == toxic) / sum(x["toxic"] == toxic for x in got)
    assert share(1) >= 0.9 and share(0) <= 0.02


def test_leaks(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "tiny"), (None, "x")], "item_id long, text string")
    rows = both(docs, lambda d: decontaminate.find_leaks(d, bench))
    got = {r["doc_id"]: [(x["item_id"], x["edits"]) for x in r["leaks"]] for r in rows}
    assert got[9] == [(1, 0)] and got[10] == [(1, 0)] and got[11] == [(4, 0)] and got[4] == [] and len(rows) == len(ROWS)
    again = {r["doc_id"]: [(x["item_id"], x["edits"]) for x in r["leaks"]] for r in decontaminate.find_leaks(docs, bench, keep=["doc_id"], item_block=1).collect()}
    assert again == got
    assert all(not r["leaks"] for r in decontaminate.find_leaks(docs, bench.limit(0)).collect())


def test_leaks_reach_the_recall(spark):
    """Against the exact edit distance: no false match, and the recall asked for at every number of edits allowed."""
    import random

    r = random.Random(11)
    word = lambda: "v" + str(r.randrange(3000))
    items = [[word() for _ in range(r.randint(12, 50))] for _ in range(60)]
    texts, want = [], 0
    for k in range(240):
        body = [word() for _ in range(120)]
        if k % 4:
            own = items[k % 60][:]
            for _ in range(len(own) * 20 // 100):
                at, kind = r.randrange(len(own)), r.randrange(3)
                own[at : at + (kind != 2)] = [] if kind == 0 else [word()]
            body[40:40] = own
            want += 1
        texts.append((k, " ".join(body)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], y["item_id"]): y["edits"] for x in decontaminate.find_leaks(df, bench).collect() for y in x["leaks"]}
    hit = sum((k, k % 60) in got for k in range(240) if k % 4)
    assert hit >= 0.95 * want and all(k % 4 and i == k % 60 and d <= len(items[i]) * 20 // 100 for (k, i), d in got.items())


def test_secrets(docs):
    rows = both(docs, secrets.scan_secrets)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert (got[13]["n_assign"], got[13]["n_hex"], got[4]["n_hex"]) == (1, 1, 0) and [s["verdict"] for s in got[13]["spans"]] == ["live", "live"]


def test_secrets_in_a_text_with_very_many(spark):
    """Thousands of matches in one text keep their places, across the blocks of the fold."""
    import re

    text = "é " + " ".join(f"password={i:08d} x" for i in range(3000))
    got = secrets.scan_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"password=\d+", text)]
    assert got["n_assign"] == 3000 and [(s["start"], s["end"]) for s in got["spans"] if s["kind"] == 0] == want


def test_near_copies_under_one_id(spark):
    """Rows of one id with different texts are one document, whichever partition they come from."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (3, a), (9, b), (5, c), (8, None), (8, c)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {(r["doc_id"], r["component_id"], r["n_shingles"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
        assert got == {(7, 3, 36, False), (3, 3, 36, True), (9, 3, 36, False), (5, 5, 36, True), (8, 5, 0, False), (8, 5, 36, False)}


def test_leaks_of_very_long_items(spark):
    """An item of 3,000 words, a fifth of a percent of them edited, in a longer text; the windows are embedded a few at a time."""
    words = [f"w{i * 7919 % 10_007}" for i in range(3000)]
    edited = [w if i % 500 else "other" for i, w in enumerate(words)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    df = spark.createDataFrame([(1, "x y " + " ".join(edited) + " z"), (2, " ".join(words[:1500]))], "doc_id long, text string")
    got = {r["doc_id"]: [(x["item_id"], x["edits"]) for x in r["leaks"]] for r in decontaminate.find_leaks(df, bench, keep=["doc_id"]).collect()}
    assert got == {1: [(1, 6)], 2: []}


def test_secret_ownership(spark):
    own, copied = "kQ3vX9zT1mB7cR5wN2yL", "Zp8Yt6Rw4Qe2Us0Io1Ka"
    rows = [(i, f"key {copied} here", f"s{i % 5}") for i in range(10)] + [(20, f"é key {own} here", "s1"), (21, "plainwordswithoutdigitsatall", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(df).collect()}
    assert got[20] == [(6, 3, 26)] and all(got[i] == [] for i in [*range(10), 21])


def test_lm(docs):
    rows = both(docs, lm_score.score_texts)
    assert len(rows) == len(ROWS) and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}


@pytest.mark.parametrize("least", [1, 2, 20])
def test_lm_against_definition(spark, least):
    import math
    import random
    import zlib
    from collections import Counter

    import numpy as np

    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["a b", "b c d", "The", "x" + str(r.randrange(50))]) for _ in range(r.randint(0, 30)))) for i in range(300)]
    got = {x["doc_id"]: x for x in lm_score.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), least=least, group_tokens=300).collect()}
    toks = {i: [*t.lower().split(), None] for i, t in texts}
    train = [toks[i] for i, _ in texts if zlib.crc32(str(i).encode()) % 10]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    c2 = {k: c for k, c in Counter(x for t in train for x in zip(t, t[1:])).items() if c >= least}
    c3 = {k: c for k, c in Counter(x for t in train for x in zip(t, t[1:], t[2:])).items() if c >= least}
    count = {(w,): c for w, c in c1.items()} | c2 | c3

    def p(h, w):
        if not h:
            return p1(w)
        seen = {k[-1]: c for k, c in count.items() if len(k) == len(h) + 1 and k[:-1] == h}
        if not seen:
            return p(h[1:], w)
        if w in seen:
            return (seen[w] - 0.5) / count[h]
        left = 1 - sum((c - 0.5) / count[h] for c in seen.values())
        return left / (1 - sum(p(h[1:], x) for x in seen)) * p(h[1:], w)

    for i, t in toks.items():
        x = got[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t), sum(c1[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10(p1(w)) for w in t))
        if i % 10 == 0:
            assert x["score"] == pytest.approx(sum(math.log10(p(tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t)), rel=1e-9)
    assert sum(p(("b",), w) for w in c1) + 0.1 / (n + 0.1 * (v + 1)) * (p(("b",), "unseen") / p1("unseen")) == pytest.approx(1)
    out = [x for i, x in got.items() if x["held_out"]]
    assert np.mean([x["score"] - x["base_score"] for x in out]) > 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "human", ""), (3, 0, None, "?"), (4, 0, "user", "a\n\nb" * 9000)]
    df = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, transcript string")
    raw = chat_format.transcripts_of(df)
    model = chat_format.train_parser(raw)
    assert both(raw, lambda d: chat_format.parse_transcripts(d, model, ["conv_id"]))
    assert chat_format.transcripts_of(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "User: a\nAssistant: b")], "id long, t string")
    got = {r["id"]: r["turns"] for r in chat_format.parse_transcripts(odd, chat_format.Model({}), ["id"], text_col="t").collect()}
    assert got[1] == got[2] == got[3] == [] and got[4]


def test_chat_held_out(spark):
    rows = q.op9_chat_format(spark, "/root/testdata/sf0.01").collect()
    out = [r for r in rows if r["held_out"]]
    assert sum(r["right"] for r in out) >= 0.9 * len(out) and len(rows) >= 100


def test_lines(docs):
    rows = both(docs, line_dedup.dedup_lines)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert got[3]["kept_text"] == LINE.upper() + " \nown three" and got[1]["kept_text"] == "own one" and got[2]["lines_dropped"] == 1 and got[None]["kept_text"] == LINE
    assert got[4]["kept_text"] == "" and got[4]["line_count"] == 1 and "line_count" in rows[0].asDict()


def test_lines_by_batches(spark):
    store = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    seen, out = set(), {}
    for b in range(5):
        rows = [(10 * b + i, "\n".join(f"this is shared line number {(b * 3 + i + k) % 17}" for k in range(3))) for i in range(4)]
        kept = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_new(spark.createDataFrame(rows, "doc_id long, text string"), store).collect()}
        for i, t in rows:
            out[i] = "\n".join(x for x in t.split("\n") if x not in seen)
            assert kept[i] == out[i]
        seen |= {x for _, t in rows for x in t.split("\n")}
    assert sum(len(x) for x in store.levels) <= 3


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        made, none = stage(spark, now, str(tmp_path)), stage(spark, now.limit(0), str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        assert none.count() == 0
        if name != "packing":
            assert made.columns == docs.columns
        now = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in now.collect()}
    assert 9 not in ids and 10 not in ids and {1, 2, 3, 4, None} <= ids


def test_parts_are_parsed_as_one_transcript(spark):
    """A long conversation in parts has the roles of a plain Viterbi over all its lines, wherever it is cut."""
    import random

    import numpy as np

    r = random.Random(9)
    rows = [(c, t, ("user", "assistant")[t % 2], "\n".join("w" * r.randrange(1, 60) + ("?" if r.random() < 0.3 else "") for _ in range(r.randint(1, 3)))) for c in range(4) for t in range(150 if c else 700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat_format.train_parser(chat_format.transcripts_of(df, chunk=10_000))

    def plain(text):
        f = chat_format.line_features(text.split("\n"))
        e = model.emission(f)
        best, back = model.start + e[0], []
        for row in e[1:]:
            back.append([max(range(6), key=lambda a, b=b: best[a] + model.step[a, b]) for b in range(6)])
            best = np.array([best[back[-1][b]] + model.step[back[-1][b], b] + row[b] for b in range(6)])
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(b[out[-1]])
        return [chat_format.STATES[s] for s in out[::-1]]

    whole = {x["conv_id"]: plain(x["transcript"]) for x in chat_format.transcripts_of(df, chunk=10_000).collect()}
    for chunk in (7, 64, 256):
        raw = chat_format.transcripts_of(df, chunk=chunk)
        got = sorted(((x["conv_id"], x["part"]), x["turns"], x["continues"]) for x in chat_format.parse_transcripts(raw, model, ["conv_id", "part"], parts_of=("conv_id", "part")).collect())
        for c, states in whole.items():
            roles = []
            for (conv, _), turns, continues in got:
                if conv == c:
                    roles += [t["role"] for t in turns][bool(continues) :]
            assert roles == [role for role, part in states if part == "begin"]


def test_rows_without_turn_numbers(spark):
    df = spark.createDataFrame([(1, None, "user", f"text {i}") for i in range(50)] + [(1, 0, "user", "x"), (1, 1, "bot", None)], "conv_id long, turn long, role string, text string")
    raw = chat_format.transcripts_of(df)
    assert raw.where("part = 0").select(chat_format.F.size("turns")).first()[0] == 2 and raw.where("part < 0").count() > 20
    out = chat_format.parse_transcripts(raw, chat_format.train_parser(raw), ["conv_id", "part"], parts_of=("conv_id", "part"))
    assert out.count() == raw.count()
