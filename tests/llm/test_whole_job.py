"""Cases that a cut in the work would get wrong."""

import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from grainmill.llm import decontaminate, lm_score


def test_lm_keeps_what_is_seen_twice_at_every_size(spark):
    """A pair of words seen twice stays in the model however large the corpus around it is."""
    rare = [(10_001, "quartz zephyr"), (10_002, "quartz zephyr"), (10_003, "quartz alone"), (10_004, "other zephyr")]
    assert all(zlib.crc32(str(i).encode()) % 10 for i in (0, 10_001, 10_002, 10_003, 10_004))
    filler = " ".join(f"f{i % 50}" for i in range(1000))
    for copies in (1, 250):
        df = spark.createDataFrame(rare + [(i, filler) for i in range(copies)], "doc_id long, text string")
        got = {r["doc_id"]: r for r in lm_score.score_texts(df, group_tokens=20_000).collect()}
        alone = 3.1 / (got[10_001]["train_tokens"] + 0.1 * (55 + 1))  # "quartz" is seen three times; 55 distinct tokens
        assert len(got) == len(rare) + copies
        assert got[10_001]["score"] == pytest.approx(math.log10(alone * 1.5 / 3 * 1.5 / 2), rel=1e-9)


def test_pipeline_drops_near_copies_from_four_fifths_on(spark):
    """The near_dedup stage against brute force, with pairs on both sides of 0.8 and between 0.8 and 0.85."""
    r, texts = random.Random(4), []
    for k in range(60):
        a = [f"t{k}w{i}" for i in range(150)]
        b = a[:]
        for at in range(20, 20 + 30 * (1 + k % 4), 30):
            b[at] = f"m{r.randrange(10**9)}"
        texts += [" ".join(a), " ".join(b)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 120, 2)]
    assert sum(0.8 <= x < 0.85 for x in alike) == sum(x < 0.8 for x in alike) == 15
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert got == {i for i in range(120) if i % 2 == 0 or alike[i // 2] < 0.8}


def test_leak_repetitions_reach_the_recall():
    """Pairs at the most edits allowed share a key in one of r tables as often as promised, with pairs that r was not chosen on."""
    for n in (10, 20, 50):
        r, pairs = random.Random(n), []
        for _ in range(3000):
            row = [r.getrandbits(61) + 1 for _ in range(n)]
            new = row[:]
            for _ in range(decontaminate.allowed(n, 80)):
                at, kind = r.randrange(len(new)), r.randrange(3)
                new[at : at + (kind != 2)] = [] if kind == 1 else [r.getrandbits(61) + 1]
            pairs.append((row, (new + [r.getrandbits(61) + 1 for _ in range(n)])[:n]))
        a, b = (np.array(x, np.uint64) for x in zip(*pairs))
        for bits in (1, 2):
            reps = decontaminate.repetitions(n, 80, bits, 0.99)
            met = np.concatenate([(decontaminate.sample_keys(a[t : t + 100], reps, bits) == decontaminate.sample_keys(b[t : t + 100], reps, bits)).any(0) for t in range(0, 3000, 100)]).mean()
            assert met >= 0.985
