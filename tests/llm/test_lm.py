"""Stupid-backoff scores against a plain count of all n-grams."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from parley.llm import lm

PLAIN = str.maketrans({c: " " for c in lm.PUNCTUATION.decode()} | {chr(65 + k): chr(97 + k) for k in range(26)})
SCHEMA = "doc_id bigint, text string, id string, chunk int, part int, ids int"


def brute(texts, order):
    docs = [[w for w in (t or "").translate(PLAIN).split()] for t in texts]
    counts = Counter(tuple(d[i : i + k]) for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    total = sum(map(len, docs))

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= lm.LEAST_COUNT:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(lm.BACKOFF) + score(gram[1:])

    return [(len(d), sum(score(tuple(d[max(0, i - order + 1) : i + 1])) for i in range(len(d)))) for d in docs]


def random_texts():
    rng = random.Random(5)
    words = ["The", "a", "b.", "cat", "dog", "é", "x-y", "İ"]
    texts = [" ".join(rng.choices(words, weights=[9, 4, 3, 2, 2, 1, 1, 1], k=rng.randrange(30))) for _ in range(60)]
    return texts + [None, "", " \t\n", "...", texts[0], texts[0], "the cat " * 4000]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("part_grams", [50, lm.PART_GRAMS])
def test_scores_equal_a_plain_count(spark, monkeypatch, order, part_grams):
    monkeypatch.setattr(lm, "PART_GRAMS", part_grams)
    texts = random_texts()
    rows = [(k if k % 7 else None, t, "x", 1, 2, 3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = lm.lm_scores(docs, order=order)
    assert found.columns == ["doc_id", "n_words", "log_score", "mean_log_score"]
    wanted = sorted((-1 if r[0] is None else r[0], n, round(s, 6)) for r, (n, s) in zip(rows, brute(texts, order)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, round(r.log_score, 6)) for r in found.collect())
    assert [x[:2] for x in got] == [x[:2] for x in wanted]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in wanted], abs=1e-5)


def test_an_empty_table_gives_no_rows(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_blocks_come_back_as_sent():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm._unpacked_ascending(lm._packed_ascending(hashes)) == hashes).all()
    for some in (hashes[:1], np.array([0, 2**64 - 1], dtype=np.uint64)):
        assert (lm._unpacked_ascending(lm._packed_ascending(some)) == some).all()
    counts = np.array([1, 2, 2**32 - 1], dtype=np.uint32)
    assert (lm._unpacked(lm._packed(counts), np.uint32) == counts).all()
