import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import langid
from parley.llm.queries import tokenizer
from parley.llm.shingles import shingle_set

LINE = "subscribe to our newsletter today"


def planted():
    """One source, so that the mix takes every document once. Copies, near copies, boilerplate and texts too short."""
    random = np.random.default_rng(3)
    text = lambda k: " ".join(f"t{k}w{j}" for j in random.integers(0, 900, 80))
    texts = [text(k) + (f"\n{LINE}" if k < 25 else "") for k in range(40)]
    texts += [texts[30], texts[31].replace(" ", " \t "), f"{LINE}\n{texts[3]}", texts[5] + "\nmore at the end"]
    for k in (33, 34):
        words = texts[k].split()
        texts.append(" ".join("x" if j == 40 else w for j, w in enumerate(words)))
    texts += ["too short", "", None, "same eight words come back again and again " * 20, " ".join(f"long{j}" for j in range(9000))]
    return list(enumerate(texts))


def expected(texts):
    """What must be left of which document: rules, exact copies, near copies, by plain loops."""
    squeezed = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    left, seen, kept = {}, set(), {}
    for i, text in texts:
        words = (text or "").split()
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        repeated = {j + d for j, w in enumerate(windows) if windows.count(w) > 1 for d in range(8)} if len(words) < 500 else ()
        if len(words) >= 20 and 100 * len(repeated) <= 30 * len(words):
            left[i] = "\n".join(line for line in text.split("\n") if line != LINE)
    for i, text in sorted(left.items()):
        if squeezed(text) not in seen:
            seen.add(squeezed(text))
            kept[i] = text
    sets = {i: set(shingle_set(t.encode(), 5).tolist()) for i, t in kept.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= Fraction(4, 5) * len(sets[a] | sets[b])
    return {i: t for i, t in kept.items() if not any(alike(i, j) for j in kept if j < i)}


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = planted()
    rows = [(i, t, "en", "one", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(tokenizer())
    wanted = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected(texts).items()}
    assert len(texts) - 12 < len(wanted) < len(texts) - 7
    found, sequences = defaultdict(int), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == wanted[p.doc_id]
        found[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert found == wanted
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_languages_of_held_out_and_odd_rows(spark):
    random = np.random.default_rng(7)
    alphabets = {"aa": "abcdefghi", "bb": "ijklmnopq", "cc": "бвгдежз"}

    def text(lang, words):
        return " ".join("".join(random.choice(list(alphabets[lang]), 5)) for _ in range(words))

    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(list(alphabets) * 40)]
    learned, asked = rows[:60], [(i, t) for i, t, _ in rows[60:]]
    learned += [(500, None, "aa"), (501, "12 34", "bb"), (502, "unlabelled", None), (0, rows[0][1], "aa"), (None, rows[1][1], "bb")]
    options = langid.TrainingOptions(docs_per_language=18, windows=2, window=32, steps=80, batch=48)
    docs = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    windows = langid.training_windows(docs, options, F.col("text"), F.col("lang"), F.col("doc_id"))
    counts = {r.label: r.n for r in windows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == set(alphabets) and all(n <= 18 * 2 for n in counts.values())
    network = langid.trained_network(windows, options)

    odd = [(900, None), (901, ""), (902, "123 !?"), (903, text("cc", 20_000)), (904, asked[0][1]), (904, asked[0][1]), (None, asked[1][1])]
    schema = "doc_id long, text string, row int, known int, score int"
    table = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in asked + odd], schema)
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(table, network).collect()]
    assert len(found) == len(asked) + len(odd) and all(0 <= s <= 1 for _, _, s in found)
    answers = {i: (lang, s) for i, lang, s in found}
    right = sum(answers[i][0] == lang for i, _, lang in rows[60:])
    assert right >= 0.95 * len(asked)
    assert answers[900] == answers[901] == answers[902] == ("und", 0.0) and answers[903][0] == "cc"
    assert sum(i == 904 for i, _, _ in found) == 2 and {(lang, s) for i, lang, s in found if i == 904} == {answers[asked[0][0]]}
    assert answers[None] == answers[asked[1][0]]
    assert langid.predict_languages(table.limit(0), network).count() == 0
    assert langid.trained_network(windows.limit(0), options) is None
    assert {r.lang_pred for r in langid.predict_languages(table, None).collect()} == {"und"}
