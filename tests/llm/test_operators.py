import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import langid, lm, mixing, packing, passages, quality, token_files, urls, wordtokens
from parley.llm.exact_dedup import drop_exact_copies, exact_dedup
from parley.llm.ngram_join import drop_near_copies
from parley.llm.queries import tokenizer

LONG = "word and more, " * 3000
TEXTS = [
    (0, "Same  text\there"), (1, "Same text here"), (2, None), (3, ""), (4, "Same text"), (5, LONG), (5, LONG),
    (None, "Same text here"), (7, "İstanbul <|endoftext|> don't é́ \U0001f600"), (8, LONG + "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like those that the operators use inside."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i != 4 else None, len(t or ""), 1, 2) for i, t in TEXTS]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, cell int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    return lambda text: np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def test_exact_dedup(docs):
    found = exact_dedup(docs, first_bytes=2).collect()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(found) == len(TEXTS)
    for r in found:
        group = groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        assert (r.keep_id, r.group_size) == (min((i for i in group if i is not None), default=None), len(group))
    assert sum(r.kept for r in found) == len(groups)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_word_tokens_equal_whole_texts(encoded, monkeypatch):
    tokens = wordtokens.WordTokens(tokenizer())
    texts = [t or "" for _, t in TEXTS] + ["'Tis o'clock 'LL", "a\x1cb\x85c\x0bd", "日本語。１①"]
    for most in (800_000, 3):
        monkeypatch.setattr(wordtokens, "MOST_WORDS", most)
        for some in (texts, texts[4:]):
            ids, bounds = tokens.encode([t.encode() for t in some], 1)
            for k, text in enumerate(some):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == encoded(text).tolist()


def test_packing(docs, encoded):
    pieces = packing.pack_documents(docs, tokenizer(), packer_pieces=4).collect()
    whole = defaultdict(list)
    for i, t in TEXTS:
        whole[i].append(encoded(t))
    for r in pieces:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in whole[r.doc_id])
    assert sum(r.length for r in pieces) == sum(len(x) for xs in whole.values() for x in xs)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 2048
    assert packing.pack_documents(docs.limit(0), tokenizer()).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 65, 400).tolist(), reverse=True)
    windows, offsets = packing.best_fit_decreasing(lengths, 64)
    rooms = {}
    for length, window, offset in zip(lengths, windows, offsets):
        fitting = [r for r in rooms.values() if r >= length]
        assert rooms.get(window, 64) == (min(fitting) if fitting else 64) and 64 - rooms.get(window, 64) == offset
        rooms[window] = rooms.get(window, 64) - length


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 24])
def test_bit_packing_round_trip(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype(np.uint32)
    assert token_files.unpack_ids(token_files.pack_ids(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    with open(tmp_path / "shard", "wb") as out:
        writer = token_files.ShardWriter(out, bits, block=99)
        writer.add([4, None], ids[:7000], np.array([0, 0, 7000]))
        writer.add([9], ids[7000:], np.array([0, 3001]))
        writer.close()
    with open(tmp_path / "shard", "rb") as file:
        reader = token_files.ShardReader(file)
        assert reader.doc_ids == [4, None, 9]
        assert reader.document(2).tolist() == ids[7000:].tolist() and reader.document(0).tolist() == []
        assert reader.ids(123, 4567).tolist() == ids[123:4567].tolist()


def test_token_files(docs, encoded):
    found = token_files.read_documents(token_files.write_token_files(docs, tokenizer())).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 0, 1, 2, 3, 4, 5, 5, 7, 8]
    start = 0
    for r in found:
        ids = [encoded(t) for i, t in TEXTS if i == r.doc_id][0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read_documents(token_files.write_token_files(docs.limit(0), tokenizer())).count() == 0


def test_mixing(docs):
    plan = mixing.mix_plan(docs)
    rows, again = sorted(plan.collect(), key=str), sorted(plan.collect(), key=str)
    assert rows == again and all(0 <= r.taken <= 3 * r.size for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(sum(s for _, s in targets.values()))
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values())
    assert sum(r.taken for r in rows) == mixing.mix(docs).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    """Sources of 100 documents, some of them long: one draw alone would miss by a fifth now and then."""
    rows = [(k, "w " * (400 if k % 25 == 0 else 20 + k % 7), f"s{k % 6}") for k in range(600)]
    rows += [(None, "w " * 30, None), (None, "v " * 30, None), (7, None, "empty"), (8, "", "empty")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, seed int, fraction int")
    plan = mixing.mix_plan(docs).toPandas()
    sums = plan.groupby("source").agg({"taken": "sum", "target": "max", "size": "sum"})
    assert (abs(sums.taken - sums.target) <= 0.02 * sums.target).drop("empty").all()
    assert sums.taken["empty"] == 0 and len(plan) == len(rows)
    assert mixing.mix(docs).columns == docs.columns


def test_quality_rules_cut_common_lines(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{own(i)}\nThe  same LINE 1 here", "a") for i in range(30)]
    rows += [(100, " ".join(["b"] * 60), "a"), (101, None, None), (102, own(0) + "\n" + own(0), "b"), (103, "The same line 2 here\n" * 9, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in quality.quality_rules(docs, keep=("text",)).collect()}
    assert all(found[i].kept and found[i].n_cut_words == 5 for i in range(30))
    assert found[100].n_repeat_words == 60 and found[100].base_failed and not found[101].kept
    assert (found[102].n_dup_lines, found[102].n_repeat_words, found[102].n_words) == (1, 60, 60)
    assert not found[103].kept and found[103].n_cut_words == 45
    cut = quality.quality_rules(docs, keep=("text",)).select("doc_id", quality.without_lines(F.col("text"), F.col("cut")).alias("t"))
    assert {r.doc_id: r.t for r in cut.collect()}[3] == own(3)


def test_passages_across_documents(spark):
    rng = np.random.default_rng(1)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage = line(60)
    near = passage.replace(passage.split()[30], "changed", 1)
    rows = [(1, f"{line(40)}\n{passage}"), (2, f"{near}\n{line(40)}"), (3, f"{line(30)}\n{passage}\nx"), (4, line(80)), (5, None), (6, "")]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.paragraph, r.keep_id, r.removed) for r in found.collect()} == {(1, 1, 1, False), (2, 0, 1, True), (3, 1, 1, True)}
    left = passages.without_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), found)
    assert {r.doc_id: r.text for r in left.collect()}[3].endswith("\nx")


def test_passages_inside_longer_lines(spark):
    rng = np.random.default_rng(2)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50000, n))
    runs = [line(50) for _ in range(30)]
    rows = [(k, f"{line(300 + k)} {run} {line(200)}") for k, run in enumerate(runs)]
    # Elsewhere in another line, and wrapped at other places.
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, 50, 9))
    rows += [(100 + k, f"{line(90)} {run if k % 2 else wrap(run)} {line(400 - k)}") for k, run in enumerate(runs)]
    rows += [(200, line(700)), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    passages_found = passages.repeated_passages(docs)
    found = passages_found.collect()
    assert {(r.doc_id, r.keep_id) for r in found if r.removed} == {(100 + k, k) for k in range(30)}
    texts = dict(rows)
    assert all(" ".join(texts[r.doc_id].split()[r.start_word :][:25]) in runs[r.keep_id] for r in found)
    left = {r.doc_id: r.text for r in passages.without_passages(docs, passages_found).collect()}
    assert all(left[i] == t for i, t in texts.items() if not 100 <= i < 130)
    for i in range(100, 130):
        n = {r.start_word + j for r in found if r.doc_id == i for j in range(25)}
        assert left[i].split() == [w for j, w in enumerate(texts[i].split()) if j not in n]


def test_url_filters(spark):
    changes = [("domain", "bad.org", "add", "2024-01-05"), ("domain", "bad.org", "remove", "2024-03-01"), ("prefix", "a.com/x", "add", "2024-01-01")]
    captures = [
        (1, "http://u@www.BAD.org:80/p", "2024-01-04"), (2, "http://www.bad.org./p", "2024-01-05"), (3, "http://bad.org", "2024-03-01"),
        (4, "http://notbad.org/", "2024-02-01"), (5, "https://a.com/x/y?q", "2024-02-01"), (6, "https://a.com/xy", "2024-02-01"),
        (7, None, "2024-02-01"), (8, "https://a.com/x", None), (5, "https://a.com/x/y?q", "2024-02-01"),
    ]
    listed = spark.createDataFrame(changes, "kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    pages = spark.createDataFrame(captures, "page_id bigint, url string, t string").withColumn("fetched_at", F.to_timestamp("t"))
    found = urls.url_verdicts(pages, listed).collect()
    assert len(found) == 9 and {r.page_id for r in found if not r.kept} == {2, 5}
    assert all(r.kept for r in urls.url_verdicts(pages, listed.limit(0)).collect())


def test_lm_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "A b. a b"), (2, "a c"), (3, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in lm.lm_scores(docs, order=2).collect()}
    a, seen = np.log(3 / 6), np.log(2 / 3)
    assert found[1].log_score == pytest.approx(a + seen + np.log(0.4) + a + seen)
    assert found[2].log_score == pytest.approx(a + np.log(0.4) + np.log(1 / 6))
    assert (found[3].n_words, found[3].log_score, found[3].mean_log_score) == (0, 0.0, None)


def test_network_gradients_are_right():
    network = langid.ByteNetwork(["x", "y"], 3, 1)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    data, labels = np.random.default_rng(2).integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 0, 1])
    loss = lambda: -np.log(network.probabilities(data)[:, np.arange(4), labels]).mean()
    slopes = network.gradients(data, labels)
    for name, at in (("out", (2, 1)), ("f_gates", (1, 4)), ("b_state", (2, 0)), ("f_in", (int(data[0, 0]), 7)), ("b_in", (int(data[1, 3]), 2))):
        values = []
        for change in (1e-3, -2e-3):
            network.weights[name][at] += change
            values.append(loss())
        network.weights[name][at] += 1e-3
        assert slopes[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.02, abs=1e-4)


def test_pipeline_stages_on_odd_rows(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, "").columns == rows.columns, name


def test_word_tokens_that_forget(encoded, monkeypatch):
    monkeypatch.setattr(wordtokens, "MOST_WORDS", 6)
    tokens = wordtokens.WordTokens(tokenizer())
    for some in (["a b c", "d e"], ["a b c d e f g h i j"], ["x a y b z c w d", "a b q r s t u v"], ["a", "new words x"]):
        ids, bounds = tokens.encode([t.encode() for t in some], 1)
        for k, text in enumerate(some):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == encoded(text).tolist()


def test_word_tokens_seen_again_are_not_forgotten(monkeypatch, encoded):
    monkeypatch.setattr(wordtokens, "MOST_WORDS", 60)
    tokens = wordtokens.WordTokens(tokenizer())
    for k in range(12):
        text = "The cat, again " + " ".join(f"w{'abcdefghijkl'[k]}{c}" for c in "abcdefghijklmno")
        ids, bounds = tokens.encode([text.encode()], 1)
        assert ids.tolist() == encoded(text).tolist()
        assert k == 0 or {"The", "cat,", "again"} <= tokens.places.keys()
        assert len(tokens.places) <= 60


def test_word_tokens_of_odd_letters_equal_whole_texts(encoded):
    """Random texts of letters whose lower case is more than letters, combining marks, marks and odd spaces."""
    rng = np.random.default_rng(11)
    parts = list("aBz'.,-!?1 \t\n\x0b\x0c\r\x1c\x85\xa0 İıßŒéÉ́̇ͅΣςǅŉﬁⅣ①日。ـ") + [" ", " ", "don't", "İ'", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(20_000)]
    tokens = wordtokens.WordTokens(tokenizer())
    assert tokens.by_words
    for k in range(0, len(texts), 2000):
        ids, bounds = tokens.encode([t.encode() for t in texts[k : k + 2000]], 1)
        for j, text in enumerate(texts[k : k + 2000]):
            assert ids[bounds[j] : bounds[j + 1]].tolist() == encoded(text).tolist(), repr(text)


def test_vocabularies_that_span_white_space_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    tokens = wordtokens.WordTokens(path)
    texts = ["Two  words\n here", "", "é́ x"]
    ids, bounds = tokens.encode([t.encode() for t in texts], 5)
    assert not tokens.by_words
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids + [5] for t in texts]


def test_drop_near_copies_decides_by_row(spark):
    words = lambda k: [f"{k}w{j}" for j in range(40)]
    a, b, c, d = (" ".join(words(k)) for k in "abcd")
    near = " ".join(words("b")[:39] + ["other"])
    rows = [(3, b), (5, a), (5, near), (9, a), (7, c), (7, d), (None, c), (None, "lone words " * 9), (None, None), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, number int, row int, component_id int")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(3, b), (5, a), (7, c), (7, d), (None, "lone words " * 9), (None, None), (None, None), (4, ""), (4, "")], key=str)
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_a_stage_drops_the_scratch_of_the_one_before(spark):
    from parley.plans import storage

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with storage.stage_scratch(spark, docs):
        first = storage.written(docs, "first")
        other = storage.written(docs, "other")
    with storage.stage_scratch(spark, first):
        second = storage.written(first, "second")
    assert first.count() == second.count() == 2
    with pytest.raises(Exception):
        other.collect()
    with storage.stage_scratch(spark, docs):
        pass
    with pytest.raises(Exception):
        second.collect()
