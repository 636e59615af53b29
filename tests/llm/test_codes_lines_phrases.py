"""Vector codes, line deduplication and phrase collocations against brute force and odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from parley.llm import collocations as col
from parley.llm import line_dedup, vector_codes
from parley.llm.vector_codes import CodeOptions, codebooks_digest, with_label_errors

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = str.maketrans(UPPER, LOWER)


def lloyd(vectors, options):
    """Codes, errors and codebooks by plain integers; ``vectors`` in the order of their ids."""
    width = len(vectors[0]) // options.parts
    whole = [[int(np.floor(float(np.float32(x)) * options.scale)) for x in v] for v in vectors]
    part = lambda v, p: v[p * width : (p + 1) * width]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    codes, errors, books = [""] * len(whole), [0] * len(whole), []
    for p in range(options.parts):
        parts = [part(v, p) for v in whole]
        book = parts[: options.entries]
        nearest = lambda x: min(range(len(book)), key=lambda e: (square(x, book[e]), e))  # noqa: B023, E731
        for _ in range(options.rounds):
            found = defaultdict(list)
            for x in parts:
                found[nearest(x)].append(x)
            book = [[sum(c) // len(found[e]) for c in zip(*found[e])] if found[e] else b for e, b in enumerate(book)]
        for i, x in enumerate(parts):
            e = nearest(x)
            codes[i] += f"{e:02x}"
            errors[i] += square(x, book[e])
        books.append(book)
    return codes, errors, np.array(books)


@pytest.mark.parametrize("options", [CodeOptions(), CodeOptions(parts=2, entries=5, rounds=4, scale=100)])
def test_vector_codes_equal_plain_lloyd(spark, options):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (300, 16)).round(3).astype(np.float32)
    vectors[100:200] = vectors[100]  # a third of all rows is one vector
    rows = [(i, [float(x) for x in v], i % 3 if i % 4 else None, "extra") for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, row string").repartition(3)
    found = vector_codes.vector_codes(docs, options)
    codes, errors, books = lloyd(vectors.tolist(), options)
    assert found.codebooks.tolist() == books.tolist()
    assert codebooks_digest(found.codebooks) == hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    of_label = Counter()
    for i, e in enumerate(errors):
        of_label[rows[i][2]] += e
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in with_label_errors(found.codes).collect()}
    assert got == {(i, codes[i], errors[i], of_label[rows[i][2]]) for i in range(300)}


def test_only_parts_that_change_their_entry_move(spark):
    options, width, n = CodeOptions(parts=1, entries=2, rounds=3), 1, 4
    # 10 goes over to the second entry after the first round, 9 after the second.
    values = np.array([0, 1, 2, 9, 10, 11, 20], dtype=np.int32)[:, None]
    books = np.array([[[0], [20]]])
    position, row = np.zeros(7, dtype=np.int16), np.arange(7)
    entry, _ = vector_codes._assigned(position, values, books)
    blocks = list(vector_codes._blocks(position, entry, row, values, options, n))
    members = spark.sparkContext.parallelize(blocks, 2).partitionBy(n, vector_codes._partition).mapValues(lambda v: v)
    last, books, held = vector_codes.resident_rounds(members, books, options, n)
    assert last.getNumPartitions() == n and books.tolist() == [[[1], [12]]]
    assert [r for r in held[-1].filter(lambda kv: kv[1][0]).flatMap(lambda kv: kv[1][1][2].tolist()).collect()] == [3]
    at_home = last.mapPartitionsWithIndex(
        lambda k, blocks: [k == p for _, m in blocks for p in vector_codes._place(m[0], m[1], m[2], options.entries, n)]
    )
    assert all(at_home.collect()) and at_home.count() == 7


def test_vector_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0], None), (None, [0.5, 0.5], 1), (3, [0.0, 2.0], 1), (3, [1.0, 2.0], None), (4, None, 1), (5, [None, 1.0], 1)]
    rows += [(6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1), (None, None, None)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    options = CodeOptions(parts=2, entries=4, rounds=2, scale=10)
    found = vector_codes.vector_codes(docs, options)
    # Two different ids, so two entries: the smallest vector of id 3, then the one without an id.
    got = sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in with_label_errors(found.codes).collect())
    assert found.codebooks.tolist() == [[[0], [8]], [[20], [5]]]
    assert got == [(-1, "0101", 9, 9), (3, "0000", 0, 9), (3, "0100", 4, 8), (3, "0100", 4, 8)]
    for none in (docs.limit(0), docs.filter("embedding is null")):
        empty = vector_codes.vector_codes(none, options)
        assert with_label_errors(empty.codes).count() == 0 and empty.codebooks.size == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(docs, CodeOptions(parts=3))


def test_nearest_is_exact_for_large_numbers():
    rng = np.random.default_rng(1)
    values, book = rng.integers(-(1 << 27), 1 << 27, (50, 8)), rng.integers(-(1 << 27), 1 << 27, (4, 8))
    entry, error = vector_codes._nearest(values, book)
    for x, e, d in zip(values.tolist(), entry, error.tolist()):
        squares = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book.tolist()]
        assert (e, d) == (squares.index(min(squares)), min(squares))


def shared_lines(texts, least, length):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(SMALL)
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in found.items() if n >= least and len(k) >= length}
    for t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in gone]
        yield "\n".join(left), len(lines), len(lines) - len(left)


@pytest.mark.parametrize("least, length", [(3, 1), (2, 0), (4, 6)])
def test_shared_lines_against_brute_force(spark, least, length):
    rng = np.random.default_rng(least)
    pool = ["Menu", " menu\t", "MENU\x0b", "", "  ", "Über uns", "über uns", "ÜBER UNS", "a", "Copyright (c)", "İ x", "\x85", "long line " * 50]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 8))) for _ in range(40)]
    texts += ["\n".join(f"own {i} {k}" for k in range(300)) for i in range(3)] + [None, "", "\n\n", "menu\n" * 500, None]
    texts += [texts[0]] * 30  # copies of one text
    rows = [(i if i % 7 else None, t, 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, name int, dropped int").repartition(5)
    found = line_dedup.drop_shared_lines(docs, least, length)
    assert found.columns == ["doc_id", "text", "name", "dropped", "kept_text", "n_lines", "n_dropped"]
    want = Counter((r[0], r[1], *x) for r, x in zip(rows, shared_lines(texts, least, length)))
    assert Counter((r.doc_id, r.text, r.kept_text, r.n_lines, r.n_dropped) for r in found.collect()) == want
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_shared_lines_use_no_python(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    plan = line_dedup.drop_shared_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def phrases_by_hand(docs, options):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(SMALL)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, options.longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    rows = []
    for lang, found in counts.items():
        f = {g: a for g, a in found.items() if a >= options.least_count}
        around = Counter()
        for g, a in f.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    around[g[i : i + m]] = max(around[g[i : i + m]], a)
        scored = []
        for g, a in f.items():
            if len(g) > 1 and 100 * around[g] < options.absorbed * a:
                cuts = [(1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[: options.best], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return rows


def random_texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["Der", "der", "große", "a", "b", "c", "d", "New", "York", "new", "\x1c", "x'y", "\U0001f600"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]
    return [
        (["de", "en", None, "und"][rng.integers(4)], "".join(w + e for w, e in zip(rng.choice(words, k), rng.choice(ends, k))))
        for k in rng.integers(0, 60, n)
    ]


@pytest.mark.parametrize("options, trie_phrases", [
    (col.PhraseOptions(least_count=5), 1 << 20), (col.PhraseOptions(least_count=3, best=20), 60),
    (col.PhraseOptions(least_count=4, longest=3, absorbed=50), 1 << 20), (col.PhraseOptions(least_count=2, longest=2), 50),
])
def test_collocations_against_brute_force(spark, options, trie_phrases, monkeypatch):
    docs = random_texts(options.least_count, 300) + [(None, None), ("en", ""), ("fr", "..."), ("en", "new york " * 400), ("en", "new york " * 400)]
    monkeypatch.setattr(col, "DENSE_SLOTS", 100 if trie_phrases > 100 else 1 << 20)
    if trie_phrases < 100:  # Python workers import the package anew, so this reaches the function below only
        batch = pa.RecordBatch.from_arrays([pa.array([[1, 2, 3], [], [4, 5, 6, 7]])], ["words"])
        monkeypatch.setattr(col, "WINDOW", 3)
        runs = [tuple(w[i : i + 2].tolist()) for w in col._windows(batch, 2) for i in range(len(w) - 1)]
        assert runs == [(0, 1), (1, 2), (2, 3), (3, 0), (0, 0), (0, 4), (4, 5), (5, 6), (6, 7)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, words int, n int").repartition(4)
    found = col.collocations(df, options, trie_phrases=trie_phrases)
    assert sorted(tuple(r) for r in found.collect()) == sorted(phrases_by_hand(docs, options))


def test_longer_phrases_travel_as_slots_and_only_frequent_ones_are_written(spark, monkeypatch):
    real, counted = col.written, []

    def written(df, name, *rest):
        table = real(df, name, *rest)
        if df.columns == ["words", "n"]:
            counted.extend((len(r.words), r.n) for r in table.collect())
        return table

    monkeypatch.setattr(col, "written", written)
    options = col.PhraseOptions(least_count=6)
    df = spark.createDataFrame(random_texts(6, 300), "lang string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert col.collocations(df, options, trie_phrases=50).count()
    assert {length for length, _ in counted} >= {2, 3} and min(n for _, n in counted) >= 6
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "one two"), (None, None)], "lang string, text string")
    for df in (docs, docs.limit(0)):
        assert col.collocations(df).count() == 0


def test_long_texts_are_read_in_slices(monkeypatch):
    text = b" ".join(b"w%d" % (k % 91) + b"." * (k % 7 == 0) for k in range(5000)).translate(col.PLAIN)
    whole = col._Lexicon("en", 1).lists([text])[0].values.to_numpy()
    assert col._Lexicon("en", 1).lists([b"", text, b"w1"])[1].values.to_numpy()[:-1].tolist() == whole.tolist()
    monkeypatch.setattr(col, "CHUNK_BYTES", 57)
    sliced, parts = col._Lexicon("en", 1), list(col._slices(text))
    assert max(map(len, parts)) < 70 and b"".join(parts) == text
    assert sliced.lists([text])[0].values.to_numpy().tolist() == whole.tolist()
    assert sliced.counts.sum() == len(whole)


@pytest.mark.parametrize("length", [2, 3, 4])
def test_trie_finds_every_phrase(length):
    rng = np.random.default_rng(length)
    words = rng.integers(-(2**62), 2**62, 12)
    phrases = np.unique(words[rng.integers(0, 12, (400, length))], axis=0)
    leads = rng.random(len(phrases)) < 0.7
    shuffled = rng.permutation(len(phrases))
    trie = col.PhraseTrie(phrases[shuffled], leads[shuffled])
    text = np.concatenate([words, [0, 77]])[rng.integers(0, 14, 5000)]
    names = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
    want = [names.get(tuple(text[i : i + length].tolist()), -1) for i in range(len(text))] + [-1]
    assert trie.positions(text).tolist() == want
    led = {tuple(p) for p, lead in zip(trie.phrases.tolist(), trie.leads) if lead}
    grams = [tuple(text[i : i + length + 1].tolist()) for i in range(len(text) - length)]
    counted = Counter(g for g in grams if g[:-1] in led and g[1:] in names)
    slots, counts = trie.counted(text)
    assert dict(zip(map(tuple, trie.candidates(slots).tolist()), counts.tolist())) == dict(counted)


def test_pairs_and_slots_travel_in_few_blocks(monkeypatch):
    """However many pairs and slots a task counts, it sends a row for each part, and they add up to the same counts."""
    rng = np.random.default_rng(4)
    vocabulary = np.unique(rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64))
    texts = [vocabulary[rng.integers(0, len(vocabulary), n)] for n in (3000, 1, 0, 500)]
    batches = [pa.RecordBatch.from_pydict({"words": pa.array([t.tolist()], pa.list_(pa.int64()))}) for t in texts]
    everything = SimpleNamespace(value=np.ones(1 << col.FILTER_BITS, dtype=bool))
    expected = Counter((int(a), int(b)) for t in texts for a, b in zip(t, t[1:]))
    for held, most, n_common in ((1 << 20, 7, 0), (400, 7 * 40, 30), (1 << 20, 7, 60)):
        common = SimpleNamespace(value=vocabulary[:n_common])
        monkeypatch.setattr(col, "HELD_COUNTS", held)
        monkeypatch.setattr(col, "WINDOW", 300)
        blocks = pa.Table.from_batches(list(col._pairs(everything, common, 7)(iter(batches))))
        assert 7 <= blocks.num_rows <= most
        found = Counter()
        for part in range(7):
            rows = col._frequent_pairs(common, 2)(blocks.filter(pc.equal(blocks.column("part"), part))).to_pylist()
            found.update({tuple(r["words"]): r["n"] for r in rows})
        assert found == Counter({k: n for k, n in expected.items() if n >= 2})

        phrases = np.array(sorted(found), dtype=np.int64)
        trie = SimpleNamespace(value=col.PhraseTrie(phrases, np.ones(len(phrases), dtype=bool)))
        blocks = pa.Table.from_batches(list(col._longer(trie, 7)(iter(batches))))
        assert 7 <= blocks.num_rows <= most
        longer = Counter((int(a), int(b), int(c)) for t in texts for a, b, c in zip(t, t[1:], t[2:]))
        rows = [col._frequent_slots(trie, 7, 2)(blocks.filter(pc.equal(blocks.column("part"), k))).to_pylist() for k in range(7)]
        assert {tuple(r["words"]): r["n"] for part in rows for r in part} == {k: n for k, n in longer.items() if n >= 2}


@pytest.mark.parametrize("numbers", ([], [0], [255, 0], [256, 1], [1 << 40, 3, 65535]))
def test_packed_numbers_come_back(numbers):
    assert col._unpacked(col._packed(np.array(numbers, dtype=np.int64))).tolist() == numbers
