"""Repeated passages against all pairs of lines, and pieces against all runs of words."""

import random
import re
from fractions import Fraction

import pytest

from parley.llm import passages

SCHEMA = "doc_id bigint, text string, id bigint, place int, node int, keys int, piece int"


def words(text):
    return re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def random_rows():
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(80) for _ in range(4)]
    passage = fresh(60)
    rows = []
    for k in range(60):
        lines = [" ".join(fresh(rng.randrange(1, 45))) for _ in range(rng.randrange(1, 5))]
        if k % 3 == 0:
            line = list(rng.choice(shared))
            if k % 2:
                line[rng.randrange(len(line) - 1)] = f"edit{k}"  # one edit: 71 of 81 shingles stay
                line = line[:-1] + ["End", "now"][: rng.randrange(3)]
            lines.insert(rng.randrange(len(lines) + 1), "  ".join(line).upper() if k % 4 == 0 else " ".join(line))
        if k % 10 == 1:
            lines.append(" ".join(fresh(50) + passage + fresh(50)))
        if k % 10 == 2:  # the same passage across line ends
            lines.append("\n".join(" ".join(passage[i : i + 15]) for i in range(0, 60, 15)))
        rows.append((k, "\n".join(lines)))
    rows += [(None, "\n".join([" ".join(shared[0])])), (100, None), (101, ""), (102, " \n\t\n"), (103, "same " * 3000), (104, "same " * 3000)]
    return rows + [(105, " ".join(passage)), (105, " ".join(passage))]


def line_rows(rows):
    """All pairs of lines with 20 words or more; links from a Jaccard similarity of 0.8 in shingles of five words."""
    lines = [(i, p, words(x)) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n"))]
    lines = [(i, p, w, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, p, w in lines if len(w) >= 20]
    group = list(range(len(lines)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            s, t = lines[a][3], lines[b][3]
            if Fraction(len(s & t), len(s | t)) >= Fraction(4, 5):
                group[top(a)] = top(b)
    found = set()
    for root in {top(k) for k in range(len(lines))}:
        members = [lines[k][:3] for k in range(len(lines)) if top(k) == root]
        ids = {i for i, _, _ in members}
        keep = min((i, p) for i, p, _ in members)
        if len(ids) > 1:
            found |= {(i, p, len(w), *keep, len(ids), (i, p) != keep) for i, p, w in members}
    return found


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, 1, 2, 3, 4, 5) for i, t in random_rows()]
    return passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()


def test_lines_equal_all_pairs(found):
    wanted = line_rows(random_rows())
    lines = {tuple(r)[:7] for r in found if r.start_word is None}
    assert lines == wanted and len(wanted) > 12


def test_pieces_are_exact_and_cover_long_repeats(found):
    rows = [(i, t) for i, t in random_rows() if i is not None]
    gone = {(i, p) for i, p, *_, removed in line_rows(rows) if removed}
    runs, places = {}, {}
    for i, t in rows:
        w = [(x, p) for p, line in enumerate((t or "").split("\n")) for x in words(line)]
        places[i] = w
        for k in range(len(w) - 24):
            runs.setdefault(tuple(x for x, _ in w[k : k + 25]), set()).add(i)
    at = {}
    for r in found:
        if r.start_word is not None:
            piece = tuple(x for x, _ in places[r.doc_id][r.start_word : r.start_word + 25])
            assert len(runs[piece]) >= r.n_documents >= 2 and places[r.doc_id][r.start_word][1] == r.paragraph
            at.setdefault(r.doc_id, set()).add(r.start_word)
    # Fifty words that stand in another document too, and in no line that goes, hold a piece.
    kept = {i: [(i, p) not in gone for _, p in w] for i, w in places.items()}
    where = {}
    for i, w in places.items():
        for k in range(len(w) - 49):
            if all(kept[i][k : k + 50]):
                where.setdefault(tuple(x for x, _ in w[k : k + 50]), []).append((i, k))
    repeats = [x for some in where.values() if len({i for i, _ in some}) > 1 for x in some]
    assert len({i for i, _ in repeats}) > 8
    assert all(any(k <= s <= k + 25 for s in at.get(i, ())) for i, k in repeats)


def test_no_rows(spark):
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    none = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id bigint, text string")
    assert passages.repeated_passages(none).collect() == []
