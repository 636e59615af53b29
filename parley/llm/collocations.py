"""Phrases whose words go together, mined level by level with broadcast double-array tries.

One pass over the texts hashes the words, counts them in every chunk, and writes each text as numbers; all later levels read these
numbers. Level 2 counts adjacent words that pass a bit table of the frequent words. From level 3 on, the frequent
phrases of the level before form double-array tries. NumPy advances the states of all text positions at once, depth by
depth; where a phrase ends in an accepting state and so does the one that begins a word later, the two make up a
candidate, both of whose parts are frequent. Every such candidate has a slot of its own, numbered from the trie, so that
candidates need not be listed; the slots are counted in every chunk and the counts are summed by Spark.

Counts travel in blocks: what a task has counted for a part of the candidates is one row of small numbers, compressed. Common words
go by a number, the others stand once in a block.

What is broadcast is bounded: the bit table by its size, the common words by ``COMMON_WORDS``, a trie by ``TRIE_PHRASES``. More phrases make more tries, split by a
hash of the words that the two parts of a candidate share, so that each candidate belongs to one trie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shingles import mix
from parley.operators.skew import salted_join
from parley.plans.shipping import ship_package
from parley.plans.storage import set_to, shared_dir, shuffles_dropped, written

TRIE_PHRASES = 1 << 20  # phrases of one trie
FILTER_BITS = 24  # the table of frequent words has 2^24 bits, 2 MB
CHUNK_BYTES = 1 << 21  # of text that is in words at a time
DENSE_SLOTS = 1 << 20  # so many slots are counted as a plain vector
WINDOW = 1 << 19  # words that NumPy looks at in one step
HELD_COUNTS = 1 << 20  # counts that a task holds before it sends them on
TEXTS_AT_ONCE = 2000  # rows of a batch that a worker gets
SENT_AT_ONCE = 1 << 16  # rows of a batch that a worker sends
PART_WORDS = 1 << 22  # occurrences of words for which a part of the counts is made at least
COMMON_WORDS = 1 << 20  # words whose numbers all tasks know, 8 MB
SPREAD = 4  # parts over which the pairs that begin with a word are dealt
END, TEXT_END = b".", b"!"
#: Capitals become small, marks and line ends become the end of a piece, a tab becomes a space; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\f\r" else 32 if c == 9 else c for c in range(256))
UNKNOWN = "und"


@dataclass(frozen=True)
class PhraseOptions:
    """``absorbed``: a phrase goes if a longer one around it is found in at least so many percent of its places."""

    least_count: int = 100
    longest: int = 5
    absorbed: int = 100
    best: int = 2000


def _slices(text: bytes) -> Iterator[bytes]:
    """The plain text in slices of bounded size, cut at spaces and piece ends."""
    start = 0
    while len(text) - start > CHUNK_BYTES:
        ends = [k for k in (text.find(b" ", start + CHUNK_BYTES), text.find(END, start + CHUNK_BYTES)) if k >= 0]
        stop = min(ends, default=len(text))
        yield text[start:stop]
        start = stop
    yield text[start:]


class _Lexicon:
    """The different words of a chunk: their places, hashes and counts. The ends of pieces and texts have hash 0."""

    def __init__(self, lang: str, seed: int):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode(), seed)
        self.places: dict[bytes, int] = {END: 0, TEXT_END: 1}
        self.hashes = np.zeros(2, dtype=np.int64)
        self.counts = np.zeros(2, dtype=np.int64)

    def numbers(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words in order, and where texts end among them."""
        words = text.replace(END, b" . ").split()
        new = list(set(words) - self.places.keys())
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) or 1 for w in new), dtype=np.uint64, count=len(new))
        self.hashes = np.concatenate([self.hashes, hashes.view(np.int64)])
        at = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
        counts = np.bincount(at, minlength=len(self.places))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        return self.hashes[at], np.flatnonzero(at == 1)

    def lists(self, texts: list[bytes]) -> pa.Array:
        """The words of each text. A long text is read in slices, the others together."""
        if len(texts) == 1:
            values = np.concatenate([self.numbers(part)[0] for part in _slices(texts[0])])
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
        values, ends = self.numbers(b"".join(x for text in texts for x in (text, b" ", TEXT_END, b" ")))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1]), pa.int32()), pa.array(values))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Plain texts of a language, about ``CHUNK_BYTES`` together; a longer text comes alone."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary())):
            plain = (text.as_py() or b"").translate(PLAIN)
            if len(plain) > CHUNK_BYTES:
                yield lang, [plain]
                continue
            if sizes.get(lang, 0) + len(plain) > CHUNK_BYTES:
                yield lang, held.pop(lang)
                sizes[lang] = 0
            held.setdefault(lang, []).append(plain)
            sizes[lang] = sizes.get(lang, 0) + len(plain)
        yield from held.items()


def _numbered(seed: int):
    schema = pa.schema([("words", pa.list_(pa.int64())), ("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def counted(lexicons: dict[str, _Lexicon]) -> Iterator[pa.RecordBatch]:
        for lang, lexicon in lexicons.items():
            words = [w.decode() for w in lexicon.places]
            for k in range(2, len(words), SENT_AT_ONCE):
                some = slice(k, k + SENT_AT_ONCE)
                part = words[some]
                yield rows({"lang": [lang] * len(part), "word": part, "hash": lexicon.hashes[some], "n": lexicon.counts[some]})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons: dict[str, _Lexicon] = {}
        size = 0
        for lang, texts in _chunks(batches):
            if lang not in lexicons:
                lexicons[lang] = _Lexicon(lang, seed)
            yield rows({"words": lexicons[lang].lists(texts)})
            size += sum(map(len, texts))
            if size > 8 * CHUNK_BYTES:
                yield from counted(lexicons)
                lexicons, size = {}, 0
        yield from counted(lexicons)

    return numbered


def _numbered_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``texts (words)`` as arrays of word hashes, and ``words (lang, word, hash, n)``.

    Hashes are those of language and word together. A frequent word has a hash of its own: else another seed is taken.
    """
    schema, seed = "words array<bigint>, lang string, word string, hash bigint, n bigint", 1
    while True:
        found = written(docs.mapInArrow(_numbered(seed), schema), "numbered-texts")
        words = found.filter("word is not null").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
        words = written(words, "words")
        of_hash = words.groupBy("hash").agg(F.count("*").alias("names"), F.max("n").alias("n"))
        if of_hash.filter((F.col("names") > 1) & (F.col("n") >= least)).isEmpty():
            return found.filter("words is not null").select("words"), words
        seed += 1


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """The words of all texts of a batch in a row, with the end of a piece before each text."""
    lists = batch.column("words")
    values, ends = lists.flatten().to_numpy(), np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)
    return np.insert(values, np.concatenate([[0], ends[:-1]]) if len(ends) else [], 0)


def _windows(batch: pa.RecordBatch, span: int) -> Iterator[np.ndarray]:
    """The same in parts of bounded size; every run of ``span`` words is whole in exactly one of them."""
    words = _flat(batch)
    for start in range(0, len(words), WINDOW):
        yield words[start : start + WINDOW + span - 1]


class _Counts:
    """Counts by key, of which few are held at a time."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether it is time to send them on."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        return self.held > HELD_COUNTS

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), dtype=np.int64)
        np.add.at(counts, where, np.concatenate(self.counts))
        self.__init__()
        return keys, counts


def _phrase_rows(phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """``(words, n)`` from a table with a row of word hashes for each phrase."""
    ends = np.arange(0, phrases.size + 1, phrases.shape[1], dtype=np.int32)
    words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(phrases).ravel()))
    return pa.RecordBatch.from_arrays([words, pa.array(counts)], ["words", "n"])


def _word_filter(frequent: DataFrame) -> np.ndarray:
    """A table of bits that are set for the low bits of the frequent words' hashes."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    cells = frequent.select(F.shiftright(slot, 6).alias("cell"), bit.alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^18 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as the largest needs, those of equal weight together, compressed."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return np.array([len(numbers), width], dtype="<i8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(block: bytes) -> np.ndarray:
    n, width = np.frombuffer(block, dtype="<i8", count=2).tolist()
    planes = pa.decompress(block[16:], n * width, "zstd", asbytes=True)
    return np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def _merged(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, with the sum of its counts."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(first) else order
    return first[starts], second[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


PAIR_BLOCK = "part int, words binary, heads binary, runs binary, tails binary, counts binary"


def _places(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Places of words among the common ones, which ascend; -1 for others."""
    at = np.searchsorted(common, words)
    return np.where(np.append(common, 0)[at] == words, at, -1) if len(common) else np.full(len(words), -1)


def _pair_blocks(first: np.ndarray, second: np.ndarray, counts: np.ndarray, common: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part of merged pairs: the places of first words, how many pairs each begins, the places of second ones, counts.

    Places go on from the common words to those of the block's own.
    """
    name = mix(first.view(np.uint64) + (mix(second.view(np.uint64)) & np.uint64(SPREAD - 1)))
    part = (name % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    first, second, counts = first[order], second[order], counts[order]
    heads, tails = _places(first, common), _places(second, common)
    ends = [0, *(1 + np.flatnonzero(np.diff(part[order]))).tolist(), len(order)]
    rows = []
    for some in map(slice, ends, ends[1:]):
        at = np.stack([heads[some], tails[some]])
        own, inverse = np.unique(np.stack([first[some], second[some]])[at < 0], return_inverse=True)
        at[at < 0] = len(common) + inverse
        starts = np.flatnonzero(np.concatenate([[True], np.diff(at[0]) != 0]))
        runs = np.diff(np.concatenate([starts, [at.shape[1]]]))
        rows.append((int(part[order[some.start]]), own.tobytes(), *map(_packed, (at[0][starts], runs, at[1], counts[some]))))
    kinds = [pa.int32()] + [pa.binary()] * 5
    names = [c.split()[0] for c in PAIR_BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _common_words(frequent: DataFrame) -> np.ndarray:
    """The hashes of the most frequent words, ascending: they have numbers that all tasks know."""
    found = frequent.orderBy(F.desc("n"), "hash").limit(COMMON_WORDS).select("hash").toArrow()
    return np.sort(found.column("hash").to_numpy())


def _pairs(frequent, common, parts: int):
    """Adjacent words that both pass the filter, in blocks."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words in (w for batch in batches for w in _windows(batch, 2)):
            good = frequent.value[words & ((1 << FILTER_BITS) - 1)] & (words != 0)
            at = np.flatnonzero(good[:-1] & good[1:])
            known, places = np.unique(words[np.concatenate([at, at + 1])], return_inverse=True)
            keys, counts = np.unique(places[: len(at)] * len(known) + places[len(at) :], return_counts=True)
            if len(keys):
                held.append((known[keys // len(known)], known[keys % len(known)], counts))
                size += len(keys)
            if size > HELD_COUNTS:
                held = [_merged(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD_COUNTS // 2:
                    yield _pair_blocks(*held[0], common.value, parts)
                    held, size = [], 0
        if held:
            yield _pair_blocks(*_merged(*map(np.concatenate, zip(*held))), common.value, parts)

    return pairs


def _frequent_pairs(common, least: int):
    """The frequent pairs of a part, from all its blocks."""

    def frequent(blocks: pa.Table) -> pa.Table:
        known = len(common.value)

        def words(places: np.ndarray, own: np.ndarray) -> np.ndarray:
            found = np.empty(len(places), dtype=np.int64)
            shared = places < known
            found[shared], found[~shared] = common.value[places[shared]], own[places[~shared] - known]
            return found

        firsts, seconds, counts = [], [], []
        for own, heads, runs, tails, n in zip(*(blocks.column(c).to_pylist() for c in ("words", "heads", "runs", "tails", "counts"))):
            own = np.frombuffer(own, dtype=np.int64)
            firsts.append(np.repeat(words(_unpacked(heads), own), _unpacked(runs)))
            seconds.append(words(_unpacked(tails), own))
            counts.append(_unpacked(n))
        first, second, n = _merged(*map(np.concatenate, (firsts, seconds, counts)))
        often = n >= least
        return pa.Table.from_batches([_phrase_rows(np.stack([first[often], second[often]], axis=1), n[often])])

    return frequent


class PhraseTrie:
    """Double-array trie of phrases of one length, whose words are 64-bit numbers.

    The child of state ``s`` by the word with code ``c`` is ``base[s] + c`` if ``check`` there says ``s``; codes begin at 1,
    and the root's children are the codes themselves.
    """

    def __init__(self, phrases: np.ndarray, leads: np.ndarray):
        """``phrases``: a row of words each; ``leads``: whether candidates that begin with the phrase belong to this trie."""
        order = np.lexsort(phrases.T[::-1])
        self.phrases, self.leads = phrases[order], leads[order]
        self.words = np.unique(phrases)
        self.length = phrases.shape[1]
        codes = (np.searchsorted(self.words, self.phrases) + 1).astype(np.int64)
        n_words = len(self.words)
        self._grow(2 * (n_words + len(phrases) * (self.length - 1)) + 2, fresh=True)
        state = codes[:, 0].copy()
        self.check[np.unique(state)] = 0
        self._used[: n_words + 1] = True
        for depth in range(1, self.length):
            state = self._add_level(state, codes[:, depth])
        self.phrase_of = np.full(len(self.check), -1, dtype=np.int64)
        self.phrase_of[state] = np.arange(len(phrases))
        del self._used
        self._number_slots()

    def _grow(self, size: int, fresh: bool = False) -> None:
        old = 0 if fresh else len(self.check)
        parts = {"base": (0, np.int64), "check": (-1, np.int64), "_used": (False, bool)}
        for name, (value, kind) in parts.items():
            grown = np.full(size, value, dtype=kind)
            if old:
                grown[:old] = getattr(self, name)
            setattr(self, name, grown)

    def _add_level(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places for the children of ``parents`` by ``codes``; the state of each phrase afterwards."""
        edges, edge_of = np.unique(np.stack([parents, codes], axis=1), axis=0, return_inverse=True)
        edge_of = edge_of.ravel()
        starts = np.flatnonzero(np.concatenate([[True], np.diff(edges[:, 0]) != 0]))
        sizes = np.diff(np.concatenate([starts, [len(edges)]]))
        places = np.zeros(len(edges), dtype=np.int64)
        for k in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")].tolist():
            children = edges[starts[k] : starts[k] + sizes[k], 1]
            places[starts[k] : starts[k] + sizes[k]] = self._room(children - children[0])
        single = starts[sizes == 1]
        free = np.flatnonzero(~self._used)
        if len(free) < len(single):
            self._grow(len(self._used) + 2 * len(single))
            free = np.flatnonzero(~self._used)
        places[single] = free[: len(single)]
        self._used[places] = True
        self.check[places] = edges[:, 0]
        self.base[edges[:, 0]] = places - edges[:, 1]
        return places[edge_of]

    def _room(self, steps: np.ndarray) -> np.ndarray:
        """The first free places that lie ``steps`` apart; they are taken."""
        while True:
            if not hasattr(self, "_from") or self._from >= len(self._used):
                self._from = 0
            limit = len(self._used) - int(steps[-1])
            start = self._from
            while start < limit:
                stop = min(start + 4096, limit)
                firsts = start + np.flatnonzero(~self._used[start:stop])
                for step in steps[1:]:
                    if not len(firsts):
                        break
                    firsts = firsts[~self._used[firsts + step]]
                if len(firsts):
                    found = firsts[0] + steps
                    self._used[found] = True
                    # Search goes on from a little below: the room before is nearly full.
                    self._from = max(self._from, start - 4096)
                    return found
                start = stop
            self._grow(2 * len(self._used) + int(steps[-1]))

    def _number_slots(self) -> None:
        """A slot for each candidate: a leading phrase, and one that begins with all its words but the first."""
        n, inner = len(self.phrases), self.length - 1
        both = np.concatenate([self.phrases[:, 1:], self.phrases[:, :inner]])
        _, name = np.unique(both, axis=0, return_inverse=True)
        name = name.ravel()
        after, before = name[:n], name[n:]  # `before` ascends as the phrases do
        self.first_next = np.searchsorted(before, after, side="left")
        n_next = np.where(self.leads, np.searchsorted(before, after, side="right") - self.first_next, 0)
        self.first_slot = np.concatenate([[0], np.cumsum(n_next)])

    def positions(self, words: np.ndarray) -> np.ndarray:
        """For every position the number of the phrase that begins there, or -1: all states advance together."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        code = np.where(self.words[at] == words, at + 1, 0)
        code = np.concatenate([code, np.zeros(self.length, dtype=np.int64)])
        alive = np.flatnonzero(code)
        state = code[alive]
        for depth in range(1, self.length):
            step = code[alive + depth]
            to = np.clip(self.base[state] + step, 0, len(self.check) - 1)
            good = (step > 0) & (self.check[to] == state)
            alive, state = alive[good], to[good]
        found = np.full(len(words) + 1, -1, dtype=np.int64)
        phrase = self.phrase_of[state]
        found[alive[phrase >= 0]] = phrase[phrase >= 0]
        return found

    def candidate_slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of every candidate's occurrence."""
        found = self.positions(words)
        at = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0))
        at = at[self.leads[found[at]]]
        return self.first_slot[found[at]] + found[at + 1] - self.first_next[found[at]]

    def counted(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots that occur and how often: as a plain vector where there are few slots."""
        slots = self.candidate_slots(words)
        if self.first_slot[-1] > DENSE_SLOTS:
            return np.unique(slots, return_counts=True)
        counts = np.bincount(slots, minlength=1)
        return np.flatnonzero(counts), counts[counts > 0]

    def candidates(self, slots: np.ndarray) -> np.ndarray:
        """The words of the candidates with these slots."""
        lead = np.searchsorted(self.first_slot, slots, side="right") - 1
        follow = self.first_next[lead] + slots - self.first_slot[lead]
        return np.concatenate([self.phrases[lead], self.phrases[follow][:, -1:]], axis=1)


SLOT_BLOCK = "part int, slots binary, counts binary"


def _slot_blocks(slots: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part of ascending slots: the steps from one to the next, and the counts."""
    part = slots % parts
    order = np.argsort(part, kind="stable")
    rows = []
    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
        steps = np.diff(slots[some] // parts, prepend=0)
        rows.append((int(part[some[0]]), _packed(steps), _packed(counts[some])))
    kinds = [pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((), (), ()), kinds)], ["part", "slots", "counts"])


def _longer(trie, parts: int):
    """Slots of candidates one word longer than the phrases of the trie, in blocks: a number travels, not the words."""

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for words in (w for batch in batches for w in _windows(batch, trie.value.length + 1)):
            if held.add(*trie.value.counted(words)):
                merged = held.taken()
                if len(merged[0]) > HELD_COUNTS // 2:
                    yield _slot_blocks(*merged, parts)
                else:
                    held.add(*merged)
        yield _slot_blocks(*held.taken(), parts)

    return longer


def _frequent_slots(trie, parts: int, least: int):
    """The words of the frequent slots of a part, from all its blocks."""

    def frequent(blocks: pa.Table) -> pa.Table:
        part = blocks.column("part")[0].as_py()
        held = _Counts()
        for slots, n in zip(blocks.column("slots").to_pylist(), blocks.column("counts").to_pylist()):
            held.add(np.cumsum(_unpacked(slots)) * parts + part, _unpacked(n))
        slots, n = held.taken()
        often = n >= least
        return pa.Table.from_batches([_phrase_rows(trie.value.candidates(slots[often]), n[often])])

    return frequent


def _tries(phrases: DataFrame, length: int, most: int) -> Iterator[PhraseTrie]:
    """Tries of the phrases, each of ``most`` phrases or so, which pass the driver one after the other."""
    tries = -(-2 * phrases.count() // most)
    if not tries:
        return
    shard = lambda words: F.pmod(F.xxhash64(words), F.lit(tries))
    inner = length - 1
    leads, follows = shard(F.slice("words", 2, inner)), shard(F.slice("words", 1, inner))
    dealt = phrases.select("words", leads.alias("leads"), follows.alias("follows"))
    for k in range(tries):
        part = dealt.filter((F.col("leads") == k) | (F.col("follows") == k)).toArrow()
        if part.num_rows:
            words = part.column("words").combine_chunks().flatten().to_numpy().reshape(-1, length)
            yield PhraseTrie(words, part.column("leads").to_numpy() == k)


def frequent_phrases(
    texts: DataFrame, frequent_words: DataFrame, options: PhraseOptions, trie_phrases: int = TRIE_PHRASES
) -> list[DataFrame]:
    """``(words, n)`` of the frequent phrases of 2 words, 3 words and so on."""
    spark, least = texts.sparkSession, options.least_count
    context, schema = spark.sparkContext, "words array<bigint>, n bigint"
    # Parts of a bounded size each: an occurrence gives a task one pair and one slot to send at most.
    occurrences = frequent_words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), occurrences // PART_WORDS)

    common = context.broadcast(_common_words(frequent_words))
    blocks = texts.mapInArrow(_pairs(context.broadcast(_word_filter(frequent_words)), common, parts), PAIR_BLOCK)
    levels = [written(blocks.groupBy("part").applyInArrow(_frequent_pairs(common, least), schema), "frequent-phrases")]
    for length in range(2, options.longest):
        # One trie at a time is in memory; its frequent candidates, which no other trie has, are written before the next is built.
        found = []
        for trie in _tries(levels[-1], length, trie_phrases):
            shared = context.broadcast(trie)
            blocks = texts.mapInArrow(_longer(shared, parts), SLOT_BLOCK)
            found.append(written(blocks.groupBy("part").applyInArrow(_frequent_slots(shared, parts, least), schema), "frequent-phrases"))
            shared.destroy()
        if not found:
            break
        levels.append(reduce(DataFrame.unionByName, found))
    return levels


def _cut_scores(phrases: DataFrame, counts: DataFrame, totals: DataFrame, options: PhraseOptions) -> DataFrame:
    """``phrases (words, a, lang)`` with ``l``, ``r``, ``n`` and ``score`` of their lowest-scoring cut."""
    size = F.size("words")
    cuts = phrases.select("words", "a", "lang", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", 1, F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    lefts = counts.select(F.col("words").alias("left"), F.col("n").alias("l"))
    rights = counts.select(F.col("words").alias("right"), F.col("n").alias("r"))
    # A join counts its keys first, so each step is written before the next reads it twice.
    cuts = written(cuts, "phrase-cuts")
    cuts = written(salted_join(cuts, lefts, "left").drop("left"), "phrase-cuts")
    cuts = written(salted_join(cuts, rights, "right").drop("right"), "phrase-cuts")
    cuts = salted_join(cuts, totals, "lang")
    whole = F.lit(1000).cast("decimal(4,0)") * (F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    parts = F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    cuts = cuts.withColumns({"_whole": whole.cast("decimal(38,0)"), "_parts": parts.cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("_whole div _parts"))
    lowest = F.min(F.struct("score", "k", "l", "r", "n", "lang", "a")).alias("cut")
    return cuts.groupBy("words").agg(lowest).select("words", "cut.lang", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def _absorbed(phrases: DataFrame, options: PhraseOptions) -> DataFrame:
    """``words`` of the phrases inside a longer one that is found in enough of their places."""
    size = F.size("words")
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m)),
        )
    )
    longer = phrases.filter(size > 2).select("a", F.explode(inside).alias("words"))
    most = longer.groupBy("words").agg(F.max("a").alias("around"))
    found = phrases.join(most, "words").filter(F.lit(100) * F.col("around") >= F.lit(options.absorbed) * F.col("a"))
    return found.select("words")


def _spelled(scored: DataFrame, frequent_words: DataFrame) -> DataFrame:
    """The phrase of each row of word hashes, joined by spaces."""
    spread = written(scored.select("words", F.posexplode("words").alias("place", "hash")), "phrase-words")
    named = salted_join(spread, frequent_words.select("hash", "word"), "hash")
    in_order = F.array_sort(F.collect_list(F.struct("place", "word")))
    phrase = F.array_join(F.transform(in_order, lambda x: x["word"]), " ")
    return scored.join(named.groupBy("words").agg(phrase.alias("phrase")), "words")


def collocations(
    docs: DataFrame, options: PhraseOptions = PhraseOptions(), text_column: str = "text", lang_column: str = "lang",
    trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases of each language whose words occur together most.

    A-Z are lower-cased, ``[.,;:!?]`` and line ends separate pieces, spaces and tabs separate words. A candidate is a run of 2 to
    ``longest`` words found ``least_count`` times (``a``) within pieces of texts of a language, of whose ``n`` words
    each occurrence counts. Cut in two parts found ``l`` and ``r`` times it scores ``floor(1000 a n / (l r))``, and the cut
    with the lowest score counts, on ties the first. Candidates inside a longer one that is found in ``absorbed`` percent of
    their places go, whether or not the longer one goes as well. Each language keeps its ``best`` by score, ``a``,
    both descending, and phrase.

    Null texts are empty, null languages are ``und``. Repeated rows count each for itself. An empty table, or one without frequent
    phrases, gives no rows. Other columns, whatever their names, are not read. Products are exact up to 38 digits; beyond
    that the query fails. Words are named by 64-bit hashes, checked to be unlike for frequent words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared_dir(spark)
    rows = docs.select(
        F.coalesce(F.col(lang_column), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    with set_to(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE), shuffles_dropped(spark):
        texts, words = _numbered_words(rows, options.least_count)
        totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = written(words.filter(F.col("n") >= options.least_count), "frequent-words")
        levels = frequent_phrases(texts, frequent, options, trie_phrases)
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    langs = frequent.select(F.col("hash").alias("_first"), "lang")
    named = salted_join(phrases.withColumn("_first", F.col("words")[0]), langs, "_first")
    named = written(named.select("words", F.col("n").alias("a"), "lang"), "candidates")
    counts = frequent.select(F.array("hash").alias("words"), "n").unionByName(phrases)
    scored = _cut_scores(named, counts, totals, options)
    scored = written(scored.join(_absorbed(named, options), "words", "left_anti"), "scored-phrases")
    best_first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _spelled(scored, frequent).withColumn("rank", F.row_number().over(best_first).cast("bigint"))
    return ranked.filter(F.col("rank") <= options.best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
