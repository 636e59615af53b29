"""Token ids of many texts, each distinct word encoded once per worker.

Where a vocabulary drops white space and lets no token span it, a text's ids are those of its words
in order. So the tokenizers library encodes the new words of a batch, and NumPy puts the ids of known words together.
A vocabulary that does not work that way, as ``PROBES`` tell, has its texts encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 800_000  # remembered per worker: bounds memory, not results
BATCH_BYTES = 4 << 20
PUNCTUATION = ".,;:!?-)(\"'*#%$&|<>/[]{}=+_~`^@\\"
#: Words in capitals and small letters, with accents, marks, digits and signs of several kinds.
PROBES = "Word wORD wordy, it's O'CLOCK 'LL don't. (a) x=1 3.14 A1b2 na\u00efve \u00dcBER \u00e9\u0301 \u0130stanbul \u0130. a\u0130' \u65e5\u672c\u8a9e\u3002 \u2460 \U0001f600! <b> #a_b 50% --"


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()


class WordTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.size, dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.letters: set[str] = set()  # beyond ASCII, whose normal form is letters only; no more than there are characters
        self._forget()
        self.by_words = self._goes_by_words()

    def _goes_by_words(self) -> bool:
        """Whether words give the ids of the whole text, whatever white space is between them."""
        self.by_words = True
        texts = [PROBES, PROBES.replace(" ", "\n"), "\t " + PROBES.replace(" ", " \x0b ") + "\r\n"]
        texts += [PROBES.lower(), " ".join(reversed(PROBES.split(" ")))]
        ids, bounds = self.encode([t.encode() for t in texts])
        found = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        return found == self._encoded(texts)

    def _letters_only(self, core: str) -> bool:
        """Whether the vocabulary too sees only letters: a lower-cased letter may bring a mark that goes with what follows."""
        if core.isascii() or not core.isalpha():
            return core.isalpha()
        if not self.letters.issuperset(core):
            normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
            self.letters.update(c for c in set(core) if normal(c).isalpha())
        return self.letters.issuperset(core)

    def _letters(self, cores: pa.Array) -> np.ndarray:
        """``_letters_only`` of all cores at once: only those beyond ASCII are looked at one by one."""
        letters = pc.ascii_is_alpha(cores).to_numpy(zero_copy_only=False)
        beyond = np.flatnonzero(~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False))
        letters[beyond] = [self._letters_only(core) for core in _strings(cores.take(pa.array(beyond)))]
        return letters

    def _forget(self) -> None:
        # A word is two pieces: its letters and what follows them. Piece 0 is empty.
        self.places: dict[str, int] = {}
        self.parts = np.zeros((0, 2), dtype=np.int32)
        self.used = np.zeros(0, dtype=bool)  # whether a word was seen again after it was learned
        self.pieces: dict[str, int] = {"": 0}
        self.starts, self.lengths = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, letters: list[str], others: list[str]) -> None:
        """Pieces of letters only fit many in one call, as the ids of word ends part them; others are encoded alone."""
        ids, lengths = [], []
        for k in range(0, len(letters), 500):
            some = letters[k : k + 500]
            found = np.array(self._encoded([" ".join(some)])[0], dtype=np.uint32)
            ends = np.flatnonzero(self.ends[found]) + 1
            # Should some word give more pieces than one, each is encoded alone.
            if len(ends) != len(some):
                alone = self._encoded(some)
                found = np.array([i for x in alone for i in x], dtype=np.uint32)
                ends = np.cumsum([len(x) for x in alone])
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        alone = self._encoded(others)
        ids.append(np.array([i for x in alone for i in x], dtype=np.uint32))
        lengths = np.concatenate([*lengths, [len(x) for x in alone]]).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *ids])
        for piece in [*letters, *others]:
            self.pieces[piece] = len(self.pieces)

    def _numbers(self, texts: list[str], letters: bool) -> np.ndarray:
        """The numbers of the pieces ``texts``; new ones are learned. A piece of letters is never looked up as another."""
        new = [x for x in texts if x not in self.pieces]
        self._learn_pieces(new if letters else [], [] if letters else new)
        return np.fromiter(map(self.pieces.__getitem__, texts), dtype=np.int32, count=len(texts))

    def _learn(self, words: list[str]) -> None:
        """``words`` are different and not known."""
        if len(self.places) + len(words) > MOST_WORDS and self.places:
            self._forget_unused(MOST_WORDS // 2)
            if len(self.places) + len(words) > MOST_WORDS:
                self._forget()
        texts = pa.array(words, pa.large_string())
        cores = pc.utf8_rtrim(texts, characters=PUNCTUATION)
        letters = self._letters(cores)
        first, parts = len(self.places), np.zeros((len(words), 2), dtype=np.int32)
        if letters.any():
            cores, whole = cores.filter(pa.array(letters)), texts.filter(pa.array(letters))
            ascii_only = pc.string_is_ascii(cores)
            named = pc.if_else(ascii_only, pc.ascii_lower(cores), cores).dictionary_encode()
            numbers = self._numbers(_strings(named.dictionary), True)
            parts[letters, 0] = numbers[named.indices.to_numpy()]
            sizes = (pc.binary_length(whole), pc.binary_length(cores))
            tailed = np.flatnonzero(pc.greater(*sizes).to_numpy(zero_copy_only=False))
            some = pa.array(tailed)
            tails = [text[len(core) :] for text, core in zip(_strings(whole.take(some)), _strings(cores.take(some)))]
            tails = pa.array(tails, pa.string()).dictionary_encode()
            numbers = self._numbers(_strings(tails.dictionary), False)
            parts[np.flatnonzero(letters)[tailed], 1] = numbers[tails.indices.to_numpy()]
        others = np.flatnonzero(~letters)
        parts[others, 0] = self._numbers(_strings(texts.take(pa.array(others))), False)
        self.parts = np.concatenate([self.parts, parts])
        self.used = np.concatenate([self.used, np.zeros(len(words), dtype=bool)])
        self.places.update(zip(words, range(first, first + len(words))))

    def _forget_unused(self, most: int) -> None:
        """Forget the words that were not seen again after they were learned; all, if still more than ``most`` are left."""
        kept = np.flatnonzero(self.used)
        if len(kept) > most:
            return self._forget()
        words = list(compress(self.places, self.used.tolist()))
        parts, starts, lengths, flat = self.parts[kept], self.starts, self.lengths, self.flat
        pieces, number = np.unique(parts, return_inverse=True)
        if not len(pieces) or pieces[0]:
            pieces, number = np.concatenate([[0], pieces]).astype(np.int64), number + 1
        wanted = np.zeros(len(starts), dtype=bool)
        wanted[pieces] = True
        names = list(compress(self.pieces, wanted.tolist()))  # in the order of their numbers
        self._forget()
        self.places, self.parts = dict(zip(words, range(len(words)))), number.reshape(-1, 2).astype(np.int32)
        self.used = np.zeros(len(words), dtype=bool)
        self.pieces, self.lengths = dict(zip(names, range(len(names)))), lengths[pieces]
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.flat = flat[np.arange(ends[-1]) + np.repeat(starts[pieces] - self.starts, self.lengths)]

    def _encoded_whole(self, texts: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        end = [] if end_id is None else [end_id]
        found = [ids + end for ids in self._encoded([text.decode() for text in texts])]
        ids = np.fromiter(chain.from_iterable(found), dtype=np.uint32)
        return ids, np.cumsum([0] + [len(x) for x in found])

    def _places(self, words: list[str]) -> np.ndarray:
        """The numbers of different words; those not seen before are learned."""
        places = np.fromiter(map(self.places.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        self.used[places[places >= 0]] = True
        missing = np.flatnonzero(places < 0).tolist()
        if not missing:
            return places
        known = len(self.places)
        unknown = [words[k] for k in missing]
        self._learn(unknown)
        if len(self.places) == known + len(unknown):
            places[missing] = np.arange(known, known + len(unknown))
            return places
        # Some of what was known before has just been forgotten.
        lost = [w for w in words if w not in self.places]
        if lost and len(self.places) + len(lost) > MOST_WORDS:
            self._forget()
            lost = words  # all in one, so that none is forgotten in between
        if lost:
            self._learn(lost)
        return np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin, with the total last."""
        if not self.by_words:
            return self._encoded_whole(texts, end_id)
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten()
        some = pc.greater(pc.binary_length(words), 0)  # nothing is before white space that a text begins with
        word_bounds = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
        words = words.filter(some).dictionary_encode()
        places = self._places(_strings(words.dictionary))
        pieces = self.parts[places].ravel()
        lengths = self.lengths[pieces]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[pieces] - (ends - lengths), lengths)]
        offsets = pa.array(np.concatenate([[0], ends[1::2]]), pa.int64())
        # The ids of each different word, copied to all its places.
        found = pa.LargeListArray.from_arrays(offsets, pa.array(ids)).take(words.indices)
        ids, bounds = found.flatten().to_numpy(), found.offsets.to_numpy()[word_bounds]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own copy; it outlives the task where Spark uses workers again."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def text_groups(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of the batch's texts (null: empty) of about ``most`` bytes, each with its first row."""
    texts = batch.column(column).cast(pa.large_binary())
    first, group, size = 0, [], 0
    for k in range(len(texts)):
        text = texts[k].as_py() or b""
        if group and size + len(text) > most:
            yield first, group
            first, group, size = k, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group
