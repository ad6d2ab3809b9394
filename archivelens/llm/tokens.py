"""Tokenising whole texts with public vocabularies, in Arrow batches on the executors.

Words repeat, so each worker keeps the ids of the words it has met and asks the tokenizers library
only for new ones; it forgets those first that it hasn't met for long. Texts are cut at single spaces, where both pre-tokenizers cut as well:

* ``spaced`` (byte-level): a space belongs to the word after it. A cut before a space is a token
  boundary unless white space stands on both sides of it; such texts are encoded whole.
* ``dropped`` (word ends): white space separates words and yields no ids.

The literal of an added token (``<|endoftext|>``) is that token, as in the library; texts that may hold
one are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words that a worker remembers (some 250 MB), that an idle one keeps (some 170 MB), and the longest
#: of them.
MEMORY, IDLE, LONGEST = 1_500_000, 1_000_000, 128
#: Marks that may follow a word.
MARKS = ".,;:!?*#$%&|)\"]}"
#: Bytes of text handled at once, here and by operators that need more room for each byte.
TEXTS, SLICE = 1 << 22, 1 << 20


def _letters(word: str, spaced: bool) -> bool:
    """Whether the word is letters only as the pre-tokenizer sees it, after normalising: a few letters
    come apart into a letter and a mark (\u0130 in lower case, \u0958 in composed form)."""
    return word.isalpha() and (spaced or word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class _Words(dict):
    """word -> its number, -1 for a word that isn't remembered; new words are noted with the owner.

    Both pre-tokenizers part a run of letters from the marks after it, so such words are put together
    from the two.
    """

    def __init__(self, owner: WordTokenizer, lead: str) -> None:
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> int:
        o = self.owner
        if len(word) > LONGEST or (o.spaced and (word != word.strip() or (not word and self.lead))):
            return -1
        before = o.past and o.past[bool(self.lead)].get(word, -1)
        if before is not None and before >= 0:
            self[word] = n = o.number()
            o.carried.append((n, before))
            return n
        bare = word.rstrip(MARKS)
        if bare != word and _letters(bare, o.spaced):
            pair = self[bare], o.head[word[len(bare) :]]
            self[word] = n = o.number()
            o.pairs.append((n, *pair))
        else:
            self[word] = n = o.number()
            (o.letters if word.isalpha() and self.lead == o.lead else o.others).append((n, self.lead + word))
        return n


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, on end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lens, lens)


class WordTokenizer:
    """ids of texts, equal to ``encode_batch(texts, add_special_tokens=False)``."""

    def __init__(self, path: str, spaced: bool) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: What texts with an added token in them have in common; words never hold one.
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(added) if added else None
        self.spaced, self.lead = spaced, " " if spaced else ""
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        # where words that are encoded together part: before a token with a space, after one that ends a word
        self.parts = np.array([n.startswith("\u0120") if spaced else n.endswith("</w>") for n in names])
        self.forget(True)

    def forget(self, all_words: bool = False) -> None:
        """Start a new generation of words; those of the one before are still at hand, older ones go."""
        self.past = None if all_words else (self.head, self.tail, self.flat, self.starts, self.lens)
        self.earlier = 0 if all_words else self.known
        self.known, self.carried = 0, []
        self.letters, self.others, self.pairs = [], [], []
        self.tail = _Words(self, self.lead)
        self.head = _Words(self, "") if self.spaced else self.tail
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def number(self) -> int:
        self.known += 1
        return self.known - 1

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers], self.lens[numbers] = self.used + np.cumsum(lens) - lens, lens
        self.used += len(ids)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def rest(self, idle: int) -> None:
        """Keep ``idle`` words at most, newer ones first."""
        if self.known + self.earlier > idle:
            self.past, self.earlier = None, 0
        if self.known > idle:
            self.forget(True)

    def _learn(self) -> None:
        while self.known > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        if self.carried:
            numbers, before = np.array(self.carried).T
            flat, starts, lens = self.past[2:]
            self._keep(numbers, flat[_runs(starts[before], lens[before])], lens[before])
            self.carried = []
        for k in range(0, len(self.letters), 4096):  # words of letters only, parted by spaces, go in one text
            numbers, words = zip(*self.letters[k : k + 4096], strict=True)
            ids, _ = self._ids([" ".join(words) if not self.lead else "".join(words)])
            at = np.flatnonzero(self.parts[ids])
            lens = np.diff(at, append=len(ids)) if self.lead else np.diff(at, prepend=-1)
            if len(at) != len(words) or lens.sum() != len(ids):
                ids, lens = self._ids(list(words))
            self._keep(np.array(numbers), ids, lens)
        if self.others:
            numbers, words = zip(*self.others, strict=True)
            self._keep(np.array(numbers), *self._ids(list(words)))
        if self.pairs:
            pairs = np.array(self.pairs)
            both = pairs[:, 1:].ravel()
            self._keep(pairs[:, 0], self._gather(both)[0], self.lens[both].reshape(-1, 2).sum(1))
        self.letters, self.others, self.pairs = [], [], []

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, on end, and where each word's begin (and the end)."""
        lens = self.lens[at]
        return self.flat[_runs(self.starts[at], lens)], np.concatenate([[0], np.cumsum(lens)])

    def encode(self, texts: pa.Array | list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, ``end_id`` after each, and the count for each text.

        Arrow cuts the texts into words and numbers the distinct ones, so each of these is looked up
        once for the batch.
        """
        if self.known > MEMORY // 2:
            self.forget()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        n = len(texts)
        whole = np.zeros(n, bool)
        if self.mark is not None:  # may hold an added token: encoded whole
            whole = pc.match_substring(texts, self.mark).to_numpy(zero_copy_only=False)
        parted = texts if self.spaced else pc.replace_substring(_folded(texts), "\n", " ")
        parted = pc.split_pattern(pc.if_else(pa.array(whole), "", parted), " ")
        edges = parted.offsets.to_numpy().astype(np.int64)
        coded = parted.values.slice(int(edges[0]) if n else 0, int(edges[-1] - edges[0]) if n else 0).dictionary_encode()
        edges -= edges[0] if n else 0
        place, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.spaced:
            first = np.zeros(len(place), bool)
            first[edges[:-1]] = True
            at = np.zeros(len(place), np.int64)
            for some, words in ((first, self.head), (~first, self.tail)):
                met, own = np.unique(place[some], return_inverse=True)
                at[some] = np.fromiter((words[names[i]] for i in met.tolist()), np.int64, len(met))[own]
        else:
            at = np.fromiter(map(self.tail.__getitem__, names), np.int64, len(names))[place]
        self._learn()
        odd = at < 0
        at[odd] = self.head[""]  # no ids
        self._learn()
        ids, bounds = self._gather(at)
        cuts = bounds[edges]
        whole[np.searchsorted(edges, np.flatnonzero(odd), "right") - 1] = True
        sizes, kept, encoded = np.diff(cuts), np.ones(len(ids), bool), {}
        for i in np.flatnonzero(whole).tolist():
            encoded[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            kept[cuts[i] : cuts[i + 1]] = False
            sizes[i] = len(encoded[i])
        sizes += 1
        ends = np.cumsum(sizes)
        out, free = np.full(int(ends[-1]) if n else 0, end_id, np.uint32), np.ones(int(ends[-1]) if n else 0, bool)
        free[ends - 1] = False
        for i, own in encoded.items():
            out[ends[i] - sizes[i] : ends[i] - 1] = own
            free[ends[i] - sizes[i] : ends[i] - 1] = False
        out[free] = ids[kept]
        return out, sizes


def _folded(texts: pa.Array) -> pa.Array:
    """The texts in lower case where that can't change their ids: the vocabulary of word ends normalises
    and lower-cases anyway, and for Latin-1 characters the two don't depend on order or context."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return texts
    beyond = np.flatnonzero(np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] > 0xC3)
    keep = np.zeros(len(texts), bool)
    keep[np.searchsorted(offsets - offsets[0], beyond, "right") - 1] = True
    return pc.if_else(pa.array(keep), texts, pc.utf8_lower(texts))


_LOADED: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """The worker's own tokenizer, kept between tasks."""
    if (path, spaced) not in _LOADED:
        _LOADED[path, spaced] = WordTokenizer(path, spaced)
    return _LOADED[path, spaced]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds much more than ``most`` bytes of ``column``."""
    lens = _sizes(batch.column(column))
    start, total = 0, 0
    for i, n in enumerate(lens.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def binary_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose values are the bytes of consecutive runs of ``flat``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def tokenize(docs: DataFrame, path: str, spaced: bool, end_id: int, tally: int = 0, idle: int = IDLE) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of each whole text with ``end_id`` after them.

    ``ids`` is the bytes of little-endian unsigned 16-bit integers, since both vocabularies have
    fewer than 65,536 ids. A null text counts as empty and gives the end id alone; a null doc_id is
    kept; other columns are left out; equal rows give equal rows; an empty table an empty one.

    With ``tally`` (the vocabulary's size) there is a column ``tally`` as well: one more row for each
    task, null in the other columns, has how often each id occurred in it (64-bit integers). A worker
    keeps its words for the next task if they are at most ``idle``.
    """
    names = ["doc_id", "n_tokens", "ids", *(["tally"] if tally else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = tokenizer(path, spaced)
        seen = np.zeros(tally, np.int64)
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                ids, counts = own.encode(part.column("text"), end_id)
                row = [part.column("doc_id"), pa.array(counts), binary_column(ids.astype("<u2"), counts)]
                if tally:
                    seen += np.bincount(ids, minlength=tally)
                    row.append(pa.nulls(len(counts), pa.binary()))
                yield pa.RecordBatch.from_arrays(row, names)
        if seen.any():
            nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([seen.tobytes()], pa.binary())], names)
        own.rest(idle)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary" + ", tally binary" * bool(tally))
