"""Token ids of whole texts, by the tokenizers library.

``WordEncoder`` gives the ids that encoding the whole text gives, but asks the library for each
distinct word once.  This is exact for tokenizers that normalise character by character (or by
NFC), replace white space and never let a token cross it, as word_bpe_49k does: ASCII white space
neither composes with its neighbours nor is part of a token.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

#: Words whose ids a worker keeps; when there are more, it starts anew.
CACHE_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LETTER, _UPPER, _BLANK, _STOP = (np.zeros(256, np.uint8) for _ in range(4))
_LETTER[list(range(65, 91)) + list(range(97, 123))] = 1
_UPPER[65:91] = 32
_BLANK[[32, 9, 10, 11, 12, 13]] = 1
_STOP[[44, 46]] = 1


def _simpler(texts: pa.Array) -> pa.Array:
    """The texts with fewer distinct words and the same ids.

    A-Z is folded where the next byte is ASCII too, as no combining mark follows then.  A full stop or
    comma between an ASCII letter and a blank is a token of its own, so it becomes a word of its own.
    Texts that may hold a special token's string stay as they are."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return texts
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return texts
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if b"<|" in raw.tobytes():
        return texts
    after = np.append(raw[1:], np.uint8(255))
    ends = at[1:][at[1:] > at[:-1]] - 1  # the last byte of each text: nothing follows it
    after[ends] = 32
    folded = raw + _UPPER[raw] * (after < 128)
    cut = np.flatnonzero(_STOP[raw[1:]] & _LETTER[raw[:-1]] & _BLANK[after[1:]]) + 1
    cut = cut[~np.isin(cut, at)]  # not across two texts
    out = np.insert(folded, cut, 32)
    at = at + np.searchsorted(cut, at, "left")
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(out)])


def _flat(encodings: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(x.ids for x in encodings), np.uint32)


class WordEncoder:
    def __init__(self, path: str, end_id: int | None = 1, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.cache_words = Tokenizer.from_file(path), end_id, cache_words
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = self._ends()
        self.ascii = self._ascii_words(path)
        self.clear()

    def _ends(self) -> np.ndarray | None:
        """Whether an id ends a word; None for a tokenizer without word-end marks."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        ends = np.zeros(self.vocabulary, bool)
        ends[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        return ends

    def _ascii_words(self, path: str):
        """The same model for words of a-z alone, without what leaves them as they are: normalising them and
        looking for pieces in them.  None unless runs of letters are pieces and letters stand for themselves."""
        from tokenizers import Tokenizer, pre_tokenizers

        config = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        steps = config.get("pretokenizers", [config])
        if self.ends is None or [x.get("type") for x in steps] != ["Split", "ByteLevel"] or "[\\p{L}]+" not in str(steps[0]["pattern"].get("Regex")) or steps[1]["add_prefix_space"]:
            return None
        plain = Tokenizer.from_file(path)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return plain

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        end = [] if self.end_id is None else [self.end_id]
        self.flat, self.used = np.zeros(1 << 21, np.uint32), len(end)
        self.flat[: len(end)] = end
        self.start, self.length, self.n = np.zeros(self.cache_words + 1, np.int32), np.zeros(self.cache_words + 1, np.int32), 1
        self.length[0] = len(end)  # entry 0: the end id

    def _groups(self, new: list[bytes]):
        """The new words by how they are encoded: words, their flat ids, their numbers of ids.

        Words of letters alone are one piece each, and a piece's last id carries the word-end mark, so many
        of them share a call as one text; if the marks don't number the words, each is encoded by itself."""
        alone: list[str] = []
        plain: tuple[list[str], list[str]] = ([], [])
        for word in map(bytes.decode, new):
            if self.ends is None or not word.isalpha():
                alone.append(word)
            else:
                plain[bool(self.ascii) and word.isascii() and word.islower()].append(word)
        for group, tokenizer in zip(plain, (self.tokenizer, self.ascii), strict=True):
            if group:
                texts = [" ".join(group[k : k + 256]) for k in range(0, len(group), 256)]
                ids = _flat(tokenizer.encode_batch_fast(texts, add_special_tokens=False))
                last = np.flatnonzero(self.ends[ids])
                if last.size == len(group):
                    yield group, ids, np.diff(last, prepend=-1)
                else:
                    alone += group
        if alone:
            got = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
            yield alone, _flat(got), np.fromiter(map(len, got), np.int64, len(got))

    def _add(self, new: list[bytes]) -> None:
        groups = list(self._groups(new))
        new = [w.encode() for group, _, _ in groups for w in group]
        got, size = np.concatenate([g[1] for g in groups]), np.concatenate([g[2] for g in groups])
        n, m = self.n, self.n + len(new)
        if m > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * m), np.resize(self.length, 2 * m)
        while self.used + len(got) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.start[n:m], self.length[n:m] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : self.used + len(got)] = got
        self.place.update(zip(new, range(n, m), strict=True))
        self.n, self.used = m, self.used + len(got)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after the other, and where each text begins (one more for the end)."""
        w = words.split(_simpler(texts))
        distinct = w.distinct.to_pylist()
        if len(self.place) + len(distinct) > self.cache_words:
            self.clear()
        found = list(map(self.place.get, distinct))
        if missing := [i for i, x in enumerate(found) if x is None]:
            self._add([distinct[i] for i in missing])
            for i in missing:
                found[i] = self.place[distinct[i]]
        place = np.array(found, np.int32)
        n_docs, n_words = len(w.offsets) - 1, len(w.codes)
        entry = np.zeros(n_words + n_docs, np.int32)  # the end id stands after each text's words
        is_end = np.zeros(n_words + n_docs, bool)
        is_end[w.offsets[1:] + np.arange(n_docs)] = True
        entry[~is_end] = place[w.codes]
        length = self.length[entry]
        before = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        # The flat place of each id: the word's start, minus the ids before the word, plus the id's own number.
        source = np.repeat((self.start[entry] - before[:-1]).astype(np.int32), length)
        source += np.arange(before[-1], dtype=np.int32)
        return self.flat[source], before[w.offsets + np.arange(n_docs + 1)]


_ENCODERS: dict[tuple[str, int | None], WordEncoder] = {}


def encoder(path: str, end_id: int | None = 1, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One encoder for each Python worker; its cache lasts from task to task."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id, cache_words)
    found = _ENCODERS[path, end_id]
    if found.cache_words != cache_words:
        found.cache_words = cache_words
        found.clear()
    return found


def blobs(ids: np.ndarray, at: np.ndarray, dtype: str = "<u4") -> pa.Array:
    """Binary values, one for each stretch ``ids[at[i]:at[i + 1]]``, little-endian."""
    data = np.ascontiguousarray(ids[at[0] : at[-1]], dtype=dtype)
    size = data.dtype.itemsize
    offsets = ((at - at[0]) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
