"""Token ids of whole texts by the tokenizers library, with the ids of words seen kept in the worker.

Both files split texts into words before merging, and a word's ids do not depend on its neighbours, so
texts are cut before single spaces and line ends.  The distinct words of a few megabytes of text are found by Arrow's
dictionary encoding, their ids are laid out by numpy, and only words that are new to the worker go through the library:
straight to its merges if they are letters of Latin-1 only, else through all its steps.  A word with ASCII
marks at its end is the word and those marks.
Texts where such a cut is not safe (runs of white space, white space at an end) are encoded whole.
Texts that hold the string of a special token are encoded whole as well: the library takes it out first.
"""

from __future__ import annotations

import gc
import os
from string import punctuation

import numpy as np
import pyarrow as pa

from .wordpiece import byte_letters

_LETTER = {b: c for c, b in byte_letters().items()}  # fixed values of byte-level vocabularies
_LATIN = {i: "".join(_LETTER[b] for b in chr(i).encode()) for i in range(256)}  # Latin-1 letters in them


BATCH = 1 << 22  #: characters of texts cut at once, or one text


class _Known(dict):
    """Ids of words; a word that is not there is learned at once if the codec can, else it stays out and gives None."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        ids = self.learn(key)
        if ids is not None:
            self[key] = ids
        return ids


class WordCodec:
    """``encode`` gives each text's ids as little-endian uint32 bytes."""

    def __init__(self, path: str, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # of words; texts that hold such tokens go another way
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every word comes to it once only
        # white space is dropped between words, or kept as the start of the next one
        self.spaces_kept = len(self.tokenizer.encode("a b", add_special_tokens=False).ids) != \
            len(self.tokenizer.encode("a  \n b", add_special_tokens=False).ids)
        self.limit = limit
        steps = self.tokenizer.normalizer
        self.lowers = steps is not None and steps.normalize_str("A") == "a"
        self.marks: dict[str, bytes] = {}
        self.newline = self._library(["x\nx"])[0][4:-4]  # a line end between words
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.known = _Known(self._learn)
        self.before: dict = {}  # known before ``known`` was begun anew

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marks(self, marks: str) -> bytes:
        """Ids of ASCII punctuation after a letter."""
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._library(["x" + marks])[0][4:]  # without the x
        return self.marks[marks]

    def _learn(self, key: str) -> bytes | None:
        """Ids of a word of Latin-1 letters and marks after them, or those known before; None for any other."""
        ids = self.before.get(key)
        if ids is not None:
            return ids
        stem = key.rstrip(punctuation)
        first = stem[:1]
        word = stem[1:] if first == " " or first == "\n" else stem
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0100"):
            return None
        if len(stem) < len(key):
            return self.known[stem] + self._marks(key[len(stem):])  # the word often stands by itself
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.translate(_LATIN)
        if self.spaces_kept and first == " ":
            word = _LETTER[32] + word
        id_bytes = self.id_bytes
        ids = b"".join([id_bytes[t.id] for t in self.tokenizer.model.tokenize(word)])
        return self.newline + ids if self.spaces_kept and first == "\n" else ids

    def _learn_others(self, keys: list[str]) -> None:
        """Adds what the library can encode by itself."""
        others = [k for k in keys if self._is_safe(k)]
        if others:
            self.known.update(zip(others, self._library(others), strict=True))

    def _is_safe(self, key: str) -> bool:
        """Whether a word has the same ids by itself as in its text."""
        if not self.spaces_kept:
            return True
        body = key[1:] if key[:1] in (" ", "\n") else key
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def _lowered(self, text: str) -> str:
        """A text as its words are looked up."""
        if self.lowers and not self.spaces_kept:  # in Latin-1, letter by letter: so it may be done at once
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return text

    def _words(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Number of each word of the texts in order, the distinct words, and the number of words before each text.

        A word has the space or line end before it.
        """
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(t) for t in raw], np.int64)
        is_first = (data == 32) | (data == 10)
        starts = np.cumsum(lengths) - lengths
        is_first[starts[lengths > 0]] = True
        first = np.flatnonzero(is_first)
        ends = np.append(first, len(data))
        strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        words = strings.dictionary.to_numpy(zero_copy_only=False).tolist()
        return strings.indices.to_numpy(), words, np.searchsorted(first, np.append(starts, len(data)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and collections would walk the known words
        try:
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < BATCH:
                    size += len(texts[end] or "")
                    end += 1
                out += self._encode(texts[at:end])
                at = end
        finally:
            if collecting:
                gc.enable()
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.before, self.known = self.known, _Known(self._learn)
        marked = [i for i, t in enumerate(texts) if t and any(s in t for s in self.special)]
        left_out = set(marked)
        numbers, words, before = self._words([self._lowered(t) if t and i not in left_out else "" for i, t in enumerate(texts)])
        found = list(map(self.known.__getitem__, words))
        late = [j for j, ids in enumerate(found) if ids is None]
        self._learn_others([words[j] for j in late])
        for j in late:
            found[j] = self.known.get(words[j])
        unsafe = np.array([ids is None for ids in found], bool)
        found = [ids or b"" for ids in found]
        # the ids of all distinct words in one row, from which each word of the texts takes its own
        ids = np.frombuffer(b"".join(found), "<u4")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        taken = counts[numbers]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        short = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(counts) - counts)[numbers] - (ends - taken)).astype(short), taken)
        place += np.arange(total, dtype=short)
        laid = ids[place].tobytes()
        at = np.append(0, ends)[before] * 4
        out = [laid[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        whole = np.unique(np.searchsorted(before, np.flatnonzero(unsafe[numbers]), "right") - 1).tolist() if unsafe.any() else []
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        if marked:
            self.tokenizer.encode_special_tokens = False
            for i, ids in zip(marked, self._library([texts[i] for i in marked]), strict=True):
                out[i] = ids
            self.tokenizer.encode_special_tokens = True
        return out


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec of a file in a worker."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]
