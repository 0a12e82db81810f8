"""Whole-text encoding with a public vocabulary file of the ``tokenizers`` library.

The vocabulary's pre-tokenizer never makes a piece that crosses white space, so the ids of a text
are the ids of its chunks (split at spaces and newlines), one after another.  Most chunks recur, so
:class:`ChunkEncoder` remembers their ids and asks the library only for what it hasn't met, many
words in one call; words of plain ASCII letters go to its model at once.  Texts are lower-cased first and single full stops and commas set apart, which is
what the vocabulary's own normaliser and pre-tokenizer do.  Texts for which that isn't certain
(combining marks, letters with context-dependent lower case, runs of mixed punctuation) are split
less or go to the library as they are.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks longer than this are encoded but not remembered.
REMEMBERED_CHARS = 48
#: The memory has two generations of at most so many chunks: it doesn't grow with the corpus.
REMEMBERED = 400_000
#: Words that go to the library in one call.
WORDS_A_CALL = 64
#: Texts that are split together: at most so many, and so many bytes (a longer one goes alone).
TEXTS_AT_ONCE = 4096
BYTES_AT_ONCE = 4 << 20

_UNSAFE = re.compile("[İΣ̀-ͯ҃-҉֑-ׇؐ-ًؚ-ٰٟ-ऀ़़়଼्্੍ۭ࠙-࠭-࡛᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]")
_MIXED = re.compile(r"[.,][^\w\s]|[^\w\s][.,]|[.,]_|_[.,]")
#: A text of these bytes without these pairs has no run of punctuation; of other texts _MIXED is asked.
_PAIRS = ("..", ",,", ".,", ",.")
_ORDINARY = (string.ascii_letters + string.digits + string.whitespace + ".,").encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """``batch(texts)`` gives the numpy id array of every whole text (null: empty)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are Spark's to share out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_chunk = not any(a.get("lstrip") or a.get("rstrip") or " " in a["content"] for a in spec.get("added_tokens", []))
        suffix = spec["model"].get("end_of_word_suffix")
        lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        vocab = self.tokenizer.get_vocab()
        self.dtype = "<u2" if len(vocab) <= 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.plain = bool(suffix and lowers and self.by_chunk)
        if self.plain:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.chunks: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in encoded]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """ids of chunks that aren't remembered; remembers those that are short."""
        found = {c: self.before[c] for c in missing if c in self.before}
        missing = missing.difference(found)
        words = [c for c in missing if c.isalpha()] if self.plain else []
        odd = list(missing.difference(words))
        tokenize, code = self.tokenizer.model.tokenize, "H" if self.dtype == "<u2" else "I"
        for c in words:
            if c.isascii():  # neither the normaliser nor the pre-tokenizer changes a word of ASCII letters
                found[c] = array(code, [t.id for t in tokenize(c)]).tobytes()
        words = [c for c in words if not c.isascii()]
        found.update(zip(odd, self._each(odd), strict=True))
        groups = [words[i : i + WORDS_A_CALL] for i in range(0, len(words), WORDS_A_CALL)]
        for group, raw in zip(groups, self._each([" ".join(g) for g in groups]), strict=True):
            ids = np.frombuffer(raw, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                bounds = [0, *(cuts * ids.itemsize).tolist()]
                found.update((w, raw[i:j]) for w, i, j in zip(group, bounds, bounds[1:], strict=False))
            else:  # the normaliser cut a word in two
                found.update(zip(group, self._each(group), strict=True))
        if len(self.chunks) + len(found) > REMEMBERED:
            self.before, self.chunks = self.chunks, {"": b""}
        self.chunks.update((c, i) for c, i in found.items() if len(c) <= REMEMBERED_CHARS)
        return found

    def _spaced(self, text: str) -> str | None:
        """A text whose chunks lie between single spaces; None if the library must see it whole."""
        if not self.by_chunk or (not text.isascii() and _UNSAFE.search(text)):
            return None
        if self.plain:
            text = text.lower()
            doubtful = text.encode().translate(None, _ORDINARY) or any(pair in text for pair in _PAIRS)
            if not (doubtful and _MIXED.search(text)):
                text = text.replace(",", " , ").replace(".", " . ")
        return text.replace("\n", " ")

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        spaced = [self._spaced(t or "") for t in texts]
        split = pc.split_pattern(pa.array([t for t in spaced if t is not None], pa.large_string()), " ")
        chunks = split.values.dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [self.chunks.get(c) for c in names]
        missing = {c for c, raw in zip(names, known, strict=True) if raw is None}
        if missing:
            fresh = self._learn(missing)
            known = [fresh[c] if raw is None else raw for c, raw in zip(names, known, strict=True)]
        ids = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int64, len(known)) // ids.itemsize
        first = np.cumsum(size) - size
        code = chunks.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        of_all = ids[np.repeat(first[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        pieces = iter([of_all[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        return [np.frombuffer(self._each([t])[0], self.dtype) if s is None else next(pieces) for t, s in zip(texts, spaced, strict=True)]

    def each(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The id arrays of a column of texts, one after another."""
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            full = int(np.searchsorted(size, BYTES_AT_ONCE + (size[at - 1] if at else 0), side="right"))
            end = min(len(column), at + TEXTS_AT_ONCE, max(at + 1, full))
            yield from self.batch(column.slice(at, end - at).to_pylist())
            at = end


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file."""
    return ChunkEncoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids written as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
