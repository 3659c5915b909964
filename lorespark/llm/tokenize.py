"""Token ids of whole texts with a public tokenizer, by way of a cache of words.

Byte-level BPE with this family's splitting rule never joins across a space that
follows and precedes other characters than white space, so a text is split there and
each piece is encoded once by the tokenizers library.  New pieces are encoded many at a
time, held apart by a separator with an id of its own.  Texts with a space beside other
white space, texts that hold the string of an added token, and texts for tokenizers of
another family are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in the cache.
CACHE_PIECES = 400_000
#: Pieces of more bytes are encoded again each time.
CACHE_BYTES = 64
#: New pieces that are encoded as one text.
TOGETHER = 200
#: Such texts that are encoded at once.
AT_ONCE = 32
SEPARATOR = "\x0b"
#: Such marks at the end of a word of letters are a piece of their own for the tokenizer.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_BESIDE = re.compile(r"\s \s|\s  | \s|^ ")


def _divided(text: str) -> str | None:
    """A text with a space wherever it can be split, before line ends too if all white space is single and inside; null if it can't be."""
    words = text.split()
    if len(text) - sum(map(len, words)) == len(words) - 1:
        return text.replace("\n", " \n")
    return None if _BESIDE.search(text) else text


def _apart(piece: str) -> bool:
    """Whether a piece can't stand between separators."""
    return not piece or SEPARATOR in piece or piece[-1].isspace() or (piece[0] != " " and piece[0].isspace())


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rule = str(self.tokenizer.pre_tokenizer)
        self.splits = rule.startswith("ByteLevel(") and "add_prefix_space=False" in rule and "use_regex=True" in rule and self.tokenizer.normalizer is None
        between = self._encode([SEPARATOR])[0]
        self.splits &= len(between) == self.kind.itemsize
        self.between = np.frombuffer(between, dtype=self.kind)[0]
        #: Words behind a space, or behind a line end that is their first character, and their ids; the last used come first.
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.line_end = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        alone = [p for p in pieces if _apart(p)]
        out = dict(zip(alone, self._encode(alone)))
        rest = [p for p in pieces if p not in out]
        parts = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
        # few at a time: an encoding takes many times the memory of its ids
        encoded = (i for k in range(0, len(parts), AT_ONCE) for i in self._encode([SEPARATOR.join(p) for p in parts[k : k + AT_ONCE]]))
        for own, ids in zip(parts, encoded):
            cuts = np.flatnonzero(np.frombuffer(ids, dtype=self.kind) == self.between) * self.kind.itemsize
            if len(cuts) != len(own) - 1:
                out.update(zip(own, self._encode(own)))
                continue
            starts = [0, *(cuts + self.kind.itemsize).tolist()]
            for piece, a, b in zip(own, starts, [*cuts.tolist(), len(ids)]):
                out[piece] = ids[a:b]
        return out

    def _fresh(self, words: list[str]) -> list[bytes]:
        lines = [w[1:] for w in words if w[:1] == "\n" and len(w) > 1]
        spaced = [" " + w for w in words if w[:1] != "\n" or len(w) == 1]
        bare, behind = self._encode_pieces(lines), self._encode_pieces(spaced)
        return [self.line_end + bare[w[1:]] if w[:1] == "\n" and len(w) > 1 else behind[" " + w] for w in words]

    def _stems(self, stems: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words, by way of the cache, which they then lead."""
        at = pc.index_in(stems, value_set=self.words)
        new = stems.filter(at.is_null())
        words = pa.concat_arrays([self.words, new])
        ids = pa.concat_arrays([self.ids, pa.array(self._fresh(new.to_pylist()), pa.large_binary())])
        place, missing = at.fill_null(0).to_numpy().astype(np.int64), at.is_null().to_numpy(zero_copy_only=False)
        place[missing] = len(self.words) + np.arange(len(new))
        rest = np.ones(len(words), dtype=bool)
        rest[place] = False
        order = np.concatenate([place, np.flatnonzero(rest)])
        order = order[pc.binary_length(words).to_numpy()[order] <= CACHE_BYTES][:CACHE_PIECES]
        self.words, self.ids = words.take(pa.array(order)), ids.take(pa.array(order))
        return ids.take(pa.array(place))

    def _resolve(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each word where it stands; those of the marks after a word of letters are found apart."""
        stem = pc.utf8_rtrim(words, MARKS)
        marked = pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(stem, "\n")), pc.less(pc.binary_length(stem), pc.binary_length(words)))
        numbered = pc.if_else(marked, stem, words).dictionary_encode()
        ids = self._stems(numbered.dictionary).take(numbered.indices)
        tails = pc.replace_substring_regex(words.filter(marked), r"^\n?\pL+", "").dictionary_encode()
        if not len(tails):
            return ids
        known = pa.array([b"", *self._encode(tails.dictionary.to_pylist())], pa.large_binary())
        which = np.zeros(len(words), dtype=np.int64)
        which[marked.to_numpy(zero_copy_only=False)] = tails.indices.to_numpy() + 1
        return pc.binary_join_element_wise(ids, known.take(pa.array(which)), pa.scalar(b"", pa.large_binary()))

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of divided texts: each distinct piece once, then laid out by its number."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = pieces.offsets.to_numpy()
        numbered = pieces.values.dictionary_encode()
        codes, words = numbered.indices.to_numpy().copy(), numbered.dictionary
        # a text's first piece has no space before it
        heads, codes[ends[:-1]] = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] += len(words)
        first = words.take(pa.array(heads)).to_pylist()
        encoded = self._encode_pieces(first)
        ids = pa.concat_arrays([self._resolve(words), pa.array([encoded[w] for w in first], pa.large_binary())])
        laid = ids.take(pa.array(codes))
        at = np.frombuffer(laid.buffers()[1], dtype=np.int64)[ends].tolist()
        data = laid.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        out: list = [b""] * len(texts)
        split, divided, whole = [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = _divided(text) if self.splits and not self.added.search(text) else None
            if parts is None:
                whole.append(k)
            else:
                split.append(k)
                divided.append(parts)
        if split:
            for k, ids in zip(split, self._split(divided)):
                out[k] = ids
        for k, ids in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which is kept with its cache from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
