"""Whole texts to token ids with the tokenizers library, one encode per distinct word.

The byte-level pre-tokenizer never joins a blank with what stands before it when a visible
character follows, so such a text may be cut before each blank and its words encoded apart.
Words are dictionary-encoded per Arrow batch and each distinct word goes to the tokenizer
once per worker; texts with runs of white space or with a special token written out are
encoded whole.  Ids are the same as the library's for the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words a worker remembers; words beyond are encoded anew in each batch.
REMEMBERED = 1_000_000
_RUNS = r" [\s\v\p{Z}\x{85}\x{1c}-\x{1f}]|[\s\v\p{Z}\x{85}\x{1c}-\x{1f}] $"
_loaded: dict[str, WordTokenizer] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        #: Special tokens that the library finds in a text, as one pattern.
        self.special = "|".join(re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values())
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.seen: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def after_blank(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a blank before it."""
        out = []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(self.lib.encode(" " + " ".join(part), add_special_tokens=False).ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(part) and len(ids) and starts[0] == 0:
                ends = np.append(starts[1:], len(ids))
                out += [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            else:
                out += self.whole([" " + w for w in part])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        pattern = f"{_RUNS}|{self.special}" if self.special else _RUNS
        odd = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        if odd.any():
            counts = np.zeros(len(texts), np.int64)
            plain_ids, counts[~odd] = self._by_word(texts.filter(pa.array(~odd)))
            got = self.whole(texts.filter(pa.array(odd)).to_pylist())
            size = np.dtype(self.dtype).itemsize
            counts[odd] = [len(x) // size for x in got]
            ids = np.empty(counts.sum(), self.dtype)
            at_odd = np.repeat(odd, counts)
            ids[at_odd] = np.frombuffer(b"".join(got), self.dtype)
            ids[~at_odd] = plain_ids
            return ids, counts
        return self._by_word(texts)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        found = list(map(self.seen.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            got = self.after_blank([words[k] for k in missing])
            room = REMEMBERED - len(self.seen)
            for k, x in zip(missing, got, strict=True):
                found[k] = x
            self.seen.update((words[k], found[k]) for k in missing[: max(0, room)])
        firsts, first_codes = np.unique(codes[offsets[:-1]], return_inverse=True)
        first_ids = self.whole([words[k] for k in firsts])
        codes[offsets[:-1]] = len(words) + first_codes
        size = np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(found + first_ids), self.dtype)
        lengths = np.fromiter(map(len, found + first_ids), np.int64, len(words) + len(first_ids)) // size
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(starts[codes] - before, n) + np.arange(n.sum())]
        return ids, np.add.reduceat(n, offsets[:-1])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def part(array: pa.Array, lo: int, hi: int) -> pa.Array:
    """Rows lo .. hi as an array of their own: Arrow's text kernels misread casts of slices."""
    return array.take(pa.array(np.arange(lo, hi)))


def slices(array: pa.Array, most_bytes: int = 8 << 20):
    """Cut a binary or text array into runs of about ``most_bytes``, so working memory is bounded."""
    if not len(array):
        return
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // most_bytes
    cuts = np.append(0, np.flatnonzero(np.diff(run)) + 1).tolist() + [len(array)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, b
