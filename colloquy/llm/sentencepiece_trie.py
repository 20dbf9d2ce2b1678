"""SentencePiece encoding by one forward pass over a trie of distinct marked words.

Blanks become the word mark and a text falls into marked words that no piece crosses.  The
distinct words of a batch are sorted, which lays their trie out depth first: each word keeps
the forward states of the prefix it shares with the one before and adds its own letters only.

The vocabulary's scores are merge ranks, under which the best-scoring path of a plain Viterbi
search is not what the encoder's merges give.  The forward state of a prefix is therefore the
one piece that can end its encoding: a piece t may follow a piece s exactly if the merges of
s + t give [s, t] again, since merges never cross a boundary of the final encoding.  That
leaves one way to reach each prefix, so a state is a piece and where it begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import table
from colloquy.llm.tokens import part, slices, vocabulary_path

MARK = "\u2581"
#: Words a worker remembers.
REMEMBERED = 500_000
_loaded: dict[str, TrieEncoder] = {}


class TrieEncoder:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score = {}, {}
        self.bytes_of: list[bytes] = []
        self.byte_id = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = lib.get_score(i)
                self.bytes_of.append(piece.encode())
        self.unknown = lib.unk_id()
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on past a blank; marked words can't be encoded apart")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reached: dict[str, bool] = {}
        self.seen: dict[str, bytes] = {}
        sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def merges(self, text: str) -> list[str]:
        """The encoder's own rule on a short string: the best-scoring neighbours merge first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, before: str, piece: str) -> bool:
        got = self.pairs.get((before, piece))
        if got is None:
            got = self.pairs[before, piece] = self.merges(before + piece) == [before, piece]
        return got

    def stands(self, piece: str) -> bool:
        got = self.reached.get(piece)
        if got is None:
            got = self.reached[piece] = self.merges(piece) == [piece]
        return got

    def encode_sorted(self, words: list[str]) -> Iterator[bytes]:
        """Ids of distinct words in sorted order, as bytes of int32."""
        ids, longest = self.ids, self.longest
        last: list[str] = [""]
        begin: list[int] = [0]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for at in range(max(0, end - longest), end):
                    piece = word[at:end]
                    if (piece in ids or end - at == 1) and self.stands(piece) and (at == 0 or self.may_follow(last[at], piece)):
                        last.append(piece)
                        begin.append(at)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            out, at = [], len(word)
            while at:
                piece = last[at]
                if piece in ids:
                    out.append(ids[piece])
                elif self.byte_id:
                    out += [self.byte_id[b] for b in reversed(piece.encode())]
                else:
                    out.append(self.unknown)
                at = begin[at]
            before = word
            yield np.array(out[::-1], "<i4").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.seen.get, words))
        missing = sorted({w for w, x in zip(words, found, strict=True) if x is None})
        if missing:
            new = dict(zip(missing, self.encode_sorted(missing), strict=True))
            found = [new[w] if x is None else x for w, x in zip(words, found, strict=True)]
            room = REMEMBERED - len(self.seen)
            if room > 0:
                self.seen.update(list(new.items())[:room])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has."""
        # a mark written out in a text is a blank to the library
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " "), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        parts = split.flatten()
        filled = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
        n_parts = np.diff(offsets - offsets[0])
        text_of = np.repeat(np.arange(len(n_parts)), n_parts)
        # blanks before each part: since the last part with letters, or the text's beginning
        number = np.arange(len(parts)) + 1
        from_ = np.maximum.accumulate(np.append(0, np.where(filled, number, 0))[:-1])
        from_ = np.maximum(from_, (offsets[:-1] - offsets[0])[text_of])
        marks = number - from_
        ends = np.zeros(len(parts), bool)
        ends[offsets[1:] - offsets[0] - 1] = True
        alone = ends & ~filled & (n_parts[text_of] > 1)
        use = np.flatnonzero(filled | alone)
        coded = parts.take(pa.array(use)).dictionary_encode()
        key = coded.indices.to_numpy().astype(np.int64) + marks[use] * len(coded.dictionary)
        distinct, code = np.unique(key, return_inverse=True)
        names = coded.dictionary.to_pylist()
        got = self.words([MARK * int(k // len(names)) + names[int(k % len(names))] for k in distinct]) if len(names) else []
        flat = np.frombuffer(b"".join(got), "<i4")
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        start = np.cumsum(size) - size
        n = size[code]
        ids = flat[np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.bincount(text_of[use], n, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts from ids: pieces and bytes joined, marks to blanks, the first blank dropped."""
        n = self.sizes[ids]
        before = np.cumsum(n) - n
        raw = self.flat[np.repeat(self.starts[ids] - before, n) + np.arange(n.sum())].tobytes()
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace").replace(MARK, " ")
            out.append(text[1:] if text[:1] == " " else text)
        return out


def encoder(path: str) -> TrieEncoder:
    if path not in _loaded:
        _loaded[path] = TrieEncoder(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_same[, ids])`` for every row.

    Null and empty texts have no ids; repeated rows and rows with a null id stay, long texts
    are encoded whole, and other columns are not read.  decoded_same: decoding the ids gives the text back (a
    text that holds the word mark itself does not come back, as in the library).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                texts = part(b.column(1), lo, hi)
                ids, counts = enc.encode(texts)
                back = enc.decode(ids, counts)
                same = [(t or "") == d for t, d in zip(texts.to_pylist(), back, strict=True)]
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [b.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded_same"]
                if with_ids:
                    offsets = pa.array(np.append(0, ends), pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    tail = ", ids array<int>" if with_ids else ""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_same boolean{tail}"
    )


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_same)`` of every document."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"), with_ids=False)
