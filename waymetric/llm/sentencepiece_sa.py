"""Operator 10: SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are laid end to end and their suffixes
sorted, as far as the longest piece reaches.  Every piece of the vocabulary then
finds the range of its occurrences by binary search; the resulting edges (start,
end, piece), sorted by position, are relaxed until no pair of adjacent tokens has
an edge over both.  For a byte-pair model relaxing means taking, in every word,
the best-scored such edge first, the leftmost of equal ones, which is the order
that the model's own merges have.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, texts_as_bytes, worker_state

SPACE = "\u2581"
SPACE_BYTES = SPACE.encode()
#: Distinct words whose ids a task remembers.
MEMO_WORDS = 200_000
#: Characters beyond which a word is relaxed by a queue of its own, in log-linear time.
LONG_WORD = 128
#: A word with the white space before it, or trailing white space.
_CHUNK = re.compile(rb" *[^ ]+| +")


class SuffixArrayModel:
    """Vocabulary of a byte-pair model with byte fallback, dummy prefix and kept white space."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size())]
        self.byte_ids = np.zeros(256, np.int64)
        self.surface: list[bytes] = [b""] * len(pieces)
        normal = []
        for piece, i in pieces:
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} spans words")
                self.surface[i] = piece.replace(SPACE, " ").encode()
                normal.append((piece, i, sp.get_score(i)))
        self.longest = max(len(p) for p, _, _ in normal)
        if self.longest > 61:  # an edge's length is a bit of a 64-bit number
            raise ValueError(f"a piece of {self.longest} characters")
        self.single = {p: i for p, i, _ in normal if len(p) == 1}
        # pieces of several characters, as rows of code points; the edges are theirs
        several = [x for x in normal if len(x[0]) > 1]
        self.piece_id = np.array([i for _, i, _ in several], np.int64)
        self.piece_len = np.array([len(p) for p, _, _ in several], np.int64)
        self.piece_points = np.zeros((len(several), self.longest), np.int64)
        for k, (p, _, _) in enumerate(several):
            self.piece_points[k, : len(p)] = [ord(c) for c in p]
        # rank of scores: equal scores share one, the best is 0
        self.rank_of = np.full(len(pieces), 1 << 30, np.int64)
        self.rank_of[[i for _, i, _ in normal]] = np.unique([-s for _, _, s in normal], return_inverse=True)[1]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def keys(codes: np.ndarray, bits: int) -> list[np.ndarray]:
        """Rows of codes as columns of unsigned 64-bit numbers that sort alike, 64 / bits codes each."""
        per = 64 // bits
        out = []
        for k in range(0, codes.shape[1], per):
            key = np.zeros(len(codes), np.uint64)
            for j in range(per):
                key <<= np.uint64(bits)
                if k + j < codes.shape[1]:
                    key |= codes[:, k + j].astype(np.uint64)
            out.append(key)
        return out

    def edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece, by position: each start's lengths as bits, its first edge, the edges' pieces.

        points: characters of the words, ends: the places that close a word.
        """
        n = len(points)
        own = points.copy()
        own[ends] = -1
        alphabet, code = np.unique(own, return_inverse=True)  # 0 closes a word
        bits = 8 if len(alphabet) <= 254 else 16 if len(alphabet) <= 65534 else 32
        per = 64 // bits
        padded = np.concatenate([code.ravel(), np.zeros(self.longest + per, np.int64)]).astype(np.uint64)
        packed = np.zeros(n + self.longest, np.uint64)
        for j in range(per):
            packed = (packed << np.uint64(bits)) | padded[j : j + n + self.longest]
        columns = [packed[k : k + n] for k in range(0, self.longest, per)]
        # the suffix array, as far as the longest piece reaches: ties of the first key are few
        suffixes = np.argsort(columns[0])
        first = columns[0][suffixes]
        tied = np.zeros(n, bool)
        tied[1:] = first[1:] == first[:-1]
        tied[:-1] |= tied[1:]
        tied &= (first & np.uint64((1 << bits) - 1)) != 0  # a word that ends within the key has no more to compare
        if len(columns) > 1 and tied.any():
            some = suffixes[tied]
            suffixes[tied] = some[np.lexsort([c[some] for c in columns[::-1]])]
        columns = [c[suffixes] for c in columns]
        # pieces in this batch's codes; those with other characters have no occurrence
        at = np.minimum(np.searchsorted(alphabet, self.piece_points), len(alphabet) - 1)
        inside = np.arange(self.longest)[None, :] < self.piece_len[:, None]
        live = np.flatnonzero(((alphabet[at] == self.piece_points) | ~inside).all(axis=1))
        wanted = np.where(inside, at, 0)[live]
        low = self.keys(wanted, bits)
        wanted[~inside[live]] = (1 << bits) - 1
        high = self.keys(wanted, bits)
        lo, hi = self._bound(columns, low, False), self._bound(columns, high, True)
        count = hi - lo
        piece = np.repeat(live, count)
        start = suffixes[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count)]
        order = np.argsort(start * 64 + self.piece_len[piece])
        start, piece = start[order], piece[order]
        lengths = np.zeros(n, np.int64)
        np.bitwise_or.at(lengths, start, np.int64(1) << self.piece_len[piece])
        counts = np.bincount(start, minlength=n)
        return lengths, np.cumsum(counts) - counts, self.piece_id[piece]

    @staticmethod
    def _bound(columns: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For each wanted key, how many suffixes sort before it (or not after it)."""
        size = len(wanted[0])
        lo, hi = np.zeros(size, np.int64), np.full(size, len(columns[0]), np.int64)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, len(columns[0]) - 1)
            less, equal = np.zeros(size, bool), np.ones(size, bool)
            for k, c in enumerate(columns):
                v = c[mid]
                less |= equal & (v < wanted[k])
                equal &= v == wanted[k]
            go = (less | equal) if after else less
            active = lo < hi
            lo, hi = np.where(active & go, mid + 1, lo), np.where(active & ~go, mid, hi)
        return lo

    def relax(self, points: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece (-1: none of several characters) of the final tokens.

        points has one more place after each word, listed in ends; word numbers the places.
        """
        lengths, first, pieces = self.edges(points, ends)
        pieces = np.append(pieces, -1)

        def find(start, length):
            bit = np.int64(1) << np.minimum(length, 62)
            has = (lengths[start] & bit) != 0
            return np.where(has, pieces[np.where(has, first[start] + np.bitwise_count(lengths[start] & (bit - 1)), -1)], -1)

        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        queued = sizes > LONG_WORD
        done = [self._relax_long(lengths, first, pieces, int(e - n), int(e)) for e, n in zip(ends[queued], sizes[queued], strict=True)]
        done_start, done_length = [d[0] for d in done], [d[1] for d in done]
        start = np.delete(np.arange(len(points)), ends)
        start = start[~queued[word[start]]]
        length = np.ones(len(start), np.int64)
        while len(start) > 1:
            w = word[start]
            both = np.where(w[1:] == w[:-1], find(start[:-1], length[:-1] + length[1:]), -1)
            pair = np.flatnonzero(both >= 0)
            if not len(pair):
                break
            # of each word, the best pair, the leftmost of equal ones
            own = w[pair]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat((self.rank_of[both[pair]] << 32) | pair, heads) & 0xFFFFFFFF
            live = np.zeros(int(w[-1]) + 1, bool)
            live[w[best]] = True
            length[best] += length[best + 1]
            keep = live[w]
            done_start.append(start[~keep])
            done_length.append(length[~keep])
            keep[best + 1] = False
            start, length = start[keep], length[keep]
        start, length = np.concatenate([*done_start, start]), np.concatenate([*done_length, length])
        order = np.argsort(start)
        start, length = start[order], length[order]
        return start, length, np.where(length > 1, find(start, length), -1)

    def _relax_long(self, lengths, first, pieces, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one word, by a queue of the pairs that have an edge: best score first, then leftmost."""
        from heapq import heapify, heappop, heappush

        has, at, n = lengths[begin:end].tolist(), first[begin:end].tolist(), end - begin
        rank_of, piece_of = self.rank_of, pieces
        length, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int):
            j = after[i]
            if j < n and (size := length[i] + length[j]) < 62 and has[i] >> size & 1:
                return (int(rank_of[piece_of[at[i] + (has[i] & ((1 << size) - 1)).bit_count()]]), i, size)
            return None

        queue = [p for i in range(n) if (p := pair(i))]
        heapify(queue)
        while queue:
            _, i, size = heappop(queue)
            j = after[i] if length[i] else n
            if j >= n or length[i] + length[j] != size:
                continue  # one of the two has changed since
            length[i], length[j], after[i] = size, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heappush(queue, p)
        size = np.array(length, np.int64)
        start = np.flatnonzero(size)
        return start + begin, size[start]

    def _learn(self, words: list[bytes]) -> None:
        spelt = [w.decode().replace(" ", SPACE) for w in words]
        sizes = np.array([len(w) for w in spelt], np.int64)
        points = np.frombuffer("\0".join([*spelt, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes + 1)
        start, length, piece = self.relax(points, np.cumsum(sizes + 1) - 1, word)
        # characters of their own: their piece, or else their bytes
        alone = np.flatnonzero(length == 1)
        chars, which = np.unique(points[start[alone]], return_inverse=True)
        piece[alone] = np.array([self.single.get(chr(c), -1) for c in chars.tolist()], np.int64)[which]
        n = np.ones(len(start), np.int64)
        lost = np.flatnonzero(piece < 0)
        raw = [chr(c).encode() for c in points[start[lost]].tolist()]
        n[lost] = [len(r) for r in raw]
        at = np.cumsum(n) - n
        ids = np.zeros(int(n.sum()), np.uint32)
        ids[at[piece >= 0]] = piece[piece >= 0]
        if raw:
            spread = np.repeat(at[lost] - (np.cumsum(n[lost]) - n[lost]), n[lost]) + np.arange(int(n[lost].sum()))
            ids[spread] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        lens = np.bincount(word[start], weights=n, minlength=len(words)).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids])
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text.  Pieces never span a word, so words are encoded once a batch."""
        import pandas as pd

        if len(self.memo) > MEMO_WORDS:
            self.clear()
        words = [_CHUNK.findall(b" " + t.replace(SPACE_BYTES, b" ")) if t else [] for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = np.empty(int(counts.sum()), object)
        flat[:] = [w for ws in words for w in ws]
        if not len(flat):
            return [np.zeros(0, np.uint32)] * len(texts)
        codes, distinct = pd.factorize(flat)
        new = [w for w in distinct if w not in self.memo]
        if new:
            self._learn(new)
        place = np.array([self.memo[w] for w in distinct], np.int64)[codes]
        lens = self.lens[place]
        ends = np.cumsum(lens)
        ids = self.ids[np.arange(int(ends[-1])) - np.repeat(ends - lens - self.starts[place], lens)]
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)][:-1])

    def decode(self, ids) -> str:
        """The text: pieces and bytes joined, without the dummy prefix."""
        raw = b"".join([self.surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _model(model_file: str) -> SuffixArrayModel:
    kept = worker_state()
    return kept.get(("pieces", model_file)) or kept.setdefault(("pieces", model_file), SuffixArrayModel(model_file))


def encode_texts(df: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids (array<int>).  Null and empty texts have no ids; other columns are ignored.

    Ids pass through, null or repeated.  Texts are taken whole; a text without any
    space is one word, which takes time in proportion to n log n and some 200 bytes a
    character in its task.
    """

    def run(batches):
        import pyarrow as pa

        model = _model(model_file)
        for batch in batches:
            texts = texts_as_bytes(batch.column("text"))
            for lo, hi in slices([len(t) for t in texts], SLICE_BYTES // 2):
                got = model.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id_col, text, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids).  Null ids decode as none."""

    def run(batches):
        import pyarrow as pa

        model = _model(model_file)
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            ids = [flat[a:b] if ok else flat[:0] for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([model.decode(x.tolist()) for x in ids], pa.string()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                names=["id", "text", "n_tokens", "ids_crc32"],
            )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, "id long, text string, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
