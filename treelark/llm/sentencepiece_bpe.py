"""Byte-pair encoding with a SentencePiece model by vectorised merge rounds in numpy, and decoding.

Text is cut before every run of spaces (no piece of such a model holds a space behind another
character, which is checked at load) and around characters that no piece holds, so each cut is
encoded by itself and every distinct cut once a batch. A round works on all open words at once: find
the smallest pair rank of each word, merge its pairs of that rank from the left, compact, and look
up only the pairs that changed; words without a pair leave. Where a merge could make a pair of equal or
smaller rank, only the leftmost pair of the word is merged in that round, as the library's queue does.

Null or empty text: only the begin and end ids, and an empty decoded text. U+2581 in a text reads as a space, as
in the library. Very long texts are encoded whole. Equal rows give equal rows; row order plays no part.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treelark.llm.common import annotate

#: Entries and ids of a Python worker's cache of encoded words, and the longest word that it keeps.
CACHE_WORDS, CACHE_IDS, CACHE_CHARS = 300_000, 3_000_000, 40
#: Characters of the texts that are encoded at once; a longer text goes by itself.
GROUP_CHARS = 1 << 22
NONE = np.iinfo(np.int64).max
SPACE = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """word -> slot; a word that is met for the first time gets the next slot and is noted in `new`."""

    def __init__(self) -> None:
        self.slots, self.new = 2, []

    def __missing__(self, word: str) -> int:
        self[word] = slot = self.slots
        self.slots += 1
        self.new.append(word)
        return slot


class Bpe:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        kind = [0 if sp.is_byte(i) else 1 if sp.is_control(i) or sp.is_unknown(i) else 2 for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        pieces = {names[i]: i for i in range(n) if kind[i] == 2}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space behind another character; words can't be encoded one by one")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.bytes_of = np.array([sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)], np.uint32)
        scores = sorted({sp.get_score(i) for i in pieces.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        rank_of = {p: rank[sp.get_score(i)] for p, i in pieces.items()}

        #: Symbols: ids of pieces, then characters that only longer pieces hold; any other character is UNKNOWN.
        self.symbol = {p: i for p, i in pieces.items() if len(p) == 1}
        self.extra = sorted({c for p in pieces for c in p} - self.symbol.keys())
        self.symbol |= {c: n + k for k, c in enumerate(self.extra)}
        self.base = n + len(self.extra) + 1
        self.char = np.full(max(map(ord, self.symbol)) + 1, self.base - 1, np.int64)
        for c, i in self.symbol.items():
            self.char[ord(c)] = i
        self.char[32] = self.symbol[SPACE]
        parts: dict[int, tuple[int, int]] = {}
        unsafe = set()
        of = lambda s: self.symbol.get(s) if len(s) == 1 else pieces.get(s)
        for p, i in pieces.items():
            for k in range(1, len(p)):
                left, right = of(p[:k]), of(p[k:])
                if left is not None and right is not None:
                    parts[left * self.base + right] = (rank_of[p], i)
                    unsafe |= {pieces[q] for q in (p[:k], p[k:]) if q in pieces and rank_of[p] <= rank_of[q]}
        keys = np.array(list(parts), np.int64)
        #: Pairs in a table with open places, a quarter full at most: key, rank and id of the merged piece.
        self.places = (4 * len(keys)).bit_length()
        self.keys, self.ranks, self.merged = (np.full(1 << self.places, x, np.int64) for x in (-1, NONE, 0))
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            first = left[free][np.unique(at[left[free]], return_index=True)[1]]
            self.keys[at[first]] = keys[first]
            self.ranks[at[first]], self.merged[at[first]] = np.array([parts[k] for k in keys[first].tolist()], np.int64).T if len(first) else (0, 0)
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.unsafe = np.zeros(self.base, bool)
        self.unsafe[list(unsafe)] = True

        inside = "".join(re.escape(c) for c in map(chr, range(32)) if c not in self.symbol)
        self.cut = re.compile(f" +[^ {inside}]*|[^ {inside}]+|[{inside}]" if inside else " +[^ ]*|[^ ]+")
        out = [bytes([int(names[i][3:5], 16)]) if kind[i] == 0 else b"" if kind[i] == 1 and i != sp.unk_id() else " ⁇ ".encode() if kind[i] == 1 else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.control = np.array([k == 1 for k in kind])
        self.forget()

    def forget(self) -> None:
        """Empty the cache: slots 0 and 1 are the begin and end ids, those of words follow. A slot's ids are a stretch of `flat`."""
        self.words, self.flat = Words(), np.array([self.bos, self.eos], np.uint32)
        self.first, self.size_of = np.array([0, 1]), np.array([1, 1])

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.places)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = self.place(key)
        there = self.keys[at]
        lost = np.flatnonzero((there != key) & (there >= 0))
        while len(lost):  # another pair's place: go on to the next
            at[lost] = (at[lost] + 1) & (len(self.keys) - 1)
            there = self.keys[at[lost]]
            lost = lost[(there != key[lost]) & (there >= 0)]
        return self.ranks[at], self.merged[at]

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the word of each. word is sorted."""

        def pairs(at: np.ndarray) -> None:
            """Look up the pairs (i, i + 1) for i in at."""
            ok = at[(at + 1 < len(sym))]
            rank[at], to[at] = NONE, 0
            ok = ok[word[ok] == word[ok + 1]]
            rank[ok], to[ok] = self.look_up(sym[ok], sym[ok + 1])

        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, to = np.empty(len(sym), np.int64), np.empty(len(sym), np.int64)
        pairs(np.arange(len(sym)))
        while len(sym):
            first = np.ones(len(sym), bool)
            first[1:] = word[1:] != word[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            if (over := least == NONE).any():
                gone = np.repeat(over, sizes)
                done.append((sym[gone], word[gone]))
                sym, word, rank, to = sym[~gone], word[~gone], rank[~gone], to[~gone]
                sizes, least = sizes[~over], least[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            fresh = np.ones(len(hit), bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            run = np.flatnonzero(fresh)
            hit_word = word[hit]
            take = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0
            head = np.ones(len(hit), bool)
            head[1:] = hit_word[1:] != hit_word[:-1]
            if self.unsafe[to[hit]].any():
                group = np.cumsum(head) - 1
                risky = np.zeros(group[-1] + 1, bool)
                np.logical_or.at(risky, group, self.unsafe[to[hit]])
                take &= head | ~risky[group]
            hit = hit[take]
            sym = sym.copy()
            sym[hit] = to[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new_at = np.cumsum(keep) - 1
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            touched = np.zeros(len(sym), bool)
            touched[new_at[hit]] = True
            touched[:-1] |= touched[1:]
            pairs(np.flatnonzero(touched))
        sym = np.concatenate([x[0] for x in done]) if done else sym
        word = np.concatenate([x[1] for x in done]) if done else word
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and the number of ids of each."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        sym = np.where(points < len(self.char), self.char[np.minimum(points, len(self.char) - 1)], self.base - 1)
        lost = sym == self.base - 1
        sym[lost] = self.base + points[lost]  # keeps the character; no pair holds such a symbol
        sym, word = self.merge_rounds(sym, word)
        if (odd := sym >= self.size).any():  # characters without a piece become their bytes
            chars = [self.extra[s - self.size] if s < self.base else chr(s - self.base) for s in sym[odd].tolist()]
            spelled = [c.encode("utf-8", "surrogatepass") for c in chars]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(b) for b in spelled]
            word, mark, sym = np.repeat(word, times), np.repeat(odd, times), np.repeat(sym, times)
            sym[mark] = self.bytes_of[np.frombuffer(b"".join(spelled), np.uint8)]
        return sym.astype(np.uint32), np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str | None], width: int = 4) -> list[bytes]:
        """The ids of each text, with begin and end ids, as little-endian unsigned integers of `width` bytes."""
        found: list[bytes] = []
        k = 0
        while k < len(texts):
            chars, first = 0, k
            while k < len(texts) and (k == first or chars + len(texts[k] or "") <= GROUP_CHARS):
                chars += len(texts[k] or "")
                k += 1
            found += self.encode_group(texts[first:k], width)
        return found

    def encode_group(self, texts: list[str | None], width: int) -> list[bytes]:
        if len(self.words) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.forget()
        cut = [self.cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 2)
        slots = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(slots), bool)
        inside[ends - 1] = inside[np.append(0, ends[:-1])] = False
        slots[ends - 1] = 1
        slots[inside] = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, len(slots) - 2 * len(cut))
        if new := self.words.new:
            ids, sizes = self.encode_words(new)
            self.first = np.append(self.first, len(self.flat) + np.cumsum(sizes) - sizes)
            self.size_of, self.flat = np.append(self.size_of, sizes), np.append(self.flat, ids)
            for w in new:
                if len(w) > CACHE_CHARS:
                    del self.words[w]
            new.clear()
        sizes = self.size_of[slots]
        after = np.cumsum(sizes)
        at = np.repeat(self.first[slots] - after + sizes, sizes)
        at += np.arange(len(at))
        flat = self.flat[at].astype(f"<u{width}").tobytes()
        cuts = [0, *(after[ends - 1] * width).tolist()]
        return [flat[i:j] for i, j in pairwise(cuts)]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text of ids (little-endian 32-bit) in UTF-8; a byte that belongs to no character becomes U+FFFD."""
        i = np.frombuffer(ids, "<u4")
        i = i[~self.control[i] | (self.out_len[i] > 0)]
        sizes = self.out_len[i]
        ends = np.cumsum(sizes)
        if not len(i):
            return b""
        at = np.repeat(self.out_at[i] - ends + sizes, sizes) + np.arange(ends[-1])
        text = self.out[at].tobytes()
        if text[:1] == b" ":
            text = text[1:]
        try:
            text.decode()
        except UnicodeDecodeError:
            text = b"".join(x if ok else "�".encode() for x, ok in characters(text))
        return text


def characters(data: bytes) -> list[tuple[bytes, bool]]:
    found, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[k : k + n].decode()
            except UnicodeDecodeError:
                continue
            found.append((data[k : k + n], True))
            break
        else:
            n = 1
            found.append((data[k : k + 1], False))
        k += n
    return found


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


VERDICT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


IDS = T.StructType([T.StructField("ids", T.BinaryType())])


def encode_ids(docs: DataFrame, width: int = 4, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, verdict): verdict holds ids alone, as little-endian unsigned integers of `width` bytes; nothing is decoded."""
    path = path or model_path()
    if width not in (2, 4) or bpe(path).size > 1 << 8 * width:
        raise ValueError(f"ids of {bpe(path).size} pieces don't fit {width} bytes")

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        return {"ids": bpe(path).encode(batch["text"].to_pylist(), width)}

    return annotate(docs, {"text": f"cast(`{text}` as string)"}, IDS, run, keep)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(row, verdict): verdict holds n_tokens, ids (little-endian uint32 as binary) and the decoded text, or their digests; keep: the columns of row."""
    path = path or model_path()

    def run(batch: dict[str, pa.Array]) -> dict[str, object]:
        model = bpe(path)
        texts = batch["text"].to_pylist()
        ids = model.encode(texts)
        n = [len(x) // 4 for x in ids]
        if not digests:
            return {"n_tokens": n, "ids": ids, "decoded": [model.decode_bytes(x).decode() for x in ids]}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"n_tokens": n, "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(model.decode_bytes(x)) for x in ids]}

    return annotate(docs, {"text": f"cast(`{text}` as string)"}, DIGEST if digests else VERDICT, run, keep)


if sys.byteorder != "little":
    raise ImportError("written for little-endian machines")
