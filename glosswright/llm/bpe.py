"""Byte-pair encoding by speculation: longest match proposes, pair checks verify, exact merging repairs.

A segmentation is the BPE result of a word exactly when each of its tokens encodes to itself and no
merge ever crosses the border of two neighbours.  The second condition concerns two tokens at a time,
so all adjacent pairs of a block of words are checked at once with numpy; only the words that hold a
failing pair go through exact merging, which is vectorised over words as well.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .common import KEPT_BETWEEN_TASKS

INF = np.int64(1 << 40)


class IntTable:
    """Fixed open-addressing map from non-negative int64 keys to int64 values, looked up by the array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.shift, self.mask, self.default = np.uint64(64 - bits), (1 << bits) - 1, default
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, default, np.int64)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = first[free[first]]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.default)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)


class SpeculativeBPE:
    """Encoder of single pre-tokens (as bytes) for a byte-level ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.tokens = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        code = {c: b for b, c in enumerate(byte_alphabet())}
        # symbols 0..255 are bytes; 256..511 are bytes that end a word, where the file marks word ends
        self.base = np.array([vocab[c] for c in code] + ([vocab[c + self.suffix] for c in code] if self.suffix else []), np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in map(_pair, model["merges"])), strict=True))
        order = np.arange(len(made))
        self.pair_rank = IntTable(left * size + right, order, int(INF))
        self.made = np.append(made, -1)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = order[::-1], left[::-1], right[::-1]
        self.topological = bool((self.rank[left] < order).all() and (self.rank[right] < order).all())
        self._build_trie(vocab, code)

    def _build_trie(self, vocab, code):
        words, ids = [], []
        for text, i in vocab.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if ends else text
            if body and all(c in code for c in body):
                words.append(([code[c] for c in body], ends))
                ids.append(i)
        flat = np.array([s for w, _ in words for s in w], np.int64)
        lengths = np.array([len(w) for w, _ in words])
        last = np.cumsum(lengths) - 1
        flat[last] += 256 * np.array([e for _, e in words], np.int64)
        got, counts = self._merge_exactly(self.base[flat], lengths)
        first = got[np.cumsum(counts) - counts]
        nodes, accept, keys = 1, [-1], {}
        for k, i in enumerate(ids):
            if counts[k] != 1 or first[k] != i:  # never the result of merging, so never to be proposed
                continue
            at = 0
            for s in flat[last[k] + 1 - lengths[k] : last[k] + 1].tolist():
                nxt = keys.get(at << 9 | s)
                if nxt is None:
                    nxt = keys[at << 9 | s] = nodes
                    accept.append(-1)
                    nodes += 1
                at = nxt
            accept[at] = i
        self.step = IntTable(np.fromiter(keys.keys(), np.int64, len(keys)), np.fromiter(keys.values(), np.int64, len(keys)), -1)
        self.accept = np.array(accept, np.int64)

    def _merge_exactly(self, symbols: np.ndarray, lengths: np.ndarray):
        """Merge lowest ranks first, leftmost first, in all words at once; flat tokens and counts by word."""
        word, out_word, out_token = np.repeat(np.arange(len(lengths)), lengths), [], []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            rank = np.append(np.where(word[:-1] == word[1:], self.pair_rank.get(key), INF), INF)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(word))))
            done = best == INF
            out_word.append(word[done])
            out_token.append(symbols[done])
            hit = (rank == best) & ~done
            if self.topological:  # overlapping equal pairs: every other one of a run
                at = np.flatnonzero(hit)
                if len(at):
                    head = np.append(True, np.diff(at) > 1)
                    run = np.maximum.accumulate(np.where(head, at, 0))
                    hit[at[(at - run) % 2 == 1]] = False
            else:
                at = np.flatnonzero(hit)
                if len(at):
                    hit[at[np.append(False, word[at[1:]] == word[at[:-1]])]] = False
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            keep = ~done
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        return t[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(lengths))

    def _propose(self, codes: np.ndarray, lengths: np.ndarray):
        """Greedy longest matches of all words, one symbol a step."""
        end = np.cumsum(lengths)
        pos = end - lengths
        word = np.flatnonzero(lengths > 0)
        pos, end = pos[word], end[word]
        node, seen, seen_at = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64), pos.copy()
        out_word, out_token = [], []
        while len(word):
            inside = pos < end
            nxt = np.where(inside, self.step.get(node << 9 | codes[np.where(inside, pos, 0)]), -1)
            moved = nxt >= 0
            node = np.where(moved, nxt, 0)
            pos = pos + moved
            token = np.where(moved, self.accept[node], -1)
            ok = token >= 0
            seen, seen_at = np.where(ok, token, seen), np.where(ok, pos, seen_at)
            stuck = np.flatnonzero(~moved)
            if len(stuck):
                out_word.append(word[stuck])
                out_token.append(seen[stuck])
                pos[stuck], seen[stuck] = seen_at[stuck], -1
                gone = stuck[pos[stuck] >= end[stuck]]
                if len(gone):
                    keep = np.ones(len(word), bool)
                    keep[gone] = False
                    word, pos, end, node, seen, seen_at = (x[keep] for x in (word, pos, end, node, seen, seen_at))
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        return t[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(lengths))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between tokens a and b survives all merging, for arrays of pairs.

        Walks back in time: of the two pieces at the border the one formed last is taken apart, and at
        each moment the pair at the border must not merge before one of them is used up by its parent.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        until_a = np.full(len(a), INF)
        until_b = until_a.copy()
        while len(live):
            r = self.pair_rank.get(a * self.size + b)
            bad = (r < INF) & (r < until_a) & (r <= until_b)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, until_a, until_b = (x[go] for x in (live, a, b, ra, rb, until_a, until_b))
            split_a = ra > rb
            a, until_a = np.where(split_a, self.right[a], a), np.where(split_a, ra, until_a)
            b, until_b = np.where(split_a, b, self.left[b]), np.where(split_a, until_b, rb)
        return ok

    def encode(self, words: list[bytes]):
        """Flat ids of the pre-tokens and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.suffix and len(codes):
            codes[(np.cumsum(lengths) - 1)[lengths > 0]] += 256
        if not self.topological:
            return self._merge_exactly(self.base[codes], lengths)
        ids, counts = self._propose(codes, lengths)
        word = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(word[:-1] == word[1:])
        pairs, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)[back]
        wrong = np.unique(word[inner[~fine]])
        if not len(wrong):
            return ids, counts
        start = np.cumsum(lengths) - lengths
        again, n = self._merge_exactly(self.base[codes[ragged(start[wrong], lengths[wrong])]], lengths[wrong])
        right = np.ones(len(words), bool)
        right[wrong] = False
        all_ids = np.concatenate([ids[right[word]], again])
        all_word = np.concatenate([word[right[word]], np.repeat(wrong, n)])
        counts = counts.copy()
        counts[wrong] = n
        return all_ids[np.argsort(all_word, kind="stable")], counts


def _pair(merge):
    return merge.split(" ") if isinstance(merge, str) else merge


#: The pre-token patterns written in the public vocabulary files.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORD_PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
ASCII_BYTE_PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


#: Classes of bytes in texts whose characters beyond ASCII are all letters.
SPACE, LETTER, DIGIT, MARK = range(4)
CLASS = np.array([SPACE if b in b" \t\n\v\f\r" else LETTER if b > 127 or chr(b).isalpha() else DIGIT if 48 <= b < 58 else MARK for b in range(256)], np.uint8)
#: Cuts of other texts at ASCII white space, and the UTF-8 bytes of other white space.
BYTE_PIECE = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def letters_beyond_ascii(text: str) -> bool:
    return all(c.isalpha() for c in set(text) if c > "\x7f")


class TextEncoder:
    """Encodes whole texts; keeps the ids of recently seen pieces, a bounded number of bytes of them.

    Texts whose characters beyond ASCII are all letters are cut into pre-tokens by the classes of their bytes, a
    block of them at a time with numpy; Arrow finds the distinct pieces.  Others are cut where no pre-token can span: at ASCII white space for files that
    drop white space, and around runs of it, the last space staying with what follows, for files that keep
    it; pieces that touch other white space or a special token's beginning stay in one piece with their
    neighbours.  Equal pieces have equal ids wherever they stand, so each distinct piece of a block is encoded
    once.
    """

    #: Bytes that a generation of pieces may take before it becomes the old one, with OVERHEAD for each piece.
    KEPT, OVERHEAD = 24 << 20, 150
    BLOCK = 4 << 20

    def __init__(self, path: str):
        self.bpe = SpeculativeBPE(path)
        self.drops_space = bool(self.bpe.suffix)
        self.marks = regex.compile("|".join(map(regex.escape, self.bpe.special))) if self.bpe.special else None
        self.whole = any(any(c.isspace() for c in m) for m in self.bpe.special)  # such a special token may span pieces
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        self.raw_token = [t.encode() for t in self.bpe.tokens]

    def _direct(self, text: bytes) -> bytes | None:
        """The text in its normal form, where classes of bytes give its pre-tokens; else None."""
        if b"<|" in text:
            return None
        if text.isascii():
            return text.lower() if self.drops_space else text
        wide = text.decode("utf-8", "replace")
        if self.drops_space:
            wide = self._lowered(wide)
            text = wide.encode()
        return text if letters_beyond_ascii(wide) else None

    def _tiles(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The places at which pieces begin in texts that begin at `first`: pre-tokens, each with the one space before it,
        and other white space."""
        kind, n = CLASS[data], len(data)
        text = np.zeros(n + 1, bool)
        text[first] = text[n] = True
        new = np.append(True, kind[1:] != kind[:-1]) | text[:n]
        if self.drops_space:
            new |= kind == DIGIT
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:])  # of a run of white space within a text: a piece of its own,
        last = last[~text[last + 1]]
        new[last] = True
        new[last[data[last] == 32] + 1] = False  # or the beginning of the next one
        quote = np.flatnonzero(data == 39)
        if len(quote):  # contractions: an apostrophe alone among marks, and the letters of one
            padded = np.append(data, np.zeros(2, np.uint8))
            before = np.where(text[quote], 0, data[quote - 1])
            alone = (CLASS[before] != MARK) | text[quote]
            if not self.drops_space:
                alone &= before != 32
            a, b = padded[quote + 1], padded[quote + 2]
            inside, longer = ~text[quote + 1], ~text[np.minimum(quote + 2, n)]
            size = np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 1, 0)
            size = np.where(longer & ((np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == 101)) | (a == 108) & (b == 108)), 2, size)
            hit = alone & inside & (size > 0)
            new[quote[hit] + 1] = False
            end = quote[hit] + 1 + size[hit]
            end = end[end < n]
            new[end] |= kind[end] == LETTER
        return np.flatnonzero(new)

    def _tiled(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in its normal form; each distinct piece is looked up once."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(sizes)
        if not len(data):
            return [b""] * len(texts)
        begin = self._tiles(data, (end - sizes)[sizes > 0])
        offsets = np.append(begin, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.new.get, distinct))
        open_ = [i for i, ids in enumerate(found) if ids is None]
        words = [distinct[i] for i in open_]
        learned = dict(zip(words, map(self.old.get, words), strict=True))
        unknown = [w for w, ids in learned.items() if ids is None]
        if unknown:
            learned.update(zip(unknown, self._learn(unknown, []), strict=True))
        self._keep(learned)
        for i, w in zip(open_, words, strict=True):
            found[i] = learned[w]
        n = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), "<u4")
        count = n[index]
        raw = ids[ragged((np.cumsum(n) - n)[index], count)].tobytes()
        total = np.append(0, np.cumsum(count)) * 4
        stop = total[np.searchsorted(begin, end)].tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    @staticmethod
    def _lowered(text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def _cut(self, text: bytes) -> list[bytes]:
        if self.whole and b"<|" in text:
            return [text]
        if self.drops_space:
            return text.split()
        pieces = BYTE_PIECE.findall(text)
        if b"<|" in text or not text.isascii() and WIDE_SPACE.search(text):
            return self._glued(pieces)
        return pieces

    @staticmethod
    def _glued(pieces: list[bytes]) -> list[bytes]:
        """Pieces that begin or end with other white space, or are a space and a special token, with their neighbours."""
        out, open_ = [], False
        for p in pieces:
            body = p.lstrip(b" ")
            if open_ and out:
                p = out.pop() + p
            elif WIDE_SPACE.match(body) or body.startswith(b"<|"):
                while out:  # the white space before it and the word before that
                    last = out.pop()
                    p = last + p
                    if last.strip():
                        break
            out.append(p)
            open_ = open_ and not body.strip() or bool(WIDE_SPACE.match(p, max(0, len(p) - 2)) or WIDE_SPACE.match(p, max(0, len(p) - 3)))
        return out

    def _pretokens(self, piece: bytes) -> list[bytes | int]:
        if piece.isascii() and b"<|" not in piece:
            return ASCII_WORD_PATTERN.findall(piece.lower()) if self.drops_space else ASCII_BYTE_PATTERN.findall(piece)
        text = piece.decode("utf-8", "replace")
        if "<|" not in text or not self.marks:
            return self._plain(text)
        spans: list[bytes | int] = []
        at = 0
        for m in self.marks.finditer(text):
            spans += self._plain(text[at : m.start()])
            spans.append(self.bpe.special[m.group()])
            at = m.end()
        return spans + self._plain(text[at:])

    def _plain(self, text: str) -> list[bytes]:
        if self.drops_space:
            text = self._lowered(text)
            return [text.encode()] if text.isalpha() else [w.encode() for w in WORD_PATTERN.findall(text)]
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text.encode()]
        return [w.encode() for w in BYTE_PATTERN.findall(text)]

    def _learn(self, words: list[bytes], others: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens (with their space, where it does not count), then of other pieces by way of their own."""
        place: dict[bytes, int] = {}
        plans = [[p if p.__class__ is int else ~place.setdefault(p, len(place)) for p in self._pretokens(piece)] for piece in others]
        ids, counts = self.bpe.encode([*(map(bytes.strip, words) if self.drops_space else words), *place])
        raw, end = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        found = [raw[a:b] for a, b in zip((end - counts * 4).tolist(), end.tolist(), strict=True)]
        later = found[len(words) :]
        return found[: len(words)] + [b"".join([later[~p] if p < 0 else p.to_bytes(4, "little") for p in plan]) for plan in plans]

    def _keep(self, learned: dict[bytes, bytes]) -> None:
        self.new.update(learned)
        self.size += sum(map(len, learned)) + sum(map(len, learned.values())) + self.OVERHEAD * len(learned)

    def _looked_up(self, pieces: list[list[bytes]]) -> None:
        """Make the distinct pieces of other texts known."""
        unknown = set().union(*pieces).difference(self.new)
        again = {p: self.old[p] for p in unknown.intersection(self.old)}
        rest = [p for p in unknown if p not in again]
        self._keep(again | dict(zip(rest, self._learn([], rest), strict=True)))

    def encode(self, texts: list[bytes | None]):
        """Yields the ids of each text in turn, as little-endian unsigned 32-bit integers."""
        i = 0
        while i < len(texts):
            tiled, other, order, size = [], [], [], 0
            while i < len(texts) and (not order or size < self.BLOCK):
                text = texts[i] or b""
                normal = self._direct(text)
                order.append(normal is not None)
                (other if normal is None else tiled).append(text if normal is None else normal)
                size += len(text)
                i += 1
            if self.size > self.KEPT:
                self.new, self.old, self.size = {}, self.new, 0
            collecting = gc.isenabled()
            gc.disable()  # many small objects, none in a cycle
            easy = iter(self._tiled(tiled)) if tiled else iter(())
            pieces = [self._cut(t) for t in other]
            if pieces:
                self._looked_up(pieces)
            hard = iter([b"".join(map(self.new.__getitem__, p)) for p in pieces])
            if collecting:
                gc.enable()
            for direct in order:
                yield next(easy if direct else hard)

    def decode(self, ids: bytes) -> bytes:
        """The text that a file without a decoder gives: token strings, one space between them."""
        token = self.raw_token.__getitem__
        return b" ".join(map(token, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder a process and file; Spark's Python workers use it again from task to task.

    Tasks of operators that need the memory drop it with common.lean().
    """
    return TextEncoder(path)


KEPT_BETWEEN_TASKS.append(encoder.cache_clear)
