"""The lower-casing word tokenizer over whole groups of texts at once (numpy).

The tokenizer composes (NFC), lower-cases, splits at white space and into contractions, runs of
letters, single digits and runs of other signs, and merges the bytes of each piece. For words of ASCII
signs and Latin-1 letters all of that is done here on the bytes of a group of texts: pieces are
found by character class, each distinct piece (by 64-bit hash) is merged once, and all new distinct
pieces of a group are merged together, one merge of each a round; a bounded table keeps the ids of
pieces seen before, so groups can be small. Other words (other scripts, control
characters, added tokens, very long pieces) go to the library, each distinct word once.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from ._textvec import LOWER, SPACE, groups, hash_spans

#: Bytes of text whose distinct pieces are found together; bytes of a piece that is merged here.
GROUP = 1 << 20
LONGEST = 64
#: Distinct pieces whose ids are kept from one group to the next, about.
KNOWN = 200_000
#: Classes of bytes: space, letter, digit, other sign, and what the library has to look at.
_SPACE, _LETTER, _DIGIT, _SIGN, _REST = range(5)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[SPACE] = _SPACE
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
NONE = 1 << 30


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + i)
    return [names[b] for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


class WordTokens:
    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in _byte_names()], np.int64)
        self.last = np.array([vocab[c + end] for c in _byte_names()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        #: Type of an id in the output.
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        """The table of known pieces: sorted hashes, first id in ``flat`` and number of ids."""
        self.hashes, self.at, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def _learn(self, a: np.ndarray, hashes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """Merges the pieces a[start : start + size] that the table lacks. ``hashes`` are sorted and distinct."""
        if len(self.hashes) > KNOWN:
            self._forget()
        i = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[i] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if not new.any():
            return
        hashes, starts, size = hashes[new], starts[new], size[new]
        ids, count = self.merge(a[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())], size)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(count) - count)
        self.count = np.insert(self.count, place, count)
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; NONE where it isn't one."""
        k = a << 20 | b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[i] == k
        return np.where(hit, self.rank[i], NONE), np.where(hit, self.made[i], 0)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces whose bytes follow each other in ``raw``; no piece is empty."""
        ends = np.cumsum(size)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        name, own = np.arange(len(size)), np.repeat(np.arange(len(size)), size)
        rank, new = (np.append(x, y) for x, y in zip(self._rank(sym[:-1], sym[1:]), (NONE, 0)))
        rank[ends - 1] = NONE
        size = size.copy()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(size):
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            done = best == NONE
            if done.any():
                mine = done[own]
                out.append((name[own[mine]], sym[mine]))
                left, again = ~mine, np.cumsum(~done) - 1
                sym, rank, new, own = sym[left], rank[left], new[left], again[own[left]]
                name, size, best = name[~done], size[~done], best[~done]
                if not len(size):
                    break
            at = np.flatnonzero(rank == best[own])
            at = at[np.concatenate(([True], own[at][1:] != own[at][:-1]))]  # leftmost, one a piece
            sym[at] = new[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, new, own = sym[keep], rank[keep], new[keep], own[keep]
            size -= 1
            at -= np.arange(len(at))  # one sign of each piece before is gone
            stop = np.cumsum(size) - 1
            for p in (at, at[at > stop - size + 1] - 1):
                inside = p < stop[own[p]]
                q = p[inside]
                rank[q], new[q] = self._rank(sym[q], sym[q + 1])
                rank[p[~inside]] = NONE
        owner, ids = np.concatenate([o for o, _ in out]), np.concatenate([s for _, s in out])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner)

    def _library(self, words: list[str]) -> list[np.ndarray]:
        if not words:
            return []
        got = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1))
        ids = np.array(got.ids, np.int64)
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _group(self, texts: list[bytes]) -> list[bytes]:
        buf = b"\n" + b"\n".join(texts) + b"\n"
        a = np.frombuffer(bytearray(buf.translate(LOWER)), np.uint8)
        kind = _CLASS[a]
        # Latin-1 letters are two bytes from 0xC3; their capitals differ in one bit.
        lead = np.flatnonzero(a[:-1] == 0xC3)
        follow = a[lead + 1]
        letter = (follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        capital = letter & (follow <= 0x9E)
        a[lead[capital] + 1] += 0x20
        mark = np.flatnonzero(a[:-1] == 0x3C)
        kind[mark[a[mark + 1] == 0x7C]] = _REST  # <| may begin an added token

        space = kind == _SPACE
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        words, stops = edges[0::2], edges[1::2]
        begin = np.empty(len(a), bool)
        begin[0] = False
        begin[1:] = ~space[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        quote = np.flatnonzero(begin & (a == 0x27))
        one, two = a[quote + 1], a[np.minimum(quote + 2, len(a) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        begin[quote[short | long] + 1] = False
        after = np.concatenate((quote[short] + 2, quote[long] + 3))
        begin[after] = ~space[after]
        # Words with anything else, or with a very long piece, are one piece each, for the library.
        rest = np.flatnonzero(kind == _REST)
        odd = np.searchsorted(rest, stops) > np.searchsorted(rest, words)
        starts = np.flatnonzero(begin)
        word = np.searchsorted(words, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(a)), stops[word]) if len(starts) else starts
        odd[word[ends - starts > LONGEST]] = True
        plain = ~odd[word]
        starts, ends, word = starts[plain], ends[plain], word[plain]

        hashes, at, which = np.unique(hash_spans(a, starts, ends), return_index=True, return_inverse=True)
        self._learn(a, hashes, starts[at], (ends - starts)[at])
        known = np.searchsorted(self.hashes, hashes)
        flat, offset, count = self.flat, self.at[known], self.count[known]
        where = np.flatnonzero(odd)
        if len(where):
            raw = [buf[i:j] for i, j in zip(words[where].tolist(), stops[where].tolist())]
            distinct = list(dict.fromkeys(raw))
            got = self._library([w.decode("utf-8", "replace") for w in distinct])
            place = {w: len(count) + k for k, w in enumerate(distinct)}
            more = np.array([len(g) for g in got], np.int64)
            offset = np.concatenate((offset, len(flat) + np.cumsum(more) - more))
            flat = np.concatenate([flat, *got])
            count = np.concatenate((count, more))
            order = np.argsort(np.concatenate((starts, words[where])), kind="stable")
            which = np.concatenate((which, [place[w] for w in raw]))[order]
            word = np.concatenate((word, where))[order]
        first, n = offset[which], count[which]
        total = np.concatenate(([0], np.cumsum(n)))
        stream = flat[np.repeat(first - total[:-1], n) + np.arange(total[-1])].astype(self.dtype)
        bounds = 1 + np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        cut = total[np.searchsorted(word, np.searchsorted(words, bounds))].tolist()
        return [stream[i:j].tobytes() for i, j in zip(cut, cut[1:])]

    def encode_many(self, texts: list[str | bytes]) -> list[bytes]:
        """Little-endian ids (``dtype``) of each text, without special tokens."""
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[bytes] = []
        for i, j in groups(list(map(len, raw)), GROUP):
            out += self._group(raw[i:j])
        return out
