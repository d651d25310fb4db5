"""BPE encoding and decoding by a prefix-sharing trie traversal.

The words of a batch are put into a trie and walked level by level, each level at once in
arrays (words over WIDTH bytes: depth first, one by one). The state of a node is the last token of the encoding of its prefix. A prefix followed by one more symbol ends
in the one vocabulary token t for which the encoding of what precedes t, followed by t,
is itself a valid encoding; that holds if the last token before t and t don't merge when
they are encoded together. So each prefix is solved once for all words that share it,
and a word's tokens are read back along the chain of states.

Words end in symbols of their own (a suffix such as ``</w>``), so the last symbol is an
edge of another kind, taken from the node of all symbols before it.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import CACHES, bound_batches, tidy
from tessera.llm.words import LOWER, SPACE, U, mix

#: What the vocabulary's ``\s`` matches beyond ASCII, which no word holds; ASCII's are those of SPACE.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Their first bytes.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Begins the name of a piece that is given in byte symbols; no word holds it.
_SYMBOLS = "\n"
_EMPTY = hashlib.sha256(b"").hexdigest()
#: Letters below U+0250 but those whose lower case is longer or beyond; all Unicode versions agree on them.
_LETTERS = "".join(c for c in map(chr, range(0x80, 0x250)) if c.isalpha() and c.lower() < "\u0250" and len(c.lower()) == 1)
_LATIN = re.compile(f"[\x00-\x7f{_LETTERS}]*")
_PIECES = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^a-z0-9{_LETTERS}\n]+")
#: Of each byte the kind of piece that it stands in, in words of ASCII and the letters below U+0100; ' may begin a piece and 0 fills up rows.
_OTHER, _LETTER, _DIGIT, _ODD = range(4)
_KIND = np.array([_ODD if c in (0, 0x27) or c > 0xBF and c != 0xC3 else _LETTER if c > 0x7F or chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _OTHER for c in range(256)], np.uint8)
_NONE = np.zeros(1, np.uint8)
#: Most bytes of a piece in the arrays of the traversal; two 64-bit numbers hold them.
WIDTH = 16
#: Bits of the place of a pair of tokens in the arrays' memo.
PAIR_BITS = 21
#: Words, pieces of words and pairs of tokens that a worker's memos keep, each in two generations of this size.
MEMO_WORDS, MEMO_PIECES, MEMO_PAIRS = 450_000, 250_000, 300_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Table:
    """Numbers by keys of two 64-bit numbers, looked up exactly, many at once (open addressing); -1 where there is none."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, (4 * len(a)).bit_length())
        self._last, self._shift = size - 1, U(65 - size.bit_length())
        self._a, self._b, self._values = np.zeros(size, U), np.zeros(size, U), np.full(size, -1, np.int64)
        rest, at = np.arange(len(a)), self._place(a, b)
        while len(rest):
            free, first = np.unique(at[rest], return_index=True)
            first = first[self._values[free] < 0]
            put = rest[first]
            self._a[at[put]], self._b[at[put]], self._values[at[put]] = a[put], b[put], values[put]
            rest = np.delete(rest, first)
            at[rest] = (at[rest] + 1) & self._last

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * U(0x9E3779B97F4A7C15) + b * U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h *= U(0xBF58476D1CE4E5B9)
        h >>= self._shift
        return h.view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._place(a, b)
        out = self._values[at]
        other = np.flatnonzero((out >= 0) & ((self._a[at] != a) | (self._b[at] != b)))
        at = at[other]
        while len(other):
            at = (at + 1) & self._last
            out[other] = value = self._values[at]
            on = (value >= 0) & ((self._a[at] != a[other]) | (self._b[at] != b[other]))
            other, at = other[on], at[on]
        return out


def _loads(pieces: np.ndarray) -> list[np.ndarray]:
    """Of rows of WIDTH bytes the 8 bytes from each place on as a number; zeros follow the rows."""
    wide = np.zeros((len(pieces), WIDTH + 16), np.uint8)
    wide[:, :WIDTH] = pieces
    return [np.ascontiguousarray(wide[:, i : i + 8]).view("<u8")[:, 0] for i in range(WIDTH + 8)]


#: What is kept of the first and of the second number for so many bytes.
_FIRST = [U((1 << 8 * min(k, 8)) - 1) for k in range(WIDTH + 1)]
_SECOND = [U((1 << 8 * max(k - 8, 0)) - 1) for k in range(WIDTH + 1)]


def _gathered(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after the other, and where each ends, after a zero."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    at = np.repeat(begins - ends[:-1], counts)
    at += np.arange(len(at))
    return values[at], ends


class Levels:
    """The traversal in arrays, for pieces of 1 to WIDTH bytes without zero bytes."""

    def __init__(self, v: Vocabulary, to_byte: dict[str, int]) -> None:
        def table(tokens: dict[str, int]) -> Table:
            own = [(bytes(to_byte[c] for c in t), i) for t, i in tokens.items() if len(t) <= WIDTH and all(to_byte.get(c) for c in t)]
            rows = np.array([t for t, _ in own], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
            loads = _loads(rows)
            return Table(loads[0], loads[8], np.array([i for _, i in own], np.int64))

        self._inner, self._final = table(v.inner), table(v.final)
        pairs = np.array(list(v._joins), U).reshape(-1, 2)
        self._joins = Table(pairs[:, 0].copy(), pairs[:, 1].copy(), np.array(list(v._joins.values()), np.int64))
        self._rank, self._left, self._right = (np.zeros(max(v.names, default=0) + 1, np.int64) for _ in range(3))
        for i, made in v._made.items():
            self._rank[i], self._left[i], self._right[i] = made
        # a pair and its answer in one number at the pair's place; a later pair takes the place of an earlier one
        self._memo = np.full(1 << PAIR_BITS, -1, np.int64)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.stay_apart`` of many pairs."""
        pair = left << 31 | right
        at = (mix(pair.astype(U)) >> U(64 - PAIR_BITS)).astype(np.int64)
        held = self._memo[at]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            out[new] = self._undo(left[new], right[new])
            self._memo[at[new]] = pair[new] << 1 | out[new]
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        rows = np.arange(len(a))
        over_a = np.full(len(a), 1 << 60)
        over_b = over_a
        while len(rows):
            rank = self._joins.find(a.astype(U), b.astype(U))
            merged = (rank >= 0) & (rank < over_a) & (rank <= over_b)
            out[rows[merged]] = False
            x, y = self._rank[a], self._rank[b]
            on = ~merged & ((x >= 0) | (y >= 0))
            rows, a, b, over_a, over_b, x, y = (z[on] for z in (rows, a, b, over_a, over_b, x, y))
            of_a = x > y
            over_a, over_b = np.where(of_a, x, over_a), np.where(of_a, over_b, y)
            a, b = np.where(of_a, self._right[a], a), np.where(of_a, b, self._left[b])
        return out

    def encode(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each piece where its own begin there and how many they are. Pieces are rows of WIDTH bytes that differ, filled up with zeros."""
        order = np.lexsort(pieces.view(">u8").astype(U).T[::-1])
        found = rows = pieces[order]
        n, sizes, loads = len(rows), (rows != 0).sum(1), _loads(rows)
        # bytes that a piece shares with the one before it, and the size of that one
        shared = np.concatenate(([0], (rows[1:] != rows[:-1]).argmax(1)))
        before = np.concatenate(([0], sizes[:-1]))
        last, begins = np.zeros((2, WIDTH, n), np.int64)
        token, begin = np.zeros((2, n), np.int64)

        def solve(rows: np.ndarray, end: int, table: Table) -> tuple[np.ndarray, np.ndarray]:
            """The last token of the first ``end`` bytes of ``rows``, and where it begins."""
            token, begin = np.zeros((2, len(rows)), np.int64)
            open_ = np.arange(len(rows))
            for start in range(end - 1, -1, -1):
                size = end - start
                t = table.find(loads[start][rows] & _FIRST[size], loads[start + 8][rows] & _SECOND[size])
                ok = t >= 0
                if start:
                    some = np.flatnonzero(ok)
                    ok[some] = self._apart(last[start - 1][rows[some]], t[some])
                done = open_[ok]
                token[done], begin[done] = t[ok], start
                open_, rows = open_[~ok], rows[~ok]
                if not len(open_):
                    return token, begin
            raise ValueError(f"no token ends {found[rows[0], :end].tobytes()!r}")

        for end in range(1, int(sizes.max(initial=0)) + 1):
            on = np.flatnonzero(sizes > end)
            # pieces with one beginning are neighbours, the beginning itself before them: the first of them stands for the node
            first = (shared[on] < end) | (before[on] == end)
            if len(on):
                node = np.cumsum(first) - 1
                t, b = solve(on[first], end, self._inner)
                last[end - 1][on], begins[end - 1][on] = t[node], b[node]
            on = np.flatnonzero(sizes == end)
            if len(on):
                token[on], begin[on] = solve(on, end, self._final)
        out, counts = np.zeros((n, WIDTH), np.int64), np.ones(n, np.int64)
        out[:, -1] = token
        on = np.flatnonzero(begin)
        while len(on):
            counts[on] += 1
            out[on, WIDTH - counts[on]] = last[begin[on] - 1, on]
            begin[on] = begins[begin[on] - 1, on]
            on = on[begin[on] > 0]
        at, many = np.zeros((2, n), np.int64)
        at[order], many[order] = np.cumsum(counts) - counts, counts
        return out[np.arange(WIDTH) >= (WIDTH - counts)[:, None]], at, many


@dataclass
class Vocabulary:
    """Tokens and merges, indexed for the traversal. Symbols inside a word and at its end differ."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    suffix: str
    names: dict[int, str] = field(default_factory=dict)
    inner: dict[str, int] = field(default_factory=dict)
    final: dict[str, int] = field(default_factory=dict)
    _apart: dict[int, bool] = field(default_factory=dict)
    #: Of each token the rank of the merge that makes it (-1: none), and the tokens that it merges.
    _made: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    _joins: dict[tuple[int, int], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        made = {a + b for a, b in self.ranks}
        size = len(self.suffix)
        steps: dict[int, list[str]] = {}
        for token, i in self.ids.items():
            self.names[i] = token
            last = token.endswith(self.suffix) and len(token) > size
            plain = token[:-size] if last else token
            if len(plain) > 1 and token not in made:
                continue  # no encoding can end in it
            step = self.merged(self.symbols(plain, last), 2)
            if len(step) > 2 or len(step) == 2 and tuple(step) not in self.ranks:
                continue
            (self.final if last else self.inner)[plain] = i
            steps[i] = step
        for (a, b), rank in self.ranks.items():
            if a in self.ids and b in self.ids:
                self._joins[self.ids[a], self.ids[b]] = rank
        for i, step in steps.items():
            if len(step) == 2 and all(x in self.ids for x in step):
                self._made[i] = self.ranks[step[0], step[1]], self.ids[step[0]], self.ids[step[1]]
            else:
                self._made[i] = -1, i, i

    def symbols(self, plain: str, last: bool) -> list[str]:
        return [*plain[:-1], plain[-1] + self.suffix] if last and self.suffix else list(plain)

    def merged(self, parts: list[str], least: int = 1) -> list[str]:
        """Merges by rank, leftmost first, down to ``least`` parts: the definition, used on tokens only."""
        parts = list(parts)
        never, rank_of = 1 << 60, self.ranks.get
        ranks = [rank_of(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while len(parts) > least and (rank := min(ranks)) < never:
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), never)
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens in a row are the encoding of their text.

        They aren't if a merge across their border comes before a merge inside either of them that would hide one of
        its sides. So the steps that made both are undone from the latest on, which bares the tokens at the border one
        by one, and each pair of neighbours there is asked whether it merges earlier than what hides it.
        """
        if len(self._apart) > MEMO_PAIRS:
            self._apart.clear()
        made, joins = self._made, self._joins
        a, b = left, right
        # the merge that hides a, and that which hides b: what merges at the border has to come before both
        over_a = over_b = 1 << 60
        apart = True
        while True:
            rank = joins.get((a, b))
            # a merge of equal rank goes from left to right: the one inside the left token comes first, that inside the right one after
            if rank is not None and rank < over_a and rank <= over_b:
                apart = False
                break
            x, y = made[a], made[b]
            if x[0] < 0 and y[0] < 0:
                break
            if x[0] > y[0] or x[0] == y[0] and y[0] < 0:
                over_a, a = x[0], x[2]
            else:
                over_b, b = y[0], y[1]
        self._apart[left << 32 | right] = apart
        return apart

    def encode_all(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its token ids. Sorted words are the trie's leaves in depth-first order.

        The path from the root is kept as two lists: of each prefix the last token, and that token's first symbol.
        """
        inner, final, apart, check = self.inner.get, self.final.get, self._apart.get, self.stay_apart
        tokens: list[int] = []
        begins: list[int] = []
        before = ""
        for word in sorted(words):
            n = len(word)
            depth, limit = 0, min(len(tokens), n - 1)
            while depth < limit and before[depth] == word[depth]:
                depth += 1
            del tokens[depth:], begins[depth:]
            for end in range(depth + 1, n + 1):
                find = inner if end < n else final
                start = end - 1
                while start >= 0:
                    token = find(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        left = tokens[start - 1]
                        ok = apart(left << 32 | token)
                        if ok or ok is None and check(left, token):
                            break
                    start -= 1
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                if end < n:
                    tokens.append(token)
                    begins.append(start)
            out = [token]
            while start:
                out.append(tokens[start - 1])
                start = begins[start - 1]
            out.reverse()
            yield word, out
            before = word


class Codec:
    """Whole texts to token ids and back, as the vocabulary file describes it."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        d = json.loads(spec)
        model = d["model"]
        if model["type"] != "BPE" or d.get("decoder") or d.get("post_processor") or not model.get("end_of_word_suffix"):
            raise ValueError("a word-end BPE file without decoder and post-processor is needed")
        ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocabulary = Vocabulary(model["vocab"], ranks, model["end_of_word_suffix"])
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self._special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self._rules = Tokenizer.from_str(spec)  # its normaliser and splitter, for words of other letters
        self._bytes = _byte_symbols()
        self._of_symbol = {c: i for i, c in enumerate(self._bytes)}
        self._levels = Levels(self.vocabulary, self._of_symbol)
        self._names = {**self.vocabulary.names, **{i: s for s, i in self.special.items()}}
        most = max(self._names, default=0)
        #: What ids are packed as.
        self.kind = np.dtype(np.uint16 if most < (1 << 16) - 2 else np.uint32)
        self._packed = [np.array(i, self.kind).tobytes() for i in range(most + 1)]
        # each id's decimal and name with the space that follows it, so that taking them joins them
        self._decimals = pa.array([f"{i} " for i in range(most + 1)], pa.large_string())
        self._spaced = pa.array([f"{n} " if (n := self._names.get(i)) is not None else "" for i in range(most + 1)], pa.large_string())
        # what is asked for again moves from the old generation to the young one; a full young one becomes the old
        self._memo: dict[str, bytes] = {}
        self._old_memo: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._old_pieces: dict[str, bytes] = {}

    def _split(self, word: str) -> list[str]:
        """The pieces of a word that isn't plain, named for the memo: letters as they are, or _SYMBOLS and byte symbols; a special token stands alone."""
        if "<|" in word and self._special.search(word):
            out = []
            for part in self._special.split(word):
                if part:
                    out += [part] if part in self.special else self._split(part)
            return out
        if _LATIN.fullmatch(word):
            return _PIECES.findall(word.lower())
        return [_SYMBOLS + p for p, _ in self._rules.pre_tokenizer.pre_tokenize_str(self._rules.normalizer.normalize_str(word))]

    def _bytes_of(self, piece: str) -> bytes:
        return bytes(self._of_symbol[c] for c in piece[1:]) if piece[0] == _SYMBOLS else piece.encode()

    def _solve(self, new: list[str]) -> None:
        """Fill the memo of pieces with such that it lacks."""
        known, packed = self._pieces, self._packed
        named = {self._bytes_of(p): p for p in new}
        short = [x for x in named if len(x) <= WIDTH and 0 not in x]
        ids, begins, counts = self._levels.encode(np.array(short, f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH))
        raw, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        known.update((named[x], raw[i * size : (i + n) * size]) for x, i, n in zip(short, begins.tolist(), counts.tolist(), strict=True))
        if len(short) < len(named):
            long = {"".join([self._bytes[c] for c in x]): p for x, p in named.items() if len(x) > WIDTH or 0 in x}
            for symbols, ids in self.vocabulary.encode_all(long):
                known[long[symbols]] = b"".join([packed[i] for i in ids])
        if len(named) < len(new):  # one piece under two names
            known.update((p, known[named[self._bytes_of(p)]]) for p in new if p not in known)

    def _learn(self, words: list[str]) -> None:
        """Fill the memo with words that it lacks: all their new pieces in one traversal."""
        if len(self._pieces) > MEMO_PIECES:
            self._pieces, self._old_pieces = {}, self._pieces
        known, old, packed = self._pieces, self._old_pieces, self._packed
        for s, i in self.special.items():
            known[s] = packed[i]
        # words of Latin letters are cut all at once; each word's end is a piece without ids
        known["\n"] = b""
        plain = _LATIN.fullmatch
        odd = [w for w in words if "<|" in w or not (w.isascii() or plain(w))]
        if odd:
            apart = set(odd)
            words = [w for w in words if w not in apart]
        pieces = _PIECES.findall("\n".join([*words, ""]).lower())
        for w in odd:
            pieces += self._split(w)
            pieces.append("\n")
        new = set(pieces) - known.keys()
        again = new & old.keys()
        known.update((p, old[p]) for p in again)
        new -= again
        if new:
            self._solve(list(new))
        ids = list(map(known.__getitem__, pieces))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.cumsum(sizes)[sizes == 0].tolist()
        raw = b"".join(ids)
        self._memo.update(zip([*words, *odd], map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    @staticmethod
    def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of the texts; ``bounds[i]:bounds[i+1]`` are those of text i."""
        raw = [t.encode() for t in texts]
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in raw], out=at[1:])
        whole = b"\n".join([*raw, b""])
        buf = np.frombuffer(whole, np.uint8)
        if _LEADS[buf].any() and _WIDE.search(whole):
            buf = np.frombuffer(_WIDE.sub(lambda m: b" " * len(m[0]), whole), np.uint8)
        word = ~SPACE[buf]
        edges = np.flatnonzero(np.diff(word, prepend=False))
        starts = edges[::2]
        ends = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(edges[1::2] - starts, out=ends[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(buf[word]))
        return words.dictionary_encode(), np.searchsorted(starts, at)

    def _plain(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where those of each word begin there and how many they are, and the words that are left out: all but those of ASCII and letters below U+0100."""
        n = len(words)
        at = np.frombuffer(words.buffers()[1], np.int64, n + 1)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: at[-1]]
        kind, before = _KIND[raw], np.concatenate((_NONE, raw[:-1]))
        odd = kind == _ODD
        after = before == 0xC3
        odd |= after & ((raw == 0x97) | (raw == 0xB7)) | (before == 0x3C) & (raw == 0x7C)
        lower = LOWER[raw]
        lower[after & (raw < 0x9F)] += 0x20
        # a piece begins with a word, with another kind of bytes, and with each digit
        first = kind == _DIGIT
        first[1:] |= kind[1:] != kind[:-1]
        first[at[:-1]] = True
        begins = np.flatnonzero(first)
        bounds = np.searchsorted(begins, at)
        sizes = np.diff(begins, append=len(raw))
        left = np.zeros(n, bool)
        left[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
        left[np.searchsorted(at, begins[sizes > WIDTH], "right") - 1] = True
        of_word = np.repeat(np.arange(n), np.diff(bounds))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(lower)])
        if left.any():
            keep = ~left[of_word]
            pieces, of_word = pieces.filter(pa.array(keep)), of_word[keep]
        pieces = pieces.dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
        bytes_ = np.concatenate((np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[: ends[-1]], np.zeros(WIDTH, np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(bytes_, WIDTH)[ends[:-1]]
        rows[np.arange(WIDTH) >= np.diff(ends)[:, None]] = 0
        ids, begins, counts = self._levels.encode(rows)
        ids, ends = _gathered(ids, begins[which], counts[which])
        many = np.bincount(of_word, counts[which], n).astype(np.int64)
        return ids, np.cumsum(many) - many, many, np.flatnonzero(left)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as ``kind``."""
        words, bounds = self._words(texts)
        ids, begins, counts, left = self._plain(words.dictionary)
        ids = ids.astype(self.kind)
        if len(left):
            size = self.kind.itemsize
            packed = self._odd_words(words.dictionary.take(pa.array(left)).to_numpy(zero_copy_only=False).tolist())
            counts[left] = np.fromiter(map(len, packed), np.int64, len(packed)) // size
            begins[left] = len(ids) + np.cumsum(counts[left]) - counts[left]
            ids = np.concatenate((ids, np.frombuffer(b"".join(packed), self.kind)))
        at = words.indices.to_numpy()
        ids, ends = _gathered(ids, begins[at], counts[at])
        raw = ids.tobytes()
        cuts = (ends[bounds] * self.kind.itemsize).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _odd_words(self, words: list[str]) -> list[bytes]:
        """The packed ids of words that aren't plain, from the memo."""
        if len(self._memo) > MEMO_WORDS:
            self._memo, self._old_memo = {}, self._memo
        memo, old = self._memo, self._old_memo
        new = [w for w in words if w not in memo]
        memo.update((w, x) for w in new if (x := old.get(w)) is not None)
        if new := [w for w in new if w not in memo]:
            gc.disable()  # strings and pairs of them make no cycles
            try:
                self._learn(new)
            finally:
                gc.enable()
        return list(map(memo.__getitem__, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(x, self.kind) for x in self.encode_packed(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by one space, as the vocabulary's file has no decoder; unknown ids are left out."""
        return " ".join(n for i in ids if (n := self._names.get(i)) is not None)

    @staticmethod
    def _joined(strings: pa.Array, ids: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
        """The strings of the ids of each text, one after the other, without the last space; texts end at ``ends``."""
        taken = strings.take(ids)
        at = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[ends].tolist()
        whole = memoryview(taken.buffers()[2] or b"")
        for a, b in zip([0, *at], at, strict=False):
            yield whole[a : max(a, b - 1)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, and SHA-256 of the ids and of the text that these ids decode to."""
        packed = self.encode_packed(texts)
        sizes = np.array([len(x) for x in packed], np.int64) // self.kind.itemsize
        ids = pa.array(np.frombuffer(b"".join(packed), self.kind))
        if not len(ids):
            return [(0, _EMPTY, _EMPTY)] * len(texts)
        ends = np.cumsum(sizes)
        numbers = [hashlib.sha256(x).hexdigest() for x in self._joined(self._decimals, ids, ends)]
        decoded = [hashlib.sha256(x).hexdigest() for x in self._joined(self._spaced, ids, ends)]
        return list(zip(sizes.tolist(), numbers, decoded, strict=True))


_codecs: dict[str, Codec] = {}
CACHES["bpe"] = _codecs.clear


def codec(spec: str) -> Codec:
    """One codec for each worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def vocabulary_file(path: str | None = None) -> str:
    """The text of a vocabulary file; by default the public word BPE of 49k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def text_runs(texts: list[str | None], size: int = 1 << 22) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters, which bounds what a traversal holds."""
    run: list[str] = []
    total = 0
    for t in texts:
        if run and total + len(t or "") > size:
            yield run
            run, total = [], 0
        run.append(t or "")
        total += len(t or "")
    if run:
        yield run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.

    A null or empty text has no tokens. Rows with equal ids stay apart; a null id stays null.
    The vocabulary (a file of bounded size, read on the driver) travels as a broadcast value.
    """
    bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_file(vocabulary))
    out = T.StructType().add("id", "long").add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [r for part in text_runs(texts) for r in c.digests(part)]
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            if with_ids:
                ids = [x.tolist() for part in text_runs(texts) for x in c.encode(part)]
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, out.names)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy("bpe", run), out)
