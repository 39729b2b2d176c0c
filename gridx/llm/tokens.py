"""Token counts and ids of whole texts with public tokenizer files.

For counts a text is cut into units whose tokens do not depend on their neighbours, words between white space. Units
are hashed in numpy; each distinct unit is looked into once per task and kept in a bounded cache.

Prefix table. The exact number of tokens of every prefix of a text, P(p), is stored as its changes from byte to byte.
Across units P(e_i-1 + p) = P(e_i-1) + inner(i, p); inside a unit the counts come from dynamic programming over the
unit's own prefixes, once for each distinct unit. So the count of a prefix, the longest prefix within a token budget
and the whole count are look-ups in the table; no text is encoded again. Units that are not in composed form, or that
hold white space beyond ASCII, get their counts from the library, prefix by prefix.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridx.llm import textvec as tv
from gridx.llm.common import texts

U = np.uint64
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
CACHE_UNITS = 500_000
SLOTS = 1 << 20
#: Remembered pairs of tokens that may or may not follow one another, remembered prefixes, their longest, and remembered pieces.
FOLLOWS, STATES, KEPT, PIECES = 200_000, 300_000, 32, 150_000
# Fixed value: the pieces into which the word vocabulary's tokenizer cuts a text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Units:
    """Bounded cache of lists of numbers, one a unit, looked up by the units' 64-bit hashes for a whole batch at once."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = CACHE_UNITS) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.slot_key, self.slot_at = np.zeros(SLOTS, U), np.full(SLOTS, -1, np.int64)
        self.sorted, self.sorted_at = np.zeros(0, U), np.zeros(0, np.int64)

    def look_up(self, data: np.ndarray, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Cache entry of every unit [s, e)."""
        _, inverse = tv._powers(len(prefix))
        h = tv.mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U))
        if len(self.keys) > self.most:
            self._clear()
        slot = (h & U(SLOTS - 1)).astype(np.int64)
        at = np.where(self.slot_key[slot] == h, self.slot_at[slot], -1)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            distinct, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            place = np.searchsorted(self.sorted, distinct)
            place[place == len(self.sorted)] = 0
            known = self.sorted[place] == distinct if len(self.sorted) else np.zeros(len(distinct), bool)
            entry = np.where(known, self.sorted_at[place] if len(self.sorted) else 0, -1)
            new = np.flatnonzero(~known)
            if len(new):
                raw = data.tobytes()
                rows = miss[first[new]]
                found = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[rows].tolist(), e[rows].tolist(), strict=True)])
                count = np.fromiter(map(len, found), np.int32, len(found))
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
                while self.used + len(flat) > len(self.ids):
                    self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.int32)))
                self.ids[self.used : self.used + len(flat)] = flat
                begin = self.used + np.cumsum(count) - count
                self.used += len(flat)
                entry[new] = len(self.keys) + np.arange(len(new))
                self.keys = np.concatenate((self.keys, distinct[new]))
                self.first, self.count = np.concatenate((self.first, begin)), np.concatenate((self.count, count))
                order = np.argsort(self.keys)
                self.sorted, self.sorted_at = self.keys[order], order
            own = (distinct & U(SLOTS - 1)).astype(np.int64)
            self.slot_key[own], self.slot_at[own] = distinct, entry
            at[miss] = entry[back.reshape(-1)]
        return at


# How the byte-level vocabulary's tokenizer cuts a text, and the symbols that stand for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_PRINTABLE)]
SYMBOL = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_REST)}
SYMBOLS = str.maketrans({chr(b): c for b, c in SYMBOL.items()})

# Bytes of which a text must be made, beside printable ASCII and white space, to be cut by ranks: lead bytes of Latin,
# Greek, Cyrillic, Hebrew and Han letters and of symbols beyond the basic plane, and continuation bytes.
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 11, 12, 13]] = True
_PLAIN[32:127] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[0xC3:0xD8] = True
_PLAIN[0xE4:0xEA] = True


class ByteLevel:
    """Token ids of whole texts with a byte-level vocabulary file of the tokenizers library.

    The file's merges are in the order of their tokens' ids, which is checked, so a faster library that merges by ranks
    gives the same ids. Texts with a special string's start, or with characters on whose class the two libraries'
    character tables might differ, are encoded by the tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        vocabulary = raw["model"]["vocab"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in raw["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        byte = {c: b for b, c in SYMBOL.items()}
        special = {x["content"] for x in raw["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.library = load(path)
        self.by_ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def batches(self, batch_texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first row, last row, ids of each text) for bounded chunks of a batch."""
        data, off = tv.buffers(batch_texts)
        for i, j in tv.chunks(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            odd = ~_PLAIN[d]
            odd[:-1] |= (d[:-1] == 0x3C) & (d[1:] == 0x7C)
            total = np.concatenate(([0], np.cumsum(odd)))
            hard = total[o[1:]] > total[o[:-1]]
            raw = d.tobytes()
            strings = [raw[a:b].decode() for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            yield i, j, [np.array(self.library.encode(x, add_special_tokens=False).ids if h else self.by_ranks.encode_ordinary(x), "<u4") for x, h in zip(strings, hard, strict=True)]


class PrefixCounts:
    """Exact token counts of every prefix of a unit, by dynamic programming over its prefixes.

    A sequence of tokens is what the merges make of a piece exactly if every two neighbours are. So one token ends
    each prefix: the one that may follow the last token of the prefix before it, and the count is one more than
    there. `plain` holds the last token of each prefix whose word goes on; a prefix that is cut there ends in a
    token with the mark of the word's end, which again follows some `plain` token. Work grows with the piece's
    length, and which tokens may follow one another is remembered.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        self.tokenizer = load(path)
        self.vocabulary, self.end = raw["model"]["vocab"], raw["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(pairs)}
        self.most = max(map(len, self.vocabulary))
        self.special = [x["content"] for x in raw["added_tokens"]]
        ends = {t[: -len(self.end)] for t in self.vocabulary if t.endswith(self.end)}
        self.tokens = ({t for t in self.vocabulary if not t.endswith(self.end)}, ends)
        self.may_follow: dict[tuple[str, str], bool] = {}
        self.may_end: dict[tuple[str, str], bool] = {}
        self.prefixes: dict[str, tuple[str, int, int]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.last: tuple[str, list[str], list[int], list[int]] = ("", [""], [0], [])

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, the lowest rank first, the leftmost among equals."""
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == len(self.rank):
                break
            k = ranks.index(least)
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
        return symbols

    def follow(self, one: str, two: str, last: bool) -> bool:
        """May token two follow token one (none if empty)? With last, two ends the word."""
        symbols = list(one + two)
        end = two + self.end if last else two
        if last:
            symbols[-1] += self.end
        return self.merged(symbols) == ([one, end] if one else [end])

    def piece(self, symbols: str) -> list[int]:
        """Tokens of each prefix of a piece, the word ending there. What is known of a prefix of up to KEPT symbols, the
        last plain token and both counts, is kept for later pieces that begin alike; what the piece before has is there."""
        before, plain, plain_count, counts = self.last
        same = 0
        for x, y in zip(before, symbols):
            if x != y:
                break
            same += 1
        plain, plain_count, counts = plain[: same + 1], plain_count[: same + 1], counts[:same]
        known, follows = self.prefixes, (self.may_follow, self.may_end)
        if len(known) > STATES:
            known.clear()
        for i in range(same + 1, len(symbols) + 1):
            state = known.get(symbols[:i]) if i <= KEPT else None
            if state is None:
                state = self._state(symbols, i, plain, plain_count, follows)
                if i <= KEPT:
                    known[symbols[:i]] = state
            plain.append(state[0])
            plain_count.append(state[1])
            counts.append(state[2])
        if len(symbols) > 3:
            self.last = symbols, plain, plain_count, counts
        return counts

    def _state(self, symbols: str, i: int, plain: list[str], plain_count: list[int], follows) -> tuple[str, int, int]:
        """(last token, tokens, tokens if the word ends here) of the first i symbols, from the shorter prefixes."""
        tokens, ends = self.tokens
        goes_on = stops = None
        for low in range(i - 1, max(-1, i - 1 - self.most), -1):
            token = symbols[low:i]
            if goes_on is None and token in tokens:
                pair = plain[low], token
                may = follows[0].get(pair)
                if may is None:
                    may = self._remember(follows[0], pair, False)
                if may:
                    goes_on = low
                    if stops is not None:
                        break
            if stops is None and token in ends:
                pair = plain[low], token
                may = follows[1].get(pair)
                if may is None:
                    may = self._remember(follows[1], pair, True)
                if may:
                    stops = low
                    if goes_on is not None:
                        break
        if goes_on is None or stops is None:
            raise ValueError(f"the vocabulary cannot write {symbols!r}")
        return symbols[goes_on:i], plain_count[goes_on] + 1, plain_count[stops] + 1

    def _remember(self, memory: dict, pair: tuple[str, str], last: bool) -> bool:
        if len(memory) > FOLLOWS:
            memory.clear()
        found = memory[pair] = self.follow(*pair, last)
        return found

    def _run(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special strings and white space, lower case, composed."""
        if text.isalpha():
            return self._whole(text)
        out, before = [], 0
        for m in PIECE.finditer(text):
            part = m[0]
            counts = self._whole(part)
            if len(part) > 1 and part[0] == "'" and part[1].isalpha():  # cut inside, it is a quote and letters
                counts = [*(self.piece("'")[0] + (self.piece(part[1:k])[-1] if k > 1 else 0) for k in range(1, len(part))), counts[-1]]
            out += [before + n for n in counts] if before else counts
            before += counts[-1]
        return out

    def _whole(self, part: str) -> list[int]:
        """Tokens of each prefix, by characters, of one piece; those of recent pieces are kept."""
        found = self.pieces.get(part)
        if found is None:
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            found = self.pieces[part] = self._counted(part)
        return found

    def _counted(self, part: str) -> list[int]:
        if part.isascii() and part.isprintable():  # its characters are their own symbols
            return self.piece(part)
        whole = self.piece(part.encode().decode("latin-1").translate(SYMBOLS))
        return [whole[e - 1] for e in accumulate(1 if c < "\x80" else len(c.encode()) for c in part)]

    def counts(self, text: str) -> list[int]:
        """Tokens of each prefix, by characters, of a text without ASCII white space."""
        if text.isascii():
            lower = text.lower()
        else:
            lower = "".join(map(str.lower, text))
            if len(lower) != len(text) or not unicodedata.is_normalized("NFC", text) or len(text.split()) > 1 or text[0].isspace() or text[-1].isspace():
                return [len(x.ids) for x in self.tokenizer.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)]
        if "<|" not in text:
            return self._run(lower)
        out, at, base = [], 0, 0
        while at < len(text):
            found = min(((p, x) for x in self.special if (p := text.find(x, at)) >= 0), default=None)
            stop = len(text) if found is None else found[0] + len(found[1]) - 1
            counts = self._run(lower[at:stop])
            out += [base + n for n in counts]
            if found is None:
                break
            base += 1 + (counts[found[0] - at - 1] if found[0] > at else 0)
            out.append(base)
            at = stop + 1
        return out

    def steps(self, texts_: list[str]) -> list[list[int]]:
        """For each text and byte: how the count changes when the byte is added, all at a character's last byte."""
        out: list = [None] * len(texts_)
        for k in sorted(range(len(texts_)), key=texts_.__getitem__):  # so that neighbours begin alike
            text = texts_[k]
            counts = self.counts(text)
            changes = list(map(sub, counts, chain((0,), counts)))
            if not text.isascii():
                changes = [x for c, d in zip(text, changes, strict=True) for x in (*[0] * (len(c.encode()) - 1), d)]
            out[k] = changes
        return out


@lru_cache(maxsize=1)
def _units_of(path: str) -> Units:
    """The worker's bounded cache of units, for all tasks that it runs."""
    return Units(PrefixCounts(path).steps)


_PREFIXES = "doc_id long, n_bytes long, n_tokens long, steps binary"


def _prefixes(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("steps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units_of(path)
        gc.disable()  # counting makes millions of lists and no cycles
        for batch in batches:
            data, off = tv.buffers(batch.column("text"))
            for i, j in tv.chunks(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, _ = tv.words(d, o)
                steps = np.zeros(len(d), np.int8)
                if len(s):
                    # the vocabulary is of lower case, so A-Z does not matter, but in special strings
                    special = bool(((d[:-1] == 0x3C) & (d[1:] == 0x7C)).any())
                    at = units.look_up(d, tv.prefix_hash(d, lower=not special), s, e)
                    size = e - s
                    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    found = units.ids[place + np.repeat(units.first[at], size)]
                    if found.max() > 127 or found.min() < -128:
                        raise ValueError("a count changes by more than one byte holds")
                    steps[place + np.repeat(s, size)] = found
                total = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))[o]
                blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(o.tobytes()), pa.py_buffer(steps.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(o)), pa.array(np.diff(total)), blob], schema=schema)
        gc.enable()
        tv.tidy()

    return run


def token_prefixes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The prefix table of every text: doc_id, n_bytes, n_tokens (its last entry) and steps, one signed byte per byte
    of the text, whose running sum is the exact number of tokens of every prefix.

    A null text is the empty text; texts that are empty or white space have no tokens; repeated rows and null ids are
    kept as they come; extra columns are ignored; an empty table gives an empty result.
    """
    return texts(docs).mapInArrow(_prefixes(path or vocabulary_path(WORD_VOCABULARY)), _PREFIXES)


class PrefixTable:
    """Answers about one text from its stored prefix table; nothing is encoded."""

    def __init__(self, text: str, steps: bytes) -> None:
        raw = np.frombuffer(text.encode(), np.uint8)
        self.counts = np.concatenate(([0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)))
        self.whole = np.append((raw & 0xC0) != 0x80, True)  # a prefix of so many bytes ends with a whole character

    def total(self) -> int:
        return int(self.counts[-1])

    def count(self, n_bytes: int) -> int:
        """Tokens of the first n_bytes bytes (cut back to a whole character)."""
        return int(self.counts[min(n_bytes, len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """Bytes of the longest prefix of at most `budget` tokens that ends with a whole character."""
        fits = np.flatnonzero((self.counts <= budget) & self.whole)
        return int(fits[-1]) if len(fits) else 0
