"""Exact tokenizer output through caches of chunks, which live as long as a Python worker.

A text may be cut wherever a tokenizer always ends a pre-token, so the ids of a text are those of its chunks in order. Texts that
hold a special string are encoded whole."""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

from beamlake.llm.base import U64, mixed, stretch_hashes, stretches

#: Entries of a worker's cache (chunk ids: some 40 MB; counts: 70 MB).
CACHE_ENTRIES = 600_000
_state: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    if ("t", path) not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state["t", path] = Tokenizer.from_file(path)
    return _state["t", path]


def _fresh(kind: str, path: str, wanted: set[str], frequent: dict) -> dict:
    """The worker's cache; a full one keeps its older half, since common words are met first, and what this batch wants."""
    cache = _state.get((kind, path))
    if cache is None:
        cache = _state[kind, path] = dict(frequent)
    elif len(cache) > CACHE_ENTRIES:
        cache = _state[kind, path] = frequent | {w: cache[w] for w in wanted if w in cache} | dict(islice(cache.items(), CACHE_ENTRIES // 2))
    return cache


#: By byte: 0 space or line feed, 1 an ASCII letter, 2 other ASCII, 3 a part of another character.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, 0x0A]], _KIND[128:] = 0, 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_VALUES = [mixed(np.arange(1, 257, dtype=U64) * U64(x)) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of chunks: between spaces and line feeds, and cut where a letter (ASCII or Latin-1) meets other ASCII.

    Both are never inside a pre-token and no character composes across them, so a text's ids are those of its chunks in order."""
    kind = _KIND[raw]
    solid = kind != 0
    letter = kind == 1
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut = np.zeros(len(raw), bool)
    cut[1:] = letter[:-1] & (kind[1:] == 2)
    start, end = solid & cut, cut
    start[1:] |= solid[1:] & ~solid[:-1]
    end[1:] |= ~solid[1:] & solid[:-1]
    start[:1] = solid[:1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, np.append(ends, len(raw)) if len(starts) > len(ends) else ends


class WordCache:
    """Ids of chunks by a 64-bit hash and a 32-bit check, in flat arrays: open addressing, looked up a batch at a time."""

    def __init__(self, path: str):
        self.path, self.bits = path, max(4, (2 * CACHE_ENTRIES - 1).bit_length())
        words = tokenizer(path).get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)  # which ids end a pre-token
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.checks, self.start, self.length, self.ids = np.empty(0, U64), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        out = np.full(len(key), -1, np.int64)
        if not len(self.keys):
            return out
        mask = (1 << self.bits) - 1
        todo, at = np.arange(len(key)), (key & U64(mask)).astype(np.int64)
        while len(todo):
            entry = self.slots[at]
            hit = (entry >= 0) & (self.keys[entry] == key[todo]) & (self.checks[entry] == check[todo])
            out[todo[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            todo, at = todo[on], (at[on] + 1) & mask
        return out

    def _place(self, first: int) -> None:
        mask = (1 << self.bits) - 1
        todo = np.arange(first, len(self.keys))
        at = (self.keys[todo] & U64(mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            on = self.slots[at] != todo
            todo, at = todo[on], (at[on] + 1) & mask

    def shrink(self) -> None:
        """Keeps the older half: common chunks are met first."""
        n = min(len(self.keys), CACHE_ENTRIES // 2)
        held = self.keys[:n], self.checks[:n], self.start[:n], self.length[:n], self.ids[: int(self.length[:n].sum())]
        self._empty()
        self.keys, self.checks, self.start, self.length, self.ids = held
        self._place(0)

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[bytes]) -> None:
        first, size = len(self.keys), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        end = np.cumsum(size) + len(self.ids)
        self.keys, self.checks = np.append(self.keys, key), np.append(self.checks, check)
        self.start, self.length = np.append(self.start, end - size), np.append(self.length, size)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
        if 2 * len(self.keys) > 1 << self.bits:  # a batch with more distinct chunks than the cache is meant for
            while 2 * len(self.keys) > 1 << self.bits:
                self.bits += 1
            self.slots, first = np.full(1 << self.bits, -1, np.int32), 0
        self._place(first)

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """By the library. Plain words go as one text, whose ids are told apart by the ends of words; other chunks one by one."""
        t, out = tokenizer(self.path), [b""] * len(chunks)
        words = [c.decode("utf-8", "surrogatepass") for c in chunks]
        plain = [i for i, w in enumerate(words) if _PLAIN(w)]
        odd = [i for i, w in enumerate(words) if not _PLAIN(w)]
        if plain:
            ids = np.array(t.encode_batch_fast([" ".join([words[i] for i in plain])], add_special_tokens=False)[0].ids, "<u4")
            raw, end = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(end) == len(plain):
                for i, a, b in zip(plain, [0, *end[:-1]], end, strict=True):
                    out[i] = raw[a:b]
            else:
                odd += plain
        for i, e in zip(odd, t.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def lookup(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each chunk in raw, ids up to its end, all ids in order)."""
        every, parts = np.frombuffer(raw, np.uint8), []
        for at, end in stretches(raw, b" \n"):
            piece = every[at:end]
            starts, ends = _cuts(piece)
            key, check = (stretch_hashes(piece, starts, ends, v) for v in _VALUES)
            parts.append((starts + at, ends + at, mixed(key), (check >> U64(32)).astype(np.uint32)))
        starts, ends, key, check = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.uint32))
        entry = self.find(key, check)
        missing = np.flatnonzero(entry < 0)
        if len(missing) and len(self.keys) > CACHE_ENTRIES:
            self.shrink()
            entry = self.find(key, check)
            missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, one = np.unique(key[missing], return_index=True)
            new = missing[one]
            self.add(key[new], check[new], self.encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
            entry = self.find(key, check)
        size = self.length[entry]
        end = np.cumsum(size)
        ids = self.ids[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.start[entry] - (end - size), size)]
        return starts, end, ids


#: Words of lower-case Latin letters, which NFC and lower-casing leave alone: one pre-token each.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _lowered(text: str) -> bytes:
    """ASCII letters lowered, which the tokenizer does too; not where a combining mark may follow, with which they compose first."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()


def forget_words() -> None:
    """Frees the worker's cache of chunks; workers outlive the stage that filled it."""
    for key in [k for k in _state if k[0] == "words"]:
        del _state[key]


def word_ids(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text (null: none) by the lower-casing word tokenizer."""
    if ("words", path) not in _state:
        _state["words", path] = WordCache(path)
    whole = {i for i, x in enumerate(texts) if x and "<|" in x}
    raws = [b"" if i in whole or not x else _lowered(x) for i, x in enumerate(texts)]
    starts, end, ids = _state["words", path].lookup(b"\n".join(raws))
    begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
    at = 4 * np.append(0, end)[np.searchsorted(starts, begin)]
    flat = ids.astype("<u4", copy=False).tobytes()
    out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for i in whole:
        out[i] = np.array(tokenizer(path).encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
    return out


_IRREGULAR = re.compile(r"[^\S \n]|[ \n][ \n]")


def byte_chunks(text: str) -> tuple[list[str], list[str], int] | None:
    """(line starts, words after one space, line feeds) or None if the text must be encoded whole.

    Single spaces and line feeds between other characters: a space opens the next pre-token, a line feed is one of its own."""
    if "<|endoftext|>" in text or not text or text[0].isspace() or text[-1].isspace() or _IRREGULAR.search(text):
        return None
    if "\n" not in text:
        first, *rest = text.split(" ")
        return [first], rest, 0
    lines = [x.split(" ") for x in text.split("\n")]
    return [x[0] for x in lines], [w for x in lines for w in x[1:]], len(lines) - 1


def byte_counts(texts: list[str | None], path: str, frequent: dict[str, int]) -> list[int]:
    """Tokens of each text by the byte-level tokenizer; frequent has the counts of common words after a space."""
    t = tokenizer(path)
    parts = [byte_chunks(x or "") for x in texts]
    wanted, starts = set().union(*(p[1] for p in parts if p)), set().union(*(p[0] for p in parts if p))
    inner, first = _fresh("inner", path, wanted, frequent), _fresh("first", path, starts, {})
    for cache, new, lead in ((inner, list(wanted.difference(inner)), " "), (first, list(starts.difference(first)), "")):
        if new:
            for w, e in zip(new, t.encode_batch_fast([lead + w for w in new], add_special_tokens=False), strict=True):
                cache[w] = len(e.ids)
    a, b = first.__getitem__, inner.__getitem__
    whole = {i: x for i, (x, p) in enumerate(zip(texts, parts, strict=True)) if p is None and x}
    of_whole = dict(zip(whole, (len(e.ids) for e in t.encode_batch_fast(list(whole.values()), add_special_tokens=False)), strict=True)) if whole else {}
    return [of_whole.get(i, 0) if p is None else sum(map(a, p[0])) + sum(map(b, p[1])) + p[2] for i, p in enumerate(parts)]
