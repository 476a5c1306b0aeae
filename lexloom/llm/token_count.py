"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

The vocabulary file is a parameter. Added special tokens count one each where their string
stands in a text, as the ``tokenizers`` library does by default. Files that ask for anything but
byte-level merging with the usual pattern (normalizers, prefix spaces, word ends, dropout, merges
that whole tokens skip) are an error: their counts would be others.

Nulls and empty texts count 0 tokens and 0 bytes. Repeated rows are counted each; of pairs of one
rank the leftmost merges first. Extra columns don't matter, an empty table gives an empty result. A
text of any length is handled whole: merging takes n log n steps, caches are bounded and never change
a count.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8

#: Unicode White_Space, which the tokenizer's pattern means by \s.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ADJACENT = re.compile(f" [{_WS}]|[{_WS}] ")
_EDGE = re.compile(f"\\A[{_WS}]|[{_WS}]\\Z")
CACHE = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """How many merges the symbols take: pop the lowest-rank adjacent pair, leftmost first.

    ``ranks`` has left symbol * 2**17 + right symbol -> rank, ``made`` the symbol each rank makes.
    A heap entry is rank * n + place; it is stale if the pair at its place no longer has its rank.
    """
    n, get = len(symbols), ranks.get
    heap = [r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := get(a << 17 | b)) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    done = 0
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = right[i]
        if j >= n or symbols[i] < 0 or get(symbols[i] << 17 | symbols[j]) != rank:
            continue
        new = symbols[i] = made[rank]
        symbols[j] = -1
        done += 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := get(new << 17 | symbols[k])) is not None:
                heapq.heappush(heap, r * n + i)
        if (h := left[i]) >= 0 and (r := get(symbols[h] << 17 | new)) is not None:
            heapq.heappush(heap, r * n + h)
    return done


def checked(spec: dict) -> dict:
    """The file's contents, if this module counts by them."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    other = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges", "byte_fallback") if model.get(k)]
    other += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    other += [f"added token {t['content']}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or other:
        raise ValueError(f"not plain byte-level merging: {model.get('type')}, {pre}, {', '.join(other)}")
    return spec


class _Cache(dict):
    def __init__(self, count):
        self.count = count

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[key] = n
        return n


class Counter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        to_byte = byte_alphabet()
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        symbol: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(pairs):
            x, y = raw(a), raw(b)
            self.made.append(symbol.setdefault(x + y, len(symbol)))
            self.ranks.setdefault(symbol[x] << 17 | symbol[y], rank)
        if len(symbol) >= 2**17:
            raise ValueError("a vocabulary of 2**17 symbols or more needs wider keys")
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+").findall
        self.tokens = _Cache(self.word)
        self.pieces = _Cache(lambda piece: self.slow(" " + piece))

    def word(self, word: str) -> int:
        data = word.encode()
        return len(data) - merges(list(data), self.ranks, self.made) if len(data) > 1 else 1

    def slow(self, text: str) -> int:
        return sum(map(self.tokens.__getitem__, self.pattern(text)))

    def plain(self, text: str) -> int:
        """Where no space touches other white space, no pre-token crosses the start of " word"."""
        if _ADJACENT.search(text) or _EDGE.search(text):
            return self.slow(text)
        first, *rest = text.split(" ")
        return self.slow(first) + sum(map(self.pieces.__getitem__, rest))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.plain(p) for p in parts if p)
        return self.plain(text)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def make():
        count = counter(path)

        def work(ids, texts):
            tokens = [count(t.decode("utf-8", "replace")) for t in texts]
            return ids, [len(t) for t in texts], tokens, [n > limit for n in tokens]

        return work

    kept = docs.select(F.col(key), utf8(text))
    return map_rows(kept, make, f"{key} {kept.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
