"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of a-z (A-Z lower-cased), 0-9 and anything beyond ASCII. A window is ``WINDOW``
consecutive words of an item, or the whole item where it has fewer. Training words are streamed
through the automaton, which tracks the longest suffix that occurs in an item: where its length
reaches a window, the window's words are hit. Only stretches of words whose pairs all occur in the
items are streamed; elsewhere no window can end, so this loses nothing.

The items' distinct texts go by hash into blocks of about BLOCK_WORDS words. A task builds a block's
automaton and writes it to the shared folder as flat arrays, some 50 bytes a word and 100 when loaded; the driver
sees only the files' names and sizes. Documents are then read once with as many automata as MEMORY
holds, usually all, which a Python worker loads once and keeps for its further tasks; with more, the
rest are further passes, whose spans are merged by document.

Null and empty texts have no words; null and wordless items have no window. Repeated documents are
handled each, repeated items under each identifier, in the order of their strings; items without one
hit words but name nothing. Very long texts
are streamed whole. Extra columns travel under names of their own. An empty benchmark hits nothing,
an empty table gives an empty result.
"""

from __future__ import annotations

import io
import json
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import STEP, filesystem, run_dir, utf8

WINDOW = 13
#: Words of items in one automaton; while it is built, some 1000 bytes each (measured: 200 MB) in one executor's worker.
BLOCK_WORDS = 200_000
#: Bytes of automata files that a worker loads for one pass; they take some twice as much in memory.
MEMORY = 96 << 20
#: The same words for the JVM, A-Z as letters.
_JVM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


class Builder:
    """Suffix automaton of many word sequences; states know their texts and the short texts that end there.

    Texts are numbered as they come.
    """

    def __init__(self, texts: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in enumerate(texts) if ws]
        self.next, self.link, self.length = [{}], [-1], [0]
        own: dict[int, set] = {}
        pairs, self.least = set(), window
        n = len(self.vocabulary) + 1
        for _, ws in coded:
            state = 0
            for w in ws:
                state = self._extend(state, w)
            pairs.update(a * n + b for a, b in zip(ws, ws[1:]))
            self.least = min(self.least, len(ws))
        # Texts by state: every prefix's state, then up the links, longest first.
        for i, ws in coded:
            state = 0
            for w in ws:
                state = self.next[state][w]
                own.setdefault(state, set()).add(i)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if s in own and self.length[self.link[s]] >= window:  # shorter strings are never asked for
                own.setdefault(self.link[s], set()).update(own[s])
        self.own = {s: sorted(x) for s, x in own.items() if self.length[s] >= window}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, ws in coded:
            if len(ws) < window:
                state = 0
                for w in ws:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(ws), i))
        self.up = [0] * len(self.length)  # the nearest state up the links that ends short texts
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            p = self.link[s]
            self.up[s] = p if p in self.short else self.up[p] if p > 0 else 0
        self.pairs, self.n = sorted(pairs), n

    def packed(self, idents: list[list[str]]) -> bytes:
        """The automaton as flat arrays, with each text's identifiers."""
        edges = [sorted(x.items()) for x in self.next]
        runs = lambda lists: np.cumsum([0, *map(len, lists)])
        states, texts = sorted(self.own), [self.own[s] for s in sorted(self.own)]
        words = sorted(self.vocabulary, key=self.vocabulary.get)
        out = io.BytesIO()
        ints = {
            "off": runs(edges), "keys": [w for x in edges for w, _ in x], "to": [t for x in edges for _, t in x], "link": self.link, "length": self.length, "up": self.up, "own": states, "own_off": runs(texts),
            "own_texts": [i for x in texts for i in x], "short": [(s, n, i) for s, x in sorted(self.short.items()) for n, i in x], "word_off": runs(words),
        }
        np.savez(
            out, pairs=np.array(self.pairs, np.int64), words=np.frombuffer(b"".join(words), np.uint8), meta=np.array([self.window, self.least, self.n]),
            idents=np.frombuffer(json.dumps(idents).encode(), np.uint8), **{k: np.array(v, np.int32) for k, v in ints.items()},
        )
        return out.getvalue()

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q])), self.link.append(self.link[q]), self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new


class Automaton:
    """A packed automaton, read: transitions by halving within a state's run of keys."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as f:
            ints = lambda k: array("i", f[k].tobytes())
            self.off, self.keys, self.to, self.link, self.length, self.up = map(ints, ("off", "keys", "to", "link", "length", "up"))
            self.own, self.own_off, self.own_texts = map(ints, ("own", "own_off", "own_texts"))
            self.pairs = f["pairs"]
            self.window, self.least, self.n = f["meta"].tolist()
            words, at = f["words"].tobytes(), f["word_off"].tolist()
            self.vocabulary = {words[a:b]: i for i, (a, b) in enumerate(zip(at, at[1:]))}
            self.idents = json.loads(f["idents"].tobytes())
            self.short: dict[int, list[tuple[int, int]]] = {}
            for s, n, i in f["short"].reshape(-1, 3).tolist():
                self.short.setdefault(s, []).append((n, i))

    def go(self, state: int, w: int) -> int:
        """The next state, or -1."""
        a, b = self.off[state], self.off[state + 1]
        if b - a > 1:
            a = bisect_left(self.keys, w, a, b)
        return self.to[a] if a < b and self.keys[a] == w else -1

    def texts(self, state: int):
        at = bisect_left(self.own, state)
        return self.own_texts[self.own_off[at] : self.own_off[at + 1]]

    def codes(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of at least ``least`` words all of whose pairs occur in some item."""
        if len(codes) < self.least or not len(self.vocabulary):
            return []
        if self.least < 2:
            good, more = codes >= 0, 0
        else:
            both = codes[:-1] * self.n + codes[1:]
            both[(codes[:-1] < 0) | (codes[1:] < 0)] = -1
            at = np.searchsorted(self.pairs, both)
            at[at == len(self.pairs)] = 0
            good, more = self.pairs[at] == both, 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
        return [(a, b + more) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b + more - a >= self.least]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, end exclusive, and the identifiers of the items whose windows occur."""
        codes = self.codes(words)
        spans: list[list[int]] = []
        found: set = set()
        go, link, length, window = self.go, self.link, self.length, self.window

        def hit(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                last = spans.pop()
                a, b = min(a, last[0]), max(b, last[1])
            spans.append([a, b])

        for a, b in self.stretches(codes):
            state = have = 0
            for i, w in enumerate(codes[a:b].tolist(), a + 1):
                new = go(state, w)
                while new < 0 and state:
                    state = link[state]
                    have = length[state]
                    new = go(state, w)
                state, have = (new, have + 1) if new >= 0 else (0, 0)
                if have >= window:
                    while length[link[state]] >= window:
                        state = link[state]
                        have = length[state]
                    hit(i - window, i)
                    found.update(self.texts(state))
                if self.short and have:
                    s = state if state in self.short else self.up[state]
                    while s:
                        for n, text in self.short[s]:
                            if n <= have:
                                hit(i - n, i)
                                found.add(text)
                        s = self.up[s]
        return [tuple(s) for s in spans], {x for i in found for x in self.idents[i]}


def united(many: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Spans of several blocks as one list; overlapping and touching ones joined."""
    if len(many) == 1:
        return many[0]
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for spans in many for s in spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def built(bench: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS) -> list[tuple[str, int]]:
    """(file, bytes) of each block's automaton; tasks build and write them, a file's name holds its attempt."""
    texts = bench.select(F.col(key).cast("string").alias("_i"), utf8(text).alias("_t"))
    texts = texts.withColumn("_n", F.regexp_count(F.col("_t").cast("string"), F.lit(_JVM_WORD))).where("_n > 0")
    texts = texts.groupBy("_t").agg(F.array_sort(F.collect_list("_i")).alias("_ids"), F.first("_n").alias("_n"))
    total = texts.agg(F.sum("_n")).first()[0] or 0
    count = -(-total // limit)
    if not count:
        return []
    folder = f"{run_dir(bench.sparkSession)}/automata-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)

        def done(block, words, idents):
            path = f"{folder}/{block}-{TaskContext.get().taskAttemptId()}.npz"
            data = Builder(words, window).packed(idents)
            with files.open_output_stream(filesystem(path)[1]) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64())], names=["path", "bytes"])

        block, words, idents = None, [], []
        for b in batches:
            for k, t, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != block and words:
                    yield done(block, words, idents)
                    words, idents = [], []
                block = k
                words.append(words_of(t))
                idents.append(ids)
        if words:
            yield done(block, words, idents)

    placed = texts.select(F.pmod(F.xxhash64("_t"), F.lit(count)).alias("_b"), "_t", "_ids").repartition(int(count), "_b").sortWithinPartitions("_b", "_t")
    return [(r.path, r.bytes) for r in placed.mapInArrow(run, "path string, bytes long").collect()]


_loaded: dict[tuple[str, ...], list[Automaton]] = {}


def loaded(paths: tuple[str, ...]) -> list[Automaton]:
    """A pass's automata; a worker keeps those of one pass."""
    if paths not in _loaded:
        _loaded.clear()
        found = []
        for path in paths:
            files, at = filesystem(path)
            with files.open_input_stream(at) as f:
                found.append(Automaton(f.read()))
        _loaded[paths] = found
    return _loaded[paths]


_SCHEMA = "n_words: long, spans: array<struct<start: int, end: int>>, items: array<string>, clean: string"


def _pass(paths: tuple[str, ...], text: str, clean: bool = False):
    """The column of (n_words, spans, items, clean) of one pass's automata; only the text goes to Python.

    ``clean`` is the text without its spans where it has some, if asked for. The function counts as
    non-deterministic, so that no filter on its result makes Spark run it twice.
    """
    arrow = to_arrow_type(_parse_datatype_string(f"struct<{_SCHEMA}>"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = loaded(paths)
        for texts in batches:
            out = []
            for at in range(0, len(texts), STEP):
                for t in texts.slice(at, STEP).to_pylist():
                    words = words_of(t)
                    found = [a.hits(words) for a in automata]
                    spans = united([s for s, _ in found]) if found else []
                    items = sorted(set().union(*(i for _, i in found)))
                    out.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": items, "clean": cut_spans(t, spans) if clean and spans else None})
            yield pa.array(out, arrow)

    return F.arrow_udf(run, f"struct<{_SCHEMA}>").asNondeterministic()(utf8(text))


def passes(files: list[tuple[str, int]], memory: int) -> list[tuple[str, ...]]:
    """The files in as few groups as hold at most ``memory`` bytes each, or one file."""
    out, held = [], 0
    for path, size in sorted(files):
        if not out or held + size > memory:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [tuple(p) for p in out] or [()]


def find(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", limit: int = BLOCK_WORDS, carry: tuple[str, ...] = (), clean: bool = False,
    memory: int = MEMORY, item_text: str = "text",
) -> DataFrame:
    """Per row: ``key``, n_words, spans of hit words, identifiers of the items found, ``carry``.

    With ``clean`` also ``clean``, the text without its spans, null where it has none. Items whose
    automata fit in ``memory`` (the usual case) take one pass without a shuffle. With more, the
    passes yield rows with hits alone, which meet the documents by (key, digest of the text).
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), *(F.col(c).alias(f"_x_{c}") for c in carry))
    groups = passes(built(bench, window, item, item_text, limit), memory)
    if len(groups) == 1:
        rows = rows.withColumn("_p", _pass(groups[0], "_t", clean))
        n, spans, items, left = (F.col(f"_p.{c}") for c in ("n_words", "spans", "items", "clean"))
    else:
        rows = rows.withColumn("_s", F.sha2(utf8("_t"), 256))
        hits = [rows.select("_k", "_s", _pass(paths, "_t").alias("_p")).where(F.size("_p.spans") > 0) for paths in groups]
        every = reduce(DataFrame.unionByName, hits).groupBy("_k", "_s").agg(F.array_sort(F.flatten(F.collect_list("_p.spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_p.items")))).alias("_items"))
        every = every.select(F.col("_k").alias("_k2"), F.col("_s").alias("_s2"), merged(F.col("_spans")).alias("_spans"), "_items")
        rows = rows.join(every, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_s") == F.col("_s2")), "left")
        n = F.regexp_count(F.coalesce(F.col("_t").cast("string"), F.lit("")), F.lit(_JVM_WORD)).cast("long")
        spans = F.coalesce("_spans", F.expr("cast(array() as array<struct<start: int, end: int>>)"))
        items = F.coalesce("_items", F.expr("cast(array() as array<string>)"))
        left = F.arrow_udf(_cut, "string").asNondeterministic()(F.when(F.size(spans) > 0, utf8("_t")), F.when(F.size(spans) > 0, F.to_json(spans)))
    return rows.select(F.col("_k").alias(key), n.alias("n_words"), spans.alias("spans"), items.alias("items"), *([left.alias("clean")] if clean else []), *(F.col(f"_x_{c}").alias(c) for c in carry))


def merged(spans):
    """Sorted spans with overlapping and touching ones joined."""

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(F.slice(spans, F.lit(2), F.size(spans)), F.slice(spans, 1, 1), step))


def digest(found: DataFrame, share: int = 20) -> DataFrame:
    """The contract's columns: contaminated where hit words are at least one in ``share``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    out = found.withColumn("n_hit", hit)
    return out.select(
        found.columns[0], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *found.columns[4:],
    )


def cut_spans(text: bytes, spans) -> str:
    """The text without the words of the spans and the signs between them."""
    clean, at, ends, begins = text.translate(_TABLE), 0, [], []
    while True:
        while at < len(clean) and clean[at] == 32:
            at += 1
        if at >= len(clean):
            break
        begins.append(at)
        stop = clean.find(b" ", at)
        at = len(clean) if stop < 0 else stop
        ends.append(at)
    out, last = [], 0
    for s in spans:  # (first word, end word)
        out.append(text[last : begins[s[0]]])
        last = ends[s[1] - 1]
    return b"".join([*out, text[last:]]).decode("utf-8", "replace")


def remove(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = 20, key: str = "doc_id", text: str = "text", limit: int = BLOCK_WORDS, memory: int = MEMORY) -> DataFrame:
    """Documents with hits over the coverage limit go; shorter hits are cut out of the others' texts.

    Returns the columns of ``docs``; ``n_chars`` follows the text where it is present.
    """
    names = docs.columns
    carry = tuple(f"_keep_{i}" for i in range(len(names)))
    rows = docs.select(F.col(key), F.col(text), *(F.col(f"`{n}`").alias(c) for n, c in zip(names, carry)))
    found = find(rows, bench, window, key, text, carry=carry, clean=True, limit=limit, memory=memory)
    hit = F.size("spans") > 0
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    kept = found.where(~(hit & (share * words >= F.col("n_words"))))
    kept = kept.withColumn("_new", F.when(hit, F.col("clean")).otherwise(F.col(carry[names.index(text)])))
    cols = {text: F.col("_new")}
    if "n_chars" in names:
        cols["n_chars"] = F.when(hit, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(carry[names.index("n_chars")]))
    return kept.select(*(cols.get(n, F.col(c)).alias(n) for n, c in zip(names, carry)))


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([None if t is None else cut_spans(t, [(x["start"], x["end"]) for x in json.loads(s)]) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())
