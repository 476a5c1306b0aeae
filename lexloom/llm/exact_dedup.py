"""Exact duplicates by Patricia-trie owners.

Texts are equal when identical after each run of white space became one space. Full byte strings go
into compressed radix tries, one a task, whose terminal nodes hold the smallest owner (identifier,
then row) and the count. It is the bytes in the trie that tell equal from different: hashes only
place strings in partitions, and the SHA-256 is output alone.

Before the shuffle each task has a trie of its own, so that a text that fills a third of the table
crosses it once a task. Its rows are written to the shared folder with the number of their terminal
in that trie, its terminals with their bytes; terminals are then partitioned by length and content
hash and merged in the tries of the owners, and rows find their owner by their terminal's number.
Beyond a budget the largest subtrees are spilled. Before the shuffle a spilled subtree's terminals
leave as partial owners. Behind it a stub stays in its place, all that reaches it leaves too, and
what has left is partitioned anew by more hash bits and merged in a further round, until nothing
leaves; the budget grows by rounds too, so that even one text with very many numbers gets done. So a
task's memory is bounded whatever the number of texts; one text with its numbers must fit in it.

Null counts as empty. Of equal texts one row stays: that with the smallest identifier, null
identifiers last, and of repeated rows with that identifier the first one read. Extra columns travel
under names of their own. Very long texts are whole; the budget is looked at after each of them. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import utf8, written

BUDGET = 48 << 20
#: What a node takes in memory beside its label, and what a terminal's number takes.
_NODE, _NUMBER = 340, 8
_BLANK = frozenset(b" \t\n\v\f\r")


def normalise(data: bytes) -> bytes:
    """Each run of white space as one space, also at the ends."""
    body = b" ".join(data.split())
    if not data:
        return body
    if not body:
        return b" "
    return b" " * (data[0] in _BLANK) + body + b" " * (data[-1] in _BLANK)


class Node:
    __slots__ = ("label", "kids", "held", "terminal", "stub")

    def __init__(self, label: bytes):
        self.label, self.kids, self.held, self.terminal, self.stub = label, None, 0, None, False


class Terminal:
    """What a string's terminal node stores: its least owner, its rows, and numbers of it given before."""

    __slots__ = ("least", "count", "numbers")

    def __init__(self):
        self.least, self.count, self.numbers = None, 0, array("q")


def owner(ident, row: int):
    """An owner's place in order: null identifiers last, then by row."""
    return (ident is None, ident or 0, row)


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` stand in ``b`` from ``at``: halving, compares whole slices."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Patricia:
    """A compressed radix trie of byte strings; edges hold what they add, nodes what their subtree takes."""

    def __init__(self, stubs: bool = True):
        self.root, self.stubs = Node(b""), stubs

    @property
    def held(self) -> int:
        return self.root.held

    def insert(self, data: bytes, least, count: int = 1, numbers=()) -> Terminal | None:
        """The string's terminal, or None where it reaches a stub."""
        node, at, n, path, more = self.root, 0, len(data), [self.root], 0
        while at < n:
            if node.stub:
                return None
            kid = node.kids.get(data[at]) if node.kids else None
            if kid is None:
                kid = Node(data[at:])
                kid.held -= more  # a fork above is none of its own
                more += n - at + _NODE
                if node.kids is None:
                    node.kids = {}
                node.kids[data[at]] = kid
                path.append(kid)
                node = kid
                break
            label = kid.label
            if data.startswith(label, at):
                at += len(label)
            else:
                c = _common(label, data, at)
                fork = Node(label[:c])
                fork.held = kid.held + _NODE
                kid.label = label[c:]
                fork.kids = {kid.label[0]: kid}
                node.kids[data[at]] = fork
                more += _NODE
                kid.held -= c
                fork.held -= _NODE  # the path adds it below
                kid, at = fork, at + c
            node = kid
            path.append(node)
        if node.stub:
            return None
        if node.terminal is None:
            node.terminal = Terminal()
        more += _NUMBER * len(numbers)
        for p in path:
            p.held += more
        t = node.terminal
        t.count += count
        t.numbers.extend(numbers)
        if t.least is None or least < t.least:
            t.least = least
        return t

    def largest(self) -> tuple[list[Node], bytes]:
        """The path to a large subtree, and its string: down from the root while one child is most of it."""
        path, prefix = [self.root], b""
        while path[-1].kids:
            kid = max(path[-1].kids.values(), key=lambda k: (k.held, k.label))
            if len(path) > 1 and 2 * kid.held < path[-1].held:
                break
            path.append(kid)
            prefix += kid.label
        return path, prefix

    def spill(self, keep: int):
        """(string, terminal) of whole subtrees that leave until at most ``keep`` is held."""
        while self.root.held > keep and self.root.kids:
            path, prefix = self.largest()
            node = path[-1]
            yield from _terminals(node, prefix)
            left = _NODE if self.stubs else 0
            gone = node.held - left
            node.kids, node.terminal, node.stub = None, None, self.stubs
            if not self.stubs:
                del path[-2].kids[node.label[0]]
            for p in path:
                p.held -= gone
            if gone <= 0:
                break

    def terminals(self):
        """(string, terminal) of each terminal node."""
        return _terminals(self.root, b"")


def _terminals(node: Node, prefix: bytes):
    """Those at and below ``node``, whose string is ``prefix``."""
    stack = [(node, prefix)]
    while stack:
        node, whole = stack.pop()
        if node.terminal:
            yield whole, node.terminal
        if node.kids:
            stack += [(kid, whole + kid.label) for kid in node.kids.values()]


def _batches(rows, schema: pa.Schema, size: int = 512, most: int = 8 << 20):
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += len(r[0] or b"")
        if len(part) >= size or held >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_PARTIAL = "_data binary, _len int, _hash long, _sha binary, _null boolean, _id long, _row long, _count long, _numbers array<long>, _more boolean"


def _partial(data: bytes, t: Terminal, more: bool):
    """A terminal as a row of ``_PARTIAL``; one that is done needs its bytes no more."""
    null, ident, row = t.least
    return (data if more else None), len(data), xxhash.xxh3_64_intdigest(data) - (1 << 63), hashlib.sha256(data).digest(), null, ident, row, t.count, list(t.numbers), more


def local(docs: DataFrame, key: str, text: str, carry: tuple[str, ...], budget: int) -> DataFrame:
    """Each task's rows (_row, _ident, _number of their terminal, ``carry``) and terminals (``_PARTIAL``), in one table."""
    kept = docs.select(F.col(key).cast("long").alias("_ident"), utf8(text).alias("_text"), *(F.col(c).alias(f"_x_{c}") for c in carry))
    partial = StructType.fromDDL(_PARTIAL)
    schema = StructType(StructType.fromDDL("_at long, _ident long, _number long").fields + kept.select(*(f"_x_{c}" for c in carry)).schema.fields + partial.fields)
    for f in schema.fields:
        f.nullable = True
    arrow = to_arrow_schema(schema)
    tail = to_arrow_schema(partial)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 36
        trie, row, number = Patricia(stubs=False), 0, 0

        def left(found):
            """Batches of terminals."""
            for b in _batches((_partial(data, t, True) for data, t in found), tail):
                cols = [b.column(f.name) if f.name in tail.names else pa.nulls(b.num_rows, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, numbers = b.slice(at, 256), []
                for ident, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    t = trie.insert(normalise(data), owner(ident, task + row))
                    if not t.numbers:
                        t.numbers.append(task + number)
                        number += 1
                    numbers.append(t.numbers[0])
                    row += 1
                    if trie.held > budget:
                        yield from left(trie.spill(budget // 2))
                n = part.num_rows
                own = {"_at": pa.array(range(task + row - n, task + row), pa.int64()), "_ident": part.column(0), "_number": pa.array(numbers, pa.int64())}
                cols = [own[f.name] if f.name in own else part.column(f.name) if f.name in part.schema.names else pa.nulls(n, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
        yield from left(trie.terminals())

    return kept.mapInArrow(run, schema)


def merged(partial: DataFrame, budget: int, bits: int) -> DataFrame:
    """One round: terminals by length and content hash into tries; ``_more`` marks those that left."""
    arrow = to_arrow_schema(StructType.fromDDL(_PARTIAL))

    def run(batches):
        def rows():
            trie = Patricia()
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    for data, null, ident, row, count, numbers in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)):
                        least = (null, ident, row)
                        if trie.insert(data, least, count, numbers) is None:  # its subtree has left
                            t = Terminal()
                            t.least, t.count, t.numbers = least, count, array("q", numbers)
                            yield _partial(data, t, True)
                        elif trie.held > budget:
                            yield from (_partial(d, t, True) for d, t in trie.spill(budget // 2))
            yield from (_partial(d, t, False) for d, t in trie.terminals())

        return _batches(rows(), arrow)

    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")) << bits
    met = partial.repartition(n, "_len", "_hash").select("_data", "_null", "_id", "_row", "_count", "_numbers")
    return met.mapInArrow(run, _PARTIAL)


def owners(partial: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per terminal's number: _number, _null, _id and _row of the owner, _count (rows of the text), _sha."""
    done, bits = None, 0
    while True:
        table, _ = written(merged(partial, budget << bits, bits), f"owners-{bits}")
        whole = table.where("not _more").select(F.explode("_numbers").alias("_number"), F.when(~F.col("_null"), F.col("_id")).alias("_least"), "_row", "_count", "_sha")
        done = whole if done is None else done.unionByName(whole)
        partial = table.where("_more")
        if partial.isEmpty():
            return done
        bits += 2


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), budget: int = BUDGET) -> DataFrame:
    """Per row: ``key``, keep_id, group_size, kept, text_sha256, ``carry``.

    Rows meet owners by their terminal's number, which no more rows share than a task has read.
    """
    table, _ = written(local(docs, key, text, carry, budget), "tries")
    found = owners(table.where("_count is not null"), budget)
    rows = table.where("_number is not null").select("_at", F.col("_ident").cast(docs.schema[key].dataType).alias("_key"), F.col("_number").alias("_mine"), *(f"_x_{c}" for c in carry))
    met = rows.join(found.hint("merge"), F.col("_mine") == F.col("_number"))  # both have a row a document, but exploded numbers are sized by their rows before
    return met.select(
        F.col("_key").alias(key), F.col("_least").alias("keep_id"), F.col("_count").alias("group_size"), (F.col("_at") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), *(F.col(f"_x_{c}").alias(c) for c in carry),
    )
