"""Owners of exact copies by Patricia tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import col, cut, kind_of, shuffle_partitions, small


class _Node:
    __slots__ = ("label", "children", "owner", "tag")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.tag = label, {}, None, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of a and b[at:], by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: Bytes that a node takes besides its label, about.
NODE_BYTES = 400


class Patricia:
    """A compressed radix trie of byte strings; terminal nodes hold the least identifier and a tag."""

    def __init__(self):
        self.root = _Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, ident, tag=None) -> _Node:
        """The terminal node of key, after ident is counted in."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                rest = key[at:]
                child = node.children[key[at]] = _Node(rest)
                self.bytes += len(rest) + NODE_BYTES
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                n = _shared(child.label, key, at)
                upper = node.children[key[at]] = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                self.bytes += NODE_BYTES
                child, at = upper, at + n
            node = child
        if node.owner is None or ident < node.owner:
            node.owner = ident
        node.tag = tag
        return node

    def terminals(self, start: _Node | None = None, above: bytes = b"") -> Iterator[tuple[bytes, _Node]]:
        """(key, node) of each terminal below start, the path above which is given; of all, if there is none."""
        stack = [(above, start or self.root)]
        while stack:
            path, node = stack.pop()
            if node.owner is not None:
                yield path + node.label, node
            stack.extend((path + node.label, x) for x in node.children.values())

    def _sizes(self) -> dict[int, int]:
        """Bytes of each node's subtree, by its id()."""
        sizes, stack = {}, [(self.root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                sizes[id(node)] = len(node.label) + NODE_BYTES + sum(sizes[id(x)] for x in node.children.values())
            else:
                stack.append((node, True))
                stack.extend((x, False) for x in node.children.values())
        return sizes

    def spill(self, down_to: int) -> Iterator[tuple[bytes, _Node]]:
        """Cut the largest subtrees off until at most down_to bytes are left, and give their terminals out.

        A subtree that alone is more than what has to go, and more than one branch, is gone
        down into, so that a common prefix doesn't take the whole trie along.
        """
        sizes = self._sizes()
        at, path = self.root, b""
        while len(at.children) == 1 or (at.children and max(sizes[id(x)] for x in at.children.values()) > 2 * max(self.bytes - down_to, 1)):
            inner_most = max(at.children.values(), key=lambda x: sizes[id(x)])
            if not inner_most.children:
                break
            at = inner_most
            path += at.label
        for byte, child in sorted(at.children.items(), key=lambda x: -sizes[id(x[1])]):
            if self.bytes <= down_to:
                break
            yield from self.terminals(child, path)
            self.bytes -= sizes[id(child)]
            del at.children[byte]


def _owners(trie_bytes: int):
    """Rows (trie, n, h, hot, id, text), sorted by trie and id, to (n, h, id, owner, text).

    A row of each comes out with the owner so far, and no text.  The owners themselves come
    out with their text ("heads") where another trie may hold the same text: those that are
    hot, and all of a trie that has been spilled, where they are given out as their subtree goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now, spilled, kind = Patricia(), None, False, pa.int64()

        def heads(found: Iterator[tuple[bytes, _Node]]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for text, node in found:
                rows.append((*node.tag[:2], node.owner, node.owner, text))
                size += len(text)
                if size > 1 << 23 or len(rows) >= 8192:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            n, h, ids, owners, texts = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(ids, kind), pa.array(owners, kind), pa.array(texts, pa.binary())], names=["n", "h", "id", "owner", "text"])

        def finish() -> Iterator[pa.RecordBatch]:
            yield from heads((text, node) for text, node in trie.terminals() if spilled or node.tag[2])

        for batch in batches:
            kind = batch.column(4).type
            which, n, h, hot, ids = (batch.column(k).to_pylist() for k in range(5))
            texts = batch.column(5)
            owner = []
            for k in range(len(ids)):
                if which[k] != now:
                    yield from finish()
                    trie, now, spilled = Patricia(), which[k], False
                owner.append(trie.insert(texts[k].as_py(), ids[k], (n[k], h[k], hot[k])).owner)
                if trie.bytes > trie_bytes:
                    spilled = True
                    yield from heads(trie.spill(trie_bytes // 2))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(4), pa.array(owner, kind), pa.nulls(len(ids), pa.binary())], names=["n", "h", "id", "owner", "text"])
        yield from finish()

    return run


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_key: int = 4096, trie_bytes: int = 64 << 20, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, owner_id): every document whose text, byte for byte, has a lesser id.

    Byte length and a 64-bit hash of the content (digest) are counted first.  Texts that are alone
    with theirs can't have a copy and are never shuffled.  All others are hash-partitioned by length
    and hash, many keys to a partition, and inserted whole into its compressed radix trie, whose
    terminal nodes hold the least identifier, so a collision of hashes costs a branch and no
    mistake.  Partitions are made for a quarter of trie_bytes each; a trie that grows beyond
    trie_bytes all the same spills its largest subtrees: their terminals (text and owner) are
    given out and their nodes freed.  A length and hash of more than rows_per_key documents is
    divided among tries first.  What was spilled or divided meets once more, owners only, in a trie of its
    length and hash, so no task gets all copies of a text that is everywhere.

    Ids keep their type, and are compared in its order.  Nulls equal nothing; empty texts are
    copies of each other; rows of a null id are left out; repeated rows of an id are one
    document; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    ship()
    keyed = docs.select(col(id_col).alias("id"), col(text_col).cast("string").cast("binary").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").withColumns({"n": F.octet_length("text"), "h": digest(F.col("text"))})
    kind = kind_of(keyed, "id")
    groups = cut(keyed.groupBy("n", "h").agg(F.count("*").alias("rows")).where("rows > 1").select("n", "h", "rows", F.ceil(F.col("rows") / rows_per_key).cast("bigint").alias("salts")))
    found, size = groups.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("rows")), F.lit(0.0))).first()
    tries = max(shuffle_partitions(docs), int(4 * size / trie_bytes) + 1)
    again = keyed.join(small(groups.drop("rows"), found, 64), ["n", "h"])
    salt = F.pmod(F.xxhash64("id"), F.col("salts"))
    placed = again.select(F.pmod(F.xxhash64("n", "h", salt), F.lit(tries)).cast("int").alias("trie"), "n", "h", (F.col("salts") > 1).alias("hot"), "id", "text")
    out = f"n int, h bigint, id {kind}, owner {kind}, text binary"
    local = cut(placed.repartitionById(tries, "trie").sortWithinPartitions("trie", "id").mapInArrow(_owners(trie_bytes), out))
    heads = local.where("text IS NOT NULL").select(F.xxhash64("n", "h").alias("trie"), "n", "h", F.lit(False).alias("hot"), "id", "text")
    last = heads.repartition("trie").sortWithinPartitions("trie", "id").mapInArrow(_owners(1 << 62), out).select("n", "h", F.col("id").alias("owner"), F.col("owner").alias("last")).distinct()
    owned = local.where("text IS NULL").select("n", "h", "id", "owner").join(last, ["n", "h", "owner"], "left").select(F.col("id").alias("doc_id"), F.coalesce("last", "owner").alias("owner_id"))
    return owned.where("doc_id <> owner_id").distinct()


SQL = """
SELECT DISTINCT d.doc_id, o.owner_id FROM documents d
JOIN (SELECT text, min(doc_id) AS owner_id FROM documents WHERE text IS NOT NULL GROUP BY text) o ON d.text = o.text
WHERE d.doc_id <> o.owner_id"""
