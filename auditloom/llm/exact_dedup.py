"""Exact dedup by a cuckoo-filter index over text digests.

Each task holds an index of the digests it has seen: a cuckoo filter answers "surely new" without
reading content, and a hit is verified against the stored digests of its content bucket. A first
index in each input task folds copies before the shuffle, so a text that a third of the rows share
reaches the second index as one row a task; the second one holds all of a range of digests.

Edge cases: null text is the empty text, and all texts without a visible character are equal. Of
equal texts the longest original stays, then the smallest doc_id; a null doc_id counts as the
largest. Rows that repeat text and doc_id of the kept row are all marked kept. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, written

_SPACE = b" \t\n\v\f\r"
_KEYS = "doc_id long, n_cp long, digest binary"
_PARTS = "digest binary, part binary, n_cp long, doc_id long, copies long"
#: Digests that an index holds before it hands its counts on, at the next change of digest range.
FLUSH = 200_000


class CuckooIndex:
    """Live digests with a payload each.

    The filter keeps 16-bit fingerprints in buckets of four, each digest's at one of two places.
    Content is bucketed by the first place: lists of [digest, payload]. When an insertion moves
    fingerprints too often, the filter doubles and is filled again from the stored digests.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.size = 0
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[int, list[list]] = {}

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995 >> 7) & self.mask)

    def find(self, digest: bytes) -> list | None:
        """The stored entry; None if the digest isn't live."""
        mark, a, b = self._places(digest)
        if mark in self.filter[a] or mark in self.filter[b]:
            for entry in self.content.get(a, ()):
                if entry[0] == digest:
                    return entry
        return None

    def _settle(self, mark: int, a: int, b: int) -> bool:
        for place in (a, b):
            if len(self.filter[place]) < self.SLOTS:
                self.filter[place].append(mark)
                return True
        place = a
        for kick in range(self.KICKS):
            slots = self.filter[place]
            slot = kick % self.SLOTS
            mark, slots[slot] = slots[slot], mark
            place = self._other(place, mark)
            if len(self.filter[place]) < self.SLOTS:
                self.filter[place].append(mark)
                return True
        return False

    def insert(self, digest: bytes, payload) -> None:
        """A digest that find() has not found."""
        mark, a, b = self._places(digest)
        self.content.setdefault(a, []).append([digest, payload])
        self.size += 1
        if not self._settle(mark, a, b):
            self._grow()

    def _grow(self) -> None:
        stored, buckets = list(self.entries()), (self.mask + 1) * 2
        while True:
            self._make(buckets)
            for entry in stored:
                self.content.setdefault(self._places(entry[0])[1], []).append(entry)
            if all(self._settle(*self._places(entry[0])) for entry in stored):
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        """Takes the digest and one of its fingerprints out; False if it isn't live."""
        mark, a, b = self._places(digest)
        if self.find(digest) is None:
            return False
        self.content[a] = [e for e in self.content[a] if e[0] != digest]
        self.filter[a if mark in self.filter[a] else b].remove(mark)
        self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


def _digests(batches):
    for b in batches:
        raw = [(x or b"").translate(None, _SPACE) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())], ["doc_id", "n_cp", "digest"])


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the text and SHA-256 of the text without white space, for every row."""
    python_ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("n_cp"), text.cast("binary").alias("raw")).mapInArrow(_digests, _KEYS)


def _better(a: tuple, b: tuple) -> bool:
    """More code points, then the smaller doc_id, a null one last."""
    return (a[0], a[1] is not None, -(a[1] or 0)) > (b[0], b[1] is not None, -(b[1] or 0))


def _fold(batches):
    """Rows of _PARTS, one for each digest that an index has held."""
    index, part = CuckooIndex(), None

    def out():
        got = list(index.entries())
        cols = [[e[0] for e in got], [e[0][:2] for e in got], [e[1][0] for e in got], [e[1][1] for e in got], [e[1][2] for e in got]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), *[pa.int64()] * 3), strict=True)], ["digest", "part", "n_cp", "doc_id", "copies"])

    for b in batches:
        for digest, at, n_cp, doc_id, copies in zip(*(b.column(k).to_pylist() for k in ("digest", "part", "n_cp", "doc_id", "copies")), strict=True):
            if at != part and index.size >= FLUSH:
                yield out()
                index = CuckooIndex()
            part = at
            if (entry := index.find(digest)) is None:
                index.insert(digest, [n_cp, doc_id, copies])
            else:
                best = entry[1]
                if _better((n_cp, doc_id), (best[0], best[1])):
                    best[:2] = n_cp, doc_id
                best[2] += copies
    yield out()


def digest_groups(keys: DataFrame) -> DataFrame:
    """digest, keep_id, group_size for keys of text_keys()."""
    parts = keys.select("digest", F.substring("digest", 1, 2).alias("part"), "n_cp", "doc_id", F.lit(1).cast("long").alias("copies"))
    folded = parts.mapInArrow(_fold, _PARTS)
    whole = folded.repartition("digest").sortWithinPartitions("part").mapInArrow(_fold, _PARTS)
    return whole.select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    keys = written(text_keys(docs), "exact-keys")
    joined = keys.join(digest_groups(keys), "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _apply(batches):
    """Inserts and deletes in the order of seq; a digest is live while more rows came than went."""
    index = CuckooIndex()
    for b in batches:
        for digest, change in zip(b.column("digest").to_pylist(), b.column("change").to_pylist(), strict=True):
            entry = index.find(digest)
            if entry is None and change > 0:
                index.insert(digest, [1])
            elif entry is not None:
                entry[1][0] += 1 if change > 0 else -1
                if not entry[1][0]:
                    index.delete(digest)
    got = list(index.entries())
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in got], pa.binary()), pa.array([e[1][0] for e in got], pa.int64())], ["digest", "copies"])


def live_digests(changes: DataFrame) -> DataFrame:
    """digest, copies still live after changes (digest, seq, change: 1 inserts, -1 deletes).

    A deletion of what isn't live has no effect. Partition the log by digest ranges; a range with
    very many changes of one digest streams through one task in order, holding one entry for it.
    """
    log = changes.select("digest", F.col("seq").cast("long"), F.col("change").cast("int"))
    return log.repartition("digest").sortWithinPartitions("seq").mapInArrow(_apply, "digest binary, copies long")
