"""Ranked lexical search with the Best Position Algorithm.

A forward table has one slim row a document: its term count and how often it has each term that some
query asks for. From it come the corpus counts (documents, terms, documents with a term). Every task
then takes its documents in blocks of bounded postings. In a block each term has an impact list:
documents by falling impact, and by document for direct access. All lists of a query are read from
the top in step; each document met is looked up in the other lists, and its place there counts as
seen. A list's best position is the end of the places seen without a gap, so it can lie far beyond
the place last read. No document unseen can score more than the sum of the impacts at the best
positions (nothing, where a list is seen whole); reading stops once that is strictly below the kth
best score, so that equal scores are all met and ties by doc_id are exact. A task carries its best k
of each query from block to block; the best k of all tasks are ranked in one small shuffle.

No shuffle moves texts or postings, a frequent term is spread over blocks like any other, and a
block's memory is bounded. Queries are taken in blocks whose terms are bounded too (QUERY_TERMS).

Scores: see query op12. Edge cases: null texts have no terms. Repeated rows are documents of their
own, ranked one after the other; so are repeated items, as long as their item_id and text are not
both equal (these count once). Null item_id is an item. Extra columns are ignored; without
documents, terms or items there is no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, python_ready

#: Best documents of an item; postings of a block; terms of a block of items, repeats included; places read of each list in a step.
TOP, POSTINGS, QUERY_TERMS, STEP = 10, 1_000_000, 200_000, 16
#: Bytes that are no part of a term become blanks, A-Z lower case.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item long, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document) and, for terms that have a number, terms (their numbers) and tfs."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def rows(batches):
        number = shared.value
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1).to_pylist():
                found = terms_of(text)
                n.append(len(found))
                own = Counter(filter(number.__contains__, found))
                terms.append([number[t] for t in own])
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, _FORWARD)


class ImpactLists:
    """Lists of a block by term: documents and impacts by falling impact, and each document's place there."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((docs, -impacts, terms))
        terms, self.docs, self.impacts = terms[order], docs[order], impacts[order]
        known, first = np.unique(terms, return_index=True)
        self.spans = {t: (a, b) for t, a, b in zip(known.tolist(), first.tolist(), [*first[1:].tolist(), len(terms)], strict=True)}
        # by document: the same spans, sorted by document, with the place in the impact list
        by_doc = np.lexsort((self.docs, terms))
        self.by_doc, self.place = self.docs[by_doc], by_doc

    def view(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """docs and impacts by falling impact; docs in order and their places in the list."""
        if term not in self.spans:
            return None
        a, b = self.spans[term]
        return self.docs[a:b], self.impacts[a:b], self.by_doc[a:b], self.place[a:b] - a


def best_positions(lists: list[tuple[np.ndarray, ...]], weights: list[int], k: int, floor: int = 0, step: int = STEP, last_read: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents, their scores, and how many places were read: at least all documents that can be among the best k.

    Scores are sums of weight times impact. floor: a score that k documents elsewhere reach; lower
    ones need not be met. Each step reads twice as many places as the one before. last_read: stop
    by last-read places instead (for comparison).
    """
    size = 1 + max((int(x[2][-1]) for x in lists), default=0)
    met, seen, best = np.zeros(size, bool), [np.zeros(len(x[0]) + 1, bool) for x in lists], [0] * len(lists)
    found, scores, top = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(k, np.int64)
    depth, longest, read = 0, max((len(x[0]) for x in lists), default=0), 0
    while depth < longest:
        places = [x[0][depth : depth + step] for x in lists]
        read += sum(map(len, places))
        new = np.unique(np.concatenate(places))
        new = new[~met[new]]
        met[new] = True
        depth, step = depth + step, 2 * step
        total = np.zeros(len(new), np.int64)
        for i, (_, impacts, by_doc, place) in enumerate(lists):
            at = np.minimum(np.searchsorted(by_doc, new), len(by_doc) - 1)
            has = by_doc[at] == new
            spot = place[at[has]]
            total[has] += weights[i] * impacts[spot]
            seen[i][spot] = True
            best[i] += int(np.argmin(seen[i][best[i] :]))  # the guard at the end is never seen
        found.append(new)
        scores.append(total)
        top = np.sort(np.concatenate([top, total]))[-k:]
        bound = 0
        for i, (docs, impacts, _, _) in enumerate(lists):
            p = min(depth, len(docs)) if last_read else best[i]
            bound += 0 if p >= len(docs) else weights[i] * int(impacts[p - 1])
        if bound < max(floor, int(top[0])):
            break
    ids, total = np.concatenate(found), np.concatenate(scores)
    good = (total > 0) & (total >= max(floor, int(top[0])))
    return ids[good], total[good], read


def search_block(queries: list[tuple[int, list[tuple[int, int]]]], ids: np.ndarray, lists: ImpactLists, kept: dict[int, list[tuple[int, int]]], k: int) -> None:
    """Adds the block's best documents to kept: item -> best k (-score, doc_id) so far."""
    for item, wanted in queries:
        views = [(v, w) for t, w in wanted if (v := lists.view(t)) is not None]
        if views:
            own = kept.get(item, [])
            found, scores, _ = best_positions([v for v, _ in views], [w for _, w in views], k, -own[-1][0] if len(own) == k else 0)
            if len(found):
                first = np.lexsort((ids[found], -scores))[:k]
                kept[item] = heapq.nsmallest(k, own + [(-int(scores[j]), int(ids[found[j]])) for j in first])


def searched(table: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the best k of each task for queries [(item, [(term number, weight), ...])]."""
    shared = table.sparkSession.sparkContext.broadcast(queries)

    def rows(batches):
        kept: dict[int, list[tuple[int, int]]] = {}
        parts, docs, postings = [], 0, 0

        def done() -> None:
            if postings:
                ids, *lists = (np.concatenate(x) for x in zip(*parts, strict=True))
                search_block(shared.value, ids, ImpactLists(*lists), kept, k)
            parts.clear()

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).fill_null(NULL_ID).to_numpy()
            m = np.array([25 + 75 * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)
            many = b.column(2).value_lengths().to_numpy()
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, many))
            parts.append((ids, b.column(2).flatten().to_numpy().astype(np.int64), docs + np.repeat(np.arange(len(ids)), many), impact))
            docs, postings = docs + len(ids), postings + len(tf)
            if postings >= POSTINGS:
                done()
                docs = postings = 0
        done()
        out = [(item, d, -s) for item, best in kept.items() for s, d in best]
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return table.mapInArrow(rows, _FOUND)


#: Stands for a null doc_id, which ranks first among equal scores.
NULL_ID = -(1 << 63)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k rows of docs (doc_id, text) for every row of items (item_id, text).

    Items are numbered by their hash in blocks of at most query_terms terms (or one item), which are
    searched one after the other over the forward table of that block; so neither the vocabulary that
    is sent to tasks nor what a task keeps grows with the number of items.
    """
    spark = docs.sparkSession
    work = Scratch(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    total, n_items = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    # a term has a byte and a blank at least, so no block has more terms than half its bytes but by the spread of the hash
    blocks = max(1, min(n_items, math.ceil(total / 2 / query_terms)))
    asked = work.write(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = None
    for block in range(blocks):
        part = search_items(docs, asked.filter(F.col("block") == block).select("item_id", "text"), k, work)
        found = part if found is None else found.unionByName(part)
    out = work.write(found, "ranked")
    work.clear(but=out)
    return out


def search_items(docs: DataFrame, items: DataFrame, k: int, work: Scratch) -> DataFrame:
    """ranked_search for items whose terms fit in one broadcast."""
    spark = docs.sparkSession
    asked = [(r["item_id"], Counter(terms_of(bytes(r["text"] or b"")))) for r in items.collect()]  # at most a block of items
    numbers = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in asked))))}
    table = work.write(forward(docs, numbers), "forward")
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # at most the vocabulary
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = [(i, [(numbers[t], c * weight[numbers[t]]) for t, c in own.items() if weight.get(numbers[t], 0) > 0]) for i, (_, own) in enumerate(asked)]
    if n_terms:
        best = searched(table.filter(F.size("terms") > 0), queries, n_docs, n_terms, k)
    else:
        best = spark.createDataFrame([], _FOUND)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], "item long, item_id long")
    best = best.withColumn("rank", place).filter(F.col("rank") <= k).join(names, "item")
    return best.select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
