"""Exact top-k over blocks of postings in numpy, as the workers run it.

A block holds the postings of some documents, ordered by tag. Of a query's tags the rare ones of the block
are added up over their postings; the common ones are looked up in a row of codes that has every
document. Documents that hold common tags only are looked at list by list, shortest first, until the tags
that are left cannot reach the query's k-th best score together. What is found carries over to the next block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: What rounding may add to a score: bounds are kept this far apart.
SLACK = 1e-5
K1 = 1.2
#: Most tags of a block that get a row of codes, and the least documents such a tag has.
ROWS, LEAST_ROW = 256, 512


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id, t, idf, norm) of one block a partition, a row for each time that a document has a tag ->
    (block, piece): the block, compressed."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    col = lambda n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held])
    block, t = int(held[0].column(0)[0].as_py()), col(2)
    ids, doc = np.unique(col(1), return_inverse=True)
    first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])])
    tf = np.diff(np.r_[first, len(t)])
    w = col(3)[first] * tf * (K1 + 1) / (tf + col(4)[first])
    t, doc = t[first], doc[first].astype(np.int32)
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    sink = pa.BufferOutputStream()
    columns = [pa.array(x) for x in (ids, t[heads], np.r_[heads, len(t)], doc, w)]
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    lists = pa.record_batch([pa.array([c.to_numpy()], type=pa.list_(c.type)) for c in columns], names=["ids", "ts", "at", "doc", "w"])
    with pa.ipc.new_stream(sink, lists.schema, options=options) as out:
        out.write_batch(lists)
    yield pa.record_batch([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "piece"])


class Block:
    """The postings of some documents: those of tag n are doc[at[n]:at[n + 1]] with the weights w."""

    def __init__(self, piece: bytes):
        (lists,) = pa.ipc.open_stream(piece)
        self.ids, self.ts, self.at, self.doc, self.w = (lists.column(n).flatten().to_numpy() for n in ("ids", "ts", "at", "doc", "w"))
        self.doc = self.doc.astype(np.intp)  # as numpy takes by
        self.df = np.diff(self.at)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        most = np.argsort(-self.df, kind="stable")[:ROWS]
        self.common = np.zeros(len(self.ts), dtype=bool)
        self.common[most[self.df[most] >= max(LEAST_ROW, len(self.ids) // 128)]] = True
        self.top = np.maximum.reduceat(self.w, self.at[:-1]) if len(self.ts) else np.zeros(0)

    def row(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What a common tag weighs in every document: codes, and the weights that they stand for."""
        if n not in self.rows:
            values, codes = np.unique(self.w[self.at[n] : self.at[n + 1]], return_inverse=True)
            row = np.zeros(len(self.ids), dtype=np.min_scalar_type(len(values)))
            row[self.doc[self.at[n] : self.at[n + 1]]] = codes + 1
            self.rows[n] = row, np.r_[0.0, values]
        return self.rows[n]


class Part:
    """Some queries and the k best documents that each has found so far. looked: postings read for them."""

    def __init__(self, k: int):
        self.looked = 0
        self.k, self.q, self.sizes, self.ts, self.boosts = k, [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        self.q.append(batch.column("q").to_numpy())
        self.sizes.append(batch.column("ts").value_lengths().to_numpy(zero_copy_only=False))
        self.ts.append(batch.column("ts").flatten().to_numpy())
        self.boosts.append(batch.column("boosts").flatten().to_numpy())

    def close(self) -> None:
        self.q, self.ts, self.boosts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.q, self.ts, self.boosts))
        self.owner = np.repeat(np.arange(len(self.q)), np.concatenate(self.sizes)) if len(self.q) else np.zeros(0, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.q)
        self.need = [-1.0] * len(self.q)

    def merge(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Keeps the k best of what query i had and what is new: by rounded score, then by id."""
        keep = score >= self.need[i] - SLACK
        r, ids = np.floor(score[keep] * 1e6 + 0.5) / 1e6, ids[keep]
        if self.best[i] is not None:
            r, ids = np.concatenate((self.best[i][0], r)), np.concatenate((self.best[i][1], ids))
        if len(r) > self.k:
            least = np.partition(r, len(r) - self.k)[len(r) - self.k]
            above, equal = np.flatnonzero(r > least), np.flatnonzero(r == least)
            left = self.k - len(above)
            if len(equal) > left:
                equal = equal[np.argpartition(ids[equal], left - 1)[:left]]
            kept = np.concatenate((above, equal))
            r, ids = r[kept], ids[kept]
        if len(r) == self.k:
            self.need[i] = float(r.min())
        self.best[i] = r, ids

    def search(self, block: Block) -> None:
        """Takes the block's documents into account. A query's tags go by the most that they can add. Documents
        that hold only the last of them, which cannot reach the k-th best score together, are not looked at."""
        n_docs = len(block.ids)
        if not n_docs or not len(self.q):
            return
        place = np.minimum(np.searchsorted(block.ts, self.ts), len(block.ts) - 1)
        here = np.flatnonzero(block.ts[place] == self.ts)
        most = block.top[place[here]] * self.boosts[here]
        order = np.lexsort((-most, self.owner[here]))
        here, most = here[order], most[order]
        place = place[here]
        ends = np.cumsum(np.bincount(self.owner[here], minlength=len(self.q)))
        reach = np.cumsum(most)  # the sum of the tags of all queries up to this one
        boosts, ends, reach, most = self.boosts[here].tolist(), ends.tolist(), [0.0, *reach.tolist()], most.tolist()
        common, from_, to, place = block.common[place].tolist(), block.at[place].tolist(), block.at[place + 1].tolist(), place.tolist()
        total, marks, seen = np.zeros(n_docs), np.zeros(n_docs, dtype=np.int32), np.zeros(n_docs, dtype=bool)
        doc, w = block.doc, block.w
        begin = end = 0
        for i, next_ in enumerate(ends):
            begin, end = end, next_
            need = self.need[i] - SLACK
            if begin == end or reach[end] - reach[begin] < need:
                continue
            last = begin  # the first of the tags that cannot reach it together
            while last < end and reach[end] - reach[last] >= need:
                last += 1
            lists, added, shared, rest, low = [], [], [], 0.0, 0.0
            for e in range(begin, end):
                if common[e]:
                    shared.append(e)
                    rest += most[e]
                    continue
                d, add = doc[from_[e] : to[e]], w[from_[e] : to[e]]
                add = add if boosts[e] == 1 else add * boosts[e]
                if added:
                    total[d] = total.take(d) + add
                else:
                    total[d] = add
                added.append(d)
                if e < last:
                    lists.append(d)
                else:
                    low += most[e]
            rows = [(*block.row(place[e]), boosts[e]) for e in shared]
            if lists:
                found = lists[0] if len(lists) == 1 else np.concatenate(lists)
                self.looked += len(found)
                score = total.take(found)
                if need > 0:
                    able = np.flatnonzero(score >= need - rest)
                    found, score = found.take(able), score.take(able)
                if len(lists) > 1 and len(found) > 1:  # each document once
                    count = np.arange(len(found), dtype=np.int32)
                    marks[found] = count
                    able = np.flatnonzero(marks.take(found) == count)
                    found, score = found.take(able), score.take(able)
                if need <= 0 and len(found) > 4 * self.k:  # what k documents have already is needed
                    need = max(need, float(np.partition(score, len(score) - self.k)[len(score) - self.k]) - SLACK)
                    able = np.flatnonzero(score >= need - rest)
                    found, score = found.take(able), score.take(able)
                if len(found):
                    left = rest
                    for e, (codes, values, boost) in zip(shared, rows):
                        score += (values if boost == 1 else values * boost).take(codes.take(found))
                        left -= most[e]
                        if len(found) > 256 and need > 0:
                            able = np.flatnonzero(score >= need - left)
                            found, score = found.take(able), score.take(able)
                    self.merge(i, score, block.ids[found])
                    need = max(need, self.need[i] - SLACK)
            if shared and rest + low >= need:
                # documents without the tags above; what was left out above stays below what is needed
                merged = [found] if lists else []
                for d in merged:
                    seen[d] = True
                for n, e in enumerate(shared):
                    if rest + low < need:
                        break
                    rest -= most[e]
                    d, score = doc[from_[e] : to[e]], w[from_[e] : to[e]] * boosts[e]
                    self.looked += len(d)
                    if added:
                        score += total.take(d)
                    able = np.flatnonzero(score >= need - rest)
                    able = able[~seen.take(d.take(able))]
                    d, score, left = d.take(able), score.take(able), rest
                    for f in range(n + 1, len(shared)):
                        codes, values, boost = rows[f]
                        score += (values if boost == 1 else values * boost).take(codes.take(d))
                        left -= most[shared[f]]
                        if len(d) > 256 and need > 0:
                            able = np.flatnonzero(score >= need - left)
                            d, score = d.take(able), score.take(able)
                    if len(d):
                        self.merge(i, score, block.ids[d])
                        need = max(need, self.need[i] - SLACK)
                        seen[d] = True
                        merged.append(d)
                for d in merged:
                    seen[d] = False
            for d in added:
                total[d] = 0.0

    def hits(self, first: int | None = None) -> Iterator[pa.RecordBatch]:
        """(q, id, score, rank, n_hits, second, spread): the hits, or the `first` of each query. The last three
        are of all hits of the query: their number, the second score and the population deviation."""
        for at in range(0, len(self.q), 5_000):
            got = [i for i in range(at, min(at + 5_000, len(self.q))) if self.best[i] is not None and len(self.best[i][0])]
            if not got:
                continue
            size = np.array([len(self.best[i][0]) for i in got])
            score, ids = (np.concatenate([self.best[i][n] for i in got]) for n in (0, 1))
            owner, begin = np.repeat(np.arange(len(got)), size), np.cumsum(size) - size
            order = np.lexsort((ids, -score, owner))
            score, ids = score[order], ids[order]
            mean = np.add.reduceat(score, begin) / size
            spread = np.sqrt(np.add.reduceat((score - mean[owner]) ** 2, begin) / size)
            second = score[np.minimum(begin + 1, len(score) - 1)]
            rank = np.arange(len(score)) - begin[owner] + 1
            kept = np.flatnonzero(rank <= (first or self.k))
            owner = owner[kept]
            columns = [pa.array(x) for x in (self.q[got][owner], ids[kept], score[kept], rank[kept].astype(np.int32), size[owner])]
            columns += [pa.array(second[owner], mask=size[owner] < 2), pa.array(spread[owner])]
            yield pa.record_batch(columns, names=["q", "id", "score", "rank", "n_hits", "second", "spread"])


#: What searched() gives.
FOUND = "q long, id long, score double, rank int, n_hits long, second double, spread double"


def searched(k: int, first: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of a part, its queries (block -1) first and then all blocks -> the hits of Part.hits()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, closed = Part(k), False
        for batch in batches:
            asks = int(np.count_nonzero(batch.column("block").to_numpy() < 0))
            if asks:
                part.add(batch.slice(0, asks))
            for n in range(asks, batch.num_rows):
                if not closed:
                    part.close()
                    closed = True
                part.search(Block(batch.column("piece")[n].as_py()))
        if closed:
            yield from part.hits(first)

    return run
