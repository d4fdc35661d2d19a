"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Each shard's graph is built and searched by numpy for many points at once: all points of a batch walk the graph
in step, each with a beam of its own. A layer is stored as one flat array of neighbours. Equal vectors are
one point of the graph with a list of ids. Shard results are merged by distance, then id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .storage import saved
from .vectors import RESULT, best, matrix, met, parted, smallest, usable

#: Rows of a shard, about: its graph is built in one task. A search looks at a tenth of such a shard, at less of a larger one.
SHARD_ROWS = 32_768
#: Neighbours in the upper layers and in the ground layer, and the beams of building and searching.
LINKS = 16
GROUND_LINKS = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
BATCH = 512
#: Points of a beam whose neighbours are looked at in one step.
STEPS = 6
#: Distances between candidates that are held at a time.
GAPS = 1 << 22
INDEX = "shard int, dim int, points binary, ids binary, ends binary, links array<binary>, entry int"


def _distances(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of each a[i] to rows[i, j]."""
    diff = rows - a[:, None, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest points of one layer for each query, in step: ids (-1: none), squared distances, nearest first, and distances computed."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, x.dtype)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distances(q, x[entry][:, None, :])[:, 0]
    seen[np.arange(n), entry] = True
    live, evaluated, steps = np.arange(n), n, min(STEPS, beam)
    while True:
        pending = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(pending, steps - 1, axis=1)[:, :steps]
        open_ = np.isfinite(np.take_along_axis(pending, pick, axis=1))
        go = open_.any(axis=1)
        live, pick, open_ = live[go], pick[go], open_[go]
        if not len(live):
            break
        done[live[:, None], pick] = True
        at = np.where(open_, ids[live[:, None], pick], -1)
        near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1).astype(np.int64)
        new = (near >= 0) & ~seen[live[:, None], np.where(near < 0, 0, near)]
        i, j = np.nonzero(new)
        _, first = np.unique(i * len(x) + near[i, j], return_index=True)  # two points of a step may share a neighbour
        i, j = i[first], j[first]
        p = near[i, j]
        seen[live[i], p] = True
        diff = x[p] - q[live[i]]
        width = np.bincount(i, minlength=len(live))
        place = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
        shape = (len(live), int(width.max()))
        d, found = np.full(shape, np.inf, x.dtype), np.full(shape, -1, np.int64)
        d[i, place], found[i, place] = np.einsum("ij,ij->i", diff, diff), p
        evaluated += len(p)
        all_d = np.concatenate((dist[live], d), axis=1)
        all_i = np.concatenate((ids[live], found), axis=1)
        all_f = np.concatenate((done[live], found < 0), axis=1)
        kept = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, kept, axis=1) for a in (all_d, all_i, all_f))
    order = np.lexsort((ids, dist), axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1), evaluated


def choose(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    """Neighbours out of candidates sorted by distance: nearer to the point than to any neighbour already chosen.

    Places left over go to the nearest of the others. The distances between a point's candidates are one matrix product.
    """
    out = np.full((len(cand), links), -1, np.int32)
    rows = max(1, GAPS // cand.shape[1] ** 2)
    for at in range(0, len(cand), rows):
        out[at : at + rows] = _chosen(x, cand[at : at + rows], dist[at : at + rows], links)
    return out


def _chosen(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    n, width = cand.shape
    own = x[np.where(cand < 0, 0, cand)]
    norm = np.einsum("ijk,ijk->ij", own, own)
    gaps = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
    out = np.full((n, links), -1, np.int32)
    count = np.zeros(n, np.int64)
    took = np.zeros((n, width), bool)
    ok = (cand >= 0) & np.isfinite(dist)
    nearest_chosen = np.full((n, width), np.inf, x.dtype)
    for c in range(width):
        rows = np.flatnonzero(ok[:, c] & (count < links) & (nearest_chosen[:, c] > dist[:, c]))
        out[rows, count[rows]] = cand[rows, c]
        took[rows, c] = True
        count[rows] += 1
        nearest_chosen[rows] = np.minimum(nearest_chosen[rows], gaps[rows, c])
    for c in range(width):
        rows = np.flatnonzero(ok[:, c] & ~took[:, c] & (count < links))
        out[rows, count[rows]] = cand[rows, c]
        count[rows] += 1
    return out


class Graph:
    """Layers of one shard; links[l][p] are the neighbours of point p in layer l, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        self.x, self.levels = x, levels
        self.top = int(levels.max()) if len(x) else 0
        self.links = [np.full((len(x), LINKS if layer else GROUND_LINKS), -1, np.int32) for layer in range(self.top + 1)]
        self.entry = int(np.argmax(levels)) if len(x) else -1

    def build(self) -> "Graph":
        # highest first: then an upper layer is whole before points of the layers below look for their place
        order = np.argsort(-self.levels, kind="stable")
        at, size = 1, 1
        while at < len(order):
            self._insert(order[:at], order[at : at + size])
            at, size = at + size, min(BATCH, size * 2)
        return self

    def _insert(self, old: np.ndarray, new: np.ndarray) -> None:
        entry = np.full(len(new), self.entry)
        for layer in range(self.top, -1, -1):
            here = np.flatnonzero(self.levels[new] >= layer)
            beam = BUILD_BEAM if len(here) else 1
            ids, dist, _ = beam_search(self.x, self.links[layer], self.x[new], entry, beam)
            entry = ids[:, 0]
            if len(here):
                self._connect(layer, new[here], ids[here], dist[here])

    def _connect(self, layer: int, points: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        x, links = self.x, self.links[layer]
        near = min(len(points) - 1, LINKS)
        if near > 0:  # the points of the batch are candidates for each other
            own = (x[points] ** 2).sum(1)
            gap = np.maximum(own[:, None] + own[None, :] - 2 * x[points] @ x[points].T, 0)
            np.fill_diagonal(gap, np.inf)
            pick = np.argpartition(gap, near - 1, axis=1)[:, :near]
            ids = np.concatenate((ids, points[pick]), axis=1)
            dist = np.concatenate((dist, np.take_along_axis(gap, pick, axis=1)), axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        chosen = choose(x, np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1), LINKS)
        links[points, :LINKS] = chosen
        i, j = np.nonzero(chosen >= 0)
        self._link_back(layer, chosen[i, j].astype(np.int64), points[i])

    def _link_back(self, layer: int, targets: np.ndarray, sources: np.ndarray) -> None:
        x, links = self.x, self.links[layer]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        who, first, count = np.unique(targets, return_index=True, return_counts=True)
        extra = np.full((len(who), int(count.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(who)), count), np.arange(len(targets)) - np.repeat(first, count)] = sources
        for at in range(0, len(who), BATCH):
            w = who[at : at + BATCH]
            cand = np.sort(np.concatenate((links[w].astype(np.int64), extra[at : at + BATCH]), axis=1), axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            dist = np.where(cand >= 0, _distances(x[w], x[np.where(cand < 0, 0, cand)]), np.inf)
            order = np.argsort(dist, axis=1, kind="stable")
            cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
            room = links.shape[1]
            fits = (cand >= 0).sum(axis=1) <= room
            kept = np.full((len(w), room), -1, np.int32)
            width = min(room, cand.shape[1])
            kept[fits, :width] = cand[fits, :width]
            if (~fits).any():
                kept[~fits] = choose(x, cand[~fits], dist[~fits], room)
            links[w] = kept

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Points nearest to each query, their squared distances, and how many distances were computed in all."""
        entry, total = np.full(len(q), self.entry), 0
        for layer in range(self.top, 0, -1):
            ids, _, n = beam_search(self.x, self.links[layer], q, entry, 1)
            entry, total = ids[:, 0], total + n
        ids, dist, n = beam_search(self.x, self.links[0], q, entry, beam)
        return ids, dist, total + n


def levels_of(ids: np.ndarray) -> np.ndarray:
    """A layer for each point, from its id alone: layer l or higher with probability LINKS**-l."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    u = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(12, np.floor(-np.log(u) / np.log(LINKS))).astype(np.int64)


def _index(group: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for dim, part in group.groupby(group["vector"].map(len)):  # vectors of unlike length are never neighbours
        part = part.sort_values("vec_id", kind="stable")
        points, place = np.unique(matrix(part["vector"], dim), axis=0, return_inverse=True)
        order = np.argsort(place.ravel(), kind="stable")
        ids, ends = part["vec_id"].to_numpy(np.int64)[order], np.cumsum(np.bincount(place.ravel()))
        graph = Graph(points.astype(np.float32), levels_of(ids[np.r_[0, ends[:-1]]])).build()
        rows.append((group["shard"].iloc[0], dim, points.tobytes(), ids.tobytes(), ends.tobytes(), [a.tobytes() for a in graph.links], graph.entry))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])


def _search(r, asked: pd.DataFrame, k: int, beam: int) -> list[pd.DataFrame]:
    points, ids, ends = np.frombuffer(r.points).reshape(-1, r.dim), np.frombuffer(r.ids, np.int64), np.frombuffer(r.ends, np.int64)
    graph = Graph.__new__(Graph)
    graph.x, graph.entry, graph.top = points.astype(np.float32), r.entry, len(r.links) - 1
    graph.links = [np.frombuffer(a, np.int32).reshape(len(points), -1) for a in r.links]
    starts, out = np.r_[0, ends[:-1]], []
    for at in range(0, len(asked), BATCH):
        part = asked.iloc[at : at + BATCH]
        q, own = matrix(part["vector"], r.dim), part["vec_id"].to_numpy(np.int64)
        found, _, _ = graph.search(q.astype(np.float32), max(beam, k + 1))
        i, j = np.nonzero(found >= 0)
        p = found[i, j]
        score = np.sqrt(((points[p] - q[i]) ** 2).sum(axis=1))
        # of a point's ids, sorted, only the first k + 1 can be among a query's k nearest
        count = np.minimum(ends[p] - starts[p], k + 1)
        row = np.repeat(np.arange(len(p)), count)
        vec = ids[starts[p][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)]
        keep = vec != own[i[row]]
        out.append(smallest(own[i[row]][keep], vec[keep], score[row][keep], k))
    return out


def nearest(rows: DataFrame, k: int = 10, every: int = 100, beam: int = SEARCH_BEAM, shard_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by Euclidean distance for every query row, by graph search; every row is indexed.

    Queries are the rows whose id is divisible by every; candidates all rows with another id and as many components.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids.
    A query id that is repeated is asked once, with the least of its vectors; repeated candidate rows all count.
    Returns query_id, rank (from 1), vec_id, score (the distance in double precision), ties to the smaller id.
    An empty table gives no rows; other columns may have any name.
    """
    clean = rows.where(F.col(id_col).isNotNull() & usable(vector_col, zero=False)).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    parts, queries, shards, waves = parted(clean, shard_rows or SHARD_ROWS, every)
    index = saved(parts.groupBy("shard").applyInPandas(_index, INDEX), "hnsw-index")

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        sizes = asked["vector"].map(len) if len(asked) else pd.Series([], dtype=int)
        found = [f for r in own.itertuples() for f in _search(r, asked[sizes == r.dim], k, beam)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return best(met(index, queries, shards, waves, search, RESULT.format("double")), k, descending=False)
