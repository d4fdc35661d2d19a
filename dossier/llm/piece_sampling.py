"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into pieces of the vocabulary form a lattice; a segmentation has the product of its pieces'
weights as its probability (Zipf's law over the ranks of the merges, to the power ``alpha``, as a BPE model stores ranks
and not probabilities). Sums over all ways to end give each lattice state exact probabilities of its next piece.

The search tree is perturbed from the top down: the root, all segmentations, gets a Gumbel number; a node's number is the
largest of its leaves', so a child inherits it and the rest of the node gets a Gumbel number of its own mass, kept below.
Best first, as in A-star with an exact bound: the open node with the largest number yields the next segmentation,
whose path leaves a node "any other piece here" at each step. The k segmentations are distinct, a sample without
replacement; the largest number still open is the threshold of their inclusion probabilities.

No piece reaches across the start of a word, so the lattice of a text is a chain of word lattices. Each worker makes
those once for each distinct word and remembers a bounded number until its task ends; all texts of a batch walk them together in numpy.
Draws come from a hash of seed, row key and place, so neither batches nor partitions change them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shingles import mix
from .storage import short_batches, trim

SPACE = "▁"
TOP = 2
ALPHA = 0.5
#: Lattice edges that a worker remembers, about; beyond it starts afresh.
KEPT_EDGES = 2_000_000
#: Words whose lattices are made together.
NEW_WORDS = 4_096
#: Bytes of text whose samples are drawn together.
PIECE = 1 << 19
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ALL, _STEP = (1 << 64) - 1, 0x632BE59BD9B4E019
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """Pieces as a trie for numpy; ids from the model's own numbering, unknown characters by their bytes."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        kinds = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(self.size)]
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.byte_ids = np.array([byte_ids.get(b, model.unk_id()) for b in range(256)], np.int32)
        normal = [i for i in range(self.size) if not kinds[i] and not model.is_byte(i)]
        rank = np.arange(1, len(normal) + 1)
        weight = -np.log(rank + 2.7)
        weight -= np.log(np.exp(weight).sum())
        self.weight = np.full(self.size, -np.inf)
        self.weight[normal] = alpha * weight
        self.byte_weight = alpha * (weight[-1] - np.log(256))
        self.bytes = [model.id_to_piece(i).encode() for i in range(self.size)]
        for b, i in byte_ids.items():
            self.bytes[i] = bytes([b])
        self.letters_of = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.n_bytes = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_at = np.cumsum(self.n_bytes) - self.n_bytes
        pieces = {model.id_to_piece(i): i for i in normal}
        letters = sorted({ord(c) for p in pieces for c in p})
        self.letters = len(letters)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[letters] = np.arange(len(letters))
        child: dict[tuple[int, int], int] = {}
        piece = [-1]
        for p, i in pieces.items():
            node = 0
            for c in p:
                step = (node, int(self.letter[ord(c)]))
                if step not in child:
                    child[step] = len(piece)
                    piece.append(-1)
                node = child[step]
            piece[node] = i
        keys = np.array([n * self.letters + c for n, c in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(child.values()), np.int32)[order]
        self.piece = np.array(piece, np.int32)
        self.root = self.step(np.zeros(self.letters + 1, np.int32), np.arange(-1, self.letters))

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, -1 where there is none."""
        key = node.astype(np.int64) * self.letters + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (letter >= 0), self.nodes[at], -1)

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Model ids of edge codes; a code past the vocabulary is a character, given by the ids of its bytes."""
        odd = codes >= self.size
        if not odd.any():
            return codes
        chars = codes[odd] - self.size
        length = np.ones(len(codes), np.int64)
        length[odd] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        at = np.cumsum(length)
        whole = np.zeros(int(at[-1]), bool)
        whole[at[~odd] - 1] = True
        out = np.empty(len(whole), np.int32)
        out[whole] = codes[~odd]
        out[~whole] = self.byte_ids[np.frombuffer("".join(map(chr, chars.tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts first."""
        size = self.n_bytes[ids]
        end = np.cumsum(size)
        at = np.repeat(self.byte_at[ids] - end + size, size)
        at += np.arange(len(at))
        text = self.letters_of[at].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


class Lattices:
    """The lattices of the words seen so far: for each state (place in a word) its edges, longest piece first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_states = self.n_edges = 0
        self.first = np.zeros(1, np.int64)  # first edge of each state
        self.code, self.next = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.logp, self.cum = np.zeros(0), np.zeros(0)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Writes values from a place on; a full array is replaced by one of twice the size."""
        held, end = getattr(self, name), at + len(values)
        if end > len(held):
            grown = np.empty(max(end, 2 * len(held)), held.dtype)
            grown[:at] = held[:at]
            setattr(self, name, grown)
            held = grown
        held[at:end] = values

    def states(self, words: list[str]) -> np.ndarray:
        """The first state of each word, given without the mark it starts with."""
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        absent = np.flatnonzero(out < 0).tolist()
        if absent:
            if self.n_edges > KEPT_EDGES:
                self.forget()
                absent = range(len(words))
            new = list(dict.fromkeys([words[i] for i in absent]))
            for at in range(0, len(new), NEW_WORDS):
                self._add(new[at : at + NEW_WORDS])
            out[absent] = [self.known[words[i]] for i in absent]
        return out

    def _weights(self, code: np.ndarray) -> np.ndarray:
        """Log weights of edge codes; a character without a piece weighs as its bytes do."""
        v, odd = self.v, np.flatnonzero(code >= self.v.size)
        c = code[odd] - v.size
        weight = v.weight[np.minimum(code, v.size - 1)]
        weight[odd] = v.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
        return weight

    def _add(self, words: list[str]) -> None:
        v = self.v
        chars = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.repeat(np.cumsum(size), size)
        n, letter = len(chars), v.letter[chars]
        count = np.ones(n, np.int64)  # the edge of one character is always there
        one = v.root[letter + 1]
        short = np.where(one >= 0, v.piece[one], -1)
        short = np.where(short >= 0, short, v.size + chars).astype(np.int32)
        found = [(np.arange(n), np.zeros(n, np.int64), 1, short)]
        at, node, length = np.flatnonzero(one >= 0), one[one >= 0], 1
        while len(at):
            go = at + length < end[at]
            at, node = at[go], node[go]
            node = v.step(node, letter[at + length])
            at, node = at[node >= 0], node[node >= 0]
            length += 1
            ends = v.piece[node] >= 0
            found.append((at[ends], count[at[ends]], length, v.piece[node[ends]]))
            count[at[ends]] += 1
        # states by their distance to the end of the word, so that each distance is one run of states and of edges
        distance = end - np.arange(n)
        order = np.argsort(distance.astype(np.uint16) if int(size.max()) < 1 << 16 else distance, kind="stable")
        state = np.empty(n + 1, np.int64)
        state[order] = np.arange(n)
        count = count[order]
        last = np.cumsum(count)
        edges, first = int(last[-1]), last - count
        code, target = np.empty(edges, np.int32), np.empty(edges, np.int32)
        for place, rank, length, piece in found:
            i = last[state[place]] - 1 - rank
            code[i] = piece
            target[i] = np.where(place + length < end[place], state[place + length], n)
        logp, cum = self._weights(code), np.empty(edges)
        beta = np.zeros(n + 1)  # the last one is what follows a word
        ends = np.cumsum(np.bincount(distance)).tolist()
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            a, b = int(first[low]), int(last[high - 1])
            run, many = first[low:high] - a, count[low:high]
            mass = logp[a:b] + beta[target[a:b]]
            most = np.maximum.reduceat(mass, run)
            share = np.exp(mass - np.repeat(most, many))
            total = np.add.reduceat(share, run)
            beta[low:high] = most + np.log(total)
            logp[a:b] = mass - np.repeat(beta[low:high], many)
            cum[a:b] = share / np.repeat(total, many)
        running = np.cumsum(cum)
        cum = running - np.repeat(np.concatenate(([0.0], running))[first], count)
        cum[last - 1] = 2.0
        base, shift = self.n_states, self.n_edges
        self.known.update(zip(words, (base + state[np.cumsum(size) - size]).tolist(), strict=True))
        self._put("first", base + 1, last + shift)
        self._put("code", shift, code)
        self._put("next", shift, np.where(target < n, target + base, -1))
        self._put("logp", shift, logp)
        self._put("cum", shift, cum)
        self.n_states, self.n_edges = base + n, shift + edges

    def walk(self, states: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random ways from each state to the end of its word: the edges in order, and how many from each state.

        A state of -1 is an end already. keys: a hash for each state, from which its draws come.
        """
        went, taken = [], np.zeros(len(states), np.int64)
        live = np.flatnonzero(states >= 0)
        state, key = states[live], keys[live]
        while len(live):
            key = mix(key + _GOLDEN)
            u = (key >> np.uint64(11)).astype(np.float64) / 2.0**53
            edge = self.first[state]
            on = np.flatnonzero(u >= self.cum[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.cum[edge[on]]]
            went.append((live, edge))
            taken[live] += 1
            state = self.next[edge]
            go = state >= 0
            live, state, key = live[go], state[go].astype(np.int64), key[go]
        at = np.cumsum(taken) - taken
        out = np.empty(int(taken.sum()), np.int64)
        for step, (who, edge) in enumerate(went):
            out[at[who] + step] = edge
        return out, taken


def below(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers of mass exp(phi), given that they are below top."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(phi), -np.inf, phi - np.log(np.exp(phi - top) - np.log(u)))


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def words_of(text: str) -> list[str]:
    """A text as the encoder reads it: a space first, spaces as marks, cut before each run of marks.

    The mark that each word starts with is left out.
    """
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
        return text.split(" ")
    return [w[1:] for w in _UNIT.findall(SPACE + text.replace(" ", SPACE))]


class Sample:
    """One text's open nodes and the segmentations found."""

    __slots__ = ("open", "found")

    def __init__(self):
        self.open: list[tuple] = []  # number, path, place, edges already taken there, log probability before it
        self.found: list[tuple] = []  # number, log probability, edges


def sample_batch(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[list[tuple], float]]:
    """The k segmentations of each text, best number first, and the largest number left open."""
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = lattices.states([w for ws in words for w in ws])
    ends = np.cumsum(n_words)
    samples = [Sample() for _ in texts]
    numbers = -np.log(-np.log(uniform(mix(seeds))))
    # what each text continues from: edges fixed so far, their log probability, then states to walk from
    todo = [(d, np.zeros(0, np.int64), flat[ends[d] - n_words[d] : ends[d]], numbers[d]) for d in range(len(texts))]
    starts_of = [flat[ends[d] - n_words[d] : ends[d]] for d in range(len(texts))]
    for turn in range(k):
        if not todo:
            break
        count = np.array([len(t[2]) for t in todo], np.int64)
        states = np.concatenate([t[2] for t in todo])
        place = np.arange(len(states)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            salt = mix(seeds[[t[0] for t in todo]] + np.uint64(turn + 1) * _GOLDEN)
        walked, taken = lattices.walk(states, mix(np.repeat(salt, count) + place.astype(np.uint64)))
        cuts = np.concatenate(([0], np.cumsum(taken)))[np.concatenate(([0], np.cumsum(count)))]
        steps = np.diff(cuts)
        logp = lattices.logp[walked]
        base = np.array([float(lattices.logp[t[1]].sum()) for t in todo])
        # summed text by text, so that a text's numbers don't depend on what is beside it
        upto = [np.cumsum(logp[a:b]) + p for a, b, p in zip(cuts[:-1], cuts[1:], base, strict=True)]
        # an open node at every new step: any other edge there
        prefix = np.concatenate(upto) - logp
        with np.errstate(divide="ignore"):
            rest = prefix + np.log(-np.expm1(np.minimum(logp, 0)))
        rest[logp > -1e-12] = -np.inf
        at = np.arange(len(walked)) + np.repeat(np.array([len(t[1]) for t in todo]) - cuts[:-1], steps)
        u = uniform(np.repeat(salt, steps) ^ (np.uint64(0xA5A5A5A5) + at.astype(np.uint64)) * _GOLDEN)
        # Gumbel numbers below one bound stay in the order of the unbounded ones
        free = rest - np.log(-np.log(u))
        again = []
        for j, (d, fixed, _, number) in enumerate(todo):
            a, b = int(cuts[j]), int(cuts[j + 1])
            own = samples[d]
            path = np.concatenate((fixed, walked[a:b])) if len(fixed) else walked[a:b]
            own.found.append((number, float(upto[j][-1]) if b > a else float(base[j]), path))
            best = np.arange(a, b) if b - a <= k + 1 else a + np.argpartition(free[a:b], b - a - k - 1)[b - a - k - 1 :]
            mine = below(rest[best], number, u[best]).tolist()
            own.open += [(x, len(own.found) - 1, len(fixed) + i - a, (int(walked[i]),), float(prefix[i])) for x, i in zip(mine, best.tolist(), strict=True) if x > -np.inf]
            own.open.sort(key=lambda x: (-x[0], x[1], x[2]))
            if turn + 1 < k and own.open:
                again.append(_branch(lattices, own, starts_of[d], d, int(salt[j])))
        todo = again
    return [(s.found, s.open[0][0] if s.open else -np.inf) for s in samples]


def _draw(key: int) -> float:
    """uniform() of one key."""
    x = key & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


def _branch(lattices: Lattices, own: Sample, starts: np.ndarray, d: int, salt: int) -> tuple:
    """Takes the best open node: another edge at its place; what is left of the node stays open."""
    number, path_at, place, tried, prefix = own.open.pop(0)
    path = own.found[path_at][2]
    state = int(np.searchsorted(lattices.first[: lattices.n_states + 1], tried[0], side="right")) - 1
    first, end = int(lattices.first[state]), int(lattices.first[state + 1])
    mass = [(e, math.exp(p)) for e, p in zip(range(first, end), lattices.logp[first:end].tolist(), strict=True) if e not in tried]
    key = salt ^ (place * 1_000_003 + len(tried))
    aim = _draw(key) * sum(m for _, m in mass)
    for pick, m in mass:
        aim -= m
        if aim < 0:
            break
    left = sum(m for e, m in mass if e != pick)
    tried = (*tried, pick)
    if left > 0:
        phi = prefix + math.log(left)
        rest = phi - math.log(math.exp(phi - number) - math.log(_draw(key + _STEP)))
        own.open.append((rest, path_at, place, tried, prefix))
    after = int(lattices.next[pick])
    done = int(np.count_nonzero(lattices.next[path[:place]] < 0))  # whole words before the place
    later = starts[done + 1 :]
    fixed = np.append(path[:place], pick)
    return d, fixed, np.concatenate(([after], later)) if after >= 0 else later, number


_lattices: dict[tuple[str, float], Lattices] = {}


def worker_lattices(path: str, alpha: float) -> Lattices:
    """The worker's own lattices: the vocabulary serves the tasks that follow."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattices(Vocabulary(path, alpha))
    return _lattices[path, alpha]


SCHEMA = "doc_id bigint, sample int, n_ids int, ids_crc32 bigint, log_prob double, perturbed double, inclusion double, round_trip boolean"


def sample_pieces(docs: DataFrame, model_path: str, k: int = TOP, alpha: float = ALPHA, seed: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k distinct segmentations of each whole text (all, if it has fewer), by falling perturbed number.

    Returns doc_id, sample (from 1), n_ids, ids_crc32 (of the ids as little-endian uint32), log_prob, perturbed (the
    Gumbel number), inclusion (the probability of being among the k, given the threshold), round_trip (whether the ids decode
    to the text) and, if asked for, ids. Null and empty texts have one segmentation, without ids. Rows with equal id and text get
    equal samples; a null id counts as one key. A text that holds the space mark itself decodes to spaces: round_trip false.
    Very long texts are segmented whole. An empty table gives no rows; other columns may have any name.
    """
    short_batches(docs.sparkSession)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = worker_lattices(model_path, alpha)
        try:
            yield from sampled(lattices, batches)
        finally:  # the worker lives on, in other stages' tasks too
            lattices.forget()
            trim()

    def sampled(lattices: Lattices, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            keys = np.array([0 if pd.isna(i) else int(i) + 1 for i in batch["doc_id"]], np.int64).view(np.uint64)
            seeds = mix(mix(keys + np.uint64(seed) * _GOLDEN) + np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64))
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PIECE or i + 1 == len(texts):
                    yield rows(lattices, batch["doc_id"].iloc[at : i + 1], texts[at : i + 1], seeds[at : i + 1])
                    at, size = i + 1, 0

    def rows(lattices: Lattices, ids: pd.Series, texts: list[str], seeds: np.ndarray) -> pd.DataFrame:
        v, out = lattices.v, []
        for doc, text, (found, threshold) in zip(ids, texts, sample_batch(lattices, texts, seeds, k), strict=True):
            for turn, (number, logp, path) in enumerate(found, 1):
                own = v.ids(lattices.code[path])
                inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(logp - threshold, 700.0))))
                out.append((None if pd.isna(doc) else doc, turn, len(own), zlib.crc32(own.astype("<u4").tobytes()), logp, number, inclusion, v.decode(own) == text, own))
        columns = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"]
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame if with_ids else frame.drop(columns="ids")

    rows_in = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInPandas(fn, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_pieces(model_path: str, ids: Column) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = worker_lattices(model_path, ALPHA).v
        for batch in batches:
            yield batch.map(lambda x: None if x is None else v.decode(np.asarray(x, np.int32)))

    return decode(ids)
