"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is a dummy space and its characters, cut into units that no piece crosses: a line feed, or a run of spaces
with the characters behind it. Each distinct unit's piece lattice is filtered forwards once: every node gets the
probabilities of the edges that end in it, given that a path does. Then all occurrences in a batch are sampled
backwards together, one edge a step, from random numbers that are a function of the row key, the occurrence's place
in its text and the step, so a segmentation doesn't depend on partitions, batches or retries.

A piece's weight is rank ** -alpha, with its rank among the vocabulary's merges; a character without a piece of its
own is written as byte pieces, and so is U+2581, which would be read back as a space. Decoding is lossless for every text.

Defined cases: null and empty texts have no pieces and decode to an empty text. A null row key is a key like any
other. Rows with equal keys and texts get equal pieces. An empty table gives no rows. Other columns are kept, but one named
like the new column is replaced. Texts of any length are sampled in parts of about CHUNK characters with the same pieces as at once;
a worker's lattices stay within KEPT_NODES nodes and those of one part, at most four a character. Units of more than LONG characters
are cut where no piece crosses, which leaves the distribution as it is; memory grows with the longest stretch without such a place.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 20
SPACE = "▁"

#: Nodes of lattices that a worker keeps; then it forgets all but units that came again. Characters of text that are sampled together.
KEPT_NODES, CHUNK = 600_000, 500_000
#: Occurrences up to which they are sampled one after the other, that many steps' random numbers at a time.
FEW, STEPS = 4, 256
#: Bits of a hash that are tested before it is looked up, and those by which it is.
TEST_BITS, SLOT_BITS = 18, 14
#: Edges whose probabilities are computed one by one as Python's numbers at a time.
EDGES = 100_000
#: Characters of a unit beyond which its nodes are filtered one by one.
FAR = 256

#: Probability one, in the whole numbers that probabilities are rounded to.
UNIT = 1 << 40
_UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_CUT = re.compile(r"\n|(?<! ) ")  # where a unit starts
#: Characters beyond which a unit is cut where no piece crosses; its parts have at least half as many as FAR.
LONG = 4096
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each 64-bit number."""
    with np.errstate(over="ignore"):
        x = x + _MIX[2]
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def _hashes(text: str, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the substrings of that length at these places."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = _longer(out, points[at + k])
    return out


def _longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The hashes of substrings that are one character longer."""
    with np.errstate(over="ignore"):
        h = (h ^ points) * _MIX[0]
        return h ^ (h >> np.uint64(29))


def _top(h: np.ndarray, bits: int = TEST_BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _one_by_one(source: np.ndarray, target: np.ndarray, weight: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The probabilities of edges sorted by target, of which alpha knows all nodes before the first target; EDGES at a time."""
    heads, out, known = np.flatnonzero(np.diff(target, prepend=-1)), np.empty(len(target)), memoryview(alpha)
    first = 0
    while first < len(target):
        after = np.searchsorted(heads, first + EDGES)
        end = int(heads[after]) if after < len(heads) else len(target)
        out[first:end] = _edge_by_edge(*(v[first:end].tolist() for v in (source, target, weight)), known)
        first = end
    return out


def _edge_by_edge(source: list[int], target: list[int], weight: list[float], alpha: memoryview) -> list[float]:
    share, i = [], 0
    while i < len(target):
        j = i
        while j < len(target) and target[j] == target[i]:
            j += 1
        value = [alpha[source[k]] + weight[k] for k in range(i, j)]
        top = max(value)
        value = [math.exp(v - top) for v in value]
        whole = sum(value)
        alpha[target[i]] = top + math.log(whole)
        share += [v / whole for v in value]
        i = j
    return share


class Lattices:
    """The filtered lattices of the units met so far, as flat arrays over nodes and edges."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes = [b""] * n  # what each piece decodes to
        self.byte_piece = np.zeros(256, np.int32)
        self.weights: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_piece[int(piece[3:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.weights[piece.replace(SPACE, " ")] = (i, -alpha * math.log(2 - sp.get_score(i)))
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.fallback = -alpha * math.log(2 + n)
        # Of the pieces of each length: sorted hashes and a last one, ids, weights, where the hashes of a slot begin, and a first
        # test of hashes, with 1 for those of pieces and 2 for those of beginnings of longer pieces.
        self.by_length = []
        for length in range(1, max(map(len, self.weights)) + 1):
            pieces = [p for p in self.weights if len(p) == length]
            begun = [*{p[:length] for p in self.weights if len(p) > length}]
            found, more = (_hashes("".join(x), np.arange(len(x)) * length, length) for x in (pieces, begun))
            order = np.argsort(found)
            ids = np.array([self.weights[p][0] for p in pieces] + [0], np.int32)[[*order, -1]]
            weights = np.array([self.weights[p][1] for p in pieces] + [0], float)[[*order, -1]]
            test = np.zeros(1 << TEST_BITS, np.uint8)
            test[_top(found)] = 1
            test[np.unique(_top(more))] += 2
            slots = np.searchsorted(found[order], np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
            self.by_length.append((np.append(found[order], ~np.uint64(0)), ids, weights, slots, test))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.ends = np.empty(0, np.int64)  # of each unit: its last node
        self.uses = np.empty(0, np.int64)  # of each unit: its occurrences, those before a time of forgetting by half
        self.begins = np.empty(0, bool)  # of each node: whether a unit starts there
        self.first = np.empty(0, np.int64)  # of each node: the first of the edges that end in it
        self.cum = np.empty(0, np.int64)  # of each edge: the cumulative probability at the node that it ends in; the last one's is UNIT
        self.source = np.empty(0, np.int32)
        self.piece = np.empty(0, np.int32)

    def _matches(self, points: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """All pieces in a text whose places have so many characters to their unit's end: starts, lasts, ids and weights, by length."""
        at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        for length, (known, ids, weights, slots, test) in enumerate(self.by_length, 1):
            h = _longer(h, points[at + (length - 1)])
            tests = test[_top(h)]
            maybe = np.flatnonzero(tests & 1)  # few others pass
            own, there = h[maybe], at[maybe]
            k = slots[_top(own, SLOT_BITS)]
            before = np.flatnonzero(known[k] < own)
            while len(before):
                k[before] += 1
                before = before[known[k[before]] < own[before]]
            hit = np.flatnonzero(known[k] == own)
            there, k = there[hit], k[hit]
            yield there, there + (length - 1), ids[k], weights[k]
            on = np.flatnonzero((tests >= 2) & (left[at] > length))
            at, h = at[on], h[on]

    def cut(self, unit: str) -> list[str]:
        """A long unit in parts that end where no piece crosses, as every path passes there: sampled apart, they are sampled alike."""
        if len(unit) <= LONG:
            return [unit]
        places, reach = [], len(self.by_length)
        for first in range(0, len(unit), CHUNK):  # a slice, with as much before and behind it as a piece can reach
            a, b = max(0, first - reach), min(len(unit), first + CHUNK + reach)
            points, crossed = np.frombuffer(unit[a:b].encode("utf-32-le"), np.uint32), np.zeros(b - a + 2, np.int64)
            for start, last, *_ in self._matches(points, np.arange(b - a, 0, -1)):
                np.add.at(crossed, start + 1, 1)
                np.add.at(crossed, last + 1, -1)
            free = np.flatnonzero(np.cumsum(crossed)[: b - a] == 0) + a
            places.append(free[(free >= max(first, 1)) & (free < first + CHUNK)])
        free, out, at = np.concatenate(places), [], 0
        while (k := np.searchsorted(free, at + FAR // 2)) < len(free):
            out.append(unit[at : int(free[k])])
            at = int(free[k])
        return [*out, unit[at:]]

    def units(self, text: str) -> list[str]:
        found = _split(text)
        return found if len(text) <= LONG or max(map(len, found)) <= LONG else [*chain.from_iterable(map(self.cut, found))]

    def add(self, units: list[str]) -> None:
        """Filter the lattices of new units forwards, all together."""
        text = "".join(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))  # characters to the unit's end
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        matches = [*self._matches(points, left)]
        alone = np.ones(len(text), bool)  # characters without a piece of their own get a node for each byte
        alone[matches[0][0]] = False
        width = np.where(alone, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
        after = np.cumsum(width) + unit
        before = after - width
        edges = [(before[start], after[end], piece, weight) for start, end, piece, weight in matches]
        data = np.frombuffer("".join(map(text.__getitem__, np.flatnonzero(alone).tolist())).encode(), np.uint8)
        first = np.cumsum(width[alone]) - width[alone]
        for k in range(4):
            own = width[alone] > k
            node = before[alone][own] + k
            edges.append((node, node + 1, self.byte_piece[data[first[own] + k]], self.fallback * (width[alone][own] if k == 0 else np.zeros(own.sum()))))
        ends = np.cumsum(np.add.reduceat(width, np.cumsum(sizes) - sizes) + 1) - 1
        begins = np.zeros(ends[-1] + 1, bool)
        begins[np.concatenate([[0], ends[:-1] + 1])] = True
        # Edges by target: those of one length have different ones, so they are put in their places length by length.
        ending = np.bincount(np.concatenate([e[1] for e in edges]), minlength=len(begins))
        target, heads = np.repeat(np.arange(len(begins)), ending), np.cumsum(ending) - ending
        source, piece, weight = np.empty(len(target), np.int64), np.empty(len(target), np.int32), np.empty(len(target))
        free = heads.copy()
        for own_source, own_target, own_piece, own_weight in edges:
            place = free[own_target]
            source[place], piece[place], weight[place] = own_source, own_piece, own_weight
            free[own_target] = place + 1
        share = self._filter(source, target, weight, begins)
        last = np.append(target[1:] != target[:-1], True)
        # Sums of whole numbers, which don't depend on the units that were met before.
        sums = np.cumsum(np.rint(share * UNIT).astype(np.int64))
        group = np.cumsum(last) - last
        within = np.minimum(sums - np.concatenate([[0], sums[last]])[group], UNIT)
        base = len(self.begins)
        self.first = np.concatenate([self.first, heads + len(self.cum)])
        self.cum = np.concatenate([self.cum, np.where(last, UNIT, within)])
        self.source = np.concatenate([self.source, (source + base).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece])
        self.begins = np.concatenate([self.begins, begins])
        self.ends = np.concatenate([self.ends, ends + base])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])

    def lookup(self, units: list[str]) -> np.ndarray:
        """The last nodes of units; the lattices of new ones are made. Nodes stay within KEPT_NODES where those of one call do."""
        known = len(self.ends)
        number = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        uses = np.bincount(number, minlength=len(self.numbers))
        self.uses += uses[:known]
        if new := [*islice(reversed(self.numbers), len(self.numbers) - known)][::-1]:
            if known and len(self.begins) + len("".join(new).encode("utf-8", "surrogatepass")) + len(new) > KEPT_NODES:
                number = self._forget(uses > 0)[number]
            self.add(new)
            self.uses[-len(new) :] = uses[known:]
        return self.ends[number]

    def _forget(self, needed: np.ndarray) -> np.ndarray:
        """Keep the needed units and, up to half of KEPT_NODES nodes, those that came more than once, the most frequent ones first.
        The new number of each unit that is kept."""
        sizes = np.diff(self.ends, prepend=-1)
        kept = needed[: len(sizes)].copy()
        often = np.flatnonzero((self.uses > 1) & ~kept)
        often = often[np.argsort(-self.uses[often], kind="stable")]
        kept[often[np.cumsum(sizes[often]) <= KEPT_NODES // 2 - sizes[kept].sum()]] = True
        edges = np.diff(self.first[self.begins], append=len(self.cum))
        nodes, on = np.repeat(kept, sizes), np.repeat(kept, edges)
        fewer_nodes, fewer_edges = np.cumsum(np.where(kept, 0, sizes)), np.cumsum(np.where(kept, 0, edges))
        self.first = self.first[nodes] - np.repeat(fewer_edges[kept], sizes[kept])
        self.source = self.source[on] - np.repeat(fewer_nodes[kept], edges[kept]).astype(np.int32)
        self.cum, self.piece, self.begins = self.cum[on], self.piece[on], self.begins[nodes]
        self.ends, self.uses = np.cumsum(sizes[kept]) - 1, self.uses[kept] // 2
        left = np.append(kept, np.ones(len(needed) - len(kept), bool))
        self.numbers = defaultdict(count(int(left.sum())).__next__, zip(compress(self.numbers, left.tolist()), count()))
        return np.cumsum(left) - 1

    @staticmethod
    def _filter(source: np.ndarray, target: np.ndarray, weight: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of edges sorted by target: their probabilities at it. Nodes of equal rank in their units are taken together, but from
        rank FAR on, where few units reach, one by one."""
        starts = np.flatnonzero(begins)
        rank = np.arange(len(begins)) - starts[np.cumsum(begins) - 1]
        rank = np.minimum(rank, FAR).astype(np.min_scalar_type(FAR))[target]  # short numbers are sorted by radix
        order = np.argsort(rank, kind="stable")
        source, target, weight = source[order], target[order], weight[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(rank[order])) + 1, [len(order)]])
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        nodes, size, groups = target[heads], np.diff(heads, append=len(target)), np.searchsorted(heads, bounds)
        alpha, share = np.zeros(len(begins)), np.empty(len(source))
        for a, b, i, j in zip(bounds[:-1], bounds[1:], groups[:-1], groups[1:]):
            if rank[order[a]] >= FAR:
                share[a:b] = _one_by_one(source[a:b], target[a:b], weight[a:b], alpha)
                break
            own = heads[i:j] - a
            value = alpha[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, own)
            value = np.exp(value - np.repeat(top, size[i:j]))
            whole = np.add.reduceat(value, own)
            alpha[nodes[i:j]] = top + np.log(whole)
            share[a:b] = value / np.repeat(whole, size[i:j])
        out = np.empty(len(share))
        out[order] = share
        return out

    def sample(self, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all occurrences one after the other, and how many each has. ends: last nodes; keys: 64-bit seeds."""
        cum, source, piece, begins, first = self.cum, self.source, self.piece, self.begins, self.first
        who = np.argsort(ends)  # neighbours in the arrays are looked up one after the other
        node = ends[who]
        counts, steps, step = np.zeros(len(ends), np.int64), [], 0
        while len(who) > FEW:
            u = (mixed(keys[who] + np.uint64(step)) & np.uint64(UNIT - 1)).astype(np.int64)
            edge = first[node]
            left = np.flatnonzero(cum[edge] <= u)
            while len(left):
                edge[left] += 1
                left = left[cum[edge[left]] <= u[left]]
            steps.append((who, piece[edge]))
            node = source[edge].astype(np.int64)
            counts[who] += 1
            on = ~begins[node]
            who, node = who[on], node[on]
            step += 1
        rest = {w: self._walk(n, keys[w], step) for w, n in zip(who.tolist(), node.tolist())}
        for w, own in rest.items():
            counts[w] += len(own)
        out = np.empty(counts.sum(), np.int32)
        stops = np.cumsum(counts) - 1
        for k, (who, got) in enumerate(steps):
            out[stops[who] - k] = got
        for w, own in rest.items():
            out[stops[w] - step - np.arange(len(own))] = own
        return out, counts

    def _walk(self, node: int, key: np.uint64, step: int) -> array:
        """The pieces of one occurrence from a node back to its unit's start."""
        cum, source, piece, begins, first = map(memoryview, (self.cum, self.source, self.piece, self.begins, self.first))
        out = array("i")
        while True:
            for u in (mixed(key + np.arange(step, step + STEPS, dtype=np.uint64)) & np.uint64(UNIT - 1)).tolist():
                edge = first[node]
                while cum[edge] <= u:
                    edge += 1
                out.append(piece[edge])
                node = source[edge]
                if begins[node]:
                    return out
            step += STEPS


@lru_cache(maxsize=2)
def lattices(model: str, alpha: float) -> Lattices:
    return Lattices(model, alpha)


def forget() -> None:
    lattices.cache_clear()


def _split(text: str) -> list[str]:
    """The units of a text. Where each space starts one, replacing and splitting takes less time than a pattern."""
    if "  " in text or "\0" in text:
        return _UNIT.findall(text)
    return [*filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))]


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK characters that no unit crosses; a unit that is longer is a part of its own length."""
    at = 0
    while len(text) - at > CHUNK:
        end = _CUT.search(text, at + CHUNK)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def encode_texts(texts: list[str], keys: list[int], own: Lattices, seed: int) -> list[np.ndarray]:
    """The sampled pieces of each text. What is sampled together is bounded by characters, and the lattices by nodes."""
    rows = mixed(np.array(keys, np.int64).astype(np.uint64) + np.uint64(seed))
    found, group, size = [[] for _ in texts], [], 0

    def sample() -> None:
        for (k, *_), pieces in zip(group, _encode_units([units for _, units, _ in group], rows[[k for k, *_ in group]], [place for *_, place in group], own)):
            found[k].append(pieces)
        group.clear()

    for k, text in enumerate(texts):
        place = 0
        for part in _parts(" " + text) if text else ():
            units = own.units(part)
            # A part of more than CHUNK characters was one unit, and is cut now.
            ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units))) if len(part) > 2 * CHUNK else np.array([len(part)])
            cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(units)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                group.append((k, units[a:b], place))
                place, size = place + b - a, size + (len(part) * (b - a) // len(units))
                if size >= 2 * CHUNK:
                    sample()
                    size = 0
    sample()
    return [own_[0] if len(own_) == 1 else np.concatenate(own_) if own_ else np.empty(0, np.int32) for own_ in found]


def _encode_units(each: list[list[str]], rows: np.ndarray, places: list[int], own: Lattices) -> list[np.ndarray]:
    """The sampled pieces of runs of units, which have row hashes and the places of their first units in their texts."""
    units = [*chain.from_iterable(each)]
    nodes = own.lookup(units)
    sizes = np.array([len(x) for x in each], np.int64)
    starts = np.repeat(np.cumsum(sizes) - sizes - np.array(places, np.int64), sizes)
    place = (np.arange(len(nodes)) - starts).astype(np.uint64)
    with np.errstate(over="ignore"):
        occurrence = mixed(np.repeat(rows, sizes) + place * _MIX[2])
    pieces, counts = own.sample(nodes, occurrence)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
    return [pieces[a:b] for a, b in zip(ends[:-1], ends[1:])]


def decode_pieces(pieces: np.ndarray, own: Lattices) -> str:
    return b"".join(map(own.bytes.__getitem__, pieces.tolist())).decode()[1:]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of about CHUNK characters, each with its texts."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy()
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, append=-1)) + 1
    for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
        part = batch.slice(i, j - i)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", text: str = "text", out: str = "pieces") -> DataFrame:
    """docs with a column of sampled piece ids, which replaces one of that name. Each text is decoded again at once; a difference is an error."""
    kept = [c for c in docs.columns if c.lower() != out.lower()]

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(model, alpha)
        for b, texts in (part for whole in batches for part in _slices(whole, len(kept))):
            keys = [-1 if k is None else k for k in b.column(len(kept) + 1).to_pylist()]
            found = encode_texts(texts, keys, own, seed)
            if not all(decode_pieces(p, own) == t for p, t in zip(found, texts)):
                raise ValueError("a text isn't what its pieces decode to")
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pieces], names=[*kept, out])

    # The text and the key come last, under names that no column has.
    spare = "_" * (1 + max(map(len, docs.columns)))
    own = docs.select(*kept, F.col(text).alias(f"{spare}t"), F.col(key).cast("long").alias(f"{spare}k"))
    kinds = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return own.mapInArrow(run, kinds)


def decoded(pieces: Column, model: str = MODEL, alpha: float = ALPHA) -> Column:
    """The texts that arrays of piece ids stand for."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        own = lattices(model, alpha)
        return pd.Series([decode_pieces(np.asarray(p, np.int32), own) if p is not None and len(p) else "" for p in ids])

    return texts(pieces)


def encode_and_decode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of 32-bit little-endian ids), text_sha256 (of the decoded text), lossless."""

    @lean(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(model, alpha)
        for b, texts in (part for whole in batches for part in _slices(whole, 1)):
            keys = [-1 if k is None else k for k in b.column(0).to_pylist()]
            n, of_pieces, of_text, same = [], [], [], []
            for text, pieces in zip(texts, encode_texts(texts, keys, own, seed)):
                back = decode_pieces(pieces, own)
                n.append(len(pieces))
                of_pieces.append(hashlib.sha256(pieces.astype("<i4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(of_pieces, pa.string()), pa.array(of_text, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "pieces_sha256", "text_sha256", "lossless"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, text_sha256 string, lossless boolean")


def op7_sp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
