"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for each vocabulary piece that matches at a position; a character
that no piece covers becomes its byte pieces.  A segmentation has a probability in proportion to
exp(smoothing x sum of its pieces' scores).  Forward filtering sums the weights of all paths to each
node; backward sampling walks from the end and draws each edge in proportion to the paths it ends.

No piece reaches over the beginning of a run of blanks or over a line break, so a text is a sequence
of independent units.  The different units of a batch are filtered together, one vector step for
each character position: a trie as a double array finds the edges, and counting the edges of each
node puts them in order.  All units of the batch are then sampled together: every unit goes along the
edges of its node, from the shortest piece on, until their cumulative probability is above the draw.
Probabilities are summed within a node only, and draws depend on the row key, the unit's number in
its text and the step alone, so a row gets one segmentation wherever it is processed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleloom.llm.common import small_batches

UNIT = re.compile(r" *[^ \n]+|\n| +")
SMOOTHING, SEED = 2e-4, 13
#: Texts that are encoded together, and characters from which a batch is closed earlier.
BATCH_TEXTS, BATCH_CHARS = 200, 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Encoder and decoder for one model file; pieces are spelled with blanks."""

    def __init__(self, path: str, smoothing: float = SMOOTHING) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        floor = -float(sp.get_piece_size())
        self.weight: dict[str, tuple[int, float]] = {}
        self.spelling: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.spelling.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelling.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.spelling.append(text.encode())
                self.weight[text] = (i, math.exp(smoothing * max(sp.get_score(i), floor)))
        self.byte_weight = smoothing * floor
        self.longest = max(map(len, self.weight))
        for text in self.weight:
            if len(text) > 1 and ("\n" in text or " " in text.lstrip(" ")):
                raise ValueError("a piece of this vocabulary reaches over a unit")
        self._plant()

    def _plant(self) -> None:
        """The trie as a double array: from state s the character with code c leads to state t = base[s] + c if parent[t] is s.

        The root is state 0; characters that no piece has get the code 0, which leads nowhere.
        """
        moves: dict[tuple[int, str], int] = {}
        children: list[list[str]] = [[]]
        ends: dict[int, str] = {}
        for text in self.weight:
            state = 0
            for c in text:
                if (state, c) not in moves:
                    children[state].append(c)
                    children.append([])
                    moves[state, c] = len(children) - 1
                state = moves[state, c]
            ends[state] = text
        codes = {c: i for i, (c, _) in enumerate(Counter(c for _, c in moves).most_common(), 1)}
        self.codes = np.zeros(0x110000, np.int64)
        self.codes[[ord(c) for c in codes]] = list(codes.values())
        below = [np.array([codes[c] for c in x], np.int64) for x in children]
        order = sorted(range(len(below)), key=lambda i: -len(below[i]))
        many = [i for i in order if len(below[i]) > 1]
        single = [i for i in order if len(below[i]) == 1]
        start = np.zeros(len(below), np.int64)
        taken, at, kind = np.zeros(4096, bool), 0, 0
        for i in many:
            at, kind = at if len(below[i]) == kind else 0, len(below[i])
            while True:
                while len(taken) < at + 64 + len(codes) + 1:
                    taken = np.concatenate([taken, np.zeros(len(taken), bool)])
                fits = ~taken[np.arange(at, at + 64)[:, None] + below[i]].any(1)
                if fits.any():
                    break
                at += 64
            at += int(fits.argmax())
            start[i] = at
            taken[at + below[i]] = True
        taken = np.concatenate([taken, np.zeros(len(codes) + len(single) + 1, bool)])
        free = np.flatnonzero(~taken[len(codes) :])[: len(single)] + len(codes)
        start[single] = free - np.array([below[i][0] for i in single], np.int64)
        place = np.zeros(len(below), np.int64)
        for (state, c), to in moves.items():
            place[to] = start[state] + codes[c]
        size = int(max(place.max(), start.max())) + len(codes) + 1
        self.base, self.parent, self.ids = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.base[place] = start
        for (state, _), to in moves.items():
            self.parent[place[to]] = place[state]
        self.weights = np.zeros(len(self.spelling))
        for state, text in ends.items():
            i, weight = self.weight[text]
            self.ids[place[state]], self.weights[i] = i, weight

    def _filter(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Last node of each unit, the first edge of each node, and of all edges, in the order of the
        nodes that they enter, the cumulative probability within the node, the node they leave and
        the piece (a character that becomes bytes: minus its code point, minus 1).

        Nodes are numbered by their position in the unit, then from the longest unit to the shortest;
        first nodes come behind all others.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        rank = np.empty(len(units), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(units))
        longer = len(units) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), side="right")  # units that reach a position
        levels = np.cumsum([0, *longer])
        nodes = int(levels[-1])
        # characters of all units, each unit behind a mark, which stands for its first node and ends the unit before
        points = np.frombuffer(("\n" + "\n".join(units) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        mark = np.cumsum(sizes + 1) - sizes - 1
        code = self.codes[points]
        code[mark] = code[-1] = 0
        place = np.arange(len(code) - 1) - np.repeat(mark + 1, sizes + 1)
        number = np.where(place < 0, nodes, levels[place]) + np.repeat(rank, sizes + 1)
        at = np.flatnonzero(place >= 0)
        state, degree, found = np.zeros(len(at), np.int64), np.zeros(nodes, np.int64), []
        for k in range(self.longest):
            to = self.base[state] + code[at + k]
            alive = np.flatnonzero(self.parent[to] == state)
            if not len(alive):
                break
            at, state = at[alive], to[alive]
            piece = self.ids[state]
            hit = np.flatnonzero(piece >= 0)
            start = at[hit]
            enter = number[start + k]
            before = degree[enter]  # pieces of one length enter a node once
            degree[enter] = before + 1
            found.append((enter, before, number[start - 1], piece[hit]))
        bare = np.flatnonzero(degree == 0)
        degree[bare] = 1
        first_edge = np.concatenate([[0], np.cumsum(degree)])
        leave, piece = np.zeros(first_edge[-1], np.int64), np.zeros(first_edge[-1], np.int32)
        for enter, before, start, got in found:
            edge = first_edge[enter] + before
            leave[edge], piece[edge] = start, got
        weight = self.weights[piece]
        if len(bare):
            which = np.empty(nodes, np.int64)
            which[number[place >= 0]] = np.flatnonzero(place >= 0)
            at = which[bare]
            char = points[at].astype(np.int64)
            width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            edge = first_edge[bare]
            leave[edge], piece[edge], weight[edge] = number[at - 1], -char - 1, np.exp(self.byte_weight * width)
        alpha, sums = np.ones(nodes + len(units)), np.empty(nodes)
        for j in range(len(levels) - 1):
            a, b = levels[j], levels[j + 1]
            e = slice(first_edge[a], first_edge[b])
            weight[e] *= alpha[leave[e]]
            total = np.add.reduceat(weight[e], first_edge[a:b] - first_edge[a])
            alpha[a:b] = sums[a:b] = total
            if j % 16 == 15:  # keep the weights of long units in range; only ratios matter
                for i in range(16):
                    alpha[levels[j - i] : levels[j - i] + b - a] /= total
        cum = weight / np.repeat(sums, degree)
        more = np.flatnonzero(degree > 1)
        edge = first_edge[more]
        for k in range(1, int(degree.max())):
            edge += 1
            cum[edge] += cum[edge - 1]
            left = np.flatnonzero(degree[more] > k + 1)
            more, edge = more[left], edge[left]
        cum[first_edge[1:] - 1] = 1
        return levels[sizes - 1] + rank, first_edge, cum, leave, piece

    def encode(self, texts: list[str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        """Sampled ids of each text; a leading blank is added, so that words at the start are like others."""
        split = [UNIT.findall(" " + t) if t else [] for t in texts]
        index: defaultdict[str, int] = defaultdict(count().__next__)
        each = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64)
        if not index:
            return [np.zeros(0, np.int32) for _ in texts]
        final, first_edge, cum, leave, piece = self._filter(list(index))
        sizes = np.array([len(s) for s in split])
        number = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        picks, steps = [], np.zeros(len(each), np.int64)
        with np.errstate(over="ignore"):
            start = _mix(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
            state = np.repeat(start, sizes) + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            node, active = final[each], np.arange(len(each))
            while len(active):
                state += np.uint64(0x8CB92BA72F3D8DD7)
                draw = (_mix(state) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                edge = first_edge[node]
                over = np.flatnonzero(cum[edge] <= draw)
                while len(over):
                    edge[over] += 1
                    over = over[cum[edge[over]] <= draw[over]]
                picks.append((active, piece[edge]))
                steps[active] = len(picks)
                node = leave[edge]
                on = np.flatnonzero(node < len(first_edge) - 1)
                node, active, state = node[on], active[on], state[on]
        last = np.cumsum(steps) - 1
        ids = np.empty(steps.sum(), np.int32)
        for k, (which, got) in enumerate(picks):
            ids[last[which] - k] = got
        owner = np.repeat(np.arange(len(texts)), sizes)
        bounds = np.cumsum(np.bincount(owner, steps, len(texts)).astype(np.int64))[:-1]
        low = (ids < 0) & (ids >= -128)
        ids[low] = self.byte_ids[-ids[low] - 1]
        out = np.split(ids, bounds)
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(ids < 0), side="right")):
            parts = [[x] if x >= 0 else [int(self.byte_ids[v]) for v in chr(-x - 1).encode("utf-8", "surrogatepass")] for x in out[i].tolist()]
            out[i] = np.array([x for p in parts for x in p], np.int32)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded: pieces and bytes put together, without the added blank."""
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def sampler(path: str, smoothing: float = SMOOTHING) -> Sampler:
    return Sampler(path, smoothing)


def encode(docs: DataFrame, model_path: str, with_ids: bool = True, smoothing: float = SMOOTHING, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit numbers), lossless, and ids.

    ``lossless`` says that decoding the ids gave the text again.  Null and empty texts have no
    pieces; texts of any length are encoded whole.  A null id has the key 0; repeated rows get equal
    segmentations.  Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sampler(model_path, smoothing)
        for b in batches:
            texts, keys = [t or "" for t in b.column(1).to_pylist()], [k or 0 for k in b.column(0).to_pylist()]
            found, at = [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < BATCH_TEXTS and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                    chars += len(texts[end])
                    end += 1
                found += coder.encode(texts[at:end], keys[at:end], seed)
                at = end
            columns = [
                b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                pa.array([coder.decode(x.tolist()) == t for x, t in zip(found, texts, strict=True)], pa.bool_()),
            ]
            if with_ids:
                bounds = np.cumsum([0, *map(len, found)])
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ids, one by one; null ids give a null text, an empty table no rows.  Other columns are ignored."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sampler(model_path)
        for b in batches:
            texts = [None if x is None else coder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
