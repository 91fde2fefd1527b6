"""SentencePiece encoding and decoding with N-best segmentations of whole texts.

The pieces and scores come from a SentencePiece model file; nothing is trained. A text's lattice holds
every piece that matches at every position, and for a character that no piece covers its bytes, at a
penalty. A segmentation's score is the sum of its pieces' scores. Forward Viterbi scores say how well
any prefix can be cut; they are exact, so a backward A-star search that uses them as its heuristic pops
the segmentations of a lattice best first.

A text's lattice falls into independent chunks between characters that no piece holds side by side: words,
mostly. Workers look all chunks of many texts up at once in a table of those met before; the N best of a text
need the A-star search only in the N - 1 chunks whose second choice costs least.

For a model of type BPE the scores are merge ranks: the best segmentation has the smallest rank sum, which
need not be the one that greedy merging reaches. It decodes to the same text.

Null and empty texts have no pieces and score 0. Encoding takes blanks and U+2581 for the same, as the
model does; every other text decodes to itself. Ties go to the segmentation whose pieces, from the end,
start earliest. Rows and the columns not named are kept.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import heapq
import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordtable import LONGEST, WordTable, buffer, slices
from .workers import give_back, lean

N_BEST = 4
#: Bytes of text that are cut up at once.
SLICE = 1_000_000
#: Chunks that a worker remembers.
CHUNKS = 600_000
#: Chunks whose N best a worker remembers.
SEARCHED = 50_000
_BLANK = "▁"
_PENALTY = 10.0


class Pieces:
    """The lattice, search and decoding of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: character -> [the trie below it, id of the piece that ends here or -1, its score]
        self.trie: dict = {}
        least = 0.0
        chars = set()
        for i, piece in enumerate(self.pieces):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            score = model.get_score(i)
            if score > -1e8:
                least = min(least, score)
            below = self.trie
            for c in piece:
                node = below.setdefault(c, [{}, -1, 0.0])
                below = node[0]
            node[1:] = i, score
            chars.update(piece)
        self.unknown = least - _PENALTY
        # no edge of the lattice spans two characters that no piece holds side by side
        self.pairs = {a + b for piece in self.pieces for a, b in itertools.pairwise(piece)}
        raw = [p.replace(_BLANK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw_first = np.cumsum([0, *map(len, raw)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        # which ASCII character may follow which character of one or two bytes inside a chunk
        self.joined = np.zeros((0x800, 128), dtype=bool)
        for a, b in self.pairs:
            for x in (a, " ") if a == _BLANK else (a,):
                for y in (b, " ") if b == _BLANK else (b,):
                    if ord(x) < 0x800 and ord(y) < 128:
                        self.joined[ord(x), ord(y)] = True
        self.table = WordTable(self._learn, np.uint32, 2, CHUNKS)
        #: Row of the table -> what the search found, for as long as the table is not emptied.
        self.searched: tuple[int, dict] = (0, {})

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position the (start, score, ids) of the lattice's edges that end there."""
        out: list[list] = [[] for _ in range(len(chunk) + 1)]
        n = len(chunk)
        for i in range(n):
            below, single = self.trie, False
            for j in range(i, n):
                node = below.get(chunk[j])
                if node is None:
                    break
                below, piece, score = node
                if piece >= 0:
                    out[j + 1].append((i, score, (piece,)))
                    single |= j == i
            if not single:
                out[i + 1].append((i, self.unknown, self._bytes(chunk[i])))
        return out

    def _bytes(self, c: str) -> tuple[int, ...]:
        return tuple([self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")])

    @staticmethod
    def forward(edges: list[list]) -> tuple[list[float], list]:
        """Viterbi: the best score of every prefix and the edge it ends with."""
        best, last = [0.0], [None]
        for own in edges[1:]:
            top, edge = -np.inf, None
            for e in own:
                if (s := best[e[0]] + e[1]) > top:
                    top, edge = s, e
            best.append(top)
            last.append(edge)
        return best, last

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a chunk: A-star from its end, guided by the forward scores."""
        edges = self.edges(chunk)
        best, _ = self.forward(edges)
        order = itertools.count(0, -1)  # among equals the newest first, so a path is finished before others open
        heap = [(-best[-1], 0, len(chunk), 0.0, ())]
        out: list = []
        while heap and len(out) < n:
            _, _, at, cost, path = heapq.heappop(heap)
            if at == 0:
                out.append((cost, tuple(itertools.chain.from_iterable(path))))
                continue
            for start, score, ids in edges[at]:
                heapq.heappush(heap, (-(best[start] + score + cost), next(order), start, score + cost, (ids, *path)))
        return out

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, counts, and (score, how much less the second best scores) of chunks."""
        found = [self.best(w.decode("utf-8", "surrogatepass").replace(" ", _BLANK)) for w in words]
        return np.frombuffer(b"".join([f[0] for f in found]), np.uint32), np.array([len(f[0]) // 4 for f in found]), np.array([f[1:] for f in found])

    def best(self, chunk: str) -> tuple[bytes, float, float]:
        """(ids of the best segmentation, its score, how much less the second best scores)."""
        pairs = self.pairs
        cuts = [i for i, pair in enumerate(map(str.__add__, chunk, chunk[1:]), 1) if pair not in pairs]
        if not cuts:
            return self._best(chunk)
        # the lattice falls into those of the parts
        found = [self._best(chunk[a:b]) for a, b in itertools.pairwise([0, *cuts, len(chunk)])]
        return b"".join([f[0] for f in found]), sum([f[1] for f in found]), min([f[2] for f in found])

    def _best(self, chunk: str) -> tuple[bytes, float, float]:
        """The first two answers of ``search``, in one pass over the lattice each way."""
        n, trie, unknown = len(chunk), self.trie, self.unknown
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        edges = []
        for i in range(n):  # every edge into i starts before it, so its score is final
            base, below, j, single = best[i], trie, i, False
            for c in chunk[i:]:
                node = below.get(c)
                if node is None:
                    break
                j += 1
                below, number, score = node
                if number >= 0:
                    edges.append((i, j, score))
                    if base + score > best[j]:
                        best[j], start[j], piece[j] = base + score, i, number
                    if j == i + 1:
                        single = True
            if not single:
                j = i + 1
                edges.append((i, j, unknown))
                if base + unknown > best[j]:
                    best[j], start[j], piece[j] = base + unknown, i, -1
        ids: list[int] = []
        on = {0}
        at = n
        while at:
            on.add(at)
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(reversed(self._bytes(chunk[start[at]])))
            at = start[at]
        ids.reverse()
        # the second best joins the best path for the last time over an edge that is not its own
        second = -np.inf
        tail = [-np.inf] * n + [0.0]
        for i, j, score in reversed(edges):
            reached = score + tail[j]
            if reached > tail[i]:
                tail[i] = reached
            if best[i] + reached > second and (j not in on or start[j] != i):
                second = best[i] + reached
        return array("I", ids).tobytes(), best[n], best[n] - second

    def column(self, texts: pa.Array, n: int = N_BEST) -> Iterator[Coded]:
        """What is found of some texts in a row, for all texts in turn."""
        data, edges = buffer(texts)
        for a, b in slices(edges, SLICE):
            yield self._slice(data[edges[a] : edges[b]], edges[a : b + 1] - edges[a], n)

    def _slice(self, data: np.ndarray, edges: np.ndarray, n: int) -> Coded:
        if (raw := data.tobytes()).find(_BLANK.encode()) >= 0:  # U+2581 and a blank are the same
            own = [raw[a:b].replace(_BLANK.encode(), b" ") for a, b in itertools.pairwise(edges.tolist())]
            data, edges = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        # every text but an empty one gets a blank in front
        full = np.diff(edges) > 0
        data, edges = np.insert(data, edges[:-1][full], 32), edges + np.concatenate([[0], np.cumsum(full)])
        cut = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            before = data[:-1].astype(np.uint16)
            wide = np.zeros(len(before), dtype=bool)
            wide[1:] = (before[1:] & 0xC0 == 0x80) & (before[:-1] & 0xE0 == 0xC0)
            code = before.copy()
            code[1:][wide[1:]] = ((before[:-1] & 0x1F) << 6 | before[1:] & 0x3F)[wide[1:]]
            here = np.flatnonzero((data[1:] < 128) & ((before < 128) | wide))
            cut[here + 1] = ~self.joined[code[here], data[here + 1]]
        cut[edges[:-1][full]] = True
        starts = np.flatnonzero(cut)
        rows = self.table.find(np.concatenate([data, np.zeros(LONGEST, np.uint8)]), starts, np.diff(np.append(starts, len(data))))
        ids, places = self.table.ids(rows)
        words = np.searchsorted(starts, edges)
        ends = places[words[1:]]
        length = np.diff(self.raw_first)[ids]
        at = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(self.raw_first[ids] - at[:-1], length)
        source += np.arange(at[-1])
        decoded = self.raw[source]
        return Coded(self, n, ids, ends, rows, words, starts, data, decoded, at[np.concatenate([[0], ends])])

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        raw = b"".join([self.raw[self.raw_first[i] : self.raw_first[i + 1]].tobytes() for i in np.asarray(ids).tolist()])
        return raw.decode("utf-8", "surrogatepass")[1:] if raw else ""

    def n_best(self, text: str | None, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a whole text."""
        (coded,) = self.column(pa.array([text or ""], pa.string()), n)
        return list(coded.n_best(0))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the best segmentation."""
        (coded,) = self.column(pa.array([text or ""], pa.string()), 1)
        return coded.ids


@dataclasses.dataclass
class Coded:
    """Some texts in a row: the ids of their best segmentations, and the bytes these decode to."""

    own: Pieces
    n: int
    ids: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    decoded: np.ndarray
    decoded_edges: np.ndarray

    def text(self, k: int) -> str:
        """What the k-th text's ids decode to."""
        raw = self.decoded[self.decoded_edges[k] : self.decoded_edges[k + 1]].tobytes()
        return raw.decode("utf-8", "surrogatepass")[1:] if raw else ""

    def _ways(self, k: int) -> tuple[float, list]:
        """(the best score, the n best as (loss, number, [(loss, word, ids)])) of the k-th text."""
        rows = self.rows[self.words[k] : self.words[k + 1]]
        score, gaps = self.own.table.values[rows].T if len(rows) else np.zeros((2, 0))
        wanted = min(self.n - 1, len(gaps))
        least = gaps <= np.partition(gaps, wanted - 1)[wanted - 1] if wanted else np.zeros(len(gaps), bool)
        near = np.flatnonzero(least & (gaps < np.inf))
        near = near[np.argsort(gaps[near], kind="stable")][:wanted]
        choices = []
        for w in near.tolist():
            found = self._searched(int(rows[w]), self.words[k] + w)
            choices.append([(found[0][0] - s, w, i) for s, i in found])
        ways = [(sum([c[0] for c in way]), number, way) for number, way in enumerate(itertools.product(*choices))]
        return float(score.sum()), heapq.nsmallest(self.n, ways, key=lambda w: w[:2])

    def _searched(self, row: int, word: int) -> list:
        own = self.own
        if own.searched[0] != own.table.generation or len(own.searched[1]) >= SEARCHED:
            own.searched = (own.table.generation, {})
        key = (row, self.n)
        if key not in own.searched[1]:
            end = self.starts[word + 1] if word + 1 < len(self.starts) else len(self.data)
            chunk = self.data[self.starts[word] : end].tobytes().decode("utf-8", "surrogatepass").replace(" ", _BLANK)
            own.searched[1][key] = own.search(chunk, self.n)
        return own.searched[1][key]

    def scores(self, k: int) -> list[float]:
        """The n best scores of the k-th text."""
        total, ways = self._ways(k)
        return [total - cost for cost, _, _ in ways]

    def n_best(self, k: int) -> Iterator[tuple[float, np.ndarray]]:
        """The n best (score, ids) of the k-th text."""
        total, ways = self._ways(k)
        rows = self.rows[self.words[k] : self.words[k + 1]]
        for cost, _, way in ways:
            parts = np.split(*self._parts(rows)) if len(rows) else [np.zeros(0, np.uint32)]
            for delta, w, i in way:
                if delta or cost:
                    parts[w] = np.array(i, dtype=np.uint32)
            yield total - cost, np.concatenate(parts)

    def _parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, edges = self.own.table.ids(rows)
        return ids, edges[1:-1]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_ADDED = "ids binary, n_tokens long, ids_crc32 long, score double, n_best_scores array<double>, decoded string, round_trip boolean"


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """``docs`` with the best ids (little-endian u32), the n best scores, and the text decoded from the ids.

    Columns of the names that are added are replaced.
    """
    docs = docs.drop("ids", "n_tokens", "ids_crc32", "score", "n_best_scores", "decoded", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            column, at = batch.column(batch.schema.get_field_index("text")), 0
            texts = column.fill_null("")
            for coded in own.column(column, n):
                size = len(coded.ends)
                part, given = batch.slice(at, size), texts.slice(at, size).to_pylist()
                at += size
                edges = [0, *coded.ends.tolist()]
                raw = coded.ids.astype("<u4").tobytes()
                each = [raw[4 * a : 4 * b] for a, b in itertools.pairwise(edges)]
                scores = [coded.scores(k) for k in range(size)]
                decoded = [coded.text(k) for k in range(size)]
                added = [
                    pa.array(each, pa.binary()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array(map(zlib.crc32, each), pa.int64(), size=size),
                    pa.array([s[0] for s in scores], pa.float64()),
                    pa.array(scores, pa.list_(pa.float64())),
                    pa.array(decoded, pa.string()),
                    pa.array([a == b for a, b in zip(decoded, given, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*batch.schema.names, "ids", "n_tokens", "ids_crc32", "score", "n_best_scores", "decoded", "round_trip"])
                give_back()

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(run), f"{schema}, {_ADDED}")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
