"""Piece lattices of many words at once, and the existing piece vocabulary they are made of.

A word's lattice has a node before each character and one after the last, and an edge
for every vocabulary piece that fits; a character without a piece of its own gets one
edge, spelled by the pieces of its UTF-8 bytes.  Edges, forward and backward sums and samples
are numpy arrays over all words of a batch, so their cost is a few array operations an edge;
a batch takes as many steps as its longest word has characters.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

from .textscan import mix

SPACE = "▁"
#: Stands for a literal SPACE character of a text; a lone surrogate occurs in no UTF-8 text.
LITERAL_SPACE = "\ud800"
_SLOT_BITS = 20


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces and log scores of a SentencePiece model file; it is only read, never trained.

    Scores that are ranks (a BPE model's: 0, -1, -2, ...) become log probabilities by
    Zipf's law; scores of a unigram model are log probabilities already.
    """

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary_path())
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(n)])
        usable &= [SPACE not in p.lstrip(SPACE) and "\n" not in p for p in self.pieces]
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so it can't encode every text")
        self.n = n
        ranks = usable & (scores == np.round(scores))
        if ranks.sum() == usable.sum():
            log = -np.log(scores[usable].max() - scores + 2.0, where=usable, out=np.zeros(n))
        else:
            log = np.where(usable, scores, 0.0)
        if (scores[self.byte_ids] == 0).all():  # ranks again: bytes are the rarest pieces
            log[self.byte_ids] = log[usable].min()
        else:
            log[self.byte_ids] = scores[self.byte_ids]
        drawn = usable.copy()
        drawn[self.byte_ids] = True
        #: Log probabilities by piece id; pieces that no text can hold have none.
        self.scores = np.where(drawn, log - np.logaddexp.reduce(log[drawn]), -np.inf)
        self._index(usable)

    def _index(self, usable: np.ndarray) -> None:
        """Sorted hashes of all prefixes of usable pieces, with the piece's id or -1."""
        ids: dict[str, int] = {}
        for i in np.flatnonzero(usable):
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                ids.setdefault(piece[:k], -1)
            ids[piece] = int(i)
        texts = list(ids)
        points, bounds = _characters(texts)
        sizes = np.diff(bounds)
        keys, open_ = np.full(len(texts), _START), np.arange(len(texts))
        for k in range(int(sizes.max())):
            open_ = open_[sizes[open_] > k]
            keys[open_] = _extended(keys[open_], points[bounds[open_] + k])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(ids.values()))[order]
        self.longest = max(map(len, texts))
        slot = (self.keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot))[::-1]  # a slot's first key
        self.crowd = np.bincount(slot, minlength=1 << _SLOT_BITS).astype(np.int8)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is that of a prefix, and the piece's id or -1."""
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at, crowd = self.slots[slot], self.crowd[slot]
        known = (self.keys[at] == h) & (crowd > 0)
        k = 1
        while len(rest := np.flatnonzero((crowd > k) & ~known)):
            hit = self.keys[at[rest] + k] == h[rest]
            at[rest[hit]] += k
            known[rest[hit]] = True
            k += 1
        return known, np.where(known, self.ids[at], -1)

    def raw(self) -> list[bytes]:
        """The bytes each id stands for."""
        values = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            values[i] = bytes([b])
        return values


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


_START = np.uint64(0x51ED270B9F3C6A85)


def _extended(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings, each with one more character."""
    return mix(h ^ (points.astype(np.uint64) + np.uint64(1)))


def _stable_order(small: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; 16 bits get a radix sort."""
    return np.argsort(small.astype(np.uint16) if len(small) and small.max() < 1 << 16 else small, kind="stable")


class Lattice:
    """The lattices of some nonempty words; node k of word w is ``base[w] + k``."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.points, bounds = _characters(words)
        n, lengths = len(self.points), np.diff(bounds)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.base = bounds[:-1] + np.arange(len(words))
        self.final = self.base + lengths
        self.n_nodes = n + len(words)
        starts, ends, pieces = [], [], []
        active, h = np.arange(n, dtype=np.int32), np.full(n, _START)
        for length in range(1, vocabulary.longest + 1):
            room = active + length <= bounds[1:][word[active]]
            active, h = active[room], h[room]
            if not len(active):
                break
            h = _extended(h, self.points[active + length - 1])
            known, piece = vocabulary.find(h)
            if length == 1:
                alone = np.flatnonzero(piece < 0)
                unknown, which = np.unique(self.points[alone], return_inverse=True)
                piece[alone] = vocabulary.n + which
            hit = piece >= 0
            starts.append(active[hit] + word[active[hit]])
            ends.append(starts[-1] + np.int32(length))
            pieces.append(piece[hit].astype(np.int32))
            active, h = active[known], h[known]
        #: Byte pieces of the characters without a piece of their own: ids vocabulary.n, vocabulary.n + 1, ...
        self.spelling = [vocabulary.byte_ids[np.frombuffer((chr(p) if p != ord(LITERAL_SPACE) else SPACE).encode(), np.uint8)] for p in (unknown.tolist() if n else [])]
        self.n_pieces = vocabulary.n
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, ends, pieces))
        order = np.argsort(end, kind="stable")  # a merge of the runs above
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        depth_of = np.zeros(self.n_nodes, np.int32)
        at = np.arange(n, dtype=np.int32)
        depth_of[at + word + 1] = at - bounds[:-1][word] + 1
        self.by_depth = _stable_order(depth_of[self.end]).astype(np.int32)
        self.depth = depth_of[self.end][self.by_depth]

    def _weights(self, scores: np.ndarray) -> np.ndarray:
        """The edges' weights: their pieces' scores, or the sums of their bytes' scores."""
        return np.concatenate([scores, [scores[ids].sum() for ids in self.spelling]])[self.piece]

    def _layers(self, key: np.ndarray) -> Iterator[slice]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip(itertools.chain((0,), cuts), itertools.chain(cuts, (len(key),) if len(key) else ()), strict=False):
            yield slice(a, b)

    @staticmethod
    def _sum_into(out: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        """out[node] = log of the sum of exp(value) over equal nodes, which stand together."""
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        top = np.maximum.reduceat(value, first)
        counts = np.diff(np.append(first, len(node)))
        out[node[first]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), first))

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Log weight of all paths from a word's start to each node."""
        alpha, weight = np.full(self.n_nodes, -np.inf), self._weights(scores)
        alpha[self.base] = 0.0
        for layer in self._layers(self.depth):
            e = self.by_depth[layer]
            self._sum_into(alpha, self.end[e], alpha[self.start[e]] + weight[e])
        return alpha

    def expected(self, scores: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when word w occurs times[w] times."""
        alpha, weight = self.forward(scores), self._weights(scores)
        beta = np.full(self.n_nodes, -np.inf)
        beta[self.final] = 0.0
        size = np.repeat(self.final - self.base, self.final - self.base + 1)
        word = np.repeat(np.arange(len(self.base)), self.final - self.base + 1)
        left = size[self.start] - (self.start - self.base[word[self.start]])
        by_start = np.argsort(self.start, kind="stable")
        order = by_start[_stable_order(left[by_start])]
        for layer in self._layers(left[order]):
            e = order[layer]
            self._sum_into(beta, self.start[e], beta[self.end[e]] + weight[e])
        w = word[self.start]
        share = np.exp(alpha[self.start] + weight + beta[self.end] - alpha[self.final[w]])
        uses = np.bincount(self.piece, weights=share * times[w], minlength=self.n_pieces + len(self.spelling))
        for k, ids in enumerate(self.spelling):
            np.add.at(uses, ids, uses[self.n_pieces + k])
        return uses[: self.n_pieces]

    def sample(self, scores: np.ndarray, words: np.ndarray, noise) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation for each of ``words`` (word numbers), drawn backward from the forward sums.

        noise(which, step) gives numbers in [0, 1) for the occurrences ``which``.  Returns the
        edges of all segmentations in reading order, and each one's number of edges.  A draw
        reads sums over its node's edges only, so it doesn't depend on a word's neighbours.
        """
        alpha = self.forward(scores)
        upto = np.exp(alpha[self.start] + self._weights(scores) - alpha[self.end])
        n_in = np.bincount(self.end, minlength=self.n_nodes)
        first = np.cumsum(n_in) - n_in
        rank = np.arange(len(self.end)) - first[self.end]
        by_rank = _stable_order(rank)
        for layer in itertools.islice(self._layers(rank[by_rank]), 1, None):
            at = by_rank[layer]
            upto[at] += upto[at - 1]
        which = np.argsort(words, kind="stable")  # near nodes are looked up together
        node, step = self.final[words[which]], 0
        stop = np.cumsum((self.final - self.base)[words])  # as many places as characters, filled from the back
        places = np.full(int(stop[-1]) if len(stop) else 0, -1, np.int32)
        is_base = np.zeros(self.n_nodes, bool)
        is_base[self.base] = True
        n_edges = np.zeros(len(words), np.int64)
        while len(which):
            edge, last = first[node], first[node] + n_in[node] - 1
            goal = noise(which, step) * upto[last]
            rest = np.flatnonzero(edge < last)
            while len(rest := rest[(edge[rest] < last[rest]) & (upto[edge[rest]] <= goal[rest])]):
                edge[rest] += 1
            places[stop[which] - 1 - step] = edge
            n_edges[which] += 1
            node = self.start[edge].astype(np.int64)
            more = ~is_base[node]
            node, which, step = node[more], which[more], step + 1
        return places[places >= 0], n_edges
