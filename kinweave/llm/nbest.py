"""SentencePiece encoding and decoding: the N best segmentations of every whole text.

Forward Viterbi scores are exact heuristics for a backward A* over the piece lattice. The lattice of a
text is a chain of its words' lattices, so A* runs over the words with a second choice near enough to
matter and, inside these, over pieces. The N best of the text need at most the N - 1 words with the
smallest loss from best to second-best.

Order: higher score first; then as A* meets ties, which is fixed by the text and the model alone.
A state is a position and a way of getting there from the right, kept as a link to the state before it; the N
best paths need no more than N states a position, so a word of any length takes time and memory in
proportion to its length.

Null and empty texts have one segmentation, the empty one. A text with fewer than N segmentations has fewer
ids. A table without rows gives one without rows; repeated rows and ids come back as often as they went in;
other columns of docs are not read, so they clash with nothing. Very long texts and words without a break
are solved whole. Decoding gives back the text exactly, but for U+2581, which is the model's sign for a
space and comes back as one, and lone surrogates, which UTF-8 can't hold and which become "?"; decoded_ok
tells such texts apart.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import slices
from kinweave.llm.pieces import PieceTable, grouped, tool


#: Words of at most so many characters are solved together with all others of their length, and remembered.
SHORT = 48


class Trie:
    """The vocabulary as arrays: all words of one length walk it together. Transitions sit in an open hash table."""

    def __init__(self, table: PieceTable):
        chars = sorted({c for p in table.ids for c in p})
        self.char = np.zeros(0x110000, dtype=np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        step: dict[tuple[int, int], int] = {}
        piece = [-1]
        for p, i in table.ids.items():
            at = 0
            for c in p:
                key = (at, int(self.char[ord(c)]))
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                at = step[key]
            piece[at] = i
        self.piece = np.array(piece)
        self.bits = max(4, (4 * len(step)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, dtype=np.int64)
        keys, to = np.array([a * self.width + c for a, c in step], dtype=np.int64), np.array(list(step.values()))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            win = np.zeros(len(keys), dtype=bool)
            win[first] = True
            win &= free
            self.keys[slot[win]], self.to[slot[win]] = keys[win], to[win]
            keys, to, slot = keys[~win], to[~win], (slot[~win] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next node of each, or -1."""
        keys = nodes * self.width + chars  # character 0 is in no key
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.to[slot], -1)
        left = np.flatnonzero(~hit & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


class Places(dict):
    """Words and their places, in order; a word that is looked up for the first time gets the next place."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class NBest:
    def __init__(self, table: PieceTable, n: int = 4, most: int = 400_000):
        self.t, self.n, self.most = table, n, most
        self.trie = Trie(table)
        self.piece_scores = np.array([*table.scores, table.unk_score])  # piece -1: unknown
        self.parts = table.piece_bytes()
        self.lists: dict[str, list] = {}
        self._forget()

    def _forget(self) -> None:
        self.index = Places()  # word -> place in what follows
        self.size = 0  # characters of all words
        self.ids = np.empty(1 << 16, dtype=np.int32)  # all words' best ids, one after the other
        self.used = 0
        self.first = np.empty(1024, dtype=np.int64)  # where a word's ids begin
        self.numbers = np.empty((1024, 3))  # score, loss of the second best, pieces

    def _add(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[at] = self.used + np.cumsum(counts) - counts
        self.numbers[at, 0], self.numbers[at, 1], self.numbers[at, 2] = scores, losses, counts
        self.used += len(ids)

    def places(self, cut: list[list[str]]) -> np.ndarray:
        """Places of all words in order; new ones are solved. The memo starts anew when it is full."""
        if len(self.index) > self.most or self.size > 16 * self.most:
            self._forget()
        known = len(self.index)
        try:
            at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
            self._learn(list(islice(reversed(self.index), len(self.index) - known))[::-1], known)
        except BaseException:
            self._forget()  # else words without a solution would be taken for known ones
            raise
        return at

    def _learn(self, words: list[str], known: int) -> None:
        """Solve the new words, whose places begin at ``known``; those of about a length at once."""
        while known + len(words) > len(self.first):
            self.first, self.numbers = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.numbers))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.size += int(sizes.sum())
        step = -(-sizes // 4) * 4
        for n in np.unique(step).tolist():
            group = np.flatnonzero(step == n)
            if n > SHORT:
                for k in group.tolist():
                    ids, score, loss = self._solve(words[k])
                    ids = np.frombuffer(ids, dtype=np.int32)
                    self._add(np.array([known + k]), ids, np.array([len(ids)]), np.array([score]), np.array([loss]))
            else:
                for lo in range(0, len(group), 4_000):
                    part = group[lo : lo + 4_000]
                    self._solve_short([words[k] for k in part.tolist()], n, known + part)

    def _solve_short(self, group: list[str], n: int, at: np.ndarray) -> None:
        """All words of the group, none longer than ``n``; positions behind a word's end have no character that a piece holds.

        Tables have a row a position and a column a word.
        """
        trie, rows = self.trie, len(group)
        size = np.fromiter(map(len, group), dtype=np.int64, count=rows)
        chars = np.zeros((rows, n), dtype=np.int64)
        chars[np.arange(n) < size[:, None]] = trie.char[np.frombuffer("".join(group).encode("utf-32-le"), dtype=np.uint32)]
        chars = np.ascontiguousarray(chars.T)
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        from_start, from_piece = np.zeros((n + 1, rows), dtype=np.int64), np.zeros((n + 1, rows), dtype=np.int64)
        edges: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = []

        def relax(s: int, e: int, r: np.ndarray, piece: np.ndarray) -> None:
            x = self.piece_scores[piece]
            edges[s].append((e, r, piece, x))
            got = alpha[s][r] + x
            better = got > alpha[e][r]
            r, piece = r[better], piece[better]
            alpha[e][r], from_start[e][r], from_piece[e][r] = got[better], s, piece

        for s in range(n):
            edges.append([])
            r = np.flatnonzero(size > s)
            node = np.zeros(len(r), dtype=np.int64)
            for e in range(s + 1, min(n, s + self.t.longest) + 1):
                node = trie.step(node, chars[e - 1][r])
                ok = node >= 0
                alone = r[~ok] if e == s + 1 else r[:0]
                r, node = r[ok], node[ok]
                piece = trie.piece[node]
                whole = piece >= 0
                if e == s + 1:
                    alone = np.concatenate([alone, r[~whole]])
                if whole.any():
                    relax(s, e, r[whole], piece[whole])
                if len(alone):
                    relax(s, e, alone, np.full(len(alone), -1))
                if not len(r):
                    break
        path = np.full((n, rows), -2)  # at its start, the piece of the best path
        here, live = size.copy(), np.arange(rows)
        while len(live):
            s, piece = from_start[here[live], live], from_piece[here[live], live]
            path[s, live] = piece
            here[live] = s
            live = live[s > 0]
        beta = np.full((n + 1, rows), -np.inf)
        beta[size, np.arange(rows)] = 0
        loss, top = np.full(rows, np.inf), alpha[size, np.arange(rows)]
        for s in range(n - 1, -1, -1):
            for e, r, piece, x in edges[s]:
                rest = x + beta[e][r]
                beta[s][r] = np.maximum(beta[s][r], rest)
                worse = top[r] - (alpha[s][r] + rest)
                worse[path[s][r] == piece] = np.inf  # the best path's own edge: from one start, a piece has one end
                loss[r] = np.minimum(loss[r], worse)
        path = np.ascontiguousarray(path.T)
        used = path != -2
        counts = used.sum(axis=1)
        strange = np.flatnonzero((path == -1).any(axis=1))
        if len(strange):  # words with characters outside the vocabulary, which become bytes
            plain = np.ones(rows, dtype=bool)
            plain[strange] = False
            for k in strange.tolist():
                ids = np.frombuffer(self._ids([(s, int(p)) for s, p in enumerate(path[k]) if p != -2], group[k]), dtype=np.int32)
                self._add(at[k : k + 1], ids, np.array([len(ids)]), top[k : k + 1], loss[k : k + 1])
            at, used, path, counts, top, loss = at[plain], used[plain], path[plain], counts[plain], top[plain], loss[plain]
        self._add(at, path[used].astype(np.int32), counts, top, loss)

    def _ending(self, word: str, e: int) -> list[tuple[int, int, float]]:
        """(start, piece, score) of the edges that end at ``e``, longest first; piece -1 is an unknown character."""
        ids, scores = self.t.ids, self.t.scores
        row = []
        for s in range(max(0, e - self.t.longest), e):
            i = ids.get(word[s:e])
            if i is not None:
                row.append((s, i, scores[i]))
        if not row or row[-1][0] != e - 1:
            row.append((e - 1, -1, self.t.unk_score))
        return row

    def _forward(self, word: str) -> tuple[array, array, array]:
        """Best score up to each position, and the start and piece of the edge that brings it."""
        alpha, start, piece = array("d", [0.0]), array("q", [-1]), array("q", [-1])
        for e in range(1, len(word) + 1):
            top, frm, got = float("-inf"), 0, -1
            for s, i, x in self._ending(word, e):
                if alpha[s] + x > top:
                    top, frm, got = alpha[s] + x, s, i
            alpha.append(top)
            start.append(frm)
            piece.append(got)
        return alpha, start, piece

    def _ids(self, path: list[tuple[int, int]], word: str) -> bytes:
        """path: (start, piece) from left to right. Little-endian int32."""
        out = array("i")
        for s, i in path:
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.t.byte_ids[b] for b in word[s].encode("utf-8"))
        return out.tobytes()

    def _solve(self, word: str) -> tuple[bytes, float, float]:
        """One long word: best ids, best score, loss of the second-best path (infinite if there is none)."""
        alpha, start, piece = self._forward(word)
        n = len(word)
        path, at = [], n
        used = bytearray(n + 1)  # ends of the best path's edges
        while at:
            used[at] = 1
            path.append((start[at], piece[at]))
            at = start[at]
        beta = array("d", [float("-inf")]) * n + array("d", [0.0])
        loss, top = float("inf"), alpha[n]
        for e in range(n, 0, -1):
            b = beta[e]
            if b == float("-inf"):
                continue
            for s, i, x in self._ending(word, e):
                if b + x > beta[s]:
                    beta[s] = b + x
                if not (used[e] and s == start[e] and i == piece[e]) and top - (alpha[s] + x + b) < loss:
                    loss = top - (alpha[s] + x + b)
        return self._ids(path[::-1], word), top, loss

    def _list(self, word: str) -> list[tuple[float, bytes]]:
        if len(word) > SHORT:
            return self._nbest(word)
        if word not in self.lists:
            if len(self.lists) >= 50_000:
                self.lists.clear()
            self.lists[word] = self._nbest(word)
        return self.lists[word]

    def _nbest(self, word: str) -> list[tuple[float, bytes]]:
        """(loss, ids) of the word's N best paths. Popped states carry their true best total: alpha is the exact rest.

        At equal loss the state nearest to the start of the word goes first, so ties are followed to their end
        instead of being spread over the word.
        """
        alpha, _, _ = self._forward(word)
        top, out = alpha[-1], []
        # of each state made: where it stands, its piece, and the state to its right
        place, piece, right = array("q", [len(word)]), array("q", [-1]), array("q", [-1])
        heap = [(0.0, len(word), 0, 0.0)]  # loss, position, state, score behind
        popped = bytearray(len(word) + 1)
        while heap and len(out) < self.n:
            loss, at, state, behind = heapq.heappop(heap)
            if not at:
                path = []
                while state:
                    path.append((place[state], piece[state]))
                    state = right[state]
                out.append((loss, self._ids(path, word)))
                continue
            if popped[at] == self.n:  # N better ways to the right are known from here
                continue
            popped[at] += 1
            for s, i, x in self._ending(word, at):
                if alpha[s] > float("-inf"):
                    place.append(s)
                    piece.append(i)
                    right.append(state)
                    heapq.heappush(heap, (top - (alpha[s] + x + behind), s, len(place) - 1, behind + x))
        return out

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the N best segmentations, best first."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str | None], chars: int = 2_000_000):
        """encode() of each, in groups of texts of about so many characters."""
        for part in grouped(texts, chars):
            cut = [self.t.words(t) for t in part]
            at = self.places(cut)
            numbers = self.numbers[at]
            counts = numbers[:, 2].astype(np.int64)
            ends = np.cumsum(counts)
            best = self.ids[np.repeat(self.first[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
            lo = used = 0
            for words in cut:
                hi = lo + len(words)
                till = int(ends[hi - 1]) if hi else 0
                yield self._encode(words, numbers[lo:hi], ends[lo:hi] - used, best[used:till])
                lo, used = hi, till

    def _encode(self, words: list[str], numbers: np.ndarray, ends: np.ndarray, best: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """numbers and ends: of each word, and where its ids end in the text's best ids."""
        score = float(numbers[:, 0].sum())
        if self.n == 1 or not words:
            return [(score, best)]
        losses = numbers[:, 1]
        m = min(self.n - 1, len(words))
        edge = np.partition(losses, m - 1)[m - 1]
        below = np.flatnonzero(losses < edge)
        where = sorted([*below.tolist(), *np.flatnonzero(losses == edge)[: m - len(below)].tolist()]) if edge < np.inf else below.tolist()
        options = [self._list(words[k]) for k in where]
        # backward A* over the chain of these words: all words to the left can still be best, at no loss
        heap, count, found = [(0.0, 0, len(where), ())], 0, []
        while heap and len(found) < self.n:
            loss, _, at, picks = heapq.heappop(heap)
            if not at:
                found.append((loss, picks))
                continue
            for j, (extra, _) in enumerate(options[at - 1]):
                count += 1
                heapq.heappush(heap, (loss + extra, count, at - 1, (j, *picks)))
        starts = np.concatenate([[0], ends])
        out = []
        for loss, picks in found:
            parts, last = [], 0
            for k, option, j in zip(where, options, picks, strict=True):
                if j:
                    parts += [best[last : starts[k]], np.frombuffer(option[j][1], dtype=np.int32)]
                    last = starts[k + 1]
            out.append((score - loss, np.concatenate([*parts, best[last:]]) if parts else best))
        return out


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def encode_documents(docs: DataFrame, table: PieceTable, n: int = 4, key: str = "doc_id", most: int = 400_000) -> DataFrame:
    """One row for each row of docs: key, n_pieces, scores, ids_sha256, decoded_ok, ids.

    ids holds the arrays of ids of the N best segmentations, best first; n_pieces, scores and ids_sha256 (over
    little-endian int32 ids) are theirs. Batches of some two million characters, or one text, go out as flat
    buffers: memory is bounded by these, by the longest text and by the ``most`` words that a worker remembers,
    whatever the size of an incoming batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    columns = [key, "n_pieces", "scores", "ids_sha256", "decoded_ok", "ids"]

    def run(batches):
        solver = tool(NBest, shared.value, n, most)
        for batch in batches:
            for rows in slices(batch):
                part = rows.column("text").to_pylist()
                found = list(solver.encode_many(part))
                ok = [solver.t.decode(x[-1][1].tolist(), solver.parts) == (t or "").encode("utf-8", "replace").decode("utf-8") for t, x in zip(part, found, strict=True)]
                flat = [ids for x in found for _, ids in x]
                counts, sizes = [len(x) for x in found], [len(ids) for ids in flat]
                ids = pa.array(np.concatenate(flat), pa.int32())
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in flat], pa.string())
                scores = pa.array([score for x in found for score, _ in x], pa.float64())
                made = [_lists(pa.array(sizes, pa.int32()), counts), _lists(scores, counts), _lists(digests, counts), pa.array(ok, pa.bool_()), _lists(_lists(ids, sizes), counts)]
                yield pa.RecordBatch.from_arrays([rows.column(key), *made], columns)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_pieces array<int>, scores array<double>, ids_sha256 array<string>, decoded_ok boolean, ids array<array<int>>"
    return docs.select(key, "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, table: PieceTable, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of an id array column; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def back(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else shared.value.decode(list(x)))

    return encoded.withColumn(out, back(F.col(ids)))
