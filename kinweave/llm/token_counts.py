"""Token counts without tokens: count-only Viterbi over unigram matches.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character; the
dynamic programme carries the best score and its number of pieces. On equal scores the piece that starts
first wins, which is the tokenizer's own rule. Scores are added in double precision, word by word; the
library adds them in single precision over the whole text and so can lose ties on long texts or after
unknown characters, where its sums pass 2**24.

Null and empty texts count 0 tokens. Characters outside the vocabulary count their UTF-8 bytes. Repeated rows, and
ids that are shared or null, come back as often as they went in; no rows give no rows; other columns are not
read. Very long texts, and words without a break, are counted whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kinweave.llm.pieces import PieceTable, grouped, tool


class Counter:
    def __init__(self, table: PieceTable, most: int = 400_000):
        import ahocorasick

        self.t, self.most = table, most
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(table.ids):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.lengths = np.array([len(p) for p in table.ids])
        self.scores = np.array([table.scores[i] for i in table.ids.values()])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}  # word -> place in what follows
        self.best, self.tokens = np.empty(1024), np.empty(1024, dtype=np.int64)

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and count of each.

        One pass of the automaton over all words, with a border that no piece holds between them; then all
        words take their steps together, by end within the word and, at one end, from the earliest start on.
        Matches are numbers from the start: a long text has as many as it has characters, and more.
        """
        border = "\n"
        size = np.array([len(c) for c in words])
        begin = np.cumsum([0, *(size[:-1] + 1)])
        found = np.fromiter((e << 32 | k for e, k in self.automaton.iter(border.join(words))), dtype=np.int64)
        end, piece = (found >> 32) + 1, found & 0xFFFFFFFF
        start = end - self.lengths[piece]
        of = np.repeat(np.arange(len(words)), size + 1)[:-1]  # the word of each character
        score, width = self.scores[piece], np.zeros(len(found), dtype=np.int64) + 1
        alone = np.ones(len(of), dtype=bool)  # characters that are no piece
        alone[end[self.lengths[piece] == 1] - 1] = False
        alone[(begin + size)[:-1]] = False
        strange = np.flatnonzero(alone)
        if len(strange):
            text = border.join(words)
            start, end = np.concatenate([start, strange]), np.concatenate([end, strange + 1])
            score = np.concatenate([score, np.full(len(strange), self.t.unk_score)])
            width = np.concatenate([width, [len(text[i].encode("utf-8")) for i in strange]])
        local, length = end - begin[of[end - 1]], end - start
        order = np.lexsort((-length, local))
        start, end, score, width = start[order], end[order], score[order], width[order]
        step = local[order] * (self.t.longest + 1) + self.t.longest - length[order]
        cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        best, count = np.full(len(of) + 1, -np.inf), np.zeros(len(of) + 1, dtype=np.int64)
        best[begin] = 0
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s, e = start[lo:hi], end[lo:hi]
            got = best[s] + score[lo:hi]
            better = got > best[e]
            best[e[better]], count[e[better]] = got[better], count[s[better]] + width[lo:hi][better]
        return best[begin + size], count[begin + size]

    def learn(self, words: set[str], group: int = 20_000) -> None:
        if len(self.index) > self.most:
            self._forget()
        new = sorted(words.difference(self.index), key=len)
        for lo in range(0, len(new), group):
            part = new[lo : lo + group]
            k, m = len(self.index), len(part)
            while k + m > len(self.best):
                self.best, self.tokens = (np.concatenate([x, np.empty_like(x)]) for x in (self.best, self.tokens))
            self.best[k : k + m], self.tokens[k : k + m] = self._solve(part)
            self.index.update(zip(part, range(k, k + m), strict=True))

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation."""
        return next(self.count_many([text]))

    def count_many(self, texts: list[str | None], chars: int = 2_000_000):
        """count() of each, in groups of texts of about so many characters."""
        for part in grouped(texts, chars):
            cut = [self.t.words(t) for t in part]
            self.learn(set().union(*cut))
            sizes = np.array(list(map(len, cut)))
            at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
            ends = np.cumsum(sizes)
            tokens = np.concatenate([[0], np.cumsum(self.tokens[at])])
            for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                yield int(tokens[hi] - tokens[lo]), float(self.best[at[lo:hi]].sum())


def count_tokens(docs: DataFrame, table: PieceTable, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, score: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        counter = tool(Counter, shared.value)
        for pdf in batches:
            found = list(counter.count_many([t if isinstance(t, str) else None for t in pdf["text"]]))
            yield pd.DataFrame({key: pdf[key], "n_tokens": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select(key, "text").mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, score double")
