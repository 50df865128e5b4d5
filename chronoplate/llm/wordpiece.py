"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces: a word takes the longest vocabulary piece that starts it, then the longest continuation
piece from there, and so on; a word that can't be covered counts as one unknown token. The automaton is a trie over both
kinds of pieces in which every node has a failure link, and the number of pieces that following the link pops, so a word is
read once, left to right, and only a counter grows. A count costs time linear in the word's length and builds no pieces.

Words are the runs between blanks (space, \\t \\n \\v \\f \\r). Counts of words already met are kept in a bounded table in each
worker. Null and empty texts count 0. A word longer than `longest` characters counts one unknown token where that limit is
given; by default there is none.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from chronoplate.llm.common import arrow_map, words_of

KNOWN = 200_000


class Automaton:
    """Trie with failure links. `heads` start a word, `tails` continue one.

    Node 0 is the root of heads, node 1 the root of tails. `fail[v]` is where reading goes on after popping the longest
    pieces out of v's string, `pops[v]` how many they are; fail -1: the string can't be split.
    """

    def __init__(self, heads: Iterable[str], tails: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, heads), (1, tails)):
            for piece in pieces:
                at = root
                for c in piece:
                    if (to := self.next[at].get(c)) is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = to
                ends[at] = ends[at] or at > 1
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        queue = deque((root, c, v) for root in (0, 1) for c, v in self.next[root].items())
        while queue:
            parent, c, v = queue.popleft()
            if ends[v]:  # the whole string is a piece: pop it, go on at the tails' root
                self.fail[v], self.pops[v] = 1, 1
            else:  # pop from the parent's string until the rest can be continued by c
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.pops[v] = self.next[at][c], popped
            queue.extend((v, d, w) for d, w in self.next[v].items())

    def count(self, word: str) -> int:
        """Pieces of one word; 1 for a word that can't be covered."""
        at, n, follow, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while (to := follow[at].get(c)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:  # what is left must be popped whole
            if at < 1:
                return 1 if word else 0
            n += pops[at]
            at = fail[at]
        return n


@functools.lru_cache(2)
def from_pieces(model_file: str) -> Automaton:
    """Automaton of a sentencepiece vocabulary: pieces with the word mark start words, the others continue them; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Automaton((p[1:] for p in pieces if p[0] == "▁" and len(p) > 1), (p for p in pieces if "▁" not in p))


class Counter(dict):
    """Counts of words already met; emptied when full, so that memory is bounded."""

    def __init__(self, automaton: Automaton, longest: int | None):
        super().__init__()
        self.automaton, self.longest = automaton, longest

    def __missing__(self, word: str) -> int:
        n = 1 if self.longest and len(word) > self.longest else self.automaton.count(word)
        if len(word) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = n
        return n


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", model_file: str | None = None, longest: int | None = None) -> DataFrame:
    """`key`, `n_words` and `n_tokens` (long) of every whole text."""
    model_file = model_file or default_model()
    state: dict[str, Counter] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["counts"] = Counter(from_pieces(model_file), longest)
        counts = state["counts"]
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sum(map(counts.__getitem__, w)) for w in words], pa.int64())], names=["key", "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), "text", f"key {kind}, n_words bigint, n_tokens bigint", work).withColumnRenamed("key", key)


def pieces_by_search(word: str, heads: set[str], tails: set[str]) -> int:
    """The same count by searching the longest piece at each place: the plain form that tests compare with."""
    at, n = 0, 0
    while at < len(word):
        pool = tails if at else heads
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n



