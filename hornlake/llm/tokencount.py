"""Token counts by trie-shared dynamic programming (operator 5).

Pre-tokens are runs between ASCII white space with a word mark in front. The
distinct pre-tokens of a task are inserted into a trie that lives as long as the
task. A node is a prefix and has its unigram forward state, the best score of a
segmentation and that segmentation's tokens; it is computed once, when the
prefix is first met, from the states on the path to it. Terminal nodes store
their pre-token's count.

Piece scores come from the vocabulary file alone (the public files hold no
unigram probabilities, and tokenizers aren't trained here): a piece
of rank r gets Zipf's log probability -log(r + 2.7). Characters without a piece
cost one byte piece per UTF-8 byte. Scores are compared as they are, in floating
point, summed from left to right; equal ones prefer fewer tokens.

Counting is local to a task, so no word, however frequent, meets others in a
shuffle. A trie that reaches ``NODES`` nodes is begun anew, which changes no count.

Cases: null and empty texts have no pre-token and count 0; repeated rows give
repeated rows; other columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, words_of

MARK = "▁"
NODES = 400_000
SCHEMA = "doc_id long, n_pretokens long, n_tokens long"


class Unigram:
    """Best segmentations over a fixed vocabulary."""

    _made: dict[str, "Unigram"] = {}

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        #: scores of pieces; None for what is only the end of one
        self.ends: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(len(p))} | pieces

    @classmethod
    def get(cls, name: str) -> "Unigram":
        if name not in cls._made:
            import public_tokenizers
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
            normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
            pieces = {sp.id_to_piece(i): -math.log(rank + 2.7) for rank, i in enumerate(normal)}
            cls._made[name] = cls(pieces, -math.log(len(normal) + 2.7))
        return cls._made[name]

    def state(self, text: str, path: list[tuple[float, int]]) -> tuple[float, int]:
        """(score, -tokens) of the prefix that is one character longer than those on ``path``."""
        ends, end = self.ends, len(path)
        top = None
        for start in range(end - 1, -1, -1):
            score = ends.get(text[start:end], 0)
            if score == 0:  # no piece ends so
                break
            if score is not None:
                s, n = path[start]
                if top is None or (s + score, n - 1) > top:
                    top = (s + score, n - 1)
        if top is None:
            width = len(text[end - 1].encode("utf-8", "replace"))
            s, n = path[-1]
            top = (s + width * self.byte_score, n - width)
        return top


class Trie:
    """Prefixes met, with their forward states; ``counts`` are those of terminal nodes."""

    def __init__(self, model: Unigram, nodes: int = NODES):
        self.model, self.most = model, nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.states: list[tuple[float, int]] = [(0.0, 0)]  # by node; the first is the root
        self.counts: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The word's token count."""
        if len(self.states) >= self.most:
            self.clear()
        child, states, text = self.child, self.states, MARK + word
        node, path = 0, [states[0]]
        for c in text:
            after = child.get((node, c))
            if after is None:
                after = child[node, c] = len(states)
                states.append(self.model.state(text, path))
            node = after
            path.append(states[node])
        self.counts[word] = -path[-1][1]
        return self.counts[word]

    def count(self, words: list[str]) -> int:
        """Tokens of all words."""
        total = 0
        for w in words:
            n = self.counts.get(w)
            total += self.insert(w) if n is None else n
        return total


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k") -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of ``docs``."""

    def make():
        trie = Trie(Unigram.get(vocabulary))

        def step(batch: pa.RecordBatch):
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            total = pa.array([trie.count(w) for w in split], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in split], pa.int64()), total], ["doc_id", "n_pretokens", "n_tokens"])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCHEMA, text=1)
