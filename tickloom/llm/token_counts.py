"""Token counts of the best unigram segmentation, by dynamic programming over a trie of pre-tokens.

Pre-tokens are a text's words with the vocabulary's word mark before them. The distinct ones of the
corpus (see ``dictionary``) are dealt in order, so that a bucket holds all those between two borders, and inserted in
a trie of the bucket; a node's forward score, the best sum of piece scores up to it, is computed once for all
pre-tokens that share the prefix, from the scores above it, and the nodes where pre-tokens end hold their counts.
Only a prefix that a border cuts has a node in more than one trie, so a frequent prefix is many tasks' work. A character that no piece covers counts as its
UTF-8 bytes, at a score below every piece's.

Defined results: null text is an empty text (no tokens); of segmentations of equal score the one of
fewest tokens counts; repeated rows each get their row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.dictionary import over_words

MARK = "▁"


def read_scores(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece vocabulary, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in usable}


class Trie:
    """Forward scores and token counts of all prefixes of the pre-tokens that were inserted."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.children: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # by node: score, and tokens with a minus sign

    def insert(self, token: str) -> int:
        """The token count of a pre-token's best segmentation."""
        path = [0]
        for depth, char in enumerate(token, 1):
            node = self.children.get((path[-1], char))
            if node is None:
                node = self.children[path[-1], char] = len(self.best)
                self.best.append(self._forward(token, depth, path))
            path.append(node)
        return -self.best[path[-1]][1]

    def _forward(self, token: str, depth: int, path: list[int]) -> tuple[float, int]:
        get, best = self.scores.get, self.best
        found = None
        for start in range(max(0, depth - self.longest), depth):
            score = get(token[start:depth])
            if score is not None:
                above = best[path[start]]
                value = (above[0] + score, above[1] - 1)
                if found is None or value > found:
                    found = value
        if token[depth - 1] not in self.scores:
            above = best[path[depth - 1]]
            size = len(token[depth - 1].encode())
            value = (above[0] + size * self.unknown, above[1] - size)
            found = value if found is None or value > found else found
        return found


class _Count:
    def __init__(self, path: str):
        self.path = path

    def __call__(self):
        trie = Trie(read_scores(self.path))
        return lambda words: [trie.insert(w).to_bytes(4, "little") for w in words]


def _split(text: str) -> list[bytes]:
    return text.encode().split()


def _name(word: bytes) -> str:
    return MARK + word.decode()


def _gather(flat: np.ndarray, offsets: np.ndarray, documents: Iterator[tuple[int | None, np.ndarray]]) -> pa.Table:
    counts = flat.view("<u4").astype(np.int64)
    rows = [(i, len(at), int(counts[at].sum())) for i, at in documents]
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "n_words", "n_tokens"), columns, strict=True)})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text."""
    return over_words(docs, id_col, text_col, _split, _name, _Count(path), _gather, "doc_id long, n_words long, n_tokens long", by_prefix=True)
