"""Token counts: greedy longest-match word pieces by a linear automaton, without building the pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table
from folio.llm.tokens import ENTRY, REMEMBERED, vocabulary

UNKNOWN = 1 << 40  # in a count: a word that no pieces make up


class LongestMatch:
    """A trie of first pieces and one of later pieces, with failure links and counts of popped pieces.

    On a character without a transition, the node's longest piece is taken off and the rest of what
    was read goes on at the failure link; how many pieces that takes off is stored with the node. A word
    takes steps in proportion to its length, whatever the vocabulary.
    """

    def __init__(self, first: frozenset[str], later: frozenset[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: start of a word; node 1: after a piece
        whole = [False, False]
        for root, words in ((0, first), (1, later)):
            for word in sorted(words):
                u = root
                for c in word:
                    v = self.next[u].get(c)
                    if v is None:
                        v = len(self.next)
                        self.next.append({})
                        whole.append(False)
                        self.next[u][c] = v
                    u = v
                whole[u] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = [0, 1]
        for u in queue:
            for c, v in self.next[u].items():
                queue.append(v)
                if whole[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """Number of pieces; one piece and UNKNOWN if greedy matching fails."""
        u, n, following, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in word:
            v = following[u].get(c)
            while v is None:
                if fail[u] < 0:
                    return UNKNOWN + 1
                n += popped[u]
                u = fail[u]
                v = following[u].get(c)
            u = v
        while u > 1:
            if fail[u] < 0:
                return UNKNOWN + 1
            n += popped[u]
            u = fail[u]
        return n


@lru_cache(maxsize=2)
def automaton(first: frozenset[str], later: frozenset[str]) -> tuple[LongestMatch, dict[str, int]]:
    return LongestMatch(first, later), {}


def piece_sets(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """First and later pieces of a sentencepiece vocabulary: those that start a word carry its mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return frozenset(n[1:] for n in names if n[0] == "▁" and len(n) > 1), frozenset(n for n in names if n[0] != "▁")


def count_pieces(docs: DataFrame, first: frozenset[str], later: frozenset[str]) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown (words that count as one piece because no pieces make them up).

    Words are runs of anything but ASCII white space. Null, empty and blank texts have zeros. Rows
    stay as they are; other columns aren't read. An empty table gives an empty result. A worker
    remembers words up to a number of bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(first, later)
        held = sum(map(len, known)) + ENTRY * len(known)
        for batch in batches:
            words, totals = [], []
            for text in batch.column(1).to_pylist():
                # bytes.split knows ASCII white space only
                parts = text.encode("utf-8", "surrogatepass").split() if text else []
                new = set(parts).difference(known)
                more = sum(map(len, new)) + ENTRY * len(new)
                if new and held + more > REMEMBERED:
                    known.clear()
                    new = set(parts)
                    held, more = 0, sum(map(len, new)) + ENTRY * len(new)
                held += more
                for p in new:
                    known[p] = machine.count(p.decode("utf-8", "surrogatepass"))
                words.append(len(parts))
                totals.append(sum(map(known.__getitem__, parts)))
                if held > REMEMBERED:  # one text with more new words than are remembered
                    known.clear()
                    held = 0
            total = np.array(totals, object)
            pieces = [t % UNKNOWN for t in total]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64()), pa.array([t // UNKNOWN for t in total], pa.int64())], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")


def op5_longest_match_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), *piece_sets(vocabulary_path or vocabulary("piece_bpe_32k.model")))
