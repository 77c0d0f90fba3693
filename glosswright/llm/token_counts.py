"""Unigram token counts, scored once for each prefix that words share.

Distinct words go into a trie.  A node holds the forward score of its prefix - the cheapest way to cut it
into vocabulary pieces - so words with a common beginning share that work, and the node at a word's end
holds its number of tokens.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

COUNT_BITS = 24


def piece_costs(path: str) -> tuple[dict[str, int], int]:
    """Costs of the pieces and of a byte of an unknown character, in millionths of a nat.

    The file ranks its pieces; the piece of rank r gets the Zipf probability 1 / ((r + 1) H).  The low bits
    of a cost count pieces: sums stay exact, and of equally likely cuts the one with fewer pieces wins.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
    rank, costs, byte = 0, {}, 0
    h = math.log(sum(1 / (r + 1) for r in range(n)))
    for i in range(n):
        if special[i]:
            continue
        cost = round(1e6 * (math.log(rank + 1) + h)) << COUNT_BITS | 1
        rank += 1
        if sp.is_byte(i):
            byte = max(byte, cost)
        else:
            costs[sp.id_to_piece(i)] = cost
    return costs, byte or round(1e6 * (math.log(n) + h)) << COUNT_BITS | 1


class ForwardTrie:
    #: Nodes after which a new trie is begun: what a task remembers is bounded, whatever it reads.
    MOST = 2_000_000

    def __init__(self, costs: dict[str, int], byte_cost: int):
        self.costs, self.byte_cost = costs, byte_cost
        self.longest = max(map(len, costs))
        self.clear()

    def clear(self):
        self.child: dict[tuple[int, str], int] = {}
        self.score = [0]
        self.terminal: dict[bytes, int] = {b"": 0}

    def __missing(self, word: bytes) -> int:
        text = "▁" + word.decode("utf-8", "replace")
        child, score, costs, longest = self.child, self.score, self.costs, self.longest
        node, path = 0, [0]
        for i, c in enumerate(text, 1):
            nxt = child.get((node, c))
            if nxt is None:
                best = path[-1] + self.byte_cost * len(c.encode())
                for j in range(max(0, i - longest), i):
                    cost = costs.get(text[j:i])
                    if cost is not None and path[j] + cost < best:
                        best = path[j] + cost
                nxt = child[node, c] = len(score)
                score.append(best)
            node = nxt
            path.append(score[node])
        out = self.terminal[word] = path[-1] & (1 << COUNT_BITS) - 1
        return out

    def counts(self, texts: list[bytes | None]):
        """(words, tokens) of each text; words are the runs between ASCII white space."""
        for text in texts:
            words = (text or b"").split()
            if len(self.score) > self.MOST:
                self.clear()
            known = self.terminal
            total = 0
            for w in words:
                n = known.get(w)
                total += self.__missing(w) if n is None else n
            yield len(words), total


@lru_cache(maxsize=2)
def trie(path: str) -> ForwardTrie:
    return ForwardTrie(*piece_costs(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row, in narrow tasks without a shuffle.

    Null and empty texts have no words and no tokens; identifiers, null or repeated, are carried as they are.
    """

    def run(batches):
        t = trie(vocabulary)
        for batch in batches:
            got = list(t.counts(batch.column("text").to_pylist()))
            yield pa.record_batch([batch.column("doc_id"), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
