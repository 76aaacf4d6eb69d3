"""Token counts under a unigram model, with pre-tokens that share prefixes scored together.

The model gives every token of a published vocabulary a cost that grows with the logarithm of its rank (no model is trained), and a pre-token is cut into the
tokens of least total cost; of equal costs, into the fewest. Each worker puts the distinct pre-tokens it meets into a trie. A node stands for one prefix and
holds its forward score: the least cost of cutting it and the number of tokens. A new pre-token follows the nodes it shares with earlier ones, so a prefix is
scored once; the count at its last node is stored. Tries have a bounded size and start afresh beyond it.

Defined cases: a null or empty text has no tokens; a byte that no token covers counts as one token of the highest cost; repeated rows and null ids stay; texts of any length are
counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tastemill.llm.bpe import VOCABULARY, read_ranks
from tastemill.llm.common import sliced
from tastemill.plans.skew import spread

SLICE = 4 << 20
#: Nodes of a worker's trie, and pre-tokens whose count it keeps; the far end of a pre-token longer than ``DEEPEST`` is scored, but not kept.
NODES, KEPT, DEEPEST = 500_000, 500_000, 256
#: Costs are whole numbers, so that sums and ties come out alike everywhere.
SCALE = 1_000_000
TOKEN = 1 << 32


def cost_of(rank: int) -> int:
    return round(SCALE * math.log(rank + 2))


class Costs(dict):
    """The cost of each token, one unit of ``TOKEN`` per cost step and one for the token itself, so that sums order by cost, then by number of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__((token, cost_of(rank) * TOKEN + 1) for token, rank in ranks.items())
        self.longest, self.unknown = max(map(len, ranks)), cost_of(max(ranks.values()) + 1) * TOKEN + 1


class PrefixCounts(dict):
    """Token counts of pre-tokens; a missing one is inserted in the trie. A node is a dict from byte to node, with its forward score under -1."""

    def __init__(self, costs: Costs, nodes: int = NODES, kept: int = KEPT):
        self.costs, self.most, self.kept = costs, nodes, kept
        self.root, self.nodes = {-1: 0}, 1

    def __missing__(self, word: str) -> int:
        if self.nodes >= self.most:
            self.root, self.nodes = {-1: 0}, 1
        data, node, path = word.encode(), self.root, [0]
        cost, longest, unknown = self.costs.get, self.costs.longest, self.costs.unknown
        for end, byte in enumerate(data, 1):
            below = node.get(byte)
            if below is None:
                best = path[-1] + unknown
                for start in range(max(0, end - longest), end):
                    token = cost(data[start:end])
                    if token is not None and path[start] + token < best:
                        best = path[start] + token
                below = {-1: best}
                if end <= DEEPEST:
                    node[byte] = below
                    self.nodes += 1
            path.append(below[-1])
            node = below
        count = path[-1] % TOKEN
        if len(word) <= 64:
            if len(self) >= self.kept:
                self.clear()
            self[word] = count
        return count


@lru_cache(2)
def prefix_counts(data: bytes) -> PrefixCounts:
    """Shared by the tasks that a Python worker runs one after the other."""
    return PrefixCounts(Costs(read_ranks(data)))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counts, split = prefix_counts(sent.value), regex.compile(pattern)
        for batch in sliced(batches, "text", SLICE):
            words = [split.findall(text or "") for text in batch.column("text").to_pylist()]
            tokens = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {id_type}, n_pretokens bigint, n_tokens bigint")
