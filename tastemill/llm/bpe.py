"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the merges end in exactly one encoding, so one number describes it: its last token. Token ``t`` ending at place i is that
token when it fits behind the last token of the prefix before it, that is when no merge across their border would come first. The encoding is read off
backwards. Appending bytes only adds entries; after an edit, entries are computed anew from the edit on until they agree with the old ones for
the length of the longest token.

Two tokens fit when no pair of parts that stand at their border at the same time would be merged before one of them goes into its own next merge. The
parts are the right edge of the left token's merge tree and the left edge of the right token's.

The vocabulary file is read by the driver and sent as it is (its size does not depend on the data). A worker keeps the encodings of
pre-tokens in a table of bounded size.

Defined cases: a null text is the empty text, with no tokens; repeated rows and null ids stay; texts of any length are encoded whole; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tastemill.llm.common import sliced
from tastemill.plans.skew import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
SLICE = 4 << 20
#: Pre-tokens kept per worker, the longest that is kept, and token pairs kept.
KEPT, KEPT_LENGTH, KEPT_PAIRS = 400_000, 64, 1_000_000


class Merges:
    """The ranks of a vocabulary, and how its tokens meet."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.fitting: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that merges do not reach."""
        if token not in self.halves:
            pieces = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(pieces) > 2:
                best = min(((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))), default=(token, 0))
                if best[0] >= token:
                    break
                pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
            self.halves[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self.halves[token]

    def reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts along one side (0 left, 1 right) of the merge tree, each with the token it is merged into (none: a number above all)."""
        key = (token, side)
        if key not in self.edges:
            found, into = [], 1 << 40
            while True:
                found.append((token, into))
                halves = self.parts(token)
                if halves is None:
                    break
                token, into = halves[side], token
            self.edges[key] = found
        return self.edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two stay apart when their bytes are encoded together. Known pairs are kept under ``left << 20 | right``."""
        known = self.reached(left) and self.reached(right) and self._apart(left, right)
        if len(self.fitting) >= KEPT_PAIRS:
            self.fitting.clear()
        self.fitting[left << 20 | right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        for a, a_into in self.edge(left, 1):
            for b, b_into in self.edge(right, 0):
                merged = self.ranks.get(self.tokens[a] + self.tokens[b])
                if merged is not None:
                    when = max(merged, a, b)
                    if when < a_into and when <= b_into:
                        return False
        return True


class Encoding:
    """A byte string and the last token of each of its prefixes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def _add(self, count: int) -> None:
        """The entries of the next prefixes: the longest token first, as it fits most often, though only one does."""
        data, last, longest = self.data, self.last, self.merges.longest
        rank, known, fits = self.merges.ranks.get, self.merges.fitting.get, self.merges.fits
        for end in range(len(last) + 1, len(last) + 1 + count):
            for start in range(max(0, end - longest), end):
                token = rank(data[start:end])
                if token is not None:
                    if start:
                        before = last[start - 1]
                        good = known(before << 20 | token)
                        if good is None:
                            good = fits(before, token)
                    else:
                        good = self.merges.reached(token)
                    if good:
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        self.data += data
        self._add(len(data))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from start to end. Returns how many entries were computed."""
        old, shift = self.last, end - start - len(new)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agreed = old[:start], 0
        while len(self.last) < len(self.data) and agreed < self.merges.longest:
            at = len(self.last)
            self._add(1)
            agreed = agreed + 1 if at >= start + len(new) and old[at + shift] == self.last[at] else 0
        computed = len(self.last) - start
        self.last += old[len(self.last) + shift :] if len(self.last) < len(self.data) else []
        return computed

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.merges.tokens[out[-1]])
        return out[::-1]


class PreTokens(dict):
    """Ids of pre-tokens, worked out when first asked for."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        whole = self.merges.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(Encoding(self.merges, data).ids())
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(2)
def merges_of(data: bytes) -> Merges:
    return Merges(read_ranks(data))


@lru_cache(2)
def pre_tokens(data: bytes) -> PreTokens:
    """Shared by the tasks that a Python worker runs one after the other."""
    return PreTokens(merges_of(data))


def encode(text: str, words: PreTokens, pattern) -> list[int]:
    return list(chain.from_iterable(map(words.__getitem__, pattern.findall(text))))


def decode(ids: list[int], merges: Merges) -> bytes:
    return b"".join(map(merges.tokens.__getitem__, ids))


def encoded(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, the ids of the text, and the bytes they decode to."""
    return _over(docs, vocabulary, pattern, "ids array<int>, decoded binary", lambda ids, back: (ids, back), ["ids", "decoded"])


def report(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    number = {i: str(i) for i in range(1 << 17)}

    def digest(ids: list[int], back: bytes):
        return len(ids), hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    return _over(docs, vocabulary, pattern, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _over(docs: DataFrame, vocabulary: str | None, pattern: str, columns: str, made, names: list[str]) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        merges, split = merges_of(sent.value), regex.compile(pattern)
        words = pre_tokens(sent.value)
        for batch in sliced(batches, "text", SLICE):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = encode(text or "", words, split)
                rows.append(made(ids, decode(ids, merges)))
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, kinds.get(n, pa.string())) for n, x in zip(names, zip(*rows, strict=True), strict=True))], ["doc_id", *names])

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, f"doc_id {id_type}, {columns}")
