"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenizers cover the bytes of space+text. Offsets at which a token of each ends cut the text into groups; inside a group the two sides
disagree everywhere. A token of one side is linked with every token of the other that it shares bytes with.

1. One pass tokenises and aligns. Most groups hold one token a side, in long stretches along which the index of B's token is that of A's plus a
   constant shift. At the current shift the end arrays are compared in pieces of doubling width; the first piece that differs is halved
   down to the end of the stretch. What follows is an irregular group, resolved token by token, after which the shift is another one.
   Each document keeps its counts, the digest of its groups, and its different linked id pairs with how often it holds them.
2. In how many documents a pair is linked is counted over the whole corpus, with partial sums before the shuffle, and for each id of A the highest count.
3. The counts go back to the documents. Of the pairs, those of the ``HEAD`` most frequent go to every task (a table of bounded size, which spares the
   shuffle most of the rows); the others, each in few documents, are joined by pair. Sums per document are formed before they are shuffled.

Defined cases: null and empty texts, and texts whose tokens do not spell space+text (a normaliser changed them), have no tokens: zeros and an empty
digest. A null id is an id like any other; rows that repeat are documents of their own and count as such; an empty table gives an empty result;
further columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tastemill.llm.common import free_names, sliced
from tastemill.plans.skew import spread
from tastemill.session import checkpointed

SLICE = 2 << 20
#: At most so many pairs are sent to every task.
HEAD = 1 << 16
#: Bits of a pair of ids, and for how often a document holds it.
PAIR, TIMES = 32, 31


def byte_level() -> dict[str, int]:
    """The byte behind every character of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


@lru_cache(maxsize=2)
def first_tokenizer(stored: bytes):
    """(ids of a text behind a space, bytes of every id) of a byte-level vocabulary, given as the bytes of its file.

    Where the merges stand in the order of the ids that they make, and the file adds nothing to the usual pattern of byte-level BPE, the ids are ranks,
    and tiktoken gives the same ids in a quarter of the time. Any other file is left to the library that wrote it.
    """
    described = json.loads(stored)
    model, byte = described["model"], byte_level()
    spelled = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in described["added_tokens"])]))
    for token, i in [*((t["content"], t["id"]) for t in described["added_tokens"]), *model["vocab"].items()]:
        spelled[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m)) for m in merges]
    steps = described["pre_tokenizer"] or {}
    plain = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True) and not described["normalizer"]
    extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if plain and made == list(range(256, 256 + len(merges))) and not any(model.get(name) for name in extras):
        ranks = {spelled[i]: i for i in range(256 + len(merges))}
        tokenizer = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: tokenizer.encode_ordinary(f" {text}"), spelled
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    whole = Tokenizer.from_buffer(stored)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(f" {text}", add_special_tokens=False).ids, spelled


@lru_cache(maxsize=2)
def second_tokenizer(stored: bytes):
    """(ids of many texts, bytes of every id) of a piece vocabulary, which adds the space itself."""
    model = SentencePieceProcessor(model_proto=stored)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
    return lambda texts: model.encode(texts, num_threads=1), spelled


def meet(a: list[int], b: list[int], ids: list[str], pieces: list[str]) -> tuple[list[str], list[int], list[int], list[int]]:
    """Align two rising lists of ends with the same last entry, and the names of the tokens that end there.

    Returns ``a1,a2|b1`` of every group, the stretches of one-to-one groups (index in a, index in b and length of each, one behind the other), and the
    indexes of the tokens of every link of the other groups.
    """
    groups, runs, left, right = [], [], [], []
    i, j, n = 0, 0, len(a)
    while i < n:
        run, width = 0, 1
        while i + run < n and a[i + run : i + run + width] == b[j + run : j + run + width]:
            run += width
            width *= 2
        if i + run < n:
            while width > 1:
                width //= 2
                if a[i + run : i + run + width] == b[j + run : j + run + width]:
                    run += width
        else:
            run = n - i
        if run:
            runs += (i, j, run)
            groups.extend(map("|".join, zip(ids[i : i + run], pieces[j : j + run], strict=True)))
            i, j = i + run, j + run
            if i == n:
                break
        p, q = i, j
        x, y = a[p], b[q]
        while True:
            left.append(p)
            right.append(q)
            if x < y:
                p += 1
                x = a[p]
            elif y < x:
                q += 1
                y = b[q]
            else:
                break
        groups.append(f"{','.join(ids[i : p + 1])}|{','.join(pieces[j : q + 1])}")
        i, j = p + 1, q + 1
    return groups, runs, left, right


def linked(runs: list[int], left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of all links, in no order."""
    first, other, length = np.array(runs, np.int64).reshape(-1, 3).T
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.concatenate([np.repeat(first, length) + within, np.array(left, np.int64)]), np.concatenate([np.repeat(other, length) + within, np.array(right, np.int64)])


def aligned(docs: DataFrame, files: Broadcast, names: tuple[str, ...]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the packed links of every document, with a key of its own; a stored table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        (encode_a, bytes_a), (encode_b, bytes_b) = first_tokenizer(files.value[0]), second_tokenizer(files.value[1])
        size_a, size_b = list(map(len, bytes_a)), list(map(len, bytes_b))
        name = list(map(str, range(max(len(bytes_a), len(bytes_b)))))
        for batch in sliced(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, digests, held = np.zeros((4, len(texts)), np.int64), [], []
            for k, (text, pieces) in enumerate(zip(texts, encode_b(texts), strict=True)):
                ids, whole = encode_a(text) if text else [], f" {text}".encode()
                if not text or b"".join(map(bytes_a.__getitem__, ids)) != whole or b"".join(map(bytes_b.__getitem__, pieces)) != whole:
                    digests.append("")
                    continue
                a, b = list(accumulate(map(size_a.__getitem__, ids))), list(accumulate(map(size_b.__getitem__, pieces)))
                groups, *parts = meet(a, b, list(map(name.__getitem__, ids)), list(map(name.__getitem__, pieces)))
                left, right = linked(*parts)
                counts[:, k] = len(ids), len(pieces), len(groups), len(left)
                digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest())
                held.append((k << PAIR) | (np.array(ids, np.int64)[left] * len(bytes_b) + np.array(pieces, np.int64)[right]))
            held = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
            start = np.flatnonzero(np.diff(held, prepend=-1))
            packed = ((held[start] & ((1 << PAIR) - 1)) << TIMES) | np.diff(start, append=len(held))
            ends = np.searchsorted(held[start] >> PAIR, np.arange(len(texts) + 1)).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(ends), pa.array(packed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), links], list(names[:-1]))

    fields = ", ".join([f"{names[0]} {kind}", *(f"{n} bigint" for n in names[1:5]), f"{names[5]} string", f"{names[6]} array<bigint>"])
    found = spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, fields)
    return checkpointed(found.withColumn(names[7], F.monotonically_increasing_id()))


def rated_pairs(links: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, top): in how many documents each pair is linked, and whether its id of A has no pair with a higher count; a stored table."""
    counts = checkpointed(links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy(F.expr(f"pair div {pieces}").alias("id")).agg(F.max("n").alias("most"))
    return checkpointed(counts.join(most, F.expr(f"pair div {pieces}") == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("top")))


def head_floor(rated: DataFrame, room: int) -> int:
    """The lowest power of two such that at most ``room`` pairs have counts from there on. Reads one row per power."""
    floor, held = 1 << 62, 0
    for power, many in sorted(rated.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count(F.lit(1))).collect(), reverse=True):
        held += many
        if held > room:
            break
        floor = 1 << power
    return floor


def align(docs: DataFrame, first: str, second: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document; ``first`` and ``second`` are the paths of the vocabularies
    on the driver, whose contents are sent to the tasks (their size does not depend on the data)."""
    files = [Path(path).read_bytes() for path in (first, second)]
    bytes_a, bytes_b = first_tokenizer(files[0])[1], second_tokenizer(files[1])[1]
    if len(bytes_a) * len(bytes_b) > 1 << PAIR:
        raise ValueError("the two vocabularies have too many pairs of ids for one 64-bit number with a count")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *free_names(docs.select("doc_id"), "links", "key"))
    found = aligned(docs, docs.sparkSession.sparkContext.broadcast(files), names)
    links = found.select("key", F.explode("links").alias("v")).select("key", F.expr(f"v >> {TIMES}").alias("pair"), F.expr(f"v & {(1 << TIMES) - 1}L").alias("times"))
    rated = rated_pairs(links, len(bytes_b))
    floor = head_floor(rated, head)
    often, seldom = rated.where(F.col("n") >= floor), rated.where(F.col("n") < floor)
    sums = [F.sum(F.col("times") * F.col("top")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = links.join(F.broadcast(often), "pair").groupBy("key").agg(*sums)
    rest = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair").groupBy("key").agg(*sums)
    totals = parts.unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("links").join(totals, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
