"""Token alignment, SimHash components and whitened vectors against plain counterparts, and on the odd cases each of them defines."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tastemill.llm import simhash, token_alignment, whitening

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, links string, KEY int, f string, node int, `odd.name` int"
LONG = " ".join(f"w{i % 977}x{i // 7}" for i in range(20_000))


def odd_rows():
    text = " ".join(f"word{i}" for i in range(60))
    texts = [text, text, None, "", " \t\n ", LONG, "Ein Ärger, ñandú 漢字 🙂", text + " tail", "A", "a b", " lead", "tab\tand\r\nlines\n\n", "<|endoftext|> <s> <0x0A> ▁ é ﬁ", "x" * 3000]
    ids = [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, 11, 12, 13]
    return [(i, t, "l", 1, "f", 2, 3) for i, t in zip(ids, texts, strict=True)] + [(None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -------------------------------------------------------------------------------------------------------- token alignment


def plain_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by comparing every pair of tokens of a group."""
    tokenizer, model = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    tokenizer.encode_special_tokens = True
    byte = token_alignment.byte_level()
    name = {i: t for t, i in tokenizer.get_vocab().items()}

    def piece_bytes(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if regex.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def spans(ids, spell):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(spell(i)), i))
            at = out[-1][1]
        return out

    found, seen = [], Counter()
    for text in texts:
        text = text or ""
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        spell = lambda i: bytes(byte[c] for c in name[i])
        if not text or {b"".join(map(spell, a)), b"".join(map(piece_bytes, b))} != {(" " + text).encode()}:
            found.append(([], (0, 0, 0), ""))
            continue
        left, right = spans(a, spell), spans(b, piece_bytes)
        cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
        groups, links, low = [], [], 0
        for cut in cuts:
            x, y = ([t for t in side if low <= t[0] and t[1] <= cut] for side in (left, right))
            groups.append(",".join(str(t[2]) for t in x) + "|" + ",".join(str(t[2]) for t in y))
            links += [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
            low = cut
        found.append((links, (len(a), len(b), len(cuts)), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        seen.update(set(links))
    best = {}
    for (i, _), n in seen.items():
        best[i] = max(n, best.get(i, 0))
    return [(*counts, len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), digest) for links, counts, digest in found]


def aligned_rows(df, **options):
    got = token_alignment.align(df, FIRST, SECOND, **options).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def test_stretches_and_links_match_plain_cuts():
    random.seed(3)
    for _ in range(400):
        total = random.randint(1, 60)
        shared = {x for x in range(1, total) if random.random() < random.choice([0.1, 0.9])}
        a, b = (sorted({*shared, total, *(x for x in range(1, total) if random.random() < 0.15)}) for _ in range(2))
        groups, runs, *rest = token_alignment.meet(a, b, [f"a{e}" for e in a], [f"b{e}" for e in b])
        left, right = token_alignment.linked(runs, *rest)
        shared = sorted(set(a) & set(b))
        within = lambda ends, mark: [",".join(f"{mark}{e}" for e in ends if low < e <= high) for low, high in zip([0, *shared], shared, strict=False)]
        assert groups == list(map("|".join, zip(within(a, "a"), within(b, "b"), strict=True)))
        starts = lambda ends: [0, *ends[:-1]]
        want = [(i, j) for i, (s, e) in enumerate(zip(starts(a), a, strict=True)) for j, (t, f) in enumerate(zip(starts(b), b, strict=True)) if s < f and t < e]
        assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == want


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_alignment_matches_brute_force(spark, head):
    random.seed(11)
    words = ["the", "unbelievable", "Größe", "naïve", "12345", "foo_bar", "漢字", "internationalization", "🙂", "don't", "x=y;", "...", "über", "\n", "  "]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 25))) for _ in range(60)] + [r[1] for r in odd_rows() if not r[1] or len(r[1]) < 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = sorted(((i, *row) for i, row in enumerate(plain_alignment(texts))), key=str)
    assert aligned_rows(docs, head=head) == want
    assert any(0 < row[5] < row[4] for row in want)


def test_both_ways_to_the_first_tokens_agree():
    """The quick way, taken for a file whose ids are ranks, against the library of the file, over all characters and their neighbours."""
    with open(FIRST, "rb") as f:
        stored = f.read()
    quick, whole = token_alignment.first_tokenizer(stored)[0], Tokenizer.from_buffer(stored)
    whole.encode_special_tokens = True
    shown = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    differ = []
    for start in range(0, len(shown), 256):
        text = "".join(f"a{c} {c}b1{c}{c}  {c}\n" for c in shown[start : start + 256])
        if quick(text) != whole.encode(" " + text, add_special_tokens=False).ids:
            differ.append(start)
    assert not differ


def test_alignment_of_odd_rows(spark, odd, none):
    got = aligned_rows(odd)
    assert len(got) == len(odd_rows()) and token_alignment.align(none, FIRST, SECOND).count() == 0
    for i in (2, 3):
        assert (i, 0, 0, 0, 0, 0, 0, "") in got
    assert [r[4] == r[1] + r[2] - r[3] for r in got] == [True] * len(got)
    assert max(r[1] for r in got if r[0] == 5) > 20_000
    with pytest.raises(FileNotFoundError):
        token_alignment.align(none, "/nowhere", SECOND)


# ---------------------------------------------------------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(zip(ids, prints, strict=True))), key=str)


def test_simhash_matches_brute_force(spark, odd, none):
    random.seed(21)
    docs = []
    for base in range(8):
        words = [f"v{random.randint(0, 300)}" for _ in range(120)]
        for _ in range(25):
            copy = list(words)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = f"N{random.randint(0, 30)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(r[0] if r[0] is None else 1000 + r[0], r[1]) for r in odd_rows()]
    want = plain_components([plain_fingerprint(t) for _, t in docs], [i for i, _ in docs])
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    for tile in (simhash.TILE, 3):
        assert sorted(map(tuple, simhash.classify(df, tile).collect()), key=str) == want
    assert sum(r[0] != r[2] for r in want) > 50
    assert sorted(map(tuple, simhash.classify(odd).collect()), key=str) == plain_components([plain_fingerprint(r[1]) for r in odd_rows()], [r[0] for r in odd_rows()])
    assert simhash.classify(none).count() == 0


@pytest.mark.parametrize("tile", [2, 16, simhash.TILE])
def test_tiles_lose_no_link(spark, tile):
    """Fingerprints around few centres, so that buckets are crowded and chains long."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for _ in range(300):
        f = int(rng.choice(centres))
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(bit)
        prints.add(f)
    prints = sorted(prints)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "f bigint"), tile).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)) for r in links)
    root = {s: s for s in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        root[find(r.a)] = find(r.b)
    want = plain_components(prints, list(range(len(prints))))
    groups = Counter(r[2] for r in want)
    assert sorted(Counter(find(s) for s in signed).values()) == sorted(groups.values())
    assert len(links) < len(prints) ** 2 / 4


# -------------------------------------------------------------------------------------------------------------- whitening


def check_whitened(rows, vectors):
    """Compare with numpy, up to the sign of every component."""
    x = np.floor(1024 * np.array([v for _, v in vectors], float)).astype(int) + 100000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, x.shape[1])
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    deviation = {}
    for (i, _), d in zip(vectors, ((n * x - total) ** 2).sum(axis=1), strict=True):
        deviation.setdefault(i, set()).add(int(d))
    assert all(int(r.deviation) in deviation[r.vec_id] for r in rows)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        got = sorted(r.whitened for r in rows if r.component == c + 1)
        assert np.allclose(got, sorted(want[:, c]), atol=1e-8) or np.allclose(got, sorted(-want[:, c]), atol=1e-8)
        assert {round(r.explained / (values[c] / values.sum()), 9) for r in rows if r.component == c + 1} == {1.0}
    assert max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize("dimensions", [3, 12])
def test_whitening_matches_numpy(spark, monkeypatch, dimensions):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(dimensions)
    data = rng.normal(0, 1, (150, dimensions)) * np.arange(1, dimensions + 1) + 3
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(data.astype(np.float32))] + [(7, [float(c) for c in data[7].astype(np.float32)])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(5)
    check_whitened(whitening.whiten(df).collect(), vectors)


def test_whitening_of_odd_rows(spark):
    schema = "vec_id bigint, embedding array<double>, i int, AT string, x string, w int, component string"
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in rng.normal(0, 1, 4)]) for i in range(40)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0]), (93, [1.0, float("nan"), 0.0, 0.0]), (94, [float("inf"), 0.0, 0.0, 0.0]), (95, [1.0]), (None, None)]
    rows = [(*r, 1, "a", "b", 2, "c") for r in [*good, *bad]]
    check_whitened(whitening.whiten(spark.createDataFrame(rows, schema)).collect(), good)
    for nothing in ([], [(1, None, 1, "a", "b", 2, "c")]):
        empty = whitening.whiten(spark.createDataFrame(nothing, schema))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in flat] == [(None, None, None, 0)] * 4
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id bigint, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
