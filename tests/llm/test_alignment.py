"""The alignment of two tokenizers against a plain version over whole texts."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from echograin.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, row long, links string, pair int"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain(text, libraries):
    """(ids of a, ids of b, links as index pairs, groups) over the whole text, by bytes."""
    a, b = libraries
    if not text:
        return [], [], [], []
    tool = al.aligner(A, B)
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    bytes_a = [tool.a_bytes[i] for i in ids_a]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    owner_a = [k for k, x in enumerate(bytes_a) for _ in x]
    owner_b = [k for k, x in enumerate(bytes_b) for _ in x]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    groups, first_a, first_b = [], 0, 0
    for k in range(len(whole)):
        if k + 1 == len(whole) or owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]:
            groups.append((ids_a[first_a : owner_a[k] + 1], ids_b[first_b : owner_b[k] + 1]))
            first_a, first_b = owner_a[k] + 1, owner_b[k] + 1
    return ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in links], groups


def wanted(texts, libraries):
    found = [(i, *plain(t, libraries)) for i, t in texts]
    counts = Counter(p for _, _, _, links, _ in found for p in set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, ids_a, ids_b, links, groups in found:
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((-1 if i is None else i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha256(named.encode()).hexdigest() if named else ""))
    return sorted(out)


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def noise(rng, n):
    return "".join(rng.choice("aabcdeth eri  \n\tABéèñ日🤗'\"01.,!?;-\x00\x1c 　") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = ["alpha", "Beta", "it's", "don't", "naïve", "日本", "x.", "(the", "of,", "1,234", "you'll", "été"] + [f"word{k}" for k in range(80)]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ".\n", ", "]) for _ in range(n))
    out = [(k, prose(rng.randrange(1, 150))) for k in range(30)] + [(100 + k, noise(rng, rng.randrange(1, 80))) for k in range(60)]
    out += [(200, None), (201, ""), (202, " "), (203, "  \n "), (204, "one"), (205, "one"), (206, "a▁b"), (207, "<|endoftext|> </s> <s> <unk> <0x41>"), (208, "x" * 3000), (209, prose(5000)), (210, "word " * 400), (None, out[0][1]), (0, out[1][1])]
    return out


@pytest.mark.parametrize("frequent", [al.FREQUENT, 50])
def test_alignment(spark, texts, libraries, frequent):
    df = spark.createDataFrame([(i, t, "en", 1, "l", 2) for i, t in texts], DOCS).repartition(5)
    assert got(al.align(df, A, B, frequent=frequent)) == wanted(texts, libraries)
    assert al.align(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_query_on_the_tables(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got(al.op12_alignment(spark, "/root/testdata/sf0.001")) == wanted([(r["doc_id"], r["text"]) for r in docs], libraries)


def test_noise_segment_by_segment(libraries):
    rng, tool = random.Random(7), al.aligner(A, B)
    import pyarrow as pa

    data = [noise(rng, rng.randrange(0, 60)) for _ in range(1500)] + ["the last one", "", ""]
    for t, x in zip(data, tool.column(pa.array(data)), strict=True):
        ids_a, ids_b, links, groups = plain(t, libraries)
        assert (x is None) == (not ids_a)
        if x:
            assert (x.n_a, x.n_b, x.n_groups) == (len(ids_a), len(ids_b), len(groups))
            assert [(p >> 16, p & 0xFFFF) for p in x.links.tolist()] == [tuple(p) for p in links] or sorted((p >> 16, p & 0xFFFF) for p in x.links.tolist()) == sorted(links)


def test_intervals_and_products():
    a, b, closes = al.elementary_intervals(np.array([2, 5, 6, 9]), np.array([1, 5, 7, 9]))
    assert a.tolist() == [0, 0, 1, 2, 3, 3] and b.tolist() == [0, 1, 1, 2, 2, 3] and closes.tolist() == [False, False, True, False, False, True]
    group, x, y = al.group_products(a, b, closes)
    assert list(zip(group.tolist(), x.tolist(), y.tolist(), strict=True)) == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 2, 2), (1, 2, 3), (1, 3, 2), (1, 3, 3)]


def test_group_pairs(spark, texts, libraries):
    some = texts[:12] + texts[90:96]
    df = spark.createDataFrame([(i, t, "en", 1, "l", 2) for i, t in some], DOCS)
    want = Counter((i, g, x, y) for i, t in some for g, (xs, ys) in enumerate(plain(t, libraries)[3]) for x in xs for y in ys)
    assert Counter((r["doc_id"], r["group"], r["a"], r["b"]) for r in al.group_pairs(df, A, B).collect()) == want
