"""Different words that a polynomial hash takes for one: tokens, passages and shingles tell them apart."""

from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa

from echograin.llm import minhash, packing, piece_bpe, substring_dedup, textcols

ONE = "".join("ab"[k.bit_count() % 2] for k in range(1024))
OTHER = ONE.translate({97: 98, 98: 97})
DOCS = "doc_id long, text string"


def test_the_pair_collides_with_powers_only():
    data = np.frombuffer((ONE + " " + OTHER).encode(), np.uint8)
    starts, ends = np.array([0, 1025]), np.array([1024, 2049])
    values = textcols.byte_table(b" ")[1]
    assert len(set(textcols.hash_spans(data, starts, ends, values).tolist())) == 1
    for keys in (textcols.FIRST, textcols.SECOND):
        assert len(set(textcols.hash_spans(data, starts, ends, values, keys).tolist())) == 2


def test_distinct_spans_compares_bytes(monkeypatch):
    words = [b"ab", b"cd", b"ab", b"AB", b"e", b"cd"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    values = textcols.byte_table(b"")[1]

    def told(**more):
        at, back = textcols.distinct_spans(data, starts, ends, values, **more)
        return [words[at[k]] for k in back]

    assert told() == words
    monkeypatch.setattr(textcols, "hash_spans", lambda *a: np.zeros(len(starts), np.uint64))
    assert told() == words
    assert told(fold=bytes(range(256)).lower()) == [b"ab", b"cd", b"ab", b"ab", b"e", b"cd"]


def test_ids_are_the_libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    texts = [ONE, OTHER, f"x {ONE} y", f"x {OTHER} y"]
    file = public_tokenizers.path("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<i4").tolist() for x in packing.WordTokenizer(file).column(pa.array(texts))] == want
    file = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=file)
    got = list(piece_bpe.encoded_column(piece_bpe.piece_model(file), pa.array(texts)))
    assert [g[1] for g in got] == [" ".join(map(str, [*sp.encode(t), sp.eos_id()])) for t in texts]
    assert [g[2] for g in got] == texts


def test_passages_and_shingles_of_other_words(spark):
    words = [f"w{k}" for k in range(19)]
    docs = spark.createDataFrame([(1, " ".join([*words, ONE])), (2, " ".join([*words, OTHER])), (3, " ".join([*words, ONE]))], DOCS)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, digests=True).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 20]
    assert got[2]["kept_sha256"] == sha256(" ".join([*words, OTHER]).encode()).hexdigest()
    few = spark.createDataFrame([(1, f"p q r s {ONE}"), (2, f"p q r s {OTHER}")], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(few).collect()} == {1: 1, 2: 2}


def test_crowded_buckets_are_counted_over_all_batches(spark):
    """40 members of one bucket, each in a batch of its own, and texts that share nothing with it."""
    base = [f"c{k}" for k in range(60)]
    texts = [" ".join([*base, f"own{k}"]) for k in range(40)] + [" ".join(f"o{k}x{j}" for j in range(30)) for k in range(10)]
    sets = list(minhash.shingle_sets(pa.array(texts)))
    low = [x.astype("<u4").tobytes() for x in minhash.minima(sets)]
    leaders = spark.createDataFrame([(bytearray(x),) for x in low], "minima binary").repartition(50)
    keys = minhash.band_keys(np.frombuffer(b"".join(low), "<u4").reshape(-1, minhash.HASHES)).view(np.int64).ravel()
    found, n = np.unique(keys, return_counts=True)
    got = {r["key"]: r["n"] for r in minhash.crowded_buckets(leaders, 16).collect()}
    assert got and got == dict(zip(found[n > 16].tolist(), n[n > 16].tolist(), strict=True))
