"""The training-data operators against brute force, libraries and SQL, with odd rows in every table."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from echograin.llm import components, html_blocks, lattice, line_crf, line_quality, minhash, packing, piece_bpe, registry, substring_dedup, toxicity, url_filters
from echograin.llm.labelled import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, id long, class string, hits int, words string"


def rows(texts):
    """Texts as documents, with columns whose names operators use themselves."""
    return [(i, t, "en", "s", 1, "b", 7, "c", 3, "w") for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "x.", "naïve", "日本", "a\x1cb", "#1", "the", "of", "and", "Zed,"] + [f"w{i}" for i in range(300)]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))
    base, passage = prose(200), prose(60)
    out = [(i, prose(rng.randrange(1, 120))) for i in range(30)]
    out += [(40 + i, base) for i in range(5)]
    for i in range(6):
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((60 + i, " ".join(w)))
    out += [(70 + i, prose(30) + passage + prose(30)) for i in range(5)]
    out += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "one"), (85, "a b c d"), (86, "word " * 400), (87, prose(9000)), (88, "x" * 5000), (89, "A b C d e"), (90, "a B c D e"), (None, "no id here " * 12)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(t or "")


# 1


def base_counts(t):
    w = words(t)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_line_quality(docs, texts, empty):
    got = {r["doc_id"]: r for r in line_quality.line_frequency_rules(docs).collect()}
    for i, t in texts:
        r, want = got[i], base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert line_quality.line_frequency_rules(empty).count() == 0


def test_frequent_lines_deplete(spark):
    menu = "home news sport weather video radio more menu search sign in now please read all about it here today"
    own = lambda i: " ".join(f"own{i}word{k}" for k in range(40))
    data = [(i, f"{menu}\n{own(i)}") for i in range(30)] + [(100 + i, f"{menu}\n{menu.upper()}\nshort{i}") for i in range(10)] + [(200 + i, own(500)) for i in range(40)]
    got = {r["doc_id"]: r for r in line_quality.line_frequency_rules(spark.createDataFrame(rows(data), DOCS), max_share=0.2, min_docs=20, copies_once=True).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 19 for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(10))
    assert all(got[200 + i]["kept"] and not got[200 + i]["n_removed_words"] for i in range(40))  # copies count as one document


def test_documents_of_a_line_are_counted_by_id_and_host(spark):
    """A line in 11 documents of 220 isn't above 5 percent of them, one in 12 is; hosts are apart, null is one of them."""
    own = lambda i, n=60: " ".join(f"own{i}word{k}" for k in range(n))
    one, two = " ".join(f"one{k}" for k in range(30)), " ".join(f"two{k}" for k in range(30))
    lines = lambda i: [one] * (3 <= i < 14) + [two] * (i < 12) + [own(i, 10 if i < 3 else 60)]
    data = [(1000 * h + i, "\n".join(lines(i)), "en", "s" if h else None) for h in (0, 1) for i in range(220)]
    data += [(5000 + i, f"{two}\n{own(5000 + i)}", "en", "t") for i in range(10)] + [(1003, "\n".join(lines(3)), "en", "s")] * 5
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("host", F.lit("x")).withColumn("row", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("lines", F.lit("z"))
    got = [(r["doc_id"], r["n_removed_words"], r["kept"]) for r in line_quality.line_frequency_rules(df).collect()]
    assert len(got) == len(data)
    for i, removed, kept in got:
        k = i % 1000
        assert removed == (30 if i < 5000 and k < 12 else 0), i
        assert kept == (i >= 5000 or k >= 3), i


# 2


def test_piece_encoding_is_the_library(docs, texts, empty):
    from sentencepiece import SentencePieceProcessor

    file = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=file)
    digests = {r["doc_id"]: r for r in piece_bpe.encode_documents(docs, file, digests=True).collect()}
    plain = {r["doc_id"]: r for r in piece_bpe.encode_documents(docs, file).collect()}
    for i, t in texts:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        assert plain[i]["ids"] == ids and plain[i]["decoded"] == sp.decode(ids)
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_documents(empty, file).count() == 0


def test_piece_encoding_of_noise():
    from sentencepiece import SentencePieceProcessor

    file = public_tokenizers.path("piece_bpe_32k.model")
    sp, model, rng = SentencePieceProcessor(model_file=file), piece_bpe.piece_model(file), random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice("aabcdeth eri  \n\tABéèñ▁日🤗'\"01.,!?\x00\x1c") for _ in range(rng.randrange(1, 50)))
        ids = [*sp.encode(t), sp.eos_id()]
        assert model.encode(t) == ids and model.decode_ids(ids) == sp.decode(ids)


# 3


def removed(documents, window=20):
    first, gone = {}, defaultdict(set)
    for i, w in documents:
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                gone[i].update(range(k, k + window))
    return gone


def test_substring_dedup(docs, texts, empty):
    ordered = sorted(((-1 if i is None else i, words(t)) for i, t in texts))
    gone = removed(ordered)
    got = {-1 if r["doc_id"] is None else r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, digests=True).collect()}
    assert len(got) == len(texts)
    for i, w in ordered:
        kept = [x for k, x in enumerate(w) if k not in gone[i]]
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(w) - len(kept)), i
        assert got[i]["kept_sha256"] == sha256(" ".join(kept).encode()).hexdigest()
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_keeps_columns_and_small_buckets(docs, texts):
    out = substring_dedup.remove_repeats(docs, per_bucket=100)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    a = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert a == {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs, digests=True).collect()}
    untouched = {i: t for i, t in texts if not a[i]}
    assert all(r["text"] == untouched[r["doc_id"]] for r in out.collect() if r["doc_id"] in untouched)


def test_windows_of_equal_hash_are_told_apart_by_the_second():
    """Words are removed only if both hashes agree."""
    packed = lambda x, kind, rising=False: substring_dedup._packed(np.array(x, kind), rising)

    def window(doc, h, check):
        return (0, packed([doc], np.int64, True), np.array([0], "<i8").tobytes(), packed([h], np.uint64, True), packed([check], np.uint32), packed([0], np.uint16), packed([5], "<i4"), None, None)

    def later(*rows):
        out = substring_dedup._later(8)(pa.Table.from_batches([substring_dedup._batch(list(rows), substring_dedup._WINDOWS)]))
        return sorted(int(x) for ids in out["ids"].to_pylist() for x in substring_dedup._unpacked(ids, True))

    assert later(window(1, 77, 5), window(2, 77, 5), window(3, 77, 5)) == [2, 3]
    assert later(window(1, 77, 5), window(2, 77, 6), window(3, 78, 5), window(4, 77, 6)) == [4]


def test_probes_name_the_documents_of_their_bucket_alone():
    """With ever more buckets a unit's rows don't repeat all its documents in each."""
    texts_ = [" ".join(f"d{i}w{k}" for k in range(30)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([i * 977 % 400 * 10**12 for i in range(400)]), pa.array(texts_)], names=["id", "text"])
    size = [sum(len(x or b"") for out in substring_dedup._probe(10, n)(iter([batch])) for x in out.column("docs").to_pylist()) for n in (8, 800)]
    assert size[1] < 24 * 8400 and size[0] < size[1]  # an id for each of the 8,400 windows at most, not 400 ids in each of 800 rows


def test_substring_dedup_keeps_clashing_columns(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, t), (2, t), (3, None)], "doc_id long, text string")
    for c in ("n_words", "n_removed", "__id", "__content", "__hits", "__repeats", "__salt"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    out = substring_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "n_words_", "n_removed_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [(got[i]["n_words_"], got[i]["n_removed_"], got[i]["n_words"], got[i]["__id"]) for i in (1, 2, 3)] == [(40, 0, "own n_words", "own __id"), (40, 40, "own n_words", "own __id"), (0, 0, "own n_words", "own __id")]


def test_substring_dedup_of_repeated_rows(spark):
    t = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame(rows([(1, t), (1, t), (2, t), (2, "other " + t)]), DOCS)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(df, digests=True).collect()) == [(1, 0), (1, 0), (2, 50), (2, 50)]


# 4 and 7


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(1)
    clean = [f"c{i}" for i in range(400)] + ["the", "of", "and", "to"]
    line = lambda: " ".join(rng.choice(clean) for _ in range(9)) + "."
    data, labels = [], []
    for i in range(600):
        toxic, poor = i % 7 == 0, i % 5 == 0
        lines = [" ".join(f"{w}$$$ |" for w in line().split()) if poor else line() for _ in range(rng.randrange(2, 6))]
        if toxic:
            lines[0] += f" you {rng.choice(['stupid', 'idiot'])} thing"
        data.append((i, "\n".join(lines)))
        labels.append((i, int(not poor), int(toxic)))
    data += [(1000, None), (1001, ""), (1002, "\n\n"), (None, "a b"), (3, data[3][1])]
    labels += [(2000, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows(data), DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), data, labels


@pytest.mark.parametrize(("judge", "at"), [(line_crf.judge, 1), (toxicity.judge, 2)])
def test_classifiers_hold_out(spark, judged, empty, judge, at):
    docs, labels, data, marks = judged
    got = judge(docs, labels).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    truth = {m[0]: m[at] for m in marks if m[0] is not None}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert len(out) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    assert judge(empty, labels).count() == 0
    assert judge(docs, labels.limit(0)).count() == len(data)


def test_held_out_labels_and_other_columns_are_unseen(judged):
    docs, labels, _, _ = judged
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string"))
    for judge in (line_crf.judge, toxicity.judge):
        a = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in judge(docs, labels).collect())
        assert a == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in judge(other, flipped).collect())


def test_risk_and_its_slopes():
    """The risk is its formula, the step follows its numeric gradient, and turns back while the risk on negatives is below zero."""
    rng = np.random.default_rng(7)
    for shift in (0.0, -3.5):
        g, is_p, prior = np.append(rng.normal(1, 0.5, 20), rng.normal(shift, 0.3, 50)), np.arange(70) < 20, 0.4
        loss = lambda z: np.log1p(np.exp(-z))
        plus, minus = toxicity.nnpu_risk(g, is_p, prior)
        assert np.isclose(plus, prior * loss(g[:20]).mean()) and np.isclose(minus, loss(-g[20:]).mean() - prior * loss(-g[:20]).mean())
        assert (minus < 0) == (shift < 0)
        slopes = toxicity.nnpu_slopes(g, is_p, prior)
        for k in range(0, 70, 3):
            step = np.eye(70)[k] * 1e-6
            (p1, m1), (p0, m0) = toxicity.nnpu_risk(g + step, is_p, prior), toxicity.nnpu_risk(g - step, is_p, prior)
            want = (p1 + m1 - p0 - m0 if minus >= 0 else m0 - m1) / 2e-6
            assert np.isclose(slopes[k], want, atol=1e-6)


def test_long_chains_are_the_same_by_products(monkeypatch):
    rng = np.random.default_rng(2)
    scores, tie, rows_, share = rng.normal(0, 3, size=900), rng.normal(size=(2, 2)), np.array([0, 300, 301, 301, 899, 900]), rng.uniform(1, 2, 5)
    by_products = line_crf.marginals(scores, tie, rows_, share)
    monkeypatch.setattr(line_crf, "LONG_CHAIN", 10**9)
    by_lines = line_crf.marginals(scores, tie, rows_, share)
    assert np.allclose(by_products[0], by_lines[0]) and np.allclose(by_products[1], by_lines[1])


def test_line_weights_and_transitions_are_learnt():
    """Training lowers the negative log-likelihood, found by enumeration, and the transitions are part of it."""
    rng = np.random.default_rng(3)
    marks = np.array([1, 0] * 30)
    parts = []
    for y in marks:
        n = int(rng.integers(2, 6))
        parts.append((rng.normal(0.5 * y, 1, (n, len(line_crf._CLASSES) + 7)), np.ones(n), np.array([0, n])))

    def loss(model):
        out = 0.0
        for (f, _, r), y in zip(parts, marks, strict=True):
            scores = model.weights[line_crf.binned(f, model.edges, r)].sum(1)
            value = lambda labels, s=scores: sum(s[k] for k, b in enumerate(labels) if b) + sum(model.tie[a, b] for a, b in zip(labels, labels[1:], strict=False))
            every = [value(labels) for labels in np.ndindex(*[2] * len(f))]
            out += np.log(np.exp(every).sum()) - value([y] * len(f))
        return out / len(marks)

    start, end = (line_crf.fit_crf(parts, marks, steps=n) for n in (1, 80))
    assert loss(end) < loss(start)
    assert end.tie[0, 0] > end.tie[0, 1] and end.tie[1, 1] > end.tie[1, 0]
    without = line_crf.LineModel(end.edges, end.weights, np.zeros((2, 2)), end.curve)
    assert loss(end) < loss(without)


def test_a_text_of_very_many_lines(spark):
    docs = spark.createDataFrame(rows([(1, "a few words here.\n" * 30000), (2, "w " * 200000), (3, "x\n")]), DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    for judge in (line_crf.judge, toxicity.judge):
        assert all(0 <= r["score"] <= 1 for r in judge(docs, labels).collect())


@pytest.mark.parametrize("module", [line_crf, toxicity])
def test_one_row_of_a_sampled_id_is_learnt_from(spark, judged, module):
    """A doc_id that is repeated many times weighs as one document."""
    docs, labels, _, _ = judged
    often = docs.unionByName(docs.where("doc_id < 12").crossJoin(spark.range(30).select()).select(*docs.columns))
    one, two = (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in module.judge(d, labels).collect()) for d in (docs, often))
    assert dict(one) == dict(two)


def test_filters_keep_columns(judged):
    docs, labels, _, _ = judged
    for reject, judge in ((toxicity.reject_toxic, lambda: toxicity.judge(docs, labels).where("predicted = 0")), (line_crf.reject_poor, lambda: line_crf.judge(docs, labels).where("predicted = 1"))):
        out = reject(docs, labels)
        assert out.columns == docs.columns and out.count() == judge().count()


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    scores, tie, rows_ = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    good, _ = line_crf.marginals(scores, tie, rows_)
    for a, b in zip(rows_[:-1], rows_[1:], strict=True):
        n = b - a
        weight = {y: np.exp(sum(scores[a + k] * y[k] for k in range(n)) + sum(tie[y[k], y[k + 1]] for k in range(n - 1))) for y in np.ndindex(*[2] * n)}
        for k in range(n):
            assert np.isclose(good[a + k], sum(v for y, v in weight.items() if y[k]) / sum(weight.values()))


# 5


def test_main_text():
    html = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice">We use cookies of the best kind and all of you have to say that it is fine with you.</div><!-- <p>no</p> -->
    <article><h1>A &amp; B</h1><p>First   part<br>of\tit&nbsp;<b>all</b>.<p>Second<script>var x="</p>";</script> one</p><aside>See also</aside>
    <div class="comments"><p>I think that this is the best of all and it was not so bad.</p></div><form><input><p>Send</p></form></article><footer>&copy; me</footer></body>"""
    assert html_blocks.main_text(html) == "A & B\nFirst part of it all.\nSecond one"


def test_blocks_without_an_article():
    good = "The cat is on the mat and it was all that we had to do for the day, so we did it and then went on to the next of them. " * 2
    html = f"<body><div id=top><a href=a>One</a> <a href=b>Two</a></div><div><h2>On cats</h2><p>{good}</p><p>Short words here</p><p>{good}</p></div><div class=footer>{good}</div>"
    assert html_blocks.main_text(html).split("\n") == ["On cats", good.strip(), "Short words here", good.strip()]


@pytest.mark.parametrize("html", [None, "", "plain", "<", "<p", "<p>a<", "</p></div>", "<script>", "<!-- open", "<a href='x", "<p>&#x;&bogus;</p>", "<article></article>", "<div " * 50, "<p>" * 500 + "x"])
def test_odd_html_is_read(html):
    assert isinstance(html_blocks.main_text(html), str)


class PlainReader(HTMLParser):
    """The blocks of a page's <article>, read one event after the other."""

    def __init__(self):
        super().__init__()
        self.blocks, self.depth, self.skip = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "aside", "form")
        self.blocks += [""] if tag in ("article", "p", "h1", "h2", "ul", "li", "div") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "aside", "form")
        self.blocks += [""] if tag in ("article", "p", "h1", "h2", "ul", "li", "div") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.depth and not self.skip else ""


def plain_text(html):
    reader = PlainReader()
    reader.feed(html or "")
    reader.close()
    return "\n".join(filter(None, (" ".join(b.split()) for b in reader.blocks)))


@pytest.fixture(scope="module")
def table_pages():
    return duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()


def test_pages_of_the_tables(spark, table_pages):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html_blocks.extract_main_text(pages.unionByName(pages.limit(3))).collect()}
    for i, html in table_pages:
        assert got[i]["text"] == plain_text(html) and got[i]["n_chars"] == len(got[i]["text"])
    assert html_blocks.extract_main_text(pages.limit(0)).count() == 0


def unmarked(html):
    """A page without <article> and without telling class names."""
    return html.replace("<article>", "<div>").replace("</article>", "</div>").replace(' class="ad"', "")


def test_both_passes_decide(table_pages, monkeypatch):
    """On pages that mark nothing the two passes find the article; each of them changes results there, and the second on the pages as they are."""
    bare = [(unmarked(h), plain_text(h)) for _, h in table_pages]
    right = lambda: sum(html_blocks.main_text(h) == want for h, want in bare)
    both = right()
    assert both >= 0.6 * len(bare)
    for density, fewer in ((0.0, True), (1.0, False)):
        with monkeypatch.context() as m:
            m.setattr(html_blocks, "stop_density", lambda text, d=density: d)
            assert (right() < both) == fewer and right() != both
    for label in (html_blocks.GOOD, html_blocks.BAD):
        with monkeypatch.context() as m:
            m.setattr(html_blocks, "second_pass", lambda blocks, labels, marked, x=label: [x if y in (html_blocks.NEAR, html_blocks.UNDECIDED) else y for y in labels])
            assert right() < both
            assert any(html_blocks.main_text(h) != plain_text(h) for _, h in table_pages)


def test_very_long_html():
    good = "The cat is on the mat and it was all that we had to do for the day, so we did it and then went on to the next of them. " * 2
    html = "<body><nav>" + "<a href=x>Link</a>" * 20000 + "</nav><div>" + f"<p>{good}</p>" * 5000 + "</div></body>"
    assert html_blocks.main_text(html) == "\n".join([good.strip()] * 5000)


# 6


def test_packing(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    more = docs.unionByName(spark.createDataFrame(rows([(83, "one"), (300, "<|endoftext|> It's a<|startoftext|>b don't e\u0301 'S")]), DOCS))
    got = packing.pack_documents(more, file, capacity=256, with_ids=True, shard_items=20).toPandas()
    want = Counter()
    for i, t in [*texts, (83, "one"), (300, "<|endoftext|> It's a<|startoftext|>b don't e\u0301 'S")]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            want[(-1 if i is None else i, k // 256, k, tuple(ids[k : k + 256]))] += 1
    assert want == Counter((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, tuple(r.ids)) for r in got.itertuples())
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 256 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.pack_documents(empty, file).count() == 0


def triplets(n, capacity=1000, seed=0):
    """n threes of sizes that fill a bin to the last, so that n bins are enough."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers((capacity - a) // 2 - 60, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    return rng.permutation(out)


def test_genetic_search_saves_bins():
    """Crossover needs fewer bins than any first packing on sizes that best fit in decreasing order packs badly."""
    saved = 0
    for seed in range(4):
        sizes = triplets(20, seed=seed)
        p = packing.Population(sizes, 1000, seed, 12).sow()
        first = p.members[0][0][0]
        p.evolve(600)
        assert p.members[0][0][0] <= first and all(p.loads(m[1]).max() <= 1000 for m in p.members) and len(p.elite) == 60
        saved += first - p.members[0][0][0]
    assert saved > 0


def test_a_generation_is_bred_even_at_the_bound():
    p = packing.Population(np.array([50, 50, 40, 60, 30, 70]), 100, 1).sow()
    crossed = []
    p.cross = lambda a, b, f=p.cross: crossed.append(1) or f(a, b)
    p.evolve(5)
    assert p.done() and crossed == [1]


def test_islands_and_the_last_pass_over_shards(spark):
    """Elites migrate, and what shards leave in half-filled sequences is packed together."""
    sizes = [int(x) for x in np.random.default_rng(8).integers(1, 400, 3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    least = -(-sum(sizes) // 1000)
    by_shard = packing.pack_shards(items, 30, capacity=1000).select("sequence_id").distinct().count()
    got = packing.pack(items, 1000, 100).join(items, "row").toPandas()
    assert sorted(got.row) == list(range(3000)) and got.groupby("sequence_id").length.sum().max() <= 1000
    assert least <= got.sequence_id.nunique() < by_shard
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def test_guests_improve_an_island(spark):
    """After the migration every island is at least as good as the neighbour's elite was."""
    items = spark.createDataFrame(list(enumerate(int(x) for x in triplets(40, seed=3))), "row long, length long")
    one, two = ([r[0] for r in packing.pack_shards(items, 1, capacity=1000, islands=3, epochs=e, generations=2).select("sequence_id").distinct().collect()] for e in (1, 3))
    assert 40 <= len(two) <= len(one)


# 8


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in keys}


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash(docs, texts, empty):
    sets = {i: shingles(t) for i, t in texts if i is not None}
    want = brute_components(sets)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), i
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.drop_near_duplicates(docs)
    assert set(left.columns) == set(docs.columns) and {r["doc_id"] for r in left.collect()} == {i for i in want if want[i] == i} | {None}


def test_minhash_crowds(spark):
    """A crowd around one text, and a chain in which only neighbours are similar."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(300)]
    data += [(1000 + i, " ".join(chain[12 * i : 12 * i + 120])) for i in range(12)]
    sets = {i: shingles(t) for i, t in data}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows(data), DOCS)).collect()}
    assert got == brute_components(sets)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    got = dict(components.components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = int(len(both) * share)
        rest = len(both) - n
        sets = [np.unique(np.concatenate([both[:n], both[n : n + rest // 2]])), np.unique(np.concatenate([both[:n], both[n + rest // 2 :]]))]
        s = minhash.signatures(minhash.minima(sets))
        assert abs(minhash.estimates(s[0], s[1:])[0] - share) < 0.2


# 9


def test_urls(spark):
    urls = ["http://A.Example.com/en/1?x=/fr/", "https://www.example.com/en/2#a", "http://x.net/es/", "http://x.net", "net/es/", None, "http://nextnet/es/1", "http://a.b.net/fr/q", "://H/p", "a://b://c/d?", "http://com/", ""]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(2, urls[2], 1)], "page_id long, url string, host int")
    outcomes = spark.createDataFrame([("http://bad.org/1", 1)] * 60 + [("http://good.org/1", 0)] * 60 + [(None, 1), ("x", None)], "url string, bad int")
    pages = pages.unionByName(spark.createDataFrame([(90, "http://bad.org/9", 1), (91, "http://good.org/9", 1)], pages.schema))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, outcomes, url_filters.RULES).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3] == ("x.net", "", None, "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2] is None and got[7][2] == "net/fr/" and got[8] == ("h", "/p", None, "allow") and got[9][:2] == ("b:", "//c/d") and got[10][2] == "com/"
    assert got[90][3] == "block" and got[91][3] == "allow"
    assert url_filters.filter_urls(pages.limit(0), outcomes.limit(0), url_filters.RULES).count() == 0


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.github.io", "www.example.com", "com", "", "notco.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filters.domain_of(F.col("host")).alias("d"), url_filters.suffix_of(F.col("host")).alias("s"))
    got = {r["host"]: (r["d"], r["s"]) for r in df.collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.github.io": ("y.github.io", "github.io"), "www.example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "notco.uk": ("notco.uk", "uk")}
    # neighbours under one suffix aren't one domain
    outcomes = spark.createDataFrame([("http://bad.github.io/1", 1)] * 80 + [("http://fine.github.io/1", 0)] * 80, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://x.bad.github.io/"), (2, "http://x.fine.github.io/"), (3, "http://bad.github.io/1"), (4, "http://fine.github.io/1")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, outcomes, ()).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_repeated_labels_are_one_outcome(spark):
    pages = spark.createDataFrame([("http://h.org/7",), ("http://h.org/7",), ("http://h.org/8",), (None,)], "url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in url_filters.labelled_outcomes(pages, labels).collect()] == [("http://h.org/7", 1)] * 2


# 10


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).normal(0, 2, (50, 8))
    best, _ = lattice.nearest_e8(x)
    d = ((x - best / 2) ** 2).sum(1)
    assert (best.sum(1) % 4 == 0).all() and d.max() <= 1 + 1e-9  # in the lattice, within the covering radius
    assert all((((x - (best + r) / 2) ** 2).sum(1) >= d - 1e-9).all() for r in lattice.ROOTS)


def test_linked_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    data = [(i, (centres[i % 12] + rng.normal(0, 0.06, 64)).astype("float32").tolist(), i % 3) for i in range(240)]
    data += [(500 + i, data[0][1], 0) for i in range(30)] + [(600, None, 1), (601, [0.0] * 64, 1), (602, [float("nan")] * 64, 1), (603, [float("inf")] * 64, 1), (604, [None] * 64, 1), (605, data[0][1], None), (606, [1.0, 2.0], 0), (607, [2.0, 4.0], 0), (None, data[0][1], 0), (608, [], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("class", F.lit("x")).repartition(3)
    ok = [(i, np.array(e, float), k) for i, e, k in data if i is not None and k is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)]
    links = defaultdict(set)
    for i, e, k in ok:
        for j, f, m in ok:
            if i != j and k == m and len(e) == len(f) and e @ f / np.linalg.norm(e) / np.linalg.norm(f) >= 0.98:
                links[i].add(j)
    small = {r["vec_id"]: r for r in lattice.linked_vectors(df, limit=3).collect()}  # most cells are crowded
    got = {r["vec_id"]: r for r in lattice.linked_vectors(df).collect()}
    assert small == got
    assert len(got) == len(data)
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(links[i]) for i in got}
    for i, r in got.items():
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert r["component_id"] == (min(reach) if i is not None else None)
    assert lattice.linked_vectors(df.limit(0)).count() == 0


# registered queries


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, ref = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(ref.columns)
    at = [ref.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in ref.fetchall())


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.judge(docs, labels).where("predicted = 1").collect()}
    kept = {}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns
        stage = spark.createDataFrame(stage.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert set(kept["toxicity"]) == set(before) - toxic
    near = brute_components({i: shingles(t) for i, t in kept["quality classifier"].items()})
    assert set(kept["MinHash near-dedup"]) == {i for i, c in near.items() if i == c}
    ordered = sorted((i, words(t)) for i, t in kept["MinHash near-dedup"].items())
    gone = removed(ordered)
    want = {i: (" ".join(x for k, x in enumerate(w) if k not in gone[i]) if gone[i] else kept["MinHash near-dedup"][i]) for i, w in ordered if not w or len(gone[i]) < len(w)}
    assert kept["substring dedup"] == want
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(want) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_pipeline_stages_on_odd_documents(spark, texts):
    """Null, empty and repeated texts, rows without an id, and columns whose names the stages use themselves."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd = spark.createDataFrame(rows([*texts, (83, "one"), (83, "one"), (86, "word " * 400)]), DOCS)
    for c in ("n_words", "n_removed", "row", "salt", "component", "kept", "score", "mark", "part", "size", "__salt", "__id"):
        odd = odd.withColumn(c, F.lit(f"own {c}"))
    stage, names = odd, odd.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = spark.createDataFrame(f(spark, stage, SF).collect(), odd.schema)
        assert stage.columns == names and stage.where(" or ".join(f"`{c}` is null or `{c}` <> 'own {c}'" for c in names[-12:])).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and len(packed) >= odd.count()
    # each stage by itself on the odd rows: null and empty texts don't fail, and only repeats and copies go in the two dedup stages
    kept = {name: f(spark, odd, SF).count() for name, f in corpus_pipeline.STAGES[2:4]}
    assert kept["MinHash near-dedup"] < odd.count() and kept["substring dedup"] <= odd.count()


def test_pipeline_stages_on_no_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, SF).count() == 0, name


def crowded_texts(n, pairs, seed=1):
    """n texts at 0.72 to each other, of which the first 2 * pairs are pairs above 0.75."""
    rng = random.Random(seed)
    common = " ".join(f"c{k}" for k in range(200))
    word = lambda: f"o{rng.randrange(10**9)}"
    own = [[word() for _ in range(38)] for _ in range(n)]
    for k in range(pairs):
        own[2 * k + 1][:5] = own[2 * k][:5]
    return [(i, f"{common} {' '.join(o)}") for i, o in enumerate(own)]


def test_minhash_pairs_in_a_crowd_under_the_limit(spark):
    """Likely partners that are no links don't keep the true one from being tried."""
    data = crowded_texts(300, 12)
    want = brute_components({i: shingles(t) for i, t in data})
    assert want == {i: i - i % 2 if i < 24 else i for i in range(300)}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows(data), DOCS)).collect()}
    assert got == want


def linked_triples(n, seed=4):
    """n times texts h, x, y: x is a link of y, and closer to h than to y; y is no link of h."""
    rng = random.Random(seed)
    data = []
    for k in range(n):
        word = iter(f"t{k}w{i}" for i in range(10**6))
        h = [next(word) for _ in range(400)]
        x, y = list(h), list(h)
        for i in range(3, 60, 5):
            x[i] = next(word)
        for i in range(3, 370, 10):
            y[i] = x[i] if i < 60 else next(word)
        for i in range(8, 60, 10):
            y[i] = x[i]
        data += [(3 * k, h), (3 * k + 1, x), (3 * k + 2, y)]
    rng.shuffle(data)
    return [(i, " ".join(w)) for i, w in data]


@pytest.mark.parametrize("deal", [1, 17])
def test_minhash_of_triples_however_they_are_dealt(spark, deal):
    data = linked_triples(60)
    want = brute_components({i: shingles(t) for i, t in data})
    df = spark.createDataFrame(rows(data), DOCS).repartition(deal)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == want


def test_minhash_of_crowded_buckets_in_parts(spark):
    """Buckets cut into parts of 16, with pairs of two parts that are no link of any hub."""
    data = crowded_texts(150, 20, seed=6)
    want = brute_components({i: shingles(t) for i, t in data})
    df = spark.createDataFrame(rows(data), DOCS).repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, per_part=16).collect()} == want


def test_minhash_of_large_sets_in_parts(spark, monkeypatch):
    """Parts are cut by the size of the sets too."""
    monkeypatch.setattr(minhash, "PART_SHINGLES", 3000)
    data = crowded_texts(60, 8, seed=8)
    want = brute_components({i: shingles(t) for i, t in data})
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows(data), DOCS)).collect()} == want


def test_minhash_of_rows_that_share_an_id_and_of_a_tie(spark):
    w = [f"w{i}" for i in range(11)]  # 7 shingles
    tie = " ".join(w[:10])  # 6 of the 7: 85 percent
    exact = [f"v{i}" for i in range(104)]  # 100 shingles
    three = " ".join(exact[:79])  # 75 of the 100: a link at exactly 75 percent
    below = " ".join(exact[:78])  # 74 of the 100
    data = [(5, " ".join(w)), (9, tie), (9, "another text of the document nine"), (12, "another text of the document nine"), (20, " ".join(exact)), (21, three), (30, " ".join(exact).upper() + " more"), (5, " ".join(w))]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows(data), DOCS)).collect()}
    assert got == {(5, 7): 5, (9, 6): 5, (9, 2): 5, (12, 2): 5, (20, 100): 20, (21, 75): 20, (30, 101): 20}
    two = spark.createDataFrame(rows([(1, " ".join(exact)), (2, below)]), DOCS)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(two).collect()} == {1: 1, 2: 2}


def test_groups_go_on_over_batches():
    table = pa.table({"key": [1, 1, 1, 2, 2, 3, 3, 3, 3], "part": pa.array([0, 0, 1, 0, 0, 0, 0, 0, 0], pa.int32()), "id": list(range(9))})
    for size in range(1, 10):
        seen = []

        def done(rows, starts):
            ids = rows["id"].to_pylist()
            seen.extend(ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True))
            return pa.RecordBatch.from_pydict({"a": [1]})

        list(minhash._by_group(iter(table.to_batches(max_chunksize=size)), done))
        assert seen == [[0, 1], [2], [3, 4], [5, 6, 7, 8]]


def test_linked_vectors_of_two_lengths_in_one_cell(spark):
    """Short vectors that fall into the cells of long ones take no links from them."""
    rng = np.random.default_rng(11)
    data = []
    for k, length in enumerate((64, 32)):
        for i in range(500):
            v = rng.normal(size=length)
            data += [(10000 * k + 2 * i + j, (v + j * rng.normal(0, 0.02, length)).tolist(), 0) for j in (0, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in lattice.linked_vectors(vectors).collect()}
    assert got == {i: i - i % 2 for i, _, _ in data}


def test_lattice_verifies_each_length_of_a_group():
    unit = lambda *x: lattice._packed([*x])
    rows = pa.table({"key": [7] * 4, "part": pa.array([0] * 4, pa.int32()), "id": [1, 2, 3, 4], "role": pa.array([1, 1, 0, 0], pa.int32()), "tab": pa.array([0] * 4, pa.int32()), "members": [1, 1, 1, 1], "vector": [unit(1.0, 0.0), unit(0.0, 1.0, 0.0), unit(2.0, 0.0), unit(0.0, 3.0, 0.0)]})
    found = [tuple(r.values()) for b in lattice._verify(iter(rows.to_batches())) for r in b.to_pylist()]
    assert [f[:2] for f in found if f[1]] == [(1, 3), (2, 4)]


def test_projections_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    matrix = lattice._projections(64)[1]
    whole = lattice._projected(x, matrix)
    for n in (1, 2, 7, 100):
        assert all((lattice._projected(x[k : k + n], matrix) == whole[k : k + n]).all() for k in range(0, 300, n))
    cell = lattice.nearest_e8(whole)[0]
    assert all((lattice._around(whole[k : k + 1], cell[k : k + 1]) == lattice._around(whole, cell)[k : k + 1]).all() for k in range(300))


def test_linked_vectors_at_the_limit_and_in_a_crowd(spark):
    """A cosine of exactly 0.98 is a link; a crowd's links are counted, not sent."""
    rng = np.random.default_rng(5)
    data = [(0, [1.0, 0.0] + [0.0] * 8, 1), (1, [0.98, float(np.sqrt(1 - 0.98 * 0.98))] + [0.0] * 8, 1), (2, [0.97, float(np.sqrt(1 - 0.97 * 0.97))] + [0.0] * 8, 2), (3, [1.0, 0.0] + [0.0] * 8, 2)]
    centre = rng.normal(size=10)
    data += [(10 + i, (centre + rng.normal(0, 0.01, 10)).tolist(), 3) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    for limit in (4096, 20):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.linked_vectors(df, limit=limit).collect()}
        assert got[0] == (1, 0) and got[1] == (1, 0) and got[2] == (0, 2) and got[3] == (0, 3)
        assert {got[10 + i] for i in range(200)} == {(199, 10)}
