"""Operators for training data against brute force, on edge cases and on the small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from textguard.llm import (
    catalog,
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, runs string, n_removed long"
SENTENCE = "the quick brown fox jumps over the lazy dog while rain falls on old stones near river bank"
PASSAGE = " ".join(f"word{i}" for i in range(90))
LONG = " ".join(f"{SENTENCE} {i}" for i in range(3000))
EDGE = [
    (1, PASSAGE + " left end", "en"), (2, "start here " + PASSAGE, "en"), (3, PASSAGE + " left end", "en"), (3, PASSAGE + " left end", "en"),
    (4, None, None), (5, "", "en"), (6, " \n\t ", "fr"), (7, LONG, "en"), (8, "a" * 2000, "de"), (9, "été " * 300, "fr"),
    (None, "one two", None), (10, "1234 5678", "de"), (11, "x y z", "de"), (12, "X  y z", "de"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, True, "x", 9) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def brute_groups(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    name = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[find(k)].append(i)
    return sorted(((i, len(sets[k]), min(name[find(k)], default=None)) for k, (i, _) in enumerate(rows)), key=str)


def noisy(seed, n, size):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if not k or rng.random() < 0.25:
            base = [f"t{rng.integers(40)}" for _ in range(rng.integers(1, size))]
        text = list(base)
        for _ in range(rng.integers(0, 1 + size // 40)):
            text[rng.integers(len(text))] = f"t{rng.integers(40)}"
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("size,percent", [(12, 85), (120, 85), (300, 80)])
def test_ngram_join_equals_all_pairs(spark, size, percent):
    rows = noisy(size, 120, size)
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows, 4, percent)


def test_ngram_join_edges(spark, edge, none):
    got = ngram_join.groups(edge)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups([(i, t) for i, t, _ in EDGE], 4, 85)
    assert ngram_join.groups(none).count() == 0


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(0)
    for n in (1, 5, 30, 200, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            for _ in range(int(0.08 * n)):
                b[rng.integers(n)] = rng.integers(2**63)
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.join_keys(a, 85), ngram_join.join_keys(b, 85)))


def test_a_set_has_few_join_keys():
    tokens = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert len(ngram_join.join_keys(tokens, 85)) < 150


def test_large_cells_are_compared_without_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base, rows = [f"t{k}" for k in range(60)], []
    for k in range(160):  # from near copies of one text to texts that share a part of it
        text = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            text[at] = f"u{rng.integers(1000)}"
        rows.append((k, " ".join(text)))
    made, write = {}, ngram_join.materialise

    def noted(df, name):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", noted)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    got = ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(rows, 4, 85)
    assert made["stars"] <= len(ngram_join.LEADERS) * len(rows) and made["rest"] <= made["cells"] * ngram_join.SMALL / 2


def brute_suffix(rows, length):
    seen = collections.Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mask[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup_equals_brute_force(spark, edge, none, length):
    rows = [(i, t[:20000] if t else t, x) for i, t, x in EDGE]
    got = suffix_dedup.summarise(frame(spark, rows), length)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_suffix([(i, t) for i, t, _ in rows], length)
    assert suffix_dedup.summarise(none, length).count() == 0


def test_suffix_dedup_keeps_the_first_copy(spark):
    rows = [(1, "abc " + PASSAGE, "en"), (2, PASSAGE + " xyz", "en"), (3, "é" * 500, "fr"), (4, None, "en")]
    got = {r.doc_id: r for r in suffix_dedup.strip_copies(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == " xyz" and got[2].n_removed == len(PASSAGE)
    assert set(got[3].text) == {"é"} and len(got[3].text) < 500 and got[4].text is None


def test_passage_stage_cuts_51_short_words(spark):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    short, part = " ".join(word(2) for _ in range(51)), " ".join(word(6) for _ in range(50))
    long = " ".join(word(30) for _ in range(14))
    rows = [(k, f"left{k} {x} right{k}", "en") for k, x in enumerate([short, short, part, part, long, long])]
    rows += [(6, f"\n{short.replace(' ', '  ')} \t", "en"), (7, None, "en"), (8, "é " * 60 + "end", "fr")]
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert all(got[k] == rows[k][1] for k in (0, 2, 3, 4)) and got[7] is None
    assert got[1] == "left1  right1" and got[5] == "left55" and 6 not in got
    assert got[8].split() == ["é", "end"]


@pytest.mark.parametrize("length", [3, 20])
def test_word_passages_equal_brute_force(spark, length):
    rng = np.random.default_rng(length)
    base = [f"w{x}é" for x in rng.integers(0, 400, 200)]
    rows = []
    for k in range(40):
        at = int(rng.integers(0, 150))
        rows.append((k, " ".join([f"a{k}", *base[at : at + int(rng.integers(2, 45))], f"b{k}", *base[:5], "z"] * int(rng.integers(1, 3))), "en"))
    seen, want = set(), {}
    for i, t, _ in rows:
        w = t.split()
        gone = set()
        for a in range(len(w) - length + 1):
            gram = tuple(w[a : a + length])
            if gram in seen:
                gone.update(range(a, a + length))
            seen.add(gram)
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    got = suffix_dedup.strip_copies(frame(spark, rows), length, words=True).collect()
    assert {r.doc_id: r.text.split() for r in got} == want


def suffix_rows():
    """Texts that share passages of many lengths, periodic ones, equal rows, null ids."""
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh \né"), 1500))
    rows = []
    for k in range(60):
        cut = [int(x) for x in np.sort(rng.integers(0, 1500, 4))]
        rows.append((k, f"<{k}>" + base[cut[0] : cut[1]] + "".join(rng.choice(list("xyz"), int(rng.integers(0, 90)))) + base[cut[2] : cut[3]], "en"))
    rows += [(70, "ab" * 700, "en"), (71, "x" + "ab" * 300 + base[:450] * 2, "en"), rows[3], rows[3], (None, rows[5][1], "en"), (None, "-" * 399, "en")]
    return rows


@pytest.mark.parametrize("kinds", [1, 2048])
@pytest.mark.parametrize("length", [100, 400])
def test_suffix_groups_and_hot_anchors_equal_brute_force(spark, monkeypatch, length, kinds):
    monkeypatch.setattr(suffix_dedup, "MAX_KINDS", kinds)
    rows = suffix_rows()
    got = suffix_dedup.summarise(frame(spark, rows), length)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_suffix([(i, t) for i, t, _ in rows], length)


@pytest.mark.parametrize("kinds", [1, 2048])
def test_suffix_first_copies_equal_brute_force(spark, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "MAX_KINDS", kinds)
    rows = [r for r in {(i, t): (i, t.replace("é", "e"), x) for i, t, x in suffix_rows() if i is not None}.values()]
    seen, want = set(), {}
    for i, t, _ in sorted(rows):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 199):
            if t[a : a + 200] in seen:
                gone[a : a + 200] = True
            seen.add(t[a : a + 200])
        want[i] = "".join(c for c, x in zip(t, gone) if not x)
    got = suffix_dedup.strip_copies(frame(spark, rows), 200)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_suffix_tables_have_no_row_per_suffix(spark, monkeypatch):
    # Suffixes of segments with one anchor and differing edges were written as a row each.
    made = []
    write = DataFrameWriter.parquet

    def counted(self, path, *args, **options):
        write(self, path, *args, **options)
        made.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    shared = word(1000)
    rows = [(k, word(900) + shared + word(900), "en") for k in range(40)] + [(50, "a" * 20000, "en")]
    got = suffix_dedup.summarise(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_suffix([(i, t) for i, t, _ in rows], 400)
    assert sum(made) < sum(len(t) - 399 for _, t, _ in rows) / 30


def test_key_bits_keep_every_wanted_row(spark):
    import pyarrow as pa

    keys = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, 3000)
    bits = suffix_dedup.key_bits(spark.createDataFrame([(int(k),) for k in keys[:1500]], "k1 long"))
    batch = pa.RecordBatch.from_arrays([pa.array(keys)], names=["k1"])
    (kept,) = suffix_dedup._with_bit(bits)(iter([batch]))
    kept = set(kept.column(0).to_pylist())
    assert kept >= set(keys[:1500].tolist()) and len(kept) < 1600


def test_language_training_keeps_the_sample_sparse(spark, monkeypatch):
    dense, sizes = language_id._dense, []
    monkeypatch.setattr(language_id, "_dense", lambda rows: sizes.append(len(rows)) or dense(rows))
    rows = [(k, f"{'the cat and dog' if k % 2 else 'der hund und katze'} {k}", "en" if k % 2 else "de") for k in range(3000)]
    model = language_id.train(frame(spark, rows), epochs=1)
    assert model.languages == ("de", "en") and max(sizes) <= 1024


def test_segments_of_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    text = "".join(np.random.default_rng(7).choice(list("abc"), 5000)) + "ab" * 2000
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([5, 6]), pa.array([text, ""])], names=["k1", "k2", "pos", "text"])

    def starts():
        out = set()
        for part in suffix_dedup._emit_segments(400, 64, False)(iter([batch])):
            for r in part.to_pylist():
                for x in r["more"] or [{"a": r["start"], "b": r["start"] + r["size"]}]:
                    out |= {(r["anchor"], s) for s in range(x["a"], x["b"])}
        return out

    whole = starts()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert starts() == whole and sorted(s for _, s in whole) == list(range(len(text) - 399))


def test_packing_round_trip(spark, edge, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = EDGE + [(20, "a <|endoftext|> b  \n\n c", "en")]
    pieces = packing.pack(frame(spark, rows), shard_docs=4).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p in {(p.start, p.length) for p in pieces if p.doc_id == i and p.doc_tokens == len(ids)}:
            want[(i, *p, zlib.crc32(ids[p[0] : sum(p)].tobytes()))] += 1
    assert {(p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces} == set(want)
    for i, t, _ in rows:
        total = sum(len(tokenizer.encode(u or "", add_special_tokens=False).ids) + 1 for j, u, _ in rows if j == i)
        assert sum(p.length for p in pieces if p.doc_id == i) == total
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and sum(n for _, n in s) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
    assert packing.pack(none).count() == 0


def test_encoder_equals_the_tokenizers_file(spark):
    import public_tokenizers

    odd = ["", " ", "\n\n  x", "a" * 5000, "don't  we'll\t1234567", "été \U0001f600\u200d漢字 \x00\x7f", "a <|endoftext|> b", "½²³Ⅷ _-_ \u00a0\u2028 z"]
    rng = np.random.default_rng(8)
    odd += ["".join(map(chr, rng.choice([*range(32, 600), 0x2009, 0x3042, 0x1F600], 400))) for _ in range(50)]
    texts = odd + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = packing.Encoder(public_tokenizers.path(name))
        assert bool(encode.fast) == (name == "byte_bpe_50k.json")
        for t in texts:
            assert encode(t).tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids


def test_bm25_prefers_shared_rare_words():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3], [1, 9, 9], [1, 2, 3, 4], [7, 8])]
    idf = np.ones(100)
    idf[1] = 0.01
    s = packing.bm25_scores(docs, idf, 3.0)
    assert s[0, 2] > s[0, 1] > s[0, 3] == 0


def test_tiling_catches_reordered_passages():
    known = decontaminate.Vocabulary()
    a, b = " ".join(f"p{i}" for i in range(10)), " ".join(f"q{i}" for i in range(10))
    tiles = decontaminate.tile(decontaminate.tokens(f"{a} {b}", known), decontaminate.tokens(f"zz {b} yy {a}", known))
    assert sorted(t[2] for t in tiles) == [10, 10]


def test_decontamination(spark, edge, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    got = {(r.doc_id, r.contaminated) for r in decontaminate.annotate(edge, items, block_chars=10).collect()}
    assert {i for i, bad in got if bad} == {1, 2, 3} and len(decontaminate.annotate(edge, items).columns) == len(edge.columns) + 3
    assert decontaminate.annotate(none, items).count() == 0 and decontaminate.annotate(edge, items.limit(0)).count() == len(EDGE)


def test_license_scan(spark, edge, none):
    mit = "Copyright (c) 2020 Someone\n\n" + license_scan.TEMPLATES["MIT"].upper().replace("SOFTWARE", "software")
    rows = [(1, mit, "en"), (2, license_scan.TEMPLATES["ISC"] + " a few more words", "en"), (3, "", "en"), (4, None, "en")]
    got = {r.doc_id: (r.license, r.n_bigrams) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1][0] == "MIT" and got[2][0] == "ISC" and got[3] == got[4] == (None, 0)
    assert license_scan.scan(edge).where("license IS NOT NULL").count() == 0 and license_scan.scan(none).count() == 0


def test_url_filter(spark):
    urls = ["http://Blog.Example.ORG/es/x?q", "http://a.example.org/en/12", "http://example.org/en/2", "http://org", "x", None, "http://badexample.com/de/", "http://m.com/de", "a://b.com/fr/#x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.query(pages).collect()}
    assert got[0] == ("blog.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2] == "org/" and got[3] == ("org", "", None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][2] is None and got[8][2:] == ("com/fr/", "allow")
    assert url_filter.query(pages.limit(0)).count() == 0


def test_quality_rules_edges(spark, edge, none):
    got = quality_rules.query(edge).collect()
    assert len(got) == len(EDGE) and all(r.n_words == 0 and r.base_failed for r in got if r.doc_id in (4, 5, 6))
    assert quality_rules.query(none).count() == 0


def test_quality_classifier_held_out(spark, edge, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.query(docs, labels).where("held_out").join(labels, "doc_id")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 40 and right > 0.9
    assert quality_classifier.query(edge, labels.limit(0)).where("score = 0.5").count() == len(EDGE)
    assert quality_classifier.query(none, labels).count() == 0


def test_language_id_held_out(spark, edge, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.query(docs).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    by_id = {r.doc_id: r for r in language_id.query(edge).collect()}
    assert by_id[4].lang_pred == by_id[5].lang_pred == by_id[10].lang_pred == "und"
    assert language_id.query(none).count() == 0


def test_language_stage_refuses_gibberish_and_keeps_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rng = np.random.default_rng(5)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (100, 200, 400, 800)]
    bad = frame(spark, [(-1 - k, t, None) for k, t in enumerate([*noise, "123 !"])]).select(*corpus_pipeline.COLUMNS)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.union(bad), "").select("doc_id").collect()}
    assert got == {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}


def test_language_stage_without_labels_keeps_letters(spark):
    docs = frame(spark, [(1, SENTENCE, None), (2, "12 !", None), (3, None, None), (4, "été", None)])
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_clashing_columns_and_ids_of_other_types(spark, edge):
    rows = [(k, SENTENCE, "en") for k in range(30)] + [(100 + k, "été chaud et long " * 5, "fr") for k in range(30)]
    docs = frame(spark, rows)
    for name in ("y", "k", "x", "share", "r", "n", "lang_pred", "held_out", "predicted", "count"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(r[0], int(r[0] >= 100), 0) for r in rows], "doc_id long, quality int, y int")
    assert quality_classifier.query(docs, labels).count() == 60
    got = language_id.query(docs).collect()
    assert {r.lang_pred for r in got} == {"en", "fr"}
    items = spark.createDataFrame([("item-a", PASSAGE)], "item_id string, text string")
    assert {r.item_id for r in decontaminate.query(edge, items).where("contaminated").collect()} == {"item-a"}


def test_many_languages_are_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9, f"l{k}") for k in range(520)]
    assert len(language_id.train(frame(spark, rows)).languages) > 300


def test_codewords_are_apart():
    codes = language_id.codewords(12, 15)
    assert min((codes[a] != codes[b]).sum() for a in range(12) for b in range(a)) >= 3


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.train(pages)
    body = "".join(f"<p>{SENTENCE}, and so on. Paragraph &amp; {i}.</p>" for i in range(5))
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Head</h1>{body}<script>x</script></article><div class=comments><p>nice one</p></div><footer>c</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 3000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(rows, model).collect()}
    assert got[1].text == "\n\n".join(["Head", *(f"{SENTENCE}, and so on. Paragraph & {i}." for i in range(5))])
    assert got[2].text == got[3].text == got[4].text == "" and got[2].n_chars == 0
    assert html_extract.query(rows.limit(0)).count() == 0


def test_decoding_has_no_contradictions():
    nodes = html_extract.parse("<body><div><p>aa</p><p>bb</p></div><section><p>cc</p></section></body>")
    rng = np.random.default_rng(1)
    for _ in range(50):
        kept = dict(zip(map(id, nodes), html_extract.decode(nodes, rng.normal(size=len(nodes)))))
        assert all(n.parent is None or kept[id(n.parent)] or not kept[id(n)] for n in nodes)


def test_pipeline_stages(spark, edge, none):
    for docs in (edge, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs.select(*corpus_pipeline.COLUMNS), "/root/testdata/sf0.001")
            assert docs.columns == corpus_pipeline.COLUMNS, name
        assert packing.pack(docs).count() >= docs.count()


def test_near_copy_stage_keeps_one_row_of_a_group(spark):
    other = SENTENCE.replace("quick", "slow")
    rows = [(3, PASSAGE, "en"), (3, PASSAGE, "en"), (3, PASSAGE + " end", "en"), (3, SENTENCE, "en"), (5, PASSAGE, "en"),
            (None, " ".join(f"n{i}" for i in range(30)), "en"), (None, " ".join(f"n{i}" for i in range(30)), "en"),
            (None, PASSAGE, "en"), (None, other[40:], "fr"), (7, None, None), (7, "", None)]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows).select(*corpus_pipeline.COLUMNS), "").collect()
    assert collections.Counter(r.doc_id for r in out) == {3: 2, None: 2, 7: 2}
    assert sum((r.text or "").startswith("word0") for r in out) == 1 and len({(r.doc_id, r.text) for r in out}) == len(out)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))
