"""Corpus operators against brute force, round trips and held-out labels, and their edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import audio, backoff, epsilon_grid, language, lattice, line_dedup, packing, quality, simhash, toxicity
from rasterloom.llm import queries as q
from rasterloom.llm.common import in_fold
from rasterloom.llm.components import components

DOCS = "doc_id long, text string, id long, component long, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null ids, and columns that clash with internal names."""
    long = " ".join(f"word{i % 97}" for i in range(30_000))
    rows = [(1, None, 7, 7, 0.5), (2, "", 7, 7, 0.5), (3, long, None, 7, 0.5), (4, "the same line that is long enough\nx", 7, None, 0.5), (4, "the same line that is long enough\nx", 7, 7, None), (None, "a text without an id, long enough", 7, 7, 0.5), (5, " \n\t", 7, 7, 0.5), (6, "the same line that is long enough\ny", 7, 7, 0.5)]
    return spark.createDataFrame(rows, DOCS)


def union_find(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(i) for i in range(n)]


# --- components --------------------------------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = union_find(131, links)
    assert got == {i: want[i] for i in {x for a, b in links for x in (a, b) if a != b}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- 1: packing --------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2, 5, 9, 20, 200]), st.sampled_from([0.0, 1.0])), min_size=1, max_size=30), st.sampled_from([16, 32]))
def test_cuts_cost_the_least(steps, window):
    spots, prices, inside = np.cumsum([s for s, _ in steps]), np.array([p for _, p in steps]), 3.0
    cuts = packing.choose_cuts(spots, prices, window, inside)
    at, best = [0, *spots.tolist()], [0.0] + [math.inf] * len(spots)
    for j in range(1, len(at)):
        for i in range(j):
            size = at[j] - at[i]
            m = -(-size // window)
            if m <= packing.RUN or i == j - 1:
                full = best[i] + (m - 1) * inside + m * window - size
                best[j] = min(best[j], full, best[i] if m == 1 and size & (size - 1) == 0 else math.inf)
        best[j] += prices[j - 1]
    price, total, last = dict(zip(spots.tolist(), prices.tolist(), strict=True)), 0.0, 0
    for c in cuts:
        assert 0 < c - last <= window
        total += (0 if (c - last) & (c - last - 1) == 0 else window - (c - last)) + price.get(c, inside)
        last = c
    assert last == spots[-1] and total <= best[-1] + 1e-9


def test_packing_gives_every_id_once(spark, data):
    rows = q.op1_packing(spark, data).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 1024 - at)
    assert padding < 0.01 * total


def test_packing_reads_added_tokens_as_the_tokenizer_file_does(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a text <|endoftext|> and more", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "<|ENDOFTEXT|> plain  text\t", "naïve 日本<|endoftext|>🙂"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        got = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]
    assert 50256 in tok.encode(texts[0], add_special_tokens=False).ids


def test_packing_edge_cases(spark, odd):
    got = packing.pack_documents(odd).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n == by[2].n == 1 and by[4].n == 2 * by[4].d and None in by
    assert packing.pack_documents(odd.limit(0)).count() == 0


# --- 2: line dedup -----------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def variants(rng, base, most):
    b = list(base)
    for _ in range(rng.randint(0, most)):
        k, kind = rng.randrange(len(b)), rng.randrange(3)
        if kind == 0:
            b[k] = rng.choice("xyzé")
        elif kind == 1:
            b.insert(k, rng.choice("xyzé"))
        else:
            del b[k]
    return "".join(b)


def test_bit_parallel_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 40)))
        b = variants(rng, a, 4)
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) <= 2 and a:
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.edit_distance("a", "b", 2).alias("d")).collect()
    assert all(r.d == levenshtein(r.a, r.b) if levenshtein(r.a, r.b) <= 2 else r.d > 2 for r in got)


@pytest.mark.parametrize("hot", [2, 1000])
def test_repeated_lines_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40, 60)]
    texts = [variants(rng, bases[i % 2], 3) for i in range(80)]
    near = [(i, j) for i, j in itertools.combinations(range(80), 2) if abs(len(texts[i]) - len(texts[j])) <= 2 and levenshtein(texts[i], texts[j]) <= 2]
    want = union_find(80, near)
    rows = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc"]: r.first_doc for r in rows}
    assert [got.get(i, i) for i in range(80)] == want


def test_short_lines_take_part(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 2, 5, 11, 12, 13, 17, 23, 24, 25, 31)]
    texts = [variants(rng, bases[i % 11], i // 11 % 3) if len(bases[i % 11]) > 2 else bases[i % 11] for i in range(99)]
    near = [(i, j) for i, j in itertools.combinations(range(99), 2) if levenshtein(texts[i], texts[j]) <= min(2, len(texts[i]) // 12, len(texts[j]) // 12)]
    want = union_find(99, near)
    rows = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc"]: r.first_doc for r in rows}
    assert [got.get(i, i) for i in range(99)] == want
    assert sum(len(texts[i]) < 24 for i in got) > 20
    kept = line_dedup.drop_repeated(spark.createDataFrame([(1, "Les.\nfirst"), (2, "Les.\nsecond\n"), (3, "Les.")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(1, "Les.\nfirst"), (2, "second\n")]


def test_line_dedup_matches_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(map(tuple, q.op2_line_dedup(spark, data).collect()), key=repr)
    assert got == sorted(c.execute(q.OP2_SQL).fetchall(), key=repr)


def test_dropping_lines_edge_cases(spark, odd):
    out = line_dedup.drop_repeated(odd)
    assert out.columns == odd.columns
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect() if r.doc_id != 3)
    assert texts == [(-1, "a text without an id, long enough"), (1, None), (2, ""), (4, "the same line that is long enough\nx"), (4, "the same line that is long enough\nx"), (5, " \n\t"), (6, "y")]
    assert line_dedup.drop_repeated(odd.limit(0)).count() == 0


# --- 3: lattice --------------------------------------------------------------------------------------------------


def test_lattice_round_trip_and_best_path(spark):
    table = lattice.pieces(spark)
    texts = ["Hello world", " two  spaces ", "", None, "naïve 日本 \n tab\t🙂", "aaaaaaaaaaaaaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = lattice.encode(docs, table)
    back = {r.id: r.text for r in lattice.decode(encoded, table).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    scores = {r.piece: r.score for r in table.where("score is not null").collect()}
    names = {r.id: r.piece for r in table.collect()}
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()
    some = sorted({w for r in sample for w in ("▁" + r.text.replace(" ", "▁").replace("▁", " ▁")).split(" ") if w})[:400]
    some += ["▁Hello", "▁日本🙂x", "🙂", "\u0000", "▁" * 5, "a" * 40, "▁\n\t", "ß日" * 30]
    first, worst, longest = next(i for i, p in names.items() if p == "<0x00>"), min(scores.values()), max(map(len, scores))
    by = {r.word: r.ids for r in encode_rows(spark, some, table)}
    assert by.keys() == set(some)
    for word in some:
        best = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            for at in range(max(0, e - longest), e):
                piece = word[at:e]
                if piece in scores:
                    best[e] = max(best[e], best[at] + scores[piece])
                elif len(piece) == 1:
                    best[e] = max(best[e], best[at] + (worst - lattice.BYTE_PENALTY) * len(piece.encode()))
        out, total = b"", 0.0
        for i in by[word]:
            ordinary = names[i] in scores
            out += names[i].encode() if ordinary else bytes([i - first])
            total += scores[names[i]] if ordinary else worst - lattice.BYTE_PENALTY
        assert out == word.encode() and abs(total - best[-1]) < 1e-6


def test_lattice_keeps_rows_and_long_words(spark):
    table = lattice.pieces(spark)
    rows = [(1, "one text"), (1, "one text"), (None, "no id"), (1, "another"), (2, "x" * 60_000 + "日" * 2_000), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    back = lattice.decode(lattice.encode(docs, table), table).collect()
    assert sorted(((r.id or 0, r.text) for r in back)) == sorted((i or 0, t) for i, t in rows)
    assert lattice.encode(docs.limit(0), table).count() == 0


def encode_rows(spark, words, table):
    return lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()


# --- 4: audio ----------------------------------------------------------------------------------------------------


def test_audio_payloads_read_back(spark, odd):
    rows = audio.audio_features(audio.encode_audio(odd)).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert Counter(bytes(r.samples) for r in rows) == Counter(audio.payload_of(t.encode()) for t in texts)
    by = {}
    for r in rows:
        assert len(r.samples) % 576 == 0 and audio.read_wave(bytes(r.media))[1] == bytes(r.samples)
        t = audio.read_tensors(bytes(r.features))
        assert t["patch"].chunk(0).to_numpy_ndarray().shape[1:] == (16, 32) and t.num_rows == -(-r.frames // 16)
        assert by.setdefault(bytes(r.media), (r.frames, tuple(r.mel_mean))) == (r.frames, tuple(r.mel_mean))


def test_resampling_keeps_a_tone_and_stops_aliases():
    t = np.arange(20_000) * 2 * np.pi / 16_000
    y = audio.resample(np.sin(440 * t), audio.phases())
    assert len(y) == 12_500 and abs(np.abs(y[300:-300]).max() - 1) < 0.01
    assert np.abs(audio.resample(np.sin(7_500 * t), audio.phases())[300:-300]).max() < 0.02
    assert audio.segments(np.array([0, 0, 1.0, 0.1, 0, 0.1, 0, 0, 0, 0])) == [(2, 4)]


def test_audio_features_match_plain_versions():
    rng = np.random.default_rng(7)
    x, filters = rng.normal(size=1000).astype(np.float32), audio.phases()
    up, taps = filters.shape
    proto = filters[:, ::-1].T.ravel()  # the whole low-pass
    plain = []
    for i in range(-(-len(x) * up // audio.DOWN)):
        at, phase = divmod(i * audio.DOWN, up)
        plain.append(sum(float(proto[k * up + phase]) * float(x[at + taps - 1 - k - taps // 2]) for k in range(taps) if 0 <= at + taps - 1 - k - taps // 2 < len(x)))
    assert np.allclose(audio.resample(x, filters), plain, atol=1e-4)
    signal, bands = rng.normal(size=1500), audio.mel_filters()
    mel = audio.log_mel(signal, bands)
    wide = np.concatenate((signal, np.zeros(audio.FRAME)))
    for f in range(len(mel)):
        part = wide[f * audio.HOP : f * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME)
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        assert np.allclose(mel[f], np.log10(np.array(power) @ bands + 1e-10), atol=1e-6)
    energy = rng.random(60)
    base, want, run = np.median(energy), [], None
    for i, e in enumerate([*energy, -9.0]):
        if e >= base + 0.05:
            run = i if run is None else run
        elif run is not None:
            want += [(run, i)] if max(energy[run:i]) >= base + 0.15 else []
            run = None
    assert audio.segments(energy) == want
    patches = audio.read_tensors(audio.tensors(mel, 0.1))
    held = patches["patch"].chunk(0).to_numpy_ndarray().reshape(-1, audio.BANDS)
    assert np.allclose(held[: len(mel)], mel, atol=1e-5) and patches["end_s"].to_pylist()[-1] == len(mel) * 0.1


def test_audio_of_an_empty_table(spark):
    assert audio.audio_features(audio.encode_audio(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# --- 5, 6, 7: models ---------------------------------------------------------------------------------------------


def test_quality_keeps_good_and_rejects_bad(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r.kept, labels[r.doc_id]) for r in q.op5_quality_classifier(spark, d).collect() if r.doc_id in labels]
    assert np.mean([k for k, y in rows if y == 1]) > 0.98 and np.mean([not k for k, y in rows if y == 0]) > 0.9


def test_quality_estimate_finds_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    err = np.full(len(quality.LABELLERS), 0.1)
    cast = np.where(rng.random((4000, len(err))) < err, ~truth[:, None], truth[:, None])
    patterns = Counter("".join("g" if v else "b" for v in row) for row in cast)
    posterior, chance, good = quality.estimate(patterns)
    assert abs(good - 0.8) < 0.03 and np.allclose(chance[:, 1, 0], 0.1, atol=0.03)
    assert quality.estimate({})[0] == {}


def test_model_stages_edge_cases(spark, odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and {1, 2, 4, 6} <= {r.doc_id for r in kept.collect()}
    assert quality.keep_good(odd.limit(0)).count() == 0
    docs = odd.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    assert language.keep_identified(docs).columns == docs.columns
    assert language.keep_identified(docs.limit(0)).count() == 0
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(odd, model).where("score between 0 and 1").count() == odd.count()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in q.op6_toxicity(spark, d).where("held_out").collect() if r.doc_id in labels]
    assert np.mean([p == y for _, y, p in rows]) > 0.95 and np.mean([p for _, y, p in rows if y == 0]) < 0.02


def test_toxic_sentence_is_located():
    model = toxicity.fit(["a fine day. you idiot. the end" if i % 2 else "a fine day. the end" for i in range(40)], [i % 2 for i in range(40)], 0.5)
    assert model.word(b"idiot") > 5 and model.word(b"day") < 1


def test_language_of_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()}
    rows = q.op7_language_id(spark, d).collect()
    assert len(rows) == len(pages) and np.mean([f"/{r.lang}/" in pages[r.page_id] for r in rows]) > 0.97


def test_broken_markup_costs_its_length():
    page = "<html lang='de'><head><style>p {}</style></head><!-- x --><p>ein <b>Wort</b><script>var a = '<p>'</script > und 1 < 2"
    assert language.visible(page).split() == "ein Wort und 1 < 2".split() and language.declared_language(page) == "de"
    assert language.visible("a <!-- b <p>c") .split() == ["a", "c"] and language.declared_language("<html <html lang=en") is None
    import time

    for bad in ("<script ", "<!--", "<", "<html ", "</script"):
        began = time.time()
        language.visible(bad * 200_000)
        language.declared_language(bad * 200_000)
        assert time.time() - began < 5


def test_odd_addresses_and_empty_pages(spark):
    rows = [(1, "http://[broken", "<p>x</p>"), (2, None, None), (3, "https://a.example.de/fr/x", ""), (4, "no address", "<html lang=>y")]
    got = {r.id: (r.host, r.suffix, r.declared) for r in language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("", "", None), 2: ("", "", None), 3: ("a.example.de", "de/fr", None), 4: ("", "", None)}
    pages = language.page_evidence(spark.createDataFrame([], "page_id long, url string, html string"))
    assert language.identify(pages, np.zeros((4, language.SLOTS))).count() == 0


def test_long_words_keep_their_shape():
    assert quality.shape(b"aB" * 200) != quality.shape(b"aB" * 201) and len(quality.shape(b"aB" * 200)) == 400


def test_quality_fit_matches_plain_steps():
    rng = np.random.default_rng(3)
    rows = [(rng.choice(50, 5, replace=False).tolist(), rng.random(5).tolist(), float(rng.random())) for _ in range(40)]
    theta, bias = quality.fit(rows, rounds=3)
    want, b, seen, seen_b = np.zeros(quality.SLOTS), 1.0, np.zeros(quality.SLOTS), 0.0
    for _ in range(3):
        grad, gb = 1e-4 * want, 0.0
        for slots, values, y in rows:
            p = 1 / (1 + math.exp(-(b + sum(want[s] * v for s, v in zip(slots, values, strict=True)))))
            for s, v in zip(slots, values, strict=True):
                grad[s] += (p - y) / len(rows) * v
            gb += (p - y) / len(rows)
        seen, seen_b = seen + grad**2, seen_b + gb**2
        want, b = want - grad / (np.sqrt(seen) + 1e-3), b - gb / (math.sqrt(seen_b) + 1e-3)
    assert np.allclose(theta, want) and math.isclose(bias, b)


def test_quality_score_passes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words", 0.25, "x")], "doc_id long, text string, score double, posterior string")
    out = quality.score(docs, quality.train(docs))
    assert out.columns == [*docs.columns, "_posterior", "_score"] and tuple(out.first())[:4] == (1, "some words", 0.25, "x")


def test_toxicity_matches_a_plain_noisy_or(spark):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=toxicity.SLOTS), -1.0)
    texts = ["One bad word. Another line!\nthird, third?", "", None, "...", "word " * 3000]
    got = toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        clean = 1.0
        parts = [p for p in re.split(r"[.!?\n]", texts[r.id] or "") if p] or [""]
        for part in parts:
            words = set("".join(c if c.isalpha() else " " for c in part.lower()).split())
            clean *= 1 - 1 / (1 + math.exp(-(-1.0 + sum(model.word(w.encode()) for w in words))))
        assert math.isclose(r.score, 1 - clean, abs_tol=1e-9)
        assert all(texts[r.id][o.begin : o.end] == o.text and o.score >= 0.5 for o in r.offending)


def test_toxicity_training_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "fine words here. " + ("you idiot" if i % 2 else "a day") + " x" * (100_000 if i < 2 else 0)) for i in range(40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_bytes=5_000)
    assert model.word(b"idiot") > 3 and model.word(b"x") == 0


def test_text_without_spaces_is_read_whole(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    likelihoods = language.train(table)
    english = " ".join(table.where("lang = 'en'").orderBy("doc_id").first().text.split()[:30])
    rng = random.Random(6)
    foreign = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(5000))
    rows = [(1, f"{english} {foreign}"), (2, foreign), (3, english)]
    docs = spark.createDataFrame([(i, t, None, "h", "") for i, t in rows], "id long, text string, declared string, host string, suffix string")
    got = {r.id: r.lang for r in language.identify(docs, likelihoods).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}
    word = ("é" * 9000).encode()
    assert [len(x) for x in language.trigrams(word)] == [4096, 4096, 4096, 4096, 1616]


# --- 8: language model -------------------------------------------------------------------------------------------


def test_scores_match_a_plain_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()
    tokens = {r.doc_id: [1, 1, *r.text.encode().lower().split(), b""] for r in docs}  # 1: a start
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    grams = [Counter(tuple(tokens[i][k - n : k + 1]) for i in train for k in range(2, len(tokens[i]))) for n in range(3)]
    states = [None, *[Counter(tuple(tokens[i][k - n : k]) for i in train for k in range(2, len(tokens[i]))) for n in (1, 2)]]
    one = grams[0]
    n, v = sum(one.values()), len(one)
    d = (n1 := sum(c == 1 for c in one.values())) / (n1 + 2 * sum(c == 2 for c in one.values()))
    spread, s = d * v / n / (v + 1), (50.0, 3.0)

    def p(gram):
        if len(gram) == 1:
            return max(one[gram] - d, 0) / n + spread
        k = len(gram) - 1
        return (grams[k][gram] + s[k - 1] * p(gram[1:])) / (states[k][gram[:-1]] + s[k - 1])

    assert abs(sum(map(p, one)) + spread - 1) < 1e-9
    state = tuple(tokens[train[0]][5:7])
    assert abs(sum(p((*state, *w)) for w in one) + p((*state, b"\0unseen")) - 1) < 1e-9
    for r in backoff.score_texts(spark.createDataFrame(docs), in_fold("doc_id", 7, 2), strength=s).collect():
        t = tokens[r.id]
        base = sum(math.log10((one[w,] + 1) / (n + v + 1)) for w in t[2:])
        score = sum(math.log10(p(tuple(t[k - 2 : k + 1]))) for k in range(2, len(t)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t) - 2, sum(one[w,] > 0 for w in t[2:]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_counts_have_64_bits():
    keys, big = np.array([5, 9], np.uint64), np.array([2**40, 3], np.int64)
    row = {"keys": backoff._packed(np.diff(keys, prepend=np.uint64(0))), "counts": backoff._packed(big)}
    counts, places = backoff._summed([row, row])
    assert counts.tolist() == [2**41, 6] and [p.tolist() for p in places] == [[0, 1], [0, 1]]
    assert backoff._unpacked(backoff._packed(counts), "i8").tolist() == [2**41, 6]


def test_scoring_edge_cases(spark, odd):
    rows = backoff.score_texts(odd, in_fold("doc_id", 7, 2)).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) for r in rows)
    nothing = backoff.score_texts(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in nothing)
    assert backoff.score_texts(odd.limit(0), in_fold("doc_id", 7, 2)).count() == 0


# --- 9, 10: near duplicates --------------------------------------------------------------------------------------


def test_cosine_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    x = base[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * rng.choice([0, 0.2, 0.35], (400, 1))
    rows = [(i, [float(v) for v in np.float32(x[i])], int(i % 3) if i % 50 else None) for i in range(400)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, None], 0), (404, [3.0, 4.0], 1), (405, [6.0, 8.0], 1)]
    ok = [i for i, e, y in rows if y is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    links = [(i, j) for i, j in itertools.combinations(ok, 2) if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / (np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])) >= 0.93]
    degree, want = Counter(x for pair in links for x in pair), union_find(406, links)
    got = epsilon_grid.cosine_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.id, r.n_links, r.component) for r in got) == [(i, degree[i], want[i]) for i in range(406)]


def test_cosine_groups_of_repeated_ids_and_extreme_values(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.1], 0), (3, [0.1, 1.0], 0), (3, [0.1, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted(((r.id or -1, r.n_links, r.component or -1) for r in epsilon_grid.cosine_groups(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(-1, 0, -1), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1.0, -1.0], 0), (4, [-1e300, 1e308], 0)]
    got = sorted((r.id, r.n_links, r.component) for r in epsilon_grid.cosine_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
    assert epsilon_grid.cosine_groups(spark.createDataFrame([], schema)).count() == 0


def plain_fingerprint(text, words=4):
    t = text.encode().lower().split()
    if not t:
        return 0
    shingles = [b" ".join(t[i : i + words]) for i in range(max(1, len(t) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400)
    rows = sorted((r.id, r.fingerprint & (2**64 - 1), r.component) for r in simhash.simhash_groups(docs).collect())
    texts = dict(map(tuple, docs.collect()))
    fps = [f for _, f, _ in rows]
    assert fps == [plain_fingerprint(texts[i]) for i, _, _ in rows]
    ids = [i for i, _, _ in rows]
    want = union_find(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert [c for _, _, c in rows] == [ids[w] for w in want]


def test_tiles_find_all_links(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(12)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(list(enumerate(signed)), "id long, fingerprint long"))
    got = {r.id: r.component for r in components(links, "u", "v").collect()}
    want = union_find(len(fps), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash_edge_cases(spark, odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and {r.component for r in rows if r.fingerprint == 0} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())[:2] == [-1, 1]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def jaccard_sets(text, words=5):
    t = text.encode().lower().split()
    return {b" ".join(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} if t else set()


@pytest.mark.parametrize("dense", [0, 32])
def test_keep_one_finds_every_similar_text(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(4)
    texts = []
    for size in (3, 8, 9, 12, 40, 41, 90, 200, 600):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for cut in (0, 0, 1, 1, 2, 4, 9, 20):
            t = list(base)
            for _ in range(min(cut, size // 12 + (size < 20))):
                t[rng.randrange(size)] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(t[: size - cut % 2]))
    # hub with satellites: each is similar to the hub, and not to the other satellites
    base = [f"h{i}" for i in range(120)]
    texts += [" ".join(base)] + [" ".join(base[:k] + [f"y{k}", f"y{k + 1}"] + base[k + 2 :]) for k in range(10, 100, 8)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    sets = [jaccard_sets(t) for t in texts]
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = union_find(len(texts), alike)
    prints = [plain_fingerprint(t) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in alike) > 20  # what a radius of 4 does not link
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.id, r.component) for r in simhash.similar_groups(docs).collect()) == list(enumerate(want))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want))
