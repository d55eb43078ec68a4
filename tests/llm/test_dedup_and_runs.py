"""Texts with long white space, lines of repeated ids, exact copies, periodic runs and prefix tries."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import exact, language, line_dedup, packing, quality, runs, trie
from rasterloom.llm import queries as q


def values(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sql(statement, data, columns, **tables):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables.get(name, f'{data}/{name}.parquet')}'")
    return values(con.execute(f"SELECT {', '.join(columns)} FROM ({statement})").fetchall())


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "a." + "\n" * 9000 + "b", "\t" * 5000, " " * 5001 + "<|endoftext|>x", "x" + "\n" * 6000 + "<|endoftext|>", "　" * 5000 + " a"])
def test_long_white_space_gives_the_ids_of_the_tokenizer_file(text):
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(packing.encoding("byte_bpe_50k.tiktoken"), text) == file.encode(text, add_special_tokens=False).ids


def test_texts_of_one_id_keep_their_own_lines(spark):
    rows = [(1, "hello wide world foo"), (7, "a unique line stays here"), (7, "hello wide world foo"), (8, None), (9, "")]
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id < 8) == [(1, "hello wide world foo"), (7, "a unique line stays here")]
    assert {r.doc_id for r in got} == {1, 7, 8, 9}


def test_many_lines_of_one_document(spark):
    text = "\n".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(100_000))
    rows = [(1, text), (2, f"{text}\nthe last one")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "the last one"}


# --- 13: exact copies --------------------------------------------------------------------------------------------


def test_exact_dedup_matches_sql(spark, data):
    got = q.op13_exact_dedup(spark, data)
    assert values(got.collect()) == sql(q.ORACLE_SQL["op13_exact_dedup"], data, got.columns)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_exact_groups_edge_cases(spark, monkeypatch, bits):
    monkeypatch.setattr(exact, "BITS", bits)
    long = "a long text " * 20_000
    rows = [(5, "a\t\n b", 1), (3, "a b", 2), (3, "a b", 3), (None, "a b", 4), (9, None, 5), (8, "", 6), (7, " ", 7), (1, long, 8), (2, long + "x", 9), (4, long, 10), (None, "y", 11), (None, "y", 12), (6, " a b", 13), (10, "a" * 64 + "b", 14), (11, "a" * 64 + "c", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = {r.length: r for r in exact.exact_groups(docs, keep=("length",)).collect()}
    assert len(got) == len(rows)
    want = {1: (3, 4), 2: (3, 4), 3: (3, 4), 4: (3, 4), 5: (8, 2), 6: (8, 2), 7: (7, 1), 8: (1, 2), 9: (2, 1), 10: (1, 2), 11: (None, 2), 12: (None, 2), 13: (6, 1), 14: (10, 1), 15: (11, 1)}
    assert {k: (r.keep_id, r.group_size) for k, r in got.items()} == want
    assert {k for k, r in got.items() if not r.kept} - {2, 3, 11, 12} == {1, 4, 5, 10} and got[2].kept != got[3].kept and got[11].kept != got[12].kept
    assert exact.exact_groups(docs.limit(0)).count() == 0


# --- 12: periodic runs -------------------------------------------------------------------------------------------


def plain_runs(words, times=4, least=6):
    found, n = set(), len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, times * p) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, p)):
                found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    out = []
    while len(out) < rng.randrange(5, 120):
        part = [rng.choice("abcd" if rng.random() < 0.7 else "ab") for _ in range(rng.randrange(1, 9))]
        out += part * rng.choice([1, 1, 2, 3, 4, 5, 9])
        if rng.random() < 0.3:
            out += part[: rng.randrange(len(part) + 1)]
    return out


def test_periodic_runs_match_brute_force(spark):
    rng = random.Random(12)
    texts = [random_words(rng) for _ in range(300)] + [["a"] * 5, ["a"] * 6, ["a"] * 400, ["a", "b"] * 100, [f"w{i}" for i in range(50)] * 5, ["a", "a", "b"] * 4 + ["a"] * 9]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r for r in runs.periodic_runs(docs).collect()}
    for i, t in enumerate(texts):
        want = plain_runs(t)
        assert [tuple(r) for r in got[i].runs] == want, t
        gone = {k for s, n, p in want for k in range(s + p, s + n)}
        assert got[i].collapsed == " ".join(w for k, w in enumerate(t) if k not in gone) and got[i].n_words == len(t)


def test_lag_scan_over_many_words():
    rng = np.random.default_rng(3)
    part = rng.integers(0, 5, 3000)
    assert runs.lag_scan(np.concatenate([part] * 5), 4, 6)[-1] == (0, 15_000, 3000)
    assert runs.lag_scan(np.zeros(300_000, np.int64), 4, 6) == [(0, 300_000, 1)]


def test_periodic_runs_query_and_edge_cases(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in q.op12_periodic_runs(spark, data).collect()}
    assert got.keys() == {d.doc_id for d in docs}
    for d in docs:
        words, h = runs.WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if n > 600:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = plain_runs(words)
        r = got[d.doc_id]
        most = min(want, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *(most or (None,) * 3)) and r.exponent_milli == (1000 * most[1] // most[2] if most else None)
        gone = {k for s, m, p in want for k in range(s + p, s + m)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "x " * 7, 7), (None, "x " * 7, 7), (3, "x\x0b\u2003y " * 200_000, 7)], "doc_id long, text string, runs long")
    rows = runs.periodic_runs(odd).collect()
    assert sorted((r.id or 0, r.n_words, [tuple(x) for x in r.runs]) for r in rows) == [(0, 7, [(0, 7, 1)])] * 2 + [(1, 0, []), (2, 0, []), (3, 400_000, [(0, 400_000, 2)])]
    assert runs.periodic_runs(odd.limit(0)).count() == 0


# --- 11: prefix trie ---------------------------------------------------------------------------------------------


def plain_trie(paths):
    """paths: {conv: [(role, text), ...]}."""
    members, below = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)

    def walk(p):
        leaves, saved = (0, 0) if p in below else (1, 0)
        for k in below.get(p, []):
            a, b = walk(k)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    out = []
    if paths:
        walk(())
    return values(out)


@pytest.mark.parametrize("block", [2, 7, 60, 1 << 17])
def test_prefix_trie_matches_brute_force(spark, block, monkeypatch):
    rng = random.Random(block)
    paths = {c: [("user", rng.choice("ab") * rng.randrange(1, 3)) for _ in range(rng.choice([0, 1, 2, 3, 5, 12]))] for c in range(-40, 400, 3)}
    paths |= {1000 + c: paths[-40 + 3 * (c % 5)] for c in range(60)}  # copies that fill many blocks
    rows = [(c, k, r, t) for c, path in paths.items() for k, (r, t) in enumerate(path)] or []
    turns = trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    every = spark.createDataFrame([(c,) for c in paths], "conv long").join(turns, "conv", "left")
    sorted_ = every.selectExpr("conv", "coalesce(turns, array()) as turns").select("conv", F.unhex(F.expr("array_join(transform(turns, t -> t.mark), '')")).alias("key"), F.expr("transform(turns, t -> t.chars)").alias("chars")).collect()
    monkeypatch.setattr(trie, "BLOCK", block)
    # a partition of a few rows after another, as executors have them
    order = sorted(sorted_, key=lambda r: (bytes(r.key), r.conv))
    cuts = sorted(rng.sample(range(1, len(order)), 5))
    nodes, paths_of = [], []
    for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
        for out, left in trie._merge((trie._Row(bytes(r.key), r.chars, {len(r.chars): [1, r.conv, 0, 0, 0, 1]}) for r in order[a:b]), False):
            nodes += out
            paths_of += left
    top = [n for out, _ in trie._merge(iter(paths_of), True) for n in out]
    nodes += top
    known = {n["prefix"]: n["conv"] for n in nodes}
    assert len(known) == len(nodes)
    got = values((n["conv"], n["depth"], known.get(n["parent"]) if n["depth"] else None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved"]) for n in nodes)
    want = plain_trie(paths)
    assert got == values(x[:7] for x in want)
    assert all(n["parent_conv"] in (None, known.get(n["parent"])) for n in nodes)
    joint = {n["prefix"] for n in nodes if n["joint"]} | {n["prefix"] for n in top}
    assert all(n["depth"] == 0 or n["parent_conv"] is not None or n["parent"] in joint for n in nodes)
    assert values(trie.prefix_trie(every).collect()) == want


def test_prefix_trie_matches_sql(spark, data):
    got = q.op11_conversation_prefix_trie(spark, data)
    assert values(got.collect()) == sql(q.ORACLE_SQL["op11_conversation_prefix_trie"], data, got.columns)


def test_prefix_trie_edge_cases(spark, tmp_path, data):
    rows = [(0, None, "u", "first"), (0, 1, None, "x"), (0, 1, None, "x"), (0, 2, "u", None), (None, 1, "u", "x"), (100, None, None, None), (101, 3, "u", "a" * 100_000), (101, 2, "v", ""), (103, 1, "u", "z"), (205, 1, "u", "z"), (-3, 0, "u", "q")]
    rows += [(c, 0, "u", "y") for c in range(110, 130)]
    where = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").coalesce(1).write.parquet(where)
    got = q.op11_conversation_prefix_trie(spark, str(tmp_path))
    assert values(got.collect()) == sql(q.ORACLE_SQL["op11_conversation_prefix_trie"], data, got.columns, conversations=f"{where}/*.parquet")
    assert trie.prefix_trie(trie.turns(spark.read.parquet(where).limit(0))).count() == 0


# --- 5 and 7: bounded samples, hot hosts ----------------------------------------------------------------------------


def test_one_id_in_bulk_counts_once_in_the_sample(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    bulk = docs.union(spark.range(20_000).select(F.lit(-1).alias("doc_id"), F.concat(F.lit("some words of one id "), F.col("id").cast("string")).alias("text")))
    held = []
    fit, quality.fit = quality.fit, lambda rows: (held.append(rows), fit(rows))[1]
    try:
        quality.train(bulk)
        quality.train(docs, sample_slots=2000)
    finally:
        quality.fit = fit
    assert len(held[0]) == docs.count() + 1 and 0 < sum(len(r[0]) for r in held[1]) <= 2000


def plain_posteriors(rows, logs, classes, languages):
    """rows: (declared, host, suffix) of each text, logs their likelihoods. Every step in plain loops."""
    rare, wider = language.RARE, language.WIDER
    scaled = lambda x: [v / sum(x) for v in x]
    start = [rare if c == language.OTHER else (1 - rare) / len(languages) for c in classes]
    soft = [scaled([np.exp(a - max(x)) * p for a, p in zip(x, start, strict=True)]) for x in logs]
    said = [*languages, language.OTHER, "-"]
    keys = [(s, (s, ".".join(h.split(".")[-2:])), (s, h)) for _, h, s in rows]
    n = len(classes)
    total = [sum(x[i] for x in soft) + 1 for i in range(n)]
    trust = np.full((n, len(said)), 0.5)
    for (d, _, _), x in zip(rows, soft, strict=True):
        trust[:, said.index(d)] += x
    trust /= trust.sum(axis=1, keepdims=True)
    out = []
    for k, (d, _, _) in enumerate(rows):
        prior = scaled(total)
        for level in range(3):
            counts = [sum(x[i] for x, q in zip(soft, keys, strict=True) if q[level] == keys[k][level]) for i in range(n)]
            prior = scaled([max(c - s, 0.0) + wider * p for c, s, p in zip(counts, soft[k], prior, strict=True)])
        x = [a + np.log(trust[i, said.index(d)]) + np.log(max(prior[i], 1e-12)) for i, a in enumerate(logs[k])]
        out.append(scaled([np.exp(v - max(x)) for v in x]))
    return out


@pytest.mark.parametrize("small", [32 << 20, 0])
def test_language_posteriors_match_plain_loops(spark, data, monkeypatch, small):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    likelihoods = language.train(docs)
    rng = random.Random(5)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", None]
    langs = sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang})
    rows = [(k, t, rng.choice([None, "", "xx", langs[0].upper(), *langs]), rng.choice(["", None, "a.b.c", "x.b.c", "q.d", "hot.example"]), rng.choice(["c", "d", None])) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    kept = []
    keep = language.written
    monkeypatch.setattr(language, "written", lambda d, name: kept.append((name, keep(d, name))) or kept[-1][1])
    monkeypatch.setattr(language, "sized", lambda d, most=0: F.broadcast(d) if small else d)
    got = {r.id: r for r in language.identify(df, likelihoods).collect()}
    seen = {r.id: r for name, d in kept if name == "evidence" for r in d.collect()}
    order = sorted(seen)
    languages = sorted({r for r in langs})
    classes = [*languages, language.OTHER]
    want = plain_posteriors([(seen[k].declared, seen[k].host, seen[k].suffix) for k in order], [seen[k].logs for k in order], classes, languages)
    for k, p in zip(order, want, strict=True):
        assert np.allclose(got[k].posterior, p, atol=1e-9), k
        assert got[k].lang == classes[int(np.argmax(p))] and abs(got[k].confidence - max(p)) < 1e-9
    assert {seen[k].declared for k in order} <= {*languages, language.OTHER, "-"}
