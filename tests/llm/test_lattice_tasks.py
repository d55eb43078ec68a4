"""Texts stay in the task that reads them, whatever their stretches, batches and spaces."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import lattice


def plain(word, pieces, first, worst):
    """Ids of a word by a plain Viterbi; ties go to the longer last piece."""
    best = [(0.0, [])]
    for e in range(1, len(word) + 1):
        ways = [(best[at][0] + pieces[word[at:e]][0], e - at, best[at][1] + [pieces[word[at:e]][1]]) for at in range(max(0, e - 16), e) if word[at:e] in pieces]
        if word[e - 1] not in pieces:
            raw = word[e - 1].encode()
            ways.append((best[e - 1][0] + (worst - lattice.BYTE_PENALTY) * len(raw), 1, best[e - 1][1] + [first + b for b in raw]))
        score, _, ids = max(ways)
        best.append((score, ids))
    return best[-1][1]


def test_texts_are_not_shuffled_and_stretches_are_joined(spark, monkeypatch):
    table = lattice.pieces(spark)
    rows = table.collect()
    pieces = {r.piece: (r.score, r.id) for r in rows if r.score is not None}
    first, worst = next(r.id for r in rows if r.piece == "<0x00>"), min(s for s, _ in pieces.values())
    rng = random.Random(3)
    texts = ["", None, " ", "   ", "a", "one two  three   ", "▁marks▁ in▁▁text ", "日本 naïve🙂\u0000\n tab\t", "x" * 90 + " y", " " * 40 + "end"]
    texts += ["".join(rng.choice("ab e  ▁ñ日🙂\n") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i % 7 or None, t, f"k{i}") for i, t in enumerate(texts)], "doc_id long, text string, extra string").coalesce(1)
    monkeypatch.setattr(lattice, "STRETCH", 7)
    rows_at_once = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        encoded = lattice.encode(docs, table, keep=("extra",))
        plan = encoded._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        got = {r.extra: r for r in lattice.decode(encoded, table).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        marked = lattice.SPACE + (t or "").replace(" ", lattice.SPACE)
        want = [x for w in re.split(f"(?<!{lattice.SPACE})(?={lattice.SPACE})", marked) for x in plain(w, pieces, first, worst)]
        r = got[f"k{i}"]
        assert (r.id, r.ids, r.text) == (i % 7 or None, want, (t or "").replace(lattice.SPACE, " ")), t


def test_no_row_is_lost_between_tasks(spark):
    docs = spark.range(500).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), F.concat_ws(" ", F.lit("same words"), F.col("id") % 3).alias("text")).repartition(9)
    table = lattice.pieces(spark)
    back = lattice.decode(lattice.encode(docs, table), table)
    assert sorted((r.id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.text) for r in docs.collect())


def test_ends_are_folded_by_steps(spark, monkeypatch):
    table = lattice.trie(lattice.pieces(spark))
    rng = random.Random(4)
    words = ["", *("".join(rng.choice("▁abcdeé日🙂") for _ in range(rng.randrange(1, 70))) for _ in range(50)), ""]
    ids, counts = lattice.best_paths(words, table)
    monkeypatch.setattr(lattice, "STEP", 5)
    again, by_step = lattice.best_paths(words, table)
    assert np.array_equal(ids, again) and np.array_equal(counts, by_step) and counts[0] == counts[-1] == 0
    monkeypatch.setattr(lattice, "LETTERS", 40)
    assert b"".join(x for _, x in lattice.met(words, table)) == ids.tobytes()
    encoder = lattice.Encoder(table)
    monkeypatch.setattr(lattice, "KNOWN", 3)
    texts = [" " + w.replace(lattice.SPACE, " ") for w in words]
    whole = [encoder(texts)[0].tolist() for _ in range(3)]
    assert whole[0] == whole[1] == whole[2]


def test_bytes_that_are_no_text_become_marks_of_replacement(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'61FF62206320FF' as string) as text")
    table = lattice.pieces(spark)
    assert lattice.decode(lattice.encode(docs, table), table).first().text == "a\ufffdb c \ufffd"
