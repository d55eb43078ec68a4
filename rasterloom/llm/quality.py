"""Quality by weak supervision: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or not at all. The votes of all documents, as counts of vote patterns, give the labellers'
accuracies; a document's posterior follows from its pattern. The posteriors of a bounded sample train a linear scorer of
hashed word shapes and coarse ratios, which decides.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, Memo, bound_batches, byte_texts, fresh, written

#: Hashed slots of the scorer, and documents it is fitted on at most (those of the smallest id hashes).
SLOTS, SAMPLE = 1 << 13, 12_000
#: Features of that sample at most.
SAMPLE_SLOTS = 1 << 22
GOOD, BAD, NONE = "g", "b", "-"
#: Name, and the values up to which a labeller votes good and from which it votes bad.
LABELLERS = (("symbols", 0.02, 0.10), ("tails", 0.02, 0.15), ("capitals", 0.15, 0.40), ("bars", 0.01, 0.08), ("shouts", 0.05, 0.20), ("top_word", 0.12, 0.25), ("stutter", 0.02, 0.10), ("echoes", 0.40, 0.55), ("same_lines", 0.20, 0.50))
FEW_WORDS = 8
TAIL = re.compile(rb"[!-/:-@\[-`{-~]{2}(?=\s|$)")
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"*$%&#@^~<>{}[]\\="
SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1+"))


def ratios(text: bytes) -> dict[str, float]:
    """What the labellers look at. Texts of a few words give ratios that no labeller uses."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if n < FEW_WORDS:
        return {"words": n}
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    part = [words[i : i + 16] for i in range(0, n, 16)]
    return {
        "words": n,
        "symbols": (size - len(text.translate(None, SYMBOLS))) / n / 3,
        "tails": sum(1 for _ in TAIL.finditer(text)) / n,
        "capitals": (size - len(text.translate(None, CAPITALS))) / size,
        "bars": text.count(b"|") / n,
        "shouts": text.count(b"!") / n,
        "top_word": max(counts.values()) / n if n >= 40 else 0.0,
        "stutter": sum(map(bytes.__eq__, words[1:], words)) / n,
        "echoes": 1 - sum(len(set(x)) for x in part) / n,
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 4 else 0.0,
    }


def votes(seen: dict[str, float]) -> str:
    """One letter a labeller."""
    if seen["words"] < FEW_WORDS:
        return NONE * len(LABELLERS)
    return "".join(GOOD if seen[k] <= good else BAD if seen[k] >= bad else NONE for k, good, bad in LABELLERS)


def shape(word: bytes) -> bytes:
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


def word_slots() -> Memo:
    return Memo(lambda word: xxhash.xxh64_intdigest(shape(word)) % SLOTS)


def features(text: bytes, seen: dict[str, float], known: Memo) -> dict[int, float]:
    """Slots and values: shares of word shapes, and the ratios in steps. known: word_slots()."""
    counts: Counter[int] = Counter()
    for word, k in Counter(text.split()).items():
        counts[known[word]] += k
    out = {s: c / max(1, seen["words"]) for s, c in counts.items()}
    for name, _, bad in LABELLERS:
        if name in seen:
            step = min(8, int(seen[name] / bad * 4))
            out[xxhash.xxh64_intdigest(f"{name}={step}") % SLOTS] = 1.0
    return out


def vote_patterns(docs: DataFrame, text_col: str) -> dict[str, int]:
    """How many documents have each pattern of votes: 3 to the power of the labellers at most."""

    def run(parts: Batches) -> Batches:
        counts: Counter[str] = Counter()
        for b in parts:
            counts.update(votes(ratios(t)) for t in byte_texts(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: r.n for r in found.collect()}


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good by pattern, P(vote | class) as labellers x (good, bad vote) x (good, bad class), P(good).

    Votes are taken as independent given the class; no vote tells nothing. The start says that labellers seldom err on good documents and miss
    many bad ones, which names the classes.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((len(LABELLERS), 2, 2)), 0.5
    n = np.array([patterns[p] for p in names], dtype=np.float64)
    cast = np.array([["gb-".index(c) for c in p] for p in names])
    chance = np.repeat(np.array([[0.98, 0.65], [0.02, 0.35]])[None], len(LABELLERS), axis=0)
    good = 0.8
    for _ in range(rounds):
        told = np.concatenate((np.log(chance), np.zeros((len(LABELLERS), 1, 2))), axis=1)
        logs = told[np.arange(len(LABELLERS)), cast].sum(axis=1) + np.log([good, 1 - good])
        q = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -500, 500)))
        weight = np.stack((n * q, n * (1 - q)), axis=1)
        total = weight.sum(axis=0)
        good = float(np.clip(total[0] / total.sum(), 0.01, 0.99))
        for k in range(len(LABELLERS)):
            given = np.stack([weight[cast[:, k] == v].sum(axis=0) for v in range(2)]) + 0.5
            chance[k] = given / given.sum(axis=0)
    return dict(zip(names, q.tolist(), strict=True)), chance, good


def fit(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of (slots, values, posterior) rows."""
    theta, bias = np.zeros(SLOTS), 1.0
    if not rows:
        return theta, bias
    slots = np.concatenate([np.array(r[0], np.int64) for r in rows])
    values = np.concatenate([np.array(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    seen, seen_bias = np.zeros(SLOTS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=theta[slots] * values, minlength=len(y)), -30, 30)))
        error = (p - y) / len(y)
        grad = np.bincount(slots, weights=error[row] * values, minlength=SLOTS) + decay * theta
        seen, seen_bias = seen + grad * grad, seen_bias + error.sum() ** 2
        theta -= rate * grad / (np.sqrt(seen) + 1e-3)
        bias -= rate * error.sum() / (np.sqrt(seen_bias) + 1e-3)
    return theta, float(bias)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_slots: int = SAMPLE_SLOTS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior by vote pattern (over all documents), and the scorer's weights and bias, over at most `sample` ids and
    `sample_slots` features of theirs, those of the smallest id hashes; of the texts of one id the one of fewest features."""
    bound_batches(docs.sparkSession)
    posterior, _, _ = estimate(vote_patterns(docs, text_col))

    def run(parts: Batches) -> Batches:
        known = word_slots()
        for b in parts:
            out = []
            for t in byte_texts(b.column(1)):
                seen = ratios(t)
                x = features(t, seen, known)
                out.append({"slots": list(x), "values": list(x.values()), "pattern": votes(seen)})
            x = pa.Table.from_pylist(out, schema=pa.schema([("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("pattern", pa.string())]))
            yield from x.add_column(0, "id", b.column(0)).combine_chunks().to_batches()

    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    kind = docs.schema[id_col].dataType.simpleString()
    # one text for each id, however often it stands there
    one = texts.mapInArrow(run, f"id {kind}, slots array<int>, values array<double>, pattern string").groupBy("id").agg(F.min(F.struct(F.size("slots").alias("n"), "slots", "values", "pattern")).alias("x")).select("id", "x.*")
    one = written(one, "sample")
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))  # a row for each id of the sample
    fits = one.select("id", "n").withColumn("upto", upto).where(F.col("upto") <= sample_slots).select("id")
    rows = sorted((r.slots, r["values"], posterior[r.pattern]) for r in one.join(F.broadcast(fits), "id", "left_semi").collect())
    return posterior, *fit(rows)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray, float], text_col: str = "text", posterior_col: str = "posterior", score_col: str = "score") -> DataFrame:
    """The documents with the labellers' posterior and the scorer's probability of good quality.

    All columns pass unchanged; a new column whose name is taken gets an underscore before it. Null text counts as empty; texts of a few words get no votes and, as nothing speaks
    against them, a high score. Equal texts get equal values; an empty table gives no rows.
    """
    posterior, theta, bias = model
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    posterior_col = fresh(docs, posterior_col)
    score_col = fresh(docs, score_col)
    schema = docs.select("*", F.lit(0.0).alias(posterior_col), F.lit(0.0).alias(score_col)).schema

    def run(parts: Batches) -> Batches:
        known = word_slots()
        for b in parts:
            first, second = [], []
            for t in byte_texts(b.column(at)):
                seen = ratios(t)
                z = bias + sum(theta[s] * x for s, x in features(t, seen, known).items())
                first.append(posterior.get(votes(seen), 0.5))
                second.append(1 / (1 + float(np.exp(-z))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.float64()), pa.array(second, pa.float64())], names=[*b.schema.names, posterior_col, score_col])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the scorer gives at least `least`, columns as before."""
    a, b = fresh(docs, "posterior"), fresh(docs, "score")
    return score(docs, train(docs, id_col, text_col), text_col, a, b).where(F.col(b) >= least).drop(a, b)
