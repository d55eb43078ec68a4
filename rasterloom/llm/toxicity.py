"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, Memo, bound_batches

#: Hashed feature slots; labelled documents of either label that the model is fitted on at most, and bytes of their texts
#: at most; passes over them.
SLOTS, SAMPLE, SAMPLE_BYTES, EPOCHS = 1 << 18, 4000, 16 << 20, 150
PREFIXES = range(4, 10)
SENTENCE = re.compile(r"[^.!?\n]+")
#: ASCII letters stay, other ASCII becomes space; bytes of other characters stay.
LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def sentence_words(sentence: str) -> set[bytes]:
    """The distinct words of a sentence, so that a repeated word counts once."""
    return set(sentence.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())


def word_features(word: bytes) -> list[int]:
    """Slots of a word: itself, and its beginnings of 4 to 9 characters where it goes on."""
    text = word.decode("utf-8", "replace")
    return [xxhash.xxh64_intdigest(b"=" + word) % SLOTS, *[xxhash.xxh64_intdigest(text[:k] + "+") % SLOTS for k in PREFIXES if len(text) > k]]


@dataclass
class Model:
    """Weight of each slot, and the log-odds of a sentence without words."""

    weights: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(sum(self.weights[i] for i in word_features(word)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, rate: float = 1.0, decay: float = 1e-5, steady: float = 0.1, least_docs: int = 3, balance: float = 0.3) -> Model:
    """The noisy-or model of labelled texts; share is that of label 1 among all labelled rows, and the score where nothing can be learnt.

    The texts of label 1 weigh `balance` of the whole loss.
    P(document) = 1 - product(1 - P(sentence)), P(sentence) = logistic(bias + sum of its words' weights). Slots that fewer
    than least_docs texts have stay at zero; `steady` slows the steps of slots with small gradients, that is, rare ones. Slots start at half of their log-odds in
    whole texts where these are clear.
    """
    words: dict[bytes, int] = {}
    tokens, sizes, counts = [], [], []
    for t in texts:
        sentences = [sentence_words(m) for m in SENTENCE.findall(t)] or [set()]
        counts.append(len(sentences))
        for s in sentences:
            sizes.append(len(s))
            tokens += [words.setdefault(w, len(words)) for w in sorted(s)]
    y = np.array(labels, dtype=bool)
    bias, theta = -5.0, np.zeros(SLOTS)
    if not len(y) or not words or y.all() or not y.any():
        return Model(theta, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    features = [word_features(w) for w in words]
    flat, of_word = np.concatenate(features).astype(np.int64), np.repeat(np.arange(len(words)), [len(f) for f in features])
    token = np.array(tokens)
    sentence_of_token, doc_of_sentence = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(y)), counts)
    pair = np.unique(doc_of_sentence[sentence_of_token].astype(np.int64) * len(words) + token)  # a text and a word of it
    with_word = np.stack([np.bincount(pair[y[pair // len(words)] == k] % len(words), minlength=len(words)) for k in (False, True)])
    clean_docs, toxic_docs = (np.bincount(flat, weights=n[of_word], minlength=SLOTS) for n in with_word)
    open_ = clean_docs + toxic_docs >= least_docs
    odds = np.log((toxic_docs + 0.5) / (y.sum() + 1)) - np.log((clean_docs + 0.5) / ((~y).sum() + 1))
    theta = np.where(open_ & (toxic_docs >= 5) & (odds > 2), odds / 2, 0.0)
    importance = np.where(y, balance / y.mean(), (1 - balance) / (1 - y.mean())) / len(y)
    m, v, mb, vb = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    for step in range(1, epochs + 1):
        weight = np.bincount(of_word, weights=theta[flat], minlength=len(words))
        z = bias + np.bincount(sentence_of_token, weights=weight[token], minlength=len(sizes))
        clean = np.bincount(doc_of_sentence, weights=_softplus(z), minlength=len(y))  # -log P(no sentence is toxic)
        slope = np.where(y, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0) * importance
        g = slope[doc_of_sentence] / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = np.bincount(flat, weights=np.bincount(token, weights=g[sentence_of_token], minlength=len(words))[of_word], minlength=SLOTS) * open_ + decay * theta
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        theta -= rate * (m / fix) / (np.sqrt(v / fix2) + steady)
        bias -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-7)
    return Model(theta, float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits the model on at most `sample` labelled documents of each label and `sample_bytes` of their whole texts, those of
    the smallest id hashes; a text that would exceed the bytes left is passed over.

    labels: (id, label 0/1); rows with a null id or label are left out. Only these texts reach the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    by = {y: n for y, n in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = every.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy(F.xxhash64("id"), "id").collect()
    chosen, left = [], {0: sample_bytes, 1: sample_bytes}
    for r in sizes:  # two samples at most
        if r["size"] <= left[r.y]:
            left[r.y] -= r["size"]
            chosen.append((r.id, r.y))
    chosen = docs.sparkSession.createDataFrame(chosen, every.select("id", F.lit(0).alias("y")).schema)
    texts = every.join(F.broadcast(chosen), "id").select("id", "text", "y").groupBy("id", "y").agg(F.max("text").alias("text")).select("id", "text", "y")
    rows = sorted(texts.collect(), key=lambda r: r.id)
    return fit([r.text or "" for r in rows], [r.y for r in rows], by.get(1, 0) / max(1, sum(by.values())))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, score, offending) of every whole text; offending: array of (begin, end, score, text) of sentences of at least `least`.

    begin and end count characters. A null or empty text is one empty sentence; so is one without sentences. Repeated
    rows get equal scores; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    held = spark.sparkContext.broadcast((model.weights, model.bias))  # a fixed number of slots
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])

    def run(parts: Batches) -> Batches:
        known = Model(*held.value)

        weights = Memo(known.word)
        odds = float(np.log(least / (1 - least)))
        for b in parts:
            scores, found = [], []
            for text in b.column(1).to_pylist():
                zs, at, hits = [], weights.__getitem__, []
                for m in SENTENCE.finditer(text or ""):
                    z = known.bias + sum(map(at, sentence_words(m[0])))
                    zs.append(z)
                    if z >= odds:
                        hits.append({"begin": m.start(), "end": m.end(), "score": 1 / (1 + float(np.exp(-z))), "text": m[0]})
                scores.append(float(-np.expm1(-_softplus(np.array(zs or [known.bias])).sum())))
                found.append(hits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(span))], names=["id", "score", "offending"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, offending array<struct<begin: long, end: long, score: double, text: string>>")
