"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run of at least `times` periods holds each of its words at least `times` times. So a word that occurs less often within
a segment splits it, and so on until nothing changes; what survives is scanned lag by lag. Within a run of lag p three
neighbouring blocks of p words, counted from the segment's beginning, are equal; running hashes find such blocks in n / p
steps a lag, and each is then extended word by word to the whole stretch, which makes the result exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Blocks that a lag scan compares at once, and the odd base of the running hashes (which wrap at 2^64).
AT_ONCE, BASE = 1 << 16, 0x9E3779B97F4A7C15

SCHEMA = "id {id}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"


def segments(words: np.ndarray, texts: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """[begin, end) of the stretches, each within one text, in which every word occurs `times` times or more. words holds a
    number for each word, texts the number of the text that it stands in."""
    found, at, segment = [], np.arange(len(words)), texts.astype(np.int64)
    span = int(words.max(initial=0)) + 1
    while len(at):
        _, group, count = np.unique(segment * span + words[at], return_inverse=True, return_counts=True)
        often = count[group] >= times
        whole = np.bincount(segment, ~often) == 0
        stays = whole[segment]
        ends = np.flatnonzero(np.diff(segment[stays], prepend=-1, append=-1))
        still = at[stays]
        found += [(int(still[a]), int(still[b - 1]) + 1) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        at, segment = at[often & ~stays], segment[often & ~stays]
        segment = np.cumsum((np.diff(at, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0)) - 1
        long = np.bincount(segment, minlength=1)[segment] >= least if len(at) else at > 0
        at, segment = at[long], np.unique(segment[long], return_inverse=True)[1]
    return sorted(s for s in found if s[1] - s[0] >= least)


def _differs(w: np.ndarray, p: int, i: int) -> int:
    """The first place from i on that differs from the one p words later."""
    step = max(64, p)
    while i < len(w) - p:
        stop = min(len(w) - p, i + step)
        d = np.flatnonzero(w[i:stop] != w[i + p : stop + p])
        if len(d):
            return i + int(d[0])
        i, step = stop, 2 * step
    return len(w) - p


def _differed(w: np.ndarray, p: int, i: int) -> int:
    """The last place before i that differs from the one p words later, or -1."""
    step = max(64, p)
    while i > 0:
        start = max(0, i - step)
        d = np.flatnonzero(w[start:i] != w[start + p : i + p])
        if len(d):
            return start + int(d[-1])
        i, step = start, 2 * step
    return -1


def lag_scan(w: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment; times is at least 4."""
    n, found = len(w), []
    power = np.cumprod(np.array([1] + [BASE] * n, np.uint64), dtype=np.uint64)
    mixed = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    hashed = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * power[:n], dtype=np.uint64)))
    reach = np.zeros(n, np.int64)  # where the farthest known run over a place ends
    low, top = 1, n // times
    while low <= top:
        lags = np.arange(low, min(top, low + AT_ONCE) + 1)
        pairs = n // lags - 1
        fit = max(1, int(np.searchsorted(np.cumsum(pairs), max(n, AT_ONCE), side="right")))
        lags, pairs = lags[:fit], pairs[:fit]
        p = np.repeat(lags, pairs)
        b = (np.arange(len(p)) - np.repeat(np.cumsum(pairs) - pairs, pairs)) * p
        same = (hashed[b + p] - hashed[b]) * power[p] == hashed[b + 2 * p] - hashed[b + p]
        thrice = np.flatnonzero(same[:-1] & same[1:] & (p[:-1] == p[1:]))
        thrice = thrice[reach[b[thrice]] < b[thrice] + 3 * p[thrice]]
        for i, q in zip(b[thrice].tolist(), p[thrice].tolist(), strict=True):
            # inside a run of a smaller period, which then divides q, or of this one
            if reach[i] >= i + 3 * q:
                continue
            start, end = _differed(w, q, i) + 1, _differs(w, q, i) + q
            if end - start >= max(least, times * q) and reach[start] < end:
                found.append((start, end - start, q))
                reach[start:end] = np.maximum(reach[start:end], end)
        low += fit
    return found


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """One row per document: id, n_words, runs (start, length and period in words, by start and then period) and collapsed,
    its words joined by one space without those that a run repeats after its first period.

    A run is a stretch of words of smallest period p that has max(least, times * p) words or more and that no
    neighbouring word extends. Null text has no words, repeated rows give repeated results, a null id is kept, other
    columns are ignored. A task holds the words of one Arrow batch, of one document at least; there is no shuffle.
    """
    if times < 4:
        raise ValueError("three neighbouring blocks lie within a run only from four periods on")
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Batches) -> Batches:
        for batch in parts:
            texts = [WORD.findall(t or "") for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            first = np.cumsum(sizes) - sizes
            words = pa.array([w for t in texts for w in t], pa.large_string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = [[] for _ in texts]
            for begin, end in segments(words, np.repeat(np.arange(len(texts)), sizes), times, least):
                k = int(np.searchsorted(first, begin, side="right")) - 1
                runs[k] += [(s + begin - int(first[k]), n, p) for s, n, p in lag_scan(words[begin:end], times, least)]
            collapsed = []
            for t, found in zip(texts, runs, strict=True):
                found.sort(key=lambda r: (r[0], r[2]))
                if found:
                    keep = np.ones(len(t), bool)
                    for s, n, p in found:
                        keep[s + p : s + n] = False
                    t = [t[i] for i in np.flatnonzero(keep).tolist()]
                collapsed.append(" ".join(t))
            struct = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(rows, struct), pa.array(collapsed, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA.format(id=kind))
