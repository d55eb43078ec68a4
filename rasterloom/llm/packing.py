"""Order-preserving packing: a dynamic programme chooses window cuts that minimise padding plus truncation penalties.

Each task tokenises its documents in their order and packs them as one stream, block by block. Candidate cuts are the
ends of documents and sentences; a run of windows between two candidates may also be cut inside sentences, at a higher
price each. Because padding is linear in a window's length, the best predecessor of a cut is a sliding-window minimum
of (cost + position), which a monotone queue gives in constant time. There is no shuffle.
"""

from __future__ import annotations

import base64
import json
import os
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches

#: Tokens of a stream that are packed at once; bounds the memory of a task.
BLOCK_TOKENS = 1 << 18
#: Windows in a run between two candidate cuts that cuts inside sentences may divide.
RUN = 3
#: White space so long that the look-ahead of the tokenizer's pattern could run out of stack on it.
LONG = 4096
BLANK = regex.compile(rf"\p{{White_Space}}{{{LONG},}}")

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The byte-level BPE of a public ranks file, with the added tokens of the tokenizer file of the same name, if any."""
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    special, whole = {}, public_tokenizers.path(os.path.splitext(vocabulary)[0] + ".json")
    if os.path.exists(whole):
        with open(whole, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text. A long run of white space is one piece of the pattern, but for its last character where a text
    goes on; it is encoded as such without the pattern, whose stack it would exhaust."""
    if len(text) < LONG:
        return enc.encode(text, allowed_special="all")
    ids, at = [], 0
    for run in BLANK.finditer(text):
        ids += enc.encode(text[at : run.start()], allowed_special="all")
        closed = run.end() == len(text) or any(text.startswith(x, run.end()) for x in enc.special_tokens_set)
        at = run.end() if closed else run.end() - 1
        ids += enc._encode_single_piece(text[run.start() : at])
    return ids + enc.encode(text[at:], allowed_special="all")


def sentence_ends(enc: tiktoken.Encoding) -> np.ndarray:
    """For each id, whether its text ends a sentence or a line."""
    return np.array([enc.decode_single_token_bytes(i).rstrip(b" ").endswith((b".", b"!", b"?", b"\n")) for i in range(enc.n_vocab)])


def _power_steps(where: np.ndarray, window: int) -> dict[int, list[int]]:
    """For each spot, the spots that lie a power of two (at most the window) before it."""
    hits: dict[int, list[int]] = {}
    for k in range(window.bit_length()):
        place = np.searchsorted(where, where - (1 << k))
        for j in np.flatnonzero((where[place] == where - (1 << k)) & (1 << k <= window)).tolist():
            hits.setdefault(j, []).append(int(place[j]))
    return hits


def choose_cuts(spots: np.ndarray, prices: np.ndarray, window: int, inside: float) -> list[int]:
    """Cut positions (ends of windows) of a stream that ends at the last spot, of least total cost.

    spots: increasing candidate positions, the last being the end; prices: the price of a cut there. A window costs its
    padding, nothing if its length is a power of two; a cut inside a sentence costs `inside`. From spot i to spot j up
    to RUN windows may run, all full but the last. A gap longer than that is bridged by full windows from i on, so cuts
    within it are not always those of least cost.
    """
    where = np.concatenate(([0], spots))
    hits = _power_steps(where, window)
    at, price = where.tolist(), [0.0, *prices.tolist()]
    n = len(at)
    cost, key, back = [0.0] * n, [0.0] * n, [0] * n
    runs = [(deque(), m * window, (m + 1) * window, (m + 1) * window + m * inside) for m in range(RUN)]
    heads = [0] * RUN  # the next spot to enter each queue; a queue increases in position and in cost + position
    for j in range(1, n):
        here, best, from_ = at[j], float("inf"), 0
        for m, (queue, near, far, full) in enumerate(runs):
            k, high = heads[m], here - near
            while k < j and at[k] < high:
                x = key[k]
                while queue and key[queue[-1]] >= x:
                    queue.pop()
                queue.append(k)
                k += 1
            heads[m] = k
            while queue and at[queue[0]] < here - far:
                queue.popleft()
            if queue and key[queue[0]] + full < best:
                from_ = queue[0]
                best = key[from_] + full
        best -= here
        for i in hits.get(j, ()):
            if cost[i] < best:
                best, from_ = cost[i], i
        if best == float("inf"):  # a gap without a spot
            from_ = j - 1
            count = -(-(here - at[from_]) // window)
            best = cost[from_] + (count - 1) * inside + count * window - (here - at[from_])
        cost[j], back[j] = best + price[j], from_
        key[j] = cost[j] + here
    cuts, j = [], n - 1
    while j:
        i = back[j]
        cuts += range(at[j], at[i], -window) if (at[j] - at[i]) % window == 0 else [at[j], *range(at[i] + (at[j] - at[i]) // window * window, at[i], -window)]
        j = i
    return cuts[::-1]


def _pack_block(lengths: list[int], ids: np.ndarray, ends: np.ndarray, window: int, sentence: float, inside: float) -> list[tuple]:
    """Pieces (document in the block, start, length, window number, offset) of a block of documents."""
    bounds = np.cumsum(lengths)
    spots = np.union1d(np.flatnonzero(ends[ids]) + 1, bounds)
    prices = np.where(np.isin(spots, bounds), 0.0, sentence)
    cuts = np.array(choose_cuts(spots, prices, window, inside))
    marks = np.union1d(cuts, bounds)
    begins = np.concatenate(([0], marks[:-1]))
    doc = np.searchsorted(bounds, begins, side="right")
    number = np.searchsorted(cuts, begins, side="right")
    first, opened = np.concatenate(([0], bounds[:-1])), np.concatenate(([0], cuts[:-1]))
    return list(zip(doc.tolist(), (begins - first[doc]).tolist(), (marks - begins).tolist(), number.tolist(), (begins - opened[number]).tolist(), begins.tolist(), strict=True))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", window: int = 1024, end_id: int = 0, sentence: float = 1.0, inside: float = 6.0) -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (place in its sequence, gapless from 0).

    A document is its ids and then end_id; the literal of an added token is that token, as in the tokenizer file. Null text counts as empty, so it is end_id alone. Documents keep their order
    in a partition, repeated rows are packed again, other columns are ignored. A sequence holds at most `window` ids;
    shorter ones are padded, except at a power of two. sentence and inside are prices, in padded tokens, of a cut at a
    sentence's end and of one within a sentence; a cut between documents is free. sequence_id is the partition's number
    times 2^33 plus a count. A partition of the empty table gives no rows.
    """
    bound_batches(docs.sparkSession, 4 << 20)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Batches) -> Batches:
        enc = encoding(vocabulary)
        ends = sentence_ends(enc)
        base = TaskContext.get().partitionId() << 33
        held_ids, held, total = [], [], 0
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def flush():
            nonlocal base, held_ids, held, total
            stream = np.concatenate(held)
            lengths = [len(x) for x in held]
            pieces = _pack_block(lengths, stream, ends, window, sentence, inside)
            data = stream.astype("<u4").tobytes()
            out = pa.RecordBatch.from_arrays([
                pa.array([held_ids[p[0]] for p in pieces], kind_of), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([data[4 * p[5] : 4 * (p[5] + p[2])] for p in pieces], pa.binary()), pa.array([lengths[p[0]] for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
            ], names=names)
            base += pieces[-1][3] + 1
            held_ids, held, total = [], [], 0
            return out

        kind_of = None
        for b in parts:
            kind_of = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*token_ids(enc, text or ""), end_id], dtype=np.int64)
                held_ids.append(doc)
                held.append(ids)
                total += len(ids)
                if total >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA.format(id=kind))


