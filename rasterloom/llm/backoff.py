"""Language-model scoring by a weighted backoff automaton whose size follows the corpus.

States are the last two tokens (or starts of a text), the last token, and an empty state; a state exists if training
texts pass it. It has an arc for each token seen there in training; for any other token its failure arc leads to the
state that is one token shorter, and the empty state has an arc for each known token and one for unknown ones. Weights
are log10 probabilities: Dirichlet-smoothed trigrams over bigrams over absolutely discounted unigrams, so the arcs and
failures of a state sum to one over known tokens and one unknown.

The automaton is never gathered in one place. Each block of documents asks for the counts of the tokens, bigrams and
trigrams that it holds: sorted 64-bit keys go to key ranges, are summed there over all blocks, and the sums return in the
same order. The block then traverses its texts with its own slice of the automaton; texts never go to the key ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches, byte_texts

#: Bytes of text in a block, and bytes of text whose keys one key range answers for on average.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Kinds of counts: tokens, and tokens after one and after two others.
WORDS, PAIRS, TRIPLES = 0, 1, 2
#: Low bits of the keys of pairs and triples that are left out, which makes their rows smaller; 56 bits stay.
SHORT = np.uint64(0xFF)
#: The tokens that end and start a text; words cannot be empty or hold a space.
END, START = b"", b" "
#: Weight of the unigrams in states of one token, and of the bigrams in states of two, in observations of the state.
STRENGTH = (400.0, 4.0)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of token pairs from the tokens' keys; of triples from the keys of a pair and a token."""
    k = first * np.uint64(0x9E3779B97F4A7C15) + second
    k ^= k >> np.uint64(31)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the distinct tokens, every token of the texts as its place there, and tokens (with the end) a text."""
    seen: dict[bytes, int] = {END: 0}
    place, flat, lengths = seen.setdefault, [], []
    for t in texts:
        words = t.lower().split()
        flat.append(np.array([place(w, len(seen)) for w in words] + [0], dtype=np.int32))
        lengths.append(len(words) + 1)
    digest = xxhash.xxh64_intdigest
    keys = np.fromiter((digest(w) for w in seen), np.uint64, len(seen))
    order = np.argsort(keys)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return keys[order], rank[np.concatenate(flat)], np.array(lengths)


def _grams(keys: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every token with the one before it, and with the two before it; starts stand before a text."""
    own, start = keys[tokens], np.uint64(xxhash.xxh64_intdigest(START))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    before = np.roll(own, 1)
    before[first] = start
    pairs = pair_keys(before, own)
    two_before = np.roll(pairs, 1)
    two_before[first] = pair_keys(np.array([start]), np.array([start]))[0]
    return pairs & ~SHORT, pair_keys(two_before, own) & ~SHORT


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each key range begins among sorted keys, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))


def _blocks(parts: Batches):
    """(block, ids, training flags, texts) of documents (id, text, held), BLOCK_BYTES of text or one row of a batch at once."""
    waiting, size, number = [], 0, 0

    def made():
        block = (TaskContext.get().partitionId() << 32) + number
        trains = ~np.array([x for b in waiting for x in b.column(2).to_pylist()], dtype=bool)
        return block, pa.chunked_array([b.column(0) for b in waiting]), trains, [t for b in waiting for t in byte_texts(b.column(1))]

    for b in parts:
        if b.num_rows:
            waiting.append(b)
            size += b.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield made()
            waiting, size, number = [], 0, number + 1
    if waiting:
        yield made()


def _digest(keys: np.ndarray) -> int:
    """Of a block's list of tokens; it goes with the block's number, so that blocks of documents in another order never meet."""
    return int(np.uint64(xxhash.xxh64_intdigest(keys.tobytes())).view(np.int64))


def _asked(docs: DataFrame, buckets: int, kinds: tuple[int, ...]) -> DataFrame:
    """What each block of documents asks of the key ranges: (bucket, kind, block, digest, keys, counts in its training texts)."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(parts: Batches) -> Batches:
        for block, _, trains, texts in _blocks(parts):
            keys, tokens, lengths = _tokens(texts)
            of_text, digest = np.repeat(trains, lengths), _digest(keys)
            for kind in kinds:
                if kind == WORDS:
                    ask, counts = keys, np.bincount(tokens[of_text], minlength=len(keys))
                else:
                    ask, at = np.unique(_grams(keys, tokens, lengths)[kind - PAIRS], return_inverse=True)
                    counts = np.bincount(at[of_text], minlength=len(ask))
                    del at
                cuts, out = _ranges(ask, buckets), []
                for r in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[r], cuts[r + 1])
                    out.append({"bucket": int(r), "kind": kind, "block": block, "digest": digest, "keys": _packed(np.diff(ask[part], prepend=np.uint64(0))), "counts": _packed(counts[part].astype(np.int64))})
                for at in range(0, len(out), 64):
                    yield pa.RecordBatch.from_pylist(out[at : at + 64], schema=schema)

    return docs.mapInArrow(run, "bucket int, kind int, block long, digest long, keys binary, counts binary")


def _texts(docs: DataFrame, rows_a_batch: int = 256) -> DataFrame:
    """The documents of each block as places in its list of tokens: (block, digest of that list, id, held, tokens)."""
    kind = docs.schema["id"].dataType

    def run(parts: Batches) -> Batches:
        for block, ids, trains, texts in _blocks(parts):
            keys, tokens, lengths = _tokens(texts)
            digest, ends, ids = _digest(keys), np.cumsum(lengths), ids.combine_chunks()
            for at in range(0, len(lengths), rows_a_batch):
                some = range(at, min(at + rows_a_batch, len(lengths)))
                held = [_packed(tokens[ends[i] - lengths[i] : ends[i]]) for i in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([digest] * n, pa.int64()), ids.slice(at, n), pa.array(~trains[at : at + n]), pa.array(held, pa.binary())], names=["block", "digest", "id", "held", "tokens"])
            steps = _packed(np.diff(keys, prepend=np.uint64(0)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([digest], pa.int64()), pa.nulls(1, ids.type), pa.nulls(1, pa.bool_()), pa.array([steps], pa.binary())], names=["block", "digest", "id", "held", "tokens"])

    return docs.mapInArrow(run, f"block long, digest long, id {kind.simpleString()}, held boolean, tokens binary")


def _summed(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts (64 bits) of the distinct keys of a range over all blocks, and for each row the places of its keys among them."""
    keys = [np.cumsum(_unpacked(r["keys"], "u8"), dtype=np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts, ends = np.zeros(len(distinct), np.int64), np.cumsum([0, *map(len, keys)])
    places = [at[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for r, place in zip(rows, places, strict=True):
        counts[place] += _unpacked(r["counts"], "i8")  # the keys of a row are distinct
    return counts, places


def token_totals(docs: DataFrame, buckets: int) -> dict[str, int]:
    """Of the training texts: tokens, distinct tokens, and how many of these occur once and twice. docs: id, text, held."""

    def count(table: pa.Table) -> pa.Table:
        counts, _ = _summed(table.select(["keys", "counts"]).to_pylist())
        return pa.table({"n": [int(counts.sum())], "v": [int((counts > 0).sum())], "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())]})

    asked = _asked(docs, buckets, (WORDS,)).select("bucket", "keys", "counts").repartition(buckets, "bucket")
    sums = asked.groupBy("bucket").applyInArrow(count, "n long, v long, once long, twice long")
    return {k: x or 0 for k, x in sums.agg(*[F.sum(c).alias(c) for c in ("n", "v", "once", "twice")]).first().asDict().items()}


def unigram_model(totals: dict[str, int]) -> tuple[float, float]:
    """Discount of known tokens, and the probability of each in the smooth part (known tokens and one unknown share it)."""
    discount = totals["once"] / (totals["once"] + 2 * totals["twice"]) if totals["once"] else 0.5
    spread = discount * totals["v"] / totals["n"] / (totals["v"] + 1) if totals["n"] else 1.0
    return discount, spread


def traverse(tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, starts: int, totals: dict[str, int], strength: tuple[float, float]) -> dict[str, np.ndarray]:
    """Sums for each text of a block. words: counts of the distinct tokens; pairs, triples: of each token after what stands before it.

    One pass from left to right, taken for all texts at once: the state is the longest one that exists. Its arc for the
    token adds its weight; without one, the failure arc adds its own and leads to the next shorter state.
    """
    discount, spread = unigram_model(totals)
    n, v = totals["n"], totals["v"]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    c = words[tokens]
    before = lambda x: np.concatenate((x[:1], x[:-1]))
    passed = {1: before(c), 2: before(pairs)}  # how often training texts pass the states of one and two tokens
    for x in passed.values():
        x[first] = starts
    arcs, chance = {1: pairs, 2: triples}, {0: np.maximum(c - discount, 0) / max(n, 1) + spread}
    for order in (1, 2):
        chance[order] = (arcs[order] + strength[order - 1] * chance[order - 1]) / (passed[order] + strength[order - 1])
    weight, state = np.zeros(len(tokens)), np.where(passed[2] > 0, 2, np.where(passed[1] > 0, 1, 0))
    for order in (2, 1):
        here = state == order
        found = here & (arcs[order] > 0)
        weight[found] += np.log10(chance[order][found])
        state[found] = -1
        failed = here & ~found
        weight[failed] += np.log10(strength[order - 1] / (passed[order][failed] + strength[order - 1]))
        state[failed] = order - 1
    last = state == 0
    weight[last] += np.log10(chance[0][last])
    base = np.log10((c + 1) / (n + v + 1))
    add = lambda x: np.add.reduceat(x, first)
    return {"n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(weight)}


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; the model learns from those not held out.

    held_out is a boolean column. Tokens are the words between ASCII white space, A-Z lower-cased, then an end; null
    texts are empty (the end alone). Rows that repeat count each time. Without training texts every token is unknown
    with probability one. `strength` is the weight of the next shorter state, in observations of the state of one and of
    two tokens. Empty tables give no rows. Documents are read three times and must come in the same order each time, as
    rows of files do; else the blocks' digests differ, which raises.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = docs.schema["id"].dataType.simpleString()
    size, starts = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held"))).first()
    buckets = max(1, -(-(size or 0) // RANGE_BYTES))
    totals = token_totals(docs, buckets)

    def answer(table: pa.Table) -> pa.Table:
        """A key range sums what all blocks have, and answers each in its order."""
        rows, out = table.to_pylist(), []
        for what in (WORDS, PAIRS, TRIPLES):
            own = [r for r in rows if r["kind"] == what]
            if own:
                counts, places = _summed(own)
                out += [{"bucket": r["bucket"], "kind": what, "block": r["block"], "digest": r["digest"], "counts": _packed(counts[at])} for r, at in zip(own, places, strict=True)]
        return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("counts", pa.binary())]))

    def score(answers: pa.Table, texts: pa.Table) -> pa.Table:
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        counts = {what: np.concatenate([_unpacked(r["counts"], "i8") for r in rows if r["kind"] == what] or [np.empty(0, np.int64)]) for what in (WORDS, PAIRS, TRIPLES)}
        is_list = pa.compute.is_null(texts.column("held"))
        lists, texts = texts.filter(is_list), texts.filter(pa.compute.invert(is_list))
        keys = np.cumsum(_unpacked(lists.column("tokens")[0].as_py(), "u8"), dtype=np.uint64) if len(lists) else np.empty(0, np.uint64)
        packed = texts.column("tokens").to_pylist()
        own = [_unpacked(x, "i4") for x in packed]
        tokens, lengths = np.concatenate(own), np.array([len(x) for x in own])
        grams = [np.unique(x, return_inverse=True)[1] for x in _grams(keys, tokens, lengths)]
        if len(lists) != 1 or len(keys) != len(counts[WORDS]) or any(len(counts[k]) != at.max() + 1 for k, at in zip((PAIRS, TRIPLES), grams, strict=True)):
            raise ValueError("documents came in another order when read again; write them to files first")
        out = traverse(tokens, lengths, counts[WORDS], counts[PAIRS][grams[0]], counts[TRIPLES][grams[1]], starts, totals, strength)
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held"), "n_tokens": lengths, "n_known": out["n_known"], "train_tokens": np.full(len(lengths), totals["n"]), "base_score": out["base_score"], "score": out["score"]})

    # partitions follow the bytes of text, so that what a task reads does not grow with them
    answered = _asked(docs, buckets, (WORDS, PAIRS, TRIPLES)).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "bucket int, kind int, block long, digest long, counts binary")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    dealt = lambda df: df.repartition(buckets, "block", "digest").groupBy("block", "digest")
    return dealt(answered).cogroup(dealt(_texts(docs))).applyInArrow(score, schema)
