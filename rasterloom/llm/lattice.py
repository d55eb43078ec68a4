"""SentencePiece encoding and decoding as a lattice over words.

Stretches of texts are rows, and Arrow batches of them are cut into words. Of the words that a task does not remember, all
substrings that are pieces are edges (columns of start, length, score and code), found by a join of the letters to the
prefixes of the piece table, a letter further at a time; a fold over the ends keeps the best path to each (Viterbi), for
many words at once. Words stay in the task that reads their text, and one of any length costs its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, bound_batches, byte_texts

#: The mark of a space, and how much worse than the worst piece a byte of an unknown character scores.
SPACE, BYTE_PENALTY = "▁", 10.0
#: Letters of words (one word at least) that meet the lattice at once, and ends of a word whose edges are held at once.
LETTERS, STEP = 1 << 16, 1 << 14
#: Words that a task remembers before it forgets them all, characters of one, and of a text that are a row.
KNOWN, REMEMBERED, STRETCH = 1 << 19, 64, 1 << 16


def pieces(spark: SparkSession, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(piece, id, score, hex) of a model's ordinary and byte pieces; hex is what the piece decodes to, as UTF-8."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    rows = []
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            rows.append((name, i, None, name[3:5]))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rows.append((name, i, sp.get_score(i), name.replace(SPACE, " ").encode().hex().upper()))
    return spark.createDataFrame(rows, "piece string, id int, score double, hex string")


class Trie(NamedTuple):
    """A piece table by prefixes. keys: a prefix's number and the next letter, ascending; to: the longer prefix's number; codes
    (-1: no piece) and scores by number; longest piece; score of a byte of an unknown character; id of byte 0."""

    keys: np.ndarray
    to: np.ndarray
    codes: np.ndarray
    scores: np.ndarray
    longest: int
    byte_score: float
    first_byte: int


def trie(table: DataFrame) -> Trie:
    """The prefixes of a piece table; of equal pieces the best-scoring one counts."""
    rows = table.select("piece", "id", "score").collect()  # the vocabulary is fixed
    best = {r.piece: r for r in sorted((r for r in rows if r.piece and r.score is not None), key=lambda r: (r.score, r.id))}
    numbers = {"": 0}
    for piece in best:
        for k in range(1, len(piece) + 1):
            numbers.setdefault(piece[:k], len(numbers))
    keys = np.array([numbers[p[:-1]] << 21 | ord(p[-1]) for p in numbers if p] + [1 << 62], np.int64)  # one that ends every search
    order = np.argsort(keys)
    codes, scores = np.full(len(numbers), -1, np.int64), np.zeros(len(numbers))
    for piece, r in best.items():
        codes[numbers[piece]], scores[numbers[piece]] = r.id, r.score
    to = np.array([*range(1, len(numbers)), 0], np.int64)[order]
    worst = min((r.score for r in best.values()), default=0.0)
    return Trie(keys[order], to, codes, scores, max(map(len, best), default=1), worst - BYTE_PENALTY, next((r.id for r in rows if r.piece == "<0x00>"), 0))


def byte_count(code: np.ndarray) -> np.ndarray:
    """How many bytes code points take in UTF-8."""
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


def lattice_edges(letters: np.ndarray, room: np.ndarray, at: np.ndarray, table: Trie) -> tuple[np.ndarray, ...]:
    """(start, len, score, code) of every piece that begins at one of the places, and of every character without one.

    letters are code points, room is how many of them a place's word has from there on. Edges of an end come by length.
    code is the piece's id, or -1 minus the character's code point.
    """
    parts, number, size, known = [], np.zeros(len(at), np.int64), 0, np.zeros(len(letters), bool)
    places = at
    while len(at):
        key = number << 21 | letters[at + size]
        k = np.searchsorted(table.keys, key)
        go = table.keys[k] == key
        at, number, size = at[go], table.to[k[go]], size + 1
        piece = table.codes[number] >= 0
        start, met = at[piece], number[piece]
        parts.append((start, np.full(len(start), size), table.scores[met], table.codes[met]))
        if size == 1:
            known[start] = True
            lone = places[~known[places]]
            parts.append((lone, np.ones(len(lone), np.int64), table.byte_score * byte_count(letters[lone]), -1 - letters[lone]))
        more = room[at] > size
        at, number = at[more], number[more]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def best_paths(words_: list[str], table: Trie) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, how many each word has) of the best-scoring pieces of words; ties go to the longer last
    piece. A character without a piece becomes its bytes."""
    sizes = np.array([len(w) for w in words_], np.int64)
    letters = np.frombuffer("".join(words_).encode("utf-32-le"), "<u4").astype(np.int64)
    word, stops = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    place, room = np.arange(len(letters)) - (stops - sizes)[word], stops[word] - np.arange(len(letters))
    best = np.zeros(len(letters) + 1)  # best[i + 1]: of the path to the end of letter i; best[0]: of the empty one
    back, taken = np.zeros(len(letters), np.int32), np.zeros(len(letters), np.int32)
    for low in range(0, int(sizes.max(initial=0)), STEP):
        at = np.flatnonzero((place >= low - table.longest + 1) & (place < low + STEP))
        start, size, score, code = lattice_edges(letters, room, at, table)
        end = start + size - 1
        within = np.flatnonzero((place[end] >= low) & (place[end] < low + STEP))
        order = within[np.argsort(place[end[within]] * len(letters) + end[within], kind="stable")]
        start, size, score, code, end = start[order], size[order], score[order], code[order], end[order]
        source = np.where(place[start] == 0, 0, start)
        firsts = np.flatnonzero(np.diff(end, prepend=-1))  # every letter ends an edge: its own, if no other
        counts = np.diff(firsts, append=len(end))
        steps = [*np.flatnonzero(np.diff(place[end[firsts]], prepend=-1)).tolist(), len(firsts)]
        edge_numbers = np.arange(len(end))
        for a, b in pairwise(steps):  # one end of every word that is long enough
            lo = firsts[a]
            hi = firsts[b] if b < len(firsts) else len(end)
            sums = best[source[lo:hi]] + score[lo:hi]
            top = np.maximum.reduceat(sums, firsts[a:b] - lo)
            chosen = np.maximum.reduceat(np.where(sums == np.repeat(top, counts[a:b]), edge_numbers[lo:hi], -1), firsts[a:b] - lo)
            ends = end[chosen]
            best[ends + 1], back[ends], taken[ends] = top, size[chosen], code[chosen]
    on_path, now = np.zeros(len(letters), bool), (stops - 1)[sizes > 0]
    while len(now):
        on_path[now] = True
        now = now[place[now] >= back[now]]
        now = now - back[now]
    path = np.flatnonzero(on_path)
    ids, of = taken[path].astype(np.int64), word[path]
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        letter = -1 - ids[bare]
        n = byte_count(letter)
        takes = np.ones(len(ids), np.int64)
        takes[bare] = n
        ids, of = np.repeat(ids, takes), np.repeat(of, takes)
        ids[ids < 0] = np.frombuffer("".join(map(chr, letter.tolist())).encode(), np.uint8).astype(np.int64) + table.first_byte
    return ids.astype(np.int32), np.bincount(of, minlength=len(sizes))


def met(words_: list[str], table: Trie) -> Iterator[tuple[str, bytes]]:
    """Words and their ids, as 32-bit integers; LETTERS of them, one word at least, meet the lattice at once."""
    lot, letters = [], 0
    for k, w in enumerate(words_, 1):
        lot.append(w)
        letters += len(w)
        if letters >= LETTERS or k == len(words_):
            ids, counts = best_paths(lot, table)
            data, ends = ids.tobytes(), np.cumsum(4 * counts).tolist()
            yield from ((w, data[a:b]) for w, a, b in zip(lot, [0, *ends[:-1]], ends, strict=True))
            lot, letters = [], 0


class Encoder:
    """Ids of texts by the lattice of their words; remembers short words, and forgets all of them beyond KNOWN."""

    def __init__(self, table: Trie):
        self.table, self.known = table, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, where each text's end) of texts that begin with a space, but for empty ones, which have no words."""
        tails, stops = [], []
        for t in texts:
            tails += word_tails(t)
            stops.append(len(tails))
        if len(self.known) > KNOWN:
            self.known = {}
        fresh = list(set(tails).difference(self.known))
        self.known.update(zip(fresh, (ids for _, ids in met([SPACE + w.replace(" ", SPACE) for w in fresh], self.table)), strict=True))
        rows = [self.known[w] for w in tails]
        for w in fresh:
            if len(w) > REMEMBERED:
                del self.known[w]
        ends = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows))) // 4
        return np.frombuffer(b"".join(rows), np.int32), np.concatenate(([0], ends))[stops]


def word_tails(text: str) -> list[str]:
    """The words of a text that begins with a space, each without its first space: a word begins with its spaces."""
    if not text:
        return []
    parts = text[1:].split(" ")
    if "" not in parts[:-1]:
        return parts
    tails, spaces = [], 0
    for x in parts[:-1]:
        if x:
            tails.append(" " * spaces + x)
            spaces = 0
        else:
            spaces += 1
    return [*tails, " " * spaces + parts[-1]]


def gather(flat: np.ndarray, begins: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """The stretches of flat with these beginnings and lengths, one after another."""
    ends = np.cumsum(takes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - takes), takes)]


def last_word(text: str) -> int:
    """Where the last word of a text begins, that begins with a space: it may go on."""
    body = text.rstrip(" ")
    return len(body) if len(body) < len(text) else len(text[: text.rfind(" ") + 1].rstrip(" "))


def listed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of ids that end where `ends` says."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))


def encode_words(distinct: DataFrame, table: DataFrame) -> DataFrame:
    """(word, ids): the best-scoring pieces of each word; ties go to the longer last piece. A character without a piece becomes its bytes."""
    bound_batches(distinct.sparkSession)
    prefixes = trie(table)

    def run(parts: Batches) -> Batches:
        for batch in parts:
            found = [ids for _, ids in met(batch.column(0).to_pylist(), prefixes)]
            ends = np.cumsum(np.array([len(x) for x in found], np.int64)) // 4
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(np.frombuffer(b"".join(found), np.int32), ends)], names=["word", "ids"])

    return distinct.select("word").where("word is not null").mapInArrow(run, "word string, ids array<int>")


def encode(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids, and the columns of `keep`) of every whole text under the model's piece scores; null counts as empty, which is one space.

    A text's stretches are rows that follow each other in the task that reads it, and the first of them brings the other
    columns; a word that goes on in the next stretch waits for it. There is no shuffle. Repeated and null ids are kept
    apart. An empty table gives no rows. Words of any length are read whole; bytes that are no UTF-8 are read as U+FFFD.
    """
    bound_batches(docs.sparkSession)
    prefixes = trie(table)
    own = docs.select(F.col(id_col).alias("id"), *keep).schema.fields
    first = F.array(F.struct(F.col(id_col).alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep, 1))))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("whole"), first.alias("own"))
    stretches = F.expr(f"transform(sequence(0, int((greatest(length(whole), 1) - 1) div {STRETCH})), k -> substring(whole, k * {STRETCH} + 1, {STRETCH}))")
    spread = rows.select(F.arrays_zip(stretches.alias("part"), "own").alias("parts")).select(F.posexplode("parts").alias("pos", "part")).select("pos", "part.part", "part.own")

    def run(parts: Batches) -> Batches:
        encoder = Encoder(prefixes)
        open_own, open_ids, rest = None, [], ""  # of the text that goes on in the next batch, and its last word so far

        def done(own_: pa.StructArray, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            id_, *others = own_.flatten()
            return pa.RecordBatch.from_arrays([id_, listed(ids, ends), *others], names=[own[0].name, "ids", *(f.name for f in own[1:])])

        for batch in parts:
            if not batch.num_rows:
                continue
            begins = batch.column(0).to_numpy() == 0
            texts = [[rest.encode()]] if open_own is not None else []
            for new, part in zip(begins.tolist(), byte_texts(batch.column(1)), strict=True):
                if new:
                    texts.append([b" "])
                texts[-1].append(part)
            texts = [b"".join(t).decode(errors="replace").replace(SPACE, " ") for t in texts]
            cut = last_word(texts[-1])
            texts[-1], rest = texts[-1][:cut], texts[-1][cut:]
            ids, ends = encoder(texts)
            owns = batch.column(2).filter(pa.array(begins))
            if open_own is not None:
                owns = pa.concat_arrays([open_own, owns])
            if len(texts) > 1:
                whole = np.concatenate([*open_ids, ids[: ends[-2]]])
                yield done(owns.slice(0, len(texts) - 1), whole, ends[:-1] + sum(map(len, open_ids)))
                open_ids = []
            open_own, open_ids = owns.slice(len(texts) - 1), [*open_ids, ids[ends[-2] if len(texts) > 1 else 0 :]]
        if open_own is not None:
            whole = np.concatenate([*open_ids, encoder([rest])[0]])
            yield done(open_own, whole, np.array([len(whole)]))

    return spread.mapInArrow(run, T.StructType([own[0], T.StructField("ids", T.ArrayType(T.IntegerType())), *own[1:]]))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of encode with the text of their ids: each id's bytes looked up, put together; the space before the text is taken off."""
    names = {r.id: bytes.fromhex(r.hex) for r in table.select("id", "hex").collect()}  # the vocabulary is fixed
    top = max(names, default=-1) + 1  # and an id that is none
    sizes = np.array([len(names.get(i, b"")) for i in range(top + 1)], np.int64)
    begins, data = np.cumsum(sizes) - sizes, b"".join(names.get(i, b"") for i in range(top))
    column = encoded.columns.index("ids")

    def run(parts: Batches) -> Batches:
        for batch in parts:
            lists = batch.column(column)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.where((ids < 0) | (ids > top), top, ids)
            out = gather(np.frombuffer(data, np.uint8), begins[ids], sizes[ids]).tobytes()
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes[ids])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            texts = [out[a:b].decode()[1:] if known else None for a, b, known in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
