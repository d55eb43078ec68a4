"""Language identification by Bayesian evidence fusion.

Four kinds of evidence: the text's likelihood under hashed byte trigrams of each language, the language that the markup
declares, and the priors of the page's host, its domain and its address suffix, each smoothed towards the next wider one.
The priors and the reliability of declarations come from grouped aggregates over all rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, Memo, bound_batches, fresh, sized, written

LANGUAGES = ("de", "en", "es", "fr")
#: No known language: a uniform likelihood.
OTHER = "und"
#: Hashed trigrams, and labelled texts of each language that the likelihoods are fitted on at most.
SLOTS, SAMPLE = 1 << 14, 2000
#: Trigrams of a text count as at most this much evidence; pseudo-counts of the wider prior; prior of no known language.
EVIDENCE, WIDER, RARE = 60.0, 20.0, 0.01
#: Trigrams of a word that are summed at once, so that a text without spaces needs no more memory than others.
CHUNK = 1 << 12
LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
HIDDEN = re.compile(r"<(script|style)\b", re.I)
CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
ROOT, DECLARED = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible(page: str) -> str:
    """A page's text: a space for each comment, script, style and tag. What is opened and never closed counts as a tag, a `<`
    without any `>` after it as text. No closing mark is looked for again once there is none, so broken pages cost their length."""
    out, at, missing = [], 0, set()
    while True:
        i = page.find("<", at)
        if i < 0:
            return "".join((*out, page[at:]))
        out.append(page[at:i])
        found = HIDDEN.match(page, i)
        name = "-->" if page.startswith("<!--", i) else found[1].lower() if found else None
        if name and name not in missing:
            end = page.find("-->", i + 4) + 3 if name == "-->" else getattr(CLOSED[name].search(page, found.end()), "end", int)()
            if end > i:
                out.append(" ")
                at = end
                continue
            missing.add(name)
        end = page.find(">", i)
        if end < 0:
            return "".join((*out, page[i:]))
        out.append(" ")
        at = end + 1


def declared_language(page: str) -> str | None:
    """The lang attribute of the first html tag."""
    root = ROOT.search(page)
    end = page.find(">", root.end()) if root else -1
    found = DECLARED.search(page, root.end(), end) if end >= 0 else None
    return found[1].lower() if found else None


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()


def trigrams(word: bytes) -> Iterator[list[int]]:
    """Slots of the trigrams of a whole word with a space on both sides, in lists of at most CHUNK."""
    w = b" " + word + b" "
    for at in range(0, len(w) - 2, CHUNK):
        yield [xxhash.xxh64_intdigest(w[i : i + 3]) % SLOTS for i in range(at, min(at + CHUNK, len(w) - 2))]


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, host, suffix) of web pages: text without markup, the html tag's language, the address's host
    and its suffix (last label, and a two-letter first folder). Null pages and addresses give empty values; bad ones too."""
    bound_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def address(url: str | None) -> tuple[str, str]:
        try:
            parts = urlsplit(url or "")
            host = (parts.hostname or "").lower()
        except ValueError:
            return "", ""
        folder = parts.path.lstrip("/").split("/")[0].lower()
        return host, host.rpartition(".")[2] + ("/" + folder if len(folder) == 2 and folder.isalpha() else "")

    def run(parts: Batches) -> Batches:
        for b in parts:
            texts, declared, hosts, suffixes = [], [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                page = page or ""
                declared.append(declared_language(page))
                texts.append(html.unescape(visible(page)))
                host, suffix = address(url)
                hosts.append(host)
                suffixes.append(suffix)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(declared, pa.string()), pa.array(hosts, pa.string()), pa.array(suffixes, pa.string())], names=["id", "text", "declared", "host", "suffix"])

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, text string, declared string, host string, suffix string")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """log P(trigram slot | language), languages x slots, from at most `sample` labelled texts a language (smallest id hashes)."""
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id is not null")
    picked = None
    for lang in languages:
        part = known.where(F.col("lang") == lang).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(picked), ["id", "lang"]).select("lang", "text")

    def run(parts: Batches) -> Batches:
        counts: Counter[tuple[str, int]] = Counter()
        for b in parts:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, k in Counter(words_of(text or "")).items():
                    for slots in trigrams(word):
                        for s in slots:
                            counts[lang, s] += k
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["lang", "slot", "n"])

    table = np.full((len(languages), SLOTS), 0.5)
    for lang, slot, n in texts.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect():
        table[languages.index(lang), slot] += n
    return np.log(table / table.sum(axis=1, keepdims=True))


def identify(rows: DataFrame, likelihoods: np.ndarray, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(id, lang, confidence, n_words, posterior array) of (id, text, declared, host, suffix) rows; text is read whole.

    The text's log-likelihood is scaled so that its trigrams weigh at most EVIDENCE ones; the class `und` gives every
    slot the same probability. Texts without words rest on declaration and priors. Hosts are smoothed towards their
    domain (last two labels), domains towards the suffix, suffixes towards all rows, each without the row itself. Null
    or empty declarations and hosts are values like any other, so a hot host is one group of a partial aggregation.
    """
    bound_batches(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    classes = (*languages, OTHER)
    table = np.vstack((likelihoods, np.full((1, SLOTS), -np.log(SLOTS)))).T.copy()
    held = rows.sparkSession.sparkContext.broadcast(table)  # languages x slots

    def read(parts: Batches) -> Batches:
        logs = held.value

        def of_word(word: bytes) -> tuple[np.ndarray, int]:
            parts = [(logs[slots].sum(axis=0), len(slots)) for slots in trigrams(word)]
            return parts[0] if len(parts) == 1 else (sum(p for p, _ in parts), sum(n for _, n in parts))

        words = Memo(of_word)
        for b in parts:
            out, sizes = [], []
            for text in b.column(1).to_pylist():
                total, n, size = np.zeros(len(classes)), 0, 0
                for word, k in Counter(words_of(text or "")).items():
                    x, m = words[word]
                    total, n, size = total + k * x, n + k * m, size + k
                out.append((total * min(1.0, EVIDENCE / max(1, n))).tolist())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), *b.columns[2:]], names=["id", "logs", "n_words", "declared", "host", "suffix"])

    seen = rows.select("id", "text", "declared", "host", "suffix").mapInArrow(read, f"id {kind}, logs array<double>, n_words long, declared string, host string, suffix string")
    declared = F.lower(F.coalesce("declared", F.lit("")))
    seen = seen.withColumns({"declared": F.when(declared.isin(*languages), declared).when(declared == "", "-").otherwise(OTHER), "host": F.coalesce("host", F.lit("")), "suffix": F.coalesce("suffix", F.lit(""))})
    seen = seen.withColumn("domain", F.substring_index("host", ".", -2))
    likely = lambda logs: F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    scaled = lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda a, z: a + z))
    start = F.array(*[F.lit(RARE if c == OTHER else (1 - RARE) / len(languages)) for c in classes])
    seen = seen.withColumn("soft", scaled(F.zip_with(likely(F.col("logs")), start, lambda a, p: a * p)))
    seen = written(seen, "evidence")
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(len(classes))]
    of = lambda n: F.array(*[F.col(f"s{i}") for i in range(len(classes))]).alias(n)
    grouped = lambda keys, n: written(seen.groupBy(*keys).agg(*sums).select(*keys, of(n)), n)
    everything = [x or 0.0 for x in seen.agg(*sums).first()]
    trust = np.full((len(classes), len(languages) + 2), 0.5)  # classes x what is declared
    said = [*languages, OTHER, "-"]
    for r in seen.groupBy("declared").agg(*sums).collect():  # a row for each language, unknown and none
        trust[:, said.index(r["declared"])] += [r[f"s{i}"] for i in range(len(classes))]
    trust /= trust.sum(axis=1, keepdims=True)
    base = np.array(everything) + 1
    wide = F.array(*[F.lit(float(x)) for x in base / base.sum()])
    narrow = lambda counts, prior: scaled(F.zip_with(F.zip_with(counts, F.col("soft"), lambda n, s: F.greatest(n - s, F.lit(0.0))), prior, lambda n, p: n + WIDER * p))
    told = F.create_map(*[x for j, d in enumerate(said) for x in (F.lit(d), F.array(*[F.lit(float(np.log(trust[i, j]))) for i in range(len(classes))]))])
    # hosts meet their domains and suffixes first, a row a host; the rows then meet their host in one join, by broadcast or else
    # in one whose hot keys Spark can split
    hosts = grouped(["suffix", "domain", "host"], "of_host").join(sized(grouped(["suffix", "domain"], "of_domain"), 4 << 20), ["suffix", "domain"]).join(sized(grouped(["suffix"], "of_suffix"), 4 << 20), "suffix")
    out = seen.join(sized(written(hosts, "hosts")), ["suffix", "domain", "host"])
    out = out.withColumn("prior", narrow(F.col("of_suffix"), wide))
    out = out.withColumn("prior", narrow(F.col("of_domain"), F.col("prior")))
    out = out.withColumn("prior", narrow(F.col("of_host"), F.col("prior")))
    out = out.withColumn("logs", F.zip_with(F.zip_with("logs", told[F.col("declared")], lambda a, b: a + b), F.transform("prior", lambda p: F.ln(F.greatest(p, F.lit(1e-12)))), lambda a, b: a + b))
    out = out.withColumn("posterior", scaled(likely(F.col("logs")))).withColumn("confidence", F.array_max("posterior"))
    named = F.array(*[F.lit(c) for c in classes])
    return out.select("id", F.element_at(named, F.array_position("posterior", F.col("confidence")).cast("int")).alias("lang"), "confidence", "n_words", "posterior")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least `least`, columns as before.

    The language column stands for the declaration and the source for the host. Documents whose id is null or repeats
    are judged together: they stay if one of them does.
    """
    key = fresh(docs, "identified")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("declared"), F.col(source_col).alias("host"), F.lit("").alias("suffix"))
    found = identify(rows, train(docs, id_col, text_col, lang_col))
    bad = found.groupBy("id").agg(F.max(F.when((F.col("lang") != OTHER) & (F.col("confidence") >= least), 1).otherwise(0)).alias("good")).where("good = 0").select(F.col("id").alias(key))
    return docs.join(sized(written(bad, "unidentified")), docs[id_col].eqNullSafe(F.col(key)), "left_anti")
