"""Language identification by partial matching: frozen per-language byte context trees.

For each language, a tree holds how often each byte followed each context of up to three
bytes. A byte costs its code length: in the longest context that the language's tree knows,
a seen byte has probability count / (total + kinds); else the escape, kinds / (total +
kinds), is paid and the next shorter context codes the byte among those not yet ruled out;
below the empty context all bytes are equal. The statistics don't change while a text is
read, so code lengths of what the trees have seen are worked out once and kept for the languages
that have seen it only; distinct runs of bytes of a batch get theirs for all languages at once.

Bytes are folded first: A-Z to a-z, other ASCII signs to the space.

Training: of the labelled rows of each language a share is drawn by a hash of the id, so
that about SAMPLE documents, and SAMPLE_BYTES of text, a language are learned from at most; these
bounds are the parameters ``sample`` and ``sample_bytes``, and they bound the model. Prediction: whole texts of all rows.

Defined results: an empty table gives no rows, and repeated rows each get theirs; a text that is null or has no letter is ``und`` with score 0, and so is
every text if nothing could be learned; equal code lengths go to the language whose name
sorts first; a result column takes the place of a kept column of the same name. score is
the posterior of the language over SPAN bytes at the text's mean code lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahac.llm.common import column_bytes, ship, small_batches

#: Training documents, and bytes of them, of each language, as drawn on average.
SAMPLE, SAMPLE_BYTES = 2000, 8_000_000
#: Bytes of context at most.
ORDER = 3
#: Code lengths held at a time while texts are read.
WORK = 2_000_000
SPAN = 64
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
PAD = b"   "


def _mask(order: int) -> np.uint32:
    """The bits of a byte and of so many before it."""
    return np.uint32((1 << 8 * (order + 1)) - 1)


def coded(texts: list[bytes]) -> np.ndarray:
    """Every byte of the texts, folded, with the three before it, as one number each."""
    data = np.frombuffer(b"".join([PAD + t for t in texts]).translate(FOLD), dtype=np.uint8).astype(np.uint32)
    own = np.ones(len(data), dtype=bool)
    begins = np.cumsum([len(t) + 3 for t in texts]) - [len(t) + 3 for t in texts]
    for i in range(3):  # the padding is context only
        own[begins + i] = False
    return ((data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:])[own[3:]]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of four folded bytes (three of context, then the byte), and their counts."""
    return np.unique(coded(texts), return_counts=True)


class Sparse:
    """Rows of (language, value) by key; keys that are not there have none."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.starts = np.append(self.starts, len(keys))
        self.lang, self.values = lang[order], np.concatenate([v for _, v in parts]).astype(np.float32)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in keys, languages and values of all rows of keys."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = np.flatnonzero(self.keys[at] == keys)
        first = self.starts[at[here]]
        n = self.starts[at[here] + 1] - first
        place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(here, n), self.lang[place], self.values[place]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.starts, self.lang, self.values))


class Model:
    """Code lengths, in bits, of the bytes that the trees' contexts have seen, and of escapes.

    Both are kept by context (and byte) for those languages only whose tree has it, so the model is as
    large as the trees, whatever the number of languages and of distinct bytes.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        seen: list[list] = [[] for _ in range(ORDER + 1)]
        escapes: list[list] = [[] for _ in range(ORDER + 1)]
        for lang in self.langs:
            codes, n = counts[lang]
            lower_keys, lower = None, None
            for k in range(ORDER + 1):
                keys, which = np.unique(codes & _mask(k), return_inverse=True)
                n_k = np.bincount(which, n, len(keys))
                contexts, first, kinds = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
                owner = np.repeat(np.arange(len(contexts)), kinds)
                both = np.add.reduceat(n_k, first) + kinds
                p = n_k / both[owner]
                ruled_out = np.full(len(keys), 1 / 256) if k == 0 else lower[np.searchsorted(lower_keys, keys & _mask(k - 1))]
                share = np.maximum(1 - np.add.reduceat(ruled_out, first), 1e-12)
                seen[k].append((keys, -np.log2(p)))
                escapes[k].append((contexts, -np.log2(kinds / share / both)))
                lower_keys, lower = keys, p
        self.seen, self.escapes = [Sparse(x) for x in seen], [Sparse(x) for x in escapes]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.seen, *self.escapes))

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code, after the bytes before it, in each language."""
        out = np.full((len(codes), len(self.langs)), 8.0, dtype=np.float32)  # -log2(1 / 256)
        for k in range(ORDER + 1):
            keys = codes & _mask(k)
            place, lang, bits = self.escapes[k].find(keys >> np.uint32(8))
            out[place, lang] += bits
            place, lang, bits = self.seen[k].find(keys)
            out[place, lang] = bits
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) in each language."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        codes = coded(texts)
        starts = (np.cumsum(sizes) - sizes)[full]
        step = max(1, WORK // len(self.langs))
        for lo in range(0, len(codes), step):
            distinct, which = np.unique(codes[lo : lo + step], return_inverse=True)
            first, last = int(np.searchsorted(starts, lo, side="right")) - 1, int(np.searchsorted(starts, lo + step))
            marks = np.maximum(starts[first:last] - lo, 0)
            out[full[first:last]] += np.add.reduceat(self.rows(distinct).astype(np.float64)[which], marks, axis=0)
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        bits = self.lengths([t or b"" for t in texts])
        for t, row in zip(texts, bits):
            if not t or not _LETTER.search(t.decode("utf-8", "replace")):
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            gap = (row - row[best]) * min(1.0, SPAN / len(t))
            names.append(self.langs[best])
            scores.append(float(1 / np.exp2(-gap).sum()))
        return names, scores


def train(labelled: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model of rows doc_id, text, lang (none of them null in text or lang); None if there are none."""
    ship(labelled.sparkSession)
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    share = {r.lang: min(1.0, sample / r.n, sample_bytes / max(r["size"], 1)) for r in sizes}
    if not share:
        return None
    names = sorted(share)
    cut = F.element_at(F.create_map(*[x for k in names for x in (F.lit(k), F.lit(share[k]))]), F.col("lang"))
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < cut).select("lang", F.col("text").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", 4_000_000):
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), column_bytes(batch.column("__text"))):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                codes, n = grams(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    found = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    coding = found.column("lang").combine_chunks().dictionary_encode()
    lang, code, n = coding.indices.to_numpy(), found.column("code").to_numpy().astype(np.uint32), found.column("n").to_numpy().astype(np.float64)
    counts = {k: (code[lang == i], n[lang == i]) for i, k in enumerate(coding.dictionary.to_pylist())}
    return Model({k: (c[o := np.argsort(c)], v[o]) for k, (c, v) in counts.items()}) if counts else None


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred and score for each row of docs, with its kept columns."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", 500_000):
            texts = column_bytes(batch.column("__text"))
            names, scores = sent.value.predict(texts) if sent.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(names), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
