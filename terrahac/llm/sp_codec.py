"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A chunk of text is merged by an agenda of adjacent symbol pairs: the pair whose joined
piece scores highest goes first, of equal scores the leftmost; what is not in the
vocabulary at the end falls back to byte pieces. Texts are first cut where no piece of the
vocabulary can reach across (before a run of spaces, around a newline, between a letter and
a sign that follows no letter in any piece), which changes no result and lets equal chunks
share their work. The rules about cuts are read from the vocabulary, not assumed.

Defined results: null and empty texts have no ids and decode to the empty text; repeated
rows each get their result; an empty table gives no rows; bytes that are no UTF-8 are read as
U+FFFD; extra columns pass through only if asked for by ``keep``; a result column takes the place of an input column of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terrahac.llm.common import column_bytes, ship, small_batches

MARK = "▁"
INF = float("inf")
#: Ids as text, joined by commas, and the bytes that they decode to.
Entry = tuple[str, bytes]
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


class Codec:
    """Encoder and decoder over the pieces of a model file's bytes."""

    #: Words, and parts of words, kept with their results; a full memory is dropped.
    CACHE = 250_000

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with byte fallback and an identity normaliser are supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: dict[int, bytes] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == p.NORMAL:
                self.ids[p.piece.replace(MARK, " ")] = (i, p.score)
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == p.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (p.USER_DEFINED, p.UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
        self.chunks = self._cuts()
        self.scores = {p: score for p, (_, score) in self.ids.items()}
        self.cache: dict[str, Entry] = {}
        self.words: dict[str, Entry] = {}

    def _cuts(self) -> re.Pattern | None:
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b == " " != a for a, b in pairs) or any("\n" in p for p in pairs):
            return None
        letter = re.compile(f"[{LETTERS}]")
        free = "".join(s for s in SIGNS if not any(b == s and letter.match(a) for a, b in pairs))
        return re.compile(f" *[{LETTERS}]+(?=[{re.escape(free)} \n]|$)| *[^ \n]+|\n| +")

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk whose spaces stand for the mark."""
        known = self.ids
        symbols = self._short(chunk) if len(chunk) <= 24 else self._long(chunk)
        out: list[int] = []
        for s in symbols:
            found = known.get(s)
            out += [found[0]] if found else [self.bytes[x] for x in s.replace(" ", MARK).encode()]
        return out

    def _short(self, chunk: str) -> list[str]:
        """The agenda as a plain list of the pairs' scores beside the symbols, scanned for the best."""
        score = self.scores.get
        symbols = list(chunk)
        agenda = [score(a + b, -INF) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) != -INF:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], -INF)
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], -INF)
        return symbols

    def _long(self, chunk: str) -> list[str]:
        """The agenda as a heap over linked symbols, for n log n steps on chunks of any length."""
        score = self.scores.get
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            piece = symbols[a] + symbols[b]
            if (found := score(piece)) is not None:
                heapq.heappush(agenda, (-found, a, b, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or right[a] != b or len(symbols[a]) + len(symbols[b]) != len(piece):
                continue
            symbols[a], symbols[b] = piece, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [s for s in symbols if s is not None]

    def _chunk(self, chunk: str) -> Entry:
        if (entry := self.cache.get(chunk)) is None:
            ids = self.merge(chunk)
            entry = (",".join(map(str, ids)), b"".join([self.surface[x] for x in ids]))
            if len(chunk) <= 64:
                if len(self.cache) >= self.CACHE:
                    self.cache.clear()
                self.cache[chunk] = entry
        return entry

    def _span(self, span: str) -> Entry:
        found = [self._chunk(x) for x in self.chunks.findall(span)]
        return ",".join([x for x, _ in found]), b"".join([x for _, x in found])

    def digest(self, text: str) -> list[Entry]:
        """For each stretch its ids as text, joined by commas, and what they decode to."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.chunks:
            return [self._chunk(self.prefix + text)]
        if not self.prefix or "  " in text or text[0] == " " or text[-1] == " ":
            return [self._chunk(x) for x in self.chunks.findall(self.prefix + text)]
        words = text.split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            for i, entry in enumerate(found):
                if entry is None:
                    entry = found[i] = self._span(" " + words[i])
                    if len(words[i]) <= 32:
                        if len(self.words) >= self.CACHE:
                            self.words.clear()
                        self.words[words[i]] = entry
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for ids, _ in self.digest(text or "") for x in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.surface[i] for i in ids])
        if self.prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = True, ids: bool = False, check_every: int = 64) -> DataFrame:
    """Encode the whole text of each row and decode the ids again.

    Adds n_tokens, with ``digests`` ids_sha256 and decoded_sha256, with ``ids`` the columns
    ids (array) and decoded. Of each Arrow batch, every ``check_every``-th row is also
    encoded by the sentencepiece library, and a difference is an error; 0 leaves that out.
    """
    ship(docs.sparkSession)
    model_ref = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    made = {f.name for f in fields[len(keep) :]}
    fields = [f for f in fields[: len(keep)] if f.name not in made] + fields[len(keep) :]
    names = [f.name for f in fields if f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_ref.value)
        library = None
        for batch in small_batches(batches, "__text"):
            texts = [x.decode("utf-8", "replace") if x else "" for x in column_bytes(batch.column("__text"))]
            out: dict[str, list] = {k: [] for k in made}
            for row, t in enumerate(texts):
                found = c.digest(t)
                joined = ",".join([x for x, _ in found])
                decoded = b"".join([x for _, x in found])
                if c.prefix and decoded[:1] == b" ":
                    decoded = decoded[1:]
                out["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    out["ids"].append([int(x) for x in joined.split(",")] if joined else [])
                    out["decoded"].append(decoded.decode("utf-8", "replace"))
                if check_every and row % check_every == 0:
                    if library is None:
                        import sentencepiece

                        library = sentencepiece.SentencePieceProcessor(model_proto=model_ref.value)
                    theirs = library.encode(t)
                    if ",".join(map(str, theirs)) != joined or library.decode(theirs).encode() != decoded:
                        raise AssertionError(f"row {row} of a batch differs from the sentencepiece library")
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) if n not in made else pa.array(out[n], pa.list_(pa.int32()) if n == "ids" else pa.int64() if n == "n_tokens" else pa.string()) for n in [*names, *[f.name for f in fields if f.name in made]]],
                names=[f.name for f in fields],
            )

    from pyspark.sql import functions as F

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(run, T.StructType(fields))
