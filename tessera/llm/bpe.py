"""Byte-level BPE encoding and decoding.

A rank file (base64 token, rank) becomes a sentencepiece BPE model without any
training: each token's bytes are written with one character a byte, its score
is its negative rank and the normaliser is the identity. Texts are cut into
pre-tokens by a pattern; each pre-token is encoded by the model on its own, so
the merges are those of a byte-level BPE with these ranks. Ids are decoded by
the inverse mapping.

Defined results: a null text is an empty text; an empty text has no ids and
decodes to no bytes; a pre-token that is itself a token is that token. Very
long texts are cut into runs of pre-tokens, so memory does not follow their
length. Rows are independent: repeated rows give repeated results, an empty
table gives an empty one, and columns other than the id and the text are not
read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: One character for each byte: U+0100 to U+01FF.
_CHARS = "".join(chr(256 + b) for b in range(256))
#: Units that one worker remembers of each kind, the pre-tokens of a run, and the rows worked on at once.
_MEMORY, _RUN, _ROWS, _CHARS_AT_ONCE = 400_000, 100_000, 2_000, 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The ModelProto: pieces in rank order, then the unknown piece that the format asks for."""
    import struct

    parts = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = codecs.charmap_decode(token, "strict", _CHARS)[0].encode()
        parts.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    parts.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    parts.append(_field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))))
    parts.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(parts)


class ByteBPE:
    """A tokenizer: ``ranks`` must hold all 256 single bytes and number 0..n-1 without gaps."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be 0..n-1 and hold every single byte")
        self.ranks, self.pattern, self.model = ranks, pattern, sentencepiece_model(ranks)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        return cls(read_ranks(path), pattern)

    def worker(self) -> Encoder:
        return Encoder(self.ranks, self.pattern, self.model)


class Encoder:
    """Executor side: sentencepiece over batches of texts, each distinct unit once.

    A unit is a pre-token, or a space and the word after it where a text has no
    space next to other white space (the pattern begins a new pre-token at each
    such space, so these units can be tokenised on their own). Units new to the
    bounded memory are encoded many to a call: their pre-tokens are joined by
    the byte 0xFF, which UTF-8 never holds, as a character that no piece has, so
    no merge crosses it. The memory holds a unit's ids as decimal digits.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        import regex
        import sentencepiece

        self.ranks = ranks
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.unknown = len(tokens)
        self.bytes_of = {str(i): t for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern)
        # The cut is right for patterns whose words take one leading space; others get the whole text.
        self.cuts = all(self.find.findall("a" + x) == self.find.findall("a") + self.find.findall(x) for x in (" b", " 1", " !", " é", " 's"))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = _CHARS[:255] + chr(512)
        self.words: dict[str, str | None] = {}
        self.pieces: dict[str, str | None] = {}

    def _digits(self, pieces: list[str]) -> list[str]:
        """Ids of each pre-token, comma-joined."""
        out, whole, gap = [], self.ranks.get, str(self.unknown)
        for at in range(0, len(pieces), 200):
            part = pieces[at : at + 200]
            joined = "\udcff".join(part).encode("utf-8", "surrogateescape")
            ids = self.model.encode(codecs.charmap_decode(joined, "strict", self.chars)[0])
            out += ",".join(map(str, ids)).split(f",{gap},")
        return [x if "," not in x or (w := whole(p.encode())) is None else str(w) for p, x in zip(pieces, out, strict=True)]

    def _learn(self, memory: dict[str, str | None], units: set[str]) -> None:
        """Make sure that ``memory`` has all ``units``."""
        if units <= memory.keys():
            return
        if len(memory) + len(units) > _MEMORY:
            memory.clear()
        new = list(units - memory.keys())
        if memory is self.pieces:
            memory.update(zip(new, self._digits(new), strict=True))
            return
        bad = [w for w in new if not w or w[0].isspace() or w[-1].isspace()]
        memory.update(dict.fromkeys(bad))
        if bad:
            new = list(set(new).difference(bad))
        if new:
            pieces = self.find.findall(" " + " ".join(new))
            ids = self._digits(pieces)
            starts = [i for i, p in enumerate(pieces) if p[0] == " "]
            memory.update((w, ids[a] if b == a + 1 else ",".join(ids[a:b])) for w, a, b in zip(new, starts, [*starts[1:], len(ids)], strict=True))

    def _whole(self, text: str) -> Iterator[str]:
        found = self.find.finditer(text)
        while part := [m[0] for m in itertools.islice(found, _RUN)]:
            self._learn(self.pieces, set(part))
            yield ",".join(map(self.pieces.__getitem__, part))

    def _cut(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= 8 * _RUN else text.find(" ", at + 8 * _RUN)
            end = len(text) if end < 0 else end
            yield text[at:end].split(" ")
            at = end

    def batch(self, texts: list[str | None]) -> Iterator[Iterable[str]]:
        """For each text its ids as decimal digits, in one or more comma-joined runs."""
        for group in self._groups(texts):
            if len(group[0]) > _CHARS_AT_ONCE:  # alone in its group: run by run, as the caller reads on
                yield self._whole(group[0])
                continue
            cut = [list(self._cut(t)) if self.cuts else [] for t in group]
            self._learn(self.words, {w for runs in cut for run in runs for w in run[1:]})
            found = [[self.find.findall(run[0]) for run in runs] for runs in cut]
            self._learn(self.pieces, {p for runs in found for pieces in runs for p in pieces})
            # Looked up at once: a text encoded as a whole may clear this memory.
            heads = [[[self.pieces[p] for p in pieces] for pieces in runs] for runs in found]
            for text, runs, own in zip(group, cut, heads, strict=True):
                out: list[str] = []
                for (first, *rest), head in zip(runs, own, strict=True):
                    tail = list(map(self.words.__getitem__, rest))
                    if None in tail or first and first[-1].isspace():
                        out = []
                        break
                    out.append(",".join(head + tail))
                yield out or list(self._whole(text))

    def _groups(self, texts: list[str | None]) -> Iterator[list[str]]:
        group, size = [], 0
        for t in texts:
            t = t or ""
            if group and size + len(t) > _CHARS_AT_ONCE:
                yield group
                group, size = [], 0
            group.append(t)
            size += len(t)
        if group:
            yield group

    def encode(self, text: str | None) -> list[int]:
        return next(self.ids([text]))

    def ids(self, texts: list[str | None]) -> Iterator[list[int]]:
        for runs in self.batch(texts):
            yield [int(i) for run in runs if run for i in run.split(",")]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, map(str, ids)))

    def digests(self, runs: Iterable[str]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the joined decimal ids, SHA-256 of the decoded ids."""
        n, a, b = 0, hashlib.sha256(), hashlib.sha256()
        for run in filter(None, runs):
            if n:
                a.update(b",")
            a.update(run.encode())
            ids = run.split(",")
            b.update(b"".join(map(self.bytes_of.__getitem__, ids)))
            n += len(ids)
        return n, a.hexdigest(), b.hexdigest()


def _mapped(df: DataFrame, columns: list[str], bpe: ByteBPE, schema: str, rows, kinds: list[pa.DataType]) -> DataFrame:
    """``rows(encoder, values)`` of each batch's second column; the vocabulary goes out as one broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((bpe.ranks, bpe.pattern, bpe.model))
    names = [columns[0], *[x.split()[0] for x in schema.split(",")]]

    def work(batches):
        enc = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                out = list(rows(enc, part.column(1).to_pylist()))
                values = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, values, kinds)], names=names)

    target = df.select(*columns)
    kind = target.schema[0].dataType.simpleString()
    return target.mapInArrow(work, f"`{columns[0]}` {kind}, {schema}")


def _encoded(enc: Encoder, texts: list[str | None]):
    return ((ids, len(ids)) for ids in enc.ids(texts))


def encode(df: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens) of each whole text."""
    return _mapped(df, [id_col, text_col], bpe, "ids array<int>,n_tokens bigint", _encoded, [pa.list_(pa.int32()), pa.int64()])


def decode(df: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the inverse of ``encode``; null ids decode to no bytes."""
    return _mapped(df, [id_col, ids_col], bpe, "decoded binary", lambda enc, all_ids: ((enc.decode(ids or []),) for ids in all_ids), [pa.binary()])


def round_trip(df: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each whole text in one pass."""
    return _mapped(df, [id_col, text_col], bpe, "n_tokens bigint,ids_sha256 string,decoded_sha256 string", lambda enc, texts: map(enc.digests, enc.batch(texts)), [pa.int64(), pa.string(), pa.string()])


def tokenised(df: DataFrame, bpe: ByteBPE, text_col: str = "text") -> DataFrame:
    """The other columns of ``df`` with ids array<int>, n_tokens and exact (the ids decode to the text's bytes);
    columns that have these names already give way."""
    df = df.drop("ids", "n_tokens", "exact")
    shared = df.sparkSession.sparkContext.broadcast((bpe.ranks, bpe.pattern, bpe.model))
    place, others = df.columns.index(text_col), [c for c in df.columns if c != text_col]

    def work(batches):
        enc = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS // 4):
                part = batch.slice(at, _ROWS // 4)
                texts = part.column(place).to_pylist()
                ids = list(enc.ids(texts))
                exact = [enc.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
                columns = [part.column(i) for i in range(part.num_columns) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(exact)], names=[*others, "ids", "n_tokens", "exact"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.mapInArrow(work, f"{kinds}, ids array<int>, n_tokens bigint, exact boolean")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import table

    bpe = ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(table(spark, sf_dir, "documents"), bpe)
