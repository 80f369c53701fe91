"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read by a small parser of our own; from it the normaliser, the metaspace marker, the pieces with
their scores (unigram) or the merges that they imply (BPE), and the byte fallback are rebuilt as a ``tokenizers``
pipeline.  Texts are encoded by units (a run of markers and what follows it up to the next), which no piece spans; a
unit's ids are looked up if it was seen before, so that the library gets each new unit once, in multithreaded batches.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, column
from .words import trim

MARK = "▁"
#: Kinds of pieces, and of models, by their numbers in the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Units whose ids are kept for the next text, at most.
CACHE = 400_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message; nested messages and strings as bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = struct.unpack("<d" if kind == 1 else "<f", b[i : i + n])[0], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    charsmap: bytes = b""
    unk_id: int = 0


def parse_model(data: bytes) -> Model:
    """The parts of a model file that encoding needs."""
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def build(m: Model):
    """The model as a ``tokenizers.Tokenizer`` without normaliser (``Encoder`` normalises whole texts)."""
    from tokenizers import Tokenizer, decoders, models

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER, UNUSED)}
        score = {p: s for p, s, _ in m.pieces}
        # every way to join two pieces into a third is a merge; the best scored third goes first, then the left one
        merges = []
        for p in rank:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in rank and b in rank:
                    merges.append((-score[p], rank[p], rank[a], rank[b], a, b))
        merges.sort()
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is not supported")
    t = Tokenizer(model)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Encoder:
    """Encoding and decoding of batches of texts; ids as the model's own library gives them."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import normalizers

        self.model = m = parse_model(data)
        self.tokenizer = build(m)
        self.precompiled = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        mixed = {c for p, _, kind in m.pieces if kind in (NORMAL, USER) and len(p) > 1 for c in p}
        if m.kind == BPE and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER)):
            # characters that stand in no longer piece are borders too
            alone = "".join(c for c in "\n\t\r" if c not in mixed)
            self.unit = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        else:
            self.unit = re.compile(r"(?s).+")
        self.known: dict[str, tuple[int, ...]] = {}
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else (" ⁇ " if kind == UNKNOWN else p.replace(MARK, " ")).encode() for p, _, kind in m.pieces]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def normalise(self, text: str) -> str:
        """The text as the model sees it, with markers for spaces; empty stays empty."""
        m = self.model
        if self.precompiled is not None:
            text = self.precompiled.normalize_str(text)
        if m.remove_extra_whitespaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if m.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape_whitespaces else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for empty or null ones."""
        units = [self.unit.findall(self.normalise(x)) if x else [] for x in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        fresh = list({u for us in units for u in us if u not in known})
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[u] = tuple(e.ids)
        out = []
        for us in units:
            ids: list[int] = []
            for u in us:
                ids += known[u]
            out.append(np.array(ids, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes put together, the added leading space dropped."""
        if not len(ids):
            return ""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - (ends - size), size)
        text = self.bytes[place].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


def verify_parity(data: bytes, texts: list[str]) -> None:
    """Raise if an encoding or a decoding of ``texts`` differs from that of the sentencepiece library."""
    import sentencepiece

    other, own = sentencepiece.SentencePieceProcessor(model_proto=data), Encoder(data)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = other.encode(text)
        if want != ids.tolist():
            raise ValueError(f"ids differ from the model's own library for {text[:80]!r}")
        if other.decode(want) != own.decode(ids):
            raise ValueError(f"decoding differs from the model's own library for {text[:80]!r}")


#: Texts that parity is verified on before any table is encoded.
PARITY = ["", " ", "a", "Hello  world\n x é\U0001f600", "tab\there\r\n\n", "  lead and trail  ", "▁ mark", "\u0001\u0002", "1234.5-6", "你好 مرحبا"]


def read_model(path: str | None = None) -> bytes:
    """The model file; without a path the public 32k model, where it is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, round_trip[, ids]) for each row; with ``keep`` all columns of ``docs`` and the ids.

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers; ``round_trip`` says whether decoding gives the text
    back.  Null texts have no ids, count as empty and give themselves back.  Repeated rows are encoded alike.  An empty
    table gives an empty one.  With ``keep``, columns of ``docs`` that are called as the new ones stay, and the new ones
    get underscores after their names.
    """
    verify_parity(model, PARITY)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if keep else docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    at = source.columns.index(text_col if keep else "text")
    bounded_batches(docs.sparkSession)
    new = ["ids", "round_trip"]
    while keep and {c.lower() for c in docs.columns} & set(new):
        new = [f"{c}_" for c in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                texts = batch.column(at).to_pylist()
                found = enc.encode(texts)
                back = [enc.decode(x) == (t or "") for x, t in zip(found, texts, strict=True)]
                if keep:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(back, pa.bool_())], names=[*batch.schema.names, *new])
                    continue
                cols = [
                    batch.column(0), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string()), pa.array(back, pa.bool_()),
                ]
                names = ["doc_id", "n_ids", "ids_sha256", "round_trip"]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    if keep:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {new[0]} array<int>, {new[1]} boolean"
    else:
        schema = "doc_id long, n_ids long, ids_sha256 string, round_trip boolean" + (", ids array<int>" if ids else "")
    return source.mapInArrow(run, schema)
