"""SentencePiece encoding and decoding with the tokenizers library as the engine.

The model's protobuf is parsed and rebuilt as a tokenizer: normaliser, metaspace marker, unigram scores
or BPE merges, byte fallback and decoder. Texts are encoded by cached chunks that no piece crosses; new
chunks go through encode_batch, on as many threads as RAYON_NUM_THREADS allows (one a task by default),
and each is compared with the SentencePiece library's own ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.chunks import ChunkCache, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the protobuf
UNIGRAM, BPE = 1, 2
BLOCK, AT_ONCE = 200, 1 << 20


def parse_model(data: bytes):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    return model


def merges_of(vocab: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """Every way to make a piece of two, best score first and then by the parts' ids."""
    found = []
    for piece, score in scores.items():
        for i in range(1, len(piece)):
            a, b = piece[:i], piece[i:]
            if a in scores and b in scores:
                found.append((-score, vocab[a], vocab[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(data: bytes):
    """The model as a tokenizers.Tokenizer. User-defined pieces and other model types are refused."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    proto = parse_model(data)
    if any(p.type == USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    # no text can hold a control piece: its name is put out of reach
    names = [f"￿{p.piece}" if p.type in (CONTROL, UNUSED) else p.piece for p in proto.pieces]
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    fallback = proto.trainer_spec.byte_fallback
    if proto.trainer_spec.model_type == UNIGRAM:
        model = models.Unigram([(n, p.score) for n, p in zip(names, proto.pieces)], unknown, fallback)
    elif proto.trainer_spec.model_type == BPE:
        vocab = {n: i for i, n in enumerate(names)}
        scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        model = models.BPE(vocab, merges_of(vocab, scores), unk_token=names[unknown], fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer, spec, steps = Tokenizer(model), proto.normalizer_spec, []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                          + [decoders.Strip(" ", 1, 0)] * spec.add_dummy_prefix)
    return tokenizer


class Codec:
    """Encodes and decodes with one model; one a worker process."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        proto = parse_model(data)
        self.whole, self.blocks = rebuild(data), rebuild(data)
        self.blocks.normalizer = None  # chunks are normalised before
        self.check = SentencePieceProcessor(model_proto=data)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        # chunks end before a space, around line feeds and before trailing stops and commas, which is right if
        # no piece goes across; `sticky` characters have a piece together with a stop or comma behind them
        pieces = [p.piece for p in proto.pieces if p.type == NORMAL]
        spec = proto.normalizer_spec
        self.chunked = (not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and self.prefix
                        and proto.trainer_spec.byte_fallback
                        and not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces))
        sticky = re.escape("".join(sorted({c for p in pieces for c in re.findall(r"([^.,])[.,]", p)} | {MARK})))
        self.chunk = re.compile(
            rf"\n| *[^ \n.,]+(?:[.,]+[^ \n.,]+)*(?:(?<=[{sticky}])[.,]+)?| *[.,]+[^ \n]*| +")
        self.unequal: set[str] = set()
        self.cache = ChunkCache(self.learn, 300_000)

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks and how many each has, some at a time, so that the libraries' results take little memory."""
        parts = [self.learn_some(chunks[i:i + 20_000]) for i in range(0, len(chunks), 20_000)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])

    def learn_some(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks; those that SentencePiece encodes otherwise are noted."""
        marked = [c.replace(" ", MARK) for c in chunks]
        blocks = [marked[i:i + BLOCK] for i in range(0, len(marked), BLOCK)]
        coded = self.blocks.encode_batch(blocks, is_pretokenized=True, add_special_tokens=False)
        sizes = np.concatenate([np.bincount(np.array(e.word_ids, np.int64), minlength=len(b)) for b, e in zip(blocks, coded)])
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int64)
        # the library puts a space before each text: take one away, or begin a line and drop its two pieces
        bare = [c[0] != " " or c.isspace() for c in chunks]
        there = self.check.encode(["\n" + c if alone else c[1:] for c, alone in zip(chunks, bare)], num_threads=1)
        skip = len(self.check.encode("\n"))
        there = [o[skip:] if alone else o for o, alone in zip(there, bare)]
        other = np.fromiter(chain.from_iterable(there), np.int64)
        if not np.array_equal(ids, other) or not np.array_equal(sizes, list(map(len, there))):
            own = np.split(ids, np.cumsum(sizes)[:-1])
            self.unequal.update(c for c, i, o in zip(chunks, own, there) if i.tolist() != o)
        return ids, sizes

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Ids and parity of each text."""
        if not self.chunked:
            own = self.check.encode(texts, num_threads=1)
            ids = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            return [(np.array(i, np.uint32), i == o) for i, o in zip(ids, own)]
        chunks = [self.chunk.findall(" " + t if t else t) for t in texts]
        ids = list(self.cache.texts(chunks))
        return [(i, not self.unequal or self.unequal.isdisjoint(c)) for i, c in zip(ids, chunks)]


class Decoder:
    """The bytes of each piece; byte pieces put characters together again."""

    def __init__(self, data: bytes):
        proto = parse_model(data)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.table = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type in (CONTROL, UNUSED)
                      else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
                      for p in proto.pieces]

        self.sizes = np.array([len(b) for b in self.table], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.table), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        return self.bytes[np.repeat(self.starts[ids] - (upto - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that stand one after the other; `ends` says where each text's ids end."""
        told = b"".join(self.joined(ids[i:i + AT_ONCE]) for i in range(0, len(ids), AT_ONCE))
        cut = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends].tolist()
        texts = [told[a:b].decode(errors="replace") for a, b in zip([0, *cut], cut)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
    with open(path, "rb") as f:
        return Codec(f.read())


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    with open(path, "rb") as f:
        return Decoder(f.read())


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array<int>), ids_crc32 (of little-endian 32-bit ids) and parity for every row.

    `model` is the path of the model's file on every machine. Null text is encoded as empty: no ids.
    Null ids and repeated rows are rows like others. An empty table gives no rows. Other columns are
    not read. `parity` says that SentencePiece gives the same ids, chunk by chunk.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())),
                        ("ids_crc32", pa.int64()), ("parity", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for rows in slices(batches, 1, 1 << 20):
            coded = coder.encode([t for _, t in rows])
            flat = [i.astype("<u4") for i, _ in coded]
            ends = np.cumsum([0, *map(len, flat)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string()), ids,
                 pa.array([zlib.crc32(f.tobytes()) for f in flat], pa.int64()), pa.array([p for _, p in coded])],
                schema=schema)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text string, ids array<int>, ids_crc32 long, parity boolean")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """`encode_texts()` rows plus decoded, the text of their ids. Null ids give null."""
    names = ["doc_id", "text", "ids", "ids_crc32", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = decoder(model)
        for whole, start in ((b, i) for b in batches for i in range(0, b.num_rows, 50)):
            b = whole.slice(start, 50)
            ids = b.column("ids")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            texts = coder.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends)
            decoded = [t if there else None for t, there in zip(texts, ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(decoded, pa.string())],
                                             names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(
        run, "doc_id long, text string, ids array<int>, ids_crc32 long, parity boolean, decoded string")
