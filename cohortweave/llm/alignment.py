"""Alignment of two tokenizers over whole texts, and how often each token pair ends together.

Texts are cut where both tokenizers must end a token: before a space or line feed that follows a character which
is no white space, and before a punctuation mark that follows a letter or digit, if no piece of the second vocabulary
joins the two. Each distinct piece is encoded and aligned once a cache, and a text is put together from its pieces.
Pairs are counted over the corpus by spilled runs (`spill.py`).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm import spill
from cohortweave.llm.chunks import grown, slices
from cohortweave.session import materialise

MARK = "▁"
BYTE = 6  # fixed value of the protobuf
LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ɏ"  # letters and digits to every tokenizer, whatever its version of Unicode
MARKS = ".,;:!?*$%&#|<>()\""
HELD = 250_000
AT_ONCE, BLOCK = 20_000, 200


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others
    in order from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def cutter(marks: str) -> re.Pattern[str]:
    """Pieces of a text: white space, then characters up to the next cut. A text's last white space is a piece, and
    white space that a tokenizer may not count as such stays inside a piece."""
    word, other = f"[{LETTERS}]*", f"[^\\s{LETTERS}]*"
    on = f"[^\\s{LETTERS}{re.escape(marks)}]"
    run = f"(?=\\S){other}{word}(?:{on}{other}{word})*"
    return re.compile(rf"\s*{run}(?:[^\S \n]\s*{run})*(?:[^\S \n]\s*\Z)?|\s+")


def array_of(values) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class Aligner:
    """Both tokenizers and the pieces aligned so far; one a worker process."""

    def __init__(self, byte_level: str, sentence_pieces: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        with open(sentence_pieces, "rb") as f:
            data = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=data)
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.inner = [array_of([f"{i}," for i in range(len(t))]) for t in (self.bytes_a, self.bytes_b)]
        self.last = [array_of([f"{i}{sign}" for i in range(len(t))]) for t, sign in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        pre, normal = spec.get("pre_tokenizer") or {}, model.normalizer_spec
        written = [p.piece for p in model.pieces if p.type != BYTE]
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not spec.get("normalizer")
                     and normal.add_dummy_prefix and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces
                     and not any("\n" in p or MARK in p.lstrip(MARK) for p in written))
        joined = {c for p in written for c in re.findall(f"(?<=[{LETTERS}])[^{LETTERS}]", p)}
        self.piece = cutter("".join(c for c in MARKS if c not in joined))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.n = self.used = 0
        self.counts = np.zeros((3, 1024), np.int64)  # tokens of a, tokens of b, whether bytes agree
        self.starts, self.sizes, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int64)

    def cut(self, text: str) -> list[str]:
        return (self.piece.findall(" " + text) if self.cuts else [" " + text]) if text else []

    def encode(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both libraries the ids of all pieces and how many each has. The second library puts a space before
        each text: one is taken away, or a line feed comes first and both tokens are dropped again. It takes no
        empty text, so a lone space follows a line feed too."""
        blocks = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)]
        coded = self.a.encode_batch(blocks, is_pretokenized=True, add_special_tokens=False)
        sizes = [np.bincount(np.array(e.word_ids, np.int64), minlength=len(block)) for block, e in zip(blocks, coded)]
        ids_a = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int64)
        bare = [p[0] != " " or p == " " for p in pieces]
        ids = self.b.encode(["\n" + p if alone else p[1:] for p, alone in zip(pieces, bare)], num_threads=1)
        ids = [i[2:] if alone else i for i, alone in zip(ids, bare)]
        return [(ids_a, np.concatenate(sizes)), (np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64))]

    def faithful(self, pieces: list[str], coded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether both tokens' bytes are the piece's own."""
        own = [p.encode() for p in pieces]
        ok = np.ones(len(pieces), bool)
        for (ids, n), table in zip(coded, (self.bytes_a, self.bytes_b)):
            parts, ends = list(map(table.__getitem__, ids.tolist())), np.cumsum(n)
            lengths = np.diff(np.cumsum([0, *map(len, parts)])[np.concatenate([[0], ends])])
            if b"".join(parts) == b"".join(own) and (lengths == list(map(len, own))).all():
                continue  # mostly all agree
            ends = ends.tolist()
            ok &= [b"".join(parts[s:e]) == o for s, e, o in zip([0, *ends], ends, own)]
        return ok

    def align(self, pieces: list[str], coded: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of every piece: whether both tokens' bytes are its own, its groups as text and its number of links; and
        the pair codes of all links in order. Pieces whose bytes differ have none."""
        ok = self.faithful(pieces, coded)
        (flat_a, n_a), (flat_b, n_b) = ((ids[np.repeat(ok, n)], np.where(ok, n, 0)) for ids, n in coded)
        # pieces have the same bytes on both sides, so ends count through all of them
        ends_a, ends_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        at = np.searchsorted(ends_b, ends_a)
        shared = ends_b[at] == ends_a if len(flat_b) else np.zeros(0, bool)
        i, j = np.flatnonzero(shared), at[shared]
        last_b = np.zeros(len(flat_b), bool)
        last_b[j] = True
        # a's tokens of a group, then b's: every token's place is its own number and that of the other side's before it
        text = np.empty(len(flat_a) + len(flat_b), object)
        before_b, upto_a = np.concatenate([[0], j + 1]), i + 1
        place_a = np.arange(len(flat_a)) + before_b[np.cumsum(shared) - shared]
        place_b = np.arange(len(flat_b)) + upto_a[np.cumsum(last_b) - last_b]
        text[place_a] = np.where(shared, self.last[0][flat_a], self.inner[0][flat_a])
        text[place_b] = np.where(last_b, self.last[1][flat_b], self.inner[1][flat_b])
        words, ends = text.tolist(), np.cumsum(n_a + n_b).tolist()
        groups = ["".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends)]
        links = np.bincount(np.repeat(np.arange(len(pieces)), n_a)[i], minlength=len(pieces))
        return ok, groups, links, spill.pair_codes(flat_b[j], flat_a[i])

    def learn(self, pieces: list[str]) -> None:
        coded = self.encode(pieces)
        ok, groups, links, pairs = self.align(pieces, coded)
        size = self.n + len(pieces)
        if size > self.counts.shape[1]:
            self.counts = np.concatenate([self.counts, np.zeros((3, max(size, self.counts.shape[1])), np.int64)], axis=1)
        self.starts, self.sizes, self.flat = grown(self.starts, size), grown(self.sizes, size), grown(self.flat, self.used + len(pairs))
        self.flat[self.used:self.used + len(pairs)] = pairs
        self.counts[:, self.n:size] = [coded[0][1], coded[1][1], ok]
        self.starts[self.n:size], self.sizes[self.n:size] = self.used + np.cumsum(links) - links, links
        self.groups += groups
        self.at.update(zip(pieces, range(self.n, size)))
        self.n, self.used = size, self.used + len(pairs)

    def texts(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, str], np.ndarray]]:
        """(tokens of a, tokens of b, groups, hash of the groups) and the pair code of each link, for each text."""
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut) - self.at.keys()
        if len(self.at) + len(new) > HELD:
            self.clear()
            new = set().union(*cut)
        new = list(new)
        for i in range(0, len(new), AT_ONCE):
            self.learn(new[i:i + AT_ONCE])
        ends = np.cumsum([0, *map(len, cut)])
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(ends[-1]))
        groups = list(map(self.groups.__getitem__, at.tolist()))
        n_a, n_b, good, links = (upto[ends[1:]] - upto[ends[:-1]] for upto in (
            np.concatenate([[0], np.cumsum(x)]) for x in (*self.counts[:, at], self.sizes[at])))
        sizes = self.sizes[at]
        shift = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        pairs = np.split(self.flat[shift + np.arange(len(shift))], np.cumsum(links)[:-1])
        for k, t in enumerate(texts):
            if not t:
                yield NOTHING
            elif good[k] < ends[k + 1] - ends[k]:
                yield self.whole(t)
            else:
                joined = ";".join(groups[ends[k]:ends[k + 1]])
                yield (int(n_a[k]), int(n_b[k]), int(links[k]), hashlib.sha256(joined.encode()).hexdigest()), pairs[k]

    def whole(self, text: str) -> tuple[tuple[int, int, int, str], np.ndarray]:
        """A text with a piece whose bytes do not agree: no tokens, unless the whole text's bytes agree after all."""
        coded = self.encode([" " + text])
        ok, groups, _, pairs = self.align([" " + text], coded)
        if not ok[0]:
            return NOTHING
        return (len(coded[0][0]), len(coded[1][0]), len(pairs), hashlib.sha256(groups[0].encode()).hexdigest()), pairs


NOTHING = (0, 0, 0, ""), np.zeros(0, np.int64)


@lru_cache(maxsize=1)
def aligner(byte_level: str, sentence_pieces: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(byte_level, sentence_pieces)


OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
SCHEMA = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in OWN[1:5]], ("groups_sha256", pa.string()),
                    ("n_best", pa.int64()), ("count_sum", pa.int64())])
SQL_TYPES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def align_documents(docs: DataFrame, byte_level: str, sentence_pieces: str, id_col: str = "doc_id", text_col: str = "text",
                    buckets: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for every row of `docs`.

    Both paths name model files on every machine: a byte-level BPE of the tokenizers library and a SentencePiece
    model with a dummy prefix. Null and empty texts, and texts whose tokens do not give the text back, have zeros
    and an empty hash. Rows of equal ids and null ids stay rows of their own and count each. A very long text is
    one document of its run; its distinct pairs are held at once. An empty table gives no rows. Other columns are
    not read. No token of either vocabulary is empty, so tokens end together one to one.
    """
    spark = docs.sparkSession
    buckets = min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << spill.BUCKET_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = aligner(byte_level, sentence_pieces), spill.RunWriter(buckets, OWN)
        for rows in slices(batches, 2, 1 << 20):
            for (row, doc, _), (told, pairs) in zip(rows, coder.texts([t for _, _, t in rows])):
                n_a, n_b, n, sha = told
                writer.add(row, (doc, n_a, n_b, n, n, sha), pairs)
                if writer.full():
                    yield batch_of_run(writer.rows())
        if writer.docs:
            yield batch_of_run(writer.rows())

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = materialise(slim.mapInArrow(run, spill.RUN_TYPES))
    return spill.streamed_back(runs, SCHEMA, SQL_TYPES)


def batch_of_run(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), spill.RUN_SCHEMA)], schema=spill.RUN_SCHEMA)
