"""Alignment and pair counts against whole-text encoding and a plain count."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cohortweave.llm import alignment, spill

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "\n", "\n\n", " \n x", "x \n", "x\t", "a\x1cb c", "a \x1c b", "!\x1c ?", "▁", "a ▁b", "a▁ b", "<|endoftext|>", "a<|endoftext|> <s> </s> <unk> <0x41>",
       "don't  stop…  now", "x\r\ny\n\n  z", "　wide　 space line", "日本語 テキスト\nです", "naïve ﬁ \U0001F600\U0001F600 é", "\x00nul\x00 x", "tab\t\tx \t y", "a  b   c", "....", "a.b,c , d .", "﻿bom"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.Aligner(A, B)


def brute(docs, libraries):
    a, b, own = libraries
    count, per = Counter(), []
    for d, t in docs:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [[table[i] for i in x] for x, table in zip(ids, (own.bytes_a, own.bytes_b))]
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(p) != whole for p in parts):
            per.append((d, 0, 0, [], []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        at = {e: j for j, e in enumerate(ends[1])}
        links, groups, i0, j0 = [], [], 0, 0
        for i, e in enumerate(ends[0]):
            if e in at:
                j = at[e]
                links.append((ids[1][j], ids[0][i]))
                groups.append(",".join(map(str, ids[0][i0:i + 1])) + "|" + ",".join(map(str, ids[1][j0:j + 1])))
                i0, j0 = i + 1, j + 1
        count.update(links)
        per.append((d, len(ids[0]), len(ids[1]), groups, links))
    most = {}
    for (side, _), c in count.items():
        most[side] = max(most.get(side, 0), c)
    return sorted(((d, na, nb, len(g), len(ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
                    sum(count[x] == most[x[0]] for x in ls), sum(count[x] for x in ls)) for d, na, nb, g, ls in per), key=str)


def texts(seed, n=400):
    rng = random.Random(seed)
    bits = [" ", " ", " ", "  ", "\n", "\t", "\x1c", " ", ".", ",", "'s", "the", "of", "Straße", "xyz", "12", "日本", "▁", "!", "\r\n", "<s>", "é", "\x85", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_pieces_are_cut_where_both_tokenizers_end(libraries):
    a, b, own = libraries
    assert own.cuts
    for t in [x for x in ODD if x] + texts(1, 3000):
        pieces = own.cut(t)
        assert "".join(pieces) == " " + t
        (x, _), (y, _) = own.encode(pieces)
        assert x.tolist() == a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        if alignment.MARK not in t:  # its bytes do not agree, so the text counts as one without tokens
            assert y.tolist() == b.encode(t), repr(t)


@pytest.mark.parametrize("buckets", [None, 3])
def test_counts_equal_a_plain_count(spark, many_chunks, libraries, buckets):
    docs = [(i, t) for i, t in enumerate(ODD + texts(2) + ["the river and the sea " * 4000])] + [(3, "same text, same id"), (3, "same text, same id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_a long, row string").repartition(5)
    got = alignment.align_documents(df, A, B, buckets=buckets)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, libraries)


def test_runs_are_merged_in_steps(monkeypatch):
    monkeypatch.setattr(spill, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    writer, runs, count = spill.RunWriter(4, ["doc"]), [], Counter()
    links = [spill.pair_codes(rng.integers(0, 30, n), rng.integers(0, 50, n)) for n in rng.integers(0, 60, 200)]
    for i, pairs in enumerate(links):
        count.update(pairs.tolist())
        writer.add(i, (i,), pairs)
        if i % 9 == 8:
            runs.append(writer.rows())
    runs.append(writer.rows())
    most = {}
    for p, c in count.items():
        most[p >> spill.ID_BITS] = max(most.get(p >> spill.ID_BITS, 0), c)
    heads = sorted((b, again, run, head) for again in (False, True) for rows in runs for run, b, head, _, _ in rows if b >= 0)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict(dict(zip(("bucket", "again", "run", "head"), map(list, zip(*heads)))))
    answers = {}
    for out in spill.count_and_answer(iter([batch.slice(0, 5), batch.slice(5)])):
        for run, b, answer in zip(*(c.to_pylist() for c in out.columns)):
            answers.setdefault(run, []).append((b, answer))
    at = 0
    for rows in runs:
        run, _, _, records, docs = rows[0]
        n = pa.ipc.open_stream(docs).read_all().num_rows
        n_best, total = spill.settle(records, [a for _, a in sorted(answers.get(run, []))], n)
        for k in range(n):
            own = links[at + k].tolist()
            assert total[k] == sum(count[p] for p in own)
            assert n_best[k] == sum(count[p] == most[p >> spill.ID_BITS] for p in own)
        at += n
    assert at == 200


def test_no_documents(spark, none):
    assert alignment.align_documents(none, A, B).count() == 0
