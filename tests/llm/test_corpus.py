"""Near duplicates, packing and the pipeline against brute force."""

import random
import zlib

import corpus_pipeline
import numpy as np
from cohortweave.llm import ngram_join, packing, quality, queries
from samples import prose


def grams(text, n):
    ws = (text or "").encode().lower().split()
    if len(ws) < n:
        return {b" ".join(ws)} if ws else set()
    return {b" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1)}


def brute(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(rng, n):
    rows = []
    for _ in range(n):
        words = prose(rng, rng.randint(3, 90)).split()
        words = [w + str(rng.randint(0, 400)) for w in words]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "y", "z"])
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, odd, none, many_chunks):
    rows = near_copies(random.Random(2), 70) + [(r.doc_id and r.doc_id + 1000, r.text) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((4, 85), (5, 80)):
        got = sorted((tuple(r) for r in ngram_join.linked_documents(df, n, percent).collect()), key=str)
        assert got == brute(rows, n, percent)
    assert ngram_join.linked_documents(none).count() == 0
    kept = sorted(r.doc_id for r in ngram_join.keep_first(df.where("doc_id < 1000")).collect())
    assert kept == sorted(d for d, _, c in brute([r for r in rows if r[0] is not None and r[0] < 1000], 5, 80) if d == c)


def test_large_groups_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", 400)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a chain: each differs from the one before in a word
        words[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.linked_documents(df, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_sets_of_a_long_chain_do_not_meet_every_block(spark, monkeypatch):
    """A chance chain of signatures grows with the corpus; what a set is sent to must not."""
    monkeypatch.setattr(ngram_join, "GROUP_GRAMS", 400)
    seen, real = [], ngram_join.tree_links
    monkeypatch.setattr(ngram_join, "tree_links", lambda sets, *a: (seen.append(sets.select("row", "part", "blocks").collect()), real(sets, *a))[1])
    rng, words, rows = random.Random(6), [f"w{i}" for i in range(60)], []
    for i in range(240):
        words[i % 60] = f"n{i}"  # the last 60 documents are all that a set can be like
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*rng.sample(words, 8)])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.linked_documents(df, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)
    sent = sum(max(r["blocks"] - 1, 1) for r in seen[0])
    assert sent < 20 * len(rows)  # in blocks of 400 n-grams the chain is 35 blocks in both size classes


def test_no_link_lacks_a_shared_signature():
    rng = random.Random(3)
    for _ in range(150):
        percent, n = rng.choice([60, 80, 85, 95]), rng.randint(1, 70)
        space = rng.randint(n, 300)
        base, sets = rng.sample(range(space), n), []
        for _ in range(8):
            s = set(base)
            for _ in range(rng.randint(0, max(1, n // 5))):
                s ^= {rng.randrange(space)}
            if s:
                sets.append(np.unique(ngram_join.mix(np.array(sorted(s), np.uint64))))
        classes, tree = ngram_join.Classes(percent), ngram_join.PrefixTree(percent)
        signs = [{x for _, found in ngram_join.signatures(s, classes) for x in found.tolist()} for s in sets]
        for s in sets:
            tree.add(s)
        for i, a in enumerate(map(set, (s.tolist() for s in sets))):
            for j, b in enumerate(map(set, (s.tolist() for s in sets[:i]))):
                if 100 * len(a & b) >= percent * len(a | b):
                    assert (a == b or signs[i] & signs[j]) and tree.find(i) == tree.find(j)


def test_plan_places_every_piece_and_is_no_worse_than_best_fit():
    rng = random.Random(1)
    for _ in range(120):
        capacity = rng.choice([10, 30, 100])
        counts = {}
        for _ in range(rng.randint(1, 60)):
            x = rng.randint(1, capacity)
            counts[x] = counts.get(x, 0) + rng.randint(1, 3)
        groups, placed = packing.plan(counts, capacity), {}
        for n, pattern in groups:
            assert sum(x * k for x, k in pattern) <= capacity
            for x, k in pattern:
                placed[x] = placed.get(x, 0) + n * k
        assert placed == counts
        assert sum(n for n, _ in groups) <= sum(n for n, _ in packing.best_fit(dict(counts), capacity))


def optimum(sizes, capacity):
    """Fewest bins, by trying every place for each piece."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1:])
        place(i + 1, [*rooms, capacity - sizes[i]])
    place(0, [])
    return best


def test_fixed_sets_are_part_of_an_optimal_packing():
    rng = random.Random(8)
    for _ in range(150):
        sizes = sorted((rng.randint(3, 20) for _ in range(rng.randint(2, 9))), reverse=True)
        rest = {x: sizes.count(x) for x in sizes}
        fixed = sum(n for n, _ in packing.reduce_dominated(rest, 20))
        left = [x for x, n in sorted(rest.items(), reverse=True) for _ in range(n)]
        assert fixed + optimum(left, 20) == optimum(sizes, 20)


def check_packing(rows, got, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *places], places)) and sum(n for _, n in places) <= capacity
    return len(by), sum(w[3] for w in want)


def test_packed_documents(spark, odd, none, small, many_chunks):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    path = queries.tokenizer_path("word_bpe_49k.json")
    used, tokens = check_packing([tuple(r) for r in docs.collect()], packing.pack_documents(docs, path).collect())
    assert used <= 1.02 * tokens / 4096 + 1
    assert packing.pack_documents(none, path).count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, at = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, small)
        assert at.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in at.collect()})
    all_rows = {r.doc_id: r.text for r in docs.collect()}
    assert all(set(b) <= set(a) for a, b in zip([all_rows, *kept], kept))
    assert sorted(kept[2]) == [d for d, _, c in sorted(brute(list(kept[1].items()), 5, 80)) if d == c]
    final = corpus_pipeline.run(spark, small).collect()
    check_packing(list(kept[2].items()), final)


def test_stages_keep_columns_named_like_their_helpers(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 120), "en", i, "r") for i in range(8)] + [(20, None, "en", 1, "r"), (21, prose(rng, 5), "en", 2, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _rejected long, _row_to_drop string")
    twice = df.unionByName(df.where("doc_id < 3").withColumn("doc_id", df.doc_id + 100))
    good, first = quality.keep_good(twice), ngram_join.keep_first(twice)
    assert good.columns == first.columns == twice.columns
    assert {r["doc_id"] for r in first.collect()} == {r[0] for r in rows}
    assert not {r["doc_id"] for r in good.collect()} & {20, 21}
