"""Sharding, fingerprints and quality rules against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

from cohortweave.llm import quality, sharding, sketch

SPACES = re.compile(r"[\x09-\x0D\x20]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_shards_are_contiguous_balanced_and_gapless(spark, odd, many_chunks):
    got = sorted(rows(sharding.byte_shards(odd, 3)), key=lambda r: (r["shard"], r["slot"]))
    assert len(got) == odd.count()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= {0, 1, 2}
    for rs in by.values():
        assert [r["slot"] for r in rs] == list(range(len(rs)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd.collect())
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in by.get(s, [])) - total / 3) <= largest for s in range(3))


def test_one_hot_id_is_spread_over_shards(spark, many_chunks):
    df = spark.createDataFrame([(7, "same")] * 400 + [(i, "x" * i) for i in range(20)], "doc_id long, text string")
    got = rows(sharding.byte_shards(df, 16))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == 420 and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 42


def test_empty_tables_give_no_rows(none):
    assert sharding.byte_shards(none).count() == 0
    assert sketch.edited_pairs(none).count() == 0
    assert quality.score_documents(none).count() == 0
    assert quality.keep_good(none).columns == none.columns


def test_edited_texts_and_fingerprints(spark, odd, many_chunks):
    got = rows(sketch.edited_pairs(odd))
    assert len(got) == odd.count()
    pairs = {}
    for i, t, *_ in odd.collect():
        pairs.setdefault(i, []).append(t or "")
    order = sorted((i for i in pairs if i is not None and len(pairs[i]) == 1))
    prints = {r["doc_id"]: r for r in got if r["doc_id"] in order}
    for i in (20, 21):  # their next document is one text for certain
        text, after = pairs[i][0], pairs[i + 1][0]
        take = len(text) // 4
        edited = text[:len(text) - take] + after[:take]
        assert prints[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints[i]["n_chars"] == len(text)
    assert prints[20]["fingerprint"] == prints[21]["fingerprint"] and prints[20]["near_next"] == 1.0
    assert 0.2 < prints[21]["near_next"] < 1.0
    assert prints[24]["fingerprint"] == "" and prints[24]["near_next"] == 1.0  # empty texts are alike
    assert all(0.0 <= r[c] <= 1.0 for r in got for c in ("near_edited", "near_next"))
    # one of the two copies of 28 is followed by the other
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 28)[-1] == 1.0
    # the last document is followed by the first; null ids come first
    assert [r["near_next"] for r in got if r["doc_id"] is None].count(None) == 0


def test_sketch_estimates_jaccard_and_containment(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(1000, 3000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    for c in "ab":
        df = sketch.add_sketch(df, c, f"s{c}")
    r = df.select(sketch.likeness(df.sa, df.sb).alias("j"), sketch.containment(df.sb, df.sa).alias("c"),
                  sketch.merged(df.sa, df.sb).alias("m"), "sa").first()
    assert abs(r["j"] - 0.5) < 0.06 and r["c"] > 0.98
    assert set(r["sa"]) <= set(r["m"])


def test_quality_counts(odd, many_chunks):
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in rows(quality.score_documents(odd))}
    for i, t, *_ in odd.collect():
        ws = words(t)
        r = got[i, len(ws), sum(map(len, ws))]
        windows = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        count = Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if count[w] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert r["n_repeat_words"] == len(covered)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_prose_and_rejects_symbols(spark, docs_schema):
    import random

    from samples import prose

    rng = random.Random(1)
    clean = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{k}" if rng.random() < .4 else w for k, w in
                          enumerate(prose(rng, 200).split())), "en") for i in range(60)]
    junk = [(100, " ".join(w + "$$$%%%" for w in clean[0][1].split()), "en")]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in rows(quality.keep_good(df))}
    assert 100 not in kept and len(kept) == 60
    assert {r["doc_id"] for r in rows(quality.score_documents(df)) if r["kept"]} == kept


def mixed_languages(declared):
    """120 clean texts, half of them English; every `declared`-th says its language."""
    import random

    rng, out = random.Random(3), []
    for i in range(120):
        lang = ("en", "fr", "en", "de", "en", "es")[i % 6]
        text = " ".join(rng.choice(quality.COMMON[lang]) if rng.random() < .4 else
                        "".join(rng.choice("bdlmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400))
        out.append((i, text, lang if declared and i // 6 % declared == 0 else rng.choice([None, "xx"])))
    return out


def test_quality_keeps_clean_texts_without_language(spark):
    junk = (500, " ".join(f"{'the' if k % 2 else 'ba' + 'dlmn'[k % 3] + str(k)}" for k in range(400)), None)
    for declared in (0, 4):
        df = spark.createDataFrame([*mixed_languages(declared), junk], "doc_id long, text string, lang string")
        assert {r["doc_id"] for r in rows(quality.keep_good(df))} == set(range(120)), declared
