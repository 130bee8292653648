"""HTML, WARC, chat, tokenizers, toxicity: round trips, brute force and held-out accuracy."""

import hashlib
import zlib

import numpy as np
import pytest
from cohortweave.llm import chat, html_text, pieces, queries, toxicity, warc
from cohortweave.llm.template import TemplateError, compile_template, fold, parse

PAGES = "page_id long, url string, html string, payload string, size long"


def test_main_text_of_a_page():
    nodes = html_text.train_tree(np.array(html_text.LABELLED))
    table = np.array(html_text.LABELLED, float)
    assert html_text.classify(nodes, table[:, :-1]) == table[:, -1].tolist()
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav>
      <div class="cookie-notice">We use cookies on this site to make it better.</div>
      <article><h1>A title</h1><p><b>First&nbsp;line<br>goes
        on &lt;here&gt; &amp;amp;.<p>Short.<aside>See also these other pages</aside>
      <div class="advert">Buy this thing now, it is cheap.</div><form><label>Name</label><input> Sign up</form><p>Last one.</article>
      <section id="comments"><article><p>I really liked reading this long and good article.</p></article></section>
      <footer>&copy; somebody</footer>"""
    assert html_text.main_text(page, nodes) == "A title\n\nFirst line goes on <here> &amp;.\n\nShort.\n\nLast one."
    assert html_text.main_text("<p", nodes) == html_text.main_text("<!-- x", nodes) == ""


LONG = " ".join(f"word{i}" for i in range(80))


@pytest.mark.parametrize("page", [
    "<article class='post tag-x category-social'><p>{}</article>",
    "<div class='content has-sidebar'><p>{}</div>",
    "<div id='layout-search-enabled'><p>{}</div>",
    "<div class='page-header-fixed'><article><p>{}</article></div>",
    "<div class=sidebar-page><div class=content><p>{}</div></div>",
    "<div class=modal><main><p>{}</main></div>",
    "<article class='post comments-open'><p>{}</article>",
    "<form id=aspnetForm><nav><a href=a>Home</a></nav><p>{}</form>",
    "<form id=form1><div><p>{}</div></form>",
    "<form><div class=content><p>{}</div></form>",
])
def test_main_text_inside_marked_wrappers(page):
    nodes = html_text.train_tree(np.array(html_text.LABELLED))
    assert html_text.main_text("<body>" + page.format(LONG), nodes) == LONG


@pytest.mark.parametrize("page", [
    "<div id=comments class=comments-area><article class=comment-body><p>{}</article></div>",
    "<div class=sidebar><div class=content><p>{}</div></div>", "<article class=comment-body><p>{}</article>",
    "<div class=modal><div class=modal-content><p>{}</div></div>", "<article class='post sponsored'><p>{}</article>",
    "<div style='display:none'><main><p>{}</main></div>", "<nav><article><p>{}</article></nav>",
    "<article><p>{0} {0}</article><form class=contact><p>{0}</form>",
])
def test_side_parts_stay_out(page):
    nodes = html_text.train_tree(np.array(html_text.LABELLED))
    assert html_text.main_text("<body>" + page.format(LONG), nodes) in ("", f"{LONG} {LONG}")


def test_pages_with_odd_rows(spark):
    rows = [(1, None, None, "x", 1), (2, "u", "", None, None), (None, "u", "<article><p>Text.</article>", "x", 1),
            (3, "v", "<article>" + "<p>word</p>" * 20_000, "x", 1), (3, "v", "<article>" + "<p>word</p>" * 20_000, "x", 1)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 5, 119_998, 119_998]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_round_trip(spark):
    same, long = "y" * 150, "<p>" + "ab" * 100_000
    rows = [(5, "u", same, "x", 1), (3, "u\n", same, None, None), (9, None, same, "x", 1), (4, "é", "z" * 99, "x", 1),
            (6, "u", "z" * 99, "x", 1), (7, "u", None, "x", 1), (8, "u", "", "x", 1), (None, "u", same, "x", 1), (1, "u", long, "x", 1),
            (1, "u", long, "x", 1)] + [(100 + i, f"u{i}", f"<html>{i} {hashlib.sha256(str(i).encode()).hexdigest() * 9}", "x", 1) for i in range(1500)]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES))
    records = warc.read_archives(manifest)
    got = {(r.page_id, r.payload_bytes): r for r in warc.restored_payloads(records).collect()}
    assert records.count() == len(rows)
    for i, url, html, *_ in rows:
        data = (html or "").encode()
        r = got[i, len(data)]
        assert bytes(r.payload) == data and r.payload_digest == hashlib.sha256(data).hexdigest()
        assert r.url == (url or "")
        expect = ("revisit", 3) if html == same and i != 3 else ("response", None)
        assert (r.record_type, r.refers_to) == expect
    path = max(manifest.collect(), key=lambda m: m.records).path.removeprefix("file://")
    with open(path, "rb") as f:
        data = f.read()
    assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    assert warc.write_archives(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<<|", "\\", "<\\\\||>", "a<", "|im_start|>", "x\n<|im_end|>\n"])
def test_guard_is_reversible(text):
    assert chat.unguard(chat.guard(text)) == text and "<|" not in chat.guard(text)
    assert chat.unline(chat.unguard(chat.guard(chat.line(text)))) == text


def test_template_language():
    run = lambda s, **env: list(compile_template(s, chat.FILTERS)(env))
    assert run("{% for x in xs %}{{ x.a + '!' }}{% generation %}{{ x.b }}{% endgeneration %}{% endfor %}", xs=[{"a": "p", "b": None}]) == [("p!", False), ("", True)]
    assert run("{% if a == 'x' and not b %}1{% elif a in 'yz' %}2{% else %}3{% endif %}", a="y", b=0) == [("2", False)]
    tree = fold(parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}", chat.FILTERS), chat.FILTERS)
    assert len(tree) == 1 and tree[0].value.value == "abcd"
    for bad in ("{{ x.__class__ }}", "{{ f(1) }}", "{{ x[0] }}", "{{ _x }}", "{% for x in xs %}", "{% exec 1 %}", "{{ x | nothing }}"):
        with pytest.raises(TemplateError):
            compile_template(bad, chat.FILTERS)


def test_conversations_read_back(spark):
    schema = "conv_id long, turn int, role string, text string, chunk long, loss string"
    rows = [(1, 1, "assistant", "b<|im_end|>\n", 1, "x"), (1, 0, "user", "a", 1, "x"), (2, 0, None, None, None, None), (2, None, "as\nk", "z" * 200_000, 1, "x"),
            (2, 5, "assistant", "é\U0001F600", 1, "x"), (2, 5, "assistant", "é\U0001F600", 1, "x"), (None, 0, "assistant", "", 1, "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len("b<|im_end|>\n")
    assert got[1].loss_sha256 == hashlib.sha256(b"b<|im_end|>\n").hexdigest()
    want = "".join(f"{r}\n{t}\n" for r, t in (("as\nk", "z" * 200_000), ("", ""), *[("assistant", "é\U0001F600")] * 2))
    assert got[2].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[2].loss_chars == 4
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_pieces_equal_the_library_and_round_trip(spark, odd, none, small):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    check = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    got = pieces.decode_ids(pieces.encode_texts(docs, path), path).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == check.encode(r.text) and r.parity and r.decoded == r.text
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pieces.encode_texts(none, path).count() == 0


def test_whole_text_tokenizer_is_rebuilt():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        data = f.read()
    check, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.rebuild(data)
    for text in ("Hello  world.", " a\nb", "日本語 \U0001F600", "x.,y <s> <0x41>", ""):
        ids = own.encode(text).ids
        assert ids == check.encode(text) and own.decode(ids) == check.decode(ids)


def test_unigram_model_is_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    scored = [("▁a", -1.0), ("b", -2.0), ("ab", -2.5), ("▁", -3.0), ("a", -3.5), ("▁ab", -9.0)]
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], *[(p, s, 1) for p, s in scored]]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = True, False
    import sentencepiece
    check = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = pieces.rebuild(model.SerializeToString())
    for text in ("ab", "abab ab", "a b", "cé"):
        assert own.encode(text).ids == check.encode(text)


def test_toxicity_learns_from_labels_and_not_from_the_held_out(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [(got[i].predicted, y) for i, y in known.items() if got[i].held_out]
    assert sum(p for p, y in held if not y) <= 1
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_every_archive_is_about_one_partition(spark, many_chunks):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 30) for i in range(400)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages)
    manifest = manifest.unionByName(manifest).unionByName(manifest)
    records = warc.read_archives(manifest)
    assert records.rdd.getNumPartitions() == manifest.count() >= 12 and records.count() == 1200
