"""Language ID, sharding, packing, WARC and media columns against plain loops."""

import functools
import hashlib
import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptweave.llm import language, media, packing, sharding, warc

DOC = "doc_id long, text string, lang string, shard int, offset long, ids string, media string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "één œuvre 漢字 🙂"), (None, "null id"), (5, "twice"), (5, "twice"), (6, "many words " * 30_000)]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, 1, 2, "i", "m") for i, t in texts], DOC)


TEXT = {"xx": "la lo lu lami lomi lumi pala polo", "yy": "grum grit grok agru strigg rogg", "zz": "wee wii woo swee twoo awii"}


def labelled(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(TEXT[y].split(), 30)), y, 1, 2, "i", "m") for i, y in enumerate(np.repeat(list(TEXT), n).tolist())]
    return spark.createDataFrame(rows, DOC)


def test_language_of_held_out_and_odd_texts(spark):
    docs = labelled(spark)
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))), per_label=40)
    out = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out(F.col("doc_id"))).collect()
    assert len(out) > 20 and all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in out)
    odd = {r.doc_id: r for r in language.identify(frame(spark, ODD), model).collect()}
    assert [(odd[i].lang_pred, odd[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3 and len(odd) == 7
    assert language.keep_identified(frame(spark, ODD), model).filter("doc_id < 4").count() == 0
    mixed = next(language.label_words(model, [TEXT["xx"] + " " + TEXT["yy"]]))
    labels = [model.labels[i] for i in mixed[2].argmax(1)]
    assert labels == ["xx"] * 8 + ["yy"] * 6  # code-switched


def test_no_label_and_no_rows(spark):
    model = language.fit(frame(spark, [(1, "a b")], None))
    assert language.identify(frame(spark, [(1, "a b")]), model).first().lang_pred == "und"
    assert language.identify(frame(spark, []), model).count() == 0


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    scores, moves, lengths = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), np.array([4, 2])
    found = language.forward_backward(scores, moves, lengths)
    for b, n in enumerate(lengths):
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[t, b, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += p
        np.testing.assert_allclose(found[:n, b], total / total.sum(1, keepdims=True), rtol=1e-6)


def test_expected_moves_against_finite_differences():
    """The gradient of the log of the sum over all paths by the transition weights."""
    import itertools

    rng = np.random.default_rng(2)
    scores, moves, lengths = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), np.array([4, 3])
    t, b = np.array([1, 2, 3, 1, 2]), np.array([0, 0, 0, 1, 1])
    found = language.expected_moves(*language.chains(scores, moves, lengths), moves, t, b)

    def total(moves):
        return sum(np.log(sum(np.exp(sum(scores[i, s, y] for i, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:]))) for path in itertools.product(range(3), repeat=int(n)))) for s, n in enumerate(lengths))

    for x, y in itertools.product(range(3), repeat=2):
        step = np.zeros((3, 3))
        step[x, y] = 1e-5
        assert abs((total(moves + step) - total(moves - step)) / 2e-5 - found[x, y]) < 1e-6


def test_signs_that_are_no_letters(spark):
    model = language.fit(labelled(spark), per_label=20)
    texts = [(1, "½ ² Ⅷ 12 _"), (2, "½ la ²"), (3, "\u0301"), (4, "la\u0301 lo")]
    out = {r.doc_id: r for r in language.identify(frame(spark, texts), model).collect()}
    assert [(out[i].lang_pred, out[i].score, out[i].n_words) for i in (1, 3)] == [("und", 0.0, 0)] * 2 and out[2].n_words == 1 and out[4].n_words == 2


def test_ties_take_the_first_language(spark):
    model = language.Model(["aa", "bb"], np.zeros((1 << language.BITS, 2), np.float32), {}, np.zeros((0, 2), np.float32), np.zeros((2, 2), np.float32))
    row = language.identify(frame(spark, [(1, "some words")]), model).first()
    assert (row.lang_pred, row.score) == ("aa", 0.5)


def test_training_is_bounded(spark):
    rows = [(i, "la lo " * 100_000, "xx") for i in range(3)] + [(9, "grum", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs, chars_per_text=60, piece=20, words_per_label=50).labels == ["xx", "yy"]
    long = "".join(f"w{i:05d} " for i in range(20_000))
    cut = spark.createDataFrame([(long,), ("short",), ("",), (None,)], "t string").select(language.pieces(F.col("t"), 7000, 70).alias("p"), "t").collect()
    at = [long.index(x) for x in cut[0].p.split("\n")]
    assert [r.p for r in cut[1:]] == ["short", "", None] and 4000 < len(cut[0].p) < 10_000 and at == sorted(at) and at[0] < 20_000 and at[-1] > 120_000
    with pytest.raises(ValueError):
        language.fit(docs, most_labels=1)


def test_sharding_of_hot_rows(spark):
    """A shard is cut by its own bytes, and rows that repeat one id and text are scattered over its buckets."""
    texts = [(1, "the same text")] * 3000 + [(i, f"text {i}") for i in range(2, 400)]
    rows = sharding.shard(frame(spark, texts), n_shards=4, bucket_bytes=4000).collect()
    assert len(rows) == len(texts)
    hot = {}
    for r in rows:
        if r.doc_id == 1:
            hot[r.bucket] = hot.get(r.bucket, 0) + 1
    assert len(hot) > 8 and max(hot.values()) < 600
    for s in range(4):
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_are_folders_in_the_order_of_slots(spark, tmp_path):
    path = f"{tmp_path}/shards"
    rows = {r.doc_id: r for r in sharding.shard(frame(spark, [(i, f"text {i}") for i in range(200)]), n_shards=3, path=path).collect()}
    for s in range(3):
        read = [r.doc_id for r in spark.read.parquet(f"{path}/shard={s}").coalesce(1).collect()]
        assert sorted(read) == sorted(i for i, r in rows.items() if r["shard"] == s)
        assert [rows[i].slot for i in read] == list(range(len(read)))


def test_sharding(spark):
    texts = [(i, f"text {i}") for i in range(100, 1100)] + ODD
    for size in (1 << 20, 2000):
        rows = sharding.shard(frame(spark, texts), n_shards=4, bucket_bytes=size).collect()
        assert len(rows) == len(texts) and {r.bucket for r in rows} == {0} if size > 2000 else len({r.bucket for r in rows}) > 1
        for s in range(4):
            assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        assert all(r.grown_shard in (r["shard"], 4) for r in rows) and {r.grown_shard for r in rows} == set(range(5))
        assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
    again = sharding.shard(frame(spark, texts).repartition(7), n_shards=4, bucket_bytes=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))  # whatever the order of the input
    order = [r.doc_id for r in sorted((r for r in rows if r["shard"] == 0 and r.doc_id), key=lambda r: r.slot)]
    assert order != sorted(order)
    assert sharding.shard(frame(spark, [])).count() == 0


def test_fisher_yates_reaches_all_orders():
    rng = np.random.default_rng(0)
    seen = [tuple(sharding.fisher_yates(3, rng)) for _ in range(3000)]
    assert len(set(seen)) == 6 and all(400 < seen.count(x) < 600 for x in set(seen)) and len(sharding.fisher_yates(0, rng)) == 0


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER), 50)


def whole_ids(texts):
    tok = tokenizer()[0]
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40) | st.text("aÉéİΣß'.,<|>endoftx \n\x1c é", max_size=40) | st.sampled_from(["don't, I'LL", "<|endoftext|>a", "<|ENDOFTEXT|>", "a.b, c.. d,. 12,5"]))
def test_ids_word_by_word_are_those_of_the_whole(text):
    assert tokenizer()[1].ids(text) == whole_ids([text])[0][:-1].tobytes()


@pytest.mark.parametrize("text", ["Hello <|x The", "A <| b", "PIPE <|endoftext|> Two", "Hi. THE, <|startoftext|>The <|ENDOFTEXT|> É Été", "Mix<|endoftext|>Mix Don't <| 12A"])
def test_ids_of_capitals_beside_special_marks(text):
    assert tokenizer()[1].ids(text) == whole_ids([text])[0][:-1].tobytes()


@pytest.mark.parametrize("windows, fan_in", [(3, 2), (16, 64)])
def test_packing(spark, windows, fan_in):
    texts = [(i, "word " * (i * 7 % 300)) for i in range(100, 300)] + ODD
    rows = packing.pack(frame(spark, texts).repartition(6), size=256, open_windows=windows, fan_in=fan_in).collect()
    ids = dict(zip([i for i, _ in texts], whole_ids([t for _, t in texts])))
    copies = {i: sum(j == i for j, _ in texts) for i in ids}
    for i, whole in ids.items():
        own = [r for r in rows if r.doc_id == i]
        assert all(r.ids == whole[r.start : r.start + r.length].tobytes() and r.doc_tokens == len(whole) for r in own)
        count = np.zeros(len(whole), int)
        for r in own:
            count[r.start : r.start + r.length] += 1
        assert (count == copies[i]).all()
    lengths = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert sorted(lengths.values())[1:] == [256] * (len(lengths) - 1)
    assert packing.pack(frame(spark, [])).count() == 0


def test_warc(spark, monkeypatch):
    big = "é" * 600
    pages = [(1, "http://a.org/x", big), (2, "http://a.org/y", big), (3, "http://b.org:8080/z?q=1", "small"), (4, "http://a.org/x", "small"), (5, None, None), (6, "not a url [", ""), (None, "http://c.org", big), (7, "http://a.org/x", big), (7, "http://a.org/x", big), (8, "http://d.org/", "w\r\n\r\nz" * 40_000)]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, digest int")
    for most in (200_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        path = warc.warc_store(df)
        rows = warc.read_archives(spark, path, df.select("url"), with_payload=True).collect()
        assert len(rows) == len(pages)
        for r in rows:
            html = next(h for i, u, h in pages if i == r.page_id) or ""
            revisit = html == big and r.page_id != 7
            assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
            assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest() and bytes(r.payload) == (b"" if revisit else html.encode())
    index = warc.CaptureIndex(spark, path)
    assert sorted(r["page_id"] for r in index.lookup("http://a.org/x")) == [1, 4, 7, 7] and [r["page_id"] for r in index.lookup("http://b.org:8080/z?q=1")] == [3] and index.lookup("http://none.org/") == []
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(f"{base}/archives"))
    every = [r for f in files for r in warc.iterate_archive(store.open_input_stream(f.path, compression=None).read())]
    assert sorted(str(r["page_id"]) for r in every) == sorted(str(p[0]) for p in pages)
    empty = warc.warc_store(df.filter("false"))
    assert warc.read_archives(spark, empty, df.select("url")).count() == 0 and warc.CaptureIndex(spark, empty).lookup("http://a.org/x") == []


def test_index_spans_blocks_and_parts(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 5}.org/{i % 50}", "x") for i in range(400)], "page_id long, url string, html string").repartition(3)
    path = str(warc.fresh_path(spark, "warc"))
    warc.build_index(warc.write_archives(df, path, archive_bytes=5000), f"{path}/index", block_lines=7, parts=4)
    index = warc.CaptureIndex(spark, path)
    for i in (0, 7, 49):
        assert sorted(r["page_id"] for r in index.lookup(f"http://h{i % 5}.org/{i}")) == list(range(i, 400, 50))
    asked = spark.createDataFrame([(u,) for u in ("http://h0.org/0", "http://h2.org/7", "http://h2.org/7", "http://H4.org:80/49", "http://none.org/", None, "zzz", "")], "url string")
    assert sorted(r.page_id for r in warc.read_archives(spark, path, asked).collect()) == sorted(i for k in (0, 7, 49) for i in range(k, 400, 50))
    assert warc.read_archives(spark, path, asked.limit(0)).count() == 0 and warc.read_archives(spark, path, df.select("url")).count() == 400


def test_a_key_with_many_captures(spark):
    df = spark.createDataFrame([(i, "http://one.org/" if i % 3 == 0 else f"http://h{i}.org/", f"x{i}") for i in range(300)], "page_id long, url string, html string")
    path = str(warc.fresh_path(spark, "warc"))
    warc.build_index(warc.write_archives(df, path), f"{path}/index", block_lines=5, parts=6)
    assert sorted(r.page_id for r in warc.read_archives(spark, path, spark.createDataFrame([("http://one.org/",)], "url string")).collect()) == list(range(0, 300, 3))


def picture():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media(spark):
    stored = media.store_media(frame(spark, ODD))
    rows = media.media_features(stored).collect()
    texts = {i: (t or "").encode() for i, t in ODD}
    assert len(rows) == len(ODD)
    for r in rows:
        raw = texts[r.doc_id]
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.sniffed_type == "audio/wav" and r.media_sha256 == hashlib.sha256(media.wav(padded)).hexdigest() and r.feature == "application/octet-stream>audio/wav"
    import wave

    with wave.open(io.BytesIO(media.wav(b"abc" * 5))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(99)) == (1, 1, b"abc" * 5)
    assert media.media_features(media.store_media(frame(spark, []))).count() == 0


def test_sniffing_corrects_and_carves(spark):
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    gz = zlib.compressobj(wbits=31)
    gz = gz.compress(b"hello") + gz.flush()
    inner = b"xx" + picture() + b"RIFF\xff\xff\xff\xffWAVE" + gif + b"BM" + gz + b"\x89PNG\r\n\x1a\n broken"
    df = spark.createDataFrame([(1, len(inner), "text/plain", inner), (2, 1, "text/plain", picture()), (3, 0, "image/png", None), (4, 0, "image/png", b"")], "doc_id long, n_bytes long, declared_type string, media binary")
    more = spark.createDataFrame([(5, 1, "text/plain", picture() + b"\n")], df.schema)
    rows = {r.doc_id: r for r in media.media_features(df.union(more)).collect()}
    assert rows[5].sniffed_type == "image/png" and [(p.start, p.end) for p in rows[5].embedded] == [(0, len(picture()))]
    assert [(p.type, inner[p.start : p.end]) for p in rows[1].embedded] == [("image/png", picture()), ("image/gif", gif), ("application/gzip", gz)] and rows[1].sniffed_type is None
    assert rows[2].feature == "text/plain>image/png" and rows[3].feature == "image/png>none" and rows[4].feature == "image/png>unknown"
