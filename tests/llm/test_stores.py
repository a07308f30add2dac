import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octavo.llm import castore, media, token_store


_ENCODER: dict = {}


@functools.cache
def plain(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t


def ids_of(tokenizer, text):
    t = plain(tokenizer)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_tokens_round_trip(docs, tokenizer):
    got = sorted(token_store.read(token_store.write(docs, tokenizer), ids=True).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, g in zip(sorted(docs.collect(), key=lambda r: r.doc_id), got, strict=True):
        want = ids_of(tokenizer, r.text)
        assert (g.doc_id, g.start, g.n_tokens, list(g.ids)) == (r.doc_id, start, len(want), want)
        assert g.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_token_edges(odd, empty, tokenizer):
    rows = token_store.read(token_store.write(odd, tokenizer)).collect()
    assert len(rows) == 10
    want = {r.doc_id: len(ids_of(tokenizer, r.text)) for r in odd.collect()}
    assert all(r.n_tokens == want[r.doc_id] for r in rows)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(10)]
    assert ordered[0].doc_id is None
    assert token_store.read(token_store.write(empty, tokenizer)).count() == 0


@pytest.mark.parametrize("text", ["a b", " a", "a  b", "a \u00a0b", "\u00a0 a b", "it's we'll", "\n a\n b", "é è", "日本 語", "a\u2003 b c", "x\u0085 y", "\ufeff a", "..  !! ?a 1 2b", "e\u0301 a", "a.\nB", "a\n\nb", "a \nb", "a\n b", "it's.'ll x's", "a.b,c", "\n\na", "a'\nre", "x\n1", "1.\na", "a-\n-b", "a\r\nb"])
def test_pieces_change_no_ids(tokenizer, text):
    e = token_store.Encoder(tokenizer, 2)
    ids, offs = e.encode(pa.array([text, text + " " + text]))
    assert ids[: offs[1]].tolist() == ids_of(tokenizer, text)
    assert ids[offs[1] :].tolist() == ids_of(tokenizer, text + " " + text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sDl1. \n\t\r\u00a0\u00e9\u0301-,", max_size=14))
def test_pieces_of_any_text(tokenizer, text):
    e = _ENCODER.setdefault(tokenizer, token_store.Encoder(tokenizer, 2))
    assert e.encode(pa.array([text]))[0].tolist() == ids_of(tokenizer, text)


def test_forgetting_changes_nothing(tokenizer, monkeypatch, docs):
    monkeypatch.setattr(token_store, "REMEMBERED", 50)
    monkeypatch.setattr(token_store, "LATEST", 10)
    e, texts = token_store.Encoder(tokenizer, 2), [r.text for r in docs.limit(12).collect()]
    for t in texts + texts:
        assert e.encode(pa.array([t]))[0].tolist() == ids_of(tokenizer, t)


def test_chunks_are_stored_once(spark, tokenizer):
    base = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, base + f" end{i}") for i in range(8)] + [(100 + i, base) for i in range(5)]
    s = token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer).store
    digests = [c.digest for r in s.chunks.collect() for c in r.own]
    assert len(digests) == len(set(digests))
    needed = {bytes(x) for r in s.recipes.collect() for x in r.digests}
    assert set(map(bytes, digests)) == needed
    assert s.borrowed.count() > 0


def test_hot_chunks_are_salted(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(castore, "HOT", 3)
    base = " ".join(f"word{i}" for i in range(3000))
    texts = {i: base + f" end{i}" for i in range(40)}
    got = token_store.read(token_store.write(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer), ids=True)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: ids_of(tokenizer, t) for i, t in texts.items()}


def test_damage_is_found():
    import zstandard

    z = zstandard.ZstdCompressor()
    parts = [b"abc", b"def"]
    digests = [castore.digest(p) for p in parts]
    own = castore.blobs(parts, digests, z)
    d = zstandard.ZstdDecompressor()
    assert castore.restore(digests, own, castore.merkle(digests), d) == b"abcdef"
    with pytest.raises(ValueError):
        castore.restore(digests, own, castore.merkle(digests[:1]), d)
    with pytest.raises(ValueError):
        castore.restore(digests, [own[0], {"digest": digests[1], "blob": z.compress(b"xyz")}], castore.merkle(digests), d)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    shifted = np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), data])
    g = castore.gear(256)
    a, b = (castore.cuts(x, np.array([0, len(x)]), g, 9, 128, 4096)[0] for x in (data, shifted))
    assert len({x + 777 for x in a} & set(b)) > 0.8 * len(a)
    for ends in (a, b):
        sizes = np.diff([0, *ends])
        assert (sizes[:-1] >= 128).all() and (sizes <= 4096).all()
    assert castore.cuts(np.zeros(0, np.uint8), np.array([0, 0]), g, 9, 128, 4096) == [[0]]


def test_media(docs, odd, empty):
    for df in (docs, odd):
        stored = media.store(df)
        rows = media.features(stored, media=True).collect()
        assert len(rows) == df.count()
        texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        for r in rows:
            data = texts[r.doc_id]
            payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert media.from_pgm(bytes(r.media))[2] == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert media.features(media.store(empty)).count() == 0


def test_added_tokens_have_their_ids(spark, tokenizer, tmp_path):
    """The query and the pipeline's stage encode as the tokenizer does by its defaults."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from octavo.llm import queries

    default = Tokenizer.from_file(tokenizer)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"a\n{end}\nb", f"x. {end}'s y", f"a  {end}  b", "<|endo", "ftext|> a", f"<|endoftext{end}|>", f"caf\u00e9 {end} \u00e9", "<|endoftext |>", "no such token", None]
    want = [[*default.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 2]
    ids, offs = token_store.Encoder(tokenizer, 2, special=True).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op6_token_store(spark, str(tmp_path)), corpus_pipeline.token_ids(spark, docs, str(tmp_path))):
        assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect()) == [(i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)]
