"""Operators on single documents against brute force: tokens, media, personal data, pages, token file."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from linewave.llm import media, pages, pii, tokenfile, tokens
from tests.llm.fixtures import documents, frame, plain

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for extra in (False, True):
        got = plain(tokens.token_counts(frame(spark, extra=extra), PIECES, table_size=10).select("doc_id", "n_bytes", "n_tokens", "over_limit"))
        n = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in documents()]
        assert got == sorted(((d, b, k, k > 4096) for d, b, k in n), key=lambda r: (r[0] is not None, str(type(r[0])), r))
    assert tokens.token_counts(frame(spark, []), PIECES).count() == 0


def test_piece_counts_on_odd_white_space():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "bc", "é", "日", "<s>", "1.", "\r\n", " ", "​"]
    after_space, after_break = tokens.PieceLengths(PIECES, {}, 50, True), tokens.PieceLengths(PIECES, {}, 50, False)
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert tokens.count_pieces(t, after_space, after_break) == len(model.encode(t)), repr(t)


def slow_crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_ogg_round_trip_and_damage():
    assert media.page_checksum(b"OggS\0\1test") == slow_crc(b"OggS\0\1test")
    rng = np.random.RandomState(0)
    for n in (0, 1, 63, 64, 65, 255, 4095, 4096, 4097, 65025, 70_000):
        data = rng.bytes(n)
        stored = media.write_ogg(data)
        payload, size, times = media.read_ogg(stored)
        assert payload == data + bytes(len(payload) - n) and size == n and len(payload) % 64 == 0 and payload
        assert times[-1] == (len(payload), len(payload) / media.RATE)
        streams = media.demultiplex(stored)
        assert len(streams) == 2
    for i in range(0, len(stored), 997):
        with pytest.raises(media.OggError):
            media.read_ogg(stored[:i] + bytes([stored[i] ^ 4]) + stored[i + 1 :])
    for cut in (10, 100, len(stored) - 1):
        with pytest.raises(media.OggError):
            media.read_ogg(stored[:cut])


def test_media_digests(spark):
    got = {}
    for r in media.media_digests(media.stored_media(frame(spark, extra=True))).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(documents())
    for d, t, *_ in documents():
        data = (t or "").encode()
        own = data + bytes(-len(data) % 64 or (0 if data else 64))
        want = (len(data), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
        assert want in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got[d]]
    assert got[1][0][1:] == got[2][0][1:] == got[2][1][1:]  # equal texts
    assert media.media_digests(media.encode_media(frame(spark, []))).count() == 0


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = [*"0123459..@@ab- +()", "1.2.3.4", "a@b.c", "4111111111111111", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pii.base_spans(t) == brute_spans(t), repr(t)


def test_personal_data_of_every_row(spark):
    got = pii.find_personal_data(frame(spark, extra=True)).collect()
    assert len(got) == len(documents())
    texts = {d: t for d, t, *_ in documents() if d is not None}
    for r in got:
        own = brute_spans(texts.get(r.doc_id) or "") if r.doc_id is not None else []
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in own) for kind in pii.BASE)
        assert set(joined.split(",")) <= set(r.spans.split(","))
    assert pii.find_personal_data(frame(spark, [])).count() == 0


def test_labelers_agree_on_what_is_added(spark):
    rows = [(i, f"my token = 'a9Z{i:04d}kQ7mB2xR8vT4wY6' and call 212-555-{1000 + i}, mail joe.b{i} [at] site [dot] org", "en", "s") for i in range(40)]
    rows += [(100 + i, f"version 1{i % 10}2-555-4{i:03d}x of release build {i}", "en", "s") for i in range(40)]
    spans = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert all({"secret", "email"} <= set(spans[i]) for i in range(40))
    assert not any(spans[100 + i] for i in range(40))


def test_reliabilities_find_the_better_labeler():
    rng = np.random.RandomState(0)
    truth = rng.rand(4000) < 0.4
    good, bad = np.where(rng.rand(4000) < 0.95, truth, ~truth), np.where(rng.rand(4000) < 0.7, truth, ~truth)
    third = np.where(rng.rand(4000) < 0.85, truth, ~truth)
    keys, counts = np.unique([f"{int(a)}{int(b)}{int(c)}---5" for a, b, c in zip(good, bad, third)], return_counts=True)
    post, chance = pii.reliabilities([("email", k) for k in keys], counts.astype(float))
    spread = chance[0, :, 1] - chance[0, :, 0]
    assert spread[0] > spread[2] > spread[1]
    want = {k: truth[[f"{int(a)}{int(b)}{int(c)}---5" == k for a, b, c in zip(good, bad, third)]].mean() for k in keys}
    assert all(abs(p - want[k]) < 0.25 for k, p in zip(keys, post))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><!-- ad --><div class="ad">Buy it, now.</div>
<article><h1>A &amp; B</h1><p><b>First,<br> line.<p>Second &lt;one&gt; &eacute;</p><p>Of.</p><div class="notice">We use cookies.</div>
<form><label>Name</label></form><section id="comments"><p>I like this, really, a lot.</p></section></article>
<aside><p>Other, long, text. Much of it, here.</p></aside><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_declared_article():
    assert pages.main_text(PAGE) == "A & B\n\nFirst, line.\n\nSecond <one> é\n\nOf."
    assert pages.main_text(PAGE[: PAGE.index("<p>Of.") + 4]) == "A & B\n\nFirst, line.\n\nSecond <one> é\n\nO"


def test_main_text_by_ratios_alone():
    body = "".join(f"<p>Sentence {i}, with words; and marks. It goes on, and on, for a good while.</p>" for i in range(6))
    page = f'<body><div><a href=1>One</a> <a href=2>Two</a></div><div id=w><h2>Head</h2>{body}</div><div>Short</div></body>'
    got = pages.main_text(page).split("\n\n")
    assert got[0] == "Head" and len(got) == 7


def test_pages_of_every_kind(spark):
    odd = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<"), (4, "w", "<p"), (5, "w", "<script>x"), (6, "w", "<!-- "), (7, "w", "a < b"), (8, "w", "<div>" * 3000 + "x"), (9, "w", '<a "x>y</a><p>k'), (10, "w", "<p>" + "long text, " * 40_000)]
    df = spark.createDataFrame([(*r, 1) for r in odd], "page_id long, url string, html string, text int")
    got = pages.extract_text(df).collect()
    assert len(got) == len(odd) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert (by[2], by[3], by[4], by[5], by[6], by[7], by[8]) == ("", "<", "", "", "", "a < b", "x")
    assert by[10] == ("long text, " * 40_000).strip()
    assert pages.extract_text(df.limit(0)).count() == 0


def test_pages_of_the_test_data(spark, sf_dir):
    from html import unescape

    for r in pages.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_text_encoder_equals_the_library():
    encoder, library = tokenfile.TextEncoder(BYTES, 2, 50), Tokenizer.from_file(BYTES)
    rng = random.Random(1)
    parts = [" ", "\n", "a", "word", "Word.", "\t", "<|endoftext|>", "é", "  ", "'s", "1", ".", "\r\n", "\x1c", "日本", "\x85", "!?", "don't", "a1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)]
    for lo in range(0, len(texts), 100):
        want = [np.asarray(e.ids, "<u2").tobytes() for e in library.encode_batch(texts[lo : lo + 100], add_special_tokens=False)]
        assert encoder.encode(texts[lo : lo + 100]) == want


def test_token_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_token_file(frame(spark, extra=True), path, BYTES, 2, pack_bytes=4000)
    library, at, want = Tokenizer.from_file(BYTES), 0, []
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, ids))
        at += len(ids)
    got = sorted(tokenfile.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, *_ in want]
    with_id = [(r, w) for r, w in zip(got, want) if w[0] is not None]
    assert all((r.start, r.n_tokens, r.ids_crc32) == (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r, (_, s, ids) in with_id)
    assert sum(r.n_tokens for r in got) == at
    assert tokenfile.read_document(spark, path, 13) == next(ids for d, _, ids in want if d == 13)
    assert tokenfile.read_document(spark, path, 999) is None
    packs = spark.read.parquet(f"{path}/packs")
    assert packs.count() > 1 and packs.select("sha256").distinct().count() == 1


def test_token_file_of_nothing_and_of_another_dictionary(spark, tmp_path):
    tokenfile.write_token_file(frame(spark, []), str(tmp_path / "none"), BYTES, 2)
    assert tokenfile.read_token_file(spark, str(tmp_path / "none")).count() == 0
    tokenfile.write_token_file(frame(spark), str(tmp_path / "a"), BYTES, 2)
    spark.createDataFrame([(b"other", hashlib.sha256(b"other").hexdigest(), 2, "x")], "dictionary binary, sha256 string, id_bytes int, vocabulary string").write.mode("overwrite").parquet(str(tmp_path / "a" / "dictionary"))
    with pytest.raises(Exception, match="another dictionary"):
        tokenfile.read_token_file(spark, str(tmp_path / "a")).collect()
