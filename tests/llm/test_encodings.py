from __future__ import annotations

import hashlib
import itertools
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat_tree, media_webp, piece_sampling, token_codes
from strandline.llm.common import mix

from .fixtures import documents, empty, pairs

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- token codes


@pytest.mark.parametrize("top", [200, 60_000, 1 << 31])
def test_codes_give_random_access(top):
    rng = np.random.default_rng(top)
    ids = np.where(rng.random(5000) < 0.5, rng.integers(0, 256, 5000), rng.integers(0, top, 5000)).astype(np.uint32)
    c = token_codes.Codes(token_codes.encode_codes(ids))
    assert len(c) == 5000 and c.range(0, 5000).tolist() == ids.tolist()
    for i in rng.integers(0, 5000, 200).tolist() + [0, 4999]:
        assert c[i] == ids[i]
    for lo, hi in [(0, 0), (17, 18), (511, 1025), (4990, 5000), (5000, 5000)]:
        assert c.range(lo, hi).tolist() == ids[lo:hi].tolist()
    with pytest.raises(IndexError):
        c[5000]


def test_codes_of_nothing_and_of_junk():
    assert len(token_codes.Codes(token_codes.encode_codes(np.zeros(0, np.uint32)))) == 0
    with pytest.raises(ValueError):
        token_codes.Codes(b"junkjunkjunkjunk")


def test_token_table_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    df = documents(spark)
    tz = Tokenizer.from_file(WORDS)
    rows = pairs(df)
    got = token_codes.read_token_codes(token_codes.write_token_codes(df, WORDS, 2, shard_tokens=500, slice_bytes=2000)).collect()
    want = sorted((str(d), len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for (d, _), i in zip(rows, [tz.encode(t or "", add_special_tokens=False).ids for _, t in rows], strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate([[0], np.cumsum([r.n_tokens for r in order])[:-1]]).tolist()
    ids = [r.doc_id for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_codes.read_token_codes(token_codes.write_token_codes(empty(spark), WORDS, 2)).count() == 0


def test_words_with_cuts_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tz = Tokenizer.from_file(WORDS)
    texts = ["", "A<|ENDOFTEXT|>b <|endoftext|>x", "don't We'RE 12.5,a ́x É. a.b,c!!?? ÀÉ'S.\x0b\x1cx y z.\x85q İI.ſ's K", "Éa.É,e ́,", "'s,'t.x;y:z"]
    ids, n = token_codes.Tokens(WORDS).texts(pa.array(texts), 2)
    want = [[*tz.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == list(itertools.chain.from_iterable(want)) and n.tolist() == [len(x) for x in want]


def test_words_that_change_under_normalisation_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tz = Tokenizer.from_file(WORDS)
    ends = ["GAZETES\u0130", "\u09df", "\u095c", "\ufb2a", "I\u0307", "E\u0301", "\u00c9", "\u00df", "Z9", "\u0645"]
    texts = [e + p + rest for e in ends for p in ".,!?;:" for rest in ("", "X", "\u0301")]
    texts += [c + m for c in "AHJTWYahjtwy" for m in map(chr, range(0x300, 0x370))]
    ids, n = token_codes.Tokens(WORDS).texts(pa.array(texts), 2)
    want = [[*tz.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == list(itertools.chain.from_iterable(want)) and n.tolist() == [len(x) for x in want]


def test_random_texts_equal_whole_texts():
    """Letters of many scripts, all combining marks, cases, digits, punctuation and white space, in any order."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    tz, r = Tokenizer.from_file(WORDS), random.Random(12)
    marks, letters = [chr(c) for c in range(0x300, 0x370)], [chr(c) for c in [*range(0x41, 0x250), *range(0x370, 0x590), 0x5E9, 0x5C1, 0x915, 0x93C, 0x9AF, 0x9BC, 0x1112, 0x1161, 0x11AB, 0x212B, 0xFB01]]
    others = list(".,!?;:'\"-()<|>0123456789") + [" ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u200d", "'s", "'LL", "<|endoftext|>"]
    texts = ["".join(r.choice(r.choice((marks, letters, others, list("AJHTWYaei"), list(".,!?;:")))) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, n = token_codes.Tokens(WORDS).texts(pa.array(texts), 2)
    want = [[*tz.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == list(itertools.chain.from_iterable(want))


class Counted:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **settings):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **settings)


@pytest.mark.parametrize("marked", [True, False])
def test_plain_words_are_encoded_together(marked):
    """3,000 plain words take a call for some hundreds; without the mark of a last token each has its own. Ids are those of whole texts."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    tz, r = Tokenizer.from_file(WORDS), random.Random(5)
    letters = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
    words = list({"".join(r.choice(letters) for _ in range(r.randint(1, 12))).lower() for _ in range(3000)})
    odd = ["d\u2019x", "a\u0301b", "'s", "x'll", "漢字", "ªº", "µ", "\x01", "<|endoftext|>", "a1b", "×÷", "ſt", "\u0301a"]
    texts = [" ".join(r.sample(words, 200) + r.choices(odd, k=k % 9)) for k in range(30)] + [" ".join(words), None, "", " ", " ".join(odd), words[0] * 3]
    tokens = token_codes.Tokens(WORDS)
    tokens.tokenizer = Counted(tz)
    if not marked:
        tokens.last = tokens.last[:0]
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        ids, n = tokens.texts(column, 2)
        want = [[*tz.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == list(itertools.chain.from_iterable(want))
    assert tokens.tokenizer.texts < 60 if marked else tokens.tokenizer.texts > 2500


def test_marks_that_do_not_fit_the_words_are_not_used():
    tokens = token_codes.Tokens(WORDS)
    words = [f"{a}{b}" for a in ("un", "happ", "zq") for b in ("ily", "xjq", "é")] * 100
    want = tokens.encoded(words)
    for last in (tokens.last, ~tokens.last, np.ones_like(tokens.last), np.zeros_like(tokens.last)):
        tokens.last = last
        assert all((a == b).all() for a, b in zip(tokens.plain(words), want, strict=True))


def test_long_words_are_forgotten(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_codes, "MEMO_BYTES", 1000)
    tokens = token_codes.Tokens(WORDS)
    want = [tokens.encoded([w * 40])[0].tolist() + [2] for w in ("ab", "cd", "ef", "x!") * 20]
    got = [tokens.texts(pa.array([w * 40]), 2)[0].tolist() for w in ("ab", "cd", "ef", "x!") * 20]
    assert got == want
    for i in range(60):
        tokens.texts(pa.array([f"w{i}" * 40]), 2)
        assert tokens.known.nbytes < 1300


def test_other_tokenizers_encode_whole_texts():
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tz, texts = Tokenizer.from_file(path), ["", None, " two  spaces\nand More.", "É.x"]
    tokens = token_codes.Tokens(path)
    ids, n = tokens.texts(pa.array(texts), 7)
    want = [[*tz.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert not tokens.by_words and ids.tolist() == list(itertools.chain.from_iterable(want)) and n.tolist() == [len(x) for x in want]
    settings = json.loads(Tokenizer.from_file(WORDS).to_str())
    assert token_codes.by_words(settings)
    settings["normalizer"]["normalizers"].pop()
    assert not token_codes.by_words(settings)


# --- chat trees


def test_escapes_are_reversible():
    for t in ["", "\\", "[INST]", "[\\INST]", "</s>[INST] ok [/INST]", "<<SYS>>\\<</SYS>> [ROLE x] [/ROLE]", "a [/INST", "]\\]"]:
        e = chat_tree.escape(t)
        assert chat_tree.unescape(e) == t and not any(c in e for c in chat_tree.CONTROL)
    turns = [("user", "x [/INST] y"), ("assistant", " </s>"), ("a] [/ROLE]b", "z"), ("", ""), ("system", "\n")]
    assert chat_tree.parse("".join(chat_tree.format_turn(*t)[0] for t in turns)) == turns


def brute_chat(rows):
    conv = {}
    for c, n, r, t in rows:
        conv.setdefault(c, []).append(((n is not None, n), r or "", t or ""))
    out = []
    for c, turns in conv.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat_tree.format_turn(r, t)[0]) for r, t in turns)))
    return sorted(out, key=str)


def conversations(spark):
    rows = [(k, n, ("user", "assistant", "system", "tool", None)[(n + k // 9) % 5], None if n == 3 else ("hello", "</s>[INST] ok [/INST]", f"own {k} \\ ü")[n % 3]) for k in range(40) for n in range(1 + k % 5)]
    rows += [(None, 0, "user", "no id"), (3, 0, "user", "hello"), (50, None, "assistant", "")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("chars", [40, 1 << 19])
def test_chat_round_trip(spark, chars):
    rows, df = conversations(spark)
    shards = chat_tree.format_conversations(df.withColumn("path", F.lit(1)), shard_chars=chars)
    got = chat_tree.read_conversations(shards)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == brute_chat(rows)
    if chars > 1000:
        total = got.agg(F.sum("formatted_chars"), F.sum("new_chars")).first()
        assert total[1] < total[0]
    for row in shards.collect():
        row = row.asDict(recursive=True)
        position, leafs = chat_tree.position_ids(row), row["leaves"]
        for leaf in leafs:
            a = row["attend"][leaf]
            seen = [p for k in range(0, len(a), 2) for p in position[a[k] : a[k + 1]]] + position[row["start"][leaf] : row["stop"][leaf]]
            assert seen == list(range(len(seen)))
    assert chat_tree.read_conversations(chat_tree.format_conversations(df.limit(0))).count() == 0


def test_forests_write_shared_turns_once():
    rows = [(k, [("user", "hello"), ("assistant", f"own {k // 3}"), ("user", f"more {k}")]) for k in range(9)]
    f = chat_tree.Forest()
    for c, turns in sorted(rows, key=lambda x: x[1]):
        f.add(c, turns)
    prefixes = {tuple(t[: k + 1]) for _, t in rows for k in range(3)}
    assert f.length == sum(len(chat_tree.format_turn(*p[-1])[0]) for p in prefixes) and len(f.nodes["parent"]) == 1 + 3 + 9


# --- media


def test_media_round_trip(spark):
    df = documents(spark)
    rows = {r.doc_id: r for r in media_webp.read_media(media_webp.write_media(df, slice_bytes=1000)).collect()}
    for d, t in pairs(df):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        r = rows[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        media = media_webp.encode_payload(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and media_webp.decode_payload(media).tobytes() == padded
    assert media_webp.read_media(media_webp.write_media(empty(spark))).count() == 0


def test_media_of_more_rows_than_an_image_has():
    raw = np.random.default_rng(0).integers(0, 256, 576 * (media_webp.MOST_ROWS + 3)).astype(np.uint8)
    media = media_webp.encode_payload(raw)
    assert len(list(media_webp.images(media))) == 2 and media_webp.decode_payload(media).tobytes() == raw.tobytes()


def prose(seed, n):
    import random

    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n)).encode()


def padded(raw):
    return raw + b"\xff" * (576 if not raw else -len(raw) % 576)


PAYLOADS = {
    "coded": prose(1, 3000),
    "copies": prose(2, 40)[:96] * 40 + prose(3, 300),
    "cache": b"".join(b"%c%c%c." % (97 + (k * k) % 7, 98 + (k * 5) % 3, 99) + prose(k, 3)[:4] for k in range(700)),
    "palette": b"".join([b"abcd", b"efgh", b"ijkl"][(k * k + k // 3) % 3] for k in range(900)),
    "predictor": b"".join(bytes([k % 251, (k * 3) % 251, (k * 7 + k // 50) % 251, (k // 4) % 251]) for k in range(4000)),
    "cross": b"".join(bytes([x, x, x, 65]) for x in np.random.default_rng(4).integers(0, 256, 3000).tolist()),
}


@pytest.mark.parametrize("feature", sorted(PAYLOADS))
def test_writer_uses_what_helps_and_the_reader_undoes_it(feature):
    raw = np.frombuffer(padded(PAYLOADS[feature]), np.uint8)
    rows = np.append(np.full(len(raw) // 576 // media_webp.MOST_ROWS, media_webp.MOST_ROWS), len(raw) // 576 % media_webp.MOST_ROWS)
    files, used = media_webp.encode_images(raw, rows[rows > 0])
    assert used[feature].any() and sum(map(len, files)) < 0.8 * len(raw)
    assert media_webp.decode_payload(b"".join(files)).tobytes() == raw.tobytes()


def test_stored_text_is_smaller_and_equal_texts_are_stored_equally():
    texts = [padded(prose(k, 5 * k)) for k in range(1, 120)] + [padded(b""), padded(b"x"), padded(prose(7, 35))]
    blocks = np.array([len(t) // 576 for t in texts])
    media = media_webp.encode_payloads(np.frombuffer(b"".join(texts), np.uint8), blocks)
    assert media[-1] == media[6] == media_webp.encode_payload(texts[6]) and sum(map(len, media)) < 0.7 * sum(map(len, texts))
    assert [x.tobytes() for x in media_webp.decode_payloads(media)] == texts


def test_images_read_together_and_pixel_by_pixel_are_equal():
    """The scalar reader, for images with several groups, as the check of the batched one."""
    texts = [padded(prose(k, 40 * k)) for k in range(1, 8)] + [padded(x) for x in PAYLOADS.values()]
    for t in texts:
        for file in media_webp.images(media_webp.encode_payload(t)):
            wide, high, _, left = media_webp._opened(file)
            if not isinstance(left, media_webp.Pending):
                continue
            r = media_webp.BitReader(left.data)
            r.at = left.at
            codes, cache, out = [media_webp.read_code(r, n) for n in media_webp._alphabets(left.cache_bits)], {}, []

            def put(v):
                out.append(v)
                if left.cache_bits:
                    cache[(media_webp.CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - left.cache_bits)] = v

            while len(out) < left.total:
                s = codes[0].read(r)
                if s < 256:
                    red, blue, alpha = (codes[c].read(r) for c in (1, 2, 3))
                    put(alpha << 24 | red << 16 | s << 8 | blue)
                elif s < 280:
                    n = media_webp._prefixed(s - 256, r)
                    d = media_webp._distance(media_webp._prefixed(codes[4].read(r), r), left.wide)
                    for _ in range(n):
                        put(out[-d])
                else:
                    put(cache.get(s - 280, 0))
            assert media_webp.read_pending([left, left])[1].tolist() == out


def test_prefix_codes_are_complete():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 40, (50, 300)) * (rng.random((50, 300)) < 0.3)
    counts[0], counts[1], counts[1, 5], counts[2, 1:] = 0, 0, 9, 0
    n = media_webp.code_lengths(counts).astype(int)
    kraft = np.where(n > 0, 2.0**-n, 0).sum(1)
    assert (kraft[3:] == 1).all() and (n[0] > 0).sum() == 1 and n[1, 5] == 1 and ((n > 0) == (counts > 0))[3:].all()


def test_look_ups_of_codes_of_all_lengths():
    """Codes of up to 15 bits, which the writer never makes."""
    n = np.zeros((3, 300), np.uint8)
    n[0, :16] = [*range(1, 16), 15]
    n[1, [7, 9]] = 1
    n[2, 250] = 1
    table, (limit, base, symbols, used) = media_webp._look_ups(n)
    codes = media_webp._codes(n)
    for row in (0, 1):
        for s in np.flatnonzero(n[row]).tolist():
            bits, length = int(codes[row, s]), int(n[row, s])
            e = int(table[(row << media_webp.LOOK) + (bits & ((1 << media_webp.LOOK) - 1))])
            assert e == (s << 4 | length) if length <= media_webp.LOOK else e == 15
            r = media_webp.BitReader(bits.to_bytes(4, "little"))
            assert media_webp.Code(n[row].tolist()).read(r) == s and r.at == length
    assert set(table[2 << media_webp.LOOK :].tolist()) == {250 << 4} and used.tolist() == [16, 2, 1]


def test_pixel_arrays(spark):
    df = documents(spark, n=12)
    media = media_webp.write_media(df)
    rows = media_webp.read_pixels(media).collect()
    assert all(len(r.rgba) == 4 * r.high * r.wide and r.wide == 144 for r in rows) and len(rows) >= df.count()


class Stream(media_webp.BitWriter):
    """Writes entropy-coded images of given symbols with flat or simple codes, for the reader's tests."""

    def code(self, symbols, alphabet):
        """A code over one to 16 symbols of equal length; returns how to write a symbol."""
        symbols = sorted(symbols)
        if len(symbols) == 1 and symbols[0] < 2:
            self.put(1, 1), self.put(0, 1), self.put(0, 1), self.put(symbols[0], 1)
            return lambda s: None
        if len(symbols) == 1 and symbols[0] < 256:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(symbols[0], 8)
            return lambda s: None
        bits = max(1, (len(symbols) - 1).bit_length())
        spare = [s for s in range(alphabet) if s not in symbols]
        symbols = sorted(symbols + spare[: (1 << bits) - len(symbols)])
        self.put(0, 1), self.put(15, 4)
        for k in media_webp.LENGTH_ORDER:  # lengths 0 and `bits`, one bit each
            self.put(1 if k in (0, bits) else 0, 3)
        self.put(0, 1)
        for s in range(alphabet):
            self.put(int(s in symbols), 1)
        at = {s: i for i, s in enumerate(symbols)}

        def write(s):
            for b in range(bits - 1, -1, -1):
                self.put(at[s] >> b & 1, 1)

        return write

    def image(self, ops, cache_bits=0, top=True):
        """ops: ('px', a, r, g, b), ('copy', length code, extra, bits, distance code, extra, bits), ('cache', index)."""
        self.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if top:
            self.put(0, 1)
        green = {o[3] for o in ops if o[0] == "px"} | {256 + o[1] for o in ops if o[0] == "copy"} | {280 + o[1] for o in ops if o[0] == "cache"}
        size = 280 + ((1 << cache_bits) if cache_bits else 0)
        px = [o for o in ops if o[0] == "px"] or [("px", 0, 0, 0, 0)]
        g, r, b, a, d = self.code(green, size), self.code({o[2] for o in px}, 256), self.code({o[4] for o in px}, 256), self.code({o[1] for o in px}, 256), self.code({o[4] for o in ops if o[0] == "copy"} or {0}, 40)
        for o in ops:
            if o[0] == "px":
                g(o[3]), r(o[2]), b(o[4]), a(o[1])
            elif o[0] == "copy":
                g(256 + o[1]), self.put(o[2], o[3]), d(o[4]), self.put(o[5], o[6])
            else:
                g(280 + o[1])


def webp(wide, high, body):
    w = Stream()
    w.put(0x2F, 8), w.put(wide - 1, 14), w.put(high - 1, 14), w.put(1, 1), w.put(0, 3)
    body(w)
    raw = w.bytes()
    raw += b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(raw)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw


def argb(px):
    return [(int(p[3]), int(p[0]), int(p[1]), int(p[2])) for p in px.reshape(-1, 4)]


def test_reader_copies_and_colour_cache():
    one, two = (255, 1, 2, 3), (255, 9, 8, 7)
    index = (media_webp.CACHE_FACTOR * (255 << 24 | 1 << 16 | 2 << 8 | 3) & 0xFFFFFFFF) >> 28

    def body(w):
        w.put(0, 1)
        # length code 2 is 3 pixels; distance code 1 is the pixel to the left
        w.image([("px", *one), ("px", *two), ("copy", 2, 0, 0, 1, 0, 0), ("cache", index)], cache_bits=4)

    assert argb(media_webp.decode_image(webp(3, 2, body))) == [one, two, two, two, two, one]


def test_reader_maps_near_distances_and_long_ones():
    px = [(255, k, k, k) for k in (10, 20, 30, 40)]

    def body(w):
        w.put(0, 1)
        # distance code 0 is 1, the row above (x 0, y 1); then code 14 with 6 extra bits: 129 + 0 -> 9 is further than the image
        w.image([*[("px", *p) for p in px], ("copy", 3, 0, 0, 0, 0, 0)])

    assert argb(media_webp.decode_image(webp(4, 2, body))) == px + px
    with pytest.raises(ValueError):
        media_webp.decode_image(webp(4, 2, lambda w: (w.put(0, 1), w.image([("px", *px[0]), ("copy", 3, 0, 0, 14, 5, 6)]))))


def test_reader_undoes_subtract_green_and_cross_colour():
    def body(w):
        w.put(1, 1), w.put(2, 2)
        w.put(1, 1), w.put(1, 2), w.put(0, 3)  # blocks of 4
        w.image([("px", 255, 32, 64, 16)], top=False)  # red_to_blue 32, green_to_blue 64, green_to_red 16
        w.put(0, 1)
        w.image([("px", 255, 5, 100, 6)])

    red = (5 + (16 * 100 >> 5)) & 255
    blue = (6 + (64 * 100 >> 5) + (32 * red >> 5)) & 255
    assert argb(media_webp.decode_image(webp(1, 1, body))) == [(255, (red + 100) & 255, 100, (blue + 100) & 255)]


def test_reader_undoes_palettes():
    def body(w):
        w.put(1, 1), w.put(3, 2), w.put(2, 8)  # three colours: four pixels in a byte
        w.image([("px", 255, 10, 20, 30), ("px", 0, 1, 1, 1), ("px", 0, 2, 2, 2)], top=False)
        w.put(0, 1)
        w.image([("px", 255, 0, 0b11100100, 0), ("px", 255, 0, 0b01, 0)])

    c = [(255, 10, 20, 30), (255, 11, 21, 31), (255, 13, 23, 33), (0, 0, 0, 0)]
    assert argb(media_webp.decode_image(webp(5, 1, body))) == [*c, c[1]]


@pytest.mark.parametrize("mode", range(14))
def test_reader_undoes_predictors(mode):
    rng = np.random.default_rng(mode)
    want = rng.integers(0, 256, (3, 4, 4))  # a r g b
    px = want.astype(int)
    guess = np.zeros_like(px)
    for y in range(3):
        for x in range(4):
            left, top = (px[y, x - 1] if x else None), (px[y - 1, x] if y else None)
            if not y:
                guess[y, x] = left if x else [255, 0, 0, 0]
            elif not x:
                guess[y, x] = top
            else:
                corner, right = px[y - 1, x - 1], (px[y - 1, x + 1] if x < 3 else px[y, 0])
                avg = lambda a, b: (a + b) // 2
                clamp = lambda v: np.clip(v, 0, 255)
                pick = left if np.abs(left + top - corner - left).sum() < np.abs(left + top - corner - top).sum() else top
                mean = avg(left, top)
                half = np.array([int((m - c) / 2) for m, c in zip(mean, corner, strict=True)])
                guess[y, x] = [np.array([255, 0, 0, 0]), left, top, right, corner, avg(avg(left, right), top), avg(left, corner), avg(left, top), avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right)), pick, clamp(left + top - corner), clamp(mean + half)][mode]
    rest = (px - guess) & 255
    packed = lambda c: media_webp._joined(np.asarray(c).reshape(-1, 4))
    got = media_webp.undo_predictor(packed(rest), 4, 3, np.array([mode << 8], np.uint32), 2)
    assert got.tolist() == packed(want).tolist()


def test_reader_rejects_broken_files():
    media = media_webp.encode_payload(("Some words of a text, some more words. " * 600)[:5760].encode())
    for junk in (b"", media[:30], media[:-100], media[:20] + b"\0" + media[21:]):
        with pytest.raises((ValueError, struct.error)):
            media_webp.decode_image(junk)


# --- pieces


def test_noise_of_no_two_places_is_the_same():
    keys = np.full(200, 5, np.uint64)
    place = np.arange(200)
    seen = np.concatenate([piece_sampling._noise(keys, sample, place, stream, turn) for sample in range(3) for stream in range(3) for turn in (0, 1, 63, 64, 65, 128, 1 << 20)])
    assert len(np.unique(seen)) == len(seen)



@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(piece_sampling.model_path())


def segmentations(pieces, word):
    """All segmentations of a word without uncovered characters: ids -> log probability."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.model_path())
    own = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    out = {(): 0.0}
    done = {}

    def walk(at, ids, logp):
        if at == len(word):
            done[ids] = logp
            return
        for n in range(1, len(word) - at + 1):
            i = own.get(word[at : at + n])
            if i is not None:
                walk(at + n, (*ids, i), logp + pieces.logp[i])

    walk(0, (), 0.0)
    total = np.logaddexp.reduce(list(done.values()))
    del out
    return {k: v - total for k, v in done.items()}


def test_samples_follow_the_lattice(pieces):
    want = segmentations(pieces, "▁the") 
    tail = segmentations(pieces, "▁cat")
    n = 3000
    found = piece_sampling.sample_slice(pieces, ["the cat"] * n, mix(np.arange(n).astype(np.uint64)), 3)
    first, second = {}, {}
    p = {a + b: x + y for a, x in want.items() for b, y in tail.items()}
    for rows in found:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == 3 and rows[0][2] >= rows[1][2] >= rows[2][2]
        assert all(r[1] == pytest.approx(p[i]) for r, i in zip(rows, ids, strict=True))
        first[ids[0]] = first.get(ids[0], 0) + 1
        second[ids[1]] = second.get(ids[1], 0) + 1
    q = {k: np.exp(v) for k, v in p.items()}
    for k, v in q.items():
        assert first.get(k, 0) / n == pytest.approx(v, abs=0.04)
        assert second.get(k, 0) / n == pytest.approx(sum(q[a] * v / (1 - q[a]) for a in q if a != k), abs=0.04)


def test_inclusion_scores_are_unbiased(pieces):
    """Sums of p / inclusion over a sample estimate 1."""
    n = 2000
    found = piece_sampling.sample_slice(pieces, ["unhappily"] * n, mix(np.arange(n).astype(np.uint64) + np.uint64(99)), 2)
    assert np.mean([sum(np.exp(r[1]) / r[3] for r in rows) for rows in found]) == pytest.approx(1, abs=0.1)


def test_few_segmentations_give_all(pieces):
    rows = piece_sampling.sample_slice(pieces, ["", "\n", "a"], mix(np.arange(3).astype(np.uint64)), 5)
    assert len(rows[0]) == 1 and len(rows[0][0][0]) == 0 and rows[0][0][3] == 1.0
    assert len(rows[1]) == 1 and len(rows[2]) == 2 and all(r[3] == 1.0 for r in rows[2])


def test_pieces_round_trip_and_do_not_depend_on_partitions(spark, pieces):
    df = documents(spark)
    got = piece_sampling.sample_pieces(df, piece_sampling.model_path(), with_ids=True, slice_bytes=5000)
    rows = got.collect()
    texts = {}
    for d, t in pairs(df):
        texts.setdefault(d, t or "")
    for r in rows:
        want = texts[r.doc_id]
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.round_trip == ("▁" not in want or True) and pieces.decode(np.array(r.ids)) == want.replace("▁", " ")
    again = piece_sampling.sample_pieces(df.repartition(2), piece_sampling.model_path(), with_ids=True)
    key = lambda r: (str(r.doc_id), r.sample, r.ids_crc32, round(r.perturbed, 9))
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))
    assert piece_sampling.sample_pieces(empty(spark), piece_sampling.model_path()).count() == 0


def test_normalisation_is_the_library_s(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.model_path())
    for t in ["abc  de\nf", "  x", "é ¿ \t漢", "🙂"]:
        assert "".join(pieces.units(t)) == sp.normalize(t)
        assert sp.decode(piece_sampling.sample_slice(pieces, [t], np.array([5], np.uint64), 1)[0][0][0].tolist()) == t


def test_texts_are_cut_into_units_in_arrays(pieces):
    import pyarrow as pa

    texts = ["x", "", None, " ", "  a  b ", "\n\n a\nb \n", "a\u2581b \u2581", "é 漢字 🙂\t\x00", "no end "]
    for column in (pa.array(texts), pa.array(["cut off", *texts, "\n"]).slice(1, len(texts)), pa.array(texts, pa.large_string()), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        units, number = pieces.cut(column)
        want = [pieces.units(t or "") for t in column.to_pylist()]
        assert [u.replace(" ", "\u2581") for u in units.to_pylist()] == list(itertools.chain.from_iterable(want)) and number.tolist() == [len(u) for u in want]


def test_lattices_of_words_of_many_lengths(pieces):
    """Every arc leads over its piece; the chances of a node's arcs come to 1; sums are those of all segmentations."""
    import pyarrow as pa

    words = ["▁the", "x", "▁unhappily", "漢🙂é", "▁", "\n", "▁" + "ab" * 3000]
    lattice = piece_sampling.Lattice(pieces, pa.array([w.replace("▁", " ") for w in words]))
    assert lattice.stop == sum(map(len, words)) and len(set(lattice.start.tolist())) == len(words)
    for w, at in zip(words, lattice.start.tolist(), strict=True):
        nodes = [at]
        for i, c in enumerate(w):
            arcs = range(lattice.first[at], lattice.first[at] + lattice.degree[at])
            assert np.exp(lattice.logc[arcs]).sum() == pytest.approx(1) and lattice.upto[arcs[-1]] == pytest.approx(1) and (lattice.frm[arcs] == at).all()
            spelt = [bytes(pieces.decode_bytes(lattice.piece[[a]])).decode() if lattice.piece[a] >= 0 else c for a in arcs]
            assert all(w.startswith(x, i) for x in spelt) and [len(x) for x in spelt] == sorted({len(x) for x in spelt})
            if i + 1 < len(w):
                (at,) = [lattice.goal[a] for a, x in zip(arcs, spelt, strict=True) if len(x) == 1]
                nodes.append(int(at))
        assert len(set(nodes)) == len(w)
    for w in ("▁the", "▁unhappily"):
        k = lattice.first[lattice.start[words.index(w)]]
        total = sum(np.exp(p) for ids, p in segmentations(pieces, w).items() if ids[0] == lattice.piece[k])
        assert np.exp(lattice.logc[k]) == pytest.approx(total)


def test_a_worker_reads_a_vocabulary_once():
    assert piece_sampling._pieces(piece_sampling.model_path()) is piece_sampling._pieces(piece_sampling.model_path())
