"""The training-data operators on small rows against plain forms."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import bpe, forest, gif, linededup, media, minhash, packing, pii, quality, suffix, tokencount, wordbpe
from quirefold.llm import common as llm_common
from quirefold.llm.common import shared_dir
from quirefold.llm.queries import ORACLE, QUERIES, tokenizer_path

from ..compare import connect, same

TEXTS = [
    None, "", "   ", "Hello World's don't  I'LL\n", "café café ÉCOLE ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "a\x1c\x85 b", "日本語 한국어 \U0001f600",
    "same line of text here\nother", "SAME line of text here  \nthird", "word " * 3000, "tie", "tie",
]
DOCS = "doc_id long, text string, score double, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.0, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", 0.0, "x")], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_word_bpe_equals_library(library):
    random.seed(4)
    texts = [t or "" for t in TEXTS] + ["".join(random.choice("abcdeth'éßİ .,!7\n—́͸") for _ in range(80)) for _ in range(200)]
    own = wordbpe.WordBpe(tokenizer_path(), cached_chunks=20, cached_words=10)
    for part in (texts[:50], texts[50:]):
        for text, packed in zip(part, own.encode_group(part)):
            ids = ids_of(library, text)
            assert np.frombuffer(packed, "<u4").tolist() == ids
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(docs, empty, library):
    got = bpe.round_trip(docs, tokenizer_path()).collect()
    assert len(got) == len(TEXTS) + 1 and bpe.encode(empty, tokenizer_path()).count() == 0
    for r in got:
        ids = ids_of(library, "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert Counter(r["decoded"] for r in again.collect()) == Counter(r["decoded"] for r in got)


@pytest.mark.parametrize("common", [1, 1 << 18])
def test_token_counts(docs, empty, library, common):
    got = tokencount.count_tokens(docs, tokenizer_path(), common).collect()
    want = Counter((i, len((t or "").encode()), len(ids_of(library, t))) for i, t in [*enumerate(TEXTS), (None, "no id")])
    assert Counter(map(tuple, got)) == want
    assert tokencount.count_tokens(empty, tokenizer_path()).count() == 0


def test_packing(docs, empty, library):
    got = packing.pack_documents(docs, tokenizer_path(), limit=512, group_pieces=5).collect()
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
        ids = ids_of(library, "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]) + [2]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    assert max(filled.values()) <= 512
    assert sum(r["length"] for r in got) == sum(len(ids_of(library, t)) + 1 for t in [*TEXTS, "no id"])
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_first_fit_decreasing_equals_plain():
    random.seed(2)
    lengths = sorted((random.randint(1, 60) for _ in range(300)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        k = next((k for k, r in enumerate(rooms) if r >= n), len(rooms))
        if k == len(rooms):
            rooms.append(64)
        rooms[k] -= n
        want.append(k)
    assert packing.first_fit_decreasing(lengths, 64) == want
    assert packing.first_fit_decreasing([], 64) == []


def test_line_dedup(spark, docs, empty, sf):
    got = {r["doc_id"]: r for r in linededup.drop_shared_lines(docs).collect()}
    assert got[8]["text"] == TEXTS[8] and got[9]["text"] == "third" and got[9]["n_dropped"] == 1 and got[0]["n_lines"] == 1
    assert got[None]["text"] == "no id" and linededup.drop_shared_lines(empty).count() == 0
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.drop_shared_lines(docs, threshold=3).collect()}[9] == 0
    same(QUERIES["op6_line_dedup"](spark, sf).toPandas(), connect(sf).execute(ORACLE["op6_line_dedup"]).df())


def test_gif_codes():
    random.seed(5)
    for n in (0, 1, 2, 191, 5000, 60000):
        for letters in (b"a", b"ab", bytes(range(256))):
            data = bytes(random.choice(letters) for _ in range(n))
            assert gif.lzw_expand(gif.lzw_compress(data), 8, n) == data
    for bits in (2, 4):
        data = bytes(random.randrange(1 << bits) for _ in range(9000))
        assert gif.lzw_expand(gif.lzw_compress(data, bits), bits, 9000) == data


def _frame(x, y, w, h, samples, disposal=0, clear=None, delay=5, flags=0):
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
    return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags, 2]) + gif._in_blocks(gif.lzw_compress(bytes(samples), 2))


def test_gif_disposal_transparency_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a\x02\x00\x02\x00\x81\x00\x00" + palette
    data = head + _frame(0, 0, 2, 2, [1, 1, 1, 1], 1) + _frame(0, 0, 2, 1, [2, 0], 2, clear=0) + _frame(1, 1, 1, 1, [3], 3) + _frame(0, 0, 1, 1, [2], 0) + b"\x3b"
    f = list(gif.read_gif(data))
    assert [x.delay_ms for x in f] == [50] * 4
    assert f[1].canvas[0, 0].tolist() == [0, 255, 0, 255] and f[1].canvas[0, 1].tolist() == [255, 0, 0, 255]
    assert f[2].canvas[0].tolist() == [[0] * 4] * 2 and f[2].canvas[1, 1].tolist() == [0, 0, 255, 255]
    assert f[3].canvas[1, 1].tolist() == [255, 0, 0, 255] and f[3].canvas[0, 0].tolist() == [0, 255, 0, 255]
    tall = head[:6] + b"\x01\x00\x05\x00" + head[10:] + _frame(0, 0, 1, 5, [0, 1, 2, 3, 1], flags=0x40) + b"\x3b"
    assert next(gif.read_gif(tall)).samples == bytes([0, 3, 2, 1, 1])[:5]


def plain_lzw(data, bits):
    """A decoder that reads code by code, as the format's text has it."""
    number, clear = int.from_bytes(data, "little"), 1 << bits
    width, table, before, out = bits + 1, [], None, b""
    while True:
        code, number = number & ((1 << width) - 1), number >> width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
        elif code == clear + 1:
            return out
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            out, before = out + entry, entry
            if len(table) == 1 << width and width < 12:
                width += 1


def test_gif_against_other_data_and_a_plain_decoder():
    # A picture of 10 x 10 in four colours that was not made by this writer.
    other = bytes.fromhex("47494638396 10a000a00910000ffffffff00000000ff000000 21f90400000000002c000000000a000a0000 0216 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b".replace(" ", ""))
    (f,) = gif.read_gif(other)
    rows = [[1] * 5 + [2] * 5] * 3 + [[1, 1, 1, 0, 0, 0, 0, 2, 2, 2]] * 2 + [[2, 2, 2, 0, 0, 0, 0, 1, 1, 1]] * 2 + [[2] * 5 + [1] * 5] * 3
    assert f.samples == bytes(v for r in rows for v in r) and f.canvas[0, 0].tolist() == [255, 0, 0, 255] and f.canvas[0, 9].tolist() == [0, 0, 255, 255]
    random.seed(6)
    for n in (1, 700, 30000):
        for bits, letters in ((8, bytes(range(256))), (2, b"\0\1\3")):
            data = bytes(random.choice(letters) for _ in range(n))
            assert plain_lzw(gif.lzw_compress(data, bits), bits) == data


def test_damaged_gifs_are_null():
    random.seed(7)
    whole = media.to_gif(media.payload_of("".join(random.choice("abcdef ") for _ in range(9000)))[1])
    assert media.from_gif(whole)[0] is not None
    for cut in (1, 2, 10, 200, 1500, len(whole) - 5):
        assert media.from_gif(whole[:-cut]) == (None, [])
    at = 13 + 768 + 8 + 10
    assert whole[at] == 8
    for bits in (0, 1, 9, 200):
        assert media.from_gif(whole[:at] + bytes([bits]) + whole[at + 1 :]) == (None, [])
    assert media.from_gif(b"GIF89a" + b"\xff" * 4 + whole[10:]) == (None, [])
    assert media.from_gif(b"no gif at all") == (None, [])


def test_media(docs, empty):
    rows = media.read_frames(media.store_as_gif(docs)).collect()
    assert len(rows) == len(TEXTS) + 1 and media.read_frames(media.store_as_gif(empty)).count() == 0
    for r in rows:
        n, payload = media.payload_of("no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "")
        assert r["payload"] == payload and r["n_bytes"] == n and sum(sum(f["histogram"]) for f in r["frames"]) == len(payload)
    assert media.from_gif(None) == (None, []) and media.from_gif(b"GIF89a") == (None, [])


def test_quality_learns(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op1_quality"](spark, sf).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9


def test_quality_edges(docs, empty, spark):
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5} and quality.score(empty, None).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == len(TEXTS) + 1
    assert quality.keep_good(docs, model, 0.0).count() == len(TEXTS) + 1
    assert quality.fit(empty, labels) is None


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(4)
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        p = np.exp(sum(e[i] * y[i] for i in range(4)) + sum(trans[y[i], y[i + 1]] for i in range(3)))
        total += p
        good += p * np.array(y)
    got, _, z = quality.forward_backward(np.append(e, [9.0, 9.0])[None], np.array([[1, 1, 1, 1, 0, 0]], bool), trans)
    assert np.allclose(got[0, :4], good / total) and np.isclose(z[0], np.log(total))


def test_long_chains_equal_short_ones():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    for n in (2, 3, 50, 1000):
        e = rng.normal(size=n) * 3
        want, _, _ = quality.forward_backward(e[None], np.ones((1, n), bool), trans)
        assert np.allclose(quality.long_marginals(e, trans), want[0])


def test_document_score_equals_enumeration():
    rng = np.random.default_rng(4)
    d = len(quality.OWN) + 2 * len(quality.NEIGHBOUR) + 2
    model = quality.Model(rng.normal(size=d), rng.uniform(0.5, 2, d), rng.normal(size=d), 0.3, rng.normal(size=(2, 2)))
    texts = ["One line here.\nBUY NOW $$$ 99\n\nOne line here.", "", "x"]
    for text, got in zip(texts, model.score(texts)):
        x, _ = quality.line_features([text])
        e = ((x - model.mean) / model.scale) @ model.weights + model.bias
        size = np.array([len(line.encode()) + 1 for line in text.split("\n")])
        total, good = 0.0, np.zeros(len(e))
        for k in range(1 << len(e)):
            y = np.array([(k >> i) & 1 for i in range(len(e))])
            p = np.exp((e * y).sum() + sum(model.trans[y[i], y[i + 1]] for i in range(len(e) - 1)))
            total, good = total + p, good + p * y
        assert np.isclose(got, (good / total * size).sum() / size.sum())


def test_texts_of_very_many_lines(monkeypatch):
    d = len(quality.OWN) + 2 * len(quality.NEIGHBOUR) + 2
    rng = np.random.default_rng(5)
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=d), 0.1, rng.normal(size=(2, 2)))
    texts = ["".join(random.choice(["a b c d\n", "\n", "Some more. \n"]) for _ in range(700)), "short\ntext", "\n" * 300]
    want = model.score(texts)
    monkeypatch.setattr(quality, "LINES", 64)
    monkeypatch.setattr(quality, "LONG", 100)
    assert np.allclose(model.score(texts), want)
    assert 0 <= model.score(["\n" * 1_000_000])[0] <= 1


def test_pii(spark):
    t = ["Mail Ann.Lee@x.org or ann.lee@x.org, call +1 (456) 555-2186.", "+1 (456) 555-2186 again; card 4111 1111 1111 1111", "Mr. John Smith met Mrs. Smith; город", "plain", None, "", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"', "10.1.2.3 and 10.1.2.3", "v1.2.3", "plain"]
    rows = pii.replace_entities(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()
    out = [r["text"] for r in rows]
    assert [r["n_entities"] for r in rows] == [3, 2, 2, 0, 0, 0, 1, 2, 0, 0]
    assert (out[3], out[4], out[5], out[8]) == ("plain", None, "", "v1.2.3")
    a, b = out[0].split()[1], out[0].split()[3].rstrip(",")
    assert a == b and "@" in a and "lee" not in a.lower()
    phone = out[0][out[0].index("+1 (") :].rstrip(".")
    assert out[1].startswith(phone) and "456" not in phone[:8]
    digits = [int(c) for c in out[1] if c.isdigit()][-16:]
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    words = out[2].replace(";", "").split()
    assert words[2] == words[5] and words[2] != "Smith" and words[1] != "John" and words[-1] == "город"
    assert out[7].split()[0] == out[7].split()[2] != "10.1.2.3"


def test_surrogates_are_distinct(spark):
    e = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(300)] + [("word", x) for x in "abcdefgh"], "kind string, canon string")
    got = pii.surrogates(e).collect()
    assert len(got) == 308 and len({r["surrogate"] for r in got}) == 308 and not {r["surrogate"] for r in got} & {r["canon"] for r in got}
    assert {r["surrogate"] for r in pii.surrogates(e, "another key").collect()} != {r["surrogate"] for r in got}


def test_surrogates_end_where_entities_outnumber_values(spark, monkeypatch):
    # No draw below this one counts, so only widened formats are left.
    monkeypatch.setattr(pii, "WIDEN", 0)
    kinds = {"ssn": "123456789", "ip": "1.2.3.4", "card": "4111111111111111", "phone": "4565552186", "word": "王", "secret": "!!!!!!", "email": "a@b.org"}
    e = spark.createDataFrame([(k, c[:-1] + chr(ord(c[-1]) + i)) for k, c in kinds.items() for i in range(5)], "kind string, canon string")
    got = pii.surrogates(e).collect()
    assert len({r["surrogate"] for r in got}) == 35
    one = spark.createDataFrame([("word", chr(0x4E00 + i)) for i in range(90)], "kind string, canon string")
    monkeypatch.setattr(pii, "WIDEN", 2)
    assert len({r["surrogate"] for r in pii.surrogates(one).collect()}) == 90


def test_persons_keep_one_name(spark):
    t = ["Mr. John Smith and Dr. John Smith; Smith and John Smith, SMITH.", "Mr. John Ronald Smith met Ms. Sean O'Brien and Mrs. Anne-Marie Petit", "Smith alone", "Mr. 王小明, Dr. أحمد and г-н Иван Петров", "Mr. J. Smith"]
    out = [r["text"] for r in pii.replace_entities(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    words = lambda s: s.replace(",", "").replace(";", "").replace(".", "").split()
    _, john, smith, _, _, john2, smith2, smith3, _, john4, smith4, caps = words(out[0])
    assert john == john2 == john4 and smith == smith2 == smith3 == smith4 and caps == smith.upper() and smith != "Smith" and john != "John"
    assert john.endswith("n")
    second = words(out[1])
    assert second[1] == john and second[3] == smith and second[2] != "Ronald"
    assert second[7].startswith("O'") and second[7] != "O'Brien" and second[10].count("-") == 1 and "Marie" not in second[10]
    assert out[2] == t[2] and out[4].startswith("Mr. J. ") and words(out[4])[2] == smith
    _, han, _, arabic, _, _, given, family = words(out[3])
    assert han != "王小明" and all("\u4e00" <= c <= "\u9fff" for c in han) and len(han) == 3
    assert arabic != "أحمد" and all("\u0600" <= c <= "\u06ff" for c in arabic)
    assert given != "Иван" and family != "Петров" and all("\u0400" <= c <= "\u04ff" for c in given + family) and given[0].isupper()


def test_numbers_keep_their_rules(spark):
    t = ["+1 (456) 555-2186 is 456-555-2186", "DE89370400440532013000", "123-45-6789", "password=!!!!!!!! and token: abcdef12", "GB29NWBK60161331926819"]
    out = [r["text"] for r in pii.replace_entities(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    digits = lambda s: "".join(c for c in s if c.isdigit())
    a, b = out[0].split(" is ")
    assert digits(a) == "1" + digits(b) and "555" != digits(b)[3:6] and a.startswith("+1 (")
    for k in (1, 4):
        moved = out[k][4:] + out[k][:4]
        assert out[k] != t[k] and out[k][:2] == t[k][:2] and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    area, group, serial = out[2].split("-")
    assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    assert "!!!!!!!!" not in out[3] and "abcdef12" not in out[3] and out[3].startswith("password=")


def test_pii_edges(spark, empty):
    assert pii.replace_entities(empty).count() == 0
    long = "word " * 60_000 + "a@b.org " + "Mr. Quill " * 50
    d = spark.createDataFrame([(1, "a@b.org", "x", 5), (1, "a@b.org", "y", 6), (None, None, "z", 7), (2, long, "w", 8)], "doc_id long, text string, digest string, n_entities int")
    got = pii.replace_entities(d).collect()
    assert sorted(r["n_entities"] for r in got) == [0, 1, 1, 51] and {r["digest"] for r in got} == set("xyzw")
    assert all("a@b.org" not in (r["text"] or "") and "Quill" not in (r["text"] or "") for r in got)


def _near_texts():
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(90)]
    texts = []
    for k in range(60):
        own = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 6])):
            own[random.randrange(90)] = word()
        texts.append(" ".join(own))
    passage = [word() for _ in range(50)]
    texts += [" ".join(passage + [word() for _ in range(random.choice([3, 8, 30]))]) for _ in range(60)]
    for _ in range(10):
        # The sets are alike, the multisets are not.
        own = [word() for _ in range(200)]
        texts += [" ".join(own), " ".join(own[:100] + own[100:101] * 600 + own[100:])]
        passage = [word() for _ in range(60)]
        texts += [" ".join(passage * 30 + own[:10]), " ".join(passage * 2 + own[:10])]
    return texts + [" ".join(word() for _ in range(40)) for _ in range(30)] + ["a b c", "a b c", "", None, "  "]


@pytest.mark.parametrize("common", [1 << 16, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(llm_common, "COMMON", common)
    texts = _near_texts()
    sets = [minhash.weighted_set(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if minhash.similar(sets[i], sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, "z", "z")], "doc_id long, text string, label string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(d).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    kept = [r["doc_id"] for r in minhash.one_of_each(d).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(got.values())) and kept.count(None) == 1


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    w = rng.integers(1, 9, (2, 300))
    s = minhash.signatures([(e, w[0]), (e[:240], w[1][:240])], k=4096)
    low = np.minimum(w[0][:240], w[1][:240]).sum()
    assert abs((s[0] == s[1]).mean() - low / (w[0].sum() + w[1][:240].sum() - low)) < 0.04


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).round(3)
    v[10] = v[20] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (550, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.nearest(d, F.col("vec_id") % 50 == 0).collect()
    x = v / np.sqrt((v * v).sum(1))[:, None]
    hits = 0
    for q in range(0, 400, 50):
        s = x @ x[q]
        s[q] = -9
        want = np.lexsort((np.arange(400), -s.round(12)))[:5].tolist()
        own = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        hits += len(set(want) & set(own))
        assert len(own) == 5 and q not in own
    assert hits >= 0.9 * 40 and [r["vec_id"] for r in got if r["query_id"] == 0 and r["rank"] < 3] == [10, 20]
    assert not [r for r in got if r["query_id"] == 550]
    assert forest.nearest(d.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_of_very_large_and_very_small_components(spark):
    v = np.random.default_rng(4).normal(size=(60, 6))
    power = np.array([2.0**700, 1.0, 2.0**-700])[np.arange(60) % 3]
    rows = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    plain, scaled = (sorted(tuple(r) for r in forest.nearest(rows(x), F.col("vec_id") % 50 == 0, share=1.0).collect()) for x in (v, v * power[:, None]))
    assert len(plain) == 10 and scaled == plain


def test_repeated_passages(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    fresh = lambda n: [word() for _ in range(n)]
    passage, short = fresh(70), fresh(40)
    texts = [" ".join(fresh(random.randint(0, 90)) + passage + fresh(30)) for _ in range(12)] + [" ".join(fresh(60) + short) for _ in range(4)] + [" ".join(fresh(20) + passage * 2)] + ["", None, "few words"]
    texts += [texts[12], " ".join(passage[:49])]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, seeds string")
    got: dict[int, set] = {}
    for r in suffix.repeated_passages(d).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["removable"] == (r["other_doc_id"] < r["doc_id"])
    held: dict[tuple, set] = {}
    split = [(t or "").split() for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want: dict[int, set] = {}
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            if len(held[tuple(w[k : k + 50])]) > 1:
                want.setdefault(i, set()).update(range(k, k + 50))
    assert set(got) == set(want)
    assert all(len(want[i] - got[i]) <= 0.05 * len(want[i]) and not got[i] - want[i] for i in want)
    assert suffix.repeated_passages(d.where("doc_id < 0")).count() == 0
    assert suffix.cut_passages("a  b c\nd", [(1, 3)]) == "a  \nd"


def removable_words(texts, found):
    """The removable words of each document; every repeated word stays in a document that has it amid the same run of 50."""
    gone: dict[int, set] = {i: set() for i in texts}
    for r in found:
        assert r["removable"] == (r["other_doc_id"] < r["doc_id"])
        if r["removable"]:
            gone[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    runs: dict[tuple, list] = {}
    for i, words in texts.items():
        for k in range(len(words) - 49):
            runs.setdefault(tuple(words[k : k + 50]), []).append((i, k))
    alike: dict[tuple, set] = {}
    for places in runs.values():
        for n in range(50) if len({i for i, _ in places}) > 1 else ():
            joined = set().union(*(alike.get((i, k + n), {(i, k + n)}) for i, k in places))
            alike.update(dict.fromkeys(joined, joined))
    assert all(any(k not in gone[i] for i, k in words) for words in alike.values())
    return gone


def test_repeated_words_stay_in_one_document(spark):
    random.seed(15)
    fresh = lambda n: ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    shared, first, second = fresh(60), fresh(60), fresh(60)
    group = fresh(80) + shared + fresh(70)
    texts = {5: fresh(30) + shared + fresh(40) + first, 10: group, 20: group, 30: group, 100: first + second, 900: fresh(9) + first[40:] + second}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    gone = removable_words(texts, suffix.repeated_passages(d).collect())
    assert gone == {5: set(), 10: set(range(80, 140)), 20: set(range(210)), 30: set(range(210)), 100: set(range(60)), 900: set(range(9, 89))}


def test_repeated_passage_stays_in_smallest_document_only(spark):
    random.seed(16)
    fresh = lambda n: ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts, want = {}, {}
    for n, size in enumerate((50, 52, 55, 60)):
        passage = fresh(size)
        for i in range(n * 40, n * 40 + 40):
            at = random.randint(0, 60)
            texts[i] = fresh(at) + passage + fresh(random.randint(0, 60))
            want[i] = set(range(at, at + size)) if i % 40 else set()
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert removable_words(texts, suffix.repeated_passages(d).collect()) == want


def test_no_passage_is_lost_among_documents_that_share_its_end(spark):
    random.seed(18)
    fresh = lambda n: ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts, want = {}, {}
    for f in range(40):
        passage, holders = fresh(55), random.sample(range(32), 2)
        for k in range(32):
            i, at = f * 32 + k, random.randint(0, 40)
            part = passage if k in holders else passage[-30:]
            texts[i] = fresh(at) + part + fresh(random.randint(1, 40))
            if k in holders:
                want[i] = [(at, at + 55)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, suffix.repeated_passages(d).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    assert found[0] == found[1]
    assert {i: [(s, e) for j, s, e, _, _ in found[0] if j == i] for i in want} == want and len(found[0]) == 80


def test_passages_repeated_within_documents_at_borders(spark):
    random.seed(17)
    fresh = lambda n: ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage = fresh(110)
    texts = {i: [w for _ in range(30) for w in fresh(60) + passage] for i in (3, 8)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = suffix.repeated_passages(d).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    held = {i: sorted((r["start_word"], r["end_word"]) for r in found if r["doc_id"] == i) for i in texts}
    assert held == {i: [(k * 170 + 60, k * 170 + 170) for k in range(30)] for i in texts}
    assert removable_words(texts, found) == {3: set(), 8: {k * 170 + n for k in range(30) for n in range(60, 170)}}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = f"{shared_dir(spark)}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
        assert 0 < kept.count() <= docs.count()
    final = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
