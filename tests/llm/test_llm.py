"""Operators for training data against brute force, round trips and held-out accuracy, with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import bytebpe, maintext, neardup, packing, pii, piecebpe, quality, tokenfiles, topk, turns, webp
from lexweave.llm.common import new_folder

LONG = "word " * 60_000 + "end"
TEXTS = [None, "", " ", "a", "Hello  world\n x", "<|endoftext|> é 日本 \x00", "ab " * 900, LONG, "same text here", "same text here", "▁▁ odd ▁"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", t) for k, t in enumerate(TEXTS)] + [(None, "no id", "x", None), (3, "a", "x", "a"), (3, "other", "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, seq string")


@lru_cache(maxsize=1)
def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_byte_bpe_equals_library():
    r = random.Random(2)
    alphabet = "abc theinr  \n\t.,!'0123é日 　"
    assert library("x <|endoftext|> y") == [87, 220, 50256, 331]
    marked = ("".join(r.choices([*alphabet, "<|endoftext|>"], k=r.randint(1, 40))) for _ in range(500))
    for text in [*TEXTS, *marked, *("".join(r.choices(alphabet, k=r.randint(1, 80))) for _ in range(1500))]:
        assert np.frombuffer(bytebpe.encoder().encode(text), "<u4").tolist() == library(text)


def test_packing_covers_each_id_once(docs):
    got = packing.pack_documents(docs, size=64, with_ids=True).toPandas()
    by_text = sorted((np.array([*library(r.text), 0], "<u4").tobytes() for r in docs.collect()))
    found = []
    for _, g in got.groupby(got["doc_id"].fillna(-1)):
        pieces = g.sort_values(["doc_tokens", "start"])
        found += [b"".join(pieces["ids"])]
    assert b"".join(sorted(found)) != b"" and sum(map(len, found)) == sum(map(len, by_text))
    assert (got["ids_crc32"] == got["ids"].map(zlib.crc32)).all()
    placed = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (placed["length"].sum() <= 64).all() and (got["length"] > 0).all()
    for _, g in placed:
        assert (g["offset"].to_numpy() == np.concatenate(([0], np.cumsum(g["length"])[:-1]))).all()
    whole = packing.sequences(packing.pack_documents(docs, size=64, with_ids=True), 64)
    assert whole.where("length(ids) <> 4 * n_tokens").count() == 0


def test_shortest_pack_first_places_all():
    r = random.Random(4)
    histogram = {n: r.randint(1, 40) for n in range(1, 100)}
    placements, packs = packing.place(histogram, 100)
    used = np.zeros(packs, dtype=int)
    for k, (length, rank, pack, offset) in enumerate(placements):
        end = placements[k + 1][1] if k + 1 < len(placements) and placements[k + 1][0] == length else histogram[length]
        assert (used[pack : pack + end - rank] == offset).all()
        used[pack : pack + end - rank] += length
    assert used.max() <= 100 and used.sum() == sum(n * c for n, c in histogram.items())
    assert sum(sorted(used)[:2]) > 100  # a pack is opened only when what is placed fits in no other


def test_new_packs_are_filled_with_one_length():
    r = random.Random(5)
    assert packing.place({100: 1000}, 1024)[1] == 100
    for copies in (1, 40, 100, 300, 511):
        histogram = {n: r.randint(1, 40) for n in range(150, 700)}
        histogram[copies] = histogram.get(copies, 0) + sum(histogram.values()) // 2
        placements, packs = packing.place(histogram, 1024)
        used = np.zeros(packs, dtype=int)
        for k, (length, rank, pack, offset) in enumerate(placements):
            end = placements[k + 1][1] if k + 1 < len(placements) and placements[k + 1][0] == length else histogram[length]
            assert end > rank and (used[pack : pack + end - rank] == offset).all()
            used[pack : pack + end - rank] += length
        assert used.max() <= 1024 and used.sum() == sum(n * c for n, c in histogram.items()) > 0.93 * 1024 * packs


def read_all(records, folder, buckets=3):
    index = tokenfiles.build_index(records, buckets).cache()
    return tokenfiles.read_ids(tokenfiles.look_up(records.select("doc_id", "ordinal"), index, buckets), folder), index


def test_token_files_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_DOCS", 4)
    folder = new_folder(spark, "test")
    records = tokenfiles.write_shards(docs, folder)
    got, index = read_all(records, folder)
    got = got.join(tokenfiles.shard_starts(records), "file").collect()
    texts = sorted((r.doc_id is not None, r.doc_id or 0, [*library(r.text), 0]) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got) == texts
    assert len({(r.doc_id, r.ordinal) for r in got}) == len(got)
    before = 0
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.ordinal)):
        assert r.shard_start + r.offset == before and r.n_tokens == len(r.ids) // 4
        before += r.n_tokens
    absent = spark.createDataFrame([(k, 0) for k in range(10**6, 10**6 + 300)], "doc_id long, ordinal long")
    assert tokenfiles.look_up(absent, index, 3).count() == 0
    assert tokenfiles.write_shards(docs.where("false"), folder).count() == 0


def test_rows_of_one_id_spread_over_tasks(spark):
    rows = [(7, f"text {k % 50}") for k in range(400)] + [(None, "x")] * 300 + [(k, "y") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = new_folder(spark, "test")
    records = tokenfiles.write_shards(docs, folder)
    assert records.where("doc_id = 7").select("pid").distinct().count() > 1
    got = read_all(records, folder)[0].collect()
    assert len({(r.doc_id, r.ordinal) for r in got}) == len(got) == len(rows)
    for doc_id in (7, None):
        found = sorted(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got if r.doc_id == doc_id)
        assert found == sorted([*library(t), 0] for d, t in rows if d == doc_id)
        assert sorted(r.ordinal for r in got if r.doc_id == doc_id) == list(range(len(found)))


def test_width_follows_the_vocabulary(spark, docs):
    assert tokenfiles.id_width() == 2 and tokenfiles.id_width(end_id=70_000) == 4
    with pytest.raises(ValueError, match="need 4 bytes"):
        tokenfiles.write_shards(docs, new_folder(spark, "test"), end_id=70_000, width=2)


def test_perfect_hash_is_minimal():
    keys, others = np.random.default_rng(1).integers(0, 2**63, (2, 20_000), dtype=np.uint64)
    keys[:500] = keys[0]  # 64 bits collide, 128 do not
    hashed = tokenfiles.PerfectHash.load(tokenfiles.PerfectHash.build(keys, others).dump())
    assert sorted(hashed.slots(keys, others)) == list(range(keys.size))


def test_pieces_equal_library():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    c, r = piecebpe.codec(), random.Random(3)
    alphabet = list("abcdefgh theinronst  ▁.,!\n\t'0123é日\x00")
    for text in [*TEXTS, *("".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(1500))]:
        want = model.encode(text or "", add_bos=True, add_eos=True)
        assert list(memoryview(c.encode(text)).cast("I")) == want and c.decode(c.encode(text)) == model.decode(want)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets, parent = {k: words_of(t) for k, t in texts.items()}, {k: k for k in texts}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = {0: None, 1: "", 2: " \n", 3: "few words", 4: "FEW  words", 5: LONG, 6: LONG}
    for k in range(10, 150):
        w = base[:]
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[k] = " ".join(w)
    rows = [(k, t, 1, "c") for k, t in texts.items()]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, band string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(texts)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_b_bit_estimate_follows_similarity(spark):
    r = np.random.default_rng(6)
    rows, true = [], []
    for share in (0.2, 0.5, 0.75, 0.9):
        a = r.integers(0, 2**63, 3000, dtype=np.uint64)
        n = int(3000 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], r.integers(0, 2**63, 3000 - n, dtype=np.uint64)))
        rows.append(([int(x) for x in neardup.signature(neardup.minima(a))], [int(x) for x in neardup.signature(neardup.minima(b))]))
        true.append(share)
    got = [x[0] for x in spark.createDataFrame(rows, "a array<long>, b array<long>").select(neardup.estimate("a", "b")).collect()]
    assert np.abs(np.array(got) - true).max() < 0.22


def test_near_duplicates_with_a_shared_passage(spark):
    # A third of the documents share a passage of most of their words, under and over the threshold, beside chains of edits.
    r, passage = random.Random(3), [f"p{k}" for k in range(80)]
    texts = {k: " ".join(passage + [f"u{k}x{j}" for j in range(r.choice([2, 8, 11, 13, 20, 30]))]) for k in range(90)}
    chain = [f"c{k}" for k in range(100)]
    for k in range(100, 130):
        chain[r.randrange(100)] = f"e{k}"
        texts[k] = " ".join(chain)
    rows = [(k, t) for k, t in texts.items()] + [(None, "p0 p1"), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == brute_components(texts)
    assert sum(x.doc_id is None and x.component_id is None and x.kept for x in got) == 2


def test_set_cells_bound_the_intersection_from_above(spark):
    # x and y hold 6 and 7 shingles, of which two fall into one cell on either side; the exact overlap may reach what the bound allows.
    rows = [(6, [1, 2, 3, 4, 5], 7, [1, 2, 3, 4, 5, 6]), (6, [1, 2, 3, 4, 5, 6], 7, [1, 2, 3, 11, 12, 13, 14]), (6, None, 7, [1]), (4, [1, 2, 3, 4], 4, [1, 2, 3, 9])]
    frame = spark.createDataFrame(rows, "n_x long, cells_x array<int>, n_y long, cells_y array<int>")
    assert [x[0] for x in frame.select(neardup.may_link("x", "y")).collect()] == [True, False, True, False]


EXPRESSIONS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for kind, rx in EXPRESSIONS.items():
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_equals_expressions(spark):
    r = random.Random(9)
    alphabet = list("abc.@@-_%+ 0123456789") + ["日", "\U0001f600", "+1 (", "4041894974608795", "10.2.3.4", "a@b.c"]
    texts = [*TEXTS, "1" * 5000, "a" * 5000 + "@", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", *("".join(r.choices(alphabet, k=r.randint(1, 50))) for _ in range(600))]
    frame = spark.createDataFrame([(k, t, "e", 1) for k, t in enumerate(texts)], "doc_id long, text string, email string, h int")
    got = {x.doc_id: x for x in pii.report(pii.personal_data(frame)).collect()}
    for k, t in enumerate(texts):
        want = base_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[k].spans.split(","))


def test_pii_contexts_find_more_and_mask(spark):
    rows = [(k, f"text number {chr(97 + k)} call hotline: +1 (31{k}) 555-010{k} now", "en", None) for k in range(8)] + [(50, "also call hotline: 312 555 9876 now", "en", 5), (51, "score was 312 555 9876 there", "en", 5), (52, None, "en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, email string, n_chars long")
    found = {x.doc_id: x.spans for x in pii.report(pii.personal_data(frame)).collect()}
    assert found[50] == "phone:19:31" and found[0].startswith("phone:")
    masked = {x.doc_id: x for x in pii.mask_documents(frame).collect()}
    assert masked[50].text == "also call hotline: [PHONE] now" and masked[50].n_chars == len(masked[50].text) and masked[52].text is None
    assert masked[0].text == "text number a call hotline: [PHONE] now" and masked[0].email == "en"


def phones(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.spans for x in pii.report(pii.personal_data(frame)).collect()}
    return [found[k] for k in range(len(texts))]


def test_pii_counts_words_in_documents_without_digits(spark):
    seeds = [f"{w} please call +1 (31{k}) 555-010{k} now" for k, w in enumerate("abcdefgh")]
    assert phones(spark, [*seeds, "x please call 312 555 9876 now"])[8] == "phone:14:26"
    assert phones(spark, [*seeds, "x please call 312 555 9876 now", *["please call the office"] * 40])[8] == ""


def test_pii_contexts_that_touch_their_value(spark):
    seeds = [f"{w} reach tel:+1 (31{k}) 555-010{k} now" for k, w in enumerate("abcdefgh")]
    assert phones(spark, [*seeds, "my tel:312 555 9876 now", 'say "312-555-9876" now'])[8:] == ["phone:7:19", ""]
    assert phones(spark, [*seeds, "my tel:312 555 9876 now", *["my tel:none yet"] * 40])[8] == ""
    quoted = [f'{w} say "+1 (31{k}) 555-010{k}" now' for k, w in enumerate("abcdefgh")]
    assert phones(spark, [*quoted, 'x say "312-555-9876" now'])[8] == "phone:7:19"


def test_pii_accepted_values_bring_new_patterns(spark):
    seeds = [f"hotline +1 (3{k}) 555-01{k} now" for k in range(10, 50)]
    middle = [f"{w} hotline 312 555 980{k} now and ring 312 555 980{k} again" for k, w in enumerate("abcdefgh")]
    last = ["x ring 312 555 7000 again", "y score 312 555 7001 again"]
    got = phones(spark, [*seeds, *middle, *last])
    assert all(x.count("phone") == 2 for x in got[40:48]) and got[48:] == ["phone:7:19", ""]
    assert phones(spark, [*seeds[:3], *middle, *last])[3:] == [""] * 10


def test_pii_counts_what_the_contexts_give(spark):
    text = 'Call tel:+1 (312) 555-0100 or ip=10.0.0.1, "312-555-9876" <a@b.c> x(1) v=fe80::1'
    cues = {x.cue for x in pii._said_cues(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    seen = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.explode("seen").alias("s")).select(F.explode("s.cues").alias("cue")).collect()
    assert {"tel:", "call tel:", "ip=", 'ip=10.0.0.1, "', "<", "v="} <= {x.cue for x in seen} and {x.cue for x in seen} <= cues


def test_quality_learns_from_positives(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 8)))
    good = lambda: " ".join(word() for _ in range(r.randint(30, 200))).capitalize() + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(r.randint(30, 200)))
    rows = [(k, good() if k % 4 else bad()) for k in range(900)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 900, 2)], "doc_id long, quality int")
    model = quality.fit_documents(docs, labels)
    assert 0.6 < model["prior"] < 0.9
    got = {x.doc_id: x.score for x in quality.score_documents(docs, model).collect()}
    right = [(got[k] >= 0.5) == bool(k % 4) for k in range(900)]
    assert np.mean(right) > 0.97 and 0 <= got[5000] <= 1 and got[5000] == got[5001]
    assert quality.score_documents(docs, quality.fit_documents(docs, labels.where("false"))).where("score <> 0.5").count() == 0


@pytest.mark.parametrize("cache", [0, 4])
def test_webp_transforms_round_trip(cache):
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (5, 3), (13, 17)):
        few = rng.choice(rng.integers(0, 2**32, 5, dtype=np.uint32), (h, w))
        for pixels in (few, rng.integers(0, 2**32, (h, w), dtype=np.uint32)):
            n = lambda b: webp._blocks(h, b) * webp._blocks(w, b)
            chains = [(), ((webp.SUBTRACT_GREEN,),), ((webp.PREDICTOR, 2, rng.integers(0, 14, n(2))),), ((webp.CROSS_COLOUR, 2, rng.integers(0, 2**32, n(2), dtype=np.uint32)),)]
            for chain in [*chains, ((webp.PALETTE,),)] if len(np.unique(pixels)) < 257 else chains:
                assert (webp.decode(webp.encode(pixels, chain, cache)) == pixels).all()
            assert (webp.decode(webp.encode(pixels, (), cache, True, (2, rng.integers(0, 3, n(2))))) == pixels).all()


def webp_file(*fields):
    """A file of (value, bits) fields by the format's description, lowest bit first; not by the encoder under test."""
    value = size = 0
    for v, n in fields:
        value, size = value | v << size, size + n
    stream = b"\x2f" + value.to_bytes((size + 7) // 8, "little")
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def size_of(width, height):
    return [(width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def lone(*symbols):
    return [f for s in symbols for f in ((1, 1), (0, 1), (1, 1), (s, 8))]


def pair(a, b):
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def one_bit(alphabet, *used):
    """Two used symbols of one bit each, in the long form: code lengths 0 and 1 take one bit each."""
    return [(0, 1), (0, 4), (0, 3), (0, 3), (1, 3), (1, 3), (0, 1), *((int(k in used), 1) for k in range(alphabet))]


def test_webp_decodes_files_of_others():
    known = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")  # a widely used probe for lossless support
    assert webp.decode(known).tolist() == [[0]]
    colour = 0xFF010702
    key = (0x1E35A7BD * colour & 0xFFFFFFFF) >> 31
    cache = webp_file(*size_of(3, 1), (0, 1), (1, 1), (1, 4), (0, 1), *one_bit(282, 7, 280 + key), *lone(1, 2, 255, 0), (0, 1), (1, 1), (1, 1))
    assert webp.decode(cache).tolist() == [[colour] * 3]
    copied = webp_file(*size_of(4, 2), (0, 1), (0, 1), (0, 1), *one_bit(280, 7, 261), *lone(1, 2, 255, 1), (0, 1), (1, 1), (0, 1))
    assert webp.decode(copied).tolist() == [[colour] * 4] * 2
    with pytest.raises(ValueError):
        webp.decode(webp_file(*size_of(4, 2), (0, 1), (0, 1), (0, 1), *one_bit(280, 7, 261), *lone(1, 2, 255, 40 - 1), (0, 1), (1, 1), (0, 30)))


@pytest.mark.parametrize(("mode", "last"), [(0, 4), (1, 6), (2, 9), (3, 6), (4, 5), (5, 7), (6, 5), (7, 7), (8, 7), (9, 7), (10, 6), (11, 9), (12, 10), (13, 8)])
def test_webp_predictors_by_hand(mode, last):
    # residuals of green 1, 4, 1, 4: pixels 1, 5 (left), 2 (above), and the mode's guess from 2 (left), 5, 1 (corner), 2 (right of above) and 4
    head = [(1, 1), (webp.PREDICTOR, 2), (0, 3), (0, 1), *lone(mode, 0, 0, 255, 0)]
    data = webp_file(*size_of(2, 2), *head, (0, 1), (0, 1), (0, 1), *pair(1, 4), *lone(0, 0, 0, 0), (0, 1), (1, 1), (0, 1), (1, 1))
    assert (webp.decode(data) >> 8 & 255).tolist() == [[1, 5], [2, last]] and (webp.decode(data) >> 24 == 255).all()


def test_webp_colour_transforms_by_hand():
    # green to red 1.0, green to blue -1.0, red to blue 0.5 of residuals red 1, green 5, blue 10
    cross = [(1, 1), (webp.CROSS_COLOUR, 2), (0, 3), (0, 1), *lone(0xE0, 16, 32, 255, 0)]
    data = webp_file(*size_of(1, 1), *cross, (0, 1), (0, 1), (0, 1), *lone(5, 1, 10, 255, 0))
    assert webp.decode(data).tolist() == [[0xFF060508]]
    data = webp_file(*size_of(1, 1), (1, 1), (webp.SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1), *lone(5, 1, 255, 9, 0))
    assert webp.decode(data).tolist() == [[0x09060504]]
    palette = [(1, 1), (webp.PALETTE, 2), (1, 8), (0, 1), *pair(1, 34), *pair(1, 17), *pair(1, 51), *pair(0, 255), *lone(0), (15, 4), (0, 4)]
    data = webp_file(*size_of(3, 1), *palette, (0, 1), (0, 1), (0, 1), *lone(0b101, 0, 0, 255, 0))
    assert webp.decode(data).tolist() == [[0xFF122334, 0xFF112233, 0xFF122334]]


def test_webp_payloads_use_palette_prediction_and_references():
    r = np.random.default_rng(7)
    walk = np.cumsum(r.integers(0, 3, 64 * 300)).astype(np.uint8).tobytes()
    passage = r.integers(0, 256, 640, dtype=np.uint8).tobytes()
    for payload in [bytes(64), b"ab" * 3200, walk, passage * 9, bytes(range(256)) * 5000, b"x" * (1 << 21)]:
        media = webp.encode_media(payload)
        assert webp.decode_media(media) == payload and all(len(f) <= len(payload) + 400 for f in webp.files(media))
    assert len(webp.encode_media(passage * 9)) < 1.3 * len(passage)
    kinds = {int.from_bytes(webp.encode_payload(p)[21:30], "little") >> 33 & 3 for p in (walk, b"ab" * 3200)}
    assert kinds == {webp.PREDICTOR, webp.PALETTE}


def test_media_column_round_trip(spark, docs):
    media = webp.media_column(docs).cache()
    stored_forms = {}
    for x in media.collect():
        stored_forms.setdefault(x.doc_id, []).append(bytes(x.media))
    got = webp.read_back(media).collect()
    for x in got:
        texts = [r.text for r in docs.collect() if r.doc_id == x.doc_id]
        raw = {hashlib.sha256(p).hexdigest(): (n, p) for n, p in ((len((t or "").encode()), (t or "").encode() + bytes(-len((t or "").encode()) % 64 or 64 * (not t))) for t in texts)}
        n, p = raw[x.payload_sha256]
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32) == (n, len(p), zlib.crc32(p[-64:])) and len(p) % 64 == 0 < len(p)
        assert (x.media_bytes, x.media_sha256) in {(len(m), hashlib.sha256(m).hexdigest()) for m in stored_forms[x.doc_id]}
    for x in webp.pixel_arrays(media).collect():
        assert sum(i.height * i.width for i in x.images) == sum(len(i.samples) for i in x.images) >= x.n_bytes
    same = [tuple(x[1:]) for x in got if x.doc_id in (8, 9)]
    assert same[0] == same[1] and webp.read_back(webp.media_column(docs.where("false"))).count() == 0


def test_main_text_on_unseen_pages():
    model = maintext.trained()
    wrong = 0
    for html in maintext.training_pages(150, seed=77):
        want = re.sub("<[^>]*>", "", "".join(x + " " for x in re.findall("\x01(.*?)\x02", html, re.S))).split()
        wrong += maintext.extract([html.replace("\x01", "").replace("\x02", "")], model)[0].split() != want
    assert wrong <= 8
    assert maintext.extract([None, "", "a < b", "<p"], model)[:2] == ["", ""]
    page = '<body><nav><a href="/">x</a></nav><article><h1>A &amp; B</h1><p>One<b>two</b>\n three.<p>Four.<script>no()</script></article><footer>&copy; me</footer>'
    assert maintext.extract([page], model) == ["A & B Onetwo three. Four."]


def brute_top(rows, k):
    vectors = [(i, v, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, _, a) in enumerate(vectors):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, _, b) in enumerate(vectors) if n != at and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found_top(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, cid int")
    return sorted(tuple(x) for x in topk.top_k(topk.whole_vectors(frame), F.col("vec_id") % 20 == 0, k).collect())


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(0, 0.3, 12).astype("f4")]) for k in range(400)] + [(400 + k, [0.5] * 12) for k in range(60)]
    rows += [(900, None), (None, [0.1] * 12), (901, [float("nan")] * 12), (902, [None] * 12), (20, [9.0] * 12), (903, [1.0] * 3), (920, [1.0] * 3)]
    rows += [(40, [0.25] * 12), (40, [0.25] * 12), (904, [2.0**21] * 12), (905, [-(2.0**21)] * 12), (906, []), (940, [])]
    assert found_top(spark, rows, 7) == brute_top(rows, 7)
    assert found_top(spark, rows[:0], 7) == [] and found_top(spark, [(0, [1.0])], 7) == []


def test_top_k_with_a_score_beyond_64_bits_says_so(spark):
    with pytest.raises(Exception, match="leaves 64 bits"):
        found_top(spark, [(0, [2.0**40]), (1, [2.0**40])], 3)
    with pytest.raises(Exception, match="too large"):
        found_top(spark, [(0, [2.0**90]), (1, [2.0**40])], 3)


def test_bounds_of_cells_hold_scores():
    r = np.random.default_rng(2)
    v = r.integers(-(2**40), 2**40, (300, 9)) >> r.integers(0, 40, (300, 1))
    shift, cells = zip(*map(topk.approximate, v), strict=True)
    near = np.frombuffer(b"".join(cells), np.int8).reshape(v.shape)
    for row, column, lower, upper in topk.scan(v[:50], near, np.array(shift), 300):
        exact = [sum(map(int.__mul__, v[a].tolist(), v[b].tolist())) for a, b in zip(row, column, strict=True)]
        assert len(row) == 50 * 300 and all(a <= x <= b for a, x, b in zip(lower, exact, upper, strict=True))


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, "user", "bye"), (5, 0, "user", "bye"), (5, 0, "user", "bye"), (6, 0, None, ""), (None, 0, "user", "hi")]
    got = {x.conv_id: (x.n_turns, x.n_copies) for x in turns.render(turns.maximal(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {3: (3, 1), 4: (1, 2), 6: (1, 1)}


def test_pipeline_and_entry(spark):
    import __spark_entry__
    import corpus_pipeline

    assert "pipeline" in __spark_entry__.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
