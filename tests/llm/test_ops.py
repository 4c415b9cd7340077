"""Small tests of the numbered operators: brute force, round trips and odd rows."""

import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lorebase.llm import jpeg, warc
from lorebase.llm.curriculum import curriculum_mix
from lorebase.llm.exact_dedup import exact_dedup
from lorebase.llm.kernel import flat, shingles
from lorebase.llm.licenses import CONFIRM, NOTICES, OTHERWISE, STEP, UNKNOWN, WINDOW, fit_licences, gate, inline_ngrams, scan_licences
from lorebase.llm.packing import Packer, pack_documents
from lorebase.llm.tokens import encoder
from lorebase.llm.toxicity import toxicity
from lorebase.llm.wavelet import WaveletMatrix, read_tokens, write_tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n", "it's 'till don't", "a<|endoftext|>b <|ENDOFTEXT|>", "naïve İ! × ÷ x×y", "a\x0cb!\x0c! \x0b", "日本語 text… !…! ½ ²3", "12345 a1b2", "ÉCOLE.ÀB nb", "don’t “q”", "a" * 5000, "é́ ≠ éa", "ΣΑΣ Σας", "👍🏽!!👍", "the same", "the same"]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")


def ids_of(text):
    return encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_dedup(spark):
    texts = ODD + ["the same"] * 40 + ["copy", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "copy"), (None, "alone")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), fan_in=2, leaves=8).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup(table(spark, [])).count() == 0


def test_tokens_and_wavelet_files(spark):
    texts = [t for t in ODD]
    files = write_tokens(table(spark, texts), TOKENIZER, shards=3)
    got = {r["doc_id"]: r for r in read_tokens(files).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = ids_of(t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids)), t
        at += len(ids)
    assert read_tokens(write_tokens(table(spark, []), TOKENIZER)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 512, 3000])
def test_wavelet_matrix_queries(n, monkeypatch):
    from lorebase.llm import wavelet

    monkeypatch.setattr(wavelet, "CHUNK", 128)  # several chunks a plane
    ids = np.random.default_rng(3).integers(0, 49_408, n)
    ids[::7] = 11
    raw = wavelet.dump([1, None], np.array([n // 3, n - n // 3]), WaveletMatrix.of(ids))
    read = []
    at = lambda size, place: read.append(size) or raw[place : place + size]
    for m in (WaveletMatrix.of(ids), wavelet.load(at)[2]):
        assert m.n == n and (m.tokens(0, n) == ids).all() and (m.tokens(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
        for i in {0, 1, 511, 512, 513, n - 1} & set(range(n)):
            assert m.access(i) == ids[i]
            assert m.rank(11, i) == int((ids[:i] == 11).sum())
        assert m.count(11) == int((ids == 11).sum()) and m.count(70_000) == 0
        assert m.locate(11) == np.flatnonzero(ids == 11).tolist()
    if n == 3000:  # one question reads a part of the file
        whole, read[:] = sum(read), []
        m = wavelet.load(at)[2]
        head, read[:] = sum(read), []
        assert m.access(77) == ids[77] and sum(read) < 0.8 * (len(raw) - head)
    with pytest.raises(ValueError):
        wavelet.load(lambda size, place: b"none"[:size])


def test_packing_covers_every_id_once(spark):
    r = random.Random(5)
    texts = ODD + [" ".join("w%d" % r.randrange(99) for _ in range(r.choice((3, 40, 300, 4000)))) for _ in range(60)]
    got = pack_documents(table(spark, texts), TOKENIZER, tokens=256, segments=8).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in enumerate(texts):
        ids, at = ids_of(t), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]]) and bytes(p["ids"]) == np.array(ids[at : at + p["length"]], "<u4").tobytes()
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at & (at - 1) == 0 and at <= 256 and len(pieces) <= 8  # no padding at all
    assert pack_documents(table(spark, []), TOKENIZER).count() == 0


def test_packing_keeps_all_limits():
    r, packer, pieces = random.Random(1), Packer(64, segments=4, loss=40, window=16), []
    prompts = {}
    for i in range(200):
        n = r.randint(1, 150)
        prompts[i] = r.randint(0, n)
        pieces += packer.add(i, n, prompts[i])
    pieces += packer.finish()
    total, loss, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, start, length, sequence, _ in pieces:
        total[sequence] += length
        count[sequence] += 1
        loss[sequence] += max(0, start + length - max(start, prompts[i]))
    assert max(total.values()) <= 64 and max(count.values()) <= 4 and max(loss.values()) <= 40


def test_warc_round_trip(spark):
    html = ["<p>" + "x" * 1200, None, "", "<p>" + "x" * 1200, "short", "short", "é" * 600, "é" * 600 + "!"]
    pages = spark.createDataFrame([(i, f"http://h/{i} a", t, "c") for i, t in enumerate(html)] + [(3, None, html[0], "c"), (None, "u", html[0], "c")], "page_id long, url string, html string, digest string")
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert len(got) == len(html) + 2
    for r in got:
        t = ("" if r["page_id"] == 1 else html[r["page_id"]] if r["page_id"] is not None else html[0]).encode()
        assert r["payload_bytes"] == len(t) and r["payload_digest"] == hashlib.sha1(t).hexdigest()
        revisit = r["page_id"] in (0, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert (r["payload"] is None) == revisit and (revisit or bytes(r["payload"]) == t)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_reader_finds_damage():
    good = warc.member(warc.record(1, "http://a", b"x" * 300_000, hashlib.sha1(b"x" * 300_000).hexdigest(), None))
    two = list(warc.records(io.BytesIO(good * 2)))
    assert len(two) == 2 and warc.parse(*two[1])["payload_bytes"] == 300_000
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-40])))
    bad = warc.member(warc.record(1, "http://a", b"abc", hashlib.sha1(b"abd").hexdigest(), None))
    with pytest.raises(ValueError):
        warc.parse(*next(warc.records(io.BytesIO(bad))))


def test_jpeg_media(spark):
    texts = ODD + ["z" * 64, "y" * 65, "long " * 120_000]
    got = {r["doc_id"]: r for r in jpeg.media_columns(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert got[len(texts) - 1]["images"] == 2 and got[15]["feature"] == got[16]["feature"]
    assert jpeg.media_columns(table(spark, [])).count() == 0


def test_jpeg_decoders_agree_and_take_ac():
    raw = jpeg.dc_image(np.random.default_rng(2).integers(0, 256, 64 * 5, dtype=np.uint8).tobytes())
    f, _ = jpeg.parse(raw)
    assert (jpeg._scalar(f, raw) == jpeg._lanes([(f, np.frombuffer(raw, np.uint8))])[0]).all()
    # one block with DC 5 (category 3) and one AC coefficient, then end of block; no restarts
    bits = "10" + "101" + "10" + "1" + "0"
    bits += "1" * (-len(bits) % 8)
    seg = jpeg._segment
    dht = lambda c, n2, s: seg(0xC4, bytes([c]) + bytes([1, 1] + [0] * 14) + bytes(s))
    one = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + dht(0, 1, [0, 3]) + dht(0x10, 1, [0, 1]) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\xff\xd9"
    ((grey, frame),) = jpeg.thumbnails([one])[0]
    assert frame.width == 8 and grey.tolist() == [[128 + 10]]
    with pytest.raises(ValueError):
        jpeg.thumbnails([b"\xff\xd8" + seg(0xC2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + b"\xff\xd9"])


def test_shingles_of_short_and_empty_texts():
    import pyarrow as pa

    data, offs = flat(pa.array(["a b", "A  B", "ab", "", " ", "a b c a b c a b c"]))
    s = [x.tolist() for x in shingles(data, offs, 3)]
    assert s[0] == s[1] != s[2] and s[3] == s[4] == [] and len(s[5]) == 3


def test_licences(spark):
    model = fit_licences(spark)
    lines = [n for own in NOTICES.values() for n in own]
    rows = [(i, f"Some prose.\n\n{n}\nmore") for i, n in enumerate(lines)] + [(1000 + i, s) for i, s in enumerate(OTHERWISE)] + [(2000, None), (2001, ""), (None, "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    families = [f for f, own in NOTICES.items() for _ in own]
    right = sum(f in got[i]["families"].split(",") for i, f in enumerate(families))
    assert right >= 0.9 * len(families)
    assert all(got[1000 + i]["n_notices"] == 0 for i in range(len(OTHERWISE))) and got[2000]["n_lines"] == 0
    assert got[None]["families"] == "mit" and got[None]["notices"][0]["line"] == 0
    assert scan_licences(table(spark, []), model=model).count() == 0


def test_licences_in_wrapped_paragraphs(spark):
    import textwrap

    model = fit_licences(spark)
    long = [(f, n) for f, own in NOTICES.items() for n in own if len(n) > 90]
    prose = " ".join(f"walk{i % 17} over hill{i % 23}" for i in range(300))
    rows, want = [], []
    for f, n in long:
        for mark in ("", " * ", "# "):
            body = "\n".join(mark + x for x in textwrap.wrap(n, 72 - len(mark)))
            rows.append((len(rows), f"A title\n\n{body}\n\nmore"))
            want.append(f)
        rows.append((len(rows), "\n".join(textwrap.wrap(f"{prose} {n} {prose}", 72))))
        want.append(f)
    rows += [(1000, "\n".join(textwrap.wrap(" ".join(OTHERWISE), 72))), (1001, "\n".join(textwrap.wrap(prose, 72)))]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    missed = [(rows[i], f) for i, f in enumerate(want) if f not in got[i]["families"].split(",")]
    assert not missed
    assert all(2 <= n["line"] < 2 + rows[i][1].count("\n") - 3 for i in range(len(want)) if i % 4 < 3 for n in got[i]["notices"])
    assert got[1000]["n_notices"] == got[1001]["n_notices"] == 0


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 5))) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.2
        if toxic:
            words[r.randrange(len(words))] = r.choice(("Idiot,", "moron", "scumbag", "scumbags"))
        if r.random() < 0.2:
            words.append(r.choice(("muslim", "gay")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, "A muslim is here."), (2001, "A christian is here."), (None, "moron"), (2002, None)]
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")).collect()
    by = {x["doc_id"]: x for x in got}
    truth = dict(labels)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i]["held_out"] == (i in set(held)) for i in range(900))
    assert sum((by[i]["predicted"] == 1) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    assert by[2000]["predicted"] == by[2001]["predicted"] == 0 and abs(by[2000]["score"] - by[2001]["score"]) < 0.05
    assert by[None]["predicted"] == 1 and by[2002]["predicted"] == 0
    none = toxicity(table(spark, ["x"]), spark.createDataFrame([], "doc_id long, toxic int")).first()
    assert none["score"] == 0.5


def test_mix_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 50))), r.choice(("a", "b", "é", None, "c", "z"))) for i in range(400)] + [(None, None, "a"), (7, "", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = curriculum_mix(d).collect(), curriculum_mix(d.repartition(3), blocks=5).collect()
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # the excess of capped sources is dealt again
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for x in got:
        taken[x["source"]] += x["taken"]
        assert 0 <= x["taken"] <= 2 * x["size"] and abs(x["target"] - target[x["source"]]) < 1e-6 and x["source_size"] == sizes[x["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    at = [x["position"] for x in got if x["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert sum(x["taken"] for x in again) == sum(x["taken"] for x in got)
    assert curriculum_mix(d.limit(0)).count() == 0


def test_licence_query_gives_notices(spark, tmp_path):
    import json

    from lorebase.llm.queries import op5_license_scan

    spark.createDataFrame([(1, "Prose.\nReleased under the MIT License."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_license_scan(spark, str(tmp_path)).collect()}
    (notice,) = json.loads(got[1]["notices"])
    assert (notice["line"], notice["family"]) == (1, "mit") and notice["probability"] == got[1]["score"] and notice["overlap"] > 0.5
    assert got[2]["notices"] == "[]"


def test_licence_gate_loses_nothing():
    r, cues = random.Random(3), gate(NOTICES, CONFIRM)
    every = [w for own in NOTICES.values() for n in own for w in n.lower().split()]
    for _ in range(4000):  # parts of notices with words put in and left out
        n = r.choice([n for own in NOTICES.values() for n in own])
        w = [x for x in re.findall("[a-z0-9]+", n.lower()) if r.random() < 0.9]
        for _ in range(r.randint(0, 3)):
            w.insert(r.randint(0, len(w)), r.choice(every))
        a = r.randint(0, len(w) // 2)
        text = " ".join(w[a : a + r.randint(3, 40)])
        grams = set(inline_ngrams(text)) | set(text.split())
        best = max(sum(g in grams for g in t) / len(t) for t in (inline_ngrams(n) for own in NOTICES.values() for n in own))
        assert best < CONFIRM or any(c in " ".join(re.findall("[a-z0-9]+", text)) for c in cues), text


def plain_scan(model, text, certain=0.5, confirm=CONFIRM):
    """The notices of one text in plain Python, every line and window scored."""
    find = lambda x: re.findall("[a-z0-9]+", x.lower())
    shapes = {f: [inline_ngrams(n) for n in NOTICES.get(f, ())] for f in model.classes}

    def judge(w):
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        z = np.array(model.intercepts) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.classes)))
        p = np.exp((z - z.max()) / model.temperature)
        p /= p.sum()
        family = model.classes[int(p.argmax())]
        overlap = max((sum(g in grams for g in t) / len(t) for t in shapes[family]), default=0.0)
        return (family, p.max(), overlap) if family != UNKNOWN and p.max() >= certain and overlap >= confirm else None

    lines = [find(x) for x in text.split("\n")]
    found = [(i, *j) for i, w in enumerate(lines) if w and (j := judge(w))]
    more, start = [], None
    for i, w in enumerate([*lines, []]):
        if w and start is None:
            start = i
        if not w and start is not None:
            own = [(x, k) for k in range(start, i) for x in lines[k]]
            if i - start > 1 or len(own) > WINDOW:
                kept = []
                for k in range(max(0, -(-(len(own) - WINDOW) // STEP)) + 1):
                    part = own[k * STEP : k * STEP + WINDOW]
                    if j := judge([x for x, _ in part]):
                        kept.append((k, part[0][1], part[-1][1], j))
                for k, a, b, j in kept:
                    near = any(y[3][0] == j[0] and k - (WINDOW - 1) // STEP <= y[0] < k for y in kept)
                    if not near and not any(y[1] == j[0] and a <= y[0] <= b for y in found):
                        more.append((a, *j))
            start = None
    return sorted(found + more)


def test_licences_against_plain_scorer(spark):
    import textwrap

    r, model = random.Random(8), fit_licences(spark)
    # Notices that the model was not fitted on: their families in other words and wrapping.
    own = [("mit", "This tool is free software. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use these files except in compliance with the License."), ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3")]
    every = [n for x in NOTICES.values() for n in x] + list(OTHERWISE)
    texts = [n for _, n in own] + [None, "", "a licence"]
    for _ in range(60):
        parts = [" ".join(r.choice(every).split()[: r.randint(3, 60)]) for _ in range(r.randint(1, 4))]
        prose = " ".join(r.choice(("river", "stone", "software", "version", "public", "walks")) for _ in range(r.randint(0, 90)))
        whole = r.choice((" ", "\n\n", "\n", "\n\n  # ")).join([*parts, prose] if r.random() < 0.5 else [prose, *parts])
        texts.append("\n".join("\n".join(textwrap.wrap(x, 72)) for x in whole.split("\n")) if r.random() < 0.5 else whole)
    got = {x["doc_id"]: x for x in scan_licences(table(spark, texts), model=model).collect()}
    for i, t in enumerate(texts):
        want = plain_scan(model, t or "")
        mine = sorted((n["line"], n["family"], n["probability"], n["overlap"]) for n in got[i]["notices"])
        assert [x[:2] for x in mine] == [x[:2] for x in want] and np.allclose([x[2:] for x in mine], [x[2:] for x in want]), t
    assert all(f in got[i]["families"].split(",") for i, (f, _) in enumerate(own))


def test_licences_of_odd_tables(spark):
    model = fit_licences(spark)
    long = "word " * 200_000 + "\nReleased under the MIT License."
    rows = [(1, "Released under the MIT License.", 1, "x"), (1, "Released under the MIT License.", 2, "y"), (2, long, 3, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines int, tokens string")
    got = sorted((r["doc_id"] or 0, r["n_notices"], r["families"]) for r in scan_licences(docs, model=model).collect())
    assert got == [(0, 0, ""), (1, 1, "mit"), (1, 1, "mit"), (2, 1, "mit")]


def test_toxicity_against_plain_scorer(spark):
    from lorebase.llm.toxicity import fit_toxicity, lowered, text_features

    r, rows, labels = random.Random(2), [], []
    for i in range(300):
        w = ["".join(r.choice("abcdé") for _ in range(r.randint(2, 5))) for _ in range(r.randint(0, 30))] + (["moron"] if i % 4 == 0 else [])
        r.shuffle(w)
        rows.append((i, r.choice((" ", ", ", "\n")).join(w), 0.5, "a"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1, rows[1][1], 0.5, "a"), (None, None, None, None), (900, "", 0.1, "b"), (901, "Moron " * 40_000, 0.1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, lab)
    weight = dict(zip(model.places.tolist(), model.values.tolist()))
    got = toxicity(docs, lab).collect()
    assert len(got) == len(rows) and toxicity(docs.limit(0), lab).count() == 0
    want = defaultdict(set)
    for i, t, _, _ in rows:
        z = model.intercept + sum(weight.get(f, 0.0) for f in text_features(t or "").tolist())
        want[i].add(round(1 / (1 + np.exp(-z)), 5))
    assert all(round(x["score"], 5) in want[x["doc_id"]] and (x["predicted"] == 1) == (x["score"] >= 0.3) for x in got)
    assert all(x["predicted"] == 1 for x in got if x["doc_id"] == 901)
    assert bytes(lowered(np.frombuffer("ÀB×É".encode(), np.uint8))).decode() == "àb×é"


def test_odd_rows_of_the_other_operators(spark):
    """Null identifiers, repeated rows, clashing names and long texts."""
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, "one two", "a", 1), (1, "one two", "a", 1), (None, "one two", None, 2), (2, long, "b", 3), (None, None, "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").withColumns({c: F.lit(c) for c in ("shard", "width", "ids", "key", "name", "position", "block", "taken", "sha", "leaf", "prompt", "payload")})
    n = {t: len(ids_of(t)) for t in ("one two", long, "")}
    tokens = sorted(r["n_tokens"] for r in read_tokens(write_tokens(docs, TOKENIZER)).collect())
    assert tokens == sorted(n[t or ""] for _, t, _, _ in rows)
    packed = defaultdict(int)
    for p in pack_documents(docs, TOKENIZER, with_ids=False).collect():
        packed[p["doc_id"]] += p["length"]
    assert packed == {1: 2 * n["one two"], 2: n[long], None: n["one two"] + n[""]}
    media = sorted((r["doc_id"] or 0, r["n_bytes"]) for r in jpeg.media_columns(docs, with_media=False).collect())
    assert media == sorted((i or 0, len((t or "").encode())) for i, t, _, _ in rows)
    mix = curriculum_mix(docs).collect()
    assert len(mix) == len(rows) and sum(x["size"] for x in mix) == 150_006
    deduped = exact_dedup(docs).collect()
    assert sum(x["kept"] for x in deduped) == 3 and len(deduped) == len(rows)
