"""Operators on single texts, held against plain Python."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import bpe, chat, licenses, quality, secrets, tokenfile, tokens

from .conftest import collected, key, prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_against_plain_python(spark, sf, rows):
    def plain(text):
        text = text or ""
        ws = W.findall(text)

        def covered(n):
            c = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
            hit = set()
            for i in range(len(ws) - n + 1):
                if c[tuple(ws[i : i + n])] > 1:
                    hit.update(range(i, i + n))
            return hit

        lines = Counter(x for x in text.split("\n") if W.search(x))
        m = {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(v - 1 for v in lines.values()), "n_repeat_words": len(covered(3))}
        m["dup_line_chars"] = sum((v - 1) * sum(map(len, W.findall(x))) for x, v in lines.items())
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        bad = 100 * m["dup_line_chars"] > quality.LINE_LIMIT * m["word_chars"] or 100 * m["n_symbols"] > quality.SYMBOL_LIMIT * m["n_words"]
        for n, most in quality.COVER_LIMITS.items():
            m[f"dup_chars_{n}"] = sum(len(ws[i]) for i in covered(n))
            bad = bad or 100 * m[f"dup_chars_{n}"] > most * m["word_chars"]
        return (*[m[c] for c in quality.COUNTS[:5]], failed, not failed and not bad, *[m[c] for c in quality.COUNTS[5:]])

    got = collected(quality.op4_quality(spark, sf))
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=key)


def test_quality_keeps_columns(docs):
    out = quality.score(docs)
    assert out.columns == [*docs.columns, "__quality"]
    assert sorted(map(repr, out.drop("__quality").collect())) == sorted(map(repr, docs.collect()))


@given(st.lists(st.text(alphabet="ab \n*\x0b\u00a0é", max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_measure_on_any_texts(texts):
    if not texts:
        return
    m = quality.measure(texts)
    for k, t in enumerate(texts):
        assert m["n_words"][k] == len(W.findall(t))
        ws = W.findall(t)
        c = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        hit = {j for i in range(len(ws) - 4) if c[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert m["dup_chars_5"][k] == sum(len(ws[j]) for j in hit)


def test_quality_limits_decide_on_what_base_passes():
    fresh = [f"w{k:03d}" for k in range(400)]
    block, short = " ".join(fresh[:20]), " ".join(fresh[:6])
    texts = [
        "\n".join([block, " ".join(fresh[100:130]), block, " ".join(fresh[200:230])]),  # 40 of 100 words in repeated 10-grams
        "\n".join([short, " ".join(fresh[100:130]), short, " ".join(fresh[200:230])]),  # one short line said twice
        "\n".join(x for k in range(20) for x in ("again this", " ".join(fresh[7 * k : 7 * k + 7]))),  # a quarter in a line that is too short for n-grams
    ]
    m = quality.measure(texts)
    failed, kept = quality.verdicts(m)
    assert (m["dup_chars_10"] * 100 // m["word_chars"]).tolist() == [40, 0, 0]
    assert (m["dup_line_chars"] * 100 // m["word_chars"]).tolist() == [20, 8, 23]
    assert failed.tolist() == [False] * 3
    assert kept.tolist() == [False, True, False]


KEY = "AKIA" + "Q7" * 10
ASSIGN = 'password = "hunter2x"'


def base_plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@given(st.lists(st.sampled_from(["password", "SECRET", "token", "apikey", "api_key", "=", ": ", '"', "'", " ", "abcdef", "ab12", "AKIA", "AKIA", "Z9" * 8, "deadbeef" * 3, "f", "ſ", "é", "\n", "."]), max_size=25))
@settings(max_examples=300, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == base_plain(text)


def b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: b64(s.encode()),
        lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: b64(zlib.compress(s.encode())),
        lambda s: b64(gzip.compress(s.encode())),
        lambda s: b64(b64(s.encode()).encode()),
        lambda s: urllib.parse.quote(b64(gzip.compress(b64(s.encode()).encode())), safe=""),
        lambda s: "".join(f"\\x{ord(c):02x}" for c in b64(s.encode())),
    ],
)
def test_secrets_in_layers(wrap):
    inner = wrap(f"key {KEY} and {ASSIGN} so")
    text = f"élan {inner} tail"
    spans = secrets.all_spans(text)
    kinds = {k for _, k, _ in spans}
    assert {"access", "assign"} <= kinds
    at, to = text.index(inner), text.index(inner) + len(inner)
    assert all(at <= a < b <= to for a, k, b in spans if k != "hex")
    clean = secrets.redacted(text, spans)
    assert not [s for s in secrets.all_spans(clean) if s[1] in ("access", "assign")]


def zst(data):
    return zstandard.ZstdCompressor().compress(data)


def every(form):
    return lambda data: "".join(form % b for b in data)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zst, lambda d: zst(gzip.compress(d))])
@pytest.mark.parametrize("write", [every("%%%02X"), every("%%%02x"), every("\\x%02x"), every("\\u%04X"), every("\\U%08x"), every("\\u{%x}"), urllib.parse.quote, lambda d: repr(d)[2:-1], lambda d: json.dumps(d.decode("latin-1"))[1:-1]])
def test_compressed_bytes_in_escapes(pack, write):
    inner = write(pack(f"key {KEY} and {ASSIGN} so".encode()))
    text = f"élan {inner} tail"
    at, to = text.index(inner), text.index(inner) + len(inner)
    spans = [s for s in secrets.all_spans(text) if s[1] != "hex"]
    assert {k for _, k, _ in spans} == {"access", "assign"}
    assert all(at <= a < b <= to for a, _, b in spans)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zst])
@pytest.mark.parametrize("write", [b64, every("%%%02X")])
def test_later_members(pack, write):
    inside = f"key {KEY} so".encode()
    for parts in ([pack(b"first"), pack(inside)], [pack(b"first"), pack(inside[:9]), pack(inside[9:])], [pack(b"first"), pack(gzip.compress(inside))]):
        assert "access" in {k for _, k, _ in secrets.all_spans(f"x {write(b''.join(parts))} y")}


NOISE = b"".join(hashlib.sha256(b"%d" % k).digest() for k in range(120))


@pytest.mark.parametrize("data", [f"key {KEY} and {ASSIGN} so".encode() * 3, gzip.compress(NOISE + f" {KEY} {ASSIGN} ".encode()), b"A=1\0KEY=" + KEY.encode() + b"\0" + ASSIGN.encode() + b"\0", b"\xff\xfe " + KEY.encode() + b" " + ASSIGN.encode() + b" \x80", "é".encode() * 40 + f" {KEY} {ASSIGN}".encode()])
@pytest.mark.parametrize("width", [None, 20, 64, 76])
@pytest.mark.parametrize("before", ["", "https://h.io/x/", "a-", "ab_", "abc+", "n: "])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\\n", "\n  "])
def test_base64_forms(data, width, before, end):
    code = b64(data)
    inner = end.join(code[k : k + (width or len(code))] for k in range(0, len(code), width or len(code)))
    text = f"élan {before}{inner} tail"
    spans = [s for s in secrets.all_spans(text) if s[1] != "hex"]
    assert {"access", "assign"} <= {k for _, k, _ in spans}
    assert all(5 <= a < b <= len(text) - 5 for a, _, b in spans)


def test_percent_run_with_other_bytes():
    assert "access" in {k for _, k, _ in secrets.all_spans(every("%%%02X")(b"\xff\0" + KEY.encode() + b"\xfe"))}


def test_base64_span_maps_to_its_characters():
    data = b"\xff\xfe\0" + KEY.encode() + b"\0\0"
    assert [(a, b) for a, k, b in secrets.all_spans(f"io/x/{b64(data)}") if k == "access"] == [(9, 41)]
    code = b64(data)
    assert [(a, b) for a, k, b in secrets.all_spans(f"{code[:20]}\n{code[20:]}") if k == "access"] == [(4, 37)]


@pytest.mark.parametrize("write", [b64, every("%%%02X"), every("\\x%02x")])
def test_a_run_in_several_layers_is_charged_once(write):
    data = b"- " * 5000 + KEY.encode()
    text = f"%41 \\u0041 %2541 \\u005cu0041 {write(gzip.compress(data))}\n."
    assert {k for _, k, _ in secrets.all_spans(text, most=len(data))} == {"access"}


def test_secret_span_maps_to_its_characters():
    text = "".join(f"%{b:02X}" for b in b"x " + KEY.encode() + b" y")
    assert (6, "access", 6 + 3 * len(KEY)) in secrets.all_spans(text)


def test_secrets_end_on_cycles_and_bombs():
    text = "%2525252525"
    assert secrets.all_spans(text) == []
    bomb = b64(zlib.compress(b"\0" * (1 << 22)))
    assert secrets.all_spans(bomb, most=1 << 20) == []


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: zstandard.ZstdCompressor().compress(x), lambda x: gzip.compress(b"first") + gzip.compress(x), lambda x: gzip.compress(bz2.compress(x))])
def test_large_contents_are_streamed(pack, monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 18)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 14)
    content = b"\0" * ((1 << 21) + 77) + b" " + KEY.encode() + b" " + b64(b"say token=abcdefgh now").encode() + b" " + b"\0" * (1 << 20)
    for text in (b64(pack(content)), "".join(f"%{b:02X}" for b in pack(content))):
        spans = secrets.all_spans("x " + text, most=1 << 20)
        # zstd keeps literals as they are, in which base64 is found on its own as well
        assert {(2, "assign", 2 + len(text)), (2, "access", 2 + len(text))} <= {*spans} and all(2 <= a < b <= 2 + len(text) and k != "packed" for a, k, b in spans)


def test_secrets_at_random_depths():
    import random

    layers = [
        lambda t: urllib.parse.quote(t, safe=""),
        lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: b64(t.encode()),
        lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
        lambda t: b64(gzip.compress(t.encode())),
        lambda t: b64(lzma.compress(t.encode())),
        lambda t: b64(zstandard.ZstdCompressor().compress(zlib.compress(t.encode()))),
    ]
    for seed in range(60):
        rnd = random.Random(seed)
        inner = f"at {KEY} é"
        for _ in range(rnd.randint(1, 5)):
            inner = rnd.choice(layers)(inner)
            if len(inner) > 20_000:
                break
        before = prose(seed, rnd.randint(0, 30)) + " "
        spans = secrets.all_spans(before + inner + " end")
        assert any(k == "access" and a >= len(before) and b <= len(before) + len(inner) for a, k, b in spans), seed
        assert all(a >= len(before) for a, k, b in spans if k == "access")


def test_secrets_query(spark, sf, rows):
    for r in secrets.op1_secrets(spark, sf).collect():
        texts = [t or "" for d, t, *_ in rows if d == r.doc_id]
        want = {hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_plain(t)).encode()).hexdigest() for t in texts}
        assert r.base_sha256 in want
    assert secrets.op1_secrets(spark, sf).count() == len(rows)


def test_redact_keeps_rows_and_columns(docs, spark):
    out = secrets.redact(docs, size_col="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    one = spark.createDataFrame([(1, f"a {KEY} b", 0)], "doc_id long, text string, n_chars long")
    assert secrets.redact(one, size_col="n_chars").first() == (1, "a [SECRET] b", 12)


def plain_license(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ws = re.findall(word, low)
    places = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    # every line and paragraph, against every template, by sets and phrases
    found, score = set(), 0.0
    for block in [*low.split("\n"), *re.split(r"\n[ \t\r\x0b\x0c]*(?=\n)", low)]:
        b = re.findall(word, block)
        for label, text, phrases in licenses.TEMPLATES:
            w = {x.decode() for x in licenses.words_of(text)}
            near = [p.replace(",", " ").split() for p in phrases.split(",")]
            if 5 * len(w & {*b}) >= 4 * len(w) and all(any(b[i : i + len(p)] == p for i in range(len(b))) for p in near):
                found.add(label)
                score = max(score, len(w & {*b}) / len(w))
    for p, lab in licenses.PHRASES.items():
        for _, text, _ in licenses.TEMPLATES:
            own = [x.decode() for x in licenses.words_of(text)]
            if lab in base and any(own[i : i + len(p.split())] == p.split() for i in range(len(own))):
                score = max(score, len({*own} & {*ws}) / len({*own}))
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return len(ws), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(found | base)), score


def test_licenses_against_plain_python(spark, tmp_path, rows):
    extra = ["Released under the MIT License.\nmit  license, CC-BY\n", "GNU General\nPublic  License; Apache license", "Licensed under CC BY-NC 4.0.", "x\n\n \nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal in the Software\n\nend", "LICENſE \u212a mit", "cc byx cc by"]
    extra += [t for _, t, _ in licenses.TEMPLATES] + ["\n".join(t.replace(" ", "\n", 3) for _, t, _ in licenses.TEMPLATES)] + [prose(70, 20_000) + "\nLicensed under CC BY-SA 4.0"]
    every = [(r[0], r[1]) for r in rows] + list(enumerate(extra, 100)) + [(100, extra[0])]
    spark.createDataFrame(every, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((d, *plain_license(t)) for d, t in every), key=key)
    assert collected(licenses.op8_licenses(spark, str(tmp_path))) == want


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("released under the Apache license", "apache"),
        ("The album was released under the new license", ""),
        ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("Licensed under CC BY 3.0", "cc-by"),
        ("This work is licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
        ("GNU General Public License, version 2", "gpl"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("MIT License, Version 2.0", "mit"),
        ("Licensed under the MIT License, Version 2.0", "mit,mit-notice"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl-notice"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ],
)
def test_near_miss_licenses(text, labels):
    words = licenses.words_of(text)
    found, _, _ = licenses.Matcher(dict.fromkeys(licenses.template_words(), 1)).scan(text, words)
    assert ",".join(sorted(found | {x for _, x in licenses.phrase_places(words)})) == labels


PATH = tokens.vocabulary_path("word_bpe_49k.json")


def expected_ids(text):
    return tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=40) | st.text(alphabet="aB 'sT.é\n9<|\u0301\u0130Σ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_encoding_is_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    want = expected_ids(text)
    e = tokens.encoder(PATH)
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == want
    assert [i for w in tokens.encode_words(PATH, tokens.words_of(text), e.dtype) for i in np.frombuffer(w, e.dtype).tolist()] == want


def test_encoder_caches_may_run_over():
    e = tokens.Encoder(PATH, most_chunks=3, most_words=3)
    texts = ["one two three four", "four five six", "one, two; three!"]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == expected_ids(t)


def test_bpe_round_trip(spark, sf, rows, docs):
    t = tokens.tokenizer(PATH)
    want = []
    for r in rows:
        ids = expected_ids(r[1])
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert collected(bpe.op6_bpe(spark, sf)) == sorted(want, key=key)
    encoded = bpe.encode(docs, PATH)
    got = sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in encoded.collect())
    assert got == sorted((r[0] is not None, r[0] or 0, expected_ids(r[1])) for r in rows)
    for r in bpe.decode(encoded, PATH).collect():
        assert r.decoded == t.decode(list(r.ids), skip_special_tokens=False)


def test_bpe_without_a_head(spark, sf, rows, monkeypatch):
    monkeypatch.setattr(bpe, "HEAD", 0)
    assert sorted(r.n_tokens for r in bpe.op6_bpe(spark, sf).collect()) == sorted(len(expected_ids(r[1])) for r in rows)


def test_java_and_python_split_alike(spark, docs):
    got = docs.select("text", bpe.split_words(docs["text"]).alias("w")).collect()
    assert all((r.w or []) == tokens.words_of(r.text or "") for r in got)


@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32))
@settings(max_examples=80, deadline=None)
def test_packing(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-n * bits // 8)
    assert (tokenfile.unpack(data, n, bits) == ids).all()
    im = tokenfile.Image(tokenfile.image([3, None], [n // 2, n - n // 2], ids, bits, block=64))
    a, b = sorted((seed % (n + 1), (seed // 7) % (n + 1)))
    assert (im.ids(a, b) == ids[a:b]).all() and (im.document(1) == ids[n // 2 :]).all()


def test_token_files(spark, sf, rows, monkeypatch):
    monkeypatch.setattr(tokenfile, "IMAGE_IDS", 500)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for r in order:
        ids = np.array([*expected_ids(r[1]), 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert collected(tokenfile.op2_tokenfile(spark, sf)) == sorted(want, key=key)


@given(st.text(max_size=30) | st.text(alphabet="\\#</turn>: hc", max_size=30), st.text(alphabet="\\#</turn>: hcü", max_size=12))
@settings(max_examples=200, deadline=None)
def test_escapes_are_reversible(text, role):
    out, a, b = chat.formatted(role, text)
    assert chat.parsed(out * 2) == [(role, text, a, b), (role, text, len(out) + a, len(out) + b)]
    assert "</turn>" not in out[:-8] and "###" not in out[3:]


TURNS = [
    [("user", "hi"), ("assistant", "yo \\h"), ("user", "a")],
    [("user", "hi"), ("assistant", "yo \\h"), ("user", "b"), ("assistant", "### x")],
    [("user", "hi"), ("assistant", "other")],
    [("user", "hi"), ("assistant", "other")],
    [("user", "hi")],
    [("", "")],
    [("system", "s" * 5000), ("user", "hi")],
]


@pytest.mark.parametrize("most", [(1 << 18, 2048), (40, 2048), (1 << 18, 2)])
def test_prefix_tree(most):
    packer, packs = chat.Packer(*most), []
    for k, turns in enumerate(sorted(TURNS)):
        if done := packer.add(k, turns):
            packs.append(done)
    packs.append(packer.close())
    seen = {}
    for p in packs:
        for m in p["members"]:
            text, losses = chat.conversation(p, m["node"])
            seen[m["conv_id"]] = ([(r, t) for r, t, _, _ in chat.parsed(text)], [chat.unescaped(text[a:b]) for a, b in losses])
        for k, n in enumerate(p["nodes"]):
            up = n["parent"]
            assert n["position"] == (0 if up < 0 else p["nodes"][up]["position"] + p["nodes"][up]["end"] - p["nodes"][up]["start"])
            assert list(chat.position_ids(n))[:1] == [n["position"]]
            assert sum(iv["end"] - iv["start"] for iv in n["attends"]) == n["position"]
    assert seen == {k: (t, [x for r, x in t if r == "assistant"]) for k, t in enumerate(sorted(TURNS))}
    if most[0] > 1000 and most[1] > 2:
        assert len(packs) == 1 and packs[0]["text"].count("### user: hi") == 2


def test_chat_tokens():
    packer, packs = chat.Packer(400, 5), []
    for c, turns in enumerate(sorted(TURNS * 2, key=str)):
        packs.append(packer.add(c, turns))
    encode = lambda texts: [expected_ids(t) for t in texts]
    seen = {}
    for p in [chat.with_tokens(p, encode) for p in [*packs, packer.close()] if p]:
        # every node's tokens stand once
        assert [n["token_start"] for n in p["nodes"]] == [0, *(n["token_end"] for n in p["nodes"])][:-1] or not p["nodes"]
        for m in p["members"]:
            seen[m["conv_id"]] = chat.conversation_tokens(p, m["node"])
        for n in p["nodes"]:
            if n["loss_start"] is not None:
                assert p["tokens"][n["loss_token_start"] : n["loss_token_end"]] == expected_ids(p["text"][n["loss_start"] : n["loss_end"]])
            assert n["token_position"] == sum(x["end"] - x["start"] for x in n["token_attends"])
    for c, turns in enumerate(sorted(TURNS * 2, key=str)):
        want = []
        for r, t in turns:
            whole, a, b = chat.formatted(r, t)
            for x in [whole[:a], whole[a:b], whole[b:]] if r == "assistant" else [whole]:
                want += expected_ids(x)
        assert seen[c] == want


def test_chat_without_rows(spark, empty_sf):
    assert [r.conv_id for r in chat.op10_chat(spark, empty_sf).collect()] == [-7]


def test_chat_query(spark, tmp_path):
    rows = [(c, i, r, t) for c, turns in enumerate(TURNS) for i, (r, t) in enumerate(turns)]
    rows += [(50, 1, "user", "again"), (50, 1, "user", "again"), (50, None, None, None), (None, 0, "assistant", "no id")]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for *_, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(chat.formatted(role, t)[0]) for *_, role, t in turns)


@pytest.mark.parametrize("name", ["op1_secrets", "op2_tokenfile", "op3_jaccard", "op4_quality", "op5_repeats", "op6_bpe", "op7_topk", "op8_licenses", "op9_mixing"])
def test_empty_tables(spark, empty_sf, name):
    from tallyforge.llm.queries import QUERIES

    assert QUERIES[name](spark, empty_sf).collect() == []
