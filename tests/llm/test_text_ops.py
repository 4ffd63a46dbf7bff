"""Operators on single documents against plain Python, and on odd rows."""

import base64
import hashlib
import json

import brute
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from spindrift.llm import bpe, license_scan, order_minhash, packing, quality, secret_scan


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_order_minhash(request, which):
    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    found, texts, after = by_id(order_minhash.fingerprints(frame)), dict(rows), brute.edited(rows)
    assert set(found) == set(texts)
    for i, (key, text) in enumerate(rows):
        r, following = found[key], rows[(i + 1) % len(rows)][1] or ""
        assert r["n_chars"] == len(text or "")
        assert r["edited_sha256"] == hashlib.sha256(after[key].encode()).hexdigest()
        own, edited, other = (brute.order_minhash(t) for t in (text or "", after[key], following))
        assert r["fingerprint"] == "".join(own.values()) and r["edited_fingerprint"] == "".join(edited.values())
        assert r["near_edited"] == pytest.approx(brute.agreement(own, edited)) and r["near_next"] == pytest.approx(brute.agreement(own, other))


def test_order_minhash_repeated_and_null_ids(spark, monkeypatch):
    """Rows of one doc_id follow each other by text, over many ranges of a few bytes each."""
    monkeypatch.setattr(order_minhash, "RANGE_BYTES", 64)
    rows = sorted([(k % 40, f"text {k} of words {k * k} and more {k % 7}") for k in range(90)] + [(3, "same"), (3, "same")]) + [(50, None)]
    rows = [(None, "no id at all")] + [(k, t or "") for k, t in rows]
    out = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    expected = []
    for i, (key, text) in enumerate(rows):
        following = rows[i + 1][1] if i + 1 < len(rows) else rows[1][1]
        half = len(text) // 2
        expected.append((key or -1, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    got = sorted((r["doc_id"] or -1, r["edited_sha256"]) for r in out)
    assert len(got) == len(expected) and sum(a == b for a, b in zip(got, sorted(expected))) >= len(got) - 1  # the null row may be followed by any first


def test_order_matters(spark):
    a = [f"w{i}" for i in range(400)]
    moved = a[200:] + a[:200]
    frame = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a)), (3, " ".join(moved)), (4, " ".join(a[:390] + ["z"] * 10))], "doc_id bigint, text string")
    s = {r["doc_id"]: r for r in frame.select("doc_id", order_minhash.signature(frame.text).alias("s")).collect()}
    pairs = spark.createDataFrame([(s[1]["s"], s[k]["s"], k) for k in (2, 3, 4)], "a array<bigint>, b array<bigint>, k int")
    like = {r["k"]: r["x"] for r in pairs.select("k", order_minhash.likeness(pairs.a, pairs.b).alias("x")).collect()}
    assert like[2] == 1.0 and like[3] < 0.8 < like[4]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_counts(request, which):
    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    found = by_id(quality.judge(frame))
    for key, text in rows:
        r = found[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality(text), key
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])


def test_quality_distance(spark):
    good = "the cat and the dog went to the house of the man in the town and it was good "
    rows = [(i, good * 8 + str(i), "en", "s", 1) for i in range(30)] + [(99, " ".join(f"#%{i}$$& xq{i}z" for i in range(80)), "en", "s", 1)]
    found = by_id(quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")))
    assert found[99]["kept"] is False and not found[99]["base_failed"] and found[99]["char_distance"] > found[0]["char_distance"]


@pytest.mark.parametrize("few", [True, False])
def test_quality_has_a_reference_for_every_language(spark, monkeypatch, few):
    """Clean documents of 80 languages with words of their own, one language with most of the documents, one with a long name."""
    if not few:
        monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 3)
        monkeypatch.setattr(quality, "SHARES", 20)
    names = [f"l{k:02d}" for k in range(79)] + ["x" * 40]
    text = lambda k, i: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}w{'abcdefghij'[(i + j * j) % 10]}" for j in range(60)) + " " + " ".join(f"q{chr(97 + j)}{chr(97 + i % 26)}" for j in range(10))
    rows = [(1000 * k + i, text(k, i), name) for k, name in enumerate(names) for i in range(200 if k == 0 else 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = by_id(quality.judge(frame))
    assert len(found) == len(rows)
    for k in (0, 77, 79):
        alone = by_id(quality.judge(frame.where(F.col("lang") == names[k])))
        assert len(alone) == (200 if k == 0 else 3)
        for key, r in alone.items():
            assert (r["char_distance"], r["word_distance"]) == pytest.approx((found[key]["char_distance"], found[key]["word_distance"]))
            assert r["kept"] == found[key]["kept"]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_licence_base(request, which):
    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    found = by_id(license_scan.licence_labels(frame))
    assert len(found) == len(rows)
    for key, text in rows:
        r = found[key]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licences(text), key


def test_licence_passages(spark):
    passage = license_scan.PASSAGES[2][0].split()
    damaged = passage[:8] + ["extra"] + passage[8:]
    rows = [(1, "intro words " + " ".join(damaged).upper() + " outro"), (2, "see the MIT License; CC-BY-NC, used Under the MIT license"), (3, " ".join(passage[:5]))]
    found = by_id(license_scan.licence_labels(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found[1]["labels"] == "bsd" and 0.6 <= found[1]["score"] < 1 and found[1]["n_base"] == 0
    assert found[2]["base_labels"] == found[2]["labels"] == "cc-by-nc,mit" and found[2]["n_base"] == 2
    assert found[3]["labels"] == "" and found[3]["score"] == 0


def test_licence_behind_its_own_opening_words(spark):
    """Hits before a passage don't hide it; two copies are two spans; a long text without a licence has none."""
    passage = license_scan.PASSAGES[0][0]
    table = "permission is hereby x " * 10
    rows = [(1, table + passage), (2, passage), (3, table), (4, passage + " word" * 200 + " " + passage), (5, "granted free of charge " * 20_000), (None, passage), (2, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in license_scan.licence_labels(frame).collect())
    assert found == [(0, "mit", 1.0), (1, "mit", 1.0), (2, "", 0.0), (2, "mit", 1.0), (3, "", 0.0), (4, "mit", 1.0), (5, "", 0.0)]
    spans = sorted((r["doc_id"], r["start"], r["end"]) for r in license_scan.licence_spans(frame.where("doc_id in (2, 4)")).collect())
    n = len(passage.split())
    assert spans == [(2, 0, n), (4, 0, n), (4, n + 200, 2 * n + 200)]


def test_order_minhash_without_any_id(spark):
    rows = [(None, "one two three four five six"), (None, "zeta eta theta iota kappa lambda"), (None, "b c d")]
    out = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = sorted(t for _, t in rows)
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + texts[(i + 1) % 3][: len(t) // 2]).encode()).hexdigest() for i, t in enumerate(texts)}
    assert len(out) == 3 and {r["edited_sha256"] for r in out} == want and all(r["edited_fingerprint"] for r in out)


def test_quality_of_a_language_of_one_document(spark):
    """A lone document isn't its own reference."""
    good = "the cat and the dog went to the house of the man in the town and it was good "
    rows = [(i, good * 8 + str(i), "en") for i in range(30)] + [(99, " ".join(f"#%{i}$$& xq{i}z" for i in range(40)), "xx"), (100, "", "yy"), (101, None, None)]
    found = by_id(quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
    assert found[99]["char_distance"] > 0.3 and found[99]["kept"] is False and not found[99]["base_failed"]
    assert all(found[i]["kept"] == found[0]["kept"] for i in range(30)) and found[100]["kept"] is False


def test_bpe_equals_the_library(docs, odd, rows, odd_rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame, texts in ((docs, rows), (odd, odd_rows)):
        encoded = bpe.encode(frame, path, public_tokenizers.PATTERN)
        ids = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
        assert ids == {k: library.encode_ordinary(t or "") for k, t in texts}
        assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path, public_tokenizers.PATTERN).collect()} == {k: t or "" for k, t in texts}
        digests = by_id(bpe.round_trip_digests(frame, path, public_tokenizers.PATTERN))
        for k, t in texts:
            assert digests[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[k])).encode()).hexdigest()
            assert digests[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_random_bytes_and_streams():
    import random

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    machine = bpe.MergeTransducer(bpe.load_ranks(path), states=500)
    rnd = random.Random(1)
    for _ in range(1500):
        piece = bytes(rnd.choice(b"aeth oni ngs\xc3\xa9\xa4\xe6\x9c") for _ in range(rnd.randint(1, 24)))
        whole = [machine.ranks[piece]] if piece in machine.ranks else [machine.ranks[t] for t in bpe.merge_by_rank(piece, machine.ranks)]
        assert machine.encode(piece) == whole
    coder = bpe.coder(path, public_tokenizers.PATTERN)
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for c in [*map(chr, [0x558, 0x10EE7, 0x16EA7, 0x18DA7, 0x323B0, 0x11DE3, 0x1D7CE, 0x10D4A]), *map(chr, range(0xA0, 0x20000, 37))]:
        if not 0xD800 <= ord(c) <= 0xDFFF:
            for text in (f"a{c}b {c}{c} 1{c}2", f" {c}. {c}"):
                assert coder.encode(text) == library.encode_ordinary(text), hex(ord(c))
    ids = coder.encode("漢字 und Straße \U0001f600" * 20)
    for chunk in (1, 2, 7, 4096):
        assert "".join(t for _, t in coder.decode_stream(ids, chunk)) == "漢字 und Straße \U0001f600" * 20


def test_bpe_configurations_are_shared():
    """Words that begin differently share the configurations of what they have in common."""
    import random

    machine = bpe.MergeTransducer(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    rnd, parts = random.Random(3), ["th", "er", "en", "tion", "ea", "nd", "ge", "lich", "ción", "ö", "bl", "ou", "st"]
    words = {" " + "".join(rnd.choices(parts, k=rnd.randint(3, 6))) for _ in range(20_000)}
    for word in sorted(words):
        whole = machine.encode(word.encode())
        assert b"".join(map(machine.bytes_of.__getitem__, whole)) == word.encode()
    assert len(machine.configs) < len(words) / 2


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    frame, rows = request.getfixturevalue(which), request.getfixturevalue({"docs": "rows", "odd": "odd_rows"}[which])
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ids = {k: np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in rows}
    pieces = packing.pack(frame, path).collect()
    at, fill = dict.fromkeys(ids, 0), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
        at[p["doc_id"]] += p["length"]
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : at[p["doc_id"]]].tobytes())
    assert at == {k: len(v) for k, v in ids.items()}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(fill.values()) <= 4096
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in fill.values())
    assert padded <= 0.03 * sum(fill.values())


def test_word_tokenizer_equals_the_library():
    """Letters of every script before a point, contractions, long runs, several blocks, and names of special tokens."""
    import random

    from spindrift.llm import word_bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(5)
    letters = [chr(p) for p in [*range(0x21, 0x3000), *range(0xA000, 0xAC00, 7), *range(0xF900, 0x10000, 3), *range(0x10000, 0x20000, 11)] if not 0xD800 <= p <= 0xDFFF]
    pool = "abcdefgh istTRE'\"..,;!?-0123 \n\t\r \u3000éÄ漢字ß\u0301İΣς\u0958\U0001f600"
    texts = [f"{x}. b{x}'s {x}{x}" for x in letters] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50))) for _ in range(5000)]
    texts += ["", " ", "x" * 5000, "'" * 300, "a'" * 300, "1" * 300, "é" * 200 + "." * 99, "a <|endoftext|> b<|startoftext|>", "word word. " * 200_000]
    for special in (True, False):
        coder = word_bpe.WordTokenizer(path, special_as_text=special)
        expected = [c.ids for c in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in coder.encode_batch(texts)] == expected


def test_cuts_are_the_cheapest():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(60):
        places = np.concatenate([[0], np.cumsum(rnd.integers(1, 8, 9))])
        pen = rnd.integers(0, 10, 10)
        cost = lambda cuts: sum(10 - (places[b] - places[a]) + pen[b] for a, b in itertools.pairwise([0, *cuts]))
        legal = lambda cuts: all(places[b] - places[a] <= 10 for a, b in itertools.pairwise([0, *cuts]))
        best = min(cost([*c, 9]) for n in range(9) for c in itertools.combinations(range(1, 9), n) if legal([*c, 9]))
        cuts = packing.choose_cuts(places, pen, 10)
        assert legal(cuts) and cuts[-1] == 9 and cost(cuts) == best


def _der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def _wrapped(data, eol, width=64):
    code = base64.b64encode(data).decode()
    return eol.join(code[i : i + width] for i in range(0, len(code), width))


_RSA = _der(0x30, _der(2, b"\0"), *[_der(2, bytes([0x90 + k]) * 60) for k in range(8)])
_PBES2 = _der(0x30, _der(0x30, _der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d"), _der(0x30)), _der(4, bytes(range(7, 199))))
_SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"q" * 130))


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n"])
@pytest.mark.parametrize("case", ["plain", "headers", "encrypted", "ssh"])
def test_pem_forms(case, eol):
    """Escaped and real line ends, header lines, encrypted keys, and the same keys without borders."""
    data, label = {"plain": (_RSA, "RSA PRIVATE KEY"), "headers": (bytes((7 * i) % 251 for i in range(160)), "RSA PRIVATE KEY"), "encrypted": (_PBES2, "ENCRYPTED PRIVATE KEY"), "ssh": (_SSH, "OPENSSH PRIVATE KEY")}[case]
    head = f"Proc-Type: 4,ENCRYPTED{eol}DEK-Info: AES-128-CBC,0123{eol}{eol}" if case == "headers" else ""
    pem = f"-----BEGIN {label}-----{eol}{head}{_wrapped(data, eol)}{eol}-----END {label}-----"
    for text in (f'{{"key": "{pem}{eol}"}}', f"see {pem} end"):
        assert [text[a:b] for kind, a, b in secret_scan.structural_spans(text) if kind == "pem"] == [pem]
        broken = text.replace(label + f"-----{eol}{head}", label + f"-----{eol}{head}AAAAA")
        assert not [s for s in secret_scan.structural_spans(broken) if s[0] == "pem"]
    if case != "headers":
        for width in (64, 76, 20):
            code = _wrapped(data, eol, width)
            for text in (f"key:{eol}{code}{eol}end of it", f"k={code} end", code):
                found = [text[a:b] for kind, a, b in secret_scan.structural_spans(text) if kind in ("der", "ssh")]
                assert max(found, key=len) == code and all(x in code for x in found), (width, text)


def test_wrapped_prose_is_no_key():
    blob = _wrapped(bytes((i * i + 3) % 256 for i in range(5000)), "\n")
    for text in (blob, "MIIE\nMIIE\n" * 500, _wrapped(_RSA[:-3], "\n"), _wrapped(b"\0" * 900, "\n"), "30" * 40 + "\n" + "30" * 40, "M" * 70 + "\n" + "M" * 9):
        assert not [s for s in secret_scan.structural_spans(text) if s[0] != "hex"]
    code = _RSA.hex().upper()
    text = "hex\n" + code[:64] + "\n" + code[64:] + "\nend"
    assert [text[a:b] for k, a, b in secret_scan.structural_spans(text)] == [text[4:-4]]


def test_secrets(spark, docs, odd, rows, odd_rows):
    rsa = _der(0x30, _der(2, b"\0"), *[_der(2, bytes([0xAA]) * 40) for _ in range(8)])
    key = base64.b64encode(rsa).decode()
    header = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + key + "\n-----END RSA PRIVATE KEY-----"
    cases = {
        1: ("é password = 'abcdefghijkl' token:secret:abcdefghijklmnop", ["assign"]),
        2: ("AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef 0123", ["access", "hex"]),
        3: (f"see {pem} end", ["pem", "der"]),
        4: (f"auth {header}.eyJzdWIiOjF9.c2ln ok eyJub3RhanNvbg.aa.bb", ["token"]),
        5: ("base " + base64.b64encode(bytes(range(60))).decode(), []),
        # Upper-case digits but for a header without letters: the base pattern reports that header's digits.
        6: ("hex " + rsa[:-1].hex().upper(), ["hex"]),
        7: ("hex " + rsa.hex().upper(), ["hex", "der"]),
    }
    frame = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id bigint, text string")
    spans = {}
    for r in secret_scan.scan_secrets(frame).collect():
        spans.setdefault(r["doc_id"], []).append(r["kind"])
        assert cases[r["doc_id"]][0][r["start"] : r["end"]] == r["secret"]
    assert {k: spans.get(k, []) for k in cases} == {k: v[1] for k, v in cases.items()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame).collect()}
    assert clean[3] == "see [SECRET] end" and clean[5] == cases[5][0]
    for table, texts in ((docs, rows), (odd, odd_rows), (frame, [(k, v[0]) for k, v in cases.items()])):
        found = by_id(secret_scan.secret_digests(table))
        assert len(found) == len(texts)
        for k, t in texts:
            base = brute.secrets(t or "")
            assert [found[k][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[0] == kind for s in base) for kind in ("assign", "access", "hex")]
            listed = [f"{kind}:{a}:{b}" for kind, a, b in base]
            assert found[k]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
            assert set(listed) <= set(found[k]["spans"].split(","))


def test_secret_patterns_on_random_strings():
    import random

    rnd = random.Random(11)
    parts = ["password", "PassWD", "secret", "toKEN", "api_key", "apikey", "API", "_", "key", '"', "'", " ", "  ", ":", "=", "==", "AKIA", "akia", "ABCDEFGHIJ0123", "deadbeef", "0123456789", "abcdef", "-", ".", "/", "+", "é", "\n", "xyz", "ſecret", "toKen"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))
        assert secret_scan._sorted(secret_scan.pattern_spans(text)) == brute.secrets(text), text


def test_empty_tables(docs):
    none = docs.where("doc_id < 0")
    rank, word = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    for frame in (order_minhash.fingerprints(none), quality.judge(none), license_scan.licence_labels(none), bpe.round_trip_digests(none, rank, public_tokenizers.PATTERN), packing.pack(none, word), secret_scan.secret_digests(none)):
        assert frame.count() == 0
