import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import cells, components, edit_fingerprint, jaccard_join, license_scan, mpeg_audio, queries, secret_scan, sentencepiece_codec, source_mix, substring_dedup, toxicity_chain, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, component string, place int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f"), (5, "a b c d e f"), (6, LONG), (7, LONG + " x"), (8, "é \U0001d4f3 日本\n\t#")]


def odd(spark, rows=ODD):
    """Nulls, empty and very long texts, repeated texts, and columns with clashing names."""
    return spark.createDataFrame([(i, t, None, None if i % 3 == 0 else "s", None, 7, "c", 9) for i, t in rows], SCHEMA)



@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 6, 30, 80, 200]))) for _ in range(60)]
    rows = list(base)
    for _ in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    passage = " ".join(rng.choices(words, k=70))
    rows += [f"{rng.choice(words)} {i} {passage} {i} end" for i in range(20)] + [None, "", "x", "x"]
    rng.shuffle(rows)
    return odd(spark, list(enumerate(rows))).cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert not compare.differences(queries.QUERIES[name](spark, SF), compare.duck(SF), queries.ORACLES[name])


def test_pieces_are_the_best_and_come_back(spark):
    codec = sentencepiece_codec.PieceCodec(sentencepiece_codec.load_model())
    scores = {p: s for p, s, kind in codec.pieces if kind == sentencepiece_codec.NORMAL}

    def best(text):
        """The best score by trying all pieces at all places of the whole text."""
        text = codec.dummy + text.replace(" ", sentencepiece_codec.MARK)
        top = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 20), end):
                s = scores.get(text[start:end], codec.unknown_score if end == start + 1 else None)
                if s is not None:
                    top[end] = max(top[end], top[start] + s)
        return top[-1]

    for text in ("the  theory of\nreading 日本", "  a", "thhe whnd ation.", "\U0001d4f3x"):
        ids = codec.encode(text).tolist()
        own, run = 0.0, 0
        for i in ids:
            if i in codec.byte_set:
                run += 1
            else:
                own += codec.pieces[i][1]
        text_bytes = [c for c in codec.dummy + text.replace(" ", sentencepiece_codec.MARK) if c not in codec.single]
        assert abs(own + len(text_bytes) * codec.unknown_score - best(text)) < 1e-3
        assert codec.decode(ids) == text
    got = {r["doc_id"]: r for r in sentencepiece_codec.digest(odd(spark)).collect()}
    assert all(r["round_trip"] for r in got.values()) and got[1]["n_tokens"] == 0 and got[4]["ids"] == got[5]["ids"]


def test_digests_need_one_worker_for_each_task(spark):
    plan = sentencepiece_codec.digest(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_audio_round_trip_and_resynchronisation(spark):
    for payload in (b"", b"x", bytes(range(256)) * 40):
        data = mpeg_audio.mux(mpeg_audio.pad(payload))
        s = mpeg_audio.parse(data)
        assert mpeg_audio.demux(data, s) == mpeg_audio.pad(payload) and s.table["frames"] == len(s.offsets) and not s.checks_bad
        assert s.duration == len(s.offsets) * mpeg_audio.Fraction(1152, 48000)
    junk = data[:1500] + b"junk\xff\xfb" + data[1500:]
    hurt = mpeg_audio.parse(junk)
    assert hurt.resyncs == 1 and hurt.skipped > 0
    broken = bytearray(data)
    broken[s.offsets[0] + 10] ^= 1
    assert mpeg_audio.parse(bytes(broken)).checks_bad == 1
    got = {r["doc_id"]: r for r in mpeg_audio.inspect(mpeg_audio.store(odd(spark)), ["doc_id"]).collect()}
    for i, t in ODD:
        want = mpeg_audio.pad((t or "").encode())
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))


def _frame(word, body):
    """A frame with its checksum, by plain bit strings: header bits 16 to 31, then those of the body that are told."""
    return lambda bits: word.to_bytes(4) + _crc(f"{word & 0xFFFF:016b}" + "".join(f"{b:08b}" for b in body)[:bits]).to_bytes(2) + body


def _crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15
        crc = crc << 1 & 0xFFFF
        if top ^ int(b):
            crc ^= 0x8005
    return crc


@pytest.mark.parametrize(
    ("word", "bits"),
    [
        # Layer II, 192 kbit/s, 48 kHz: stereo 27 subbands (88 allocation bits a channel), mono 64 kbit/s likewise, and joint stereo
        (0xFFFC0000 | 10 << 12 | 1 << 10 | 0 << 6, lambda used: 2 * 88 + 2 * used),
        (0xFFFC0000 | 4 << 12 | 1 << 10 | 3 << 6, lambda used: 88 + 2 * used),
        (0xFFFE0000 | 6 << 12 | 1 << 10 | 0 << 6, lambda used: 256),
        (0xFFFE0000 | 6 << 12 | 1 << 10 | 3 << 6, lambda used: 128),
        (0xFFFE0000 | 6 << 12 | 1 << 10 | 1 << 6 | 1 << 4, lambda used: 4 * (2 * 8 + 24)),
    ],
)
def test_checksums_of_layers_one_and_two(word, bits):
    h = mpeg_audio.header(word)
    assert h.checked and h.layer in (1, 2)
    body = bytearray(h.size - 6)
    body[0] = 0b01010000  # the first subband of one channel is used, or of both
    body[-1] = 7
    used = sum(body[0] >> s & 15 > 0 for s in ((4, 0) if h.channels == 2 else (4,)))
    data = _frame(word, bytes(body))(bits(used)) * 4
    s = mpeg_audio.parse(data)
    assert (len(s.offsets), s.checks_good, s.checks_bad) == (4, 4, 0)
    hurt = bytearray(data)
    hurt[6] ^= 0x40
    assert (mpeg_audio.parse(bytes(hurt)).checks_good, mpeg_audio.parse(bytes(hurt)).checks_bad) == (3, 1)
    hurt = bytearray(data)
    hurt[h.size - 1] ^= 1  # behind what the checksum covers
    assert mpeg_audio.parse(bytes(hurt)).checks_good == 4


def test_delay_and_padding_shorten_the_duration():
    data = mpeg_audio.mux(mpeg_audio.pad(b"x" * 5000))
    at = data.index(b"Xing") + 8 + 4 + 4 + 100
    named = bytearray(data)
    named[at : at + 9] = b"LAME3.100"
    named[at + 21 : at + 24] = (576 << 12 | 1000).to_bytes(3)
    s = mpeg_audio.parse(bytes(named))
    assert s.duration == len(s.offsets) * mpeg_audio.Fraction(1152, 48000) - mpeg_audio.Fraction(1576, 48000)


SECRET = 'token = "abcdef123456"'


@pytest.mark.parametrize(
    "hide",
    [
        lambda s: urllib.parse.quote(s, safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(urllib.parse.quote(base64.b64encode(s.encode()).decode()).encode()).decode(),
    ],
)
def test_hidden_secrets(hide):
    text = f"é {hide(SECRET)} end"
    base, spans, *_ = secret_scan.scan(text)
    assert not base and spans and all(2 <= s < e <= len(text) - 4 for s, _, e in spans)


def test_each_place_of_an_equal_layer_is_found(spark):
    for token in (base64.b64encode(SECRET.encode()).decode(), base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode()):
        for inner in (token, urllib.parse.quote(token, safe="").replace("a", "%61")):
            text = f"{inner} and {inner} or {inner}."
            spans = secret_scan.scan(text)[1]
            assert {(s, e) for s, _, e in spans if e - s >= len(inner)} == {(m.start(), m.end()) for m in re.finditer(re.escape(inner), text)}
            assert secret_scan.redact(odd(spark, [(1, text)])).first()["text"] == "[SECRET] and [SECRET] or [SECRET]."
    assert secret_scan.scan(urllib.parse.quote(SECRET) + " \\u0041 x")[2] == 3


def test_secrets_in_damaged_runs_and_bytes():
    token = urllib.parse.quote(SECRET, safe="")
    inner = "%FF" + token + "%80 x"
    base, spans, *_ = secret_scan.scan(inner)
    assert not base and [(s, e) for s, _, e in spans] == [(3, 3 + len(token) - 3)]
    for data in (b"\xff\xfe junk " + SECRET.encode() + b"\x00\x80", b"\x01" + SECRET.encode()):
        for token in (base64.b64encode(data).decode(), base64.b64encode(gzip.compress(data)).decode()):
            assert [(s, e) for s, _, e in secret_scan.scan(f"a {token} b")[1]] == [(2, 2 + len(token))]
    lines = base64.encodebytes(b"some text before, " * 5 + SECRET.encode()).decode().strip()
    assert "\n" in lines
    for end in ("\n", "\r\n", "\n   "):
        text = lines.replace("\n", end)
        assert (2, 0, 2 + len(text)) in secret_scan.scan(f"x {text} y")[1]


@pytest.mark.parametrize("secret", ["é password=hunter22secret", "日本 password=hunter22", "token=abc123", "token=hunter22", "passwd:abcdef"])
def test_short_and_foreign_base64_is_decoded(secret):
    for token in (base64.b64encode(secret.encode()).decode(), base64.urlsafe_b64encode(secret.encode()).decode().rstrip("=")):
        assert secret_scan.scan(f"x {token} y")[1] == [(2, 0, 2 + len(token))]
    assert secret_scan.scan("dG9rZW49aGVsbG8=")[1] == []


def test_compressed_layers_are_read_to_their_end(monkeypatch):
    long = gzip.compress(("é, " * 40 + "\n").encode() * (1 << 18) + SECRET.encode())
    members = gzip.compress(b"one, ") + gzip.compress(b"two, ") + gzip.compress(SECRET.encode())
    for data in (long, members, members + b"\0" * 9, zlib.compress(SECRET.encode() + b" " * (17 << 20))):
        token = base64.b64encode(data).decode()
        assert secret_scan.scan(f"x {token} y")[1:] == ([(2, 0, 2 + len(token))], 1, 1, 0)
    assert secret_scan.scan(base64.b64encode(members[:-9]).decode())[4] == 1
    # whatever a part's size, the spans are those of the whole
    inner = base64.b64encode(SECRET.encode()).decode()
    for text in (f"日本 {inner}, é", "a, " * 9 + SECRET, "q" * 70 + "\t" + urllib.parse.quote(SECRET, safe=""), "f" * 99, "password  " + " " * 50 + "= 'abcdefgh'"):
        token = base64.b64encode(gzip.compress(text.encode())).decode()
        want = secret_scan.scan(token)[1]
        assert want
        for part in (1, 2, 7, 30):
            monkeypatch.setattr(secret_scan, "PART", part)
            assert secret_scan.scan(token)[1] == want
        monkeypatch.undo()


def test_base_secrets_by_plain_regexes(spark):
    rows = [(i, t) for i, t in enumerate(["PASSWORD: 'hunter22' AKIA" + "B" * 16, "api-key=abcdef", "apikey=abc", "f" * 24 + "g" + "0" * 23, "ſecret=abcdefg", None])]
    got = {r["doc_id"]: r for r in secret_scan.find(odd(spark, rows), ["doc_id"]).collect()}
    for i, t in rows:
        t = t or ""
        assign = [m for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 6]
        access = [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        hexes = [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (len(assign), len(access), len(hexes))
    assert "[SECRET]" in secret_scan.redact(odd(spark, rows)).where("doc_id = 0").first()["text"]


def test_urls(spark):
    urls = ["http://A.example.org/es/x", "https://example.org/en/12?q#f", "https://example.org/en/2", "http://notexample.org", "http://b.com/de/1", "http://b.com/fr/1", "no host", None, "http://h.net/a/1", "x://Y?p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(8, 1)] * 20 + [(None, 0)], "page_id long, bad int")
    got = [tuple(r)[1:5] for r in url_filter.judge(df, labels).orderBy("page_id").collect()]
    assert [g[2] for g in got] == ["example.org/es/", "example.org/en/1", "org/", None, "com/de/", "com/fr/", None, None, None, None]
    assert got[9][:2] == ("y", "") and got[6][:2] == ("", "") and got[3][3] == "allow"
    assert [g[3] for g in got[:6]] == ["block", "block", "allow", "allow", "block", "allow"]


def _judged(pages, marks):
    """Templates and verdicts by a plain walk over the whole tree, for urls that no rule decides."""
    found = {}
    for i, url in pages:
        found.setdefault(url.split("://")[1].split("/", 1)[0], []).append((i, [x for x in url.split("://")[1].split("/")[1:] if x]))
    known = [marks[i] for i, _ in pages if i in marks]
    overall = sum(known) / max(1, len(known))
    out = {}
    for host, rows in found.items():
        template = dict.fromkeys((i for i, _ in rows), "")
        for level in range(max(len(p) for _, p in rows)):
            nodes = {}
            for i, path in rows:
                if len(path) > level:
                    x = path[level]
                    m = re.fullmatch(r"(?:[0-9]+|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F-]{16,})(\.[a-z]{2,5})?", x)
                    nodes.setdefault(template[i], {}).setdefault("*" + (m[1] or "") if m else x, []).append(i)
            for above, branches in nodes.items():
                labels = {b: [marks[i] for i in ids if i in marks] for b, ids in branches.items()}
                n, bad = sum(map(len, labels.values())), sum(map(sum, labels.values()))
                rate = bad / max(1, n)
                for b, ids in branches.items():
                    error = (rate * (1 - rate) * len(labels[b]) + 1) ** 0.5
                    alike = len(branches) > 1 and abs(sum(labels[b]) - rate * len(labels[b])) < 3 * error
                    for i in ids:
                        template[i] = f"{above}/{'*' if alike and not b.startswith('*') else b}"
        host_labels = [marks[i] for i, _ in rows if i in marks]
        rate = (sum(host_labels) + 8 * overall) / (len(host_labels) + 8)
        for i, _ in rows:
            own = [marks[j] for j, _ in rows if template[j] == template[i] and j in marks]
            share = (sum(own) + 8 * rate) / (len(own) + 8) if own else 0.0
            out[i] = (template[i], round(share, 6), "block" if share >= 0.5 else "allow")
    return out


def test_url_tree_by_a_plain_walk(spark):
    rng = random.Random(4)
    parts = ["docs", "spam", "news", "a", "b", "7", "2020-01-02", "12.html", "deadbeefdeadbeef", "x y"]
    pages = [(i, f"http://{rng.choice('pqrs')}.net/" + "/".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(500)]
    marks = {i: int(("spam" in u or "//s" in u) and rng.random() < 0.9 or rng.random() < 0.05) for i, u in pages if rng.random() < 0.6}
    labels = spark.createDataFrame(list(marks.items()), "page_id long, bad int")
    df = spark.createDataFrame([(i, u, "h", "p", "t", 1, 2) for i, u in pages], "page_id long, url string, host string, path string, template string, bad int, segments int")
    got = {r["page_id"]: (r["template"], r["bad_share"], r["verdict"]) for r in url_filter.judge(df.unionAll(df.limit(0)), labels).collect()}
    want = _judged(pages, marks)
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 and got[i][2] == want[i][2] for i in want) and len({v for _, _, v in got.values()}) == 2
    twice = url_filter.judge(df.unionAll(df)).count()
    assert twice == 2 * len(pages) and url_filter.judge(df.limit(0), labels).count() == 0 and url_filter.judge(df.limit(0)).count() == 0


def test_rules_label_like_pages(spark):
    """Pages of one host under a template that a rule mostly blocks are blocked too."""
    urls = [(i, f"http://h.com/{('de', 'fr')[i % 2]}/{i}") for i in range(60)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules=url_filter.RULES[:4] + (("block", "com", "/de/1"), ("block", "com", "/de/2"), ("block", "com", "/de/3"))).collect()}
    assert got[4]["rule"] is None and got[4]["verdict"] == "block" and got[1]["verdict"] == "allow"


def test_deep_sections_of_urls(spark):
    for top in ("a/b/c", "a/b/c/d/e/f/g"):
        urls = [(i, f"http://h.net/{top}/{'spam' if i < 60 else 'good'}/{i}") for i in range(160)]
        marks = spark.createDataFrame([(i, int(i < 60)) for i in range(160)], "page_id long, bad int")
        got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), marks).collect()}
        assert all((got[i]["verdict"], got[i]["template"]) == (("block", f"/{top}/spam/*") if i < 60 else ("allow", f"/{top}/good/*")) for i in range(160))
    # a few branches that are alike are one template
    urls = spark.createDataFrame([(i, f"http://h.net/a/b/c/{i}/x{i}") for i in range(3)], "page_id long, url string")
    assert {r["template"] for r in url_filter.judge(urls).collect()} == {"/a/b/c/*/*"}


def test_licenses_by_words(spark):
    texts = ["Under the MIT-license. under THE mit license", "underx the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0 é", None, "", "GNU General Public License, version 3."]
    got = {r["doc_id"]: r for r in license_scan.scan(odd(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, label) for phrase, label in license_scan.BASE for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        starts = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[6]["labels"] == "gpl-3" and got[4]["score"] == 0 and len(license_scan.RULES) > 200


def _of_regex(rng, tree):
    """A random text that the parsed regex matches, but for what surrounds it."""
    out = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "ANY":
            out.append("q")
        elif op == "IN":
            op, arg = rng.choice(arg)
            out.append(chr(arg) if str(op) == "LITERAL" else " ")
        elif op == "SUBPATTERN":
            out.append(_of_regex(rng, arg[3]))
        elif op == "BRANCH":
            out.append(_of_regex(rng, rng.choice(arg[1])))
        elif op == "MAX_REPEAT":
            out += (_of_regex(rng, arg[2]) for _ in range(rng.randint(arg[0], max(arg[0], min(1, arg[1])))))
    return "".join(out)


def test_no_rule_is_lost_by_its_words(spark):
    rng = random.Random(5)
    texts = ["released under the MIT", "distributed under Apache 2.0", "MPL 2.0", "available under BSD-3-Clause", "open database license 1.0", "do what the fuck you want to public license"]
    texts += {_of_regex(rng, re._parser.parse(r[-1])) for r in license_scan.RULES for _ in range(12)}
    got = {r["doc_id"]: r for r in license_scan.scan(odd(spark, list(enumerate(texts))).repartition(8)).collect()}
    for i, t in enumerate(texts):
        hits = sorted((m.start(), -m.end(), r[0], r[1]) for r in license_scan.RULES for m in re.finditer(r[-1], t.lower()))
        kept = [h for k, h in enumerate(hits) if not any(o[0] <= h[0] and o[1] <= h[1] and o[2] <= h[2] for o in hits[:k])]
        assert [tuple(d) for d in got[i]["detections"]] == kept, t
    assert [got[i]["labels"] for i in range(6)] == ["mit", "apache-2", "mpl-2", "bsd-3-clause", "odbl-1", "wtfpl"]
    bodies = ["Permission is hereby granted, free of charge,\n to any person obtaining a copy of this software and", "Redistribution and use in source and binary forms, with or without modification, are permitted", "pineapple public source license", LONG + " boost software license 1.0 " + LONG]
    assert [r["labels"] for r in license_scan.scan(odd(spark, list(enumerate(bodies)))).orderBy("doc_id").collect()] == ["mit", "bsd", "", "bsl-1"]
    clash = spark.createDataFrame([(1, "mit license", "x", 2.0, "y", "z")] * 2, "doc_id long, text string, labels string, score double, license_scan_low string, detections string")
    got = license_scan.scan(clash)
    assert sorted(got.columns) == sorted(["doc_id", "text", "license_scan_low", *license_scan.RESULT])
    assert [r["labels"] for r in got.collect()] == ["mit"] * 2 and license_scan.scan(clash.limit(0)).count() == 0


def test_mix(spark, sample):
    rows = [tuple(r) for r in source_mix.mix(sample).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()]
    again = [tuple(r) for r in source_mix.mix(sample).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()]
    assert sorted(rows, key=repr) == sorted(again, key=repr) and len(rows) == sample.count()
    targets, taken = {}, {}
    for _, source, size, source_size, target, copies, words in rows:
        targets[source] = (target, source_size)
        taken[source] = taken.get(source, 0) + words
        assert words == copies * size <= 3 * size
    assert abs(sum(t for t, _ in targets.values()) - sum(r[2] for r in rows)) < 1e-6
    assert all(abs(taken[s] - t) <= 0.02 * size and t <= 3 * size for s, (t, size) in targets.items())
    assert source_mix.mixed(sample).columns == sample.columns
    assert source_mix.mix(odd(spark)).count() == len(ODD) and source_mix.mix(sample.limit(0)).count() == 0


def test_hypergeometric_is_the_distribution(spark):
    df = spark.range(4000).select(source_mix.hypergeometric(*(F.lit(x).cast("long") for x in (20, 8, 10)), source_mix._uniform(1, F.col("id"))).alias("x"))
    got = np.array([r[0] for r in df.collect()])
    assert abs(got.mean() - 4) < 0.08 and abs(got.var() - 10 * 0.4 * 0.6 * 10 / 19) < 0.15 and 0 <= got.min() and got.max() <= 8


def test_toxic_documents_are_caught(spark):
    rng = random.Random(1)
    plain, bad = [f"p{i}" for i in range(200)], ["idiot", "scum", "moron"]
    rows = [(i, " ".join(rng.choices(plain, k=60) + (rng.sample(bad, 2) if i % 10 == 0 else []))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0), int(i % 10 == 0)) for i in range(300)] + [(None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    docs = odd(spark, rows + [(900, None), (901, "")])
    got = {r["doc_id"]: r for r in toxicity_chain.score(docs, toxicity_chain.fit(docs, labels), ["doc_id"]).collect()}
    assert len(got) == 602
    held_out = range(300, 600)
    assert sum(got[i]["rejected"] == (i % 10 == 0) for i in held_out) >= 297
    none = toxicity_chain.fit(docs, labels.limit(0))
    assert toxicity_chain.score(docs, none, ["doc_id"]).where("rejected").count() == 0


def _walk(text, walker, shift):
    out, at = [0] * edit_fingerprint.SAMPLES, 0
    codes = walker.codes(text).tolist()
    for j in range(edit_fingerprint.SAMPLES << shift):
        if at == len(codes):
            break
        if not j & (1 << shift) - 1:
            out[j >> shift] = int(walker.symbols[codes[at]])
        at += int(walker.bits[j % edit_fingerprint.PERIOD][codes[at]])
    return out


def test_fingerprints_by_a_plain_walk(spark):
    walker = edit_fingerprint.Walker()
    texts = ["", "a", "hello world" * 20, "é日\U0001d4f3" * 500, LONG[:5000]]
    for t, (shift, symbols) in zip(texts, walker.fingerprints(texts)):
        assert symbols.tolist() == _walk(t, walker, shift)
        assert edit_fingerprint.read(edit_fingerprint.written((shift, symbols)))[1].tolist() == symbols.tolist()
    rows = sorted(ODD)
    got = {r["doc_id"]: r for r in edit_fingerprint.with_edits(odd(spark).repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        new = edit_fingerprint.edited(t or "", rows[(k + 1) % len(rows)][1] or "")
        a, b, c = walker.fingerprints([t or "", new, rows[(k + 1) % len(rows)][1] or ""])
        want = (len(t or ""), hashlib.sha256(new.encode()).hexdigest(), edit_fingerprint.written(a), edit_fingerprint.written(b), edit_fingerprint.likeness(a, b), edit_fingerprint.likeness(a, c))
        assert tuple(got[i])[1:] == want
    assert edit_fingerprint.with_edits(odd(spark).limit(0)).count() == 0
    groups = {r["doc_id"]: r["near_group"] for r in edit_fingerprint.with_groups(odd(spark)).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    twice = edit_fingerprint.with_groups(odd(spark).unionAll(odd(spark))).select("doc_id", "fingerprint", "near_group").collect()
    assert len(twice) == 16 and {(r["doc_id"], r["near_group"]) for r in twice} == set(groups.items())
    assert edit_fingerprint.with_groups(odd(spark).limit(0)).count() == 0


def _edited_copies(rng, n, share):
    """n random texts, and a copy of each with this share of its characters replaced, put in or left out."""
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randint(60, 1500))) for _ in range(n)]

    def edit(c):
        return c if rng.random() >= share else rng.choice(("", "#", c + "#"))

    return texts, ["".join(map(edit, t)) for t in texts]


def test_near_copies_by_brute_force(spark, monkeypatch):
    """Groups are those of all pairs of fingerprints, for lists of any length, and they find near texts."""
    rng = random.Random(9)
    texts, copies = _edited_copies(rng, 150, 0.004)
    rows = list(enumerate(texts + copies + ["", "", None]))
    found = edit_fingerprint.Walker().fingerprints([t or "" for _, t in rows])
    low = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(i):
                if low[i] != low[j] and edit_fingerprint.likeness(found[i], found[j]) >= edit_fingerprint.NEAR:
                    low[i] = low[j] = min(low[i], low[j])
    docs = odd(spark, rows)
    got = {r["doc_id"]: r["near_group"] for r in edit_fingerprint.with_groups(docs).collect()}
    assert sum(got[i] == low[i] for i in got) >= 0.99 * len(rows)
    assert all(got[got[i]] == got[i] for i in got) and len({got[300], got[301], got[302]}) == 1
    recall = sum(got[150 + i] == got[i] for i in range(150)) / 150
    near = [edit_fingerprint.edit_distance(a, b) <= 0.02 * max(len(a), len(b)) for a, b in zip(texts, copies)]
    assert recall >= 0.9 and sum(near) >= 0.99 * len(near)
    # one list of all, in cells of few members: every pair of alike fingerprints is found
    monkeypatch.setattr(edit_fingerprint, "bands", lambda f: (np.ones(len(f), np.int64), np.arange(len(f))))
    monkeypatch.setattr(cells, "CELL", 7)
    got = {r["doc_id"]: r["near_group"] for r in edit_fingerprint.with_groups(docs).collect()}
    assert [got[i] for i in range(300)] == low[:300]


def test_repeated_windows_by_brute_force(spark, sample):
    docs = {r["doc_id"]: (r["text"] or "").encode().split() for r in sample.collect()}
    first = {}
    for i in sorted(docs):
        for s in range(len(docs[i]) - 49):
            first.setdefault(tuple(docs[i][s : s + 50]), i)
    got = {r["doc_id"]: r for r in substring_dedup.dedup(sample).collect()}
    for i, w in docs.items():
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < i for p in range(s, s + 50)}
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    assert sum(r["n_removed"] for r in got.values()) > 1000
    assert substring_dedup.dedup(odd(spark)).where("doc_id = 7").first()["n_removed"] == 30_000
    assert substring_dedup.dedup(sample.limit(0)).count() == 0


def test_jaccard_components_by_brute_force(spark, sample):
    sets = {}
    for r in sample.collect():
        w = (r["text"] or "").split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(sample).collect()}
    assert got == {i: (len(sets[i]), low[i]) for i in sets} and any(low[i] != i for i in sets)
    assert jaccard_join.first_of_each(sample).count() == sum(low[i] == i for i in sets)
    assert jaccard_join.join(sample.limit(0)).count() == 0


def test_light_sets_need_no_prefix():
    assert jaccard_join.boundary(0.0) < jaccard_join.boundary(30.0) <= jaccard_join.boundary(1e9) == jaccard_join.MOST_LIGHT
    light = jaccard_join.boundary(30.0)
    for a in range(1, light + 1):
        for b in range(a, light + 1):
            need = jaccard_join.needed(a, b)
            if need <= a:
                assert need in jaccard_join.subset_sizes(a, light) and need in jaccard_join.subset_sizes(b, light)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(5, 3), (3, 5), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 3: 3, 5: 3}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    codec = sentencepiece_codec.PieceCodec(sentencepiece_codec.load_model())
    assert rows and set(docs[0].asDict()) | {"ids"} == set(out.columns)
    assert all(codec.decode(r["ids"]) == r["text"] and not secret_scan.base_spans(r["text"]) for r in rows)
    assert max(sum(1 for r in rows if r["doc_id"] == i) for i in {r["doc_id"] for r in rows}) <= 3


CLASH = "doc_id long, text string, source string, n_chars long, rejected string, p_toxic string, p_low_quality int, n_assign string, spans int, feature string, component_id int, size string, copies string, ids string, unit int, taken string, row int"


def clashing(spark, texts):
    """Rows whose columns have names that operators give to their results."""
    return spark.createDataFrame([(i, t, "s" if i % 2 else None, 1, "r", "p", 3, "a", 4, "f", 5, "z", "c", "i", 6, "t", 7) for i, t in texts], CLASH)


def test_names_that_clash(spark):
    df = clashing(spark, [(1, "a b c"), (2, None), (3, "token=abcdef123"), (3, "token=abcdef123")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity_chain.reject(df, labels)
    assert kept.columns == df.columns and kept.count() >= 1
    for out in (jaccard_join.first_of_each(df), secret_scan.redact(df), source_mix.mixed(df)):
        assert out.columns == df.columns
        assert out.where("rejected <> 'r' OR p_low_quality <> 3 OR size <> 'z'").count() == 0
    assert secret_scan.redact(df).where("text LIKE '%[SECRET]%'").count() == 2
    found = secret_scan.find(df, df.columns).collect()
    assert [r["n_assign"] for r in found] == [0, 0, 1, 1] and found[0]["rejected"] == "r"
    scored = toxicity_chain.score(df, toxicity_chain.fit(df, labels), df.columns)
    assert scored.schema["rejected"].dataType.simpleString() == "boolean" and scored.count() == 4
    heard = mpeg_audio.inspect(mpeg_audio.store(df), df.columns).collect()
    assert len(heard) == 4 and heard[0]["feature"].startswith("frames=")
    encoded = sentencepiece_codec.encode(df)
    assert sorted(encoded.columns) == sorted(df.columns) and encoded.first()["ids"] != "i"


def test_repeated_rows(spark, sample):
    rows = spark.createDataFrame([(i, f"w{i} " * (5 + i % 7), "s" if i % 3 else "t") for i in range(20)], "doc_id long, text string, source string")
    twice = rows.unionAll(rows)
    mixed = source_mix.mixed(twice)
    assert mixed.count() == source_mix.mix(twice).agg(F.sum("copies")).first()[0]
    assert jaccard_join.first_of_each(rows.limit(2).unionAll(rows.limit(2)).unionAll(rows.limit(2))).count() == 2
    # one doc_id in two sources
    both = spark.createDataFrame([(i, "x " * (1 + i % 9), s) for i in range(3000) for s in ("a", "b")], "doc_id long, text string, source string")
    got = source_mix.mix(both).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.01 * r["target"] for r in got)
    base = secret_scan.find(twice, ["doc_id"])
    assert base.count() == 40 and base.distinct().count() == 20


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sentencepiece_codec.digest(none).count() == 0 and secret_scan.find(none, ["doc_id"]).count() == 0
    assert mpeg_audio.inspect(mpeg_audio.store(none), ["doc_id"]).count() == 0 and license_scan.scan(none).count() == 0
    assert toxicity_chain.reject(none, labels).count() == 0 and source_mix.mixed(none).count() == 0
    assert jaccard_join.first_of_each(none).count() == 0 and substring_dedup.dedup(none).count() == 0


def test_very_long_texts(spark):
    long = "word " * 400_000 + SECRET
    df = odd(spark, [(1, long)])
    assert secret_scan.find(df, ["doc_id"]).first()["spans"].count(":") == 2
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity_chain.score(df, toxicity_chain.fit(df, labels), ["doc_id"]).count() == 1


def test_a_large_near_group_is_one_component(spark, monkeypatch):
    """Hundreds of copies, each with its own few edits, among them ones too far from the others, held against brute force, in
    small cells and with shingles that are hot at once."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in range(rng.choice((1, 2, 3, 4, 5, 6))):
            w[rng.randrange(len(w))] = f"e{i}-{k}"
        rows.append(" ".join(w))
    rows += [" ".join(f"c{rng.randrange(9)}" for _ in range(rng.randint(3, 14))) for _ in range(150)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for w in (r.split() for r in rows)]
    low = list(range(len(rows)))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(12):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    for cell, hot, flush in ((1024, 32, 1 << 20), (16, 3, 500)):
        monkeypatch.setattr(cells, "CELL", cell)
        monkeypatch.setattr(jaccard_join, "HOT_HERE", hot)
        monkeypatch.setattr(jaccard_join, "FLUSH_SHINGLES", flush)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(odd(spark, list(enumerate(rows)))).collect()}
        assert [got[i] for i in range(len(rows))] == low


def _far_copies(rng, n):
    """Copies of one text of 150 words, each with its own two or three edits, so that most are too far from most others."""
    rows = []
    for i in range(n):
        w = [f"b{k}" for k in range(150)]
        for k in range(rng.choice((2, 3, 3))):
            w[rng.randrange(len(w))] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    return rows


def _counted(counts, name, f):
    def run(df, *rest):
        counts[name] += df.count()
        return f(df, *rest)

    return run


def test_jaccard_of_a_near_group_gives_few_rows(spark, monkeypatch):
    """What is verified and linked of a near group grows with its members, not with their pairs, in several cells too."""
    counts = {"verified": 0, "edges": 0}
    monkeypatch.setattr(jaccard_join, "verified", _counted(counts, "verified", jaccard_join.verified))
    every = _counted(counts, "edges", components.components)
    monkeypatch.setattr(components, "components", every)
    monkeypatch.setattr(jaccard_join, "components", every)
    monkeypatch.setattr(cells, "CELL", 100)
    assert jaccard_join.join(odd(spark, _far_copies(random.Random(11), 300))).count() == 300
    assert counts["verified"] <= 8 * 300 and counts["edges"] <= 5 * 300


def test_near_copies_of_the_pipeline_give_few_rows(spark, monkeypatch):
    """The same in one cell, through the stage."""
    import corpus_pipeline

    counts = {"verified": 0}
    monkeypatch.setattr(jaccard_join, "verified", _counted(counts, "verified", jaccard_join.verified))
    docs = odd(spark, _far_copies(random.Random(12), 300))
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert counts["verified"] <= 8 * 300
    assert kept == {r["component_id"] for r in jaccard_join.join(docs).collect()}


def test_fingerprints_of_a_near_group_give_few_links(spark, monkeypatch):
    counts = {"edges": 0}
    every = _counted(counts, "edges", components.components)
    monkeypatch.setattr(components, "components", every)
    monkeypatch.setattr(edit_fingerprint, "components", every)
    monkeypatch.setattr(cells, "CELL", 100)
    assert edit_fingerprint.with_groups(odd(spark, _far_copies(random.Random(11), 300))).count() == 300
    assert counts["edges"] <= 4 * 300


def test_pipeline_by_brute_force(spark, tmp_path):
    """Which documents stay and how often, stage by stage on a fixture with each case, against plain Python."""
    import corpus_pipeline

    rng = random.Random(2)
    plain = [f"p{i}" for i in range(300)]
    texts = [" ".join(rng.choices(plain, k=rng.randint(8, 60)) + (["scum", "idiot"] if i % 9 == 0 else [])) for i in range(200)]
    texts += [texts[3], texts[4] + " tail", texts[5].upper(), texts[1] + ' password = "hunter22x"', None, ""]
    docs = [(i, t, "en", "s%d" % (i % 3), len(t or ""), "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, lang string, source string, n_chars long, rejected string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), df.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        out = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        assert out.columns == (names if name != "SentencePiece" else [*names, "ids"])
        seen.append([tuple(r) for r in out.select(*names).collect()])
    clean = [d for d in docs + docs[:5] if "scum" not in (d[1] or "")]
    assert sorted(map(repr, seen[0])) == sorted(map(repr, clean))
    sets = {d[0]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (d[1] or "").lower().split()) else set() for d in clean}
    low = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                    low[a] = low[b] = min(low[a], low[b])
    assert sorted(r[0] for r in seen[1]) == sorted(i for i in low if low[i] == i)
    assert [r[0] for r in sorted(seen[2])] == [r[0] for r in sorted(seen[1])] and all("hunter22x" not in (r[1] or "") for r in seen[2])
    size = {r[0]: len((r[1] or "").split()) for r in seen[2]}
    times = {i: sum(r[0] == i for r in seen[3]) for i in size}
    assert max(times.values()) <= 3 and all(times[i] == 0 for i in size if not size[i])
    by = {s: sum(size[r[0]] for r in seen[2] if r[3] == s) for s in ("s0", "s1", "s2")}
    for s, weight in zip(sorted(by), (1, 2, 3)):
        taken = sum(size[r[0]] for r in seen[3] if r[3] == s)
        assert abs(taken - sum(by.values()) * weight / 6) <= max(size.values()) or taken == 3 * by[s]
    codec = sentencepiece_codec.PieceCodec(sentencepiece_codec.load_model())
    assert all(codec.decode(r["ids"]) == (r["text"] or "") for r in out.collect()) and len(seen[4]) == len(seen[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in whole.collect()) == sorted(repr(tuple(r)) for r in out.collect())
