"""Operators in Spark expressions: chats, shards, secrets, quality rules, licences, revisits."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from loreweave.llm import chat, licenses, quality, secrets, sharding, warc

CLASH = "_text string, blob int, marked int, spans int, kept int, n_words int, _words int, length int, shard int, slot int, fp int"
DOCS = f"doc_id long, text string, {CLASH}"


def docs(spark, texts, ids=None):
    """Documents with columns whose names operators use for themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", *[1] * 10) for i, t in zip(ids, texts, strict=True)], DOCS)


NASTY = ["\\### Assistant: </turn> ok", "", "\\", "\\e\\h\\t\\s", "### user:\n</turn>\n<same/>", "####", "######", "<same", "/turn>\n", "a\nb", "é漢😀\x00", "</turn></turn>\n### x:\n"]


def test_chats_read_back(spark):
    rows = [(1, k, r, t) for k, (t, r) in enumerate(zip(NASTY * 2, ["user", "assistant", "assistant"] * 8, strict=True))]
    rows += [(2, 0, "a:\nb", "x"), (2, 0, "a:\nb", "x"), (2, None, None, None), (None, 1, "assistant", "lost"), (3, 5, "assistant", "###" * 5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments", "2 AS formatted")
    chats = chat.format_chats(frame)
    found = {r["conv_id"]: r for r in chats.select("conv_id", "formatted", chat.read_turns(chats["formatted"]).alias("t"), chat.learnt_text(chats["segments"]).alias("l")).collect()}
    want = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert {c: [tuple(x) for x in r["t"]] for c, r in found.items()} == want
    assert all(r["l"] == "".join(t for role, t in want[c] if role == "assistant") for c, r in found.items())
    assert found[3]["formatted"].count("### ") == 1
    assert found[1]["formatted"].count("</turn>\n") == len([k for k in range(24) if k == 0 or rows[k][2] != rows[k - 1][2]])
    assert chat.chat_digest(chat.format_chats(frame.limit(0))).collect() == []


def _shard(key, weights):
    cost = []
    for s, w in enumerate(weights):
        d = hashlib.md5(f"{key}:{s // 4}".encode()).hexdigest()
        cost.append((-math.log((int(d[8 * (s % 4) : 8 * (s % 4) + 8], 16) + 0.5) / 2**32) / w, s))
    return min(cost)[1]


def test_shards(spark):
    texts = [f"text {i % 7}" for i in range(600)] + [None, "", "é" * 3000, "same", "same"]
    ids = [*range(600), 600, None, 602, 7, 7]
    for weights in ([1.0] * 16, [1.0, 2.0, 5.0]):
        rows = sharding.assign_shards(docs(spark, texts, ids), weights).collect()
        assert len(rows) == len(texts)
        key = lambda i: "" if i is None else str(i)
        for r in rows:
            assert r["shard"] == _shard(key(r["doc_id"]), weights)
            assert r["grown_shard"] == _shard(key(r["doc_id"]), [*weights, 1.0]) and r["grown_shard"] in (r["shard"], len(weights))
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        for s in range(len(weights)):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    share = Counter(r["shard"] for r in rows)
    assert share[2] > share[1] > share[0]
    assert sharding.assign_shards(docs(spark, []), [1.0, 1.0]).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_of(docs(spark, [])["doc_id"], [1.0, 0.0])


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SECRET_TEXTS = [
    "token:token:abcdefgh", "token=token=abcdefgh", 'é😀 PassWord" : "s3cret/x_y" and api_key=12345', "AKIAAKIA" + "A" * 30 + " AKIAB", "x" + "0a" * 12 + " " + "0a" * 11 + "g", None, "", "secret= ſecret=abcdefg K",
    "token=" + "a" * 30 + "\n" + "b" * 24 + "password='" + "AKIA" + "Z" * 16 + "'", "apikey = abc.def-ghi" * 40,
]


def _secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def _spans(row):
    return tuple((s["start"], s["rank"], s["end"], s["kind"]) for s in row["spans"])


def test_secrets_and_ledger(spark):
    frame = docs(spark, SECRET_TEXTS * 2)
    found = secrets.find_secrets(frame).collect()
    assert Counter((r["doc_id"], _spans(r)) for r in found) == Counter((k, tuple(_secrets(t))) for k, t in enumerate(SECRET_TEXTS * 2))
    ledger = secrets.scan_unseen(secrets.addressed(docs(spark, SECRET_TEXTS[:3]))).cache()
    again = secrets.scan_unseen(secrets.addressed(docs(spark, SECRET_TEXTS)), ledger=ledger)
    # Null and empty text are one blob.
    assert again.count() == len(set(t or "" for t in SECRET_TEXTS)) - 3
    rules = (secrets.SecretRule("assign", "2", "nothing like this"), *secrets.RULES[1:])
    old = secrets.addressed(docs(spark, SECRET_TEXTS[:3]))
    assert {tuple(r["scanned"]) for r in secrets.scan_unseen(old, rules, ledger).collect()} == {("assign@2",)}
    assert secrets.scan_unseen(old, secrets.RULES, ledger).count() == 0
    merged = secrets.find_secrets(docs(spark, SECRET_TEXTS), ledger=ledger).collect()
    assert {r["doc_id"]: _spans(r) for r in merged} == {k: tuple(_secrets(t)) for k, t in enumerate(SECRET_TEXTS)}
    # What a replaced rule version found is gone.
    later = secrets.find_secrets(docs(spark, SECRET_TEXTS), rules, ledger).collect()
    assert {r["doc_id"]: _spans(r) for r in later} == {k: tuple(s for s in _secrets(t) if s[3] != "assign") for k, t in enumerate(SECRET_TEXTS)}
    assert secrets.find_secrets(docs(spark, [])).collect() == []


def test_secrets_of_null_ids_repeated_rows_and_a_very_long_text(spark):
    long = "word " * 400_000 + "AKIA" + "X" * 20 + " " + "é" * 1000 + " token: abcdef"
    texts, ids = [long, long, "password=hunter22", "password=hunter22", "password=hunter22", None], [None, None, 3, 3, 4, None]
    found = secrets.find_secrets(docs(spark, texts, ids)).collect()
    assert Counter((r["doc_id"], _spans(r)) for r in found) == Counter((i, tuple(_secrets(t))) for i, t in zip(ids, texts, strict=True))
    # Copies are scanned once.
    assert secrets.scan_unseen(secrets.addressed(docs(spark, texts, ids))).count() == 3


def test_redaction_leaves_no_secret(spark):
    frame = secrets.find_secrets(docs(spark, SECRET_TEXTS))
    for r in frame.select("text", secrets.redacted(frame["text"], frame["spans"]).alias("out")).collect():
        spans, want, at = _secrets(r["text"]), "", 0
        for start, _, end, _ in spans:
            if start >= at:
                want += r["text"][at:start] + "[SECRET]"
            at = max(at, end)
        assert r["out"] == (want + r["text"][at:] if spans else r["text"])


QUALITY_TEXTS = [
    None, "", " \n\t", "a b", "a b c a b c", "the the the the", "one two three one two three " * 20, "la x\nla x\n\n la x\nq #*$%&|<>", " ".join(f"w{i}" for i in range(60)),
    " ".join(f"the word{i} of" for i in range(30)), "\u00a0x\u2003y z\x0bq\x1cr", "word " * 20000, "- a\n- b\n* c ... \nd…",
]


def _quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def test_quality(spark):
    rows = quality.judged(docs(spark, QUALITY_TEXTS)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _quality(QUALITY_TEXTS[r["doc_id"]]), r["doc_id"]
    assert {r["doc_id"]: r["kept"] for r in rows}[9] and not {r["doc_id"]: r["kept"] for r in rows}[8]
    assert quality.judged(docs(spark, [])).collect() == []
    filtered = quality.judged(docs(spark, QUALITY_TEXTS)).filter("kept AND n_repeat_words < 9")
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1


def _filled(name):
    return licenses.SENTENCES[name].replace("{}", "The Example Project and Friends")


def test_licences(spark):
    one, at, url, as_is, see = (licenses.SENTENCES[k] for k in ("apache-notice", "apache-copy", "apache-url", "apache-as-is", "apache-see"))
    notice = f"# {one}\n# {at}\n#\n#     {url}\n#\n# {as_is}\n# {see}"
    wrapped = notice.replace("compliance with", "compliance\n# with")
    mit = " ".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    want = {
        "Some words\nLicensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "nothing here": [],
        "": [],
        "prose. Licensed under CC BY-NC 4.0. prose": ["CC-BY-NC-4.0"],
        wrapped: ["Apache-2.0"],
        "The MIT License (MIT)\n\nCopyright me\n\n" + mit: ["MIT"],
        "Released under the MIT License.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.": ["MIT", "GPL-3.0-only"],
        "A licence of my own. Permission denied.": [],
        "x. " * 50_000 + "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0-only"],
        wrapped + "\na line without a full stop\nLicensed under CC BY 4.0.": ["Apache-2.0", "CC-BY-4.0"],
        "A title\n" + mit.replace("free of charge, ", "free of charge,\n * "): ["MIT"],
        "# This is free and unencumbered software released into the public\n# domain.": ["Unlicense"],
        "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": ["GPL-2.0-or-later"],
        "To the extent possible under law,\nA. Person Jr. has waived all copyright and related or neighboring rights to\nThis Work.": ["CC0-1.0"],
    }
    texts = [*want, None]
    found = {r["doc_id"]: r for r in licenses.scan_licences(docs(spark, texts)).collect()}
    assert [found[k]["licences"] for k in range(len(texts))] == [*want.values(), []]
    assert found[5]["n_left"] == 0 and found[6]["n_known"] == 3
    assert all(any(m in s.lower() for m in licenses.MARKERS) for s in licenses.SENTENCES.values())
    assert licenses.scan_licences(docs(spark, [])).collect() == []


@pytest.mark.parametrize("wrap", [False, True])
def test_every_sentence_and_every_rule_is_reached(wrap):
    rules = tuple((r.licence, re.compile(r.pattern)) for r in licenses.RULES)
    broken = lambda t: re.sub(r"(\S+ \S+ \S+) ", r"\1\n# ", t) if wrap else t
    for name in licenses.SENTENCES:
        # One sentence ends in words of any kind; wrapped, its last line is not known to belong to it.
        assert licenses.identifiers(broken(_filled(name))).removesuffix("<?>") == f"<{name}>"
    assert {s.rstrip("?") for r in licenses.RULES for s in r.steps} == set(licenses.SENTENCES) and len(set(licenses.RULES)) == len(licenses.RULES)
    for k, r in enumerate(licenses.RULES):
        for steps in ([s for s in r.steps if not s.endswith("?")], [s.rstrip("?") for s in r.steps]):
            for gap in ("\n", "\nsomething else here\n"):
                ids = licenses.identifiers(gap.join(broken(_filled(s)) for s in steps))
                assert licenses.recognised(ids, rules)[0] == [r.licence], (r, ids)
                # and by this rule, not by a later one
                assert not any(p.search(ids) for _, p in rules[:k]) and licenses.recognised(ids, rules[k : k + 1])[0] == [r.licence]


@pytest.mark.parametrize("name", [k for k, v in licenses.SENTENCES.items() if v.count("{}") and not v.endswith("{}.")])
def test_open_places_have_no_bound(name):
    holder = " ".join(f"Holder{k}" for k in range(3000))
    for sentence in (licenses.SENTENCES[name].replace("{}", holder), _filled(name)):
        assert licenses.identifiers(sentence) == f"<{name}>"
        assert licenses.identifiers("Before.\n" + sentence.replace(" ", "\n") + "\nBehind.") == f"<?><{name}><?>"
    first = licenses.SENTENCES[name].split("{}")[0]
    # A beginning without an end, then a whole sentence: the later beginning counts. Without any end none is known.
    assert licenses.identifiers(f"{first} nobody.\n{_filled(name)}") == f"<?><{name}>"
    assert licenses.identifiers(f"{first} nobody. " * 2000) == ""


def test_expected_licences_are_stated(spark):
    """Texts and what they say, without a look at the operator's tables."""
    bsd = "Neither the name of the Association of Very Many Contributors to the Project of That Name nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    known = {
        bsd: "<bsd-names>",
        bsd.replace(" ", "\n# "): "<bsd-names>",
        'THIS SOFTWARE IS PROVIDED BY THE REGENTS OF A UNIVERSITY, ITS STAFF, STUDENTS, FRIENDS, AND ALL OTHER CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.': "<bsd-as-is>",
        "To the extent possible under law, A. N. Author has waived all copyright and related or neighboring rights to A Work of Many Words.": "<cc0-person>",
        "Neither the name of the holder may be used.": "",
    }
    found = {r["doc_id"]: r["identifiers"] for r in licenses.scan_licences(docs(spark, list(known))).collect()}
    assert [found[k].replace("<?>", "") for k in range(len(known))] == list(known.values())


def test_revisits(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    at = lambda n: base + timedelta(seconds=n)
    rows = [
        (1, "response", "http://www.A.com:80/x/?utm_source=f#top", at(0), {"etag": "1", "content-length": "9", "cache-control": "old"}, "d1"),
        (2, "revisit", "https://a.com/x", at(5), {"etag": "W/1", "cache-control": "new", "content-length": "0"}, None),
        (3, "response", "https://a.com/x", at(7), {"etag": "2"}, "d2"),
        (4, "revisit", "https://a.com/x", at(7), {"etag": "1"}, None),
        (5, "revisit", "https://a.com/x", at(9), {}, "d2"),
        (6, "revisit", "https://a.com/x", at(900), None, None),
        (7, "revisit", "https://a.com/y", at(9), {"etag": "1"}, None),
        (8, "revisit", None, at(9), {"etag": "1"}, None),
        (9, "revisit", "https://a.com/x", None, {"etag": "1"}, None),
        (10, "request", "https://a.com/x", at(1), {}, None),
        (11, "revisit", "  ", at(9), {"etag": "1"}, None),
        (2, "revisit", "https://a.com/x", at(5), {"etag": "W/1", "cache-control": "new", "content-length": "0"}, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, date timestamp, headers map<string,string>, payload_digest string").selectExpr("*", "1 AS latest", "2 AS verdict")
    for rows_per_slice in (1, 3, 50_000):
        found = sorted(((r["record_id"], r["verdict"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(frame, rows_per_slice).collect()), key=lambda x: x[0])
        assert [x[:3] for x in found] == [(2, "resolved", 1), (2, "resolved", 1), (4, "validators differ", None), (5, "resolved", 3), (6, "no validator", None), (7, "no response", None), (8, "no response", None), (9, "no response", None), (11, "no response", None)]
        assert found[0][3] == {"etag": "W/1", "content-length": "9", "cache-control": "new"}
    assert warc.resolve_revisits(frame.limit(0)).collect() == []


WARC = """WARC/1.0
WARC-Type: warcinfo
WARC-Record-ID: <urn:a:0>
Content-Length: 4

soft

WARC/1.0
WARC-Type: response
warc-record-id: <urn:a:1>
WARC-Target-URI: http://a.com/x
WARC-Date: 2024-01-01T00:00:00.123Z
WARC-Payload-Digest: sha1:AAA

HTTP/1.1 200 OK
ETag: "1"
Set-Cookie: a
set-cookie: b

<html>

one: two</html>

WARC/1.0
WARC-Type: response
WARC-Record-ID: <urn:a:2>
WARC-Target-URI: http://a.com/x
WARC-Date: 2024-01-01T00:00:10Z

HTTP/1.1 200 OK
ETag: "2"

new

WARC/1.0
WARC-Type: response
WARC-Record-ID: <urn:a:3>
WARC-Target-URI: http://a.com/x
WARC-Date: 2024-01-01T00:00:20Z

HTTP/1.1 304 Not Modified
ETag: W/"2"
Expires: never

WARC/1.0
WARC-Type: revisit
WARC-Record-ID: <urn:a:4>
WARC-Target-URI: http://b.com/
WARC-Date: 2024-01-01T00:00:30Z
WARC-Refers-To-Target-URI: https://www.a.com/x
WARC-Refers-To-Date: 2024-01-01T00:00:00Z
WARC-Payload-Digest: sha1:AAA

HTTP/1.1 200 OK

"""


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_are_read_and_resolved(spark, tmp_path, packed):
    import gzip

    raw = WARC.replace("\n", "\r\n").encode()
    if packed:  # a compressed file has a member for each record
        cuts = [0, *(m.start() for m in re.finditer(rb"(?<!^)WARC/1.0\r\n", raw)), len(raw)]
        raw = b"".join(gzip.compress(raw[a:b]) for a, b in zip(cuts, cuts[1:]))
    (tmp_path / ("x.warc.gz" if packed else "x.warc")).write_bytes(raw)
    records = warc.read_warc(spark, str(tmp_path))
    found = {r["record_id"]: r for r in records.collect()}
    assert {k: (r["kind"], r["status"]) for k, r in found.items()} == {"urn:a:1": ("response", 200), "urn:a:2": ("response", 200), "urn:a:3": ("revisit", 304), "urn:a:4": ("revisit", 200)}
    assert found["urn:a:1"]["headers"] == {"etag": '"1"', "set-cookie": "a, b"} and found["urn:a:1"]["payload_digest"] == "sha1:AAA" and found["urn:a:2"]["payload_digest"] is None
    told = {r["record_id"]: (r["verdict"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(records).collect()}
    assert told == {"urn:a:3": ("resolved", "urn:a:2", {"etag": 'W/"2"', "expires": "never"}), "urn:a:4": ("resolved", "urn:a:1", {"etag": '"1"', "set-cookie": "a, b"})}


def test_warc_files_that_are_written(spark, tmp_path):
    from datetime import datetime

    rows = [(1, "response", "http://a/", datetime(2024, 5, 6, 7, 8, 9), 200, {"ETag": "x"}, "d", "body\n\n and é"), (2, "revisit", "http://a/", datetime(2024, 5, 7), 304, {}, None, None)]
    frame = spark.createDataFrame(rows, "record_id long, kind string, url string, date timestamp, status int, headers map<string,string>, payload_digest string, body string")
    warc.write_warc(frame, str(tmp_path / "w"))
    back = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=lambda r: r["record_id"])
    assert [(r["record_id"], r["kind"], r["url"], r["date"], r["status"], r["headers"], r["payload_digest"]) for r in back] == [(f"urn:record:{k}", kind, u, d, s, {a.lower(): b for a, b in h.items()}, p) for k, kind, u, d, s, h, p, _ in rows]
    warc.write_warc(frame.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).collect() == []


def _record(kind, name, body, date="2024-01-01T02:30:00Z", version="1.1", length=None):
    raw = body.encode()
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{name}>\r\nWARC-Target-URI: http://{name}/\r\nWARC-Date: {date}\r\nContent-Length: {len(raw) if length is None else length}\r\n\r\n"
    return head.encode() + raw + b"\r\n\r\n"


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_records_are_as_long_as_they_say(spark, tmp_path, split):
    http = "HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    example = "a page on files:\r\n\r\n" + _record("response", "forged", http + "x").decode() * 3 + "end"
    endless = "\r\n\r\n" + _record("response", "huge", http, length=10**9).decode()
    records = [_record("warcinfo", "info", "soft"), _record("response", "one", http + example), _record("response", "two", http, version="1.0"), _record("response", "three", http + endless * 2 + "\u00e9" * 99, version="0.18")]
    records += [_record("response", f"more{k}", http + (example if k % 3 == 0 else "short")) for k in range(40)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc").write_bytes(_record("response", "other", http) * 2)
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"no record\r\n\r\n" + _record("response", "late", http + "WARC/1.0\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["record_id"] for r in rows) == sorted(["urn:one", "urn:two", "urn:three", "urn:other", "urn:other", "urn:late", *(f"urn:more{k}" for k in range(40))])
    assert all(r["status"] == 200 and r["headers"] == {"a": "b"} for r in rows)


def test_dates_have_their_own_zone(spark, tmp_path):
    dates = ["2024-03-10T02:30:00Z", "2024-03-10T03:30:00.7Z", "2024-03-10T04:30:00+02:00", "2024-03-10T02:30:00", "never"]
    (tmp_path / "z.warc").write_bytes(b"".join(_record("response", f"d{k}", "HTTP/1.1 200 OK\r\n\r\n", d) for k, d in enumerate(dates)))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = warc.read_warc(spark, str(tmp_path)).selectExpr("record_id", "unix_timestamp(date) AS s", "url", "date", "'response' AS kind", "200 AS status", "map('A', 'b') AS headers", "CAST(NULL AS STRING) AS payload_digest", "'' AS body")
        told = {r["record_id"][-1]: r["s"] for r in rows.collect()}
        warc.write_warc(rows, str(tmp_path / "w"))
        back = {r["record_id"][-1]: r["s"] for r in warc.read_warc(spark, str(tmp_path / "w")).selectExpr("record_id", "unix_timestamp(date) AS s").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert told == back == {"0": 1710037800, "1": 1710041400, "2": 1710037800, "3": 1710037800, "4": None}


def test_line_ends_make_no_fields(spark, tmp_path):
    rows = [(1, "response", None, None, None, None, None, None)]
    schema = "record_id long, kind string, url string, date timestamp, status int, headers map<string,string>, payload_digest string, body string"
    warc.write_warc(spark.createDataFrame(rows, schema), str(tmp_path / "ok"))
    (back,) = warc.read_warc(spark, str(tmp_path / "ok")).collect()
    assert back["record_id"] == "urn:record:1" and back["url"] is None and back["date"] is None and back["status"] is None
    for bad in ({"url": "http://a/\r\nWARC-Type: x"}, {"headers": {"a": "b\nc: d"}}):
        row = {"record_id": 1, "kind": "response", "url": "u", "date": None, "status": 200, "headers": {}, "payload_digest": None, "body": ""} | bad
        with pytest.raises(Exception, match="line end"):
            warc.write_warc(spark.createDataFrame([tuple(row.values())], schema), str(tmp_path / str(len(bad)) / next(iter(bad))))
