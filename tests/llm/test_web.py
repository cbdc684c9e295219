"""URL filters and the web archive."""

import base64
import hashlib
import random

import pytest

from datascout import runtime
from datascout.llm import archive, urls

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.example.net", "/en/x", "block"), ("a.example.net", "/en/", "block"), ("EXAMPLE.org", None, "block"), ("b-c.org", "/", None),
]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.Example.net/en/x?y#z", "http://a.example.net/en", "http://xnet/",
    "http://b.a.example.net/en/xx/", "ftp://u:p@example.com:80/de/", "http://example.com/de/?q", "http://w.org/fr/1#2", "x://y://z", "http://a..net/",
    "http://b-c.org/", "http://d.b-c.org/\nq", "http://b.org/", "http://É.net/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for h, p, v in rules:
        h, p, v = (h or "").lower(), p or "", v or default
        if (host == h or host.endswith("." + h) or not h) and path.startswith(p):
            key = (len(h), len(p))
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return host, path, best and best[1], best[2] if best else default


@pytest.mark.parametrize("rules", [RULES, [], [("", "/en/", "block"), *RULES]])
def test_urls_are_judged_as_by_hand(spark, rules):
    rng = random.Random(1)
    labels = ["a", "b", "net", "org", "example", "com", "b-c", "z"]
    made = ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 5))) + rng.choice(["", "/", "/en/", "/en/x", "/de/1", "/fr/?"]) for _ in range(300)]
    rows = [(i, u, 1, "x") for i, u in enumerate(URLS + made + ["http://a.example.net/en/x"] * 300)] + [(None, "http://net/", 1, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, part int, key string")
    ruled = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = urls.judge_urls(table, ruled).collect()
    got = sorted((-1 if r.page_id is None else r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in found)
    want = sorted((-1 if i is None else i, *map(str, brute(u, rules))) for i, u, _, _ in rows)
    assert got == want
    assert urls.judge_urls(table.limit(0), ruled).count() == 0


PAGES = [
    (3, "http://c", "same"), (1, "http://a", "same"), (1, "http://a", "same"), (2, "http://b", None), (5, "http://b", ""), (4, "http://e", "é\r\n\r\nx"),
    (None, None, "nobody"), (6, "http://x\r\nWARC-Type: odd", "last"), (7, "http://d", "x" * 200_000), (8, "http://d", "x" * 200_000),
]


def _table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as key", "1 as payload")


@pytest.mark.parametrize("least", [0, 5])
def test_archive_reads_back(spark, least):
    out = runtime.scratch_path(spark, "warc-test")
    archive.write_archive(_table(spark), out, min_bytes=least)
    found = archive.read_archive(spark, out).collect()
    assert len(found) == len(PAGES)
    first = {}
    for page, _, html in sorted(PAGES, key=lambda r: -1 if r[0] is None else r[0]):
        first.setdefault(html or "", page)
    seen = {}
    for r in found:
        html = next(h or "" for p, _, h in PAGES if p == r.page)
        data = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if r.record_type == "response":
            assert r.refers_to is None
            seen.setdefault(html, []).append(r.page)
        else:
            assert r.refers_to == first[html] and len(data) >= least
    assert all(pages == [first[h]] for h, pages in seen.items() if len(h.encode()) >= least)
    assert spark.read.parquet(f"{out}/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_records_are_rebuilt(spark):
    out = runtime.scratch_path(spark, "warc-test")
    archive.write_archive(_table(spark), out)
    for full in (False, True):
        for r in archive.rebuild_records(spark, out, full).collect():
            head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
            lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            html = next((h or "").encode() for p, _, h in PAGES if p == r.page)
            body = html if full or lines["WARC-Type"] == "response" else b""
            assert rest == archive.HTTP_HEAD.encode() + body + b"\r\n\r\n"
            if not full:
                assert int(lines["Content-Length"]) == len(rest) - 4


def test_damage_is_found_and_empty_archives_work(spark):
    out = runtime.scratch_path(spark, "warc-test")
    archive.write_archive(_table(spark), out)
    spark.createDataFrame([("0" * 64, bytearray(b"bad"))], "key string, payload binary").write.mode("append").parquet(f"{out}/payloads")
    with pytest.raises(Exception, match="damaged"):
        archive.payloads_of(spark, out).collect()
    out = runtime.scratch_path(spark, "warc-test")
    archive.write_archive(_table(spark).limit(0), out)
    assert archive.read_archive(spark, out).count() == 0
