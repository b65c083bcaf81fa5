"""WARC, HTML extraction and token files: round trips, brute force, edge cases."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import html_text, token_scan, warc
from tabsmith.llm.common import scratch
from tests.conftest import SF_SMALL

PAGES = "page_id long, url string, html string"


def _records(rows):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[sha(h)] = min(first.get(sha(h), p), p)
    out = []
    for p, _, h in rows:
        again = sha(h) in first and p != first[sha(h)]
        out.append((str(p), len((h or "").encode()), sha(h), "revisit" if again else "response", first[sha(h)] if again else None))
    return sorted(out, key=str)


def test_warc_round_trip_with_magic_inside_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, None), (4, "", ""), (5, "u", "é" * 60), (6, "u", "é" * 60),
            (7, "u\r\nContent-Length: 3", fake), (8, "é", "before " + fake + fake + " after WARC/1.0\r\n"), (9, "u", "WARC/1.0\r\n"), (10, "u", "\r\n\r\n" * 50),
            (10, "u", "\r\n\r\n" * 50), (None, "u", "x" * 200), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "u", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n" + "z" * 300),
            (14, "u", "q" * 400_000 + fake + "r" * 300_000),
            *((20 + i, f"http://a/{c}Content-Length: 3{c}WARC-Type: revisit", "w" * 200 + str(i)) for i, c in enumerate("\u0085\u2028\u2029\x0b\x0c"))]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"first": F.lit("clash"), "digest": F.lit(1), "value": F.lit(2)}).repartition(3)
    for block in ("1m", "100k"):  # a file is one split, or several that cut records
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            path = scratch(spark, "warc-test")
            warc.write_archives(pages, path)
            got = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_records(spark, path).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == _records(rows)


def test_warc_empty_table_and_broken_archive(spark):
    path = scratch(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.page_records(spark, path).count() == 0
    path = scratch(spark, "warc-cut")
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    cut = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length: 50\r\n\r\nabc"
    spark.createDataFrame([(good + good + cut,)], "value string").coalesce(1).write.option("lineSep", " ").text(path)
    assert [r["id"] for r in warc.read_archives(spark, path).collect()] == ["<urn:page:1>"] * 2


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_positions_are_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        at = html_text.common_positions(a, b)
        assert len(at) == _lcs(a, b) and at == sorted(set(at))
        rest = iter(b)
        assert all(x in rest for x in (a[i] for i in at))


PAGE = ('<html><head><title>t</title><style>p{}</style></head><body class="with-sidebar"><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>'
        '<div class="ad">buy %d</div><div id="cookie-notice">cookies</div><aside>side</aside>%s<form><input>send</form><div class="comments"><p>nice</p></div>'
        '<script>var a = "</p><article>";</script><footer>&copy; x</footer>')


def test_main_text_of_articles():
    body = "<article><h1>A  &amp;\n B</h1><!-- <p>no</p> --><p>one<b> two</b> three<p>four &lt;x&gt; &eacute;&#8364;<ul><li>i<li>j</ul><div class=ad>x</div><p hidden>y</article>"
    blocks = html_text.text_blocks(PAGE % (1, body))
    assert html_text.main_blocks(blocks, list(range(len(blocks)))) == ["A & B", "one two three", "four <x> é€", "i", "j"]
    assert html_text.main_blocks(html_text.text_blocks(""), []) == []
    assert html_text.main_blocks(html_text.text_blocks("plain < text & more"), []) == ["plain < text & more"]
    assert html_text.main_blocks(html_text.text_blocks("<p>cut <b>off <a href='x"), [])[0].startswith("cut off")


def test_main_text_by_differencing(spark):
    plain = "<div>Welcome to the site</div><div><p>own %d text</p><p>second %d</p></div><div>All rights</div>"
    rows = [(i, f"http://h.org/a/{i}", PAGE % (i, plain % (i, i))) for i in range(40)]
    rows += [(50, "http://alone.org/x", "<p>Welcome to the site</p>"), (51, None, None), (52, "http://h.org/z", ""), (53, "no url", "<p>" + "w " * 300_000),
             (54, "http://c.org/1", "<p>same</p>"), (55, "http://c.org/2", "<p>same</p>"), (54, "http://c.org/1", "<p>same</p>"), (None, "http://n.org", "<p>n</p>")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("clash"), "shared": F.lit(1), "host": F.lit(2)})
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect())
    want = [(str(i), f"own {i} text\nsecond {i}") for i in range(40)]
    want += [("50", "Welcome to the site"), ("51", ""), ("52", ""), ("53", ("w " * 300_000).strip()), ("54", "same"), ("54", "same"), ("55", "same"), ("None", "n")]
    assert got == sorted((p, t, len(t)) for p, t in want)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_pairs_do_not_depend_on_borders(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    results = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            results.append(sorted((r["id"], r["shared"]) for r in html_text.shared_blocks(pages).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1] and any(s for _, s in results[0])


def test_token_counts_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "tokens \u0000\u0001 <|endoftext|> é 日本"), (9003, "x"), (None, "a b"), (9004, "long " * 200_000)], DOCS)
    path = scratch(spark, "token-docs")
    docs.unionByName(extra).withColumns({"file": F.lit("clash"), "place": F.lit(1), "row": F.lit(2)}).repartition(3).write.parquet(path)
    stored = spark.read.parquet(path)
    encode = token_scan.encoder(token_scan.TOKENIZER).encode_ordinary
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or ""))) for r in stored.collect())
    out = token_scan.token_counts(stored)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out.collect()) == want
    assert token_scan.token_counts(spark.read.schema(DOCS).parquet(path).limit(0)).count() == 0


DOCS = "doc_id long, text string"


def test_separator_scan_over_small_blocks(spark):
    rng = np.random.default_rng(4)
    path, want = scratch(spark, "flat"), []
    for f in range(4):
        ids = rng.integers(0, 9, 500).astype("<u2")
        ids[rng.integers(0, 500, 20)] = 0
        if f == 1:
            ids[100:] = 5  # a document that spans many blocks and doesn't end
        if f == 2:
            ids[:] = 0
        token = ids.tobytes()
        spark.createDataFrame([(bytearray(token),)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.mode("append").option("lineSep", "\u0001\u0000\u0000\u0000").text(path)
        all_ids = [*ids.tolist(), 1, 0]
        start, number = 0, 0
        for i, x in enumerate(all_ids):
            if x == 0:
                want.append((number, start, i - start, True))
                start, number = i + 1, number + 1
    blocks = token_scan.scan_blocks(spark, path, block=16)
    got = sorted((r["number"], r["start"], r["n_tokens"], r["ended"]) for r in token_scan.documents_of(blocks).collect())
    assert got == sorted(want)


def test_unfinished_document_at_the_end(spark):
    blocks = spark.createDataFrame([("f", 0, 4, [1]), ("f", 1, 4, []), ("f", 2, 2, []), ("g", 0, 3, [2])], "file string, block long, n long, ends array<long>")
    got = sorted((r["file"], r["number"], r["start"], r["n_tokens"], r["ended"]) for r in token_scan.documents_of(blocks).collect())
    assert got == [("f", 0, 0, 1, True), ("f", 1, 2, 8, False), ("g", 0, 0, 2, True)]
