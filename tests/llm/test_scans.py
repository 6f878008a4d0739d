"""Token counts, media, decontamination and page text: operators of one scan."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from tidewater.llm import decontaminate, media, pages, tokens
from tidewater.llm.queries import tokenizer_path


def test_token_counts_equal_the_library(spark, awkward, empty):
    tokenizers = pytest.importorskip("tokenizers")
    try:
        path = tokenizer_path()
    except ImportError:
        pytest.skip("no vocabulary files")
    encoder = tokenizers.Tokenizer.from_file(path)
    extra = ["tabs\t\tand   runs \n\n of  space ", "it's we'll I'd", "x\u00a0y\u2003z", "١٢٣ ½ Ⅷ", "emoji 👩‍👩‍👧 e\u0301", " \x1c\x1f lead", "汉字かな", "<|endoftext|>"]
    df = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(encoder.encode(r["text"] or "", add_special_tokens=False))) for r in df.collect())
    got = tokens.count_tokens(df, path, limit=100)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.collect())
    assert tokens.count_tokens(awkward, path).count() == awkward.count()
    assert tokens.count_tokens(empty, path).count() == 0


def test_other_vocabularies_are_refused():
    try:
        path = tokenizer_path("word_bpe_49k.json")
    except ImportError:
        pytest.skip("no vocabulary files")
    with pytest.raises(ValueError, match="byte-level"):
        tokens._load(path)


def test_streams_round_trip(awkward, empty):
    want = {hashlib.sha256(media.pad((r["text"] or "").encode())).hexdigest() for r in awkward.collect()}
    rows = media.read_media(media.to_media(awkward)).collect()
    assert len(rows) == awkward.count() and {r["payload_sha256"] for r in rows} == want
    assert all(r["n_gaps"] == 0 and r["payload_bytes"] % media.ALIGN == 0 and r["payload_bytes"] > 0 for r in rows)
    assert media.read_media(media.to_media(empty)).count() == 0
    one = {}
    for r in rows:
        one.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["tail_crc32"], r["media_bytes"]))
    assert all(len(v) == 1 for v in one.values())


@pytest.mark.parametrize("size", [1, 175, 176, 177, 183, 184, 359, 360, 361, 575, 576, 9215, 9216, 9217, 50_000, 200_000])
def test_any_payload_size(size):
    payload = random.Random(size).randbytes(size)
    stream = media.demux(out := media.mux(payload))
    assert len(out) % media.PACKET == 0 and stream.payload(media.DATA_PID) == payload and stream.gaps == stream.bad_tables == 0
    assert [u[1] for u in stream.units] == [i * media.TICKS for i in range(-(-size // media.UNIT))]
    assert [u[2] for u in stream.units] == [i % media.GOP == 0 for i in range(len(stream.units))]


def test_damaged_streams_are_counted():
    out = media.mux(bytes(range(256)) * 200)
    parts = [out[i : i + media.PACKET] for i in range(0, len(out), media.PACKET)]
    assert media.demux(b"".join(parts[:5] + parts[6:])).gaps == 1
    assert media.demux(b"".join(parts[:5] + parts[4:5] + parts[5:])).repeats == 1
    assert media.demux(b"".join([parts[0][:20] + b"\0" + parts[0][21:], *parts[1:]])).bad_tables == 1
    assert media.demux(b"junk" * 100).units == []
    assert zlib.crc32(b"") == 0 and media.crc32_mpeg(b"123456789") == 0x0376E6E7


def packet(pid, counter, body, start=False, adaptation=b""):
    field = bytes([len(adaptation)]) + adaptation if adaptation else b""
    room = 184 - len(field)
    assert len(body) <= room
    if len(body) < room:  # stuffing in the adaptation field
        short = room - len(body)
        field = (bytes([field[0] + short]) + field[1:] + b"\xff" * short) if field else (b"\0" if short == 1 else bytes([short - 1, 0]) + b"\xff" * (short - 2))
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | counter & 15]) + field + body


def section(table, body):
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0" + body
    return head + media.crc32_mpeg(head).to_bytes(4, "big")


def test_foreign_streams():
    """Tables over several packets, two sections in one, other PIDs, a lost byte, repeated packets."""
    pat = section(0, b"\0\0\xe0\x10" + b"\0\7\xe1\x23")
    pmt = section(2, b"\xe2\0\xf0\0" + b"".join(bytes([6, 0xE2 + i // 256, i % 256, 0xF0, 2, 9, 9]) for i in range(60)))
    assert len(pmt) > 2 * 184
    other = section(0x42, b"private")
    parts = [packet(0, 0, b"\0" + pat, True), packet(0x123, 5, b"\0" + pmt[:183], True), packet(0x123, 6, pmt[183:367])]
    rest = pmt[367:]
    parts += [packet(0x123, 7, bytes([len(rest)]) + rest + other, True), packet(0x1FFF, 0, b"")]
    pes = lambda n, data: b"\0\0\1\xbd\0\0\x80\x80\5" + bytes([0x21 | n >> 29 & 14]) + (n >> 14 & 0xFFFE | 1).to_bytes(2, "big") + ((n & 0x7FFF) << 1 | 1).to_bytes(2, "big") + data
    parts += [packet(0x200, 0, pes(90_000, b"one"), True), packet(0x200, 1, b" more"), packet(0x200, 1, b" more"), packet(0x200, 2, pes(180_000, b"two"), True)]
    found = media.demux(b"".join(parts))
    assert found.programs == {7: 0x123} and len(found.types) == 60 and set(found.types.values()) == {6}
    assert [(u[0], u[1], u[3]) for u in found.units] == [(0x200, 90_000, b"one more"), (0x200, 180_000, b"two")]
    assert (found.repeats, found.gaps, found.bad_tables) == (1, 0, 0)
    lost = b"".join(parts[:5]) + b"\1\2\3" + b"".join(parts[5:])
    again = media.demux(lost)
    assert again.units == found.units and again.gaps == 1
    assert media.demux(b"".join(parts[:8] + parts[7:])).repeats == 1 and media.demux(b"".join(parts[:8] + [parts[7], *parts[7:]])).gaps >= 1
    cut = media.demux(b"".join([parts[0], parts[1], parts[2], packet(0x123, 7, b"\0" + other, True)]))
    assert cut.bad_tables == 1 and not cut.types


def test_contamination_equals_brute_force(spark, awkward, empty):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 30, 10, 9, 3, 1))] + [(None, "an item without an id"), (6, None), (7, " ,.! "), (8, "the1 the1 the1 the1 the1 the1 the1 the1 the1 the1 the1 the1")]
    docs = [(i, prose(rng, 300)) for i in range(20)] + [(20, None), (21, ""), (22, "the1 " * 40), (23, items[0][1].upper()), (24, "x " + items[1][1] + " y " + items[4][1]), (25, items[2][1].replace(" ", ", ")), (26, "an id item x without an"), (27, " ".join(reversed(items[0][1].split())))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(docs, items))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "near_items"]
    assert any(w[6] for w in want)
    got = decontaminate.digest(decontaminate.find_contamination(df, bench))
    assert sorted(map(tuple, got.select(columns).collect())) == want
    sliced = decontaminate.digest(decontaminate.find_contamination(df, bench, slice_bytes=200))
    assert sorted(map(tuple, sliced.select(columns).collect())) == want
    kept = {r["doc_id"] for r in decontaminate.keep_clean(df, bench, slice_bytes=200).collect()}
    assert kept == {w[0] for w in want if not w[5]}
    assert decontaminate.find_contamination(awkward, bench).count() == awkward.count()
    assert decontaminate.keep_clean(awkward, bench).columns == awkward.columns
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(df, bench.limit(0)).where("size(items) > 0").count() == 0


def test_sliced_contamination_keeps_rows(spark, awkward):
    rng = random.Random(8)
    items = [(i, prose(rng, 12)) for i in range(6)]
    docs = [(1, "x " + items[0][1]), (1, "clean words"), (1, "x " + items[0][1]), (None, items[1][1] + " " + items[2][1]), (None, "other clean words here"), (2, None), (2, None), (2, ""), (3, prose(rng, 40))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    sliced = decontaminate.digest(decontaminate.find_contamination(df, bench, slice_bytes=100))
    assert key(sliced.collect()) == key(decontaminate.brute_force(docs, items))
    whole, parts = (decontaminate.digest(decontaminate.find_contamination(awkward, bench, slice_bytes=n)).collect() for n in (32 << 20, 100))
    assert key(whole) == key(parts) and len(parts) == awkward.count()
    assert decontaminate.keep_clean(awkward, bench, slice_bytes=100).count() == awkward.count()


def test_proximity_finds_shuffled_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, " ".join(reversed(item.split()))), (2, item), (3, "alpha and many other words " * 30), (4, "alpha " + "x " * 40 + "beta " + "x " * 40 + "gamma delta")]
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: (r["items"], r["near_items"]) for r in found.collect()} == {1: ([], ["1"]), 2: (["1"], []), 3: ([], []), 4: ([], [])}


def test_index_keeps_every_posting():
    raw = ["The end. The, the END!", None, "", "é è 5a", "x " * 4000]
    shard = decontaminate.Shard.of(pa.array(raw))
    again = decontaminate.Shard.unpacked(shard.n_words, *shard.packed())
    cut = np.cumsum(again.counts)
    found = {(w, int(d), int(p - again.first[d])) for w, a, b in zip(again.terms, cut - again.counts, cut) for p in again.postings[a:b] for d in [again.document(p)]}
    assert found == {(w, d, i) for d, text in enumerate(raw) for i, w in enumerate(decontaminate.words(text))}
    assert len(decontaminate.Shard.of(pa.array([None], pa.string())).postings) == 0


def test_one_index_serves_several_searches(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "e d c b a")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    for text, hits in (("a b c", {1}), ("c b", {2}), ("x", set())):
        found = decontaminate.search(index, spark.createDataFrame([(1, text)], "item_id long, text string"))
        assert {r["doc_id"] for r in found.where("size(items) > 0").collect()} == hits and found.count() == 2


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>one  <b>bold</b>&nbsp;text<br>next<p>two</article><aside>side</aside><div id=comments><p>hi</div><footer>&copy;</footer><script>var x='</p>'</script></body></html>"


def test_main_text():
    assert pages.text_of(PAGE) == "Head & line\none bold text next\ntwo"
    assert pages.text_of("<p>a &lt; b<li>c<li>d<table><tr><td>e<td>f</table> 3 < 4") == "a < b\nc\nd\ne\nf\n3 < 4"
    assert pages.text_of("") == "" and pages.text_of("<!-- a") == "" and pages.text_of("x <!-- a --> y <b") == "x y <b"
    assert pages.text_of("<div" + " x" * 10).startswith("<div")
    assert pages.text_of("<div>" * 5000 + "deep") == "deep"
    assert pages.text_of("""<p title="a > b" id='c > d'>e</p><p title="x>f</p>""") == "e\nf"


@pytest.mark.parametrize("part", ["<a ", "< ", "<a \"", "<a '\">", "<span><hr>", "<div></p>", "<b></i><div></b>", "<li><tr><td>", "<script ", "<!-", "<!--"])
def test_long_malformed_pages_take_time_in_proportion(part):
    began = time.process_time()
    pages.text_of(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 20
    for n in (30_000, 30_001):
        pages.text_of("<div>" * n + "</table>" * n + part * 9 + ">")


def test_wrappers_keep_their_story():
    story = "<h1>News</h1><p>A long story that goes on and on.</p>"
    for marks in ('id="content" class="no-sidebar"', 'class="page-with-header"', 'class="share-price-analysis"'):
        assert pages.text_of(f"<body><div {marks}>{story}</div></body>").startswith("News\n")
    assert pages.text_of(f"<div class=widget><article>{story}</article></div><div class=comments>more than the story has {'x' * 400}</div>").startswith("News\n")
    assert pages.text_of(f"{story}<div class='comments'>{'more than the story ' * 40}</div>") == "News\nA long story that goes on and on."
    assert pages.text_of(f"{story}<div class='cookie'>we use them</div>") == "News\nA long story that goes on and on."


def plain_texts(rows, share=0.5, at_least=10):
    """Templates counted in dictionaries."""
    seen, copies = {}, {}
    for _, url, html in rows:
        host, own = (url or "").partition("://")[2].split("/")[0].lower(), set()
        page = pages.hashed(pages.parse(html or ""), own)
        if host and page not in copies.setdefault(host, set()):
            copies[host].add(page)
            for h in own:
                seen[host, h] = seen.get((host, h), 0) + 1
    out = {}
    for i, url, html in rows:
        host = (url or "").partition("://")[2].split("/")[0].lower()
        found = frozenset(h for (where, h), n in seen.items() if where == host and n >= at_least and n >= share * len(copies[host]))
        out[i] = pages.text_of(html or "", found)
    return out


def test_templates_equal_a_plain_count(spark):
    """Without an article element, what goes are recurring subtrees and shapes."""
    rows = []
    for i in range(60):
        site = i % 3
        notice = f"<div class='site-notice n{site}'>Number {i} of today</div>" if i % 2 or site else ""
        rows.append((i, f"http://s{site}.example.org/{i}", f"<div class='top bar{site}'>Site {site}<p>All of it</p></div>{notice}<p>Story {i} {'la ' * (i % 7)}</p><div>Part {i % 4}</div>"))
    rows += [(100, None, "<div class='top bar1'>Site 1</div>"), (101, "http://s1.example.org/x", None)]
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_texts(rows)
    assert got[1] == "Story 1 la\nPart 1" and got[101] == ""


def test_templates_of_a_host_are_removed(spark):
    body = "<article><div>Read our other stories</div><p>story {}</p></article>"
    rows = [(i, "https://Site.example.org/x", body.format(i)) for i in range(20)] + [(50 + i, f"https://h{i}.example.org/", body.format(i)) for i in range(3)] + [(90, None, body.format(90)), (91, "https://site.example.org/y", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(df).collect()}
    assert got[3] == "story 3" and got[51] == "Read our other stories\nstory 1" and got[90] == "Read our other stories\nstory 90" and got[91] == ""
    clash = df.selectExpr("*", "'x' AS host", "'y' AS text", "1 AS n_chars", "2 AS templates")
    assert pages.extract_main_text(clash).count() == len(rows)
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_make_no_template(spark):
    body = "<nav>menu</nav><article><div>Read our other stories</div><p>story {}</p><a href='{}'>on</a></article>"
    rows = [(i, f"https://site.example.org/{i}", body.format("told often", i)) for i in range(30)] + [(100 + i, "https://site.example.org/x", body.format(i, i)) for i in range(15)]
    # All pages of the second host share a whole article or main element.
    rows += [(200 + 20 * k + i, "https://same.example.org/x", f"<p>{i}</p>{tag}the one text{end}") for k, (tag, end) in enumerate((("<article>", "</article>"), ("<div role=main>", "</div>"))) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(30)} == {"story told often"} and got[103] == "story 3"
    assert {got[200 + i] for i in range(40)} == {"the one text"}


def test_queries_cover_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from tidewater.llm.queries import QUERIES

    for name, query in QUERIES.items():
        table = "pages" if name.startswith(("op1_", "op5_")) else "documents"
        rows, source = query(spark, sf), spark.read.parquet(f"{sf}/{table}.parquet")
        if name.startswith("op11_"):  # a row a piece: every document has its first one, and once
            rows = rows.where("piece = 0")
        elif name.startswith("op12_"):  # a row an item: every group with another source in its language
            rows, source = rows.where("part = 'pair'").select("lang", "source").distinct(), source.select("lang", "source").distinct()
            alone = source.groupBy("lang").count().where("count = 1")
            source = source.join(alone, "lang", "left_anti")
        assert rows.count() == source.count(), name


def test_queries_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    import duckdb

    from tests.test_oracles import rows
    from tidewater.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(sql).df()), name
