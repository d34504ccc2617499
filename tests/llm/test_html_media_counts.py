import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import gif, html, media, tokencounts
from tidemark.llm.runtime import shared_dir

LONG = "This paragraph of the article has quite a number of words, and it goes on until the window has surged above the bound."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


CASES = [
    (page(f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A  title\n</h1><p>{LONG}</p><p>Short.</p></article><footer>(c)</footer>"), f"A title\n{LONG}\nShort."),
    (page(f"<div class='menu main-menu'>Home | About</div><div id=content><h2>Head</h2><p>{LONG}<p>{LONG} &amp; &eacute;&#8217;&#x41;</div><div class=comments><p>{LONG}</p></div>"), f"Head\n{LONG}\n{LONG} & é’A"),
    (page(f"<header><h1>Site name</h1></header><main><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}<input></form></main>"), f"T\n{LONG}"),
    (page(f"<script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p {{}}</style><!-- <p>{LONG}</p> --><p>{LONG}</p>", "<script>var t=\"</p>\";</script>"), LONG),
    (page(f"<div class='cookie-notice'><p>{LONG}</p></div><p>{LONG}</p><div style='display: none'>{LONG}</div><div class=\"ad\">{LONG}</div>"), LONG),
    (page("<article><p>Tiny.</p></article>"), "Tiny."),
    (page("<article><p><b>Never closed.<br><p>Next one</p></article><footer>no</footer>"), "Never closed.\nNext one"),
    (page(f"<article><p>a&nbsp;b\tc<br>d</p><ul><li>one</li><li>two</li></ul><table><tr><td>x</td><td>y</td></tr></table><p>{LONG}</p></article>"), f"a b c d\none\ntwo\nx\ny\n{LONG}"),
    (page("<p>About</p>"), ""), ("", ""), (None, ""), ("<", ""), ("plain text that is long enough to be the main text of a page without any markup at all", "plain text that is long enough to be the main text of a page without any markup at all"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_main_text(i):
    assert html.main_text(CASES[i][0]) == CASES[i][1]


MARKED = [
    # a teaser or a card in an article element doesn't hide the main text, and is a line like others
    (page(f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><p><a href='#'>x</a></p><p><a href='#'>y</a></p><p><a href='#'>z</a></p><article><p>Read on.</p></article>"), f"Title\n{LONG}\n{LONG}"),
    (page(f"<article><p>Card.</p></article><div><p>{LONG}</p></div>"), f"Card.\n{LONG}"),
    # without such elements, and with the main text in them
    (page(f"<div><p>{LONG}</p><p>Short.</p></div><div><p>{LONG}</p></div>"), f"{LONG}\nShort.\n{LONG}"),
    (page(f"<div>{LONG}</div><article><p>{LONG}</p><p>Short.</p></article>"), f"{LONG}\nShort."),
]


@pytest.mark.parametrize("i", range(len(MARKED)))
def test_article_elements_are_weighed(i):
    assert html.main_text(MARKED[i][0]) == MARKED[i][1]


def test_links_and_short_openings_of_the_text_stay():
    assert html.main_text(page(f"<article><p>{LONG}</p><ul><li><a href='a'>A reference</a></li></ul><p><a href='b'>Mostly a</a> link</p></article>")) == f"{LONG}\nA reference\nMostly a link"
    assert html.main_text(page(f"<p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p><p>{LONG}</p>")) == f"One.\nTwo.\nThree.\nFour.\n{LONG}"
    assert html.kept([9, 0, 0, 0, 8, 0, 0, 7, 1, 2, 3, 70, 0]) == [False] * 4 + [True] + [False] * 2 + [True] * 5 + [False]
    assert html.kept([70, 0, 0, 0, 5, 5, 5, 70]) == [True, False, False, False, True, True, True, True]


def test_names_of_paragraphs_in_the_article_and_slashes():
    assert html.main_text(page(f"<article><p class='search-results tags'>{LONG}</p><p class=notice-board>B</p><div class=comments><p>c</p></div><p class='text ad'>x</p></article>")) == f"{LONG}\nB"
    assert html.main_text(page(f"<article><script src=/a/>var t=1;</script><p>{LONG}</p><a name=x/>y</a><br/>z<img src=/b/ /></article>")) == f"{LONG}\ny z"
    assert html.main_text(page(f"<script src='a'/>var t = 1;</script><p>{LONG}</p>")) == LONG
    assert html.main_text(page(f"<iframe src='a' /><svg width=1 /><p>{LONG}</p>")) == LONG


@pytest.mark.parametrize("shape", ["<div>{}</div>", "<nav>{}</nav>", "<div class=menu>{}</div>", "<article>{}</article>"])
def test_deep_nesting_takes_linear_time(shape):
    import time

    def took(n):
        start, end = shape.split("{}")
        began = time.perf_counter()
        html.main_text(start * n + f"<p>{LONG}</p>" + "<b>" * n + "x" + "</b>" * n + "</i>" * n + end * n)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.05)


def plain_kept(lengths):
    """Surge and dive as the docstring of `kept` puts it, line by line."""
    n, w = len(lengths), html.WINDOW
    sums = [sum(lengths[i : i + w]) for i in range(n)]
    out = set()
    for s in range(n):
        if lengths[s] and sums[s] > html.SURGE:
            dive = next((i for i in range(s, n) if sums[i] == 0), n)
            start = next((i for i in range(s - 1, -1, -1) if sum(lengths[max(0, i - w + 1) : i + 1]) == 0), -1)
            out |= {i for i in range(start + 1, dive) if lengths[i]}
    return [i in out for i in range(n)]


def test_windows_equal_brute_force():
    draw = random.Random(3)
    for _ in range(3000):
        lengths = [draw.choice((0, 0, 0, 1, 9, 25, 61, 200)) for _ in range(draw.randrange(0, 30))]
        assert html.kept(lengths) == plain_kept(lengths), lengths


def test_lines_hold_what_another_parser_finds(spark, small):
    """The texts of all pages, against the words that the standard library's parser finds in article elements."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        depth = off = 0

        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.off += tag in ("script", "style", "aside", "form", "nav", "footer")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.off -= tag in ("script", "style", "aside", "form", "nav", "footer")

        def handle_data(self, data):
            if self.depth > 0 and not self.off:
                self.found += data.split()

    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    same = 0
    for r in rows:
        words = Words()
        words.feed(r.html or "")
        got = html.main_text(r.html).split()
        assert not got or set(got) <= set("".join(words.found)) | set(words.found) or len(set(got) - set(words.found)) <= 3
        same += got == words.found
    assert rows and same >= 0.5 * len(rows)


def test_surge_and_dive():
    assert html.kept([0, 10, 10, 0, 0, 0, 50, 40, 0, 5, 0, 0, 0, 9]) == [False] * 5 + [False, True, True, False, True, False, False, False, False]
    assert html.kept([]) == [] and html.kept([61]) == [True] and html.kept([60]) == [False]


def test_pages_table(spark):
    rows = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[0][0])], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html.extract(rows).collect()
    assert len(got) == len(CASES) + 1 and all(r.text == CASES[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert html.extract(rows.where("false")).isEmpty()


def payloads():
    draw = np.random.default_rng(0)
    yield from (b"", b"a", bytes(64), b"ab" * 40_000, bytes(draw.integers(0, 256, 30_000, dtype=np.uint8)), bytes(draw.integers(97, 100, 200_000, dtype=np.uint8)))
    for n in (3836, 3837, 3838, 3839, 3840, 4096):
        yield bytes(draw.integers(0, 256, n, dtype=np.uint8))


@pytest.mark.parametrize("data", list(payloads()), ids=len)
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_of_other_encoders():
    # the picture of 10 by 10 that introductions to the format show, with a minimum code size of 2
    stream = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C0491 4C01".replace(" ", ""))
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert gif.lzw_decode(stream, 2, 100) == bytes(int(c) for r in rows for c in r)
    assert gif.lzw_decode(stream[:5], 2, 100) == gif.lzw_decode(stream, 2, 100)[: len(gif.lzw_decode(stream[:5], 2, 100))]
    assert gif.lzw_decode(b"", 2, 5) == b"" and gif.lzw_decode(b"\xff\xff\xff", 2, 5) is not None


def codes(samples, least=2):
    """An LZW stream without a dictionary: a clear code before each sample."""
    clear, bits, width = 1 << least, "", least + 1
    for v in [x for s in samples for x in (clear, s)] + [clear + 1]:
        bits = format(v, f"0{width}b") + bits
    n = -(-len(bits) // 8)
    return int(bits, 2).to_bytes(n, "little")


def test_disposal_transparency_and_palettes():
    red, blue, green = (255, 0, 0), (0, 0, 255), (0, 255, 0)
    word = lambda v: v.to_bytes(2, "little")
    table = bytes(c for x in (red, blue, green, (0, 0, 0)) for c in x)

    def frame(x, y, w, h, samples, disposal, transparent=None, own=None, interlace=False):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + word(5) + bytes([transparent or 0, 0])
        stream = codes(samples)
        flags = (0x81 if own else 0) | (0x40 if interlace else 0)
        return control + b"\x2c" + word(x) + word(y) + word(w) + word(h) + bytes([flags]) + (own or b"") + b"\x02" + bytes([len(stream)]) + stream + b"\0"

    data = b"GIF89a" + word(2) + word(2) + b"\x81\0\0" + table + b"\x21\xfe\x02hi\0"
    data += frame(0, 0, 2, 2, [0, 0, 0, 0], 1) + frame(0, 0, 1, 1, [1], 3) + frame(1, 0, 1, 2, [2, 3], 2, transparent=3) + frame(0, 0, 1, 1, [0], 0, own=bytes(blue) * 4) + frame(0, 0, 1, 2, [1, 2], 0, interlace=True) + b"\x3b"
    found = gif.decode(data)
    shown = [[[tuple(int(v) for v in p) for p in row] for row in f.shown] for f in found]
    r, b, g, none = (*red, 255), (*blue, 255), (*green, 255), (0, 0, 0, 0)
    assert shown[0] == [[r, r], [r, r]]
    assert shown[1] == [[b, r], [r, r]]
    assert shown[2] == [[r, g], [r, r]]  # the blue pixel is gone again; sample 3 is transparent
    assert shown[3] == [[b, none], [r, none]]  # the area of the frame before was cleared, then the frame's own palette
    assert shown[4] == [[b, none], [g, none]]
    assert [f.delay for f in found] == [5] * 5
    assert gif.decode(data[: len(data) - 12])[0].samples.tolist() == [[0, 0], [0, 0]]
    with pytest.raises(ValueError, match="GIF"):
        gif.decode(b"no")


def test_memory_follows_the_file_not_its_header(spark):
    word = lambda v: v.to_bytes(2, "little")
    screen = b"GIF89a" + word(65535) + word(65535) + b"\0\0\0;"
    frame = b"GIF89a" + word(4) + word(4) + b"\0\0\0" + b"\x2c\0\0\0\0" + word(65535) + word(65535) + b"\0\x02\x02\x44\x01\0;"
    rows = spark.createDataFrame([(1, bytearray(screen)), (2, bytearray(frame))], "media_id long, media binary")
    assert media.frames(rows).isEmpty() and gif.decode(frame) == []
    # a run of one colour is what fills most: it is taken at its full size
    one = gif.encode(bytes(64 * 60_000), rows=60_000)
    assert gif.decode(one)[0].samples.shape == (60_000, 64)


def test_stored_frames_are_shown_as_another_decoder_would():
    """Frames of a stored payload composed by hand: grey levels, later frames over earlier ones."""
    payload = bytes(range(64)) * 3 + bytes(range(128, 192)) * 2
    (one, two), samples = zip(*media.timed(gif.encode(payload, rows=3)), strict=True)
    assert b"".join(samples) == payload and (one["starts_ms"], two["starts_ms"]) == (0, 100)
    level = lambda v: 21 * (v >> 6)
    first = [level(v) for v in payload[:192]]
    second = [level(v) for v in payload[192:] + payload[128:192]]
    assert one["histogram"] == [first.count(i) for i in range(64)] and two["histogram"] == [second.count(i) for i in range(64)]


def plain_lzw(stream, least):
    """A decoder after the format's description, code by code."""
    bits = int.from_bytes(stream, "little")
    clear, width, at, table, out, last = 1 << least, least + 1, 0, [], b"", None
    while at + width <= 8 * len(stream):
        code = bits >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = [bytes((i,)) for i in range(clear)] + [b"", b""], least + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry
    return out


@pytest.mark.parametrize("data", [b"", b"a" * 5000, bytes(range(256)) * 12, ("the cat sat on the mat " * 300).encode()], ids=len)
def test_streams_are_read_by_a_plain_decoder(data):
    assert plain_lzw(gif.lzw_encode(data), 8) == data


def test_frames_table(spark):
    one = gif.encode(bytes(range(64)) * 3, rows=2, delay=7)
    rows = spark.createDataFrame([(1, bytearray(one)), (2, None), (3, bytearray(b"")), (4, bytearray(b"junk"))], "media_id long, media binary")
    got = media.frames(rows).orderBy("frame").collect()
    assert [(r.media_id, r.frame, r.starts_ms, r.delay_ms, r.height) for r in got] == [(1, 0, 0, 70, 2), (1, 1, 70, 70, 1)]
    assert sum(got[0].histogram) == 64 * 2 and media.frames(rows.where("false")).isEmpty()


def test_payloads_round_trip(spark, edge, nothing):
    rows = media.round_trip(edge).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    assert len(rows) == edge.count()
    for r in rows:
        data = texts[r.doc_id].encode()
        data += bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.encode(data)).hexdigest() and r.media_bytes == len(gif.encode(data))
    assert next(r for r in rows if r.doc_id == 7).feature.startswith("frames=2;") and media.round_trip(nothing).isEmpty()


WORDS = {"w1": (None, r"\S+")}


def totals(ledger):
    return sorted((tuple(r) for r in ledger.totals().collect()), key=repr)


def test_deltas_equal_a_recount(spark, tmp_path, edge, nothing):
    draw = random.Random(0)
    docs = {i: (i, " ".join("w" for _ in range(draw.randrange(9))), draw.choice(("en", None)), draw.choice("ab")) for i in range(80)}
    frame = lambda rows: tokencounts.counted(spark.createDataFrame(list(rows), "doc_id long, text string, lang string, source string"), WORDS)
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert totals(ledger) == []
    assert ledger.apply("load", tokencounts.deltas(inserted=frame(docs.values())))
    gone, changed = [docs[i] for i in range(10)], [docs[i] for i in range(10, 30)]
    new = [(i, t + " more", g, "c") for i, t, g, s in changed]
    batch = tokencounts.deltas(deleted=frame(gone), revised=(frame(changed), frame(new)))
    assert ledger.apply("2", batch) and not ledger.apply("2", batch) and not ledger.apply("load", batch)
    left = [d for d in docs.values() if d[0] >= 30] + new
    other = tokencounts.Ledger(spark, f"file://{tmp_path}/other")
    other.apply("all", tokencounts.deltas(inserted=frame(left)))
    assert totals(ledger) == totals(other) and sum(r[3] for r in totals(ledger)) == 70
    ledger.apply("none left", tokencounts.deltas(deleted=frame(left)))
    assert totals(ledger) == []
    # a run that died before its rename has left a folder that doesn't count
    other._fs.mkdirs(other._path(f"file://{tmp_path}/other/tries/dead"))
    assert totals(other)
    counts = tokencounts.counted(edge, WORDS)
    assert counts.count() == edge.count() and tokencounts.counted(nothing, WORDS).isEmpty()


def test_folds_keep_totals(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, tokencounts.ROWS)
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert not ledger.fold()
    a, b = frame([(1, "s", None, "v", 10, 40), (2, "s", "en", "v", 5, 20)]), frame([(3, None, "en", "v", 7, 9)])
    ledger.apply("a", tokencounts.deltas(inserted=a))
    assert ledger.fold() and not ledger.fold()
    ledger.apply("b", tokencounts.deltas(inserted=b, deleted=frame([(2, "s", "en", "v", 5, 20)])))
    expected = [("s", None, "v", 1, 10, 40), (None, "en", "v", 1, 7, 9)]
    assert totals(ledger) == sorted(expected, key=repr)
    assert ledger.fold() and totals(ledger) == sorted(expected, key=repr)
    # the first batch's data is gone, its name still counts
    assert not any(s.getPath().getName().endswith(".parquet") for s in ledger._fs.listStatus(ledger._path(ledger._folder("a"))))
    assert not ledger.apply("a", tokencounts.deltas(inserted=a)) and not ledger.apply("b", tokencounts.deltas(inserted=b))
    ledger.apply("c", tokencounts.deltas(revised=(b, frame([(3, None, "en", "v", 8, 9)]))))
    assert tokencounts.Ledger(spark, f"file://{tmp_path}/ledger").totals().where("tokens = 8").count() == 1
    # what a lost race leaves inside a batch's folder is not read
    ledger._fs.mkdirs(ledger._path(f"{ledger._folder('c')}/stray"))
    b.select(*tokencounts.KEYS, "tokens", "chars").withColumn("docs", F.lit(1)).write.mode("overwrite").parquet(f"{ledger._folder('c')}/stray/x")
    assert ledger.totals().where("tokens = 8").count() == 1


def test_token_query_equals_a_plain_count(spark, small):
    import tiktoken

    from tidemark.llm import queries

    own = tiktoken.Encoding("plain", pat_str=queries.BYTE_BPE, mergeable_ranks=tokencounts.read_ranks(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    expected = {}
    for r in queries.table(spark, small, "documents").collect():
        text = r.text or ""
        plain = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ")
        for version, n in (("byte_bpe_50k", len(own.encode_ordinary(text))), ("words_1", sum(w != "" for w in plain))):
            sums = expected.setdefault((r.source, r.lang, version), [0, 0, 0])
            for i, v in enumerate((1, n, len(text))):
                sums[i] += v
    got = queries.op7_tokencounts(spark, small).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == expected and len(got) == len(expected)


def test_byte_pairs_equal_another_library(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import BYTE_BPE, TOKENIZERS

    plain = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    texts = ["Hello world, it's 2024!\n\n  été", "", "<|endoftext|> a", "x" * 2000, "  spaced   out \t"]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = tokencounts.counted(rows, {"v": (f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE)}).collect()
    assert {r.doc_id: r.tokens for r in got} == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
