"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

import base64
import gzip
import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from redactum.llm import (  # noqa: E402
    html_blocks, language, merge_dropout, order_minhash, orc_tokens, packing, repetition, topk, url_filter, warc)
from redactum.llm.common import fresh_path, prepare, table  # noqa: E402
from redactum.llm.tokens import Encoder, default_path  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (5, "a b c d e f"), (6, "a b c d e f"), (6, "a b c d e f"),
       (None, "x"), (8, "▁ é\x00 \U0001F600 <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "kept": F.lit(1), "key": F.lit("k"), "c": F.lit(0), "s": F.lit("s")})


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- top-k ---------------------------------------------------------------------

def brute_topk(vecs, k):
    out = Counter()
    for n, (qi, q) in enumerate(vecs):
        if qi % 2:
            continue
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), vi) for m, (vi, v) in enumerate(vecs)
                      if m != n and len(v) == len(q))[:k]
        out.update((qi, r + 1, vi, -s) for r, (s, vi) in enumerate(best))
    return out


def test_topk_equals_brute_force(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    vecs = [(i, [int(x) for x in rng.integers(-3, 4, 6 if i % 10 else 3)]) for i in range(300)]
    vecs += [(300, [0] * 6), (302, [])]
    data = [(i, [x / 1024 for x in v]) for i, v in vecs]
    data += [data[4], (400, None), (402, [None, 1.0]), (404, [float("nan")] * 6), (406, [float("inf")] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = rows(topk.top_k(spark, df, F.col("vec_id") % 2 == 0, 5))
    assert Counter(got) == brute_topk(vecs + [vecs[4]], 5)  # the repeated row is a row of its own
    pair = lambda *x: spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert rows(topk.top_k(spark, pair(2.0**30, 2.0**12), F.col("vec_id") == 0)) == [(0, 1, 1, 2**62)]
    for too_large in (pair(2.0**40, 2.0**12), pair(1e17, 1.0)):
        with pytest.raises(Exception, match="too large|OverflowError"):
            topk.top_k(spark, too_large, F.lit(True)).collect()
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(5000, 2)) * 1000
    v = v.astype(int).astype(float)
    order = np.argsort(v, axis=0, kind="stable")
    ids, scores, depth = topk.threshold_search(v, np.arange(5000), order, np.array([3.0, 2.0]), np.zeros(5000, bool), 10)
    assert depth < 2500
    assert sorted(scores, reverse=True) == sorted(v @ np.array([3.0, 2.0]), reverse=True)[:10]


# -- near duplicates -------------------------------------------------------------

def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_equals_full_table():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        a = list(rng.integers(0, rng.choice([2, 4]), rng.integers(0, 12)))
        b = list(rng.integers(0, 3, rng.integers(0, 12))) if rng.random() < 0.5 else a[rng.integers(0, 3):] + [1]
        most, true = int(rng.integers(0, 8)), edit(a, b)
        assert min(order_minhash.banded_distance(a, b, most), most + 1) == min(true, most + 1)


def test_classes_of_planted_copies(spark, odd):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [[word() for _ in range(80)] for _ in range(12)]
    docs, truth = [], {}
    for g, words in enumerate(base):
        for k in range(40 if g == 0 else 3):
            copy = list(words)
            if k:
                copy[int(rng.integers(0, 80))] = word()
            docs.append((100 * g + k, " ".join(copy)))
            truth[100 * g + k] = 100 * g
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark, df).collect()}
    assert got == truth
    r = Counter(rows(order_minhash.near_duplicates(spark, odd)))
    assert r == Counter({(1, 1, True): 1, (2, 2, True): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 5, True): 1,
                         (6, 5, False): 2, (None, None, True): 1, (8, 8, True): 1})
    one = order_minhash.deduplicated(spark, odd.union(odd))
    assert one.columns == odd.columns
    assert Counter(x.doc_id for x in one.collect()) == Counter({1: 2, 2: 2, 3: 2, 4: 1, 5: 1, None: 1, 8: 1})
    assert order_minhash.near_duplicates(spark, odd.limit(0)).count() == 0


def test_crowded_buckets_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    template, texts = [word() for _ in range(60)], []
    for _ in range(220):  # one template and 40 words of their own: not similar, but for every text's one copy
        own = [word() for _ in range(40)]
        copy = list(own)
        for at in rng.choice(40, 15, replace=False):
            copy[at] = word()
        texts += [template + own, template + copy]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sketches = [order_minhash.sketch(" ".join(w))[2] for w in texts]
    band_sizes = Counter((k, int(v)) for s in sketches for k, v in enumerate(s))
    assert max(band_sizes.values()) > 256
    parent = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (sketches[a] == sketches[b]).any() and order_minhash.similar_words(
                    [w.encode() for w in texts[a]], [w.encode() for w in texts[b]]):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if p == old else p for p in parent]
    assert 220 <= len(set(parent)) < 225
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark, docs).collect()}
    assert got == dict(enumerate(parent))


def test_crowded_search_aligns_few_pairs(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    common, base, crowded, texts = [word() for _ in range(400)], [word() for _ in range(100)], [], []
    for bucket in range(9):  # a passage in texts that are not similar; its words are in fewer texts than the common ones
        passage = [word() for _ in range(30)]
        for _ in range(40):
            crowded.append((bucket, len(texts), 100))
            texts.append(passage + list(rng.choice(common, 70, replace=False)))
    for k in range(60):  # copies that no link joins yet
        copy = list(base)
        copy[k] = word()
        crowded.append((9, len(texts), 100))
        texts.append(copy)
    aligned, verified = [], order_minhash.verified
    monkeypatch.setattr(order_minhash, "verified",
                        lambda pairs, *more: aligned.append(pairs.count()) or verified(pairs, *more))
    links = order_minhash.crowded_links(
        spark, spark.createDataFrame(crowded, "bucket long, c long, n_words int"), spark.createDataFrame([], "c long, label long"),
        spark.createDataFrame([(c, " ".join(w)) for c, w in enumerate(texts)], "c long, text string"), 0.8)
    got = dict(rows(order_minhash.components(spark, links)))
    assert got == {c: 360 for c in range(360, 420)}
    assert sum(aligned) <= 4 * len(texts)  # of 8790 pairs in buckets


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_similar_texts_share_the_needed_words(spark, least):
    prepare(spark)
    rng = np.random.default_rng(7)
    texts = []
    for n in [*range(1, 12), 20, 31, 32, 64, 150]:
        base = list(rng.choice(list("abcdefghijklmnop"), n))
        for _ in range(4):
            copy = list(base)
            for _ in range(int(rng.integers(0, int((1 - least) * n + 1e-9) + 1))):
                at = int(rng.integers(0, len(copy)))
                copy[at:at + 1] = [[], ["x"], ["a", "b"]][int(rng.integers(0, 3))]
                copy = copy or ["a"]
            texts.append(copy)
    frame = spark.createDataFrame([(c, len(w), [c % 3], " ".join(w)) for c, w in enumerate(texts)],
                                  "c long, n_words int, crowd array<long>, text string")
    rare = {c: set(r) for c, r in rows(order_minhash.rare_words(spark, frame, least))}
    lengths = spark.createDataFrame([(n,) for n in range(160)], "n int")
    needed = dict(rows(lengths.select("n", order_minhash.needed_words(F.col("n"), least))))
    checked = 0
    for a in range(len(texts)):
        for b in range(a):
            if order_minhash.similar(" ".join(texts[a]), " ".join(texts[b]), least):
                checked += 1
                assert len(rare[a] & rare[b]) >= needed[min(len(texts[a]), len(texts[b]))]
    assert checked > 50


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 107), (103, 107)]
    got = dict(rows(order_minhash.components(spark, spark.createDataFrame(links, "a long, b long"))))
    parts = {}
    for c, label in got.items():
        parts.setdefault(label, set()).add(c)
    assert sorted(map(sorted, parts.values())) == [list(range(20)), list(range(20, 40)), list(range(40, 60)), [100, 103, 107]]


# -- language -----------------------------------------------------------------------

def test_language_on_held_out_documents(spark, odd):
    prepare(spark)
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect()
            if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert np.mean([a == b for a, b in held]) > 0.9
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd).collect()}
    assert said[1] == said[2] == said[3] == ("und", 0.0) and said[4][0] == "en"
    none = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_gradients_by_differences():
    net = language.Network.start(["a", "b"], 3)
    for name in ("table", "turn", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, inside = language.windows_of([b"abcab", b"cc"])
    y = np.array([0, 1])
    _, grads = net.gradients(x, y, inside)
    for part, grad in zip((net.table, net.turn, net.out, net.bias), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = part[at]
        part[at] = old + 1e-2
        up = net.gradients(x, y, inside)[0]
        part[at] = old - 1e-2
        down = net.gradients(x, y, inside)[0]
        part[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 0.02 * abs(grad[at]) + 1e-3


# -- HTML ---------------------------------------------------------------------------

PAGE = """<html class="menu-open"><head><title>T</title></head><body><header><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies to make this site better for you and for all who read it.</p></div>
<nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><main><article><header><h1>A &amp; B&nbsp;c</h1></header>
<p>First   <b>par</b>agraph <a href="#">link</a> &lt;here&gt;.<p>El.<div class="ad">Buy this long advert text with many words</div>
<p>Last.</p><form><label>Name</label></form><aside><p>Side note that is quite long, with many words in it</p></aside></article>
<section class="comments"><article class="comment"><p>I like this very much, thank you for it all</p></article></section></main>
<footer><p>&copy; 2024 a longer footer text with no links in it</p></footer><script>var a="<p>no</p>";</script></body></html>"""


def test_main_text(spark):
    prepare(spark)
    tree = html_blocks.trained()
    assert html_blocks.main_text(PAGE, tree) == "A & B c\nFirst paragraph link <here>.\nEl.\nLast."
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<" * 5000)],
                               "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_blocks.extract(df).collect()}
    assert got[2] == got[None] == ("", 0) and got[1][1] == len(got[1][0]) and len(got) == 4


@pytest.mark.parametrize("odd_tag", [
    '<svg viewBox="0 0 1 1"/>', "<svg />", "<button>", "<object data=x>", "<video src=a><source src=b>", "<svg-icon name=x></svg-icon>",
    "<button-group></button-group>", "<video-player></video-player>", "<title-bar></title-bar>", "<style-x></style-x>",
    "<svg><title>No</title><g><text>drawn</text></g></svg>", "<button><p>press</p></button>", "<select><option>one</select>",
    "<script>if (a<b) c='</p>'</script>"])
def test_embedded_elements_end_where_they_close(odd_tag):
    tree, long = html_blocks.trained(), "many words of one paragraph " * 12
    page = (f"<body><div>{odd_tag}</div><main><article><h1>Head</h1><p>First {long}</p><p>In {odd_tag} it {long}</p>"
            f"<div>{odd_tag}</div><p>Last {long}</p></article></main>{odd_tag}</body>")
    want = [" ".join(x.split()) for x in ("Head", f"First {long}", f"In it {long}", f"Last {long}")]
    assert html_blocks.main_text(page, tree).split("\n") == want
    button = page.replace("</main>", "<p>After</p><button>Share</button></main>")
    assert html_blocks.main_text(button, tree).split("\n") == [*want, "After"]
    for name in html_blocks.RAW:
        assert html_blocks.main_text(f"<main><p>{long}</p><{name}>{long}<p>{long}</p>", tree) == long.strip()


def test_classes_are_weak_evidence():
    tree = html_blocks.trained()
    long = " ".join(["Many words make one long paragraph of the article here."] * 4)
    page = f"<body>{{}}<p>{long}</p><p>{long} End.</p>{{}}</body>"
    want = f"{long}\n{long} End."
    for wrapper in ("page has-footer", "no-sidebar", "wiki-sidebar-off", "with-banner layout", "sidebar-left-page"):
        assert html_blocks.main_text(page.format(f'<div class="{wrapper}">', "</div>"), tree) == want
    for wrapper in ("banner", "promo", "social"):  # all of the page
        assert html_blocks.main_text(page.format(f'<div class="{wrapper}"><div>', "</div></div>"), tree) == want
    menu = '<div class="sidebar"><a href="/">Home</a> <a href="/b">News</a></div>'
    clutter = '<span class="ad">Buy one, get one free today only!</span> <span class="cookie-notice">We use <b>cookies</b>.</span>'
    inline = f"<main>{menu}<p>{long} {clutter} and <span class='share-price'>12</span> <span>more</span></p></main>"
    assert html_blocks.main_text(inline, tree) == f"{long}\nand 12 more"
    assert html_blocks.main_text(page.format(menu, '<div class="footer">Copyright of the page</div>'), tree) == want


def test_given_pages_keep_their_article(spark):
    tree = html_blocks.trained()
    import html
    for r in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1).replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article))
        assert html_blocks.main_text(r.html, tree) == "\n".join(filter(None, parts))


# -- token files and packing -----------------------------------------------------------

def test_orc_round_trip(spark, odd):
    path = default_path("word_bpe_49k.json")
    docs = odd.select("doc_id", "text", "kept").union(
        table(spark, SF, "documents").select(F.col("doc_id") + 100, "text", F.lit(1)))
    where, got = orc_tokens.store_tokens(spark, docs, path, 2)
    whole = {(r.doc_id, r.text): [*Encoder.of(path).tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
             for r in docs.collect()}
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, t), i in whole.items())
    want[next(k for k in want if k[0] == 6)] += 1  # the row that repeats
    out = sorted(got.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out])[:-1])
    assert [r.doc_id or -1 for r in out] == sorted(r.doc_id or -1 for r in out)
    one = orc_tokens.read_tokens(spark, where, [105])
    assert one.count() == 1 and "PushedFilters: [" in one._jdf.queryExecution().toString()
    assert orc_tokens.store_tokens(spark, odd.limit(0), path, 2)[1].count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400) if seed else np.array([64] * 5 + [1] * 200)
    counts = Counter(lengths.tolist())
    bins, n = {}, 0
    for length, runs in packing.make_plan(counts, 64).items():
        ends = np.append(runs[1:, 0], counts[length])
        for (first, each, bin_, offset), end in zip(runs, ends, strict=True):
            for k in range(end - first):
                bins.setdefault(bin_ + k // each, []).append((offset + k % each * length, length))
                n += 1
    assert n == len(lengths)
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0] + [x for _, x in items])[:-1])
        assert sum(x for _, x in items) <= 64 and sum(3 * x > 64 for _, x in items) <= 2
    assert len(bins) <= 1.06 * sum(lengths) / 64 + 3 + sum(lengths > 32)


def test_pack_documents(spark, odd):
    path = default_path("byte_bpe_50k.json")
    got = packing.pack_documents(spark, odd, path, 2, 128).collect()
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
        assert r.offset + r.length <= 128
    ids = np.array([*Encoder.of(path).tokenizer.encode(ODD[3][1], add_special_tokens=False).ids, 2], "<u4")
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 4)
    assert sum(x[2] for x in mine) == len(ids) and all(x[2] == 128 for x in mine[1:])
    assert all(c == zlib.crc32(ids[s:s + n].tobytes()) for _, s, n, c in mine)
    assert sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert packing.pack_documents(spark, odd.limit(0), path, 2).count() == 0


# -- WARC ------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    data = [(1, "http://a/é x\n", "same"), (5, "u", "same"), (3, None, "same"), (2, "v", None), (4, "v", ""),
            (None, "w", "same"), (7, "z", "long ü " * 50000), (7, "z", "long ü " * 50000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("resp", F.lit(9))
    path, got = warc.archive(spark, df)
    assert got.filter("gap IS NOT NULL").count() == 0
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    key = lambda i: f"<urn:page:{'none' if i is None else i}>"
    best = {"same": 5, "": 4, "long ü " * 50000: 7}
    want = Counter((key(i), len((h or "").encode()), sha(h), *(("response", None) if best[h or ""] == i else
                                                              ("revisit", key(best[h or ""])))) for i, _, h in data)
    assert Counter(rows(got.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_id"))) == want


def record(n, body=b"x"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    sha = base64.b32encode(hashlib.sha1(body).digest())
    return (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Type: application/http\r\n"
            b"WARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, sha, len(block), block))


def test_salvage_plain_and_members():
    a, b, c = record(1), record(2, b"body with WARC/1.1 inside"), record(3)
    found = lambda data: [(k, what["head"]["warc-record-id"] if k == "record" else what)
                          for k, _, _, what in warc.salvage_any(data)]
    assert [w for _, w in found(a + b + c)] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    broken = a + b.replace(b"body", b"bodi") + c
    assert found(broken) == [("record", "<urn:page:1>"), ("gap", "payload digest differs"), ("record", "<urn:page:3>")]
    spans = [(s, e) for _, s, e, _ in warc.salvage(broken)]
    assert spans == [(0, len(a)), (len(a), len(a) + len(b)), (len(a) + len(b), len(broken))]
    assert found(b"junk" + c + b"WARC/1.0\r\ncut")[1] == ("record", "<urn:page:3>")
    z = [gzip.compress(x, mtime=0) for x in (a, b, c)]
    assert [w for _, w in found(b"".join(z))] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    bad = z[0] + z[1][:40] + bytes([z[1][40] ^ 255]) + z[1][41:] + z[2]
    kinds = found(bad)
    assert kinds[0] == ("record", "<urn:page:1>") and kinds[-1] == ("record", "<urn:page:3>")
    assert sum(k == "gap" for k, _ in kinds) == 1 and not any(w == "<urn:page:2>" for _, w in kinds)
    assert found(b"") == []


def test_damage_of_a_written_archive_costs_one_record(spark):
    import glob

    prepare(spark)
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i} " + hashlib.sha256(b"%d" % i).hexdigest() * 40)
                                for i in range(60)], "page_id long, url string, html string")
    path, got = warc.archive(spark, df)
    name, = glob.glob(path.removeprefix("file:") + "/part-*")
    data = open(name, "rb").read()
    assert gzip.decompress(data).count(b"WARC-Type: response") == 60
    starts = [r.start for r in got.orderBy("start").collect()]
    assert len(set(starts)) == 60
    at = (starts[20] + starts[21]) // 2
    lost = f"<urn:page:{re.search(rb'<urn:page:([0-9]+)>', zlib.decompress(data[starts[20]:starts[21]], 31))[1].decode()}>"
    bad = fresh_path(spark, "damaged").removeprefix("file:")
    os.makedirs(bad)
    with open(f"{bad}/part-0", "wb") as f:
        f.write(data[:at] + bytes([data[at] ^ 255]) + data[at + 1:])
    found = warc.read_warc(spark, bad).collect()
    assert {r.record_id for r in found if r.gap is None} == {f"<urn:page:{i}>" for i in range(60)} - {lost}
    assert [(r.start, r.stop) for r in found if r.gap is not None] == [(starts[20], starts[21])]
    large = b"x" * (1 << 24)
    assert gzip.decompress(warc.member(large) + b"\0" + warc.member(b"y") + b"\0") == large + b"y"


# -- long words that a polynomial hash takes for equal -----------------------------------

def test_long_words_keep_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    raw = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    a, b = repetition.word_hashes(raw, *repetition.word_spans(raw))
    assert a != b
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = Encoder(default_path(name))
        got, want = encoder.encode_all([f"{one} {two}", two]), encoder.whole([f"{one} {two}", two])
        assert all((x == y).all() for x, y in zip(got, want, strict=True))
    n = dict(zip(repetition._NAMES, repetition.measure(f"{one} {two} " + " ".join(f"w{i}" for i in range(30)) + f" {two}"), strict=True))
    assert n["n_repeat_words"] == 0


def test_word_hashes_tell_words_apart():
    rng = np.random.default_rng(8)
    words = list({bytes(rng.integers(97, 99, rng.integers(1, 30))) for _ in range(3000)} | {b"a" * k for k in range(1, 40)})
    raw = np.frombuffer(b" ".join(words * 2), np.uint8)
    got = repetition.word_hashes(raw, *repetition.word_spans(raw))
    assert len(set(got.tolist())) == len(words) and (got[:len(words)] == got[len(words):]).all()
    assert len(repetition.word_hashes(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


# -- merge dropout ------------------------------------------------------------------------

def test_merge_dropout(spark, odd):
    import sentencepiece

    path = default_path("piece_bpe_32k.model")
    plain, coder = merge_dropout.Coder(path, 0.0, 1), merge_dropout.Coder(path, 0.2, 1)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in table(spark, SF, "documents").limit(40).collect()] + ["", " a  b ", "日本 é\n", "a" * 500]
    assert all(plain.encode(t, i).tolist() == model.encode(t) for i, t in enumerate(texts))
    for i, t in enumerate([*texts, "a▁b ▁", "▁"]):
        ids = coder.encode(t, i).tolist()
        assert coder.decode(ids) == t and ids == merge_dropout.Coder.of(path, 0.2, 1).encode(t, i).tolist()
    assert len({tuple(coder.encode("segmentation of words", d).tolist()) for d in range(30)}) > 1
    got = merge_dropout.encode_decode(odd, path).collect()
    assert len(got) == len(ODD) and all(r.decoded_equal and r.n_tokens == len(r.ids) for r in got)


def test_every_occurrence_of_a_word_is_cut_on_its_own():
    coder = merge_dropout.Coder(default_path("piece_bpe_32k.model"), 0.2, 5)
    word, n = " international", 4000
    plain = coder._known([word])[0]
    key_of = lambda *numbers: merge_dropout._mix_all(np.array(numbers, np.uint64))
    seen = Counter(coder.encode(word[1:], d).tobytes() for d in range(n))
    assert len(seen) > 30  # a table of streams stops at its size
    rng, drawn = np.random.default_rng(6), Counter()
    for _ in range(n):
        said: dict = {}
        skip = lambda *at: said.setdefault(at, rng.random() < 0.2)  # noqa: B023, E731
        drawn[np.array(coder.segment(word.replace(" ", "▁"), skip), "<u4").tobytes()] += 1
    assert plain.ids in seen
    for ids in seen | drawn:
        assert abs(seen[ids] - drawn[ids]) < 5 * (seen[ids] + drawn[ids] + 1) ** 0.5
    assert len(set(coder._encode_words([word] * n, key_of(*range(n))))) > 30
    odd = [word, " a\nb", "naïve", " " + "x" * 40, "\U0001F600 ok", "", " ", "日本"]  # merged in tables and by themselves
    for key in range(200):
        keys = np.repeat(key_of(key), len(odd))
        assert coder._encode_words(odd, keys) == [coder._at_once(w, int(keys[0])) for w in odd]


# -- URL filter ----------------------------------------------------------------------------

def test_url_rules_and_models(spark):
    data = [(1, "http://A.Org/x?q#f"), (2, "https://sub.EXAMPLE.org/es/1"), (3, "http://example.org/en/12"), (4, None),
            (5, "no scheme"), (6, "x://a.com/fr/z"), (7, "x://com/de/"), (8, "http:///p"), (9, "http://notexample.org/es/"),
            (10, "http://net/fr/z"), (11, "http://net/de/z"), (11, "http://net/de/z"), (12, "http://h" + "/é" * 20000)]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(spark, df).collect()}
    f = lambda i: (got[i].host, got[i].path, got[i].rule, got[i].verdict)
    assert f(1) == ("a.org", "/x", "org/", "allow") and f(2) == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert f(3) == ("example.org", "/en/12", "example.org/en/1", "block") and f(9)[2:] == ("org/", "allow")
    assert f(4)[:3] == f(5)[:3] == ("", "", None) and f(8)[:2] == ("", "/p")
    assert f(6)[2:] == ("com/fr/", "allow") and f(7)[2:] == ("com/de/", "block")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.filter_urls(spark, df.limit(0)).count() == 0
    only = url_filter.filter_urls(spark, df.filter("page_id = 10")).collect()
    assert only[0].verdict == "allow"


# -- repetition ------------------------------------------------------------------------------

def brute_quality(text):
    text = text or ""
    spans = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [w for _, w in spans]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))


def test_repetition_equals_brute_force(spark, odd):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + [t for _, t in ODD if t is None or len(t) < 1000]
    texts += ["a " * 30, "x y\nx y\n \n \nx y", "é ü\x0b" * 12, "\u00a0 \u2003 a"]
    for t in texts:
        got = repetition.measure(t)
        assert got[:5] == brute_quality(t)
        assert got[5] == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and not (got[5] and got[6])
    assert repetition.quality(odd).count() == len(ODD)
    assert repetition.quality(odd.limit(0)).count() == 0


# -- pipeline -----------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    left = docs
    for name, stage in P.STAGES[:-1]:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, left, SF).write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == docs.columns
    good = {r.doc_id for r in docs.collect() if repetition.measure(r.text)[6]}
    kept = {r.doc_id for r in left.collect()}
    assert kept <= good and len(kept) > 0.6 * len(good)
    packed = {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()}
    assert packed == kept
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_sample_is_the_least_of_each_language(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of many", "abc"[i % 3]) for i in range(4000)],
                                 "doc_id long, text string, lang string").repartition(300, "doc_id")
    got = {lang: sorted(r.place for r in language.sample(docs).filter(F.col("lang") == lang).collect()) for lang in "abc"}
    for lang in "abc":
        places = (docs.filter((F.col("lang") == lang) & (language.remainder(F.col("doc_id")) != 1))
                  .select(F.xxhash64("doc_id").alias("p")).collect())
        assert got[lang] == sorted(r.p for r in places)[:language.DOCS]
