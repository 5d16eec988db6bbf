"""The methods behind the operators, each against a brute-force version or a property that has to hold."""

import itertools
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import bit_table, decontaminate, gif, html_text, mixing, near_dup, pii, quality, secrets, toxicity, url_filter, words


def test_flight_keeps_words_and_documents():
    rng = random.Random(1)
    sizes = [float(rng.randrange(1, 400)) for _ in range(300)]
    chances = [rng.random() for _ in sizes]
    out = mixing.fly(sizes, list(chances), np.random.default_rng(3))
    open_ = [i for i, p in enumerate(out) if 0 < p < 1]
    assert len(open_) <= 2
    assert sum(out) == pytest.approx(sum(chances)) and np.dot(sizes, out) == pytest.approx(np.dot(sizes, chances))
    landed = mixing.land(sizes, list(out))
    assert set(landed) <= {0.0, 1.0} and abs(np.dot(sizes, landed) - np.dot(sizes, chances)) <= sum(sizes[i] for i in open_)


def test_flight_keeps_the_chances_on_average():
    sizes, chances = [3.0, 5.0, 9.0, 2.0, 7.0, 4.0], [0.2, 0.5, 0.3, 0.7, 0.6, 0.4]
    runs = np.array([mixing.fly(sizes, list(chances), np.random.default_rng(s)) for s in range(4000)])
    assert np.abs(runs.mean(axis=0) - chances).max() < 0.04


def test_choice_of_a_hot_source_spans_blocks(spark):
    units = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("source_no"), (F.col("id") % 97 + 1).alias("size"), F.lit(0.37).alias("chance"))
    out = mixing.choose(units, block=64)
    got = {r["source_no"]: r for r in out.groupBy("source_no").agg(F.count("*").alias("n"), F.sum("chance").alias("k"), F.sum(F.col("chance") * F.col("size")).alias("w"), F.sum("size").alias("all")).collect()}
    assert [got[s]["n"] for s in (0, 1)] == [2000, 1000]
    for r in got.values():
        assert abs(r["k"] - 0.37 * r["n"]) <= 3 and abs(r["w"] - 0.37 * r["all"]) <= 100
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.choose(units.repartition(7), block=64).collect()))


def test_missing_ids_keep_the_others_exact(spark):
    units = spark.createDataFrame([(2**62 + 1, 0, 5, 0.5), (None, 0, 5, 0.5), (2**62 + 3, 0, 5, 0.5)], "id long, source_no int, size long, chance double")
    assert {r["id"] for r in mixing.choose(units).collect()} == {2**62 + 1, 2**62 + 3, None}


def similar_texts(rng, groups, copies):
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(groups):
        base = rng.choices(vocabulary, k=60)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(60)] = rng.choice(vocabulary)
            yield " ".join(own)


@pytest.mark.parametrize("block", [8, 256])
def test_large_families_in_small_blocks_lose_no_link(spark, block):
    from tests.llm.test_queries import components

    rows = list(enumerate(similar_texts(random.Random(5), 6, 40)))
    got = near_dup.components(spark.createDataFrame(rows, "doc_id long, text string"), k=5, block=block).collect()
    want = components(rows, 5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_dedup_keeps_one_of_each_and_rows_without_id(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (2, "A b c d e f g", "y"), (3, "other words here", None), (None, "a b c d e f g", "z"), (4, None, "t")]
    out = near_dup.dedup(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]


HOSTS = ["com", "example.com", "a.example.com", "b.a.example.com", "xexample.com", "", "."]
PATHS = ["/", "/a", "/a/", "/a/b", "/ab", "/a/b/c", ""]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(HOSTS[:5]), st.sampled_from(PATHS)), max_size=8), st.sampled_from(HOSTS), st.sampled_from([*PATHS, "/a/b/c/d"]))
def test_trie_matches_every_rule(rules, host, path):
    fits = [((len(h) + len(p), len(h), v == "block"), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    want = max(fits, key=lambda f: f[0])[1:] if fits else (None, None)
    assert url_filter.longest(url_filter.compile_rules(rules), host, path) == want


def test_rule_lists_are_checked():
    with pytest.raises(ValueError):
        url_filter.compile_rules([("maybe", "a", "/")])


def plain_lzw(data, least, clear_when_full):
    """A slow writer of code streams, one bit string at a time; it may go on with a full table."""
    bits, clear = [], 1 << least
    put = lambda code, width: bits.extend(code >> i & 1 for i in range(width))
    table, width = {bytes([i]): i for i in range(clear)}, least + 1
    put(clear, width)
    fresh, prefix = clear + 2, b""
    for byte in data:
        longer = prefix + bytes([byte])
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        if fresh < 4096:
            table[longer] = fresh
            fresh += 1
            if fresh - 1 == 1 << width and width < 12:
                width += 1
        elif clear_when_full:
            put(clear, width)
            table, width, fresh = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        prefix = bytes([byte])
    if prefix:
        put(table[prefix], width)
    put(clear + 1, width)
    return np.packbits(bits, bitorder="little").tobytes()


@pytest.mark.parametrize("least", [2, 4, 8])
@pytest.mark.parametrize("clear", [True, False])
def test_code_streams_of_another_writer(least, clear):
    rng = random.Random(least)
    data = bytes(rng.randrange(1 << least) for _ in range(30_000)) + bytes(5000)
    assert gif.lzw_decode(plain_lzw(data, least, clear), least, len(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_code_streams_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def picture(frames, palette, size=(4, 4)):
    """A GIF from (left, top, indices, disposal, transparent, delay, interlaced) frames."""
    out = [b"GIF89a", struct.pack("<HHBBB", size[1], size[0], 0x81, 0, 0), bytes(palette)]
    for left, top, indices, disposal, clear, delay, woven in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0")
        h, w = indices.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if woven else 0))
        rows = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, d)] if woven else range(h)
        stream = gif.lzw_encode(indices[list(rows)].astype(np.uint8).tobytes(), 2)
        out.append(b"\x02" + bytes([len(stream)]) + stream + b"\0")
    return b"".join(out) + b"\x3b"


PALETTE = [0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]


def colours(rgba):
    names = {(0, 0, 0, 0): ".", (0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b"}
    return ["".join(names[tuple(int(v) for v in p)] for p in row) for row in rgba]


def test_disposal_transparency_and_interlace():
    red, dot = np.full((4, 4), 1), np.array([[2, 3], [3, 2]])
    shown = [
        (0, 0, red, 1, None, 10, True),
        (1, 1, dot, 2, 3, 20, False),  # 3 is transparent; then the rectangle is cleared
        (0, 0, np.full((2, 2), 3), 3, None, 30, False),  # then what was below comes back
        (3, 3, np.full((1, 1), 2), 0, None, 0, False),
    ]
    frames = list(gif.decode(picture(shown, PALETTE)))
    assert [f.delay_ms for f in frames] == [100, 200, 300, 0]
    assert colours(frames[0].rgba) == ["rrrr"] * 4
    assert colours(frames[1].rgba) == ["rrrr", "rgrr", "rrgr", "rrrr"]
    assert colours(frames[2].rgba) == ["bbrr", "bb.r", "r..r", "rrrr"]
    assert colours(frames[3].rgba) == ["rrrr", "r..r", "r..r", "rrrg"]


def test_interlaced_rows_are_put_back():
    rows = np.repeat(np.arange(9)[:, None] % 4, 3, axis=1)
    (frame,) = gif.decode(picture([(0, 0, rows, 1, None, 0, True)], PALETTE, (9, 3)))
    assert (frame.indices == rows).all()


def test_frames_of_broken_and_missing_pictures(spark):
    good = picture([(0, 0, np.full((2, 2), 1), 1, None, 5, False)] * 2, PALETTE, (2, 2))
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"no picture")), (5, bytearray(good[:-30])), (1, bytearray(good))]
    got = gif.frames(spark.createDataFrame(rows, "n int, media binary"), "media", ["n"]).collect()
    whole = [(r["n"], r["frame"], r["start_ms"], r["delay_ms"]) for r in got if r["error"] is None]
    assert sorted(x for x in whole if x[0] == 1) == [(1, 0, 0, 50)] * 2 + [(1, 1, 50, 50)] * 2
    assert {r["n"] for r in got if r["error"]} == {4, 5}
    assert all(r["red"][15] == 4 and r["green"][0] == 4 for r in got if r["error"] is None)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(40):
        nodes = [html_text.Node("#page", "", -1, 0)]
        for i in range(1, 9):
            parent = int(rng.integers(0, i))
            nodes.append(html_text.Node("div", "", parent, nodes[parent].depth + 1))
            nodes[parent].items.append(i)
        odds = rng.normal(size=9)
        kept = html_text.decode(nodes, odds)
        assert all(kept[n.parent] or not kept[i] for i, n in enumerate(nodes) if i)
        best = max(
            sum(odds[i] for i in range(1, 9) if choice[i - 1])
            for choice in itertools.product((0, 1), repeat=8)
            if all(nodes[i].parent == 0 or choice[nodes[i].parent - 1] or not choice[i - 1] for i in range(1, 9))
        )
        assert sum(odds[i] for i in range(1, 9) if kept[i]) == pytest.approx(best)


def test_trees_tell_parts_of_unseen_templates():
    trees = html_text.fit()
    x, y = html_text._training(list(html_text.templates(60, seed=99)))
    assert ((trees.log_odds(x) > 0) == (y == 1)).mean() > 0.9


def test_pages_of_known_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Shop</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>A   title</h1><p>First &amp; foremost, this is a sentence.\n It goes on.</p>"
        "<script>var x = '<p>no</p>';</script><p>Second caf&eacute;, with more words to read.</p></article><section class='comments'><p>Nice post!</p></section>"
        "<footer>&copy; somebody</footer></body></html>"
    )
    assert html_text.extract([page], html_text.fit()) == ["A title\nFirst & foremost, this is a sentence. It goes on.\nSecond café, with more words to read."]


def test_votes_match_all_cosines():
    rng = np.random.default_rng(4)
    terms = rng.random((300, quality.TERMS)).astype(np.float32) * (rng.random((300, quality.TERMS)) < 0.05)
    labels = rng.integers(0, 2, 300)
    model = quality.fit_terms(terms[:200], labels[:200])
    got = model.score(terms)
    low = (terms * model.weights) @ model.basis
    low = low / np.linalg.norm(low, axis=1, keepdims=True)
    for i in range(0, 300, 17):
        cosine = low[i] @ model.vectors.T
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0).astype(float) ** quality.SHARPNESS
        assert got[i] == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-4)


def test_positive_unlabelled_risk_finds_hidden_positives():
    rng = np.random.default_rng(6)
    positive = (rng.random((200, 20)) < np.r_[[0.6] * 5, [0.2] * 15]).astype(np.float32)
    truth = rng.random(1000) < 0.2
    rates = np.where(truth[:, None], np.r_[[0.6] * 5, [0.2] * 15], np.r_[[0.02] * 5, [0.2] * 15])
    unlabelled = (rng.random((1000, 20)) < rates).astype(np.float32)
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.2, seed=0)
    assert ((unlabelled @ w + b > 0) == truth).mean() > 0.93


def test_terms_of_stems():
    (part,) = words.chunks(pa.array(["stemmata stemmaxy stemmazz short"]))
    numbers, first = toxicity.document_terms(part)
    assert first.tolist() == [0, len(numbers)] and len(numbers) == 4 + 1 + 2  # words, their stem, families of 2 and 3


def test_ledger_scans_a_blob_once_for_each_rule_version(spark):
    one = spark.createDataFrame([("a.txt", "password=abcdef1"), ("b.txt", "password=abcdef1"), ("c.txt", None)], "path string, text string")
    rows, ledger = secrets.scan(one)
    assert sorted((r["path"], len(r["spans"])) for r in rows.collect()) == [("a.txt", 1), ("b.txt", 1), ("c.txt", 0)]
    assert ledger.count() == 2
    more = one.unionByName(spark.createDataFrame([("d.txt", "token: zyxwvu98")], one.schema))
    assert secrets.update(more, ledger=ledger).count() == 1
    rows, after = secrets.scan(more, ledger=ledger)
    assert sorted((r["path"], len(r["spans"])) for r in rows.collect()) == [("a.txt", 1), ("b.txt", 1), ("c.txt", 0), ("d.txt", 1)]
    assert after.count() == 3 and secrets.update(more, ledger=after, rule_version=2).count() == 3
    masked = rows.withColumn("text", secrets.redacted()).collect()
    assert {r["text"] for r in masked} == {"[secret]", None}


def test_overlaps_bear_replaced_words(spark):
    rng = random.Random(8)
    vocabulary = [f"vé{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(30)]
    docs = []
    for i, text in items:
        own = text.split()
        for at in range(5, 40, 7):
            own[at] = "other"
        docs.append((i, " ".join(rng.choices(vocabulary, k=50) + own + rng.choices(vocabulary, k=50))))
        docs.append((500 + i, f"Vorher ÉTÉ {text} nachher".upper()))
        docs.append((1000 + i, " ".join(rng.choices(vocabulary, k=140))))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(frame, bench).collect()}
    assert got == {(i, i) for i, _ in items} | {(500 + i, i) for i, _ in items}
    assert {r["doc_id"] for r in decontaminate.remove(frame, bench).collect()} == {1000 + i for i, _ in items}


@pytest.mark.parametrize("texts", [[None], [""], ["one"], ["one two"], ["a b", None, "c", "d e f g h i"]])
def test_windows_of_few_words(texts):
    for k in (1, 3, 5, 9):
        (part,) = words.chunks(pa.array(texts, pa.string()))
        hashes, first = words.windows(part, k)
        counts = [len((t or "").split()) for t in texts]
        assert np.diff(first).tolist() == [c - k + 1 if c >= k else min(c, 1) for c in counts] and len(hashes) == first[-1]


def test_best_run_matches_all_runs():
    rng = np.random.default_rng(9)
    for _ in range(100):
        same = rng.random(rng.integers(1, 25)) < 0.6
        value = np.where(same, 1, -1)
        best = max([0, *(value[a:b].sum() for a in range(len(value)) for b in range(a + 1, len(value) + 1))])
        score, a, b = decontaminate.best_run(same)
        assert score == best and value[a:b].sum() == best


TRICKY = [
    "a@b.c@d.e f@g x..y@z-.q.r. _%@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1..2.3.4 999.1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-5 4111  1111 41111111111111110", "+1 (555) 123-4567 +1+2 3456789 ++49 30 1234567890123456 +123456 7",
    "+4111 1111 1111 1111", "1.2.3.4@x.y", "😀 a@b.c 😀 +49 30 123456", "0" * 5000, "1 " * 3000, "a@" * 2000, "1." * 3000, "+" * 2000 + "1" * 20, "a.b" * 3000 + "@c.d", "- 1-2-3-4 " * 500,
]


def test_tricky_personal_data(spark):
    from tests.llm.test_queries import personal

    rng = random.Random(10)
    texts = TRICKY + ["".join(rng.choices("0123456789  -.+()@ab", k=200)) for _ in range(300)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "n int, text string"))
    got = {r["n"]: [tuple(x) for x in r["b"]] for r in found.select("n", F.transform(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS)), lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("b")).collect()}
    assert got == {n: personal(t) for n, t in enumerate(texts)}


def test_cards_of_parted_digits(spark):
    from tests.llm.test_queries import personal

    texts = [sep.join("4111111111111111") for sep in (" ", "-")] + ["pay 4 1 1 1-1 1 1 1 1 1 1 1 1 1 1 1 now"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()
    got = [[(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE_KINDS] for r in found]
    assert got == [personal(t) for t in texts] and all(x[0][0] == "card" for x in got)


def test_reliabilities_tell_a_good_labeler_from_a_coin():
    rng = random.Random(11)
    counts: dict = {}
    for _ in range(4000):
        truth = rng.random() < 0.6
        good = lambda p: (1 if truth else -1) if rng.random() < p else (-1 if truth else 1)  # noqa: E731, B023
        votes = (good(0.95), good(0.9), good(0.9), rng.choice((1, -1)), good(0.8), rng.choice((1, 0)))
        counts[votes] = counts.get(votes, 0) + 1
    rows = [{"kind": "email", "votes": list(v), "grade": 0, "n": n} for v, n in counts.items()]
    chance, learnt = pii.reliabilities(rows)
    rates = learnt["email"]["rates"]
    assert learnt["email"]["share"] == pytest.approx(0.6, abs=0.05)
    assert rates[1][0][1] > 0.9 and rates[0][0][1] < 0.1 and abs(rates[1][3][1] - rates[0][3][1]) < 0.1
    assert chance["email", (1, 1, 1, 1, 1, 1)] > 0.9 > 0.1 > chance["email", (-1, -1, -1, 1, -1, 0)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<!-[]>&\"'/abp =x\n", max_size=120))
def test_broken_markup_never_raises(page):
    nodes = html_text.parse(page)
    assert all(0 <= n.parent < i for i, n in enumerate(nodes) if i)
    html_text.text_of(nodes, html_text.decode(nodes, np.ones(len(nodes))))


@pytest.mark.parametrize(
    "page",
    ["<span>" * 20_000 + "</div>" * 20_000, "<p>" * 20_000 + "</b>" * 20_000, "<a" * 50_000, "<!--" * 50_000, "<div>" * 20_000 + "deep", "<a href='" * 20_000, "<b>" * 10_000 + "<p>" * 10_000, "<![x[" * 20_000],
)
def test_time_is_linear_in_broken_pages(page):
    import time

    began = time.perf_counter()
    html_text.text_of(nodes := html_text.parse(page), html_text.decode(nodes, np.ones(len(nodes))))
    assert time.perf_counter() - began < 2


SHAPES = [
    ("<p>a</p><![foo[x]]>b<![endif]-->", "a\nb"),
    ("plain words only", "plain words only"),
    ("<article><p>x is <math><mi>a</mi></math> here.</p><object>fallback</object></article>", "x is a here.\nfallback"),
    ("<table><caption>Prices</caption><tr><th>Name</th><th>Price</th></tr><tr><td>Tea</td><td>2</td></tr></table>", "Prices\nName\nPrice\nTea\n2"),
    ("<body>Long article text that goes on for a while, with commas.<br><br>More text here <p>last paragraph of it</p></body>", "Long article text that goes on for a while, with commas. More text here\nlast paragraph of it"),
    (
        "<nav><a href='/'>Home</a> <a href='/b'>Shop</a></nav><article><h1>Tea</h1><p>Some words here, and there.</p><dl><dt>Term</dt><dd>Its meaning is told here.</dd></dl>"
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre><code>x = 1</code></pre><figure><img src=x><figcaption>A cup of it</figcaption></figure></article><footer>&copy; me</footer>",
        "Tea\nSome words here, and there.\nTerm\nIts meaning is told here.\na\nb\n1\n2\nx = 1\nA cup of it",
    ),
    (
        "<div><h1>Title of it</h1><p>Some words here, and there, that make a sentence.</p></div><div><h3>Comments (2)</h3><div>Ann</div><div>I like it, really.</div><div>Bob</div><div>Me too.</div></div>",
        "Title of it\nSome words here, and there, that make a sentence.",
    ),
    ("<p>One line.</p><p>All rights reserved.</p><!-- never closed <p>x</p>", "One line.\nAll rights reserved."),
]


@pytest.fixture(scope="module")
def trees():
    return html_text.fit()


@pytest.mark.parametrize("page, text", SHAPES)
def test_pages_of_other_shapes(trees, page, text):
    assert html_text.extract([page], trees) == [text]


# Readers' comments without a class that tells, an article that is a list of links, one that quotes, and text for those without scripts.
FLOOD = "<p>The river rose in the night, and by morning the lower fields were under water, as they had been ten years before.</p><p>Nobody had expected it so late in the year, the mayor told us.</p>"
FLOOD_TEXT = "The river rose in the night, and by morning the lower fields were under water, as they had been ten years before.\nNobody had expected it so late in the year, the mayor told us."
MENU = '<div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></div>'
UNCLASSED = [
    (f'<html><body>{MENU}<article><h1>Flood</h1>{FLOOD}</article><div><h3>3 thoughts on “Flood”</h3><div><b>Al</b> says: I saw it too, it was awful.</div><div><b>Bea</b> says: Same here.</div><div><b>Cy</b> says: We moved the cows in time.</div></div></body></html>', "Flood\n" + FLOOD_TEXT),
    (f'<html><body>{MENU}<div class="content"><h1>Flood</h1>{FLOOD}</div><div><div>Al wrote on May 3:</div><div>I saw it too, it was awful.</div></div><div><div>Bea wrote on May 4:</div><div>Same here, and worse.</div></div></body></html>', "Flood\n" + FLOOD_TEXT),
    (f'<html><body>{MENU}<article><h1>Flood</h1>{FLOOD}</article><div><div><div>Al wrote on May 3:</div><div>I saw it too, it was awful.</div></div><div><div>Bea wrote on May 4:</div><div>Same here, and worse.</div></div></div></body></html>', "Flood\n" + FLOOD_TEXT),
    (f'<html><body>{MENU}<div class="content"><h1>Links of the week</h1><ul><li><a href="/1">One good article about birds</a></li><li><a href="/2">How a bridge was built in a year</a></li><li><a href="/3">Why the sea is getting warmer</a></li></ul><p>That is all for this week, see you on Monday.</p></div><footer>&copy; 2024 Example</footer></body></html>', 'Links of the week\nOne good article about birds\nHow a bridge was built in a year\nWhy the sea is getting warmer\nThat is all for this week, see you on Monday.'),
    (f'<html><body>{MENU}<article><h1>Talk</h1><p>We met the mayor.</p><p>Anna Lee said: the water came at night, and nobody was ready for it.</p><p>We asked what comes next.</p></article><footer>&copy; 2024 Example</footer></body></html>', 'Talk\nWe met the mayor.\nAnna Lee said: the water came at night, and nobody was ready for it.\nWe asked what comes next.'),
    (f'<html><body>{MENU}<article><h1>Flood</h1>{FLOOD}<noscript><p>The map needs scripts, here is what it shows in words.</p></noscript></article></body></html>', "Flood\n" + FLOOD_TEXT + '\nThe map needs scripts, here is what it shows in words.'),
    (f'<html><body>{MENU}<main><h1>Flood</h1><p>3 May 2024</p>{FLOOD}</main></body></html>', 'Flood\n3 May 2024\n'+ FLOOD_TEXT),
]


@pytest.fixture(scope="module")
def both_trees(spark, trees):
    """Fitted on templates alone, and with real pages, all of which take a list of links for a menu."""
    return trees, html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("page, text", UNCLASSED)
def test_pages_without_telling_classes(both_trees, page, text):
    assert [html_text.extract([page], t) for t in both_trees] == [[text], [text]]


def test_real_articles_are_whole(spark):
    """Every page of the table whose article is marked: the text is what the article's blocks say, and nothing else."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    known = html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for page, got in zip(pages, html_text.extract(pages, known), strict=True):
        nodes = html_text.parse(page)
        kept = [False] * len(nodes)
        for i, n in enumerate(nodes):
            own = n.tag not in html_text._SILENT and not any(w in n.words.split() for w in ("ad", "related", "sidebar", "comments"))
            kept[i] = i == 0 or (kept[n.parent] and own and (n.tag in ("html", "body") or n.tag == "article" or nodes[n.parent].tag not in ("#page", "html", "body")))
        assert got == html_text.text_of(nodes, kept)


def test_copies_of_a_page_are_learnt_from_once(spark):
    rows = [("<article><p>one</p></article>",)] * 50 + [(f"<article><p>text {i}</p></article>",) for i in range(5)] + [("<main>" + "x" * 300 + "</main>",), (None,), ("no tags",)]
    frame = spark.createDataFrame(rows, "html string").repartition(4)
    drawn = html_text._drawn(frame, "html", 4, 200)
    assert len(set(drawn)) == len(drawn) == 4
    assert len(html_text._drawn(frame, "html", 300, 200)) == 6


def test_many_spans_in_one_text(spark):
    """Over 200,000 matches in a text: spans are where they should be, and time is near-linear."""
    import time

    from tests.llm.test_queries import personal

    text = " ".join(f"u{i}@b{i}.org 10.0.{i % 300}.7 555-123-{i % 10_000:04d}" for i in range(70_000))
    found = pii.find(spark.createDataFrame([(1, text), (2, "😀 a@b.c")], "n int, text string"))
    began = time.perf_counter()
    got = {r["n"]: [tuple(x) for x in r["b"]] for r in found.select("n", F.transform("spans", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("b")).collect()}
    assert time.perf_counter() - began < 60
    assert [x for x in got[1] if x[0] in pii.BASE_KINDS] == personal(text) and got[2] == [("email", 2, 7)]
    assert sum(x[0] == "national" for x in got[1]) == 70_000


def test_added_spans_overlap_no_base_span(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices(["555-123-4567", " ", "+1 ", "4111 1111 1111 1111", "(", ")", "1", "123-45-6789", " x@y.z ", "GB82WEST12345698765432", "tel "], k=12)) for _ in range(200)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), least=0.0).collect()
    seen = 0
    for r in found:
        base, more = ([s for s in r["spans"] if (s["kind"] in pii.BASE_KINDS) == flag] for flag in (True, False))
        assert not any(b["start"] < s["end"] and s["start"] < b["end"] for s in more for b in base)
        assert all(texts[r["n"]][s["start"] : s["end"]] == s["word"] for s in r["spans"])
        assert [(pii.KINDS.index(s["kind"]), s["start"]) for s in r["spans"]] == sorted((pii.KINDS.index(s["kind"]), s["start"]) for s in r["spans"])
        want = {m.span() for m in __import__("re").finditer(pii._PATTERNS["ssn"], texts[r["n"]])} if "ssn" in {s["kind"] for s in more} else set()
        got = {(s["start"], s["end"]) for s in more if s["kind"] == "ssn"}
        assert got == {w for w in want if not any(b["start"] < w[1] and w[0] < b["end"] for b in base)} or not want
        seen += len(more)
    assert seen > 50


def test_account_numbers_have_to_check(spark):
    texts = ["IBAN: GB82WEST12345698765432", "IBAN: GB00WEST12345678901234", "IBAN: GB00ABCD12345678901234", "IBAN: DE89370400440532013000", "IBAN: DE89370400440532013001"]
    got = [[s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()]
    assert got == [["iban"], [], [], ["iban"], []]


def test_a_retried_append_counts_once(spark):
    one = spark.createDataFrame([("a.txt", "password=abcdef1"), ("b.txt", "nothing")], "path string, text string")
    _, ledger = secrets.scan(one)
    rows, after = secrets.scan(one.unionByName(spark.createDataFrame([("c.txt", "password=abcdef1"), ("c.txt", "password=abcdef1")], one.schema)), ledger=ledger.unionByName(ledger))
    assert sorted((r["path"], len(r["spans"])) for r in rows.collect()) == [("a.txt", 1), ("b.txt", 0), ("c.txt", 1), ("c.txt", 1)]
    assert secrets.update(one, ledger=ledger.unionByName(ledger)).count() == 0


def test_every_text_is_read_once_over_deliveries(spark):
    """Against plain Python: ledger rows are the distinct texts, at each rule version, whatever order they come in."""
    rng = random.Random(13)
    texts = [rng.choice(["password=abcdef1", "x", "", None, f"token: {rng.randrange(10**9)}zz", f"text {rng.randrange(30)}"]) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(5)
    first, ledger = secrets.scan(frame.filter("n % 2 = 0"))
    second, ledger = secrets.scan(frame.filter("n % 2 = 1"), ledger=ledger)
    assert ledger.count() == len({t or "" for t in texts})
    got = {r["n"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in first.unionByName(second).collect()}
    assert got == {n: secrets.find(t or "") for n, t in enumerate(texts)}
    again, ledger = secrets.scan(frame, ledger=ledger, rule_version=2)
    assert ledger.count() == 2 * len({t or "" for t in texts}) and again.count() == 400


def test_masks_of_many_and_overlapping_spans(spark):
    text = "".join(f"key{i} " for i in range(100_000))
    spans = [("hex", m.start(), m.end()) for m in __import__("re").finditer(r"key\d+", text)]
    rows = [(1, text, spans), (2, "abcdef", [("a", 0, 2), ("a", 1, 3), ("a", 3, 4), ("a", 5, 6)]), (3, None, []), (4, "x", [])]
    got = {r["n"]: r["t"] for r in spark.createDataFrame(rows, f"n int, text string, spans {secrets.SPANS}").select("n", secrets.redacted(by="#").alias("t")).collect()}
    assert got == {1: "# " * 100_000, 2: "#e#", 3: None, 4: "x"}


def test_bit_tables_lose_no_hash(spark):
    from loomgraph.llm import bit_table

    values = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    table = bit_table.build(values, "h").value
    inside, outside = (np.array([r["h"] for r in spark.range(a, b).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64) for a, b in ((0, 20_000), (20_000, 40_000)))
    assert len(bit_table.passing(table, inside)) == 20_000 and len(bit_table.passing(table, outside)) < 1000
    assert len(bit_table.passing(bit_table.build(values.limit(0), "h").value, outside)) == 0


def test_splits_and_anti_joins_lose_no_row(spark):
    from loomgraph.llm import bit_table

    rows = spark.range(5000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 997).alias("k"), F.lit("own").alias("_at0"), "id")
    keys = rows.filter("k % 7 = 0").select("k").distinct()
    near, far = bit_table.split(rows, keys, "k")
    assert near.columns == rows.columns and near.count() + far.count() == 5000 and far.join(keys, "k").isEmpty() and far.count() > 3000
    got = sorted(r["id"] for r in bit_table.without(rows, keys, "k").collect())
    assert got == sorted(r["id"] for r in rows.filter("k is null or k % 7 <> 0").collect())


@pytest.mark.parametrize("length, replaced, least", [(6, 1, 1.0), (7, 1, 1.0), (9, 1, 1.0), (10, 1, 0.95), (12, 1, 0.95), (12, 2, 0.9), (15, 2, 0.95), (15, 3, 0.9), (20, 3, 0.95), (20, 4, 0.95), (30, 6, 0.95)])
def test_recall_of_replaced_words(spark, length, replaced, least):
    rng = random.Random(length * 31 + replaced)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(i if i % 7 else None, " ".join(rng.choices(vocabulary, k=length))) for i in range(1, 201)]
    docs = []
    for n, (_, text) in enumerate(items):
        own = text.split()
        for at in rng.sample(range(length), replaced):
            own[at] = f"other{rng.randrange(10**6)}"
        docs.append((n, " ".join(rng.choices(vocabulary, k=30) + own + rng.choices(vocabulary, k=30))))
    docs += [(1000 + n, " ".join(rng.choices(vocabulary, k=100))) for n in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert max(found) < 1000 and len(found) >= least * 200


def test_large_benchmarks_are_joined_by_shuffle(spark):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40)))) for i in range(40)]
    docs = [(n, " ".join(rng.choices(vocabulary, k=20) + rng.choice(items)[1].split() + rng.choices(vocabulary, k=20) + rng.choice(items)[1].split())) for n in range(60)]
    docs += [(100, f"{items[3][1]} x y z {items[3][1]}")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.overlaps(frame, bench).collect()))
    two = sorted(map(tuple, decontaminate.overlaps(frame, bench, broadcast_seeds=0, broadcast_words=0).collect()))
    assert one == two and sum(r[0] == 100 and r[1] == 3 for r in one) == 2


def test_every_run_of_an_alignment():
    same = np.array([1] * 12 + [0] * 20 + [1] * 11 + [0, 1] * 3, bool)
    assert sorted(decontaminate.runs(same, 10)) == [(0, 12), (32, 43)] and list(decontaminate.runs(same, 13)) == []


def plain_hash(word):
    """A word's hash, byte by byte."""
    total = 0
    for k, c in enumerate(word.lower()):
        total += (c + 1) * pow(words._BASE, k, 1 << 64)
    return int(words.mix(np.array([total % (1 << 64)], np.uint64))[0])


def test_hashes_of_words_of_any_length(monkeypatch):
    texts = ["a bc  DEF", None, " " * 30, "x" * 9000 + " y " + "Zq" * 5000, "", "é\t😀 end "]
    (part,) = words.chunks(pa.array(texts))
    want = [plain_hash(w) for t in texts for w in (t or "").encode().split()]
    assert part.hashes.tolist() == want
    for size in (7, 64, 5000):
        monkeypatch.setattr(words, "CHUNK", size)
        assert [h for p in words.chunks(pa.array(texts)) for h in p.hashes.tolist()] == want


def test_a_very_long_text_in_bounded_memory():
    """50 MB of text, and one word of 10 MB in it."""
    import resource

    text = "some words of a long text " * 1_600_000 + "w" * 10_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (part,) = words.chunks(pa.array([text], pa.large_string()))
    assert len(part.hashes) == 9_600_001 and len(np.unique(part.hashes)) == 7
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB


def test_terms_are_chosen_as_by_plain_counts(spark):
    """The terms and bits that Spark finds, and scores, against plain Python over the same texts."""
    rng = random.Random(15)
    bad, plain_words = [f"vile{i}" for i in range(6)], [f"word{i}" for i in range(80)]
    docs = [(n, " ".join(rng.choices(plain_words, k=12) + (rng.choices(bad, k=3) if n % 4 == 0 else []))) for n in range(200)]
    labels = [(n, int(n % 4 == 0)) for n in range(100)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    sets = {}
    for n, text in docs:
        (part,) = words.chunks(pa.array([text]))
        sets[n] = set(toxicity.document_terms(part)[0].tolist())
    positive, everyone = [sets[n] for n, y in labels if y], list(sets.values())
    sure = {}
    for t in set().union(*everyone):
        p, u = sum(t in s for s in positive), sum(t in s for s in everyone)
        share_p, share_u = (p + 0.5) / (len(positive) + 1), (u + 0.5) / (len(everyone) + 1)
        sure[t] = (share_p - share_u) / (share_u * (1 - min(share_u, 0.999)) / len(positive) + 1e-9) ** 0.5 if p >= 3 else 0
    best = sorted(sure, key=lambda t: (-sure[t], t))[: toxicity.TERMS]
    assert model.terms.tolist() == sorted(t for t in best if sure[t] > 4)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for n, _ in docs:
        z = [sum(w[i] for i, t in enumerate(model.terms) if t in sets[n]) + b for w, b in zip(model.weights, model.bias, strict=True)]
        assert scored[n] == pytest.approx(np.mean([1 / (1 + np.exp(-x)) for x in z]))
    assert min(s for n, s in scored.items() if n % 4 == 0) > max(s for n, s in scored.items() if n % 4)


def test_votes_match_plain_neighbours(spark):
    """Scores of the operator against a vote worked out from all cosines, vector by vector."""
    rng = random.Random(16)
    docs = [(n, " ".join(rng.choices(["Good", "plain", "words.", "more,"] if n % 2 else ["$$", "BUY", "now!!!", "###"], k=rng.randrange(1, 40)))) for n in range(120)]
    labels = [(n, n % 2) for n in range(80)]
    model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.vectors.shape[0] == 80
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for n, text in docs[::7]:
        (part,) = words.chunks(pa.array([text]))
        terms = quality.term_counts(part)[0]
        low = [sum(float(t) * float(w) * float(b) for t, w, b in zip(terms, model.weights, column, strict=True) if t) for column in model.basis.T]
        size = sum(x * x for x in low) ** 0.5
        cosines = sorted(((sum(x * float(v) for x, v in zip(low, vector, strict=True)) / size, y) for vector, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in cosines]
        assert got[n] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, cosines, strict=True)) / sum(weight), abs=2e-3)
    assert min(s for n, s in got.items() if n % 2) > max(s for n, s in got.items() if n % 2 == 0)


def test_targets_of_many_sources(spark):
    """More sources than fit a driver's plan: Spark's rounds against the plain list, hard caps in a row included."""
    rng = random.Random(17)
    sizes = [0 if i % 11 == 0 else int(10 ** rng.uniform(0, 6)) for i in range(3000)]
    weights = [float(1 + i % 3) for i in range(3000)]
    rows = spark.createDataFrame(list(zip(range(3000), sizes, weights)), "n int, size long, weight double")
    for budget, most in ((1.0, 3), (2.9, 3), (3.0, 3), (0.01, 1)):
        got = {r["n"]: r["target"] for r in mixing.aimed(rows, budget, most).collect()}
        want = mixing.targets(sizes, weights, budget * sum(sizes), most)
        assert [got[n] for n in range(3000)] == pytest.approx(want, rel=1e-9)
    assert [r["target"] for r in mixing.aimed(rows.filter("size = 0"), 1.0, 3).distinct().select("target").distinct().collect()] == [0.0]


def test_very_many_sources(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit("two words").alias("text"))
    mixed = mixing.blend(docs)
    n, words_taken, most = mixed.agg(F.count("*"), F.sum("taken"), F.max("copies")).first()
    assert n == 60_000 and abs(words_taken - 2 * 60_000) <= 60_000 and most <= 3


def test_rows_that_repeat_an_id_are_dealt_over_blocks(spark):
    units = spark.range(5000).select(F.when(F.col("id") < 4000, 7).alias("id"), F.lit(0).alias("source_no"), F.lit(5).cast("long").alias("size"), F.lit(0.5).alias("chance"))
    dealt = mixing.numbered(units, many=64)
    assert dealt.count() == 5000 == dealt.select("id", "turn").distinct().count()
    out = mixing.choose(units, block=64)
    assert {r["id"]: r["n"] for r in out.groupBy("id").agg(F.count("*").alias("n")).collect()} == {7: 4000, None: 1000}
    assert abs(out.agg(F.sum("chance")).first()[0] - 2500) <= 2


def test_ids_of_any_type_and_shared_ids(spark):
    texts = ["a b c d e f g", "A b c d e f g", "other words are here now", "a b c d e f g h", None]
    rows = [(f"id{9 - i}", t) for i, t in enumerate(texts)] + [("id9", "something else that is said once only"), (None, "alone")]
    got = sorted(((r["doc_id"] or "", r["component_id"] or "", r["kept"]) for r in near_dup.components(spark.createDataFrame(rows, "doc_id string, text string"), k=3).collect()))
    assert got == [("", "", True), ("id5", "id5", True), ("id6", "id6", True), ("id7", "id7", True), ("id8", "id6", False), ("id9", "id6", False), ("id9", "id9", True)]
    out = near_dup.dedup(spark.createDataFrame(rows, "doc_id string, text string"), k=3).collect()
    assert sorted((r["doc_id"] or "", r["text"] or "") for r in out) == sorted([("id5", ""), ("id6", texts[3]), ("id7", texts[2]), ("id9", texts[0]), ("id9", rows[5][1]), ("", "alone")])


def test_recall_of_pairs_at_the_threshold(spark):
    """Of all pairs of the table at 80 or more, how many share a component; by the formula at most 7 of 10,000 don't."""
    from tests.llm.test_queries import shingles
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    sets = {i: shingles(t, 4) for i, t in rows}
    at: dict = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    common: dict = {}
    for ids in at.values():
        for n, a in enumerate(ids if len(ids) < 200 else []):
            for b in ids[n + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b) in common if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.999 * len(pairs)


def test_counted_joins_lose_no_row(spark):
    from loomgraph.llm.skew import join_counted

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50).alias("key"), "id")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("key <> 7")
    want = sorted(map(tuple, rows.join(table, "key").select("key", "id", "top").collect()))
    for least in (10**9, 100, 0):
        assert sorted(map(tuple, join_counted(rows, table, "key", "n", 3000, least).select("key", "id", "top").collect())) == want


def test_very_large_sets_are_compared_exactly():
    a = np.arange(30_000_000, dtype=np.uint64)
    b, c = a[:24_000_000], a[:23_999_999]  # 80 of 100, and one short of it
    assert near_dup.spanning_links([a, b, np.arange(5, dtype=np.uint64)], 80) == [(0, 1)]
    assert near_dup.spanning_links([a, c, np.arange(5, dtype=np.uint64)], 80) == []


def test_bit_tables_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bit_table, "PER_TASK", 500)
    monkeypatch.setattr(bit_table, "SLICE", 64)
    hashes = spark.range(3000, numPartitions=7).select(F.xxhash64("id").alias("h"))
    table = bit_table.build(hashes, "h").value
    monkeypatch.setattr(bit_table, "PER_TASK", 1 << 20)
    assert (bit_table.build(hashes, "h").value == table).all()
    known = np.array([r["h"] for r in hashes.collect()], np.int64).view(np.uint64)
    assert len(bit_table.passing(table, known)) == 3000
    other = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    assert len(bit_table.passing(table, other)) < 300


def test_findings_through_the_ledger(spark):
    """Copies, an earlier delivery, a column named like a result: every path has the findings of its text, each blob once in the ledger."""
    rows = [(i, t, f"own {i}") for i, t in enumerate(["password=hunter2hunter2", "plain", None, "password=hunter2hunter2", "plain", "token: abcdef0123"] * 5)]
    frame = spark.createDataFrame(rows, "id long, text string, spans string")
    first, ledger = secrets.findings(frame.filter("id < 12"), ["id", "spans"])
    second, whole = secrets.findings(frame.filter("id >= 12"), ["id", "spans"], ledger=ledger)
    got = {r[0]: (r[1], [(s["kind"], s["start"], s["end"]) for s in r[3]]) for r in [*first.collect(), *second.collect()]}
    assert got == {i: (own, secrets.find(t or "")) for i, t, own in rows}
    blobs = [r["blob"] for r in whole.collect()]
    assert len(blobs) == len(set(blobs)) == 4
    again, same = secrets.findings(frame, ["id"], ledger=whole)
    assert same.count() == 4 and {r["id"]: len(r["spans"]) for r in again.collect()} == {i: len(f) for i, (_, f) in got.items()}


def test_lzw_reads_a_code_that_is_not_yet_known_and_refuses_later_ones():
    data = b"a" * 9000 + bytes(range(200)) * 90  # runs of one byte name the entry that is just being made; the table fills up
    for part in (data, data[:1], data[:300]):
        assert gif.lzw_decode(gif.lzw_encode(part), 8, len(part)) == part
    for codes in ([256, 97, 259], [256, 258]):
        with pytest.raises(ValueError, match="beyond a table"):
            gif.lzw_decode(gif._pack(np.array(codes), np.full(len(codes), 9)), 8, 100)
