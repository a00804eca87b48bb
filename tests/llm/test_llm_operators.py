"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import json
import random
import re
import time
import warnings
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from placeworks.llm import decontaminate, embedding_dedup, graph, html_extract, induced, mixing, near_dedup, queries, repeats, scratch, secret_scan, sharding, textops, tokens, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, rid long, h long, score double, toxic int, topic string, probability double, bucket long, _cell string"


def rows_of(texts):
    return [(i, t, "en", "s", 1, 1, 1, 0.5, 1, "x", 0.1, 1, "c") for i, t in texts]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 90)
    texts = [(None, None), (None, "lost id " + base), (1, None), (2, ""), (3, "   \n"), (4, "One Two"), (5, "one  two"), (6, base), (7, base.upper()), (8, base), (8, base), (8, words(rng, 30))]
    for i in range(9, 60):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append((i, rng.choice([" ".join(w), words(rng, 40) + " " + passage + " " + words(rng, 20), words(rng, 60)])))
    texts.append((60, words(rng, 30000)))
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(rows_of(corpus), CLASH)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], CLASH)


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


def test_word_hashes():
    """No collision of complementary Thue-Morse strings, of lengths or of places; case does not count."""
    told = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), *("x" * n for n in range(1, 80)), "abcdefgh", "abcdefghi", "ABCDEFGHI"]
    buf = np.frombuffer(" ".join(told).encode(), np.uint8)
    hashes = textops.word_hashes(buf, *textops.word_bounds(buf, np.array([0, len(buf)]), textops.NONSPACE)[:2]).tolist()
    assert len(hashes) == len(told) and len(set(hashes)) == len(told) - 1 and hashes[-1] == hashes[-2]


def test_sharding(docs, nothing, corpus):
    out = sharding.shard_documents(docs, 8).collect()
    assert len(out) == len(corpus) and {r.law for r in out} == {"bytes"} and all(r.grown_shard is None for r in out)
    sizes = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    assert sizes == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(nothing, 8).count() == 0


def test_sharding_against_plain_splitters(spark, docs, corpus):
    """Shards are runs of the keys' order, cut within the tolerance of equal sizes; slots are places in it."""
    keys = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    assert all(h == np.int64(np.uint64(xxhash.xxh64((t or "").encode(), seed=42).intdigest()).view(np.int64)) for (_, t), h in keys.items())
    order = sorted(corpus, key=lambda r: (keys[r], -(1 << 63) if r[0] is None else r[0]))
    sizes = np.array([len((t or "").encode()) + 1 for _, t in order])
    out = sorted(sharding.shard_documents(docs, 4, tolerance=0.0).collect(), key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.size) for r in out] == [(d, n) for (d, _), n in zip(order, sizes.tolist(), strict=True)]
    ends, cuts = np.append(0, np.cumsum(sizes)), [sum(r.shard < k for r in out) for k in (1, 2, 3)]
    # Rows of one key stay together, so a cut is the nearest border between keys.
    borders = [i for i in range(len(order) + 1) if i in (0, len(order)) or (keys[order[i]], order[i][0]) != (keys[order[i - 1]], order[i - 1][0])]
    for k, cut in zip((1, 2, 3), cuts, strict=True):
        target = ends[-1] * k / 4
        assert abs(ends[cut] - target) == min(abs(ends[b] - target) for b in borders)


def test_sharding_is_even(spark):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    sums = [r.s for r in sharding.shard_documents(many, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.01 * sum(sums) / 8


def test_mixing(docs, nothing, corpus):
    out = mixing.mixed(docs).collect()
    assert len(out) == len(corpus) and all(0 < r.probability <= 1 for r in out)
    assert mixing.mixed(nothing).count() == 0


def mixing_rows(n=600):
    rng = random.Random(2)
    return [(i, words(rng, rng.randint(1, 30)), rng.choice(["en", "de", None]), "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 3)}") for i in range(n)]


MIXED = "doc_id long, text string, lang string, source string"


def test_mixing_meets_its_targets(spark):
    out = mixing.mixed(spark.createDataFrame(mixing_rows(), MIXED), rate=0.3).toPandas()
    out["w"] = out.tokens * out.probability
    assert out.probability.max() < 1 and np.isclose(out.w.sum(), 0.3 * out.tokens.sum())
    for m in ("source", "lang", "topic"):
        key = out[m].fillna("")
        natural = out.tokens.groupby(key).sum() / out.tokens.sum()
        target = natural ** mixing.POWERS[m]
        got = out.w.groupby(key).sum() / out.w.sum()
        assert np.allclose(got, target / target.sum(), atol=1e-6)


def test_mixing_takes_rare_cells_whole(spark):
    """A rare source is taken whole, and does not shrink the sample of the others."""
    rows = [*mixing_rows(), (1000, "a rare one", "en", "rare")]
    out = mixing.mixed(spark.createDataFrame(rows, MIXED)).toPandas()
    assert out[out.source == "rare"].probability.tolist() == [1.0] and out.probability.max() == 1
    assert np.isclose((out.tokens * out.probability).sum(), 0.5 * out.tokens.sum())
    assert out[out.source != "rare"].probability.min() > 0.3


def test_mixing_keeps_names_apart(spark):
    rows = [(1, "x", "b\x1fc", "a"), (2, "x", "c", "a\x1fb")]
    assert mixing.mixed(spark.createDataFrame(rows, MIXED)).count() == 2
    assert mixing.sample(spark.createDataFrame(rows, MIXED)).columns == ["doc_id", "text", "lang", "source"]


def test_mixing_joins_any_number_of_cells(spark, monkeypatch):
    docs = spark.createDataFrame(mixing_rows(), MIXED)
    one = sorted(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_CELLS", 1)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == one


def test_mixing_tells_of_targets_it_cannot_meet(spark, monkeypatch):
    """A value alone in two marginals has two targets."""
    monkeypatch.setattr(mixing, "MOST", 12)
    rows = [(i, "some plain words", "en" if i % 2 else "de", "a" if i % 3 else "b") for i in range(200)]
    with pytest.warns(UserWarning, match="cannot be met together"):
        mixing.mixed(spark.createDataFrame([*rows, (200, "some plain words", None, None)], MIXED))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.mixed(spark.createDataFrame(rows, MIXED))


def brute_repeats(texts, size=400):
    seen = collections.Counter()
    raws = [(t or "").encode() for _, t in texts]
    for b in raws:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for (d, _), b in zip(texts, raws, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_passages(texts, size=51):
    told = [t if t is None else re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in texts]
    strings = collections.defaultdict(set)
    for (d, t), w in zip(texts, told, strict=True):
        for i in range(len(w or ()) - size + 1):
            strings[tuple(w[i : i + size])].add((d, t))
    out = []
    for (d, _), w in zip(texts, told, strict=True):
        covered = bytearray(len(w or ()))
        for i in range(len(covered) - size + 1):
            if len(strings[tuple(w[i : i + size])]) > 1:
                covered[i : i + size] = b"\1" * size
        out.append((d, sum(c and (not i or not covered[i - 1]) for i, c in enumerate(covered))))
    return sorted(out, key=str)


def test_passages(spark, docs, corpus):
    """Passages of over 50 words, whatever their bytes, in the middle of texts, at a distance of one word, and copies."""
    rng = random.Random(31)
    short = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    one, two = short(51), short(60)
    texts = [(100, one + " " + short(30)), (101, short(20) + "\n" + one), (102, short(9) + " " + one + " " + short(1) + " " + two), (103, two + " " + short(3)), (104, " ".join(two.split()[:50]) + " end"), (105, one + " " + two), (106, short(51)), (106, short(51))]
    for given in (texts, [*corpus, *texts]):
        out = repeats.remove_repeats(spark.createDataFrame(given, "doc_id long, text string"), kept_bytes=False).collect()
        assert sorted(((r.doc_id, r.n_passages) for r in out), key=str) == brute_passages(given)
    assert sum(r.n_passages > 0 and r.n_removed == 0 for r in out) > 3


@pytest.mark.parametrize("most", [64, 2])
def test_repeats(docs, nothing, corpus, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", most)
    out = repeats.remove_repeats(docs, kept_bytes=False).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str)
    assert got == brute_repeats(corpus) and sum(r.n_removed for r in out) > 0
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_inside_one_text(spark):
    texts = [(1, "ab" * 500), (2, "x" * 399), (3, "y" * 401), (4, "é" * 300)]
    out = repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out), key=str) == brute_repeats(texts)
    assert {r.doc_id: bytes(r.kept) for r in out}[2] == b"x" * 399


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for t in range(150):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(1, 50))
        s = np.append(np.tile(s[: max(1, len(s) // 4)], 5) if t % 3 == 0 else s, 0)
        sa = induced.suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        shared = induced.common_prefixes(s, sa, 1000)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[b] == n


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><a href=/>home</a></nav><!-- ad --><div class="ad">Buy this now, it is really very cheap today.</div>%s<div id=comments><p>What a comment by a reader, and a long one at that.</p></div><footer>&copy; x</footer></body></html>"""


def test_html():
    article = "<article><h1>A &amp; B</h1><p><b>First   long paragraph of the text, with words.<br>More<p>Second <a href=x>linked</a> paragraph,\n with more words in it.</article>"
    assert html_extract.main_text(PAGE % article) == "A & B First long paragraph of the text, with words. More Second linked paragraph, with more words in it."
    plain = "<div id=m><h1>T</h1><div><p>First long paragraph of the text, with many words.<p>Second paragraph, with more words in it.</div><div class=share>Share</div></div>"
    assert html_extract.main_text(PAGE % plain) == "T First long paragraph of the text, with many words. Second paragraph, with more words in it."
    for odd in ("", "<", "<b", "<p", "<script>x", "<!-- x", "<a href='", "<p>" * 3000, "</p></div>"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("plain words") == "plain words"


def test_html_sections_of_unequal_length():
    """Without article or main, sections beside the longest one are content too."""
    paragraph = lambda s, i: f"<p>Paragraph {i} of section {s}, which has a good number of plain words in it, as prose does.</p>"
    parts = [(s, "".join(paragraph(s, i) for i in range(n))) for s, n in (("one", 10), ("two", 3), ("three", 1))]
    page = PAGE % ("<div class=post>" + "".join(f"<section>{p}</section>" for _, p in parts) + "</div>")
    expected = " ".join(p.replace("<p>", "").replace("</p>", " ").strip() for _, p in parts)
    assert html_extract.main_text(page) == expected


PARAGRAPH = "<p>Paragraph with a good number of plain words in it, as prose does, and a few more of them.</p>"


@pytest.mark.parametrize("name", ["content related-story", "post notice-board", "comments"])
def test_html_names_only_weigh(name):
    """The text of a page stays, whatever its element is called; beside a longer article, the same element goes."""
    text = " ".join([PARAGRAPH[3:-4]] * 6)
    assert html_extract.main_text(PAGE % f'<div class="{name}">{PARAGRAPH * 6}</div>') == text
    assert html_extract.main_text(PAGE % f'<article>{PARAGRAPH * 6}</article><div class="{name}">{PARAGRAPH * 3}</div>') == text


SAID = "<p>Reader number %d thinks that this is a rather long comment about the article above, and says so.</p>"


@pytest.mark.parametrize("where", ["inside", "beside", "unnamed"])
def test_html_leaves_out_what_readers_wrote(where):
    """An article of three paragraphs and many comments: by their name, inside the article or beside it, or outside an article without any."""
    article, said = "".join(f"<p>{i} of the article. {PARAGRAPH[3:-4]}</p>" for i in range(3)), "".join(SAID % i for i in range(5 if where == "unnamed" else 40))
    text = " ".join(f"{i} of the article. {PARAGRAPH[3:-4]}" for i in range(3))
    pages = {
        "inside": f'<article>{article}<div class="comments">{said}</div></article>',
        "beside": f'<div>{article}</div><div class="comments">{said}</div>',
        "unnamed": f'<article>{article}</article><section id="c-1">{said}</section>',
    }
    assert html_extract.main_text(f"<html><body>{pages[where]}</body></html>") == text


def test_html_forms():
    """A form that is the page is read, but for its fields; one beside the content is not."""
    text = " ".join([PARAGRAPH[3:-4]] * 4)
    fields = "<select><option>one<option>two</select><input value=x><textarea>t</textarea><button>Send</button>"
    assert html_extract.main_text(f"<body><form action=/x>{fields}<div>{PARAGRAPH * 4}</div></form></body>") == text
    assert html_extract.main_text(f"<body><div>{PARAGRAPH * 4}</div><form><p>Tell us what you think of it here.</p>{fields}</form></body>") == text
    assert html_extract.main_text(f"<body><article>{PARAGRAPH * 4}<form><p>Subscribe to our letter.</p>{fields}</form></article></body>") == text


def test_html_cards_are_no_article():
    """Short articles that lead to other pages do not win over a long text beside them."""
    cards = "<article><h3><a href=x>Other story</a></h3><p>A short line about it.</p></article>" * 4
    assert html_extract.main_text(f"<body><div>{PARAGRAPH * 12}</div>{cards}</body>").startswith(PARAGRAPH[3:-4])


def test_html_of_nested_main_is_linear():
    began = time.process_time()
    assert html_extract.main_text("<article>" + "<main>" * 20_000 + "<p>text").endswith("text")
    assert time.process_time() - began < 10


def test_html_of_any_depth_is_linear():
    began = time.process_time()
    assert html_extract.main_text("<div>" * 60_000 + "<p>text") == "text"
    assert time.process_time() - began < 20


def test_html_densities_against_plain_recursion():
    """Composite text density of random trees, by the definition."""
    rng = random.Random(17)

    def tree(depth):
        tag = rng.choice(["div", "p", "a", "span", "section"]) if depth else "body"
        kids = [tree(depth + 1) if depth < 4 and rng.random() < 0.5 else words(rng, rng.randint(1, 9)) for _ in range(rng.randint(0 if depth else 2, 4))]
        return tag if tag not in ("p", "a") else "span", kids

    def told(node, links, inside):
        """(characters, characters in links, tags, links) below a node."""
        sums = np.zeros(4, int)
        for kid in node[1]:
            if isinstance(kid, str):
                sums += (len(kid), len(kid) * inside, 0, 0)
            else:
                sums += told(kid, links, inside or kid[0] == "a") + np.array([0, 0, 1, kid[0] == "a"])
        links.append((node, sums))
        return sums

    def markup(node):
        return f"<{node[0]}>" + "".join(k if isinstance(k, str) else markup(k) for k in node[1]) + f"</{node[0]}>"

    for _ in range(40):
        root = tree(0)
        # Some spans are links; links hold no links.
        root = json.loads(json.dumps(root))
        for kid in root[1]:
            if isinstance(kid, list) and kid[0] == "span" and not any(isinstance(k, list) for k in kid[1]):
                kid[0] = "a"
        found = []
        told(root, found, False)
        whole = found[-1][1]
        expected = []
        for _, (c, lc, t, lt) in found:
            if not c:
                expected.append(0.0)
                continue
            base = np.log(c / max(c - lc, 1) * lc + whole[1] / max(whole[0], 1) * c + np.e)
            ratio = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)
            # Without any link on the page the base is 1, and the natural logarithm stands in.
            expected.append(c / max(t, 1) * np.log(ratio) / (np.log(base) if base > 1 else 1))
        density, total = html_extract.Page(markup(root)).densities()
        assert sorted(np.round(expected, 9)) == sorted(np.round(density[1:], 9))
        assert np.isclose(total[0], density[1])


def test_html_table(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (2, "v", "<p>" + "long words " * 20000, 3)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_toxicity(spark, nothing):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        text = words(rng, 25).split()
        if bad:
            text.insert(rng.randrange(25), rng.choice(["zzvile", "zzvilest", "qqrude"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), 0.0, "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, None, 0.0, "x"), (5000, "", "en", 0.0, "x"), (5000, "", "en", 0.0, "x")], "doc_id long, text string, lang string, score double, toxic string")
    table = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, table).collect()
    assert len(out) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    told = dict(labels)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.predicted == told[r.doc_id] for r in held if r.doc_id in told]) > 0.9
    assert toxicity.toxicity(nothing, table.limit(0)).count() == 0
    model = toxicity.fit(docs, table)
    assert toxicity.scored(docs, model).columns == ["doc_id", "text", "lang", "score", "toxic"]


def test_toxicity_against_a_plain_forward_pass(spark, monkeypatch):
    """Scores of whole texts, of none, of one word, of words with prefixes in common and of long ones, filter by filter."""
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 40)
    rng = random.Random(31)
    texts = [None, "", "-- !", "One", "one", "é中 ½", "ab abc abcd abcde abcdef abcdefg"] + [words(rng, n) for n in (2, 3, 4, 50, 2000)] + [words(rng, 30) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    expected = [plain.toxic_score(model, t) for t in texts]
    assert len(set(np.round(expected, 4))) > 20 and np.allclose([got[i] for i in range(len(texts))], expected, atol=1e-4)


def test_toxicity_keeps_the_natural_mixture(spark, monkeypatch):
    """A sample of as many toxic as clean rows stands for all learnable labels, in training and in the thresholds."""
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 40)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 10)
    rng = random.Random(8)
    labels = [(i, int(rng.random() < 0.1)) for i in range(1500)]
    seen, train, calibrated = collections.defaultdict(list), toxicity.train, toxicity.calibrated

    def kept(y, w):
        for label, weight in zip(y.tolist(), w.tolist(), strict=True):
            seen[label].append(weight)

    monkeypatch.setattr(toxicity, "train", lambda ids, y, w: (kept(y, w), train(ids, y, w))[1])
    monkeypatch.setattr(toxicity, "calibrated", lambda s, y, langs, w: (kept(y, w), calibrated(s, y, langs, w))[1])
    docs = spark.createDataFrame([(i, words(rng, 5), "en") for i, _ in labels], "doc_id long, text string, lang string")
    toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    learnable = collections.Counter(y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    assert {y: len(w) for y, w in seen.items()} == {0: 40, 1: 40} and all(np.isclose(sum(seen[y]), learnable[y]) for y in (0, 1))


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """A word that only rows outside the first sample have is learned, in several parts, the same in each run; thresholds count all remaining rows."""
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 60)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 30)
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    rng = random.Random(9)
    kept = [r.id for r in spark.range(3000).where("crc32(cast(cast(id as string) as binary)) % 3 != 1").orderBy(F.xxhash64("id"), "id").collect()]
    early = set(kept[:400])
    labels = [(i, int(rng.random() < 0.4)) for i in range(3000)]
    texts = {i: words(rng, 12) + (" zzvile" if i in early else " qqrude") * y for i, y in labels}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, table).collect()}
    of = lambda y: np.mean([out[i] >= 0.7 for i, x in labels if x == y and i not in early])
    assert of(1) > 0.9 and of(0) < 0.1
    seen, calibrated = [], toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda *a: (seen.append(a[4].sum() if len(a) > 4 else 0), calibrated(*a))[1])
    models = [toxicity.fit_whole(docs, table) for _ in range(2)]
    assert all(np.array_equal(a, b) for a, b in zip(models[0].kernels, models[1].kernels, strict=True)) and models[0].thresholds == models[1].thresholds
    rest = sum(zlib.crc32(next(toxicity.column_buckets(pa.array([texts[i]]))).astype(np.uint16).tobytes()) % toxicity.CALIBRATES == 0 for i in kept)
    assert seen[1:3] == [rest, rest]  # of the language, of all


def test_toxicity_learns_in_as_many_parts_however_rows_are_dealt(spark, monkeypatch):
    """Sessions that deal rows out to many partitions make, and send, no more models; and the same one comes out."""
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 60)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 10)
    monkeypatch.setattr(toxicity, "PART_ROWS", 300)
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    rng = random.Random(13)
    rows = [(i, words(rng, 8) + " vile" * (i % 2), "en", i % 2) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    few = toxicity.fit_whole(table.drop("toxic"), table.select("doc_id", "toxic"))
    for name in ("repartition", "repartitionByRange"):
        monkeypatch.setattr(type(table), name, lambda self, n, *cols, f=getattr(type(table), name): f(self, max(n, 37), *cols))
    many = toxicity.fit_whole(table.drop("toxic"), table.select("doc_id", "toxic"))
    assert np.array_equal(few.embedding, many.embedding) and np.array_equal(few.weight, many.weight) and few.thresholds == many.thresholds


def test_toxicity_of_labels_without_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 10)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1000, "one two"), (None, "three")], "doc_id long, text string")
    for docs in (docs, docs.limit(0)):
        assert toxicity.toxicity(docs, labels).count() == docs.count()


def test_toxicity_learns_by_weight():
    texts, y = [np.full((2, toxicity.PARTS), 9, np.int32)] * 200, np.repeat([0, 1], 100)
    model = toxicity.train(texts, y, np.where(y == 1, 1.0, 9.0))
    assert abs(toxicity.scores(model, model.projected(), texts[0], np.array([0, 2]))[0] - 0.1) < 0.05


def test_toxicity_thresholds():
    scores, y = np.repeat([0.95, 0.9, 0.8, 0.2], [60, 40, 2, 58]), np.repeat([1, 1, 0, 0], [60, 40, 2, 58])
    langs = ["en"] * 160
    assert toxicity.calibrated(scores, y, langs, np.ones(160))["en"] == 0.8  # 100 of 102
    assert toxicity.calibrated(scores, y, langs, np.where(y == 1, 1.0, 9.0))["en"] == 0.9  # 100 of 118
    assert toxicity.calibrated(1 - scores, y, langs, np.ones(160)) == {"": float("inf"), "en": float("inf")}


def test_toxicity_reads_whole_texts(spark, monkeypatch):
    """What tells a toxic text may stand after any number of words, in training and in the thresholds."""
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 10)
    seen, train, scores = [], toxicity.train, toxicity.scores
    monkeypatch.setattr(toxicity, "train", lambda ids, *rest: (seen.extend(ids), train(ids, *rest))[1])
    monkeypatch.setattr(toxicity, "scores", lambda m, t, ids, first: (seen.append(ids), scores(m, t, ids, first))[1])
    rng = random.Random(12)
    rows = [(i, words(rng, 1500 + i), i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    assert sorted(map(len, seen)) == [1500 + i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_toxicity_learns_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 60)
    texts = [rng.integers(1, 2000, (n, toxicity.PARTS)) for n in rng.integers(0, 60, 100)]
    y = np.arange(100) % 2
    whole = toxicity.train(texts, y, np.ones(100))
    monkeypatch.setattr(toxicity, "PART_WORDS", 200)
    parts = toxicity.train(texts, y, np.ones(100))
    told = [[toxicity.scores(m, m.projected(), t, np.array([0, len(t)]))[0] for t in texts] for m in (whole, parts)]
    assert np.allclose(*told, atol=0.05)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_contamination(spark, docs, nothing, corpus, monkeypatch):
    cut = lambda t: WORD.findall((t or "").translate(LOWER))
    items = [(1, " ".join(corpus[14][1].split()[:25])), (2, "one two"), (2, "one two"), (3, None), (4, "-- !"), (None, words(random.Random(9), 15)), (12, corpus[-1][1][500:700])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for g in [w[j : j + 10] for j in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []:
            windows[tuple(g)].add("null" if i is None else str(i))
    expected = []
    for d, t in corpus:
        w, hit, found = cut(t), set(), set()
        for size in {len(g) for g in windows}:
            for j in range(len(w) - size + 1):
                if (g := tuple(w[j : j + size])) in windows:
                    hit |= set(range(j, j + size))
                    found |= windows[g]
        expected.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for bits in (decontaminate.SLOT_BITS, 3):  # with eight flags, nearly every word passes the filter
        monkeypatch.setattr(decontaminate, "SLOT_BITS", bits)
        out = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").distinct().collect()
        assert sorted(map(tuple, out), key=str) == sorted(set(expected), key=str) and any(r.contaminated for r in out)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_contamination_of_rows_without_an_id_of_their_own(spark):
    rng = random.Random(21)
    leaked, ok = words(rng, 14), [words(rng, 14) for _ in range(3)]
    rows = [(d, t, k) for d in (None, 1) for k, t in enumerate([leaked, leaked, *ok, ok[0]])] + [(2, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    bench = spark.createDataFrame([(1, leaked), (2, words(rng, 30)), (3, leaked)], "item_id long, text string")
    out = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ",").alias("i"), "contaminated").collect()
    expected = [(d, len((t or "").split()), 14 * (t == leaked), "1,3" if t == leaked else "", t == leaked) for d, t, _ in rows]
    assert collections.Counter(map(tuple, out)) == collections.Counter(expected)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and collections.Counter(map(tuple, kept.collect())) == collections.Counter(r for r in rows if r[1] != leaked)


def test_secrets(spark, nothing):
    texts = [
        "x password = abcdef12 y", 'API_KEY: "k-12.3_4=5"', "token=abc", "password=token :abcdefgh", "AKIA" + "A1" * 9, "AKIA123", "ff" * 12, "ff" * 11, "paſſword = abcdef",
        'the auth_header is Zk9qT2xRb0hWc3B4Q1d5TnJtRGd4 here', "", None, "é secret='longvalue' " * 2,
    ]
    out = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [s for s in r.spans.split(",") if s] for r in out}
    base = {i: [s for s in v if not s.startswith("novel")] for i, v in spans.items()}
    assert base[0] == ["assign:2:21"] and base[1] == ["assign:0:20"] and base[2] == [] and base[3] == [] and base[5] == [] and base[7] == [] and base[8] == []
    assert base[4] == ["access:0:22"] and base[6] == ["hex:0:24"] and base[12] == ["assign:2:19", "assign:23:40"]
    assert any(s.startswith("novel") for s in spans[9]) and spans[10] == spans[11] == []
    assert all(r.base_sha256 == hashlib.sha256(",".join(base[r.doc_id]).encode()).hexdigest() for r in out)
    assert secret_scan.scan_secrets(nothing).count() == 0


@pytest.mark.parametrize("text", ["auth_" * 200_000, "auth" * 250_000, "auth_" * 100_000 + "1", "auth-" + "ab1" * 300_000, "token" + " " * 1_000_000, "secret_" + "_" * 900_000])
def test_secrets_of_odd_texts_are_linear(text):
    began = time.process_time()
    secret_scan.base_spans(text)
    secret_scan.Novelty().spans(text)
    assert time.process_time() - began < 3


def test_names_in_front_of_values():
    """The value of a name and its value, against every name in front of it."""
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice(["auth", "token", "api_key", "key", "_", "-", "/", "ab", "x", "9", "a1", "+"]) for _ in range(rng.randint(1, 9)))
        start = rng.randint(0, 2) if len(text) > 3 else 0
        expected = None
        for m in re.finditer(r"(?=((?:" + secret_scan.CONTEXT.pattern + r")[A-Za-z]*[_/-]+))", text[start:], re.I):
            name = text[start : start + m.end(1)]
            if not any(c.isdigit() for c in name) and not set(text[start + m.end(1) :]) & set("_/-"):
                expected = start + m.end(1)
        assert secret_scan._value(text, start, len(text)) == expected, text


def test_secrets_against_plain_scans(spark):
    """The fixed patterns by plain loops, over random pieces of them; values joined to names; ordinary code."""
    rng = random.Random(23)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", '"', "'", " ", "  ", "\n", "é", "AKIA", "A1", "f00d" * 6, "0123456789ab", "x.y-z", "abcdef", "Z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def assign(t, i):
        low = t[i:].translate(LOWER)
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name):
                j = i + len(name)
                j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
                while t[j : j + 1] == " ":
                    j += 1
                if t[j : j + 1] not in (":", "=") or not t[j : j + 1]:
                    return None
                j += 1
                while t[j : j + 1] == " ":
                    j += 1
                j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
                k = j
                while k < len(t) and t[k] in value:
                    k += 1
                return (k, k - j) if k > j else None
        return None

    def runs(t, lead, allowed, least):
        i, out = 0, []
        while i < len(t):
            k = i + len(lead) if t.startswith(lead, i) else -1
            first = k
            while k >= 0 and k < len(t) and t[k] in allowed:
                k += 1
            if k > first >= 0:
                out += [(i, k)] * (k - i >= least)
                i = k
            else:
                i += 1
        return out

    expected = []
    for t in texts:
        spans, i = [], 0
        while i < len(t):
            if found := assign(t, i):
                spans += [(i, 0, found[0])] * (found[1] >= 6)
                i = found[0]
            else:
                i += 1
        spans += [(a, 1, b) for a, b in runs(t, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20)]
        spans += [(a, 2, b) for a, b in runs(t, "", set("0123456789abcdef"), 24)]
        expected.append(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    out = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, e in enumerate(expected):
        assert out[i].base_sha256 == hashlib.sha256(e.encode()).hexdigest(), texts[i]
    random_value = "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY9"
    joined = [f"client_secret_key={random_value}", f"aws_secret_access_key={random_value}", f"secret_{random_value}", "secret_manager_configuration_handler_v2_default", f"x = {random_value}"]
    got = [r.spans for r in sorted(secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")).collect())]
    assert got == [f"novel:{len(t) - 40}:{len(t)}" for t in joined[:3]] + ["", ""]


def brute_near(texts, k, percent):
    sets = {}
    for i, (d, t) in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {d: d for d, _ in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (texts[i][0], texts[j][0]) and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(texts[i][0]), find(texts[j][0])
                top[max(a, b)] = min(a, b)
    return sorted(((d, len(sets[i]), find(d) if d is not None else None) for i, (d, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(docs, nothing, corpus, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    out = near_dedup.near_duplicates(docs, 4, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute_near(corpus, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    if block == 4:
        assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_long_complementary_words(spark):
    rows = [(i, " ".join(["one two three four", w])) for i, w in enumerate([thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")])]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(0, 1, 0), (1, 1, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 1)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_tokens(spark, docs, nothing, corpus):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    out = sorted(map(tuple, tokens.token_output(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    ids = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in corpus]
    assert collections.Counter((d, n, c) for d, _, n, c in out) == collections.Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    assert [r[0] for r in out] == sorted((r[0] for r in out), key=lambda d: (d is not None, d)) and [r[1] for r in out] == np.cumsum([0, *(r[2] for r in out)])[:-1].tolist()
    assert tokens.token_output(nothing, path).count() == 0


def test_tokens_of_one_hot_id(spark):
    """Rows of one doc_id, or without one, fill more than one shard, and starts go on from one to the next."""
    rng = random.Random(17)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(400)]
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    path, small = scratch.new_path(spark, "hot"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # else so few rows become one partition
    try:
        tokens.write_tokens(docs, queries.tokenizer_path(), path)
    finally:
        spark.conf.unset(small)
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", F.explode("doc_ids").alias("d"))
    assert all(r.n > 1 for r in blocks.groupBy("d").agg(F.countDistinct("shard").alias("n")).collect())
    out = sorted((r.start, r.n_tokens, r.doc_id is not None) for r in tokens.read_tokens(spark, path, "n", "long", len).collect())
    assert [s for s, _, _ in out] == np.cumsum([0, *(n for _, n, _ in out)])[:-1].tolist() and [k for *_, k in out] == sorted(k for *_, k in out) and len(out) == 400


def test_tokens_of_long_complementary_words(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")]
    got = {r.doc_id: r.ids_crc32 for r in tokens.token_output(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {i: zlib.crc32(np.array([*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_pretokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(4)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", " ", "1", "½", "中", "!", "a", "B", "​", "'s", "don't", "ſ", "Ⅷ", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["a<|endoftext|>b", None, ""]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert tokenizer.encode(text or "", add_special_tokens=False).ids == ids.tolist()


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:220] = x[0] + rng.normal(size=(120, 16)) * 0.02
    rows = [(i, v.tolist(), i % 2 if i % 7 else None) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, x[5].tolist(), 1), (None, x[5].tolist(), 1), (906, (x[5] * 3).tolist(), 1), (907, [1e300] * 16, 1)]
    assert len({r[0] for r in rows}) == len(rows)
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    links, top = collections.Counter(), {i: i for i in out}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    unit = lambda v: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())
    for a, (i, v, p) in enumerate(good):
        for j, w, q in good[:a]:
            if p == q and unit(v) @ unit(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                m, n = find(i), find(j)
                top[max(m, n)] = min(m, n)
    assert all((r.n_links, r.component_id) == (links[i], find(i)) for i, r in out.items())
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_of_a_dense_label(spark, kind, monkeypatch):
    """Thousands of vectors of one label near each other, copies and repeated ids; every link and group, and hardly a pair missed."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 256)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    x = centre + rng.normal(size=(1500, 32)) * 0.35
    x[1000:1400] = x[rng.integers(0, 1000, 400)] + rng.normal(size=(400, 32)) * 0.05
    x[1400:] = x[7]
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(3, x[7].tolist(), 1), (3, x[7].tolist(), 1)]
    out = embedding_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
    vectors = np.array([v for _, v, _ in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    assert 400 < linked.sum() and len(out) == len(rows)
    got, expected = collections.Counter(r.vec_id for r in out for _ in range(r.n_links)), collections.Counter(np.repeat([r[0] for r in rows], linked.sum(axis=1)).tolist())
    assert not got - expected and sum(got.values()) >= 0.99 * sum(expected.values())
    assert {r.component_id for r in out if r.vec_id == 3} == {3} and {r.component_id for r in out if r.vec_id == 1450} == {3}


def test_sql_of_operators(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf_dir)
        oracle = con.sql(sql)
        told = lambda rows, names: sorted(json.dumps(dict(zip(names, r, strict=True)), sort_keys=True, default=str) for r in rows)
        assert told([tuple(r) for r in df.collect()], df.columns) == told(oracle.fetchall(), oracle.columns), name
