import math
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.decontamination import clean, contaminated
from quire.llm.html_text import LAYOUTS, Tree, extract, labelled, main_text, trained
from quire.llm.language_id import held_out, identify
from quire.llm.media import feature, load, media_columns, store
from quire.llm.mixing import _quotas, apportion, mix, mixed, targets
from quire.llm.sharding import shard
from quire.llm.token_count import count_tokens, default_path, merges_in
from tests.llm.helpers import bag, docs, edited, prose, similarity, tokens

TEXTS = ["Don't stop 12 ΣΑΣ İstanbul", "", None, "   ", "a<|endoftext|>b <|ENDOFTEXT|>", "日本語 😀👍🏽 ok", "x" * 4000, "é é x\x1cy z\x85 a​b", "word " * 3000, "\x00 \x01\tq\r\n"]


# --- token counts -----------------------------------------------------------------------------------


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    assert count_tokens(docs(spark, {})).count() == 0


def test_merges():
    ranks = {("a", "b"): 0, ("ab", "c"): 2, ("b", "c"): 1, ("a", "a"): 3}
    assert merges_in(list("abc"), ranks) == 2
    assert merges_in(list("aabc"), ranks) == 2
    assert merges_in(list("aaaa"), ranks) == 2
    assert merges_in(["a"], ranks) == 0


# --- HTML -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class=site><a href=/>Home</a> Site title</header><div id="cookie-notice"><p>We use cookies. Lots of them, for all the pages here.</p></div>
<nav><ul><li><a href=a>One</a></li></ul></nav><main><h1>Big &amp; title</h1><!-- <p>gone</p> --><p>First   para&nbsp;here <b>bold</b>word &lt;x&gt;.<p>Second<br>line <a href=x>link</a> and more words follow here.
<div class="ad">Buy now this great thing</div><ul><li>one point</li><li>two points</li></ul><form><label>mail</label></form><blockquote>Quote here</blockquote></main>
<section id=comments><h2>Comments</h2><p>Great article, I love it so much, thank you</p></section><aside><p>Side bar</p></aside><footer>&copy; 2020 Firm</footer></body></html>"""


def test_html():
    assert main_text(PAGE) == "Big & title\n\nFirst para here boldword <x>.\n\nSecond line link and more words follow here.\n\none point\n\ntwo points\n\nQuote here"


def test_furniture_by_name():
    page = """<body class=has-sidebar><div class="layout with-sidebar"><article class=post><div class="entry-header"><h1>Title</h1></div><p>Some text of the article stands here.</p>
    <div class="share-buttons">Share this</div></article><section><article class="comment odd"><p>I like this very much, thank you all.</p></article></section><div id="main-sidebar">Side words here</div>
    <div style="display: none">Hidden words</div><p aria-hidden="true">Not read</p><div role=complementary>More words</div></div></body>"""
    assert main_text(page) == "Title\n\nSome text of the article stands here."


BODY = "<h1>Title here</h1><p>Some text of the article stands here, and it goes on for a good many words more.</p><p>A second part follows it, with words enough to be read as text by anyone who wants to.</p>"
TEXT = "Title here\n\nSome text of the article stands here, and it goes on for a good many words more.\n\nA second part follows it, with words enough to be read as text by anyone who wants to."
CARD = "<article class='comment'><p>I like this very much, thank you for all of it.</p></article>"
MENU = "<nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"{MENU}<div class='entry-content'>{BODY}</div><section id=comments>{CARD}{CARD}</section>",
        f"{MENU}<div class='entry-content'>{BODY}</div><article class='teaser'><a href=x>Read this too</a></article>",
        f"<form method=post action=/>{MENU}<div>{BODY}</div><footer>All of it</footer></form>",
        f"{MENU}<article class='post tag-social category-advertising'>{BODY}</article>",
        f"<div id='page' class='right-sidebar'>{MENU}<div>{BODY}</div><div class='sidebar'>Side words here</div></div>",
        f"<form><div id='page' class='right-sidebar'><article class='post category-advertising'>{BODY}</article>{CARD}</div></form>",
        f"{MENU}<article>{BODY}</article><section id=comments>{CARD * 40}</section>",
        f"{MENU}<article>{BODY}</article><form><p>Leave your name and mail here</p></form>",
    ],
)
def test_furniture_around_the_text(page):
    assert main_text(f"<body>{page}</body>") == TEXT


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<p>x</b></p></p>", "<!-- open", "<script>never closed", "<a href='x>y", "&amp &#x41; &unknown;", "<p><b>a<br><p>b" * 50])
def test_odd_html(page):
    assert isinstance(main_text(page), str)


def test_html_rows(spark):
    pages = spark.createDataFrame([(0, "u", PAGE, "t"), (1, None, None, "t"), (2, "v", "<article><p>One<br><p>Two", "t"), (2, "v", "<article><p>One<br><p>Two", "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract(pages).orderBy("page_id").collect()]
    assert got[1:] == [(1, "", 0), (2, "One\n\nTwo", 8), (2, "One\n\nTwo", 8)] and got[0][2] == len(got[0][1])
    assert extract(pages.limit(0)).count() == 0


#: Layouts that the tree has not seen, in the form of LAYOUTS.
HELD_OUT = """
<nav> / 0 li 2 2 / 0 li 1 1 / </nav><article> / 1 h1 6 0 / 1 p 48 1 / 1 li 3 3 / 1 li 5 5 / 1 p 2 0 / 0 div.ad 12 0 / 1 p 77 0 / </article> / 0 p 30 0 / 0 footer 9 1
<main> / 1 h1 5 0 / 1 p 15 0 / 1 p 64 20 / 0 form 6 0 / </main> / 0 div 40 3
0 div 19 1 / 0 li 1 1 / 0 li 1 1 / 0 li 2 2 / 1 h1 7 0 / 1 p 58 0 / 1 p 39 4 / 1 h2 3 0 / 1 p 71 0 / 1 p 47 2 / 0 li 4 4 / 0 li 6 6 / 0 li 5 5 / 0 p 8 4
0 a 1 1 / 0 a 2 2 / 1 h1 9 0 / 1 div 42 0 / 1 div 36 7 / 1 div 81 2 / 0 div.comments 22 0 / 0 div.comments 51 0
1 p 66 0 / 1 p 31 1
<div.sidebar> / 0 p 44 0 / </div><article> / 1 p 3 0 / 1 p 18 0 / </article>
"""


def test_held_out_layouts():
    x, y = labelled(HELD_OUT)
    right = trained().predict(x) == y
    rules = trained().rules()
    assert right.mean() >= 0.95 and all(name in rules for name in ("words <=", "words_after <=", "density <="))
    assert len(labelled()[1]) >= 150 and not {*HELD_OUT.split("\n")} & {*LAYOUTS.split("\n")} - {""}


def test_pages_without_names_or_article():
    text = "word " * 40
    page = f"<div>We use cookies on all of our pages, see <a href=x>the rules</a> for more.</div><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><h1>A title of some words</h1><p>{text}</p><p>{text}</p><p>{text}</p><ul><li><a>More of this</a><li><a>And more of that</a></ul>"
    assert main_text(page) == "\n\n".join(["A title of some words", *[text.strip()] * 3])


@pytest.mark.parametrize("part", ["<a '", "<a ='", '<a ="', "<b>", "<p>", "<", "</", "<x = ", "<li><b>", "<!--", "&"])
def test_hostile_pages_take_linear_time(part):
    start = time.process_time()
    main_text(part * (500_000 // len(part)) + "x" + "</i>" * 100_000)
    assert time.process_time() - start < 6


def test_very_long_page():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert main_text(f"<nav><a>x</a></nav><article><p>{words}</p></article>") == words


def test_tree():
    x = np.array([[0, 1], [1, 1], [0, 0], [1, 0]], float)
    y = np.array([0, 1, 0, 1])
    assert (Tree(x, y).predict(x) == y).all()
    assert Tree(x, np.ones(4)).predict(x).all()


# --- media ------------------------------------------------------------------------------------------


def test_media(spark):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in media_columns(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        stored = store(whole)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), feature(load(stored)))
    assert got[1].feature == got[2].feature
    assert media_columns(docs(spark, {})).count() == 0


# --- mixing -----------------------------------------------------------------------------------------


def test_targets():
    got = targets([("b", 100), ("a", 10), (None, 1000)])
    assert got == {"a": 20, "b": 200, None: Fraction(1665 - 220)}
    assert sum(got.values()) == Fraction(3, 2) * 1110
    assert targets([("a", 0)]) == {"a": 0}


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, prose(5 + i * 7 % 60, i), ["b", "a", None, "é"][i % 4 if i % 3 else 0]) for i in range(400)] + [(1000, None, "a"), (1001, "", "b"), (1002, "one two", "new")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))


@pytest.mark.parametrize("shard_docs", [16, 2048])
def test_mix(sources, shard_docs):
    rows = mix(sources, shard_docs=shard_docs).collect()
    again = mix(sources, shard_docs=shard_docs).collect()
    assert sorted(rows) == sorted(again) and len(rows) == sources.count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 2 * r.size
    goal = targets(list(sizes.items()))
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size} and own[0].target == float(goal[s])
        assert abs(sum(r.taken for r in own) - own[0].target) <= 16 * (1 + len(own) / shard_docs * 2)


def highest_quotients(votes, seats):
    """The plain loop."""
    out = [0] * len(votes)
    for _ in range(seats):
        out[max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * out[i] + 1), -i))] += 1
    return out


DEALS = [([20000] + [100] * 8, 130), ([1000000] + [400] * 5, 1002), ([7, 7, 7], 5), ([1], 9), ([0, 3, 0], 4), ([5, 3, 1] * 30, 17), ([10**6 + i * i for i in range(40)], 333), ([3, 3], 0)]


@pytest.mark.parametrize("votes,seats", DEALS)
def test_apportionment(votes, seats):
    assert apportion([Fraction(v) for v in votes], seats) == highest_quotients(votes, seats)


def test_quotas_of_shards(spark):
    rows = [(str(k), i, v, sum(votes), seats, len(votes)) for k, (votes, seats) in enumerate(DEALS) for i, v in enumerate(votes)]
    keyed = spark.createDataFrame(rows, "source string, shard long, size long, source_size long, blocks long, shards long")
    got = {(r.q_source, r.q_shard): r.quota for r in _quotas(keyed, 10**6, 16).collect()}
    want = {(str(k), i): min(16 * n, votes[i] * 10**6) for k, (votes, seats) in enumerate(DEALS) for i, n in enumerate(highest_quotients(votes, seats))}
    assert got == want


def test_mixed(sources):
    got = mixed(sources)
    counts = Counter(r.doc_id for r in got.collect())
    assert got.columns == sources.columns and max(counts.values()) <= 2 and 1000 not in counts


def test_mix_of_odd_tables(spark, sources):
    assert mix(sources.limit(0)).count() == 0
    twice = sources.where("doc_id < 8").unionByName(sources.where("doc_id < 8"))
    assert mix(twice).count() == 16


# --- sharding ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [500, 3000, 10**6])
def test_shards(spark, limit):
    texts = {i: prose(5 + i % 50, i) for i in range(300)} | {999: None, 1000: "x" * 5000}
    rows = shard(docs(spark, texts), limit).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard_id] += r.n_bytes
    assert len(rows) == len(texts)
    ids = sorted({r.shard_id for r in rows if "-" not in r.shard_id})
    assert not any(b != a and b.startswith(a) for a in ids for b in ids)
    for r in rows:
        assert r.shard_bytes == sums[r.shard_id] and r.fits == (r.shard_bytes <= limit)
        assert r.fits or r.n_bytes == r.shard_bytes > limit


def test_only_oversized_buckets_split(spark):
    rows = shard(docs(spark, {i: "x" * 100 for i in range(200)}), 1000).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard_id] += r.n_bytes
    for r in rows:
        sibling = r.shard_id[:-1]
        assert sum(n for s, n in sums.items() if s.startswith(sibling)) > 1000


def test_shards_of_odd_tables(spark):
    assert shard(docs(spark, {})).count() == 0
    same = docs(spark, {1: "x" * 100})
    for _ in range(4):
        same = same.unionByName(same)
    rows = shard(same, 500).collect()
    assert len(rows) == 16 and all(r.fits for r in rows) and len({r.shard_id for r in rows}) > 1
    assert shard(docs(spark, {None: "a", 1: "b"}), 10).count() == 2


# --- decontamination --------------------------------------------------------------------------------


def best_windows(texts, items):
    out = {}
    for i, t in texts.items():
        b = bag(tokens(t))
        for j, item in items.items():
            w = tokens(item)
            k = bag(w)
            mine = bag(tokens(t), len(w)) if 0 < len(w) < 5 else b
            n = min(len(k), len(mine))
            best = None
            for p in range(len(mine) - n + 1) if n else ():
                common, union = similarity(mine[p : p + n], k)
                if 100 * common >= 75 * union and (best is None or common * best[1] > best[0] * union):
                    best = (common, union, p)
            if best:
                out[i, j] = (best[0] / best[1], best[2])
    return out


def test_contaminated(spark):
    items = {j: prose(n, 50 + j) for j, n in enumerate((14, 20, 33, 60, 6, 5))} | {6: "three short words", 7: None, 8: "", 9: "the the the the the the the the the"}
    items[10] = items[3]
    texts = {i: prose(80, i) + " " + (items[i % 6] if i % 2 else edited(items[i % 6], 30, i)).upper() + "\n" + prose(40, i + 500) for i in range(24)}
    texts |= {100: items[2], 101: " ".join(items[2].split(" ")[:29]), 102: "x Three  short words y", 103: None, 104: "", 105: "the " * 9, 106: "the " * 40, 107: prose(200, 7), 108: edited(items[3], 8), 109: " ".join(reversed(items[3].split(" ")))}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in contaminated(docs(spark, texts), bench).collect()}
    assert got == best_windows(texts, items) and len(got) > 20
    left = clean(docs(spark, texts), bench)
    assert left.columns == docs(spark, {}).columns
    assert {r.doc_id for r in left.collect()} == set(texts) - {i for i, _ in got}


def test_items_in_several_blocks(spark, monkeypatch):
    import quire.llm.decontamination as D

    monkeypatch.setattr(D.item_blocks, "__defaults__", (300,))
    items = {j: prose(20, j) for j in range(12)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = {j: prose(30, j + 100) + " " + items[j] for j in items}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench).collect()}
    assert got == {(j, j) for j in items}
    assert clean(docs(spark, texts), bench).count() == 0


def test_contamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contaminated(docs(spark, {}), bench).count() == 0
    assert contaminated(docs(spark, {1: "a b c d e f g"}), bench.limit(0)).count() == 0
    assert contaminated(docs(spark, {1: "a b c d e f g"}).unionByName(docs(spark, {1: "a b c d e f g"})), bench).count() == 2


# --- language ---------------------------------------------------------------------------------------


def test_languages(spark):
    from tests.conftest import DATA

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    d = d.unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 %%", "en", "s", 5), (10**6 + 2, "", None, "s", 0), (10**6 + 3, "Ж", None, "s", 1)], d.schema))
    got = identify(d.withColumn("score", F.lit("clash")))
    rows = got.collect()
    assert len(rows) == d.count()
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (10**6, 10**6 + 1, 10**6 + 2):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "fr", "de", "es")
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in identify(d).collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in rows)


def test_held_out_labels_do_not_matter(spark):
    from tests.conftest import DATA

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    changed = d.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    pick = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in identify(df).collect())
    assert pick(d) == pick(changed)


def test_languages_of_odd_tables(spark):
    assert identify(docs(spark, {})).count() == 0
    got = identify(docs(spark, {1: "some words"}, lang=None)).first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)
    assert not math.isnan(identify(docs(spark, {k: "same text" for k in range(30)})).first().score)


def test_junk_and_unlearned_languages_are_rejected_by_distance(spark):
    import random
    import string

    from tests.conftest import DATA

    r = random.Random(5)
    junk = ["".join(r.choice(letters) for _ in range(n)) for letters in (string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits + "+/") for n in (300, 1000, 4000) for _ in range(5)]
    junk += [" ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(2, 9))) for _ in range(200)) for _ in range(5)]
    junk += [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    ]
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = [(x.text, x.lang) for x in d.where("lang is not null and length(text) > 400").orderBy("doc_id").limit(60).collect()]
    short = [(" ".join(t.split()[at : at + n]), lang) for t, lang in clean for at, n in ((3, 4), (10, 12), (20, 30))]
    extra = [(10**6 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)] + [(2 * 10**6 + i, t, None, "short", len(t)) for i, (t, _) in enumerate(short)]
    got = identify(d.unionByName(spark.createDataFrame(extra, d.schema))).collect()
    assert all(x.rejected for x in got if x.source == "junk")
    assert sum(x.rejected for x in got if x.source == "short") <= 0.1 * len(short)
    assert sum(x.rejected for x in got if x.doc_id < 10**6) <= 0.1 * d.count()
