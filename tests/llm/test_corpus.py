"""The ten operators and the pipeline on small tables: brute force, and nulls, empties, repeats and ties."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL, normal
from weftline.llm import decontaminate, html, langid, licences, linededup, lm, mixing, simhash, topk, toxicity, vptree
from weftline.llm.covertree import LEAF, Best, cover_tree, dual_search
from weftline.llm.queries import ORACLES, QUERIES
from weftline.llm.wrapper import add_page, choose, fold, merge, pack, read, size, texts_of, unpack

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, key string, id int"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns of clashing names."""
    full = [(i, t, l, s, len(t or ""), 1, 0.5, "k", 2) for i, t, l, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "fr", "b"), (4, "one", "fr", "b"), (5, "word " * 30_000, "en", "a"), (None, "no id here", "en", "c"), (7, "one", "fr", "b"), (8, "\x00 \U0001f600 é", None, "")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, SMALL).toPandas()) == normal(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    n = QUERIES[name](spark, SMALL).count()
    table = "pages" if name.startswith("op5") else "documents"
    assert n == spark.read.parquet(f"{SMALL}/{table}.parquet").count() or (name.startswith("op10") and n > 0)


# 1 language


def test_language_held_out_accuracy_and_rejection(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(d, usable=langid.id_split("doc_id", 5) != 0)
    got = langid.identify(d.where(langid.id_split("doc_id", 5) == 0), model).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.rejected.mean() < 0.01
    best, score, rejected = model.predict(["Привет как дела", "123 ...", None, "the and of", ""])
    assert list(best >= 0) == [True, False, False, True, False] and list(rejected) == [True, True, True, False, True]
    assert (score[[1, 2, 4]] == 0).all()
    unseen = ["Questa mattina abbiamo camminato lungo il fiume fino alla piazza del mercato", "Jutros smo hodali uz rijeku sve do gradske tržnice i popili kavu", "Tänä aamuna kävelimme joen vartta kauppatorille ja joimme kahvia", "Bu sabah nehir boyunca yürüyüp pazar yerine kadar gittik", "xkq zzv qqp wvx jjk", "asdfgh qwerty zxcvbn"]
    assert model.predict(unseen)[2].all()


def test_language_odd_rows(spark):
    d = docs(spark, ODD + [(20 + i, w, l, "s") for i, (w, l) in enumerate([("le la les des", "fr"), ("the of and to", "en")] * 20)])
    model = langid.fit_languages(d)
    out = langid.identify(d, model).toPandas()
    assert len(out) == len(ODD) + 40 and set(out[out.doc_id.isin([1, 2, 3])].lang_pred) == {"und"}
    assert (out[out.doc_id == 4].lang_pred.nunique()) == 1 and "score" in out
    assert langid.accepted(docs(spark, [])).count() == 0 and langid.accepted(docs(spark, [(1, "no label", None, "s")])).count() == 1


def test_language_logits_are_means_of_embeddings():
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]))

    def plain(text):
        total, n, padded = np.zeros(2), 0, [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0]
        for k in langid.ORDERS:
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if not any(g) or 0 in g[1:-1] or (k > 2 and not any(g)):
                    continue
                h = k
                for c in g:
                    h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
                    h ^= h >> 15
                total += model.scores[h & (langid.BUCKETS - 1)]
                n += 1
        return total / max(n, 1) + model.bias

    for text in ("ab", "one two", "É, zwei!  drei", "x"):
        assert np.allclose(model.logits([text])[0][0], plain(text), atol=1e-5), text


def test_every_language_is_learnt(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}o " * 5, f"l{i % 300}", "s") for i in range(600)]
    assert len(langid.fit_languages(docs(spark, rows)).languages) == 300
    assert langid.identify(docs(spark, ODD), None).where("rejected").count() == len(ODD)


# 2 mixing


def fill(sizes, weights, total):
    targets, capped = {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            return level | {s: 2 * sizes[s] for s in capped}
        capped |= set(over)


def test_mixing_brute_force(spark):
    rng = random.Random(2)
    rows = [(100 + i, "w " * rng.randrange(1, 40), "en", rng.choice(["a", "b", "B", "é", "z", None])) for i in range(400)] + ODD
    got = mixing.mix(docs(spark, rows)).toPandas()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    by_id = {i: s for i, _, _, s in rows}
    for r in got.itertuples():
        s = by_id[None if math.isnan(r.doc_id) else int(r.doc_id)]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 2 * r.size and r.taken == r.copies * r.size
    again = mixing.mix(docs(spark, rows)).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None, None, None)])).first()["taken"] == 0
    made = mixing.mixed_documents(docs(spark, rows))
    assert made.count() == got.copies.sum() and made.columns == [*docs(spark, []).columns, "copy"]
    clash = docs(spark, rows).withColumns({"copy": F.lit("x"), "whole": F.lit(1), "n": F.lit(2), "Low": F.lit(3)})
    out = simhash.materialise(mixing.mixed_documents(clash))
    assert out.count() == made.count() and sorted(out.columns) == sorted(clash.columns) and out.where("n <> 2 or copy < 1").count() == 0


def test_mixing_meets_its_targets_and_draws_fairly(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), "en", f"s{i % 5}" if i % 3 else "hot") for i in range(900)]
    largest = max(len(t) // 2 for _, t, *_ in rows)
    extra = []
    for seed in ("one", "two"):
        got = mixing.mix(docs(spark, rows), seed=seed).toPandas()
        for (size, target), part in got.groupby(["source_size", "target"]):
            assert abs(part.taken.sum() - target) <= largest, (size, target)
        rate = got.target / got.source_size
        assert ((got.copies - np.floor(rate)).isin([0, 1])).all()
        some = (rate % 1 > 0.1) & (rate % 1 < 0.9)
        extra.append(set(got[some & (got.copies > rate)].doc_id))
        assert some.sum() > 100 and abs((got.copies > rate)[some].mean() - (rate % 1)[some].mean()) < 0.1
    assert extra[0] != extra[1]


# 3 language model


def test_lm_base_and_normalisation(spark):
    rng = random.Random(1)
    rows = [(100 + i, " ".join(rng.choice(["the", "of", "Cat", "dog", f"x{rng.randrange(99)}ing"]) for _ in range(rng.randrange(30))), None, None) for i in range(60)] + ODD
    got = lm.language_scores(docs(spark, rows), lm.id_split("doc_id", 7) != 2).toPandas()
    c = Counter()
    token = lambda t: (t or "").encode().lower().split() + [None]
    for i, t, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            c.update(token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(token(t)), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in token(t)), 6)) for _, t, *_ in rows)
    assert sorted((r.n_tokens, round(r.base_score, 6)) for r in got.itertuples()) == want
    assert (got.train_tokens == n).all() and (got.score <= 0).all()
    p = 10 ** lm.train(np.array([5, 700, 9000]), np.array([3, 2, 8])).astype(np.float64)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    none = lm.language_scores(docs(spark, ODD), F.lit(False)).toPandas()
    assert (none.n_known == 0).all() and (none.train_tokens == 0).all()


def test_lm_beats_its_base(spark):
    got = lm.op3_lm(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


# 4 SimHash


def brute_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_simhash_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(2)):
                t[rng.randrange(len(t))] = "Changed"
            texts.append(" ".join(t))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts + ["", None, "  ", "long word " * 20_000])]
    got = simhash.simhash_groups(docs(spark, rows)).toPandas()
    fp = {i: brute_fingerprint(t, 3) for i, t, *_ in rows}
    want = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {int(r.id): int.from_bytes(bytes(r.fp), "big") for r in got.itertuples()} == fp
    assert {int(r.id): int(r.component) for r in got.itertuples()} == want
    odd = simhash.simhash_groups(docs(spark, ODD)).toPandas()
    assert len(odd) == len(ODD) and odd[odd.id == 7].component.iloc[0] == 4 and simhash.simhash_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_vantage_point_shards_lose_no_pair(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(20))]))[:, None]
    nodes = vptree.build(rows[::5], 4)
    who, leaf, home = vptree.route(nodes, rows, radius)
    assert np.bincount(who[home], minlength=len(rows)).tolist() == [1] * len(rows)
    forest = vptree.Forest(len(rows))
    for at in np.unique(leaf):
        mine, seen = who[(leaf == at) & home], who[(leaf == at) & ~home]
        order = np.concatenate([mine, seen])
        local = vptree.Forest(len(order))
        vptree.link(rows[mine], rows[order], radius, radius, local)
        root = local.roots(np.arange(len(order)))
        forest.join(order, order[root])
    want = components(range(len(rows)), lambda a, b: (int(rows[a, 0]) ^ int(rows[b, 0])).bit_count() <= radius)
    assert dict(enumerate(forest.roots(np.arange(len(rows))).tolist())) == want


def test_near_duplicate_stage(spark):
    rng = random.Random(9)
    rows, group = [], {}
    for g in range(15):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(300)]
        for k in range(4):
            t = list(base)
            if k >= 2:
                t[rng.randrange(300)] = f"edit{g}{k}"
            rows.append((len(rows), " ".join(t), "en", "s"))
            group[len(rows) - 1] = g
    kept = [r.doc_id for r in simhash.without_near_duplicates(docs(spark, rows)).collect()]
    assert sorted(kept) == [4 * g for g in range(15)]
    repeated = docs(spark, [*rows[:1], *rows[:1], *ODD])
    out = simhash.without_near_duplicates(repeated)
    assert out.columns == repeated.columns and Counter(r.doc_id for r in out.collect())[0] == 1
    one, two = rows[0][1], rows[5][1]
    mixed = docs(spark, [(1, one, "en", "s"), (2, one, "en", "s"), (2, two, "en", "s"), (2, two, "en", "s"), (3, two, "en", "s"), (None, one, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")])
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.without_near_duplicates(mixed).collect())
    assert kept == sorted([(0, one), (1, one), (2, two), (4, "")])


def jaccard(a, b, size=5):
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicate_stage_at_the_threshold(spark, monkeypatch):
    rng, made = random.Random(12), itertools.count()
    new = lambda n: [f"n{next(made)}" for _ in range(n)]
    texts = []
    for own in range(14, 25):  # 160 shared shingles and own ones: similarity 0.77 to 0.85
        base = new(164)
        texts += [base + new(own), base + new(own)]
    for n in [8, 9, 10, 11, 12] * 6:  # short texts and one or two words more
        base = new(n)
        texts += [base, base + new(1), base[1:], base + new(2)]
    loop = new(7)
    texts += [loop * 40, loop * 50, loop * 40 + new(1), loop * 40 + new(3), loop * 40 + new(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    want = components(range(len(rows)), lambda a, b: jaccard(rows[a][1], rows[b][1]) >= 0.8)
    assert 20 < len(set(want.values())) < len(rows)
    for block in (simhash.BLOCK, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.near_duplicate_ids(docs(spark, rows)).collect()
        assert {r.id: r.component for r in got} == want


# 5 HTML

PAGE = "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul>{menu}</ul></nav><div class='ad'>buy {ad}</div><article><h1>{title}</h1>{body}</article><div id=comments><p>nice</p></div><footer>&copy; us</footer></body></html>"


def test_html_article_and_odd_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(menu="<li>m</li>" * (i % 4 + 1), ad=i, title=f"A&amp;{i}", body="<p>x <b>bo</b>ld<br>y<p>z\n\t w" * (i % 3 + 1))) for i in range(9)]
    rows += [(20, None, None), (21, "no host", ""), (22, "http://h.example/z", "a < b & c"), (23, "http://q.example", "<p>open <b>tags<p>two"), (0, "http://h.example/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages).collect()}
    for i in range(9):
        want = f"A&{i} " + " ".join(["x bold y z w"] * (i % 3 + 1))
        assert got[i] == (want, len(want))
    assert got[20] == ("", 0) and got[21] == ("", 0) and got[22][0] == "a < b & c" and got[23][0] == "open tags two"
    assert html.main_text(pages.limit(0)).count() == 0


def test_wrapper_finds_template_text_without_marks(spark):
    page = "<div><p>Always here</p></div><div><p>{}</p><p>{} more</p></div><div><p>Bottom line</p></div>"
    pages = spark.createDataFrame([(i, f"http://plain.example/{i}", page.format(f"t{i}", i)) for i in range(5)], "page_id long, url string, html string")
    assert sorted(r.text for r in html.main_text(pages).collect()) == [f"t{i} {i} more" for i in range(5)]
    assert sorted(r.text for r in html.main_text(pages, by_shuffle=True).collect()) == [f"t{i} {i} more" for i in range(5)]
    # on two pages nothing can be told from the template, unless a parameter says so
    two = pages.where("page_id < 2")
    assert {r.text for r in html.main_text(two, template_pages=2).collect()} == {"t0 0 more", "t1 1 more"}
    assert all("Always here" in r.text for r in html.main_text(two).collect())


def own_article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", "\n"))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return " ".join(b for b in blocks if b)


def unmarked(page, rename=""):
    """The page without class names (or with one of its own) and with elements that say nothing of their role."""
    return re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", re.sub(r' class="[^"]*"', rename, page))


@pytest.mark.parametrize("change", ["as it is", "class names gone", "class names renamed", "roles gone"])
def test_html_of_the_fixture_pages(spark, change):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    make = {"as it is": lambda p, i: p, "class names gone": lambda p, i: re.sub(r' class="[^"]*"', "", p), "class names renamed": lambda p, i: re.sub(r' class="[^"]*"', f" class='k{i % 7}x'", p), "roles gone": lambda p, i: unmarked(p)}[change]
    pages = spark.createDataFrame([(r.page_id, r.url, make(r.html, r.page_id)) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert got == {r.page_id: own_article(r.html) for r in rows}


def test_html_needs_its_wrapper(spark, monkeypatch):
    """Without what the wrapper says, pages whose marks say nothing come out with menu, advert and footer."""
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()
    plain = [(r.page_id, unmarked(r.html)) for r in rows]
    ignored = {i: " ".join(t.value for k in read(p).kids for t in texts_of(k)) for i, p in plain}
    wrong = [r.page_id for r in rows if ignored[r.page_id] != own_article(r.html)]
    assert len(wrong) == len(rows)


def test_html_teasers_notices_and_short_articles(spark):
    page = "<body><div><a href=1>One</a><a href=2>Two</a></div><div><p>Shared notice of this site.</p><h1>T {i}</h1><p>{text}</p><p class=ad>Buy {i}</p></div><article><p>Tease {i}</p></article><article><p>Other {i}</p></article><div><ul><li><a>more {i}</a><li><a>and {i}</a></ul></div></body>"
    rows = [(i, f"http://t.example/{i}", page.format(i=i, text=f"prose {i} " * (40 if i else 1))) for i in range(6)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T {i} " + (f"prose {i} " * (40 if i else 1)).strip() for i in range(6)}


def test_html_of_malformed_and_long_pages_in_linear_time():
    began = time.time()
    for page in ("<a " + '"' * 100_001, "<a " * 30_000 + '"', '<a ">"' * 50_000, "<" * 100_000, "</" * 50_000, "<div>" * 50_000 + "deep", "<!--" * 40_000, "<p>x" * 40_000, "<ul>" + "<li>x" * 40_000, "".join(f"<div id=i{i} class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>x</div>" for i in range(20_000))):
        html.article(page, None)
    assert time.time() - began < 12
    assert html.article("<div>" * 500 + "deep" + "</div>" * 500 + "after", None) == "deep after"
    assert html.article('<p title="x>y">one</p><p title="never closed>two', None) == "one two" and html.article('<p>a<b title=">">c</b>', None) == "ac"


def test_wrappers_are_bounded_whatever_the_pages():
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))

    def some(depth):
        return "".join(f"<div class={name()}>{some(depth - 1) if depth else name()}</div>" for _ in range(rng.randrange(1, 5)))

    whole = None
    for _ in range(150):
        whole = add_page(whole, fold(read(some(4))))
    assert size(whole) <= 4_096 and whole.pages == 150
    assert "needle" in html.article("<div class=zzzz>needle</div>", choose(whole))


def test_wrapper_alignment():
    one, two = fold(read("<ul><li>a<li>b</ul><p>x</p>")), fold(read("<ul><li>c</ul><h2>t</h2><p>x</p>"))
    w = merge(one, two)
    assert [(x.node.tag, x.least, x.most) for x in w.items] == [("ul", 1, 1), ("h2", 0, 1), ("p", 1, 1)]
    assert [(x.node.tag, x.least, x.most) for x in w.items[0].node.items] == [("li", 1, 2)]
    assert pack(unpack(pack(w))) == pack(w)
    again = merge(merge(w, two), two)
    assert [x.key for x in again.items] == [x.key for x in w.items] and again.pages == 4
    pairs = fold(read("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert [(x.node.tag, x.least, x.most) for x in pairs.items[0].node.items] == [("(", 1, 3)]
    single = merge(pairs, fold(read("<dl><dt>a<dd>b</dl>")))
    assert [(x.node.tag, x.least, x.most) for x in single.items[0].node.items] == [("(", 1, 3)]


# 6 licences


def test_licences_and_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [("r/LICENSE", mit), ("r/a/b/x.txt", "nothing at all"), ("r/a/y.txt", "some words before\nLicensed under CC BY-NC 4.0.\nand after " + "word " * 200), ("r/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("q/z.txt", "none"), ("r/empty", ""), ("r/null", None), (None, mit), ("top", "x"), ("r/long", "word " * 30_000 + "\n" + mit), ("r/LICENSE", mit)]
    got = {r.path: (r.licence, r.licence_file, r.inherited) for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["r/LICENSE"] == ("MIT", True, False) and got["r/a/b/x.txt"] == ("GPL-3.0", False, True) and got["r/a/y.txt"] == ("CC-BY-NC-4.0", False, False)
    assert got["q/z.txt"] == (None, False, False) and got["r/empty"] == ("MIT", False, True) and got["r/null"][0] == "MIT" and got[None][0] == "MIT" and got["top"][0] is None and got["r/long"] == ("MIT", False, False)
    assert licences.scan_licences(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licences_full_texts_and_long_lines(spark):
    rest = "\n".join(f"further terms of the text {i} that nobody reads" for i in range(300))
    mit = 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\n' + rest
    gpl = "\n".join(["This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation; either version {} of the License, or", rest])
    inside = "word " * 500 + "Licensed under CC BY 4.0. " + "word " * 500
    rows = [("m/LICENSE", mit), ("m/a/x.c", "none"), ("g/COPYING.txt", gpl.format(2)), ("g/x.c", "none"), ("h/COPYING", gpl.format(3)), ("n/notes.txt", mit), ("n/x.c", "none"), ("l/x.txt", inside), ("e/LICENSE", "no terms"), ("e/x.c", "none")]
    got = {r.path: (r.licence, r.licence_file, r.inherited) for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["m/LICENSE"] == ("MIT", True, False) and got["m/a/x.c"] == ("MIT", False, True)
    assert got["g/COPYING.txt"] == ("GPL-2.0", True, False) and got["g/x.c"] == ("GPL-2.0", False, True) and got["h/COPYING"][0] == "GPL-3.0"
    assert got["n/notes.txt"] == ("MIT", False, False) and got["n/x.c"][0] is None
    assert got["l/x.txt"] == ("CC-BY-4.0", False, False) and got["e/LICENSE"][:2] == (None, False) and got["e/x.c"][0] is None


# 7 lines


def test_lines_both_ways_and_near_the_threshold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lines = [f"own {i}"] + [f"shared {rng.randrange(30)}" for _ in range(3)] + ["  padded  ", ""]
        rows.append((100 + i, "\n".join(lines), "en", f"s{rng.randrange(14)}" if i % 50 else None))
    rows += ODD
    d = docs(spark, rows).drop("size", "score")
    want_sites = {}
    for _, t, _, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" ") and s is not None:
                want_sites.setdefault(x.strip(" "), set()).add(s)
    bad = {x for x, s in want_sites.items() if len(s) >= 10}
    order = sorted((i, p, x.strip(" ")) for i, t, *_ in rows if i is not None for p, x in enumerate((t or "").split("\n")) if x.strip(" "))
    first = {}
    for i, p, x in order:
        first.setdefault(x, (i, p))
    want = Counter()
    for i, t, *_ in rows:
        want[i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if x.strip(" ") not in bad or first.get(x.strip(" ")) == (i, p))] += 1
    for by_shuffle in (False, True):
        out = linededup.dedup_lines(d, by_shuffle=by_shuffle)
        assert Counter((r.doc_id, r.text) for r in out.collect()) == want and len(bad) > 0
    cut = linededup.without_boilerplate(docs(spark, rows))
    assert cut.columns == docs(spark, []).columns and cut.where("n_chars <> char_length(text)").count() == 0
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


# 8 top k


def test_topk_brute_force_with_ties(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (150, 6)) / 8.0
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] * 6), (241, [float("inf")] * 6), (None, [1.0] * 6), (150, [9.0, 9.0]), (60, [float(v) for v in x[60]])]
    got = topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7).collect()
    v = [(i, np.floor(64 * np.array(r + [0.0] * (6 - len(r))))) for i, r in rows if i is not None and r is not None and None not in r and np.isfinite(r).all()]
    want = []
    for q, qv in {i: r for i, r in v if i % 20 == 0}.items():
        best = sorted((-int(qv @ r), i) for i, r in v if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = topk.top_inner_products(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    assert len(few) == 2 and topk.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def nodes_of(node):
    yield node
    for c in node.kids:
        yield from nodes_of(c)


@pytest.mark.parametrize("spread", [1, 30])
def test_cover_tree_levels_cover_nest_and_part(spread):
    rng = np.random.default_rng(spread)
    x = np.rint(np.concatenate([rng.normal(c, spread, (150, 6)) for c in rng.normal(0, 60, (12, 6))]))
    x = np.concatenate([x, x[:40], x[:1].repeat(50, axis=0)])
    tree = cover_tree(x)
    assert sorted(tree.members.tolist()) == list(range(len(x)))
    for node in nodes_of(tree):
        away = np.sqrt(((x[node.members] - node.centre) ** 2).sum(axis=1))
        assert np.isclose(away.max(), node.radius) and node.radius <= 2.0**node.level and (x[node.row] == node.centre).all()
        if node.leaf:
            assert node.n <= LEAF or node.radius == 0
            continue
        child = [c.row for c in node.kids] + node.loose.tolist()
        assert node.row in child and all(c.radius <= 2.0 ** (node.level - 1) for c in node.kids)
        apart = np.sqrt(((x[child][:, None] - x[child][None]) ** 2).sum(axis=2))[np.triu_indices(len(child), 1)]
        assert (apart > 2.0 ** (node.level - 1)).all()


def test_dual_search_prunes_exactly():
    """At the settings of production: tight clusters leave most pairs unscored, and nothing is lost."""
    rng = np.random.default_rng(1)
    d = np.rint(np.concatenate([rng.normal(c, 3, (160, 16)) for c in rng.normal(0, 60, (25, 16))]))
    ids = np.arange(len(d))
    q = d[::20]
    best = Best(len(q), 20)
    for s in range(0, len(d), topk.ROWS):
        dual_search(cover_tree(q), q, ids[::20], cover_tree(d[s : s + topk.ROWS]), d[s : s + topk.ROWS], ids[s : s + topk.ROWS], best)
    assert best.scored < 0.25 * len(q) * len(d)
    for row, i in enumerate(ids[::20]):
        s = d @ q[row]
        want = sorted((-int(s[j]), int(j)) for j in ids if j != i)[:20]
        assert [(-int(a), int(b)) for a, b in zip(best.scores[row], best.ids[row])] == want


def test_topk_in_several_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.normal(size=5)]) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = topk.top_inner_products(d, k=4, every=5), topk.top_inner_products(d, k=4, every=5, block=17)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 320


# 9 toxicity


def test_toxicity_held_out_and_pairs(spark):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1200):
        kind = i % 6
        extra = {0: ["vile"], 1: ["dull", "gang"], 2: ["dull"], 3: ["gang"]}.get(kind, [])
        rows.append((i, " ".join(rng.sample(common, 12) + extra), "en", "s"))
        labels.append((i, int(kind in (0, 1))))
    lab = spark.createDataFrame(labels + [(5000, 1), (1, None)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs(spark, rows), lab, usable=langid.id_split("doc_id", 4) != 2)
    out = toxicity.score_toxicity(docs(spark, rows + ODD), machine, score_name="s").toPandas()
    held = out[(out.doc_id < 1200) & out.doc_id.notna() & (out.lang == "en")]
    held = held[[zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id]]
    truth = [int(i) % 6 in (0, 1) for i in held.doc_id]
    assert ((held.s >= 0.3) == truth).mean() > 0.95 and out.s.between(0, 1).all() and len(out) == len(rows) + len(ODD)
    assert toxicity.fit_toxicity(docs(spark, rows), lab.limit(0)) is None
    assert toxicity.score_toxicity(docs(spark, ODD), None).where("score = 0").count() == len(ODD)


def test_toxicity_of_terms_that_matter_only_together(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    # of the rows with either word half are toxic, and so are half of those with neither
    rows = [(i, " ".join(rng.sample(common, 10) + {0: ["dull", "gang"], 1: ["dull"], 2: ["gang"], 3: []}[i % 4]), "en", "s") for i in range(4000)]
    lab = spark.createDataFrame([(i, int(i % 4 in (0, 3))) for i in range(4000)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs(spark, rows), lab, usable=F.col("doc_id") < 3000)
    out = toxicity.score_toxicity(docs(spark, rows), machine, score_name="s").where("doc_id >= 3000").toPandas()
    assert ((out.s >= 0.5) == (out.doc_id % 4).isin([0, 3])).mean() > 0.99


def test_toxicity_scores_are_the_machines_sum():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine({}, -0.3, rng.normal(size=50), rng.normal(size=(50, toxicity.WIDTH)))
    rows = [rng.choice(50, n, replace=False) for n in (0, 1, 7, 0, 30)] + [np.empty(0, np.int64)]
    for r, got in zip(rows, machine.score(rows)):
        z = -0.3 + sum(machine.weights[i] for i in r) + sum(machine.vectors[i] @ machine.vectors[j] for i, j in itertools.combinations(r, 2))
        assert abs(got - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    assert len(machine.score([])) == 0


@pytest.mark.parametrize("labels", [[(1, 1), (2, 0), (3, 0)], [(1, 0), (2, 0), (3, 0)], [(1, 1), (2, 1)], [(1, 1), (1, 0), (2, 0)], [(9, 1)], [(3, 1)]])
def test_toxicity_with_hardly_a_label(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs(spark, ODD), lab)
    out = toxicity.score_toxicity(docs(spark, ODD), machine, score_name="s").toPandas()
    assert len(out) == len(ODD) and out.s.between(0, 1).all() and (machine is None) == (labels == [(9, 1)])


# 10 decontamination


def edits(a, b):
    """Least edits of ``a`` against any stretch of ``b``."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for ch in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def whole_edits(a, b):
    """Edits between two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain(text):
    codes, _, _ = decontaminate.normalise([text])
    return "".join(map(chr, codes[:-1].tolist()))


def test_decontamination_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 25)))) for i in range(12)] + [(50, ""), (51, None), (52, "tiny"), (53, None)]
    texts = [None, "", "a tiny thing", "atinything"]
    for i, t in items[:12]:
        for e in range(0, len(t) // 6, 3):
            s = list(t)
            for _ in range(e):
                at = rng.randrange(len(s))
                s[at : at + 1] = rng.choice([["z"], [], [s[at], "y"]])
            texts.append(" ".join(word() for _ in range(30)) + ".\n" + "".join(s).upper().replace(" ", ",  ") + "!\n" + " ".join(word() for _ in range(20)))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(4, texts[4], "en", "s")]
    got = decontaminate.contaminations(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = Counter()
    for i, t, *_ in rows:
        for k, x in items:
            a, b = plain(x), plain(t)
            if a and (edits(a, b) <= len(a) // 10 if len(a) >= 8 else f" {a} " in f" {b} "):
                want[i, k] += 1
    by_id, by_item = dict((r[0], r[1]) for r in rows), dict(items)
    for r in got:
        a, b = plain(by_item[r.item_id]), plain(by_id[r.doc_id][r.start : r.end])
        assert r.edits == edits(a, plain(by_id[r.doc_id])) == whole_edits(a, b), r
    assert Counter((r.doc_id, r.item_id) for r in got) == want and len(want) > 30 and any(r.edits > 0 for r in got)
    clean = decontaminate.uncontaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, *_ in rows} - {i for i, _ in want}
    assert decontaminate.contaminations(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.uncontaminated(docs(spark, ODD), spark.createDataFrame([], "item_id long, text string")).count() == len(ODD)


@pytest.mark.parametrize("m", range(8, 60))
def test_decontamination_allows_a_tenth_of_any_item(m):
    rng = random.Random(m)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(m))
    for spread in (1, 3, 9):
        changed = list(item)
        for e in range(m // 10):
            changed[(e * m // max(1, m // 10) + spread) % m] = "0"
        changed = "".join(changed)
        want = edits(item, f"before {changed} after")
        got = decontaminate.Matcher([1], [decontaminate.normalise([item])[0][:-1]]).find([f"before {changed} after"])
        assert want <= m // 10 and [(r, i, e) for r, i, e, *_ in got] == [(0, 0, want)]


def test_decontamination_reports_where_an_item_starts():
    find = lambda item, text: decontaminate.Matcher([1], [decontaminate.normalise([item])[0][:-1]]).find([text])
    text = "at one twoo three four five six, so"
    ((_, _, e, a, b),) = find("one two three four five six", text)
    assert (e, text[a:b]) == (1, "one twoo three four five six")
    text = "at ne two three four five six, so"
    ((_, _, e, a, b),) = find("one two three four five six", text)
    assert e == 1 and text[a:b].strip() == "ne two three four five six"


def test_decontamination_of_items_that_share_a_phrase():
    rng = random.Random(1)
    phrase = "answer the following question and give reasons for every step that you take "
    items = [phrase + " ".join(f"w{rng.randrange(10**6)}" for _ in range(22)) for _ in range(2000)]
    made = decontaminate.Matcher(list(range(2000)), [decontaminate.normalise([x])[0][:-1] for x in items])
    began = time.time()
    got = made.find([phrase * 18, f"{phrase * 9} so {items[77]} and {items[1500].replace('w', 'v', 2)}"])
    assert {(r, i) for r, i, *_ in got} == {(1, 77), (1, 1500)} and time.time() - began < 5


def test_decontamination_in_several_blocks(spark, monkeypatch):
    items = [(i, f"item {i * 7919} holds words {i * 104729} of its own") for i in range(30)]
    rows = [(i, f"before {items[i % 30][1]} after", "en", "s") for i in range(40)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    got = decontaminate.contaminations(docs(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got if r.edits == 0) >= Counter((i, i % 30) for i in range(40))
    assert decontaminate.uncontaminated(docs(spark, rows), bench).count() == len(ODD)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    before = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, d = [before.count()], before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = simhash.materialise(stage(spark, d, SMALL))
        assert d.columns == before.columns, name
        sizes.append(d.count())
    assert sizes[1] >= 0.99 * sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*before.columns, "copy"] and out.count() > 0
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)] and corpus_pipeline.ORACLE_SQL is None
