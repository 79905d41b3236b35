"""Fitted models, samples and scores recomputed by plainer means; odd columns, batches and weights."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import common, html_extract, language, media, mixing, packing, simhash, url_filter

SF = "/root/testdata/sf0.1"
WORDS = {"en": "the of and to in that is was for with this from have not are", "fr": "de la le les des une dans pour que qui avec sur être pas ce été", "de": "der die und das nicht ein eine für mit auf ist über können wird auch", "es": "de el la los una que por con para como más pero sus está sobre también"}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


# ---- shared helpers


def test_batches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "BYTES_AT_ONCE", 10)
    texts = ["aaaa", "bbbb", None, "cccc", "d" * 50, "", "ee", "f" * 8]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), "t"))
    assert [p.column("t").to_pylist() for p in parts] == [["aaaa", "bbbb", None], ["cccc"], ["d" * 50], ["", "ee", "f" * 8]]


def test_a_group_of_copies_counts_once_in_a_sample(spark):
    rows = spark.createDataFrame([("x", f"text {i % 50 if i % 3 else 7}") for i in range(3000)] + [("y", f"other {i}") for i in range(900)], "c string, t string")
    got = common.bounded_sample(rows, F.col("t"), 200, F.col("c"), ("x", "y")).collect()
    seen = [r.t for r in got]
    assert len(set(seen)) == len(seen) and 25 <= sum(r.c == "x" for r in got) <= 50 and 60 <= sum(r.c == "y" for r in got) <= 100
    assert common.bounded_sample(rows.limit(0), F.col("t"), 200).collect() == []
    assert len(common.bounded_sample(rows, F.col("t"), 10_000).where("t is not null").collect()) == 950


# ---- mixing


def test_weights_that_cant_be_met(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    table = lambda rows: spark.createDataFrame(rows, "source string, weight double")
    for rows in ([("c", 1.0)], [("a", 0.0), ("b", 0.0)], []):
        with pytest.raises(ValueError, match="positive weight"):
            mixing.mix(docs, weights=table(rows))
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="null, negative or infinite"):
            mixing.mix(docs, weights=table([("a", 1.0), ("b", bad)])).collect()
    once = sorted((r.doc_id, r.source) for r in mixing.mix(docs, weights=table([("a", 3.0)])).collect())
    assert once == sorted((r.doc_id, r.source) for r in mixing.mix(docs, weights=table([("a", 1.0), ("a", 2.0)])).collect())
    assert {s for _, s in once} == {"a"}  # a source without a weight is left out


# ---- URLs


def test_a_tree_is_the_best_split():
    r = random.Random(3)
    urls = [f"http://{'x' * r.randint(1, 20)}.{r.choice(['com', 'net'])}/{'/'.join('p' * r.randint(1, 5) for _ in range(r.randint(0, 4)))}{r.randint(0, 9999)}" for _ in range(300)]
    labels = [int(len(u) + 10 * r.random() > 45) for u in urls]
    model = url_filter.fit(urls, labels, trees=1, depth=1, rate=0.3, bins=400, shrink=1.0)
    x, y = model.matrix(urls), np.array(labels, float)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = max(((g[x[:, j] <= c].sum() ** 2 / (h[x[:, j] <= c].sum() + 1) + g[x[:, j] > c].sum() ** 2 / (h[x[:, j] > c].sum() + 1)), -j, c) for j in range(x.shape[1]) for c in np.unique(x[:, j])[:-1])
    got = x[:, model.feature[0, 0]] <= model.cut[0, 0]
    gain = g[got].sum() ** 2 / (h[got].sum() + 1) + g[~got].sum() ** 2 / (h[~got].sum() + 1)
    assert gain >= 0.999 * best[0]
    want = math.log(p / (1 - p)) + np.where(got, -0.3 * g[got].sum() / (h[got].sum() + 1), -0.3 * g[~got].sum() / (h[~got].sum() + 1))
    assert np.allclose(model.score(urls), want)


def test_scores_are_the_leaves_that_a_walk_finds():
    r = random.Random(4)
    urls = [f"http://{'ab' * r.randint(1, 9)}{r.randint(0, 99)}.example.{r.choice(['com', 'net', 'org'])}/{r.randint(1, 10 ** r.randint(1, 6))}?{'&'.join('k=1' for _ in range(r.randint(0, 4)))}" for _ in range(400)]
    labels = [int((u.count("&") + len(u) // 9 + r.randint(0, 2)) % 3 == 0) for u in urls]
    model = url_filter.fit(urls, labels, trees=7, depth=3)
    for u, row, score in zip(urls, model.matrix(urls), model.score(urls)):
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < 7:
                at = 2 * at + (1 if row[f[at]] <= c[at] else 2)
            total += v[at - 7]
        assert abs(total - score) < 1e-9
    assert url_filter.Model(0.0, 3, *(np.zeros((0, 1)),) * 3).used() == [] and len(model.used()) > 2
    assert len(url_filter.lexical(urls[0])) + 2 == len(url_filter.FEATURES)


def area_under(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    ranks = np.array([order[scores == s].mean() for s in scores])
    y = np.array(labels, bool)
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def unseen_hosts():
    """(area under the curve over hosts that the trees haven't seen, features in use, distinct scores) on the pages' URLs."""
    import pyarrow.parquet as pq

    urls = pq.read_table(f"{SF}/pages.parquet", columns=["url"])["url"].to_pylist()
    host = [url_filter.parts(u)[0] for u in urls]
    site = [h[h.find(".") + 1 :] if h.split(".")[0] in ("www", "m", "blog") else h for h in host]
    label = [int(bool(set(h.replace("-", ".").split(".")) & set(url_filter.BLOCKLIST))) for h in host]
    bad = sorted({s for s, y in zip(site, label) if y})
    good = sorted({s for s, y in zip(site, label) if not y})
    fold = {s: i % 6 for i, s in enumerate(bad)} | {s: i % 6 for i, s in enumerate(good)}
    scores, used = np.zeros(len(urls)), set()
    for k in range(6):
        inside = [i for i in range(len(urls)) if fold[site[i]] != k]
        out = [i for i in range(len(urls)) if fold[site[i]] == k]
        model = url_filter.fit([urls[i] for i in inside], [label[i] for i in inside])
        scores[out] = model.score([urls[i] for i in out])
        used |= set(model.used())
    return area_under(scores, label), used, len(np.unique(scores.round(6)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_trees_on_unseen_hosts():
    area, used, scores = unseen_hosts()
    assert area > 0.7 and len(used) >= 5 and scores > 50


# ---- languages


def brute_posteriors(spark, table, rows, languages=("en", "fr", "de", "es"), strength=20.0, unknown=0.01):
    """language.identify over (text, declared, host, suffix) in numpy, from the same trigram models."""
    model = language.fit(table, "text", F.lower("lang"), languages, 4000, 0.3)
    m = len(languages)
    soft = lambda logs: np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    seen = [model.evidence((t or "").encode()) for t, *_ in rows]
    flat = np.log(np.array([(1 - unknown) / m] * m + [unknown]))
    total, by = np.zeros(m + 1), {"suffix": {}, "host": {}, "said": {}}
    for (_, said, host, suffix), (ll, letters) in zip(rows, seen):
        if letters:
            p = soft(ll + flat)
            total += p
            for level, key in (("suffix", suffix), ("host", (suffix, host)), ("said", said)):
                by[level].setdefault(key, np.zeros(m + 1))
                by[level][key] += p
    overall = (total + 1) / (total + 1).sum()
    smooth = lambda s, parent: (s + strength * parent) / (s.sum() + strength)
    out = []
    for (_, said, host, suffix), (ll, letters) in zip(rows, seen):
        if not letters:
            out.append(("und", 1.0))
            continue
        prior = smooth(by["host"][suffix, host], smooth(by["suffix"][suffix], overall))
        p = soft(ll + np.log(prior) + np.log((by["said"][said] + 1) / (np.maximum(total, 1e-9) + 10)))
        out.append(((*languages, "und")[int(p.argmax())], p.max()))
    return out


def test_posteriors(spark):
    r = random.Random(9)
    rows = []
    for i in range(300):
        lang = r.choice(list(WORDS))
        text = prose(r, lang, r.randint(1, 12)) if i % 11 else "".join(r.choice("bcdfgh ") for _ in range(30))
        rows.append((text if i % 17 else None, r.choice([lang, lang, "EN", None]), r.choice([None, "", f"h{lang}", "mixed"]), r.choice([None, "net", lang])))
    rows[0] = (prose(r, "de", 5000), "de", None, None)
    table = spark.createDataFrame([(i, *x, "k") for i, x in enumerate(rows)], "doc_id long, text string, lang string, host string, suffix string, declared string").repartition(3)
    got = {x.doc_id: x for x in language.identify(table, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix")).collect()}
    want = brute_posteriors(spark, table, [(t, d and d.lower(), h, s) for t, d, h, s in rows])
    assert len(got) == len(rows) and all(got[i].declared == "k" and got[i].text == rows[i][0] for i in got)
    for i, (lang, p) in enumerate(want):
        assert abs(got[i]["__posterior"] - p) < 1e-6 and got[i]["__language"] == lang
        assert got[i]["__keep"] == (lang != "und" and p >= 0.5)


def test_pages(spark):
    r = random.Random(10)
    page = lambda lang, text: f"<html lang='{lang}-XX'><head><title>t</title><script>var the = 'the of and';</script></head><body><nav>a</nav><p>{text}</p></body></html>"
    langs = [r.choice(list(WORDS)) for _ in range(120)]
    rows = [(i, f"https://h{lang}{i % 3}.example.{lang}:80/x?y", page(lang if i % 9 else "en", prose(r, lang, 60))) for i, lang in enumerate(langs)]
    rows += [(500, None, None), (501, "no scheme", "<html xml:lang='de'><p>" + prose(r, "fr", 80)), (502, "http://x", "<p>12 34</p>"), (502, "http://x", "<p>12 34</p>")]
    got = {x.page_id: x for x in language.page_languages(spark.createDataFrame([(*x, "n") for x in rows], "page_id long, url string, html string, host string")).collect()}
    assert sum(got[i].language == lang for i, lang in enumerate(langs)) >= 118 and all(got[i].declared == (lang if i % 9 else "en") for i, lang in enumerate(langs))
    assert (got[500].declared, got[500].language, got[500].keep) == (None, "und", False) and (got[501].declared, got[501].language) == ("de", "fr") and not got[502].keep
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.page_languages(empty).collect() == []


# ---- pages without an article


def test_scoring_decides():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    for _ in range(60):
        boxes = []
        for k in range(4):
            texts = []
            for _ in range(r.randint(1, 6)):
                n = r.randint(5, 60)
                words = [word() + ("," if r.random() < 0.15 else "") for _ in range(n)]
                linked = r.randint(0, n) if r.random() < 0.4 else 0
                texts.append((" ".join(words), " ".join(words[:linked])))
            boxes.append((f"mark{k}", texts))
        html = "".join(f"<section><div><p>{m}</p>" + "".join(f"<p>{'<a href=x>' + a + '</a>' if a else ''}{t[len(a):]}</p>" for t, a in texts) + "</div></section>" for m, texts in boxes)
        points = {}
        for mark, texts in boxes:  # div: 5 at first; paragraphs of 25 characters or more count
            total, chars, linked = 5.0, len(mark), 0
            for t, a in texts:
                chars, linked = chars + len(t), linked + len(a)
                if len(t) >= 25:
                    total += 1 + t.count(",") + min(len(t) // 100, 3)
            points[mark] = total * (1 - linked / chars)
        upper = 0.0  # what the body of all gets in the end: sections by half, the root by less
        ordered = sorted(points.values(), reverse=True)
        root = html_extract.parse(html)
        got, _ = html_extract.score(root)
        divs = {"".join(c for c in x.items[0].items if isinstance(c, str)): v for x, v in got.items() if x.tag == "div"}
        assert divs.keys() == points.keys() and all(abs(divs[m] - points[m]) < 1.0 for m in points), (divs, points, upper)
        rest = max(v for x, v in got.items() if x.tag != "div")
        if ordered[0] > max(ordered[1], rest) + 2:
            best = max(points, key=points.get)
            assert best in html_extract.main_text(f"<html><body>{html}</body></html>")


# ---- columns of any name


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "<p>" + "long enough to be a paragraph, " * 4 + "</p>", 7, 8)], "text long, html string, n_chars long, elements long")
    assert html_extract.extract(rows, keep=("text", "n_chars", "elements")).columns == ["elements", "text", "n_chars"]
    assert media.interleave(rows, keep=("elements", "text")).columns == ["text", "elements"]
    pieces = spark.createDataFrame([(5, 9, 1, 2, 3), (2048, 9, 1, 2, 3), (7, 9, 1, 2, 3)], "length long, sequence_id long, tag long, shard long, offset long")
    got = packing.pack(pieces)
    assert got.columns == ["length", "tag", "shard", "sequence_id", "offset"] and sorted((r.length, r.tag, r.shard) for r in got.collect()) == [(5, 1, 2), (7, 1, 2), (2048, 1, 2)]


def test_one_of_a_group_stays_whatever_its_columns(spark):
    rows = [(1, "a b c d e f", {"k": 1}, "x"), (1, "a b c d e f", {"k": 1}, "x"), (2, "a b c d e f", {"k": 2}, "y"), (3, "other words here now", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp map<string,int>, hash string")
    for kept in (simhash.keep_one(docs), simhash.keep_one(docs, words_per_shingle=5, similarity=0.8)):
        assert sorted((r.doc_id, r.fp and r.fp["k"], r.hash) for r in kept.collect()) == [(1, 1, "x"), (3, None, None)] and kept.columns == docs.columns


# ---- the pipeline on odd tables


def test_pipeline_on_odd_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(8)
    long = prose(r, "en", 60_000)
    base = [prose(r, lang, 150) for lang in WORDS for _ in range(6)]
    near = [" ".join(w if j != 70 else "changed" for j, w in enumerate(t.split())) for t in base]  # five of 146 shingles
    texts = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(near)] + [(200, long), (200, long), (201, long + " end"), (None, prose(r, "fr", 80)), (None, prose(r, "fr", 80)), (202, None), (203, "")]
    table = [(i, t, lang, None if i and i % 5 == 0 else "s", None if t is None else len(t)) for i, t in texts for lang in [next((k for k in WORDS if t and t.split()[0] in WORDS[k].split()), None)]]
    spark.createDataFrame(table, kind).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda name: sorted((x.doc_id is None, x.doc_id or 0) for x in seen[name])
    assert {202, 203} & {x.doc_id for x in seen["language_id"]} == set()
    kept = {x.doc_id for x in seen["simhash_near_dedup"]}
    assert kept >= set(range(24)) and not kept & set(range(100, 124)) and 200 in kept and 201 not in kept  # every near copy goes, every first stays
    assert sum(x.doc_id is None for x in seen["simhash_near_dedup"]) == 2 and ids("simhash_near_dedup").count((False, 200)) == 1
    tokens = {}
    for x in seen["packing"]:
        tokens[x.sequence_id] = tokens.get(x.sequence_id, 0) + x.length
    assert max(tokens.values()) <= 2048 and {x.doc_id for x in seen["packing"]} == {x.doc_id for x in seen["mixing"]}

    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
