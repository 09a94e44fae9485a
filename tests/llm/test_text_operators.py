"""Classifier, URL verdicts, licences, I-Match, HTML extraction and the pipeline."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, prose, words
from pyspark.sql import functions as F

from isochrone.llm import html_extraction, imatch, licences, quality_classifier, url_filter

DATA = "/root/testdata/sf0.001"
have_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def test_classifier_separates_held_out_documents(spark):
    rng = random.Random(0)
    rows, labels = awkward(), [(1, 1), (None, 0), (12345, 1), (4, None)]
    for i in range(100, 400):
        bad = i % 4 == 0
        text = prose(rng, 60)
        rows.append((i, rng.choice([text.upper(), text.replace(" ", " | "), "aa bb cc dd ee " * 12]) if bad else text))
        labels.append((i, 0 if bad else 1))
    docs = documents(spark, rows)
    model = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scored = quality_classifier.score(docs, model).withColumn("held", quality_classifier.held_out(F.col("doc_id"))).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    held = [r for r in scored if r["held"] and r["doc_id"] is not None and r["doc_id"] >= 100]
    assert len(held) > 30 and np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) >= 0.95
    nothing = quality_classifier.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert {round(r["score"], 9) for r in quality_classifier.score(docs, nothing).collect()} == {0.3}
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def brute_model(rows, labels, model):
    """Quantile of the raw scores over all labelled rows that are not held out, and scores, in Python."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    raw = lambda f: sum(f[n] * w for n, w in zip(quality_classifier.FEATURES, model.weights, strict=True))
    known = sorted({(raw(f), i, q) for i, f in rows for j, q in labels if i == j and not held(i)})
    low = sum(q == 0 for _, _, q in known)
    cut = known[max(low, 1) - 1][0]
    above = min((r for r, _, _ in known if r > cut), default=cut)
    shift = (cut + above) / 2 - np.log(0.3 / 0.7)
    return (cut + above) / 2, [1 / (1 + np.exp(-(raw(f) - shift))) for _, f in rows]


def test_classifier_threshold_covers_all_labels_and_hot_ids_keep_both_classes(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1, 161):
        text = prose(rng, rng.randint(20, 60))
        bad = i % 3 == 0
        rows.append((i, text.replace(" ", " # ", 8) if bad else text))
        labels.append((i, 0 if bad else 1))
    hot = next(i for i, q in labels if q == 0 and zlib.crc32(str(i).encode()) % 5)
    rows += [(hot, "| " * rng.randint(1, 99) + prose(rng, 20)) for _ in range(60)] + [(hot, "aa")] * 40
    docs = documents(spark, rows)
    model = quality_classifier.fit(docs, spark.createDataFrame(labels * 2, "doc_id long, quality int"), sample=10)
    assert any(model.weights)
    measured = [(r["doc_id"], r.asDict()) for r in quality_classifier.features(docs).collect()]
    threshold, scores = brute_model(measured, labels, model)
    assert model.threshold == pytest.approx(threshold)
    got = quality_classifier.score(docs, model).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in got) == sorted((i, round(s, 9)) for (i, _), s in zip(measured, scores, strict=True))
    assert {r["predicted"] for r in got} == {0, 1}


def test_pair_fit_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=600) * 0.3 > 0).astype(int)
    w = quality_classifier.fit_pairs(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0] and abs(w[0] / w[1] + 2) < 0.5


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len, default=None)


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x#y", "https://example.org", "https://example.org/", "x://example.org/en/12", "http://sub.com/fr/#", "http://com/de/", "http://ücom.COM/de/x",
            "a://b://c.com/fr/", "http://notorg/", "http://x.net?/q=://z.com/de/", "http://x.net/a b\nc", "http://" + "a" * 5000 + ".com/de/", "http://sub.com/fr/#"]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    verdicts = {r: v for v, r in url_filter.RULES}
    for i, u in enumerate(urls):
        host, path, rule = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == verdicts[rule]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p">t</a>' for h in hosts)
    rows = [(0, "http://bad.com/de/1", ""), (1, "http://bad.com/de/2", ""), (2, "http://spam.net/x", link("bad.com", "BAD.com")), (3, "http://good.org/", link("friend.net", "nowhere.net")), (4, "http://friend.net/", link("good.org")), (5, "http://bad.com/en/", None), (6, "http://alone.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_distrust_reaches_far_hosts_and_hosts_without_pages(spark):
    link = lambda *urls: "".join(f'<a href="https://{u}">t</a>' for u in urls)
    rows = [(i, f"http://a.com/de/{i}", "") for i in range(100)] + [(1000 + i, f"http://big.net/{i}", link("a.com/de/1") if i == 0 else "") for i in range(550)]
    # a host that only links to a blocked url elsewhere; a subdomain two labels below another; a clean one
    rows += [(2000, "http://only.net/", link("gone.com/de/x?y", "GONE.com/de/z")), (2001, "http://x.y.only.net/", None), (2002, "http://calm.net/", link("gone.net/"))]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(100)} == {"block"}
    assert {got[1000 + i] for i in range(550)} == {"allow"}  # distrust passes one way: 85 of 275
    assert (got[2000], got[2001], got[2002]) == ("block", "block", "allow")
    back = [(i, u, link("big.net/") if i == 0 else h) for i, u, h in rows]  # and back and forth: 0.85 * 100 / (1 - 0.85 ** 2) = 306
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(back, "page_id long, url string, html string")).collect()}
    assert {got[1000 + i] for i in range(550)} == {"block"}


def test_propagation_equals_the_solved_equations(spark):
    rng = random.Random(1)
    n = 12
    edges = {(a, b): rng.randint(1, 5) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(30)) if a != b}
    seeds = [(f"h{i}", rng.randint(0, 3), rng.randint(0, 3)) for i in range(n)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(
        spark.createDataFrame(seeds, "host string, allowed long, blocked long"), spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in edges.items()], "src string, dst string, n long")).collect()}
    for kind, column in ((0, 1), (1, 2)):
        m = np.zeros((n, n))
        for (a, b), k in edges.items():
            m[(b, a) if kind == 0 else (a, b)] = k
        m /= np.maximum(m.sum(axis=0), 1)
        want = np.linalg.solve(np.eye(n) - 0.85 * m, np.array([x[column] for x in seeds], float))
        assert all(0 <= w - got[f"h{i}"][kind] + 1e-9 <= url_filter.TOLERANCE for i, w in enumerate(want))


def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base = [], set()
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))


def test_licences_equal_brute_force(spark):
    rng = random.Random(0)
    notices = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "the gnu general public", "apache licensé", "mit license mit license", "CC\nBY/cc by"]
    rows = awkward() + [(100 + i, " ".join(rng.choice([prose(rng, 5), rng.choice(notices)]) for _ in range(6))) for i in range(60)] + [(200 + i, n) for i, n in enumerate(notices)]
    got = licences.scan_documents(documents(spark, rows)).collect()
    want = sorted((brute_licences(r[1]) for r in rows), key=str)
    assert sorted(((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == want
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[200 + i] for i in range(4)] == ["apache,apache-2.0", "gpl,gpl-3.0", "mit,mit-reference", "cc-by,cc-by-nc"]
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got if r["base_labels"])
    assert licences.scan_documents(documents(spark, rows).limit(0)).count() == 0


def test_whole_key_phrase_gives_the_label(spark):
    labelled = {
        "Apache License Version 2.0": "apache,apache-2.0", "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        "GNU General Public License version 3": "gpl,gpl-3.0", "CC BY-NC 4.0": "cc-by,cc-by-nc", "CC BY-SA 4.0": "cc-by,cc-by-sa", "CC BY 4.0": "cc-by,cc-by-4.0",
        "licensed under the MIT license": "mit,mit-reference", "Free Software Foundation, either version 2 of the License, or later": "gpl-2.0",
        "Redistribution and use in source and binary forms": "bsd", "redistribution X Y source Z binary forms": "", "redistribution and use in source or binary forms": "",
        "in no event will the authors be held liable": "zlib", "in no event will some authors be held liable": "", "a mit license": "mit",
    }
    rows = [(i, t) for i, t in enumerate(labelled)] + [(100 + i, f"before it\n{t} and after") for i, t in enumerate(labelled)]
    got = {r["doc_id"]: r["labels"] for r in licences.scan_documents(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(labelled))] == list(labelled.values()) == [got[100 + i] for i in range(len(labelled))]
    for _, text, key in licences.TEMPLATES:  # what ``occurrences`` keeps has every common word of a key phrase
        keyed = [(i, w) for i, w, in_key in licences.places(text, key) if in_key]
        assert all(w in licences.VOCABULARY or any(0 < abs(i - j) <= licences.NEAR and v in licences.VOCABULARY for j, v in keyed) for i, w in keyed)


def test_imatch_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BLOCK_ROWS", 7)  # several blocks on a small table
    rng = random.Random(6)
    rows = awkward() + [(100 + i, prose(rng, rng.randint(1, 200))) for i in range(40)] + [(200, "same text here"), (201, "same text here")]
    got = imatch.fingerprint_documents(documents(spark, rows)).withColumn("print", imatch.printed(F.col("hashes"))).withColumn("near", imatch.likeness(F.col("hashes"), F.col("edited_hashes"))).collect()
    assert len(got) == len(rows) and all(0 <= r["near"] <= 1 for r in got)
    single = [r for r in rows if r[0] is not None and r[0] != 4]  # rows with one place in the order
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r["doc_id"]: r for r in got}
    for r in single:
        following = order[(order.index(r) + 1) % len(order)][1] or ""
        text = r[1] or ""
        half = len(text) // 2
        want = text[: len(text) - half] + following[:half]
        assert by_id[r[0]]["n_chars"] == len(text) and by_id[r[0]]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    prints = {}
    for r in got:
        if r["doc_id"] in (4, 5, 200, 201):
            prints.setdefault(r["doc_id"] >= 200, set()).add(r["print"])
    assert all(len(p) == 1 for p in prints.values())
    assert imatch.fingerprint_documents(documents(spark, rows).limit(0)).count() == 0


def test_imatch_hashes_and_likeness_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(3, 25))) for i in range(1, 61)]
    # words that all documents have are outside the band; so are those of the last texts, but for equal ones
    rows = [(i, t + " everywhere") for i, t in rows] + [(70, "everywhere"), (71, "everywhere everywhere"), (72, "everywhere"), (73, ""), (74, " "), (75, None)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in imatch.fingerprint_documents(docs).withColumn("near", imatch.likeness(F.col("hashes"), F.col("next_hashes"))).withColumn("print", imatch.printed(F.col("hashes"))).collect()}
    assert len({got[i]["print"] for i in (70, 71)}) == 2 and got[70]["print"] == got[72]["print"]
    assert got[71]["near"] == 0.0 and got[73]["near"] == 0.0 and got[74]["near"] == got[75]["near"] == 1.0
    assert len({got[i]["print"] for i in (73, 74, 75)}) == 1
    found = {}
    for _, t in rows:
        for w in set(words(t)):
            found[w] = found.get(w, 0) + 1
    kept = {w for w, n in found.items() if imatch.LOW * len(rows) <= n <= imatch.HIGH * len(rows)}
    assert "everywhere" not in kept and len(kept) > 20
    # the hash function itself is Spark's: terms, subsets and their hashes are recomputed from its values
    vocabulary = spark.createDataFrame([(w,) for w in kept], "w string").withColumn("t", F.xxhash64("w"))
    member = vocabulary.select("w", "t", *[(F.expr(f"xxhash64(t, {imatch.SEED + i})") % (1 << level) == 0).alias(f"m{i}") for i, level in enumerate(imatch.SUBSETS)])
    member = {r["w"]: (r["t"], [r[f"m{i}"] for i in range(len(imatch.SUBSETS))]) for r in member.collect()}
    inside = [(i, sorted(member[w][0] for w in set(words(t)) & kept), [sorted(member[w][0] for w in set(words(t)) & kept if member[w][1][k]) for k in range(len(imatch.SUBSETS))]) for i, t in rows]
    wanted = spark.createDataFrame([(i, [full, *subsets]) for i, full, subsets in inside], "doc_id long, sets array<array<long>>")
    wanted = {r["doc_id"]: r["h"] for r in wanted.select("doc_id", F.transform("sets", lambda x: F.when(F.size(x) > 0, F.xxhash64(x)).otherwise(0)).alias("h")).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    for k, i in enumerate(order):
        if any(wanted[i]):
            assert got[i]["hashes"] == wanted[i]
        a, b = got[i]["hashes"], got[order[(k + 1) % len(order)]]["hashes"]
        either = [x == y for x, y in zip(a, b, strict=True) if x or y]
        assert got[i]["next_hashes"] == b and got[i]["near"] == pytest.approx(1.0 if a == b else sum(either) / len(either))


@pytest.fixture(scope="module")
def trees():
    return html_extraction.model(200)


def test_parse_repairs_markup():
    blocks = lambda page: [html_extraction.block_text(t, i) for t in [html_extraction.parse(page)] for i in range(len(t.tag)) if t.text[i]]
    assert blocks("<p>a<p>b &amp;amp; c</p>d<br>e<div>f <i>g</i>h</div>") == ["a", "b &amp; c", "d e", "f gh"]
    assert blocks("<script>var t='</p>'</script>x<!-- y --><style>z") == ["x"]
    assert blocks("<head><title>t</title><body>in<ul><li>1<li>2</ul>") == ["in", "1", "2"]
    assert blocks("a < b <p title='x>y'>c</p></div></nonsense>") == ["a < b", "c"]
    assert blocks("") == [] and blocks("<div>" * 5000 + "deep") == ["deep"]


def test_parse_keeps_text_behind_odd_markup():
    blocks = lambda page: [html_extraction.block_text(t, i) for t in [html_extraction.parse(page)] for i in range(len(t.tag)) if t.text[i]]
    assert blocks("<p><img alt=Bob's src=x.jpg></p><p>He didn't go home.</p><p>It's late.</p>") == ["He didn't go home.", "It's late."]
    assert blocks("<p title = 'x>y' data-a=\"it's>\">c</p><a href=a=\"b>d</a>") == ["c", "d"]
    assert blocks("<head><title>t</title><meta name=a><style>z</style><p>one</p><p>two") == ["one", "two"]
    assert blocks("<head><title>t</title></head><body>in") == ["in"]
    for tag in ("noscript", "svg", "canvas", "template", "iframe", "xmp"):
        assert blocks(f"<p>a</p><{tag}><p>b</p><{tag}><p>c</p>") == ["a", "b", "c"]
        assert blocks(f"<p>a</p><{tag}>raw</{tag}><p>c</p>") == ["a", "c"]
    assert blocks("<p>if <math><mi>x</mi>=<mn>1</mn></math> then <object>text</object> end</p>") == ["if x=1 then text end"]
    assert blocks("<p>a</p><textarea>b") == blocks("<p>a</p><script>b") == blocks("<p>a</p><style>b") == ["a"]


def test_decode_is_the_best_consistent_choice():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(2, 11))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(size=n)
        best = max((sum(odds[i] for i in range(n) if m >> i & 1) for m in range(2**n) if all(not m >> i & 1 or i == 0 or m >> parent[i] & 1 for i in range(n))))
        chosen = html_extraction.decode(parent, odds)
        assert odds[chosen].sum() == pytest.approx(best)
        assert all(not chosen[i] or i == 0 or chosen[parent[i]] for i in range(n))


def test_extraction_on_unseen_layouts(trees):
    rng = np.random.default_rng(77)
    missed = extra = total = 0
    for _ in range(120):
        page = html_extraction.training_page(rng)
        tree = html_extraction.parse(page)
        want = [x for x in (html_extraction.block_text(tree, i) for i in range(len(tree.tag))) if x.startswith("m")]
        got = html_extraction.main_blocks([page], trees)[0]
        missed, extra, total = missed + len(set(want) - set(got)), extra + len(set(got) - set(want)), total + len(want)
    assert missed <= 0.05 * total and extra <= 0.06 * total


@have_data
def test_extraction_of_the_pages(spark, trees):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("text", F.lit("clash"))
    more = spark.createDataFrame([(None, None, None, None), (-1, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages.union(more), trees).collect()}
    assert got[None] == got[-1] == "" and html_extraction.extract(pages.limit(0), trees).count() == 0
    same = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        same += got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
    assert same >= 0.98 * pages.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    clean = [(100 + i, prose(rng, 80), f"s{i % 3}") for i in range(40)]
    copy = [(200 + i, clean[i][1], "s1") for i in range(5)]
    near = [(300 + i, clean[i][1].replace(" ", "\n", 1) + " tail", "s2") for i in range(5)]
    junk = [(400, "a | b | c | d " * 10, "s0"), (401, prose(rng, 50).upper(), "s0")]
    documents(spark, awkward() + clean + copy + near + junk).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept.append({r["doc_id"] for r in out.collect()})
        docs = out
    first, lines, unique, mixed = kept
    assert not first & {1, 2, 3, 400, 401} and {r[0] for r in clean} <= first
    assert {r[0] for r in clean} <= lines and not lines & set(range(200, 205))
    assert {r[0] for r in clean} <= unique <= lines and mixed <= unique
    assert {r["doc_id"] for r in docs.collect()} == mixed


def test_labelled_texts_do_not_travel(spark, capsys):
    """Whatever the sizes say, only measurements are shuffled to meet the labels."""
    from isochrone.llm import quality_classifier

    rng = random.Random(1)
    docs = documents(spark, [(i, prose(rng, 30)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality_classifier.labelled_features(docs.hint("merge"), labels.hint("merge")).explain("formatted")
    plan = capsys.readouterr().out
    moved = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("text#" in m for m in moved)
    both = quality_classifier.classify(docs, labels).collect()
    apart = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(both) == 40 and sorted(map(tuple, both)) == sorted(map(tuple, apart))
