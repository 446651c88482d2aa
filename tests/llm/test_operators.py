"""Operators against brute force, round trips and held-out accuracy, with their defined edge cases."""

import hashlib
import math
import os
import random
import re
import time
import shutil
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trailspark.llm import decontaminate, htmltext, langid, mixing, preference, quality, queries, shingles, simhash, topk, urlfilter, warc
from trailspark.llm.common import written

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def documents(spark, texts, **more):
    data = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, DOCS)
    # names that operators use inside must not disturb them
    for name in ("score", "keep", "fp", "n_hit", "items", "rank", "size", "taken", "block", "component_id", "key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def nasty(rng):
    return [None, "", " \t\n ", "one", "ONE", prose(rng, 12), prose(rng, 12), "é ü ñ 漢字", "a" * 5000, prose(rng, 30_000), "x\x00y\x1fz", "&&& *** ###"]


# --- decontamination


def brute_overlap(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found |= {str(item)} - {"None"}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_is_brute_force(spark):
    rng = random.Random(1)
    items = [(1, prose(rng, 25)), (2, "just three words"), (3, None), (4, ""), (10, prose(rng, 10)), (11, "One"), (None, "epsilon"), (1, prose(rng, 11))]
    texts = [*nasty(rng)[:9], items[0][1].upper().replace(" ", "--"), "so just, THREE words: " + prose(rng, 40) + items[4][1], prose(rng, 60, WORDS[:2]), items[0][1][:40]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"part_bytes": 60}, {"part_bytes": 60, "held_bytes": 100}):  # one part, several at once, several in turn
        out = decontaminate.contamination(documents(spark, texts), bench, **options)
        got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
        assert got == {i: brute_overlap(t, items) for i, t in enumerate(texts)}


def test_contamination_by_an_item_without_an_id(spark):
    rng = random.Random(31)
    said = prose(rng, 12)
    bench = spark.createDataFrame([(None, said)], "item_id long, text string")
    found = decontaminate.contamination(documents(spark, [said, prose(rng, 12)]), bench)
    assert rows(found, "doc_id", "n_hit", "n_items", "contaminated") == [(0, 12, 0, True), (1, 0, 0, False)]
    assert rows(decontaminate.drop_contaminated(documents(spark, [said, "other"]), bench), "doc_id") == [(1,)]


def test_contamination_keeps_clashing_columns(spark):
    df = documents(spark, ["a b c"]).withColumn("found", F.lit(1)).withColumn("_found", F.lit(2)).withColumn("Overlap", F.lit(3))
    out = decontaminate.drop_contaminated(df, spark.createDataFrame([(1, "x y")], "item_id long, text string"))
    assert out.columns == df.columns and out.collect() == df.collect()


def test_large_benchmark_is_one_pass_without_a_shuffle_of_texts(spark):
    """50 MB of benchmark: the documents are read once and only searched."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1700)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50_000)).cast("string"))), " ")
    bench = spark.range(5000).select(F.col("id").alias("item_id"), words.alias("text"))
    bench, _ = written(bench, "bench")
    assert bench.agg(F.sum(F.octet_length("text"))).first()[0] > 45e6
    said = bench.where("item_id = 17").first().text.split()
    docs = documents(spark, ["start " + " ".join(said[400:425]) + " end", " ".join(said[100:109]), "w1 w2 " * 300])
    found = decontaminate.drop_contaminated(docs, bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert rows(found, "doc_id") == [(1,), (2,)]


def test_contamination_of_small_alphabet(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(1, 14), WORDS[:2])) for i in range(6)]
    texts = [prose(rng, rng.randint(0, 60), WORDS[:2]) for _ in range(20)]
    matcher = decontaminate.WuManber([(str(i), t) for i, t in items], 4)
    for t in texts:
        words = decontaminate.words_of(t)
        spans, found = matcher.search(words)
        n, n_hit, n_items, _, _ = brute_overlap(t, items, 4)
        assert (len(words), sum(b - a for a, b in spans), len(found)) == (n, n_hit, n_items)


@pytest.mark.parametrize("window", [200, 259, 300, 700])
def test_contamination_by_long_windows(spark, window):
    """Shifts of a long window take more than a byte."""
    rng = random.Random(window)
    items = [(1, prose(rng, 800)), (2, prose(rng, 150)), (3, prose(rng, window))]
    words = items[0][1].split()
    texts = [" ".join(words[20 : 20 + window]), " ".join(words[20 : 19 + window]), "x " + items[1][1], prose(rng, 900) + " " + items[2][1] + " y", prose(rng, 1000)]
    got = decontaminate.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=window)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    assert found == {i: brute_overlap(t, items, window) for i, t in enumerate(texts)}


def test_contamination_empty_and_repeated(spark):
    docs = documents(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(7))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.contamination(docs, empty), "doc_id", "n_hit", "contaminated") == [(7, 0, False)] * 2
    assert decontaminate.contamination(docs.limit(0), empty).count() == 0
    assert decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- language


def test_language_held_out_accuracy(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    score = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert score > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_language_cases(spark):
    rng = random.Random(3)
    train = spark.createDataFrame([(i, prose(rng, 50, ["the", "and", "with"]) if i % 2 else prose(rng, 50, ["für", "und", "nicht"]), "en" if i % 2 else "de", "s", 1) for i in range(60)], DOCS)
    model = langid.fit(train.unionByName(train.limit(1).withColumn("lang", F.lit(None).cast("string"))))
    assert model.languages == ["de", "en"]
    texts = [None, "", "123 !!", "the", "THE AND", "nicht für", "漢字", "and " * 300_000]
    got = [(r.language.lang_pred, r.language.score) for r in langid.identify(documents(spark, texts), model).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["und", "und", "und", "en", "en", "de", "de", "en"] and got[6][1] == 0
    nothing = langid.fit(train.limit(0))
    assert langid.identify(documents(spark, ["the"]), nothing).first().language.lang_pred == "und"
    assert langid.keep_identified(documents(spark, texts), model).count() == 4


def test_language_model_is_brute_force(spark):
    """The fitted filter and the decisions against n-gram counts in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    crc = {r.doc_id: r.c for r in docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect()}
    counts = defaultdict(Counter)

    def grams_of(text):
        points = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        points = f" {points} " if points else ""
        return [points[i : i + n] for n in langid.GRAMS for i in range(len(points) - n + 1)]

    for i, text, lang in data:
        if lang is not None and text is not None and crc[i] % 4 != 2:
            counts[lang].update(grams_of(text))
    names = sorted(counts)
    total = {x: sum(counts[x].values()) for x in names}
    shares = {x: {g: n / total[x] for g, n in counts[x].items() if n >= langid.least_count(total[x])} for x in names}
    top = Counter()
    for x in names:
        for g, v in shares[x].items():
            top[g] = max(top[g], v)
    digest = lambda g: int(langid.grams(np.array([ord(c) for c in g], np.uint32), (len(g),))[0])
    size = langid.SLOTS
    bits = {x: [{int(langid.BitSlicedBloom.slots(np.array([digest(g)], np.uint64), k, size)[0]) for g, v in shares[x].items() if v >= langid.RATIO * top[g]} for k in range(langid.HASHES)] for x in names}
    held = {x: set.union(*bits[x]) for x in names}
    model = langid.fit(docs)
    assert model.languages == names and model.masks.shape == (size,)
    assert all({int(j) for j in np.flatnonzero(model.masks >> np.uint64(i) & np.uint64(1))} == held[x] for i, x in enumerate(names))
    for _, text, _ in data[:25]:
        found = grams_of(text)[:4000]
        places = [[int(langid.BitSlicedBloom.slots(np.array([digest(g)], np.uint64), k, size)[0]) for k in range(langid.HASHES)] for g in found]
        rate = {x: (len(held[x]) / size) ** langid.HASHES for x in names}
        hits = {x: max(0.0, (sum(all(j in held[x] for j in js) for js in places) - len(places) * rate[x]) / (1 - rate[x])) for x in names}
        if len(found) < 4000:
            best = max(names, key=lambda x: hits[x])
            assert model.decide(text) == (best, pytest.approx(hits[best] / sum(hits.values())))


def test_language_of_two_hundred_and_of_single_documents(spark):
    data = []
    for k in range(200):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        data.append((k, " ".join("".join(letters[i : i + 4]) for i in range(9)), f"l{k:03}"))
    data = [(i + 1000 * j, t, x) for j in range(3) for i, t, x in data]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learned = {x for i, _, x in data if x in model.languages}
    assert len(learned) > 190 and model.masks.shape[0] == 4
    found = langid.identify(docs, model).where(F.col("lang").isin(*learned)).select("lang", "language.lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in found) and langid.keep_identified(docs, model).count() >= len(found)
    one = langid.fit(docs.where("doc_id < 4 AND lang IN ('l000', 'l001')"))
    assert {r.language.lang_pred for r in langid.identify(docs.where("lang = 'l001'"), one).collect()} <= {"l001", *one.languages}
    assert all(r.language.score > 0 for r in langid.identify(docs.where(F.col("lang").isin(*one.languages)), one).collect())


def test_counts_in_chunks_add_up(monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", 7)
    points = langid.codes(prose(random.Random(5), 40))
    total = Counter()
    for h, n in langid._counted(langid._all_grams(points, (2, 3))):
        total.update(dict(zip(h.tolist(), n.tolist(), strict=True)))
    assert total == Counter(langid.grams(points, (2, 3)).tolist())


def test_bloom_masks_match_members():
    rng = np.random.default_rng(0)
    members = {x: rng.integers(0, 1 << 63, 500).astype(np.uint64) for x in ("a", "b")}
    bloom = langid.BitSlicedBloom.build(["a", "b"], members, 1 << 14)
    assert all(bloom.containing(members["a"]) & np.uint64(1)) and all(bloom.containing(members["b"]) & np.uint64(2))
    other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert abs(np.mean(bloom.containing(other) & np.uint64(1)) - bloom.false_rate[0]) < 0.005


# --- URL lists


def brute_url(url, at, entries):
    m = re.match(r"[A-Za-z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", url or "")
    if not m or at is None:
        return "unlisted", None
    host = m[1].lower().rstrip(".")
    labels, steps = host.split("."), [x for x in (m[2] or "").split("/") if x]
    keys = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(steps[:i]) for i in range(1, len(steps) + 1)}
    best = None
    for key in keys:
        log = defaultdict(list)
        for rule, day, action in entries:
            if rule is not None and re.sub("^[^/]*", lambda m: m[0].lower(), rule) == key and day is not None and action in urlfilter.STRICTNESS:
                log[day].append(action)
        active = [d for d in log if d <= at]
        if active:
            action = max(log[max(active)], key=urlfilter.STRICTNESS.get)
            if action != "remove" and (best is None or len(key) > len(best[1])):
                best = action, key
    return best or ("unlisted", None)


def test_url_list_is_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "com"]
    entries = [(rng.choice([*hosts, "a.com/p", "b.a.com/p/q", "B.a.com/P", "A.com/p/Q"]), f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", rng.choice(["block", "allow", "remove"])) for _ in range(60)]
    entries += [(None, "2024-01-01", "block"), ("x.org", None, "block"), ("x.org", "2024-01-01", "typo")]
    urls = [f"http://{rng.choice(hosts).upper()}:80/{rng.choice(['', 'p', 'p/q/', 'P', 'p/Q', 'z?x=1'])}" for _ in range(120)]
    urls += [None, "", "no url", "https://user@x.org#frag"]
    data = [(i, u, None if i == 5 else f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}") for i, u in enumerate(urls)] + [(0, urls[0], "2024-05-05")] * 3
    data += [(900, "http://a.com/p", "0001-01-01"), (901, "http://a.com/p", "9999-12-31"), (902, "http://x.org/", "1969-12-31")]
    caps = spark.createDataFrame(data, "page_id long, url string, fetched_at string").withColumn("rule", F.lit("clash"))
    list_ = spark.createDataFrame(entries, "rule string, listed_at string, action string")
    want = sorted(((i, *brute_url(u, at, entries)) for i, u, at in data), key=repr)
    for size in (1 << 20, 0):  # broadcast, or join
        assert rows(urlfilter.evaluate(caps, list_, broadcast_bytes=size).select("page_id", "verdict", "rule"), "page_id", "verdict", "rule") == want
    assert {r.verdict for r in urlfilter.evaluate(caps, list_.limit(0)).select("verdict").collect()} == {"unlisted"}
    assert urlfilter.evaluate(caps.limit(0), list_).count() == 0


# --- top-k


def brute_topk(data, k=5, step=50):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, (i, w) in enumerate(ok) if j != at and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [4096, 70])
def test_topk_is_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in np.float32(rng.normal(size=9) * (50 if i % 13 == 0 else 0.3))]) for i in range(500)]
    data += [(i, [1.0] * 9) for i in range(500, 700)]  # many copies
    data += [(700, None), (701, [None] * 9), (702, [float("nan")] * 9), (703, [float("inf")] * 9), (None, [1.0] * 9), (750, [0.0] * 9), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (850, []), (900, [-1.0] * 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    index, sizes = topk.build_index(df, block_rows=block_rows)
    assert rows(topk.search(index, sizes, df.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id", "score") == brute_topk(data)


def test_topk_of_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(15)
    data = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** (i % 6)]) for i in range(120)]
    data += [(0, [1e6, 9e5, 0.0]), (0, [1e6, 9e5, 0.0]), (50, [9e5, 1e6, -3.0]), (7, [2.0**27, -(2.0**27), 1.0]), (7, [2.0**27, -(2.0**27), 1.0])]
    data += [(100, [-1e6, 0.0, 0.5])] * 4 + [(800, [1e12]), (801, [1e2]), (802, [-10.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for block_rows in (4096, 30):
        index, sizes = topk.build_index(df, block_rows=block_rows)
        found = topk.search(index, sizes, df.where("vec_id % 50 = 0"), query_rows=3)
        assert rows(found, "query_id", "rank", "vec_id", "score") == brute_topk(data)
    wide = spark.createDataFrame([(0, [2.0**53]), (1, [2.0**53])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.search(*topk.build_index(wide), wide.where("vec_id = 0")).collect()


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(*topk.build_index(df), df).count() == 0


# --- HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header class='site-header'><a href='/'>Home</a></header>"
    "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class=\"cookie-notice\">We use cookies</div><!-- ad --><div class='ad'>Buy</div>"
    "<{tag}><h1>Title {n} &amp; more</h1><p>First  para\n{n} <b>bold{n}</b>&nbsp;x{n}<p>Second &#233; {n}<br>line {n}<form><input value=1><button>Go</button></form>"
    "<aside>Related</aside><div class='comments'><p>reader says</p></div><ul><li>one {n}<li>two {n}</ul></{tag}><footer>&copy; foot {n}</footer></body></html>"
)
TEXT = "Title {n} & more\n\nFirst para {n} bold{n} x{n}\n\nSecond é {n} line {n}\n\none {n}\n\ntwo {n}"


def test_html_articles_and_slots(spark):
    data = [(i, f"http://h{i % 3}.com/{i}", PAGE.format(tag="article", n=i)) for i in range(12)]
    data += [(20 + i, f"http://plain.com/{i}", PAGE.format(tag="div", n=i)) for i in range(10)]  # only the template tells
    data += [(40, "http://h1.com/x", None), (41, None, ""), (42, "http://one.com", "<p>lonely <b>page"), (43, "http://h2.com/", "<<<a <b"), (44, "http://h2.com/y", "<article>" + "<p>w</p>" * 5000)]
    df = spark.createDataFrame([*data, data[0]], "page_id long, url string, html string").withColumns({n: F.lit("clash") for n in ("slots", "runs", "host", "template_key", "Template_host", "template_of", "main_text", "tokens")})
    for size in (1 << 20, 0):
        got = rows(htmltext.extract_main(df, broadcast_bytes=size), "page_id", "main_text")
        assert len(got) == len(data) + 1
        found = dict(got)
        assert all(found[i] == TEXT.format(n=i) for i in range(12)) and all(found[20 + i] == TEXT.format(n=i) for i in range(10))
        assert found[40] == found[41] == "" and found[42] == "lonely page" and found[44] == "\n\n".join(["w"] * 5000)
    assert htmltext.extract_main(df.limit(0)).count() == 0


def test_helper_tables_can_be_deleted(spark):
    from trailspark.llm import common

    df = spark.createDataFrame([(1, "http://a.com/", "<article><p>x</p></article>")], "page_id long, url string, html string")
    assert htmltext.extract_main(df).first().main_text == "x"
    left = [p.removeprefix("file://") for p in common._made]
    assert any("page-templates" in p for p in left) and all(os.path.exists(p) for p in left if "page-t" in p)
    common.clean_up(spark)
    assert not common._made and not any(os.path.exists(p) for p in left)


def test_html_copies_of_an_article_are_kept(spark):
    df = spark.createDataFrame([(i, "http://same.com/", PAGE.format(tag="article", n=1)) for i in range(8)], "page_id long, url string, html string")
    assert {r.main_text for r in htmltext.extract_main(df).collect()} == {TEXT.format(n=1)}


def brute_templates(pages):
    """Occurrence vectors as dictionaries of pages, without hashes of them or partial sums: host -> (slots, runs, links)."""
    by_host = defaultdict(list)
    for at, (_, url, html) in enumerate(pages):
        m = re.match(r"[A-Za-z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        rows_, longest = htmltext.tokens(html)
        by_host[m[1].lower().rstrip(".") if m else ""].append((at, rows_, longest))
    by_host[htmltext.ALL] = [x for ps in list(by_host.values()) for x in ps]
    out = {}
    for host, ps in by_host.items():
        if len(ps) < htmltext.MIN_PAGES and host != htmltext.ALL:
            continue
        vector, chars, linked, up, tag, kind, seen = defaultdict(dict), Counter(), Counter(), {}, {}, {}, defaultdict(set)
        for at, rows_, longest in ps:
            for token, parent, k, t, n, c, x in rows_:
                linked[token] += x
                vector[token][at] = n
                chars[token] += c
                up[token], tag[token], kind[token] = parent if token else None, t, k
                seen[token].add(longest % 64)
        frequent = [t for t in vector if 2 * len(vector[t]) >= len(ps)]
        same = lambda t: [u for u in frequent if vector[u] == vector[t]]
        valid = {t for t in frequent if kind[t] != htmltext.RUN and len(same(t)) > 1} | {0}
        above = lambda t: [] if up[t] is None else [up[t], *above(up[t])]
        elements = [t for t in valid if kind[t] == htmltext.ELEMENT and all(u in valid for u in above(t))]
        runs = [t for t in frequent if kind[t] == htmltext.RUN and len(seen[t]) >= htmltext.DIFFERING and any(u in elements or u == 0 for u in same(t))]
        left = {t: chars[t] - sum(chars[r] for r in runs if t in above(r)) for t in vector}
        full = [t for t in elements if set(vector[t].values()) == {1} and tag[t] in htmltext._HOLDS_BLOCKS and left[t] >= max(1, 0.7 * left[0])]
        mains = [t for t in full if tag[t] in ("article", "main")]
        full = [t for t in full if not any(u in mains for u in above(t))]
        best = max(full, key=lambda t: (len(above(t)), left[t], -t), default=None)
        slots = [best] if best is not None and tag[best] not in ("body", "html") else []
        if not slots:
            named = [t for t in elements if tag[t] in ("article", "main")]
            slots = sorted(t for t in named if up[t] not in named)
        out[host] = slots, sorted(runs), sorted(t for t in elements if tag[t] in htmltext._HOLDS_BLOCKS and linked[t] > chars[t] and t not in slots)
    return out


STRAP = (
    "<html><body><div class='top'><p>The Daily Bugle</p><a href='/'>Home</a></div><div class='mid'><p class='strap'>All the news that fits</p><h1>Head {n}</h1>"
    "<p>{said}</p><p>More {n} {said}</p></div><div class='low'><p>Printed by Bugle Ltd, 1 High Street</p></div></body></html>"
)


def strap_pages(rng, count, host="bugle.com"):
    return [(i, f"http://{host}/{i}", STRAP.format(n=i, said=prose(rng, 40))) for i in range(count)]


def test_html_template_text_goes(spark):
    """Constant straps and legal lines of a host without an article are template; without it they stay."""
    data = strap_pages(random.Random(71), 10)
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = dict(rows(htmltext.extract_main(df), "page_id", "main_text"))
    said = [re.findall("<p>(.*?)</p>", h)[1:3] for _, _, h in data]
    assert got == {i: f"Head {i}\n\n{said[i][0]}\n\n{said[i][1]}" for i in range(10)}
    alone = htmltext.extract(data[0][2])
    assert "All the news" in alone and "Printed by" in alone and "Bugle" in alone
    inside = [(i, u, h.replace("class='mid'", "role='main'")) for i, u, h in data]
    assert dict(rows(htmltext.extract_main(spark.createDataFrame(inside, df.schema)), "page_id", "main_text")) == got


def test_html_template_deduction_is_brute_force(spark):
    rng = random.Random(72)
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    pages += strap_pages(rng, 20) + [(0, None, None), (1, "no url", "<p>x"), (2, "http://bugle.com/", "<div><div>")]
    for i in range(30):  # some elements and lines on part of the pages only
        part = "<div class='share'><p>Share this story</p></div>" if i % 3 else ""
        pages.append((900 + i, f"http://odd.org/{i}", f"<body><main><h2>{prose(rng, 3)}</h2>{part}<p>{prose(rng, 30)}</p>{'<p>often</p>' * (i % 2)}</main><div>{prose(rng, 2)}</div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: (r.slots, r.runs, r.links) for r in htmltext.templates(df.repartition(7)).collect()}
    want = brute_templates(pages)
    assert got == want and len(want) > 3 and want["odd.org"][1] and want["bugle.com"][1]
    texts = {r.page_id: r.main_text for r in htmltext.extract_main(df).where("url LIKE 'http://odd.org/%'").collect()}
    assert not any("Share this" in t for t in texts.values())


def test_html_template_decides_without_names(spark, monkeypatch):
    """The given pages with their articles renamed and all lists of names empty: the slot is still the article, and only by its template."""
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    want = [htmltext.extract(h) for _, _, h in given]
    never = re.compile(r"(?!)")
    for name, empty in (("_FURNITURE", frozenset()), ("_ROLES", frozenset()), ("_HEADERS", frozenset()), ("_MAIN", frozenset()), ("_NAMES", never), ("_ODD_NAMES", never)):
        monkeypatch.setattr(htmltext, name, empty)
    renamed = [(i, u, re.sub(r"(</?)article\b", r"\1div", h)) for i, u, h in given]
    found = brute_templates(renamed)
    got, alone = [], []
    for _, url, h in renamed:
        host = re.match(r"\w+://(?:[^/?#@]*@)?([^/?#:]+)", url)[1].lower()
        got.append(htmltext.extract(h, *found.get(host, found[htmltext.ALL])))
        alone.append(htmltext.extract(h))
    assert got == want
    assert sum(a != w for a, w in zip(alone, want, strict=True)) > 0.9 * len(want)


def test_html_extraction_is_brute_force(spark):
    """The texts of 250 given pages against blocks cut out by patterns alone."""
    import html as html_lib

    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries.op5_html_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html or "", re.S)[1]
        body = re.sub(r"<br\s*/?>", "\n", re.sub(r"<!--.*?-->", "", body, flags=re.S))
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|h2|p|ul|ol|li|div|blockquote|pre|table|tr|td)\b[^>]*>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b), r.page_id


def test_html_formulas_labels_and_slots_of_any_name(spark):
    """Text of formulas, labels and code stays; a slot inside an element that names would drop is still the slot; lists of links in it go."""
    page = (
        "<body><form id='aspnet'><div class='menu'><a href='/a'>A</a></div><div class='box'><h1>T{n}</h1><p>Let {n} <math><mi>x{n}</mi><mo>={n}</mo></math> be {n} <code>a&lt;b{n}</code>.{n}</p>"
        "<p><label>Note {n}</label> and {n} <object>fallback {n}</object></p><div class='more'><a href='/1'>See also one {n}</a> <a href='/2'>and two</a></div><p>{said}</p></div><div class='low'>Legal {n}</div></form></body>"
    )
    rng = random.Random(5)
    data = [(i, "http://any.com/", page.format(n=i, said=prose(rng, 30))) for i in range(12)]
    got = dict(rows(htmltext.extract_main(spark.createDataFrame(data, "page_id long, url string, html string")), "page_id", "main_text"))
    said = {i: re.search(r"<p>([^<]*)</p></div><div class='low'>", h)[1] for i, _, h in data}
    assert got == {i: f"T{i}\n\nLet {i} x{i}={i} be {i} a<b{i}.{i}\n\nNote {i} and {i} fallback {i}\n\n{said[i]}" for i in range(12)}
    own = htmltext.extract("<article><p>Let <math><mi>x</mi></math> be.</p><p><label>L</label> m</p></article>")
    assert own == "Let x be.\n\nL m"


def test_html_article_parts_under_doubtful_names_stay(spark):
    page = "<body><article><h1>T{n}</h1><div class='search'><p>How binary search works {n}</p></div><div class='related'><a href='/x'>More like this</a> <a href='/y'>and this</a></div><p>End.</p></article></body>"
    df = spark.createDataFrame([(i, "http://s.com/", page.format(n=i)) for i in range(3)], "page_id long, url string, html string")
    assert dict(rows(htmltext.extract_main(df), "page_id", "main_text")) == {i: f"T{i}\n\nHow binary search works {i}\n\nEnd." for i in range(3)}


@pytest.mark.parametrize("page", ["<i>" * 400_000 + "</b>" * 400_000, "<b><article>" + "<i>" * 300_000 + "</b>" * 300_000, "<a" * 2_000_000, "<div>" * 100_000 + "x", "<p/><i>" * 300_000, "<i '\">" * 400_000, "<!-- " * 500_000, "<script " * 400_000, "<td><b class='a b c d e f'>" * 100_000])
def test_html_malformed_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    htmltext.tokens(page)
    htmltext.extract(page, [1], [2])
    assert time.perf_counter() - began < 30


def test_html_deep_pages_and_many_classes_have_their_own_tokens():
    deep = "<div>" * 10_000 + "{}" + "</div>"
    a, b = ({t for t, *_ in htmltext.tokens(deep.format(x))[0]} for x in ("<p>x</p>", "<ul>x</ul>"))
    assert len(a) == len(b) == 10_003 and len(a & b) == 10_001
    a, b = ({t for t, *_ in htmltext.tokens(f"<div class='a b c d {x}'></div>")[0]} for x in "ef")
    assert len(a & b) == 1


# --- SimHash


def brute_fingerprint(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[root(i)].append(x)
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash_is_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng, 200) for _ in range(6)]
    texts = nasty(rng) + base * 2
    for b in base:
        for _ in range(12):
            words = b.split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(200)] = rng.choice(WORDS)
            texts.append(" ".join(words))
    got = simhash.near_duplicates(documents(spark, texts)).select("doc_id", simhash.hexadecimal().alias("h"), "component_id").orderBy("doc_id").collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert [r.h for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == brute_components(range(len(texts)), fps)
    kept = simhash.keep_first(documents(spark, texts))
    assert kept.count() == len({r.component_id for r in got}) and kept.columns == documents(spark, texts).columns


def test_covering_masks_cover():
    rng = random.Random(7)
    for level, positions in ((0, list(range(64))), (1, list(range(5, 35)))):
        masks = simhash.covering_masks(positions, 3, level)
        assert len(masks) == 15 and all(m for m in masks)
        for _ in range(3000):
            bits = sum(1 << p for p in rng.sample(positions, 3))
            assert any(not m & bits for m in masks)


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_of_hot_buckets_are_complete(spark, bucket):
    """Chains and balls of fingerprints that share most bits, with buckets small enough to be covered again."""
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(16), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges, _ = simhash.links(nodes, bucket=bucket)
    pairs = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in edges.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[root(a)] = root(b)
    want = brute_components(range(len(fps)), fps)
    assert len({root(x) for x in fps}) == len(set(want))


def test_components_of_a_long_chain(spark):
    order = list(range(600))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (1000, 1001)], "a long, b long")
    found, _ = simhash.components(edges)
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(1, 600)} | {1001: 1000}


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    df = documents(spark, ["a b", "a b", "c"]).withColumn("doc_id", F.when(F.col("text") == "a b", F.lit(None).cast("long")).otherwise(5))
    assert rows(simhash.near_duplicates(df), "doc_id", "component_id") == sorted([(None, None), (None, None), (5, 5)], key=repr)
    assert rows(simhash.keep_first(df), "doc_id", "text") == [(5, "c"), (None, "a b")]


def test_more_languages_than_a_word_of_a_mask(spark):
    data, ids = [], iter(range(10_000))
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        text = " ".join("".join(letters[i : i + 4]) for i in range(9))
        data += [(next(ids), text, f"l{k:02}") for _ in range(12 if k < 64 else 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 70 and model.masks.shape == (2, langid.SLOTS)
    found = langid.identify(docs, model).select("lang", "language.lang_pred").distinct().collect()
    assert {(r.lang, r.lang_pred) for r in found} == {(f"l{k:02}", f"l{k:02}") for k in range(70)}


def brute_shingles(text):
    words = text.encode().translate(simhash._LOWER).split() if text else []
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pairs_that_go_past_are_brute_force(spark, monkeypatch):
    """Several chunks, batches and sizes of sketches: every pair of other parts that is alike is there, and few others."""
    rng = random.Random(62)
    monkeypatch.setattr(shingles, "CHUNK", 7)
    texts = []
    for base_words in (120, 130, 260):
        base = [f"b{base_words}x{rng.randint(0, 9999)}" for _ in range(base_words)]
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(base_words), rng.randint(0, 7)):
                words[at] = f"new{rng.random()}"
            texts.append(" ".join(words[: rng.randint(base_words - 12, base_words)]))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    data = [(k, r.node, r.node if i % 3 else 5, len(brute_shingles(r.text))) for i, r in enumerate(df.select(F.xxhash64("text").alias("node"), "text").collect()) for k in range(2 if i % 2 else 1)]
    found, _ = shingles.across(spark.createDataFrame(data, "bucket long, node long, part long, n long").repartition(5), df, text="text", similarity=0.8)
    got = {tuple(r) for r in found.collect()}
    node = dict(zip((r.node for r in df.select(F.xxhash64("text").alias("node")).collect()), map(brute_shingles, texts), strict=True))
    part = {i: p for _, i, p, _ in data}
    jaccard = {(a, b): len(node[a] & node[b]) / len(node[a] | node[b]) for a in node for b in node if a < b and part[a] != part[b]}
    assert {x for x, j in jaccard.items() if j >= 0.8} <= got <= set(jaccard) and len(got) < 1.5 * sum(j >= 0.8 for j in jaccard.values())


def test_near_duplicates_by_similarity_are_brute_force(spark):
    """Copies with several changed words, most beyond three bits, in groups of one bucket and in large ones."""
    rng = random.Random(61)
    texts = nasty(rng)
    for copies, most in ((1, 7), (3, 7), (40, 7), (90, 12)):  # most of the last group are alike to none
        base = prose(rng, 200, WORDS + [f"w{i}" for i in range(500)]).split()
        for _ in range(copies + 1):
            words = list(base)
            for at in rng.sample(range(200), rng.randint(0, most)):
                words[at] = f"new{rng.random()}"
            words[rng.randint(150, 200) :] = []
            texts.append(" ".join(words))
    fps, sets = [brute_fingerprint(t) for t in texts], [brute_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if (fps[i] ^ fps[j]).bit_count() <= 3 or alike:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = simhash.near_duplicates(documents(spark, texts), similarity=0.8).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label != brute_components(range(len(texts)), fps)
    assert corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), SMALL).count() == len(set(label))


# --- quality


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_keep_first_is_brute_force(spark, broadcast_bytes):
    rng = random.Random(21)
    texts = [prose(rng, 60) for _ in range(12)]
    data = [(i, texts[i % 12]) for i in range(1, 40)] + [(100 + i, t) for i, t in enumerate(nasty(rng))] + [(5, texts[5]), (200, "once more"), (200, "once more"), (None, texts[1]), (None, None)]
    data += [(1, "another text of a used id"), (None, "only nulls have this"), (None, "only nulls have this"), (None, "Only NULLS have this")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    out = simhash.keep_first(df, broadcast_bytes=broadcast_bytes)
    order = sorted(data, key=lambda x: (x[0] is None, x[0] or 0))
    parts = brute_components(range(len(order)), [brute_fingerprint(t) for _, t in order])
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns
    want = {part: order[part][0] for part in parts}  # the id that stays, of one of its texts in the group
    texts_of = {part: {t for (i, t), q in zip(order, parts, strict=True) if q == part and i == want[part]} for part in want}
    left = dict(texts_of)
    for i, t in got:
        part = next(q for q in left if want[q] == i and t in left[q])
        del left[part]
    assert not left and len(got) == len(want)
    assert simhash.keep_first(df.limit(0), broadcast_bytes=broadcast_bytes).count() == 0


def test_quality_accuracy_and_cases(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_quality(spark, sf)
    joined = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert joined.agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.97
    docs = documents(spark, nasty(random.Random(9)))
    none = quality.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r.keep for r in quality.score(docs, none).select("quality_score.keep").collect()} == {True}
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    odd = docs.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    assert quality.score(odd, model).where("quality_score.score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_of_labels_kept_out(spark):
    """Accuracy on a third of the labels that the fit never sees, with and without pseudo-labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = {}
    for rounds in (0, quality.ROUNDS):
        model = quality.fit(docs, labels.where(~out), rounds=rounds)
        scored = quality.score(docs, model).join(labels.where(out), "doc_id")
        found[rounds], n = scored.agg(F.avg((F.col("quality_score.keep").cast("int") == F.col("quality")).cast("int")), F.count("*")).first()
    print("accuracy without and with pseudo-labels", found, n)
    assert n > 100 and found[quality.ROUNDS] > 0.96 and found[quality.ROUNDS] >= found[0] - 0.01


def test_quality_reads_the_samples_in_one_pass(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    passes, plain = [], quality._features
    monkeypatch.setattr(quality, "_features", lambda *a: passes.append(a[0]) or plain(*a))
    model = quality.fit(docs, labels)
    assert len(passes) == 1 and len(model.views) == 2


def newton(x, y, ridge):
    """The minimum of the ridge's loss, in plain Python: gradient descent with halving steps."""
    n, width = len(x), len(x[0])
    mean = [sum(r[j] for r in x) / n for j in range(width)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in x) / n) or 1.0 for j in range(width)]
    z = [[(r[j] - mean[j]) / scale[j] for j in range(width)] + [1.0] for r in x]
    cost = [ridge] * width + [1e-6]

    def loss(w):
        s = [sum(a * b for a, b in zip(r, w, strict=True)) for r in z]
        return sum(math.log1p(math.exp(-abs(t))) + max(t, 0) - t * k for t, k in zip(s, y, strict=True)) + sum(c * v * v for c, v in zip(cost, w, strict=True)) / 2

    w, rate, now = [0.0] * (width + 1), 1.0, None
    for _ in range(4000):
        p = [1 / (1 + math.exp(-sum(a * b for a, b in zip(r, w, strict=True)))) for r in z]
        slope = [sum((pi - yi) * r[j] for pi, yi, r in zip(p, y, z, strict=True)) + cost[j] * w[j] for j in range(width + 1)]
        now = loss(w) if now is None else now
        while (new := loss(step := [a - rate * b for a, b in zip(w, slope, strict=True)])) > now - 0.25 * rate * sum(b * b for b in slope) and rate > 1e-12:
            rate /= 2
        w, now, rate = step, new, rate * 1.5
        if max(map(abs, slope)) < 1e-7:
            break
    return lambda r: sum(v * (a - m) / s for v, a, m, s in zip(w, r, mean, scale, strict=False)) + w[-1]


def test_fit_calibration_and_a_round_are_brute_force():
    """Two views of two features, one round: each step again in plain Python."""
    rng = random.Random(11)
    make = lambda k: ([rng.gauss(k * 2 - 1, 1), rng.gauss(0, 1)], [rng.gauss(0, 1), rng.gauss(k * 2 - 1, 1)])
    y = [rng.randrange(2) for _ in range(60)]
    views = list(zip(*(make(k) for k in y), strict=True))
    pool = list(zip(*(make(rng.randrange(2)) for _ in range(80)), strict=True))
    model = quality.co_train(*map(np.array, views), np.array(y), *map(np.array, pool), rounds=1, per_round=10, confident=0.9)
    own = [[i for i in range(60) if y[i] == c] for c in (0, 1)]
    held = sorted(i for o in own for i in o[::10])
    combine = sorted(i for o in own for i in o[5::10])
    train = [i for i in range(60) if i not in held and i not in combine]
    share = sum(y[i] for i in train) / len(train)
    sets = [([v[i] for i in train], [y[i] for i in train]) for v in views]
    squash = lambda t: 1 / (1 + math.exp(-t))
    first = [newton(*s, 1.0) for s in sets]
    scales = [newton([[f(v[i])] for i in held], [y[i] for i in held], 1e-2) for f, v in zip(first, views, strict=True)]
    new = []
    for teacher in (0, 1):
        p = [squash(scales[teacher]([first[teacher](r)])) for r in pool[teacher]]
        for label, quota in ((1, share), (0, 1 - share)):
            sure = sorted(((label * q + (1 - label) * (1 - q), -j) for j, q in enumerate(p)), reverse=True)
            new += [(1 - teacher, -j, label) for s, j in sure[: max(1, round(10 * quota))] if s >= 0.9]
    for pupil, j, label in new:
        sets[pupil][0].append(pool[pupil][j])
        sets[pupil][1].append(label)
    assert new
    last = [newton(*s, 1.0) for s in sets]
    scales = [newton([[f(v[i])] for i in held], [y[i] for i in held], 1e-2) for f, v in zip(last, views, strict=True)]
    said = lambda a, b: [scales[0]([last[0](a)]), scales[1]([last[1](b)])]
    both = newton([said(views[0][i], views[1][i]) for i in combine], [y[i] for i in combine], 1e-2)
    got = model.probabilities(*map(np.array, pool))
    for j, (a, b) in enumerate(zip(*pool, strict=True)):
        s = said(a, b)
        assert np.allclose([g[j] for g in got], [squash(s[0]), squash(s[1]), squash(both(s))], atol=2e-3)


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(10)
    y = np.tile([0, 1], 40)
    view = lambda y, noise: y[:, None] * 2.0 + rng.normal(size=(len(y), 3)) * noise
    pool_y = rng.integers(0, 2, 400)
    model = quality.co_train(view(y, 0.5), view(y, 1.0), y, view(pool_y, 0.5), view(pool_y, 1.0))
    a, b, both = model.probabilities(view(pool_y, 0.5), view(pool_y, 1.0))
    assert ((both > 0.5) == pool_y).mean() > 0.95 and ((b > 0.5) == pool_y).mean() > 0.8


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(11)
    big, other = prose(rng, 300), "é漢" * 600
    data = [(1, "http://a/", big), (2, None, big), (3, "http://c/\r\nX: y", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", prose(rng, 400_000)), (None, "u", big), (3, "http://c/", big)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash")).repartition(3)
    index, folder = warc.write_bundles(df, f"file://{tmp_path}/out", frame_bytes=5000)
    got = warc.read_bundles(spark, index)
    want = []
    for i, _, html in data:
        payload = (html or "").encode()
        revisit = html == big and i != 3
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, True))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert rows(got, *names) == sorted(want, key=repr)
    assert rows(warc.read_records(index), *names) == sorted(want, key=repr)
    assert index.count() == len(data) and index.select("frame").distinct().count() > 1
    empty, _ = warc.write_bundles(df.limit(0))
    assert warc.read_bundles(spark, empty).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_warc_of_repeated_ids_and_attempts(spark, tmp_path, broadcast_bytes):
    """Rows that repeat an id have records of their own; what other attempts leave is not read, and goes."""
    rng = random.Random(81)
    big = [prose(rng, 300) for _ in range(3)]
    data = [(i % 20, f"http://a/{i % 7}", big[i % 3] if i % 2 else f"small {i}") for i in range(120)] + [(5, "u", big[0]), (5, "u", big[0]), (None, None, big[1])]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    folder = f"{tmp_path}/out"
    index, _ = warc.write_bundles(df, f"file://{folder}", frame_bytes=3000, broadcast_bytes=broadcast_bytes)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    top = {h: max(i for i, _, x in data if x == h and i is not None) for h in big}
    digest = lambda h: hashlib.sha1(h.encode()).hexdigest()
    want = sorted(((i, len(h), digest(h), "revisit" if h in top and i != top[h] else "response", top[h] if h in top and i != top[h] else None, True) for i, _, h in data), key=repr)
    assert rows(warc.read_records(index), *names) == rows(warc.read_bundles(spark, index), *names) == want
    ids = Counter(r.record_id for r in index.collect())
    assert len(ids) == len(set(data))
    found = {r.record_id: r for r in warc.read_records(index).collect()}
    assert set(found) == set(ids)
    again, _ = warc.write_bundles(df.repartition(3), f"file://{folder}", frame_bytes=3000, broadcast_bytes=broadcast_bytes)  # leaves the first bundles alone
    for x in (index, again):
        assert rows(warc.read_records(x), *names) == want and Counter(r.record_id for r in x.collect()) == ids
    named = index.first().bundle.removeprefix("file://")
    left = named.replace(named[-21:], "0123456789ab.warc.zst")  # of an attempt that was lost
    shutil.copy(named, left)
    assert warc.drop_orphans(index, f"file://{folder}") == 1 and not os.path.exists(left)
    assert rows(warc.read_records(index), *names) == want


def test_seek_table_is_a_plain_zstd_stream(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    bundle = warc.BundleWriter(out, 100)
    at = [bundle.add(bytes([65 + i]) * 60) for i in range(5)]
    bundle.close()
    data = out.getvalue()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(bytes([65 + i]) * 60 for i in range(5))
    reader = warc.BundleReader(io.BytesIO(data), len(data))
    assert [reader.frame(f)[o : o + n] for f, o, n in at] == [bytes([65 + i]) * 60 for i in range(5)]


# --- mixing


def test_targets_share_and_stop():
    assert [float(x) for x in mixing.targets([10, 10, 10], [1, 2, 3])] == [5, 10, 15]
    found = [float(x) for x in mixing.targets([100, 1, 0], [1, 2, 3])]
    assert found == [98, 3, 0]


def test_permutations_are_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))


def test_mixing_totals_limits_and_text(spark):
    rng = random.Random(12)
    data = [(i, prose(rng, rng.choice([0, 1, 7, 400, 3000])), None if i % 7 == 0 else f"s{min(i % 5, 2)}") for i in range(150)]
    data += [(500, None, "s1"), (501, "", "tiny"), (502, "a\x1cb c", "tiny"), (503, "repeat id", "s1"), (503, "repeat id", "s1")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(1))
    first = mixing.mix(df, block_words=16, shard_slots=64, with_text=True)
    out = mixing.taken(first)
    got = out.collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in data}
    assert len(got) == len(data) and all(r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    by_source = defaultdict(int)
    for r in got:
        by_source[r.target, r.source_size] += r.taken
    assert all(abs(n - target) <= 4 * 16 for (target, _), n in by_source.items())
    again = mixing.taken(mixing.mix(df.repartition(7), block_words=16, shard_slots=64))
    names = ("doc_id", "size", "target", "taken")
    assert rows(out, *names) == rows(again, *names)
    text = mixing.packed(first).collect()
    assert sum(len(r.text.encode().split()) for r in text) == sum(r.taken for r in got)
    assert len({(r.shard, r.slot) for r in text}) == len(text) and max(len(r.text.encode().split()) for r in text) <= 16
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0


def brute_mix(data, block_words, shard_slots, most=3):
    """Words taken of each row, by laying out streams, drawing shards and permuting blocks without any table."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in data}, key=lambda s: (s is None, s or ""))
    n_buckets = max(1, int(np.sqrt(len(data))))
    hashed = lambda i: queries_hash[i] % n_buckets
    streams = {s: sorted((hashed(i), i, size(t), at) for at, (i, t, x) in enumerate(data) if x == s) for s in names}
    sizes = [sum(n for _, _, n, _ in streams[s]) for s in names]
    goals = mixing.targets(sizes, [1 + k % 3 for k in range(len(names))], most)
    blocks = [-(-n // block_words) for n in sizes]
    wanted = [min(round(g * b / n), b * most) if n else 0 for g, b, n in zip(goals, blocks, sizes, strict=True)]
    rng, left, order = np.random.default_rng(mixing.SEED), np.array(wanted), []
    while left.any():
        drawn = mixing.draw(left, shard_slots, rng)
        order.append(drawn)
        left = left - drawn
    assert sum(order).tolist() == wanted and all(int(x.sum()) == shard_slots for x in order[:-1])
    taken = Counter()
    for k, s in enumerate(names):
        times = Counter()
        for j in range(wanted[k]):
            times[int(mixing.permute(np.array([j % blocks[k]]), blocks[k], mixing.SEED + 31 * k + 7919 * (j // blocks[k]))[0])] += 1
        at = 0
        for _, _, n, row in streams[s]:
            taken[row] += sum(times[w // block_words] for w in range(at, at + n))
            at += n
    return [(i, size(t), sizes[names.index(s)], float(goals[names.index(s)]), taken[at]) for at, (i, t, s) in enumerate(data)]


queries_hash: dict = {}


@pytest.mark.parametrize(("groups", "shard_slots"), [(4096, 40), (4096, 100_000)])
def test_mixing_is_brute_force(spark, monkeypatch, groups, shard_slots):
    rng = random.Random(91)
    data = [(i, prose(rng, rng.choice([0, 3, 50, 400])), rng.choice(["a", "b", "c", "d", None])) for i in range(120)] + [(500, None, "a"), (501, "one word", "tiny")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    queries_hash.update({r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("h")).collect()})
    got = mixing.taken(mixing.mix(df, block_words=16, shard_slots=shard_slots))
    assert rows(got, "doc_id", "size", "source_size", "target", "taken") == sorted(brute_mix(data, 16, shard_slots), key=repr)


def test_mixing_in_groups_of_shards(spark, monkeypatch):
    """More shards than groups: sizes of shards, totals and limits stay."""
    monkeypatch.setattr(mixing, "GROUPS", 4)
    rng = random.Random(92)
    data = [(i, prose(rng, rng.choice([5, 300])), rng.choice(["a", "b", None])) for i in range(80)]
    mixed = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block_words=16, shard_slots=10)
    slots = mixed.slots.collect()
    of_shard = Counter(r.shard for r in slots)
    assert len(of_shard) > 20 and sorted(of_shard.values(), reverse=True)[len(of_shard) - 2] == 10 and len({(r.shard, r.slot) for r in slots}) == len(slots)
    assert {r.slot for r in slots if r.shard == 0} == set(range(10))
    uses = Counter((r.source_ix, r.block) for r in slots)
    assert max(uses.values()) - min(uses.values()) <= 3 and max(uses.values()) <= 3
    for r in mixing.taken(mixed).collect():
        assert r.taken <= 3 * r["size"]
    by_source = {r.source_ix: r.target for r in mixed.sources.collect()}
    assert all(abs(16 * sum(n for (s, _), n in uses.items() if s == k) - target) <= 64 for k, target in by_source.items())


def test_word_counts_are_brute_force(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("a\u00e9\u4e2d \t\n\v\f\r\0\1\2\x1c\x85\u00a0") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " \n ", "\1\2 \2\1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("n", mixing.size_of(F.col("t")))
    assert rows(df, "i", "n") == sorted(((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in enumerate(texts)), key=repr)


def test_mixing_of_a_source_below_one_block(spark):
    df = spark.createDataFrame([(1, "w " * 50, "a"), (2, "w " * 3000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.taken(mixing.mix(df)).collect()}
    assert (got[1].target, got[1].taken) == (150, 150)
    assert abs(got[2].taken - got[2].target) <= 2 * mixing.BLOCK_WORDS


# --- preferences


def brute_pairs(turns, size=preference.SEGMENT_TURNS):
    """pair -> segment -> prompt, chosen, rejected, their masks, paired."""
    found = defaultdict(lambda: {"chosen": defaultdict(list), "rejected": defaultdict(list)})
    out = []
    for c, t, r, x in turns:
        t = preference.LAST if t is None else t
        text = f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n"
        if c is None:
            span = [(len(text) - len(f"{x or ''}<|im_end|>\n"), len(text) - 1)] if r == "assistant" else []
            out.append((None, 0, "", text, "", span, [], False))
        else:
            found[c // 2]["rejected" if c % 2 else "chosen"][t].append((r, x))
    for p, sides in found.items():
        a, b = sides["chosen"], sides["rejected"]
        cut = min((t for t in {*a, *b} if not (len(a[t]) == len(b[t]) == 1 and a[t] == b[t])), default=None)
        a, b = ({t: ms for t, ms in x.items() if ms} for x in (a, b))
        numbers = {*a, *b}
        top = max(numbers - {preference.LAST}, default=0)
        of = lambda t: min(t, top) // size if len(numbers) > size else 0  # noqa: B023, E731
        for segment in {of(t) for t in numbers}:
            said = {"prompt": "", "chosen": "", "rejected": ""}
            masks = {"prompt": [], "chosen": [], "rejected": []}
            for side, ts in (("chosen", a), ("rejected", b)):
                for t in sorted(t for t in ts if of(t) == segment):
                    place = "prompt" if cut is None or t < cut else side
                    for r, x in sorted(ts[t], key=lambda m: tuple((v is not None, v or "") for v in m)) if (place, side) != ("prompt", "rejected") else ():
                        head = f"<|im_start|>{r or ''}\n"
                        body = f"{x or ''}<|im_end|>\n"
                        if r == "assistant":
                            masks[place].append((len(said[place]) + len(head), len(said[place]) + len(head + body) - 1))
                        said[place] += head + body
            out.append((p, segment, said["prompt"], said["chosen"], said["rejected"], masks["chosen"], masks["rejected"], bool(a) and bool(b)))
    return sorted(out, key=repr)


def pair_rows(df):
    spans = lambda m: [(s.start, s.end) for s in m]
    return sorted(((r.pair_id, r.segment, r.prompt, r.chosen, r.rejected, spans(r.chosen_mask), spans(r.rejected_mask), r.paired) for r in df.collect()), key=repr)


def test_preferences_are_brute_force(spark):
    turns = [(0, 0, "user", "q"), (1, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 1, "assistant", "bad"), (0, 2, "user", "same"), (1, 2, "user", "same")]
    turns += [(2, 0, "user", "x"), (3, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 1, "assistant", "y")]  # equal
    turns += [(4, 0, "user", "alone"), (6, 0, None, None), (7, 0, None, None), (6, 1, "assistant", ""), (7, 1, "assistant", None), (-2, -1, "assistant", "below"), (-1, -1, "assistant", "zero")]
    turns += [(8, 0, "user", "p"), (9, 0, "user", "p"), (9, 1, "assistant", "longer"), (10, 0, "u", "r"), (10, 0, "u", "r"), (11, 0, "u", "r"), (12, None, "user", "end"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody")]
    turns += [(14 + k, t, "assistant" if t % 2 else "user", f"{t}{'!' * k if t > 700 else ''}") for k in (0, 1) for t in range(900)]  # long
    turns += [(14, None, "user", "unnumbered"), (18, 1_700_000_000, "user", "s"), (19, 1_700_000_000, "user", "s"), (18, 1_700_000_900, "assistant", "t"), (19, 1_700_090_000, "assistant", "t"), (18, None, "user", "n"), (19, -5_000_000, "user", "z")]
    turns += [(16, 3, "assistant", "é漢😀"), (17, 3, "assistant", prose(random.Random(3), 20_000)), (None, None, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("cut", F.lit(1)).withColumn("segment", F.lit("clash"))
    out = preference.pairs(df, *preference.by_parity())
    assert pair_rows(out) == brute_pairs(turns)
    assert all(r.part == 0 for r in out.collect()) and out.where("pair_id = 0").count() == 1 and out.where("pair_id = 9").count() == 1 and out.where("pair_id = 7").count() == 4
    assert pair_rows(preference.pairs(df, *preference.by_parity(), segment_turns=2)) == brute_pairs(turns, 2)
    assert preference.pairs(df.limit(0), *preference.by_parity()).count() == 0


def test_preferences_spread_a_turn_repeated_often(spark):
    turns = [(0, 0, "user", "q"), (1, 0, "user", "q")] + [(0, 1, "assistant", f"a{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8)
    found = preference.pairs(df, *preference.by_parity(), segment_turns=50).collect()
    assert len(found) > 7 and max(r.chosen.count("<|im_start|>") for r in found) < 200
    assert sorted("".join(r.chosen for r in found).split("<|im_end|>\n")) == sorted("".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for c, t, r, x in turns[2:]).split("<|im_end|>\n"))
    assert all(r.chosen[s.start : s.end].endswith("<|im_end|>") for r in found for s in r.chosen_mask)


# --- bounds of hot keys and long rows


def test_url_list_long_urls_and_depths(spark):
    """A URL of a megabyte is looked up whole, in seconds; rules of depths between those of the list are found."""
    deep = "http://www.a.com/" + "/".join(f"s{i}" for i in range(200_000)) + "?q"
    dots = "http://" + "x." * 20_000 + "b.org/"
    steps = "/".join(f"s{i}" for i in range(300))
    entries = [(f"www.a.com/{steps}", "2024-01-01", "block"), ("a.com", "2024-01-01", "allow"), ("b.org", "2024-01-01", "block"), ("c.org/x/y", "2024-01-01", "block")]
    data = [(1, deep), (2, dots), (3, "http://c.org/x/y/z"), (4, "http://c.org/x"), (5, "http://org/"), (6, "http://a.com/s0"), (7, "http://d.www.a.com/s0/s1")]
    caps = spark.createDataFrame([(i, u, "2024-02-02") for i, u in data], "page_id long, url string, fetched_at string")
    list_ = spark.createDataFrame(entries, "rule string, listed_at string, action string")
    begun = time.monotonic()
    got = {r.page_id: (r.verdict, r.rule) for r in urlfilter.evaluate(caps, list_).collect()}
    assert time.monotonic() - begun < 30
    assert got == {1: ("block", f"www.a.com/{steps}"), 2: ("block", "b.org"), 3: ("block", "c.org/x/y"), 4: ("unlisted", None), 5: ("unlisted", None), 6: ("allow", "a.com"), 7: ("allow", "a.com")}


def test_mixing_of_null_ids_over_many_buckets(spark):
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat_ws(" ", F.lit("w"), F.col("id")).alias("text"))
    mixed = mixing.mix(df)
    dealt = [r["count"] for r in mixed.rows.groupBy("bucket").count().collect()]
    assert len(dealt) > 100 and max(dealt) < 400 and sum(dealt) == 20_000
    got = mixing.taken(mixed).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).first()
    assert got.size == 40_000 and abs(got.taken - 40_000) <= mixing.BLOCK_WORDS


@pytest.mark.parametrize("batch", [1, 2, 7, 40, 10_000])
def test_shingle_candidates_hold_no_bucket(batch):
    """However the rows are cut into batches, the pairs are those of whole buckets."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, shingles.SMALL - 1, shingles.SMALL, shingles.SMALL + 1, 60, 1, 200, 4, shingles.SMALL]
    data = pd.DataFrame({"bucket": np.repeat(np.arange(len(sizes)), sizes)})
    data["n"] = rng.integers(40, 60, len(data))
    data["node"] = rng.permutation(len(data))
    data["part"] = rng.integers(0, 50, len(data))
    data = data.sort_values(["bucket", "n", "node"], ignore_index=True)
    want = set()
    for _, rows_ in data.groupby("bucket"):
        found = list(rows_.itertuples(index=False))
        for i, x in enumerate(found):
            for y in found[i + 1 : None if len(found) <= shingles.SMALL else i + 1 + shingles.SHIFTS]:
                if x.part != y.part and x.n / y.n >= 0.8:
                    want.add((min(x.node, y.node), max(x.node, y.node)))
    cut = (data.iloc[at : at + batch] for at in range(0, len(data), batch))
    assert {(a, b) for f in shingles._pairs_in(cut, 0.8) for a, b in zip(f["a"], f["b"], strict=True)} == want
