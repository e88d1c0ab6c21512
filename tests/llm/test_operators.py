"""The training-data operators against brute force on whole small tables, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rareflag.llm import (
    bpe_tree, ecoc_langid, licenses, line_crf, oddsketch, ordinal, queries, site_style, tool_calls, unigram_count,
    winnow)
from tests.conftest import SF001, SF0001

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: extra columns whose names the operators use inside
EXTRA = ("rid", "bucket", "cid", "root", "top", "th", "_text", "class_id", "node", "host", "drop", "kept")
LONG = "alpha beta gamma delta " * 20_000


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_copies(n, seed=5):
    """n texts of one base, each with some words changed: many pairs just above and below the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    return [" ".join(w if rng.random() > 0.035 else f"x{rng.randrange(10 ** 6)}" for w in base) for _ in range(n)]


def odd_texts():
    return [None, "", " \t\n", "one", "one two", "One TWO", "one two", "!!!", "日本語 のテキスト", "naïve café 😀", LONG, LONG]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None, *(["x"] * len(EXTRA))) for i, t in enumerate(odd_texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows + [(None, "no id at all", "en", *([None] * (2 + len(EXTRA))))], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


def read(spark, name, sf=SF0001):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brute_components(texts, size):
    sets = {}
    for d, t in texts.items():
        w = SPACED.findall(lower(t))
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_brute_force(spark, docs, size, monkeypatch):
    monkeypatch.setattr(oddsketch, "BLOCK", 16)  # many blocks
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {10_000 + i: t for i, t in enumerate(near_copies(150) + odd_texts()[:-2] + ["same text again"] * 40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = oddsketch.near_duplicates(df, size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute_components(texts, size)


def test_ask_gives_one_link_per_tree(spark):
    """Three trees in one bucket; the asker of another tree is linked with each of two, once."""
    texts = {1: "a b c d e", 2: "a b c d e", 3: "a b c d e", 4: "p q r s t", 5: "a b c d e"}
    df = spark.createDataFrame(list(texts.items()), "rid long, text string").coalesce(1)
    sketch = oddsketch._sketch_table(df.withColumn("doc_id", F.col("rid")), "text", 2).select("doc_id", "sketch")
    full = df.join(sketch, F.col("rid") == F.col("doc_id")).select(F.col("rid").alias("cid"), "text", "sketch")
    members = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 3, 3), (7, 4, 4)], "top long, cid long, root long")
    asks = spark.createDataFrame([(7, 5, 5)], "top long, a long, own long")
    links = oddsketch.ask(asks, members, full, 2, 0.8).collect()
    assert len(links) == 2 and {1 if r.b < 3 else r.b for r in links} == {1, 3}


def brute_winnow(texts, items, span=10):
    split = lambda t: WORDS.findall(lower(t))
    wins = {}
    for k, t in items:
        w = split(t)
        for i in range(len(w) - span + 1) if len(w) >= span else [0] if w else []:
            wins.setdefault(tuple(w[i:i + span]), set()).add(str(k))
    out = {}
    for d, t in texts.items():
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                k = wins.get(tuple(w[i:i + size]))
                if k:
                    hit.update(range(i, i + size))
                    found |= k
        out[d] = (len(w), len(hit), sorted(found), bool(hit))
    return out


def test_winnowing_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    items += [(90_001, "one two"), (90_002, None), (90_003, ""), (90_004, items[0][1]), (90_005, "ab " * 14)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= dict(enumerate(odd_texts(), 20_000))
    texts |= {30_000: f"start {items[0][1]} end", 30_001: "AB " * 40, 30_002: "ab " * 9}
    out = winnow.decontaminate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
                               spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in out} == brute_winnow(texts, items)
    assert any(r.contaminated for r in out)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    rng = random.Random(3)
    texts = [r.text for r in docs.collect()] + odd_texts() + [
        "a" * 3000, "ab" * 2500, "".join(rng.choice("abcdé日") for _ in range(4000)), "<|endoftext|> x</w> don't 12345"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe_tree.digests(bpe_tree.encode_decode(df, path)).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(back))


def brute_count(vocab, text):
    """Plain quadratic Viterbi: starts from left to right, only a strictly better score replaces."""
    s = "▁" + text.replace(" ", "▁")
    longest, unknown = max(map(len, vocab)), min(vocab.values()) - 10
    best = [(0.0, 0)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - longest), e):
            p = s[b:e]
            if p in vocab:
                c = (best[b][0] + vocab[p], best[b][1] + 1)
            elif e - b == 1:
                c = (best[b][0] + unknown, best[b][1] + len(p.encode()))
            else:
                continue
            if best[e] is None or c[0] > best[e][0]:
                best[e] = c
    return best[-1]


def test_token_counts_brute_force(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = unigram_count.vocabulary(path)
    texts = [r.text for r in docs.orderBy("doc_id").collect()][:40] + odd_texts()[:-2] + ["a  b\n\n c", "☃\x01é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in unigram_count.token_counts(df, path).collect():
        t = texts[r.doc_id]
        assert (r.score, r.n_tokens) == (brute_count(vocab, t) if t else (0.0, 0))


def brute_base(text):
    w = SPACED.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    wins = {}
    for i in range(len(w) - 4):
        wins.setdefault(tuple(w[i:i + 5]), []).append(i)
    rep = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep), failed


def test_line_labels(spark, docs, odd):
    field = line_crf.fit(docs, read(spark, "labels"))
    df = docs.select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 50_000, "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in line_crf.quality(df, field).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == brute_base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    emit, move = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    got = line_crf.viterbi(emit, np.array([0, 9]), move)
    score = lambda p: sum(emit[i, s] for i, s in enumerate(p)) + sum(
        move[a, b] for a, b in zip(p[:-1], p[1:], strict=True))
    paths = [[(k >> i) & 1 for i in range(9)] for k in range(512)]
    assert np.isclose(score(got.astype(int).tolist()), max(map(score, paths)))


def test_long_texts_train_whole(spark, monkeypatch):
    """The labels differ only after line 100; a long text has all its features in the fit."""
    rng = random.Random(2)
    texts = []
    for i in range(20):
        lines = [words_of(rng) for _ in range(120)]
        texts.append("\n".join(lines + (["!!! $$$ ###"] * 60 if i % 2 else [words_of(rng) for _ in range(60)])))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = line_crf.fit(docs, labels)
    verdict = {r.doc_id: (r.n_content_lines, r.n_lines) for r in line_crf.quality(docs, field).collect()}
    assert all(verdict[i][0] == verdict[i][1] for i in range(0, 20, 2))
    assert all(verdict[i][0] < verdict[i][1] for i in range(1, 20, 2))
    seen = []
    monkeypatch.setattr(ordinal, "fit_rows", lambda slot, bounds, *_: seen.append(sorted(np.diff(bounds))))
    wide = [" ".join(f"{w}{i}" for w in words_of(rng, 5000).split()) for i in range(6)]
    ordinal.fit(spark.createDataFrame(list(enumerate(wide)), "doc_id long, text string"), labels)
    (_, n, text), = ordinal.tb.chunks(ordinal.tb.texts(pa.array(wide)))
    want = sorted(np.diff(ordinal.distinct(*ordinal.features(text), n)[1]))
    assert seen == [want] and want[0] > 4000


def test_main_text(spark):
    page = ("<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><main><article>"
            "<h1>Head &amp; more</h1><p>First   part\n{}</p><script>x()</script><p>Second</p></article></main>"
            "<footer>Foot</footer></body></html>")
    rows = [(i, f"http://a.org/{i}", page.format(i), "x") for i in range(6)] + [
        (6, None, None, None), (7, "odd", "", None), (8, "http://a.org/8", page.format("z" * 300_000), None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {r.page_id: r.text for r in site_style.main_text(df).collect()}
    assert out == {i: f"Head & more\nFirst part {i}\nSecond" for i in range(6)} | {
        6: "", 7: "", 8: "Head & more\nFirst part " + "z" * 300_000 + "\nSecond"}


def words_of(rng, n=12):
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))


def brute_main_text(pages):
    """Texts by style trees over lists and dictionaries; pages are (host, html)."""
    entropy = lambda counts: -sum(c / sum(counts) * np.log(c / sum(counts)) for c in counts)
    found, hosts, copies = [], {}, set()
    for host, page in pages:
        rows = [b for b in site_style.blocks(page) if b[2] >= 0]
        found.append(rows)
        leaves = {}
        for text, up, mark, link in rows:
            if mark < 4 and up:
                leaves.setdefault(tuple(up), []).append((text, min(4, 4 * link // len(text))))
        if (host, repr(rows)) not in copies:
            hosts.setdefault(host, []).append(leaves)
        copies.add((host, repr(rows)))
    mean, seen = {}, {}
    for host, tree in hosts.items():
        parts = {}
        for leaf in {k for t in tree for k in t}:
            there = [t[leaf] for t in tree if leaf in t]
            m = len(there)
            styles, share = {}, {}
            for bs in there:
                style = min(len(bs), 50), int(sum(b[1] for b in bs) / len(bs) + 0.5)
                styles[style] = styles.get(style, 0) + 1
                for t in {b[0] for b in bs}:
                    share[t] = share.get(t, 0) + 1
            imp = 1.0
            if m > 1:
                by_text = [1 - np.log(c) / np.log(m) for c in share.values() for _ in range(c)]
                imp = 0.1 * entropy(list(styles.values())) / np.log(m) + 0.9 * np.mean(by_text)
            for node in leaf:
                parts.setdefault(node, []).append((sum(map(len, there)), imp))
                seen[host, node] = max(seen.get((host, node), 0), m)
        for node, p in parts.items():
            mean[host, node] = sum(n * i for n, i in p) / sum(n for n, _ in p)
    out = []
    for (host, _), rows in zip(pages, found, strict=True):
        main = any(r[2] > 0 for r in rows)
        around = {n for r in rows if r[2] > 0 for n in r[1] if n & 3 == 0}

        def low(node, main=main, host=host):
            if (host, node) not in mean:
                return False
            m = seen[host, node]
            w = (m / 2 + 1) / (m + 1) if main else 0
            return round(w * {0: 0.2, 1: 0.5, 2: 0.2}[node & 3] + (1 - w) * mean[host, node], 9) < 0.3

        out.append("\n".join(t for t, up, mark, _ in rows if not any(
            low(n) for n in up if n not in around or mark < 4 and n == up[-1])))
    return out


def site_texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r.text for r in site_style.main_text(df).orderBy("page_id").collect()]


def test_main_text_statistics_decide_with_article(spark):
    rng, pages, want = random.Random(3), [], []
    for i in range(12):
        a, b, c = (words_of(rng) for _ in range(3))
        pages.append(("a.org", f"<body><article><h1>Column</h1><p>{a}</p><p>{b}</p><div class='house'><h3>On us</h3>"
                               f"<p>We are the paper of record.</p></div></article><div class='legal'>Rights.</div></body>"))
        want.append(f"Column\n{a}\n{b}")
        pages.append(("b.org", f"<body><article class='teaser'><p>{a}</p></article><div class='body'><p>{b}</p><p>{c}</p>"
                               f"</div><div class='legal'>All rights are ours.</div></body>"))
        want.append(f"{a}\n{b}\n{c}")
    assert site_texts(spark, pages) == want == brute_main_text(pages)


def test_main_text_brute_force(spark):
    """Hosts with and without main elements, some texts shared by some of the pages."""
    rng, pages = random.Random(8), []
    stock = [words_of(rng) for _ in range(6)]
    for i in range(90):
        text = lambda share: rng.choice(stock) if rng.random() < share else words_of(rng)
        parts = [f"<div class='{k}{rng.randrange(9)}'>" + "".join(f"<p>{text(s)}</p>" for _ in range(rng.randrange(1, 4)))
                 + f"<a href='/'>{text(0.9)}</a></div>" for k, s in (("x", 1.0), ("y", 0.6), ("z", 0.1), ("w", 0.0))]
        rng.shuffle(parts)
        tag = rng.choice(["section", "section", "article"])
        pages.append((f"h{i % 4}.org", f"<body>{parts[0]}<{tag}><h2>{text(0.5)}</h2>{parts[1]}{parts[2]}</{tag}>{parts[3]}"
                                       f"<div class='end'>Same end.</div></body>"))
    got = site_texts(spark, pages)
    assert got == brute_main_text(pages)
    assert all(got) and not any("Same end." in t for t in got)


def test_main_text_copies(spark):
    """Copies, also with other adverts, count as one page, whether few or nearly all of their host."""
    rng = random.Random(5)
    page = lambda a, b: (f"<body><div class='ad'>{words_of(rng)}</div><div class='text'><p>{a}</p><p>{b}</p></div>"  # noqa: E731
                         f"<div class='end'>The same end.</div></body>")
    x, y, z = (words_of(rng) for _ in range(3))
    pages, want = [("two.org", page(x, y))] * 2 + [("odd url", page(x, z))] * 3, [f"{x}\n{y}\nThe same end."] * 2 + [
        f"{x}\n{z}\nThe same end."] * 3
    pages += [("many.org", page(x, y)) for _ in range(40)]
    want += [f"{x}\n{y}"] * 40
    for _ in range(5):
        a, b = words_of(rng), words_of(rng)
        pages.append(("many.org", page(a, b)))
        want.append(f"{a}\n{b}")
    assert site_texts(spark, pages) == want == brute_main_text(pages)


def test_main_text_slugs(spark):
    """Slugs of headings with a noise word keep their text; shared branches and whole noise names go."""
    rng, pages, want = random.Random(6), [], []
    for host in ["one.org"] + ["a.org"] * 10:
        a, b, c, d, ad = (words_of(rng) for _ in range(5))
        pages.append((host, f"<body><article><h1>T</h1><p>{a}</p><section id='related-work'><h2 id='related'>Related work"
                            f"</h2><p>{b}</p></section><h2 id='side-effects'>Side effects</h2><p>{c}</p><section id="
                            f"'social-policy'><p>{d}</p></section><div class='box ad'>{ad}</div><div id='comments'><p>{ad}"
                            f"</p></div><div class='share-box'><p>Tell your friends.</p></div></article></body>"))
        want.append(f"T\n{a}\nRelated work\n{b}\nSide effects\n{c}\n{d}")
    want[0] += "\nTell your friends."  # nothing to compare it with
    assert site_texts(spark, pages) == want == brute_main_text(pages)


def test_language_id_held_out(spark):
    docs = read(spark, "documents", SF001)
    out = ecoc_langid.language_id(docs).where("held_out").join(docs, "doc_id")
    n, right = out.where("lang_pred <> 'und'").agg(F.count("*"), F.sum((F.col("lang_pred") == F.col("lang")).cast(
        "int"))).first()
    assert n > 100 and right / n > 0.9


def test_language_of_odd_rows(spark, docs, odd):
    out = {r.doc_id: r for r in ecoc_langid.language_id(odd, docs).collect()}
    assert len(out) == odd.count()
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 7))
    assert all(0 <= r.score <= 1 for r in out.values()) and out[10].lang_pred == out[11].lang_pred != "und"
    none = ecoc_langid.fit(docs.limit(0))
    assert {r.lang_pred for r in ecoc_langid.identify(odd, none, ["doc_id"]).collect()} == {"und"}


def test_quality_grade_held_out(spark):
    docs, labels = read(spark, "documents", SF001), read(spark, "labels", SF001)
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.fit(docs, labels.where(~test))
    assert (np.diff(model.cuts) > 0).all()
    rows = ordinal.grade(docs, model, ["doc_id"]).join(ordinal.grades_of(labels.where(test)), "doc_id").collect()
    good = [r.kept == (r.grade == 2) for r in rows]
    assert len(good) > 50 and sum(good) / len(good) > 0.85


def test_licences(spark):
    text = licenses.TEMPLATES[0][1]
    rows = [("p/LICENSE", text), ("p/q/r.py", "print(1)"), ("other/x.py", "nothing of the kind"), (None, None),
            ("p/q/r.py", "print(1)"), ("other/e", ""), ("other/long", LONG)]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, path string, text string, dir string")
    out = {r.doc_id: (r.license, r.how) for r in licenses.scan(df, carry=("doc_id",)).collect()}
    name = licenses.TEMPLATES[0][0]
    assert out[0] == (name, "own") and out[1] == out[4] == (name, "inherited")
    assert all(out[i][1] == "none" for i in (2, 3, 5, 6))


def test_wrapped_licence_headers(spark):
    mpl = ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was "
           "not distributed with this\n * file, You can obtain one at the address below. */\n\nint main() {}")
    bsd = ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that "
           "the following conditions are met:\n\nprint(1)")
    rows = [(0, "a/m.c", mpl), (1, "a/b.py", bsd), (2, "a/t.txt", "Some text.\n\nAvailable under CC BY-SA 4.0.")]
    rows += [(i, f"b/{i}.txt", f"The work of the day {i} is in the form of a list.\nIt has no notice.") for i in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = {r.doc_id: r.license for r in licenses.scan(df, carry=("doc_id",)).collect()}
    assert [out[i] for i in range(3)] == ["MPL-2.0", "BSD-3-Clause", "CC-BY-SA-4.0"]
    assert all(out[i] is None for i in range(3, 9))


def test_licence_prefix_filter_loses_nothing(spark):
    docs = read(spark, "documents", SF0001)
    files = licenses.as_files(docs).withColumn("rid", F.col("doc_id").cast("string")).withColumn(
        "is_licence", F.col("path").endswith("/LICENSE")).where("text is not null")
    body = licenses.units(files)
    some, every = (licenses.cosines(body, licenses.TEMPLATES, x).where("cosine >= 0.5") for x in (0.5, 0.0))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(some) == rows(every) and some.count() > 0


def test_tool_links(spark):
    args = '{"query": "x", "limit": 3}'
    calls = spark.createDataFrame([
        (1, "a", 0, "search", args, None), (1, "b", 1, "search", args, ["a"]), (1, None, 2, "search", args, None),
        (1, "d", 3, "search", "{", []), (1, "e", 4, "unheard", args, []), (1, "a", 5, "search", args, [])],
        "conv_id long, call_id string, pos long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", None), ("q", "lost"), (None, "n")],
                                    "call_id string, content string")
    out = tool_calls.link(calls, results, tool_calls.schema_table(spark)).collect()
    by = {(r.call_id, r.pos): r for r in out}
    assert len([r for r in out if r.call_id == "a"]) == 2 and by["a", 0].n_results == 2
    assert by["b", 1].level > by["a", 0].level
    assert [r.status for r in out if r.call_id == "q"] == ["orphan result"]
    assert by["d", 3].status == by["e", 4].status == "invalid" and by[None, 2].status == "no result"


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_tool_calls"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    from rareflag.llm import oracles
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    got = queries.queries()[name](spark, SF0001)
    want = con.execute(oracles.ORACLES[name])
    cols = [d[0] for d in want.description]
    tidy = lambda v: round(float(v), 5) if isinstance(v, (int, float)) else v
    rows = lambda it: sorted((tuple(map(tidy, r)) for r in it), key=repr)
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.select(*cols).collect()) == rows(want.fetchall())


def test_odd_rows_and_empty_tables(spark, odd, docs):
    labels, bench = read(spark, "labels"), read(spark, "benchmark")
    path, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    field, model = line_crf.fit(docs, labels), ordinal.fit(docs, labels)
    runs = [oddsketch.near_duplicates, lambda d: winnow.decontaminate(d, bench),
            lambda d: winnow.decontaminate(d, bench.limit(0)), lambda d: line_crf.quality(d, field),
            lambda d: bpe_tree.digests(bpe_tree.encode_decode(d, path)),
            lambda d: unigram_count.token_counts(d, pieces), lambda d: ecoc_langid.language_id(d, docs),
            lambda d: ordinal.grade(d, model, ["doc_id"]),
            lambda d: licenses.scan(licenses.as_files(d), carry=("doc_id",))]
    for run in runs:
        assert run(odd).count() == odd.count()
        assert run(odd.limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert site_style.main_text(pages).count() == 0
    calls, results = tool_calls.from_turns(read(spark, "conversations").limit(0))
    assert tool_calls.link(calls, results, tool_calls.schema_table(spark)).count() == 0
