from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import prose
from spanseek.llm import decontaminate, html_text, license_scan, lm_scores, pii, secrets, toxicity
from spanseek.llm.common import SQL

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> str:
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "phone": lambda: 10 <= len(digits) <= 15,
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits)}[kind]():
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_equals_brute_force(spark):
    rng = random.Random(5)
    bits = ["a@b.com", "_x@c.de", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "é", " ", " ", ".", "007.08.1.255", "+", "@", "12", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(250)] + ["a@b.cc " * 700, "7" * 5000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(docs).collect():
        mine = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.pii if s.kind != "iban")
        assert mine == base_spans(row.text or ""), row.text
        assert [(s.start, s.rank) for s in row.pii] == sorted((s.start, s.rank) for s in row.pii)


def test_pii_sql_gives_the_same(spark, tmp_path):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 a@b.com", "example DE89370400440532013000", "bank example DE89370400440532013000!", "_DE89370400440532013000", "éGB82WEST12345698765432é",
             "GB82WEST12345698765431", None, "", "+1 (017) 555-7713 1.2.3.4 é 4111 1111 1111 1111", "AA00 BBBB CCCC 1.2.3.4.5.6.7.8"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    mine = pii.pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = sorted(mine.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['op2_pii']})").fetchall()
    got = sorted(tuple(r[c] for c in columns) for r in mine.collect())
    assert got == sorted(theirs) and sum(r.n_iban for r in mine.collect()) == 3


def test_pii_adds_accounts_and_redacts_once(spark):
    docs = spark.createDataFrame([(1, "é my IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765431 end"), (2, "1.2.3.4@x.com +49 170 1.2.3.4"), (3, None)],
                                 "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert texts == {1: "é my IBAN [IBAN] and GB82WEST12345698765431 end", 2: "[EMAIL] +49 170 [IP]", 3: None}


def test_pii_on_odd_rows(spark, odd, none):
    found = pii.find(odd).collect()
    assert len(found) == 11 and all(r.pii == [] for r in found) and pii.find(none).count() == 0
    assert pii.redact(odd).columns == odd.columns and sorted(map(str, pii.redact(odd).collect())) == sorted(map(str, odd.collect()))


def test_licences(spark, odd, none):
    lines = "The license plate.\nCopyright law of MIT\nSPDX-License-Identifier: GPL-2.0-only\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."
    row = license_scan.scan(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()
    assert [(x.paragraph, x.family) for x in row.licences] == [(2, "GPL-2.0"), (3, "MIT"), (4, "CC-BY-NC")] and row.n_paragraphs == 5
    model = license_scan.fit()
    wrong = [t for f, ts in license_scan.NOTICES.items() for t in ts
             if model.families[int(np.argmax(license_scan._score(model, license_scan._grams(license_scan._words(t)))))] != f]
    assert len(wrong) <= 1, wrong
    assert all(r.licences == [] for r in license_scan.scan(odd).collect()) and license_scan.scan(none).count() == 0


def test_licences_wrapped_over_lines(spark):
    mit = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
    bsd = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:"""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    apache = "Licensed under the\nApache License,\nVersion 2.0."
    long = "They walked home along the river in the dark of night. " * 40
    rows = [(mit, [(4, "MIT")]), (bsd, [(0, "BSD")]), (gpl, [(0, "GPL-3.0")]), (f"{bsd}\n{apache}\n{gpl}", [(0, "BSD"), (2, "Apache-2.0"), (5, "GPL-3.0")]),
            (f"{long}Licensed under the\nApache License, Version 2.0.{long}", [(0, "Apache-2.0")]), (f"Released under the MIT License.\n{apache}", [(0, "MIT"), (1, "Apache-2.0")]),
            ("They had no valid license\nand walked home mit all rights\nunder the public domain", []), ("Licensed under the\n\nApache License, Version 2.0.", [])]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: [(x.paragraph, x.family) for x in r.licences] for r in license_scan.scan(docs).collect()}
    assert found == {i: want for i, (_, want) in enumerate(rows)}


def test_html_keeps_the_article_whole():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home, away, and more text in a long menu entry</a></li></ul></nav>
    <header class="site-header"><p>Our site, since 1999, for all of you, with much love</p></header><div class="cookie-notice"><p>We use cookies, as you know, and more</p></div>
    <article><h1>A &amp; B</h1><p>First paragraph,   with
    white space, and <b>bold<br>text.<p>Second &lt;one&gt;.</p><form><p>Subscribe, now, please, today</p></form><script>var x = "</p>";</script></article>
    <aside><p>Related, things, to, read, and, buy, all, here</p></aside><div id="comments"><p>I like, this, a lot, really, said a reader in a long comment</p></div>
    <footer>&copy; someone</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\nFirst paragraph, with white space, and bold text.\nSecond <one>."


def test_html_keeps_what_stands_beside_the_best_container():
    body = "".join(f"<p>{chr(97 + i) * 296}, x,</p>" for i in range(6))
    parts = "<h1>T</h1><div class=lead>A short lead.</div><section>%s</section><ul><li>One<li>Two</ul><table><tr><td>7</td></tr></table><pre>x = 1</pre>" % body
    after = "<blockquote>Said.</blockquote><section><h2>More</h2><p>Short.</p></section>"
    menu = "<div><a href=/>Home</a> <a href=/b>All the other pages</a></div>"
    want = ["T", "A short lead.", *(chr(97 + i) * 296 + ", x," for i in range(6)), "One", "Two", "7", "x = 1", "Said.", "More", "Short."]
    for page in (f"{menu}<article>{parts}{after}</article>", f"{menu}<main>{parts}{after}</main>", f"<main>{menu}{parts.replace('section', 'article')}{after}</main>",
                 f"<body>{menu}<div><div>{parts}</div>{after}</div></body>"):
        assert html_text.main_text(page).split("\n") == want, page
    assert html_text.main_text(f"<h1>T</h1>{menu}<article>{body}</article><p>Elsewhere</p>").split("\n") == ["T", *want[2:8]]


def test_html_reads_attributes_by_name():
    long = "Text that is long enough, as paragraphs of articles are, to be told from a list of links."
    for attributes in ('style="overflow:hidden"', 'class="overflow-hidden post"', 'title="the hidden door"', "data-x='display:none'", "data-hidden=1", 'id="related-work"',
                       "class=social-science", 'class="wrap with-sidebar"', 'class="search notice widget"'):
        assert html_text.main_text(f"<body><div {attributes}><p>{long}</p><p>Short.</p></div></body>") == f"{long}\nShort.", attributes
    for attributes in ("hidden", 'HIDDEN="hidden"', "hidden=''", "aria-hidden = true", 'style="color:red; display : none"', "style='visibility:hidden'", 'class="x comments"', "role=search"):
        assert html_text.main_text(f"<body><p>{long}</p><div {attributes}><p>{long}</p></div></body>") == long, attributes
    assert html_text.main_text(f'<article><p>{long}</p><section id=related-work><h2 id=comments>Related</h2><p>Short.</p></section>'
                               f'<div class="social share"><a href=/>Send</a></div></article><div class=notice><p>We tell you.</p></div>') == f"{long}\nRelated\nShort."


@pytest.mark.parametrize("page", ["", "<p>a", "<" * 20000, "<a " * 20000, "<div>" * 5000, "<!-- open", "<script>var a;", '<a b="' * 5000, "</p></div>"])
def test_html_never_fails(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (None, "v", "<p>Text &eacute;</p>", 3), (None, "v", "<p>Text &eacute;</p>", 3)],
                                  "page_id long, url string, html string, text long")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "", "Text é", "Text é"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_long_secrets_are_found(spark):
    rng = random.Random(41)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(signs) for _ in range(n))
    texts = [f"Authorization: Bearer {key(256)}", f"Authorization: Bearer eyJ{key(17)}.eyJ{key(700)}.{key(43)}", f'private_key = "{key(1600)}"',
             f"an image data:image/png;base64,{key(3000)} in a page", "over and " + "water1-page2-stone3-" * 40 + "end1"]
    docs = spark.createDataFrame([(i, x, "src1") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    long = [r for r in secrets.scan(docs).collect() if r.end - r.start > 200]
    assert sorted((r.doc_id, r.end - r.start, r.is_secret) for r in long) == [(0, 256, True), (1, 703, True), (2, 1600, True), (3, 3000, False), (4, 804, False)]
    covered = [secrets.describe(secrets.Finding(b"", b"window7" * n, b"", b"src", False))[7] for n in (1, 50, 500)]
    assert np.allclose(covered, 6 / 7)


def edits(pattern: str, text: str) -> int:
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != c)))
        before = now
    return min(before)


def test_decontamination_equals_brute_force():
    rng = random.Random(7)
    items = [prose(100 + i, rng.randrange(8, 40)) for i in range(12)]
    held = decontaminate.prepare(list(range(12)), items)
    texts = []
    for _ in range(120):
        i = rng.randrange(12)
        signs = list(items[i])
        for _ in range(rng.randrange(0, int(len(signs) * 0.16) + 1)):
            at, kind = rng.randrange(len(signs)), rng.random()
            if kind < 0.4:
                signs[at] = rng.choice("abcxyz")
            elif kind < 0.7:
                del signs[at]
            else:
                signs.insert(at, rng.choice("abc "))
        texts.append(prose(rng.randrange(10 ** 6), 15) + "; " + "".join(signs).upper() + "!! " + prose(rng.randrange(10 ** 6), 15))
    raw, at = decontaminate.flat(pa.array(texts))
    got = {(r, i): e for r, i, _, _, e in zip(*(x.tolist() for x in decontaminate.matches(raw, at, held)))}
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower())
    want = {}
    for r, t in enumerate(texts):
        for i, item in enumerate(items):
            e = edits(plain(item), plain(t))
            if e <= held.budget[i]:
                want[r, i] = e
    assert got == want and 40 < len(want) < 120


def test_decontamination_places_and_blocks(spark, odd, none, monkeypatch):
    item = prose(300, 30)
    docs = spark.createDataFrame([(1, "é ü: " + item + " tail words"), (2, prose(301, 80)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "tiny"), (5, prose(302, 30))], "item_id long, text string")
    want = {(1, 1, 5, 5 + len(item), 0), (1, 2, 5, 5 + len(item), 0)}
    assert {tuple(r) for r in decontaminate.find(docs, items).collect()} == want
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [2, 3]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 200)  # several passes give the same
    assert {tuple(r) for r in decontaminate.find(docs, items).collect()} == want
    assert decontaminate.clean(odd, items).count() == 11 and decontaminate.find(none, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == 11


def test_secrets(spark, odd, none):
    forest = secrets.default_forest()
    fresh = secrets.labelled_findings(seed=91)
    right = (forest.scores(np.array([secrets.describe(f) for f in fresh])) >= 0.5) == np.array([f.is_secret for f in fresh])
    assert right.mean() > 0.97
    text = 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962'
    rows = secrets.scan(spark.createDataFrame([(1, text, "src1")], "doc_id long, text string, source string")).orderBy("start").collect()
    assert [(r.start, r.end, r.is_secret) for r in rows] == [(11, 51, True), (64, 104, False)]
    assert all(not r.is_secret for r in secrets.scan(odd).collect()) and secrets.scan(none).count() == 0


def test_toxicity_learns_and_leaves_the_held_out_fifth_alone(spark, odd, none):
    rng = random.Random(3)
    docs, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = prose(i, 60).split()
        for _ in range(3 * bad):
            words.insert(rng.randrange(60), rng.choice(["blasted", "wretched", "vilest"]))
        docs.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    training = toxicity.training_marks(labels)
    assert {r.doc_id for r in training.collect()}.isdisjoint(held)
    model = toxicity.fit(docs, training)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == (i % 6 == 0) for i in held]
    assert np.mean(right) > 0.97
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, toxicity.training_marks(turned))
    assert np.allclose(again.weights, model.weights) and math.isclose(again.intercept, model.intercept, abs_tol=1e-9)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == 11 and all(0 <= r.score <= 1 for r in scored) and toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, training.limit(0))).where("score > 0.5").count() == 0


def brute_lm(rows):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [split.findall((t or "").translate(low)) + ["\0end"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for (i, _), h, ws in zip(rows, held, tokens)]


def test_lm_base_scores_and_gain(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "LOOKUP", 40)  # most words go the way of the join
    monkeypatch.setattr(lm_scores, "EPOCHS", 6)
    rows = [(i, ("AMBER basin Cedar delta " * 30 if i % 2 else "one two three four " * 30) + prose(i, 10)) for i in range(200)] + [(900, None), (901, ""), (902, prose(5, 3000)), (3, "again")]
    got = lm_scores.scores(spark.createDataFrame(rows, "doc_id long, text string"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0).collect()
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_lm(rows), key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    even = [r for r in got if r.held_out and r.n_tokens > 100]
    assert sum(r.score for r in even) > 0.6 * sum(r.base_score for r in even)


def test_lm_probabilities_sum_to_one_and_windows_do_not_matter():
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(1, 500, 300))[::-1]
    net = lm_scores.Network(counts, 77)
    net.to_class = rng.standard_normal(net.to_class.shape).astype(np.float32)
    net.to_word = rng.standard_normal(net.to_word.shape).astype(np.float32)
    h = np.repeat(rng.standard_normal((1, lm_scores.HIDDEN)).astype(np.float32), 301, axis=0)
    assert math.isclose(np.exp(net.log_probs(h, np.r_[np.arange(300), lm_scores.HEAD])).sum(), 1, abs_tol=1e-4)
    sizes = [1, 700, 0, 3, 256, 1025]
    begin = np.r_[0, np.cumsum(sizes)]
    read, target = rng.integers(0, 300, begin[-1]), rng.integers(0, 300, begin[-1])
    alone = []
    for a, b in zip(begin, begin[1:]):
        state, total = np.zeros((1, lm_scores.HIDDEN), np.float32), 0.0
        for t in range(a, b):
            state = net.step(net.read[read[t:t + 1]], state)[0]
            total += net.log_probs(state, target[t:t + 1])[0]
        alone.append(total)
    assert np.allclose(lm_scores.score_texts(net, read, target, begin), alone, rtol=1e-4)


def test_lm_on_odd_rows(spark, odd, none):
    got = lm_scores.scores(odd, F.lit(False)).collect()
    assert len(got) == 11 and all(np.isfinite(r.score) for r in got) and lm_scores.scores(none, F.lit(False)).count() == 0
    assert all(r.score == 0 and r.base_score == 0 for r in lm_scores.scores(odd.limit(4), F.lit(True)).collect())


def test_gradients_are_right():
    rng = np.random.default_rng(4)
    net = lm_scores.Network(np.sort(rng.integers(1, 50, 200))[::-1], 20)
    net.to_class, net.to_word = (rng.standard_normal(a.shape).astype(np.float32) * 0.3 for a in (net.to_class, net.to_word))
    for name in ("read", "carry", "carry_bias", "to_class", "class_bias", "to_word", "word_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    inputs, targets = rng.integers(0, 200, (3, 7)), rng.integers(0, 200, (3, 7))
    targets[0, 2] = lm_scores.HEAD
    fresh = np.zeros((3, 7), bool)
    fresh[:, 0], fresh[1, 4] = True, True

    def loss():
        h, total = np.zeros((3, lm_scores.HIDDEN)), 0.0
        for t in range(7):
            h = np.where(fresh[:, t, None], 0.0, h)
            h = net.step(net.read[inputs[:, t]], h)[0]
            total -= net.log_probs(h, targets[:, t]).sum()
        return total / 21

    grads, _ = net._gradients(inputs, targets, fresh, np.zeros((3, lm_scores.HIDDEN)))
    for name in grads:
        value = getattr(net, name)
        where = np.unravel_index(int(np.argmax(np.abs(grads[name]))), value.shape)
        kept = value[where]
        value[where] = kept + 1e-5
        up = loss()
        value[where] = kept - 1e-5
        down = loss()
        value[where] = kept
        assert math.isclose((up - down) / 2e-5, grads[name][where], rel_tol=2e-2, abs_tol=1e-6), name


def test_spans_of_the_query_are_the_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.com 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.pii(spark, str(tmp_path)).collect()}
    assert rows[1].base_sha256 == hashlib.sha256(b"email:0:7,ip:8:15").hexdigest() and rows[1].spans == "email:0:7,ip:8:15"
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and html.unescape("&amp;") == "&"
