"""Decontamination, token counts, licences, revisits and the pipeline against brute-force versions."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, license_scan, queries, token_counts, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(text, items):
    words, found, hit = WORD.findall(lower(text)), set(), set()
    for item, body in items:
        w = WORD.findall(lower(body))
        n = min(13, len(w))
        for win in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == win:
                    found.add(item)
                    hit.update(range(i, i + n))
    ids = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("bound", [1 << 20, 150])
def test_contamination(spark, docs, no_docs, monkeypatch, bound):
    """By one automaton, and by several whose results are merged."""
    monkeypatch.setattr(decontaminate, "MAX_AUTOMATON_BYTES", bound)
    rng = np.random.default_rng(1)
    vocabulary = ["ab", "Cd", "é", "x9", "to"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.integers(0, 30)))) for i in range(12)] + [(3, say(14)), (50, "?! --"), (51, "solo word")]
    bench = spark.createDataFrame(items + [(None, "ab"), (60, None)], "item_id long, text string")
    texts = [say(200), items[0][1] + ", " + items[5][1].upper(), "Solo-WORD!", "solowords", None, "", say(5), items[2][1] * 2, "x" * 20 + " " + say(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decontaminate.contamination(frame, bench).collect():
        assert tuple(r)[1:6] == brute_contamination(texts[r.doc_id], items)
        if r.n_hit:
            cut = [texts[r.doc_id][int(a) : int(b)] for a, b in (s.split(":") for s in r.spans.split(","))]
            assert sum(len(WORD.findall(lower(c))) for c in cut) == r.n_hit
    kept = {r.doc_id for r in decontaminate.clean(frame, bench).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_contamination(t, items)[4]}
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(no_docs, bench).count() == 0 and decontaminate.clean(no_docs, bench).count() == 0


def test_contamination_by_names_and_repeats(spark):
    """Items named by strings; texts and items of one word over and over, where blocks meet at many places."""
    items = [("a/1", "la " * 40), ("b", "la la la"), ("c", "x " + "la " * 12), ("d", "la " * 13 + "y"), ("a/1", "so " * 6), ("e", "so la " * 30)]
    texts = ["la " * 500, "la la", "la " * 12, "x " + "la " * 12, "so " * 6, "q so la so " + "la so " * 9, "z " * 200 + "la la la", "so la " * 300]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decontaminate.contamination(frame, bench).collect():
        assert tuple(r)[1:6] == brute_contamination(texts[r.doc_id], items), texts[r.doc_id][:40]


def test_automaton_grows_with_words():
    """A few bytes of automaton for each word: every word is in one block, not in a window for each of its places."""
    rng = np.random.default_rng(3)
    text = " ".join(f"w{n}" for n in rng.integers(0, 50_000, 20_000)).encode()
    scanner = decontaminate.Scanner([("i", text)])
    assert scanner.automaton.get_stats()["nodes_count"] <= 2.2 * 20_000


def brute_tokens(text, rule):
    """Each token by itself, over character spans that round outwards."""
    import tiktoken  # noqa: F401

    path = f"{token_counts.TOKENIZER_DIR}/{token_counts.TOKENIZER}"
    encoding, lengths = token_counts._encoder(path)
    raw, at, counts = text.encode(), 0, Counter()
    sections = token_counts.line_sections(text)
    bounds = [(name, len(text[:a].encode()), len(text[:b].encode())) for name, a, b in sections]
    for t in encoding.encode_ordinary(text):
        a, b = at, at + int(lengths[t])
        at = b
        met = [(name, min(b, e) - max(a, s)) for name, s, e in bounds if s < b and a < e]
        if met:
            name = {"first": met[0], "last": met[-1], "most": max(met, key=lambda m: m[1])}[rule][0]
        counts[name if met else None] += 1
    assert at == len(raw)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution(spark, rule):
    texts = ["one two\nthree   \n\n\n four", "Ärger é\nüber\n\t tab", "", None, "x\n" * 50, "no breaks", "日本語\n𝄞 clef\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_counts.count_tokens(frame, rule=rule).collect():
        got.setdefault(r.doc_id, Counter())[r.section] += r.n_tokens
    for i, t in enumerate(texts):
        assert +got[i] == +brute_tokens(t or "", rule)


def test_token_sections_given(spark, docs, no_docs):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "title here and body", [("title", 0, 5), ("body", 15, 19)])], "doc_id long, text string, s array<struct<name string,start int,end int>>")
    rows = {r.section: r.n_tokens for r in token_counts.count_tokens(frame, F.col("s")).collect()}
    assert rows == {"title": 1, "body": 1, None: 2}
    assert token_counts.count_tokens(no_docs).count() == 0
    assert token_counts.count_tokens(docs).where("section is null").count() == docs.count()
    with pytest.raises(Exception, match="overlap"):
        bad = frame.withColumn("s", F.expr("array(named_struct('name','a','start',0,'end',9),named_struct('name','b','start',5,'end',12))"))
        token_counts.count_tokens(bad, F.col("s")).collect()


def brute_licences(text, model):
    """The whole row by plain Python: paragraphs line by line, every window of every paragraph, sets of n-grams."""
    paragraphs, last_blank = [], True
    for i, line in enumerate((text or "").split("\n")):
        blank = not any(c.isalnum() for c in line)
        if not blank and last_blank:
            paragraphs.append((i, []))
        if not blank:
            paragraphs[-1][1].append(line)
        last_blank = blank
    entries = []
    for line, lines in paragraphs:
        words, best = license_scan.words_of("\n".join(lines)), {}
        half = license_scan.WINDOW // 2
        for at in range(0, max(1, len(words)) if len(words) > 2 * half else 1, half):
            window = words[at : at + 2 * half]
            grams = set(license_scan.hashes_of(window))
            scores = license_scan.scores_of(model, " ".join(window))
            chance = [1 / (1 + np.exp(-s / model.temperatures[k == len(scores) - 1])) for k, s in enumerate(scores)]
            if chance[-1] < license_scan.MIN_PROBABILITY or not grams:
                continue
            found = {"unknown": (0.0, chance[-1])}
            for k, family in enumerate(license_scan.FAMILIES):
                cover = max(len(grams & set(t)) / min(len(grams), len(t)) for t in model.templates[family])
                if chance[k] >= license_scan.MIN_PROBABILITY and cover >= license_scan.MIN_COVER:
                    found.pop("unknown", None)
                    found[family] = (cover, chance[k])
            for family, sure in found.items():
                best[family] = max(best.get(family, (0, 0)), sure)
        if len(best) > 1:
            best.pop("unknown", None)
        entries += [(line, f, *best[f]) for f in sorted(best)]
    names = {f for _, f, _, _ in entries} - {"unknown"}
    names -= {n for n, others in license_scan.ABSORBED_BY.items() if names & set(others)}
    return len([e for e in entries if e[1] != "unknown"]), len([e for e in entries if e[1] == "unknown"]), ",".join(sorted(names)), entries


def licence_rows(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, r) for r in license_scan.scan(frame).collect())]


def test_licences_against_brute_force(spark, docs, no_docs):
    model = license_scan.trained()
    mit, bsd = "\n\n".join(license_scan.BODIES["MIT"]), "\n".join(license_scan.BODIES["BSD-2-Clause"] + license_scan.BODIES["BSD-3-Clause"][:1])
    texts = [mit, bsd, "Dual MIT/Apache-2.0", None, "", "\n\n \n", "no words of any law here", "mit der Bahn\n\n\n ** \n\nLicensed under the\r\nGNU GPL version 3.", "\n\n#\n# All rights\n# reserved\n#\nx"]
    texts += ["word " * 4000 + "\nReleased under the MIT License.\n" + "word " * 500, "Licensed under the Wombat Moonlight License, version 7.7", "Ärger 中文 license ٣ mit\n中文\n\nlicensed"]
    texts += ["\n".join(rows) for rows in ([t for _, _, t, _ in license_scan.labelled_rows()[i : i + 9]] for i in range(0, 300, 37))]
    for text, row in zip(texts, licence_rows(spark, texts)):
        n, unknown, families, entries = brute_licences(text, model)
        assert (row.n_licenses, row.n_unknown, row.families) == (n, unknown, families), text
        got = [e.split(":") for e in row.paragraphs.split(",") if e]
        assert [(int(a), b) for a, b, _, _ in got] == [(e[0], e[1]) for e in entries]
        assert [float(x) for e in got for x in (e[3], e[2])] == pytest.approx([x for e in entries for x in e[2:]], abs=2e-6)
    assert license_scan.scan(no_docs).count() == 0 and license_scan.scan(docs).count() == docs.count()
    assert license_scan.scan(docs).columns == ["doc_id", "n_licenses", "n_unknown", "families", "paragraphs"]
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("width", [72, 80])
def test_published_texts_are_named_by_their_bodies(spark, width):
    """Texts that the machine has, most of whose paragraphs are not in the table, and short ones; without headings too."""
    import os
    import textwrap

    texts = {k: "\n\n".join(license_scan.BODIES[k]) for k in ("MIT", "ISC", "Zlib", "Unlicense", "BSD-2-Clause")}
    texts["BSD-3-Clause"] = texts["BSD-2-Clause"] + "\n\n" + license_scan.BODIES["BSD-3-Clause"][0]
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            texts[name] = re.split(r"\n\s*\n", open(path).read(), maxsplit=2)[2]
    wrap = lambda t, mark: "\n".join(mark + x for p in t.split("\n\n") for x in [*textwrap.wrap(p, width), ""])
    names = list(texts)
    rows = licence_rows(spark, [h + wrap(texts[k], m) for k in names for h, m in (("", ""), ("", " * "), (f"{k} License\n\n", "# "))])
    for i, row in enumerate(rows):
        assert names[i // 3] in row.families.split(","), (names[i // 3], row)
    # of paragraphs that several licences have in common, the most are the text's own
    for i, name in enumerate(names):
        counts = Counter(e.split(":")[1] for e in rows[3 * i].paragraphs.split(","))
        counts.pop("unknown", None)
        assert counts.most_common(1)[0][0] == name or name == "BSD-3-Clause", (name, counts)


def test_licence_statements_on_held_out_text(spark):
    """Sentences and names that are in no row of the table, unseen licences, and prose that uses their words."""
    right = {
        "Dual MIT/Apache-2.0": "Apache-2.0,MIT", "This crate is offered under the terms of Apache-2.0": "Apache-2.0", "We release our code under AGPLv3": "AGPL-3.0",
        "The toolkit is made available under LGPL-3.0": "LGPL-3.0", "Everything here is covered by MPL-2.0, the docs are not.": "MPL-2.0",
        "This project is licensed under the MIT License - see the LICENSE.md file for details": "MIT", "Photos: licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": "BSL-1.0", "// SPDX-License-Identifier: ISC": "ISC",
        "License :: OSI Approved :: Apache Software License, Apache License, Version 2.0": "Apache-2.0", "Dieses Werk ist lizenziert unter CC BY-SA 4.0": "CC-BY-SA-4.0",
        "licensed under the Apache\nLicense, Version 2.0": "Apache-2.0", "Copyright 1999 Bar. All rights reserved.": "Proprietary",
    }
    unseen = ["Licensed under the Wombat Moonlight License, version 7.7", "SPDX-License-Identifier: WTFPL", "released under the terms of the Vim License"]
    prose = ["They went mit dem Zug to Apache county", "the driver has a clean record", "two licenses were revoked by the fishing office", "version 3 of the general theory", "a free public library"]
    rows = licence_rows(spark, [*right, *unseen, *prose])
    assert [r.families for r in rows[: len(right)]] == list(right.values())
    assert [(r.families, r.n_unknown) for r in rows[len(right) :][: len(unseen)]] == [("", 1)] * len(unseen)
    assert sum(r.n_licenses for r in rows[-len(prose) :]) == 0


HEAD = "ETag: \"a\"\r\nLast-Modified: Mon\r\nContent-Type: text/html\r\nX-A: 1\r\nX-A: 2\r\n"


def test_revisits(spark):
    schema = "record_id string, warc_type string, profile string, target_uri string, warc_date timestamp, http_status int, http_headers string, payload_digest string, payload_length long"
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    full = lambda i, url, m, head=HEAD, status=200: (i, "response", None, url, at(m), status, head, f"d{i}", 5)
    again = lambda i, url, m, head: (i, "revisit", warc.NOT_MODIFIED, url, at(m), 304, head, None, 0)
    rows = [
        full("a", "HTTP://Ex.com:80#x", 1), full("b", "http://ex.com/", 5, HEAD.replace('"a"', '"b"')), full("c", "http://ex.com/", 6, status=500),
        again("r1", "http://ex.com/", 1, 'ETag: "a"'), again("r2", "http://ex.com/", 4, 'ETag: W/"a"\r\nContent-Type: x\r\nX-A: 3'),
        again("r3", "http://ex.com/#f", 9, 'ETag: "a"'), again("r4", "http://ex.com/", 9, "Last-Modified: Mon"), again("r5", "http://ex.com/", 9, "X: 1"),
        again("r6", None, 9, 'ETag: "a"'), again("r7", "http://ex.com/other", 9, 'ETag: "a"'), again("r2", "http://ex.com/", 4, 'ETag: W/"a"\r\nContent-Type: x\r\nX-A: 3'),
        ("r8", "revisit", "other profile", "http://ex.com/", at(9), 304, "", None, 0), (None,) * 9,
    ]
    from datetime import datetime

    rows = [tuple(datetime.fromisoformat(v) if k == 4 and v else v for k, v in enumerate(r)) for r in rows]
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "1 as at", "'x' as url", "2 as slice")
    for slices in ((1, 1), (1, 3), (2, 1024), (warc.HOT_ROWS, warc.SLICES)):
        got = sorted((r.record_id, r.outcome, r.match_id) for r in warc.resolve_revisits(frame, *slices).collect())
        assert got == [("r1", "no_earlier", None), ("r2", "resolved", "a"), ("r2", "resolved", "a"), ("r3", "mismatch", "b"), ("r4", "resolved", "b"), ("r5", "unvalidated", "b"), ("r6", "no_earlier", None), ("r7", "no_earlier", None)]
    r2 = warc.resolve_revisits(frame).where("record_id = 'r2'").first()
    assert r2.merged_headers == {"etag": 'W/"a"', "last-modified": "Mon", "content-type": "text/html", "x-a": "3"} and r2.payload_digest == "da"
    assert warc.resolve_revisits(frame.where("false")).count() == 0


def test_canonical_urls(spark):
    same = {
        "HTTP://u:p@Ex.com:80/a/./b/../c?#f": "http://ex.com/a/c", "https://[2001:DB8::1]:443/x": "https://[2001:db8::1]/x", "https://[::1]:8443": "https://[::1]:8443/",
        "http://e/%7e%c3%a9/%zz%?q=%2f": "http://e/%7E%C3%A9/%zz%?q=%2F", "http://e/../../a/..": "http://e/", "http://e/a/b/.": "http://e/a/b/", "http://e/a//b/...": "http://e/a//b/...",
        "urn:x#y": "urn:x", "": "", None: None,
    }
    frame = spark.createDataFrame([(u,) for u in same], "u string")
    got = {r.u: r.c for r in frame.select("u", warc.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == same


def test_revisits_of_a_hot_url_equal_brute_force(spark):
    """One URL with two thirds of the records, ties among them, and one stray date long before the rest."""
    from datetime import datetime, timedelta, timezone

    rng, rows = np.random.default_rng(5), []
    for i in range(600):
        day = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(rng.integers(0, 250)))
        day = datetime(1970, 1, 2, tzinfo=timezone.utc) if i == 3 else day
        url = "http://hot/" if rng.random() < 0.66 else f"http://e/{int(rng.integers(0, 40))}"
        kind = rng.random() < 0.3 or i == 3
        rows.append((f"{i:04d}", "response" if kind else "revisit", None if kind else warc.NOT_MODIFIED, url, day, 200 if kind else 304, 'ETag: "a"', f"d{i}", i))
    schema = "record_id string, warc_type string, profile string, target_uri string, warc_date timestamp, http_status int, http_headers string, payload_digest string, payload_length long"
    want = []
    for r in rows:
        if r[1] == "revisit":
            earlier = [(x[4], x[0]) for x in rows if x[1] == "response" and x[3] == r[3] and x[4] < r[4]]
            want.append((r[0], max(earlier)[1] if earlier else None))
    frame = spark.createDataFrame(rows, schema)
    for hot_rows, slices in ((5, 8), (50, 1024), (10000, 1024)):
        got = [(r.record_id, r.match_id) for r in warc.resolve_revisits(frame, hot_rows, slices).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    want = sorted((tuple(r[rel.columns.index(c)] for c in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*order).collect()), key=str) == want


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    n = [d.count() for d in seen]
    assert n[0] >= n[1] >= n[2] >= n[3] == n[4] > 0
    for d in seen[1:5]:
        assert d.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in seen[2].collect() if brute_contamination(r.text, items)[4]}
    assert {r.doc_id for r in seen[2].collect()} - dirty == {r.doc_id for r in seen[3].collect()}
    assert corpus_pipeline.run(spark, sf).count() == n[5]


def test_pipeline_odd_rows(spark, docs, no_docs, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names go through all stages; empty tables give an empty mixture."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 60, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (None, "x"), (2, None)], "item_id long, text string")
    for name, table, size in (("some", docs, None), ("none", no_docs, 0)):
        folder = str(tmp_path / name)
        for t, frame in (("documents", table), ("labels", labels), ("benchmark", bench)):
            frame.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(table.columns) <= set(out.columns) and (out.count() == size if size is not None else out.count() > 0)
        assert out.where("text is null").count() == 0
