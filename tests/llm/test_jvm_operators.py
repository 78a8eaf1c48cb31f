"""Mixing, exact dedup, url filter, shards and license scan against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.llm import license_scan, mixing, queries, sharding, url_filter
from tamarack.llm.exact_dedup import exact_unique
from tests.llm.frames import DOCUMENTS, write_documents

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return write_documents(tmp_path_factory.mktemp("awkward"))


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write_documents(tmp_path_factory.mktemp("empty"), [])


def documents(spark, folder):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows(spark, name, folder):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name, tmp_path):
    if name == "op4_url_filter":
        spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        empty = str(tmp_path)
    elif name == "op6_vector_search":
        spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        empty = str(tmp_path)
    elif name == "op5_quality":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{empty}/labels.parquet")
    found = queries.QUERIES[name](spark, empty)
    assert found.count() == 0 and found.columns


# --- mixing -------------------------------------------------------------------------


def size_of(text):
    return 0 if text is None else len([w for w in SPACE.split(text) if w])


def water_levels(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, target, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        level = goal / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            goal -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_mix(spark, awkward, which):
    folder = awkward if which == "awkward" else SMALL
    docs = documents(spark, folder)
    got = rows(spark, "op2_source_mix", folder)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d["doc_id"], size_of(d["text"])) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size_of(d["text"])
    targets = water_levels(dict(sizes))
    source_of = {d["doc_id"]: d["source"] for d in docs}
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[s] and math.isclose(r["target"], targets[s], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    if which == "small":
        largest = Counter()
        for d in docs:
            largest[d["source"]] = max(largest[d["source"]], size_of(d["text"]))
        for s in sizes:
            assert abs(taken[s] - targets[s]) <= max(0.1 * targets[s], largest[s])
    again = rows(spark, "op2_source_mix", folder)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_emits_copies(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    out = mixing.mixed(docs)
    plan = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == plan.rows.agg(F.sum("copies")).first()[0]


def test_targets_reach_every_cap(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 0), (None, 5)], "source string, size long").withColumn("_id", F.lit(1))
    got = {r["source"]: r["target"] for r in mixing.source_rates(sizes).collect()}
    want = water_levels({"a": 1, "b": 1000, "c": 0, None: 5})
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in got)


# --- exact dedup ---------------------------------------------------------------------


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_exact_dedup(spark, awkward, which):
    folder = awkward if which == "awkward" else SMALL
    docs, groups = documents(spark, folder), defaultdict(list)
    for d in docs:
        text = d["text"] or ""
        groups[SPACE.sub("", text)].append((-len(text), d["doc_id"] is None, d["doc_id"] or 0))
    got = rows(spark, "op3_exact_dedup", folder)
    assert len(got) == len(docs)
    want = Counter()
    for d in docs:
        bare = SPACE.sub("", d["text"] or "")
        best = min(groups[bare])
        want[(d["doc_id"], None if best[1] else best[2], len(groups[bare]), hashlib.sha256(bare.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_unique_keeps_columns(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = exact_unique(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({SPACE.sub("", d[1] or "") for d in DOCUMENTS})


# --- url filter ----------------------------------------------------------------------


def url_parts(url):
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    host = re.match(r"[^/?#]*", rest[2]).group()
    path = re.match(r"[^?#]*", rest[2][len(host) :]).group()
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in host), path


def rule_of(host, path):
    found = [
        (h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(found, key=lambda x: len(x[0]), default=(None, None))


def test_url_rules(spark):
    got = rows(spark, "op4_url_filter", SMALL)
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path = url_parts(urls[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= url_filter.THRESHOLD else "allow"))


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "http://net", "http://xnet/", "http://a.example.net/en/?q", "http://example.net/en",
            "http://É.ORG/fr/", "http://x.org?/fr/", "a://b://c.net/", "http://x.example.com/de/" + "y" * 50_000, "http://a\nb.net/\nc#d"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate([*urls, *urls])], "page_id int, url string, _row int")
    out = url_filter.url_verdicts(pages).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        host, path = url_parts(r["_row"]["url"])
        rule, verdict = rule_of(host, path)
        assert (r["_host"], r["_path"], r["_rule"]) == (host, path, rule) and r["_verdict"] in ("allow", "block")
        assert verdict in (None, r["_verdict"])


def test_url_grams_by_brute_force(spark):
    fields = [("", ""), ("a", "/"), ("host.example", "/en/1"), ("ü😀é.org", "/😀😀😀/日本語日本語"), ("aaaaaaaa", "/" + "ab" * 40)]
    frame = spark.createDataFrame(fields, "host string, path string")
    for r in frame.select("*", url_filter.grams(F.col("host"), F.col("path")).alias("found")).collect():
        marked = (("h", f"^{r['host']}$"), ("p", f"^{r['path']}$"))
        want = {mark + text[i : i + n] for mark, text in marked for n in (3, 4, 5) for i in range(len(text) - n + 1)}
        assert len(r["found"]) == len(want) and set(r["found"]) == want


def test_long_urls_take_linear_time(spark):
    """A path of a million characters; by substrings from the start one of a tenth did not end in 40 s."""
    rng = random.Random(3)
    path = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/") for _ in range(1_000_000))
    pages = spark.createDataFrame([(1, f"https://host.example/{path}"), (2, "https://host.example/")], "page_id long, url string")
    began = time.monotonic()
    out = {r["_row"]["page_id"]: r for r in url_filter.url_verdicts(pages).collect()}
    assert out[1]["_path"] == f"/{path}" and 0 <= out[1]["_score"] <= 1
    assert time.monotonic() - began < 60


def test_url_model_separates_unseen_hosts(spark):
    bad = ["m.casino-win.example.com", "free-bets.example.com", "ads-track.example.org", "cheap-pills.example.org"]
    good = ["thther.example.org", "www.ththen.example.com", "weather-station.example.org", "blog.tionsh.example.com"]
    pages = spark.createDataFrame([(f"https://{h}/en/7",) for h in bad + good], "url string")
    verdicts = {r["_host"]: r["_verdict"] for r in url_filter.url_verdicts(pages, rules=()).collect()}
    assert [verdicts[h] for h in bad + good] == ["block"] * 4 + ["allow"] * 4


# --- shards --------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_shards(spark, awkward, which):
    folder = awkward if which == "awkward" else SMALL
    docs, got = documents(spark, folder), rows(spark, "op7_exact_shards", folder)
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in slots)


def test_shards_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    got = sharding.sharded(spark.range(0, 1000, numPartitions=7).select("id", F.col("id").cast("string").alias("text")), shards=3).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["_shard"]].append((r["_slot"], r["_row"]["id"]))
    assert sorted(len(x) for x in by_shard.values()) == [333, 333, 334]
    for found in by_shard.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found)))
        ids = [i for _, i in sorted(found)]
        assert ids != sorted(ids) and 300 < sum(ids) / len(ids) < 700


def test_shards_of_very_many_partitions(spark, monkeypatch):
    drawn, draw = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda counts, *rest: drawn.append(counts) or draw(counts, *rest))
    # partition 0 holds a third of all rows, 100,000 others the rest
    part = F.when(F.col("id") < 100_000, F.lit(0)).otherwise(F.col("id") % 100_000 + 1)
    rows = spark.range(300_011).select(F.col("id").alias("_id"), part.alias("_part"))
    got = sharding.dealt(rows, shards=7)
    sizes = {r["_shard"]: r["count"] for r in got.groupBy("_shard").count().collect()}
    assert [len(x) for x in drawn] == [sharding.GROUPS] and sum(drawn[0]) == 300_011
    assert sizes == {s: 300_011 // 7 + (s < 300_011 % 7) for s in range(7)}
    assert got.select("_id").distinct().count() == 300_011
    # the large partition is spread as chance has it: 14,286 rows a shard, standard deviation 90
    hot = [r["count"] for r in got.filter("_part = 0").groupBy("_shard").count().collect()]
    assert len(hot) == 7 and all(abs(n - 100_000 / 7) < 500 for n in hot)


def test_no_task_has_a_whole_partition(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1000)
    rows = spark.range(64_000).select(F.col("id").alias("_id"), F.lit(3).alias("_part"))
    ranked = sharding._permuted(rows, "_part", 1, 64_000, "_rank")
    assert ranked.agg(F.min("_rank"), F.max("_rank"), F.count_distinct("_rank")).first()[:] == (0, 63_999, 64_000)
    order = F.xxhash64("_id", F.lit(1))
    assert rows.groupBy(F.shiftrightunsigned(order, 63 - (64).bit_length())).count().agg(F.max("count")).first()[0] < 2000


def test_hypergeometric_follows_its_law():
    state = sharding.random.Random(5)
    drawn = Counter(sharding.hypergeometric(state, 8, 12, 10) for _ in range(20_000))
    for k in range(9):
        p = math.comb(8, k) * math.comb(12, 10 - k) / math.comb(20, 10)
        assert abs(drawn[k] / 20_000 - p) < 0.012
    assert 0 <= sharding.hypergeometric(state, 10**12, 10**12, 10**6) <= 10**6


def test_matrix_margins():
    matrix = sharding.communication_matrix([5, 0, 17, 1000], 7)
    assert [sum(r) for r in matrix] == [5, 0, 17, 1000]
    columns = [sum(c) for c in zip(*matrix, strict=True)]
    assert max(columns) - min(columns) <= 1


# --- licenses ------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base_places(text):
    words = WORD.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))
    found = []
    for phrase, label in license_scan.BASE:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), found


@pytest.mark.parametrize("which", ["small", "awkward"])
def test_license_base(spark, awkward, which):
    folder = awkward if which == "awkward" else SMALL
    docs, got = documents(spark, folder), rows(spark, "op8_license_scan", folder)
    key = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
    want = Counter()
    for d in docs:
        n, found = base_places(d["text"])
        starts = [i for i, _ in found]
        labels = ",".join(sorted({x for _, x in found}))
        want[(d["doc_id"], n, len(found), min(starts, default=None), max(starts, default=None), labels)] += 1
    assert Counter(map(key, got)) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


LICENSE_TEXTS = {
    "MIT License MIT LICENSE, mit\nlicense": (3, 0, 4, "mit"),
    "a mit licenses": (0, None, None, ""),
    "Released under the MIT License.": (1, 3, 3, "mit"),
    "Licensed under the Apache License, Version 2.0.": (1, 3, 3, "apache"),
    "Licensed under CC BY-NC 4.0.": (0, None, None, "cc-by-nc"),
    "This work is licensed under the GNU General Public License, version 3.": (1, 7, 7, "gpl"),
    "under the GNU Lesser General Public License": (1, 4, 4, "gpl,lgpl"),
    "SPDX-License-Identifier: BSD-3-Clause": (0, None, None, "bsd-3-clause"),
    "the license of an apache helicopter": (0, None, None, ""),
    "x" * 3000 + " GPLv3 " + "y" * 3000: (0, None, None, "gpl"),
}


def test_license_labels(spark, tmp_path):
    texts = list(LICENSE_TEXTS)
    folder = write_documents(tmp_path, [(i, t, "en", "s") for i, t in enumerate(texts)])
    for r in rows(spark, "op8_license_scan", folder):
        assert (r["n_base"], r["first_word"], r["last_word"], r["labels"]) == LICENSE_TEXTS[texts[r["doc_id"]]]


def test_rules_have_their_gates():
    for rule in license_scan.signature_rules():
        assert re.search(rf"\b{rule['keyword']}\b|{rule['keyword']}  ", rule["pattern"])
    assert len(license_scan.signature_rules()) > 300


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""

#: Texts that rest on the notice alone: at least one for each rule.
NOTICE_TEXTS = [
    (MIT_TEXT, "mit"),
    (MIT_TEXT.replace('"Software"', "\u201cSoftware\u201d"), "mit"),
    (ISC_TEXT, "isc"),
    (BSD_TEXT, "bsd"),
    ("Copyright (c) 2024 The Example Company of Somewhere, Inc., its parents and its heirs. All rights reserved.", "proprietary"),
    ("Copyright. All rights reserved.", "proprietary"),
    ("Proprietary and confidential. Use is subject to a license.", "proprietary"),
    ("Released into the public domain.", "public-domain"),
    ("This work was placed in the public domain.", "public-domain"),
    ("Dedicated to the public domain.", "public-domain"),
    ("See the LICENSE file.", "see-license"),
    ("See LICENCE file", "see-license"),
]


def labels_and_scores(spark, folder, texts):
    found = rows(spark, "op8_license_scan", write_documents(folder, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    return [(r["labels"], r["score"]) for r in sorted(found, key=lambda r: r["doc_id"])]


def test_notices_fit_their_standard_texts(spark, tmp_path):
    found = labels_and_scores(spark, tmp_path, [t for t, _ in NOTICE_TEXTS])
    assert [labels for labels, _ in found] == [label for _, label in NOTICE_TEXTS]
    assert all(score > 0 for _, score in found)
    assert {label for label, *_ in license_scan.NOTICES} == {label for _, label in NOTICE_TEXTS}


def fitting_texts(pattern):
    """Spaced words that fit a rule: once with every option left out, once for each word of its alternatives."""
    bare = pattern.removeprefix("(?<= )").removesuffix("(?= )").replace("[cs]", "c")
    bare = re.sub(r"\(\?:  \[\^ \]\+\)\{0,[0-9]+\}\?", "", bare).replace("[0-9]+", "7")
    todo, done = [bare], set()
    while todo:
        text = todo.pop()
        group = re.search(r"\(([^()]*)\)(\??)", text)
        if group is None:
            option = re.search(r"(.)\?", text)
            if option is None:
                done.add(f" {text} ")
            else:
                todo += [text[: option.start()] + x + text[option.end() :] for x in ("", option[1])]
        else:
            choices = group[1].split("|") + ([""] if group[2] else [])
            todo += [text[: group.start()] + x + text[group.end() :] for x in choices]
    return done


def test_every_rule_passes_the_stems():
    for rule in license_scan.signature_rules():
        texts = fitting_texts(rule["pattern"])
        assert texts and all(re.fullmatch(f" ?{rule['pattern']} ?", text) for text in texts), rule
        assert all(any(stem.replace(" ", "  ") in text for stem in license_scan.STEMS) for text in texts), rule


UNDER_TEXTS = [
    ("Released under the Apache 2.0.", "apache"),
    ("distributed under the MPL 2.0", "mpl"),
    ("Available under the BSD.", "bsd"),
    ("It is released under Creative Commons Attribution 4.0.", "cc-by"),
    ("provided under the terms of the MIT", "mit"),
    ("Released under pressure from the committee.", ""),
]


def test_names_after_under_need_no_other_word(spark, tmp_path):
    found = labels_and_scores(spark, tmp_path, [t for t, _ in UNDER_TEXTS])
    assert [labels for labels, _ in found] == [label for _, label in UNDER_TEXTS]
    assert [score > 0 for _, score in found] == [bool(label) for _, label in UNDER_TEXTS]


FUSED_TEXTS = [
    ("GPLv3", "gpl"),
    ("GPLv2+", "gpl"),
    ("GPL3", "gpl"),
    ("a GNU GPLv2 program", "gpl"),
    ("GPLv3-or-later", "gpl"),
    ("GPL v. 3, GPLv 3", "gpl"),
    ("LGPLv2.1", "lgpl"),
    ("AGPLv3", "agpl"),
    ("Released under the MPLv2", "mpl"),
    ("the MPLv2.0 license", "mpl"),
    ("SPDX-License-Identifier: Apache2", "apache"),
    ("licensed under the EUPLv1.2", "eupl"),
    ("GPLv3 or LGPLv3", "gpl,lgpl"),
    ("CC0 license", "cc0"),
    ("GPLvx, GPLs and xGPLv3", ""),
    ("a php7 server, no license", ""),
]


def test_versions_may_be_attached(spark, tmp_path):
    found = labels_and_scores(spark, tmp_path, [t for t, _ in FUSED_TEXTS])
    assert [labels for labels, _ in found] == [label for _, label in FUSED_TEXTS]
    assert [score > 0 for _, score in found] == [bool(label) for _, label in FUSED_TEXTS]


def test_an_attached_version_ranks_like_its_own_word(spark, tmp_path):
    found = rows(spark, "op8_license_scan", write_documents(tmp_path, [(0, "GPLv3", "en", "s"), (1, "GPL v3", "en", "s")]))
    rules = {r["place"]: r for r in license_scan.signature_rules()}
    scanned = license_scan.license_scan(spark.createDataFrame([(0, "GPLv3"), (1, "GPL v3")], "doc_id int, text string")).collect()
    kept = [[rules[d["place"]]["priority"] for d in r["_found"]] for r in scanned]
    assert kept[0] == kept[1] == [45] and len({r["score"] for r in found}) == 1
