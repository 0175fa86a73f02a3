"""Licence scans against plain word lists, and the set join against all pairs."""

from __future__ import annotations

import math
import random
import re
import textwrap

import numpy as np
import pytest

from evalboard.llm import licenses as L
from evalboard.llm.kernels import ngram_hashes
from evalboard.llm.queries import op9_license_scan

from .conftest import ODD, PROSE, documents

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def notices(w, templates, threshold):
    """(template, overlap, first, last pair) of every notice, by trying every window."""
    pairs, out = list(zip(w, w[1:], strict=False)), []
    for t, x in enumerate(templates):
        tw = words(x.text)
        own = set(zip(tw, tw[1:], strict=False))
        width, clusters, furthest = math.ceil((len(tw) - 1) / threshold - 1e-9), [], -1
        for i in range(len(pairs)):
            block = pairs[i : i + width]
            overlap = len(own & set(block))
            if own and pairs[i] in own and overlap >= threshold * len(own) - 1e-9:
                last = max(i + k for k, p in enumerate(block) if p in own)
                if i > furthest:
                    clusters.append([])
                furthest = max(furthest, last)
                clusters[-1].append((-overlap, last - i, i, last))
        out += [(t, -min(c)[0], min(c)[2], min(c)[3], len(own)) for c in clusters]
    return out


def kept(found):
    order = sorted(found, key=lambda m: (-m[1] / m[4], -m[1], m[0], m[2]))
    return [m for i, m in enumerate(order) if not any(2 * (min(m[3], b[3]) - max(m[2], b[2]) + 1) > min(m[3] - m[2], b[3] - b[2]) + 1 for b in order[:i])]


def plain(text):
    w = words(text)
    places = sorted((i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    base = {label for _, label in places}
    found = kept(notices(w, L.TEMPLATES, 0.8))
    more, score = base | {L.TEMPLATES[m[0]].label for m in found}, max([float(bool(places)), *(m[1] / m[4] for m in found)])
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(more)), round(score, 9), sorted((m[0], m[1], m[2], m[3] + 1) for m in found)


def test_against_plain(spark):
    r = random.Random(5)
    texts = [*ODD, "all the rights\n" + PROSE[0] + "\nreserved"]
    for t in (x.text for x in L.TEMPLATES):
        w = t.split()
        texts += [t, PROSE[0] + "\n" + t.upper() + "\n" + PROSE[1], " ".join(x for x in w if r.random() > 0.15), "\n".join(w)]
        texts += ["\n".join(" * " + x for x in textwrap.wrap(t, columns)) for columns in (20, 70, 80)]
        w = [x for x in w if r.random() > 0.15]
        texts += [PROSE[0] + "\n" + "\n\n".join(w) + "\n" + PROSE[1], "\n".join(x + " " + r.choice(t.split()) if r.random() < 0.3 else x for x in w)]
    texts += ["CC-BY cc by-sa MIT\tLicense, apache license apache license", "Gnu General Public\nLicense", "mit licenses", "İstanbul MIT LİCENSE"]
    got = {x["doc_id"]: x for x in L.scan_licenses(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], round(x["score"], 9), sorted((m["template"], m["overlap"], m["first_word"], m["last_word"]) for m in x["notices"])) == plain(t), t


@pytest.mark.parametrize("seed", range(6))
def test_filters_lose_no_match(seed):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(9)]
    templates = tuple(L.Template(f"t{i}", " ".join(r.choices(pool, k=r.randint(1, 9)))) for i in range(8))
    vocabulary = L.vocabulary_of(templates)
    index = L.build_index(templates, np.array([r.randint(0, 50) for _ in vocabulary]), 0.7)
    texts = [r.choices([*pool, "other"], k=r.randint(0, 20)) + r.choice(templates).text.split()[: r.randint(0, 9)] + r.choice(templates).text.split() for _ in range(60)]
    flat = [(i, w) for i, t in enumerate(texts) for w in t]
    row = np.array([i for i, _ in flat])
    pairs, at = ngram_hashes(L.word_keys([w.encode() for _, w in flat]), row, 2)
    found, token = L.template_tokens(pairs, vocabulary)
    begin = np.searchsorted(row, np.arange(len(texts)))
    got = sorted((i, t, n, a - begin[i], b - begin[i]) for i, t, n, a, b in L.matches(at[found], row[at[found]], token, index))
    want = sorted((i, *m[:4]) for i, text in enumerate(texts) for m in notices(text, templates, 0.7))
    assert got == want and want


BY, GPL = "This work is licensed under a Creative Commons Attribution 4.0 International License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


@pytest.mark.parametrize(("behind", "label", "text"), [
    ("", "cc-by", BY), (", commercial use allowed", "cc-by", BY), (". Images: ShareAlike.", "cc-by", BY), (" NonCommercial NoDerivatives sa nc nd", "cc-by", BY),
    (" This library", "gpl", GPL), (" Lesser Affero", "gpl", GPL), ("", "cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"), (" sa", "cc-by-nc", "licensed under cc by-nc 4.0"),
])
def test_words_behind_a_notice_decide_nothing(spark, behind, label, text):
    got = L.scan_licenses(documents(spark, ["Some words before. " + text + behind + " and some words after."])).first()
    by_template = {m["label"]: (m["overlap"], m["size"]) for m in got["notices"]}
    assert set(by_template) == {label} and by_template[label][0] == by_template[label][1]


def test_bags_of_words_are_no_notice(spark):
    texts = ["licensed by cc under 4", "All seats reserved, rights", "license the under mit", " ".join(sorted(BY.split())), " ".join(reversed(GPL.split()))]
    assert [r["labels"] for r in L.scan_licenses(documents(spark, texts)).collect()] == [""] * 5


def test_two_notices_beside_each_other(spark):
    got = L.scan_licenses(documents(spark, [f"{BY}. {GPL} {BY} Released under the MIT License. All rights reserved."])).first()
    assert got["labels"] == "all-rights-reserved,cc-by,gpl,mit" and [m["label"] for m in got["notices"]] == ["cc-by", "gpl", "cc-by", "mit", "all-rights-reserved"]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Released under the Apache License", "apache"),
        ("Licensed under the MIT License, Version 2.0", "mit"),
        ("All of it was reserved by rights", ""),
        ("(c) 2020 Somebody. All rights reserved.", "all-rights-reserved"),
        ("This library is free software; you can redistribute it\nand/or modify it under the terms of the GNU Lesser General\nPublic License as published by the Free Software Foundation;\neither version 2.1 of the License, or any later version.", "lgpl"),
        ("the rights of way and under the terms of a license to use, copy and sell the software, all of it free of charge", ""),
        ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met:", "bsd"),
    ],
)
def test_known_notices(spark, text, labels):
    assert L.scan_licenses(documents(spark, [text])).first()["labels"] == labels


def test_query_labels_wrapped_notices(spark, tmp_path):
    texts = ["\n".join(textwrap.wrap(t.text, 70)) for t in L.TEMPLATES]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["labels"] for x in op9_license_scan(spark, str(tmp_path)).collect()}
    assert all(t.label in got[i].split(",") for i, t in enumerate(L.TEMPLATES))


def test_odd_rows(odd, empty):
    assert L.scan_licenses(odd).count() == odd.count() and L.scan_licenses(empty).count() == 0
