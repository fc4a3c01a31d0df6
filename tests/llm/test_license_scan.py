"""License scans against known places and a brute-force window search."""

import random
from collections import Counter
from difflib import SequenceMatcher

from tessera.llm import license_scan as L

FILLER = "lorem ipsum dolor sit amet consectetur "


def brute(text, differing=L.DIFFERING):
    """Names of templates of which some window of words differs little enough, by trying all windows."""
    words, out = L.WORD.findall((text or "").lower()), set()
    for name, wording in L.TEMPLATES:
        t = L.WORD.findall(wording.lower())
        most = int(differing * len(t))
        if (Counter(t) & Counter(words)).total() < len(t) - most:  # no window can match more words than all of the text has
            continue
        for a in range(len(words)):
            for n in range(len(t) - most, len(t) + most + 1):
                part = words[a : a + n]
                if len(part) == n and max(n, len(t)) - sum(m.size for m in SequenceMatcher(None, t, part, autojunk=False).get_matching_blocks()) <= most:
                    out.add(name)
    return out


def test_each_template_is_found_with_its_place():
    s = L.Scanner()
    for name, wording in L.TEMPLATES:
        text = FILLER * 3 + wording + " " + FILLER * 3
        finds = [f for f in s.scan(text) if f[3] == 0]
        assert name in {f[0] for f in finds}, wording
        assert any(text[a:z].split()[0] == wording.split()[0] for _, a, z, _ in finds)


def test_changed_words_and_clean_texts():
    s = L.Scanner()
    mit = next(w for n, w in L.TEMPLATES if len(w) > 300)
    changed = mit.replace("free of charge", "gratis of charge").replace("modify, ", "")
    assert [(f[0], f[3]) for f in s.scan(FILLER + changed + FILLER)] == [("MIT", 2)]
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    for text in (None, "", FILLER * 50, "a license for fishing, with permission", half, "license " * 4000):
        assert s.scan(text) == []


def test_small_texts_against_brute_force():
    s = L.Scanner()
    for text in ("x Licensed under CC BY 4.0 y", "Licensed under CC BY-NC 4.0. Released under the MIT License.", "licensed under the gnu license", "Licensed under the Apache License, Version 3.0."):
        assert {f[0] for f in s.scan(text)} == brute(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (2, None, "x"), (None, "", "x")], "doc_id bigint, text string, licenses string")
    found = L.scan(df)
    assert found.columns == ["doc_id", "text", "licenses"]
    assert sorted(len(r.licenses) for r in found.collect()) == [0, 0, 1, 1]
    assert L.scan(df.limit(0)).count() == 0


def test_licenses_are_told_apart():
    s = L.Scanner()
    bsd2, bsd3 = (next(w for n, w in L.TEMPLATES if n == name and len(w) > 900) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [(bsd2, "BSD-2-Clause"), (bsd3, "BSD-3-Clause"), (gpl.format("General Public License", "2"), "GPL-2.0"), (gpl.format("General Public License", "3"), "GPL-3.0")]
    cases += [(gpl.format("Lesser General Public License", "2.1"), "LGPL-2.1"), (gpl.format("Affero General Public License", "3"), "AGPL-3.0")]
    for text, name in cases:
        assert [f[0] for f in s.scan(FILLER + text + " " + FILLER)] == [name], name


def test_a_page_of_many_notices():
    short = [(n, w) for n, w in L.TEMPLATES if len(L.WORD.findall(w)) <= L.NOTICE_WORDS]
    found = L.Scanner().scan(" ".join(w for _, w in short))
    assert sorted(f[0] for f in found) == sorted(n for n, _ in short)


def test_an_occurrence_needs_no_certain_word():
    """Also where a word that all licenses have is the one that differs."""
    finds = L.Scanner().scan("This is free and unencumbered software released into the common domain.")
    assert [(f[0], f[3]) for f in finds] == [("Unlicense", 1)]


def test_changed_notices_against_brute_force():
    rng = random.Random(4)
    s = L.Scanner()
    short = [w for _, w in L.TEMPLATES if len(L.WORD.findall(w)) <= L.NOTICE_WORDS]
    for _ in range(60):
        words = []
        for w in rng.sample(short, 2):
            words += rng.choices(["lorem", "the", "license", "is"], k=rng.randint(0, 3))
            own = w.split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(["the", "of", "other"])] * rng.randint(0, 1)
            words += own
        text = " ".join(words)
        wanted, found = brute(text), {f[0] for f in s.scan(text)}
        assert found <= wanted and (found or not wanted), text
        # what isn't given overlaps a find that differs less
        for name in wanted - found:
            assert any(f[0] != name for f in s.scan(text)), text


def test_long_texts_and_places():
    s = L.Scanner()
    apache = next(w for n, w in L.TEMPLATES if n == "Apache-2.0" and len(w) > 100)
    parts = ["İstanbul " + FILLER * 5000, apache, " " + FILLER * 3000, "Released under the MIT License.", " " + "license " * 20_000, apache]
    text = "".join(parts)
    finds = s.scan(text)
    assert [f[0] for f in finds] == ["Apache-2.0", "MIT", "Apache-2.0"]
    assert [text[f[1] : f[1] + 8] for f in finds] == ["Licensed", "Released", "Licensed"]
    many = s.scan("Released under the MIT License. " * 3000)
    assert len(many) == 3000 and {f[0] for f in many} == {"MIT"}


def test_overlapping_finds_keep_the_one_that_differs_less():
    assert [(f[0], f[3]) for f in L.Scanner().scan("Licensed under the BSD 2-Clause License.")] == [("BSD-2-Clause", 0)]


def test_query(spark, sf):
    from tessera.llm.queries import op6_license_scan, table

    s, rows = L.Scanner(), {r.doc_id: r for r in op6_license_scan(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        finds = s.scan(d.text)
        assert rows[d.doc_id].n_finds == len(finds) and rows[d.doc_id].names == ",".join(sorted({f[0] for f in finds}))
        if len(d.text or "") < 1500:
            assert bool(finds) == bool(brute(d.text))
