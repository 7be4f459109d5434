"""The training-data operators against plain loops, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinframe.llm import decontaminate, katz, language, licenses, minhash_forest, mixing, pseudonyms, range_join, token_shards, toxicity, words
from kinframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, state int, cls string, block int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs_of(spark, rows):
    """``(doc_id, text, lang, source)`` rows with extra columns whose names operators use."""
    full = [(i, t, lang, s, len(t or ""), 7, "k", 1, "c", 2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"word{int(rng.paretovariate(0.8)) % words}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0"), (20, base[0], "en", "s0"), (21, base[1] + " more", None, None)]
    rows += [(22, "", "en", "s1"), (23, None, "de", "s1"), (None, base[2], "en", "s2"), (None, None, None, None)]
    rows += [(24, LONG, "en", "s0"), (25, "a b", "en", "s0"), (26, " \t\n ", "en", "s0"), (27, "x" * 3_000_000, "en", "s0"), (28, "Ünï cödé ÀÉ 你好", "fr", "s1")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


# ------------------------------------------------------------------ words


def test_words_match_plain_splits():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\r\x0b\x0c\x00aBz09.,_éß你") for _ in range(rng.randrange(40))).encode() for _ in range(300)] + [None, b"", b"y" * 2_500_000]
    for table, pattern in ((words.WHITESPACE_WORDS, rb"[^\x20\x09-\x0D]+"), (words.ALNUM_WORDS, rb"[0-9a-zA-Z\x80-\xff]+")):
        w = words.Words(texts, table)
        seen = {}
        for i, t in enumerate(texts):
            want = [m.lower() for m in re.findall(pattern, t or b"")]
            got = [w.raw[a:b].lower() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.stop[w.first[i] : w.first[i + 1]])]
            assert got == want
            for x, h in zip(want, w.hash[w.first[i] : w.first[i + 1]].tolist()):
                assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)
    assert mixing.word_counts(texts).tolist() == [len((t or b"").split()) for t in texts]


# ------------------------------------------------------------------ 1 licences


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND"
    rows = [(1, mit), (2, "Text. Released under the MIT License.\nLicensed under the Apache License, Version 2.0. End"), (3, None), (4, ""), (5, "the license plate")]
    rows += [(6, "Released under the MIT License.\n" * 3), (7, "Copyright (c) 2020 Ann. All rights reserved."), (8, "SPDX-License-Identifier: MIT"), (6, "Released under the MIT License.\n" * 3)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses, r.left_over) for r in got}
    assert found[1] == (3, "mit-grant,mit-notice,as-is", "MIT", 0)
    assert found[2] == (2, "mit-ref,apache-2-ref", "Apache-2.0,MIT", 0)
    assert found[3] == found[4] == found[5] == (0, "", "", 0)
    assert found[6] == (3, "mit-ref,mit-ref,mit-ref", "MIT,MIT,MIT", 0) and len(got) == 9
    assert found[7] == (2, "copyright,reserved", "Proprietary", 0)
    assert found[8] == (1, "spdx", "", 1)


MIT_TEXT = """MIT License

Copyright (c) 2020 Ann Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD_TEXT = """Copyright 2020 Ann Other

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
GPL_TEXT = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_licences(spark):
    """The standard texts as they are wrapped, plain, with \\r\\n, and as comment blocks."""
    texts = {"MIT": MIT_TEXT, "BSD-3-Clause": BSD_TEXT, "GPL-3.0": GPL_TEXT.format(":", ",", 3), "GPL-2.0": GPL_TEXT.format(";", ";", 2), "MPL-2.0": MPL_TEXT}
    rows = []
    for name, text in texts.items():
        lines = text.split("\n")
        forms = [text, "\r\n".join(lines), *("\n".join(f"{mark} {x}".rstrip() for x in lines) for mark in ("#", " *", "//", "REM"))]
        rows += [(f"{name}/{k}", "some code\n\n" + form) for k, form in enumerate(forms)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {key: key.split("/")[0] for key, _ in rows}


def test_spdx_lines_and_dual_licences(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT\n#include <x>"), (2, "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause) */")]
    rows += [(3, "released under the MIT license and licensed under the Apache License, Version 2.0"), (4, "x\n# SPDX-License-Identifier: Apache-2.0\nAll rights reserved."), (5, None)]
    got = {r.doc_id: (r.licenses, r.left_over) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), spdx=True).collect()}
    assert got == {1: ("MIT", 0), 2: ("GPL-2.0-only,BSD-3-Clause", 0), 3: ("Apache-2.0,MIT", 0), 4: ("Proprietary,Apache-2.0", 0), 5: ("", 0)}


def test_every_sentence_passes_the_triggers():
    for _, text in licenses.SENTENCES:
        assert re.search(licenses.TRIGGERS, text) and re.search(licenses._RAW_TRIGGERS, text), text


# ------------------------------------------------------------------ 2 mixing


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s] + 1e-9}
        if not over:
            return target
        full |= over


def check_mix(docs, **options):
    rows = mixing.mix(docs, **options).collect()
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.copies <= 3
    target = plain_targets(size)
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
    for s in size:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, **options).collect()))
    return rows


def test_mixing_meets_targets(spark, awkward, nothing):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(0, 90)), "en", rng.choice(["big"] * 6 + ["b", "c", None])) for i in range(400)]
    rows += [(1000, "one two", "en", "a-tiny"), (1001, prose(rng, 5000), "en", "c")]
    for block in (16, 1024):
        assert len(check_mix(docs_of(spark, rows), block=block)) == 402
    assert len(check_mix(awkward, block=64)) == awkward.count()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents_repeat_whole_rows(spark, awkward):
    plan = {(r.doc_id, r.source, r.size): 0 for r in mixing.mix(awkward, block=64).collect()}
    for r in mixing.mix(awkward, block=64).collect():
        plan[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mixed_documents(awkward, block=64)
    assert out.columns == awkward.columns
    got = collections.Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert got == collections.Counter({k: v for k, v in plan.items() if v})


def test_schedule_is_spread_evenly(spark):
    targets = spark.createDataFrame([("sa", "a", 60_000, 60_000.0), ("sb", "b", 20_000, 25_000.0), ("sc", "c", 40_000, 35_000.0)], "key string, source string, source_size long, target double")
    slots = sorted(mixing.schedule(targets, 10).collect())
    n = collections.Counter(r.key for r in slots)
    assert n == {"sa": 6000, "sb": 2500, "sc": 3500}
    for key, share in (("sa", 0.5), ("sb", 2500 / 12000), ("sc", 3500 / 12000)):
        assert sorted(r["rank"] for r in slots if r.key == key) == list(range(n[key]))
        for at in range(200, 11_000, 200):
            assert abs(sum(r.key == key for r in slots[:at]) - share * at) < 15


def test_mix_of_many_sources_meets_every_target(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", f"host{i % 1500}.org") for i in range(4000)] + [(-1, "w " * 20_000, "en", "big")]
    out = mixing.mix(docs_of(spark, rows), block=64)
    per = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 1501 and all(r.taken == round(r.target) for r in per)


# ------------------------------------------------------------------ 3 decontamination


def plain_hits(text, items):
    toks = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        n = min(10, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(toks) - n + 1):
            if n and tuple(toks[i : i + n]) in wins:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(toks), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [500_000, 7])
def test_decontamination(spark, awkward, nothing, max_windows):
    import hashlib

    rng = random.Random(9)
    items = [(i, prose(rng, 14)) for i in range(6)] + [(2, prose(rng, 12)), (10, "Short-One item"), (11, None), (None, prose(rng, 15)), (12, "!!")]
    rows = [(i, prose(rng, 30) + ", " + (items[i % 10][1] or "") + "! " + prose(rng, 20), "en", "s") for i in range(30)]
    rows += [(40, items[0][1] + " " + items[1][1], "en", "s"), (41, " ".join(items[3][1].split()[:9]), "en", "s"), (42, "x short one, ITEM y short one item", "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows).unionByName(awkward)
    got = decontaminate.report(docs, bench, max_windows=max_windows).collect()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    assert len(got) == docs.count()
    for r in got:
        want = [plain_hits(t, items) for t in texts[r.doc_id]]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) in [(n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest()) for n, h, f in want]
        assert r.contaminated == (r.n_hit > 0)
    clean = decontaminate.decontaminate(docs, bench, max_windows=max_windows)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    cut = decontaminate.decontaminate(docs, bench, remove="spans", max_windows=max_windows)
    assert cut.count() == docs.count() and "short" not in cut.where("doc_id = 42").first().text.lower()
    assert decontaminate.report(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


# ------------------------------------------------------------------ 4 pseudonyms


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    rng = random.Random(2)
    cards = []
    while len(cards) < 60:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(c):
            cards.append(c)
    bad = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards[:5]]
    rows = [(i, f"pay {c} now; or {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}!!") for i, c in enumerate(cards)]
    rows += [(100 + i, f"not {c}.") for i, c in enumerate(bad)]
    rows += [(200, "+1 (743) 555-3824 (743) 555-3824"), (201, "10.1.2.3 and 300.1.2.3"), (202, "born 2024-02-29, 29.02.2024; 2023-02-29 12/31/1999 31/12/1999 1700-01-01")]
    rows += [(203, "a.Bc-9@Mail.example.com a.bc-9@other.org"), (204, "123-45-6789 666-45-6789"), (205, None), (206, ""), (207, "v 2.0."), (207, "v 2.0."), (208, "1" * 200_000), (209, "a" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k", counts=("found", "changed")).collect()}
    new = []
    for i in range(60):
        m = re.fullmatch(r"pay (\d{16}) now; or (\d{4})-(\d{4})-(\d{4})-(\d{4})!!", out[i].text)
        assert m[1] == "".join(m.groups()[1:]) and luhn(m[1]) and m[1][0] == "4" and m[1] != cards[i]
        new.append(m[1])
    assert len(set(new)) == len(set(cards))
    for i in range(5):
        assert out[100 + i].text == rows[60 + i][1] and out[100 + i].changed == 0
    m = re.fullmatch(r"\+1 (\(\d{3}\) \d{3}-\d{4}) (\(\d{3}\) \d{3}-\d{4})", out[200].text)
    assert m[1] == m[2] != "(743) 555-3824"
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)\.(\d+) and 300\.1\.2\.3", out[201].text)
    assert all(int(x) < 256 for x in m.groups()) and m[0][:8] != "10.1.2.3"
    m = re.fullmatch(r"born (\d{4})-(\d\d)-(\d\d), (\d\d)\.(\d\d)\.(\d{4}); 2023-02-29 (\d\d)/(\d\d)/(\d{4}) (\d\d)/(\d\d)/(\d{4}) 1700-01-01", out[202].text)
    assert (m[1], m[2], m[3]) == (m[6], m[5], m[4]) and (m[7], m[8], m[9]) == (m[11], m[10], m[12])
    m = re.fullmatch(r"([a-z0-9])\.([A-Z0-9])([a-z0-9])-([a-z0-9])@Mail.example.com (.*)@other.org", out[203].text)
    assert f"{m[1]}.{m[2].lower()}{m[3]}-{m[4]}" == m[5]
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} 666-45-6789", out[204].text)
    assert (out[205].text, out[206].text, out[207].text) == (None, "", "v 2.0.") and out[209].text == rows[-1][1]
    other = pseudonyms.pseudonymise(df, key="other").where("doc_id = 0").first().text
    assert other != out[0].text
    empty = pseudonyms.pseudonymise(df.limit(0), "k")
    assert empty.count() == 0 and empty.columns == df.columns


def plain_feistel(key, tag, a, b, ma, mb):
    for r in range(pseudonyms.ROUNDS):
        seed = f"{key}|{tag}|{ma}|{mb}|{r}|{b}"
        a, b, ma, mb = b, (a + int(hashlib.sha256(seed.encode()).hexdigest()[:12], 16)) % ma, mb, ma
    return a, b


def plain_number(key, tag, x):
    h = len(x) // 2
    a, b = plain_feistel(key, tag, int("0" + x[:h]), int(x[h:]), 10**h, 10 ** (len(x) - h))
    return (str(a).zfill(h) if h else "") + str(b).zfill(len(x) - h)


def plain_check(x):
    return next(c for c in "0123456789" if luhn(x + c))


def iban_rest(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def put(old, new, kind="[0-9]"):
    it = iter(new)
    return re.sub(kind, lambda m: next(it), old)


def plain_pseudonym(key, kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "social":
        area = int(m[:3])
        a, b = plain_feistel(key, "social", area - 1 - (area > 666), (int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, 898, 99 * 9999)
        return f"{a + (1 if a + 1 < 666 else 2):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if kind == "phone":
        head, d = d[:-10], d[-10:]
        low = [0 if int(c) < 200 else 200 for c in (d[:3], d[3:6])]
        n = [800 if x else 200 for x in low]
        a, b = plain_feistel(key, "phone", int(d[:3]) - low[0], (int(d[3:6]) - low[1]) * 10000 + int(d[6:]), n[0], n[1] * 10000)
        return put(m, f"{head}{a + low[0]:03}{b // 10000 + low[1]:03}{b % 10000:04}")
    if kind == "card":
        k = 1 if d[0] == "4" else 2 if re.match("5[1-5]|3[4678]|65", d) else 4
        new = d[:k] + plain_number(key, "card", d[k:-1])
        return put(m, new + plain_check(new))
    if kind == "iban":
        x = m.replace(" ", "")
        own = re.sub("[^0-9]", "", x[4:])
        body = put(x[4:], "".join(plain_number(key, "iban", own[i : i + 18]) for i in range(0, len(own), 18)))
        return put(m, f"{x[:2]}{98 - iban_rest(body + x[:2] + '00'):02}{body}", "[A-Z0-9]")
    k = 2 if kind == "french" else len(re.match(r"\+([0-9]+)", m)[1]) + 1 + ("(0)" in m)
    return put(m, d[:k] + plain_number(key, kind, d[k:]))


def test_pseudonyms_match_a_plain_feistel_and_stay_valid(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = []
    for _ in range(150):
        values.append(("social", f"{rng.choice([x for x in range(1, 900) if x != 666]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}"))
        values.append(("phone", rng.choice(["({}) {}-{}", "+1 {}-{}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4))))
        start = rng.choice(["4", "51", "55", "2221", "2720", "34", "37", "6011", "65", "3528"])
        body = start + digits(15 - len(start))
        values.append(("card", body + plain_check(body)))
        country, size = rng.choice([("DE", 18), ("GB", 18), ("FR", 23), ("NO", 11), ("MT", 27)])
        account = ("NWBK" if country == "GB" else "") + digits(size - 4 * (country == "GB"))
        whole = f"{country}{98 - iban_rest(account + country + '00'):02}{account}"
        values.append(("iban", rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])))
        values.append(("world", rng.choice(["+44 20 {} {}", "+49 (0)30 {}{}", "+353 1 {} {}", "+33 6 {}{}"]).format(digits(4), digits(4))))
        values.append(("french", "0" + rng.choice("123456789") + "".join(rng.choice([" ", "."]) + digits(2) for _ in range(4))))
    df = spark.createDataFrame([(i, f"x: {v}; IS {v}, MY end", "o", 1, "t", 2) for i, (_, v) in enumerate(values)], "doc_id long, text string, __old string, __NEW int, __text string, `a.b` int")
    out = pseudonyms.pseudonymise(df, "secret", counts=("n", "m"))
    assert out.columns == [*df.columns, "n", "m"]
    rows = {r.doc_id: r for r in out.collect()}
    for i, (kind, v) in enumerate(values):
        want = plain_pseudonym("secret", kind, v)
        assert rows[i].text == f"x: {want}; IS {want}, MY end", (kind, v)
        assert (rows[i]["__old"], rows[i]["__NEW"], rows[i]["__text"], rows[i]["a.b"], rows[i].n) == ("o", 1, "t", 2, 2)
        d = re.sub("[^0-9]", "", want)
        if kind == "social":
            assert not re.search("^(000|666|9..)|-00-|0000$", want)
        if kind == "phone":
            old = re.sub("[^0-9]", "", v)
            assert all((d[at] < "2") == (old[at] < "2") for at in (-10, -7))
        if kind == "card":
            assert luhn(d) and len(d) == 16 and (v[0] == "4" or d[:2] == v[:2])
        if kind == "iban":
            x = want.replace(" ", "")
            assert iban_rest(x[4:] + x[:4]) == 1 and want[:2] == v[:2]
    bad = spark.createDataFrame([("DE00 3704 0044 0532 0130 00",), ("GB29 NWBK",)], "text string")
    assert {r.text for r in pseudonyms.pseudonymise(bad, "k").collect()} == {"DE00 3704 0044 0532 0130 00", "GB29 NWBK"}


def test_social_numbers_and_codes_are_permuted_one_to_one(spark):
    e = pseudonyms.Expressions(pseudonyms.Spark, "k")
    areas = spark.range(1, 900).where("id <> 666").select(F.format_string("%03d", "id").alias("a"))
    serials = spark.range(1, 61).select(F.format_string("%02d-%04d", (F.col("id") % 99 + 1).cast("int"), "id").alias("s"))
    df = areas.join(serials, F.lit(True)).select(F.concat_ws("-", "a", "s").alias("m"))
    assert df.select(F.expr(e.social("m")).alias("x")).distinct().count() == 898 * 60


def test_feistel_is_a_permutation(spark):
    e = pseudonyms.Expressions(pseudonyms.Spark, "k")
    for digits in (1, 2, 3):
        df = spark.range(10**digits).select(F.lpad(F.col("id").cast("string"), digits, "0").alias("x"))
        got = [r[0] for r in df.select(F.expr(e.number("x", "t"))).collect()]
        assert len(set(got)) == 10**digits and all(len(g) == digits for g in got)
    days = spark.range(3000).select(F.expr("date_format(date_add(DATE'1999-01-01', CAST(id AS INT)), 'yyyy-MM-dd')").alias("x"))
    got = [r[0] for r in days.select(F.expr(e.day("x", "ymd"))).collect()]
    assert len(set(got)) == 3000 and all("1800-01-01" <= g <= "2199-12-31" for g in got)


# ------------------------------------------------------------------ 5 Katz scores


def plain_scores(rows, held):
    """The model by dictionaries: per row (tokens, known, base, score), and the corpus size."""
    tok = [[w.lower() for w in (t or "").encode().split()] + [None] for _, t in rows]
    uni, bi, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for (i, _), t in zip(rows, tok):
        if i is not None and not held(i):
            uni.update(t)
            for h, w in zip(["S", *t], t):
                bi[h, w] += 1
                hist[h] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d2 = katz.discounts(collections.Counter(uni.values())), katz.discounts(collections.Counter(bi.values()))
    cut = lambda r, d: r * (d[r] if r <= 5 else 1)
    p1 = {w: cut(c, d1) / n for w, c in uni.items()}
    if n and 1 - sum(p1.values()) <= 1e-12:
        p1 = {w: c / (n + 1) for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    after = collections.defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))
    alpha, whole = {}, {}
    for h, seen in after.items():
        left = sum(c - cut(c, d2) for _, c in seen)
        whole[h] = hist[h] if left > 1e-12 else hist[h] + 1
        alpha[h] = (left if left > 1e-12 else 1) / whole[h] / (1 - sum(p1[w] for w, _ in seen))

    def p(h, w):
        return cut(bi[h, w], d2) / whole[h] if bi.get((h, w)) else alpha.get(h, 1) * p1.get(w, unknown)

    for h in list(after)[:20]:
        assert math.isclose(sum(p(h, w) for w in uni) + alpha[h] * unknown, 1, rel_tol=1e-9)
    out = []
    for t in tok:
        base = sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((len(t), sum(w in uni for w in t), base, sum(math.log10(p(h, w)) for h, w in zip(["S", *t], t))))
    return out, n


@pytest.mark.parametrize("limits", [{}, {"hot_count": 60, "partition_bytes": 3000}])
def test_katz_matches_plain_loop(spark, awkward, nothing, limits):
    rng = random.Random(4)
    docs = docs_of(spark, [(100 + i, prose(rng, rng.randrange(80)), "en", "s") for i in range(300)]).unionByName(awkward)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, n = plain_scores(rows, held)
    key = lambda i, *x: (str(i), *(round(y, 5) for y in x))
    got = katz.scores(docs, fold, **limits).collect()
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == sorted(key(i, *w) for (i, _), w in zip(rows, want))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert katz.held_out_scores(nothing).count() == 0
    alone = katz.scores(docs, F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and {r.score for r in alone} == {0.0}


def test_katz_discounts():
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    assert all(0 < x < 1 for x in d[1:]) and math.isclose(sum(n * r * (1 - d[r]) for r, n in {1: 100, 2: 40, 3: 20, 4: 12, 5: 8}.items()), 100)
    for n in ({}, {1: 3}, {2: 5}, {1: 1, 2: 9, 3: 30, 4: 2, 5: 9, 6: 50}):
        assert all(0 < x < 1 for x in katz.discounts(n)[1:])


# ------------------------------------------------------------------ 6 MinHash forest


def plain_components(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i in range(len(rows)):
        low[find(i)].append(rows[i][0])
    return [(r[0], len(s), None if r[0] is None else min(low[find(i)])) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("options", [{}, {"reach": 1, "crowded": 1}])
def test_forest_finds_every_component(spark, awkward, nothing, options):
    rng = random.Random(8)
    rows = []
    passage = prose(rng, 60, 5000)
    for g in range(25):
        base = prose(rng, rng.randrange(5, 120), 5000).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(copy) + (" " + passage if g % 3 == 0 else ""), "en", "s"))
    docs = docs_of(spark, rows).unionByName(awkward)
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], 85)
    got = minhash_forest.near_duplicates(docs, 85, **options).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(a), n, str(c)) for a, n, c in want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = minhash_forest.drop_near_duplicates(docs, 85, **options)
    assert left.columns == docs.columns
    named = [a for a, _, c in want if a is not None and a == c]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, set(named))) + ["None", "None"]
    assert minhash_forest.near_duplicates(nothing).count() == 0 and minhash_forest.drop_near_duplicates(nothing).count() == 0


def test_forest_finishes_a_family_without_its_original(spark):
    """Thousands of copies that resemble a text which is not there, each like few others."""
    rng = random.Random(11)
    n, size = 2500, 150
    base, kept, rows = [f"w{i}" for i in range(size)], np.ones((n, size - 4), np.float32), []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(size), 2):
            copy[at] = f"edit{i}x{at}"
            kept[i, max(0, at - 4) : at + 1] = 0
        rows.append((i, " ".join(copy), "en", "s"))
    # Edited runs occur once, so only those of the missing original are common.
    common = kept @ kept.T
    near = 100 * common >= 85 * (2 * (size - 4) - common)
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(1)
        if (low == label).all():
            break
        label = low
    got = minhash_forest.near_duplicates(docs_of(spark, rows), 85).collect()
    assert len(set(label.tolist())) < n / 10
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(label.tolist()))


def test_exact_finish_in_blocks(spark):
    """Every probe meets every class of its region, over blocks and list and matrix shingles."""
    rng = random.Random(12)
    rows, texts = [], []
    for g in range(12):
        base = prose(rng, 80, 5000).split()
        texts += [" ".join([*base[:40], f"e{g}x{k}", *base[41:]]) for k in range(4)]
    found = list(minhash_forest._sets(words.Words([t.encode() for t in texts], words.WHITESPACE_WORDS), 5))
    cls = [bytes([i]) for i in range(len(texts))]
    # Groups lie in one of two regions; class 4k is at home.
    rows = [(c, str(i), str(i // 24), i % 4 > 0) for i, c in enumerate(cls)]
    parties = spark.createDataFrame(rows, "cls binary, comp string, region string, probe boolean")
    table = spark.createDataFrame([(c, s.tobytes()) for c, s in zip(cls, found)], "cls binary, shingles binary")
    for limits in ({}, {"probes": 5, "members": 7}, {"block_bytes": 2_000}):
        got = {(r.a[0], r.b[0]) for r in minhash_forest._exact_links(parties, table, 85, **limits).collect()}
        assert got == {(i, j) for i in range(48) for j in range(i + 1, 48) if i // 4 == j // 4}


def test_forest_with_text_and_negative_ids(spark):
    rng = random.Random(13)
    base = prose(rng, 60)
    rows = [(-5, base), (3, base + " x"), (-9, base + " y"), (7, prose(rng, 60)), (-(2**63), "a b c d e f"), (2**63 - 1, "a b c d e f g")]
    for kind, cast in (("long", int), ("string", str)):
        docs = spark.createDataFrame([(cast(i), t) for i, t in rows], f"doc_id {kind}, text string")
        got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, 80).collect()}
        low = min(cast(i) for i in (-5, 3, -9))
        assert got == {**{cast(i): low for i in (-5, 3, -9)}, **{cast(i): cast(i) for i in (7, -(2**63), 2**63 - 1)}}


# ------------------------------------------------------------------ 7 token shards


def test_token_shards_round_trip(spark, awkward, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    odd = ["  two  spaces ", "tab\t x", "  nbsp", "a　 b", "it's we'll", "\n\nline \n end ", "mañana 123abc!!", " lead", "x<|endoftext|>y"]
    docs = awkward.unionByName(docs_of(spark, [(500 + i, t, "en", "s") for i, t in enumerate(odd)]))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((str(r.doc_id), len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_shards.round_trip(docs, tokenizer_path()).orderBy("start").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got[:2]] == [None, None]
    assert token_shards.round_trip(nothing, tokenizer_path()).count() == 0


def test_cache_keeps_frequent_pieces(monkeypatch):
    """Ids stay those of the tokenizer while the cache is cut again and again."""
    import pyarrow as pa

    monkeypatch.setattr(token_shards, "CACHE_PIECES", 300)
    encoder = token_shards.Encoder(tokenizer_path())
    rng = random.Random(5)
    encoded = []
    pieces = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda p: encoded.extend(p) or pieces(p))
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "of", "Größe", "x" * 9]) if rng.random() < 0.7 else f"junk{rng.random()}" for _ in range(40)) for _ in range(10)]
        got = encoder.encode(pa.array([*texts, "", None, " a  b"]))
        want = encoder._encode([*texts, "", "", " a  b"])
        assert [x.tolist() for x in got] == want
    assert len(encoder.known) < 900 and encoded.count(" the") == 1


def test_sample_reaching_the_driver_is_bounded(spark, monkeypatch):
    """Rows without an id, or with one and the same, do not all go to the driver."""
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, f"text {i}") for i in range(900)], "doc_id long, text string")
    sent, plain = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(plain(self)) or sent[-1])
    texts = token_shards._sample(docs, 8, 100)
    assert len(texts) == len(set(texts)) == 8 and max(map(len, sent)) == 8


def test_shard_reads_one_document():
    import hashlib

    ids = [np.arange(n, dtype=np.uint32) for n in (1, 5, 300)]
    compress, _ = token_shards._codec(b"")
    frames = [compress.compress(token_shards._bytes(x, 2)) for x in ids]
    data = token_shards.pack_shard([7, None, 9], [2, 6, 301], frames, 2, hashlib.sha256(b"").digest())
    shard = token_shards.Shard(data, b"")
    assert shard.doc_ids == [7, None, 9] and shard.ids(2).tolist() == [*range(300), 0]
    with pytest.raises(ValueError):
        token_shards.Shard(data, b"other")


# ------------------------------------------------------------------ 8 toxicity


def test_toxicity_learns_words(spark, awkward, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 8 == 0
        text = prose(rng, rng.randrange(20, 60)).split()
        if bad:
            for _ in range(rng.choice([1, 2, 5])):
                text.insert(rng.randrange(len(text)), rng.choice(["Vile!", "NASTY", "foul,"]))
        rows.append((100 + i, " ".join(text), "en", "s"))
        if i % 3:
            labels += [(100 + i, int(bad))]
    labels += [(None, 1), (101, None), (105, 0), (105, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_of(spark, rows).unionByName(awkward)
    model = toxicity.train(docs, lab)
    out = toxicity.score(docs, model, ["doc_id"]).collect()
    assert len(out) == docs.count()
    flagged = {r.doc_id for r in out if r.toxic}
    assert flagged == {100 + i for i in range(0, 600, 8)}
    severity = {r.doc_id: r.severity for r in out}
    assert all(0 <= s <= 2 for s in severity.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(flagged)
    none = toxicity.train(docs, lab.limit(0))
    assert toxicity.drop_toxic(docs, none).count() == docs.count() and not any(r.toxic for r in toxicity.score(docs, none, ["doc_id"]).collect())
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0 and toxicity.drop_toxic(nothing, none).count() == 0


def test_repeated_labelled_documents_are_bounded(spark, monkeypatch):
    rows = [(i % 4, f"word{i % 4} text{i}", "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    seen, plain = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda grade, *rest: seen.append(len(grade)) or plain(grade, *rest))
    toxicity.train(docs_of(spark, rows), labels, max_rows=20, min_z=1.0)
    assert seen == [20]


def test_ordinal_fit_orders_thresholds_and_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 900)
    lengths = np.where(grade == 0, 0, np.where(grade == 1, 1, 2))
    flat = np.concatenate([[0] * n if n < 2 else [0, 1] for n in lengths.tolist()]).astype(int)
    w, theta = toxicity.fit(grade, lengths, flat, 2)
    assert theta[0] < theta[1] and w[0] > 0 and w[1] > 0
    margin = np.array([0, w[0], w[0] + w[1]])
    severity = toxicity.Model(np.zeros(2, np.uint64), w, theta).above(margin).sum(1)
    assert severity[0] < 0.2 and abs(severity[1] - 1) < 0.2 and severity[2] > 1.8


# ------------------------------------------------------------------ 9 range join


def plain_links(rows, cosine):
    ok = []
    for i, v, lab in rows:
        good = i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) if good else None)
    n, root = len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i in range(n):
        low[find(i)].append(rows[i][0])
    return [(str(r[0]), links[i], str(None if r[0] is None else min(low[find(i)]))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 8, "block": 7}, {"cell_rows": 8, "pivot_bytes": 1}])
def test_range_join_is_exact(spark, options):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        lab = int(rng.choice([0, 0, 0, 1, 2]))
        if i % 4 == 0:
            base = rng.normal(size=6).astype(np.float32)
        noise = rng.normal(size=6) * rng.choice([0, 0.05, 0.1, 0.5])
        v = (base + noise).astype(np.float32) * np.float32(rng.choice([1, 3]))
        rows.append((i, v.tolist(), lab))
    rows += [(500, [0.0] * 6, 1), (501, None, 1), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (503, [float("nan")] * 6, 1), (504, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1), (505, [1.0] * 6, None), (506, [], 1), (507, [1.0, 2.0], 0), (508, [2.0, 4.0], 0), (None, [1.0] * 6, 0)]
    rows += [(600 + i, rows[0][1], rows[0][2]) for i in range(40)] + [(700 + i, (np.array(rows[3][1]) * 1e-30).tolist(), rows[3][2]) for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, space string, node int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = range_join.range_join(df, 0.98, **options).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted(plain_links(rows, 0.98))
    assert range_join.range_join(df.limit(0), 0.98).count() == 0


# ------------------------------------------------------------------ 10 language


def test_language(spark, awkward, nothing):
    rng = random.Random(7)
    stems = {"aa": ["kato", "mivu", "rupa", "soli"], "bb": ["strunk", "glabe", "frode", "knax"], "cc": ["été", "çava", "noël", "crêpe"]}
    rows = [(100 + i, " ".join(rng.choice(stems[k]) + rng.choice("aeiou") for _ in range(rng.randrange(3, 60))), k, "s") for i in range(600) for k in [rng.choice("abc") * 2]]
    docs = docs_of(spark, rows)
    out = language.held_out_split(docs.unionByName(docs_of(spark, [(1, None, "aa", "s"), (2, "", "aa", "s"), (3, "12 .. …", "bb", "s"), (None, "kato", "aa", "s"), (4, "kato", None, "s"), (100, rows[0][1], "aa", "s"), (5, "你好", "aa", "s")]))).collect()
    truth = {i: k for i, _, k, _ in rows}
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert len(out) == 607 and all(r.held_out == fold(r.doc_id) for r in out)
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(tested) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.98 * len(tested)
    by = {r.doc_id: r for r in out}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[3].score == 0
    assert by[4].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out} <= {"aa", "bb", "cc", "und"}
    assert language.held_out_split(nothing).count() == 0
    assert {r.lang_pred for r in language.held_out_split(docs.where("false").unionByName(docs.limit(3).withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert language.held_out_split(awkward).count() == awkward.count()
