"""License scans, vector codes and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import license_scan as L
from corpusmill.llm import merkle as M
from corpusmill.llm import vector_codes as V
from corpusmill.llm.license_rules import CONFIDENCE, RULES, STEMS

# ---------------------------------------------------------------- licences


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_scan(text):
    """Every rule without a gate, every pair of detections compared."""
    w = words_of(text)
    said = "".join(f"{i}:{x} " for i, x in enumerate(w))
    found = []
    for k, r in enumerate(RULES):
        for m in re.finditer(r.regex, said, re.ASCII):
            first = int(m.group().split(":")[0])
            found.append((first, first + m.group().count(":"), r.tier, k, r.label))
    def beats(y, x):
        return y[0] <= x[0] and y[1] >= x[1] and (y[2] < x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[1] - y[0] == x[1] - x[0] and y[3] < x[3]))
    kept = [x for x in found if not any(beats(y, x) for y in found)]
    places, base = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels = sorted(base | {x[4] for x in kept})
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), max((CONFIDENCE[x[2]] for x in kept), default=0.0)), sorted(x[:2] + (x[4], x[2], x[3]) for x in kept)


LICENSES = [
    "Released under the MIT License",
    "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "Licensed under CC BY-NC 4 and CC BY-NC-SA 4.0",
    "cc by nc cc by nc cc-by-nc",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3",
    "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the",
    "Redistribution: neither the name of the Foo Corp nor the names of its contributors may be used to endorse or promote products",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on",
    "https://creativecommons.org/licenses/by-sa/4.0/ Creative Commons Attribution-ShareAlike 4.0",
    "copyright (c) 2020 Some Body Ltd. All rights reserved.",
    "under the mit licenseé and éunder the mit license",
    "under\nthe\x00MIT license under the mit-license",
    "Kelvin Kits under the MIT licence İ",
    "no licence here but open software and the bsd operating system",
    None, "", " \t\n", "!!!", "under the mit license " * 300,
]


def test_license_scan_equals_plain_rules_without_a_gate(spark):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(LICENSES)], "doc_id long, text string, n_words int, base string")
    got = {r.doc_id: tuple(r)[1:] for r in L.scan(d).collect()}
    assert got == {i: plain_scan(t)[0] for i, t in enumerate(LICENSES)}
    assert got[0][4:6] == ("mit", "mit") and got[2][4] == "cc-by-nc" and got[3][1:4] == (3, 0, 6)
    assert got[4][5] == "gpl-3" and got[4][6] == 1.0 and got[5][5] == "gpl-3"


def test_license_detections_are_those_of_the_scan(spark):
    d = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")
    got = {}
    for r in L.detections(d).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.end_word, r.label, r.tier, r.rule))
    assert {k: sorted(v) for k, v in got.items()} == {i: kept for i, t in enumerate(LICENSES) if (kept := plain_scan(t)[1])}


def test_license_scan_of_real_texts_needs_no_gate(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: tuple(r)[1:] for r in L.scan(d).collect()} == {r.doc_id: plain_scan(r.text)[0] for r in d.collect()}


def test_every_rule_is_gated_by_a_part_of_what_it_matches():
    assert len(RULES) > 250
    assert all(any(s in r.keyword for s in STEMS) and len(r.keyword) >= 3 for r in RULES)
    assert all(r.label.strip() and "|" not in re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", r.pattern)) for r in RULES)


def test_license_scan_odd_rows(spark, odd, empty):
    assert L.scan(empty).count() == 0 and L.detections(empty).count() == 0
    rows = L.scan(odd).collect()
    assert len(rows) == odd.count() and sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    assert {r.n_words for r in rows if r.doc_id == 8} == {30_000}


def test_license_scan_runs_no_python_and_no_shuffle(spark):
    plan = L.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "from_json" not in plan


# ---------------------------------------------------------------- vector codes


def plain_codes(rows, rounds=V.ROUNDS):
    """(vec_id, label, vector) -> ({row: (code, error)}, codebooks), by plain loops over integers."""
    import math

    ok = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    if not ok:
        return [], None
    width = -(-max(len(r[2]) for r in ok) // V.PARTS)
    ints = [[math.floor(x * V.SCALE) for x in r[2]] + [0] * (width * V.PARTS - len(r[2])) for r in ok]
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, ok[i][2]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i in order[: V.ENTRIES]] for p in range(V.PARTS)]
    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(V.PARTS):
            members = {}
            for v in ints:
                members.setdefault(near(v, p)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for r, v in zip(ok, ints):
        found = [near(v, p) for p in range(V.PARTS)]
        out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def coded(spark, rows):
    d = spark.createDataFrame([(a, b, c, "x", 1.0) for a, b, c in rows], "vec_id long, label int, embedding array<double>, code string, error double").repartition(3)
    return [tuple(r) for r in V.compress(d).collect()]


def expected(rows):
    out, books = plain_codes(rows)
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((a, c, e if e < 1 << 63 else None, total[b] if total[b] < 1 << 63 else None, sha) for a, b, c, e in out), key=repr)


def test_vector_codes_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2]), [round(rng.gauss(0, 0.1), rng.choice([1, 5])) for _ in range(8)]) for i in range(600)]
    rows += [rows[3], rows[3], (None, 1, [0.5] * 8), (None, None, [-0.25] * 8)]
    rows += [(900, 1, None), (901, 1, [0.1, None] * 4), (902, 1, [float("nan")] + [0.0] * 7), (903, 2, [float("inf")] + [0.0] * 7)]
    rows += [(2000 + i, 3, [-0.001] * 8) for i in range(50)]
    got = coded(spark, rows)
    assert sorted(got, key=repr) == expected(rows) and len(got) == 654


def test_vector_codes_of_odd_lengths_and_huge_components(spark):
    rows = [(1, 1, [0.5]), (2, 1, [1.0, 2.0, 3.0]), (3, None, []), (4, None, [-1.0] * 6)]
    assert sorted(coded(spark, rows), key=repr) == expected(rows)
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.choice([-1, 1]) * 2.0 ** rng.randint(0, 40) for _ in range(8)]) for i in range(300)]
    assert sorted(coded(spark, rows), key=repr) == expected(rows)


def test_vector_codes_of_nothing(spark):
    assert coded(spark, [(1, 1, None)]) == [] and V.compress(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_vector_codes_decode_to_their_entries(spark):
    rng = random.Random(7)
    rows = [(i, 0, [rng.random() for _ in range(8)]) for i in range(40)]
    x = V.finite(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    codes = V.train(x)
    for r in V.encode(x, codes).withColumn("back", V.decode(F.col("code"), codes)).collect():
        ints = [int(v * V.SCALE // 1) for v in rows[r.vec_id][2]]
        assert sum((round(b * V.SCALE) - a) ** 2 for a, b in zip(ints, r.back)) == r.error


def test_partial_distances_drop_only_what_is_farther():
    import numpy as np

    rng = np.random.default_rng(8)
    for kind in (np.int64, object):
        book = rng.integers(-20, 20, (90, 6)).astype(kind)
        book[40] = book[7]  # a tie
        x = np.concatenate([rng.integers(-20, 20, (500, 6)).astype(kind), book])
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        at, least = V.nearest(x, book)
        assert at.tolist() == [row.index(min(row)) for row in d.tolist()] and least.tolist() == d.min(axis=1).tolist()
    assert V.falling_variance(np.array([[0, 5, 1], [0, -5, 2]])) == [1, 2, 0]


# ---------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    def proofs(leaves):
        """Root, and (sibling lists, places) of each leaf."""
        paths, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
        while len(now) > 1:
            for k, i in enumerate(at):
                run = now[i // 16 * 16 : i // 16 * 16 + 16]
                paths[k].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
                at[k] = i // 16
            now = [digest(*now[i : i + 16]) for i in range(0, len(now), 16)]
        return now[0], paths
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, built = [], []
    for s in names:
        g = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub, paths = proofs([leaf_of(r) for r in g])
        subs.append(sub)
        built.append((g, paths))
    root, above = proofs(subs)
    out = []
    for s, sub, up in zip(built, subs, above):
        for r, path in zip(*s):
            cur = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                cur = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for place, sib in path + up:
                cur = digest(*sib[:place], cur, *sib[place:])
            out.append((r[0], leaf_of(r), sub, root, digest(*(d for _, sib in path + up for d in sib)), cur, cur == root))
    return sorted(out, key=repr)


def manifest_of(d):
    x = M.manifest(d, M.hashed(*[F.col(c) for c in M.FIELDS]), "source", "doc_id", [F.col("doc_id"), M.tampered(d).alias("bad")])
    x = x.withColumn("f", M.folded(F.coalesce("bad", "leaf"), F.col("proof")))
    return sorted((tuple(r) for r in x.select("doc_id", "leaf", "subroot", "root", M.siblings_digest(F.col("proof")), "f", F.col("f") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize("range_rows", [1, 7, 100, 100_000])
def test_manifest_equals_plain_trees_however_rows_fall_into_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(M, "RANGE_ROWS", max(3, range_rows))
    rng = random.Random(range_rows)
    rows = [(i, "hot", "en", i, f"Text {i} ÄB") for i in range(300 if range_rows > 1 else 40)]
    rows += [(i, s, None, None, None if i % 7 == 0 else "Ünï T") for s, n in (("a", 1), ("b", 16), ("c", 17), ("é", 33), (None, 5), ("", 2)) for i in range(n)]
    rows += [(None, "a", "x", 3, "Q"), (None, "a", "x", 3, "Q"), (4, "hot", "en", 4, "Text 4 ÄB"), (4, "hot", "en", 4, "other")]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int").repartition(5)
    assert manifest_of(d) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(5, None, None, None, None)]
    got = manifest_of(spark.createDataFrame(rows, schema))
    assert got == plain_manifest(rows) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()
    assert manifest_of(spark.createDataFrame([], schema)) == []


def test_manifest_of_odd_rows(spark, odd):
    rows = [tuple(r[c] for c in M.FIELDS) for r in odd.collect()]
    assert manifest_of(odd) == plain_manifest(rows)
