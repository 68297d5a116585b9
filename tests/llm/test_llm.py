"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import ann, bpe, common, components, fingerprint, katz, langid, licenses, mixing, neardup, packing, passages, queries, surrogates

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, node binary"


def documents(spark, texts, langs=None, sources=None):
    """Rows with extra columns whose names the operators use themselves."""
    ids = [t[0] if isinstance(t, tuple) else k for k, t in enumerate(texts)]
    texts = [t[1] if isinstance(t, tuple) else t for t in texts]
    rows = [(i, t, (langs or ["en"] * len(ids))[k], (sources or ["s"] * len(ids))[k], len(t or ""), 1, True, 0.0, b"x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DDL)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, short, long, repeated, tied texts, a null id."""
    rng = random.Random(5)
    long = prose(rng, 30_000, 3000)
    return [None, "", " \n\t", "one", "two words", long, long, "ID", (None, "no id here"), "Équipe été 42", prose(rng, 80)]


@pytest.fixture(scope="module")
def corpus():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    return rows


def words(text):
    return (text or "").encode().lower().split()


# -- near-duplicates ------------------------------------------------------------


def near_truth(texts, size, percent):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(2)
    base, texts = prose(rng, 150).split(), {}
    for k in range(60):  # a family around a base, some of it just too far from the rest
        t = list(base)
        for i in rng.sample(range(len(t)), k // 8):
            t[i] = f"new{k}_{i}"
        texts[k] = " ".join(t)
    texts |= {100 + k: prose(rng, rng.randrange(3, 60), 12) for k in range(40)} | {200: texts[3], 201: "a b", 202: "A b"}
    got = neardup.near_duplicates(documents(spark, list(texts.items())), neardup.Params(words=3, percent=85)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_truth(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.near_duplicates(documents(spark, odd), neardup.Params(words=3, percent=85)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd)
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["component_id"] == 1
    assert by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert neardup.near_duplicates(documents(spark, odd).limit(0)).count() == 0


def test_repeated_rows_have_one_set(spark, monkeypatch):
    rng, seen = random.Random(11), []
    base, prefixes = prose(rng, 60).split(), neardup._prefixes
    texts = {k: " ".join([*base[:50 - k], *prose(rng, 10 + k).split()]) for k in range(12)} | {k: " ".join(base + [f"e{k}"]) for k in range(20, 24)}
    monkeypatch.setattr(neardup, "_prefixes", lambda placed, sets, p: seen.append([r["node"] for r in sets.select("node").collect()]) or prefixes(placed, sets, p))
    got = neardup.near_duplicates(documents(spark, [*texts.items()] * 2), neardup.Params(words=3, percent=85)).collect()
    assert seen[0] and len(seen[0]) == len(set(map(bytes, seen[0])))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_truth(texts, 3, 85)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(500, 600)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


# -- passages -------------------------------------------------------------------


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for _ in range(100):
        texts = [rng.integers(1, rng.integers(2, 60), rng.integers(0, 60)).astype(np.uint64) for _ in range(3)]
        zero = np.zeros(1, np.uint64)
        v, least = np.concatenate([zero, *(x for t in texts for x in (t, zero))]), int(rng.integers(1, 20))
        want = set()
        for c in np.flatnonzero(v):
            a, b = c - 1, c + 1
            while v[a] > v[c]:
                a -= 1
            while v[b] >= v[c]:
                b += 1
            if b - a - 1 >= least:
                want.add((a + 1, c, b - 1))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, least, max(map(len, texts)))), strict=True)) == want


def test_repeated_passages(spark):
    rng = random.Random(4)
    shared, other = prose(rng, 70, 10**6), prose(rng, 60, 10**6)
    edited = shared.split()
    edited[35] = "changed"
    texts = [prose(rng, 50 + k, 10**6) for k in range(30)]
    texts[3] += " " + shared + " " + prose(rng, 20, 10**6)
    texts[9] = shared + " " + texts[9] + " " + other
    texts[17] += " " + " ".join(edited)
    texts[20] = other + " " + texts[20]
    texts += [texts[5], None, "", "short"]
    got = defaultdict(list)
    for r in passages.repeated_passages(documents(spark, texts)).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == {3, 9, 17, 20, 5, 30}
    assert {(r["start_word"], r["n_words"]) for r in got[3]} == {(53, 70)}
    assert {(r["start_word"], r["n_words"], r["class_id"]) for r in got[9]} == {(0, 70, 3), (129, 60, 9)}
    assert got[17][0]["class_id"] == 3 and got[30][0]["class_id"] == 5 and not got[30][0]["kept"] and got[5][0]["kept"]


def test_repeats_inside_one_document_are_left_alone(spark):
    line = prose(random.Random(1), 60, 10**6)
    assert passages.repeated_passages(documents(spark, [f"{line} {line}", "other text"])).count() == 0
    assert passages.repeated_passages(documents(spark, ["x"]).limit(0)).count() == 0


def test_a_passage_beside_many_open_chains_is_found():
    # a line that b repeats 100 times, then a passage whose middle word was changed:
    # its first part and the line's runs on all diagonals are open together
    rng = np.random.default_rng(9)
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    p, line, one, two = passages.Params(), fresh(4), fresh(30), fresh(30)
    a = np.concatenate([one, line[:1], fresh(4), two])
    b = np.concatenate([one, line[:1], fresh(4), two, *(np.concatenate([line[:1], fresh(1)]) for _ in range(100))])
    assert passages.matches(a, b, list(range(len(b))), p) == [(0, 64, 0, 64)]


def test_a_passage_is_found_from_the_diagonal_of_either_half():
    rng = np.random.default_rng(10)
    p, w = passages.Params(), rng.integers(1, 1 << 62, 60).astype(np.uint64)
    one = np.concatenate([w[:30], rng.integers(1, 1 << 62, 1).astype(np.uint64), w[30:]])
    many = np.concatenate([w[:12], one[30:31], w[12:24], one[30:31], w[24:36], one[30:31], w[36:]])  # three words more
    a, b, c = (neardup.shingles(x, p.words) for x in (w, one, many))
    for d in (0, 1):
        assert passages.matches(a, b, [d], p) == [(0, 55, 0, 56)]
        assert passages.matches(b, a, [-d], p) == [(0, 56, 0, 55)]
    long = passages.Params(similarity=0.5)
    for d in range(4):
        assert passages.matches(a, c, [d], long) == [(0, 55, 0, 58)]


def test_exact_repeats_of_later_members_are_linked(spark):
    # documents 0 .. 5 share part of the passage only, those after them all of it; all
    # else is their own: where the least shingle is in a part, the links fail
    rng = random.Random(12)
    texts, want = [], set()
    for k in range(25):
        p = prose(rng, 60, 10**7).split()
        parts = [p[:30], p[30:], p[15:45], p[:25], p[35:], p[20:50]]
        texts += [(100 * k + i, " ".join([prose(rng, 60, 10**7), *q, prose(rng, 60, 10**7)])) for i, q in enumerate(parts)]
        texts += [(100 * k + 50 + i, " ".join([prose(rng, 60, 10**7), *p, prose(rng, 60, 10**7)])) for i in range(2)]
        want |= {100 * k + 50, 100 * k + 51}
    got = passages.repeated_passages(documents(spark, texts)).where("links > 0").collect()
    assert {r["doc_id"] for r in got} == want and all((r["start_word"], r["n_words"]) == (60, 60) for r in got)


def test_edited_passages_behind_a_first_document_are_linked(spark):
    # the first of three has both halves of the passage, apart, and so all least shingles
    rng = random.Random(13)
    fresh = lambda n: prose(rng, n, 10**9).split()
    texts, want = [], set()
    for _ in range(20):
        p = fresh(60)
        q = [*p[:30], "changed", *p[31:]]
        want |= {len(texts) + 1, len(texts) + 2}
        texts += [[*p[:30], *fresh(40), *p[31:], *fresh(40)], [*fresh(50), *p, *fresh(50)], [*fresh(50), *q, *fresh(50)]]
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).where("links > 0").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)


def test_no_edited_passage_is_left_to_chance(spark):
    rng = random.Random(14)
    fresh = lambda n: prose(rng, n, 10**9).split()
    texts = []
    for k in range(150):
        p = fresh(51)
        q = [p[:25] + fresh(1) + p[26:], p[:25] + fresh(1) + p[25:], p[:25] + p[26:]][k % 3]
        texts += [fresh(40) + p + fresh(40), fresh(40) + q + fresh(40)]
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))


def test_a_passage_that_the_first_document_has_twice(spark):
    rng = random.Random(15)
    fresh = lambda n: prose(rng, n, 10**9).split()
    texts = []
    for _ in range(10):
        p = fresh(60)
        texts += [fresh(30) + p + fresh(100) + p + fresh(30), fresh(40) + p + fresh(40)]
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    want = [(2 * k + d, at, 60, 2 * k) for k in range(10) for d, at in ((0, 30), (0, 190), (1, 40))]
    assert sorted((r["doc_id"], r["start_word"], r["n_words"], r["class_id"]) for r in got) == want


def test_pairs_of_different_classes_only(spark):
    # one shingle that 40 documents of class 1 and 3 others have, repeated inside each
    rng, p = random.Random(16), passages.Params()
    rows = [(7, 1 if d < 40 else d, d, rng.randrange(500), 500 + rng.randrange(500)) for d in range(43)] + [(8, 1, 50, 3, 3), (8, 1, 51, 3, 3), (9, 41, 41, 2000, 2000), (9, 1, 5, 2, 2)]
    got = passages._candidates(spark.createDataFrame(rows, "s long, label long, doc_id long, lo int, hi int"), p)
    want = {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and x[2] < y[2]}
    got = {(r["a"], r["b"]): r for r in got.collect()}
    assert set(got) == want and len(want) == 123
    reach = 2 * passages._reach(p) + 2 * p.words
    assert got[5, 41]["alo"] == 0 and got[5, 41]["bhi"] == 2000 + reach and got[5, 41]["ahi"] == rows[5][4] + reach


def test_texts_alike_in_parts_only_are_not_compared_in_pairs(spark, monkeypatch):
    # 24 documents with the same two lines, too far apart for one passage, and an edited passage behind a first document
    rng, counts = random.Random(18), []
    fresh = lambda n: prose(rng, n, 10**9).split()
    one, two, p = fresh(30), fresh(30), fresh(60)
    texts = [fresh(20) + one + fresh(15) + two + fresh(20) for _ in range(24)]
    texts += [[*p[:30], *fresh(40), *p[31:], *fresh(40)], [*fresh(50), *p, *fresh(50)], [*fresh(50), *p[:30], "changed", *p[31:], *fresh(50)]]
    stored = common.stored

    def counting(df, tag):
        out = stored(df, tag)
        counts.extend([out.count()] if tag == "pairs" else [])
        return out

    monkeypatch.setattr(common, "stored", counting)
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).where("links > 0").collect()
    assert sorted(r["doc_id"] for r in got) == [25, 26] and sum(counts) < 60  # all pairs of the 24 are 276


def test_diagonals_with_a_long_run():
    rng, p = np.random.default_rng(17), passages.Params()
    fresh = lambda n: rng.integers(1, 1 << 31, n).astype(np.int32)
    one, two, line = fresh(21), fresh(11), fresh(3)
    a, b = np.concatenate([fresh(9), one, fresh(5), two]), np.concatenate([one, fresh(2), two[:10], fresh(4), two])
    assert passages.long_diagonals(a, b, p) == [-9, 2]
    assert passages.long_diagonals(a[9:29], b, p) == []  # no run of 21
    many = np.tile(line, 700)  # too many equal runs to list
    assert passages.long_diagonals(many, many, p) == [d for d in range(-2100 + 11, 2100 - 10) if d % 3 == 0]


# -- mixing ---------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    sizes = {"a": 40, "b": 4000, "c": 9000, "d": 2500, None: 700}
    texts, sources = [], []
    for s, total in sizes.items():
        while total > 0:
            n = min(total, rng.randrange(1, 60))
            texts.append(prose(rng, n))
            sources.append(s)
            total -= n
    docs = documents(spark, texts + [None, ""], sources=sources + ["a", "e"])
    line = mixing.mix(docs.select("doc_id", "text", "source"))
    per = {r["row"]: r for r in line.line.where("source_key = 'sa'").collect()}
    taken = line.line.join(line.schedule.groupBy("source_key", "row").agg(F.sum("n_words").alias("t")), ["source_key", "row"], "left").groupBy("source_key")
    got = {r["source_key"]: r for r in taken.agg(F.max("target").alias("target"), F.max("source_size").alias("size"), F.sum("t").alias("t"), F.max(F.col("t") / F.col("size")).alias("most")).collect()}
    total = sum(sizes.values())
    assert sum(r["target"] for r in got.values()) == pytest.approx(total)
    assert got["sa"]["target"] == 120 and len(per) > 0 and got["se"]["target"] == 0
    for r in got.values():
        assert abs((r["t"] or 0) - r["target"]) <= max(4, 0.01 * r["target"]) and (r["most"] or 0) <= 3
    assert got["n"]["target"] <= 3 * 700


def test_mixing_of_odd_rows_and_reruns(spark):
    rng = random.Random(14)
    texts = [(None, "no id here"), (None, None), (1, prose(rng, 30_000)), (2, "twice the same"), (2, "twice the same"), (2, "other text")] + [(10 + k, prose(rng, rng.randrange(60))) for k in range(60)]
    docs = documents(spark, texts, sources=[("a", "b", None)[k % 3] for k in range(len(texts))])

    def run():
        mixed = mixing.mix(docs.select("doc_id", "text", "source"))
        taken = mixed.schedule.groupBy("source_key", "row").agg(F.sum("n_words").alias("t"))
        rows = mixed.line.join(taken, ["source_key", "row"], "left").collect()
        return mixed, sorted((r["doc_id"] or -1, r["source_key"], r["size"], r["t"] or 0) for r in rows)

    mixed, first = run()
    assert run()[1] == first and len(first) == len(texts) and all(t <= 3 * n for _, _, n, t in first)
    # each slot goes to the source on whose stretch of the cumulative targets its mirrored number lies
    goal = {r["source_key"]: r["target"] for r in mixed.line.select("source_key", "target").distinct().collect()}
    ends, total = [], 0.0
    for key in sorted(goal, key=lambda k: (k == "n", k)):
        total += goal[key]
        ends.append((total, key))
    for r in mixed.schedule.select("slot", "source_key").distinct().collect():
        x = int(f"{r['slot']:040b}"[::-1], 2) / 2**40 * sum(goal.values())
        assert r["source_key"] == next(k for end, k in ends if x < end) or min(abs(x - e) for e, _ in ends) < 1e-6


def test_mixing_nothing(spark):
    assert mixing.mix(documents(spark, ["x"]).limit(0)).schedule.count() == 0
    assert mixing.mix(documents(spark, [None, ""])).schedule.count() == 0


# -- licences -------------------------------------------------------------------


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 A. Person\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(",", " ;"), mit + " more", None, "", "hello\nAll rights reserved!\n", "Licenced under the MIT Licence", "Copyright 2020 Ann. Licensed under the MIT License. and a thousand other words", "© 2004-2020 The Regents of a University. All rights reserved.", (None, mit), "x\n" * 100_000]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[k]["license_id"] for k in range(7)] == ["MIT", "MIT", None, None, None, None, "MIT-notice"]
    assert [got[k]["n_lines"] for k in (7, 8, 10)] == [1, 0, 100_000] and got[None]["license_id"] == "MIT"
    assert got[5]["notices"] == ["rights-reserved-notice"] and got[3]["n_lines"] == 0 and got[3]["digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(documents(spark, texts).limit(0)).count() == 0


def test_licence_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op4_license_scan"])
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall(), key=repr) == sorted(map(tuple, licenses.op4_license_scan(spark, SF).select(*names).collect()), key=repr)


def test_full_licence_texts(spark, tmp_path):
    known = licenses.full_texts()
    names = [*licenses.TEXTS, "Apache-2.0-terms"]
    documents(spark, [f"Copyright (c) 2021 A. Person\n{known[n].upper()}" for n in names]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["license_id"] for r in licenses.op4_license_scan(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(names))] == names


# -- neighbours -----------------------------------------------------------------


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, (900, 1))
    v[10] = v[11] = v[12] = v[5]
    rows = [(k, x.tolist(), 1) for k, x in enumerate(v)]
    bad = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [1.0, None] + [0.0] * 22, 1), (1003, [math.nan] * 24, 1), (1004, [math.inf] * 24, 1), (1020, [1.0] * 3, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    found = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, ann.Params(block=256, query_block=16)).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        score = v @ v[q]
        order = [k for k in np.lexsort((np.arange(900), -score)) if k != q][:20]
        assert len(found[q]) == 20
        hits += len({x for x, _ in found[q]} & set(order))
        assert all(abs(s - score[x]) < 1e-12 for x, s in found[q])
    assert hits / (45 * 20) >= 0.9 and set(found) == set(range(0, 900, 20))


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    # asked is the least vector of the id; both rows of id 1 are candidates
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2.0), (2, 1.0), (1, 0.0)]


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


# -- fingerprints ---------------------------------------------------------------


def test_fingerprints(spark, corpus):
    got = {r["doc_id"]: r for r in fingerprint.op6_document_fingerprints(spark, SF).collect()}
    errors, same = [], {}
    for k, (d, t, _, _) in enumerate(corpus):
        after, cut = corpus[(k + 1) % len(corpus)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        a, b = Counter(t.lower().split()), Counter(edited.lower().split())
        errors.append(got[d]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
        assert same.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.15


def test_fingerprints_of_odd_rows(spark, odd):
    got = fingerprint.fingerprints(documents(spark, odd)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd) and by[0]["fingerprint"] == by[2]["fingerprint"] == "" and by[0]["near_next"] == 1.0
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[5]["near_next"] == 1.0
    same = fingerprint.fingerprints(documents(spark, [(7, "a b c d"), (7, "a b c d"), (None, "x y"), (None, "x y"), (9, "z")])).collect()
    assert sorted(r["near_next"] for r in same) == [0.0, 0.0, 0.0, 1.0, 1.0]  # each copy but the last is followed by its copy
    far = fingerprint.fingerprints(documents(spark, [(k, f"w{k} w{k} v") for k in range(50)] + [(1 << 60, "far away"), (-(1 << 60), "w0 w0 v")])).collect()
    assert next(r for r in far if r["doc_id"] == -(1 << 60))["near_next"] == 1.0 and len(far) == 52
    one = fingerprint.fingerprints(documents(spark, ["just one text"])).first()
    assert one["near_next"] == 1.0
    assert fingerprint.fingerprints(documents(spark, odd).limit(0)).count() == 0


def test_fingerprints_give_the_drivers_memory_back(spark, monkeypatch):
    steps, stored = [], common.stored
    monkeypatch.setattr(common, "release", lambda s: steps.append("release"))
    monkeypatch.setattr(common, "stored", lambda df, tag: steps.append(tag) or stored(df, tag))
    assert fingerprint.fingerprints(documents(spark, ["one two", "three", None])).count() == 3
    assert steps == ["release", "keys", "order", "release", "signatures", "release"]


def test_words_of_long_texts_are_not_merged(spark):
    # 20,000 different words each: nothing in common
    texts = [" ".join(f"{c}{k}" for k in range(20_000)) for c in "ab"]
    assert fingerprint.fingerprints(documents(spark, texts)).first()["near_next"] <= 0.1


def test_packing():
    rng = np.random.default_rng(2)
    for top in (1, 240, 241, 5000, 1 << 16, (1 << 20) - 1, 1 << 20, 1 << 40):
        for n in (0, 1, 1000):
            v = rng.integers(0, top, n)
            v[: n // 2] %= 300
            assert (packing.unpack_codes(packing.pack_codes(v)) == v).all() and (packing.unpack(packing.pack(v)) == v).all()


# -- BPE ------------------------------------------------------------------------


def test_bpe_is_the_library(spark, odd, corpus):
    from tokenizers import Tokenizer

    p = bpe.production()
    tok = Tokenizer.from_file(p.tokenizer)
    rng = random.Random(8)
    marks = ["a", "É", "İ", "Σ", "ς", "ŉ", "\x85", "\xa0", "\x1c", " ", "'s", "'LL", "'", "<|endoftext|>", "<|startoftext|>", "<|", "9", "½", "中", "가", "é", "́", "😀", "_", "\x00", "​", "ﬁ"]
    texts = odd + [t for _, t, _, _ in corpus[:40]] + ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(400)]
    small = bpe.Params(tokenizer=p.tokenizer, chunk_words=500, part_words=100)
    assert bpe.encode(documents(spark, texts).limit(0), p).count() == 0
    assert bpe.encode(documents(spark, ["a b", None]).select("text"), p).columns == ["n_tokens", "ids_sha256", "decoded_sha256"]
    wide = bpe.encode(documents(spark, [(3, "a b"), (3, "a b"), (None, None)]), small).collect()
    assert sorted((r["doc_id"] or 0, r["lang"], r["size"], r["n_tokens"]) for r in wide) == [(0, "en", 1, 0), (3, "en", 1, 2), (3, "en", 1, 2)]
    for params in (p, small):
        got = bpe.encode(documents(spark, [(k, t[1] if isinstance(t, tuple) else t) for k, t in enumerate(texts)]).select("doc_id", "text"), params, with_ids=True).collect()
        assert len(got) == len(texts)
        for r in got:
            t = texts[r["doc_id"]]
            ids = tok.encode((t[1] if isinstance(t, tuple) else t) or "", add_special_tokens=False).ids
            assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids)
            assert r["decoded"] == tok.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


# -- personal data --------------------------------------------------------------


def test_surrogates(spark):
    text = "Write to Jo.Doe.42@mail8.example.com or JO.DOE.42@MAIL8.EXAMPLE.COM, +1 (632) 555-4827 or 632-555-4827.\nFrom 17.252.227.210 or 10.0.3.4 with 4111 1111 1111 1111, password=b7db7aa4a5fcc78305.\nMr. John Smith met Mrs. Anna Smith; г-жа Анна Петрова. DE89 3704 0044 0532 0130 00. Version 2.0."
    texts = [text, None, "", "no entities, only 12 words", text]
    got = {r["doc_id"]: r for r in surrogates.replace(documents(spark, texts)).collect()}
    out = got[0]["text"]
    assert got[1]["text"] is None and got[3]["text"] == texts[3] and got[4]["text"] == out and got[3]["n_entities"] == 0
    for x in ("Doe", "example", "4827", "17.252", "4111 1111 1111 1111", "b7db7aa4", "John", "Smith", "Анна", "Петрова", "3704"):
        assert x not in out
    found = surrogates.detect(out)
    assert [f.kind for f in found] == [f.kind for f in surrogates.detect(text)]
    by = defaultdict(list)
    for f in found:
        by[f.kind].append(f.canonical)
    assert len(set(by["email"])) == len(set(by["phone"])) == 1 and len(by["email"]) == len(by["phone"]) == 2
    assert by["family"][0] == by["family"][1] and surrogates.luhn(by["card"][0]) and by["ip"][1].startswith("10.")
    assert surrogates.replace(documents(spark, texts).limit(0)).count() == 0


def test_surrogates_are_permutations():
    key = b"k"
    assert sorted(surrogates.permute(key, "t", x, 1000) for x in range(1000)) == list(range(1000))
    assert len({surrogates.surrogate(key, "ssn", f"{x:09d}") for x in range(3000)}) == 3000


def test_surrogates_without_collisions(spark):
    names = [f"Mr. {a}{b}" for a in "BCDFGHJKLM" for b in ("anor", "elin", "opat", "usik")]
    docs = documents(spark, names)
    table = surrogates.assign(docs, surrogates.Params())
    rows = table.collect()
    given = [r["surrogate"] for r in rows]
    assert len(set(given)) == len(given) == len(names) and not set(given) & {r["entity"] for r in rows}
    broadcast = {r["doc_id"]: r["text"] for r in surrogates.replace(docs).collect()}
    joined = {r["doc_id"]: r["text"] for r in surrogates.replace(docs, surrogates.Params(exceptions=-1)).collect()}
    assert broadcast == joined


# -- language -------------------------------------------------------------------


def test_languages_on_held_out_rows(spark, corpus):
    got = {r["doc_id"]: r for r in langid.op9_language_id(spark, SF).collect()}
    held = [(d, lang) for d, _, lang, _ in corpus if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] for d, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.9


def test_languages_of_odd_rows(spark, odd):
    docs = documents(spark, odd + ["the cat and the dog"] * 30 + ["der Hund und die Katze"] * 30, ["en"] * (len(odd) + 30) + ["de"] * 30)
    model = langid.learn(docs, F.lit(True))
    got = langid.identify(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[0]["lang_score"] == 0 and by[0]["lang_rejected"]
    assert by[len(odd) + 40]["lang_pred"] == "de" and len(got) == docs.count()
    nothing = langid.learn(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.predict(["kurz " * 300_000], model)[0] == langid.predict(["kurz " * 10], model)[0]


# -- language model -------------------------------------------------------------


def test_katz_is_the_definition(spark):
    rng = random.Random(9)
    texts = {k: " ".join(rng.choices("a b c d e f g h i j".split() + [f"r{k}"], k=rng.randrange(0, 40))) for k in range(120)} | {500: None, 501: "", 502: "Zz unseen A"}
    texts |= {600 + k: "always the same" for k in range(8)} | {650: "always the other same x"}  # contexts with large counts only
    train = {d for d in texts if d % 5 != 2 and d != 650 and not 500 <= d < 503}
    p = katz.Params(chunk_tokens=300, part_entries=64)
    learn = (F.col("doc_id") % 5 != 2) & (F.col("doc_id") != 650) & ~F.col("doc_id").between(500, 502)
    got = {r["doc_id"]: r for r in katz.score(documents(spark, list(texts.items())), learn, p).collect()}
    tok = {d: [*words(t), None] for d, t in texts.items()}
    contexts = {d: list(zip([None, "<s>", *t[:-2]], ["<s>", *t[:-1]], t, strict=False)) for d, t in tok.items()}
    c, b, three = Counter(), Counter(), Counter()
    for d in train:
        c.update(tok[d])
        b.update((v, w) for _, v, w in contexts[d])
        three.update(((u, v), w) for k, (u, v, w) in enumerate(contexts[d]) if k)
    n, v = sum(c.values()), len(c)
    c["<s>"] = len(train)
    d_of = [katz.discounts(np.array([sum(x == r for x in of.values()) for r in range(1, p.top + 2)]), p) for of in (b, three)]
    after = [defaultdict(dict), defaultdict(dict)]
    for of, seen in zip((b, three), after, strict=True):
        for (h, w), r in of.items():
            seen[h][w] = r

    def kept(order, h, r):
        whole = min(after[order][h].values()) > p.top
        return d_of[order][r - 1] * r if r <= p.top else r - p.tail * whole

    def uni(w):
        return ((c[w] if w != "<s>" else 0) + 1) / (n + v + 1)

    def prob(order, h, w):
        """P(w|h) of bigrams (order 0) and trigrams (order 1)."""
        total, less = (c[h], uni) if order == 0 else (b[h], lambda x: prob(0, h[1], x))
        if not total:
            return less(w)
        seen = after[order][h]
        if w in seen:
            return kept(order, h, seen[w]) / total
        return less(w) * (1 - sum(kept(order, h, r) for r in seen.values()) / total) / (1 - sum(map(less, seen)))

    everything = [*(x for x in c if x != "<s>"), b"unknown"]
    for h in ("<s>", b"a", b"r7", b"the"):  # each distribution is whole, unknown words being one
        assert sum(prob(0, h, w) for w in everything) == pytest.approx(1)
    for h in (("<s>", b"a"), (b"a", b"b"), (b"always", b"the"), (b"zz", b"a")):
        assert sum(prob(1, h, w) for w in everything) == pytest.approx(1)
    assert max(c[b"a"], c[b"b"]) > p.part_entries  # so there are split contexts
    for d, t in tok.items():
        assert got[d]["n_tokens"] == len(t) and got[d]["train_tokens"] == n and got[d]["n_known"] == sum(c[w] > 0 for w in t)
        want = [prob(1, (u, v), w) if k else prob(0, v, w) for k, (u, v, w) in enumerate(contexts[d])]
        assert got[d]["score"] == pytest.approx(sum(map(math.log10, want)))
        assert got[d]["base_score"] == pytest.approx(sum(math.log10(uni(w)) for w in t))


def test_katz_order_is_by_part_context_and_place():
    rng = np.random.default_rng(3)
    for top in (3, 1 << 60):  # the larger ones do not fit one number
        part, context = rng.integers(0, top, 500) // 2 * 2, rng.integers(0, 40, 500)
        ids = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        assert (katz._order(part, context, ids) == np.lexsort((ids[context], part))).all()
    assert len(katz._order(part[:0], context[:0], ids)) == 0


def test_katz_without_training(spark, odd):
    got = katz.score(documents(spark, odd), F.lit(False)).collect()
    assert len(got) == len(odd) and all(r["score"] == 0 and r["train_tokens"] == 0 for r in got)
    assert katz.score(documents(spark, odd).limit(0), F.lit(True)).count() == 0


# -- the pipeline ---------------------------------------------------------------


def test_pipeline(spark, odd):
    import corpus_pipeline as cp

    rng = random.Random(10)
    base = [prose(rng, 60) + f" mail a.b{k}@site.example.org" for k in range(40)]
    docs = documents(spark, odd + base + base[:10], sources=[("x", "y", None)[k % 3] for k in range(len(odd) + 50)]).select(*cp.COLUMNS)
    at = docs
    for name, stage in cp.STAGES:
        out = common.stored(stage(spark, at, ""), "test")
        if name != cp.STAGES[-1][0]:
            assert out.columns == cp.COLUMNS
        if name == "near-duplicates":
            kept = [r["text"] for r in out.collect()]
            assert len(set(kept)) == len(kept)
        if name == "source mixing":
            assert out.where("text LIKE '%site.example%'").count() == 0
            n = sum(len(words(r["text"])) for r in at.collect())
            assert abs(sum(len(words(r["text"])) for r in out.collect()) - n) <= 0.02 * n + 4
        at = out
    assert at.count() > 0 and "ids_sha256" in at.columns
    assert cp.encode(spark, cp.mix(spark, docs.limit(0), ""), "").count() == 0


def test_pipeline_stages_give_the_drivers_memory_back(spark, monkeypatch):
    import corpus_pipeline

    assert "Trim native heap" in common.trim(spark)
    calls, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: calls.append(trim(s)))
    docs = documents(spark, [prose(random.Random(k), 40) for k in range(4)]).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = len(calls)
        stage(spark, docs, SF)
        assert len(calls) > before, name


def test_pipeline_stages_have_executors_collect_garbage(spark, monkeypatch):
    import corpus_pipeline

    # what the driver does itself is left out: on a local master the executor is its JVM
    monkeypatch.setattr(common, "release", lambda s: None)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = documents(spark, [prose(random.Random(k), 40) for k in range(4)]).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = full.getCollectionCount()
        stage(spark, docs, SF)
        assert full.getCollectionCount() > before, name


def test_surrogates_of_full_formats(spark):
    # three quarters of all addresses of one private range: most surrogates are entities
    ips = [f"192.168.{k >> 8}.{k & 255}" for k in range(3 << 14)]
    docs = documents(spark, [" ".join(ips[k : k + 512]) for k in range(0, len(ips), 512)])
    rows = surrogates.assign(docs, surrogates.Params(attempts=1)).collect()
    assert {r["entity"] for r in rows} == set(ips) and len({r["surrogate"] for r in rows}) == len(rows) == len(ips)
    assert all(r["surrogate"] != r["entity"] and r["surrogate"].startswith("192.168.") for r in rows)


def test_surrogates_get_longer():
    key = b"k"
    for kind, word in (("secret", "****"), ("given-f", "anna"), ("family", "李"), ("key", "AKIA" + "A" * 16), ("email", "_@x.org")):
        few = {surrogates.surrogate(key, kind, word, n) for n in range(4)}
        assert min(len(surrogates.surrogate(key, kind, word, n)) for n in (24, 39)) > max(map(len, few))


def longest_common_run(a, b):
    best = run = 0
    for x, y in zip(a, b, strict=True):
        run = run + 1 if x == y else 0
        best = max(best, run)
    return best


def test_surrogates_hide_all_of_a_long_entity():
    rng = random.Random(13)
    for n in (10, 80, 120, 200, 20_000):
        for kind in ("secret", "email"):
            x = "".join(rng.choices("abcdefghij0123456789", k=n)) + "@ab.example.org" * (kind == "email")
            y = surrogates.surrogate(b"k", kind, x)
            assert len(y) == len(x) and longest_common_run(x.partition("@")[0], y[: len(x.partition("@")[0])]) <= 5
            # one character more or less changes all others
            other = surrogates.surrogate(b"k", kind, ("b" if x[0] == "a" else "a") + x[1:])
            assert longest_common_run(y[:n], other[:n]) <= 5


def test_surrogates_of_all_scripts(spark):
    cases = [
        "password: Пароль! or пароль", "почта@домен.рф", "İnci@example.com", "IŞIK@ÖRNEK.com.tr", "Mr. 李明 met Mrs. 王芳", "Mr. محمد", "Dr. שלמה", "Frau Straße", "Mme Œuvre",
        "call +49 30 901820", "_@_.org", "ΣΑΣ@παράδειγμα.gr", "Dr. เอก", "secret=" + "é" * 30_000,
    ]
    docs = [(None, c) for c in cases] + [(k, c) for k, c in enumerate(cases)] + [(100, "password: ****** token=---- pwd=....")]
    wide = documents(spark, docs).withColumn("_own", F.lit(7)).withColumn("_row", F.lit(8))
    for p in (surrogates.Params(), surrogates.Params(exceptions=-1)):
        got = defaultdict(list)
        for r in surrogates.replace(wide, p).collect():
            got[r["doc_id"]].append(r)
            assert r["_own"] == 7 and r["_row"] == 8
        assert len(got[None]) == len(cases) and got[100][0]["n_entities"] == 0 and got[100][0]["text"].startswith("password: ******")
        for k, case in enumerate(cases):
            out = got[k][0]["text"]
            assert out in [r["text"] for r in got[None]]  # equal entities, equal surrogates
            entity = surrogates.detect(case)[0]
            assert got[k][0]["n_entities"] >= 1 and case[entity.start : entity.end] not in out
            if entity.kind == "secret":
                assert longest_common_run(case[entity.start : entity.end], out[entity.start : entity.start + entity.end - entity.start]) <= 3
    assert "@" in got[2][0]["text"] and surrogates.script(surrogates.detect(got[4][0]["text"])[0].canonical) == "CJK"


def test_surrogates_of_one_person_agree():
    key = b"k"
    for word in ("李", "김", "иванов", "שלמה", "anna"):
        assert surrogates.surrogate(key, "family", word) == surrogates.surrogate(key, "family", word)
        assert surrogates.script(surrogates.surrogate(key, "family", word)) == surrogates.script(word)
    assert len({surrogates.coded(key, "t", f"{a}{b}") for a in "0123456789" for b in "абвгд"}) == 50
