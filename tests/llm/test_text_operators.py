"""Operators on documents against brute force, on a small table and on edge cases."""

import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from textmill.llm import best_fit, bytesops, katz, keyed, ngram_join, quality_rules, repeats
from textmill.staging import stage

from .conftest import texts_of

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(params=["documents", "edges"])
def docs(request):
    return request.getfixturevalue(request.param)


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if often[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs):
    found = quality_rules.rule_verdicts(docs).collect()
    exp = sorted((i, *counts_of(t)) for i, t in texts_of(docs))
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found)
    assert got == exp
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] in ((False,) if r["base_failed"] else (True, False))


def test_many_repeated_windows(spark):
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words + words[:200])
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert quality_rules.rule_verdicts(df).first()["n_repeat_words"] == counts_of(text)[4] == 400


def test_bad_host_is_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "x" if i % 10 else good, "bad") for i in range(400)]
    rows += [(1000 + i, good if i % 20 else "x", f"host{i % 8}") for i in range(400)] + [(5000, good, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.rule_verdicts(df).collect()}
    assert not any(got[i]["kept"] for i in range(400))
    assert all(got[1000 + i]["kept"] == bool(i % 20) for i in range(400))
    assert 0 < got[5000]["host_rate"] < 0.6  # shrunk towards all hosts


def shingle_set(text, gram=5):
    w = lowered(text)
    return {tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)} if len(w) >= gram else ({tuple(w)} if w else set())


def components_of(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingle_set(t)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(docs):
    exp = components_of(texts_of(docs))
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == exp[r["doc_id"]] for r in got)


def test_ngram_join_chain_and_stars(spark):
    """Copies of one text that differ from each other too much to be linked except through it."""
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 25):
        w = list(base)
        for p in range(6):  # an edit costs five shingles: 30 of 396, then 60 between two copies
            w[(k * 16 + p * 61) % 396 + 2] = f"e{k}_{p}"
        rows.append((k, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(100 + k, " ".join(chain[k * 8 : k * 8 + 120])) for k in range(8)]
    rows += [(200 + k, " ".join(base[:60] + [f"o{k}_{i}" for i in range(300)])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exp = components_of(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    assert got == exp
    for rounds in (0, 1):
        matrix = stage(ngram_join.incidence(df), "m").where("grams is not null")
        labels = ngram_join.linked_rows(matrix.select(F.col("doc_id").alias("id"), "n", "block", "grams"), star_rounds=rounds)
        assert all(exp[r["id"]][1] == r["component"] for r in labels.collect())


def removed(rows, length=200):
    seen = collections.Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(docs):
    rows = [(i, (t or "").encode()[:40000]) for i, t in texts_of(docs)]
    cut = docs.withColumn("text", F.substring("text", 1, 100000))
    if any(len(t or "") > 40000 for _, t in texts_of(docs)):  # brute force on shorter texts
        cut = docs.withColumn("text", F.expr("left(text, 20000)"))
        rows = [(i, (t or "")[:20000].encode()) for i, t in texts_of(docs)]
    got = repeats.without_repeats(cut)
    assert set(docs.columns) <= set(got.columns)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == removed(rows)


def test_repeats_keep_text_and_columns(spark):
    shared = " ".join(f"s{i}" for i in range(80))
    own = [" ".join(f"d{k}_{i}" for i in range(60)) for k in range(4)]
    rows = [(k, f"é{own[k]} |{k}|{shared}|{k}| {own[k][::-1]}" if k < 3 else own[k], f"m{k}") for k in range(4)]
    got = {r["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()}
    for k in range(4):
        assert got[k]["mark"] == f"m{k}" and own[k] in got[k]["text"] and (k == 3 or "s40" not in got[k]["text"])
    period = spark.createDataFrame([(1, "ab" * 300), (2, "q" * 199), (3, "x" * 201)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in repeats.without_repeats(period).collect()) == [(1, 600), (2, 0), (3, 201)]


def katz_of(rows, held):
    seqs = [(i, [*lowered(t), None], h) for (i, t), h in zip(rows, held)]
    words, pairs = collections.Counter(), collections.Counter()
    for _, s, h in seqs:
        if not h:
            words.update(s)
            pairs.update(zip([None, *s], s))
    n, v = sum(words.values()), len(words)

    def factors(counts):
        often = collections.Counter(counts.values())
        return katz.discounts([often[r] for r in range(1, katz.DISCOUNTED + 2)])

    dw, dp = factors(words), factors(pairs)
    star = lambda c, d: c * (d[c - 1] if c <= katz.DISCOUNTED else 1)
    p = {w: star(c, dw) / (n + 0.5) for w, c in words.items()}
    unknown = 1 - sum(p.values())
    over, mass = collections.Counter(), collections.Counter()
    for (h, w), c in pairs.items():
        over[h] += star(c, dp)
        mass[h] += p[w]

    def back(h):
        return (1 - over[h] / (words[h] + 0.5)) / (1 - mass[h]) if words[h] else 1.0

    def chance(h, w):
        c = pairs[h, w]
        return star(c, dp) / (words[h] + 0.5) if c else back(h) * p.get(w, unknown)

    for h in list(words)[:10]:
        assert abs(sum(chance(h, w) for w in words) + back(h) * unknown - 1) < 1e-9
    return [
        (i, h, len(s), sum(w in words for w in s), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in s),
         sum(math.log10(chance(a, w)) for a, w in zip([None, *s], s)))
        for i, s, h in seqs
    ]


def test_katz(docs):
    held = F.pmod(F.col("doc_id"), F.lit(4)) == 1
    rows = texts_of(docs)
    exp = sorted(katz_of(rows, [i % 4 == 1 for i, _ in rows]), key=lambda r: (r[0], r[2]))
    got = sorted((tuple(r) for r in katz.katz_scores(docs, held).collect()), key=lambda r: (r[0], r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in exp]
    for a, b in zip(got, exp):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_katz_without_training_rows(edges):
    got = katz.katz_scores(edges, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in got)


def test_packing(docs):
    got = best_fit.pack_documents(docs, capacity=100, group_bins=16).collect()
    of = {r["doc_id"]: (r["source"], r["text"] or "") for r in docs.collect()}
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    many = collections.Counter(i for i, _ in texts_of(docs))
    assert total == {i: many[i] * len(WORD.findall(t)) for i, (_, t) in of.items()}
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        ends = [r["bin_offset"] + r["n_tokens"] for r in rows]
        assert [r["bin_offset"] for r in rows] == [0, *ends[:-1]] and ends[-1] <= 100
        sources = [of[r["doc_id"]][0] for r in rows if of[r["doc_id"]][0] is not None]
        assert len(sources) == len(set(sources)) and len({of[r["doc_id"]][1] for r in rows}) == len(rows)


def test_pack_takes_the_tightest_compatible_bin():
    items = [(60, "a", 1), (50, "b", 2), (40, "a", 3), (40, "c", 2), (40, "d", 9), (10, "e", 1)]
    # 40/a conflicts with the bin of 60/a, 40/c with that of 50/b by cluster, 40/d fits 60/a exactly.
    placed = best_fit.pack(items, 100)
    naive, bins = [], []
    for length, s, c in items:
        fits = [(100 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + length <= 100 and s not in [x[1] for x in b] and c not in [x[2] for x in b]]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        naive.append((k, sum(x[0] for x in bins[k])))
        bins[k].append((length, s, c))
    assert placed == naive


def test_empty_tables(nothing):
    assert quality_rules.rule_verdicts(nothing).count() == 0
    assert ngram_join.ngram_components(nothing).count() == 0
    assert repeats.without_repeats(nothing).count() == 0
    assert katz.katz_scores(nothing, F.lit(False)).count() == 0
    assert best_fit.pack_documents(nothing).count() == 0


def test_null_ids_do_not_crash(edges_null_id):
    n = edges_null_id.count()
    assert quality_rules.rule_verdicts(edges_null_id).count() == n
    assert ngram_join.ngram_components(edges_null_id).count() == n
    assert repeats.without_repeats(edges_null_id).count() == n
    assert katz.katz_scores(edges_null_id, F.lit(False)).count() == n
    assert best_fit.pack_documents(edges_null_id, capacity=100000).count() == n


def test_frames_that_are_no_scan_are_written_first(spark, documents):
    moved = documents.repartition(3).where("doc_id % 2 = 0")
    assert keyed.by_split(moved).select(keyed.SPLIT).distinct().count() > 1
    assert ngram_join.ngram_components(moved).count() == moved.count()


def test_rolling_hash_depends_on_bytes_only():
    import numpy as np

    data = np.frombuffer(b"xxabcabcabc yabc", dtype=np.uint8)
    h = bytesops.Rolling(data)
    starts = np.array([2, 5, 8, 13, 0])
    found = h.ranges(starts, starts + 3)
    assert len(set(found[:4].tolist())) == 1 and found[4] != found[0]
