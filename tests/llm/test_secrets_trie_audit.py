"""Secret scans, the prefix trie and the filter audit against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import crf_secrets, euler_tour, filter_audit, prefix_trie
from textmill.llm.queries import QUERIES

HEX = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"


# ---- secrets ----


def plain_spans(text):
    """The three patterns as the contract words them."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(
        (
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        )
    ):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


SECRETS = [
    None,
    "",
    " \n ",
    f'é the Token = "{HEX}" and {HEX}',
    "secret=token:abcdefgh password : 'short' passwd='longer1'",
    "api_key=" + "A" * 5 + " APIKEY:'b64+/_.=-value' ſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "Q" * 16 + " AKIAshort AKIA" + "7" * 15 + " xAKIA" + "Z" * 30,
    "漢字 " + "0123456789abcdef" * 2 + "漢" + "f" * 23 + "g" + "e" * 24,
    "secret" + " " * 5000 + "x",
    "token" * 2000 + "=" + HEX,
    ("plain words " * 3000) + HEX + (" and more" * 3000),
]


def as_table(texts):
    blobs = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])


def test_base_spans():
    data, at = as_table(SECRETS)
    found = crf_secrets.secrets_in(crf_secrets.Field(), data, at)
    got = [[f"{k}:{s}:{e}" for k, s, e in spans] for spans in found]
    assert got == [plain_spans(t) for t in SECRETS]
    assert sum(map(len, got)) > 8


def brute_best(emit, step):
    """Best score of any tags, each text between two outside tags."""
    def score(tags):
        path = [0, *tags, 0]
        return sum(emit[i][t] for i, t in enumerate(tags)) + sum(step[a][b] for a, b in zip(path, path[1:]))

    return max(map(score, itertools.product(range(3), repeat=len(emit)))), score


@pytest.mark.parametrize("shift", [0.0, 2.0, 8.0])
def test_decoding_equals_trying_all_tags(shift):
    rng = np.random.default_rng(int(shift))
    for _ in range(60):
        sizes = rng.integers(1, 6, 4)
        emit = rng.normal(0, 2, (sizes.sum(), 3))
        emit[:, 0] += shift
        step = rng.normal(0, 2, (3, 3))
        row = np.repeat(np.arange(4), sizes)
        tags = crf_secrets.decode(emit, step, row)
        for r in range(4):
            best, score = brute_best(emit[row == r], step)
            assert abs(score(tags[row == r].tolist()) - best) < 1e-6


def test_expected_counts_equal_sums_over_all_tags():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 1, 4])
    starts, emit, step = np.array([0, 3, 4]), rng.normal(0, 1, (8, 3)), rng.normal(0, 1, (3, 3))
    order = np.argsort(-sizes, kind="stable")
    lives = [int((sizes > t).sum()) for t in range(4)]
    chance, steps = crf_secrets._expected(emit, step, starts[order], sizes[order], lives)
    want, want_steps = np.zeros((8, 3)), np.zeros((3, 3))
    for s, n in zip(starts, sizes):
        _, score = brute_best(emit[s : s + n], step)
        paths = list(itertools.product(range(3), repeat=int(n)))
        weights = np.exp([score(p) for p in paths])
        for p, w in zip(paths, weights / weights.sum()):
            for i, t in enumerate(p):
                want[s + i, t] += w
            for a, b in zip([0, *p], [*p, 0]):
                want_steps[a, b] += w
    assert np.allclose(chance, want) and np.allclose(steps, want_steps)


def secret_docs(spark):
    rng = random.Random(3)
    words = "the of and river house under many light seven walk table green".split()
    rows = []
    for i in range(400):
        body = " ".join(rng.choices(words, k=60)).split()
        if i % 4 == 0:
            body.insert(rng.randrange(60), f'token = "{rng.getrandbits(160):040x}"')
        if i % 7 == 0:
            body.insert(rng.randrange(60), f"{rng.randrange(10**15, 10**16)} {rng.randrange(256)}.{rng.randrange(256)}.0.1")
        rows.append((i, " ".join(body)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_field_finds_secrets_that_no_pattern_matches(spark):
    model = crf_secrets.train(secret_docs(spark), windows=200)
    upper = HEX.upper()
    texts = [f"the river {upper} under many", f'walk token is "{upper}" green', "the 4365873117289653 of 10.20.30.40 house"]
    found = crf_secrets.secrets_in(model, *as_table(texts))
    assert found[0] == [("crf", 10, 50)]
    assert found[1] == [("crf", 15, 55)]
    assert found[2] == []


def test_secrets_query_equals_the_patterns(spark, sf, documents):
    rows = QUERIES["op11_secret_scan"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("crf")] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds[k] for k in ("assign", "access", "hex")]
        places = [int(x.split(":")[1]) for x in spans]
        assert places == sorted(places)


def test_secrets_on_edges(spark, edges_null_id, nothing):
    model = crf_secrets.train(edges_null_id, windows=50)
    found = crf_secrets.find_secrets(edges_null_id, model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in edges_null_id.collect())
    empty = crf_secrets.train(nothing)
    assert not empty.emit.any()
    assert crf_secrets.find_secrets(nothing, empty).collect() == []


def test_samples_are_bounded_and_do_not_depend_on_the_layout(spark):
    docs = secret_docs(spark)
    models = [crf_secrets.train(docs.repartition(n), windows=20) for n in (1, 5)]
    assert np.array_equal(models[0].emit, models[1].emit)


# ---- prefix trie ----


def plain_trie(rows, group=100, shared=6):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode())
            turns[conv].append((turn is not None, turn or 0, tie.hexdigest(), (role, text)))
    plain = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (c % group if c >= 0 else -(-c % group))
        rebuilt[c] = tuple(plain.get(base, [])[:h] + plain[c][h:])
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        own = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        parts = [below(x) for x in children[p]]
        return (sum(x[0] for x in parts) if parts else 1, own + sum(x[1] for x in parts))

    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(p), parent, len(members), len(children[p]), *below(p), sha))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, id long, depth string"


def conversations(seed, n=300, convs=260):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(-250, convs), 0, 100])
        for turn in range(rng.randrange(0, 5)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice("ab"), 7, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, seed):
    rows = conversations(seed) + [(None, 1, "user", "lost", 1, "x"), (5, 0, "user", "é漢" * 1000, 1, "x")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_many_equal_conversations_and_one_long(spark, monkeypatch):
    """A third of all turns in one conversation, many equal conversations, small blocks everywhere."""
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [(c, t, "user", "ab"[t % 2], 0, "x") for c in range(100, 160) for t in range(3)]
    rows += [(200, t, "user", "ab"[t % 2], 0, "x") for t in range(90)]
    df = spark.createDataFrame(rows, TURNS)
    turns, convs = prefix_trie.rebuilt_turns(df)
    whole = prefix_trie.prefix_trie(turns, convs)
    assert sorted(map(tuple, whole.collect()), key=repr) == plain_trie(rows)
    a = prefix_trie.prefixes(turns).select("conv_id", "depth", "k1", "k2", "p1").collect()
    b = prefix_trie.prefixes(turns, block_bits=2).select("conv_id", "depth", "k1", "k2", "p1").collect()
    assert sorted(a) == sorted(b)


def test_trie_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(none).collect() == []
    lone = [(7, None, None, None, 1, "x"), (7, None, None, None, 1, "x")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(lone, TURNS))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(lone)


@pytest.mark.parametrize("bits,small", [(3, 4), (3, 10**6), (20, 4), (0, 0)])
def test_list_ranks(spark, bits, small):
    order = list(range(500))
    random.Random(bits).shuffle(order)
    after = dict(zip(order, [*order[1:], None]))
    links = spark.createDataFrame(list(after.items()), "id long, next long")
    got = dict(map(tuple, euler_tour.list_ranks(links, bits, small).collect()))
    assert got == {v: i for i, v in enumerate(order)}


def test_prefix_sums(spark):
    rows = [(i, i % 7, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "pos long, a long, b long")
    got = sorted(map(tuple, euler_tour.prefix_sums(df, "pos", ["a", "b"], block_bits=4, most=8).collect()))
    assert got == [(i, sum(x % 7 for x in range(i)), i) for i in range(1000)]


# ---- filter audit ----


def plain_audit(docs, labels):
    good, toxic = Counter(), Counter()
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        rows.append((source or "", {f for f, x in bits.items() if x}, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in own)
                out.append(
                    [part, "".join(order), step, f, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own)]
                    + [sum(r[2] for r in gone), sum(r[3] for r in gone)]
                )
    totals = Counter()
    for r in out:
        totals[r[0], r[3]] += r[5]
    return sorted((*r, totals[r[0], r[3]]) for r in out)


def audit_of(spark, docs, labels):
    got = filter_audit.filter_audit(
        spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("n", F.lit(3)),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1)),
    )
    return sorted(map(tuple, got.collect()))


def audit_docs():
    rng = random.Random(9)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", " \t", long, long + " #", "A" + long[1:], "go " * 300, "AB CD " * 150 + "|", "\x0bone\x0c" + long, "é漢 " + long]
    docs = [(rng.randrange(60), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(120)]
    return docs + [(None, long, "a"), (None, long, "b"), (3, long, "a"), (3, long, "a")]


def test_audit_equals_plain_python(spark):
    labels = [(i, i % 2, i % 3 - 1) for i in range(0, 60, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    assert audit_of(spark, audit_docs(), labels) == plain_audit(audit_docs(), labels)


def test_audit_of_many_copies(spark, monkeypatch):
    """Copies in many slices, and equal hashes of different texts."""
    monkeypatch.setattr(filter_audit, "SLICE_ROWS", 4)
    monkeypatch.setattr(filter_audit, "SALTS", 2)
    docs = [(i, "same text", "a") for i in range(100)] + [(i, f"other {i}", "b") for i in range(100, 120)]
    assert audit_of(spark, docs, []) == plain_audit(docs, [])
    poor = lambda text: [F.lit(1).cast("long").alias("_k1"), (F.length(text) % 2).cast("long").alias("_k2")]
    monkeypatch.setattr(filter_audit, "_keys", poor)
    plain = spark.createDataFrame(docs + [(7, "other 7", "b"), (1, "other 101", "b")], "id long, text string, part string")
    found = filter_audit.later_copies(plain, filter_audit.failures(plain))
    assert sorted(r["id"] for r in found.collect()) == [*range(1, 100), 101]


def test_audit_edges(spark, nothing):
    assert audit_of(spark, [], []) == []
    one = audit_of(spark, [(1, None, None)], [])
    assert len(one) == 600 and {r[0] for r in one} == {""}


def test_audit_plan_has_no_python_and_no_cross_join(spark, sf):
    plan = QUERIES["op13_filter_audit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "MapIn", "CartesianProduct", "NestedLoop"))
