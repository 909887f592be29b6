from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import chat, components, decontam, linededup, mixing, pii, quality, sharding, simhash, storage, substring, topk

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ("n_words", "size", "fp", "key", "starts", "_id", "first", "shard", "h1", "w", "bucket", "rate", "spans", "base", "slot", "kept", "row", "place", "_fw_row", "_fw_cell", "_fw_h1")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared lines and passages, nulls, empties, a very long text, repeated rows."""
    rng = random.Random(seed)
    line = "The quick brown fox jumps over the lazy dog, again and again."
    passage = prose(rng, 60)
    base = prose(rng, 120)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += [base] * 6 + [base + f" tail{k}" for k in range(4)] + [prose(rng, 25) + " " + passage + " " + prose(rng, 5) for _ in range(8)]
    texts += [f"{prose(rng, 9)}\n  {line.upper()}\t\n{prose(rng, 12)}\n{line}" for _ in range(7)]
    texts += ["", " \n\t ", "one", "one two", None, None, "Ünïcödé ß 漢字 words\nand\n\nlines", prose(rng, 9) + " " + prose(rng, 40) * 2]
    texts += [" ".join(["same"] * 70), prose(rng, 30_000, 50_000), "x" * 50_000, "1" * 30_000 + " " + "1.1." * 9_000 + "a." * 20_000 + "@" + "a.b" * 10_000]
    rows = [(3 * k + 1, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "b", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "nameless text of its own", "en", "b", 24)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOC)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def same(df, want):
    assert Counter(map(tuple, df.collect())) == Counter(map(tuple, want))


# --- 1 chat ---------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi</s>"), (1, 2, "user", "and <s\\> [/ROLE\\\\] more"), (1, 3, "assistant", "a"), (1, 4, "assistant", None), (1, 5, "user", ""),
    (2, 0, "assistant", "only ä漢"), (2, 0, "assistant", "only ä漢"), (3, None, None, "no role"), (3, 1, "[ROLE]x</s>", "odd role [SEP]"), (None, 0, "user", "lost"),
]


def test_chat_round_trip(spark):
    long = [(9, k, ("user", "assistant")[k // 3 % 2], f"turn {k} [SEP]") for k in range(900)]
    df = spark.createDataFrame(TURNS + long, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    made = chat.format_chats(df)
    got = {r[0]: r for r in made.select("conv_id", "formatted", "pieces", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, t, r, x in sorted(TURNS + long, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [tuple(t) for t in r.t] for c, r in got.items()} == want
    for c, r in got.items():
        assert "".join(p.text for p in r.pieces) == r.formatted
        assert r.formatted.count("<s>") == 1 + sum(a[0] != b[0] for a, b in zip(want[c], want[c][1:]))
    for r in chat.digest(made).collect():
        told, learnt = want[r.conv_id], "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(told), len(learnt), brute.sha(learnt))
        assert r.turns_sha256 == brute.sha("".join(f"{a}\n{b}\n" for a, b in told))
        assert r.formatted_chars == len(got[r.conv_id].formatted)


def test_chat_empty(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# --- 2 lines --------------------------------------------------------------------------------------


def test_lines(docs, rows):
    want = brute.lines(pairs(rows))
    assert any(x[2] for x in want)
    same(linededup.dedup_lines(docs), want)
    same(linededup.dedup_lines(docs, digest=True), [(*x[:3], brute.sha(x[3])) for x in want])


def test_hot_lines_take_the_shared_index(docs, rows, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 1)
    monkeypatch.setattr(linededup, "SHARD_PROBES", 20)
    same(linededup.dedup_lines(docs, min_chars=2, min_docs=2), brute.lines(pairs(rows), 2, 2))


def test_very_hot_lines(spark):
    rows = [(k, "a line that every one of the documents here holds\n" + f"own {k % 7}") for k in range(2500)]
    same(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), brute.lines(rows))


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h1, h2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    index = linededup.Index(linededup.build_index(h1[:4000], h2[:4000], np.arange(4000), np.arange(4000) * 2))
    slot = index.probe(h1, h2)
    assert sorted(slot[:4000]) == list(range(4000)) and (slot[4000:] == -1).all()
    assert (index.counts[slot[:4000]] == np.arange(4000)).all()
    assert (linededup.Index(linededup.build_index(h1[:0], h2[:0], np.arange(0), np.arange(0))).probe(h1, h2) == -1).all()


def test_lines_empty(none):
    assert linededup.dedup_lines(none).count() == 0


# --- 3 simhash ------------------------------------------------------------------------------------


def test_near_groups(docs, rows):
    want = brute.groups(pairs(rows))
    assert len({x[2] for x in want}) < len(want) - 8
    same(simhash.digest(simhash.near_groups(docs)), want)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_long_texts_are_taken_in_pieces(monkeypatch, size):
    monkeypatch.setattr(simhash, "PIECE", size)
    for t in ["", " ", "one", "one two", "a b c", "A  b\tc d " * 20, "x" * 300 + " y z", " lead " + prose(random.Random(1), 80) + "\n\n", prose(random.Random(2), 700)]:
        for width in (1, 3, 5):
            assert simhash.fingerprint(t.encode(), width) == brute.simhash(t, width)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:150]:
        prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    hub = rng.getrandbits(64)  # one large bucket
    prints += [hub ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 4))) for _ in range(400)]
    prints = sorted(set(prints))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    links = simhash.near_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in links)
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    adjacent = {p: [q for q in prints if q != p and (p ^ q).bit_count() <= 3] for p in prints}
    left = set(prints)
    while left:
        group, front = set(), [left.pop()]
        while front:
            x = front.pop()
            group.add(x)
            front += [y for y in adjacent[x] if y not in group]
        left -= group
        least = min(map(signed, group))
        assert all(roots.get(signed(x), signed(x)) == least for x in group)


def test_components(spark):
    chain = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 600)] + [(7, 7), (None, 3), (3, None), (5, 6)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(101)} | {k: 500 for k in range(500, 600)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, rows):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    named = {g for i, _, g in brute.groups(pairs(rows)) if g is not None}
    assert sorted(k for k in kept if k is not None) == sorted(named) and kept.count(None) == 1
    assert simhash.keep_one(docs).columns == docs.columns


def test_keep_one_tells_rows_apart_by_their_text(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(None, a), (None, a), (4, a), (None, b), (None, b), (7, c), (7, prose(rng, 70)), (7, c), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(4, a), (None, b), (7, c), rows[6]])
    for parts in (1, 5):
        assert Counter(map(tuple, simhash.keep_one(df.repartition(parts)).collect())) == want
    marked = spark.createDataFrame([(5, b, k) for k in range(40)], "doc_id long, text string, n long")
    assert len({simhash.keep_one(marked.repartition(p)).first().n for p in (1, 3, 7)}) == 1


def test_large_buckets_are_split_without_losing_links(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 80)
    monkeypatch.setattr(simhash, "FEW_BITS", 5)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**32, 60, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, (3000, 3)).astype(np.uint64), axis=1)
    run = np.unique(np.r_[centres[rng.integers(0, 60, 3000)] ^ flips, rng.integers(0, 2**12, 700, dtype=np.uint64)])
    diff = (run[:, None] ^ run[None, :]).ravel()
    near = np.zeros(diff.size, bool)
    near[simhash.chains_hold(diff, 4)] = True
    near = near.reshape(run.size, run.size)
    assert near.sum() < (np.bitwise_count(diff) <= 3).sum()

    def roots(a, b):
        root = np.arange(run.size)
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            if (new == root).all():
                return root
            root = new

    left, right = (np.concatenate(x) for x in simhash._refined(run, 4, 3))
    assert (np.bitwise_count(left ^ right) <= 3).all()
    want = roots(*np.nonzero(near))
    assert 10 < np.unique(want).size < run.size
    assert (roots(np.searchsorted(run, left), np.searchsorted(run, right)) == want).all()


def test_chains_hold_their_budgets_from_some_start():
    rng = random.Random(8)
    diffs = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(3000)], np.uint64)
    some = np.zeros(diffs.size, bool)
    for start in range(8):
        bits = [np.bitwise_count((diffs >> np.uint64(8 * ((start + j) % 8))) & np.uint64(255)).astype(int) for j in range(8)]
        want = np.all([np.sum(bits[:n], axis=0) <= 3 * n // 8 for n in range(1, 9)], axis=0)
        assert (simhash.chains_hold(diffs, start) == np.flatnonzero(want)).all()
        assert (simhash.chains_hold(diffs, np.full(diffs.size, start)) == np.flatnonzero(want)).all()
        some |= want
    assert (some == (np.bitwise_count(diffs) <= 3)).all()


def test_simhash_empty(none):
    assert simhash.near_groups(none).count() == 0
    with pytest.raises(ValueError):
        simhash.near_links(none.selectExpr("doc_id as fp"), distance=4)


# --- 4 personal data ------------------------------------------------------------------------------

ODD = [
    "a@b.c_x@d.e", "..%+@h.i. x@y", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3.x", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (269) 555-3296 4524132264652876",
    "+49 30 1234567-", "++1 23 456 78 90", "4524132264652876", "5 4111111111111111", "äö 漢 x.y@z.com 漢 10.0.0.1", "12  4111111111111111 3", "+1 2", "a@@b.c", "1" * 19, "0" * 16,
]


def test_base_spans(spark, docs, rows):
    more = [(9000 + k, t) for k, t in enumerate(ODD)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = [(i, *(sum(s[0] == k for s in brute.spans(t)) for k in pii.KINDS), brute.sha(",".join("%s:%d:%d" % s for s in brute.spans(t)))) for i, t in pairs(rows) + more]
    found = pii.digest(pii.find_personal_data(df))
    same(found.drop("spans", "n_spans"), want)
    assert not found.filter("n_spans < n_email + n_ip + n_card + n_phone").count()


def test_labels_discover_unseen_identifiers(spark):
    known = [(k, f"call tel: +1 (555) 010-00{k:02d} now") for k in range(12)]
    unseen = [(50, "call tel: 555.0199x now"), (51, "note: 555.0199x"), (52, "tel: soon")]
    noise = [(60 + k, f"note: word{k} then") for k in range(30)]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(known + unseen + noise, "doc_id long, text string"))).collect()}
    assert got[50].spans == "phone:10:19" and got[50].n_phone == 0 and got[50].base_sha256 == brute.sha("")
    assert got[51].spans == "" and got[52].spans == "" and all(got[i].spans == "" for i, _ in noise)
    assert all(got[i].spans.startswith("phone:10:") for i, _ in known)


def test_discovered_values_have_the_shapes_of_seeds(spark):
    long = "9" * 200
    known = [(k, f"tel: +1 (555) 010-00{k:02d} now") for k in range(12)] + [(20 + k, f"card: 4111 1111 1111 1111 and mail= a{k}@b.c") for k in range(4)]
    known += [(30 + k, f"card: {n}") for k, n in enumerate(("4524132264652876", "9807915762804490", "4845168114407329"))]
    unseen = {
        50: ("tel: (017) 555-7713 x", "phone:5:19"), 51: ("tel: 030 1234567, then", "phone:5:16"), 52: ("tel: 01234 567890", "phone:5:17"),
        53: ("card: 9807 9157 6280 4491 2x", "card:6:25"), 54: (f"card: {long}", "card:6:206"), 55: ("tel: 112", "phone:5:8"),
        56: ("tel: 030 1234567 10.0.0.1", "ip:17:25,phone:5:16"), 57: ("tel: 030 1234567 2024 2025 now", "phone:5:21"), 58: ("mail= x1 2 3", "email:6:8"),
        59: ("tel: 030 - 1234567 or so", "phone:5:18"), 60: ("tel: none given", ""),
    }
    rows = known + [(i, t) for i, (t, _) in unseen.items()]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), min_confidence=0.2)).collect()}
    assert {i: got[i] for i in unseen} == {i: want for i, (_, want) in unseen.items()}


def test_words_before_seeds_discover_unseen_identifiers(spark):
    known = [(k, f"é so\nplease reach me\u00df at +1 (555) 010-00{k:02d} now") for k in range(12)]
    unseen = [(50, "é tell 10.0.0.1 and Reach me\u00df  at (017) 555-7713."), (None, "meß at\n030 1234567 now"), (52, "look at (017) 555-7713"), (53, "meß at")]
    noise = [(60 + k, f"look at word{k} then at home{k}") for k in range(30)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(spark.createDataFrame(known + unseen + noise, "doc_id long, text string"))).collect()}
    assert got[50] == "ip:7:15,phone:34:48" and got[None] == "phone:7:18"
    assert got[52] == got[53] == "" and all(got[i] == "" for i, _ in noise)
    assert all(got[i].startswith("phone:") and "," not in got[i] for i, _ in known)


def test_discovered_values_vouch_for_further_patterns(spark):
    rows = [(k, f"tel: +1 (555) 010-00{k:02d}.") for k in range(12)] + [(20 + k, f"tel: 030 55500{k:02d}.") for k in range(3)]
    rows += [(30 + k, f"cell: 030 55500{k:02d}.") for k in range(3)] + [(40, "cell: 040 7654321."), (41, "fax: 040 7654321.")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), min_confidence=0.6)).collect()}
    assert got[40] == "phone:6:17" and got[41] == "" and all(got[30 + k] == "phone:6:17" for k in range(3))


def test_words_after_seeds_discover_unseen_identifiers(spark):
    rows = [(k, f"{k}? a{k}@b.c, wrote back and left") for k in range(8)] + [(50, "so ann(at)b2.c wrote"), (51, "the 2 wrotes"), (52, "and wrote")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), min_confidence=0.7)).collect()}
    assert got[50] == "email:3:14" and got[51] == got[52] == "" and all(got[k] == f"email:3:9" for k in range(8))


def test_pattern_scores_equal_those_of_a_plain_graph(spark):
    rng = random.Random(6)
    phone = [f"+1 (555) 010-{k:04d}" for k in range(30)]
    other = [f"x{k}y" for k in range(40)]
    told = [(rng.choice("abcdef") * 2, rng.choice(phone + other)) for _ in range(300)] + [("zz", "word")] * 3 + [("zz", v) for v in phone[:12]]
    rows = [(k, f"{p}: {v}.") for k, (p, v) in enumerate(told)]
    got = {(r.pattern, r.kind): (r.confidence, r.mass) for r in pii.pattern_confidence(spark.createDataFrame(rows, "doc_id long, text string"), min_confidence=0.5).collect()}
    edges = {p: {v for q, v in told if q == p and v != "word"} for p, _ in told}
    total = {p: len(v) + 3 * (p == "zz") for p, v in edges.items()}
    score = {v: 1.0 for v in phone}
    for _ in range(pii.ROUNDS):
        mass = {p: sum(score.get(v, 0.0) for v in held) for p, held in edges.items()}
        sure = {p: m / total[p] for p, m in mass.items()}
        score = {v: 1.0 if v in phone else 1 - np.prod([1 - c for p, c in sure.items() if v in edges[p]]) for v in phone + other}
    assert {k: pytest.approx(x, abs=1e-5) for k, x in got.items()} == {(p + ":", "phone"): (sure[p], mass[p]) for p in edges}


def test_many_matches_in_one_text(spark):
    text = " ".join(f"w{k} 10.0.{k % 256}.{k % 199}" for k in range(40_000))
    runs = " ".join(f"7{x * 40_000}y" for x in (".", ")", "(", "()", "-", "1", "a", "@", "+1", " 1", "a:", "1."))
    began = time.perf_counter()
    got = pii.digest(pii.find_personal_data(spark.createDataFrame([(1, text), (2, text[:100]), (3, runs)], "doc_id long, text string"))).collect()
    assert time.perf_counter() - began < 60
    want = [s for s in brute.spans(text) if s[0] == "ip"]
    r = next(r for r in got if r.doc_id == 1)
    assert r.n_ip == len(want) == 40_000 and r.base_sha256 == brute.sha(",".join("%s:%d:%d" % s for s in brute.spans(text)))


def test_pii_empty(none):
    assert pii.digest(pii.find_personal_data(none)).count() == 0


# --- 5 top-k --------------------------------------------------------------------------------------


def vectors(n, dim, seed):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([0.0, -0.5, 0.25]) + rng.gauss(0, 0.3) * (k % 3) for _ in range(dim)]) for k in range(n)]
    rows += [(1000, None), (1020, [0.1, None]), (1040, [float("nan")] * dim), (1060, [float("inf")] * dim), (1080, []), (1100, [0.5]), (None, [1.0] * dim), rows[20], rows[40], rows[41], rows[41]]
    return rows


@pytest.mark.parametrize("block", [16, 4096])
def test_topk(spark, monkeypatch, block):
    for name, size in (("ROW_BLOCK", block), ("ROWS_PER_SHARD", 4 * block), ("QUERY_BLOCK", 3 * block // 16), ("QUERIES_PER_GROUP", block // 2)):
        monkeypatch.setattr(topk, name, size)
    rows = vectors(300, 40, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    same(topk.exact_topk(df.filter("vec_id % 20 = 0"), df), brute.topk(rows))


def test_topk_wide_values_and_few_rows(spark):
    rows = [(0, [1e15, 2.0]), (20, [3e14, -1.0]), (21, [-4e14, 9.5]), (22, [1e-3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.topk([(i, v) for i, v in rows])
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    got = {(r.query_id, r.vec_id): r.score for r in topk.exact_topk(df.filter("vec_id % 20 = 0"), df).collect()}
    assert got == {(q, i): clamp(s) for q, _, i, s in want}
    assert topk.exact_topk(df.filter("false"), df.filter("false")).count() == 0


# --- 6 sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 24])
def test_sharding(docs, rows, bucket_bytes):
    made = sharding.external_shuffle(docs, bucket_bytes=bucket_bytes)
    assert made.columns == [*("shard_in" if c == "shard" else "slot_in" if c == "slot" else c for c in docs.columns), "shard", "slot"]
    got = made.collect()
    assert {(r.shard_in, r.slot_in) for r in got} == {("clash", "clash")}
    assert Counter((r.doc_id, r.text) for r in got) == Counter(pairs(rows))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in sizes)
    again = sharding.external_shuffle(docs.repartition(5), bucket_bytes=bucket_bytes).collect()
    place = lambda rs: {(r.doc_id, r.text, r.shard, r.slot) for r in rs}
    assert place(got) == place(again)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id]
    assert order != sorted(order)


def test_sharding_digest(docs, rows, none, spark):
    got = sharding.digest(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(rows))
    assert sharding.digest(none).count() == 0
    for parts in (got, sharding.digest(docs, bucket_bytes=3000).collect()):
        sizes = Counter(r.shard for r in parts)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in parts} == {"rows"}
        assert sorted((r.shard, r.slot) for r in parts) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    few = sharding.external_shuffle(spark.range(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_sharding_carries_maps(spark):
    rows = [(k % 3, {"a": k % 2, "b": None}, [{1: (str(k % 2), {"x": k % 2})}] if k % 5 else None, k) for k in range(40)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "slot int, m map<string,int>, deep array<map<int,struct<s:string,t:map<string,int>>>>, slot_in int")
    made = sharding.external_shuffle(df, bucket_bytes=300)
    assert made.columns == ["slot_in_in", "m", "deep", "slot_in", "shard", "slot"] and made.schema["deep"].dataType.simpleString() == df.schema["deep"].dataType.simpleString()
    assert sorted(map(str, (tuple(r)[:4] for r in made.collect()))) == sorted(map(str, map(tuple, df.collect())))


def test_bucket_begins_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 5)
    sizes = [(b, (b * 7) % 4 + 1, 0) for b in range(0, 43, 2)]
    got = dict(map(tuple, sharding._begins(spark.createDataFrame(sizes, "bucket int, n long, size long")).collect()))
    assert got == {b: sum(n for c, n, _ in sizes if c < b) for b, *_ in sizes}


def test_sharding_scatters_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    rows = [(None, "a row that is here very often")] * 2000 + [(k, f"row {k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string")
    seen = []
    monkeypatch.setattr(sharding, "_counted", lambda t, f=sharding._counted: seen.append(f(t)) or seen[-1])
    got = sharding.external_shuffle(df, bucket_bytes=4000).collect()
    assert Counter((r.id, r.text) for r in got) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(8) for k in range(375)]
    before, after = (max(r["size"] for r in c.collect()) for c in seen)
    assert before > 100_000 > 10_000 > after
    again = sharding.external_shuffle(df.repartition(7), bucket_bytes=4000).collect()
    assert {(r.id, r.shard, r.slot) for r in got} == {(r.id, r.shard, r.slot) for r in again}


# --- 7 quality ------------------------------------------------------------------------------------


def labelled(n=900, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        kind = rng.choice(["good"] * 5 + ["low", "toxic"])
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnrst')}{rng.choice('aeiou')}" for _ in range(rng.randrange(20, 150))]
        if kind == "low":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "vileness"])
        rows.append((k, " ".join(words), rng.choice(["en", None]), rng.choice(["s1", "s2", None]), 0))
        labels.append((k, int(kind != "low"), int(kind == "toxic")))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled()
    df = spark.createDataFrame([*rows, (None, None, None, None, None), (5000, "", "en", "s1", 0)], DOC).withColumn("_id", F.lit(1))
    told = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    models = quality.fit(df.drop("_id"), told)
    got = {r.doc_id: r for r in quality.score(df, models).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    assert np.mean([got[i].keep == (q == 1 and t == 0) for i, q, t in held]) > 0.97
    assert len(got) == len(rows) + 2
    kept = quality.keep_good(df, models)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_quality_keeps_rare_positives(spark):
    rows, labels = labelled(2400)
    toxic = [i for i, _, t in labels if t][:30]
    chosen = {i for i, _, t in labels if not t} | set(toxic)
    told = spark.createDataFrame([x for x in labels if x[0] in chosen], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([r for r in rows if r[0] in chosen], DOC)
    models = quality.fit(df, told, n_labelled=400)
    assert models["toxic"] is not None and models["toxic"].shift < -1
    found = {r.doc_id for r in quality.score(df, models).filter("p_toxic >= 0.5").collect()}
    assert len(found & set(toxic)) > 20 and len(found - set(toxic)) < 5


class PlainPool:
    """The unlabelled documents as a list of (id, text, cell)."""

    def __init__(self, rows, n, seed=11):
        self.rows, self.n, self.seed = rows, n, seed

    def counts(self, models):
        out = {t: {} for t in models}
        for _, text, cell in self.rows:
            for t, m in models.items():
                p = 1 / (1 + np.exp(-(m.text_scale[0] * plain_logit(m, text) + m.text_scale[1])))
                for c, sure in enumerate((p <= min(0.05, 0.2 * m.base), p >= 0.95)):
                    out[t].setdefault(cell, np.zeros(2))[c] += bool(sure)
        return out

    def draw(self, models):
        out = {}
        for t, m in models.items():
            told = []
            for c, cells in enumerate(m.sure_cells()):
                mine = [(self.order[i], i, x) for i, x, cell in self.rows if cell in set(cells.tolist())]
                told += [(i, x, c) for _, i, x in sorted(mine)[: self.n]]
            if told:
                told.sort(key=lambda r: (r[0], r[2]))
                out[t] = quality.Sparse.of([self.names.row(quality.features(x.encode())) for _, x, _ in told]), np.array([c for *_, c in told], float)
        return out


def plain_logit(model, text):
    return model.text.bias + sum(model.text.by_feature.get(f, 0.0) for f in quality.features(text.encode()))


def test_quality_equals_a_plain_form(spark):
    rows, labels = labelled(700)
    rows = [(i, x, g, "bad" if q == 0 and i % 4 else "spam" if t and i % 3 else s, len(x)) for (i, x, g, s, _), (_, q, t) in zip(rows, labels)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    told = [x for x in labels if x[0] % 2]
    models = quality.fit(df, spark.createDataFrame(told, "doc_id long, quality int, toxic int"), n_pseudo=20, rounds=2)
    cells = {r.doc_id: (r.c, r.o) for r in df.select("doc_id", quality.cell(df).alias("c"), F.xxhash64(F.lit(11), F.col("doc_id")).alias("o")).collect()}
    pool = PlainPool([(i, x, cells[i][0]) for i, x, *_ in rows if i % 2 == 0], 20)
    pool.order = {i: o for i, (_, o) in cells.items()}
    mine = [r for r in rows if r[0] % 2]
    pool.names = quality.Vocabulary()
    x = quality.Sparse.of([pool.names.row(quality.features(r[1].encode())) for r in mine])
    ys = {"low": np.array([1.0 - q for _, q, _ in told]), "toxic": np.array([float(t) for *_, t in told])}
    plain = quality.co_train(pool.names, x, np.array([cells[r[0]][0] for r in mine]), ys, pool, 2)
    assert any(c.size for m in plain.values() for c in m.sure_cells())
    got = {r.doc_id: r for r in quality.score(df, models).collect()}
    for i, text, *_ in rows:
        for t, name in (("low", "p_low"), ("toxic", "p_toxic")):
            assert got[i][name] == pytest.approx(plain[t].probability(plain_logit(plain[t], text), np.array([cells[i][0]]))[0], abs=1e-6)


def test_metadata_cells(spark):
    rows = [("en", "a", 0), ("en", "a", 1), ("en", "a", 2), ("en", "b", 2), (None, "a", 2), ("en", "a", None), ("en", "a", 10**12), ("en", "a", -5)]
    df = spark.createDataFrame(rows, "lang string, source string, n_chars long")
    got = [r.c for r in df.select(quality.cell(df).alias("c")).collect()]
    lang, source = lambda x: zlib.crc32((x or "\0").encode()) % 32, lambda x: zlib.crc32((x or "\0").encode()) % 64
    step = lambda n: 0 if n is None else min(31, 1 + int(np.log2(max(0, n) + 1)))
    assert got == [(lang(a) * 64 + source(b)) * 32 + step(n) for a, b, n in rows]
    assert df.select(quality.cell(df.select("lang")).alias("c")).first().c == lang("en") * 64 * 32


def test_quality_without_examples(spark, docs, rows, none):
    models = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert models == {"low": None, "toxic": None} and quality.keep_good(docs, models).count() == len(rows)
    assert quality.score(none, quality.fit(none, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))).count() == 0


# --- 8 substrings ---------------------------------------------------------------------------------


def test_substrings(docs, rows):
    want = brute.windows(pairs(rows))
    assert sum(x[2] for x in want) > 500
    same(substring.dedup_substrings(docs).drop("intervals"), want)
    same(substring.dedup_substrings(docs, digest=True).drop("intervals"), [(*x[:3], brute.sha(x[3])) for x in want])
    for r in substring.dedup_substrings(docs).collect():
        ends = [e for x in r.intervals for e in (x.begin, x.end)]
        assert ends == sorted(set(ends)) and sum(x.end - x.begin for x in r.intervals) == r.n_removed


@pytest.mark.parametrize("window,gram", [(5, 1), (5, 5), (8, 3)])
def test_substrings_other_widths(spark, window, gram):
    rng = random.Random(window * gram)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    same(substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=window, gram=gram).drop("intervals"), brute.windows(rows, window))


def test_substrings_empty(none):
    assert substring.dedup_substrings(none).count() == 0


# --- 9 mixing -------------------------------------------------------------------------------------


def test_targets(spark):
    sizes = {"a": 100, "b": 5000, "c": 7, None: 900, "d": 0, "ä": 40}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((k for k in sizes if k is not None), key=str.encode) + [None]
    weight = {k: (1, 2, 3)[n % 3] for n, k in enumerate(order)}
    goal, free = dict.fromkeys(sizes, 0.0), set(sizes)
    excess = float(sum(sizes.values()))
    while excess > 1e-9:  # share, cap, share the excess again
        total = sum(weight[k] for k in free)
        for k in free:
            goal[k] += excess * weight[k] / total
        excess = sum(max(0.0, goal[k] - 3 * sizes[k]) for k in free)
        capped = {k for k in free if goal[k] >= 3 * sizes[k]}
        goal |= {k: 3.0 * sizes[k] for k in capped}
        free -= capped
    assert {k: pytest.approx(v) for k, v in goal.items()} == {k: r.target for k, r in got.items()}
    assert got["d"].rate == 0


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(None if k == 7 else f"s{k:03d}", rng.randrange(50)) for k in range(120)]
    df = spark.createDataFrame(rows, "name string, n long")
    order = [F.col("name").asc_nulls_last()]
    told = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    want = {name: (sum(n for _, n in told[:k]), k) for k, (name, _) in enumerate(told)}
    for parts in (None, 1, 4, 50):
        got = storage.running_sums(df, order, {"total": F.col("n"), "place": F.lit(1)}, parts=parts)
        assert {r.name: (r.total, r.place) for r in got.collect()} == want and got.columns == ["name", "n", "total", "place"]


def test_mix(spark, docs, rows, none):
    planned = mixing.plan_copies(docs)
    sizes = {(i, t): len(brute.WORD.findall(t or "")) for i, t in pairs(rows)}
    for r in planned.collect():
        assert r["_fw_size"] == sizes[r.doc_id, r.text] and 0 <= r["_fw_copies"] <= 3
    want = Counter()
    for r in planned.collect():
        want[r.doc_id, r.text] += r["_fw_copies"]
    mix = mixing.mix_sources(docs)
    assert mix.columns == docs.columns and Counter((r.doc_id, r.text) for r in mix.collect()) == +want
    assert mixing.mix_sources(none).count() == 0 and mixing.digest(mixing.plan_copies(none)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, prose(rng, rng.randrange(1, 40)), None, ("x", "y", "z")[k % 3 if k % 2 else 0], 0) for k in range(6000)], DOC)
    for r in mixing.digest(mixing.plan_copies(df)).groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) < 0.05 * r.target


# --- 10 decontamination ---------------------------------------------------------------------------


def items(rows):
    long = max((t for _, t, *_ in rows if t), key=lambda t: len(t.split())).split()
    mid = [t for _, t, *_ in rows if t and 60 < len(t.split()) < 200]
    return [
        (1, "Say: " + " ".join(mid[0].split()[5:30]).upper()), (2, " ".join(mid[1].split()[:10])), (3, "one"), (4, ""), (5, None), (6, "not there at all in any of the documents, I hope so"),
        (None, " ".join(mid[2].split()[3:15])), (7, " ".join(long[25_000:25_020])), (8, "one two"), (10, "one"), (10, "one"), (9, "same same same same same same same same same same same"),
    ]


def shared_run(a, b):
    """Length of the longest run of words that both hold."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[k] + 1 if x == y else 0 for k, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_decontamination(spark, docs, rows):
    bench = spark.createDataFrame(items(rows), "item_id long, text string").withColumn("n_words", F.lit(0))
    want = brute.hits(pairs(rows), items(rows))
    assert sum(x[5] for x in want) >= 5
    one = decontam.find_matches(docs.coalesce(1), bench)
    for found in (decontam.find_matches(docs, bench), decontam.find_matches(docs, bench, slice_bytes=500), one):
        same(decontam.digest(found), want)
        assert found.columns == ["doc_id", "n_words", "hit_words", "item_ids", "matches"]
    clean = decontam.decontaminate(docs, bench, slice_bytes=500)
    for clean in (clean, decontam.decontaminate(docs, bench)):
        assert clean.columns == docs.columns
        assert Counter(r.doc_id for r in clean.collect()) == Counter(x[0] for x in want if not x[5])
    by_id = {r[0]: r[1] for r in rows}
    words = {str(i): brute.ALNUM.findall(brute.low(t or "")) for i, t in items(rows) if i not in (None, 10)}
    longest = Counter()
    for r in one.collect():
        mine = brute.ALNUM.findall(brute.low(by_id[r.doc_id] or ""))
        for m in r.matches:
            if m.item_id in words:
                theirs = words[m.item_id]
                assert mine[m.doc_start : m.doc_start + m.length] == theirs[m.item_start : m.item_start + m.length]
                longest[m.item_id] = max(longest[m.item_id], m.length)
        assert {x for m in r.matches for x in range(m.doc_start, m.doc_start + m.length)} <= set(r.hit_words)
    every = [brute.ALNUM.findall(brute.low(t or "")) for _, t in pairs(rows)]
    told = {i: max(shared_run(w, d) for d in every if len(d) < 5000 or i == "7") for i, w in words.items() if w}
    assert dict(longest) == {i: n for i, n in told.items() if n >= min(10, len(words[i]))}


def test_decontamination_with_string_ids_and_one_common_phrase(spark):
    phrase = " ".join(f"p{k}" for k in range(12))
    bench = [(f"b{k}", f"{phrase} own{k}") for k in range(300)] + [("none", "q " * 12)]
    rows = [(k, f"x{k} {phrase} y") for k in range(200)] + [(500, "x"), (None, None)]
    found = decontam.find_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string"))
    same(decontam.digest(found), brute.hits(rows, bench))
    assert found.selectExpr("sum(size(matches))").first()[0] <= 300 * found.rdd.getNumPartitions()


def test_decontamination_in_runs_of_one_word():
    index = decontam.TestIndex([("1", b"so " * 500), ("2", b"so so"), ("3", b"and so so on")], 10)
    words, told, found = index.search([["x", *["so"] * 3000, "y"], [b"and"], []])
    assert [w.size for w in words] == [0, 0, 0] and found == [[], [], []] and told == [[], [], []]
    docs = [[b"x", *[b"so"] * 3000, b"y"], [b"and"], [], [b"and", b"so", b"so", b"on"]]
    words, told, found = index.search(docs)
    assert [w.size for w in words] == [3000, 0, 0, 4] and index.touched(docs).tolist() == [True, False, False, True]
    assert told == [["1", "2"], [], [], ["2", "3"]]
    # a test suffix that is the rest of one told is not told
    assert sorted((m[0], m[1], m[3]) for f in found for m in f) == [("1", 0, 500), ("2", 0, 2), ("3", 0, 4)]


def test_suffixes_are_searched_in_the_order_of_their_whole_length():
    rng = random.Random(9)
    text = [rng.choice((b"a", b"b")) for _ in range(60)]
    docs = [[rng.choice((b"a", b"b", b"a")) for _ in range(rng.randrange(0, 90))] + [b"z"] * rng.randrange(2) for _ in range(40)]
    docs += [text[5:40] + [b"z"], [b"c"] + text[20:] + text[:30]]
    for window in (3, 7):
        found = decontam.TestIndex([("i", b" ".join(text))], window).search(docs)[2]
        best = {}
        for k, matches in enumerate(found):
            for _, start, at, n in matches:
                assert docs[k][at : at + n] == text[start : start + n]
                best[start] = n
        for start in range(len(text)):
            n = max(next((n for n in range(len(text) - start, -1, -1) if text[start : start + n] == d[at : at + n]), 0) for d in docs for at in range(len(d)))
            if n >= window:
                told = max((best[s] - (start - s) for s in best if s <= start), default=0)
                assert told == n


def test_decontamination_empty(spark, docs, rows, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.digest(decontam.find_matches(docs, bench)).filter("contaminated").count()
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.find_matches(none, bench).count() == 0


# --- shared ---------------------------------------------------------------------------------------


def test_written_tables_live_in_the_shared_folder(spark):
    table = storage.written(spark.range(5), "probe")
    before = spark.conf.get(storage._CLEANUP)
    with pytest.raises(Exception, match="divide"):
        storage.written(spark.sql("select 1 / id as x from range(1)"), "fails")
    assert spark.conf.get(storage._CLEANUP) == before == "false"
    assert table.count() == 5 and all(storage.shared_dir(spark).removeprefix("file://") in f for f in table.inputFiles())
    storage.purge(spark, table)
