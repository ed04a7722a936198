"""Every operator against brute force or a round trip, and on the awkward rows that its docstring defines."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexnet.llm import chat, common, decontaminate, language, lm, packing, quality, records, simhash, tokens, topk, toxicity
from hexnet.llm.entry import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, w string, i int, score double, key string, block long, n int"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
AWKWARD = [
    (1, "The first line of text.\nAnd a second line, of the text.", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "de"), (5, LONG, "fr"),
    (6, "repeated row here", "en"), (6, "repeated row here", "en"), (7, "repeated row here", None), (None, "no id at all", "en"), (8, "Über été 你好 \U0001f600 1,234", "de"),
]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame([(d, t, l, "src", len(t or ""), 1, "x", 2, 0.5, "k", 3, 4) for d, t, l in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


# ---------------------------------------------------------------- tokens, packing, records

ODD = ["", "a  b", "x \n y", "\n\nfoo  bar ", "it's don't  ", "<|endoftext|> a", "<|startoftext|> b", "İstanbul", "Σας ΣΑΣ", "a\tb", "a b", "é x", "²x", "1,234 a1.", "a.\nB", "...,, ..", " x", "x ", "Å Ⅷ", "a\x00b", "One two, three. Two two"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_encode_like_whole_texts(name):
    e = tokens.WordEncoder(tokenizer(name))
    assert e.encode(ODD) == e._whole(ODD) == e.encode(ODD)
    assert e.encode([None]) == [b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_encode_like_whole_ones(name):
    rng, e = random.Random(3), tokens.WordEncoder(tokenizer(name))
    some = [*"abZİıéΣς日.,'s!1½-\t\n ", "  ", "e\u0301", "\u0307", "ARİHİ.", "\u00a0", "\U0001f600", "the", " ", " ", "\u0345"]
    texts = ["TARİHİ.", "BELEDİYESİ, tarih", "İ,"] + ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x250, 0x2FFF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(8)) for _ in range(1000)]
    assert e.kind and e.encode(texts) == e._whole(texts)


def test_another_kind_of_tokenizer_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    t.pre_tokenizer = None
    t.save(str(tmp_path / "t.json"))
    e = tokens.WordEncoder(str(tmp_path / "t.json"))
    assert e.kind is None and e.encode(["a b  c", None]) == e._whole(["a b  c", ""])


def test_best_two_fit():
    rng = np.random.default_rng(1)
    for _ in range(40):
        size = int(rng.integers(5, 60))
        lengths = rng.integers(1, size + 1, int(rng.integers(0, 40))).tolist()
        bins = packing.best_two_fit(lengths, size)
        assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in b) <= size for b in bins)
    # the greedy bin 6 + 3 leaves a gap of 1; 2 + 2 instead of 3 fill it
    assert sorted(sorted([6, 3, 2, 2][k] for k in b) for b in packing.best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]
    assert packing.best_two_fit([], 10) == []


def test_best_two_fit_against_a_plain_version():
    def plain(lengths, size):
        left, bins = Counter(lengths), []
        while left:
            own, gap = [], size
            while fits := [n for n in left if n <= gap]:
                own.append(max(fits))
                gap -= own[-1]
                left -= Counter(own[-1:])
            if gap and len(own) > 1 and left:
                room = gap + own[-1]
                pairs = [(a + b, a, b) for a in left for b in left if b <= a and a + b <= room and (a != b or left[a] > 1)]
                if pairs and max(pairs)[0] > own[-1]:
                    _, a, b = max(pairs)
                    left = left - Counter([a, b]) + Counter([own.pop()])
                    own += [a, b]
            bins.append(own)
        return bins

    rng = np.random.default_rng(5)
    for size in (10, 17, 40):
        lengths = rng.integers(1, size + 1, 60).tolist()
        assert [sorted(lengths[k] for k in b) for b in packing.best_two_fit(lengths, size)] == [sorted(b) for b in plain(lengths, size)]


def test_packing_keeps_large_ids(spark):
    df = spark.createDataFrame([((1 << 60) + 1, "a b"), (None, "c"), (5, None)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack_documents(df, tokenizer("byte_bpe_50k.json")).collect()} == {(1 << 60) + 1, None, 5}


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_packing(spark):
    path, size = tokenizer("byte_bpe_50k.json"), 64
    rows = packing.pack_documents(docs(spark), path, size).collect()
    e, per = tokens.WordEncoder(path), {}
    texts = {d: t for d, t, _ in AWKWARD}
    for r in rows:
        ids = np.append(np.frombuffer(e._whole([texts[r.doc_id] or ""])[0], "<u4"), np.uint32(0))
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.astype("<u4").tobytes()) == r.ids_crc32
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in per.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(r.length for r in rows) / size) + 1
    assert sum(r.doc_id == 6 for r in rows) == 2 * sum(r.doc_id == 7 for r in rows)
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_record_frames():
    data = records.frame(7, np.array([1, 2, 70_000], "<u4")) + records.frame(None, np.array([3], "<u4"))
    doc, ids, at = records.parse(data, 0)
    assert (doc, ids.tolist()) == (7, [1, 2, 70_000]) and records.parse(data, at)[0] is None
    for k in range(len(data)):
        broken = bytearray(data)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            records.parse(bytes(broken), records.parse(bytes(broken), 0)[2])


def test_records(spark):
    path = tokenizer("word_bpe_49k.json")
    folder = common.fresh_path(spark, "t")
    listed = records.write(docs(spark), folder, path, end_id=1).collect()
    assert sum(r.n_docs for r in listed) == len(AWKWARD)
    got = sorted(records.read(spark, folder).collect(), key=lambda r: r.start)
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    e, start = tokens.WordEncoder(path), 0
    for r, (d, t, _) in zip(got, order, strict=True):
        ids = e._whole([t or ""])[0] + np.array([1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    empty = common.fresh_path(spark, "t")
    assert records.write(docs(spark, []), empty, path, 1).count() == 0 and records.read(spark, empty).count() == 0
    index = listed[0].path.removeprefix("file:").removesuffix(".rec") + ".idx"
    with open(index, "r+b") as f:
        f.seek(8)
        f.write(b"\x07")
    with pytest.raises(Exception, match="index|damaged"):
        records.read(spark, folder).collect()


def test_starts_over_many_bins(spark, monkeypatch):
    monkeypatch.setattr(records, "SHARD_CHARS", 40)
    monkeypatch.setattr(records, "BIN", 2)
    folder = common.fresh_path(spark, "t")
    listed = sorted(records.write(docs(spark, [(k, f"one two {k}", "en") for k in range(60)]), folder, tokenizer("word_bpe_49k.json"), 1).collect(), key=lambda r: (r.part, r.seq))
    assert len(listed) > 4 and [r.start for r in listed] == [sum(x.n_tokens for x in listed[:k]) for k in range(len(listed))]


# ---------------------------------------------------------------- decontamination

def _words(t):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c.isalnum() else " " for c in t or "").split(" ") if w]


def test_decontamination(spark):
    rnd = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "Delta", "été", "x1"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(1, text(14)), (2, text(5)), (2, text(5)), (3, text(3)), (4, ""), (5, None), (None, text(12)), (10, text(25))]
    rows = [(k, text(rnd.randint(0, 12)) + " ".join(str(t) for _, t in rnd.sample(items[:4], rnd.randint(0, 2))) + text(5)) for k in range(60)]
    rows += [(200, None), (201, ""), (7, rows[7][1]), (None, items[0][1]), (300, items[7][1])]
    d = docs(spark, [(a, b, "en") for a, b in rows])
    bench = spark.createDataFrame([(a, b, 1, "z") for a, b in items], "item_id long, text string, n int, w string")
    found = {}
    for a, t in items:
        ws = _words(t)
        if a is not None and ws:
            n = min(10, len(ws))
            for k in range(len(ws) - n + 1):
                found.setdefault(tuple(ws[k : k + n]), set()).add(a)

    def brute(a, t):
        ws, hit, own = _words(t), set(), set()
        for n in {len(w) for w in found}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in found:
                    hit |= set(range(k, k + n))
                    own |= found[tuple(ws[k : k + n])]
        return (a, len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit))

    got = sorted(map(tuple, decontaminate.report(d, bench).collect()), key=str)
    assert got == sorted((brute(a, t) for a, t in rows), key=str)
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(a for a, t in rows if not brute(a, t)[-1])
    spans = decontaminate.clean(d, bench, remove="spans").collect()
    assert len(spans) == len(rows)
    for r in spans:
        want = next(t for a, t in rows if a == r.doc_id)
        hit = brute(r.doc_id, want)
        assert len(_words(r.text)) == hit[1] - hit[2] and (hit[2] or r.text == want)
    none = bench.limit(0)
    assert not decontaminate.report(d, none).where("contaminated").count() and decontaminate.clean(d, none).count() == len(rows)
    assert decontaminate.report(d.limit(0), bench).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame([(1, LONG[:2000])], "item_id long, text string")
    one = decontaminate.report(docs(spark), bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(one, key=str) == sorted(decontaminate.report(docs(spark), bench).collect(), key=str)


# ---------------------------------------------------------------- near duplicates

def test_triples_cover():
    for four in itertools.combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.STRICT.places)


def test_fingerprint():
    import xxhash

    words = "a b c d e f g".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)
    assert int.from_bytes(simhash.fingerprint("A b\tc d\ne F g "), "big") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == bytes(8)
    assert int.from_bytes(simhash.fingerprint("Two words"), "big") == xxhash.xxh64_intdigest("two words", 42)


def test_forest_and_lists():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base[k % 12] ^ (rng.integers(0, 2, 400, dtype=np.uint64) << np.uint64(k % 7)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for k in range(6)]))
    rows = fps.view(np.uint8).reshape(-1, 8)
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in simhash.forest(np.arange(len(fps)), rows, simhash.STRICT):
        assert int(np.bitwise_count(fps[a] ^ fps[b])) <= 4
        up[top(a)] = top(b)
    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 4):
            assert top(a) == top(int(b))


def test_components(spark):
    rng = np.random.default_rng(2)
    for n, m in ((300, 200), (200, 400), (60, 30)):
        e = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1040)]
        got = {r.node: r.root for r in simhash.components(spark.createDataFrame(e, "a long, b long").repartition(7)).collect()}
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in e:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        assert all(got.get(x, x) == top(x) for x in list(up))


def test_classes(spark):
    rows = AWKWARD + [(20 + k, " ".join(f"t{j}" for j in range(120)) + (f" end{k}" if k else ""), "en") for k in range(5)]
    got = simhash.classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {d: int.from_bytes(simhash.fingerprint(t), "big") for d, t, _ in rows}
    ids = [d for d in fp if d is not None]
    comp = {d: d for d in ids}
    for _ in ids:
        for a, b in itertools.product(ids, ids):
            if bin(fp[a] ^ fp[b]).count("1") <= 4:
                comp[a] = comp[b] = min(comp[a], comp[b])
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}"
        assert r.component_id == (comp[r.doc_id] if r.doc_id is not None else None)
    assert simhash.classes(docs(spark, [])).count() == 0


def test_first_of_each(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 200)) for _ in range(6)]
    rows = []
    for k, t in enumerate(base):
        for j in range(4):
            words = t.split()
            words[3 + j] = "changed" if j else words[3]
            rows.append((10 * k + j, " ".join(words), "en"))
    rows += [(None, base[0], "en"), (999, None, "en"), (1000, "", "en"), (0, rows[0][1], "en")]
    kept = simhash.first_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 10, 20, 30, 40, 50, None, 999], key=str)


def _altered(seed, n=240):
    """Pairs of ids (2 k, 2 k + 1) and texts of 60 to 300 words, the second with some words changed at the end."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        m = int(rng.integers(60, 300))
        words = [f"p{k}x{x}" for x in range(m)]
        cut = int((m - 4) * rng.uniform(0.05, 0.2))
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(words[:-cut] + [f"q{k}x{x}" for x in range(cut)]), "en")]
    sets = [{tuple(t.split()[x : x + 5]) for x in range(len(t.split()) - 4)} for _, t, _ in rows]
    return rows, {2 * k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(n)}


def test_wide_links_only_similar(spark):
    rows, similarity = _altered(5)
    assert sum(0.7 <= s < 0.8 for s in similarity.values()) > 20
    comp = {r.doc_id: r.component_id for r in simhash.classes(docs(spark, rows), 5, simhash.WIDE).collect()}
    assert not [(k, s) for k, s in similarity.items() if s < 0.8 and comp[k] == comp[k + 1]]


def test_wide_against_brute_force(spark):
    rows, similarity = _altered(7, 400)
    near = {k for k, s in similarity.items() if s >= 0.8}
    assert sum(similarity[k] < 0.85 for k in near) > 60
    comp = {r.doc_id: r.component_id for r in simhash.classes(docs(spark, rows), 5, simhash.WIDE).collect()}
    missed = [k for k in near if comp[k + 1] != k]
    assert len(missed) <= 2 and {k for k in similarity if comp[k + 1] == k} <= near, missed


def test_wide_group_whose_members_differ(spark):
    """Copies of one text that are similar to it but not to each other are one group; similar to none, none."""
    words = [f"w{x}" for x in range(204)]
    own = lambda k, n: " ".join(words[: 10 * k] + [f"c{k}x{x}" for x in range(n)] + words[10 * k + n :])
    close, far = [(k, own(k - 1, 10), "en") for k in range(1, 20)], [(100 + k, own(k, 25).replace("w", "v"), "en") for k in range(0, 18, 3)]
    comp = {r.doc_id: r.component_id for r in simhash.classes(docs(spark, [*close, (50, " ".join(words), "en"), *far]), 5, simhash.WIDE).collect()}
    assert all(comp[k] == 1 for k in [*range(1, 20), 50]) and all(comp[d] == d for d, _, _ in far)


def test_lists_of_any_length_and_batches():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    fps = np.array([base ^ (rng.random(64) < 0.2) * rng.integers(0, 256, 64, dtype=np.uint8) for _ in range(150)], np.uint8)
    rows = pd.DataFrame({"key": np.repeat([1, 2, 3], [20, 90, 40]), "node": rng.permutation(150), "fp": [x.tobytes() for x in fps]})
    rows["root"] = rows["node"] % 4
    want = set()
    for _, own in rows.groupby("key"):
        for (a, x, r), (b, y, q) in itertools.combinations(zip(own["node"], own["fp"], own["root"]), 2):
            both = np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)
            if r != q and np.bitwise_count(both).sum() <= simhash.WIDE.distance and (both == 0).sum() >= simhash.WIDE.shared:
                want.add((min(a, b), max(a, b)))
    assert want and {tuple(x) for x in simhash._list_pairs(rows, simhash.WIDE).to_numpy().tolist()} == want


def test_sets_that_differ_are_not_met_though_fingerprints_are_near():
    """A group of near fingerprints gives as many pairs as are similar, not as many as it has."""
    rng = np.random.default_rng(8)
    common, n = rng.integers(0, 2**63, 14).astype(np.uint64), 300
    sets = [np.unique(np.append(common, rng.integers(0, 2**63, 6).astype(np.uint64))) for _ in range(n)]
    sets[1::50] = [np.unique(np.append(x[:-1], np.uint64(k))) for k, x in enumerate(sets[::50])]  # 19 of 21
    rows = pd.DataFrame({"key": 1, "node": range(n), "fp": bytes(64), "root": range(n), "size": [len(x) for x in sets], "parity": [simhash.parity(x) for x in sets]})
    got = {tuple(x) for x in simhash._list_pairs(rows, simhash.WIDE).to_numpy().tolist()}
    similar = {(a, b) for a, b in itertools.combinations(range(n), 2) if simhash.jaccard(sets[a], sets[b]) >= 0.8}
    assert similar == {(k, k + 1) for k in range(0, n, 50)} <= got and len(got) < 2 * n


def test_no_similar_sets_are_left_out_by_size_and_parity():
    rng = np.random.default_rng(9)
    for n in (1, 4, 5, 9, 40, 700, 3000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(n) >= a], rng.integers(0, 2**63, b).astype(np.uint64)])) for a in (0, 0.05, 0.1, 0.2) for b in (0, n // 20, n // 9, n // 4)]
        rows = pd.DataFrame({"key": 1, "node": range(16), "fp": bytes(64), "root": range(16), "size": [len(x) for x in sets], "parity": [simhash.parity(x) for x in sets]})
        got = {tuple(x) for x in simhash._list_pairs(rows, simhash.WIDE).to_numpy().tolist()}
        assert {(a, b) for a, b in itertools.combinations(range(16), 2) if simhash.jaccard(sets[a], sets[b]) >= 0.8} <= got


@pytest.mark.parametrize("scheme", [simhash.WIDE, simhash.STRICT])
def test_first_of_each_with_clashing_ids(spark, scheme):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(5, a, "en"), (5, b, "en"), (5, b, "en"), (3, a, "en"), (8, c, "en"), (8, a, "en"), (9, c, "en")]
    for order in (rows, rows[::-1]):
        assert sorted((r.doc_id, r.text) for r in simhash.first_of_each(docs(spark, order), scheme=scheme).collect()) == [(3, a), (5, b), (8, c)]


# ---------------------------------------------------------------- classifiers

def _learned(spark, rows, which):
    return docs(spark, [(d, t, "en") for d, t, _ in rows]), labels(spark, [(d, y if which == "quality" else 1, y if which == "toxic" else 0, "clash") for d, _, y in rows])


def test_chain_against_all_labellings():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        s, join = rng.normal(size=n), rng.normal(size=(2, 2))
        good, pairs, z = quality.chain(s, join)
        total, want, count = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(s[k] * y[k] for k in range(n)) + sum(join[a, b] for a, b in zip(y[:-1], y[1:])))
            total += p
            want += p * np.array(y)
            for a, b in zip(y[:-1], y[1:]):
                count[a, b] += p
        assert np.allclose(good, want / total) and np.allclose(pairs, count / total) and math.isclose(z, math.log(total))


def test_chains_of_many_documents():
    rng = np.random.default_rng(3)
    lens = np.array([7, 4, 4, 1])
    s, join = rng.normal(size=lens.sum()), rng.normal(size=(2, 2))
    starts = np.cumsum(lens) - lens
    good, pairs = quality.chains(s, starts, lens, join)
    for k, (at, n) in enumerate(zip(starts, lens, strict=True)):
        one, two, _ = quality.chain(s[at : at + n], join)
        assert np.allclose(good[at : at + n], one) and np.allclose(pairs[k], two)


def test_quality_knows_the_order_of_words():
    rng = random.Random(0)
    make = lambda: " ".join(["The", *(rng.choice("cat dog sees house it with".split()) for _ in range(8))]) + ". Then " + " ".join(rng.choice("cat dog sees".split()) for _ in range(5)) + "."

    def shuffled(t):
        return "\n".join(" ".join(rng.sample(line.split(), len(line.split()))) for line in t.split("\n"))

    docs_ = [(t, 1) if k % 2 else (shuffled(t), 0) for k, t in enumerate("\n".join(make() for _ in range(3)) for _ in range(200))]
    field = quality.fit_field(docs_)
    fresh = ["\n".join(make() for _ in range(3)) for _ in range(40)]
    assert np.mean([field.score(t) > field.score(shuffled(t)) for t in fresh]) > 0.9
    # bad lines inside good documents are told apart
    lines = np.array([field.marginals("\n".join([make(), shuffled(make()), make()]))[0] for _ in range(30)])
    assert lines[:, 1].mean() < min(lines[:, 0].mean(), lines[:, 2].mean())


def test_quality(spark):
    rows = [(k, "This is a fine sentence about it.\nAnd another line of words follows here.", 1) if k % 3 else (k, "WOW!! BUY!! NOW!!\n### %%% &&& BUY!!", 0) for k in range(90)]
    d, y = _learned(spark, rows, "quality")
    field = quality.fit(d, y.unionByName(y).unionByName(labels(spark, [(None, 1, 0, ""), (5, None, 0, "")])), F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in quality.predict(d, field, "doc_id").collect()}
    assert all(got[k].predicted == y for k, _, y in rows)
    odd = quality.predict(docs(spark), field, "doc_id").collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    bare = quality.fit(d, y.limit(0), F.lit(True))
    assert {r.score for r in quality.predict(d, bare, "doc_id").collect()} == {0.5}
    assert quality.predict(d.limit(0), field, "doc_id").count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    bad = ["grumblefoo", "scabbard", "vilewort"]
    rows = [(k, " ".join([f"word{x}" for x in rng.integers(0, 400, 30)] + ([bad[k % 3]] if k % 5 == 0 else [])), int(k % 5 == 0)) for k in range(300)]
    d, y = _learned(spark, rows, "toxic")
    index = toxicity.fit(d, y, F.col("doc_id") % 7 != 0)
    got = {r.doc_id: r for r in toxicity.predict(d, index, "doc_id").collect()}
    assert all(got[k].predicted == v for k, _, v in rows)
    assert got[0].neighbours and "grumblefoo" in got[0].terms
    # exact: against all cosines over all words
    examples = [Counter(toxicity.words_of(rows[i][1])) for i in index.doc_ids]
    weight = lambda tf: {w: (1 + math.log(n)) * index.worth[index.at[w]] for w, n in tf.items() if w in index.at}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [weight(x) for x in examples]
    assert all(set(x) == set(v) for x, v in zip(examples, vectors, strict=True))
    for _, t, _ in rows[:60]:
        own = weight(Counter(toxicity.words_of(t)))
        cosines = [sum(x * v.get(w, 0) for w, x in own.items()) / norm(own) / norm(v) for v in vectors]
        want = sorted(((-round(c, 9), k) for k, c in enumerate(cosines) if c > 0))[: toxicity.K]
        found, _ = index.nearest(*index.vector(Counter(toxicity.words_of(t))))
        assert np.allclose(found, [-c for c, _ in want], atol=2e-9)
    assert all(r.neighbours for r in got.values())
    odd = toxicity.predict(docs(spark), index, "doc_id").collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.fit(d, y.limit(0), F.lit(True))
    assert len({r.score for r in toxicity.predict(d, none, "doc_id").collect()}) == 1
    assert toxicity.predict(d.limit(0), index, "doc_id").count() == 0


def test_language(spark):
    words = {"en": "the of and with that this from", "de": "der die und nicht mit über straße", "fr": "le la est été avec pour dans", "es": "el los que niño para una con", "xx": "zzq qqz zqz"}
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 12)), lang) for k, lang in enumerate(list(words) * 30)]
    d = docs(spark, rows)
    model = language.fit(d, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in language.predict(d, model, "doc_id").collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows) == len(rows)
    odd = {r.doc_id: r for r in language.predict(docs(spark), model, "doc_id").collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (2, 3, 4)) and odd[8].lang_pred != "und"
    assert language.predict(docs(spark, [(1, "123 ... !", "en")]), model, "doc_id").first().lang_pred == "und"
    nothing = language.fit(d.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(d, nothing, "doc_id").collect()} == {"und"}
    single = language.fit(d.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in language.predict(d, single, "doc_id").collect()} == {"en"}


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = common.sample(rows, "label", 500)
    n = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert 400 < n[0] < 620 and 400 < n[1] < 620
    assert sorted(got.collect()) == sorted(common.sample(rows.repartition(9), "label", 500).collect())


# ---------------------------------------------------------------- language model

def _stirling(n):
    """S(n, t) for the discount 1/2, t = 1 .. n."""
    s = [0.0, 1.0]
    for c in range(1, n):
        s = [0.0] + [(s[t - 1] if t else 0) + (c - t / 2) * (s[t] if t < len(s) else 0) for t in range(1, c + 2)]
    return np.array(s[1:])


@pytest.mark.parametrize("c, alpha", [(2, 0.3), (3, 0.01), (5, 2.0), (12, 0.7), (60, 0.05), (60, 40.0)])
def test_tables_are_drawn_from_their_distribution(c, alpha):
    p = _stirling(c) * alpha ** np.arange(1, c + 1)
    u = (np.arange(20_000) + 0.5) / 20_000
    t = lm.draw_tables(np.full(len(u), c), np.full(len(u), alpha), u)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / len(u) - p / p.sum()).max() < 2e-4


def test_other_draws():
    seeds = np.arange(50_000, dtype=np.uint64)
    for shape in (0.6, 2.0, 900.0):
        x = lm.draw_gamma(np.full(len(seeds), shape), seeds, 3)
        assert abs(x.mean() / shape - 1) < 0.03 and abs(x.var() / shape - 1) < 0.05
    big = lm.draw_tables(np.array([10**6, 10**6, 2]), np.array([50.0, 1e-9, 1e9]), np.array([0.5, 0.5, 0.5]))
    assert 60 < big[0] < 150 and big[1] == 1 and big[2] == 2  # the mode is near 2 * alpha
    assert np.allclose(lm.digamma(np.array([1.0, 2.5, 50.0])), [-0.5772156649, 0.7031566406, 3.9019896734])


def _naive_scores(texts, asked, sweeps=120, burn=40, d=0.5, s=1.0):
    """log10 of each asked text by one-by-one Gibbs over tables, contexts of one word and a root, strengths s."""
    rng, rest = random.Random(1), {}
    customers = [(u, w) for t in texts for u, w in zip(["^", *t.split()], [*t.split(), "$"])]
    v = len({w for _, w in customers})
    tables, root = {}, {}

    def p_root(w):
        n, k = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root.get(w, [])) - d * len(root.get(w, [])) + (s + d * k) / (v + 1)) / (s + n)

    def p(u, w):
        own = tables.get(u, {})
        n, k = sum(map(sum, own.values())), sum(map(len, own.values()))
        return (sum(own.get(w, [])) - d * len(own.get(w, [])) + (s + d * k) * p_root(w)) / (s + n)

    def join(at, w, base, k):
        own = at.setdefault(w, [])
        place = rng.random() * (sum(own) - d * len(own) + (s + d * k) * base)
        for j, n in enumerate(own):
            place -= n - d
            if place < 0:
                own[j] += 1
                return False
        own.append(1)
        return True

    def leave(at, w):
        own = at[w]
        j = rng.choices(range(len(own)), own)[0]
        own[j] -= 1
        if not own[j]:
            del own[j]
            return True
        return False

    def add(u, w):
        if join(tables.setdefault(u, {}), w, p_root(w), sum(map(len, tables.get(u, {}).values()))):
            join(root, w, 1 / (v + 1), sum(map(len, root.values())))

    for u, w in customers:
        add(u, w)
    for k in range(sweeps):
        for u, w in customers:
            if leave(tables[u], w):
                leave(root, w)
            add(u, w)
        if k >= burn:
            for t in asked:
                rest[t] = [a + p(u, w) for a, (u, w) in zip(rest.get(t, [0.0] * 99), zip(["^", *t.split()], [*t.split(), "$"]))]
    return {t: sum(math.log10(x / (sweeps - burn)) for x in rest[t]) for t in asked}


def test_language_model_against_one_by_one_gibbs(spark, monkeypatch):
    monkeypatch.setattr(lm, "draw_strengths", lambda counts, n: np.ones(counts.shape[1]))
    monkeypatch.setattr(lm, "ROOT_STRENGTH", 1.0)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("aaabbcdefgh") for _ in range(8)) for _ in range(25)]
    asked = [*texts[:6], "a b c", "h h z", "z", "f e d a"]
    want = _naive_scores(texts, asked)
    rows = [(k, t, "en") for k, t in enumerate([*texts, *asked])]
    got = {r.doc_id: r for r in lm.score(docs(spark, rows), F.col("doc_id") < len(texts)).collect()}
    for k, t in enumerate(asked):
        r = got[len(texts) + k]
        assert abs(r.score - want[t]) < 0.03 * abs(want[t]), (t, r.score, want[t])
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens))


def test_language_model(spark):
    rng = np.random.default_rng(5)
    start = [f"w{x}" for x in range(30)]
    texts = []
    for k in range(300):
        w, out = rng.choice(start), []
        for _ in range(20):
            out.append(w)
            w = start[(start.index(w) + 1) % 30] if rng.random() < 0.8 else rng.choice(start)
        texts.append((k, " ".join(out), "en"))
    rows = texts + [(2000 + d, t, x) for d, t, x in AWKWARD[1:5]] + [(None, "w1 W2", "en"), (0, texts[0][1], "en")]
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = lm.score(docs(spark, rows), learn).collect()
    assert len(got) == len(rows)
    count, n = {}, 0
    for d, t, _ in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            for w in [*(t or "").lower().split(), None]:
                count[w] = count.get(w, 0) + 1
                n += 1
    want = {}
    for d, t, _ in rows:
        ws = [*(t or "").lower().split(), None]
        want[d] = (len(ws), sum(w in count for w in ws), n, sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in ws))
    for r in got:
        a = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == a[:3] and math.isclose(r.base_score, a[3], rel_tol=1e-9) and r.score <= 0
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    assert lm.score(docs(spark, []), learn).count() == 0
    untaught = lm.score(docs(spark, AWKWARD[:1]), F.lit(False)).first()
    assert untaught.train_tokens == 0 and untaught.base_score == 0 and untaught.score == 0


def test_scores_do_not_depend_on_dealing(spark, monkeypatch):
    rows = [(k, " ".join(f"a b{(k * 7 + j) % 50}" for j in range(20)), "en") for k in range(40)]
    score = lambda: {r.doc_id: r.score for r in lm.score(docs(spark, rows).repartition(3), F.lit(True)).collect()}
    one = score()
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 100)
    monkeypatch.setattr(lm, "WORD_SHARD_TOKENS", 500)
    dealt = score()
    assert all(abs(one[k] - dealt[k]) < 0.002 * abs(one[k]) for k in one)
    # a divided context's parts know the others' tables as they were before the round
    monkeypatch.setattr(lm, "HOT", 100)
    parted = score()
    assert all(abs(one[k] - parted[k]) < 0.01 * abs(one[k]) for k in one)
    monkeypatch.setattr(lm, "MOST_HOT", 0)
    assert all(abs(v - parted[k]) < 1e-6 for k, v in score().items())


def test_probabilities_leave_room(spark):
    """Texts of one word and the empty one are disjoint, so their probabilities sum to less than one."""
    rows = [(k, t, "en") for k, t in enumerate(["a b", "a c", "a b", "b c", "c c", "a"] * 5)]
    extra = [(1000 + k, f"a {w}", "en") for k, w in enumerate("abc")] + [(1100, "a unknown", "en"), (1200, "a", "en"), (1201, "", "en")] + [(1300 + k, w, "en") for k, w in enumerate(["a", "b", "c", "unknown"])]
    got = {r.doc_id: 10**r.score for r in lm.score(docs(spark, rows + extra), F.col("doc_id") < 1000).collect()}
    assert 0 < sum(got[1300 + k] for k in range(4)) + got[1201] < 1


def _naive_scores_of_two(texts, asked, sweeps=120, burn=40, d=0.5):
    """log10 of each asked text by one-by-one Gibbs over tables: contexts of two words, of one and a root, strengths 1."""
    rng, rest, seats = random.Random(3), {}, {}
    v = len({w for t in texts for w in [*t.split(), "$"]})

    def grams(t):
        words = ["^", "^", *t.split(), "$"]
        return [((words[k - 2], words[k - 1]), words[k]) for k in range(2, len(words))]

    def p(context, w):
        if context is None:
            return 1 / (v + 1)
        own = seats.get(context, {})
        n, k = sum(map(sum, own.values())), sum(map(len, own.values()))
        return (sum(own.get(w, [])) - d * len(own.get(w, [])) + (1 + d * k) * p(context[1:] if context else None, w)) / (1 + n)

    def add(context, w):
        if context is None:
            return
        base = p(context[1:] if context else None, w)
        at = seats.setdefault(context, {})
        k = sum(map(len, at.values()))
        own = at.setdefault(w, [])
        place = rng.random() * (sum(own) - d * len(own) + (1 + d * k) * base)
        for j, n in enumerate(own):
            place -= n - d
            if place < 0:
                own[j] += 1
                return
        own.append(1)
        add(context[1:] if context else None, w)

    def leave(context, w):
        own = seats[context][w]
        j = rng.choices(range(len(own)), own)[0]
        own[j] -= 1
        if not own[j]:
            del own[j]
            if context:
                leave(context[1:], w)

    customers = [g for t in texts for g in grams(t)]
    for u, w in customers:
        add(u, w)
    for k in range(sweeps):
        for u, w in customers:
            leave(u, w)
            add(u, w)
        if k >= burn:
            for t in asked:
                rest[t] = [a + p(u, w) for a, (u, w) in zip(rest.get(t, [0.0] * 99), grams(t))]
    return {t: sum(math.log10(x / (sweeps - burn)) for x in rest[t]) for t in asked}


def test_contexts_of_two_words_against_one_by_one_gibbs(spark, monkeypatch):
    monkeypatch.setattr(lm, "draw_strengths", lambda counts, n: np.ones(counts.shape[1]))
    monkeypatch.setattr(lm, "ROOT_STRENGTH", 1.0)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("aaabbcdefgh") for _ in range(12)) for _ in range(40)]
    asked = [*texts[:6], "a b c", "h h z", "z", "z a b", "f e d a"]
    want = _naive_scores_of_two(texts, asked)
    rows = [(k, t, "en") for k, t in enumerate([*texts, *asked])]
    got = {r.doc_id: r.score for r in lm.score(docs(spark, rows), F.col("doc_id") < len(texts), words=2).collect()}
    for k, t in enumerate(asked):
        assert abs(got[len(texts) + k] - want[t]) < 0.03 * abs(want[t]), (t, got[len(texts) + k], want[t])


def test_contexts_of_two_words_do_not_depend_on_dealing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["a", "a", f"b{rng.randrange(20)}", f"c{rng.randrange(200)}"]) for _ in range(30)), "en") for k in range(80)]
    learn = F.col("doc_id") % 4 != 0
    score = lambda: {r.doc_id: r.score for r in lm.score(docs(spark, rows).repartition(3), learn, words=2).collect()}
    one = score()
    for name, value in (("BLOCK_TOKENS", 300), ("SHARD_TOKENS", 200), ("WORD_SHARD_TOKENS", 500)):
        monkeypatch.setattr(lm, name, value)
    dealt = score()
    assert sorted(dealt) == sorted(one) and all(abs(one[k] - dealt[k]) < 0.002 * abs(one[k]) for k in one)
    monkeypatch.setattr(lm, "HOT", 100)
    parted = score()
    assert all(abs(one[k] - parted[k]) < 0.02 * abs(one[k]) for k in one)
    monkeypatch.setattr(lm, "MOST_HOT", 0)
    assert all(abs(v - parted[k]) < 1e-6 for k, v in score().items())


def test_contexts_of_two_words_on_odd_rows(spark):
    rows = [(k, t, "en") for k, t in enumerate(["a b", None, "", "c", "a b", "A  B\n c"])] + [(None, "a b", "en"), (0, "a b", "en")]
    got = lm.score(docs(spark, rows), F.col("doc_id") < 4, words=2).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3, 3, 3, 4] and all(r.score < 0 and r.train_tokens == 10 for r in got)
    assert len({r.score for r in got if r.n_tokens == 3}) == 1
    assert lm.score(docs(spark, []), F.lit(True), words=2).count() == 0
    assert lm.score(docs(spark, rows[:1]), F.lit(False), words=2).first().score == 0


# ---------------------------------------------------------------- chat

def test_chat_round_trip(spark):
    own = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <| \\", "", None, "a\nb"]
    log = spark.createDataFrame([(1, k, "message", r, t, None, "clash") for k, (r, t) in enumerate(zip(["user", "assistant", "a\nb\\n", None, "assistant"], own))], "conv_id long, seq long, op string, role string, text string, target long, n string")
    rows = sorted(chat.format_log(log).collect(), key=lambda r: r.n)
    assert [chat.parse(r.formatted) for r in rows] == [(r or "", t or "") for r, t in zip(["user", "assistant", "a\nb\\n", None, "assistant"], own)]
    assert all(r.formatted.count("<|") == 2 for r in rows)
    d = chat.digest(chat.format_log(log)).first()
    learned = own[1] + own[4]
    assert d.loss_chars == len(learned) and d.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and d.n_turns == 5
    assert d.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in zip(["user", "assistant", "a\nb\\n", None, "assistant"], own)).encode()).hexdigest()
    assert chat.digest(chat.format_log(log.limit(0))).count() == 0


def test_chat_events(spark):
    e = [
        (1, 1, "message", "user", "hi", None), (1, 2, "message", "assistant", "he", None), (1, 3, "delta", None, "llo", None), (1, 4, "edit", None, "HI", 1),
        (1, 5, "regenerate", None, "bet", 2), (1, 6, "delta", None, "ter", None), (1, 7, "delta", None, "!", 1), (1, 8, "delta", None, "lost", 99),
        (2, 1, "delta", None, "nothing before", None), (2, 2, None, "user", "x", None), (2, 3, "message", "assistant", "y", None), (2, 4, "regenerate", "tool", "z", None),
        (None, 1, "message", "user", "n", None), (3, 1, "message", "user", "same", None), (3, 1, "message", "user", "same", None),
    ]
    rows = chat.fold(spark.createDataFrame(e, "conv_id long, seq long, op string, role string, text string, target long")).orderBy("conv_id", "n").collect()
    got = {}
    for r in rows:
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "HI!"), ("assistant", "better")], 2: [("user", "x"), ("tool", "z")], None: [("user", "n")], 3: [("user", "same")] * 2}


def _folded(log):
    """The log folded one event after the other."""
    known, out = lambda x: (x is not None, x if x is not None else 0), {}
    for conv in {r[0] for r in log}:
        rows = [(r[1], r[2] or "message", r[3], r[4] or "", r[5]) for r in log if r[0] == conv]
        msgs = []
        for seq, op, role, text, target in sorted(rows, key=lambda r: (known(r[0]), r[1], (r[2] is not None, r[2] or ""), r[3])):
            at = len(msgs) - 1 if target is None else max((k for k, m in enumerate(msgs) if m[0] is not None and m[0] == target), default=-1)
            if op == "regenerate" and at >= 0:
                for m in msgs[at:]:
                    m[3] = False
                role = msgs[at][1] if role is None else role
            if op in ("message", "regenerate"):
                msgs.append([seq, role, text, True])
            elif at >= 0:
                msgs[at][2] = msgs[at][2] + text if op == "delta" else text
        out[conv] = [(m[1] or "", m[2]) for m in msgs if m[3]]
    return out


def test_chat_against_a_plain_fold(spark):
    rng, log = random.Random(4), []
    for conv in [*range(10), None]:
        for s in range(rng.randint(1, 40)):
            op = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", None])
            log.append((conv, rng.choice([s, s, s, rng.randint(0, 5), None]), op, rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None, f"t{s}"]), rng.choice([None, None, rng.randint(0, 40), rng.randint(0, 6)])))
    got = {}
    for r in sorted(chat.fold(spark.createDataFrame(log, "conv_id long, seq long, op string, role string, text string, target long").repartition(5)).collect(), key=lambda r: r.n):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: v for c, v in _folded(log).items() if v}


def test_chat_long_conversation_and_message(spark):
    n = 20_000
    part = F.when(F.col("id") % 2 == 0, "message").otherwise("delta")
    log = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), part.alias("op"), F.lit("assistant").alias("role"), F.lit("some text").alias("text"), F.lit(None).cast("long").alias("target"))
    d = chat.digest(chat.format_log(log)).first()
    assert d.n_turns == n // 2 and d.loss_chars == 9 * n
    one = log.withColumn("op", F.when(F.col("seq") == 0, "message").otherwise("delta"))
    d = chat.digest(chat.format_log(one)).first()
    assert d.n_turns == 1 and d.loss_sha256 == hashlib.sha256(b"some text" * n).hexdigest()


# ---------------------------------------------------------------- top k

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = [(k, rng.normal(size=8).round(3).tolist(), 0) for k in range(700)]
    vecs += [(700 + k, vecs[0][1], 0) for k in range(300)]  # a vector with many rows
    vecs += [(2000, None, 0), (2100, [1.0, None] * 4, 0), (2200, [float("nan")] * 8, 0), (2300, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (2400, [2.0, 1.0], 0), (100, vecs[100][1], 0)]
    e = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, block int")
    got = {}
    for r in topk.search(topk.quantize(e), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    queries = [x for x in ints if x[0] % 100 == 0]
    assert set(got) == {q for q, _ in queries}
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.search(topk.quantize(e.limit(0)), F.col("vec_id") % 100 == 0).count() == 0
    two = topk.search(topk.quantize(e.where("vec_id in (100, 101)")), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in two] == [(100, 101)]


def test_topk_of_huge_components_and_what_is_skipped(spark):
    rows = [(k, [float(k % 7), float(k % 5)]) for k in range(50)] + [(100, [1e300, -1e300]), (101, [-1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r for r in topk.search(topk.quantize(df), F.col("vec_id") % 100 == 0, 3).collect()}
    assert got[100, 1].score == 2**63 - 1 and len(got) == 6
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(k, (centres[k % 20] + rng.normal(size=8) * 0.1).tolist()) for k in range(2000)]
    df, report = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    found = topk.search(topk.quantize(df), F.col("vec_id") % 100 == 0, 10, report).collect()
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 2000, 100):
        s = x @ x[q]
        s[q] = -(1 << 62)
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(2000), -s))[:10].tolist()
    assert report["skipped"] > 5 * report["searched"]


def test_topk_in_many_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    one = sorted(topk.search(topk.quantize(df), F.col("vec_id") % 10 == 0, 5).collect())
    monkeypatch.setattr(topk, "CHUNK", 7)
    monkeypatch.setattr(topk, "HELD", 10)
    assert sorted(topk.search(topk.quantize(df), F.col("vec_id") % 10 == 0, 5).collect()) == one
