import random

import numpy as np

from lectern.llm import copies
from lectern.llm.copies import SIZE, Points, Signer, expand, near_copies, word_set


def made(seed, n=400):
    r = random.Random(seed)
    common = [f"common{i}" for i in range(60)]
    say = lambda: [r.choice(common) if r.random() < 0.5 else f"rare{r.randrange(20000)}" for _ in range(r.randrange(20, 60))]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = list(r.choice(rows)[1].split())
            for _ in range(r.randrange(0, 8)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"new{r.randrange(9999)}"], [w[k], f"new{r.randrange(9999)}"]])
            if r.random() < 0.2:
                r.shuffle(w)
        else:
            w = say()
        rows.append((i, " ".join(w or ["x"])))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(60)]  # a hot group of copies
    return rows + [(5000, None), (5001, ""), (5002, "short"), (5003, "?" * 100), (5004, " ".join(f"long{i}" for i in range(20_000)))]


def brute(rows, least):
    s = [(i, set(word_set(t))) for i, t in rows if t and len(t) >= 80 and word_set(t)]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(s) for j, b in s[k + 1 :] if len(a & b) >= least * len(a | b) - 1e-9}


def test_pairs_against_brute_force(spark):
    rows = made(1)
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "pid long, text string, key string")
    links, members = near_copies(df, "pid", "text", 0.7)
    got = [(r["a"], r["b"]) for r in expand(links, members).collect()]
    want = brute(rows, 0.7)
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(set(got) & want) >= 0.99 * len(want)
    ids = [r["id"] for r in members.collect()]
    assert len(ids) == len(set(ids)) and 5004 in ids and 5003 not in ids


def test_edited_family_of_a_third_of_the_rows(spark):
    r = random.Random(5)
    base, rows = [f"family{i}" for i in range(60)], []
    for i in range(120):
        rows.append((i, " ".join(base + [f"edit{i}x{k}" for k in range(r.randrange(8, 13))])))
    rows += [(i, " ".join(f"rare{r.randrange(20000)}" for _ in range(40))) for i in range(1000, 1240)]
    links, members = near_copies(spark.createDataFrame(rows, "pid long, text string"), "pid", "text", 0.7)
    got, want = {(p["a"], p["b"]) for p in expand(links, members).collect()}, brute(rows, 0.7)
    assert not got - want and len(want) > 3000 and len(got) >= 0.99 * len(want)


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    rows = made(2, 200)
    df = spark.createDataFrame(rows, "pid long, text string")
    want = {(r["a"], r["b"]) for r in near_copies(df, "pid", "text")[0].collect()}
    monkeypatch.setattr(copies, "BLOCK_ROWS", 2)
    got = {(r["a"], r["b"]) for r in near_copies(df, "pid", "text")[0].collect()}
    assert got == want and want


def test_hot_keys_of_a_small_collection_are_found(spark, monkeypatch):
    rows = made(2, 100) + [(7000 + i, " ".join([f"family{k}" for k in range(60)] + [f"edit{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, text string")
    found, links, search = [], [], copies.hot_keys
    monkeypatch.setattr(copies, "hot_keys", lambda texts, n: found.append(search(texts, n)) or found[-1])
    for rows_in_block in (20_000, 50):
        monkeypatch.setattr(copies, "BLOCK_ROWS", rows_in_block)
        links.append({(r["a"], r["b"]) for r in near_copies(df, "pid", "text")[0].collect()})
    assert links[0] == links[1] and links[0]
    assert len(found) == 1 and max(found[0][1]) >= 5  # 300 records that share most keys, in blocks of 50


def test_agreement_is_weighted_jaccard():
    levels = {f"w{i}": 1 + i % 16 for i in range(64)}
    r = random.Random(3)
    near, n = [], 60
    for _ in range(n):
        a, b = (r.sample(sorted(levels), 30) for _ in range(2))
        weight = lambda s: sum(levels[w] for w in s)
        want = weight(set(a) & set(b)) / weight(set(a) | set(b))
        sig = Signer({f"{w}": v for w, v in levels.items()}).sign([sorted(a), sorted(b)])
        near.append((sig[0] == sig[1]).mean() - want)
    assert abs(np.mean(near)) < 4 / np.sqrt(n * SIZE) and np.max(np.abs(near)) < 0.25


def test_points_have_the_rate_of_the_weight():
    h = np.arange(4000, dtype=np.uint64)
    for level in (1, 5, 16):
        p = Points().first(h, np.full(4000, level))
        assert abs(p.mean() * level - 1) < 0.02
    low, high = Points().first(h, np.full(4000, 3)), Points().first(h, np.full(4000, 9))
    assert (high <= low).all() and abs((high == low).mean() - 3 / 9) < 0.02


def test_empty(spark):
    links, members = near_copies(spark.createDataFrame([], "pid long, text string"), "pid", "text")
    assert links.count() == 0 and members.count() == 0 and expand(links, members).count() == 0


def test_hot_keys_are_found_in_a_share_of_the_records(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK_ROWS", 1000)
    monkeypatch.setattr(copies, "SEEN", 250)
    rows = [(i, " ".join(f"family{k}" for k in range(60))) for i in range(3000)] + [(9000 + i, f"one{i} two{i} three{i}") for i in range(500)]
    keys, parts = copies.hot_keys(spark.createDataFrame(rows, "id long, text string"), len(rows))
    assert len(keys) == copies.BANDS and set(parts) <= {3, 4} and list(keys) == sorted(keys)


def test_texts_of_common_words_are_found():
    """Records from one template: fourteen of sixteen words are in nearly every record."""
    r = random.Random(9)
    signer, needed, hits = Signer({}), copies.sift_at(0.7), 0
    for k in range(200):
        shared = [f"template{i}" for i in range(14)]
        sig = signer.sign([[*shared, f"a{k}", f"b{k}"][: 14 + r.randrange(1, 3)], [*shared, f"c{k}"]])
        keys = copies.band_keys(sig)
        agree = ((sig[0] ^ sig[1]) & np.uint64(3) == 0).sum()
        hits += bool((keys[0] == keys[1]).any() and agree >= needed)
    assert hits >= 198


def test_the_sift_follows_the_similarity():
    assert copies.sift_at(0.7) < copies.sift_at(0.8) < copies.sift_at(0.9)
    p, needed = 0.7 + 0.3 / 4, copies.sift_at(0.7)
    lost = sum(np.exp(sum(np.log((SIZE - i) / (i + 1)) for i in range(k)) + k * np.log(p) + (SIZE - k) * np.log(1 - p)) for k in range(needed))
    assert lost < 1e-6
    assert copies.BANDS * 10**10 / copies.block_rows(10**10) <= copies.HOT_KEYS * 1.01
