import random

from lectern.llm.leaks import RUN, ItemIndex, find_leaks, words

VOCABULARY = [f"w{i}" for i in range(40)]


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words(text)
        grams = {tuple(w[k : k + RUN]) for k in range(len(w) - RUN + 1)}
        for i, t in items:
            x = words(t)
            if any(tuple(x[k : k + RUN]) in grams for k in range(len(x) - RUN + 1)):
                out.add((d, i))
    return out


def made(seed):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    items = [(i, say(r.randrange(5, 50)) + ". " + say(6) + "?") for i in range(30)] + [(40, None), (41, ""), (42, say(8))]
    items += [(50, items[0][1])]
    docs = []
    for d in range(120):
        text = say(r.randrange(200))
        if r.random() < 0.5:
            w = words(items[r.randrange(30)][1])
            k = r.randrange(max(1, len(w) - RUN))
            text += ", " + " ".join(w[k : k + r.choice([11, 12, 20])]).upper() + "; " + say(30)
        docs.append((d, text))
    return docs + [(900, None), (901, ""), (902, "a b")], items


def test_all_leaks_and_only_leaks(spark):
    docs, items = made(3)
    got = find_leaks(spark.createDataFrame(docs + docs[:5], "doc_id long, text string"), spark.createDataFrame([(*i, "k") for i in items], "item_id long, text string, kind string")).collect()
    found = [(r["doc_id"], r["item_id"]) for r in got]
    assert len(found) == len(set(found)) and set(found) == brute(docs, [i for i in items if i[1]])
    assert all(r["longest_run"] >= RUN and 0 < r["item_share"] <= 1 and 0 <= r["question_share"] <= 1 for r in got)


def test_wand_gives_what_scoring_all_gives():
    docs, items = made(4)
    ix = ItemIndex([i for i in items if i[1]])
    r = random.Random(1)
    for _ in range(300):
        terms = set(r.sample(VOCABULARY, r.randrange(1, 12))) & ix.postings.keys()
        score: dict = {}
        for t in terms:
            for i, v in ix.postings[t]:
                score[i] = score.get(i, 0) + v
        assert sorted(ix.above(terms)) == sorted(i for i, s in score.items() if s >= 1 - 1e-9)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, i).count() == 0


def test_an_answer_that_leaks_without_its_question(spark):
    rest = " ".join(f"answer{i}" for i in range(30))
    item = f"{rest}. What does the prover send in the very last round of this long protocol run?"
    docs = spark.createDataFrame([(1, f"before {rest} after"), (2, f"before {item} after"), (3, "What does the prover send in the very last round of this long protocol run?")], "doc_id long, text string")
    got = {r["doc_id"]: (r["question_share"], round(r["item_share"], 3)) for r in find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (0.0, round(30 / 45, 3)), 2: (1.0, 1.0), 3: (1.0, round(15 / 45, 3))}


def test_the_index_is_small():
    import pickle
    import random

    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(30_000)}" for _ in range(800))) for i in range(200)]
    assert len(pickle.dumps(ItemIndex(items))) < 12 * sum(len(t) for _, t in items)
