import random

from helixmart.llm import decontaminate as D

SCHEMA = "doc_id long, text string, key string"
ITEM = ("Anna has 12 apples and gives 5 apples to her old friend Bob before lunch. After lunch Anna buys 7 kg more, so how many "
        "apples does Anna have at the end of the day?")
OTHER = "what is the mean of the lengths of all rivers that flow through the northern part of the country in spring"


def found(spark, texts, items=((1, ITEM), (2, OTHER))):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}


def noise(rng, n):
    return " ".join(f"v{rng.randrange(3000)}x" for _ in range(n))


def test_exact_and_reparameterised_items(spark):
    rng = random.Random(1)
    changed = ITEM.replace("Anna", "Carla").replace("Bob", "Dave").replace("12", "31").replace("7 kg", "9 lb").replace("5", "eight")
    mixed = ITEM.replace("Anna has", "Carla has").replace("does Anna", "does Emil").replace("lunch Anna", "lunch Fred")
    texts = [noise(rng, 300) + " " + ITEM + " " + noise(rng, 50), changed, noise(rng, 20) + "\n" + OTHER.replace(" ", "  "), noise(rng, 500),
             None, "", " ".join(ITEM.split()[:6]), " ".join(OTHER.split()[2:16]), mixed, ITEM + " " + OTHER, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    got = found(spark, texts)
    assert {(0, 1), (1, 1), (2, 2), (7, 2), (9, 1), (9, 2)} <= set(got) <= {(0, 1), (1, 1), (2, 2), (7, 2), (8, 1), (9, 1), (9, 2)}
    assert got[0, 1].same_slots and not got[1, 1].same_slots
    assert got[0, 1].covered_words == got[0, 1].item_words and got[1, 1].covered_words == got[1, 1].item_words
    if (8, 1) in got:  # contradictory names cost the windows that hold them
        assert got[8, 1].covered_words < got[0, 1].covered_words


def test_slots_must_agree():
    item = [{"at": i, "item_at": i, "slots": ["", "x" if i < 3 else "y"], "item_slots": ["", "a"]} for i in range(6)]
    assert D._agreeing(item, 2)[1] == 3


def test_repeated_sentences_are_covered_whole(spark):
    """An item that repeats one template sentence 20 times has 20 diagonals at each start."""
    rng = random.Random(2)
    item = " ".join(f"then box {rng.randrange(1000)} goes to room {rng.randrange(1000)} today." for _ in range(20))
    changed = " ".join(str(int(w) + 5000) if w.isdigit() else w for w in item.split())
    longer = item.replace("today. then", "today. and then", 1)
    scattered = " ".join(f"{noise(rng, 30)} then box {i} goes to room {i + 1}" for i in range(3))
    got = found(spark, [noise(rng, 40) + " " + item + " " + noise(rng, 40), changed, longer, scattered], [(1, item)])
    assert set(got) == {(0, 1), (1, 1), (2, 1)}
    assert got[0, 1].same_slots and not got[1, 1].same_slots
    assert got[0, 1].covered_words == got[1, 1].covered_words == got[0, 1].item_words == 160
    short = "plus 1 plus 2 plus 3 plus 4 plus 5 plus 6 plus 7 plus 8 plus 9 plus 10 plus 11 plus"
    assert found(spark, [short], [(1, short)])[0, 1].same_slots  # diagonals two words apart


def test_equal_templates_and_odd_items(spark):
    items = [(5, OTHER), (4, OTHER), (None, OTHER), (6, None), (7, ""), (8, "too short"), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13")]
    assert set(found(spark, [OTHER, "1 2 3 4 5 6 7 8 9 10 11 12 13", "1 2 3 4 5 6 7 8 9 10 11 12 14"], items)) == {(0, 4), (1, 9)}


def test_every_item_with_words_is_found_verbatim(spark):
    items = [(1, "Who Wrote Hamlet?"), (2, "What is 12 times 7 plus 30 minus 4"), (3, "Alan Turing Met Kurt Gödel In Vienna Before Paris And Rome"),
             (4, "水的沸点是多少？"), (5, "the river near the Old Town Hall Of Prague Has 31 bridges"), (6, "In 1912 Anna Lee of 31 Elm Road"),
             (7, "add 3 apples and 3 pears to the big box today"), (8, "add 3 apples and 5 pears to the big box today"), (9, "photosynthesis")]
    rng = random.Random(3)
    texts = [f"{noise(rng, 60)} {t} {noise(rng, 10)}" for _, t in items] + ["请问水的沸点是多少？谢谢", "wrote hamlet", "水的沸点是", "31 elm road of anna lee in 1912"]
    got = found(spark, texts, items)
    # Items 7 and 8 have one template and count as 7.
    assert set(got) == {(i, n) for i, (n, _) in enumerate(items) if n != 8} | {(7, 7), (9, 4)}
    assert got[0, 1].same_slots and got[0, 1].covered_words == got[0, 1].item_words == 3


def test_range_hashes_do_not_depend_on_the_place():
    h = D.word_hashes([b"a", b"b", b"c", b"d", b"a", b"b", b"c", b"e"])
    for n in (1, 2, 3):
        at = D.range_hashes(h, D.np.array([0, 4, 1]), n)
        assert at[0] == at[1] == D.range_hashes(h[4:], D.np.array([0]), n)[0] and at[0] != at[2]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).count() == 0
    assert D.contaminated(spark.createDataFrame([(1, OTHER, "k")], SCHEMA), bench).count() == 0


def test_op5_over_the_table(spark, tiny):
    """Whatever holds a whole item word for word is found, and nothing that shares less than 7 words with any."""
    docs = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    strip = lambda t: D.Template(t).names()
    windows = {tuple(w[i : i + 7]) for w in map(strip, bench.values()) for i in range(len(w) - 6)}
    whole = {d for d, t in docs.items() if any(" ".join(b.split()) in " ".join(t.split()) for b in bench.values())}
    near = {d for d, t in docs.items() for w in [strip(t)] if any(tuple(w[i : i + 7]) in windows for i in range(len(w) - 6))}
    got = {r.doc_id for r in D.op5_decontaminate(spark, tiny).collect()}
    assert whole and whole <= got <= near


def brute_windows(text, width):
    """(position, names, slots) of the windows with enough literal words, by plain loops."""
    pairs = [p for p in map(D._template_of, (text or "").split()) if p[0]]
    return [(i, tuple(p[0] for p in pairs[i : i + width]), [p[1] or "" for p in pairs[i : i + width]]) for i in range(len(pairs) - width + 1)
            if sum(p[1] is None for p in pairs[i : i + width]) >= D.LITERALS]


def test_windows_against_plain_loops():
    rng = random.Random(6)
    words = ["The", "the", "12", "12%", "kg", "seven", "...", "Anna", "box,", "(room)", "goes", "é", "水"]
    for n in (0, 3, 7, 60):
        text = " ".join(rng.choice(words) for _ in range(n))
        t = D.Template(text)
        h, good = t.windows(D.WIDTH)
        at = D.np.flatnonzero(good).tolist()
        want = brute_windows(text, D.WIDTH)
        assert [(i, t.values(i, D.WIDTH)) for i in at] == [(i, s) for i, _, s in want]
        by_hash = {}
        for i, names, _ in want:
            assert by_hash.setdefault(int(h[i]), names) == names
        assert len(by_hash) == len({names for _, names, _ in want})


def test_documents_against_plain_search(spark):
    """Every document meets every item in a second, slow form of the rule: windows by dictionary, then the same places."""
    rng = random.Random(12)
    items = [(i, f"{noise(rng, 14)} {rng.randrange(90)} kg of {noise(rng, 3)} for Anna {i}") for i in range(6)]
    texts = [noise(rng, 30) for _ in range(10)]
    for i, text in items:
        changed = " ".join(str(int(w) + 7) if w.isdigit() else w for w in text.split())
        texts += [f"{noise(rng, 9)} {text} {noise(rng, 5)}", f"{noise(rng, 4)} {changed}", " ".join(text.split()[:9]), " ".join(text.split()[:15])]
    want = set()
    for d, text in enumerate(texts):
        mine = brute_windows(text, D.WIDTH)
        for item, body in items:
            own = brute_windows(body, D.WIDTH)
            hits = [{"at": a, "item_at": b, "slots": s, "item_slots": z} for a, names, s in mine for b, other, z in own if names == other]
            reach = len({b + i for b, _, _ in own for i in range(D.WIDTH)})
            if hits and D._agreeing(hits, D.WIDTH)[0] >= min(D.COVERED, reach):
                want.add((d, item))
    assert len(want) >= 12
    assert set(found(spark, texts, items)) == want
