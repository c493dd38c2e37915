import re

from setforge.llm import decontamination as D

ITEM = "If Tom buys 12 apples for 3 dollars each and sells 4 apples to Anna, how much money does Tom have left after that trade?"


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_documents_hold_whole_items(spark):
    """Items that stand in a text word for word are found, and nothing else."""
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    words = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower()).split()
    want = set()
    for b in items:
        item = words(b.text)
        grams = {tuple(item[k : k + 8]) for k in range(max(1, len(item) - 7))}
        for d in docs:
            w = words(d.text)
            if len(grams & {tuple(w[k : k + 8]) for k in range(len(w) - 7)}) >= min(6, len(grams)):
                want.add((d.doc_id, b.item_id))
    assert {(r.doc_id, r.item_id) for r in D.op1_decontamination(spark, sf).collect()} == want
    assert want


def test_new_parameters(spark):
    new = "So then: if Bob buys 99 apples for 7 euros each and sells 5 apples to Maria, how much money does Bob have left after that trade? Fine."
    new = new.replace("if Bob", "If Bob").replace("then: ", "then. ")
    mixed = new.replace("does Bob", "does Zed").replace("sells 5 apples to Maria", "sells 5 apples to Bob").replace("7 euros", "7,5 dollars")
    docs, items = frames(spark, [(1, new), (2, mixed), (3, ITEM), (4, "no such thing at all in this text"), (5, ITEM[:40])], [(10, ITEM)])
    got = {r.doc_id: r for r in D.leaks(docs, items).collect()}
    assert set(got) == {1, 3}
    assert got[3].n_changed == 0 < got[1].n_changed <= got[1].n_slots
    assert {r.doc_id for r in D.clean(docs, items).collect()} == {2, 4, 5}


def test_short_items_and_shuffled_join(spark):
    docs, items = frames(spark, [(1, "well, a short one is here"), (2, "short one"), (3, "x " * 50 + ITEM)], [(1, "A short one, is here!"), (2, "too short"), (3, ITEM), (3, ITEM)])
    for p in (D.LeakParams(), D.LeakParams(broadcast_windows=0)):
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items, p).collect()} == {(1, 1), (3, 3)}


def test_odd_rows(spark, odd, clash):
    items = spark.createDataFrame([(1, "same text here and there"), (None, "word"), (2, None), (3, "")], "item_id long, text string")
    for docs in (odd, clash):
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()} == {(6, 1), (7, 1)}
        kept = D.clean(docs, items)
        assert kept.columns == docs.columns and kept.count() == 8
    assert D.leaks(odd.limit(0), items).count() == D.leaks(odd, items.limit(0)).count() == 0
    assert D.clean(odd, items.limit(0)).count() == 11


def test_what_stands_before_does_not_matter(spark):
    items = [(1, "What is the capital of the old kingdom?"), (2, "Tom has 3 apples. Tom eats 2. How many apples are left for lunch today?"), (3, "What year did Anna Smith leave the small town of Paris for good?")]
    docs = [(1, "- What is the capital of the old kingdom?"), (2, "Question\nWhat is the capital of the old kingdom?"), (3, "(What is the capital of the old kingdom?)"), (4, "so, Bob has 5 apples. Bob eats 4. How many apples are left for lunch today?")]
    docs += [(5, "Answer this What year did Anna Smith leave the small town of Paris for good?"), (6, "what is the capital of the new kingdom?")]
    got = {(r.doc_id, r.item_id) for r in D.leaks(*frames(spark, docs, items)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3)}


def test_slot_heavy_and_very_short_items(spark):
    items = [(1, "What is 12 + 7 * 3?"), (2, "Add 3.5 kg"), (3, "12/05/2001 13/06/2002 14/07/2003 15/08/2004 16/09/2005"), (4, "too short")]
    docs = [(1, "Here: what is 12 + 7 * 3? Easy."), (2, "What is 13 + 7 * 3?"), (3, "please add 3.5 kg now"), (4, "please add 35 kg now"), (5, "on 12/05/2001 13/06/2002 14/07/2003 15/08/2004 16/09/2005"), (6, "is it short")]
    got = {(r.doc_id, r.item_id): r for r in D.leaks(*frames(spark, docs, items)).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3)}
    assert all(r.n_hits == r.n_windows == 1 and r.n_changed == 0 for r in got.values())


def test_values_that_run_together(spark):
    """A changed value must stand for one value throughout, and different values must not become one."""
    item = "Tom has 30 red apples, Ann has 20 green pears and Joe has 10 blue plums, so how many pieces of fruit do Tom and Ann and Joe have in all?"
    other = item.replace("Tom", "Bob").replace("Ann", "Zoe").replace("Joe", "Kim").replace("30", "9").replace("20", "8").replace("10", "7")
    one = item.replace("Tom", "Bob").replace("Ann", "Bob").replace("Joe", "Bob").replace("30", "7").replace("20", "7").replace("10", "7")
    swapped = other.replace("do Bob and Zoe and Kim", "do Max and Eve and Lea")
    docs = [(1, other), (2, one), (3, swapped), (4, "Well. " + other.upper().lower()), (5, item.upper()), (6, item.lower())]
    got = {r.doc_id: r for r in D.leaks(*frames(spark, docs, [(1, item)])).collect()}
    assert set(got) == {1, 5, 6}
    assert got[1].n_changed > 0 and got[1].n_slots >= got[1].n_changed


def test_renamed_opening(spark):
    items = [(1, "Tom has 3 red apples and 5 green pears today"), (2, "Tom has 3 red apples and 5 green pears today. Then Ann gets 2 kg of ripe plums for lunch.")]
    docs = [(1, "Bob has 9 red apples and 4 green pears today"), (2, "Bob has 9 red apples and 4 green pears today. Then Eve gets 7 pounds of ripe plums for lunch."), (3, "they have 9 red apples and 4 green pears")]
    assert {(r.doc_id, r.item_id) for r in D.leaks(*frames(spark, docs, items)).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_words_of_both_readings_agree(spark):
    """Slot values stand at the places of their placeholders, whatever the text."""
    import random

    rng = random.Random(1)
    bits = ["Tom", "O'Neil", "3.5", "12:30", "km", " ", " ", " ", "-", "%", "$", "a", "É", "é", "x8", "\u0001", "\u0003", "’", ".", "\n", "5", "Hz", "m½", "ß", "İ", "cents", "\U0001d400"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = D._plain(docs.text)
    marks = "[" + D.NAME + "-" + D.UNIT + "]"
    for r in docs.select("text", D.template_words(t).alias("w"), D.slot_words(t).alias("s")).collect():
        words = [w for w in r.w if w]
        assert len(words) == len(r.s), r.text
        assert all((re.findall(marks, a) == re.findall(marks, b)) and (re.search(marks, a) or a == b) for a, b in zip(words, r.s, strict=True)), r.text
