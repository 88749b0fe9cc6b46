"""Template decontamination against a plain version of its definition, and single questions with changed slots."""
import collections
import random
import re

from meshloom.llm import decontaminate as D

LITERALS, WINDOW = 4, 8


def slots_of(text):
    """(type, value) of every template word, word by word."""
    out, number = [], None
    for word in (text or "").split():
        core = word.strip(D.PUNCTUATION)
        if not core:
            continue
        low = core.lower()
        joined = re.fullmatch(r"([\d.,:/]*\d[\d.,:/]*)([a-z]+\d?)", low)
        if number is not None and (low in D.UNITS or low in D.NUMBER_WORDS):  # goes on with the amount before it
            number.append(low)
            number = None if low in D.UNITS else number
            continue
        number = None
        if re.fullmatch(r"[\d.,:/]*\d[\d.,:/]*", core):
            out.append(("n", number := [low]))
            if word.rstrip(".,;:!?)\"'").endswith("%"):
                number.append("percent")
                number = None
        elif joined and joined[2] in D.UNITS:
            out.append(("n", [joined[1], joined[2]]))
        elif low in D.NUMBER_WORDS or "-" in low and all(p in D.NUMBER_WORDS for p in low.split("-")):
            out.append(("n", number := low.split("-")))
        elif core.isalpha() and len(core) > 1 and core[0].isupper() and core[1:].islower():
            if out and out[-1][0] == "name":
                out[-1][1].append(low)
            else:
                out.append(("name", [low]))
        else:
            out.append(("w", [low]))
    return [(t, D.amount(list(v)) if t == "n" else " ".join(v)) for t, v in out]


def windows(slots):
    found = collections.defaultdict(list)
    for at in range(len(slots) - WINDOW + 1):
        part = slots[at : at + WINDOW]
        if sum(t == "w" for t, _ in part) >= LITERALS:
            found[tuple(v if t == "w" else t for t, v in part)].append(at)
    return found


def plain(docs, items, coverage=0.5, consistency=0.8):
    out = {}
    for d, text in docs.items():
        ds, dw = slots_of(text), windows(slots_of(text))
        for i, item in items.items():
            its = slots_of(item)
            iw = windows(its)
            n = sum(map(len, iw.values()))
            by = collections.defaultdict(list)
            for k in iw.keys() & dw.keys():
                for a in iw[k]:
                    for b in dw[k]:
                        by[b - a].append(a)
            offsets, runs = sorted(by), []
            for o in offsets:
                if runs and o - runs[-1][-1] <= n:
                    runs[-1].append(o)
                else:
                    runs.append([o])
            for of in [*([o] for o in offsets), *runs]:
                places = {a for o in of for a in by[o]}
                pairs = {(its[a + k], ds[a + o + k]) for o in of for a in by[o] for k in range(WINDOW) if its[a + k][0] != "w"}
                names = {p for p in pairs if p[0][0] == "name"}
                kept = min(len({a for a, _ in pairs}), len(pairs) - len(names) + len({b for _, b in names}))
                if n > 1 and len(places) >= coverage * n and (not pairs or kept / len(pairs) >= consistency):
                    out[d, i] = max(out.get((d, i), 0), len(places))
    return out


def run(spark, docs, items):
    table = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    return {(r.doc_id, r.item_id): r for r in D.contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()}


def test_against_the_plain_version(spark):
    rnd = random.Random(3)
    common = "the of a train leaves from with and sells how many are left after each day at most two three twenty kg km hours % 5 12 7kg 30% 3.5".split()
    names = "Anna Smith Paris Boston Peter Lee Oslo".split()
    rare = [f"word{a}{b}" for a in "abcdefghijk" for b in "mnopqr"]

    def sentence(n):
        return " ".join(rnd.choice(rnd.choice([common, names, rare, rare])) + rnd.choice(["", "", "", ",", ".", "?"]) for _ in range(n))

    items = {i: sentence(rnd.randint(14, 40)) for i in range(12)} | {50: None, 51: ""}
    docs = {90: None, 91: ""}
    for d in range(60):
        words = items[rnd.randrange(12)].split()
        for at in range(len(words)):
            if words[at].strip(",.?") in names and rnd.random() < 0.5:
                words[at] = rnd.choice(names)
            elif words[at][0].isdigit() and rnd.random() < 0.7:
                words[at] = str(rnd.randint(1, 99)) + rnd.choice(["", " kg", "kg", "%"])
            elif rnd.random() < 0.03:
                words[at] = rnd.choice(["", "extra extra", "other"])
        docs[d] = f"{sentence(20)} {' '.join(words[: rnd.randint(8, 60)])} {sentence(rnd.randint(0, 20))}"
    got = {k: r.n_windows for k, r in run(spark, docs, items).items() if r.item_windows > 1}
    want = plain(docs, items)
    assert got == want and 15 < len(got)


Q = "Anna Smith packs %s of apples into small baskets and then Peter carries all of these baskets to the market where people wait for him since the morning"


def test_values_of_slots(spark):
    docs = {1: Q % "5kg", 2: Q % "5 kg", 3: Q % "9 kg", 4: (Q % "5 kg").replace("Smith", "Jones"), 5: (Q % "5 kg").replace("Anna Smith", "Lena"), 6: (Q % "5 kg").replace("Anna Smith", "Peter")}
    got = run(spark, docs, {1: Q % "5 kg"})
    assert {d: r.n_changed for (d, _), r in got.items()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1}  # in the last, two names became one


def test_a_name_that_begins_a_sentence_is_a_slot(spark):
    item = "Clara has some boxes with pens. Clara gives half of those boxes to every child who has asked her for one of these"
    got = run(spark, {1: item.replace("Clara", "Maria"), 2: f"intro: {item}"}, {1: item})
    assert {d: (r.n_windows == r.item_windows, r.n_changed) for (d, _), r in got.items()} == {1: (True, 1), 2: (True, 0)}


def test_long_texts_repeated_rows_and_extra_columns(spark):
    long = " ".join(f"w{k % 9973}" for k in range(300_000))
    docs = spark.createDataFrame([(1, f"{long} {Q % '5 kg'}", 1, 2, "h"), (1, f"{long} {Q % '5 kg'}", 1, 2, "h"), (2, long, 1, 2, "h"), (None, Q % "5 kg", 1, 2, "h")], "doc_id long, text string, item_id long, pos long, h string")
    items = spark.createDataFrame([(7, Q % "5 kg", "x"), (7, Q % "5 kg", "x"), (None, "x", "y")], "item_id long, text string, slots string")
    got = D.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.begin) for r in got] == [(1, 7, 300_000)]
    assert D.contaminated(docs.limit(0), items).count() == 0 == D.contaminated(docs, items.limit(0)).count()


def test_every_text_of_an_item_is_searched(spark):
    one = "The keeper of the harbour counts every lantern twice before the evening boats arrive and writes 12 names into the ledger"
    two = "A slow machine in the northern mill turns raw wool into 30 metres of thread while the foreman reads the long report aloud"
    docs = spark.createDataFrame([(1, f"before {one} after"), (2, f"before {two} after"), (3, "nothing of this kind stands here at all, only other words"), (4, f"{one} and {two}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, one), (7, two), (8, two), (7, one)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == {(1, 7), (2, 7), (2, 8), (4, 7), (4, 8)}
