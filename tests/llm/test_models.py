"""The learned operators against plain versions of what they compute: noisy-or, additive tables, decision lists."""
import math
import random

import numpy as np
import pytest

from meshloom.llm import quality_gam, quality_rules, toxicity

random.seed(8)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def toxic(spark):
    rows = []
    for k in range(500):
        s = [prose(7) + random.choice(".!?") for _ in range(random.randint(1, 9))]
        if k % 3 == 0:
            s[len(s) // 2] = f"{prose(2)} {random.choice(['Vileword,', 'nastythings', 'NASTYTHING'])} {prose(3)}."
        rows.append((k, int(k % 3 == 0), random.choice([" ", "\n"]).join(s)))
    return rows


def test_scores_are_noisy_or_of_the_sentences(spark, toxic):
    model = toxicity.fit([{"y": y, "text": t} for _, y, t in toxic], rounds=40)
    texts = [t for _, _, t in toxic[:60]] + ["", "\n\n", "one", "Vileword! Vileword!\nok.", "vileword " * 40_000]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        text, rest = texts[r.doc_id], 1.0
        spans = toxicity.sentences(text)
        for a, b in spans:
            z = model.bias
            for word in set(text[a:b].split()):
                core = word.strip(toxicity._STRIP).lower()
                z += model.weights.get("w:" + core, 0.0) + sum(model.weights.get("p:" + core[:k], 0.0) for k in toxicity.PREFIXES if len(core) > k)
            rest *= 1 - 1 / (1 + math.exp(-z))
        if not spans:
            rest = 1 - 1 / (1 + math.exp(-model.bias))
        assert r.score == pytest.approx(1 - rest, abs=1e-9) and r.n_sentences == len(spans)
        assert all(text[s.begin : s.end] in [text[a:b] for a, b in spans] and s.score >= 0.5 for s in r.offending)


def test_learning_in_spark_and_in_one_process_agree(spark, toxic):
    rows = spark.createDataFrame(toxic, "doc_id long, y int, text string").repartition(5)
    a = toxicity.learn(rows)
    b = toxicity.fit([{"y": r.y, "text": r.text} for r in toxicity.in_order(rows)])
    assert a.weights.keys() == b.weights.keys() and a.bias == pytest.approx(b.bias) and all(a.weights[k] == pytest.approx(b.weights[k], abs=1e-9) for k in b.weights)
    x, y = quality_gam.learn(rows), quality_gam.fit_rows(toxicity.in_order(rows))
    assert x.base == y.base and x.pairs == y.pairs and all(np.allclose(p, q) for p, q in zip(x.tables, y.tables))


def test_labels_with_nulls_ties_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"text {k}", 1, 0, 9) for k in (2, 3, 5, 6)] + [(2, "text 2b", 1, 0, 9), (None, "x", 1, 0, 9)], "doc_id long, text string, toxic int, y int, quality int")
    labels = spark.createDataFrame([(2, 1, "l"), (2, 0, "l"), (3, None, "l"), (5, 0, "l"), (5, 0, "l"), (99, 1, "l"), (None, 1, "l")], "doc_id long, toxic int, text string")
    got = {r.doc_id: (r.y, r.text) for r in toxicity.sample(docs, labels, "text", "toxic", 10, 10)}
    inside = [k for k in (2, 5) if __import__("zlib").crc32(str(k).encode()) % 3 != 1]
    assert got == {k: {2: (1, "text 2b"), 5: (0, "text 5")}[k] for k in inside}
    scored = toxicity.score(docs, toxicity.Model({}, -1.0)).collect()
    assert len(scored) == 6 and len({round(r.score, 12) for r in scored}) == 1


def test_tables_add_up_bin_by_bin():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 4)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = quality_gam.fit(x, y, rounds=15, pair_rounds=15)
    want = []
    for row in x[:200]:
        z = m.base
        for k in range(4):
            z += m.tables[k][sum(row[k] >= e for e in m.edges[k])]
        for (a, b), t in zip(m.pairs, m.pair_tables):
            z += t[sum(row[a] >= e for e in m.pair_edges[a]), sum(row[b] >= e for e in m.pair_edges[b])]
        want.append(z)
    assert np.allclose(m.logit(x[:200]), want)
    assert (0, 1) in m.pairs and ((m.logit(x) > 0) == y).mean() > 0.95  # an interaction that no single table can hold


def test_long_and_repeated_texts_score_alike(spark):
    long = prose(200_000)
    docs = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "")], "doc_id long, text string")
    m = quality_gam.fit(quality_gam.features(np.frombuffer(b"abcabc", np.uint8), np.array([0, 3, 6])), np.array([0.0, 1.0]))
    got = [(r.doc_id, r.score) for r in quality_gam.score(docs, m).collect()]
    assert len(got) == 4 and len({s for d, s in got if d == 1}) == 1 and len({s for d, s in got if d > 1}) == 1


def plain_list(rows, cuts, max_rules=8, max_conditions=3, precision=0.95, cover=8):
    """Sequential covering row by row: grow by FOIL's gain on two parts, prune on the third, stop below the precision."""
    def holds(r, conditions):
        return all((r[f] >= v) == up for f, up, v in conditions)

    def share(rs):
        return sum(r["poor"] for r in rs), sum(not r["poor"] for r in rs)

    found, left = [], list(rows)
    while len(found) < max_rules:
        rule = []
        while len(rule) < max_conditions:
            grown = [r for r in left if r["part"] != 2 and holds(r, rule)]
            p0, n0 = share(grown)
            if p0 < cover or n0 == 0:
                break
            best = None
            for f, values in cuts.items():
                for v in values:
                    for up in (False, True):
                        p, n = share([r for r in grown if (r[f] >= v) == up])
                        if p >= cover:
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > (best[0] if best else 1e-9):
                                best = gain, (f, up, v)
            if best is None or best[1] in rule:
                break
            rule.append(best[1])
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = share([r for r in left if r["part"] == 2 and holds(r, rule[:k])])
            worth.append(((p - n) / max(1, p + n), p, k))
        rule = rule[: max(worth)[2]]
        p, n = share([r for r in left if holds(r, rule)])
        vp, vn = share([r for r in left if r["part"] == 2 and holds(r, rule)])
        if p < cover or p < precision * (p + n) or vp < precision * (vp + vn):
            break
        found.append(rule)
        left = [r for r in left if not holds(r, rule)]
    return found


def test_decision_lists_equal_the_plain_version_and_decide_kept(spark):
    rnd, rows = random.Random(1), []
    for k in range(900):
        kind = k % 4
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(60, 200))]
        if kind == 0:
            words = [w + rnd.choice(["#$%", "", "**"]) for w in words]
        if kind == 1:
            words = [rnd.choice(WORDS[:9]) for _ in words]
        rows.append((k, "\n".join(" ".join(words[at : at + 12]) for at in range(0, len(words), 12)), int(kind > 1 if rnd.random() > 0.004 else kind < 2)))
    rows += [(k, "too short", 0) for k in range(900, 910)] + [(950, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality")
    verdict, rules = quality_rules.apply_rules(table.select("doc_id", "text"), labels, n_cuts=24)
    got = verdict.join(labels, "doc_id").selectExpr("doc_id", "base_failed", "kept", "rule", "quality = 0 as poor", "crc32(cast(cast(doc_id as string) as binary)) % 3 as fold", "pmod(xxhash64(doc_id, 'part'), 3) as part", *[f"cast(if(base_failed, null, {e}) as double) as {n}" for n, e in quality_rules.FEATURES.items()]).collect()
    known = [r.asDict() for r in got if not r.base_failed and r.fold != 1]
    cuts = {}
    for n in quality_rules.FEATURES:
        values = sorted(r[n] for r in known)
        cuts[n] = sorted({values[math.ceil(k / 24 * len(values)) - 1] for k in range(1, 24)})
    want = plain_list(known, cuts)
    assert [[(c.feature, c.at_least, c.value) for c in r.conditions] for r in rules.rules] == want and want
    for r in got:
        first = 0 if r.base_failed else next((k for k, rule in enumerate(want, 1) if all((r[f] >= v) == up for f, up, v in rule)), 0)
        assert r.kept == (not r.base_failed and first == 0) and (r.base_failed or r.rule == first)
