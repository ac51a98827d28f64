"""Benchmark leaks: verbatim, re-parameterised, and none in clean text."""

import random

from tabscope.llm import decontam
from tests.llm import corpus

ITEM = "A train leaves Paris at 9:30 with 120 passengers and reaches Lyon after 40 km. How many minutes does the driver Anna ride with 120 passengers?"


def run(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r for r in found.collect()}


def test_leaks(spark):
    rng = random.Random(8)
    items = [(k, corpus.prose(rng, 30)) for k in range(20)] + [(50, ITEM), (51, "one two"), (52, None), (53, "When does the red bus stop?"), (None, ITEM)]
    changed = ITEM.replace("Paris", "Berlin").replace("9:30", "7:15").replace("120", "95").replace("40 km", "12 miles").replace("Lyon", "Bonn").replace("Anna", "Ida")
    # the same value of the item turns into many values: not the same question
    broken = " ".join(ITEM.replace("120", f"{k}5", 1).replace("120", f"{k}7", 1).replace("Paris", f"City{k}") for k in range(1))
    docs = [(k, corpus.prose(rng, 100)) for k in range(40)]
    docs += [(100 + k, f"{corpus.prose(rng, 40)}\n{items[k][1]}\n{corpus.prose(rng, 40)}") for k in range(20)]
    docs += [(200, "x " + ITEM), (201, "Intro text here. " + changed), (202, broken), (203, ITEM.lower()), (204, None), (205, ""), (206, "We ask: When does the red bus stop? Soon.")]
    docs += [(None, ITEM), (300, f"{ITEM} {ITEM}"), (301, " ".join(ITEM.split()[:8]))]
    found = run(spark, docs, items)
    assert {(100 + k, k) for k in range(20)} | {(200, 50), (201, 50), (300, 50), (206, 53)} <= set(found)
    assert not [d for d, _ in found if d < 100 or d in (204, 205, 301)]
    assert (found[200, 50]["exact"], found[201, 50]["exact"]) == (True, False)
    assert found[201, 50]["consistent"] == 1


def test_slots_must_be_consistent(spark):
    words = "alpha beta gamma delta epsilon"
    item = " ".join(f"{words} 7 {words} 7 {words} 7".split())
    docs = [(1, item.replace("7", "3")), (2, item.replace("7", "1", 1).replace("7", "2", 1).replace("7", "3", 1))]
    assert set(run(spark, docs, [(1, item)])) == {(1, 1)}


def test_templates():
    _, kinds, first = decontam.tokens_of(["Two cats. The cat Tom ate 3.5 kg of fish\nNow Ann", None, "***"])
    n, name, unit, lit = decontam.NUMBER, decontam.NAME, decontam.UNIT, decontam.LITERAL
    assert kinds.tolist() == [n, lit, lit, lit, name, lit, n, unit, lit, lit, lit, name]
    assert first.tolist() == [0, 12, 12, 12]


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]) == {} == run(spark, [(1, ITEM)], [])


def test_every_place_is_judged(spark):
    """A copy is found although a variant with other values comes right before or after it."""
    item = "alpha beta gamma delta epsilon 7 zeta eta theta iota kappa 9 lambda mu nu xi omicron 11 pi rho"
    variant = item.replace(" 7 ", " 70 ").replace(" 9 ", " 90 ").replace(" 11 ", " 110 ")
    assert set(run(spark, [(1, f"{item} {variant}"), (2, f"{variant} {item}")], [(1, item)])) == {(1, 1), (2, 1)}
    twice = "red box 7 with blue lid and green box 7 with brown lid and black box 7 with white lid"
    spoiled = twice.replace("7", "1", 1).replace("7", "2", 1).replace("7", "3", 1)
    found = run(spark, [(1, f"{spoiled} {twice}")], [(1, twice)])
    assert found[1, 1]["exact"]


def test_short_and_number_heavy_items(spark):
    """Items that templates can't tell are found verbatim, in any case and punctuation, and nowhere else."""
    items = [(1, "What is 2 + 2?"), (2, "Name the capital."), (3, "12 + 7 = 19 so 3 * 4 = 12 yes"), (4, "Tom ran 5 km in 20 minutes, then 3 km in 10 minutes"), (5, "東京はどこですか"), (6, "***"), (7, "")]
    docs = [(10 * k + 1, f"Some text before. {t} And after it.") for k, t in items]
    docs += [(10 * k + 2, f"before {t.upper()} after") for k, t in items] + [(10 * k + 3, f"x {t.lower()} y") for k, t in items]
    docs += [(200, "What is 2 plus 3?"), (201, "Name the big capital."), (202, "12 7 19 so 3 4 13 yes")]
    found = run(spark, docs, items)
    assert set(found) == {(10 * k + n, k) for k in (1, 2, 3, 4, 5) for n in (1, 2, 3)}


def test_one_template_many_items(spark):
    """Items of one template are one class: a row for each document, and the item it holds word for word."""
    text = "a farmer has {} red hens and sells {} of them at the market for {} coins so how many hens are left"
    items = [(k, text.format(k, 2 * k, 3 * k + 100)) for k in range(1, 61)]
    docs = [(1000 + k, f"Intro. {text.format(k, 2 * k, 3 * k + 100)}") for k in range(1, 61)] + [(5000, text.format(7777, 8888, 9999))]
    found = run(spark, docs, items)
    assert set(found) == {(1000 + k, k) for k in range(1, 61)} | {(5000, 1)}
    assert all(r["template_id"] == 1 and r["exact"] == (d < 5000) for (d, _), r in found.items())


def test_consistency_goes_both_ways(spark):
    words = "alpha beta gamma delta epsilon"
    item = f"{words} 7 {words} 8 {words} 9"
    docs = [(1, item.replace("7", "3").replace("8", "4").replace("9", "5")), (2, f"{words} 3 {words} 3 {words} 3")]
    assert set(run(spark, docs, [(1, item)])) == {(1, 1)}


def plain_tokens(text):
    """Tokens of a text by plain Python: folded letters and digits, and the kind of each."""
    out, opens = [], True
    for line in (text or "").split("\n"):
        opens = True
        for word in line.split():
            own = "".join(c for c in word if c.isalnum())
            if own:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in own)
                kind = "number" if any(c.isdigit() for c in own) or low in decontam.NUMBER_WORDS.split() else "unit" if low in decontam.UNIT_WORDS.split() else "name" if own[0].isupper() and not opens else ""
                out.append((low, kind))
            opens = word[-1] in ".!?:"
    return out


def brute(docs, items):
    """Documents that hold an item: all tokens verbatim, or a stretch as long with one consistent value for another."""
    out = set()
    for d, text in docs:
        own = plain_tokens(text)
        for k, asked in items:
            want = plain_tokens(asked)
            for at in range(len(own) - len(want) + 1) if want else ():
                here = own[at : at + len(want)]
                same = [x[0] for x in here] == [x[0] for x in want]
                fits = all(x[1] == y[1] and (x[1] or x[0] == y[0]) for x, y in zip(here, want, strict=True))
                pairs = {(x[0], y[0]) for x, y in zip(here, want, strict=True) if x[1]}
                one_to_one = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
                if same or (fits and one_to_one):
                    out.add((d, k))
    return out


def test_against_brute_force(spark):
    """Whole items, as they are or with other values, are found exactly where plain Python finds them."""
    rng = random.Random(17)
    names, units = "Anna Tom Maria Felix Paul".split(), "km miles kg hours days".split()

    def question(n):
        words = corpus.prose(rng, n).lower().rstrip(".").split()
        for k in range(3, n, 5):
            words[k] = rng.choice([str(rng.randint(2, 99)), rng.choice(names), rng.choice(units)])
        return " ".join(words)

    items = [(k, question(rng.choice([6, 12, 20, 30]))) for k in range(40)]
    docs = []
    for k, text in items:
        fresh = {w: {"n": str(1000 + i), "u": rng.choice(units)}["n"] for i, w in enumerate(sorted({w for w in text.split() if w.isdigit()}))}
        docs += [(10 * k, f"{corpus.prose(rng, 30)} {text} {corpus.prose(rng, 30)}"), (10 * k + 1, f"Start. {' '.join(fresh.get(w, w) for w in text.split())} {corpus.prose(rng, 9)}")]
        docs.append((10 * k + 2, corpus.prose(rng, 60)))
    found = set(run(spark, docs, items))
    expected = brute(docs, items)
    long_enough = {k for k, t in items if len(t.split()) >= 12}
    assert {p for p in expected if p[1] in long_enough or p[0] % 10 == 0} <= found
    assert {d for d, _ in found} == {d for d, _ in found if d % 10 < 2}
