"""Template decontamination: recall on edited items, and rows against a version that compares everything with everything."""

import random
import re

import pytest

from tessera.llm import decontaminate as D

NAMES = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy".split()
UNITS = ["kg", "days", "dollars", "km"]
OTHER_UNITS = "miles kilometers kilometres meters pounds grams kilograms inches feet foot inch liters millilitres gallons degrees hours Stunden Kilometer heures kilomètres metros horas mph kWh kN µg".split()
FILL = "then how many of the apples does she still keep when all her friends have gone home with what they were given on that long walk".split()


def item(rng):
    """Two sentences with names, numbers and units among common words."""
    w = lambda n: rng.sample(FILL, n)
    a, b = rng.sample(NAMES, 2)
    x, y = rng.sample(range(2, 99), 2)
    first = ["If", a, *w(3), str(x), rng.choice(UNITS), *w(3), "to", b, *w(2)]
    return " ".join(first) + ". " + " ".join(["So", *w(3), a, *w(2), str(y), *w(4)]) + "?"


def other(rng, text):
    """The same item with other names and numbers, alike for alike."""
    names = dict(zip(NAMES, rng.sample(NAMES, len(NAMES))))
    numbers = {str(n): str(m) for n, m in zip(range(2, 99), rng.sample(range(100, 900), 97))}
    return re.sub(r"[A-Za-z]+|[0-9]+", lambda m: names.get(m[0], numbers.get(m[0], m[0])), text)


WORDS = {str(n): w for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
TENS = dict(zip(range(20, 100, 10), "twenty thirty forty fifty sixty seventy eighty ninety".split()))


def spelled(n):
    return WORDS.get(n) or (TENS[int(n) // 10 * 10] + ("-" + WORDS[n[-1]] if n[-1] != "0" else "") if int(n) >= 20 else "nineteen")


EDITS = {
    "verbatim": lambda r, t: t,
    "other names and numbers": other,
    "lower case": lambda r, t: t.lower(),
    "upper case": lambda r, t: t.upper(),
    "lower case and other numbers": lambda r, t: re.sub("[0-9]+", lambda m: str(int(m[0]) + 100), t.lower()),
    "grouped and decimal numbers": lambda r, t: re.sub("[0-9]+", lambda m: r.choice([f"{m[0]},{r.randint(100, 999)}", f"{m[0]}.50"]), t),
    "number words": lambda r, t: re.sub("[0-9]+", lambda m: spelled(m[0]), t),
    "other units": lambda r, t: re.sub("[0-9]+ (" + "|".join(UNITS) + ")", lambda m: m[0].split()[0] + " " + r.choice(OTHER_UNITS), t),
    "names of several words": lambda r, t: re.sub("|".join(NAMES), lambda m: m[0] + " Van Helsing", t),
    "one mention changed": lambda r, t: t[: t.rindex(next(n for n in NAMES if t.count(n) > 1))] + "Zoe" + t[t.rindex(next(n for n in NAMES if t.count(n) > 1)) + len(next(n for n in NAMES if t.count(n) > 1)) :],
}


@pytest.fixture(scope="module")
def bench_items():
    rng = random.Random(17)
    return [item(rng) for _ in range(40)]


def test_recall_on_edits(spark, bench_items):
    rng = random.Random(18)
    kinds = list(EDITS)
    rows = [(len(kinds) * i + k, "as it was said. " + EDITS[e](rng, t) + " And so on.") for i, t in enumerate(bench_items) for k, e in enumerate(kinds)]
    bench = spark.createDataFrame(list(enumerate(bench_items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    recall = {e: sum((len(kinds) * i + k, i) in got for i in range(len(bench_items))) / len(bench_items) for k, e in enumerate(kinds)}
    assert min(recall.values()) >= 0.9, recall
    wrong = sum(d // len(kinds) != i for d, i in got)
    assert wrong <= 0.02 * len(rows)


def test_units_and_number_words():
    assert {"miles", "kilometers", "pounds", "kilograms", "feet", "stunden", "heures", "kilómetros", "dezigramm", "ms", "kwh"} <= set(D.UNITS)
    assert {"veinte", "fünfundzwanzig", "trente", "twenty", "veintitrés"} <= set(D.NUMBER_WORDS) and not {"as", "once", "six"} & set(D.UNITS)


def test_a_preamble_of_all_items_brings_no_pairs(spark):
    """Items that begin alike, documents with that beginning: windows that all items share bring none together."""
    rng = random.Random(21)
    opening = "Read the following short story with great care and then answer the question below in one full sentence please."
    items = [opening + " " + item(rng) for _ in range(300)]
    rows = [(i, opening + " " + " ".join(rng.choice(FILL) for _ in range(40))) for i in range(700)] + [(1000 + i, "x " + t.replace("apples", "pears")) for i, t in enumerate(items[:5])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench, coverage=0.6).collect()}
    assert {(1000 + i, i) for i in range(5)} <= got and not any(d < 1000 for d, _ in got)
    items = D._items(bench, "item_id", "text")
    shared = items.groupBy("hash").count().filter("count > 250")
    assert shared.count() >= 5 and D._probes(items, 0.6).join(shared, "hash").count() == 0


def test_short_items_with_a_name_that_opens_them(spark):
    bench = spark.createDataFrame([(1, "Alice has 7 apples today"), (2, "Berlin is the capital of Germany")], "item_id long, text string")
    rows = [(1, "Carol has 9 apples today"), (2, "So: carol has 9 pears today. Erin has 12,000 apples today."), (3, "alice HAS 7 apples today"), (4, "Paris is the capital of France"), (5, "has 9 apples today")]
    got = {(r.doc_id, r.item_id, r.kind) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, "reparameterised"), (2, 1, "reparameterised"), (3, 1, "exact"), (4, 2, "reparameterised")}


# ---------------------------------------------------------------- everything against everything, text by text


def tokens(text):
    """(lower-case value, kind in the plain view, capital, inside a sentence, the one character between it and the token before, or None)."""
    found = [[m.start(), m.end()] for m in re.finditer(r"[0-9A-Za-z]+", text)]
    number = lambda w: w[0].isdigit() or w.lower() in D.NUMBER_WORDS
    out = []
    for a, b in found:
        w = text[a:b]
        between = text[out[-1][1] : a] if out else ""
        if out:
            last = text[out[-1][0] : out[-1][1]]
            x, y = text[out[-1][0] : out[-1][1]].lower().replace("-", " ").split(" ")[-1], w.lower()
            power, before = y in D.POWERS, x in D.POWERS
            compound = (power and number(x)) or (y in D.ONES and x in D.TENS) or (y in D.NUMBER_WORDS and not power and before)
            if (w[0].isdigit() and last[0].isdigit() and last[-1].isdigit() and between in (".", ",")) or (compound and between in (" ", "-")):
                out[-1][1], out[-1][2] = b, w
                continue
        out.append([a, b, w])
    rows = []
    for k, (a, b, w) in enumerate(out):
        value, first = text[a:b].lower(), text[a:b].split()[0] if " " in text[a:b] else text[a:b]
        kind = "number" if number(re.split("[ -]", text[a:b])[0]) else ""
        if not kind and rows and rows[-1][1] == "number" and value in D.UNITS:
            kind = "unit"
        before = text[:a].rstrip(" \t\"'(")
        rows.append((value, kind, first[0].isupper() and not kind, bool(before) and before[-1] not in ".!?:;\n\r", text[out[k - 1][1] : a] if k else None))
    return rows


def named(rows):
    """Tokens of the named view: (value, kind, may be a name)."""
    inner = {v for v, _, c, i, _ in rows if c and i}
    is_name = [c and (i or v in inner or (v not in D.OPENERS and k + 1 < len(rows) and rows[k + 1][2] and rows[k + 1][3] and rows[k + 1][4] == " ")) for k, (v, _, c, i, _) in enumerate(rows)]
    out = []
    for k, (v, kind, c, i, gap) in enumerate(rows):
        if is_name[k] and k and is_name[k - 1] and gap == " ":
            out[-1] = (out[-1][0] + " " + v, "name", False)
        else:
            out.append((v, "name" if is_name[k] else kind, c and not i and not is_name[k]))
    return out


def windows(text):
    """For both views: width, and [place, template, slots] of each window, by the rules of the operator's docstring."""
    rows = tokens(text)
    for view, seq in (("named", named(rows)), ("plain", [(v, k, False) for v, k, *_ in rows])):
        def of(width, view=view, seq=seq):
            for at in range(len(seq) - width + 1):
                part = seq[at : at + width]
                forms = [(part, False)] + ([([(v, "name" if m else k, m) for v, k, m in part], False)] if any(m for *_, m in part) else [])
                for p, _ in forms:
                    if width >= D.MIN_TOKENS and 2 * sum(not k for _, k, _ in p) >= width:
                        yield at, ("t", view, *[k or v for v, k, _ in p]), [(at + j, (k, v)) for j, (v, k, _) in enumerate(p) if k]
                if view == "plain" and (width < D.MIN_TOKENS or 2 * sum(not k for _, k, _ in part) < width):
                    yield at, ("l", *[v for v, *_ in part]), []

        width = min(D.WINDOW, len(seq))
        if width >= D.MIN_TOKENS or (view == "plain" and width):
            yield view, width, of
        else:
            yield view, 0, of


def slow(docs, bench):
    out = {}
    for item_id, said in bench:
        for view, width, of in windows(said):
            if not width:
                continue
            mine = list(of(width))
            places = {at for at, *_ in mine}
            for doc_id, text in docs:
                theirs = {}
                for v, _, f in windows(text):
                    if v == view:
                        for at, key, slots in f(width):
                            theirs.setdefault(key, []).append((at, slots))
                lines = {}
                for at, key, slots in mine:
                    for there, other_slots in theirs.get(key, []):
                        lines.setdefault(there - at, []).append((at, [(p, i, d) for (p, i), (_, d) in zip(slots, other_slots)]))
                matched, same = set(), set()
                for line in lines.values():
                    votes = {t for _, s in line for t in s}
                    pairs = {(i, d) for _, i, d in votes}

                    def stays(i, d, votes=votes, pairs=pairs):
                        for side in (0, 1):
                            rivals = [t for t in votes if t[1 + side] == (i, d)[side]]
                            if ((i, d)[side],) * 2 in pairs:
                                if i != d:
                                    return False
                            elif 2 * sum(t[1:] == (i, d) for t in rivals) <= len(rivals):
                                return False
                        return True

                    kept = {p for p in pairs if stays(*p)}
                    if any(i not in {k for k, _ in kept} and d not in {k for _, k in kept} for i, d in pairs):
                        continue
                    good = {at for at, s in line if all(stays(i, d) for _, i, d in s)}
                    matched |= good
                    if all(i == d for at, s in line if at in good and all(stays(a, b) for _, a, b in s) for _, i, d in s):
                        same |= good
                if matched and 2 * len(matched) >= len(places):
                    new = (2 * len(same) >= len(places), len(matched) / len(places))
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), (False, 0)), new)
    return {(*k, exact, round(share, 9)) for k, (exact, share) in out.items()}


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_like_everything_against_everything(spark, bench_items, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(19)
    bench = list(enumerate([*bench_items[:12], "Two and two", "Alice has 7 apples today", "1 2 3 4 5 6 7", "12 + 45 - 3 * 7 = 8 so", ""]))
    docs = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(bench)[1] if rng.random() < 0.7 else item(rng)
            t = EDITS[rng.choice([e for e in EDITS if e != "one mention changed"])](rng, t) if rng.random() < 0.8 and not re.search(r"\b(1|0)[0-9]\b", t) else t
            w = t.split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(["Zoe", "17", "word", "Bob", "two", "KG"])
            parts.append(" ".join(w))
        docs.append((k, rng.choice([" ", "\n", ". "]).join(parts)))
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = slow(docs, bench)
    assert {(r.doc_id, r.item_id, r.kind == "exact", round(r.coverage, 9)) for r in got} == want and len(want) > 60
