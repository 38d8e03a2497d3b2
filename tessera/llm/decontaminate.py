"""Benchmark decontamination on templates.

Texts become sequences of tokens in which numbers, names and units are typed
placeholders (slots): a whole number ('1,200', '4.50', 'twenty-five', '3 million') is
one token, and so is a run of name words.  Windows of these templates are hash-joined
between documents and benchmark items; windows of one occurrence lie on one diagonal
(document position minus item position), and on each diagonal the slot values
must map one to one from item to document.  So a question asked again with other
numbers or names is found as well as a copied one.

A text is seen in two ways.  NAMED: words with a capital inside a sentence are names,
and so are those that open one if the text has them inside another or a name follows
(but for common openers, 'If Alice');
other opening words with a capital may be names, so windows with such words are taken
both ways.  PLAIN: no names and no case, only numbers and units are placeholders; that
finds copies in other case.  Windows that are less than half literal have no template;
in the plain view these are taken literally, so a copied item is found
whatever it consists of.  Characters of scripts written without spaces are tokens of
their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow_text import combine, flat, mix, ranges, word_hashes
from tessera.llm.runtime import key_filter, may_have, small_batches, trimmed, written

#: Tokens of a template window; items of MIN_TOKENS to WINDOW - 1 tokens are one window.
WINDOW, MIN_TOKENS = 8, 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Window hashes of the benchmark that are broadcast; of a larger one a bitmap of bounded size is, and the join does the rest.
BROADCAST_WINDOWS = 2_000_000

# Measures with prefixes: words take all of them, signs the short ones; words also end in s or n for several.
PREFIXES, SIGNS = "deca hecto kilo mega giga tera deci centi milli micro nano kiló hectó kilò déca dezi zenti mikro".split(), "k m c d h n g t u µ μ".split()
MEASURES = (
    "meter metre mètre metro gram gramm gramme gramo liter litre litro watt vatio joule julio volt voltio volte amp ampere ampère amperio hertz hercio pascal "
    "newton byte bit octet calorie kalorie caloría second seconde tonne mol"
).split()
MEASURE_SIGNS = "m g l w j v a hz b pa n s wh cal bar bit m2 m3 m² m³".split()
# Other units, in four languages, without the s for several.
OTHER_UNITS = (
    "lb oz mi ft in t h hr min sec y yr mph kmh c f k pc pct usd eur gbp chf kcal ha ml ph psi rpm dpi px "
    "mile yard foot feet inch inches pound ounce stone ton gallon quart pint cup teaspoon tablespoon acre hectare degree celsius fahrenheit kelvin "
    "hour minute second day week month year decade century centuries percent dollar euro cent pound franc yen penny pence dozen mole knot "
    "meile meilen zoll fuß pfund unze unzen tonnen morgen hektar grad stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren jahrzehnt jahrhundert prozent franken dutzend "
    "mille pied pouce livre once acre degré heure jour semaine mois an année décennie siècle pourcent sou douzaine "
    "milla pie pulgada libra onza tonelada hectárea grado hora minuto segundo día semana mes meses año década siglo porciento dólar dólares céntimo peso docena"
).split()
# Words for numbers: English ones in order, then those of other languages (no articles, no words that mean something else in English).
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion"
).split()
ONES = [*NUMBER_WORDS[1:10], *"deux trois quatre cinq six sept huit neuf dos tres cuatro cinco seis siete ocho nueve".split()]
TENS = [*NUMBER_WORDS[20:28], *"vingt trente quarante cinquante soixante treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()]
POWERS = [*NUMBER_WORDS[28:], *"hundert tausend millionen milliarden mille millions milliard milliards mil millones".split()]
_ZWEI, _ZWANZIG = "ein zwei drei vier fünf sechs sieben acht neun".split(), "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
NUMBER_WORDS += [
    *ONES[9:], *TENS[8:], *POWERS[5:], *_ZWEI[1:], *_ZWANZIG, *(f"{one}und{ten}" for one in _ZWEI for ten in _ZWANZIG), *"null zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split(),
    *"zéro dix onze douze treize quatorze quinze seize".split(), *"cero diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte cien ciento".split(), *(f"veinti{one}" for one in "uno dós trés cuatro cinco séis siete ocho nueve".split()),
]
UNITS = sorted({*(f"{prefix}{word}{several}" for prefix in ["", *PREFIXES] for word in MEASURES for several in ("", "s", "n")), *(f"{sign}{unit}" for sign in ["", *SIGNS] for unit in MEASURE_SIGNS), *(f"{word}{several}" for word in OTHER_UNITS for several in ("", "s"))} - {*NUMBER_WORDS, "as", "an", "us", "once"})
# Words that open sentences and are no part of a name behind them.
OPENERS = (
    "a an and are as at before after because but by did do does during each every for from given has have he her his how however i if in is it its let many most "
    "my no not now of on once one or our she since so some suppose that the their then there these they this those to today under until was we were what when "
    "where which while who whose why will with without would yesterday you your"
).split()
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
NAMED, PLAIN = 1, 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 32, 34, 39, 40]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 58, 63]] = True


def _hash_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    return word_hashes(raw, end - [len(w.encode()) for w in words], end)


_UNIT_HASHES, _NUMBER_HASHES = np.sort(_hash_of(UNITS)), np.sort(_hash_of(NUMBER_WORDS))
_ONES, _TENS, _POWERS, _OPENERS = (np.sort(_hash_of(w)) for w in (ONES, TENS, POWERS, OPENERS))
_SLOT_HASH = np.array([0, *(_hash_of(["\x01number", "\x01name", "\x01unit"]))], np.uint64)


#: Scripts written without spaces between words, as ranges of code points: Thai to Lao, Myanmar, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the tokens: runs of letters and digits, but each character of unspaced scripts alone."""
    inside = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    wide = np.flatnonzero(raw >= 0xE0)
    if len(wide):
        long = raw[wide] >= 0xF0
        b = np.append(raw, np.zeros(3, np.uint8)).astype(np.int64)
        point = np.where(long, (b[wide] & 7) << 18 | (b[wide + 1] & 63) << 12 | (b[wide + 2] & 63) << 6 | b[wide + 3] & 63, (b[wide] & 15) << 12 | (b[wide + 1] & 63) << 6 | b[wide + 2] & 63)
        alone = np.zeros(len(point), bool)
        for lo, hi in UNSPACED:
            alone |= (point >= lo) & (point <= hi)
        cut[wide[alone]] = True
        cut[np.minimum(wide + 3 + long, len(raw))[alone]] = True
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    at = np.flatnonzero(cut[1:-1]) + 1 if len(raw) else np.zeros(0, np.int64)
    at = at[inside[at] & inside[at - 1]]
    return np.sort(np.concatenate((np.flatnonzero(edge == 1), at))), np.sort(np.concatenate((np.flatnonzero(edge == -1), at)))



def _among(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h if len(sorted_) else np.zeros(len(h), bool)


#: Bits of the leading part of a hash that a table says to be wanted or not, before hashes are looked up.
LEAD_BITS = 22


def _leads(sorted_: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << LEAD_BITS, bool)
    out[(sorted_ >> np.uint64(64 - LEAD_BITS)).astype(np.int64)] = True
    return out


def _among_few(h: np.ndarray, sorted_: np.ndarray, leads: np.ndarray) -> np.ndarray:
    ok = leads[(h >> np.uint64(64 - LEAD_BITS)).astype(np.int64)]
    ok[ok] = _among(h[ok], sorted_)
    return ok


#: Keep the hashes of the two views, and of literal windows, apart.
_SEED = {NAMED: np.uint64(0x2545F4914F6CDD1D), PLAIN: np.uint64(0x5851F42D4C957F2D)}
_AS_IS = np.uint64(0x9E6C63D0876A9A35)


class View:
    """Tokens of many texts in one of the two ways: bounds in bytes, first token of each text, kinds, and which may be names."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray, kind: np.ndarray, maybe: np.ndarray, view: int):
        self.raw, self.start, self.end, self.kind, self.view = raw, start, end, kind, view
        self.first = np.searchsorted(start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.h = word_hashes(raw, start, end)
        self.maybe = maybe & (kind == LITERAL)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start tokens, hashes and variants (0; 1: with the words that may be names; 2: literal) of the windows inside one text."""
        n = len(self.h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = self.text[:n] == self.text[width - 1 :]

        def held(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[width:] - total[:-width]

        out = []

        def take(kind: np.ndarray | None, ok: np.ndarray, variant: int, seed: np.uint64) -> None:
            at = np.flatnonzero(ok)
            values = self.h if kind is None else np.where(kind > 0, _SLOT_HASH[kind], self.h)
            if 3 * len(at) > n:
                h = combine(values, width)[at]
            else:  # a few windows: only their tokens
                h = combine(values[(at[:, None] + np.arange(width)).ravel()], width)[::width]
            out.append((at, h ^ np.uint64(width) ^ seed, np.full(len(at), variant)))

        half = 2 * held(self.kind == LITERAL) >= width
        if width >= MIN_TOKENS:
            take(self.kind, inside & half, 0, _SEED[self.view])
        if self.view == NAMED:
            named = np.where(self.maybe, NAME, self.kind)
            take(named, inside & (held(self.maybe) > 0) & (2 * held(named == LITERAL) >= width), 1, _SEED[NAMED])
        else:
            take(None, inside & ~half if width >= MIN_TOKENS else inside, 2, _AS_IS)
        return tuple(np.concatenate(x) for x in zip(*out))

    def slots(self, token: int, width: int, variant: int, places: bool = False) -> list[str]:
        """Kind and value of the window's slots in order; with ``places`` where they are in the text, too."""
        kind = self.kind[token : token + width]
        if variant == 1:
            kind = np.where(self.maybe[token : token + width], NAME, kind)
        return [] if variant == 2 else [f"{i}|" * places + "%d:%s" % (k, self.raw[self.start[i] : self.end[i]].tobytes().decode(errors="replace").lower()) for i, k in enumerate(kind.tolist(), token) if k]


def views(raw: np.ndarray, offsets: np.ndarray) -> list[View]:
    """Both views of the texts raw[offsets[i]:offsets[i+1]]."""
    start, end = _tokens(raw, offsets)
    if not len(start):
        none = np.zeros(0, np.int8)
        return [View(raw, start, end, offsets, none, none.astype(bool), v) for v in (NAMED, PLAIN)]
    h = word_hashes(raw, start, end)

    def beside(start: np.ndarray, end: np.ndarray, letters: bytes) -> np.ndarray:
        """Whether a token stands behind the one before, in one text, with just one of these letters between."""
        text = np.searchsorted(offsets, start, "right")
        ok = np.zeros(len(start), bool)
        ok[1:] = (text[1:] == text[:-1]) & (start[1:] - end[:-1] == 1)
        ok[ok] = np.isin(raw[start[ok] - 1], np.frombuffer(letters, np.uint8))
        return ok

    def merged(join: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lead = np.flatnonzero(~join)
        return lead, start[lead], end[np.append(lead[1:], len(join)) - 1]

    # whole numbers
    digit = (raw[start] >= 48) & (raw[start] <= 57)
    ends = (raw[end - 1] >= 48) & (raw[end - 1] <= 57)
    word = _among(h, _NUMBER_HASHES)
    number = digit | word
    behind = lambda mask: np.append(False, mask[:-1])
    power = _among(h, _POWERS)
    compound = (power & behind(number)) | (_among(h, _ONES) & behind(_among(h, _TENS))) | (word & ~power & behind(power))
    join = (digit & behind(digit & ends) & beside(start, end, b".,")) | (compound & beside(start, end, b" -"))
    lead, start, end = merged(join, start, end)
    number, h = number[lead], word_hashes(raw, start, end)
    kind = np.where(number, NUMBER, LITERAL).astype(np.int8)
    text = np.searchsorted(offsets, start, "right") - 1
    after = np.append(False, number[:-1] & (text[1:] == text[:-1]))
    kind[after & _among(h, _UNIT_HASHES) & ~number] = UNIT
    plain = View(raw, start, end, offsets, kind, np.zeros(len(start), bool), PLAIN)
    # names
    two = np.append(raw, 0)[start + 1]
    capital = (((raw[start] >= 65) & (raw[start] <= 90)) | ((raw[start] == 0xC3) & (two >= 0x80) & (two <= 0x9E))) & (kind == LITERAL)
    # a capital means a name only inside a sentence: the last byte before it that
    # is no gap must be there, in the same text, and be no stop
    solid = np.maximum.accumulate(np.where(_GAP[raw], -1, np.arange(len(raw))))
    last = np.where(start > 0, solid[start - 1], -1)
    inner = (last >= offsets[text]) & ~_STOP[raw[np.maximum(last, 0)]]
    name = capital & inner
    own = mix(h + mix(text.astype(np.uint64)))
    opening = capital & ~inner
    name |= opening & _among(own, np.sort(own[name]))
    blank = beside(start, end, b" ")
    name |= opening & np.append((name & blank)[1:], False) & ~_among(h, _OPENERS)
    kind = np.where(name, NAME, kind).astype(np.int8)
    lead, start, end = merged(name & np.append(False, name[:-1]) & blank, start, end)
    return [View(raw, start, end, offsets, kind[lead], opening[lead], NAMED), plain]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()))
    names = ["item_id", "view", "width", "item_at", "hash", "item_windows", "item_slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for i, key in enumerate(ids):
                if key is None:
                    continue
                for v in views(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])):
                    width = min(WINDOW, len(v.start))
                    if width >= MIN_TOKENS or width and v.view == PLAIN:
                        at, h, variant = v.windows(width)
                        places = len(np.unique(at))
                        out += [(key, v.view, width, a, x, places, v.slots(a, width, k, places=True)) for a, x, k in zip(at.tolist(), h.view(np.int64).tolist(), variant.tolist())]
            cols = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return benchmark.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(trimmed(run), "item_id long, view int, width int, item_at int, hash long, item_windows int, item_slots array<string>")


def text_key(text) -> Column:
    """What tells texts apart: 128 bits of their hash; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _probes(items: DataFrame, coverage: float) -> DataFrame:
    """hash, item_id, view: of each item's places the rarest, so many that a text which holds enough of them holds one of these.

    A place is as frequent as the items that have its windows.  Windows that very many items share, a common preamble, are no probes
    unless an item has hardly any others."""
    spread = items.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    places = items.join(spread, "hash").groupBy("item_id", "view", "item_at").agg(F.sum("often").alias("often"), F.max("item_windows").alias("n"))
    item = Window.partitionBy("item_id", "view")
    places = places.withColumn("nth", F.row_number().over(item.orderBy("often", "item_at"))).withColumn("all", F.count(F.lit(1)).over(item)).withColumn("n", F.max("n").over(item))
    rare = places.filter(F.col("nth") <= F.col("all") - F.ceil(F.col("n") * coverage) + 1).select("item_id", "view", "item_at")
    return items.join(rare, ["item_id", "view", "item_at"]).select("hash", "item_id", "view").distinct()


def _windows(docs: DataFrame, doc_id: str, text: str, widths: list[tuple[int, int]], wanted, bitmap: bool) -> DataFrame:
    """The documents' windows whose hashes are wanted: among broadcast sorted hashes, or (nearly) by a bitmap of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = wanted.value
        for batch in batches:
            raw, offsets = flat(batch.column(1))
            ids, texts = batch.column(0), batch.column(2)
            for a, b in ranges(offsets):
                rows, tokens, hashes, slots = [], [], [], []
                for v in views(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    for width in (w for view, w in widths if view == v.view):
                        at, h, variant = v.windows(width)
                        hit = may_have(some, h) if bitmap else _among_few(h, *some)
                        at, h, variant = at[hit], h[hit], variant[hit]
                        doc = np.searchsorted(v.first, at, "right") - 1
                        rows += (doc + a).tolist()
                        tokens += (at - v.first[doc]).tolist()
                        hashes += h.view(np.int64).tolist()
                        slots += [v.slots(i, width, k) for i, k in zip(at.tolist(), variant.tolist())]
                if rows:
                    rows = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([ids.take(rows), texts.take(rows), pa.array(tokens, pa.int32()), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.string()))], names=["doc_id", "text_key", "doc_at", "hash", "doc_slots"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", text_key("text").alias("text_key"))
    return texts.mapInArrow(trimmed(run), "doc_id long, text_key binary, doc_at int, hash long, doc_slots array<string>")


def consistent(windows: list[tuple[int, int, list[str], list[str]]]) -> tuple[set[int], set[int], int]:
    """Item places matched by windows (diagonal, place, item's slots, document's slots) with slots that map one to one;
    those of them on diagonals where no slot changes; most slot values on a diagonal.

    Where a value maps to several, the pair that leaves it as it is stays (a copy with an
    edit), else the one that more than half of its places have, and windows with
    another pair are left out; without such a pair the diagonal isn't consistent."""
    lines: dict[int, list] = {}
    for diagonal, at, x, y in windows:
        own = [v.split("|", 1) for v in x]
        lines.setdefault(diagonal, []).append((at, [v for _, v in own], y, [place for place, _ in own]))
    matched, same, most = set(), set(), 0
    for line in lines.values():
        seen = {(place, *p) for _, x, y, places in line for place, *p in zip(places, x, y)}
        times = Counter((i, d) for _, i, d in seen)
        total = [Counter(), Counter()]
        for p, n in times.items():
            for side in (0, 1):
                total[side][p[side]] += n
        alike = {p[0] for p in times if p[0] == p[1]}
        kept = {p for p, n in times.items() if all(p[0] == p[1] if p[side] in alike else 2 * n > total[side][p[side]] for side in (0, 1))}
        settled = [{p[side] for p in kept} for side in (0, 1)]
        if any(p[0] not in settled[0] and p[1] not in settled[1] for p in times):
            continue
        places = {at for at, x, y, _ in line if kept.issuperset(zip(x, y))}
        if places:
            used = {p for at, x, y, _ in line if at in places for p in zip(x, y)}
            matched |= places
            most = max(most, len(used))
            if all(x == y for x, y in used):
                same |= places
    return matched, same, most


FOUND = "text_key binary, item_id long, matched_windows int, item_windows int, slot_values int, exact boolean"


def _judged(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                matched, same, slots = consistent([(w["diagonal"], w["item_at"], w["item_slots"], w["doc_slots"]) for w in r["windows"]])
                n = r["item_windows"]
                if matched and len(matched) >= coverage * n:
                    exact = len(same) >= coverage * n
                    out.append((r["text_key"], r["item_id"], len(matched), n, slots, exact))
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            cols = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item whose template the document holds.

    Returns doc_id, item_id, matched_windows, item_windows, coverage, slot_values
    (distinct slot values that map one to one), kind: 'exact' where slots are as
    in the item, else 'reparameterised', and text_key (a hash of the text, as rows may share an id).  A pair counts if in one view at least
    ``coverage`` of the item's windows occur on diagonals with consistent slots;
    windows with a slot that contradicts the others of its diagonal don't count.
    Items with fewer than MIN_TOKENS tokens match where a document holds all their
    tokens, whatever the case; those without a token or with a null id match nothing.
    Texts are judged one by one, equal ones once; rows that share a document id (null ids too) and have different
    texts are documents of their own; null and empty texts hold nothing; other columns are
    ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = written(_items(benchmark, item_id, item_text), "items")
    n = items.count()
    widths = sorted((r[0], r[1]) for r in items.select("view", "width").distinct().collect())  # some ten pairs
    if n <= BROADCAST_WINDOWS:
        hashes = np.unique(np.array([r[0] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64))
        wanted = spark.sparkContext.broadcast((hashes, _leads(hashes)))
    else:
        wanted = key_filter(items.select("hash").distinct())
    met = written(_windows(docs, doc_id, text, widths, wanted, n > BROADCAST_WINDOWS), "windows")
    texts = written(met.select("text_key", "doc_at", "hash", "doc_slots").distinct(), "text-windows")
    probes = written(_probes(items, coverage), "probes")
    # texts and items that can share enough windows; a window that many items share brings none of them together
    near = written(texts.select("text_key", "hash").join(probes, "hash").select("text_key", "item_id", "view").distinct(), "candidates")
    window = F.struct((F.col("doc_at") - F.col("item_at")).alias("diagonal"), "item_at", "item_slots", "doc_slots")
    # a row for a text and an item: no longer than the text
    pairs = near.join(items, ["item_id", "view"]).join(texts, ["text_key", "hash"]).groupBy("text_key", "item_id", "view").agg(F.collect_set(window).alias("windows"), F.max("item_windows").alias("item_windows"))
    found = written(pairs.select("text_key", "item_id", "windows", "item_windows").mapInArrow(trimmed(_judged(coverage)), FOUND), "found")
    share = F.col("matched_windows") / F.col("item_windows")
    best = found.groupBy("text_key", "item_id").agg(F.max(F.struct("exact", share.alias("coverage"), "matched_windows", "item_windows", "slot_values")).alias("b"))
    out = met.select("doc_id", "text_key").distinct().join(best, "text_key")
    return out.select("doc_id", "item_id", "b.matched_windows", "b.item_windows", "b.coverage", "b.slot_values", F.when(F.col("b.exact"), "exact").otherwise("reparameterised").alias("kind"), "text_key")
