"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers (in digits, or English words from two upwards and
tens with a unit), units behind numbers and capitalised words inside sentences turn into typed
placeholders, other words are lowered, punctuation goes. A word that opens a sentence may be a
name or not, so texts have a second template in which capitalised openers are names too; an
item is held where it is under either. Windows
of template tokens are hash-joined with the benchmark's, as tables: of each item and template those that
fewest items have, as many as must include one that a holding document has. Joined pairs
are then tested on whole texts. A document holds an item where, within twice the item's length, at least `share` of its distinct windows occur and the
slots agree: one number or name of the item always stands for one of the document and the
other way round (units may change). Every placement with that share is tested, with its own
windows only. A place of a text counts once for a window that an item repeats, and items are taken
in blocks, so memory grows with the text and not with the repeats of an item.

Characters of scripts without spaces are tokens of their own. An item of fewer tokens than
a window is held where all of them occur in order with the same values, numbers and names
too. Items without tokens, or null ones, are never reported. Null and empty
documents hold nothing. Repeated documents are reported each; several benchmark rows with
one id count as items of their own and give one row a document with the best coverage. Very
long texts are searched whole. Empty tables give no rows, or leave the documents as they are.
Columns are taken by name and clashing ones renamed inside, so others may have any name.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictspark.llm.jaccard import id_filter, text_id
from verdictspark.llm.tables import discard, join_hot, keep, read, small
from verdictspark.llm.words import Words, buffers, mix, pieces, windows

WINDOW = 5
SHARE = 0.5
#: Items that one joined row lists; a window of more is split, and so is a document's list.
LISTED = 64

#: Units of measure.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal qt pt s sec min h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros pound pounds cent cents penny pence meter meters metre metres centimeter centimeters centimetre centimetres "
    "millimeter millimeters millimetre millimetres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards acre acres "
    "gram grams milligram milligrams kilogram kilograms ounce ounces ton tons tonne tonnes litre litres liter liters milliliter milliliters "
    "millilitre millilitres gallon gallons quart quarts pint pints cup cups second seconds minute minutes degree degrees watt watts volt volts "
    "km2 m2 mph kmh kw kwh w v hz c f k"
).split()

#: Number words. A unit joins the ten before it; by itself one is a pronoun.
NUMBER_WORDS = (
    ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20)),
    ("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)),
    ("dozen hundred thousand million".split(), (12, 100, 1000, 1000000)),
)

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:;\n\r\"()[]|")] = True
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT_HASH = np.array([0, 0x6E756D626572, 0x6E616D65, 0x756E6974], dtype=np.uint64)


@dataclass
class Template:
    """Template tokens of several texts: kinds, the hash that windows see, the value's own, and which are capitalised openers."""

    kind: np.ndarray
    seen: np.ndarray
    value: np.ndarray
    first: np.ndarray
    opener: np.ndarray

    def named(self) -> Template:
        """The second template: openers are names."""
        return Template(np.where(self.opener, NAME, self.kind), np.where(self.opener, _SLOT_HASH[NAME], self.seen), self.value, self.first, self.opener)


def _hashes(listed: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(listed).encode(), dtype=np.uint8)
    edge = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    return Words(data, np.array([0, len(data)]), edge, np.append(edge[1:] - 1, len(data)), np.array([0, len(edge)])).hashes(fold=True)


_known: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Hashes of units, of number words with their numbers, and of those numbers in digits."""
    if not _known:
        words = [(w, k) for names, values in NUMBER_WORDS for w, k in zip(names, values, strict=True)]
        h, k = _hashes([w for w, _ in words]), np.array([k for _, k in words])
        order = np.argsort(h)
        digits = sorted({*range(1, 100), *k.tolist()})
        _known.update(units=_hashes(UNITS), words=h[order], numbers=k[order], digits=np.array(digits), digit_hashes=_hashes([str(d) for d in digits]))
    return _known


#: Code points of scripts without spaces between words: each is a token; and of their punctuation, which goes.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
WIDE_MARKS = ((0x3000, 0x3004), (0x3007, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0x0E5A, 0x0E5B), (0x0F0B, 0x0F14), (0x104A, 0x104F), (0x17D4, 0x17DA))


def _unspaced(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Marks all bytes of unspaced characters 2 at the first and 1 at others; their punctuation gets kind 0 in place."""
    out = np.zeros(len(data), dtype=np.uint8)
    for size, mask in ((3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(data >= 0xF0 if size == 4 else (data >= 0xE0) & (data < 0xF0))
        at = at[at + size <= len(data)]
        if not len(at):
            continue
        point = (data[at] & mask).astype(np.int64)
        for k in range(1, size):
            point = point << 6 | (data[at + k] & 0x3F)
        within = lambda ranges: np.any([(point >= lo) & (point <= hi) for lo, hi in ranges], axis=0)  # noqa: E731, B023
        marks, chars = at[within(WIDE_MARKS)], at[within(UNSPACED) & ~within(WIDE_MARKS)]
        for k in range(size):
            kind[marks + k] = 0
            out[chars + k] = 1
        out[chars] = 2
    return out


def templates(column: pa.Array) -> Template:
    data, at = buffers(column)
    kind = _KIND[data]
    lone = _unspaced(data, kind)
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner] = 0
    after[inner - 1] = 0
    # An unspaced character begins a token, and so does what follows it.
    opening, closing = lone == 2, np.zeros(len(data), dtype=bool)
    opening[1:] |= (lone[1:] == 0) & (lone[:-1] > 0)
    closing[:-1] = opening[1:]
    start = np.flatnonzero((kind > 0) & ((kind != before) | opening))
    end = np.flatnonzero((kind > 0) & ((kind != after) | closing)) + 1
    opens = np.zeros(len(start), dtype=bool)
    opens[np.searchsorted(start, at[:-1])[np.searchsorted(start, at[:-1]) < len(start)]] = True
    number = kind[start] == 2 if len(start) else np.zeros(0, dtype=bool)
    gap = np.full(len(start), 99)
    gap[1:] = start[1:] - end[:-1]
    gap[opens] = 99
    words = Words(data, at, start, end, np.searchsorted(start, at))
    value = words.hashes(fold=True)
    known = _tables()
    spelt = np.minimum(np.searchsorted(known["words"], value), len(known["words"]) - 1)
    spelt = np.where(known["words"][spelt] == value, known["numbers"][spelt], 0)
    between = data[np.maximum(start - 1, 0)]
    # The parts behind a number's first (12.5, 1,200) belong to its value, as a unit does to its ten (thirty-five).
    follows, joins = np.zeros(len(start), dtype=bool), np.zeros(len(start), dtype=bool)
    follows[1:] = number[1:] & number[:-1]
    follows &= (gap == 1) & np.isin(between, np.frombuffer(b".,", dtype=np.uint8))
    joins[1:] = (spelt[1:] > 0) & (spelt[1:] < 10) & (spelt[:-1] >= 20) & (spelt[:-1] < 100)
    joins &= (gap == 1) & np.isin(between, np.frombuffer(b"- ", dtype=np.uint8))
    stays = ~(follows | joins)
    number = number | (spelt > 1) | joins
    spelt[:-1] += np.where(joins[1:], spelt[1:], 0)
    named = np.flatnonzero((spelt > 1) & ~joins)
    value[named] = known["digit_hashes"][np.searchsorted(known["digits"], spelt[named])]
    behind = np.zeros(len(start), dtype=bool)
    behind[1:] = number[:-1]
    unit = ~number & behind & (gap <= 1) & np.isin(value, known["units"])
    mid = gap < 99
    if len(start):
        last = end[np.maximum(np.arange(len(start)) - 1, 0)]
        mid &= ~(_STOP[data[np.minimum(last, len(data) - 1)]] | _STOP[data[np.maximum(start - 1, 0)]])
        capital = _UPPER[data[start]] & ~number & ~unit & (end - start > 1)
        # Text in capitals throughout has no names.
        capital &= ~_UPPER[data[np.minimum(start + 1, len(data) - 1)]]
    else:
        capital = mid
    name = capital & mid
    kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, PLAIN)))[stays]
    parts = np.flatnonzero(follows)
    if len(parts):
        head = np.maximum.accumulate(np.where(stays, np.arange(len(start)), 0))[parts]
        np.add.at(value, head, value[parts] * (2 * (parts - head) + 1).astype(np.uint64))
    value = value[stays]
    place = np.concatenate([[0], np.cumsum(stays)])
    return Template(kinds, np.where(kinds > 0, _SLOT_HASH[kinds], value), value, place[words.first], (capital & ~mid)[stays])


@dataclass
class Benchmark:
    """A block of items: their templates, and their distinct windows in order of hash."""

    ids: list
    template: Template
    need: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    #: The window that begins at each token, by its place in `hashes`; -1 where none does.
    begins: np.ndarray
    #: Items shorter than a window by length: the hashes of their values in order, and the items.
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    #: The items that have openers, under the second template.
    opened: Benchmark | None = None


def _windowed(ids: list, template: Template, n: int, wanted: np.ndarray) -> Benchmark:
    count = np.diff(template.first)
    item = np.repeat(np.arange(len(ids)), count)
    at = np.arange(len(item))
    goes = (at + n <= template.first[item + 1]) & wanted[item] if len(item) else np.zeros(0, dtype=bool)
    h = windows(template.seen, n)[np.flatnonzero(goes)] if goes.any() else np.zeros(0, dtype=np.uint64)
    item, at = item[goes], at[goes]
    order = np.lexsort((at, item, h))
    h, item, at = h[order], item[order], at[order]
    # Equal windows of one item count once.
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
    begins = np.full(len(template.kind), -1)
    begins[at] = np.cumsum(new) - 1
    return Benchmark(ids, template, np.bincount(item[new], minlength=len(ids)), h[new], item[new], begins, {})


def benchmark_of(ids: list, column: pa.Array, n: int) -> Benchmark:
    template = templates(column)
    count = np.diff(template.first)
    bench = _windowed(ids, template, n, np.ones(len(ids), dtype=bool))
    opens = np.zeros(len(ids), dtype=bool)
    opens[np.repeat(np.arange(len(ids)), count)[template.opener]] = True
    if opens.any():
        bench.opened = _windowed(ids, template.named(), n, opens)
    for m in range(1, n):
        items = np.flatnonzero(count == m)
        if len(items):
            whole = windows(template.value, m)[template.first[items]]
            order = np.argsort(whole, kind="stable")
            bench.short[m] = whole[order], items[order]
    return bench


def _short_leaks(template: Template, bench: Benchmark) -> Iterator[Leak]:
    """Texts that hold all tokens of an item shorter than a window, values and all."""
    for m, (hashes, items) in bench.short.items():
        h = windows(template.value, m)
        pos = np.flatnonzero(np.isin(h, hashes))
        text = np.searchsorted(template.first, pos, side="right") - 1
        inside = pos + m <= template.first[np.minimum(text + 1, len(template.first) - 1)]
        pos, text = pos[inside], text[inside]
        lo, hi = np.searchsorted(hashes, h[pos]), np.searchsorted(hashes, h[pos], side="right")
        for t, i in sorted({(int(t), int(i)) for t, x, y in set(zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)) for i in items[x:y]}):
            a = int(bench.template.first[i])
            yield Leak(t, i, 1, 1, int((bench.template.kind[a : a + m] > 0).sum()), 0)


@dataclass
class Leak:
    text: int
    item: int
    matched: int
    needed: int
    slots: int
    changed: int


#: Entries (place, item) that are looked at together; one item's may be as many as the places.
BLOCK = 1 << 20


def leaks(template: Template, bench: Benchmark, n: int, share: float) -> Iterator[Leak]:
    """The (text, item) pairs that hold: short items, then others under the first template, then under the second."""
    yield from _short_leaks(template, bench)
    done: set[tuple[int, int]] = set()
    for own, items in ((template, bench), (None, bench.opened)):
        if items is not None and len(items.hashes):
            for leak in _placed(own or template.named(), items, n, share, done):
                done.add((leak.text, leak.item))
                yield leak


def _placed(template: Template, bench: Benchmark, n: int, share: float, done: set[tuple[int, int]]) -> Iterator[Leak]:
    h = windows(template.seen, n)
    slot = np.zeros(1 << 16, dtype=bool)
    slot[(bench.hashes >> np.uint64(48)).astype(np.int64)] = True
    pos = np.flatnonzero(slot[(h >> np.uint64(48)).astype(np.int64)])
    lo, hi = np.searchsorted(bench.hashes, h[pos]), np.searchsorted(bench.hashes, h[pos], side="right")
    text = np.searchsorted(template.first, pos, side="right") - 1
    real = (hi > lo) & (pos + n <= template.first[np.minimum(text + 1, len(template.first) - 1)])
    pos, lo, hi = pos[real], lo[real], hi[real]
    # How many places each window of each item has, and blocks of items with about BLOCK of them.
    places = np.cumsum(np.bincount(lo, minlength=len(bench.hashes) + 1) - np.bincount(hi, minlength=len(bench.hashes) + 1))[:-1]
    block = np.cumsum(np.bincount(bench.item, weights=places, minlength=len(bench.ids))).astype(np.int64) // BLOCK
    for k in np.unique(block[bench.item[places > 0]]).tolist():
        own = np.flatnonzero((block[bench.item] == k) & (places > 0))
        lo, hi = np.searchsorted(bench.hashes[own], h[pos]), np.searchsorted(bench.hashes[own], h[pos], side="right")
        each = hi - lo
        window = own[np.repeat(lo, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)]
        at = np.repeat(pos, each)
        text, item = np.searchsorted(template.first, at, side="right") - 1, bench.item[window]
        order = np.lexsort((at, item, text))
        at, text, item, window = at[order], text[order], item[order], window[order]
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(cut, np.append(cut[1:], len(text)), strict=True):
            i, t = int(item[a]), int(text[a])
            if b - a >= share * bench.need[i] and (t, i) not in done:
                held = _held(template, bench, i, at[a:b], window[a:b], n, share * int(bench.need[i]))
                if held:
                    yield Leak(t, i, held[0], int(bench.need[i]), *held[1:])


def _held(template: Template, bench: Benchmark, i: int, pos: np.ndarray, window: np.ndarray, n: int, floor: float) -> tuple[int, int, int] | None:
    """Windows, slots and changed slots of the best placement of item i whose slots agree."""
    reach = 2 * int(bench.template.first[i + 1] - bench.template.first[i])
    matched, begin, stop = array("q"), array("q"), array("q")
    inside, left = Counter(), 0
    at, met = array("q", pos.tolist()), array("q", window.tolist())
    for k in range(len(at)):
        inside[met[k]] += 1
        while at[k] - at[left] > reach:
            w = met[left]
            inside[w] -= 1
            if not inside[w]:
                del inside[w]
            left += 1
        # A placement ends where its next entry would push out its first.
        if len(inside) >= floor and (k + 1 == len(at) or at[k + 1] - at[left] > reach):
            matched.append(len(inside))
            begin.append(left)
            stop.append(k + 1)
    for k in np.lexsort((begin, -np.array(matched, dtype=np.int64))).tolist():
        held = _slots(template, bench, i, pos[begin[k] : stop[k]], window[begin[k] : stop[k]], n, floor)
        if held:
            return matched[k], *held
    return None


def _alignments(begins: np.ndarray, pos: np.ndarray, window: np.ndarray) -> list[tuple[int, int]]:
    """(shift, pairs) of a placement's places against an item's, the commonest first; pairs are made in blocks."""
    order = np.argsort(begins, kind="stable")
    lo, hi = np.searchsorted(begins[order], window), np.searchsorted(begins[order], window, side="right")
    least, each = int(pos[0]) - len(begins), hi - lo
    total = np.zeros(int(pos[-1]) - least + 1, dtype=np.int64)
    block = np.cumsum(each) // BLOCK
    for a, b in zip(np.searchsorted(block, np.unique(block)), np.searchsorted(block, np.unique(block), side="right"), strict=True):
        e = each[a:b]
        entry = order[np.repeat(lo[a:b], e) + np.arange(int(e.sum())) - np.repeat(np.cumsum(e) - e, e)]
        total += np.bincount(np.repeat(pos[a:b], e) - entry - least, minlength=len(total))
    some = np.flatnonzero(total)
    some = some[np.argsort(-total[some], kind="stable")]
    return [(int(s) + least, int(total[s])) for s in some]


def _slots(template: Template, bench: Benchmark, i: int, pos: np.ndarray, window: np.ndarray, n: int, floor: float) -> tuple[int, int] | None:
    """Slots of a placement and those with another value, or None where values don't map one to one.

    The commonest alignment counts first, then any other that reaches the floor by itself. To it come
    the slots of other alignments, as after an inserted word, that keep the order of item and document.
    """
    own, first, size = bench.template, int(bench.template.first[i]), int(bench.template.first[i + 1] - bench.template.first[i])
    begins = bench.begins[first : first + size]
    common = _alignments(begins, pos, window)

    def aligned(shift: int) -> np.ndarray:
        """The item's places whose window stands at this shift."""
        x = pos - shift
        x = np.where((x >= 0) & (x < size), x, 0)
        return x[(begins[x] == window) & (x + shift == pos)]

    for base, count in common:
        if base != common[0][0] and (count < floor or len(np.unique(begins[aligned(base)])) < floor):
            continue
        here: list[int] = []
        there: list[int] = []
        for s in [base, *(s for s, _ in common if s != base)]:
            for x in np.unique((aligned(s)[:, None] + np.arange(n)).ravel()).tolist():
                k = bisect_left(here, x)
                if (k == len(here) or here[k] != x and there[k] > x + s) and (k == 0 or there[k - 1] < x + s):
                    here.insert(k, x)
                    there.insert(k, x + s)
            if len(here) == size:
                break
        t, d = first + np.array(here), np.array(there)
        kind, a, b = own.kind[t], own.value[t], template.value[d]
        repeats = (kind == NUMBER) | (kind == NAME)
        pairs = set(zip(kind[repeats].tolist(), a[repeats].tolist(), b[repeats].tolist(), strict=True))
        if len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}):
            return int((kind > 0).sum()), int(((kind > 0) & (a != b)).sum())
    return None


def _opened_key(h: np.ndarray) -> np.ndarray:
    """The key of a window of the second template."""
    return mix(h + np.uint64(0x8CB92BA72F3D8DD7))


def _short_key(h: np.ndarray, m: int) -> np.ndarray:
    return mix(h + np.uint64(0x632BE59BD9B4E019 * m % (1 << 64)))


def _item_keys(n: int, share: float):  # noqa: ANN202
    """Distinct windows of each item and how many of the rarest stand for it; a short item's one key and its length.

    Items have numbers of their own here: twice the item's, and one more for its second template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            item = 2 * np.asarray(batch.column("item"))
            bench = benchmark_of(list(range(len(item))), batch.column("text"), n)
            own, key, takes, short = [], [], [], []

            def add(owner, keys, stand, length) -> None:  # noqa: ANN001
                own.append(owner)
                key.append(keys)
                takes.append(np.broadcast_to(stand, len(keys)))
                short.append(np.full(len(keys), length))

            for second, b in enumerate((bench, bench.opened)):
                if b is not None:
                    stand = b.need - np.ceil(share * b.need).astype(np.int64) + 1
                    add(item[b.item] + second, _opened_key(b.hashes) if second else b.hashes, stand[b.item], 0)
            for m, (hashes, items) in bench.short.items():
                add(item[items], _short_key(hashes, m), 1, m)
            own, key, takes, short = (np.concatenate(c) for c in (own, key, takes, short))
            columns = [pa.array(own), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(takes), pa.array(short, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "key", "takes", "short"])

    return run


def _held_keys(n: int, lengths: list[int], marks: np.ndarray):  # noqa: ANN202
    """The keys that each text may share with the benchmark."""
    bits = np.uint64(8 * len(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            template = templates(batch.column("text"))
            texts, keys = [], []
            whole = ((n, windows(template.seen, n)), (n, _opened_key(windows(template.named().seen, n))))
            short = ((m, _short_key(windows(template.value, m), m)) for m in lengths)
            for m, h in chain(whole, short):
                at = (h % bits).astype(np.int64)
                pos = np.flatnonzero(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                text = np.searchsorted(template.first, pos, side="right") - 1
                fits = pos + m <= template.first[text + 1]
                texts.append(text[fits])
                keys.append(h[pos[fits]])
            text, key = np.concatenate(texts), np.concatenate(keys)
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(text[new])), pa.array(key[new].view(np.int64))], names=["tid", "key"])

    return run


def _tested(n: int, share: float):  # noqa: ANN202
    """Rows of a text and the items it may hold: the pairs that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            asked = batch.column("items").to_pylist()
            texts = {x["item"]: x["text"] for row in asked for x in row}
            ids = list(texts)
            bench = benchmark_of(ids, pa.array([texts[i] for i in ids], pa.string()), n)
            wanted = [{x["item"] for x in row} for row in asked]
            found = [f for f in leaks(templates(batch.column("text")), bench, n, share) if ids[f.item] in wanted[f.text]]
            columns = [batch.column("tid").take(pa.array([f.text for f in found], pa.int64())), pa.array([ids[f.item] for f in found], pa.int64())]
            columns += [pa.array([getattr(f, c) for f in found], pa.int64()) for c in ("matched", "needed", "slots", "changed")]
            yield pa.RecordBatch.from_arrays(columns, names=["tid", "item", "matched", "windows", "slots", "changed_slots"])

    return run


def _listed(pairs: DataFrame, key: str, of: str, value: Column) -> DataFrame:
    """Rows (key, part, items) of pairs (key, of), at most about LISTED values each."""
    counts = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(LISTED))).cast("int").alias("parts"))
    parted = join_hot(pairs, counts, key).withColumn("part", F.pmod(F.xxhash64(of), F.col("parts")).cast("int"))
    return parted.groupBy(key, "parts", "part").agg(F.collect_list(value).alias("items"))


def _leaking(docs: DataFrame, items: DataFrame, n: int, share: float) -> DataFrame:
    """(tid, item, matched, windows, slots, changed_slots) of docs (tid, text) and items (item, text), a row for each pair that holds."""
    spark = docs.sparkSession
    keys = keep(items.select("item", "text").mapInArrow(_item_keys(n, share), "item long, key long, takes long, short int"), "leak-keys")
    common = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_items"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("_items", "key"))
    chosen = join_hot(keys, common, "key").withColumn("_rank", rank).where("_rank <= takes").select(F.shiftright("item", 1).alias("item"), "key", "short")
    chosen = keep(chosen, "leak-chosen")
    lengths = sorted(r["short"] for r in chosen.where("short > 0").select("short").distinct().collect())
    marks = id_filter(chosen.select("key"), chosen.count(), 1024)
    held = keep(docs.mapInArrow(_held_keys(n, lengths, marks), "tid binary, key long").distinct(), "leak-held")

    lists = keep(_listed(chosen.select("item", "key"), "key", "item", F.col("item")), "leak-lists")
    pairs = join_hot(held, lists.groupBy("key").agg(F.first("parts").alias("lists")), "key").where("lists is not null")
    pairs = keep(pairs.select("tid", F.explode(F.transform(F.sequence(F.lit(0), F.col("lists") - 1), lambda k: F.struct(F.col("key").alias("key"), k.alias("part")))).alias("at")), "leak-places")
    side = lists.select(F.struct("key", "part").alias("at"), "items")
    pairs = keep(join_hot(pairs, side, "at").select("tid", F.explode("items").alias("item")).distinct(), "leak-pairs")
    named = keep(join_hot(pairs, items.select("item", F.col("text").alias("_item_text")), "item"), "leak-named")
    asked = keep(_listed(named, "tid", "item", F.struct("item", F.col("_item_text").alias("text"))).select("tid", "items"), "leak-asked")
    tids = asked.select("tid").distinct()
    texts = docs.join(small(tids, pairs.select("tid").distinct().count()), "tid", "left_semi").dropDuplicates(["tid"])
    tested = texts.join(asked, "tid").select("tid", "text", "items").mapInArrow(_tested(n, share), "tid binary, item long, matched long, windows long, slots long, changed_slots long")
    found = keep(tested, "leak-found")
    discard(keys, chosen, held, lists, pairs, named, asked)
    return found


def _parts(docs: DataFrame, benchmark: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts (tid, text), and items (item, item_id, text) under numbers of their own."""
    named = benchmark.where("text is not null").select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    body = docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).where("text <> ''")
    return body.select(text_id(F.col("text")).alias("tid"), "text"), keep(named, "leak-items")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: float = SHARE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each document and item that it holds."""
    texts, items = _parts(docs, benchmark, text)
    found = _leaking(texts, items, n, share)
    rows = found.join(items.select("item", "item_id"), "item").withColumnRenamed("tid", "_tid")
    ids = docs.select(docs[id_col].alias("doc_id"), text_id(docs[text]).alias("tid"))
    out = ids.join(small(rows, found.count()), F.col("tid") == F.col("_tid"))
    return out.select("doc_id", "item_id", "matched", "windows", "slots", "changed_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: float = SHARE, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, all columns as they were."""
    tids = keep(_leaking(*_parts(docs, benchmark, text), n, share).select(F.col("tid").alias("_leaked")).distinct(), "leak-texts")
    return docs.join(small(tids, tids.count()), text_id(docs[text]) == F.col("_leaked"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the evidence."""
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("matched", "windows", "slots", "changed_slots"), F.col("matched") / F.col("windows")).alias("b")
    found = found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_rows"), best)
    return found.select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.windows").alias("windows"), F.col("b.slots").alias("slots"), F.col("b.changed_slots").alias("changed_slots"))
