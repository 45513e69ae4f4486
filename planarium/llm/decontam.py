"""Benchmark decontamination by template canonicalisation.

Words of documents and items become templates: numbers, capitalised names and
units of measure turn into typed placeholders.  Windows of template words are
hash-joined; along each diagonal (the same shift between item and document)
matching windows are stitched, near diagonals are taken together, and the words
behind the placeholders that differ are checked for consistency: one item value
must stand for one document value and the other way round; of a passage that is
mostly verbatim the longest consistent stretch counts.  So a question asked again with other numbers and names
is found, while a document that only shares a frame is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.llm._store import small_batches, written
from planarium.llm._text import LOWER, U64, mix, prefix_hash, slices, span_hash, utf8, window_hashes, words

WINDOW = 6
#: Bytes of a benchmark that is broadcast whole; a larger one is joined by shuffle, behind a filter of fixed size.
BROADCAST_BYTES, FILTER = 4 << 20, 1 << 22
NUMBER, NAME, UNIT = U64(1), U64(2), U64(3)

# Units of measure and currencies.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons tonne tonnes ml l liter liters litre litres "
    "gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "percent dollar dollars cent cents euro euros usd eur gbp degrees celsius fahrenheit kelvin watt watts volt volts amp amps joule joules newton newtons hz khz mhz ghz mph kph"
).split()

_SEPARATOR = np.ones(256, dtype=bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SEPARATOR[_a : _b + 1] = False
_CASED = np.zeros(256, dtype=bool)
_CASED[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def _unit_hashes() -> np.ndarray:
    buf, offsets = utf8(pa.array(UNITS))
    return np.sort(span_hash(prefix_hash(LOWER[buf]), offsets[:-1], offsets[1:]))


_UNITS = _unit_hashes()


def templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template value and plain hash of each token, the first token of each text, and the words of each token.

    A word is a run of ASCII letters, digits and bytes of other scripts,
    lower-cased.  With a digit it is a number; capitalised after a word that
    ends without '.', '!', '?' or a line break, and not followed by a second
    capital, a name; in the list, a unit.  A token is a word, or a run of names,
    whose value is all of them: so a slot may change its number of words.
    """
    buf, offsets = utf8(column)
    starts, ends, first = words(buf, offsets, _SEPARATOR)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64), first, np.zeros(0, np.int64)
    plain = span_hash(prefix_hash(LOWER[buf]), starts, ends)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    number = digits[ends] > digits[starts]
    stop = np.zeros(256, dtype=bool)
    stop[[0x2E, 0x21, 0x3F, 0x0A, 0x0D, 0x3A]] = True
    stops = np.concatenate([[0], np.cumsum(stop[buf])])
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    opens[first[:-1][first[:-1] < first[1:]]] = True
    shouted = _CASED[buf[np.minimum(starts + 1, len(buf) - 1)]] & (ends - starts > 1)
    name = _CASED[buf[starts]] & ~shouted & ~opens
    at = np.searchsorted(_UNITS, plain)
    at[at == len(_UNITS)] = 0
    unit = _UNITS[at] == plain
    out = plain.copy()
    out[unit], out[name], out[number] = UNIT, NAME, NUMBER
    goes_on = np.zeros(len(out), dtype=bool)
    goes_on[1:] = (out[1:] == NAME) & (out[:-1] == NAME) & ~opens[1:]
    token = np.flatnonzero(~goes_on)
    weight = np.diff(np.append(token, len(out)))
    place = np.arange(len(out)) - np.repeat(token, weight)
    whole = np.where(weight > 1, mix(np.add.reduceat(mix(plain + place.astype(U64) * U64(0x9E3779B97F4A7C15)), token)), plain[token])
    return out[token], whole, np.searchsorted(token, first), weight


SEEN = 1 << 20
#: Words of an item in one run, as they are, that count whatever their share of it.
LONG = 50


class Table:
    """Hashes of item windows of one width, sorted, with the item word that each starts at."""

    def __init__(self, values: np.ndarray, width: int, starts: np.ndarray):
        h = window_hashes(values, width)[starts]
        order = np.argsort(h, kind="stable")
        self.width, self.h, self.at = width, h[order], starts[order]
        self.seen = np.zeros(SEEN, dtype=bool)
        self.seen[(self.h & U64(SEEN - 1)).astype(np.int64)] = True

    def maybe(self, values: np.ndarray) -> np.ndarray:
        """Could the window at each place be one of the items'? (The last ones don't exist.)"""
        return self.seen[(window_hashes(values, self.width) & U64(SEEN - 1)).astype(np.int64)]

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of `values` and item words whose windows are equal."""
        if len(values) < self.width:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe(values))
        h = window_hashes(values, self.width)[at]
        lo, n = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n -= lo
        return np.repeat(at, n), self.at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _runs(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least `least` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    keep = edge[1::2] - edge[::2] >= least
    return edge[::2][keep], edge[1::2][keep]


class Items:
    """Windows of a block of items.

    A window is joined by its template, but one of a single kind of placeholder
    is in any text and is joined by its plain words; so is an item of fewer than
    six words (one window of its whole length) with fewer than three words that
    are no placeholders.  Along a diagonal that was met once, all template words count.
    """

    def __init__(self, ids: list[int], column: pa.Array):
        self.ids = ids
        self.template, self.plain, self.first, self.weight = templates(column)
        sizes = np.diff(self.first)
        self.words = np.diff(np.concatenate([[0], np.cumsum(self.weight)])[self.first])
        slot = np.concatenate([[0], np.cumsum(self.template <= UNIT)])
        change = np.concatenate([[0], np.cumsum(self.template[1:] != self.template[:-1])]) if len(self.template) else np.zeros(0, int)
        self.tables: list[tuple[bool, Table]] = []
        self.free = np.zeros(len(sizes), dtype=np.int64)
        for w in range(1, WINDOW + 1):
            own = np.flatnonzero(sizes >= w if w == WINDOW else sizes == w)
            starts = np.concatenate([np.arange(self.first[k], self.first[k + 1] - w + 1) for k in own] or [np.zeros(0, np.int64)]).astype(np.int64)
            slots = slot[starts + w] - slot[starts]
            by_words = (slots == w) & (change[starts + w - 1] == change[starts]) if w == WINDOW else w - slots < WINDOW // 2
            self.tables += [(plain, Table(self.plain if plain else self.template, w, starts[by_words == plain])) for plain in (False, True) if (by_words == plain).any()]
            if w == WINDOW:  # Words of windows of one kind count wherever their diagonal is met.
                any_of = np.unique((starts[by_words, None] + np.arange(w)).ravel())
                self.free = np.bincount(np.searchsorted(self.first, any_of, side="right") - 1, self.weight[any_of], minlength=len(sizes))

    def maybe(self, template: np.ndarray, plain: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The texts with a window that may be an item's."""
        found = np.zeros(len(first) - 1, dtype=bool)
        for by_words, table in self.tables:
            hit = table.maybe(plain if by_words else template)
            hits = np.concatenate([[0], np.cumsum(hit)])
            ends = np.minimum(np.maximum(first[1:] - table.width + 1, first[:-1]), len(hit))
            found |= hits[ends] > hits[np.minimum(first[:-1], len(hit))]
        return np.flatnonzero(found)

    def spans(self, template: np.ndarray, plain: np.ndarray, weight: np.ndarray, a: int, b: int, least: float) -> list[tuple[int, int, int, float]]:
        """Matches in one document's tokens a..b: (item, first word, words, share of the item)."""
        upto = np.concatenate([[0], np.cumsum(weight[a:b])])
        template, plain = template[a:b], plain[a:b]
        met = [(*table.hits(plain if by_words else template), table.width) for by_words, table in self.tables]
        own, shift = np.concatenate([o for _, o, _ in met]), np.concatenate([d - o for d, o, _ in met])
        if not len(own):
            return []
        item = np.searchsorted(self.first, own, side="right") - 1
        # Items that can't reach the share on all diagonals together go at once.
        words = np.unique(np.concatenate([(np.unique(o)[:, None] + np.arange(w)).ravel() for _, o, w in met]))
        most = np.bincount(np.searchsorted(self.first, words, side="right") - 1, self.weight[words], minlength=len(self.free)) + self.free
        near = (most >= np.minimum(least * self.words, LONG))[item]
        item, shift = item[near], shift[near]
        order = np.lexsort((shift, item))
        item, shift = item[order], shift[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
        item, shift = item[new], shift[new]
        edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else np.zeros(1, int)
        rows = [row for x, y in zip(edge[:-1], edge[1:]) for row in self._passages(template, plain, int(item[x]), shift[x:y].tolist(), least)]
        return [(k, int(upto[d]), int(upto[d + n] - upto[d]), share) for k, d, n, share in rows]

    def _passages(self, template: np.ndarray, plain: np.ndarray, k: int, shifts: list[int], least: float) -> list[tuple[int, int, int, float]]:
        """Matches of one item: diagonals that suffice alone, then near ones taken together."""
        size, out, rest = int(self.first[k + 1] - self.first[k]), [], []
        for s in shifts:
            lo, hi = max(int(self.first[k]), -s), min(int(self.first[k + 1]), len(template) - s)
            starts, ends = _runs(self.template[lo:hi] == template[lo + s : hi + s], min(WINDOW, size))
            if not len(starts):
                continue
            own = np.concatenate([np.arange(x, y) for x, y in zip(starts, ends)]) + lo
            row = self._accepted(plain, k, own + s, own, least)
            if row:
                out.append(row)
            else:
                rest += [(int(x) + lo + s, int(y) + lo + s, s) for x, y in zip(starts, ends)]
        if len(rest) > 1:
            rest = [r for r in sorted(rest) if not any(a <= r[0] and r[1] <= a + n for _, a, n, _ in out)]
        while len(rest) > 1:
            doc, own, used = self._chain(rest, size)
            row = self._accepted(plain, k, doc, own, least) if self.weight[own].sum() >= min(least * self.words[k], LONG) else None
            if not row:
                break
            out.append(row)
            rest = [r for r in rest if r not in used and not (row[1] <= r[0] and r[1] <= row[1] + row[2])]
        return out

    def _chain(self, runs: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray, set]:
        """The runs (start, end, shift) of one item that cover most of it in its order, each within an item's length of the one before; document and item words, overlaps once."""
        start, end, shift = (np.array(x) for x in zip(*runs))
        score, back = (end - start).astype(float), np.full(len(runs), -1)
        for j in range(1, len(runs)):
            # What j adds after i: its words behind the ends of i in the document and in the item.
            cut = np.maximum(start[j], np.maximum(end[:j], end[:j] - shift[:j] + shift[j]))
            gain = end[j] - cut
            near = (gain > 0) & (start[j] - end[:j] <= size) & (np.abs(shift[j] - shift[:j]) <= size) & (start[j] - shift[j] >= start[:j] - shift[:j])
            total = np.where(near, score[:j] + gain, -1.0)
            i = int(np.argmax(total))
            if total[i] > score[j]:
                score[j], back[j] = total[i], i
        j, path = int(np.argmax(score)), []
        while j >= 0:
            path.append(j)
            j = int(back[j])
        doc, own, at, item_at = [], [], -1, -1
        for j in reversed(path):
            a = max(int(start[j]), at, item_at + int(shift[j]))
            doc.append(np.arange(a, end[j]))
            own.append(np.arange(a, end[j]) - shift[j])
            at, item_at = int(end[j]), int(end[j] - shift[j])
        return np.concatenate(doc), np.concatenate(own), {runs[j] for j in path}

    def _accepted(self, plain: np.ndarray, k: int, doc: np.ndarray, own: np.ndarray, least: float) -> tuple[int, int, int, float] | None:
        """The match that words doc[i] ~ own[i] make, if they make one."""
        size = int(self.first[k + 1] - self.first[k])
        for keep in self._stretches(plain, doc, own, size):
            d, o = doc[keep], own[keep]
            covered = int(self.weight[o].sum())
            if covered >= least * self.words[k] and self._evident(plain, d, o, size):
                return k, int(d[0]), int(d[-1] - d[0] + 1), float(covered / self.words[k])
        # A long run of the item's own words counts whatever its share.
        same = self.plain[own] == plain[doc]
        joins = np.concatenate([[True], (doc[1:] == doc[:-1] + 1) & (own[1:] == own[:-1] + 1)])
        upto, best = np.concatenate([[0], np.cumsum(self.weight[own])]), (0, 0, 0)
        for a, b in zip(*_runs(same, 1)):
            cuts = [a, *(a + 1 + np.flatnonzero(~joins[a + 1 : b])).tolist(), b]
            best = max([best, *((int(upto[y] - upto[x]), int(x), int(y)) for x, y in zip(cuts, cuts[1:]))])
        n, a, b = best
        return (k, int(doc[a]), b - a, float(n / self.words[k])) if n >= LONG else None

    def _stretches(self, plain: np.ndarray, doc: np.ndarray, own: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Choices of words without conflict between slots: all; those of windows with few placeholders; the longest stretch that mostly has the item's own values."""
        everything = np.arange(len(doc))
        if self._consistent(plain, doc, own):
            yield everything
            return
        if size >= WINDOW:
            slots = np.convolve(self.template[own] <= UNIT, np.ones(WINDOW, int), "valid") if len(own) >= WINDOW else np.zeros(0, int)
            whole = (doc[WINDOW - 1 :] - doc[: len(slots)] == WINDOW - 1) & (own[WINDOW - 1 :] - own[: len(slots)] == WINDOW - 1)
            light = np.unique((np.flatnonzero((slots <= WINDOW // 2) & whole)[:, None] + np.arange(WINDOW)).ravel())
            if len(light) and self._consistent(plain, doc[light], own[light]):
                yield light
        slot = self.template[own] <= UNIT
        x, y = self.plain[own], plain[doc]
        differ, best = slot & (x != y), (0, 0)
        to: dict[int, tuple[int, int]] = {}
        fro: dict[int, tuple[int, int]] = {}
        a = 0
        at = np.flatnonzero(differ).tolist()
        balance, other = (np.concatenate([[0], np.cumsum(x)]) for x in (slot.astype(int) - 2 * differ, differ))
        for i in [*at, len(doc)]:
            # The stretch a..i is consistent; it counts from where most of its slots are the item's own.
            if i - a > best[1] - best[0]:
                fit = a + np.flatnonzero((balance[i] > balance[a:i]) | (other[i] == other[a:i]))
                if len(fit) and i - fit[0] > best[1] - best[0]:
                    best = (int(fit[0]), i)
            if i == len(doc):
                break
            u, v = int(x[i]), int(y[i])
            for seen, one, two in ((to, u, v), (fro, v, u)):
                if one in seen and seen[one][1] != two:
                    a = max(a, seen[one][0] + 1)
            to[u], fro[v] = (i, v), (i, u)
        if best[1] > best[0]:
            yield everything[best[0] : best[1]]

    def _evident(self, plain: np.ndarray, doc: np.ndarray, own: np.ndarray, size: int) -> bool:
        """Do the covered words say more than their kinds? Placeholders alone count if the words behind them are the item's, or as the whole frame of the item."""
        frame, same = self.template[own], int((self.plain[own] == plain[doc]).sum())
        if (frame > UNIT).sum() >= WINDOW // 2 or same == len(own):
            return True
        return size >= WINDOW and (3 * same >= len(own) or (len(own) == size and len(np.unique(frame)) > 1))

    def _consistent(self, plain: np.ndarray, doc: np.ndarray, own: np.ndarray) -> bool:
        """Do the values behind matching placeholders that differ map one to one?"""
        x, y = self.plain[own], plain[doc]
        slot = (self.template[own] <= UNIT) & (x != y)
        x, y = x[slot], y[slot]
        pairs = len(np.unique(np.stack([x, y], axis=1), axis=0)) if len(x) else 0
        return pairs == len(np.unique(x)) == len(np.unique(y))


def _matches(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        template, plain, first, weight = templates(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        maybe = items.maybe(template, plain, first)
        rows = [(ids[i], items.ids[k], a, n, share) for i in maybe.tolist() for k, a, n, share in items.spans(template, plain, weight, int(first[i]), int(first[i + 1]), least)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "first_word", "n_words", "share"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of each item's windows, with the kind of window: its width, and whether words or templates count."""
    for batch in slices(batches, "item_text"):
        rows = []
        for key, text in zip(batch.column("item").to_pylist(), batch.column("item_text").to_pylist()):
            for by_words, table in Items([0], pa.array([text], pa.string())).tables:
                kind = 2 * table.width + by_words
                rows += [(key, kind, h) for h in np.unique(mix(table.h ^ U64(kind))).view(np.int64).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["item", "kind", "h"])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of the windows' last bits, of fixed size."""
    bits = np.zeros(FILTER, dtype=bool)
    for batch in batches:
        bits[batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64) & U64(FILTER - 1)] = True
    yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]}, schema=pa.schema([("bits", pa.binary())]))


def _doc_windows(batches: Iterator[pa.RecordBatch], kinds: list[int], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Names of the windows of each text that may be an item's."""
    for batch in slices(batches):
        template, plain, first, weight = templates(batch.column("text"))
        keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(keys)), np.diff(first))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for kind in kinds:
            width = kind // 2
            h = mix(window_hashes(plain if kind % 2 else template, width) ^ U64(kind))
            at = np.arange(len(h))
            ok = bits[h & U64(FILTER - 1)] & (doc[at] == doc[at + width - 1])
            found.append((keys[doc[at[ok]]], h[ok]))
        key, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if len(key):
            key, h = np.unique(np.stack([key, h.view(np.int64)], axis=1), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key)), pa.array(np.ascontiguousarray(h).view(np.int64))], names=["key", "h"])


def _checked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Passages of each text among its own candidate items."""
    for batch in slices(batches):
        template, plain, first, weight = templates(batch.column("text"))
        rows = []
        for i, (doc, items) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("items").to_pylist())):
            own = Items([x["item_id"] for x in items], pa.array([x["item_text"] for x in items], pa.string()))
            rows += [(doc, own.ids[k], a, n, share) for k, a, n, share in own.spans(template, plain, weight, int(first[i]), int(first[i + 1]), least)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "first_word", "n_words", "share"])


def _joined(docs: DataFrame, items: DataFrame, least: float, schema: str) -> DataFrame:
    """The hash join of windows by shuffle, for benchmarks too large to broadcast; documents are scanned for windows once."""
    items = items.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    windows = written(items.select("item", "item_text").mapInArrow(_item_windows, "item long, kind int, h long"), "windows")
    kinds = sorted(r["kind"] for r in windows.select("kind").distinct().collect())  # twelve at most
    bits = np.zeros(FILTER, dtype=bool)
    for r in windows.select("h").coalesce(64).mapInArrow(_seen, "bits binary").toLocalIterator():
        bits |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).view(bool)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    met = keyed.select("key", "text").mapInArrow(lambda it: _doc_windows(it, kinds, shared.value), "key long, h long").distinct()
    pairs = met.join(windows.select("item", "h").distinct(), "h").select("key", "item").distinct()
    lists = pairs.join(items.dropDuplicates(["item"]), "item").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item_id", "item_text"))).alias("items"))
    return keyed.join(lists, "key").select("doc_id", "text", "items").mapInArrow(lambda it: _checked(it, least), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words, share): passages of docs that repeat an item.

    A passage counts if its matching windows cover at least `least` of the
    item's words and its slots are consistent, or if it has LONG words of the
    item in one run.  Null texts and ids on either
    side match nothing; an item of fewer than six words is met as a whole; texts that share an id are matched one by one, equal rows of the benchmark as one; an empty table on
    either side gives no rows.  Only doc_id, item_id and text are read.
    """
    small_batches(docs)
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, n_words long, share double"
    # A text has at most as many windows as bytes, so a benchmark within the bound can be broadcast.
    if int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        return _joined(docs, items, least, schema)
    rows = items.orderBy("item_id", "text").collect()
    block = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string())))
    return docs.mapInArrow(lambda it: _matches(it, block.value, least), schema)
