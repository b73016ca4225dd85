"""Pages made of repeated keywords, lists of links or product tags, told from running text and from lists of the record.

A page is cut into units of at most 24 words: sentences, lines and pieces of these. Each unit has features of density (links,
hashtags, lists behind a label), affinity (its content words are those of link lists and repetitions elsewhere in the corpus),
repetition in the unit and of items in the page, lack of entropy, lack of function words, disguised words, and amounts.
Nothing is known of the words beforehand: function words are those that a quarter of a language's pages hold, and words of
affinity are found by counts over the whole corpus, from units that are plainly links or repetition. Per language, medians
and deviations over all units and the correlation of the features, from moments of values cut at three deviations, give a
robust Mahalanobis distance that outliers do not shift. A unit is flagged if it is an outlier that lies in a spam-directed
direction: lists of names lack function words but little else, and lists of amounts point the other way. A page is reported
when more than half of its characters lie in flagged stretches.

Words are numbers of 20 bits in all counts, so tables over the vocabulary keep their size whatever the corpus. A token weighs
at most 65,535 characters.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.cluster import checkpoint

#: Signs and words of amounts, digits used for letters, and Cyrillic letters that look like Latin ones.
AMOUNTS = frozenset(
    "% ‰ £ $ € per cent pct percent prozent pour por ciento procent τοις εκατό million millions millionen millones milion miliony "
    "milionów mln mio mil billion milliard milliarden εκατομμύρια εκατ".split()
)
LEET = str.maketrans("430157", "aeoist")
LOOKS = str.maketrans("аеорсухіјѕԁһ", "aeopcyxijsdh")

FEATURES = ("density", "affinity", "repeat_in_unit", "repeat_in_page", "entropy_lack", "function_lack", "disguise", "amounts")
#: How far each feature points to spam; amounts point away from it, lack of function words alone hardly counts.
DIRECTION = np.array([1.0, 1.0, 0.8, 1.0, 0.4, 0.25, 1.0, -1.5])
#: Least deviation of each feature, for those that nearly all units lack.
LEAST = np.array([0.05, 0.08, 0.08, 0.08, 0.08, 0.08, 0.05, 0.08])
#: Distance past which a unit is an outlier, the least cosine of its angle to the direction, and the share of a page's characters.
DISTANCE, ALIGNED, SHARE = 6.25, 0.25, 0.5
PIECE_WORDS, ITEM_WORDS = 24, 6
#: The share of a language's pages that hold a function word, and the share of all pages that a label of a language has.
FUNCTION_PAGES, LANGUAGE_PAGES = 0.25, 0.001
#: Plain units: their density, or their repetition. Shares of a word's occurrences in plain units from which on it has affinity, first and then.
PLAIN_DENSITY, PLAIN_REPEAT, ROUNDS = 0.3, 0.5, (0.02, 0.5)
#: Pages from which on a language's own figures outweigh those of all languages together.
SHRINK_PAGES = 50
#: Units to each side that decide with a unit whether its stretch is flagged.
REACH = 2

BITS = 20
WORD, NUMBER, LINK, TAG, LINE, STOP, MARK = range(7)
DISGUISED, LETTER, AMOUNT, SEPARATOR, UPPER, COLON, OPEN, CLOSE = (1 << k for k in range(3, 11))
#: Tokens to a block of pages that is handled at once; a longer page is a block of its own.
BLOCK = 1_000_000

_TOKEN = re.compile(
    r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\s<>\"'()\[\]|]+|(?:[\w-]+\.)+[a-z]{2,}(?![\w.])(?:[/?#:][^\s<>\"'()\[\]|]*)?"
    r"|#\w[\w-]+|[^\W_]+(?:['’-][^\W_]+)*|\n|[^\w\s]"
)
_INNER_DIGIT = re.compile(r"[^\W\d_]\d+[^\W\d_]|^\d+[^\W\d_]{2,}\d|^\d[^\W\d_]{2,}")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_DAMAGE = ("Ã", "Å", "Ä", "Î", "â€")


def tidy(text: str) -> str:
    """Line ends made plain, and UTF-8 that was read as Latin-1 mended."""
    if any(d in text for d in _DAMAGE):
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _plain(word: str) -> tuple[str, bool]:
    """A word without its disguise, and whether it had one."""
    word, disguised = word.lower(), False
    if not word.isascii() and any("Ѐ" <= c <= "ӿ" for c in word) and any(c.isascii() and c.isalpha() for c in word):
        word, disguised = word.translate(LOOKS), True
    if not word.isalpha() and len(word) >= 4 and any(c in "430157" for c in word) and sum(c.isalpha() for c in word) >= 2 and _INNER_DIGIT.search(word):
        word, disguised = word.translate(LEET), True
    return word, disguised


def token_code(t: str) -> int:
    """Flags in the low 12 bits, then 16 bits of length and 20 of the word's number."""
    first, size, word = t[0], len(t), 0
    if t == "\n":
        code = LINE
    elif first == "#" and size > 1:
        code = TAG
    elif size == 1 and not first.isalnum():
        code = (STOP if t in ".!?…" else MARK) | (SEPARATOR if t in ",;|/•·»›>–—-:()[]" else 0)
        code |= (COLON if t == ":" else 0) | (OPEN if t in "([" else 0) | (CLOSE if t in ")]" else 0)
    elif "/" in t or "." in t:
        code = LINK
    elif t.isdigit():
        code, word = NUMBER, zlib.crc32(t.encode()) & ((1 << BITS) - 1)
    else:
        plain, disguised = _plain(t)
        word = zlib.crc32(plain.encode()) & ((1 << BITS) - 1)
        code = WORD | (DISGUISED if disguised else 0) | (LETTER if size == 1 else 0)
    code |= (AMOUNT if t.lower() in AMOUNTS else 0) | (UPPER if first.isupper() else 0)
    return code | min(size, 65_535) << 12 | word << 28


class Tokens(dict):
    """From what stands between two blanks to the codes of its tokens, in compatibility form and without zero-width characters.

    Only a memory, as most words come again: it may be emptied at any time.
    """

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        codes = tuple(map(token_code, _TOKEN.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", chunk)))))
        if len(self) > 400_000:
            self.clear()
        if len(chunk) < 100:
            self[chunk] = codes
        return codes

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, tidy(text).replace("\n", " \n ").split(" "))), np.int64)


# ---- pages as tokens, and the words that most pages of a language hold ----------------------------------------------

PAGES = "doc_id bigint, n int, codes binary, label string, word array<int>, pages array<bigint>"


def _groups(batches: Iterator[pa.RecordBatch], weight: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none weighs much more than ``BLOCK``."""
    for b in batches:
        if b.num_rows:
            part = np.cumsum(weight(b)) // BLOCK
            at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            yield from (b.slice(lo, hi - lo) for lo, hi in zip(at, at[1:]))


def page_tokens(docs: DataFrame, ident: Column, text: Column, label: Column) -> DataFrame:
    """A row of codes for every page with text, and rows of how many pages of a label hold a word (word -1: how many pages there are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in _groups(batches, lambda b: pc.binary_length(b.column("text")).to_numpy() // 5):
            found = [known.of(t) for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in found])
            flat = np.concatenate(found)
            codes = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int32()), pa.array(codes, pa.binary()), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.list_(pa.int32())), pa.nulls(len(n), pa.list_(pa.int64()))],
                names=["doc_id", "n", "codes", "label", "word", "pages"],
            )
            word = (flat & 7) == WORD
            held = _distinct(np.repeat(np.arange(len(n)), n)[word] << BITS | flat[word] >> 28)
            labels = b.column("label").dictionary_encode()
            label_no = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = labels.dictionary.to_pylist()
            keys, times = np.unique(label_no[held >> BITS] << BITS | held & ((1 << BITS) - 1), return_counts=True)
            cut = np.searchsorted(keys, np.arange(len(names) + 1) << BITS)
            rows = [
                (name, np.append(keys[lo:hi] & ((1 << BITS) - 1), -1).astype(np.int32), np.append(times[lo:hi], (label_no == k).sum()))
                for k, (name, lo, hi) in enumerate(zip(names, cut, cut[1:])) if name
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))))],
                    names=["doc_id", "n", "codes", "label", "word", "pages"],
                )

    name = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2})(?:[^a-z]|$)", 1)
    texts = docs.select(ident.cast("bigint").alias("doc_id"), text.alias("text"), F.coalesce(name, F.lit("")).alias("label")).where(F.col("text").rlike(r"\S"))
    return texts.mapInArrow(run, PAGES)


def function_words(pages: DataFrame) -> np.ndarray:
    """A row of bits over the word numbers for each language: the words that ``FUNCTION_PAGES`` of its pages hold.

    A language is a two-letter label of at least ``LANGUAGE_PAGES`` of the labelled pages, so there are at most 676. At
    most ``tokens a page / FUNCTION_PAGES`` words of each reach the driver.
    """
    counts = pages.where("codes is null").select("label", F.explode(F.arrays_zip("word", "pages")).alias("x")).groupBy("label", F.col("x.word").alias("word")).agg(F.sum("x.pages").alias("pages"))
    counts = checkpoint(counts)
    total = {r["label"]: r["pages"] for r in counts.where("word = -1").collect()}
    langs = sorted(k for k, v in total.items() if v >= LANGUAGE_PAGES * sum(total.values()))
    table = np.zeros((len(langs), 1 << BITS), bool)
    if langs:
        need = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(FUNCTION_PAGES * total[k]))])
        for r in counts.where((F.col("word") >= 0) & (F.col("pages") >= need[F.col("label")])).collect():
            table[langs.index(r["label"]), r["word"]] = True
    return table


# ---- units -----------------------------------------------------------------------------------------------------------

UNITS = "doc_id bigint, lang int, units int, chars binary, features binary, n_words binary, words binary, labels binary"


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _times(group: np.ndarray, item: np.ndarray, groups: int) -> np.ndarray:
    """How often each item occurs in its group, for every row. One sort of plain numbers: group, item and row share 63 bits."""
    rows = len(group)
    if not rows:
        return np.zeros(0, np.int64)
    row_bits, group_bits = rows.bit_length(), groups.bit_length()
    keys = np.sort((group << (63 - group_bits)) | (item & ((1 << (63 - group_bits - row_bits)) - 1)) << row_bits | np.arange(rows))
    same = keys >> row_bits
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    times = np.diff(np.append(first, rows))
    out = np.empty(rows, np.int64)
    out[keys & ((1 << row_bits) - 1)] = np.repeat(times, times)
    return out


def unit_features(flat: np.ndarray, n: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """Units of some pages, one after the other: their page, characters, features that need no corpus, content words and labels.

    Features are in 0 to 200. ``label_*`` are the words before a colon with the unit of the colon, the last unit of its line
    and the characters up to it: what follows a word of affinity is a list.
    """
    size_of, rows = (flat >> 12) & 0xFFFF, len(flat)
    kind, doc = flat & 7, np.repeat(np.arange(len(n)), n)
    word_no = flat >> 28
    word, number, linky = kind == WORD, kind == NUMBER, (kind == LINK) | (kind == TAG)
    has = lambda bit: (flat & bit) > 0
    fresh = np.ones(rows, bool)
    fresh[1:] = doc[1:] != doc[:-1]

    # sentences and lines, cut into pieces of so many words
    line_start = fresh.copy()
    line_start[1:] |= kind[:-1] == LINE
    ends = (kind == LINE) | (kind == STOP)
    ends[:-1] &= (kind[:-1] == LINE) | has(UPPER)[1:] | ((kind[1:] != WORD) & (kind[1:] != NUMBER))
    sentence_start = fresh.copy()
    sentence_start[1:] |= ends[:-1]
    counts = word | number | linky
    so_far = np.cumsum(counts)
    at = np.flatnonzero(sentence_start)
    before = np.repeat((so_far - counts)[at], np.diff(np.append(at, rows)))
    piece = np.maximum(so_far - before - 1, 0) // PIECE_WORDS
    unit_start = sentence_start.copy()
    unit_start[1:] |= piece[1:] != piece[:-1]
    first = np.flatnonzero(unit_start)
    units = len(first)
    unit = np.cumsum(unit_start) - 1
    sums = lambda x: np.add.reduceat(x.astype(np.int64), first)
    chars, n_words = sums(size_of + 1), sums(word)

    # the language whose function words the page has most of; without any it is -1
    lang = np.full(len(n), -1)
    spoken = np.zeros(rows, bool)
    if len(table):
        words_at = np.flatnonzero(word)
        score = np.stack([np.bincount(doc[words_at], t[word_no[words_at]], len(n)) for t in table])
        lang = np.where(score.max(axis=0) > 0, score.argmax(axis=0), -1)
        spoken[words_at] = table[lang[doc[words_at]], word_no[words_at]] & (lang[doc[words_at]] >= 0)
    content = word & ~spoken & (size_of > 1)

    # repetition: words and pairs of words in a unit, outside of brackets
    depth = np.cumsum(has(OPEN).astype(np.int64) - has(CLOSE))
    line_at = np.flatnonzero(line_start)
    line = np.cumsum(line_start) - 1
    outside = depth - np.where(line_at > 0, depth[np.maximum(line_at - 1, 0)], 0)[line] <= 0
    w = np.flatnonzero(word & outside & ~has(AMOUNT))
    wu, no = unit[w], word_no[w]
    times = _times(wu, no, units)
    again = content[w] & (times >= 2)
    pair = np.flatnonzero(wu[1:] == wu[:-1])
    twice = pair[_times(wu[pair], (no[pair] * 1_000_003 + no[pair + 1]) & 0x7FFFFFFF, units) >= 2]
    again[twice] = again[twice + 1] = True
    repeat = np.bincount(wu, again, units) / np.maximum(n_words, 4)
    held = np.bincount(wu, minlength=units)
    entropy = np.log(np.maximum(held, 1)) - np.bincount(wu, np.log(times), units) / np.maximum(held, 1)
    lack = np.where(held >= 4, 1 - entropy / np.log(np.maximum(held, 2)), 0.0)

    # items between separators that come back in the page, unless in a sentence with an end or with an amount
    apart = (kind == LINE) | (kind == STOP) | linky | has(SEPARATOR)
    item_start = fresh.copy()
    item_start[1:] |= apart[:-1] | apart[1:]
    item_at = np.flatnonzero(item_start)
    item = np.cumsum(item_start) - 1
    place = np.arange(rows) - item_at[item] + 1
    add = lambda x: np.add.reduceat(x.astype(np.int64), item_at)
    item_words, item_chars = add(word), add(size_of + 1)
    last = np.append(first[1:], rows) - 1
    ended = kind[np.where(kind[last] == LINE, np.maximum(last - 1, first), last)] == STOP
    able = np.flatnonzero((item_words > 0) & (item_words <= ITEM_WORDS) & (item_chars >= 5) & (add(has(AMOUNT)) == 0) & ~ended[unit[item_at]])
    name = add(np.where(word | number, (word_no * 2_654_435_761 >> 7 & 0x7FFFFFFF) * place, 0)) & 0x7FFFFFFF
    often = able[_times(doc[item_at[able]], name[able], len(n)) >= 3]
    listed = np.bincount(unit[item_at[often]], item_chars[often], units) / chars

    letter, lone = has(LETTER), np.zeros(rows, bool)
    lone[2:] = letter[2:] & letter[1:-1] & letter[:-2] & (doc[2:] == doc[:-2])
    share = lambda x, y: sums(x) / np.maximum(y, 1)
    features = np.stack([
        sums(np.where(linky, size_of + 1, 0)) / chars, repeat, listed, lack, np.where(n_words > 0, 1 - share(spoken, n_words), 1.0),
        share((has(DISGUISED) & word) | lone, n_words), 3 * share(has(AMOUNT), sums(word | number)),
    ], axis=1)

    colon = np.flatnonzero(has(COLON))
    colon = colon[(colon > 0)]
    colon = colon[content[colon - 1] & (doc[colon] == doc[colon - 1])]
    line_last = unit[np.append(line_at[1:], rows) - 1]
    upto = np.cumsum(size_of + 1)
    return {
        "doc": doc[first], "lang": lang, "chars": chars, "features": np.round(200 * np.clip(features, 0, 1)).astype(np.uint8),
        "n_words": sums(content), "words": word_no[content],
        "label_doc": doc[colon], "label_word": word_no[colon - 1], "label_unit": unit[colon], "label_last": line_last[line[colon]],
        "label_before": upto[colon] - (upto - size_of - 1)[first[unit[colon]]],
    }


def page_units(pages: DataFrame, table: np.ndarray) -> DataFrame:
    """The units of every page, in compact form. Tasks get the function words as bits, an eighth of a megabyte a language."""
    bits, shape = np.packbits(table), table.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool)
        for b in _groups(batches, lambda b: b.column("n").to_numpy()):
            n = b.column("n").to_numpy().astype(np.int64)
            keep = np.flatnonzero(n)
            if not len(keep):
                continue
            codes = b.column("codes").to_pylist()
            flat = np.concatenate([np.frombuffer(pa.decompress(codes[k], int(n[k]) * 8, "zstd", asbytes=True), np.int64) for k in keep])
            x = unit_features(flat, n[keep], table)
            units = np.bincount(x["doc"], minlength=len(keep))
            to = np.cumsum(units)
            word_to = np.append(0, np.cumsum(x["n_words"]))
            label_to = np.cumsum(np.bincount(x["label_doc"], minlength=len(keep)))
            rows: list[list] = [[], [], [], [], []]
            start = label_start = 0
            for k, stop in enumerate(to.tolist()):
                mine = slice(label_start, label_to[k])
                label = np.stack([x["label_word"][mine], x["label_unit"][mine] - start, x["label_last"][mine] - start, x["label_before"][mine]], axis=1)
                parts = (x["chars"][start:stop].astype(np.int32), x["features"][start:stop], x["n_words"][start:stop].astype(np.uint8), x["words"][word_to[start] : word_to[stop]].astype(np.int32), label.astype(np.int32))
                for column, part in zip(rows, parts):
                    column.append(part.tobytes())
                start, label_start = stop, label_to[k]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(keep)), pa.array(x["lang"], pa.int32()), pa.array(units, pa.int32()), *(pa.array(r, pa.binary()) for r in rows)],
                names=[c.split()[0] for c in UNITS.split(", ")],
            )

    return pages.where("codes is not null").select("doc_id", "n", "codes").mapInArrow(run, UNITS)


class Block:
    """Units of many pages as flat arrays; with the words of affinity their features are whole."""

    def __init__(self, b: pa.RecordBatch):
        whole = lambda name, t: np.frombuffer(b"".join(b.column(name).to_pylist()), t)
        self.units = b.column("units").to_numpy().astype(np.int64)
        self.page = np.repeat(np.arange(b.num_rows), self.units)
        self.lang = b.column("lang").to_numpy()[self.page]
        self.chars = whole("chars", np.int32).astype(np.int64)
        self.raw = whole("features", np.uint8).reshape(-1, len(FEATURES) - 1) / 200.0
        self.n_words, self.words = whole("n_words", np.uint8).astype(np.int64), whole("words", np.int32)
        self.word_unit = np.repeat(np.arange(len(self.page)), self.n_words)
        labels = [len(x) // 16 for x in b.column("labels").to_pylist()]
        self.label = whole("labels", np.int32).reshape(-1, 4).astype(np.int64)
        self.label[:, 1:3] += np.repeat(np.cumsum(self.units) - self.units, labels)[:, None]

    def akin(self, affinity: np.ndarray) -> np.ndarray:
        """Words of affinity in each unit."""
        return np.bincount(self.word_unit, affinity[self.words], len(self.page))

    def plain(self, affinity: np.ndarray | None) -> np.ndarray:
        """Units that are plainly links or, once words of affinity are known, repetition or made of such words."""
        seeds = self.raw[:, 0] > PLAIN_DENSITY
        if affinity is not None:
            seeds |= (self.n_words >= 3) & ((self.raw[:, 1] >= PLAIN_REPEAT) | (self.akin(affinity) > 0.5 * self.n_words))
        return seeds

    def features(self, affinity: np.ndarray) -> np.ndarray:
        packed = self.raw[:, 0].copy()
        for _, at, last, before in self.label[affinity[self.label[:, 0]]]:
            packed[at] = max(packed[at], 1 - before / self.chars[at])
            packed[at + 1 : last + 1] = 1.0
        return np.column_stack([packed, self.akin(affinity) / np.maximum(self.n_words, 3), self.raw[:, 1:]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for b in _groups(batches, lambda b: 8 * b.column("units").to_numpy()):
        yield b, Block(b)


# ---- words of affinity -----------------------------------------------------------------------------------------------


def affinity(paged: DataFrame) -> np.ndarray:
    """Bits over the word numbers: the words so many of whose occurrences, in all units, lie in plain ones. The driver gets one table of 20 bits' size a round."""
    known: np.ndarray | None = None
    total = np.zeros(1 << BITS, np.int64)
    for round_no, least in enumerate(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], known=known, whole=not round_no) -> Iterator[pa.RecordBatch]:
            seen, all_words = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
            for _, x in _blocks(batches):
                seen += np.bincount(x.words[x.plain(known)[x.word_unit]], minlength=1 << BITS)
                if whole:
                    all_words += np.bincount(x.words, minlength=1 << BITS)
            at = np.flatnonzero(seen + all_words)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]), pa.array(all_words[at])], names=["word", "plain", "total"])

        counts = paged.mapInArrow(run, "word int, plain bigint, total bigint").groupBy("word").agg(F.sum("plain").alias("plain"), F.sum("total").alias("total")).toPandas()
        plain = np.zeros(1 << BITS, np.int64)
        plain[counts["word"]] = counts["plain"]
        if not round_no:
            total[counts["word"]] = counts["total"]
        known = (plain >= 3) & (plain >= least * (total + 5))
    return known


# ---- the standard of each language, and the verdict ------------------------------------------------------------------


def profiles(paged: DataFrame, known: np.ndarray, langs: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Median, deviation and inverse correlation of the features for each language's units; the last one holds for pages in no language.

    Each page weighs the same, shared by its units, so no long page is its own standard. A language's figures are drawn
    towards those of all pages together by ``SHRINK_PAGES`` pages' weight, so its standard changes smoothly with its size.
    Medians and deviations come from histograms of 201 steps.
    """
    d = len(FEATURES)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((langs + 1, d, 201))
        for _, x in _blocks(batches):
            weight = 1 / x.units[x.page]
            step = np.round(200 * x.features(known)).astype(np.int64)
            lang = np.where(x.lang < 0, langs, x.lang)
            for k in range(d):
                seen[:, k] += np.bincount(lang * 201 + step[:, k], weight, (langs + 1) * 201).reshape(-1, 201)
        yield pa.RecordBatch.from_arrays([pa.array([seen.ravel()], pa.list_(pa.float64()))], names=["x"])

    def summed(run, schema: str) -> np.ndarray:
        rows = paged.mapInArrow(run, schema).select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(len(rows))
        out[rows["k"]] = rows["v"]
        return out

    seen = summed(histograms, "x array<double>").reshape(-1, d, 201)
    seen = np.concatenate([seen, seen.sum(axis=0, keepdims=True)])

    def middle(h: np.ndarray, at: np.ndarray) -> float:
        order = np.argsort(at, kind="stable")
        return float(at[order][np.searchsorted(np.cumsum(h[order]), max(h.sum() / 2, 1e-9))])

    grid = np.arange(201) / 200
    mids, scales, size = np.zeros((langs + 2, d)), np.ones((langs + 2, d)), seen[:, 0].sum(axis=1)
    for g in range(langs + 2):
        for k in range(d):
            mids[g, k] = middle(seen[g, k], grid)
            scales[g, k] = max(1.4826 * middle(seen[g, k], np.abs(grid - mids[g, k])), LEAST[k])
    weight = (size / (size + SHRINK_PAGES))[:, None]
    weight[langs:] = 0  # pages in no language are mostly lists, and would be their own standard
    mids, scales = weight * mids + (1 - weight) * mids[-1], weight * scales + (1 - weight) * scales[-1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((langs + 1, d + 1, d + 1))
        for _, x in _blocks(batches):
            lang = np.where(x.lang < 0, langs, x.lang)
            z = np.clip((x.features(known) - mids[lang]) / scales[lang], -3, 3)
            z = np.column_stack([z, np.ones(len(z))]) / np.sqrt(x.units[x.page])[:, None]
            for g in np.unique(lang):
                own = z[lang == g]
                out[g] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], names=["x"])

    sums = summed(moments, "x array<double>").reshape(-1, d + 1, d + 1)
    sums = np.concatenate([sums, sums.sum(axis=0, keepdims=True)])
    corr = np.stack([_correlation(s) for s in sums])
    corr = weight[:, :, None] * corr + (1 - weight[:, :, None]) * corr[-1]
    return [(mids[g], scales[g], np.linalg.inv(corr[g])) for g in range(langs + 1)]


def _correlation(s: np.ndarray) -> np.ndarray:
    """Half the correlation off the diagonal, from sums of products with a last column of ones."""
    n = max(s[-1, -1], 1e-9)
    mean = s[-1, :-1] / n
    cov = s[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = 0.5 * cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 1.0)
    return corr


def flagged(features: np.ndarray, lang: np.ndarray, standard: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which units are outliers in a spam-directed direction: far off, at a small enough angle to it."""
    bad = np.zeros(len(features), bool)
    for g in np.unique(lang):
        mid, scale, inverse = standard[g]
        own = lang == g
        z = np.clip((features[own] - mid) / scale, -12, 12)
        far = np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", z, inverse, z), 0))
        along = z @ DIRECTION / (np.linalg.norm(DIRECTION) * np.maximum(np.linalg.norm(z, axis=1), 1e-9))
        bad[own] = (far > DISTANCE) & (along > ALIGNED)
    return bad


def spam_shares(page: np.ndarray, units: np.ndarray, chars: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Of each page the share of characters in flagged units, or in units around which most characters within ``REACH`` units are flagged."""
    size, k = len(chars), np.arange(len(chars))
    begin = np.repeat(np.cumsum(units) - units, units)
    lo, hi = np.maximum(k - REACH, begin), np.minimum(k + REACH + 1, begin + np.repeat(units, units))
    upto, bad_upto = np.append(0, np.cumsum(chars)), np.append(0, np.cumsum(chars * bad))
    stretch = bad | (2 * (bad_upto[hi] - bad_upto[lo]) > upto[hi] - upto[lo])
    return np.bincount(page, chars * stretch, len(units)) / np.maximum(np.bincount(page, chars, len(units)), 1) if size else np.zeros(len(units))


def page_shares(docs: DataFrame, ident: Column, text: Column, label: Column) -> DataFrame:
    """``doc_id, lang, spam_share`` of every row whose text holds a word or sign; null, empty and blank texts have none. ``lang`` is the place of the page's language among the labels found, or -1.

    ``label`` may be wrong, odd or null for some pages; only which words most pages of a label hold is taken from it. Repeated
    rows are judged each, long texts whole.
    """
    pages = checkpoint(page_tokens(docs, ident, text, label))
    table = function_words(pages)
    paged = checkpoint(page_units(pages, table))
    known = affinity(paged)
    standard = profiles(paged, known, len(table)) if paged.take(1) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches):
            bad = flagged(x.features(known), np.where(x.lang < 0, len(table), x.lang), standard)
            shares = spam_shares(x.page, x.units, x.chars, bad)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(shares)], names=["doc_id", "lang", "spam_share"])

    return paged.mapInArrow(run, "doc_id bigint, lang int, spam_share double")


def spam_pages(docs: DataFrame) -> DataFrame:
    return page_shares(docs, F.col("doc_id"), F.col("text"), F.col("lang")).where(F.col("spam_share") > SHARE).select("doc_id")
