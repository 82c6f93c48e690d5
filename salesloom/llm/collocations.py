"""Phrase collocation mining: HAT-tries count phrases, their runs merge by prefix.

Texts are lower-cased (A-Z), split at punctuation and line breaks into pieces and those at
blanks into words. Phrases of 2 to `longest` words count within pieces, by language.

Each task counts into a trie of word ids: the root leads by first word to a hash container
of the rest of each phrase. A container that holds too many bursts into one container for
each second word; there the trie ends, so it stays shallow. When the trie holds too many
phrases, whole subtrees, the largest first, leave as sorted runs, cut by language and by
range of the prefix's hash (the prefix is the first two words). A run is one row, however
many phrases it holds; those of a range meet and add up.

A phrase occurs `least` times only if every part of it does. So two passes go before, one
over words and one over pairs of frequent words, which tell what can be frequent by hash
alone: tasks send the sorted hashes that they met with counts up to `least`, six bytes
each, by range of hash; what adds up to `least` goes to the tasks of the next pass as a
bitmap of bounded size. Hashes that collide, or bits set by chance, let a phrase be
counted in vain and change no result: all counts are kept by the words themselves.

A phrase scores floor(1000 * a * n / (l * r)) at its worst cut into first and rest, with
its count a, those of the two parts l and r and the language's word count n, in decimals
of 38 digits. Phrases inside a longer one that is as frequent are dropped. The `top` of
each language are ranked; only that many rows of a task meet in the rank's sort.

A null language counts as `und`, null texts as empty. Repeated rows count each. Columns
other than text and lang take no part. Very long texts are read in parts that end at the
end of a piece.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import LOWER, UPPER, Scratch, mix, text_bytes
from salesloom.llm.sketches import HASH_BITS, SKETCH, Bitmap, bitmap_of, ranges_for, shift_of, sketched

LEAST = 100
LONGEST = 5
TOP = 2000

ENDS = b".,;:!?\n\x0b\x0c\r"
#: To small letters, one kind of end of a piece, one kind of blank.
PLAIN = bytes.maketrans(UPPER.encode() + ENDS + b"\t", LOWER.encode() + b"\n" * len(ENDS) + b" ")

#: What stands for the end of a piece among words, none of which holds one of ENDS.
MARK = b"."

#: Bytes of a text that are split at once, words that are counted at once.
PART_BYTES = 1 << 20
BATCH_WORDS = 1 << 19
#: Phrases of a task's tries, words of its vocabularies; beyond, subtrees leave.
MOST_ENTRIES = 400_000
MOST_WORDS = 1_000_000
#: Hashes that a task sorts at once.
MOST_HASHES = 1 << 23
#: Entries of a container that bursts.
BURST = 2048
#: Ids of the end of a piece and of words that are not frequent; others come after.
BREAK, RARE, FIRST_ID = 0, 1, 2

RUNS = "lang string, range long, phrases binary, counts binary"


def parts_of(text: bytes) -> Iterator[bytes]:
    """The text with one kind of blanks and ends, in parts that end where a piece does."""
    text = text.translate(PLAIN)
    at = 0
    while len(text) - at > PART_BYTES:
        cut = text.rfind(b"\n", at, at + PART_BYTES)
        if cut < 0:
            cut = text.find(b"\n", at + PART_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang)) >> (64 - HASH_BITS)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - HASH_BITS)


class Vocabulary(dict):
    """Word to id; words that the bitmap lacks share one."""

    def __init__(self, lang: str, frequent: Bitmap):
        super().__init__({MARK: BREAK})
        self.lang, self.frequent = lang, frequent
        self.words, self.hashes = [b""] * FIRST_ID, [0] * FIRST_ID

    def __missing__(self, word: bytes) -> int:
        hashed = word_hash(self.lang, word)
        found = RARE
        if self.frequent.has(hashed):
            found = len(self.words)
            self.words.append(word)
            self.hashes.append(hashed)
        self[word] = found
        return found


class Tokens:
    """Word ids of the texts of a task, by language, given out in batches."""

    def __init__(self, frequent: Bitmap):
        self.frequent = frequent
        self.vocabularies: dict[str, Vocabulary] = {}
        self.waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        self.n_waiting: Counter = Counter()

    def read(self, lang: str, text: bytes) -> Iterator[tuple[str, np.ndarray]]:
        vocabulary = self.vocabularies.get(lang)
        if vocabulary is None:
            vocabulary = self.vocabularies[lang] = Vocabulary(lang, self.frequent)
        for part in parts_of(text):
            tokens = part.replace(b"\n", b" " + MARK + b" ").split()
            tokens.append(MARK)
            self.waiting[lang].append(np.fromiter(map(vocabulary.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
            self.n_waiting[lang] += len(tokens)
            if self.n_waiting[lang] > BATCH_WORDS:
                yield lang, self._batch(lang)

    def _batch(self, lang: str) -> np.ndarray:
        del self.n_waiting[lang]
        return np.concatenate(self.waiting.pop(lang))

    def rest(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang in list(self.waiting):
            yield lang, self._batch(lang)

    def full(self) -> bool:
        return sum(map(len, self.vocabularies.values())) > MOST_WORDS

    def pairs(self, lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where two words of the bitmap follow each other, and the hashes of these pairs."""
        linked = (ids[:-1] >= FIRST_ID) & (ids[1:] >= FIRST_ID)
        hashes = np.array(self.vocabularies[lang].hashes, dtype=np.uint64)[ids]
        return linked, pair_hash(hashes[:-1][linked], hashes[1:][linked])


class Trie:
    """Counts of phrases by first word id: a container of the rests, or one for each second id.

    A rest is the packed ids of the words that follow.
    """

    def __init__(self):
        self.nodes: dict[int, Counter | dict[int, Counter]] = {}
        self.burst: set[int] = set()
        self.entries: Counter = Counter()

    def add(self, ids: np.ndarray, begins: np.ndarray, length: int) -> None:
        """Counts the phrases of `length` words that begin at some places of a text."""
        if not len(begins):
            return
        both = ids[begins].astype(np.uint64) << np.uint64(32) | ids[begins + 1]
        order = np.argsort(both, kind="stable")
        both, begins = both[order], begins[order]
        packed = ids.astype(">u4").tobytes()
        rests = [packed[a:b] for a, b in zip((4 * begins + 4).tolist(), (4 * (begins + length)).tolist())]
        firsts = (both >> np.uint64(32)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(firsts)) + 1).tolist(), len(firsts)]
        for lo, hi in zip(edges, edges[1:]):
            first = int(firsts[lo])
            if first in self.burst:
                self._add_below(first, both[lo:hi], rests[lo:hi])
                continue
            container = self.nodes.get(first)
            if container is None:
                container = self.nodes[first] = Counter()
            container.update(rests[lo:hi])
            self.entries[first] = len(container)
            if len(container) > BURST and length > 2:
                self._burst(first)

    def _add_below(self, first: int, both: np.ndarray, rests: list[bytes]) -> None:
        children = self.nodes[first]
        edges = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), len(both)]
        for lo, hi in zip(edges, edges[1:]):
            child = children[int(both[lo]) & 0xFFFFFFFF]
            before = len(child)
            child.update(rests[lo:hi])
            self.entries[first] += len(child) - before

    def _burst(self, first: int) -> None:
        children: dict[int, Counter] = defaultdict(Counter)
        for rest, n in self.nodes[first].items():
            children[int.from_bytes(rest[:4], "big")][rest] = n
        self.nodes[first] = children
        self.burst.add(first)

    def take(self, keep: int) -> Iterator[tuple[int, dict[bytes, int]]]:
        """Takes out subtrees, the largest first, until `keep` entries are left."""
        held = self.entries.total()
        for first, n in self.entries.most_common():
            if held <= keep:
                return
            node = self.nodes.pop(first)
            yield first, {k: v for child in node.values() for k, v in child.items()} if first in self.burst else node
            self.burst.discard(first)
            del self.entries[first]
            held -= n


def runs_of(lang: str, phrases: list[bytes], counts: list[int], prefixes: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row for each range of the prefixes' hashes that some phrase falls into, with phrases and counts in order."""
    parts = (prefixes >> shift_of(ranges)).astype(np.int64)
    order = np.argsort(parts, kind="stable")
    parts, counted = parts[order], np.array(counts, dtype="<i8")[order]
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
    at, order = list(zip(edges, edges[1:])), order.tolist()
    columns = [
        pa.array([lang] * len(at), pa.string()),
        pa.array(parts[[lo for lo, _ in at]]),
        pa.array([b"\n".join([phrases[k] for k in order[lo:hi]]) for lo, hi in at], pa.binary()),
        pa.array([counted[lo:hi].tobytes() for lo, hi in at], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "range", "phrases", "counts"])


def _words(rest: bytes, words: list[bytes]) -> list[bytes]:
    return [words[int.from_bytes(rest[k : k + 4], "big")] for k in range(0, len(rest), 4)]


class Counts:
    """A task's tries, word counts and word totals, by language."""

    def __init__(self, longest: int, ranges: int, words: Bitmap, pairs: Bitmap):
        self.longest, self.ranges, self.words, self.pairs = longest, ranges, words, pairs
        self.start()

    def start(self) -> None:
        self.tokens = Tokens(self.words)
        self.tries: dict[str, Trie] = defaultdict(Trie)
        self.singles: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(FIRST_ID, dtype=np.int64))

    def count(self, lang: str, ids: np.ndarray) -> None:
        found = np.bincount(ids, minlength=len(self.singles[lang]))
        found[: len(self.singles[lang])] += self.singles[lang]
        self.singles[lang] = found
        linked, hashes = self.tokens.pairs(lang, ids)
        linked[linked] = self.pairs.holds(hashes)
        whole = linked
        for length in range(2, self.longest + 1):
            if length > 2:
                whole = whole[:-1] & linked[length - 2 :]
            self.tries[lang].add(ids, np.flatnonzero(whole), length)

    def read(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Counts a text; gives the runs that have to leave for the tries to stay within bounds."""
        for batch in self.tokens.read(lang, text):
            self.count(*batch)
        if self.tokens.full():
            yield from self.rest()
            self.start()
        elif sum(trie.entries.total() for trie in self.tries.values()) > MOST_ENTRIES:
            yield from self.spilled(MOST_ENTRIES // (2 * len(self.tries)))

    def spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        for lang, trie in self.tries.items():
            vocabulary = self.tokens.vocabularies[lang]
            words, hashes = vocabulary.words, np.array(vocabulary.hashes, dtype=np.uint64)
            phrases, counts, firsts, seconds = [], [], [], []
            for first, found in sorted(trie.take(keep), key=lambda taken: words[taken[0]]):
                run = sorted((b" ".join([words[first], *_words(rest, words)]), n, rest[:4]) for rest, n in found.items())
                phrases += [phrase for phrase, _, _ in run]
                counts += [n for _, n, _ in run]
                seconds += [second for _, _, second in run]
                firsts.append(np.full(len(run), first))
            if phrases:
                prefixes = pair_hash(hashes[np.concatenate(firsts)], hashes[np.frombuffer(b"".join(seconds), dtype=">u4")])
                yield runs_of(lang, phrases, counts, prefixes, self.ranges)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for batch in self.tokens.rest():
            self.count(*batch)
        yield from self.spilled(0)
        for lang, counts in self.singles.items():
            vocabulary = self.tokens.vocabularies[lang]
            run = sorted((vocabulary.words[k], int(counts[k]), vocabulary.hashes[k]) for k in np.flatnonzero(counts[FIRST_ID:]) + FIRST_ID)
            run.insert(0, (b"", int(counts[RARE:].sum()), 0))
            phrases, found, hashes = map(list, zip(*run))
            yield runs_of(lang, phrases, found, np.array(hashes, dtype=np.uint64), self.ranges)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    return zip(batch.column("lang").to_pylist(), batch.column("data").to_pylist())


def phrase_counter(longest: int, ranges: int, words: Broadcast, pairs: Broadcast):
    """A task's work: runs of words and phrases that can be frequent; a language's words in all as ''."""

    def count_phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(longest, ranges, Bitmap(words.value), Bitmap(pairs.value))
        for batch in batches:
            for lang, text in _rows(batch):
                yield from counts.read(lang, text)
        yield from counts.rest()

    return count_phrases


def word_sketch(ranges: int, least: int):
    """A task's work: sketches of the words that it met."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def taken() -> pa.RecordBatch:
            n = sum(map(len, counts.values()))
            hashes = np.fromiter((word_hash(lang, w) for lang, found in counts.items() for w in found), dtype=np.uint64, count=n)
            hashes, places = np.unique(hashes, return_inverse=True)
            met = np.fromiter((k for found in counts.values() for k in found.values()), dtype=np.float64, count=n)
            counts.clear()
            return sketched(hashes, np.bincount(places, met, len(hashes)), ranges, least)

        for batch in batches:
            for lang, text in _rows(batch):
                for part in parts_of(text):
                    counts[lang].update(part.split())
                if sum(map(len, counts.values())) > MOST_WORDS:
                    yield taken()
        yield taken()

    return sketch


def pair_sketch(ranges: int, least: int, words: Broadcast):
    """A task's work: sketches of the pairs of words, of those in the bitmap, that it met."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Bitmap(words.value)
        tokens, met = Tokens(frequent), []

        def taken() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *met]), return_counts=True)
            met.clear()
            return sketched(hashes, counts, ranges, least)

        for batch in batches:
            for row in _rows(batch):
                met.extend(tokens.pairs(*found)[1] for found in tokens.read(*row))
                if tokens.full():
                    met.extend(tokens.pairs(*found)[1] for found in tokens.rest())
                    tokens = Tokens(frequent)
                if sum(map(len, met)) > MOST_HASHES:
                    yield taken()
        met.extend(tokens.pairs(*found)[1] for found in tokens.rest())
        yield taken()

    return sketch


def _added_up(least: int):
    def added_up(runs: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for phrases, counts in zip(runs.column("phrases"), runs.column("counts")):
            for phrase, n in zip(phrases.as_py().split(b"\n"), np.frombuffer(counts.as_py(), dtype="<i8").tolist()):
                total[phrase] += n
        kept = [(phrase, n) for phrase, n in total.items() if n >= least or not phrase]
        lang = runs.column("lang")[0].as_py()
        columns = [pa.array([lang] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())]
        return pa.Table.from_arrays(columns, names=["lang", "phrase", "n"])

    return added_up


def merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of what is frequent: the runs of a range meet, where counts are added up."""
    totals = runs.groupBy("lang", "range").applyInArrow(_added_up(least), "lang string, phrase binary, n long")
    return totals.withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n) of words and phrases that occur `least` times; all words of a language as ''."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_bytes().alias("data"))
    ranges = ranges_for(texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0)
    most = min(least, 255)  # what is counted so often by one sketch alone passes
    words = context.broadcast(bitmap_of(texts.mapInArrow(word_sketch(ranges, most), SKETCH), ranges, most, scratch, "words"))
    pairs = context.broadcast(bitmap_of(texts.mapInArrow(pair_sketch(ranges, most, words), SKETCH), ranges, most, scratch, "pairs"))
    counts = scratch.table(merged(texts.mapInArrow(phrase_counter(longest, ranges, words, pairs), RUNS), least), "counts")
    scratch.remove("words", "pairs")
    return counts


def _ratio() -> Column:
    return F.expr(
        "(1000 * cast(a as decimal(20, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))"
    )


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases at the cut that scores least.

    `totals` has (lang, n): the number of words of each language.
    """
    parts = counts.where("phrase <> ''")
    phrases = parts.where(F.contains("phrase", F.lit(" "))).withColumnRenamed("n", "a")
    m = F.size(F.split("phrase", " "))
    cuts = phrases.select("*", m.alias("m"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - m)").alias("right")
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang").withColumn("score", _ratio())
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return worst.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def enclosing(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most) of phrases inside longer ones: the count of the most frequent of these."""
    words = F.split("phrase", " ")
    longer = counts.select("lang", "n", words.alias("words"), F.size(words).alias("m")).where("m > 2")
    inside = longer.select("lang", "n", "m", "words", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("length"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("length") + 1)).alias("begin"))
    phrase = F.array_join(F.slice("words", F.col("begin"), F.col("length")), " ")
    return inside.groupBy("lang", phrase.alias("phrase")).agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = frequent_phrases(docs, scratch, least, longest)
    totals = scratch.table(counts.where("phrase = ''").select("lang", "n"), "totals")
    kept = scored(counts, totals).join(enclosing(counts), ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
