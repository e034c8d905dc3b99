"""Phrase collocations through weighted acyclic automata: shard count transducers, their union by prefix range, composition for part counts."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored, whole
from pulsegrid.llm.tokens import lower_ascii, rows_of, span_hashes, text_parts

ORDER = 4
#: Occurrences of a candidate, phrases reported per language, per cent of a phrase's occurrences that a longer one must have to replace it.
LEAST, TOP, INSIDE = 30, 2000, 80
#: Text of a shard, words of a prefix range, n-grams of one automaton of the lookups.
SHARD_BYTES, RANGE_WORDS, SEGMENT = 6 << 20, 1 << 20, 50_000
#: N-grams that wait to be added up.
MERGED = 1 << 20
#: Documents from which the borders of the prefix ranges are estimated (they decide where counting happens, never what is counted), and n-grams of each of their shards.
SAMPLED_DOCS, SAMPLED_GRAMS = 2000, 20_000
BREAKS, BLANKS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANKS[[0x20, 0x09]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, byte starts, byte ends, goes on): the words of lower-cased rows; ``goes on`` tells that the next word is in the same piece.

    A symbol is 63 bits of the word's hash, not 0.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    gap = BREAKS[data] | BLANKS[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    piece, row = np.cumsum(BREAKS[data])[starts], rows_of(starts, offsets)
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    return np.maximum(span_hashes(data, starts, ends) >> np.uint64(1), np.uint64(1)), starts, ends, goes_on


def counted(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted different n-grams (a column of word numbers for each place, 0: none) and the sums of their weights."""
    heads, head = np.unique(columns[0].astype(np.int64) << 32 | columns[1], return_inverse=True)
    tails, tail = np.unique(columns[2].astype(np.int64) << 32 | columns[3], return_inverse=True)
    keys = head.astype(np.int64) << 32 | tail
    if weights is None:
        keys, sums = np.unique(keys, return_counts=True)
    else:
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, weights)
    head, tail = heads[keys >> 32], tails[keys & 0xFFFFFFFF]
    return [c.astype(np.int32) for c in (head >> 32, head & 0xFFFFFFFF, tail >> 32, tail & 0xFFFFFFFF)], sums.astype(np.int64)


def suffixes(numbers: np.ndarray, goes_on: np.ndarray) -> list[np.ndarray]:
    """Each word with up to three that follow it in its piece."""
    columns, open_ = [numbers], goes_on
    for k in range(1, ORDER):
        at = np.flatnonzero(open_)
        columns.append(np.zeros(len(numbers), np.int32))
        columns[k][at] = numbers[at + k]
        follows = np.zeros_like(open_)
        follows[:-k] = open_[:-k] & goes_on[k:]
        open_ = follows
    return columns


def first_of_prefix(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Per length of a prefix: where in sorted n-grams another one begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
        yield new.copy()


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def to_transducer(symbols: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted n-grams as an acyclic automaton in level order: labels and numbers of arcs of each level's states; the last arcs carry the counts."""
    used = np.zeros(len(symbols), bool)
    for column in columns:
        used[column] = True
    own = np.cumsum(used) - 1
    arrays, levels = [symbols[used]], list(first_of_prefix(columns))
    for k, level in enumerate(levels):
        arrays.append(_small(own[columns[k][level]]))
        arrays.append(_small(counts) if k == ORDER - 1 else _small(np.diff(np.append(np.cumsum(levels[k + 1])[level] - 1, levels[k + 1].sum()))))
    head = b"".join(struct.pack("<BI", a.dtype.itemsize, len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def from_transducer(data: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(symbols, n-grams as columns of numbers in them, counts) of a transducer."""
    data = zstandard.ZstdDecompressor().decompress(data)
    arrays, at = [], struct.calcsize("<BI") * (2 * ORDER + 1)
    for i in range(2 * ORDER + 1):
        width, size = struct.unpack_from("<BI", data, 5 * i)
        arrays.append(np.frombuffer(data, f"<u{width}", size, at))
        at += width * size
    counts, columns = arrays[-1].astype(np.int64), []
    repeat = np.ones(len(counts), np.int64)
    for k in reversed(range(ORDER)):
        if k < ORDER - 1:  # leaves below each state
            repeat = np.add.reduceat(repeat, np.concatenate(([0], np.cumsum(arrays[2 + 2 * k].astype(np.int64))))[:-1])
        columns.append(np.repeat(arrays[1 + 2 * k].astype(np.int32), repeat))
    return arrays[0], columns[::-1], counts


def borders_in(symbols: np.ndarray, columns: list[np.ndarray], borders: np.ndarray) -> np.ndarray:
    """Where each border would stand in sorted n-grams."""
    out = np.zeros(len(borders), np.int64)
    for n, border in enumerate(borders):
        low, high = 0, len(columns[0])
        for k in range(ORDER):
            number = int(np.searchsorted(symbols, border[k]))
            there = number < len(symbols) and symbols[number] == border[k]
            low, high = low + int(np.searchsorted(columns[k][low:high], number)), low + int(np.searchsorted(columns[k][low:high], number, side="right" if there else "left"))
        out[n] = low
    return out


SHARDS = "lang string, part int, word string, symbol bigint, n bigint, transducer binary"
_FIELDS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("word", pa.string()), ("symbol", pa.int64()), ("n", pa.int64()), ("transducer", pa.binary())])


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, lower-cased bytes, row offsets) of up to about SHARD_BYTES of text."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(langs.indices.to_numpy() == code)
            for _, _, data, offsets in text_parts(batch.column("text").take(pa.array(rows)), SHARD_BYTES):
                yield lang, lower_ascii(data), offsets


def _numbered(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(0 and then the different symbols, the number of each word in them, the first place of each)."""
    distinct, first, numbers = np.unique(symbols, return_index=True, return_inverse=True)
    return np.concatenate((np.zeros(1, np.uint64), distinct)), (numbers + 1).astype(np.int32), first


def _shards(borders: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per shard of text: its words with their numbers, and a transducer for each prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, offsets in _by_language(batches):
            symbols, starts, ends, goes_on = words_of(data, offsets)
            if not len(symbols):
                continue
            table, numbers, first = _numbered(symbols)
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            parts = (table[1:] % np.uint64(len(borders) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(parts), pa.array(words), pa.array(table[1:].astype(np.int64)), pa.array(np.bincount(numbers)[1:]), pa.nulls(len(words), pa.binary())], schema=_FIELDS)
            columns, counts = counted(suffixes(numbers, goes_on))
            cuts = np.concatenate(([0], borders_in(table, columns, borders), [len(counts)]))
            full = np.flatnonzero(np.diff(cuts))
            for r in full.tolist():
                made = to_transducer(table, [c[cuts[r] : cuts[r + 1]] for c in columns], counts[cuts[r] : cuts[r + 1]])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([r], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([made], pa.binary())], schema=_FIELDS)

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in _by_language(batches):
        symbols, _, _, goes_on = words_of(data, offsets)
        if len(symbols):
            table, numbers, _ = _numbered(symbols)
            grams = np.stack([table[c] for c in suffixes(numbers, goes_on)], axis=1)[:: max(1, len(symbols) // SAMPLED_GRAMS)]
            yield pa.RecordBatch.from_arrays([pa.array([len(symbols)]), pa.array([grams.tobytes()])], ["words", "grams"])


def prefix_borders(docs: DataFrame, range_words: int = RANGE_WORDS) -> np.ndarray:
    """Borders of prefix ranges of about ``range_words`` words each, estimated from SAMPLED_DOCS documents."""
    count = docs.count()
    share = min(1.0, SAMPLED_DOCS / max(count, 1))
    found = docs.sample(share, 7).repartition(8).mapInArrow(_sampled, "words bigint, grams binary").collect()
    words = sum(r["words"] for r in found) / share
    grams = np.concatenate([np.frombuffer(r["grams"], np.uint64).reshape(-1, ORDER) for r in found] or [np.zeros((0, ORDER), np.uint64)])
    grams = grams[np.lexsort(grams.T[::-1])]
    ranges = max(1, round(words / range_words))
    at = (np.arange(1, ranges) * len(grams)) // ranges
    return np.unique(grams[at], axis=0) if len(at) else np.zeros((0, ORDER), np.uint64)


COUNTS = "lang string, gram array<bigint>, f bigint"


def _union(borders: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the words and the transducers of a language's part: words with their numbers (word not null), n-grams of 1 to 4 words from
    ``least`` on, and those that a border cuts, whatever they have here."""

    def totals(lang: str, part: int, symbols: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = borders[max(part - 1, 0) : part + 1]
        for k, new in enumerate(first_of_prefix(columns)):
            at = np.flatnonzero(new)
            f = np.add.reduceat(counts, at)
            near = np.zeros(len(at), bool)
            for edge in edges:
                near |= np.logical_and.reduce([symbols[columns[j][at]] == edge[j] for j in range(k + 1)])
            keep = ((f >= least) | near) & (columns[k][at] > 0)
            at, f = at[keep], f[keep]
            own = np.stack([symbols[columns[j][at]] for j in range(k + 1)], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * (k + 1), pa.array(own.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), lists, pa.array(f), pa.nulls(len(at), pa.string())], ["lang", "gram", "f", "word"])

    def merged(transducers: list[tuple]) -> tuple:
        symbols = np.unique(np.concatenate([t[0] for t in transducers]))
        if symbols[0]:  # 0 stands for no word everywhere
            symbols = np.concatenate((np.zeros(1, np.uint64), symbols))
        numbers = [np.searchsorted(symbols, t[0]).astype(np.int32) for t in transducers]
        columns = [np.concatenate([own[t[1][k]] for own, t in zip(numbers, transducers, strict=True)]) for k in range(ORDER)]
        return symbols, *counted(columns, np.concatenate([t[2] for t in transducers]))

    def closed(key: tuple[str, int], words: dict, transducers: list[tuple]) -> Iterator[pa.RecordBatch]:
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(words)), pa.array([[s] for s, _ in words], pa.list_(pa.int64())), pa.array(list(words.values()), pa.int64()), pa.array([w for _, w in words])], ["lang", "gram", "f", "word"])
        if transducers:
            yield from totals(*key, *merged(transducers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, transducers, waiting = None, {}, [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                own = (batch.column("lang")[at].as_py(), batch.column("part")[at].as_py())
                if own != key:
                    if key:
                        yield from closed(key, words, transducers)
                    key, words, transducers, waiting = own, {}, [], 0
                data = batch.column("transducer")[at].as_py()
                if data is None:
                    word = (batch.column("symbol")[at].as_py(), batch.column("word")[at].as_py())
                    words[word] = words.get(word, 0) + batch.column("n")[at].as_py()
                    continue
                transducers.append(from_transducer(data))
                waiting += len(transducers[-1][2])
                if waiting > MERGED and len(transducers) > 1:
                    transducers, waiting = [merged(transducers)], 0
        if key:
            yield from closed(key, words, transducers)

    return run


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self) -> None:
        self.arcs: list[list] = []
        self.final: int | None = None


class CountAutomaton:
    """An acyclic transducer from sequences to counts, built from sorted entries one by one.

    States behind the current entry are never changed again and are shared with equal ones; counts are pushed towards the
    start, so the weights of a path and of its last state add up to the entry's count.
    """

    def __init__(self) -> None:
        self.path, self.last, self.known = [_State()], (), {}
        self.root = self.path[0]

    def add(self, entry: tuple, count: int) -> None:
        if self.last and entry <= self.last:
            raise ValueError("entries must be sorted and different")
        same = 0
        while same < min(len(entry), len(self.last)) and entry[same] == self.last[same]:
            same += 1
        self._share(same)
        for label in entry[same:]:
            self.path[-1].arcs.append([label, 0, _State()])
            self.path.append(self.path[-1].arcs[-1][2])
        for state in self.path[:same]:
            arc = state.arcs[-1]
            extra = arc[1] - min(arc[1], count)
            arc[1] -= extra
            for further in arc[2].arcs if extra else ():
                further[1] += extra
            if extra and arc[2].final is not None:
                arc[2].final += extra
            count -= arc[1]
        if same < len(entry):
            self.path[same].arcs[-1][1] = count
            count = 0
        self.path[-1].final, self.last = count, entry

    def _share(self, upto: int) -> None:
        while len(self.path) > upto + 1:
            state = self.path.pop()
            key = (state.final, tuple((label, weight, id(target)) for label, weight, target in state.arcs))
            self.path[-1].arcs[-1][2] = self.known.setdefault(key, state)

    def composed(self, queries: list[tuple]) -> list[int | None]:
        """Counts of sorted ``queries`` (None: not there); what a query shares with the one before is not walked again."""
        self._share(0)
        arcs: dict[int, dict] = {}
        out, last, walk = [], (), [(self.root, 0)]
        for query in queries:
            same = 0
            while same < min(len(query), len(last)) and query[same] == last[same]:
                same += 1
            del walk[same + 1 :]
            for label in query[len(walk) - 1 :]:
                state, weight = walk[-1]
                table = arcs.get(id(state)) or arcs.setdefault(id(state), {a[0]: (a[1], a[2]) for a in state.arcs})
                if label not in table:
                    break
                walk.append((table[label][1], weight + table[label][0]))
            state, weight = walk[-1]
            out.append(weight + state.final if len(walk) == len(query) + 1 and state.final is not None else None)
            last = query[: len(walk) - 1]
        return out


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (with f) and queries (f null), sorted by language and n-gram: answers the queries through automata of up to SEGMENT entries."""

    def answers(lang: str, automaton: CountAutomaton, queries: list[tuple]) -> pa.RecordBatch:
        found = [(q, f) for q, f in zip(queries, automaton.composed(queries), strict=True) if f is not None]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([list(q) for q, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.int64())], ["lang", "gram", "f"])

    here, automaton, queries, entries, before = None, None, [], 0, None
    for batch in batches:
        for lang, gram, f in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "f")), strict=True):
            gram = tuple(gram)
            if here != lang or (entries >= SEGMENT and gram != before):
                if queries:
                    yield answers(here, automaton, queries)
                here, automaton, queries, entries = lang, CountAutomaton(), [], 0
            if f is None:
                queries.append(gram)
            else:
                automaton.add(gram, f)
                entries += 1
            before = gram
    if queries:
        yield answers(here, automaton, queries)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a (its occurrences), l and r (those of its parts), n (words of the language), score.

    Texts (null: empty) in lower case (A-Z) are cut at ``.,;:!?`` and line ends into pieces, those at blanks into words; a null language is
    ``und``. A phrase has 2 to 4 words of a piece and at least ``least`` occurrences. Cut after k words it scores floor(2000000 a / (l + r)); its
    lowest cut counts, the smallest k among equals. A phrase inside a longer one (of 3 or 4 words, ``least`` occurrences) that has 80 % of its
    occurrences is dropped. Ties in rank go by a, then by the phrase in byte order.

    Each shard of text becomes one transducer per prefix range, made of every word with its three followers, so a word is
    shipped once and not once per length. Ranges are cut anywhere in the order of n-grams, so a frequent word or pair is
    spread; only prefixes that a border cuts are added up again afterwards. Words are told apart by 63 bits of hash.
    """
    base = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole(text_col).alias("text"))
    borders = prefix_borders(base)
    shards = base.mapInArrow(_shards(borders), SHARDS).repartition(len(borders) + 1, "part", "lang").sortWithinPartitions("part", "lang")
    found = stored(shards.mapInArrow(_union(borders, least), COUNTS + ", word string"))
    words = found.where("word is not null").select("lang", F.col("gram")[0].alias("symbol"), "word", F.col("f").alias("n"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = stored(found.where("word is null").groupBy("lang", "gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least))

    phrases = counts.where(F.size("gram") > 1).withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    cuts = cuts.withColumn("left", F.slice("gram", F.lit(1), F.col("k"))).withColumn("right", F.slice("gram", F.col("k") + 1, F.lit(ORDER)))
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("gram")).distinct().withColumn("f", F.lit(None).cast("bigint"))
    queried = counts.unionByName(parts).repartitionByRange("lang", "gram").sortWithinPartitions("lang", "gram", F.col("f").desc_nulls_last())
    found = stored(queried.mapInArrow(_looked_up, COUNTS))
    cuts = cuts.join(found.select("lang", F.col("gram").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(found.select("lang", F.col("gram").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20, 0)) * 2000000) div (l + r)"))
    scored = cuts.groupBy("lang", "gram").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.where(F.size("gram") > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.size("gram") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("gram") - F.col("k") + 1)))
    inner = inner.select("lang", F.slice("gram", F.col("at"), F.col("k")).alias("gram"), "a").groupBy("lang", "gram").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "gram"], "left").where(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {INSIDE}")
    kept = kept.select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = stored(kept.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= top).drop("rank"))
    spelt = best.select("lang", "gram", F.posexplode("gram").alias("at", "symbol")).join(words.select("lang", "symbol", "word"), ["lang", "symbol"])
    spelt = spelt.groupBy("lang", "gram").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    named = best.join(spelt, ["lang", "gram"]).withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
