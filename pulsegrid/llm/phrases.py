"""Substring dedup by repeated-phrase automata: confirm recurring passages, compile them per shard, locate every occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import stored, text_keys, whole
from pulsegrid.llm.tokens import gram_hashes, rows_of, span_hashes, text_parts, within, word_spans

#: Words of the anchor phrase that every window picks among its own.
ANCHOR = 8
#: Windows of one context at most.
RUN = 64
#: Contexts of one anchor in one shard; an anchor with more is dealt over so many shards as it needs, and they are compared by window.
SHARD_CONTEXTS = 4096
#: Bytes of contexts compiled into one automaton.
SHARD_BYTES = 4 << 20
_POSITION = np.uint64((1 << 28) - 1)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[: len(values) - have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(words: np.ndarray, of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first window start, last window start, places of the anchor) of each run of windows of a row that pick the same anchor.

    A window picks the lowest hash among the phrases of ANCHOR words inside it (the last of equals): equal windows pick equal
    anchors wherever they stand, and each window has exactly one.
    """
    starts = within(of, window)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = gram_hashes(words, ANCHOR)
    packed = (grams & ~_POSITION) | (_POSITION - np.arange(len(grams), dtype=np.uint64))
    picked = (_POSITION - (_lowest(packed, window - ANCHOR + 1)[starts] & _POSITION)).astype(np.int64)
    rows = rows_of(starts, of)
    # A run goes on while the phrase is the same one, also at another place (a word said over and over), up to RUN windows.
    phrase = grams[picked]
    new = np.flatnonzero(np.concatenate(([True], (phrase[1:] != phrase[:-1]) | (rows[1:] != rows[:-1]))))
    lengths = np.diff(np.concatenate((new, [len(starts)])))
    pieces = -(-lengths // RUN)
    new = np.repeat(new, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    base = of[rows[new]]
    moves = np.concatenate(([0], np.cumsum(picked[1:] != picked[:-1])))
    return rows[new], grams[picked[new]].astype(np.int64), starts[new] - base, starts[last] - base, moves[last] - moves[new] + 1


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_parts(batch.column("text")):
                starts, ends, of = word_spans(data, offsets)
                rows, grams, lo, hi, places = anchors(span_hashes(data, starts, ends), of, window)
                at = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays([pa.array(grams), batch.column("id").take(at), batch.column("k").take(at), pa.array(lo << 16 | places << 8 | (hi - lo))], ["anchor", "id", "k", "at"])

    return run


def _context_rows(window: int):
    """Cuts the words of each anchor's windows out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                text = (batch.column("text")[one].as_py() or "").encode().split()
                found = batch.column("anchors")[one].values
                grams, salts, shards, at = (found.field(i).to_numpy() for i in range(4))
                lo, hi = at >> 16, (at >> 16) + (at & 255)
                for a in range(0, len(lo), 4096):
                    cut = [b" ".join(text[s : e + window]) for s, e in zip(lo[a : a + 4096].tolist(), hi[a : a + 4096].tolist(), strict=True)]
                    n = len(cut)
                    part = slice(a, a + n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams[part]), pa.array(salts[part]), pa.array(shards[part]), pa.array([batch.column("id")[one].as_py()] * n, batch.schema.field("id").type), pa.array([batch.column("k")[one].as_py()] * n, pa.int64()), pa.array(lo[part]), pa.array(cut, pa.binary())],
                        ["anchor", "salt", "shards", "id", "k", "lo", "context"],
                    )

    return run


def _code_points(ids: np.ndarray) -> str:
    """One character per word, so that automata walk words; surrogates are left out."""
    ids = ids + 1
    return np.where(ids >= 0xD800, ids + 0x800, ids).astype("<u4").tobytes().decode("utf-32-le")


def locate(contexts: pa.Array, window: int) -> tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray, np.ndarray]:
    """Covered spans (words) of each context, then hash, context and start of each window, and whether it recurs among them.

    Windows whose words stand twice are confirmed; their maximal runs are the passages, compiled into one automaton, which
    then reads every context.
    """
    text = contexts.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts, ends, of = word_spans(data, offsets - offsets[0])
    words = span_hashes(data, starts, ends)
    at = within(of, window)
    hashes, rows = gram_hashes(words, window)[at], rows_of(at, of)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    recurs = np.zeros(len(at), bool)
    recurs[order[1:]] |= same
    recurs[order[:-1]] |= same

    _, ids = np.unique(words, return_inverse=True)
    codes = _code_points(ids.astype(np.int64))
    on = np.flatnonzero(recurs)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(text))]
    if len(on):
        breaks = np.flatnonzero(np.concatenate(([True], (np.diff(at[on]) != 1) | (np.diff(rows[on]) != 0))))
        first, last = at[on][breaks], at[on][np.concatenate((breaks[1:], [len(on)])) - 1]
        passages = ahocorasick.Automaton()
        for p in {codes[a : b + window] for a, b in zip(first.tolist(), last.tolist(), strict=True)}:
            passages.add_word(p, len(p))
        passages.make_automaton()
        known: dict[str, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
            line = codes[a:b]
            if line not in known:
                found: list[tuple[int, int]] = []
                for end, size in passages.iter(line):
                    start = end - size + 1
                    while found and found[-1][1] >= start:
                        start = min(start, found.pop()[0])
                    found.append((start, end + 1))
                known[line] = found
            spans[i] = known[line]
    return spans, hashes.astype(np.int64), rows, recurs


def _shard_rows(window: int):
    names = ["id", "k", "start", "end", "gram", "known"]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, hashes, rows, recurs = locate(batch.column("context"), window)
        lo = batch.column("lo").to_numpy()
        at = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2) + lo[at][:, None]
        # Anchors dealt over several shards: what is single here may stand in another shard, so windows go on by their hash.
        dealt = np.flatnonzero(batch.column("shards").to_numpy()[rows] > 1) if len(rows) else np.zeros(0, np.int64)
        if len(dealt):
            _, once = np.unique(hashes[dealt], return_index=True)
            dealt = dealt[once]
        first = np.searchsorted(rows, rows[dealt])  # windows of a context follow each other
        begin = lo[rows[dealt]] + (dealt - first)
        take = pa.array(np.concatenate((at, rows[dealt])).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(take), batch.column("k").take(take), pa.array(np.concatenate((flat[:, 0], begin))), pa.array(np.concatenate((flat[:, 1], begin + window))),
                pa.array(np.concatenate((np.zeros(len(at), np.int64), hashes[dealt])), mask=np.arange(len(take)) < len(at)), pa.array(np.concatenate((np.ones(len(at), bool), recurs[dealt]))),
            ], names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # A shard ends between two groups of (anchor, salt), of which each has a bounded number of contexts.
            anchor, salt = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
            if held and (held[-1].column("anchor")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (anchor[0], salt[0]) and size >= SHARD_BYTES:
                yield one(pa.concat_batches(held))
                held, size = [], 0
            ends = np.concatenate((np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1, [batch.num_rows]))
            begin, lengths = 0, np.cumsum(np.fromiter((len(x.as_buffer()) for x in batch.column("context")), np.int64, batch.num_rows))
            for end in ends.tolist():
                if size + lengths[end - 1] - (lengths[begin - 1] if begin else 0) >= SHARD_BYTES and end < batch.num_rows:
                    yield one(pa.concat_batches([*held, batch.slice(begin, end - begin)]))
                    held, size, begin = [], 0, end
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                size += int(lengths[-1] - (lengths[begin - 1] if begin else 0))
        if held:
            yield one(pa.concat_batches(held))

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            rows = batch.slice(first, 512)
            total, removed, kept = [], [], []
            for text, spans in zip(rows.column("text"), rows.column("spans"), strict=True):
                words, upto, parts, gone = (text.as_py() or "").encode().split(), 0, [], 0
                for s in spans.values.to_pylist() if spans.is_valid else []:
                    parts += words[upto : s["start"]]
                    gone += max(0, s["end"] - max(upto, s["start"]))
                    upto = max(upto, s["end"])
                total.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(parts + words[upto:]).decode())
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["id", "kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word that a window of ``window`` words covers whose words also start anywhere else in the table.

    Anchors (one for every window, by its content) are counted; those seen twice give the contexts in which repeats can stand.
    Contexts are shuffled by anchor, cut into shards of bounded size, and each shard confirms its recurring passages, compiles them
    and streams its contexts through the automaton. An anchor with very many contexts is dealt over shards; its windows
    that are single there are counted once more over all shards. Per document row: id_col, kept (words joined by a space), n_words,
    n_removed. Null texts have no words; rows that repeat are repeats of each other; words are compared unchanged.
    """
    key, _ = text_keys(whole(text_col))
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), key.alias("k"))
    id_type = base.schema["id"].dataType
    found = base.mapInArrow(_anchor_rows(window), T.StructType([T.StructField("anchor", T.LongType()), T.StructField("id", id_type), T.StructField("k", T.LongType()), T.StructField("at", T.LongType())]))
    places = F.shiftright("at", 8).bitwiseAND(F.lit(255))
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(places).alias("places")).where("places > 1").withColumn("shards", F.ceil(F.col("n") / SHARD_CONTEXTS)).drop("n", "places")
    counts = stored(counts)  # a table of its own: Spark may then split the partition of an anchor that very many windows pick
    placed = found.join(counts, "anchor").withColumn("salt", F.pmod(F.xxhash64("id", "k", "at"), "shards"))
    placed = placed.groupBy(F.col("id").alias("__id"), F.col("k").alias("__k")).agg(F.collect_set(F.struct("anchor", "salt", "shards", "at")).alias("anchors"))
    texts = base.join(placed, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k"))).select("id", "k", "text", "anchors")
    longs = [T.StructField(c, T.LongType()) for c in ("anchor", "salt", "shards")]
    contexts = texts.mapInArrow(_context_rows(window), T.StructType([*longs, T.StructField("id", id_type), T.StructField("k", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("context", T.BinaryType())]))
    contexts = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    fields = [T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("k", "start", "end", "gram")], T.StructField("known", T.BooleanType())]
    located = stored(contexts.mapInArrow(_shard_rows(window), T.StructType(fields)))

    dealt = located.where(F.col("gram").isNotNull())
    again = dealt.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    spans = located.where(F.col("gram").isNull()).select("id", "k", "start", "end").unionByName(dealt.where(~F.col("known")).join(again, "gram").select("id", "k", "start", "end"))
    spans = spans.groupBy(F.col("id").alias("__id"), F.col("k").alias("__k")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    both = base.join(spans, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")), "left").select("id", "text", "spans")
    out = both.mapInArrow(_without, T.StructType([T.StructField("id", id_type), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
    return out.withColumnRenamed("id", id_col)
