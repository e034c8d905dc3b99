"""Token-ID output: whole texts encoded, ids stored in grammar-compressed (Re-Pair) shards with random access."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import mapped, scratch_path, whole

#: Ids of a shard (it ends with a document), rounds of replacement, pairs replaced at once, and how often a pair must stand to be one.
SHARD_IDS, ROUNDS, PAIRS, LEAST = 1 << 20, 3, 4096, 16
END_ID = 2
MAGIC = b"RPG1"
#: Words whose ids a task remembers; then it forgets all.
REMEMBERED = 300_000


# -- encoding


@cache
def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable ones stand for themselves, others move beyond Latin-1."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


#: Before a word that must not be taken for a lower-cased one (a noncharacter).
RAW = "\ufdd0"
SPECIAL = re.compile("\u03a3|\ufdd0|<\\|")
#: Signs behind a letter and before a blank: there the pre-tokenizer cuts, so they can be words of their own.
SIGNS = r"(\pL)([^\pL\pN\s]+)( |\n|$)"


class WordEncoder:
    """ids of texts by a tokenizer that lower-cases, drops white space and never joins across it: each word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        used = len(self.ids)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts, self.lengths = np.concatenate((self.starts, used + np.cumsum(lengths) - lengths)), np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))

    def _look_up(self, words: list[str]) -> None:
        """Words of letters go to the model together, told apart by their closing tokens; all others through the whole tokenizer."""
        plain = [w for w in words if w.isalpha()]
        if plain:
            letters = _byte_letters()
            spelled = [w if w.isascii() else "".join(letters[b] for b in w.encode()) for w in plain]
            found = self.letters.encode_batch_fast([" ".join(spelled[i : i + 1024]) for i in range(0, len(spelled), 1024)], add_special_tokens=False)
            ids = np.fromiter((i for f in found for i in f.ids), np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                self._learn(plain, ids, np.diff(ends, prepend=0))
            else:
                plain = []
        rest = [w for w in words if not w.isalpha()] if plain else words
        if rest:
            found = [f.ids for f in self.whole.encode_batch_fast([w.removeprefix(RAW) for w in rest], add_special_tokens=False)]
            self._learn(rest, np.fromiter((i for f in found for i in f), np.uint32), np.array([len(f) for f in found], np.int64))

    def _prepared(self, text: str) -> str | None:
        """The text in lower case where that is safe. Case and marks may interact, a capital sigma is lower-cased by place, special tokens stay whole."""
        low = text.lower()
        if text.isascii():
            return None if "<|" in text else low
        normal = len(low) == len(text) and not SPECIAL.search(text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return low if normal else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self.forget()
        plain = [self._prepared(t) for t in texts]
        words = pc.replace_substring(pc.replace_substring_regex(pa.array(plain, pa.large_string()), SIGNS, r"\1 \2\3"), "\n", " ")
        odd = [i for i, t in enumerate(plain) if t is None]
        if odd:  # each word as it is, behind a mark that tells it from a lower-cased one
            raw = [" ".join(RAW + w for w in texts[i].replace("\n", " ").split(" ")) for i in odd]
            words = pc.replace_with_mask(words, pa.array(np.isin(np.arange(len(texts)), odd)), pa.array(raw, pa.large_string()))
        lists = pc.split_pattern(words, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, get = coded.dictionary.to_pylist(), self.known.get
        places = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(places < 0).tolist()
        if missing:
            self._look_up([distinct[i] for i in missing])
            places[missing] = [get(distinct[i]) for i in missing]
        codes = places[coded.indices.to_numpy()]
        starts, lengths = self.starts[codes], self.lengths[codes]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate(([0], ends))[lists.offsets.to_numpy()])


class TextEncoder:
    """ids of texts by any tokenizer: every text is encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [f.ids for f in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for f in found for i in f), np.uint32), np.array([len(f) for f in found], np.int64)

    def forget(self) -> None:
        """Nothing is remembered."""


#: Fixed value: the pre-tokenizer of the vocabulary whose words can be encoded one by one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(settings: dict) -> bool:
    """Do a tokenizer's settings say what ``WordEncoder`` takes for granted: NFC, blanks made equal, lower case, words by WORDS, and their ends marked?"""
    normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    parts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = settings["model"]
    return (
        normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORDS} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"] and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]
    )


@cache
def encoder(path: str) -> WordEncoder | TextEncoder:
    """The word by word encoder where the tokenizer's file allows it, else the plain one."""
    with open(path, encoding="utf-8") as file:
        return WordEncoder(path) if by_words(json.load(file)) else TextEncoder(path)


# -- grammar


def _slot(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint32(0x9E3779B1) >> np.uint32(14) if keys.dtype == np.uint32 else keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)


def repair(ids: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first nonterminal, rules, sequence, symbols of each document): the most frequent pairs give way to nonterminals, round by round.

    A round counts all pairs inside documents and replaces its ``pairs`` most frequent ones together, left to right where they
    overlap; rules refer to earlier symbols only.
    """
    base = max(int(ids.max()) + 1 if len(ids) else 1, END_ID + 1)
    # Pairs are numbers of twice a symbol's bits; with 16 bits a symbol they sort twice as fast.
    bits, kind = (16, np.uint32) if base + rounds * pairs <= 1 << 16 else (32, np.uint64)
    seq = ids.astype(kind)
    end = np.zeros(len(seq), bool)
    end[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    top = base
    for _ in range(rounds):
        if len(seq) < 2:
            break
        keys = (seq[:-1] << kind(bits)) | seq[1:]
        # Exact counts of the pairs that may be frequent: those whose hash is met often enough.
        inside = keys[~end[:-1]]
        slots = _slot(inside)
        order = np.sort(inside[(np.bincount(slots, minlength=1 << 18) >= least)[slots]])
        if not len(order):
            break
        cut = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        counts = np.diff(np.concatenate((cut, [len(order)])))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        best = good[np.lexsort((order[cut[good]], -counts[good]))[:pairs]]
        chosen = order[cut[best]]
        chosen = chosen[np.sort(np.unique(_slot(chosen), return_index=True)[1])]
        # A table by hash says which pair a place may hold; of pairs with one slot only the more frequent was chosen.
        listed = np.zeros(1 << 18, np.int32)
        listed[_slot(chosen)] = np.arange(len(chosen))
        maybe = listed[_slot(keys)]
        where = np.flatnonzero((chosen[maybe] == keys) & ~end[:-1])
        which = maybe[where]
        # Of neighbouring finds, which overlap, every other one from the left.
        new_run = np.concatenate(([True], np.diff(where) != 1))
        place = np.arange(len(where)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        where, which = where[place % 2 == 0], which[place % 2 == 0]
        seq[where] = top + which
        end[where] = end[where + 1]
        stays = np.ones(len(seq), bool)
        stays[where + 1] = False
        seq, end = seq[stays], end[stays]
        rules.append(np.stack((chosen >> kind(bits), chosen & kind((1 << bits) - 1)), axis=1).astype(np.int64))
        top += len(chosen)
    ends = np.flatnonzero(end) + 1
    symbols = np.zeros(len(lengths), np.int64)
    symbols[lengths > 0] = np.diff(np.concatenate(([0], ends)))
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), seq, symbols


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard: header; rules (left, right); length of each rule's expansion; symbols and ids of each document; the sequence."""
    base, rules, seq, symbols = repair(ids, lengths)
    sizes = expansion_sizes(base, rules)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<IIIIQQ", width, base, len(rules), len(lengths), len(seq), len(ids))
    return b"".join((head, rules.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes()))


def expansion_sizes(base: int, rules: np.ndarray) -> np.ndarray:
    sizes = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        sizes[base + i] = sizes[a] + sizes[b]
    return sizes[base:]


class Shard:
    """Reads a packed shard; any document, or any ids of one, without the others."""

    HEAD = len(MAGIC) + 32

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token-id shard")
        width, self.base, rules, docs, seq, self.total = struct.unpack_from("<IIIIQQ", blob, 4)
        at, parts = self.HEAD, []
        for kind, n in (("<u4", 2 * rules), ("<u4", rules), ("<u4", docs), ("<u4", docs), (f"<u{width}", seq)):
            parts.append(np.frombuffer(blob, kind, n, at))
            at += n * int(kind[-1])
        self.rules, self.lengths, self.seq = parts[0].reshape(-1, 2), parts[3].astype(np.int64), parts[4]
        self.sizes = np.concatenate((np.ones(self.base, np.int64), parts[1].astype(np.int64)))
        self.offsets = np.concatenate(([0], np.cumsum(parts[2].astype(np.int64))))
        self.starts = np.concatenate((np.arange(self.base, dtype=np.int64), self.base + np.concatenate(([0], np.cumsum(parts[1].astype(np.int64))))[:-1]))
        self.flat = np.arange(self.base + int(parts[1].sum(dtype=np.int64)), dtype=np.uint32)
        for i, (a, b) in enumerate(self.rules.tolist()):
            start = self.starts[self.base + i]
            for child in (a, b):
                n = self.sizes[child]
                self.flat[start : start + n] = self.flat[self.starts[child] : self.starts[child] + n]
                start += n

    def expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        n = self.sizes[seq]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[seq] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.offsets[i] : self.offsets[i + 1]])

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """ids start..stop of a document: expansion lengths tell which symbols to expand."""
        seq = self.seq[self.offsets[i] : self.offsets[i + 1]]
        ends = np.cumsum(self.sizes[seq.astype(np.int64)])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(seq[a:b])[start - before : stop - before]


# -- Spark


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encodes whole texts in ascending order of id (null first; equal ids by text) and writes shards under ``path``.

    A row is a shard: part and shard (their order is that of the ids), doc_ids, n_ids and the packed bytes. A text
    is never cut; null is empty, and each document ends with END_ID.
    """
    id_type = docs.schema[id_col].dataType

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        held_ids, held_ids_of, held_docs, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            names = pa.concat_arrays(held_docs)
            blob = pack(np.concatenate(held_ids), np.concatenate(held_ids_of))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([blob], pa.binary())],
                ["part", "shard", "n_ids", "doc_ids", "payload"],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                rows = batch.slice(first, 1024)
                ids, counts = encode([x or "" for x in rows.column("text").to_pylist()])
                full = counts + 1
                out = np.full(int(full.sum()), END_ID, np.uint32)
                inside = np.ones(len(out), bool)
                inside[np.cumsum(full) - 1] = False
                out[inside] = ids
                held_ids.append(out)
                held_ids_of.append(full)
                held_docs.append(rows.column("id"))
                size += len(out)
                if size >= shard_ids:
                    yield row()
                    held_ids, held_ids_of, held_docs, size, shard = [], [], [], 0, shard + 1
        if held_ids:
            yield row()
        encoder(tokenizer).forget()  # Python workers live on

    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "shard", "n_ids")] + [T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])
    mapped(ordered, pack_rows, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_type: T.DataType, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, decoded from the files; its ids on demand."""
    shards = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                shard = Shard(batch.column("payload")[one].as_py())
                n = len(shard.lengths)
                ids = shard.expand(shard.seq).astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                arrays = [batch.column("doc_ids")[one].values, pa.array(np.full(n, batch.column("part")[one].as_py())), pa.array(np.full(n, batch.column("shard")[one].as_py())), pa.array(begins), pa.array(shard.lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "shard", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    fields = [T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("part", "shard", "at", "n_tokens", "ids_crc32")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    docs = mapped(shards.select("part", "shard", "doc_ids", "payload"), decode, T.StructType(fields))
    # Running sums in two steps: over the parts, and over the shards of each.
    sizes = shards.select("part", "shard", "n_ids")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)))
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0)))
    first = inside.join(parts, "part").select("part", "shard", (F.col("ahead") + F.col("inside")).alias("first"))
    out = docs.join(first, ["part", "shard"])
    return out.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the id files of ``docs`` into the shared folder and returns what read_ids() reads back from them."""
    path = scratch_path(docs.sparkSession)
    write_ids(docs, path, tokenizer, id_col, text_col)
    return read_ids(docs.sparkSession, path, docs.schema[id_col].dataType)
