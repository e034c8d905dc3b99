"""Texts of millions of characters: every operator ends, and in time; white space is encoded as the plain encoder does."""

import re
import time

import pytest

from pulsegrid.llm import pii, tokencount
from pulsegrid.llm.collocations import collocations
from pulsegrid.llm.decontam import contamination
from pulsegrid.llm.linededup import drop_common_lines
from pulsegrid.llm.queries import tokenizer_path

LONG = {"blanks": " " * 2_000_000, "breaks": "\n" * 2_000_000, "letters": "a" * 2_000_000, "tokens": "token_" * 200_000, "digits": "1" * 2_000_000, "mixed": "x" + "\t " * 1_000_000 + "y 1"}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_personal_data_and_token_counts_of_long_texts(kind):
    started = time.time()
    pii.find_pii(LONG[kind])
    assert time.time() - started < 10
    started = time.time()
    starts, ends = tokencount.token_spans(LONG[kind], tokenizer_path("byte_bpe_50k.tiktoken"))
    assert starts[0] == 0 and ends[-1] == len(LONG[kind]) and (starts[1:] == ends[:-1]).all()
    assert time.time() - started < 30


@pytest.mark.parametrize("text", ["a" + " " * 1500 + "b", " " * 1500, "\n" * 1200 + "x", "x" + "\n \t" * 700 + ".", "1" + " " * 1100 + "　" * 1100 + "2", "é" + "\xa0" * 1001 + "'s", "a" + " " * 1000, "\x1c" * 1500 + "a"])
def test_long_white_space_is_encoded_as_without_a_cut(text):
    encoding, _ = tokencount._encoding(tokenizer_path("byte_bpe_50k.tiktoken"))
    assert tokencount.encoded(text, encoding) == encoding.encode_ordinary(text)


def test_identifiers_equal_their_expression():
    plain = re.compile(r"(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{6,}")
    for text in ("token_token_a1b2", "abcdef", "a-1_", "------1 x", "1234567", "ab_cd 12345678", "é123456", "token_" * 30 + "1", "12345a_token_abcdefg token_99"):
        runs = pii.IdentifierRuns(text)
        assert [runs.end_at(i) for i in range(len(text))] == [m.end() if (m := plain.match(text, i)) else 0 for i in range(len(text))]


def test_frame_operators_take_long_texts(spark, make):
    docs = make([(i, t) for i, t in enumerate(LONG.values())])
    bench = spark.createDataFrame([("i", "x y 1"), ("j", "a" * 2_000_000)], "item_id string, text string")
    assert contamination(docs, bench).where("n_hit > 0").count() >= 1
    assert drop_common_lines(docs).count() == len(LONG) and collocations(docs, 2).count() == 0
