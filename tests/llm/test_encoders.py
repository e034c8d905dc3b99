"""Every tokenizer file is encoded as the library encodes it."""

import random

import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import idstore
from pulsegrid.llm.queries import tokenizer_path


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", idstore.WordEncoder), ("byte_bpe_50k.json", idstore.TextEncoder)])
def test_ids_equal_the_library(name, kind):
    r = random.Random(3)
    texts = ["", "Hello World, it's 2024!", "  a\n\nb  ", *("".join(r.choice("abcABC  \n\t.,'1é\u03a3\u4e2d") for _ in range(r.randint(0, 60))) for _ in range(400))]
    found = idstore.encoder(tokenizer_path(name))
    assert type(found) is kind
    ids, lengths = found.encode(texts)
    want = [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_files_of_another_tokenizer(make):
    texts = [(1, "Some Text  here"), (2, None), (None, "more\n"), (3, "")]
    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in idstore.token_files(make(texts), path).collect()}
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts}
