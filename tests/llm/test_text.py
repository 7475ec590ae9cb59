import random

import numpy as np
import pytest

from nightjar.llm import idfiles as I
from nightjar.llm.common import tokenizer_path
from nightjar.llm.minhash import near_duplicates
from nightjar.llm.text import slice_hashes
from nightjar.llm.tokens import PieceEncoder


def complement_string(letters, a="a", b="b"):
    """The string whose second half is always the first with its two letters swapped: sums of powers of any odd base clash on it."""
    return "".join((a, b)[i.bit_count() & 1] for i in range(letters))


def test_slices_hash_alike_only_if_equal():
    r = random.Random(1)
    words = sorted({bytes(r.choices(b"ab\x00", k=r.randint(0, 140))) for _ in range(20000)})
    body = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = slice_hashes(body, ends - [len(w) for w in words], ends)
    assert len(np.unique(h)) == len(words)
    again = np.frombuffer(b"xyz" + b"".join(reversed(words)), np.uint8)
    size = np.array([len(w) for w in reversed(words)])
    stops = 3 + np.cumsum(size)
    assert (slice_hashes(again, stops - size, stops)[::-1] == h).all()


@pytest.mark.parametrize("letters", [1024, 2048, 8192])
def test_strings_that_clash_in_powers_of_two(letters):
    one, two = complement_string(letters), complement_string(letters, "b", "a")
    body = np.frombuffer((one + two).encode(), np.uint8)
    h = slice_hashes(body, np.array([0, letters]), np.array([letters, 2 * letters]))
    assert h[0] != h[1]


def test_ids_of_such_words(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = [complement_string(2048), complement_string(2048, "b", "a"), f"x {complement_string(1024)} y {complement_string(1024, 'b', 'a')}"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    raw = [t.encode() for t in texts]
    ids, counts = PieceEncoder(path, True).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    import zlib

    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids_crc32 for r in I.round_trip(df, path, end_id=0).collect()}
    assert got == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(want, 1)}


def test_such_words_link_no_documents(spark):
    one, two = complement_string(2048), complement_string(2048, "b", "a")
    df = spark.createDataFrame([(1, f"{one} x y"), (2, f"{two} x y"), (3, f"{one} x y")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
