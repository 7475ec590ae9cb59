import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from nightjar.llm.packing import pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_id_lies_in_one_piece_and_sequences_are_full(spark):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (4, "word " * 9000), (5, "The cat sat."), (5, "again"), (7, " a  b\t\nc ")] + [
        (100 + i, "some words of text " * (i % 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as start", "1 as length")
    got = pack(df.where("doc_id <> 5").repartition(3), PATH, 2).toPandas()
    tok = Tokenizer.from_file(PATH)
    for doc, text in rows:
        if doc == 5:
            continue
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == doc].sort_values("start")
        assert own.doc_tokens.eq(len(ids)).all() and own.length.sum() == len(ids)
        assert b"".join(own.ids) == ids.tobytes()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
    pad = 0
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.to_numpy() == np.concatenate([[0], seq.length.cumsum()[:-1]])).all()
        total = seq.length.sum()
        assert total <= 4096
        pad += 0 if total & (total - 1) == 0 else 4096 - total
    assert pad <= 0.01 * got.length.sum()


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "one two"), (5, "one two")], "doc_id bigint, text string")
    assert pack(df.where("doc_id = 0"), PATH, 2).count() == 0
    assert pack(df, PATH, 2).agg({"length": "sum"}).first()[0] == 6
