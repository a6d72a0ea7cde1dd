import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import ODD, documents, prose

from tributary.llm import packing
from tributary.llm.packing import WordIds, pack
from tributary.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def expected(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check(rows, ids, window):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for doc, want in ids.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["length"] > 0
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[at : at + r["length"]]
            assert len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at == len(want)
    used = []
    for s in range(len(sequences)):
        at = 0
        for r in sorted(sequences[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        used.append(at)
        assert {r["padded_to"] for r in sequences[s]} == {at if at & (at - 1) == 0 else window}
    assert all(u == window for u in used[:-1]) and used[-1] <= window


@pytest.mark.parametrize("window", [7, 64])
def test_pieces_cover_every_id_once(spark, window):
    texts = [*ODD, *(prose(n, n) for n in (1, 30, 200)), "it's 12 o'clock, don't!", "<|endoftext|> x <|ENDOFTEXT|>", prose(3000, 5)]
    docs = documents(spark, texts, clash=("ids", "at", "total", "part")).repartition(4)
    check(pack(docs, PATH, window=window).collect(), dict(enumerate(expected(texts))), window)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = documents(spark, ["a b c", "a b c", "d"], ids=[3, 3, None])
    rows = pack(docs, PATH, window=8).collect()
    assert sum(r["length"] for r in rows) == 4 + 4 + 2 and sorted(r["doc_id"] is None for r in rows) == [False, False, True]
    assert pack(docs.limit(0), PATH).count() == 0


def test_split_words_give_the_tokenizers_ids():
    texts = [*ODD, "Foo's can't İstanbul H̱ Å ßs 12ab3 ²x ªb ſ Ŀ ŉ don'T IT'S 'RE ''s l'l é''ll -- … Ĳ", "a\x1c\x1db x\x85y", "THE the, the. (the) the!!!"]
    ids, starts = WordIds(PATH)(pa.array(texts))
    assert [[*ids[a:b].tolist(), 1] for a, b in zip(starts[:-1], starts[1:], strict=True)] == expected(texts)


def test_every_letter_alone_among_others_and_before_a_sign():
    letters = [chr(c) for c in range(0x21, 0x180)]
    texts = [x.join(ends) for x in letters for ends in (("", ""), ("A", "."), ("", "b,"), ("Z", "!"), ("q", ".,"), (".", ""), ("", "."))] + [None, " \t ", ",", "A.B"]
    ids, starts = WordIds(PATH)(pa.array(texts))
    assert [[*ids[a:b].tolist(), 1] for a, b in zip(starts[:-1], starts[1:], strict=True)] == expected(texts)


def test_words_of_letters_are_told_apart_by_their_parts_alone():
    """A sign behind a word or a capital makes no new word to remember: what is left is encoded once."""
    encode = WordIds(PATH)
    encode(pa.array(["Tree tree, TREE. treE! tree", "trees Über über."]))
    assert set(encode.parts) == {"tree", "trees", "über", ".", ",", "!"} and not encode.known


def test_parts_are_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "AT_ONCE", 7)
    encode = WordIds(PATH)
    for seed in range(6):
        texts = [prose(80, seed), f"a1-{seed} it's {seed}x"]
        ids, starts = encode(pa.array(texts))
        assert [[*ids[a:b].tolist(), 1] for a, b in zip(starts[:-1], starts[1:], strict=True)] == expected(texts)


def test_query_digest(spark):
    from tributary.llm.queries import op10_packing

    rows = op10_packing(spark, "/root/testdata/sf0.001").orderBy("sequence_id", "offset").limit(3).collect()
    assert rows[0]["offset"] == 0 and 0 <= rows[0]["ids_crc32"] < 1 << 32 and zlib.crc32(b"") == 0
