import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import ODD, documents, prose

from tributary.llm.queries import vocabulary
from tributary.llm.sentence_pieces import Pieces, suffix_array, with_ids, with_text

PATH = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = Pieces(PATH)


def same(texts):
    ids, starts = MODEL.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [LIBRARY.encode(t or "") for t in texts]
    assert MODEL.decode(ids.astype(np.int64), starts) == [(t or "").replace("▁", " ") for t in texts]


def test_ids_of_the_library():
    same([*ODD, "  a", "a ", "a  b   c", " ", "ab" * 300 + " " + "the" * 200, "=== ---- " * 20, " " * 40, "<s> </s> <0x41> ▁▁x", prose(400, 1), "hello" * 30])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab the-=é\n日🙂 .ingo", max_size=70), max_size=5))
def test_any_text(texts):
    same(texts)


def test_suffix_array():
    codes = np.frombuffer("banana\0bandana".encode("utf-32-le"), np.uint32).astype(np.int64)
    want = sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    assert suffix_array(codes, 16).tolist() == want


def test_columns(spark):
    docs = documents(spark, [*ODD, "a b", "a b"], clash=("ids", "decoded"))
    rows = with_text(with_ids(docs, PATH), PATH, into="decoded").collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert with_ids(docs.limit(0), PATH).count() == 0
