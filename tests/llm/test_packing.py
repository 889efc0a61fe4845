import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrane.llm import packing as P

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_chunked_ids_are_the_tokenizers(tokenizer):
    own = P.WordTokenizer(PATH)
    for text in [
        "İstanbul ſ 'S IT'S don't we'LL x́y ｆｕｌｌ ΣΑΣ a\tb\x1cc <|endoftext|> <|x ª²µ× ½ tab_ __a__ 12a3\xa0nb ß ẞ", "", "  \n ", "é" * 3000, "Ünïcode!?;--a1b", "日本 語 ٣ x",
    ]:
        assert own.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, pieces, tokenizer, tokens, segments, loss, first=None):
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(ids(tokenizer, text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        whole = texts[doc][0]
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(whole[at : at + p.length].tobytes())
            at += p.length
        assert at == len(whole)
    waste = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tokens and len(parts) <= segments and sum(p.loss_tokens for p in parts) <= loss
        waste += 0 if at & (at - 1) == 0 else tokens - at
    return waste


def test_pieces_cover_every_text_once(documents, tokenizer):
    rows = [(i, f"word{i} again " * (i % 70)) for i in range(300)] + [(900, None), (901, ""), (902, "long text " * 30_000), (None, "no id")]
    assert check(rows, P.pack(documents(rows).coalesce(2), PATH).collect(), tokenizer, 4096, 256, 4096) == 0


def test_all_limits_hold(documents, tokenizer):
    rows = [(i, "some words here " * (1 + i % 9)) for i in range(200)]
    df = documents(rows).selectExpr("*", "doc_id % 13 AS prompt")
    pieces = P.pack(df.coalesce(2), PATH, max_tokens=64, max_segments=3, max_loss=40, loss_from="prompt").collect()
    check(rows, pieces, tokenizer, 64, 3, 40)
    with pytest.raises(ValueError):
        P.pack(df, PATH, max_segments=0)
    assert P.pack(documents([]), PATH).count() == 0
