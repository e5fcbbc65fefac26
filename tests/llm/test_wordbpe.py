"""op11 against the tokenizers library, and its cuts against the vocabulary."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listloom.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAéÉİΣß'stre0١ \t\x1c\x85\xa0 日本́ा क가<|endoftext|>ZQxjø\U0001f600\x00\x7f\xad﻿‍"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_op11_equals_the_library(spark, documents, odd, write_tables, library):
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 0) for i, t in enumerate(documents.text)] + [(9000, "a <|startoftext|>b<|endoftext|><|x|>", "en", "s", 0)], odd.schema))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for doc_id, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(tuple(r) for r in wordbpe.op11_word_bpe(spark, write_tables(docs)).collect()) == sorted(want)


def test_any_text_equals_the_library(library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))).replace("Q", "<|startoftext|>" if k % 3 == 0 else "q") for k in range(4000)]
    texts += ["".join(chr(rnd.randint(1, 0x24F)) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    texts += ["".join(chr(c) for _ in range(rnd.randint(0, 12)) if not 0xD800 <= (c := rnd.randint(1, 0x1FFFF)) < 0xE000) for _ in range(1000)]
    for text, ids in zip(texts, wordbpe.vocabulary(PATH).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert "".join(wordbpe.vocabulary(PATH).decode(ids)) == library.decode(ids.tolist(), skip_special_tokens=False), text


def test_long_words_and_texts_are_cut_and_whole(library, monkeypatch):
    texts = ["zqxj" * 30_000 + "日本" * 5_000, "", " word 'tis" * 20_000, "x", "  \n" * 5_000]
    monkeypatch.setattr(wordbpe, "GROUP", 1000)
    monkeypatch.setattr(wordbpe, "PIECE", 77)
    monkeypatch.setattr(wordbpe, "KEPT", 3)
    own = wordbpe.Vocabulary(PATH)
    found = list(own.encode(texts))
    assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ["".join(own.decode(f)) for f in found] == [library.decode(f.tolist(), skip_special_tokens=False) for f in found]
    assert list(own.encode([])) == [] and all(len(x) <= wordbpe.SHORT for m in (own.stretches, own.words) for x in m)


def test_cuts_lie_where_no_token_has_the_pair():
    own = wordbpe.vocabulary(PATH)
    tokens = [t.removesuffix("</w>") for t in json.load(open(PATH))["model"]["vocab"]]
    pairs = {t[k : k + 2] for t in tokens for k in range(len(t) - 1)}
    for word in ("zqxjstring", "qqqq", "ing", "a", "Ã©x" * 40):
        assert own.cuts(word).tolist() == [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
    assert len(own.cuts("zqxjvk")) > 0


def test_general_interface(spark, odd, empty, library):
    ids = wordbpe.encode(odd.withColumnRenamed("lang", "ids"))
    assert ids.columns == ["doc_id", "text", "source", "n_chars", "ids"]
    rows = wordbpe.decode(ids).collect()
    assert all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows) and len(rows) == odd.count()
    assert wordbpe.encode(empty).count() == 0 == wordbpe.round_trip(empty).count()
    strange = spark.createDataFrame([([0, 99_999_999, -5, 1],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in wordbpe.decode(strange).collect()] == ["! \"", None, ""]


def test_files_that_keep_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        wordbpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
