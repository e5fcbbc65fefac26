"""Language ID against a plain version with dictionaries."""

import zlib
from collections import Counter

from listloom.llm import langid


def grams(text):
    out, words, word = Counter(), [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in words:
        out.update(w)
        out.update(a + b for a, b in zip(w, w[1:], strict=False))
        out.update(["_" + w[0]] + [w[-1] + "_"])
        edged = "_" + w + "_"
        out.update(edged[j : j + 3] for j in range(len(edged) - 2))
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], len(g), [0 if c == "_" else ord(c) for c in g]))[:size]


def brute(rows, size=langid.PROFILE):
    sums = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c, size))} for lang, c in sums.items() if c}
    out = []
    for i, text, _ in rows:
        mine = ranked(grams(text), size)
        far = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get) if mine and far else None
        score = 1 - far[best] / (size * len(mine)) if best else 0.0
        out.append((i, zlib.crc32(str(i).encode()) % 4 == 2, best or "und", round(score, 9)))
    return sorted(out)


SCRIPTS = [
    (100, "Привет, мир! Как дела сегодня?", "ru"), (101, "Добрый день всем людям мира", "ru"), (102, "日本語のテキストです。そして", "ja"), (103, "これは日本語の文です", "ja"),
    (104, "ÄÖÜ ärger über öl", "de"), (105, "bœuf øl ł", None), (106, "Καλημέρα κόσμε", None), (107, "мир", None), (108, "a", "x"), (109, "a", "y"), (110, "a", None), (111, "İ ß Σ", "de"),
]


def test_equals_plain_profiles(spark, odd, documents, write_tables):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()] + SCRIPTS
    rows += [(1000 + i, t, lang) for i, t, lang in zip(documents.doc_id.tolist(), documents.text, documents.lang, strict=True)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], odd.schema).withColumn("lang_pred", langid.F.lit("z"))
    found = sorted((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in langid.op6_language_id(spark, write_tables(docs)).collect())
    assert found == brute(rows)


def test_small_hold_gives_the_same_profiles(spark, documents, monkeypatch):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in zip(documents.doc_id.tolist(), documents.text, documents.lang, strict=True)], "doc_id long, text string, lang string").repartition(2)
    want = langid.profiles(docs, langid.F.lit(True))
    monkeypatch.setattr(langid, "HELD", 500)
    assert langid.profiles(docs, langid.F.lit(True)) == want and len(want) == 4


def test_stage_without_languages_keeps_every_text_with_a_letter(spark, odd, sf_dir):
    left = langid.stage(spark, odd.withColumn("lang", langid.F.lit(None).cast("string")), sf_dir).collect()
    assert sorted(r["doc_id"] for r in left) == [4, 5, 6, 6, 8, 9, 10, 11]


def test_stage_drops_what_is_in_no_learned_language(spark, odd, sf_dir, documents):
    rows = [(i, t, lang, "s", 0) for i, t, lang in zip(documents.doc_id.tolist(), documents.text, documents.lang, strict=True)]
    docs = spark.createDataFrame(rows + [(10_000 + i, t, lang, "s", 0) for i, t, lang in SCRIPTS if lang in (None, "none")] + [(20_000, "日本語のテキストです", None, "s", 0), (20_001, "12 !", "en", "s", 0)], odd.schema)
    left = {r["doc_id"] for r in langid.stage(spark, docs, sf_dir).collect()}
    assert {r[0] for r in rows} <= left and not left & {10_106, 10_107, 20_000, 20_001}
