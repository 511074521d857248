from __future__ import annotations

import random
import zlib

from litrewise.llm import language

ALPHABETS = {"xx": ["ka", "lo", "mi", "zu"], "yy": ["bre", "fto", "gni", "pse"], "zz": ["äl", "öm", "ür", "ßt"]}


def labelled(spark, n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(ALPHABETS))
        words = ["".join(rng.choices(ALPHABETS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        rows.append((i, " ".join(words), lang if i % 17 else None, "s", len(words)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


def test_held_out_accuracy_and_split(spark):
    docs = labelled(spark)
    rows = language.identify_documents(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0.0 <= r["score"] <= 1.0
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 20
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_odd_rows(odd):
    rows = {(r["doc_id"], r["lang_pred"]) for r in language.identify_documents(odd).collect()}
    undetermined = {i for i, lang in rows if lang == "und"}
    assert undetermined == {1, 2, 3, 10, None}
    assert len(language.identify_documents(odd).collect()) == odd.count()


def test_only_text_decides(spark):
    docs = labelled(spark, 60)
    dictionaries = language.learn_dictionaries(docs)
    a = language.identify(docs, dictionaries).select("doc_id", "lang_pred", "score").collect()
    blind = docs.selectExpr("doc_id", "text", "'xx' as lang", "null as source")
    b = language.identify(blind, dictionaries).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_narrow_margins_are_rejected(spark):
    compressors = language.Compressors({"xx": b"kalomizu " * 50, "yy": b"breftogni " * 50})
    _, score, margin = compressors.predict("qqqq")
    assert margin < language.NARROW_BITS and score <= 0.75


def test_nothing_to_learn(empty, odd):
    assert language.identify_documents(empty).count() == 0
    rows = language.identify_documents(odd.filter("doc_id = 4").drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert [r["lang_pred"] for r in rows.collect()] == ["und"]


def test_numbers_are_no_letters(spark):
    texts = ["½ ²", "①", "Ⅷ", "１２", "٣", "_", "a½", "ª", "漢"]
    dictionaries = {"xx": b"kalo mizu " * 20, "yy": b"bre fto " * 20}
    rows = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dictionaries).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {0, 1, 2, 3, 4, 5}


def test_predictions_equal_plain_compression(spark):
    import zstandard

    docs = labelled(spark, 80)
    dictionaries = language.learn_dictionaries(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, dictionaries).collect()}
    for r in docs.collect():
        letters = "".join(c if c.isalpha() else " " for c in r["text"].lower())
        words = " ".join(letters.split()).encode()
        level = language.SHORT_LEVEL if len(words) <= language.SHORT_BYTES else language.LEVEL
        sizes = {}
        for lang, content in dictionaries.items():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            press = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)
            blocks = [words[i : i + language.BLOCK_BYTES] for i in range(0, len(words), language.BLOCK_BYTES)]
            sizes[lang] = sum(len(press.compress(b)) for b in blocks)
        assert found[r["doc_id"]] == min(sorted(sizes), key=sizes.get)


def test_all_sampled_texts_share_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 3000)
    rows = [(i, f"{chr(97 + i % 26) * 8}{chr(97 + i // 26) * 8} " * 60, "xx") for i in range(100)]
    content = language.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["xx"]
    assert len(content) <= 3000 and len({w[:3] + w[-3:] for w in content.split() if len(w) == 16}) > 60


def test_short_texts_teach_languages_without_others(spark):
    rows = [(i, "bre fto", "yy") for i in range(30)] + [(100 + i, "kalomizu " * 20 + str(i), "xx") for i in range(30)]
    rows += [(200 + i, "zz zz", "xx") for i in range(30)]
    found = language.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"xx", "yy"} and b"zz" not in found["xx"]


def test_one_id_neither_drops_nor_multiplies_rows(spark):
    rows = [(1, f"bre fto gni pse {'kalo ' * 10} {i}", "yy") for i in range(3000)] + [(2, "kalomizu " * 20, "xx")] * 1000
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.learn_dictionaries(frame)
    assert set(found) == {"xx", "yy"} and len(found["xx"]) <= 200 and len(found["yy"]) > 10_000


def test_the_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = [(100 * k + i, f"text of {k} {i} " * 5, f"l{k}") for k in range(6) for i in range(k + 1)]
    found = language.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) == {"l3", "l4", "l5"}


def test_equal_shares():
    assert language.equal_shares([b"a" * 10, b"b" * 2, b"c" * 10], 12) == [b"a" * 5, b"b" * 2, b"c" * 5]
    assert language.equal_shares([b"a", b"b"], 100) == [b"a", b"b"]
