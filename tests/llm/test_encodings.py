from graphmere.llm.encodings import find_garbled, restore_garbled

SCHEMA = "doc_id long, text string, word string, kind string, n long, doc string"
CLEAN = [
    "La décision de l’équipe précède la forêt où le café était – déjà là", "Die geprüfte Größe löscht die nächtliche Lösung", "Общая запись хранит раздел памяти",
    "Każda żółta książka śledzi wątpliwość", "この注釈が昨日の棚を更新した。すべての記憶は古い。", "Nuestra señal añadió líneas más tarde", "The “quiet” index doesn’t cost 5 €",
]
NATURAL = ["NÃO HÁ AVANÇO — ÂNGULO", "Ðór í Ásbyrgi ¹ ² ³", "‰ and ‡ marks, ½ cup", "PÂTÉ ET CRÈME", "£4, ¥600 ™ ©", "", None, "plain ascii", "x² ≤ 40 °C", "a b"]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "iso8859-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("utf-8", "cp1251"), ("iso8859-2", "cp1252")]


def garble(text, written, read):
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(written))


def rows(texts, start=0):
    return [(start + i, t, "word", "unit", 1, "d") for i, t in enumerate(texts)]


def test_found_and_restored(spark):
    clean = rows(CLEAN * 4) + rows(NATURAL, 1000) + [rows(CLEAN)[0]]
    bad, origin = [], {}
    for c, (written, read) in enumerate(CHAINS):
        for i, t in enumerate(CLEAN):
            try:
                g = garble(t, written, read)
            except UnicodeEncodeError:
                continue
            # What differs in single characters between blanks only is no word that could be told from others.
            if any(len(w) > 2 and w != v for w, v in zip(t.split(), g.split())):
                n = 10_000 + 100 * c + i
                bad.append((n, f"Some plain words first. {g}", "word", "unit", 1, "d"))
                origin[n] = f"Some plain words first. {t}"
    lost = (90_000, "Some words: " + CLEAN[0].encode("cp1252").decode("utf-8", "replace"), "w", "k", 1, "d")
    twice = (90_001, garble(garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252"), "w", "k", 1, "d")
    df = spark.createDataFrame(clean + bad + [lost, twice], SCHEMA)
    found = {r["doc_id"] for r in find_garbled(df).collect()}
    assert found == set(origin) | {90_000, 90_001}
    restored = {r["doc_id"]: r["restored"] for r in restore_garbled(df).collect()}
    # Of lost characters only those in words with one possible original come back.
    assert restored[90_000].startswith("Some words: La décision de l’équipe précède la forêt") and restored[90_001] == CLEAN[0]
    words = [(a, b, g) for n, t in origin.items() for a, b, g in zip(restored[n].split(), t.split(), dict((r[0], r[1]) for r in bad)[n].split()) if b != g]
    right = sum(a == b for a, b, _ in words)
    assert right >= 0.9 * len(words), [w for w in words if w[0] != w[1]]


def test_a_third_garbled_by_a_swap(spark):
    texts = ["Общая запись хранит раздел памяти", "Каждый раздел памяти хранит старую запись", "Новая запись обновила общий раздел"]
    clean = rows(texts * 4)
    bad = rows([garble(t, "cp1251", "koi8-r") for t in texts * 2], 100)
    once = "Сегодня запись хранит редкое слово"
    bad += rows([garble(once, "cp1251", "koi8-r")], 200)
    df = spark.createDataFrame(clean + bad + rows([once], 300), SCHEMA)
    assert {r["doc_id"] for r in find_garbled(df).collect()} == {r[0] for r in bad}
    restored = {r["doc_id"]: r["restored"] for r in restore_garbled(df).collect()}
    assert restored[100] == texts[0] and restored[200] == once


def test_more_garbled_than_clean(spark):
    texts = ["Общая запись хранит раздел памяти", "Каждый раздел памяти хранит Старую запись", "Новая запись обновила Общий раздел"]
    bad = rows([garble(t, "cp1251", "koi8-r") for t in texts * 6], 100)
    df = spark.createDataFrame(rows(texts * 3) + bad, SCHEMA)
    assert {r["doc_id"] for r in find_garbled(df).collect()} == {r[0] for r in bad}
    western = ["Die geprüfte Größe löscht die nächtliche Lösung", "Größere Änderungen prüft nächtlich die Küche"]
    bad = rows([garble(t, "cp1252", "cp437") for t in western * 6], 200)
    df = spark.createDataFrame(rows(western * 3) + bad, SCHEMA)
    assert {r["doc_id"] for r in find_garbled(df).collect()} == {r[0] for r in bad}


def test_other_readers_and_pairs_of_readings(spark):
    german, chinese = "Die Größe prüft die Übersicht", "注释更新了书架，记忆很旧"
    twice = garble(garble("déjà vu à l’été", "utf-8", "cp1252"), "utf-8", "iso8859-1")
    bad = [german.encode().decode(r, "replace") for r in ("gb18030", "shift_jis", "cp949")] + [garble("Καλημέρα κόσμε", "cp1253", "cp1252"), twice]
    df = spark.createDataFrame(rows([german, chinese, "déjà vu à l’été", "Καλημέρα κόσμε"] * 4) + rows(bad, 100), SCHEMA)
    assert {r["doc_id"] for r in find_garbled(df).collect()} == {100, 101, 102, 103, 104}


def test_empty_and_clean(spark):
    assert find_garbled(spark.createDataFrame([], SCHEMA)).count() == 0
    assert find_garbled(spark.createDataFrame(rows(CLEAN + NATURAL) + rows(["é" * 20_000], 500), SCHEMA)).count() == 0


def test_words_are_cut_once(spark, monkeypatch):
    import re

    import pyarrow as pa

    from graphmere.llm import encodings

    texts = ["", None, "plain ascii", "déjà vu déjà x² été", "この注釈が 昨日の棚 déjà", "naïve-ã©é DÃ©jÃ ã‚’ã\u0081¤", "été " * 3, "�x a1é2b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "d long, text string")
    want = set()
    for i, t in enumerate(texts):
        for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or ""):
            if not w.isascii():
                parts = re.findall(r"[^\x00-\x7f]+", w)
                units = [u for p in parts for u in re.findall(encodings._unit_pattern(), p)]
                chars = [c for c in w if "ࠀ" <= c < "�"] + re.findall("[ぁ-ん]{2,}", w)
                want |= {(i, w, "word"), *((i, p, "fragment") for p in parts), *((i, u, "unit") for u in units), *((i, c, "char") for c in chars)}
    made = encodings.document_words(df, "d", "text")
    rows = [tuple(r) for r in made.collect()]
    assert set(rows) == want and len(rows) == len(want) and {k for *_, k in want} == {"word", "fragment", "unit", "char"}
    # No text goes through a pattern twice, as a filter pushed below its own column did.
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    # What is known is forgotten where it gets too much; nothing is lost by that.
    monkeypatch.setattr(encodings, "KNOWN_WORDS", 1)
    one = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t and t.encode()], pa.binary())], names=["doc", "text"]) for i, t in enumerate(texts)]
    assert sorted(tuple(r.values()) for b in encodings._pieces(iter(one)) for r in b.to_pylist()) == sorted(want)
