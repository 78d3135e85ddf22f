import numpy as np
import pytest

from codectx.llm import encoding as e

FRENCH = "Le contexte récupéré améliore la qualité. Voilà pourquoi « l’été » reste à côté du modèle gelé, où la perte était élevée. "
GERMAN = "Die Rückgabe enthält ungültige Einträge für größere Läufe. Der Prüfer löscht veraltete Blöcke. "
POLISH = "Także część wierszy nie mieści się w oknie. Proszę sprawdzić długość kontekstu. Źródło pliku zostało usunięte, więc wynik jest pusty. "
RUSSIAN = "Проверка выполняется после каждой эпохи. Если кэш устарел, индекс нужно построить заново. Почему фрагмент обрезан на границе строки? "
PORTUGUESE = "ATENÇÃO: NÃO USE EM PRODUÇÃO SEM REVISÃO. A função não é chamada quando a opção já está na configuração. "
ENGLISH = "The retriever returns “x” before it’s ready — see y… "
PLAIN = [FRENCH, GERMAN, POLISH, RUSSIAN, PORTUGUESE, ENGLISH, "│ a │ b │ ≤ 3 µs ± 2 → № 7 €", "À vérifier : ok", "plain ascii"]
DOCS = "doc_id long, text string, encodings string, segments long, lost int"


def wrong(text, right, read):
    return text.encode(right).decode(read, "surrogateescape" if read == "ascii" else "strict")


def lenient(text):
    """UTF-8 read as cp1252, undefined bytes passed through as controls."""
    return "".join(b.decode("cp1252") if b not in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d") else chr(b[0]) for b in (bytes([x]) for x in text.encode()))


GARBLED = [
    (FRENCH, wrong(FRENCH, "utf-8", "latin-1")), (GERMAN, lenient(GERMAN)), (ENGLISH, lenient(ENGLISH)), (ENGLISH, lenient(lenient(ENGLISH))), (GERMAN, wrong(GERMAN, "utf-8", "mac_roman")), (POLISH, wrong(POLISH, "utf-8", "cp437")),
    (RUSSIAN, lenient(RUSSIAN)), (PORTUGUESE, lenient(PORTUGUESE)), (POLISH, wrong(POLISH, "iso8859-2", "latin-1")), (RUSSIAN, wrong(RUSSIAN, "cp1251", "latin-1")), (FRENCH, lenient(lenient(FRENCH))),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, PLAIN[i % len(PLAIN)]) for i in range(900)] + [(1000 + k, g) for k, (_, g) in enumerate(GARBLED)]
    rows += [(2000, None), (2001, ""), (2002, "caf� is damaged"), (2003, FRENCH * 500), (2004, "It is " + lenient("naïve") + " here"), (2005, GERMAN + lenient(FRENCH))]
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], DOCS)


def test_finds_the_garbled_and_only_them_and_restores_them(corpus):
    out = {r.doc_id: r for r in e.find_garbled(corpus).collect()}
    assert set(out) == {1000 + k for k in range(len(GARBLED))} | {2002, 2004, 2005}
    for k, (text, _) in enumerate(GARBLED):
        if k not in (8, 9):  # one-byte mistakes are restored where there is enough of them
            assert out[1000 + k].text == text, k
    assert out[2002].lost == 1 and out[2002].text == "caf� is damaged"
    assert out[2004].text == "It is naïve here" and out[2005].text == GERMAN + FRENCH


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], DOCS)
    assert e.find_garbled(empty).collect() == []
    one = spark.createDataFrame([(1, lenient("naïve"), "", 1, 1)], DOCS)
    assert [r.text for r in e.find_garbled(one).collect()] == ["naïve"]


def test_counts_do_not_depend_on_partitions(corpus):
    a = {(r.kind, r.slot): r.n for r in e.count_pairs(corpus).collect()}
    b = {(r.kind, r.slot): r.n for r in e.count_pairs(corpus.repartition(9)).collect()}
    assert a == b


@pytest.mark.parametrize("word", ["naïve", "été", "größe", "“x”", "привет", "łąka"])
def test_garbling_that_is_repeated_is_still_found(spark, word):
    rows = [(i, f"a {lenient(word)} b") for i in range(300)] + [(1000 + i, p) for i, p in enumerate(PLAIN) if word not in p]
    out = {r.doc_id: r.text for r in e.find_garbled(spark.createDataFrame([(*r, "", 1, 1) for r in rows], DOCS)).collect()}
    assert out == {i: f"a {word} b" for i in range(300)}


@pytest.mark.parametrize("text", ["l’été", "список", "c’était à l’école", "il dit —été— ici", "GEHÖ“"])
def test_runs_that_are_utf8_by_chance_stay(spark, text):
    rows = [(i, f"{text} {FRENCH if i % 2 else RUSSIAN}", "", 1, 1) for i in range(60)]
    assert e.find_garbled(spark.createDataFrame(rows, DOCS)).collect() == []


def test_a_single_damaged_word_is_found(spark):
    polish = POLISH + "Zażalenie, każdy wyraża pożar, mażą i ważą. "
    rows = [(i, [polish, FRENCH, GERMAN, ENGLISH][i % 4]) for i in range(600)] + [(1000, "The word Za¿alenie stands here alone."), (1001, "A naïve señor stands here alone. ¿Qué? Muñoz")]
    out = {r.doc_id: r for r in e.find_garbled(spark.createDataFrame([(*r, "", 1, 1) for r in rows], DOCS)).collect()}
    assert set(out) == {1000} and out[1000].lost == 1 and out[1000].text == rows[600][1] and out[1000].encodings == []


def test_what_went_wrong_many_times_is_undone_as_often():
    text = "na\u00efve"
    for _ in range(6):
        text = lenient(text)
    m = e.PairModel(np.zeros(1 << e.CHAR_BITS), np.zeros(1 << e.PAIR_BITS))
    assert e.restore(text, m)[0] == "na\u00efve"
