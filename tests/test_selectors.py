"""What each row selector says of rows of every kind, written out by hand; the schemes of votes that rules must not cast."""

import pytest

from stichos.rules import selectors as se

ROWS = {"IO": "Iliad: Overall", "I1": "Iliad: Book 1", "O2": "Odyssey: Book 2", "LO": "HymnsLong: Overall", "L1": "HymnsLong: Book 1", "L3": "HymnsLong: Book 3", "HO": "Hymns: Overall",
        "TO": "Theogony: Overall", "CO": "CallimachusHymns: Overall", "C2": "CallimachusHymns: Book 2", "DO": "Dionysiaca: Overall", "D24": "Dionysiaca: Book 24", "D25": "Dionysiaca: Book 25",
        "AO": "Argonautica: Overall", "A1": "Argonautica: Book 1", "FO": "Fall of Troy: Overall", "F3": "Fall of Troy: Book 3", "XO": "Abduction of Helen: Overall", "MO": "Works of Moschus: Overall",
        "PO": "Megara: Overall", "SO": "Shield of Heracles: Overall", "EO": "Idylls_Eidulia: Overall"}
# selector: role and label of each row it takes. T train and t test with the name shown, H train and h test without it.
WANTED = {
    "iliad_odyssey_only": "I1 T0, O2 T1",
    "dionysiaca_split": "D24 T0, D25 T1",
    "authors_split": "D24 T0, D25 T0, F3 T1",
    "iliad_odyssey_only_no_target": "I1 T0, O2 T0",
    "books_only": "I1 T0, O2 T0, L1 T0, L3 T0, C2 T0, D24 T0, D25 T0, A1 T0, F3 T0",
    "all_overalls": "IO T2, LO T2, HO T2, TO T2, CO T2, DO T2, AO T2, FO T2, XO T2, MO T2, SO T2, EO T2",
    "all_overalls_test_books": "I1 t0, O2 t1, L1 t2, L3 t2, C2 t8, D24 t7, D25 t7, A1 t5, F3 t8, IO T0, LO T2, HO T2, TO T3, CO T5, DO T7, AO T5, FO T8, XO T8, MO T8, SO T3, EO T5",
    "closer_only": "I1 t1, O2 t2, L3 t3, C2 t0, A1 t5, F3 t0, IO T2, LO T2, HO T2, TO T2, CO T2, AO T2, FO T2, MO T2, SO T2, EO T2",
    "closer_only_hymns": "L3 t2, I1 h0, O2 h1, IO T0, LO T2, HO T2, TO T3, CO T5, AO T5, FO T8, MO T8, SO T3, EO T5",
    "closer_only_hymns_dio_as_test": "L3 t2, I1 h0, O2 h1, D24 h7, D25 h7, DO h7, F3 t8, MO t8, IO T0, LO T2, HO T2, TO T3, CO T5, AO T5, FO T8, XO T8, SO T3, EO T5",
    "closer_only_hymns_dio_as_test_1": "L3 t2, I1 h0, O2 h1, D24 h7, D25 h7, DO h7, F3 t8, MO t8, XO t8, IO T0, LO T2, HO T2, TO T3, CO T5, AO T5, FO T8, SO T3, EO T5",
    "homer_hesiod_hymns": "L3 t2, I1 h0, O2 h1, CO t8, C2 t8, IO T0, LO T2, HO T2, TO T3, SO T3, EO T8",
    "homer_hymns": "L3 t2, I1 h0, O2 h1, CO t8, C2 t8, TO t3, SO t3, IO T0, LO T2, HO T2, EO T8",
    "homer_test_hesiod_hymns": "L3 t2, I1 h0, O2 h1, CO t8, C2 t8, TO t3, SO t3, HO t2, LO t2, IO T0, EO T8",
    "homer_hesiod_hymns_all": "CO t8, C2 t8, IO T0, I1 T0, O2 T1, LO T2, L3 T2, HO T2, TO T3, SO T3, EO T8",
    "homer_hymns_all": "CO t8, C2 t8, TO t3, SO t3, IO T0, I1 T0, O2 T1, LO T2, L3 T2, HO T2, EO T8",
    "homer_test_hesiod_hymns_all": "CO t8, C2 t8, TO t3, SO t3, HO t2, LO t2, L3 t2, IO T0, I1 T0, O2 T1, EO T8",
    "classify_1": "I1 T1, O2 T1, L3 T0, TO T0, CO T0, C2 T0, D24 T0, D25 T0, A1 T0, FO T0, F3 T0, XO T0, MO T0, SO T0, EO T0",
    "classify_2": "I1 T1, O2 T1, D24 T0, D25 T0",
    "classify_3": "I1 H1, O2 H1, L3 T0, TO T0, CO T0, C2 T0, D24 H0, D25 H0, A1 T0, F3 T0, XO T0, MO T0, SO T0, EO T0",
    "classify_4": "I1 T1, O2 T1, TO T0, CO T0, C2 T0, D24 T0, D25 T0, A1 T0, FO T0, F3 T0, XO T0, MO T0",
    "classify_5": "I1 H1, O2 H1, L3 T0, SO T0",
    "classify_6": "I1 T1, O2 T1, L3 T0, TO T0, CO T0, C2 T0, D24 T0, D25 T0, A1 T0, F3 T0, XO T0, MO T0, SO T0, EO T0",
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, *v.split(": ")) for k, v in ROWS.items()], "short string, text_name string, sub string")


def said(found):
    mark = lambda r: {(False, True): "T", (True, True): "t", (False, False): "H", (True, False): "h"}[r.is_test, r.show_name]
    return sorted(f"{r.short} {mark(r)}{r.label}" for r in found)


def test_every_selector(rows):
    assert set(WANTED) == set(se.SELECTORS)
    got = se.select_all(rows, se.SELECTORS).collect()
    for name, wanted in WANTED.items():
        assert said(r for r in got if r.selector == name) == sorted(wanted.split(", ")), name


@pytest.mark.parametrize("name", ["dionysiaca_split", "classify_3", "closer_only_hymns_dio_as_test"])
def test_one_selector_alone(rows, name):
    out = se.select_rows(rows, se.SELECTORS[name])
    assert said(out.collect()) == sorted(WANTED[name].split(", ")) and {r.name for r in out.collect()} <= set(ROWS.values())
