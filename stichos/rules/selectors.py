"""Which rows of the matrix an analysis uses (V-*).

A selector is an ordered list of arms (predicate, decision) over `text`, `sub` and
`name` (`text: sub`); the first arm that holds decides. Decisions are `skip` or a role
(train, test), whether the name is shown, and a label. Without an arm a row is skipped.
The text names and labels are fixed values of the analyses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS = ("Epitaphius Bios", "Eros Drapeta", "Europa", "Megara", "Idylls_Epigrams",
         "Epithalamium Achillis et Deidameiae", "Epitaphius Adonis", "Fragmenta")
AFTER_HESIOD = ("Cynegetica", "Halieutica", "Fall of Troy", "The Taking of Ilios", "Dionysiaca", "Argonautica",
                "Phaenomena", "Idylls", "Works of Bion", "Works of Moschus", "Abduction of Helen")
HYMNS = ("Hymns", "HymnsShort", "HymnsLong")
HESIOD = ("Works and Days", "Shield of Heracles", "Theogony")
HOMER = ("Iliad", "Odyssey")
DIVIDED = ("Iliad", "Odyssey", "HymnsLong", "Dionysiaca", "Argonautica")
DIVIDED_ALL = DIVIDED + ("Cynegetica", "Halieutica", "Fall of Troy")
LATE = ("Abduction of Helen", "Cynegetica", "Halieutica", "Fall of Troy", "The Taking of Ilios", "Works of Bion",
        "Works of Moschus")
BOOK, WHOLE = "sub <> 'Overall'", "sub = 'Overall'"


def of(*texts: str) -> str:
    return f"text IN ({', '.join(repr(t) for t in texts)})"


def named(*names: str) -> str:
    return f"name IN ({', '.join(repr(n) for n in names)})"


def labels(role: str, *pairs: tuple, where: str = "", rest: str | None = None) -> list[tuple[str, str]]:
    """(texts, label) pairs of one role; `rest` decides what else fulfils `where`."""
    gate = f"{where} AND " if where else ""
    out = [(gate + of(*([t] if isinstance(t, str) else t)), f"{role} {label}") for t, label in pairs]
    return out + ([(where or "TRUE", rest)] if rest else [])


_HOMER = (("Iliad", 0), ("Odyssey", 1))
_HIDDEN_BOOKS = (*labels("test show", ("HymnsLong", 2)), *labels("test hide", *_HOMER))
_EARLY = (*_HOMER, (HYMNS, 2), (HESIOD, 3), ("CallimachusHymns", 5), ("Idylls_Eidulia", 5), ("Argonautica", 5))


def _skip(*texts: str, rows: tuple = ("HymnsLong: Book 1",)) -> list[tuple[str, str]]:
    return [(of(*texts), "skip")] + ([(named(*rows), "skip")] if rows else [])


def _in_tests(where: str) -> list[tuple[str, str]]:
    """Rows shown against a trained space: hymns by name, Homer without."""
    return [(f"({where}) AND {c}", d) for c, d in _HIDDEN_BOOKS]


def _look(where: str) -> list[tuple[str, str]]:
    return [*_in_tests(where), *labels("test hide", ("Dionysiaca", 7), where=f"({where})"),
            *labels("test show", (LATE, 8), where=f"({where})"), (where, "skip"),
            *labels("train show", *_EARLY, ("Dionysiaca", 7), ("Idylls", 5), rest="train show 8")]


def _classes(base: list, shown_homer: bool = True, hide: tuple = ()) -> list[tuple[str, str]]:
    out = list(base)
    if hide:
        out += labels("train hide", (hide, 0))
    return out + labels("train show" if shown_homer else "train hide", (HOMER, 1), rest="train show 0")


_CLASSIFY = [*_skip("Hymns", *PARTS), (f"{of(*DIVIDED)} AND {WHOLE}", "skip")]
_CLASSIFY_ALL = [*_skip("Hymns", *PARTS), (f"{of(*DIVIDED_ALL)} AND {WHOLE}", "skip")]
_FAR = _skip(*AFTER_HESIOD, *PARTS)
_ODD = ("HymnsLong: Book 5", "HymnsLong: Book 3", "Shield of Heracles: Overall")

SELECTORS: dict[str, list[tuple[str, str]]] = {
    "iliad_odyssey_only": labels("train show", *_HOMER, where=BOOK),
    "dionysiaca_split": [(f"{BOOK} AND text = 'Dionysiaca' AND CAST(substr(sub, 6) AS INT) <= 24", "train show 0"),
                         (f"{BOOK} AND text = 'Dionysiaca'", "train show 1")],
    "authors_split": labels("train show", ("Dionysiaca", 0), ("Fall of Troy", 1), where=BOOK),
    "iliad_odyssey_only_no_target": labels("train show", (HOMER, 0), where=BOOK),
    "books_only": [(BOOK, "train show 0")],
    "all_overalls": [*_skip(*PARTS, rows=()), (WHOLE, "train show 2")],
    "all_overalls_test_books": [
        *_skip(*PARTS, rows=()),
        *labels("test show", *_HOMER, ("HymnsLong", 2), ("Dionysiaca", 7), ("Argonautica", 5), where=BOOK, rest="test show 8"),
        *labels("train show", *_EARLY, ("Dionysiaca", 7), ("Idylls", 5), rest="train show 8")],
    "closer_only": [
        *_skip("Dionysiaca", "Abduction of Helen", *PARTS),
        *labels("test show", ("Iliad", 1), ("Odyssey", 2), ("HymnsLong", 3), ("Argonautica", 5), where=BOOK, rest="test show 0"),
        (WHOLE, "train show 2")],
    "closer_only_hymns": [
        *_skip("Dionysiaca", "Abduction of Helen", *PARTS), *_in_tests(BOOK), (BOOK, "skip"),
        *labels("train show", *_EARLY, rest="train show 8")],
    "closer_only_hymns_dio_as_test": [
        *_skip(*PARTS), *_look(f"{BOOK} OR {of('Dionysiaca', 'Works of Moschus', 'Works of Bion')}")],
    "closer_only_hymns_dio_as_test_1": [
        *_skip(*PARTS), *_look(f"{BOOK} OR {of('Dionysiaca', 'Works of Moschus', 'Works of Bion', 'Abduction of Helen', 'The Taking of Ilios')}")],
    "homer_hesiod_hymns": [
        *_FAR, *_in_tests(BOOK), *labels("test show", ("CallimachusHymns", 8)), (BOOK, "skip"),
        *labels("train show", *_HOMER, (HESIOD, 3), (HYMNS, 2), rest="train show 8")],
    "homer_hymns": [
        *_FAR, *_in_tests(BOOK), *labels("test show", (HESIOD, 3), ("CallimachusHymns", 8)), (BOOK, "skip"),
        *labels("train show", *_HOMER, (HYMNS, 2), rest="train show 8")],
    "homer_test_hesiod_hymns": [
        *_FAR, *_in_tests(BOOK), *labels("test show", (HESIOD, 3), (HYMNS, 2), ("CallimachusHymns", 8)), (BOOK, "skip"),
        *labels("train show", *_HOMER, rest="train show 8")],
    "homer_hesiod_hymns_all": [
        *_FAR, *labels("test show", ("CallimachusHymns", 8)),
        *labels("train show", *_HOMER, (HESIOD, 3), (HYMNS, 2), rest="train show 8")],
    "homer_hymns_all": [
        *_FAR, *labels("test show", (HESIOD, 3), ("CallimachusHymns", 8)),
        *labels("train show", *_HOMER, (HYMNS, 2), rest="train show 8")],
    "homer_test_hesiod_hymns_all": [
        *_FAR, *labels("test show", (HESIOD, 3), (HYMNS, 2), ("CallimachusHymns", 8)),
        *labels("train show", *_HOMER, rest="train show 8")],
    "classify_1": _classes(_CLASSIFY),
    "classify_2": [*_skip(*HYMNS, *PARTS), (f"{of(*DIVIDED)} AND {WHOLE}", "skip"),
                   *labels("train show", (HOMER, 1), ("Dionysiaca", 0))],
    "classify_3": _classes(_CLASSIFY_ALL, shown_homer=False, hide=("Dionysiaca",)),
    "classify_4": _classes([*_CLASSIFY, (named(*_ODD, "Idylls_Eidulia: Overall"), "skip")]),
    "classify_5": [*_CLASSIFY, *labels("train hide", (HOMER, 1)), (named(*_ODD), "train show 0")],
    "classify_6": _classes(_CLASSIFY_ALL),
}


def decision(arms: list[tuple[str, str]]) -> str:
    """The arms as one SQL CASE."""
    return "CASE " + " ".join(f"WHEN {test} THEN '{d}'" for test, d in arms) + " ELSE 'skip' END"


def select_rows(rows: DataFrame, arms: list[tuple[str, str]], text: str = "text_name", sub: str = "sub") -> DataFrame:
    """V-0: keep the rows a selector takes, with is_test, show_name and label."""
    packed = rows.select(F.struct(*rows.columns).alias("_row"), F.col(text).alias("text"), F.col(sub).alias("sub"),
                         F.concat_ws(": ", text, sub).alias("name"))
    said: Column = F.split(F.expr(decision(arms)), " ")
    out = packed.withColumn("_d", said).filter(F.col("_d")[0] != "skip")
    return out.select("_row.*", "name", (F.col("_d")[0] == "test").alias("is_test"),
                      (F.col("_d")[1] == "show").alias("show_name"), F.col("_d")[2].cast("int").alias("label"))


def select_all(rows: DataFrame, selectors: dict[str, list[tuple[str, str]]], text: str = "text_name", sub: str = "sub") -> DataFrame:
    """All selectors in one pass over the rows: a row for each selector that takes it."""
    packed = rows.select(F.struct(*rows.columns).alias("_row"), F.col(text).alias("text"), F.col(sub).alias("sub"),
                         F.concat_ws(": ", text, sub).alias("name"))
    said = F.array(*[F.struct(F.lit(s).alias("selector"), F.split(F.expr(decision(arms)), " ").alias("_d")) for s, arms in selectors.items()])
    out = packed.select("_row", "name", F.inline(said)).filter(F.col("_d")[0] != "skip")
    return out.select("selector", "_row.*", "name", (F.col("_d")[0] == "test").alias("is_test"),
                      (F.col("_d")[1] == "show").alias("show_name"), F.col("_d")[2].cast("int").alias("label"))
