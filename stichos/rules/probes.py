"""Probe forms that reveal the stem class of a lemma (X-4).

A lemma belongs to the first block whose shape it has. The probes of a block are tried in
order: cut some letters off the lemma, move the accent forward if asked, add an ending; if
the form table knows that form of that lemma in that case, number and gender, the class is
found. The endings and classes are fixed values.
"""

from __future__ import annotations

from stichos.rules.table import (ADJ_2, ADJ_3, ADJ_EIS, ADJ_US, DIGAMMA, EIR_SHORT_A, IOTA, LONG_A, LONG_H, OMICRON,
                                 SHORT_A, SIGMA)

# block: SQL over clean (no marks, no digits), plain (no digits), lemma and pos_set
BLOCKS = (
    (1, "right(clean, 1) = 'h' AND array_contains(pos_set, 'noun')"),
    (2, "right(clean, 2) IN ('ra', 'ia', 'ea') AND array_contains(pos_set, 'noun')"),
    (3, "right(clean, 1) = 'a' AND array_contains(pos_set, 'noun')"),
    (4, "right(clean, 2) = 'hs' AND array_contains(pos_set, 'noun')"),
    (5, "right(clean, 3) IN ('ras', 'ias', 'eas') AND array_contains(pos_set, 'noun')"),
    (6, "right(clean, 3) = 'eus' AND array_contains(pos_set, 'noun')"),
    (7, "right(clean, 2) = 'is' AND array_contains(pos_set, 'noun')"),
    (8, "right(clean, 2) = 'os' AND array_contains(pos_set, 'adj')"),
    (9, "right(lemma, 3) = 'u/s' AND array_contains(pos_set, 'adj')"),
    (10, "right(clean, 3) = 'eis' AND array_contains(pos_set, 'adj')"),
    (11, "right(clean, 2) = 'os' AND array_contains(pos_set, 'noun')"),
)

# Block, what the lemma ends in, letters cut, accent, ending, case, number, gender (None any), class
PROBES = (
    (1, "h", 1, "-", "hs", "gen", "sg", "fem", LONG_H),
    (1, "h/", 2, "-", "h=s", "gen", "sg", "fem", LONG_H),
    (2, "a", 1, "-", "ai", "nom", "pl", "fem", "eir"),
    (2, "a", 1, "moves", "as", "gen", "sg", "fem", "eir"),
    (2, "a/", 2, "-", "ai/", "nom", "pl", "fem", "eir"),
    (2, "a/", 2, "-", "a=s", "gen", "sg", "fem", "eir"),
    (3, "", 1, "-", "ai", "nom", "pl", "fem", SHORT_A),
    (3, "", 1, "moves", "as", "gen", "sg", "fem", SHORT_A),
    (4, "hs", 2, "-", "ou", "gen", "sg", "masc", LONG_H),
    (4, "hs", 2, "-", "hn", "acc", "sg", "masc", LONG_H),
    (4, "h/s", 3, "-", "ou=", "gen", "sg", "masc", LONG_H),
    (4, "h/s", 3, "-", "h/n", "acc", "sg", "masc", LONG_H),
    (5, "as", 2, "-", "ou", "gen", "sg", "masc", LONG_A),
    (5, "as", 2, "-", "hn", "acc", "sg", "masc", LONG_A),
    (5, "a/s", 3, "-", "ou=", "gen", "sg", "masc", LONG_A),
    (5, "a/s", 3, "-", "h/n", "acc", "sg", "masc", LONG_A),
    (6, "", 4, "-", "e/ws", "gen", "sg", None, DIGAMMA),
    (7, "is", 2, "-", "ews", "gen", "sg", None, IOTA),
    (7, "i/s", 3, "-", "e/ws", "gen", "sg", None, IOTA),
    (8, "os", 2, "-", "ai", "nom", "pl", "fem", ADJ_3),
    (8, "os", 2, "moves", "hs", "gen", "sg", "fem", ADJ_3),
    (8, "os", 2, "-", "oi", "nom", "pl", None, ADJ_2),
    (8, "os", 2, "moves", "ou", "gen", "sg", None, ADJ_2),
    (8, "o/s", 3, "-", "ai/", "nom", "pl", "fem", ADJ_3),
    (8, "o/s", 3, "-", "h=s", "gen", "sg", "fem", ADJ_3),
    (8, "o/s", 3, "-", "oi/", "nom", "pl", None, ADJ_2),
    (8, "o/s", 3, "-", "ou=", "gen", "sg", None, ADJ_2),
    (9, "", 3, "-", "ei=a", "nom", "sg", "fem", ADJ_US),
    (10, "", 3, "drops", "e/ssas", "gen", "sg", "fem", ADJ_EIS),
    (11, "os", 2, "moves", "ou", "gen", "sg", None, OMICRON),
    (11, "os", 2, "-", "ous", "gen", "sg", None, SIGMA),
    (11, "o/s", 3, "-", "ou=", "gen", "sg", None, OMICRON),
    (11, "o/s", 3, "-", "ou=s", "gen", "sg", None, SIGMA),
)
EIR = {False: LONG_A, True: EIR_SHORT_A}


def probes() -> list[tuple]:
    """(no, block, needs, cut, accent, ending, case, number, gender, class)."""
    return [(no, *row) for no, row in enumerate(PROBES)]
