"""The 42 dialect rules.

Each rule is an ordered list of arms (predicate, votes); the first arm that holds decides
and no arm means no vote. Predicates are SQL over the columns of a parse: form, lemma,
pos, case, number, gender, tense, mood, voice, person, stem_class, and the marks-free
`clean` and `clean_lemma`. A missing property is NULL, so an arm that needs it does not
hold. Votes read `yes>no` with the initials of the dialects.

The words, endings and votes are fixed values of the analysis.
"""

from __future__ import annotations

import re

# Stem classes a lemma may have.
ADJ_3, ADJ_2 = "type_1_2_os/a/on_adjective", "type_2nd_decl_adjective"
ADJ_US, ADJ_EIS = "type_us_eia_u_adjective", "type_eis_essa_en_adjective"
LONG_H, SHORT_A = "alpha_stem_-h", "alpha_stem_short_-a"
LONG_A, EIR_SHORT_A = "alpha_stem_eir_-a", "alpha_stem_eir_short_-a"
DIGAMMA, IOTA, OMICRON, SIGMA = "digamma_stem", "iota_stem", "omicron_stem", "sigma_stem"
NO_CLASS = "no_special_type"


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def lemma(*names: str) -> str:
    return _one_of("lemma", names)


def form(*forms: str) -> str:
    return _one_of("form", forms)


def starts(*prefixes: str, of: str = "clean") -> str:
    return "(" + " OR ".join(f"left({of}, {len(p)}) = '{p}'" for p in prefixes) + ")"


def ends(*suffixes: str, of: str = "clean") -> str:
    return "(" + " OR ".join(f"right({of}, {len(s)}) = '{s}'" for s in suffixes) + ")"


def has(**props: str) -> str:
    """case='nom|voc' and so on; `*` only asks for the property to be there."""
    tests = []
    for name, value in props.items():
        column = "`case`" if name == "case" else name
        tests.append(f"{column} IS NOT NULL" if value == "*" else _one_of(column, value.split("|")))
    return " AND ".join(tests)


def under(gate: str, *arms: tuple[str, str]) -> list[tuple[str, str]]:
    """Arms that share a condition. An arm without a test always holds."""
    return [(f"({gate})" + (f" AND {test}" if test else ""), votes) for test, votes in arms]


def pair(yes_test: str, no_test: str, yes: str = "I>A", no: str = "A>I") -> tuple:
    return (yes_test, yes), (no_test, no)


def words(ionic: dict, column=starts) -> list[tuple[str, str]]:
    """lemma -> (Ionic start, Aeolic start)."""
    return [arm for name, (i, a) in ionic.items() for arm in under(lemma(name), *pair(column(i), column(a)))]


MI_VERB = "right(clean_lemma, 2) = 'mi'"
A_CONTRACT = "(right(clean_lemma, 2) = 'aw' OR right(clean_lemma, 5) = 'aomai')"
MIDDLE = has(voice="mp|mid|pass")
LONG_A_PARTICIPLE = f"({has(pos='part', voice='mp|mid')})"
SHORT_A_PARTICIPLE = (f"({has(pos='part', tense='*')} AND (voice = 'act' OR "
                      f"({has(voice='pass', tense='aor')})))")
ARTICLE = lemma("o(/s", "o(")


def vowel_at(k: int) -> str:
    return f"length(clean) >= {k} AND left(right(clean, {k}), 1) IN ('a', 'e', 'i', 'o', 'u', 'w', 'h')"


def _classes(*names: str) -> str:
    return _one_of("stem_class", names)


def _pronoun(name: str, case: str, ionic: tuple, aeolic: tuple) -> list:
    return under(f"{lemma(name)} AND {has(pos='pron', number='pl', case=case)}", *pair(form(*ionic), form(*aeolic)))


def _present(person: str, number: str) -> str:
    return has(person=person, number=number, tense="pres", mood="ind", voice="act")


def _contract(gate: str, *endings: str) -> list:
    return [arm for e in endings for arm in under(gate, *pair(ends("a" + e), ends("h" + e)))]


def _a_stem(case: str, ionic: tuple, aeolic: tuple = ()) -> list:
    arms = [(f"`case` IN ({', '.join(repr(c) for c in case.split('|'))}) AND {ends(*ionic)}", "I>A")]
    if aeolic:
        arms.append((f"`case` IN ({', '.join(repr(c) for c in case.split('|'))}) AND {ends(*aeolic)}", "A>I"))
    return arms


def _number_case(number: str, case: str, *arms: tuple) -> list:
    return under(has(number=number, case=case), *[(ends(*suffixes.split("|")), votes) for suffixes, votes in arms])


def _within(gate: str, arms: list) -> list:
    return under(gate, *arms)


RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # ---- single words -------------------------------------------------------------------
    "SW.1": ("a(=s = e(/ws", under(lemma("e(/ws"), *pair(form("e(/ws"), form("a(=s", "a(/s")))),
    "SW.2": ("-aos vs -ews", [
        *under(lemma("lao/s"), *pair(starts("le", of="form"), starts("la", of="form"))),
        *under(lemma("nao/s"), *pair(starts("ne", of="form"), starts("na", of="form"))),
        *under(lemma("i)/laos"), *pair(starts("ile"), starts("ila")))]),
    "SW.3": ("S/SS/TT variants", [
        *under(lemma("o(/sos"), (starts("oss", "ott"), "A>I"), ("", "I>A")),
        *under(lemma("o(po/sos"), (starts("oposs", "opott"), "A>I"), ("", "I>A")),
        *under(lemma("me/sos"), (starts("mess", "mett"), "A>I"), ("", "I>A"))]),
    "SW.4": ("Forms of the plural personal pronoun", [
        *_pronoun("e)gw/", "nom", ("h(mei=s",), ("a)/mmes",)),
        *_pronoun("e)gw/", "dat", ("h(mi=n",), ("a)/mmin", "a)/mmi")),
        *_pronoun("e)gw/", "acc", ("h(me/as", "h(ma=s"), ("a)/mme",)),
        *_pronoun("su/", "nom", ("u(mei=s",), ("u)/mmes",)),
        *_pronoun("su/", "dat", ("u(mi=n",), ("u)/mmin", "u)/mmi")),
        *_pronoun("su/", "acc", ("u(me/as", "u(ma=s"), ("u)/mme",))]),
    "SW.5": ("The conjunction ei)", [
        *under(lemma("ei)"), *pair(form("ei)"), form("ai)"))),
        *under(lemma("ei)/qe"), *pair(form("ei)/qe"), form("ai)/qe"))),
        (lemma("ai)/qe"), "A>I")]),
    "SW.6": ("The particle e)a_/n", under(lemma("e)a/n"), (form("h)/n"), "I>A"))),
    "SW.7": ("The particle a)/n", under(lemma("a)/n"), *pair(form("a)/n"), form("ka", "ke")))),
    "SW.8": ("a(/teros = e(/teros", [(lemma("a(/teros"), "A>I"), (lemma("e(/teros"), "I>A")]),
    "SW.9": ("de/komai = de/xomai", [
        *under(f"{lemma('de/xomai')} AND {has(tense='imperf')} AND left(form, 2) = 'e)'",
               *pair("substr(clean, 2, 3) = 'dex'", "substr(clean, 2, 3) = 'dek'")),
        *under(f"{lemma('de/xomai')} AND ({has(tense='pres')} OR ({has(tense='imperf')} AND left(form, 2) <> 'e)'))",
               *pair(starts("dex"), starts("dek")))]),
    "SW.10": ("o)/numa = o)/noma", words({"o)/noma": ("ono", "onu")})),
    "SW.11": ("Forms of e)/nika", under(
        f"{lemma('fe/rw')} AND mood NOT IN ('inf', 'imperat') AND {has(tense='aor')}",
        ("substr(clean, 2, 3) = 'nei'", "I>A"))),
    "SW.12a": ("Adverbs ending in -ou", [
        (lemma("pou=", "o(/pou", "au)tou=", "o(mou=", "a(mou=", "dh/pou"), "I>A")]),
    "SW.12b": ("Adverbs ending in -ei", [
        (lemma("pei=2", "toutei/", "thnei=", "au)tei="), "A>I"), (lemma("tau/th|", "au)tou="), "I>A"),
        *under(lemma("e)kei="), (form("thnei="), "A>I"), ("", "I>A"))]),
    "SW.12c": ("Adverbs ending in -qen", [
        (lemma("e)/nqen", "e)/swqen", "o(/qen", "o(po/qen", "po/qen"), "I>A"),
        *under(lemma("pro/sqen"), *pair(form("pro/sqen"), form("pro/sqa")))]),
    "SW.12d": ("Adverbs ending in -ka vs -te", [
        (lemma("o(/te", "o(/te2", "tote/", "tote/2", "o(po/te"), "I>A"),
        *under(lemma("to/te"), *pair(form("to/te"), form("to/ka"))),
        *under(lemma("pote/", "pote/2", "po/te"), *pair("clean = 'pote'", "clean = 'poka'"))]),
    "SW.13": ("Ionic -ei- for attic -e-", [
        *words({"ce/nos": ("cei", "cen"), "e)/natos": ("ei", "en"), "e(/neka": ("ei", "en"), "mo/nos": ("mou", "mon"),
                "ko/rh": ("kou", "kor"), "o(/ros": ("ou", "or"), "deirh/": ("dei", "der"), "ou)do/s": ("ou", "od")}),
        (lemma("o(/los"), "A>I"), (lemma("ou)=los"), "I>A"),
        *under(f"{lemma('i)/sos')} AND {has(number='sg', case='nom|acc')}",
               *pair(starts("i)=", of="form"), starts("i)/", of="form")))]),
    "SW.14": ("dei/lomai = bou/lomai", under(lemma("bou/lomai"), (starts("bol"), "IH>A"))),
    "SW.15": ("i(aro/s = i(ero/s", under(lemma("i(ero/s"), (starts("ie", "ir"), "I>A"), (starts("ia"), "A>"))),
    "SW.16": ("Forms of ekei=nos", words({"e)kei=nos": ("ke", "kh")})),
    "SW.17": ("Forms of koinos", [
        *under(lemma("su/n"), (starts("c", of="form"), "H>IA"), ("", "IA>H")),
        (lemma("cuno/s"), "IH>A"), (lemma("koino/s"), "A>IH")]),
    "SW.18": ("Forms of kratero/s", [(lemma("kratero/s"), "H>IA"), (lemma("kartero/s"), "IA>H")]),
    "SW.19": ("Forms of dhmiourgo/s", under(lemma("dhmiourgo/s"), (starts("dhmioe"), "H>IA"),
                                            (starts("dhmior"), "I>HA"))),
    "SW.20": ("Forms of eu)qu/s", words({"eu)qu/s": ("iq", "eu")})),
    "SW.21": ("Forms of mi/a", under(f"{lemma('ei(=s')} AND {has(gender='fem')}",
                                     (starts("m"), "I>AH"), (starts("i"), "AH>I"))),
    "SW.22": ("Homeric forms of gonu, doru, zeus, naus", [
        (f"{lemma(name)} AND {starts(start)}", "H>AI")
        for name, start in (("go/nu", "gou"), ("do/ru", "dou"), ("*zeu/s", "zh"), ("nau=s", "nh"))]),
    "SW.23": ("Homeric forms of polus", under(lemma("polu/s"), (form("pollo/s", "pollo/n"), "H>AI"),
                                              (starts("pole"), "H>AI"))),
    "SW.24": ("Homeric ptolis", under(lemma("po/lis"), (starts("pt"), "H>AI"))),
    # ---- noun endings -------------------------------------------------------------------
    "NE.1a": ("Endings of singular feminine long alpha-stems", _within(
        f"({ARTICLE} OR (pos = 'noun' AND {_classes(LONG_H, LONG_A)}) OR (pos = 'adj' AND {_classes(ADJ_3)}) OR "
        f"{LONG_A_PARTICIPLE} OR (pos <> 'noun' AND {lemma('polu/s')})) AND {has(gender='fem', number='sg')}",
        [*_a_stem("nom|voc", ("h",), ("a",)), *_a_stem("gen", ("hs",), ("as",)),
         *_a_stem("dat", ("hi", "h"), ("ai", "a")), *_a_stem("acc", ("hn",), ("an",))])),
    "NE.1b": ("Endings of singular feminine short alpha-stems", _within(
        f"((pos = 'noun' AND {_classes(SHORT_A, EIR_SHORT_A)}) OR {SHORT_A_PARTICIPLE} OR "
        f"(pos = 'adj' AND {_classes(ADJ_US, ADJ_EIS)})) AND {has(gender='fem', number='sg')}",
        [*_a_stem("nom", ("h",)), *_a_stem("gen", ("hs",), ("as",)),
         *_a_stem("dat", ("hi", "h"), ("a",)), *_a_stem("acc", ("hn",))])),
    "NE.2": ("Singulars of masculine alpha stems", _within(
        f"pos = 'noun' AND {_classes(LONG_H, LONG_A)} AND {has(gender='masc', number='sg')}",
        [*_a_stem("nom", ("hs",), ("as",)),
         (f"{has(case='gen')} AND {ends('w')}", "I>A"), (f"{has(case='gen')} AND {ends('ao')}", "H>AI"),
         (f"{has(case='gen')} AND {ends('a')}", "A>I"),
         *_a_stem("dat", ("hi", "h"), ("ai", "a")), *_a_stem("acc", ("hn",), ("an",))])),
    "NE.3": ("Plurals of alpha stems", under(
        f"((pos = 'noun' AND {_classes(LONG_H, LONG_A, EIR_SHORT_A, SHORT_A)}) OR "
        f"(pos = 'adj' AND {_classes(ADJ_3, ADJ_US, ADJ_EIS)} AND gender = 'fem') OR {lemma('o(/s')} OR "
        f"({has(pos='part', gender='fem')})) AND {has(case='gen', number='pl')}",
        (ends("a/wn", of="form"), "AH>I"), (f"({ends('w=n', of='form')} OR {ends('wn')})", "I>AH"),
        (f"({ends('a=n', of='form')} OR {ends('an')})", "AH>I"))),
    "NE.4": ("Forms of digammma stems", _within(f"pos = 'noun' AND {_classes(DIGAMMA)}", [
        *_number_case("sg", "gen", ("eos", "I>AH"), ("hos", "AH>I")),
        *_number_case("sg", "dat", ("ei", "I>AH"), ("hi", "AH>I")),
        *_number_case("sg", "acc", ("ea", "I>AH"), ("ha", "AH>I")),
        *_number_case("pl", "nom", ("eis", "AI>H"), ("hes", "H>IA")),
        *_number_case("pl", "gen", ("ewn", "AI>H"), ("hwn", "H>IA")),
        *_number_case("pl", "acc", ("eas", "AI>H"), ("has", "H>IA"))])),
    "NE.5": ("forms of iota stems", _within(f"pos = 'noun' AND {_classes(IOTA)}", [
        *_number_case("sg", "gen", ("ews", "I>AH"), ("ios", "AH>"), ("hos", "H>")),
        *_number_case("sg", "dat", ("ei", "I>A"), ("i", "A>")),
        *_number_case("pl", "nom|voc", ("eis", "I>AH"), ("ies", "AH>"), ("hes", "H>AI")),
        *_number_case("pl", "gen", ("ewn", "I>A"), ("iwn", "AH>")),
        *_number_case("pl", "dat", ("isi|iesi", "A>"), ("esi|esin", "I>A"), ("iessi|iessin", "H>IA")),
        *_number_case("pl", "acc", ("eis", "I>AH"), ("is|ias", "AH>"), ("has", "H>AI"))])),
    "NE.6": ("Dative plural in -essi", _number_case("pl", "dat", ("essi|essin", "AH>I"))),
    "NE.7": ("Homeric second declension endings", _within(
        f"((pos = 'noun' AND {_classes(OMICRON)}) OR (pos = 'adj' AND {_classes(ADJ_3, ADJ_2)}) OR pos = 'part' OR "
        f"{ARTICLE})", [
            *_number_case("sg", "gen", ("oio|oo", "H>AI"), ("ou", "AI>H")),
            *_number_case("dual", "gen|dat", ("oiin", "H>AI"), ("", "AI>H")),
            *_number_case("pl", "dat", ("oisi|oisin", "H>AI"), ("ois", "AI>H"))])),
    # ---- verb endings -------------------------------------------------------------------
    "VE.1": ("Ionic mi-verbs inflected like contracts", [
        arm for name, gate, ionic, aeolic in (
            ("di/dwmi", _present("2nd", "sg"), ("didoi=s", "didoi=sqa"), ("di/dws",)),
            ("di/dwmi", _present("3rd", "sg"), ("didoi=",), ("di/dwsi", "di/dwsin")),
            ("di/dwmi", _present("3rd", "pl"), ("didou=si", "didou=sin"), ("dido/asi", "dido/asin")),
            ("ti/qhmi", _present("3rd", "sg"), ("tiqei=",), ("ti/qhsi", "ti/qhsin")),
            ("ti/qhmi", _present("3rd", "pl"), ("tiqei=si", "tiqei=sin"), ("tiqe/asi", "tiqe/asin")),
            ("i(/hmi", _present("3rd", "pl"), ("i(ei=si",), ("i(a=si",)))
        for arm in under(f"{lemma(name)} AND {gate}", *pair(form(*ionic), form(*aeolic), "HI>A", "A>HI"))]),
    "VE.2": ("Third person middle forms", _within(
        f"{has(number='pl', person='3rd', mood='*', tense='*')} AND {MIDDLE} AND (tense IN ('perf', 'plup') OR "
        f"mood = 'opt' OR ({MI_VERB} AND tense IN ('pres', 'imperf')))", [
            *under(vowel_at(5), *pair(ends("atai"), ends("ntai"))),
            *under(vowel_at(4), *pair(ends("ato"), ends("nto")))])),
    "VE.3": ("Alpha contract endings", _within(f"pos = 'verb' AND {A_CONTRACT}", [
        *_contract(has(tense="pres", mood="ind|subj", voice="act", number="sg", person="2nd"), "s"),
        *_contract(has(tense="pres", mood="ind|subj", voice="act", number="sg", person="3rd"), ""),
        *_contract(has(tense="pres", mood="ind|subj", voice="act", number="pl", person="2nd"), "te"),
        *_contract(has(tense="pres", mood="ind|subj", voice="mp", number="sg", person="2nd"), ""),
        *_contract(has(tense="pres", mood="ind|subj", voice="mp", number="sg", person="3rd"), "tai"),
        *_contract(has(tense="pres", mood="ind|subj", voice="mp", number="pl", person="2nd"), "sqe"),
        *_contract(has(tense="imperf", mood="ind", voice="act", number="sg", person="2nd"), "s"),
        *_contract(has(tense="imperf", mood="ind", voice="act", number="sg", person="3rd"), ""),
        *_contract(has(tense="imperf", mood="ind", voice="act", number="pl", person="2nd"), "te"),
        *_contract(has(tense="imperf", mood="ind", voice="mp", number="sg", person="3rd"), "to"),
        *_contract(has(tense="imperf", mood="ind", voice="mp", number="pl", person="2nd"), "sqe"),
        *_contract(has(tense="pres", mood="inf", voice="act"), "n"),
        *_contract(has(tense="pres", mood="inf", voice="mp"), "sqai")])),
    "VE.4": ("Athematic 3rd plural secondary ending", under(
        f"pos = 'verb' AND {MI_VERB} AND lemma <> 'ei)mi/' AND right(clean_lemma, 4) <> 'eimi' AND "
        f"mood NOT IN ('inf', 'imperat') AND {has(number='pl', person='3rd', tense='imperf|aor')}",
        (ends("san"), "I>AH"), ("right(clean, 5) <> 'ousin' AND right(clean, 1) = 'n'", "AH>I"))),
    "VE.5": ("Active infinitive endings (-men vs -nai vs -menai)", under(
        f"pos = 'verb' AND {MI_VERB} AND {has(mood='inf', voice='*')}",
        (ends("menai"), "AH>I"), (ends("nai"), "I>AH"), (ends("men"), "A>IH"))),
    "VE.6": ("Homeric verb endings", [(f"pos = 'verb' AND mood IS NOT NULL AND tense IS NOT NULL AND {gate} AND {test}", "H>IA")
                                      for gate, test in (
        (has(number="sg", person="1st", mood="subj", voice="act"), ends("mi")),
        (f"{has(number='sg', person='2nd', voice='act')} AND NOT ({MI_VERB} OR {lemma('oi)=da')})", ends("sqa")),
        (has(number="sg", person="3rd", mood="subj", voice="act"), ends("si", "sin")),
        (has(tense="aor", number="pl", person="3rd", voice="pass", mood="ind"), ends("en")),
        (has(tense="plup", number="sg", person="1st", mood="ind", voice="act"), ends("ea")),
        (has(tense="plup", number="sg", person="3rd", mood="ind", voice="act"), ends("een", "ein", "ee", "ei")),
        (f"{has(number='pl', person='1st')} AND {MIDDLE}", ends("mesqa")))]),
    # ---- movable n ----------------------------------------------------------------------
    "NM.1": ("Nu Movable (simple)", [
        (f"{has(pos='noun|adj|part', case='dat', number='pl')} AND {ends('sin')}", "IH>"),
        *under("pos = 'verb' AND mood NOT IN ('inf', 'imperat')",
               (f"{has(person='3rd', number='sg')} AND {ends('en')}", "IH>A"),
               (f"{has(person='3rd', number='pl')} AND {ends('sin')}", "IH>A"))]),
}
RULE_NAMES = tuple(RULES)


def lemmas_of(rule: str) -> set[str] | None:
    """The lemmas that a rule is about: every arm begins by asking for one of a list. None if some arm does not."""
    out: set[str] = set()
    for test, _ in RULES[rule][1]:
        listed = re.match(r"\(*lemma IN \(((?:'[^']*'(?:, )?)+)\)(?=\)| AND |$)", test)
        if not listed or " OR " in re.sub(r"\((?:[^()]|'[^']*'|\([^()]*\))*\)", "", test[listed.end():]):
            return None
        out.update(re.findall(r"'([^']*)'", listed.group(1)))
    return out


def case_expression(rule: str, code_of, quote: str = "`") -> str:
    """A rule as one SQL CASE that gives the combination code."""
    arms = " ".join(f"WHEN {test} THEN {code_of(votes)}" for test, votes in RULES[rule][1])
    return f"CASE {arms} ELSE 13 END".replace("`", quote)
