"""Joins to forms, lemmas and the dictionary (X-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stichos.functions import phonemes as ph, text as tx
from stichos.functions.text import _col, let
from stichos.operators.tokens import join_types
from stichos.rules import endings, probes
from stichos.rules.table import NO_CLASS


# ---- lookups (X-1 ... X-3) ------------------------------------------------------------------

def lookup_parses(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """X-1: tokens with their parses; a token without any is one row with valid = false."""
    joined = join_types(tokens, forms, ["token"])
    return joined.withColumn("valid", F.col("parse_no").isNotNull())


def forms_in_vocabulary(forms: DataFrame, vocab: DataFrame) -> DataFrame:
    """X-2: parses of tokens that occur."""
    return forms.join(vocab.select("token").distinct(), "token", "left_semi")


def lemma_pos(forms: DataFrame) -> DataFrame:
    """X-3: parts of speech per lemma (there are about a dozen in all, so the set is small)."""
    return forms.groupBy("lemma").agg(F.array_sort(F.collect_set("pos")).alias("pos_set"))


# ---- stem classes (X-4) -----------------------------------------------------------------------

def short_alpha_by_accent(lemma) -> Column:
    """X-4a: circumflex on the last vowel but one, or acute on the last but two."""
    vowels = F.translate(tx.decapitalize(lemma), "bcdfgjklmnpqrstvxyz", "")
    parts = F.regexp_extract_all(ph.split_diaeresis(vowels), F.lit(rf"(?:{ph.DIPHTHONG}|[a-z])[^a-z.]*"), 0)
    return let(parts, lambda v: F.coalesce(F.contains(F.try_element_at(v, F.lit(-2)), F.lit("=")), F.lit(False))
               | F.coalesce(F.contains(F.try_element_at(v, F.lit(-3)), F.lit("/")), F.lit(False)))


def accent_forward(stem) -> Column:
    """X-4b: an acute moves to the last vowel; a circumflex turns into an acute."""
    s = _col(stem)
    moved = F.regexp_replace(F.translate(s, "/", ""), r"^(.*[aeiouwh])([^aeiouwh]*)", "$1/$2")
    return F.when(F.contains(s, F.lit("/")), moved).otherwise(F.translate(s, "=", "/"))


def stem_classes(forms: DataFrame) -> DataFrame:
    """X-4: class per lemma by probe forms.

    Every lemma makes at most four probe rows; one join with the form table keeps the
    probes that exist, and the first of them names the class.
    """
    lem = lemma_pos(forms)
    lem = (lem.withColumn("low", tx.decapitalize("lemma")).withColumn("plain", tx.strip_digits("low"))
           .withColumn("clean", tx.strip_diacritics(tx.strip_digits("lemma"))).withColumn("bare", tx.strip_digits("lemma")))
    block = F.coalesce(*[F.when(F.expr(test), F.lit(no)) for no, test in probes.BLOCKS])
    lem = lem.withColumn("block", block).filter("block IS NOT NULL")

    def make(p):
        no, blk, needs, cut, accent, ending, case, number, gender, cls = p
        base = F.col("low") if blk == 6 else F.col("plain")
        stem = F.substr(base, F.lit(1), F.length(base) - cut)
        if accent == "moves":
            stem = accent_forward(stem)
        elif accent == "drops":
            stem = F.translate(stem, "*/", "")
        form = F.concat(stem, F.lit(ending))
        fits = (F.col("block") == blk) & (F.right("bare", F.lit(len(needs))) == needs if needs else F.lit(True))
        return F.when(fits, F.struct(F.lit(no).alias("no"), form.alias("token"), F.lit(case).alias("want_case"),
                                     F.lit(number).alias("want_number"), F.lit(gender).cast("string").alias("want_gender"),
                                     F.lit(cls).alias("class")))

    cells = F.filter(F.array(*[make(p) for p in probes.probes()]), lambda c: c.isNotNull())
    tries = lem.select("lemma", short_alpha_by_accent("lemma").alias("short_alpha"), F.inline_outer(cells)).filter("token IS NOT NULL")
    known = forms.select("token", "lemma", F.col("case").alias("want_case"), F.col("number").alias("want_number"),
                         F.col("gender").alias("_gender"))
    hits = tries.join(known, ["token", "lemma", "want_case", "want_number"]).filter(
        F.col("want_gender").isNull() | (F.col("want_gender") == F.col("_gender")))
    found = hits.groupBy("lemma").agg(F.min_by("class", "no").alias("_class"), F.first("short_alpha").alias("_short"))
    named = F.when(F.col("_class") == "eir", F.when(F.col("_short"), probes.EIR[True]).otherwise(probes.EIR[False])) \
        .otherwise(F.col("_class"))
    return (forms.select("lemma").distinct().join(found, "lemma", "left")
            .select("lemma", F.coalesce(named, F.lit(NO_CLASS)).alias("stem_class")))


# ---- clitics (X-5 ... X-8) ----------------------------------------------------------------------

# Words that lean on a neighbour.
ENCLITIC_LEMMAS = r"""^((tis)|(pou/(2)?)|(poqi)|(ph)|(poi)|(poqen)|(pote/(2)?)|(pw(2)?)|(pws)|(ge)|(te)|(toi(2)?)|(pe/r)|(qh/n))$"""
ENCLITIC_FORMS = r"""^((mou(=)?)|(moi/(/)?)|(me(/)?)|(sou(=)?)|(soi(/)?)|(se(/)?)|(e\((/)?)|(sfi(/)?si)|(meu(=)?)|(se/?o)|(seu=?)|(toi/?)|(te/)|(tu/)|(e\(/o)|(mi/?n)|(ni/?n)|(sfi/?)|(sfi/?n)|(sfwe/?)|(sfwi/?n)|(sfe/as)|(sfe/?a)|(nu/?n?)|(ke/?)|(ke/?n))$"""
ENCLITIC_OF_LEMMA = {"e(/": "ou(= oi(= e(/o e(o eu(= eu( e(/qen e(qen".split(),
                     "sfei=s": "sfe/ sfe sfe/wn sfewn sfa/s sfa=s sfas".split()}
PROCLITIC_LEMMAS = r"""^((ei\)s)|(e\)k)|(e\)c)|(ei\))|(ei\)2)|(w\(s)|(ou\)([\d]+)?))$"""


def is_enclitic_parse() -> Column:
    """X-5 over the columns of a parse."""
    lemma, form = F.col("lemma"), F.col("form")
    present = (F.col("tense") == "pres") & (F.col("mood") == "ind")
    tests = [lemma.rlike(ENCLITIC_LEMMAS), form.rlike(ENCLITIC_FORMS),
             *[(lemma == k) & form.isin(*v) for k, v in ENCLITIC_OF_LEMMA.items()],
             (F.substr(lemma, F.lit(1), F.length(lemma) - 1) == "a)/ra") & form.isin("r(a/", "r(a"),
             (lemma == "ei)mi/") & present & (F.left(form, F.lit(3)) != "ei)"),
             (lemma == "phmi/") & present & ~form.isin("ph/|s", "ph=|s")]
    return F.coalesce(_any(tests), F.lit(False))


def is_proclitic_parse() -> Column:
    """X-6 over the columns of a parse."""
    lemma, form = F.col("lemma"), F.col("form")
    article = (lemma == "o(") & (F.left(form, F.lit(1)).isin("o", "h") | (F.left(form, F.lit(2)) == "ai"))
    return F.coalesce(_any([article, lemma.rlike(PROCLITIC_LEMMAS)]), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out | F.coalesce(t, F.lit(False))
    return out


# Words with a cluster of their own (S-4).
SHORT_Z_LEMMAS = ("*za/kunqos", "*ze/leia")
SINGLE_SK_LEMMAS = ("ske/parnon", "*skama/ndrios", "*ska/mandros")


def token_facts(forms: DataFrame) -> DataFrame:
    """X-7, X-8: per token with parses: clitic only if all parses are, and the words whose
    first z may be single (S-4) or whose sk is one consonant."""
    return forms.groupBy("token").agg(
        F.bool_and(is_enclitic_parse()).alias("enclitic"), F.bool_and(is_proclitic_parse()).alias("proclitic"),
        F.when(F.min("lemma") == F.max("lemma"), F.max("lemma")).alias("only_lemma"))


def special_clusters(sound, only_lemma) -> Column:
    """S-4."""
    s, lem = _col(sound), _col(only_lemma)
    return (F.when(lem.isin(*SHORT_Z_LEMMAS), F.regexp_replace(s, r"^\.?z", "z^"))
            .when(lem.isin(*SINGLE_SK_LEMMAS), F.regexp_replace(s, r"^\.?s\.?k", "s~")).otherwise(s))


def student_tokens(forms: DataFrame) -> DataFrame:
    """Token table for S-3, letters only."""
    return token_facts(forms).select("token", special_clusters("token", "only_lemma").alias("sound"),
                                     "enclitic", "proclitic")


# ---- vowel lengths (X-18 ... X-23) ---------------------------------------------------------------

PLAIN_SLOT = "*"


def stem_slot() -> Column:
    """X-18: which stem of its entry a parse uses; NULL if there is none.

    Columns: the parse, and entry_pos of the dictionary entry.
    """
    pos = F.when(F.col("entry_pos") == "??", F.col("pos")).otherwise(F.col("entry_pos"))
    no_tense = F.when(F.col("lemma").isin("fhmi/", "e)/dw") | (F.col("form") == "e)pi/staito"), "pres")
    tense = F.coalesce("tense", no_tense)
    voice = F.coalesce("voice", F.lit("act"))
    augmented = tense.isin("imperf", "aor", "plup")
    folded = (F.when(augmented & (tense == "aor") & (voice == "mp"), "mid")
              .when(augmented & (tense != "aor") & voice.isin("mid", "pass"), "mp")
              .when((tense == "fut") & (voice == "mp"), "mid")
              .when(tense.isin("pres", "perf") & voice.isin("mid", "pass"), "mp").otherwise(voice))
    bare = (F.coalesce(F.col("feature") == "unaugmented", F.lit(False)) | (F.col("pos") == "part"))
    verb = (F.when(tense == "futperf", tense)
            .when(augmented, F.concat_ws(".", tense, folded, F.when(bare, "n").otherwise("y")))
            .when(tense.isNotNull(), F.concat_ws(".", tense, folded)))
    nominative = (F.col("case") == "nom") & F.col("gender").isin("masc", "neut")
    adj = (F.when((F.col("pos") == "adv") | F.col("gender").isNull(), "neutNom")
           .when(F.coalesce(nominative, F.lit(False)), F.concat("gender", F.lit("Nom"))).otherwise(F.col("gender")))
    return F.when(pos == "verb", verb).when(pos == "noun", "rest").when(pos == "adj", adj).otherwise(PLAIN_SLOT)


def stem_lists(entries: DataFrame, stems: DataFrame) -> DataFrame:
    """One row per entry with all its stems as an array (an entry has a few dozen at most), so that parses meet both in one join.

    entries: lemma, entry_pos, ending_type. stems: lemma, slot, variant_no, stem,
    stem_lengths; an entry with one stem for everything uses the slot `*`.
    """
    listed = stems.groupBy("lemma").agg(F.collect_list(F.struct("slot", "variant_no", "stem", "stem_lengths")).alias("_stems"))
    return entries.join(listed, "lemma", "left")


def stems_of_parses(forms: DataFrame, entries: DataFrame, stems: DataFrame) -> DataFrame:
    """X-18: candidates per parse, one row per stem variant of its slot; a parse without any keeps one row without stem."""
    keyed = forms.join(stem_lists(entries, stems), "lemma", "left").withColumn("_slot", stem_slot())
    wanted = F.filter("_stems", lambda x: x["slot"].eqNullSafe(F.col("_slot")) | (x["slot"] == PLAIN_SLOT))
    return keyed.select(*keyed.columns, F.inline_outer(wanted)).drop("_slot", "_stems")


def split_ending(candidates: DataFrame) -> DataFrame:
    """The ending a stem leaves of a token; NULL if the stem does not fit.

    Vowels split by an accent get a diaeresis mark, so that they stay two sounds.
    """
    token, stem = F.col("token"), F.col("stem")
    plain = F.translate(token, "=/", "")
    check = F.translate(stem, "v", "")
    tail = F.substr(plain, F.length(check) + 1)
    # where the token begins with the stem letter by letter, its accents show the split vowels
    kept = F.when(F.contains(token, check), F.concat(
        F.substr(token, F.lit(1), F.instr(token, check) - 1), F.substr(token, F.instr(token, check) + F.length(check))))
    kept = F.translate(F.regexp_replace(F.coalesce(kept, token), r"([aoehw])[/=+]([iu])", "$1$2+"), "=/", "")
    ending = F.when(plain.startswith(check), F.when(token.startswith(stem), kept).otherwise(tail))
    return candidates.withColumn("ending", F.when(~F.startswith(ending, F.lit("+")), ending))


def ending_lengths(candidates: DataFrame) -> DataFrame:
    """X-19, X-21: lengths of the ending, by its own letters, else by list, else by default. Narrow: the lists are
    a broadcast table of fixed size, one row per ending type with its class's rows as an array."""
    tests = F.array(*[F.coalesce(F.expr(c), F.lit(False)) for c in endings.conditions()])
    df = candidates.join(F.broadcast(endings.by_type(candidates.sparkSession)), "ending_type", "left").withColumn("_tests", tests)
    look = F.when(F.col("ending_class") == "oida", F.translate("ending", ")", "")).otherwise(F.col("ending"))
    df = df.withColumn("_look", F.when(~ph.only_known_vowels("ending"), look))

    def hit(row):
        same = F.when(row["is_prefix"], F.startswith(F.col("_look"), row["ending"])).otherwise(F.col("_look") == row["ending"])
        return same & ((row["condition"] < 0) | F.get(F.col("_tests"), row["condition"]))

    df = df.withColumn("_listed", F.when(F.col("_look").isNotNull(), F.get(F.filter("listed", hit), F.lit(0))["lengths"]))
    oida = F.col("ending_type").eqNullSafe(F.lit(endings.OIDA))
    digamma = oida & (F.col("_listed").isNotNull() | ph.only_known_vowels("ending"))
    shown = F.when(F.col("_listed").isNotNull() & oida, F.translate("ending", ")", "")).otherwise(F.col("ending"))
    return (df.withColumn("ending_lengths", F.coalesce("_listed", ph.default_lengths("ending")))
            .withColumn("new_ending", F.when(digamma, F.concat(F.lit("v"), shown)).otherwise(shown))
            .drop("_look", "_tests", "_listed", "listed", "ending_class"))


def parse_lengths(forms: DataFrame, entries: DataFrame, stems: DataFrame) -> DataFrame:
    """X-22: lengths and spelling per parse: the first stem variant whose count of vowels is
    right, else the defaults of the token. One join by lemma and one grouping by parse; every parse stays in the flow."""
    cand = ending_lengths(split_ending(stems_of_parses(forms, entries, stems)))
    whole = F.concat("stem_lengths", "ending_lengths")
    joint = F.when(F.col("new_ending").rlike(r"^$|^['()+]"), F.concat("stem", "new_ending")) \
        .otherwise(F.concat_ws(".", "stem", "new_ending"))
    fits = F.col("ending").isNotNull() & (F.length(whole) == F.length(ph.default_lengths("token")))
    best = cand.groupBy("token", "parse_no").agg(
        F.min_by(F.struct(whole.alias("lengths"), joint.alias("spelling")), F.when(fits, F.col("variant_no"))).alias("_b"))
    return best.select("token", "parse_no", F.coalesce("_b.lengths", ph.default_lengths("token")).alias("lengths"),
                       F.coalesce("_b.spelling", F.col("token")).alias("spelling"))


def unify_lengths(lengths: DataFrame, by: str = "token") -> DataFrame:
    """X-23: one length per vowel over all parses: what all agree on, else open.

    Lists of different size give up (unified = false). Each vowel is a row (token, place), so words may have any number of them.
    """
    shown = F.length(F.translate("spelling", "/=", ""))
    size = F.length("lengths")
    whole = lengths.groupBy(by).agg(F.min(size).alias("_min"), F.max(size).alias("_max"), F.count("*").alias("n_parses"),
                                    F.min_by("spelling", F.struct(shown, "parse_no")).alias("spelling"))
    vowels = lengths.select(by, F.posexplode(F.split("lengths", "")).alias("_at", "_length")).filter("_length <> ''")
    each = vowels.groupBy(by, "_at").agg(F.min("_length").alias("_low"), F.max("_length").alias("_high"))
    one = F.struct("_at", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("?").alias("_length"))
    joined = each.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    agreed = F.coalesce(F.array_join(F.transform("_all", lambda x: x["_length"]), ""), F.lit(""))
    same = F.col("_min") == F.col("_max")
    return whole.join(joined, by, "left").select(by, same.alias("unified"), F.when(same, agreed).alias("lengths"), "spelling", "n_parses")


def reading_tokens(forms: DataFrame, entries: DataFrame, stems: DataFrame) -> DataFrame:
    """Token table for both readings of S-3: student (letters only) and native (vowel lengths of the dictionary, S-2)."""
    one = unify_lengths(parse_lengths(forms, entries, stems))
    lens = F.when(F.col("unified"), F.col("lengths")).otherwise(ph.default_lengths("token"))
    word = F.when(F.col("unified"), F.col("spelling")).otherwise(F.col("token"))
    tagged = F.regexp_replace(ph.tag_lengths(word, lens), r"^\.", "")
    return token_facts(forms).join(one, "token").select(
        "token", special_clusters("token", "only_lemma").alias("student"), special_clusters(tagged, "only_lemma").alias("native"),
        "enclitic", "proclitic")


def native_tokens(forms: DataFrame, entries: DataFrame, stems: DataFrame) -> DataFrame:
    """Token table for S-3 with the vowel lengths of the dictionary alone."""
    return reading_tokens(forms, entries, stems).select("token", F.col("native").alias("sound"), "enclitic", "proclitic")
