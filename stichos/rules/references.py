"""Entries that only point to another one (X-12)."""

from __future__ import annotations

# Pattern over the core text, and whether the sense mark is taken out first.
CROSS_REFERENCES = (
    # a word that just names a synonym
    (r"""^[^\s]*( \(.*?\))?:""", False),
    # variants that point to the common form
    (r"""^(((i\.e\. )?[^\s]*(, contr\. [^,\s]*)?, )+(for|Ep\. forms from|(Dor\.|Aeol\.|Lacon\.|Ep\.|Ion\.|Att\.|Boeot\.)( word)? for) ((and )?[^\s]*( \(q\. v\.\))?([\s]*\(prob\. Lacon\.\))?, )*[^\s]*( \(q\. v\.\))?(, esp\. in sense of .*$|\.[\s]*))(((i\.e\. )?[^\s]*, )+(for|Ep\. forms from|(Dor\.|Aeol\.|Lacon\.|Ep\.|Ion\.)( word)? for) ((and )?[^,;]*( \(q\. v\.\))?([\s]*\(prob\. Lacon\.\))?, )*[^\s]*( \(q\. v\.\))?\.[\s]*)*(; cf [^\s]*\.)?$""", False),
    (r"""^((i\.e\. )?[^\s]*( \([A-Z]\))?, )+(=) ([^\s]*( \(q\. v\.\))?(, )?)""", True),
    # see another word
    (r"""^(([^\s]*( \((gen)\. (pl)\.\))?( \[[^\]]*\])?, )+(etc\., )?((Ep\.|Aeol\.|Dor\.|Ion\.|Att\.|Boeot\.|contr\.)( for)? [^\s]*, )?((v\.|=) (sub )?([^\s]*, )*[^\s]*( ([1Il]+))?(, Hsch| [A-Z]\. \d+\.\d+| sub init| &#65288;[^&\s]*&#65289;)?\.[\s]*)+)+$""", True),
    # other readings and spellings
    (r"""^[^\s]*( \((dat|acc|gen)\. (sg|pl)\.\))?, ((freq\. |prob\. )?f\.l\.|v\.l\.|written) for [^\s]*( [^\s]*\.?)?(, aor\. inf\. of [^,\.\s]+)?([A-Z]\.[A-Z0-9]+)?( or [^\s]*)?( \(v\. [^\s]+( [A-Z])?\))?,?((((( [A-Z][a-z]*)? [A-Z][a-z]*\.)? (in|ap\.))? (([A-Z]+[a-z]*[\d]*|[\d]+[a-z]?)\.?){1,4}([a-zA-Z0-9]*: in Gloss\. expld\. by murex|; c\.?f\. [^\s]+( \([A-Z]\))?| [A-Z]|\. s\.v\. [^,\.\s]+|,[\s]+=[\s]+(([A-Z]+[a-z]*[\d]*|[\d]+[a-z]?)\.?){1,4})?)| q\.[\s]*v|( \(q\.[\s]*v\.\)(, (Erot|which is to be preferred))?)|( [A-Z][a-z]*\., [A-Z][a-z]*\. [^,\.\s]+, v\. [^,\.\s]+))?\.$""", True),
    # dialect forms
    (r"""^[^\s]*( \([A-Z]\))?(, [^\s]*)?( \[[a-z\^_]*\])?(, i\.[\s]*e\. [^\s]*)?( or [^,\s]+)?,[\s]*((( (and )?(Ep\.|Dor\.( \(Lacon\.\))?|Aeol[,\.]|poet\.|Ion\.|Att\.|Boeot\.|contr\.|corrupt)(,)?)+[\s]*for|gloss on)[\s]+[^\s]*( \(q\.[\s]*v\.\))?([,:] |\.))""", True),
    (r"""^([^\s]*([\s]+\[[^\]]*\])?,[\s]*)+( (and )?(Ep\.|Dor\.|Aeol\.|poet\.|Ion\.|Att\.|Boeot\.))+ for [^\s]*\.""", True),
    (r"""^[^\s]*, (part\. of|late form for) [^\s]*[\.,]""", True),
    (r"""^[^\s]*, ((Ep\.|Aeol\.|Dor\.|Ion\.) dat\.|pf\.) of [^\s]*(, [A-Z][a-z]*\.\d+\.\d+)?\.""", True),
    # several pointers in a row
    (r"""^([^\s]*, v\.[\s]+[^\s]*( \([A-Z]\))?( \([^\.]*?\))?\.[\s]*)+$""", True),
    # forms of verbs
    (r"""^([^\s]*([\s]+\[[^\]]*\])?,[\s]*)+( es, e,)?(for [^,\.\s]+, )?([\s]*(but [^,\s]*,[\s]*)?( inf\. of the)?([\s]*( and )?(Ep\.|Dor\.|Aeol\.|poet\.|Ion\.|Att\.|Boeot\.))*([\s]+([1-3])(sg|pl)\.)?([\s]*(opt)\.)?([\s]*(aor|fut|impf|pf|plpf)\.([\s]+[1-2])?)?([\s]+(inf|imper)\.)?([\s]+iterative)?([\s]+(Act|Pass|Med)\.)?[\s]+(of|for)[\s]+[^\s]*([\s]+(\(q\.[\s]*v\.\)|q\.[\s]*v|v\.[\s]+[^,\.\s]*|)|, ([A-Z][a-z]*\.?)+\d+ (\(v\.l\. [^,\.\s]+\))?)?[\.:,])+$""", True),
    # forms of nouns
    (r"""^[^\s]*,([\s]*(but [^,\s]*,[\s]*)?([\s]*( and )?(Ep\.|Dor\.|Aeol\.|poet\.|Ion\.|Att\.|Boeot\.))*([\s]+(acc|dat|gen)\.)?([\s]+(neut)\.)?([\s]+(sg|pl)\.)?[\s]+(of|from)[\s]+[^\s]*( \(q\.[\s]*v\.\)| q\.[\s]*v)?([\s]*v\. [^,\.\s]*)?[\.:])+$""", True),
    (r"""^([^\s]+, )+(poet)\. forms, v\. [^\s]+\.$""", True),
    (r"""^[^\s]+, acc\. sg\., dual [^\s]+, pl\. [^\s]+; v\. [^\s]+\.$""", True),
)
