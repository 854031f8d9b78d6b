"""C-* and N-*: sources, shaping, normalisation, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import common as c
from stichos.functions import text as tx
from stichos.operators import tokens as tk
from stichos.plans import pipeline
from stichos.sources import corpus, json_arrays as ja

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("c01_read_lines", f"""WITH {c.SQL_LINES}
SELECT text_name, book, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(line) AS last_line
FROM lines GROUP BY ALL""")
def read_lines(spark, sf):
    """The lines written as JSON arrays and read back in ranges of 64 KB."""
    folder = c.scratch(spark, "lines")
    d = c.doc_lines(spark, sf).select("text", F.col("text_name").alias("poem"), "book", "line")
    ja.write_json_arrays(d, folder)
    back = ja.json_elements(spark, folder, 1 << 16).select(F.from_json("value", corpus.VERSE_LINE).alias("v")).select("v.*")
    return back.groupBy(F.col("poem").alias("text_name"), "book").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.max("line").cast("long").alias("last_line"))


def _manifest(spark, sf):
    """Flags per text, from the data: a text of many documents is divided by book and so on."""
    d = c.documents(spark, sf)
    return d.groupBy("text_name").agg(F.count("*").alias("n_docs"), F.max("book").alias("num_books")).select(
        "text_name", "num_books", (F.col("num_books") % 2 == 0).alias("divide_by_book"),
        (F.col("text_name") == "fr").alias("skip_for_accuracy"), (F.col("text_name") == "es").alias("to_be_combined"))


@query("c02_manifest_filter", f"""WITH {c.SQL_LINES},
m AS (SELECT text_name, text_name = 'fr' AS skip, text_name = 'es' AS part FROM docs GROUP BY text_name)
SELECT text_name, count(*) AS n_lines FROM lines JOIN m USING (text_name) WHERE NOT skip AND NOT part GROUP BY ALL""")
def manifest_filter(spark, sf):
    kept = corpus.counted_texts(c.doc_lines(spark, sf), _manifest(spark, sf))
    return kept.groupBy("text_name").agg(F.count("*").alias("n_lines"))


# documents dealt to the 31 texts of the corpus, and the corpus written out for SQL
def _corpus_lines(spark, sf):
    names = F.array(*[F.lit(r[0]) for r in corpus.MANIFEST])
    return c.doc_lines(spark, sf).withColumn("text_name", F.element_at(names, (F.col("doc_id") % 31 + 1).cast("int")))


_CORPUS = c.SQL_LINES + """,
mf(k, name, author, books, divided, skipped, combined, part) AS (VALUES (0, 'Iliad', 'Homer', 24, true, false, false, false), (1, 'Odyssey', 'Homer', 24, true, false, false, false), (2, 'Hymns', 'Anonymous', 33, false, false, false, false),
(3, 'HymnsLong', 'Anonymous', 5, true, true, false, false), (4, 'HymnsShort', 'Anonymous', 1, false, true, false, false), (5, 'CallimachusHymns', 'Callimachus', 6, false, false, false, false), (6, 'Abduction of Helen', 'Colluthus', 1, false, false, false, false),
(7, 'Shield of Heracles', 'Hesiod', 1, false, false, false, false), (8, 'Theogony', 'Hesiod', 1, false, false, false, false), (9, 'Works and Days', 'Hesiod', 1, false, false, false, false), (10, 'Epitaphius Bios', 'Moschus', 1, false, false, false, true),
(11, 'Eros Drapeta', 'Moschus', 1, false, false, false, true), (12, 'Europa', 'Moschus', 1, false, false, false, true), (13, 'Megara', 'Moschus', 1, false, false, false, true), (14, 'Dionysiaca', 'Nonnus of Panopolis', 48, true, false, false, false),
(15, 'Cynegetica', 'Oppian of Apamea', 4, true, false, false, false), (16, 'Halieutica', 'Oppian', 5, true, false, false, false), (17, 'Fall of Troy', 'Quintus Smyrnaeus', 14, true, false, false, false), (18, 'Idylls_Eidulia', 'Theocritus', 30, false, false, false, true),
(19, 'Idylls_Epigrams', 'Theocritus', 24, false, false, false, true), (20, 'The Taking of Ilios', 'Tryphiodorus', 1, false, false, false, false), (21, 'Argonautica', 'Apollonius Rhodius', 4, true, false, false, false), (22, 'Phaenomena', 'Aratus Solensis', 1, false, false, false, false),
(23, 'Epithalamium Achillis et Deidameiae', 'Bion of Phlossa', 1, false, false, false, true), (24, 'Epitaphius Adonis', 'Bion of Phlossa', 1, false, false, false, true), (25, 'Fragmenta', 'Bion of Phlossa', 1, false, false, false, true),
(26, 'Works of Moschus', 'Moschus', 1, false, false, true, false), (27, 'Idylls', 'Theocritus', 1, false, false, true, false), (28, 'Works of Bion', 'Bion of Phlossa', 1, false, false, true, false), (29, 'Iliad1', 'Homer', 1, false, true, false, false), (30, 'Odyssey1', 'Homer', 1, false, true, false, false)),
sr(whole, source_pos, source) AS (VALUES ('Works of Moschus', 0, 'Epitaphius Bios'), ('Works of Moschus', 1, 'Eros Drapeta'), ('Works of Moschus', 2, 'Europa'), ('Works of Moschus', 3, 'Megara'), ('Idylls', 0, 'Idylls_Eidulia'), ('Idylls', 1, 'Idylls_Epigrams'),
('Works of Bion', 0, 'Epithalamium Achillis et Deidameiae'), ('Works of Bion', 1, 'Epitaphius Adonis'), ('Works of Bion', 2, 'Fragmenta')),
cl0 AS (SELECT doc_id, name, book, line, text FROM lines JOIN mf ON doc_id % 31 = k)"""


@query("c02_corpus_manifest", f"""WITH {_CORPUS} SELECT name AS text_name, author, books AS num_books, divided AS divide_by_book, skipped AS skip_for_accuracy, combined AS is_combined, part AS to_be_combined, count(doc_id) AS n_lines
FROM mf LEFT JOIN cl0 USING (name) GROUP BY ALL""")
def corpus_manifest(spark, sf):
    texts = corpus.manifest(spark).drop("increments", "source_texts")
    n = _corpus_lines(spark, sf).groupBy("text_name").agg(F.count("*").alias("n_lines"))
    return texts.join(n, "text_name", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


@query("c03_c04_whole_corpus", f"""WITH {_CORPUS}, al AS (SELECT name, 0 AS source_pos, book, text FROM cl0 UNION ALL SELECT whole, source_pos, book, text FROM cl0 JOIN sr ON source = name)
SELECT al.name AS text_name, source_pos, NOT skipped AND NOT part AS counted, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM al JOIN mf ON mf.name = al.name WHERE NOT part GROUP BY ALL""")
def whole_corpus(spark, sf):
    every = pipeline.corpus_with_combinations(spark, _corpus_lines(spark, sf))
    counted = corpus.counted_texts(every, corpus.manifest(spark)).select("text_name").distinct().withColumn("counted", F.lit(True))
    per = every.groupBy("text_name", "source_pos").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    return per.join(counted, "text_name", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))


def _combinations(spark, sf):
    texts = c.documents(spark, sf).select("text_name").distinct()
    return texts.filter("text_name IN ('de', 'fr')").select(
        F.concat_ws("+", F.lit("en"), "text_name").alias("text_name"), F.array(F.lit("en"), "text_name").alias("source_texts"))


@query("c03_combine_texts", f"""WITH {c.SQL_LINES},
parts AS (SELECT 'en+' || t AS combined, unnest(['en', t]) AS text_name, unnest([0, 1]) AS source_pos
          FROM (SELECT DISTINCT text_name AS t FROM docs WHERE text_name IN ('de', 'fr'))),
alltexts AS (SELECT text_name, 0 AS source_pos, book, text FROM lines UNION ALL
             SELECT combined, source_pos, book, text FROM lines JOIN parts USING (text_name))
SELECT text_name, source_pos, count(*) AS n_lines, count(DISTINCT book) AS n_books, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM alltexts GROUP BY ALL""")
def combine(spark, sf):
    return corpus.combine_texts(c.doc_lines(spark, sf), _combinations(spark, sf)).groupBy("text_name", "source_pos").agg(
        F.count("*").alias("n_lines"), F.count_distinct("book").alias("n_books"), F.sum(F.length("text")).alias("n_chars"))


@query("c04_skip_parts", f"""WITH {c.SQL_LINES}
SELECT text_name, book, count(*) AS n_lines FROM lines WHERE text_name <> 'es' GROUP BY ALL""")
def skip_parts(spark, sf):
    return corpus.without_parts(c.doc_lines(spark, sf), _manifest(spark, sf)).groupBy("text_name", "book").agg(
        F.count("*").alias("n_lines"))


_MARKUP_SQL = r"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS ls,
  regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages),
pieces AS (SELECT page_id, ls, flatten(list_transform(ps, lambda b: string_split(regexp_replace(b, '(?s)<note.*?/note>', '', 'g'), '<br'))) AS bl FROM p),
shaped AS (SELECT page_id, CASE WHEN len(ls) > 0 AND page_id % 3 <> 0
   THEN list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '(?s)<note.*?/note>', '', 'g'), '(?s)<[^>]*>', '', 'g'))
   ELSE list_filter(list_transform(bl, lambda x: translate(regexp_replace(regexp_replace(x, '(?s)^[^<>]*>', ''), '(?s)<[^>]*>', '', 'g'), '0123456789', '')),
                    lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '') END AS l FROM pieces)
SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 + page_id % 7 AS line FROM shaped"""


@query("c05_c06_markup_lines", _MARKUP_SQL)
def markup(spark, sf):
    # every third page hides its line elements, so that both shapes occur
    p = c.load(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 3 != 0, F.col("html")).otherwise(
        F.regexp_replace("html", "<(/?)li", "<$1xx")))
    out = corpus.lines_of_markup(p, ["page_id"], "html", first_line=F.col("page_id") % 7, line_tag="li", break_tag="br")
    return out.select("page_id", "text", F.col("line").cast("long").alias("line"))


@query("c06_running_line_number", f"""WITH {c.SQL_LINES}
SELECT doc_id, line AS page_line, row_number() OVER (PARTITION BY text_name, book ORDER BY doc_id, line) AS line FROM lines""")
def running_numbers(spark, sf):
    li = c.doc_lines(spark, sf).withColumnRenamed("line", "page_line")
    return corpus.number_lines(li, ["text_name", "book"], ["doc_id", "page_line"]).select(
        "doc_id", F.col("page_line").cast("long").alias("page_line"), "line")


_ED = r"((†|&#8224;).*?(†|&#8224;))|(\[.*?\])|(<.*?>)"


@query("c07_editorial_marks", rf"""WITH l AS (SELECT page_id, unnest(s) AS text, generate_subscripts(s, 1) AS line
 FROM (SELECT page_id, string_split(html, '>') AS s FROM pages))
SELECT page_id, line, regexp_extract(text || '>', '{_ED}', 0) AS passage FROM l WHERE regexp_matches(text || '>', '{_ED}')""")
def editorial(spark, sf):
    p = c.load(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("i", "t"))
    return corpus.editorial_marks(p.select("page_id", (F.col("i") + 1).cast("long").alias("line"), F.concat("t", F.lit(">")).alias("text"))) \
        .select("page_id", "line", "passage")


@query("c08_drop_pentameters", f"""WITH {c.SQL_LINES}
SELECT text_name, book, count(*) AS n_lines FROM lines WHERE NOT (text_name = 'en' AND book = 5 AND line % 2 = 0) GROUP BY ALL""")
def pentameters(spark, sf):
    return corpus.drop_pentameters(c.doc_lines(spark, sf), "en", 5).groupBy("text_name", "book").agg(F.count("*").alias("n_lines"))


@query("c09_form_table", f"""WITH {c.SQL_TOKENS}
SELECT token, CAST(dense_rank() OVER (PARTITION BY token ORDER BY text_name) - 1 AS INTEGER) AS parse_no, text_name AS lemma
FROM (SELECT DISTINCT token, text_name FROM std)""")
def form_table(spark, sf):
    langs = c.tokens(spark, sf).groupBy("token").agg(F.array_sort(F.collect_set("text_name")).alias("l"))
    # an element is [token, [parse, ...]]
    token = F.regexp_replace(F.to_json(F.array("token")), r"\]$", "")
    element = F.concat(token, F.lit(","), F.to_json(F.transform("l", lambda x: F.struct(x.alias("lemma")))), F.lit("]"))
    folder = c.scratch(spark, "forms")
    ja.write_elements(langs.select(element.alias("value")), folder)
    return corpus.read_forms(spark, folder).select("token", "parse_no", "lemma")


@query("c10_overlay",
    """WITH base AS (SELECT o_custkey AS key, 'order' AS origin, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL),
sup AS (SELECT user_id AS key, 'event' AS origin, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL)
SELECT * FROM sup UNION ALL SELECT * FROM base WHERE key NOT IN (SELECT key FROM sup)""")
def overlay(spark, sf):
    base = c.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    sup = c.load(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    return corpus.overlay(base.select("key", F.lit("order").alias("origin"), "n"),
                          sup.select("key", F.lit("event").alias("origin"), "n"), "key")


# ---- N-* ------------------------------------------------------------------------------------

@query("n01_decapitalize", rf"""WITH {c.SQL_LINES},
w AS (SELECT unnest(string_split(text, ' ')) AS raw FROM lines), v AS (SELECT raw, '*' || raw AS star, '*)/' || raw AS marked FROM w)
SELECT raw, {c.sql_decap_token('raw')} AS plain, {c.sql_decap_token('star')} AS starred,
       {c.sql_decap_token('marked')} AS shifted, count(*) AS n FROM v GROUP BY ALL""")
def decap(spark, sf):
    w = c.doc_lines(spark, sf).select(F.explode(F.split("text", " ")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return w.select("raw", tx.decapitalize("raw").alias("plain"), tx.decapitalize(F.concat(F.lit("*"), "raw")).alias("starred"),
                    tx.decapitalize(F.concat(F.lit("*)/"), "raw")).alias("shifted"), "n")


@query("n02_n05_clean_lines", rf"""WITH {c.SQL_LINES}
SELECT doc_id, line, {c.sql_decap_line('text')} AS low, {c.sql_beta('text')} AS beta, {c.sql_squeeze('text')} AS squeezed,
       {c.sql_clean_line(c.sql_decap_line('text'))} AS clean FROM lines""")
def clean_lines(spark, sf):
    return c.doc_lines(spark, sf).select(
        "doc_id", F.col("line").cast("long").alias("line"), tx.decapitalize_line("text").alias("low"), tx.beta_only("text").alias("beta"),
        tx.squeeze("text").alias("squeezed"), tx.clean_verse("text").alias("clean"))


@query("n06_clean_blocks", f"""SELECT doc_id, {c.sql_clean_block('text')} AS clean FROM documents""")
def clean_blocks(spark, sf):
    return c.spread(c.documents(spark, sf)).select("doc_id", tx.clean_block("text").alias("clean"))


_FAULTY = "SELECT DISTINCT '=(' || lower(raw) AS w FROM tk UNION SELECT DISTINCT lower(raw) || '/(' FROM tk UNION SELECT DISTINCT raw FROM tk"


@query("n07_n09_standardize", f"""WITH {c.SQL_LINES},
tk AS (SELECT unnest(string_split({c.sql_clean_line('text')}, ' ')) AS raw FROM lines),
f AS ({_FAULTY}),
{c.sql_standardize_ctes('f', 'w', 'w')}
SELECT w, token, {c.sql_strip('token')} AS letters FROM std""")
def standardize(spark, sf):
    raw = c.doc_lines(spark, sf).select(F.explode(F.split(tx.clean_line("text"), " ")).alias("raw"))
    low = F.lower("raw")
    w = raw.select(F.explode(F.array(F.concat(F.lit("=("), low), F.concat(low, F.lit("/(")), F.col("raw"))).alias("w")).distinct()
    return w.withColumn("token", tx.standardize("w")).withColumn("letters", tx.strip_diacritics("token"))


@query("n10_line_tokens", f"WITH {c.SQL_TOKENS} SELECT doc_id, line, token, count(*) AS n FROM std GROUP BY ALL")
def line_tokens(spark, sf):
    return c.tokens(spark, sf).groupBy("doc_id", F.col("line").cast("long").alias("line"), "token").agg(F.count("*").alias("n"))


@query("n11_block_tokens", f"""WITH {c.SQL_LINES},
tk AS (SELECT * FROM (SELECT text_name, book, unnest(string_split({c.sql_clean_block('text')}, ' ')) AS raw FROM lines) WHERE raw <> ''),
{c.sql_standardize_ctes('tk', 'raw', 'text_name, book')}
SELECT text_name, book, token, count(*) AS n FROM std GROUP BY ALL""")
def block_tokens(spark, sf):
    return tk.vocabulary(tk.tokens_of_blocks(c.doc_lines(spark, sf), ["text_name", "book"]), ["text_name", "book"])


# lines whose first word has a hyphen are cut there, so that it stands at a line's end
_WRAPPED = r"""replace(regexp_replace(regexp_replace(text, '\?|(\d+-(\d+|ff|fin).*?\n)|\d', '', 'g'), '\n\*\S*( *|( +(a|b|\*a|\*b)))\n', chr(10), 'g'), '--', ' --')"""


def wrapped_lines(spark, sf):
    """Pieces of documents with a hyphen put behind every third letter group at a line's end."""
    li = c.doc_lines(spark, sf)
    return li.withColumn("text", F.when(F.col("line") % 3 == 1, F.concat("text", F.lit("-"))).when(F.col("line") % 7 == 2, F.concat("text", F.lit("--  "))).otherwise(F.col("text")))


@query("n11_wrapped_words", f"""WITH {c.SQL_LINES},
wl AS (SELECT doc_id, text_name, book, line, CASE WHEN line % 3 = 1 THEN text || '-' WHEN line % 7 = 2 THEN text || '--  ' ELSE text END AS text FROM lines),
bt AS (SELECT doc_id, text_name, book, line, {_WRAPPED} AS t FROM wl),
nx AS (SELECT *, CASE WHEN regexp_matches(lead(t) OVER o, '^[^\\s]*- *$') THEN '' ELSE regexp_extract(lead(t) OVER o, '^[^\\s]*') END AS next, coalesce(regexp_matches(lag(t) OVER o, '- *$'), false) AND NOT regexp_matches(t, '^[^\\s]*- *$') AS taken FROM bt WINDOW o AS (PARTITION BY doc_id, text_name, book ORDER BY line)),
ow AS (SELECT *, CASE WHEN taken THEN regexp_replace(t, '^[^\\s]*', '') ELSE t END AS own FROM nx),
tk AS (SELECT * FROM (SELECT text_name, book, unnest(string_split({c.sql_squeeze(c.sql_beta("CASE WHEN regexp_matches(own, '- *$') THEN regexp_replace(own, '- *$', '') || coalesce(next, '') ELSE own END"))}, ' ')) AS raw FROM ow) WHERE raw <> ''),
{c.sql_standardize_ctes('tk', 'raw', 'text_name, book')}
SELECT text_name, book, token, count(*) AS n FROM std GROUP BY ALL""")
def wrapped_words(spark, sf):
    t = tk.tokens_of_wrapped_blocks(wrapped_lines(spark, sf), ["doc_id", "text_name", "book"])
    return tk.vocabulary(t, ["text_name", "book"])


@query("n12_vocabulary", f"WITH {c.SQL_TOKENS} SELECT token, count(*) AS n FROM std GROUP BY token ORDER BY token")
def vocabulary(spark, sf):
    return tk.vocabulary(c.tokens(spark, sf)).orderBy("token")


@query("n13_token_counts", f"""WITH {c.SQL_TOKENS}
SELECT text_name, book, count(*) AS n_tokens, count(DISTINCT token) AS n_unique FROM std GROUP BY ALL""")
def token_counts(spark, sf):
    return tk.token_counts(c.tokens(spark, sf), ["text_name", "book"])


def benchmark_tokens(spark, sf):
    b = c.load(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("text"))
    return tk.tokens_of_lines(b, ["item_id"])


SQL_BENCH = c.SQL_TOKENS + f""",
bl AS (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark),
btk AS (SELECT * FROM (SELECT unnest(string_split({c.sql_clean_line(c.sql_decap_line('text'))}, ' ')) AS raw FROM bl) WHERE raw <> ''),
bstd AS (SELECT DISTINCT token FROM (WITH {c.sql_standardize_ctes('btk', 'raw', 'raw')} SELECT token FROM std))"""


@query("n14_lookup_failures", f"""WITH {SQL_BENCH}
SELECT count(*) FILTER (WHERE token NOT IN (SELECT token FROM bstd)) AS n_failed, count(*) AS n_total FROM (SELECT DISTINCT token FROM std)""")
def lookup_failures(spark, sf):
    return tk.lookup_failures(c.tokens(spark, sf), benchmark_tokens(spark, sf))
