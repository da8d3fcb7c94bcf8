"""Line-first cleaning: each line faces punctuation, navigation and boilerplate rules; documents that lose too much go.

Everything happens inside the row (arrays and higher-order functions): no shuffle, and no key can become hot.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table

WORD_BREAK = f"[{SPACES}]+"
NOT_SYMBOLS = "[^#*$%&|<>]+"
BOILERPLATE = "(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|click here|subscribe to|sign up|share this|powered by|licensed under|enable javascript)"
#: What follows holds for other languages and scripts.
#: Ends of sentences in any script; Thai and Lao mark none, so their letters are taken as such.
SENTENCE_END = "[.!?…。！？｡．‼⁇⁈⁉।॥۔؟։።፧။៕། \u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ede]".replace(" ", "")
QUOTED = "«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹"
_SPACED = f"{SPACES}\u00a0\u202f"
#: A bar, or one of »›· with space or an end of the line on both sides that does not follow the end of a sentence.
SEPARATOR = rf"(?:\||(?<![^{_SPACED}])(?<![.!?…][{_SPACED}])[»›·](?![^{_SPACED}]))"
MENU = f"{SEPARATOR}.*{SEPARATOR}|{SEPARATOR}[{_SPACED}]*$"
BOILERPLATE_ELSEWHERE = (
    r"(?iu)(?<!\p{L})(?=[acdhijklmnprstupé])(?:tous droits réservés|politique (?:de confidentialité|(?:de|en matière de|relative aux) cookies)|mentions légales|conditions (?:générales )?d['’]utilisation|cliquez ici|abonnez-vous|inscrivez-vous|partagez? cet article|propulsé par|sous licence|activez javascript"
    r"|alle rechte vorbehalten|datenschutz(?:erklärung|richtlinie|bestimmungen)|cookie-richtlinie|nutzungsbedingungen|(?:klicken sie hier|hier klicken)|newsletter abonnieren|jetzt (?:anmelden|registrieren|abonnieren)|lizenziert unter|javascript aktivieren"
    r"|todos los derechos reservados|política de (?:privacidad|cookies)|(?:términos|condiciones) (?:de uso|de servicio|del servicio)|(?:haga|haz) clic aquí|suscríb(?:ete|ase)|regístrate|comparte est[eo]|licenciado bajo|habilit[ae] javascript)"
)
#: Every match of either pattern holds one of these in lower case: texts without them are not searched line by line.
BOILERPLATE_HINTS = "rights reserved;cookie policy;privacy policy;terms of ;click here;subscribe to;sign up;share this;powered by;licensed under;javascript".split(";")
BOILERPLATE_HINTS += "tous droits;politique ;mentions légales;utilisation;cliquez ici;abonnez-vous;inscrivez-vous;cet article;propulsé par;sous licence".split(";")
BOILERPLATE_HINTS += "alle rechte;datenschutz;cookie-richtlinie;nutzungsbedingungen;klicken;newsletter abo;jetzt ;lizenziert unter".split(";")
BOILERPLATE_HINTS += "todos los derechos;política de;términos d;condiciones d;clic aquí;suscríb;regístrate;comparte est;licenciado bajo".split(";")
#: Characters of scripts that put no spaces between words; two of them count as a word in kept.
NOT_UNSPACED = "[^\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
LONG_LINE = 60


def count_of(line: Column, others: str) -> Column:
    """How many characters remain when everything in others is taken out."""
    return F.length(F.regexp_replace(line, others, ""))


def unended(line: Column) -> Column:
    """Long and without any end of a sentence."""
    return (F.length(line) >= LONG_LINE) & ~line.rlike(SENTENCE_END)


def symbols(line: Column) -> Column:
    """Over a tenth symbols, or over a tenth doubled exclamation marks."""
    doubled = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))
    return (count_of(line, NOT_SYMBOLS) * 10 > F.length(line)) | (doubled * 10 > F.length(line))


def navigation(line: Column) -> Column:
    """Menu entries: two separators or more, or one at the end. Quotation marks and letters such as l·l are none."""
    return line.rlike("[|»›·]") & F.regexp_replace(line, QUOTED, "").rlike(MENU)


def boilerplate(line: Column) -> Column:
    return line.rlike(BOILERPLATE) | line.rlike(BOILERPLATE_ELSEWHERE)


def good_lines(lines: str, text: str, low: str) -> list[Column]:
    """The lines that pass: each rule filters what the one before left (column __kept), and only where the text, or the
    text in lower case, holds what the rule needs."""
    left = lambda holds, rule: F.when(holds, F.filter("__kept", lambda x: ~rule(x))).otherwise(F.col("__kept"))
    hinted = reduce(or_, [F.col(low).contains(h) for h in BOILERPLATE_HINTS])
    return [
        F.filter(lines, lambda x: ~unended(x)),
        left(F.col(text).rlike("[#*$%&|<>]") | F.col(text).contains("!!"), symbols),
        left(F.col(text).rlike("[|»›·]"), navigation),
        left(hinted, boilerplate),
    ]


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts, the cleaned text and the verdict to every row of docs.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bad_lines, clean_text, base_failed, kept;
    columns of docs with these names are replaced. A null text counts as empty: no words, base_failed, clean_text ''.
    Rows stand alone: repeated rows and ties change nothing, an empty table gives an empty result.
    """
    has_word = f"[^{SPACES}]"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("__text", body).withColumn("__w", F.array_remove(F.split("__text", WORD_BREAK), "")).withColumn("__l", F.filter(F.split("__text", "\n"), lambda x: x.rlike(has_word)))

    # neighbours come from shifted copies of an array: a lambda that looked them up in the array would be a trap, for the
    # optimizer may put the array's whole expression into the lambda when a caller filters on the results
    shift = lambda c, by: F.slice(c, 1 + by, F.greatest(F.size(c) - by, F.lit(0)))
    windows = lambda c: F.slice(c, 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    df = df.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    pairs = F.zip_with("__h", shift("__h", 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("__h", windows(F.zip_with(pairs, shift("__h", 2), lambda a, c: F.xxhash64(a, c))))
    # windows of one hash stand together when sorted; only these are made into texts, and compared as such
    numbered = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
    none = lambda kind: F.array().cast(f"array<struct<g:{kind},p:int>>")
    equal = lambda c: F.zip_with(c, shift(c, 1), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
    either = F.zip_with("__n", F.concat(F.array(F.lit(False)), "__n"), lambda a, b: a | b)
    df = df.withColumn("__g", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), numbered).otherwise(none("bigint"))).withColumn("__n", equal("__g"))
    df = df.withColumn("__p", F.sort_array(F.slice(F.zip_with("__g", either, lambda x, e: F.struct(x["p"].alias("p"), e.alias("e"))), 1, F.size("__g"))))
    three = F.filter(F.arrays_zip(F.col("__p").alias("q"), F.col("__w").alias("a"), shift("__w", 1).alias("b"), shift("__w", 2).alias("c")), lambda x: F.coalesce(x["q"]["e"], F.lit(False)))
    texts = F.sort_array(F.transform(three, lambda x: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("g"), x["q"]["p"].alias("p"))))
    df = df.withColumn("__g", F.when(F.size("__p") > 0, texts).otherwise(none("string"))).withColumn("__n", equal("__g"))
    df = df.withColumn("__p", F.sort_array(F.filter(F.zip_with("__g", either, lambda x, e: F.when(e, x["p"])), lambda x: x.isNotNull()))).withColumn("__low", F.lower("__text"))
    for lines in good_lines("__l", "__text", "__low"):
        df = df.withColumn("__kept", lines)

    # each position of a repeated window covers three words; those already covered by the one before count once
    state = "struct<n:bigint,last:int>"
    covered = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")).cast(state), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")).cast(state))["n"]
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": count_of(F.col("__text"), NOT_SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": covered,
        "n_lines": F.size("__l").cast("long"),
        "n_bad_lines": (F.size("__l") - F.size("__kept")).cast("long"),
        "clean_text": F.array_join("__kept", "\n"),
        "__all_chars": F.length(F.array_join("__l", "")),
        "__kept_chars": F.length(F.array_join("__kept", "")),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    # base_failed counts words by spaces; kept does not ask that of scripts without them
    unspaced = F.when(F.col("__text").rlike("[\u0e00-\u9fff]"), count_of(F.col("__text"), NOT_UNSPACED)).otherwise(0)
    few = (F.col("n_words") < MIN_WORDS) & (F.col("n_words") + unspaced / 2 < MIN_WORDS)
    again = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    df = df.withColumn("kept", ~few & ~again & (100 * F.col("__kept_chars") >= MIN_KEPT_PERCENT * F.col("__all_chars")))
    return df.drop("__text", "__low", "__w", "__l", "__h", "__g", "__n", "__p", "__kept", "__all_chars", "__kept_chars")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_lines of documents without the cleaned texts; edge cases as there. Here base_failed always means not kept."""
    out = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.col("kept") & ~F.col("base_failed")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_bad_lines")


# DuckDB's patterns can't look around: separators get spaces of their own instead, and those after the end of a sentence become letters.
_ELSEWHERE_SQL = BOILERPLATE_ELSEWHERE.replace(r"(?iu)(?<!\p{L})(?=[acdhijklmnprstupé])", r"(?i)(?:^|\PL)").replace("'", "''")
_OPEN = f"regexp_replace(regexp_replace(x, '{QUOTED}', '', 'g'), '([.!?…][{_SPACED}])[»›·]', '\\1x', 'g')"
_PADDED = f"replace(regexp_replace(' ' || {_OPEN} || ' ', '[\\x20\\x09-\\x0C\u00a0\u202f]', '  ', 'g'), chr(13), ' ' || chr(13) || ' ')"
_BAR = r"(?:\|| [»›·] )"
OP1_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[{SPACES}]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS l FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, unnest(l) AS x FROM d),
judged AS (
  SELECT r, x,
    length(regexp_replace(x, '{NOT_SYMBOLS}', '', 'g')) * 10 > length(x)
    OR (length(x) - length(replace(x, '!!', ''))) * 10 > length(x)
    OR (length(x) >= {LONG_LINE} AND NOT regexp_matches(x, '{SENTENCE_END}'))
    OR regexp_matches(x, '[|»›·]') AND regexp_matches({_PADDED}, '{_BAR}[^\r\u0085\u2028\u2029]*{_BAR}|{_BAR}[\\x20\\x0D]*$')
    OR regexp_matches(x, '{BOILERPLATE}') OR regexp_matches(x, '{_ELSEWHERE_SQL}') AS bad FROM lines),
byd AS (SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, sum(length(x)) AS a, coalesce(sum(length(x)) FILTER (NOT bad), 0) AS k FROM judged GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '{NOT_SYMBOLS}', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_bad_lines, coalesce(a, 0) AS a, coalesce(k, 0) AS k
  FROM d LEFT JOIN cov USING (r) LEFT JOIN byd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * k >= {MIN_KEPT_PERCENT} * a AS kept, n_lines, n_bad_lines
FROM c"""
