"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Texts are read once: each document's candidates (places, kind and a code of votes and features, no text) go to a table
in the shared folder. EM and the classifier see only how often each code occurs: a bounded table of counts, so their
arithmetic is done where it is collected.
"""

from __future__ import annotations

from functools import reduce
from math import prod
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spans_of, table

#: Kinds of the base, in the order in which spans at one place are listed, then those that the method may add.
BASE = ("email", "ip", "card", "phone")
MORE = ("ssn", "iban", "tel", "account", "name", "address", "birth")
KINDS = BASE + MORE
# Java patterns. Possessive parts and look-behinds keep matching linear on any text and find what the plain patterns find.
# A look-ahead at the first character comes before a look-behind: at most places it fails, and is the cheaper of the two.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of 14 digits and more; shorter ones never count. Up to 19 digits that pass Luhn: card; others: account.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
TEL = r"(?=[(2-9])(?<![0-9+.(-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
#: Titles, the given names and street words below are gazetteers of English, German, French and Spanish.
NAME = r"(?=[DFHMPS])(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señora?|Señorita|Sra?|Doña)\.?\x20\p{Lu}[\p{L}'’]+(?:[\x20-]\p{Lu}[\p{L}'’]+){0,2}"
ADDRESS = (
    r"(?=[0-9\p{Lu}acp])(?<![\p{L}\p{N}])(?:[0-9]{1,5}[a-z]?,?\x20(?:\p{Lu}\p{L}+\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)(?!\p{L})"
    r"|[0-9]{1,5},?\x20(?:bis\x20|ter\x20)?(?:rue|avenue|boulevard|place|chemin|allée|impasse)\x20(?:de\x20la\x20|de\x20|du\x20|des\x20|d['’]|l['’])?\p{Lu}\p{L}+"
    r"|\p{Lu}\p{L}*(?:straße|strasse|str\.|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?(?![\p{L}\p{N}])"
    r"|(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)\x20(?:de\x20la\x20|de\x20|del\x20)?\p{Lu}\p{L}+,?\x20(?:n[.ºo]\x20?)?[0-9]{1,4}(?![\p{L}\p{N}]))"
)
BIRTH = r"(?=[0-9])(?<![0-9./-])(?:[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9./-]?[0-9])"
GIVEN_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Daniel|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Jessica|Sarah|Karen|Emma|Anna|Peter|Paul|Mark|George"
    "|Hans|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Matthias|Ursula|Monika|Petra|Sabine|Renate|Jean|Pierre|Michel|Philippe|Alain|Nicolas|Marie|Nathalie|Isabelle|Sylvie|Catherine|Françoise"
    "|José|Antonio|Juan|Manuel|Francisco|Luis|Carlos|Javier|María|Carmen|Ana|Isabel|Laura|Cristina|Marta|Lucía"
)
BIRTH_CUES = r"(born|birth|d\.?o\.?b|geboren|geburt|geb\.|\bnée?\b|naissance|nacid|nacimiento)"
NAME_CUES = r"(dear|contact|attn|signed|author|patient|client|customer|name|regards|liebe|sehr geehrte|kunde|cher|chère|bonjour|estimad|cliente)"
ADDRESS_CUES = r"(address|lives? (at|in)|resid|located|deliver|ship|send|visit|adresse|wohn|habite|domicil|dirección|vive|reside)"
#: Lengths of account numbers by country; of other countries nothing is known.
IBAN_LENGTHS = "AT20|BE16|CH21|DE22|DK18|ES24|FI18|FR27|GB22|IE22|IT27|LU20|NL18|NO15|PL28|PT25|SE24"
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|it|uk|nl|be|ch|at|pl|se|no|fi|dk|pt|eu|ru|cn|jp|kr|in|br|mx|ar|ca|au|us"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
IBAN_COUNTRIES = "AD|AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"
CUES = "(mail|contact|phone|tel|call|fax|mobile|card|visa|account|acct|konto|cuenta|compte|ssn|social|iban|bank|server|host|reach)"
COUNTER_CUES = r"(version|isbn|issn|order|invoice|ticket|token|hash|sha|commit|serial|part|ref)\W*$"
#: Kinds of which a span of the wrong form can't exist: a number never given out, a wrong length for its country.
FORMED = ("ssn", "iban")
CONTEXT = 24
ROUNDS, ACCEPT = 12, 0.5
ABSTAIN, NO, YES = 0, 1, 2
_SPAN = "array<struct<s:int,k:int,e:int,code:int>>"
_N_FEATURES = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column) -> Column:
    return F.call_function("luhn_check", _digits(m))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, NO).when(yes, YES).otherwise(ABSTAIN)


def format_vote(kind: str, m: Column) -> Column:
    """The regular-expression labeler: is the match well formed beyond what made it a candidate?"""
    if kind == "email":
        good = m.rlike(r"^[A-Za-z0-9].*\.[A-Za-z]{2,}$")
        return _vote(good, ~good)
    if kind == "ip":
        return _vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike(r"(^|\.)0[0-9]"))
    if kind == "ssn":
        good = m.rlike("^(?!000|666|9)...-(?!00)..-(?!0000)....$")
        return _vote(good, ~good)
    if kind == "name":
        return _vote(m.rlike(r"\x20\p{Lu}[\p{L}'’]+[\x20-]\p{Lu}"), F.lit(False))
    if kind == "iban":
        right = reduce(or_, [m.startswith(x[:2]) & (F.length(m) == int(x[2:])) for x in IBAN_LENGTHS.split("|")])
        return _vote(right, m.rlike(f"^({'|'.join(x[:2] for x in IBAN_LENGTHS.split('|'))})") & ~right)
    return F.lit(ABSTAIN if kind in ("account", "birth") else YES)


def gazetteer_vote(kind: str, m: Column) -> Column:
    """Lists of top-level domains, calling codes, countries, issuers' first digits, given names and years of birth."""
    if kind == "email":
        good = m.rlike(rf"(?i)\.({TOP_DOMAINS})$")
        return _vote(good, ~good)
    if kind == "ip":
        return _vote(F.lit(False), m.rlike(r"^(0|10|127|22[4-9]|2[3-5][0-9])\."))
    if kind in ("card", "account"):
        good = _digits(m).rlike("^(4|5[1-5]|2[2-7]|3[47]|6)")
        return _vote(good, ~good)
    if kind == "phone":
        good = m.rlike(rf"^\+({CALLING_CODES})")
        return _vote(good, ~good)
    if kind == "iban":
        good = m.rlike(f"^({IBAN_COUNTRIES})")
        return _vote(good, ~good)
    if kind == "name":
        return _vote(m.rlike(f"\\x20({GIVEN_NAMES})(?!\\p{{L}})"), F.lit(False))
    if kind == "birth":
        return _vote(m.rlike("(19[2-9]|200|201)[0-9]"), m.rlike("(190|191|202|20[3-9])[0-9]"))
    return F.lit(ABSTAIN)


def context_vote(kind: str, pre: Column) -> Column:
    """Cues in the text before: for some kinds their own, and their absence counts against a date."""
    low = F.lower(pre)
    if kind == "birth":
        return _vote(low.rlike(BIRTH_CUES), ~low.rlike(BIRTH_CUES))
    own = {"name": NAME_CUES, "address": ADDRESS_CUES}.get(kind, CUES)
    return _vote(low.rlike(own), low.rlike(COUNTER_CUES))


#: What the classifier sees of a span beside its kind and votes: each is a bit.
FEATURES = (
    lambda x: ~x["pre"].rlike("[A-Za-z0-9]$") & ~x["post"].rlike("^[A-Za-z0-9]"),  # stands apart from letters and digits
    lambda x: F.length(x["m"]) >= 14,
    lambda x: F.length(_digits(x["m"])) * 2 > F.length(x["m"]),
    lambda x: x["pre"].rlike(r"[:=]\s*$"),
    lambda x: x["m"].rlike(r"[\x20().-]"),
    lambda x: x["pre"].rlike(r"(^|\n)$") & x["post"].rlike(r"^($|\n)"),  # a line of its own
)


def features(x: Column) -> Column:
    return reduce(add, [f(x).cast("int") * (1 << k) for k, f in enumerate(FEATURES)])


def candidates(text: Column) -> Column:
    """Spans of all kinds; code is kind, three votes and the features as one number."""

    def of(kind: str, pattern: str, holds=None) -> Column:
        found = spans_of(text, pattern, CONTEXT)
        if holds is not None:
            found = F.filter(found, lambda x: holds(x["m"]))
        code = lambda x: (((F.lit(KINDS.index(kind)) * 3 + format_vote(kind, x["m"])) * 3 + gazetteer_vote(kind, x["m"])) * 3 + context_vote(kind, x["pre"])) * _N_FEATURES + features(x)
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), code(x).alias("code"))).cast(_SPAN)

    between = lambda low, high: lambda m: F.length(_digits(m)).between(low, high)
    byte = "(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))"
    is_card = lambda m: between(14, 19)(m) & luhn(m)
    none = F.array().cast(_SPAN)
    given = lambda pattern, *spans, also=None: F.when((text.rlike(pattern) if also is None else text.contains(also) & text.rlike(pattern)), F.concat(*spans)).otherwise(none)
    with_digits = F.concat(
        given(IP, of("ip", IP, lambda m: m.rlike(rf"^{byte}(\.{byte}){{3}}$"))),
        given(CARD, of("card", CARD, is_card), of("account", CARD, lambda m: between(14, 19)(m) & ~luhn(m))),
        given(PHONE, of("phone", PHONE, between(10, 15)), also="+"),
        given(SSN, of("ssn", SSN)),
        given(IBAN, of("iban", IBAN)),
        given(TEL, of("tel", TEL)),
        given(ADDRESS, of("address", ADDRESS)),
        given(BIRTH, of("birth", BIRTH)),
    )
    # one search for a digit spares a text without any eight others
    parts = [given(EMAIL, of("email", EMAIL), also="@"), given(NAME, of("name", NAME)), given("[0-9]", with_digits)]
    return F.sort_array(F.concat(*parts))


def unpack(code: int) -> tuple[int, tuple[int, int, int], int]:
    """Kind, votes, features."""
    rest, f = divmod(code, _N_FEATURES)
    rest, v2 = divmod(rest, 3)
    rest, v1 = divmod(rest, 3)
    k, v0 = divmod(rest, 3)
    return k, (v0, v1, v2), f


def learn(counts: dict[int, int], rounds: int = ROUNDS) -> list[int]:
    """Codes that the final classifier accepts, from how often each occurs (at most len(KINDS) * 27 * 64 numbers).

    EM: the probability of each vote given that a span is, or isn't, personal data, for each labeler, and a prior for
    each kind. Then a naive-Bayes span classifier is fitted to EM's posteriors, with kind, votes and the features, each for itself, as inputs.
    Spans of FORMED kinds that the form speaks against are learnt from but never accepted.
    """
    seen = [(*unpack(code), n, code) for code, n in sorted(counts.items())]
    prior, smooth = [0.5] * len(KINDS), 1.0
    vote = [[[0.4, 0.1, 0.5], [0.5, 0.4, 0.1]] for _ in range(3)]  # [labeler][0: it is, 1: it isn't][abstain, no, yes]

    def posterior(k: int, votes: tuple[int, int, int], ratio: float = 1.0) -> float:
        good, bad = prior[k] * ratio, 1 - prior[k]
        for i, v in enumerate(votes):
            good, bad = good * vote[i][0][v], bad * vote[i][1][v]
        return good / (good + bad)

    for _ in range(rounds):
        kinds, sums = [[smooth, smooth] for _ in KINDS], [[[smooth] * 3 for _ in range(2)] for _ in range(3)]
        for k, votes, _f, n, _code in seen:
            p = posterior(k, votes)
            for y, w in enumerate((n * p, n * (1 - p))):
                kinds[k][y] += w
                for i, v in enumerate(votes):
                    sums[i][y][v] += w
        prior = [a / (a + b) for a, b in kinds]
        vote = [[[x / sum(row) for x in row] for row in labeler] for labeler in sums]
    bits = [[[smooth, smooth] for _ in range(2)] for _ in FEATURES]  # [feature][0: it is, 1: it isn't][absent, present]
    for k, votes, f, n, _code in seen:
        p = posterior(k, votes)
        for b, rows in enumerate(bits):
            rows[0][f >> b & 1] += n * p
            rows[1][f >> b & 1] += n * (1 - p)
    ratio = [[(yes[v] / sum(yes)) / (no[v] / sum(no)) for v in range(2)] for yes, no in bits]
    can_be = lambda k, votes: KINDS[k] not in FORMED or votes[0] != NO
    return [code for k, votes, f, _n, code in seen if can_be(k, votes) and posterior(k, votes, prod(r[f >> b & 1] for b, r in enumerate(ratio))) >= ACCEPT]


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<s,k,e,code>>) for every row of docs: base spans, and others that the classifier accepts.

    A null text is empty and has no spans. Rows are scanned alone: repeated rows and null ids come back each. With no
    candidates anywhere nothing is learnt and nothing added. Extra columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = cut(docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).select("doc_id", candidates(F.col("text")).alias("spans")), "pii-candidates")
    accepted = learn({r.code: r.n for r in found.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()})
    keep = F.array(*[F.lit(c) for c in accepted]) if accepted else F.array().cast("array<int>")
    return found.select("doc_id", F.filter("spans", lambda x: (x["k"] < len(BASE)) | F.array_contains(keep, x["code"])).alias("spans"))


def count_kind(k: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_pii of documents with counts and digest of the base spans; edge cases as there."""
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    n = {f"n_{kind}": count_kind(k) for k, kind in enumerate(BASE)}
    return out.select("doc_id", *[c.alias(name) for name, c in n.items()], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
