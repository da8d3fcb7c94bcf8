"""The SQL of the quality rules on lines of several languages and scripts, against the operator."""

import itertools

import duckdb
from pyspark.sql import functions as F

from fleetledger.llm import quality_rules

LINES = [
    "Il dit « oui » et elle dit « non » à tous ceux qui étaient venus.", "Accueil » Produits » Contact", "Home · About · Contact", "Col·lecció de l·lustres i més", "»Ja«, sagte er, und »nein«, sagte sie.", "Mehr lesen »", "Fin de la phrase. » Et la suite · encore",
    "a | b", "a |", "| a", "a|b|c", "Next ›", "› ‹ one ›", "one » › two", "! » » three", "trailing ·  ", "\u00a0»\u00a0x\u202f›\u202fy", "x » y\r › z",
    "Tous droits réservés par nous", "politique de confidentialité", "ALLE RECHTE VORBEHALTEN", "Cookie-Richtlinie", "xcookie-richtlinie", "Términos de uso", "haz clic aquí", "l'abonnez-vous", "abonnez-vousx", "Comparte este", "Click Here", "JavaScript aktivieren", "éabonnez-vous", "_abonnez-vous",
    "这是一个很长的句子它没有任何标点符号所以应该被当作坏行处理掉因为它超过了六十个字符的长度限制而且里面真的没有任何的句号或者问号存在于此处啊朋友们大家好", "这是一个很长的句子它有标点符号所以应该被留下来。因为它超过了六十个字符的长度限制而且里面真的有句号或者问号存在于此处啊朋友们大家好吗", "word " * 20, "word " * 20 + "۔", "Wow!! Yes!!", "# # # $ $ x",
]


def test_sql_has_the_rules_of_the_code(spark):
    plain = "\n".join(f"Plain{k} sentence{k} number{k} stands{k} here{k} as{k} any{k} would{k}." for k in range(12))
    texts = [*LINES, *(f"{plain}\n{x}" for x in LINES), *("\n".join(pair) + "\n" + plain for pair in itertools.combinations(LINES[:14], 2)), None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = F.col("kept") & ~F.col("base_failed")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines"]
    got = sorted(tuple(r) for r in quality_rules.clean_lines(d).withColumn("kept", kept).select(*names).collect())
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    rel = con.sql(quality_rules.OP1_SQL)
    assert sorted(rel.select(*names).fetchall()) == got
    assert len({r[-1] for r in got}) >= 3 and {r[7] for r in got} == {True, False}
