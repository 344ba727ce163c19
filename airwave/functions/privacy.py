"""Pseudonyms for authors and mentions, and the audit of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: what a mention is (three or more letters, digits, dots, hyphens, underscores), and the marks of pseudonyms
HANDLE = r"@([A-Za-z0-9_.\-]{3,})"
AUTHOR, MENTION = "viewer #", "@viewer-"


def digest(name: Column, salt: str) -> Column:
    """Eight hex digits keyed by ``salt``; a mention and an author field that both read @name share theirs."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), name), 256), 1, 8)


def pseudonymise_author(author: Column, salt: str) -> Column:
    """Any author's name or handle becomes a pseudonym; null, empty and what is one already stay."""
    done = author.isNull() | (author == "") | F.startswith(author, F.lit(AUTHOR))
    return F.when(done, author).otherwise(F.concat(F.lit(AUTHOR), digest(author, salt)))


def pseudonymise_text(text: Column, salt: str) -> Column:
    """Every mention becomes the pseudonym of its handle; done twice it changes nothing more."""
    rest = F.split(text, HANDLE)
    handles = F.regexp_extract_all(text, F.lit(HANDLE), 0)
    made = F.transform(handles, lambda h: F.when(F.startswith(h, F.lit(MENTION)), h).otherwise(F.concat(F.lit(MENTION), digest(h, salt))))
    return F.array_join(F.flatten(F.zip_with(rest, made, lambda r, m: F.array(F.coalesce(r, F.lit("")), F.coalesce(m, F.lit(""))))), "")


def pseudonymise(messages: DataFrame, salt: str) -> DataFrame:
    """Author and in-text mentions by the same keyed digest."""
    return messages.withColumn("author", pseudonymise_author(F.col("author"), salt)).withColumn("text", pseudonymise_text(F.col("text"), salt))


def pseudonymise_documents(docs: DataFrame, salt: str) -> DataFrame:
    """Mentions in title, content and summary."""
    return docs.withColumns({c: pseudonymise_text(F.col(c), salt) for c in ("title", "content", "summary")})


def anonymise_report(messages: DataFrame) -> DataFrame:
    """What a run would touch: rows with mentions, mentions, distinct handles, rows with an author and distinct authors."""
    h = messages.select(F.regexp_extract_all("text", F.lit(HANDLE), 1).alias("h"), F.nullif("author", F.lit("")).alias("author"))
    rows = h.agg(F.count_if(F.size("h") > 0).alias("rows"), F.sum(F.size("h")).alias("mentions"), F.count("author").alias("authored"), F.countDistinct("author").alias("authors"))
    return rows.crossJoin(h.select(F.explode("h").alias("x")).agg(F.countDistinct("x").alias("handles")))


def privacy_audit(docs: DataFrame) -> DataFrame:
    """Documents with e-mail addresses, runs of nine or more digits of which four differ (a phone or card number,
    not a rule or a row of zeros), or handles that are nobody's pseudonym."""
    mail = F.size(F.regexp_extract_all("content", F.lit(r"([A-Za-z0-9._]+@[A-Za-z0-9-]+\.[A-Za-z]+)"), 1))
    runs = F.regexp_extract_all("content", F.lit(r"([0-9]{9,})"), 1)
    digits = F.size(F.filter(runs, lambda d: F.size(F.array_distinct(F.split(d, ""))) >= 4))
    raw = F.regexp_extract_all("content", F.lit(r"(?:^|[^A-Za-z0-9._])@([A-Za-z0-9_.\-]{3,})"), 1)
    handles = F.size(F.filter(raw, lambda h: ~F.startswith(h, F.lit(MENTION[1:]))))
    out = docs.select("id", mail.cast("long").alias("emails"), digits.cast("long").alias("digit_runs"), handles.cast("long").alias("handles"))
    return out.where("emails > 0 or digit_runs > 0 or handles > 0")


def vocabulary_audit(idf: DataFrame) -> DataFrame:
    """Terms of a keyword vocabulary (term, df) that are handles."""
    return idf.where(F.rlike("term", F.lit("^" + HANDLE + "$")) & ~F.startswith("term", F.lit(MENTION)))
