"""Names, documentation and keywords as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a word: a break is where lower case turns to upper, letters to digits, or at anything else.
PARTS = r"\p{Lu}*\p{Ll}+|\p{Lu}+|[0-9]+"
#: Characters of the texts of one task that counts tokens.
CHARS = 4_000_000


def strip_html(text: Column) -> Column:
    """Without tags: from each < to the first > after at least one character."""
    return F.regexp_replace(text, r"<[\s\S][^>]*>", "")


def append_member(owner: Column, member: Column) -> Column:
    return F.concat_ws(".", owner, member)


def split_name(name: Column) -> Column:
    return F.split(name, "[.#]")


def short_name(name: Column) -> Column:
    return F.element_at(split_name(name), -1)


def suffixes(name: Column) -> Column:
    """A name and all that follows a dot or hash in it, separators kept."""
    starts = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: (i == 1) | F.substring(name, i - 1, 1).isin(".", "#"))
    return F.transform(starts, lambda i: F.substring(name, i, F.length(name)))


def module_id(organization: Column, name: Column, revision: Column) -> Column:
    return F.concat_ws(":", organization, name, revision)


def is_snapshot(revision: Column) -> Column:
    return revision.endswith("SNAPSHOT")


def row_key(module: Column, name: Column) -> Column:
    """Identity of a type or view row."""
    return F.concat_ws(":", module, name)


def indexable(body: Column, attributes: Column) -> Column:
    """Documentation without markup: body, then attribute values by line."""
    return F.concat(strip_html(F.coalesce(body, F.lit(""))), F.array_join(F.transform(attributes, lambda a: strip_html(a["value"])), "\n"))


def document(name: Column, content: Column) -> Column:
    """What keywords are searched in: the name twice, then the documentation."""
    return F.concat(F.repeat(F.concat(name, F.lit("\n")), 2), content)


def stem(token: Column) -> Column:
    """Inflected forms of a word as one: plurals, -ed and -ing, without the e that these drop.

    ``creates``, ``created``, ``creating`` and ``create`` are one word, and so are ``mapped`` and ``map``. The published stemmer it stands for looks words up;
    this one goes by their endings alone.
    """
    s = F.when(token.rlike("^.{2,}[^aeiou]ies$"), F.regexp_replace(token, "ies$", "y")).when(token.rlike("(ss|us|is)$") | (F.length(token) < 4), token).otherwise(F.regexp_replace(token, "s$", ""))
    cut = F.regexp_replace(s, "^(.*[aeiouy].*[^aeiou]|.*[aeiouy][^aeiou])(?:ed|ing)$", "$1")
    single = F.regexp_replace(cut, "([bdgmnprt])\\1$", "$1")
    base = F.when(cut != s, single).otherwise(s)
    return F.when(F.length(base) > 3, F.regexp_replace(base, "e$", "")).otherwise(base)


def word_parts(word: Column) -> Column:
    """A word and its parts; most words are their only part, which needs no search for parts."""
    return F.when(word.rlike(r"^\p{Lu}*\p{Ll}+$"), F.array(word)).otherwise(F.array_union(F.array(word), F.regexp_extract_all(word, F.lit(PARTS), F.lit(0))))


def tokens(text: Column, stemmed: bool = False) -> Column:
    """Words between white space and dots, with their parts, in lower case; a word that is its only part counts once."""
    words = F.filter(F.split(text, r"[\s.]+"), lambda w: w != "")
    flat = F.flatten(F.transform(words, lambda w: F.transform(word_parts(w), lambda t: F.lower(t))))
    return F.transform(flat, stem) if stemmed else flat


def term_counts(docs: DataFrame, id_col: str, text: Column, stemmed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, token, tf, norm)``: how often each token stands in each document, and the norm of the document's length; columns of the document to ``keep`` follow.

    The tokens of :func:`tokens`, one row a word, so that everything but the split runs in generated code. Documents are dealt by
    their id before they are split: a task has so many characters at most, unless one document has more, and tokens are counted where they are.
    """
    given = docs.select(F.col(id_col).alias("id"), *keep, text.alias("text"))
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    given = given.repartition(max(chars // CHARS + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id")
    words = given.select("id", *keep, F.explode(F.split("text", r"[\s.]+")).alias("w")).filter("w <> ''")
    each = words.select("id", *keep, F.explode(word_parts(F.col("w"))).alias("t"))
    token = F.lower("t")
    counts = each.select("id", *keep, (stem(token) if stemmed else token).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), *[F.first(c).alias(c) for c in keep])
    return counts.withColumn("norm", norm_byte(F.sum("tf").over(Window.partitionBy("id"))))


def keyword_counts(docs: DataFrame, id_col: str, text: Column, keywords: list[str], stemmed: bool = False) -> DataFrame:
    """``(id, token, tf, norm)`` of ``keywords`` alone: each document counts its own, and nothing is shuffled."""
    held = docs.select(F.col(id_col).alias("id"), tokens(text, stemmed).alias("all"))
    own = F.transform(F.lit(sorted(set(keywords))), lambda k: F.struct(k.alias("token"), F.size(F.filter("all", lambda t: t == k)).cast("long").alias("tf")))
    each = held.select("id", F.size("all").cast("long").alias("length"), F.explode(F.filter(own, lambda x: x["tf"] > 0)).alias("x"))
    return each.select("id", "x.token", "x.tf", norm_byte(F.col("length")).alias("norm"))


def norm_byte(length: Column) -> Column:
    """The norm of a document of ``length`` tokens, one over the fourth root of the length and 10, in one byte.

    A byte is a power of two, counted from 2^-31, and two binary digits after the leading one; further digits are cut off.
    """
    norm = F.pow(length + 10, F.lit(-0.25)).cast("float").cast("double")
    power = F.floor(F.log2(norm))
    return (4 * (power + 31) + F.floor(norm * F.pow(F.lit(2.0), 2 - power)) - 4).cast("byte")


def norm_of(byte: Column) -> Column:
    """The norm that a byte stands for."""
    code = byte.cast("int")
    return (4 + code % 4) * F.pow(F.lit(2.0), F.floor(code / 4) - 33)


def tfidf(tf: Column, df: Column, n: Column, norm: Column) -> Column:
    """A token's share of a keyword score."""
    idf = 1 + F.log(n / (df + 1))
    return F.sqrt(tf) * idf * idf * norm


def keyword_scores(counts: DataFrame, keywords: list[str], n_docs: int) -> DataFrame:
    """``(id, doc_score)`` of the documents with any of the (tokenised) ``keywords``."""
    hits = counts.filter(F.col("token").isin(keywords))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return hits.join(F.broadcast(df), "token").groupBy("id").agg(F.sum(tfidf(F.col("tf"), F.col("df"), F.lit(n_docs), norm_of(F.col("norm")))).alias("doc_score"))


def link(base: Column, **parameters: Column) -> Column:
    """A URL with encoded query parameters."""
    return F.concat(base, F.lit("?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parameters.items()]))
