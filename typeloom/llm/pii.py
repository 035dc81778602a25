r"""Personal data by bootstrapped contextual extraction (operator 7), in DataFrame functions only.

Four kinds of identifiers have patterns of their own; their matches are the seeds. So has a fifth, secrets: long runs of lower-case
hexadecimal digits and letters. The word before a seed is a lexical pattern. Spark scores the bipartite graph of patterns
and instances in rounds: a pattern's confidence is the share of its word's occurrences in the corpus that
confident instances follow, an instance's is that of its best pattern, and instances that become confident
support further patterns, until no more do. At the end, identifier-like tokens and groups of digits (``min_digits`` digits or
more, or an @; without quotes, brackets and punctuation around them) whose instance is confident are spans too, wherever they stand.

Positions: matches are wrapped in two control characters, the text is split at them, and lengths
(in code points) are summed over the parts. Control characters U+0001 and U+0002 in a
text stand for U+0003 meanwhile, which changes no position and no match.

Defined cases: null counts as the empty text, which has no spans; repeated rows get equal rows;
an empty table gives an empty result; other columns are ignored. A candidate that overlaps a seed's span in its
text adds no span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_LOWER, ASCII_UPPER, cut

# Equivalents of the plain patterns that need linear time on long runs of one class: a match can only
# begin where a run begins or the last match ended, and repetitions give nothing back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])"
#: What may be an identifier: groups of digits one to three separators apart, or a token with a digit or an @.
TOKEN = r"(?<![^\x20\x09-\x0D])(?:[(]?[0-9]++(?:[().\x20/-]{1,3}[0-9]++)++(?![^\x20\x09-\x0D.,;:!?)])|[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)"
KINDS = ("email", "ip", "card", "phone")
SEEDS = (*KINDS, "secret")
#: Without the quotes, brackets and punctuation around a token; brackets that hold a part of it stay.
_END = """trim(trailing '"\\'.,;:!?)]}>' from m.value)"""
_CUT = f"""if(instr({_END}, ')') > 0, m.value, trim(leading '"\\'([<{{' from {_END}))"""
_LEAD = f"""if(instr({_END}, ')') > 0, 0, char_length({_END}) - char_length({_CUT}))"""
_CORE = f"named_struct('start', m.start + {_LEAD}, 'stop', m.start + {_LEAD} + char_length({_CUT}), 'value', {_CUT}, 'cue', m.cue)"
_SPACES = "\\t\\n\\u000b\\u000c\\r"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPAN = "array<struct<start:int,stop:int,value:string,cue:string>>"


def _spans(text: str, pattern: str) -> str:
    """SQL for the matches of ``pattern`` in column ``text`` with the word before each."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"split(regexp_replace({text}, '{quoted}', '\u0001$0\u0002'), '\u0001')"
    match = "substring_index(x, '\u0002', 1)"
    # An opening quote or bracket may stand between the word and the match.
    before = """trim(trailing '"\\'([<' from a.tail)"""
    cue = f"if(right({before}, 1) = ' ', lower(substring_index(rtrim({before}), ' ', -1)), '')"

    def tail(x: str) -> str:
        """The end of ``x`` with spaces for all white space: the whole of it where 64 characters don't hold its last word."""
        short = f"translate(right({x}, 64), '{_SPACES}', '     ')"
        return f"if(char_length({x}) <= 64 or instr(rtrim(trim(trailing '\"\\'([<' from {short})), ' ') > 0, {short}, translate({x}, '{_SPACES}', '     '))"

    rest = "substring_index(x, '\u0002', -1)"
    found = f"named_struct('start', a.at, 'stop', a.at + char_length({match}), 'value', {match}, 'cue', {cue})"
    step = f"named_struct('at', a.at + char_length(x) - 1, 'found', array_append(a.found, {found}), 'tail', {tail(rest)})"
    start = f"named_struct('at', char_length(p[0]), 'found', cast(array() as {_SPAN}), 'tail', {tail('p[0]')})"
    return f"transform(array({parts}), p -> aggregate(slice(p, 2, size(p)), {start}, (a, x) -> {step}, a -> a.found))[0]"


_DIGITS = "regexp_replace(m.value, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + "
    f"cast(if(i % 2 = 1, cast(substr(reverse({_DIGITS}), i, 1) as int), "
    f"(2 * cast(substr(reverse({_DIGITS}), i, 1) as int)) % 10 + (2 * cast(substr(reverse({_DIGITS}), i, 1) as int)) div 10) as int)) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": f"m.value rlike '^{_BYTE}([.]{_BYTE}){{3}}$'",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 9 and 15",
    "secret": "m.value rlike '[0-9]' and m.value rlike '[a-f]'",
}
_WORTH = {"email": "instr(t, '@') > 0", "ip": "instr(t, '.') > 0", "card": "true", "phone": "instr(t, '+') > 0", "secret": "t rlike '[0-9a-f]{32}'"}
_PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET}


def _joined(arrays: list[tuple[str, str]]) -> str:
    """SQL that joins spans as kind:start:end, by kind as listed, then start."""
    return "array_join(concat(" + ", ".join(f"transform({col}, s -> concat('{kind}:', s.start, ':', s.stop))" for kind, col in arrays) + "), ',')"


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_digits: int = 6) -> DataFrame:
    """Per row: id, a key of its content, the seeds of each kind, and further identifier-like tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("key"), F.translate(text, "\x01\x02", "\x03\x03").alias("t"))
    for kind in SEEDS:
        none = f"cast(array() as {_SPAN})"
        rows = rows.withColumn(kind, F.expr(f"filter(if({_WORTH[kind]}, {_spans('t', _PATTERN[kind])}, {none}), m -> {_VALID[kind]})"))
    seeds = ", ".join(SEEDS)
    more = f"filter(transform({_spans('t', TOKEN)}, m -> {_CORE}), m -> (instr(m.value, '@') > 0 or length({_DIGITS}) >= {min_digits}) and not exists(concat({seeds}), b -> b.start < m.stop and m.start < b.stop))"
    return rows.withColumn("more", F.expr(more)).drop("t")


def _word_counts(docs: DataFrame, text_col: str, words: DataFrame, limit: int = 100_000) -> DataFrame:
    """Occurrences in the whole corpus of ``words(cue)``; the list is sent to all tasks only if it has at most ``limit`` words."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    each = docs.select(F.explode(F.split(F.lower(text), r"[\x20\x09-\x0D]+")).alias("cue"))
    if words.count() <= limit:
        return each.join(F.broadcast(words), "cue", "left_semi").groupBy("cue").agg(F.count(F.lit(1)).alias("seen"))
    return each.groupBy("cue").agg(F.count(F.lit(1)).alias("seen")).join(words, "cue", "left_semi")


def learn(docs: DataFrame, spans: DataFrame, text_col: str = "text", min_confidence: float = 0.5, min_support: int = 3) -> DataFrame:
    """Confident new instances ``(value, kind)`` after scoring the graph of patterns and instances."""
    seeds = spans.select(F.explode(F.expr("concat(" + ", ".join(f"transform({k}, s -> named_struct('kind', '{k}', 'cue', s.cue, 'value', s.value))" for k in SEEDS) + ")")).alias("s")).select("s.*")
    more = spans.select(F.explode("more").alias("s")).select(F.lit(None).cast("string").alias("kind"), "s.cue", "s.value")
    graph = cut(seeds.union(more).filter("cue <> ''").groupBy("kind", "cue", "value").agg(F.count(F.lit(1)).alias("n")))
    # Only words that stand before some candidate that is no seed can lead anywhere, or get there in later rounds.
    useful = cut(graph.filter("kind is null").select("cue").distinct())
    seen = cut(_word_counts(docs, text_col, useful))
    seeded = graph.filter("kind is not null").join(useful, "cue", "left_semi")
    open_ = graph.filter("kind is null").drop("kind")
    labelled, before = seeded, -1
    while True:
        support = labelled.groupBy("cue", "kind").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("values"))
        patterns = support.join(seen, "cue").filter(F.col("values") >= min_support).select("cue", "kind", (F.col("hits") / F.col("seen")).alias("confidence"))
        patterns = patterns.filter(F.col("confidence") >= min_confidence)
        found = cut(open_.join(patterns, "cue").groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))
        # Instances only ever gain patterns, so their number stays when nothing changes any more.
        now = found.count()
        if now <= before:
            return found
        before = now
        labelled = cut(seeded.unionByName(open_.join(found, "value").select("kind", "cue", "value", "n")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_digits: int = 6, broadcast_values: int = 100_000, **options) -> DataFrame:
    """Per row: ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, secret_spans, n_secret, n_spans)``.

    The first four count seeds; ``spans`` has these and what contexts add, by kind; ``secret_spans`` has the fifth kind, and ``n_spans`` counts all.
    """
    spans = cut(base_spans(docs, id_col, text_col, min_digits))
    found = learn(docs, spans, text_col, **options)
    where = spans.select("doc_id", "key", F.explode("more").alias("s")).distinct().select("doc_id", "key", "s.*")
    extra = where.join(F.broadcast(found) if found.count() <= broadcast_values else found, "value").groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra"))
    extra = extra.select(F.col("doc_id").alias("of"), F.col("key").alias("content"), "extra")
    out = spans.drop("more").join(extra, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("content")), "left")
    for k in SEEDS:
        own, more = (f"transform({x}, s -> named_struct('start', s.start, 'stop', s.stop))" for x in (k, f"filter(coalesce(extra, array()), e -> e.kind = '{k}')"))
        out = out.withColumn(f"all_{k}", F.expr(f"array_sort(concat({own}, {more}))"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(
        F.col("doc_id").alias(id_col), *counts, F.sha2(F.expr(_joined([(k, k) for k in KINDS])), 256).alias("base_sha256"), F.expr(_joined([(k, f"all_{k}") for k in KINDS])).alias("spans"), F.expr(_joined([("secret", "all_secret")])).alias("secret_spans"),
        F.size("all_secret").cast("long").alias("n_secret"), sum((F.size(f"all_{k}") for k in SEEDS), F.lit(0)).cast("long").alias("n_spans"),
    )
