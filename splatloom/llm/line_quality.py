"""Quality rules: measures of each text, and lines that too many documents of a host share.

Built-in functions only.  One pass over the texts takes the measures and hashes the normalised
lines; both go to the shared folder.  A host's lines are counted by the number of its documents
that hold them.  Lines above the limits are removed, and a document that loses too large a part of
its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import written

SPACE = r"[\x20\x09-\x0D]+"
#: Base rules.
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: A line is removed if more than LINE_DOCS documents of its host hold it, and they are more than LINE_SHARE of the
#: host's documents or more than LINE_MANY.
LINE_DOCS, LINE_SHARE, LINE_MANY = 10, 0.02, 1_000
#: A document of which less than this part of its words is left is depleted.
LEFT_SHARE = 0.5


def text_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in ``words``.

    A text whose windows all hash differently repeats none.  Otherwise the windows are sorted by
    hash and words, so that equal ones are neighbours; texts may be of any length.
    """
    at = lambda i: [F.get(words, i + k) for k in range(3)]
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    windows = F.transform(starts, lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), *[w.alias(f"w{k}") for k, w in enumerate(at(i))], i.alias("i")))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))

    def found(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1)))
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), zero, add, lambda acc: acc["n"])

    # One-element arrays give values a name, so that they are computed once.
    alike = F.get(F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h)), 0)
    value = F.get(F.transform(F.array(F.sort_array(windows)), found), 0)
    return F.when((F.size(words) > 3) & alike, value).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, held).

    ``held`` lists the hash and the number of words of each line that has a word, normalised to
    lower case and single spaces.
    """
    text = F.coalesce(F.col("text"), F.lit(""))  # the column of that name below
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D]+", " "))
    hashed = lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n"))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    out = out.withColumns({"words": text_words(text), "lines": lines})
    out = out.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform(F.transform("lines", normal), hashed).alias("held"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words).

    One row for every row of ``docs``, each a document of its own; null and empty texts have no words
    and fail.  A null host is a host of its own.  ``kept`` is false where the base rules fail or less
    than ``LEFT_SHARE`` of the words stand outside the removed lines.  Texts may be of any length.
    """
    base = written(measures(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "measures")
    hosts = base.groupBy("host").agg(F.count("*").alias("docs"))
    # A document counts once for each of its lines; counts are added up before the shuffle, so hot lines are cheap.
    counts = base.select("host", F.explode(F.array_distinct(F.transform("held", lambda x: x["line"]))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    above = (F.col("c.docs") > LINE_DOCS) & ((F.col("c.docs") > LINE_SHARE * F.col("h.docs")) | (F.col("c.docs") > LINE_MANY))
    common = written(counts.alias("c").join(hosts.alias("h"), F.expr("c.host <=> h.host")).where(above).select("c.host", "c.line"), "lines")
    lines = base.select("row", "host", F.explode("held").alias("l")).select("row", "host", "l.line", "l.n")
    inside = lines.alias("l").join(common.alias("c"), F.expr("l.line = c.line and l.host <=> c.host"), "left_semi")
    removed = inside.groupBy("row").agg(F.sum("n").alias("removed"))
    lost = F.coalesce(F.col("removed"), F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_words") - lost >= LEFT_SHARE * F.col("n_words"))
    out = base.drop("held", "host").join(removed, "row", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), lost.alias("n_removed_words"))


SQL = rf"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
w as (select row, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
t as (select row, i, [words[i], words[i + 1], words[i + 2]] as t from (select row, words, unnest(range(1, len(words) - 1)) as i from w)),
twice as (select row, i from (select row, i, count(*) over (partition by row, t) as k from t) where k > 1),
repeated as (select row, count(distinct p) as n from (select row, unnest([i, i + 1, i + 2]) as p from twice) group by row),
b as (select d.row, d.doc_id, d.source, d.text, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d join w using (row) left join repeated r using (row)),
l as (select row, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) as line
  from (select row, source, unnest(string_split(text, chr(10))) as x from d)),
hosts as (select source, count(*) as docs from d group by source),
common as (select l.source, l.line from l join hosts h on l.source is not distinct from h.source where l.line <> ''
  group by l.source, l.line, h.docs having count(distinct l.row) > {LINE_DOCS}
  and (count(distinct l.row) > {LINE_SHARE}::double * h.docs or count(distinct l.row) > {LINE_MANY})),
removed as (select row, sum(len(string_split(l.line, ' ')))::bigint as n
  from l join common c on l.line = c.line and l.source is not distinct from c.source group by row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words - lost >= {LEFT_SHARE} * n_words as kept, lost as n_removed_words
from (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words as base_failed, coalesce(removed.n, 0)::bigint as lost
  from b left join removed using (row))
"""
