"""Operator 1: licence scans, in DataFrame functions only.

A gate of keywords spares most texts.  In the others, each word that is a rule's anchor opens
a window of words, the rules of that anchor are tried there, and their matches are intervals
of words.  Intervals inside another of the same or a higher priority are suppressed in one
pass over the sorted intervals.  All of it happens within the row: there is no shuffle, and
the work on a text is in proportion to its words and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigipanel.llm.license_rules import KEYWORDS, anchored

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words a signature can span.
WINDOW = 32


def _normal(text: Column) -> Column:
    """The words of a text with single blanks between them.

    `lower` also changes letters beyond A-Z, but no word boundary and none of the signatures'
    letters depends on that.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def _words(doubled: Column) -> Column:
    """Number of words in a part of a doubled text, by its blanks: two per word."""
    return ((F.length(doubled) - F.length(F.replace(doubled, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _places(normal: Column, n_words: Column, phrase: str) -> Column:
    """Count, first and last place of a phrase that can't overlap itself; null without any.

    With every blank doubled, and one at both ends, occurrences share no blank, so that what
    stands before the first and after the last one gives their places.
    """
    mark, size = f" {phrase.replace(' ', '  ')} ", len(phrase.split())
    doubled = F.concat(F.lit(" "), F.replace(normal, F.lit(" "), F.lit("  ")), F.lit(" "))
    return F.when(
        F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {phrase} "),
        F.struct(
            ((F.length(doubled) - F.length(F.replace(doubled, F.lit(mark), F.lit("")))) / len(mark)).cast("bigint").alias("n"),
            _words(F.substring_index(doubled, mark, 1)).alias("first"),
            (n_words - size - _words(F.substring_index(doubled, mark, -1))).alias("last"),
        ),
    )


def _rules_by_anchor() -> tuple[Column, Column]:
    """The anchors, and a map from an anchor to its rules; both constants of the plan."""
    groups: dict[str, list[Column]] = {}
    for number, anchor, label, priority, regex in anchored():
        rule = F.struct(
            F.lit(number).alias("number"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(regex).alias("regex")
        )
        groups.setdefault(anchor, []).append(rule)
    entries = [x for anchor, rules in groups.items() for x in (F.lit(anchor), F.array(*rules))]
    return F.array(*map(F.lit, groups)), F.create_map(*entries)


def _detections(words: Column) -> Column:
    """Sorted intervals (start, -end, priority, number, label) of all rules' matches."""
    anchors, rules = _rules_by_anchor()
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(anchors, F.get(words, i)))
    windows = F.transform(
        places, lambda i: F.struct(i.alias("start"), F.get(words, i).alias("anchor"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("text"))
    )

    def tried(window: Column) -> Column:
        def match(rule: Column) -> Column:
            text = F.trim(F.call_function("regexp_extract", window["text"], rule["regex"], F.lit(0)))
            size = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)
            return F.struct(
                window["start"].alias("start"), (-(window["start"] + size)).alias("minus_end"), rule["priority"].alias("priority"),
                rule["number"].alias("number"), rule["label"].alias("label"),
            )

        return F.filter(F.transform(F.element_at(rules, window["anchor"]), match), lambda d: -d["minus_end"] > d["start"])

    return F.array_sort(F.flatten(F.transform(windows, tried)))


def _kept(detections: Column) -> Column:
    """Labels and best score of the detections that no other suppresses.

    In the order of start, then longest first, an interval lies in an earlier one if that one
    ends no sooner; so the furthest end so far, per priority, decides.
    """

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        top = d["priority"] == 1
        covered = F.when(top, acc["end_top"]).otherwise(F.greatest(acc["end_top"], acc["end_all"])) >= end
        size = (end - d["start"]).cast("double")
        return F.struct(
            F.when(top, F.greatest(acc["end_top"], end)).otherwise(acc["end_top"]).alias("end_top"),
            F.greatest(acc["end_all"], end).alias("end_all"),
            F.when(covered, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(covered, acc["score"]).otherwise(F.greatest(acc["score"], size / (size + 2))).alias("score"),
        )

    start = F.struct(
        F.lit(0).alias("end_top"), F.lit(0).alias("end_all"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")
    )
    return F.aggregate(detections, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is m / (m + 2) for the longest phrase or kept detection of m words, 0 without
    any.  A null or empty text has no words, no labels and score 0.  Rows are independent:
    repeated rows, null ids and empty tables pass through; other columns are ignored.
    """
    normal = docs.select(F.col(id_col).alias("doc_id"), _normal(F.col(text_col)).alias("normal"))
    # The words are a column of their own: an expression inside a lambda runs for each element.
    split = normal.withColumn("words", F.when(F.col("normal") == "", F.array().cast("array<string>")).otherwise(F.split("normal", " ")))
    words = split.withColumn("n_words", F.size("words").cast("bigint"))
    keywords = F.arrays_overlap("words", F.array(*map(F.lit, KEYWORDS)))
    marked = words.withColumns({f"base{i}": _places(F.col("normal"), F.col("n_words"), phrase) for i, (phrase, _) in enumerate(BASE)})
    found = marked.withColumn("found", F.when(keywords, _kept(_detections(F.col("words")))))
    base = [F.col(f"base{i}") for i in range(len(BASE))]
    labels = F.array_sort(F.array_compact(F.array(*(F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(base, BASE)))))
    sizes = [len(phrase.split()) for phrase, _ in BASE]
    scores = [F.when(b.isNotNull(), F.lit(n / (n + 2))) for b, n in zip(base, sizes)]
    none = F.array().cast("array<string>")
    return found.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(b["n"], F.lit(0)) for b in base[1:]), F.coalesce(base[0]["n"], F.lit(0))).cast("bigint").alias("n_base"),
        F.least(*(b["first"] for b in base)).alias("first_word"),
        F.greatest(*(b["last"] for b in base)).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found.labels", none))), ",").alias("labels"),
        F.coalesce(F.greatest(*scores, "found.score"), F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The same scan for DuckDB: every word is a row, rules are joined by their anchor."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({n}, {quote(a)}, {quote(label)}, {p}, {quote(regex)})" for n, a, label, p, regex in anchored())
    base = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in BASE)
    return f"""
with rule(number, anchor, label, priority, regex) as (values {table}),
base(phrase, label, size) as (values {base}),
doc as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
word as (select doc_id, unnest(range(len(w))) as i, w from doc),
hit as (select doc_id, i, phrase, label, size from word join base on w[i + 1] = split_part(phrase, ' ', 1)
        and array_to_string(w[i + 1 : i + size], ' ') = phrase),
base_sum as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word,
        max(size / (size + 2.0)) as score, list(distinct label) as labels from hit group by doc_id),
spot as (select doc_id, i, number, priority, label,
        trim(regexp_extract(array_to_string(w[i + 1 : i + {WINDOW}], ' '), regex)) as m
        from word join rule on w[i + 1] = anchor),
found as (select doc_id, i, i + len(string_split(m, ' ')) as e, number, priority, label from spot where m <> ''),
ranked as (select *, max(e) over before as end_all, max(case when priority = 1 then e end) over before as end_top from found
        window before as (partition by doc_id order by i, e desc, priority, number rows between unbounded preceding and 1 preceding)),
kept as (select * from ranked where coalesce(case when priority = 1 then end_top else end_all end, 0) < e),
kept_sum as (select doc_id, max((e - i) / (e - i + 2.0)) as score, list(distinct label) as labels from kept group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ',') as labels,
       cast(greatest(coalesce(b.score, 0), coalesce(k.score, 0)) as double) as score
from doc d left join base_sum b using (doc_id) left join kept_sum k using (doc_id)"""
