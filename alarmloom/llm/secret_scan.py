"""Secrets in whole texts: a trigram inverted index picks candidates for each rule, regular expressions verify them.

Everything here is DataFrame expressions.

Each rule's pattern gives a Boolean query over trigrams that every match must
contain (``trigrams.trigram_query``): alternatives of sets of trigrams. The index
has a row a block of documents and a column a trigram, with the posting list of
the documents in the block that have it. For each rule the lists of an
alternative's trigrams are intersected and the alternatives united. Only
documents so found are run through the rule's pattern. A rule without a trigram that
every match must contain (a run of hex digits) scans all documents.

Texts are not shuffled to meet their candidates: a bit map of the candidates' keys, of
a fixed size, goes to all tasks, and only rows that it does not rule out are joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, join_spread, temp_names, text_of
from .trigrams import trigram_query

#: Documents in a block of the index, as a power of two.
BLOCK_BITS = 12
#: Rows of 64 bits in the map of candidates.
MAP_ROWS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` of which ``group`` has at least ``least`` code points."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The three kinds that every scan has, in the order in which their ties stand.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Further kinds, with the published forms of such secrets.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def posting_lists(docs: DataFrame, key: Column, body: Column, words: list[str]) -> DataFrame:
    """The inverted index over ``words``: a row a block, in column p0, p1, ... the keys of its documents with that trigram in any case.

    A block is a run of rows of one input partition, so its lists are made where its rows are read.
    """
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    lowered = docs.select(block.alias("block"), key.alias("key"), F.lower(body).alias("lowered"))
    has = lowered.select("block", "key", *(F.contains("lowered", F.lit(w)).alias(f"has{i}") for i, w in enumerate(words)))
    return has.groupBy("block").agg(*(F.collect_list(F.when(F.col(f"has{i}"), F.col("key"))).alias(f"p{i}") for i in range(len(words))))


def candidates(docs: DataFrame, key: Column, body: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the numbers of the rules whose trigram query the document answers; documents without any are left out."""
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    words = sorted(frozenset().union(*(c for q in asked.values() for c in q)))
    number = {w: i for i, w in enumerate(words)}
    index = posting_lists(docs, key, body, words)

    def found(query: list[frozenset[str]]) -> Column:
        lists = [reduce(F.array_intersect, (F.col(f"p{number[w]}") for w in sorted(choice))) for choice in query]
        return reduce(F.array_union, lists)

    answers = F.array(*(F.struct(F.lit(i).alias("rule"), found(q).alias("keys")) for i, q in asked.items())) if asked else F.array().cast("array<struct<rule:int,keys:array<bigint>>>")
    flat = index.select(F.explode(answers).alias("a")).select("a.rule", F.explode("a.keys").alias("key"))
    return flat.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def bit_of(key: Column) -> Column:
    """The place of a key in the map of candidates, from 0 to 64 * MAP_ROWS - 1."""
    return F.pmod(F.xxhash64(key), F.lit(64 * MAP_ROWS))


def with_candidates(docs: DataFrame, rules: tuple[Rule, ...], held: str) -> DataFrame:
    """``docs`` with ``held``, the numbers of the rules for which the row is a candidate (null: none)."""
    key, other, row, bits, there = temp_names(docs, "scan_key", "scan_other", "scan_row", "scan_bits", "scan_there")
    body = text_of()
    row_key = F.xxhash64("doc_id", body)
    hits = checkpointed(candidates(docs, row_key, body, rules)).select(F.col("key").alias(other), F.col("rules").alias(held))
    place, own = bit_of(F.col(other)), bit_of(F.col(key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))  # of a place, a shift looks at the last six bits
    bit_map = hits.groupBy(F.shiftright(place, 6).alias(row)).agg(F.bit_or(bit).alias(bits))
    keyed = docs.withColumn(key, row_key).withColumn(there, F.shiftright(own, 6))
    marked = keyed.join(F.broadcast(bit_map), F.col(there) == F.col(row), "left")  # MAP_ROWS rows at most
    lit = F.call_function("shiftrightunsigned", F.col(bits), own.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    marked = marked.withColumn(there, F.coalesce(lit, F.lit(False))).drop(row, bits)
    none = F.lit(None).cast("array<int>")
    far = marked.where(~F.col(there)).drop(there, key).withColumn(held, none)
    near = join_spread(marked.where(there).drop(there), hits, key, other, "left").drop(key, other)
    return far.unionByName(near)


def running(values: Column, step, block: int = 256) -> Column:
    """For an array of numbers from 0 up, ``step`` (sum or maximum) over those before each, 0 for the first: blocks
    first, then inside each block, so time stays near the array's length."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))

    def before(numbers: Column) -> Column:
        return F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
    inside = F.transform(blocks, before)
    starts = F.zip_with(inside, F.slice(before(totals), F.lit(1), F.size(totals)), lambda own, start: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda x: step(x, start)))
    return F.when(n > 0, F.flatten(starts)).otherwise(F.array().cast("array<int>"))


def running_starts(lengths: Column) -> Column:
    return running(lengths, lambda a, x: a + x)


def running_maximum(ends: Column) -> Column:
    return running(ends, lambda a, x: F.greatest(a, x))


SPAN = "array<struct<start:int,rank:int,end:int>>"


def with_spans(df: DataFrame, body: Column, rule: Rule, rank: int, asked: Column, out: str) -> DataFrame:
    """Adds ``out``: start, rank and end of the rule's matches, leftmost first, in code points."""
    pattern = F.lit(rule.pattern)
    found, gaps, ends = f"{out}_found", f"{out}_gaps", f"{out}_lengths"
    # the match and, where it is another, the group whose length decides
    step = df.withColumn(found, F.when(asked, F.regexp_extract_all(body, pattern, F.lit(0))))
    some = F.size(F.coalesce(found, F.array())) > 0
    step = step.withColumn(gaps, F.when(some, F.transform(F.split(body, rule.pattern, -1), lambda x: F.length(x))))
    step = step.withColumn(ends, F.when(some, F.transform(found, lambda x: F.length(x))))
    size = F.when(some, F.transform(F.regexp_extract_all(body, pattern, F.lit(rule.group)), lambda x: F.length(x))) if rule.group else F.col(ends)
    # a gap stands before each match: the start of match i is all gaps up to i and all matches before it
    strides = F.zip_with(F.slice(gaps, F.lit(1), F.size(ends)), F.col(ends), lambda gap, own: gap + own)
    starts = F.zip_with(running_starts(strides), F.slice(gaps, F.lit(1), F.size(ends)), lambda a, gap: a + gap)
    spans = F.zip_with(starts, F.col(ends), lambda a, own: F.struct(a.alias("start"), F.lit(rank).alias("rank"), (a + own).alias("end")))
    kept = F.filter(F.arrays_zip(spans.alias("span"), size.alias("size")), lambda x: x["size"] >= rule.least)
    step = step.withColumn(out, F.when(some, F.transform(kept, lambda x: x["span"])).otherwise(F.array().cast(SPAN)).cast(SPAN))
    return step.drop(found, gaps, ends)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """All columns of ``docs`` and ``secret_spans``: an array of (kind, start, end) in code points, by start, then in the order of ``rules``.

    Matches of a kind do not overlap and are the leftmost; spans of two kinds may
    overlap. A null or empty text has no spans; a long text is scanned whole. Rows are told apart by the hash of doc_id
    and text; equal rows, and rows whose hashes agree by chance, share their
    candidates, which changes nothing as every candidate is verified on its own text.
    Other columns may have any names; one named secret_spans is replaced. An empty table gives no rows.
    """
    (held,) = temp_names(docs, "scan_rules")
    body = text_of()
    df = with_candidates(docs, rules, held)
    names = temp_names(df, *(f"spans_{i}" for i in range(len(rules))))
    for i, (rule, name) in enumerate(zip(rules, names)):
        asked = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains(held, i), F.lit(False))
        df = with_spans(df, body, rule, i, asked, name)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    ordered = F.array_sort(F.concat(*names))
    spans = F.transform(ordered, lambda x: F.struct(F.element_at(kinds, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return df.select(*(column(c) for c in docs.columns if c != "secret_spans"), spans.alias("secret_spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the three base kinds, a hash of their spans and all spans, for each document.

    A null or empty text has none (the hash is that of no bytes), equal rows have a row each, an empty table gives no rows; whole texts are
    scanned, and other columns are not looked at.
    """
    scanned = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*(r.kind for r in BASE_RULES)))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def kept_text(body: Column, gaps: Column, mark: str) -> Column:
    """What lies in ``gaps`` (array of start, end in code points, ascending) of ``body``, with ``mark`` between.

    Taking a part of a text walks it from its start, so gaps are taken in blocks of about
    the square root of their number: each block's text first, then the gaps of it.
    """
    n = F.size(gaps)
    block = F.ceil(F.sqrt(n)).cast("int")

    def of_block(k: Column) -> Column:
        own = F.slice(gaps, k * block + 1, block)
        start, end = own[0]["start"], F.element_at(own, -1)["end"]
        held = F.array(F.struct(F.substring(body, start + 1, end - start).alias("text"), start.alias("start"), own.alias("own")))
        return F.transform(held, lambda h: F.array_join(F.transform(h["own"], lambda g: F.substring(h["text"], g["start"] - h["start"] + 1, g["end"] - g["start"])), mark))[0]

    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), of_block), mark)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of each secret, overlapping spans as one; texts without secrets, null and empty ones stay as they are.

    ``n_chars``, where there is one, follows the new text of a changed row. Rows, repeated
    ones too, keep their number and their columns, whatever their names; an empty table gives no rows.
    """
    name, gaps, spans = temp_names(docs, "text_redacted", "text_gaps", "text_spans")
    own = docs.withColumnRenamed("secret_spans", temp_names(docs, "kept_spans")[0])
    scanned = scan_secrets(own).withColumnRenamed("secret_spans", spans)
    body, changed = F.col("text"), F.size(spans) > 0
    # a span opens a gap's end unless an earlier one reaches to or beyond its start
    reach = running_maximum(F.transform(spans, lambda x: x["end"]))
    joined = F.zip_with(F.col(spans), reach, lambda x, r: F.struct(r.alias("start"), x["start"].alias("end")))
    opening = F.filter(joined, lambda g: (g["end"] >= g["start"]))
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    all_gaps = F.concat(opening, F.array(F.struct(last.alias("start"), F.length(body).alias("end"))))
    step = scanned.withColumn(gaps, F.when(changed, all_gaps))
    new = step.withColumn(name, F.when(changed, kept_text(body, F.col(gaps), mark)).otherwise(body))
    columns = []
    for c, there in zip(docs.columns, own.columns):
        value = column(there)
        if c == "text":
            value = F.col(name)
        elif c == "n_chars":
            value = F.when(changed, F.length(name)).otherwise(value).cast(docs.schema["n_chars"].dataType)
        columns.append(value.alias(c))
    return new.select(*columns)


def plain_spans(text: str | None, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """What ``scan_secrets`` finds in one text, for comparison on small tables."""
    out = []
    for rank, rule in enumerate(rules):
        out += [(m.start(), rank, m.end()) for m in re.finditer(rule.pattern, text or "", re.ASCII) if len(m.group(rule.group)) >= rule.least]
    return [(rules[rank].kind, start, end) for start, rank, end in sorted(out)]


def spans_sql(rule: Rule, rank: int) -> str:
    """A list of (start, rank, end) of the rule's matches in ``body``: each starts behind the gaps and matches before it."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    found, gaps = f"regexp_extract_all(body, {pattern}, 0)", f"regexp_split_to_array(body, {pattern})"
    size = f"length(regexp_extract_all(body, {pattern}, {rule.group})[i])"
    before = f"list_sum(list_transform({gaps}[:i], lambda x: length(x))) + coalesce(list_sum(list_transform({found}[:i - 1], lambda x: length(x))), 0)"
    one = f"{{'start': ({before})::BIGINT, 'rank': {rank}, 'end': ({before} + length({found}[i]))::BIGINT}}"
    return f"list_transform(list_filter(range(1, len({found}) + 1), lambda i: {size} >= {rule.least}), lambda i: {one})"


def report_sql(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> str:
    """The report in SQL."""
    lists = ", ".join(f"{spans_sql(r, i)} AS s{i}" for i, r in enumerate(rules))
    every = " || ".join(f"s{i}" for i in range(len(rules)))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = f"array_to_string(list_transform({{0}}, lambda x: {kinds}[x.rank + 1] || ':' || x.start || ':' || x.end), ',')"
    counts = ", ".join(f"len(s{i})::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    base = f"list_filter(spans, lambda x: x.rank < {len(BASE_RULES)})"
    return f"""WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), found AS (SELECT doc_id, {lists} FROM bodies),
sorted AS (SELECT *, list_sort({every}) AS spans FROM found)
SELECT doc_id, {counts}, sha256(coalesce({text.format(base)}, '')) AS base_sha256, coalesce({text.format('spans')}, '') AS spans FROM sorted"""


REPORT_SQL = report_sql()
