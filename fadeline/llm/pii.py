"""Personal data, by DataFrame expressions only: regular expressions, then bootstrapped contextual extraction.

The base expressions find e-mail and IP addresses, card and phone numbers. Their finds are the seeds:
the words around them are lexical patterns, and patterns and instances form a bipartite graph. Round by
round a pattern is scored by the share of its known instances that are of one kind, and an instance by
the patterns that it occurs with. Identifiers that no base expression matches, but that stand with
high-confidence patterns, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import discard, materialise, row_key

KINDS = ("email", "ip", "card", "phone")
#: Marks of the contexts: two words before, one before, one after.
CONTEXTS = ("2<", "1<", "1>")
#: Code points at either side of a span that its contexts are first read from, and then, where a word is not whole in them, from more, at last from all.
CONTEXT = (256, 4096, 65536)
#: Rounds of scoring; what a pattern needs to count: distinct known instances of one kind, and their share of the known.
ROUNDS, LEAST_SEEDS, LEAST_SCORE = 3, 5, 0.9

# Matches of the same language as the plain expressions, written so that neither runs of one character
# class (possessive, anchored at the run's start or the last match's end) nor thousands of repeats
# (atomic groups of bounded repeats) make the engine backtrack or recurse deeply.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EXPRESSIONS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?>(?:\.{_LABEL}++){{1,500}})+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?>[0-9](?:[\x20-]?[0-9]){11})(?>(?:[\x20-]?[0-9]){1,500})*",  # 12 digits or more: shorter ones fail anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier of another form: a spelt address (one at two dot three), or a whole run of letters, digits and . / - that holds three digits or two parts with a dot between.
_AT, _DOT = (rf"(?:\s?[\[(]{w}[\])]\s?|\s{w}\s)" for w in ("at", "dot"))
_SPELT = rf"(?i:{_LOCAL}++{_AT}{_LABEL}++(?>(?:{_DOT}{_LABEL}++){{1,500}})+)"
_RUN = r"(?=[A-Za-z/-]*+[0-9.])(?:(?=(?:[A-Za-z./-]*+[0-9]){3})[A-Za-z0-9./-]++|(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])(?=[0-9.-]*+[A-Za-z])[A-Za-z0-9.-]++(?!/))"
IDENTIFIER, WITH_SPELT = rf"(?<![A-Za-z0-9./-]){_RUN}", rf"(?<![A-Za-z0-9./-])(?:{_SPELT}|{_RUN})"
#: Texts that may hold a spelt address; only those are searched for one.
_SPELLS = r"(?i:[\s\[(]dot[\s\])])"
#: What a text must hold for its expression to be tried.
_NEEDS = {"email": "@", "phone": "+"}


EMPTY = "cast(array() as array<struct<start: int, end: int, kind: string, value: string>>)"


def _scan(a: Column, op) -> Column:
    """op over each prefix of the array, by doubling: n log n steps and no array that grows element by element."""
    far = lambda k: F.call_function("shiftleft", F.lit(1), k)
    step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= far(k), op(x, F.get(acc, i - far(k)))).otherwise(x))
    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1)
    return let(a, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, step)).otherwise(v))


def _spans(text: Column, kind: str, expression: Column) -> Column:
    """array<struct<start,end,kind,value>> of the matches; positions in code points, end exclusive.

    The pieces between the matches give the positions: each match starts where the pieces and matches
    before it end.
    """

    def placed(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, expression, -1), 1, F.size(found)), found, lambda piece, value: F.length(piece) + F.length(value))
        own = lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.when(F.size(found) > 0, F.zip_with(_scan(lengths, lambda a, b: a + b), found, own)).otherwise(F.expr(EMPTY))

    needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]" if kind else rf"[0-9]|[A-Za-z]\.[A-Za-z]|{_SPELLS}")
    return F.when(needed, let(F.regexp_extract_all(text, expression, F.lit(0)), placed)).otherwise(F.expr(EMPTY))


def _trimmed(spans: Column) -> Column:
    """Spans without the . / - at their ends."""

    def one(s: Column) -> Column:
        marks = F.lit("./-")
        start, end = s["start"] + F.length(s["value"]) - F.length(F.ltrim(s["value"], marks)), s["end"] - F.length(s["value"]) + F.length(F.rtrim(s["value"], marks))
        return F.struct(start.alias("start"), end.alias("end"), s["kind"].alias("kind"), F.trim(s["value"], marks).alias("value"))

    return F.transform(spans, one)


def _apart(others: Column, base: Column) -> Column:
    """The spans of `others` that overlap none of `base`: in order of start, no end before reaches them and no start after lies in them."""
    last = F.lit(2**31 - 1)
    marked = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["value"].alias("value")))

    def free(every: Column) -> Column:
        ends = _scan(F.transform(every, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), F.greatest)
        starts = F.reverse(_scan(F.reverse(F.transform(every, lambda s: F.when(s["own"], last).otherwise(s["start"]))), F.least))
        kept = let(ends, lambda e: let(starts, lambda b: F.filter(every, lambda s, i: s["own"] & (F.get(e, i) <= s["start"]) & (F.get(b, i) >= s["end"]))))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("kind"), s["value"].alias("value")))

    every = F.array_sort(F.concat(marked(base, False), marked(others, True)))
    return F.when((F.size(others) == 0) | (F.size(base) == 0), others).otherwise(let(every, free))


def _chunked(text: Column, body) -> Column:
    """body(part), where part(start, end) is text from start to end at a cost that does not depend on where it lies."""
    part = lambda chunks: lambda start, end: F.when(end > start, F.substring(F.array_join(F.slice(chunks, F.shiftright(start, 8) + 1, F.shiftright(end - 1, 8) - F.shiftright(start, 8) + 1), ""), F.pmod(start, F.lit(256)) + 1, end - start)).otherwise("")
    return let(F.regexp_extract_all(text, F.lit("(?s).{1,256}"), F.lit(0)), lambda chunks: body(part(chunks)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    figures = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    worth = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(span: Column) -> Column:
    value, kind = span["value"], span["kind"]
    n = F.length(_digits(value))
    part_ok = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    parts = F.split(value, r"\.")
    ip = F.forall(parts, lambda p: part_ok(p) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    return F.when(kind == "ip", ip).when(kind == "card", n.between(12, 19) & _luhn(value)).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _sorted(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _contexts(text: Column, part, start: Column, end: Column) -> Column:
    """The two words before a span, the one before and the one after, as far as there are any; folded: lower case, digits as 0.

    Words are runs without white space, so that punctuation is part of a context.
    """
    fold = lambda c: F.lower(F.translate(c, "123456789", "000000000"))
    two_before, one_before, one_after = r"(?<=\s)(\S++\s++\S++)\s*+$", r"(?<=\s)(\S++)\s*+$", r"^\s*+(\S++)(?=\s)"

    def grown(take, whole, sizes: tuple[int, ...] = CONTEXT) -> Column:
        """What take gives for the first of the sizes that holds the words whole, or for none: all there is. Only what stands beside long words is read again."""
        if not sizes:
            return take(None)
        return let(take(sizes[0]), lambda c: F.when(whole(c, sizes[0]), c).otherwise(grown(take, whole, sizes[1:])))

    def left(size: int | None) -> Column:
        all_ = F.concat(F.lit(" "), part(F.lit(0), start))
        return all_ if size is None else F.when(start > size, part(start - size, start)).otherwise(all_)

    def right(size: int | None) -> Column:
        all_ = F.concat(part(end, F.length(text)), F.lit(" "))
        return all_ if size is None else F.when(end + size < F.length(text), part(end, end + size)).otherwise(all_)

    before = grown(left, lambda c, size: (start <= size) | c.rlike(two_before))
    after = grown(right, lambda c, size: (end + size >= F.length(text)) | c.rlike(one_after))

    def found(before: Column, after: Column) -> Column:
        two = F.regexp_replace(F.regexp_extract(before, two_before, 1), r"\s+", " ")
        words = F.array(two, F.regexp_extract(before, one_before, 1), F.regexp_extract(after, one_after, 1))
        marked = F.transform(words, lambda w, k: F.when(w != "", F.concat(F.element_at(F.array(*map(F.lit, CONTEXTS)), k + 1), w)))
        return F.filter(marked, lambda p: p.isNotNull())

    return let(fold(before), lambda b: let(fold(after), lambda a: found(b, a)))


def spans(docs: DataFrame) -> DataFrame:
    """docs plus `base` (valid base spans in order) and `others` (identifiers that overlap none of them)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for kind, expression in EXPRESSIONS.items():
        docs = docs.withColumn(f"_{kind}", _spans(text, kind, F.lit(expression)))
    docs = docs.withColumn("base", _sorted(F.filter(F.concat(*(F.col(f"_{k}") for k in KINDS)), _valid))).drop(*(f"_{k}" for k in KINDS))
    return docs.withColumn("others", let(_trimmed(_spans(text, "", F.when(text.rlike(_SPELLS), WITH_SPELT).otherwise(IDENTIFIER))), lambda others: let(F.col("base"), lambda base: _apart(others, base))))


def discovered(instances: DataFrame) -> DataFrame:
    """(row, start, end, kind) of the identifiers that high-confidence patterns add.

    instances has row, start, end, value, kind (null if unknown) and patterns. A pattern's score for a kind
    is the sum of its distinct instances' scores for it, over one more than the sum for all kinds: what is
    unknown of an instance speaks neither for nor against its pattern. An instance of unknown kind scores
    the noisy-or of its patterns that count. An identifier takes the kind of its best pattern.
    """
    edges = materialise(instances.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct(), "pattern-instances")
    seeds = edges.filter("kind is not null").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    unknown = edges.filter("kind is null").select("pattern", "value")
    known, patterns, old = seeds, None, []
    for _ in range(ROUNDS):
        scored = known.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.sum((F.col("score") >= LEAST_SCORE).cast("int")).alias("seeds"))
        kinds = F.collect_list(F.struct("kind", "mass", "seeds")).alias("kinds")  # at most one entry a kind
        scored = scored.groupBy("pattern").agg(F.sum("mass").alias("n"), kinds)
        scored = scored.select("pattern", "n", F.inline("kinds")).withColumn("confidence", F.col("mass") / (F.col("n") + 1))
        patterns = scored.filter((F.col("seeds") >= LEAST_SEEDS) & (F.col("mass") >= LEAST_SCORE * F.col("n"))).select("pattern", "kind", "confidence")
        patterns = materialise(patterns, "patterns")  # cuts lineage, and lets a frequent pattern's instances be split over tasks
        discard(*old)
        old = [patterns]
        new = unknown.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        new = unknown.join(new.filter(F.col("score") >= LEAST_SEEDS / (LEAST_SEEDS + 1)), "value").select("pattern", "value", "kind", "score")
        known = seeds.unionByName(new)
    found = instances.filter("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    return found.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))


def find_pii(docs: DataFrame, *carried: Column) -> DataFrame:
    """Every row of docs as (row, doc_id, text_key, carried..., base, spans): base spans, and all spans with the added ones.

    Spans are structs (start, order, end, kind, value) in order of start and kind; null and empty texts
    have none. Rows are told apart by a number of their own, so that null and repeated doc_ids and wholly
    repeated rows do no harm; other columns are not looked at. A text with very many spans costs in
    proportion to its length, and to their number times its logarithm.
    """
    own = docs.select(*row_key(F.col("doc_id"), F.col("text")), *carried, "text").withColumn("row", F.monotonically_increasing_id())
    names = [c for c in own.columns if c not in ("text", "row")]
    parts = materialise(spans(own).select("row", *names, "base", _candidates()), "pii")
    added = discovered(parts.select("row", F.inline("candidates")))
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", F.col("end"), "kind", F.lit("").alias("value"))).alias("added"))
    added = materialise(added, "added")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(_sorted(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))), F.col("added"))))
    return parts.drop("candidates").join(added, "row", "left").select("row", *names, "base", every.alias("spans"))


def _candidates() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))

    def slim(column: Column, kind, part) -> Column:
        one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"), F.lower(s["value"]).alias("value"), _contexts(text, part, s["start"], s["end"]).alias("patterns"))
        return F.transform(column, one)

    own = _chunked(text, lambda part: F.concat(slim(F.col("base"), lambda s: s["kind"], part), slim(F.col("others"), lambda s: F.lit(None).cast("string"), part)))
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string, value: string, patterns: array<string>>>)")
    return F.when(F.size("base") + F.size("others") > 0, F.filter(own, lambda s: F.size(s["patterns"]) > 0)).otherwise(none).alias("candidates")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by <kind>, n_chars of those texts set anew. Keeps all rows and columns.

    Of spans that overlap the one that starts first gives the name, and all that they cover goes.
    """
    found = find_pii(docs, F.struct("*").alias("doc"))
    text = F.col("doc.text")

    def put(spans: Column, ends: Column, part) -> Column:
        at = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= at(i), F.concat(part(at(i), s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(ends, -1), F.length(text)))

    ends = lambda spans: _scan(F.transform(spans, lambda s: s["end"]), F.greatest)
    whole = let(F.col("spans"), lambda s: let(ends(s), lambda e: _chunked(text, lambda part: put(s, e, part))))
    any_ = F.size("spans") > 0
    out = found.withColumn("new", F.when(any_, whole).otherwise(text))
    value = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in value:
        value["n_chars"] = F.when(any_, F.length("new")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(value[c].alias(c) for c in docs.columns))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, counts of base spans by kind, base_sha256, spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
