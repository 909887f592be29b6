"""Personal data: base patterns and bootstrapped contextual extraction, with DataFrame functions only.

Base matches are the seed entities. Lexical patterns are labels right before a
value (letters and one of ``: = #``), the one or two words before a value and the
word after one. The values of a pattern are its instances; those without a digit
or an @ are ordinary words, which are only counted, place by place. On the graph of
patterns and distinct values, scores go back and forth: a pattern's confidence in
a kind is the mean score of its instances (ordinary places score 0), a value's
score is 1 for a seed, else one less the chance that all its patterns err.
Patterns whose ordinary places alone keep them under ``MIN_CONFIDENCE`` are left
out of the graph. Patterns whose instances' scores add up to ``MIN_SEEDS`` and
whose confidence is ``MIN_CONFIDENCE`` after the last round tag the values they
stand at that the base patterns missed, so discovered values may vouch for further
patterns. A value is a run without blanks, or groups of digits, brackets, hyphens
and dots with a blank (or a sign between blanks) between them; it ends before a
base match. For a phone or a card the groups go on up to the kind's number of
digits; other kinds hold no blanks. Values, labels and words have no greatest
length. All steps are aggregations and equi-joins, combined on the map side; no
text is written or shuffled, and nothing is broadcast but what Spark itself finds
small enough.

The regular expressions match what the plain forms match, but start only where a
run begins and never give back, so a long run of one class costs linear time.
Positions are code points: a match begins after the pieces before it that
``split`` leaves and the matches before it, summed up in runs of the square root of
their number.

Defined results: null text is empty and has no spans; repeated rows get the same
spans; rows with a null id are told apart by their text; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
ROUNDS = 3

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TRIGGER = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_BLANK = r"[ \t-\r]"
_INK = r"[^ \t-\r]"
_END = r"(?=[ \t-\r.,;:\])>\"']|\z)"
#: Groups of digits as phone and card numbers have them; each ends where a word ends.
_NUMBER = rf"[+(]*+[0-9][0-9().-]*+{_END}(?:(?: [-./])?+ \(?+[0-9][0-9().-]*+{_END})*+"
_LABEL = rf"(?<![\p{{L}}_])([\p{{L}}_]{{2,}}+ ?+[:=#] ?+)({_NUMBER}|[^ \t-\r:=#]{_INK}*+)"
_WORD = r"[\p{L}_][\p{L}\p{M}_'-]*+"
#: A value that holds a digit or an @.
_VALUE = rf"(?<!{_INK})(?=[^ \t-\r0-9@]*+[0-9@])(?:{_NUMBER}|{_INK}++)"
_BACKWARDS = r"([\p{L}\p{M}_'-]*+)(?<=[\p{L}_])(?![^ \t-\r])"
#: One or two words at the end of a text that is read backwards.
_LAST = rf"^{_BLANK}++{_BACKWARDS}(?:{_BLANK}++{_BACKWARDS})?"
#: The word after what is left of a value's token.
_NEXT = rf"^{_INK}*+{_BLANK}++({_WORD})(?!{_INK})"
#: Patterns of words after a value begin so.
_MARK = "~ "
#: Punctuation at the end, with and without brackets; a run is met at its beginning only.
_TRAILING = r"(?<![.,;:)>\]\"'])[.,;:)>\]\"']++$"
_OPEN_TRAILING = r"(?<![.,;:>\]\"'])[.,;:>\]\"']++$"
_BLOCK = 64
#: How many digits a discovered value of a kind may hold; other kinds hold no blanks.
MOST_DIGITS = {"card": 19, "phone": 15}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(back)),
        lambda i: (F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _running(sizes: Column) -> Column:
    """What is before each of the sizes, summed; by runs, as one array grown step by step takes quadratic time."""

    def within(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    run = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    # without sizes the one run is empty
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), run), lambda i: F.slice(sizes, i + 1, run))
    begins = within(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(parts, begins, within))


def _positions(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, value) of the matches ``found`` of ``pattern``, in code points."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    before = _running(F.zip_with(gaps, found, lambda g, v: F.length(g) + F.length(v)))

    def place(x: Column) -> Column:
        start = x["at"] + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    placed = F.transform(F.arrays_zip(before.alias("at"), gaps.alias("gap"), found.alias("value")), place)
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _trimmed(value: Column) -> Column:
    """Without punctuation at the end; a bracket that closes one of the value stays."""
    closed = value.rlike(r"\([^()]*\)[.,;:>\]\"']*$")
    return F.when(closed, F.regexp_replace(value, _OPEN_TRAILING, "")).otherwise(F.regexp_replace(value, _TRAILING, ""))


def _shaped(kind: Column, value: Column) -> Column:
    """The part of the value that has the kind's shape: its first groups, as far as the kind's digits go."""
    most = F.create_map(*(x for k, n in MOST_DIGITS.items() for x in (F.lit(k), F.lit(n))))[kind]
    groups = F.split(value, " ")

    def step(acc: Column, g: Column) -> Column:
        longer = F.concat(acc["out"], F.lit(" "), g)
        goes_on = acc["on"] & (F.length(_digits(longer)) <= most)
        return F.struct(F.when(goes_on, longer).otherwise(acc["out"]).alias("out"), goes_on.alias("on"))

    first = F.get(groups, 0)
    # each group but a sign holds a digit, so no more of them can be taken
    some = F.slice(groups, 2, 2 * max(MOST_DIGITS.values()))
    numbered = F.aggregate(some, F.struct(first.alias("out"), F.lit(True).alias("on")), step)["out"]
    return _trimmed(F.regexp_replace(F.when(most.isNull(), first).otherwise(numbered), r" [-./]$", ""))


def _key(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key): an id and a text's hash name the rows that get the same spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def base_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base) of every row: an array of (rank, kind, start, end)."""
    none = F.array().cast("array<string>")
    docs = _key(documents, id_col, text_col)
    found = (F.when(F.col("text").rlike(_TRIGGER[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"_{k}") for k in KINDS)
    docs = docs.select("doc_id", "text", "key", *found)

    def spans(k: str) -> Column:
        held = F.filter(_positions(F.col("text"), PATTERNS[k], F.col(f"_{k}")), lambda s: _holds(k, s["value"]))
        return F.transform(held, lambda s: _span(F.lit(k), s["start"], s["end"]))

    return docs.select("doc_id", "key", F.concat(*map(spans, KINDS)).alias("base"))


def _span(kind: Column, start: Column, end: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    return F.struct(rank.alias("rank"), kind.alias("kind"), start.alias("start"), end.alias("end"))


# --- patterns and their instances -------------------------------------------------------------


def _sliced(docs: DataFrame, pattern: str, *, placed: bool) -> DataFrame:
    """(doc_id, key, value, gap, rest, at) of each match, between the gap and the rest, with what is before the gap if ``placed``."""
    docs = docs.select("doc_id", "key", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("gaps")).filter(F.size("found") > 0)
    gaps, n = F.slice("gaps", 1, F.size("found")), F.size("found")
    parts = [F.col("found").alias("value"), gaps.alias("gap"), F.slice("gaps", 2, n).alias("rest")]
    if placed:
        parts.append(_running(F.zip_with(gaps, "found", lambda g, v: F.length(g) + F.length(v))).alias("at"))
    return docs.select("doc_id", "key", F.explode(F.arrays_zip(*parts)).alias("p")).select("doc_id", "key", "p.*")


def _places(docs: DataFrame, *, placed: bool = False) -> DataFrame:
    """(doc_id, key, patterns, value and, if ``placed``, start) of each value at a label, or at words if it holds a digit or an @."""
    text, start = F.col("text"), [(F.col("at") + F.length("gap")).alias("start")] * placed
    words = _sliced(docs.filter(text.rlike("[0-9@]")), _VALUE, placed=placed)
    back = F.reverse("gap")
    words = words.select("*", F.lower(F.reverse(F.regexp_extract(back, _LAST, 1))).alias("one"), F.lower(F.reverse(F.regexp_extract(back, _LAST, 2))).alias("two"), F.lower(F.regexp_extract("rest", _NEXT, 1)).alias("next"))
    one, two, after = (F.when(F.col(c) != "", F.col(c)) for c in ("one", "two", "next"))
    patterns = F.array_compact(F.array(one, F.concat(two, F.lit(" "), one), F.concat(F.lit(_MARK), after)))
    words = words.select("doc_id", "key", patterns.alias("patterns"), "value", *start)
    labels = _sliced(docs.filter(text.rlike(r"[\p{L}_] ?[:=#]")), _LABEL, placed=placed).withColumn("label", F.regexp_extract("value", f"^{_LABEL}", 1))
    start = [(F.col("at") + F.length("gap") + F.length("label")).alias("start")] * placed
    name, value = F.lower(F.regexp_replace("label", " ", "")), F.expr("substring(value, length(label) + 1)")
    return words.unionByName(labels.select("doc_id", "key", F.array(name).alias("patterns"), value.alias("value"), *start))


def _instance(value: Column) -> tuple[Column, Column]:
    """(the kind that the value is a seed of, or null; the value as an instance)."""
    kind, told = F.lit(None).cast("string"), _trimmed(value)
    for k in reversed(KINDS):
        seed = F.regexp_extract(value, f"^(?:{PATTERNS[k]})", 0)
        is_seed = value.rlike(_TRIGGER[k]) & (seed != "") & _holds(k, seed)
        kind, told = F.when(is_seed, F.lit(k)).otherwise(kind), F.when(is_seed, seed).otherwise(told)
    return kind, told


def _edges(docs: DataFrame) -> DataFrame:
    """(pattern, value, kind, n) of each pattern and distinct value, written; the places at ordinary words have a null value."""
    shown = F.when(F.col("value").rlike("[0-9@]"), F.col("value")).alias("value")
    rows = _places(docs).select(F.explode("patterns").alias("pattern"), shown)
    raw = rows.groupBy("pattern", "value").agg(F.count("*").alias("n"))
    kind, told = _instance(F.col("value"))
    return written(raw.select("pattern", told.alias("value"), kind.alias("kind"), "n").groupBy("pattern", "value", "kind").agg(F.sum("n").alias("n")), "pii-edges")


def _word_places(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(pattern, places): how often the words stand before, or after, any token."""
    docs = docs.select(F.array_remove(F.split(F.lower("text"), f"{_BLANK}+"), "").alias("t")).filter(F.size("t") > 1)
    none, n = F.array(F.lit(None).cast("string")), F.size("t")
    tokens = F.arrays_zip(F.col("t").alias("word"), F.concat(none, F.slice("t", 1, n - 1)).alias("before"), F.concat(F.slice("t", 2, n - 1), none).alias("after"))
    tokens = docs.select(F.explode(tokens).alias("p")).select("p.*")
    tokens = tokens.join(words.select(F.substring_index("pattern", " ", -1).alias("word")).distinct(), "word")
    before = F.when(F.col("after").isNotNull(), F.array(F.col("word"), F.concat("before", F.lit(" "), "word")))
    after = F.when(F.col("before").isNotNull(), F.array(F.concat(F.lit(_MARK), "word")))
    none = F.array().cast("array<string>")
    rows = tokens.select(F.explode(F.array_compact(F.concat(F.coalesce(before, none), F.coalesce(after, none)))).alias("pattern"))
    return rows.join(words.select("pattern"), "pattern").groupBy("pattern").agg(F.count("*").alias("places"))


def pattern_confidence(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """(pattern, kind, confidence, mass) after ``rounds`` rounds on the graph of the patterns that can reach ``min_confidence``."""
    docs = _key(documents, id_col, text_col)
    edges = _edges(docs)
    # only so many distinct values can add up to min_seeds
    shown = edges.groupBy("pattern").agg(
        F.count_if(F.col("value").isNotNull()).alias("values"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("shown"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("ordinary"),
    )
    able = written(shown.filter((F.col("values") >= min_seeds) & (F.col("values") >= min_confidence * (F.col("values") + F.col("ordinary")))), "pii-able")
    is_label = F.col("pattern").rlike("[:=#]$")
    labels = able.filter(is_label).select("pattern", (F.col("values") + F.col("ordinary")).alias("total"))
    words = able.filter(~is_label)
    if words.isEmpty():
        total = labels
    else:
        counted = words.join(_word_places(docs, words), "pattern")
        ordinary = F.greatest(F.col("places") - F.col("shown"), F.lit(0))
        counted = counted.withColumn("total", F.col("values") + ordinary).filter(F.col("values") >= min_confidence * F.col("total"))
        total = labels.unionByName(counted.select("pattern", "total"))
    total = written(total, "pii-totals")
    edges = written(edges.filter("value is not null").join(total.select("pattern"), "pattern", "left_semi"), "pii-graph")
    seeds = edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    edges, score, confidence = edges.select("pattern", "value"), seeds, None
    for _ in range(rounds):
        mass = edges.join(score, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        confidence = written(mass.join(total, "pattern").select("pattern", "kind", (F.col("mass") / F.col("total")).alias("confidence"), "mass"), "pii-patterns")
        wrong = F.exp(F.sum(F.log1p(F.greatest(-F.col("confidence"), F.lit(-0.999999)))))
        learnt = edges.join(confidence, "pattern").groupBy("value", "kind").agg((1 - wrong).alias("score"))
        score = learnt.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return confidence


def _discovered(documents: DataFrame, base: DataFrame, best: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, new): the spans of the values at the patterns of ``best`` that no base match touches."""
    docs = _key(documents, id_col, text_col)
    found = _places(docs, placed=True).filter(F.col("value").rlike("[0-9@]"))
    found = found.select("doc_id", "key", "start", "value", F.explode("patterns").alias("pattern")).join(best, "pattern")
    found = written(found.select("doc_id", "key", "start", "value", "kind").distinct(), "pii-found")
    # base matches and values meet by blocks of the text
    end = F.col("start") + F.length("value")
    blocks = F.sequence(F.floor(F.col("start") / _BLOCK), F.floor((end - 1) / _BLOCK))
    values = found.select("*", end.alias("end"), F.explode(blocks).alias("block"))
    spans = base.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.explode("base").alias("s")).select("_id", "_key", F.col("s.start").alias("_start"), F.col("s.end").alias("_end"))
    spans = spans.distinct().select("*", F.explode(F.sequence(F.floor(F.col("_start") / _BLOCK), F.floor((F.col("_end") - 1) / _BLOCK))).alias("_block"))
    meet = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")) & (F.col("_start") < F.col("end")) & (F.col("_end") > F.col("start"))
    cut = values.join(spans, meet, "left").groupBy("doc_id", "key", "start", "value", "kind").agg(F.min("_start").alias("cut"))
    # groups of digits end before the first base match among them
    whole = F.col("cut").isNull()
    later = F.col("cut") > F.col("start") + F.length(F.substring_index("value", " ", 1))
    short = F.substring(F.col("value"), F.lit(1), F.col("cut") - F.col("start"))
    value = _trimmed(F.regexp_replace(F.when(whole, F.col("value")).otherwise(short), r"(?: [-./])? $", ""))
    new = cut.filter(whole | later).select("doc_id", "key", "kind", "start", _shaped(F.col("kind"), value).alias("value")).filter(F.col("value").rlike("[0-9@]"))
    return new.groupBy("doc_id", "key").agg(F.collect_set(_span(F.col("kind"), F.col("start"), F.col("start") + F.length("value"))).alias("new"))


def find_personal_data(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (rank, kind, start, end), base matches and those with the discovered ones."""
    base = written(base_spans(documents, id_col=id_col, text_col=text_col), "pii-base")
    sure = pattern_confidence(documents, id_col=id_col, text_col=text_col, min_seeds=min_seeds, min_confidence=min_confidence, rounds=rounds)
    sure = sure.filter((F.col("confidence") >= min_confidence) & (F.col("mass") >= min_seeds))
    best = written(sure.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")), "pii-best")
    if best.isEmpty():
        return base.select("doc_id", "base", F.sort_array("base").alias("spans"))
    new = _discovered(documents, base, best, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "new")
    joined = base.join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    everything = F.concat("base", F.coalesce("new", F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>")))
    return joined.select("doc_id", "base", F.sort_array(everything).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from :func:`find_personal_data`; counts are of base matches, ``n_spans`` of all spans."""

    def told(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
