"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base: four patterns, leftmost non-overlapping matches of each kind, those that fail its check dropped.  Start and end are
code points, summed from the lengths of the matches and of the text between them.

Contextual: base spans are the seeds.  The one and the two words before a span are its lexical patterns (of its kind); a word
of over 40 characters is no lexical pattern.  Strings of a looser shape that no base span touches are candidates, with the same
patterns.  Over the graph of patterns and instances, seeds are accepted values from the start.  In each round, a pattern that
introduces LEAST_SEEDS distinct accepted values at least has a confidence: the occurrences of accepted values that it
introduces, over all occurrences of its words in all documents (as words or as the start of one, where a
value may follow).  A candidate value's score is 1 - product of (1 - confidence) over its patterns; with LEAST_SCORE at least
it is accepted, counts for its other patterns as a seed does and so brings in new ones.  Rounds end when none accepts another value; as no
value is ever given up, they do end.  Accepted candidates become spans.

Counts are over all documents.  Occurrences are counted before they meet the patterns: what a map of fixed size (BITMAP
bits, sent to all tasks) lets pass is summed by cue, so a word that is everywhere is one row a task.  Values and patterns
are likewise summed before any join.

Defined cases: null text is the empty text, with no spans; repeated rows are found each for itself; ties cannot arise, as
spans are ordered by kind, start and end; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS, LEAST_SCORE = 5, 0.8
#: Bits of the map of patterns that words are tested against before they are counted.
BITMAP = 1 << 22
#: A match starts where a run of its first characters starts, or where the match before it ended; so a run is tried once.
_AT = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)", "digit": r"(?:(?<![0-9])|\G)"}
BASE = {
    "email": _AT["email"] + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _AT["digit"] + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![^\s<(\[])[A-Za-z0-9._%+-]++[ ]?(?:@|\(at\)|\[at\]|\{at\})[ ]?[A-Za-z0-9-]++(?:[ ]?(?:\.|\(dot\)|\[dot\]|\{dot\})[ ]?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[\x20./-]\(?[0-9]{2,4}\)?){1,4}(?![0-9A-Za-z.-])",
}
#: Cheap tests of a whole text without which a pattern cannot match.
_HINT = {"email": "instr({t}, '@') > 0", "ip": r"{t} RLIKE '[0-9][.][0-9]'", "card": r"{t} RLIKE '[0-9][\\x20-]?[0-9]'", "phone": r"{t} RLIKE '[+][0-9]'"}
#: Documents in which a seed or candidate can be.
MARKED = r"[0-9@]|[(\[{]at[)\]}]"
#: Positions inside a word where a value may start: a run of digits or of an address's characters, a sign or bracket before a digit, groups of an IP.
_INSIDE = r"(?<=[^0-9\s])(?=[0-9])|(?<=\S)(?=[+(][0-9])|(?<=[^A-Za-z0-9._%+\s-])(?=[A-Za-z0-9._%+-])|(?<=[^0-9A-Fa-f:.\s])(?=[0-9A-Fa-f]{0,4}:)"
#: What a word holds at least where _INSIDE finds a place in it.
_SPECIAL = r"[^A-Za-z._%+-]"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _valid(kind: str, value: Column, loose: bool = False) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.lit(True) if loose else value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        whole = F.length(digits).between(13, 19)
        return whole if loose else whole & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(7 if loose else 9, 15)
    return F.lit(True)


def spans(text: Column, pattern: str, possible: Column, kind: str, loose: bool = False) -> Column:
    """Valid matches with start and end in code points."""
    none = F.array().cast("array<string>")
    hits = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    gaps = F.when(possible, F.split(text, pattern, -1)).otherwise(none)
    both = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("g"), F.length(h).alias("h"), h.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + x["h"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"], loose), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.filter(both, lambda x: x["h"].isNotNull()), start, step, lambda acc: acc["out"])


def _cues(text: Column, start: Column) -> Column:
    """The one and the two words before a position, lowered, as an array; a cut word is no word, so longer ones give none."""
    before = F.concat(F.lit(" "), F.substring(text, F.greatest(start - 95, F.lit(1)), F.least(start, F.lit(96))))
    one, two = (F.lower(F.regexp_extract(before, p, 1)) for p in (r"[\s](\S{1,40})\s*$", r"[\s](\S{1,40}\s+\S{1,40})\s*$"))
    return F.filter(F.array(one, F.regexp_replace(two, r"\s+", " ")), lambda c: c != "")


def _kinded(kind: str, array: Column) -> Column:
    return F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _base(t: Column) -> list[Column]:
    """The base spans of a text column, an array for each kind, named by it; `text` must be the column's name."""
    return [spans(t, BASE[k], F.expr(_HINT[k].format(t="text")), k).alias(k) for k in KINDS]


def _key() -> list[Column]:
    """Rows that share both have the same spans."""
    return [F.col("doc_id"), F.xxhash64("text").alias("h")]


def find(docs: DataFrame, *carried: str) -> DataFrame:
    """Each row of docs (doc_id, text) with its base spans, and seen: these and the free candidates, with their cues."""
    t = F.col("text")
    docs = docs.select(*carried, *_key(), F.coalesce(t, F.lit("")).alias("text")).select(*carried, "doc_id", "h", "text", *_base(t))
    every = F.concat(*KINDS)
    marked = t.rlike(MARKED)
    docs = docs.withColumn("loose", F.concat(*[_kinded(k, spans(t, LOOSE[k], marked, k, loose=True)) for k in KINDS]))
    free = F.filter("loose", lambda x: ~F.exists(every, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    known = F.concat(*[_kinded(k, F.col(k)) for k in KINDS])

    def with_cues(found: Column, seed: bool) -> Column:
        parts = ("kind", "start", "end", "value")
        return F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in parts), F.lit(seed).alias("seed"), _cues(t, x["start"]).alias("cues")))

    plain = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS]
    seen = F.concat(with_cues(known, True), with_cues(free, False)).alias("seen")
    return docs.select(*carried, "doc_id", "h", *plain, seen)


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def _said_cues(docs: DataFrame, able: DataFrame | None = None) -> DataFrame:
    """Occurrences of what _cues can give: each word and each start of it that a value may follow, alone and after the word before it.

    With able (cue), a word or start goes at once if it is none of able by a map of BITMAP bits, a table of BITMAP / 64 rows at
    most; a two-word cue counts only where its last word does, as that has all its values."""
    w = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    pairs = docs.select(F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), w).alias("last"), w.alias("word")))).where("word <> ''")
    parts = F.split(F.substring("word", 1, 46), _INSIDE, -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ""))
    starts = F.filter(starts, lambda x: (x != "") & (F.length(x) <= 40))
    many = F.col("word").rlike(_SPECIAL) & F.col("word").rlike(_INSIDE)
    said = pairs.select("last", F.explode(F.when(many, F.concat(F.array("word"), starts)).otherwise(F.array("word"))).alias("one"))
    two = F.when(F.col("last") != "", F.concat("last", F.lit(" "), "one"))
    cues = F.explode(F.array_compact(F.array("one", two))).alias("cue")
    if able is None:
        return said.select(cues)
    mask = F.expr("shiftleft(1L, cast(b % 64 as int))")
    words = able.select(_bit("cue").alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(mask).alias("bits"))

    def passing(rows: DataFrame, column: str) -> DataFrame:
        tested = rows.withColumn("b", _bit(column)).withColumn("w", F.floor(F.col("b") / 64)).join(F.broadcast(words), "w")
        return tested.where(F.col("bits").bitwiseAND(mask) != 0).select(rows.columns)

    return passing(passing(said, "one").select(cues), "cue")


def _graph(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """kind, cue, value, seed, n (occurrences of the value behind the cue), total (occurrences of the cue): cues of LEAST_SEEDS values at least."""
    edges = seen.select("kind", "value", "seed", F.explode("cues").alias("cue")).groupBy("kind", "cue", "value", "seed").agg(F.count("*").alias("n"))
    edges = stored(edges, "edges")
    able = edges.groupBy("kind", "cue").agg(F.countDistinct("value").alias("values"), F.sum("n").alias("least"))
    able = stored(able.where(F.col("values") >= LEAST_SEEDS).drop("values"), "patterns")
    total = _said_cues(docs, able.select("cue").distinct()).groupBy("cue").agg(F.count("*").alias("total"))
    # a value that starts where _INSIDE does not look (after another match) is an occurrence too
    totals = able.join(total, "cue", "left").select("kind", "cue", F.greatest("total", "least").alias("total"))
    return stored(edges.join(totals, ["kind", "cue"]), "graph")


def accepted_values(graph: DataFrame) -> DataFrame:
    """kind, value of the candidates that the rounds accept."""
    known = graph.where("seed").select("kind", "value").distinct()
    found, n = None, 0
    while True:
        every = known if found is None else known.unionByName(found).distinct()
        trusted = graph.join(every, ["kind", "value"])
        trust = trusted.groupBy("kind", "cue").agg(F.least(F.lit(1.0), F.sum("n") / F.first("total")).alias("trust"), F.countDistinct("value").alias("values"))
        trust = trust.where(F.col("values") >= LEAST_SEEDS).select("kind", "cue", "trust")
        doubt = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        scores = graph.where("NOT seed").join(trust, ["kind", "cue"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("score"))
        found, before = stored(scores.where(F.col("score") >= LEAST_SCORE).select("kind", "value"), "accepted"), n
        n = found.count()  # trust never falls, so none is given up
        if n == before:
            return found


def contextual(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, end of the candidates that the graph accepts."""
    seen = found.where(F.size("seen") > 0).select("doc_id", "h", F.explode("seen").alias("s")).select("doc_id", "h", "s.*")
    accepted = accepted_values(_graph(docs, seen))
    return seen.where("NOT seed").join(accepted, ["kind", "value"], "left_semi").select("doc_id", "h", "kind", "start", "end")


_MORE = "array<struct<kind:string,start:int,end:int>>"


def additions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows' keys (doc_id, h) with their added spans, for the few that have any; stored, so that Spark knows the size."""
    return stored(contextual(docs, found).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more")), "added")


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    more = more.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "more")
    both = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    return both.withColumn("more", F.coalesce("more", F.array().cast(_MORE))).drop("_d", "_h", "h")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, an array of {start, end} for each kind (base), and more: {kind, start, end} that the contexts add; one row for each of docs."""
    docs = docs.select("doc_id", "text")
    found = stored(find(docs), "found")
    return _with_more(found.drop("seen"), additions(docs, found))


def _said(kind: str, array: Column) -> Column:
    return F.transform(array, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))


def _of(kind: str) -> Column:
    added = F.transform(F.filter("more", lambda x: x["kind"] == kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.array_sort(F.concat(F.col(kind), added))


def report(found: DataFrame) -> DataFrame:
    base = F.concat_ws(",", F.concat(*[_said(k, F.col(k)) for k in KINDS]))
    every = F.concat_ws(",", F.concat(*[_said(k, _of(k)) for k in KINDS]))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def masked(text: Column) -> Column:
    """text with each span of the columns of personal_data() replaced by its kind in brackets; overlapping spans are one, named by the first."""
    def named(kind: str) -> Column:
        return F.transform(_of(kind), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*[named(k) for k in KINDS]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(every, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(reduce(lambda a, b: a + b, [F.size(k) for k in KINDS], F.size("more")) > 0, whole).otherwise(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked; other columns as they are, n_chars (if there) of the new text.

    The patterns run once: rows are stored with their spans, and masked from there."""
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id"), F.col("text"))
    found = stored(find(whole, "_doc"), "found")
    rows = _with_more(found.drop("seen"), additions(docs.select("doc_id", "text"), found.drop("_doc")))
    rows = rows.select("_doc", masked(F.col("_doc.text")).alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        same = F.col("_text") == F.col("_doc.text")
        changed["n_chars"] = F.when(same, F.col("_doc.n_chars")).otherwise(F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(personal_data(documents(spark, sf_dir)))
