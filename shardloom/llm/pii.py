"""Personal data, by fixed patterns and by bootstrapped contextual extraction.

Base entities are found by the four fixed patterns.  They are seeds, and so are *secrets* that show
themselves: long runs of lower-case hexadecimal digits.  The words around a seed are its lexical
patterns (the word before, the two before, the word after, and those on both sides; signs that
touch it don't count).  Every other token with a digit or an at sign is a candidate instance.
Patterns and instances form a graph that is scored in rounds: a pattern's score is the mean score of
the distinct instances seen in it, shrunk towards none, and an instance's score for a kind is that
of its best pattern, where seeds stay certain.  Patterns that end with high confidence, seen with
enough distinct instances and documents, turn the candidates that they surround, and that have the
kind's shape, into spans of that kind: keys in other alphabets where ``token = ...`` is known from
seeds, numbers without their plus sign, and the like.

All of it is DataFrame functions.  Places are found without user code: splitting a text at a
pattern gives the pieces between its matches, so running sums of the lengths of pieces and matches
are the matches' places.

Defined results: null texts are empty; a text without hits has zero counts, the digest of the
empty string and empty spans; repeated rows are reported each; spans are code points, end
exclusive; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The method's own kind, found besides the base kinds and listed after them.
SECRET = "secret"
_ALL = (*KINDS, SECRET)
_WORD_SIGN = r"[A-Za-z0-9._%+-]"
#: The contract's patterns.  A match of the first starts where a run of its characters does (or at
#: the last match's end), of the others where a number or a chain of digits does: saying so, with
#: possessive repeats, keeps long runs linear and the matches the same.  Chains under 13 digits
#: could only fail.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_WORD_SIGN})){_WORD_SIGN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    SECRET: r"(?<![0-9A-Za-z])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])",
}
#: A cheap condition without which a text has no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", SECRET: None}
#: A token with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What a discovered identifier of a kind must look like at least.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]+([.:][0-9]+){2,}$",
    "card": r"^([0-9][ -]?){8,}$",
    "phone": r"^[(+]?([0-9][ ().-]*){6,}$",
    SECRET: r"^[A-Za-z0-9_+/=-]{16,}$",
}
ROUNDS = 3
CONFIDENCE = 0.9
SHRINK = 0.5
LEAST_INSTANCES, LEAST_DOCUMENTS = 8, 8


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is an entity."""
    if kind in ("email", SECRET):
        return F.lit(True)
    if kind == "ip":
        parts = F.split(match, r"\.")
        # Leading zeros don't count towards a part's size; four digits without them are over 255.
        return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.lpad(F.ltrim(p, F.lit("0")), 3, "0"), 1, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(match))).otherwise(False)
    return n.between(9, 15)


#: One or two words beside a match, from there outwards, past signs that touch it.
_BESIDE = r"^[^\x20\x09-\x0DA-Za-z0-9]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?)"
_GAP = r"[\x20\x09-\x0D]++"


def _words_before(piece: Column) -> Column:
    """The two words before a match: the piece before it is read backwards, so that its length doesn't matter."""
    return F.lower(F.regexp_replace(F.reverse(F.regexp_extract(F.reverse(piece), _BESIDE, 1)), _GAP, " "))


def _word_after(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(piece, _BESIDE, 1), r"^[^\x20\x09-\x0D]++", 0))


def _matches(text: Column, pattern: str, need: str | None) -> Column:
    """Array of (gap: code points since the match before, match, two words to the left, word to the right)."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<gap:int,match:string,left:string,right:string>>")

    def one(match: Column, i: Column) -> Column:
        return F.struct(
            F.length(pieces[i]).alias("gap"), match.alias("match"), _words_before(pieces[i]).alias("left"), _word_after(pieces[i + 1]).alias("right")
        )

    condition = text.rlike("[0-9]" if need is None else "[0-9@]")
    if need is not None:
        condition &= F.contains(text, F.lit(need))
    return F.when(condition & text.rlike(pattern), F.transform(found, one)).otherwise(empty)


def matches(documents: DataFrame, keep: list[str | Column]) -> DataFrame:
    """``keep``, _row and the raw matches by pattern, in one pass over the texts; written once."""
    text = text_or_empty()
    columns = [_matches(text, PATTERNS[k], _NEEDS[k]).alias(k) for k in _ALL]
    columns.append(_matches(text, CANDIDATE, None).alias("token"))
    return settle(documents.select(*keep, F.monotonically_increasing_id().alias("_row"), *columns), "pii-matches")


def placed(found: DataFrame, kind: str) -> DataFrame:
    """_row, kind, start, end, match, left, right: matches with their places, by a running sum in each text."""
    rows = found.where(F.size(kind) > 0).select("_row", F.posexplode(kind).alias("_i", "_m"))
    upto = Window.partitionBy("_row").orderBy("_i")
    n = F.length("_m.match")
    end = F.sum(F.col("_m.gap") + n).over(upto)
    return rows.select("_row", F.lit(kind).alias("kind"), (end - n).cast("long").alias("start"), end.cast("long").alias("end"), "_m.match", "_m.left", "_m.right")


def base_entities(found: DataFrame) -> DataFrame:
    """Valid matches of every kind, the seeds."""
    out = None
    for kind in _ALL:
        part = placed(found, kind).where(valid(kind, F.col("match")))
        out = part if out is None else out.unionByName(part)
    return out


def candidates(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Tokens with a digit or an at sign that no seed overlaps, trimmed of punctuation."""
    core = r"[(+]?[A-Za-z0-9](?:.*[A-Za-z0-9])?"
    tokens = placed(found, "token")
    match = F.regexp_extract("match", core, 0)
    before = F.length(F.regexp_extract("match", rf"^(.*?){core}", 1))
    cut = tokens.select("_row", (F.col("start") + before).alias("start"), match.alias("match"), "left", "right").where("match <> ''")
    cut = cut.withColumn("end", F.col("start") + F.length("match"))
    taken = entities.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_taken"))
    joined = cut.join(taken, "_row", "left")
    free = ~F.exists(F.coalesce("_taken", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return joined.where(free).select("_row", "start", "end", "match", "left", "right")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a place; a missing word makes none."""
    last = F.regexp_extract(left, r"[^ ]++$", 0)
    both = F.concat(last, F.lit(" _ "), right)
    return F.filter(
        F.array(
            F.when(last != "", F.concat(last, F.lit(" _"))), F.when(F.contains(left, F.lit(" ")), F.concat(left, F.lit(" _"))),
            F.when(right != "", F.concat(F.lit("_ "), right)), F.when((last != "") & (right != ""), both),
        ),
        lambda p: p.isNotNull(),
    )


def score_patterns(entities: DataFrame, free: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, score, instances, documents) after the rounds.

    An edge joins a pattern with a distinct instance (its text, lower case).  Edges are aggregated
    before anything is joined, so frequent patterns and instances are single rows.
    """
    seed = entities.select("kind", F.lower("match").alias("instance"), "_row", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    rest = free.select(F.lower("match").alias("instance"), "_row", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    # A seed is certain for its kind (or kinds, if it has several), and certainly not of the others.
    certain = settle(seed.select("instance", "kind").distinct().withColumn("s", F.lit(1.0)), "pii-seeds")
    every = seed.select("pattern", "instance", F.lit(True).alias("seed")).unionByName(rest.select("pattern", "instance", F.lit(False).alias("seed")))
    edges = settle(every.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    # A pattern's documents, each once however many instances it has there.
    places = seed.select("pattern", "_row").unionByName(rest.select("pattern", "_row")).distinct()
    support = places.groupBy("pattern").agg(F.count("*").alias("documents"))
    totals = settle(edges.groupBy("pattern").agg(F.count("*").alias("n")).join(support, "pattern"), "pii-totals")
    scores, ranked = certain, None
    for k in range(rounds):
        # Every instance of a pattern weighs on it, those of another kind (or none) with zero.
        part = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("s").alias("s"))
        ranked = settle(part.join(totals, "pattern").select("kind", "pattern", (F.col("s") / (F.col("n") + F.lit(SHRINK))).alias("score"), F.col("n").alias("instances"), "documents"), "pii-patterns")
        if k + 1 < rounds:
            reached = edges.where("NOT seed").join(ranked.where(_confident()), "pattern").where(_shaped("instance")).groupBy("instance", "kind").agg(F.max("score").alias("s"))
            scores = certain.unionByName(reached.select("instance", "kind", "s"))
    return ranked


def _confident() -> Column:
    return (F.col("score") >= CONFIDENCE) & (F.col("instances") >= LEAST_INSTANCES) & (F.col("documents") >= LEAST_DOCUMENTS)


def _shaped(column: str) -> Column:
    """Whether a candidate looks like its row's kind."""
    out = F.lit(False)
    for kind, shape in SHAPES.items():
        out |= (F.col("kind") == kind) & F.col(column).rlike(shape)
    return out


def discovered(free: DataFrame, ranked: DataFrame) -> DataFrame:
    """Candidates that a confident pattern surrounds and whose shape fits: one kind each, the best."""
    strong = ranked.where(_confident())
    places = free.select("_row", "start", "end", "match", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    met = places.join(strong.select("kind", "pattern", "score"), "pattern")
    best = met.where(_shaped("match")).groupBy("_row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("_b"))
    return best.select("_row", F.col("_b.kind").alias("kind"), "start", "end")


def find_spans(documents: DataFrame, keep: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """The rows' raw table (``keep`` and _row) and all spans: _row, kind, start, end, base."""
    found = matches(documents, keep)
    entities = settle(base_entities(found), "pii-entities")
    free = settle(candidates(found, entities), "pii-candidates")
    more = discovered(free, score_patterns(entities, free))
    spans = entities.select("_row", "kind", "start", "end", (F.col("kind") != SECRET).alias("base")).unionByName(more.select("_row", "kind", "start", "end", F.lit(False).alias("base")))
    return found, spans


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in _ALL]), s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(documents: DataFrame) -> DataFrame:
    found, spans = find_spans(documents, ["doc_id"])
    number = F.array_position(F.array(*[F.lit(k) for k in _ALL]), F.col("kind")).cast("int")
    one = F.struct(number.alias("k"), "start", "end")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    listed = spans.groupBy("_row").agg(*counts, F.collect_list(F.when(F.col("base"), one)).alias("_base"), F.collect_list(one).alias("_all"))
    text = listed.select("_row", *[f"n_{k}" for k in KINDS], _joined(F.col("_base")).alias("_base"), _joined(F.col("_all")).alias("_all"))
    whole = found.select("doc_id", "_row").join(text, "_row", "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return whole.select("doc_id", *zero, F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"))


def mask_spans(documents: DataFrame) -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; other columns as they are.

    Null and empty texts stay as they are.  The spans are joined back by a 128-bit hash of id and
    text, the same in every scan; rows that are equal in both have the same spans.
    """
    key = [F.xxhash64("doc_id", text_or_empty()).alias("_k1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("_k2")]
    found, spans = find_spans(documents, key)
    # Overlapping spans of different kinds become one place: the first's kind, up to the furthest end.
    order = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "kind")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(upto.isNull() | (F.col("start") >= upto), 1).otherwise(0)
    group = spans.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = group.groupBy("_row", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    of_row = merged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    keys = found.select(F.col("_row").alias("_at"), F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"))
    listed = settle(of_row.join(keys, of_row["_row"] == keys["_at"]).groupBy("_j1", "_j2").agg(F.first("_spans").alias("_spans")), "pii-spans")
    names = documents.columns
    marked = documents.select(F.struct(*[documents[f"`{c}`"] for c in names]).alias("_doc"), *key)
    joined = marked.join(listed, (marked["_k1"] == listed["_j1"]) & (marked["_k2"] == listed["_j2"]), "left")
    text, at = F.col("_doc.text"), F.col("_spans")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(at[i - 1]["end"])
    parts = F.transform(at, lambda s, i: F.concat(F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    tail = F.substring(text, (F.element_at(at, -1)["end"] + 1).cast("int"), F.length(text))
    masked = F.when(at.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    return joined.select(*[masked.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in names])
