"""Personal data in texts: exact kinds by pattern, and candidates judged by boosted trees; DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.session import materialize

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, written so that a long run of characters is read once. A match may begin where the
# last one ended or where no character of its first run stands before it; elsewhere it would have begun further left.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: any run of digit groups, addresses with a disguised @ or dot, and hexadecimal groups.
LOOSE = {
    "number": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20.,:/()_-]{1,2}[0-9]++)*+",
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[{](?:at|AT)[)\]}])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{](?:dot|DOT|\.)[)\]}]\x20?)[A-Za-z0-9-]++)++",
    "groups": r"(?:\G|(?<![0-9A-Fa-f:]))(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
_AROUND = 24  # characters of context on either side
_CUES = "(?i)(tel|phone|fax|call|mobile|card|visa|credit|ip|host|address|mail|contact)[^A-Za-z]*$"
FEATURES = ["digits", "groups", "longest", "shortest", "largest", "dots", "blanks", "dashes", "brackets", "others", "letters", "size", "luhn", "glued", "cue", "around_digits", "kind_no"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 14 to 19 digits passes the check; false for others."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(False)


def _valid(kind: Column, value: Column) -> Column:
    octets = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(octets, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    digits = _digits(value)
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", small).when(kind == "card", _luhn(digits))
            .when(kind == "phone", F.length(digits).between(10, 15)).otherwise(False))


def _searched(text: Column) -> Column:
    """Whether a text has a digit or a sign of an address, without which no pattern matches."""
    return text.rlike("[0-9@]") | F.contains(text, F.lit("[at")) | F.contains(text, F.lit("(at")) | F.contains(text, F.lit("{at")) | text.rlike("[(\\[{]AT[)\\]}]|[A-F]{1,4}:[A-Fa-f]|[a-f]{1,4}:[A-Fa-f]")


def candidates(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (row, text): the matches of all patterns as (generator, k, gap, value, before, after).

    ``gap`` is the number of code points between a match and the one before it. Texts without a digit and without a
    sign of an address are not searched.
    """
    text = F.col("text")
    out = df.withColumn("_searched", _searched(text))
    names = []
    for name, pattern in {**BASE, **LOOSE}.items():
        wanted = F.col("_searched") & (F.contains(text, F.lit("@")) if name == "email" else F.contains(text, F.lit("+")) if name == "phone" else F.lit(True))
        out = out.withColumn(f"_m_{name}", F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        out = out.withColumn(f"_p_{name}", F.when(F.size(f"_m_{name}") > 0, F.split(text, pattern, -1)))
        names.append(name)

    def matched(name: str) -> Column:
        pieces = F.col(f"_p_{name}")
        one = lambda m, k: F.struct(F.lit(name).alias("generator"), k.alias("k"), F.length(F.get(pieces, k)).alias("gap"), m.alias("value"),
                                    F.right(F.get(pieces, k), F.lit(_AROUND)).alias("before"), F.left(F.get(pieces, k + 1), F.lit(_AROUND)).alias("after"))
        none = F.array().cast("array<struct<generator:string,k:int,gap:int,value:string,before:string,after:string>>")
        return F.when(pieces.isNotNull(), F.transform(F.col(f"_m_{name}"), one)).otherwise(none)

    return out.withColumn("matches", F.concat(*[matched(n) for n in names])).drop("text", "_searched", *[f"_m_{n}" for n in names], *[f"_p_{n}" for n in names])


def _placed(stage: DataFrame) -> DataFrame:
    """One row per match with its place in the text; base matches that fail their test are left out."""
    rows = stage.where(F.size("matches") > 0).select("row", F.explode("matches").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "generator").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(order)).withColumn("start", F.col("end") - F.length("value"))
    base = F.col("generator").isin(KINDS)
    return rows.withColumn("base", base).where(~base | _valid(F.col("generator"), F.col("value"))).drop("k", "gap")


def _featured(rows: DataFrame) -> DataFrame:
    """Kind and features of loose candidates: the form of the value, and what stands beside it."""
    value = F.col("value")
    digits = _digits(value)
    lengths = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    count = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    rows = rows.withColumns({"digits": F.length(digits), "groups": F.size(lengths), "longest": F.coalesce(F.array_max(lengths), F.lit(0)), "shortest": F.coalesce(F.array_min(lengths), F.lit(0)),
                             "largest": F.coalesce(F.array_max(F.transform(F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""), lambda g: F.left(g, F.lit(9)).cast("double"))), F.lit(0.0)),
                             "dots": count("[.]"), "blanks": count(" "), "dashes": count("-"), "brackets": count("[()\\[\\]{}]"), "others": count("[,:/_@]"), "letters": count("[A-Za-z]"),
                             "size": F.length(value), "luhn": _luhn(digits).cast("int"),
                             "glued": (F.col("before").rlike("[A-Za-z0-9_=\"']$") | F.col("after").rlike("^[A-Za-z0-9_=\"']")).cast("int"),
                             "cue": F.col("before").rlike(_CUES).cast("int"), "around_digits": F.length(_digits(F.concat("before", "after")))})
    four = (F.col("groups") == 4) & (F.col("dots") == 3) & (F.col("size") == F.col("digits") + 3)
    kind = (F.when(F.col("generator") == "address", "email").when((F.col("generator") == "groups") | four, "ip")
            .when((F.col("digits") >= 14) & (F.col("brackets") == 0) & (F.col("shortest") >= 3), "card").otherwise("phone"))
    rows = rows.withColumn("kind", kind)
    return rows.withColumn("kind_no", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))


def _related(rows: DataFrame) -> DataFrame:
    """Whether each row overlaps a base span of its text."""
    order = Window.partitionBy("row").orderBy("start", "end")
    end_before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("overlaps", F.coalesce(end_before > F.col("start"), F.lit(False)) | F.coalesce(next_start < F.col("end"), F.lit(False)))


def _examples(base: DataFrame) -> DataFrame:
    """Base spans as the loose generators would meet them, as they are and in a form that the base patterns do not match.

    An address is disguised by words for @ and the last dot, a card number by dots between its groups of four, a phone
    number by leaving out the country code; context stays. An ip address has the one form only.
    """
    kind, value = F.col("generator"), F.col("value")
    national = r"^\+[0-9]{1,3}[^0-9(]*"
    plain = F.when(kind == "phone", F.substring(value, 2, 1_000_000)).otherwise(value)
    bracket = F.when(F.regexp_replace(value, national, "").startswith("("), "(").otherwise("")
    hidden = (F.when(kind == "email", F.regexp_replace(F.regexp_replace(value, r"\.([A-Za-z0-9-]+)$", " [dot] $1"), "@", " [at] "))
              .when(kind == "card", F.regexp_replace(_digits(value), "(.{4})(?=.)", "$1."))
              .when(kind == "phone", F.regexp_replace(F.regexp_replace(value, national, ""), "^[(]", "")))
    shown = F.struct(plain.alias("value"), F.when(kind == "phone", F.concat("before", F.lit("+"))).otherwise(F.col("before")).alias("before"))
    other = F.struct(hidden.alias("value"), F.when(kind == "phone", F.concat("before", bracket)).otherwise(F.col("before")).alias("before"))
    forms = base.select("row", "start", "end", "after", kind.alias("base_kind"), F.explode(F.array(shown, other)).alias("form")).where(F.col("form.value") != "")
    generator = F.when(F.col("base_kind") == "email", "address").otherwise("number").alias("generator")
    return forms.select("row", generator, F.col("form.value").alias("value"), F.right("form.before", F.lit(_AROUND)).alias("before"), "after", "start", "end")


def _judged(loose: DataFrame, base: DataFrame, sample_rows: int, trees: int, depth: int, purity: float) -> DataFrame | None:
    """Loose candidates that the boosted trees accept, as (row, kind, start, end, score); None if there is nothing to learn from.

    Positive examples are base spans, plain and disguised. The others are all loose candidates that overlap no base span:
    unlabelled, nearly all of them no personal data, and every one of them may be accepted. No feature decides a label. The trees
    see at most ``sample_rows`` different examples, those with the smallest hashes, of four fifths of them; on the rest
    each kind gets the lowest threshold, a half at least, above which base spans are at least ``purity`` of the different
    examples in every twentieth of the score, so that the many plain ones do not cover for a doubtful group.
    """
    loose = _featured(_examples(base)).withColumn("label", F.lit(1.0)).unionByName(_featured(loose.drop("base", "overlaps")).withColumn("label", F.lit(0.0)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(loose)
    mark = F.xxhash64("value", "before", "after")
    vectors = vectors.withColumn("mark", mark)
    sample = vectors.where(F.pmod("mark", F.lit(5)) > 0).dropDuplicates(["mark", "label"]).orderBy("mark", "label").limit(sample_rows).select("features", "label")
    sample = materialize(sample).coalesce(1)
    seen = {r.label: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(seen.get(0.0, 0), seen.get(1.0, 0)) < 10:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=1).fit(sample)
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1]).select("row", "kind", "start", "end", "score", "label", "mark")
    scored = materialize(scored)
    held = scored.where(F.pmod("mark", F.lit(5)) == 0).dropDuplicates(["mark", "label"])
    bins = held.groupBy("kind", F.floor(F.col("score") * 20).alias("bin")).agg(F.sum("label").alias("hits"), F.count("*").alias("n"))  # at most 21 rows a kind
    mixed = F.max(F.when(F.col("hits") < F.col("n") * purity, F.col("bin") + 1))
    limits = bins.groupBy("kind").agg(mixed.alias("mixed"), F.sum("hits").alias("hits")).where("hits > 0").select("kind", (F.greatest(F.coalesce("mixed", F.lit(0)), F.lit(10)) / 20).alias("limit"))
    return scored.where("label = 0").join(limits, "kind").where(F.col("score") >= F.col("limit")).select("row", "kind", "start", "end", "score")


def _best(accepted: DataFrame) -> DataFrame:
    """The best of every run of overlapping candidates."""
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = accepted.withColumn("new", F.coalesce(before <= F.col("start"), F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(F.max_by(F.struct("kind", "start", "end"), F.struct("score", F.col("end") - F.col("start"), F.col("start"))).alias("b")).select("row", "b.*")


def spans(df: DataFrame, sample_rows: int = 20_000, trees: int = 12, depth: int = 4, purity: float = 0.7) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, text_key, and the base and added spans as arrays of (start, order, kind, end).

    Base spans are leftmost, non-overlapping matches of their kind that pass its test, and always stay. Loose generators
    propose further, overlapping spans; boosted trees score those that overlap no base span by form and context, each
    kind's threshold is set on held-out examples, and of overlapping ones the best stays. Without enough examples, or
    for a kind whose ``purity`` is not reached, none is added.

    Texts are searched once, their matches stored; only matches are moved, and a text's own matches are all that is ever
    gathered. Places are code points, the end exclusive. A null or empty text has no spans; repeated rows are searched
    each; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), text.alias("text"))
    stage = materialize(candidates(given))
    rows = materialize(_related(_placed(stage)))
    base = rows.where("base").select("row", F.col("generator").alias("kind"), "start", "end", F.lit(True).alias("base"))
    accepted = _judged(rows.where("not base and not overlaps"), rows.where("base"), sample_rows, trees, depth, purity)
    every = base if accepted is None else base.unionByName(_best(accepted).withColumn("base", F.lit(False)))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("order")
    one = F.struct(F.col("start").cast("int").alias("start"), order, "kind", F.col("end").cast("int").alias("end"))
    lists = every.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.sort_array(F.collect_list(one)).alias("spans"))
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return stage.select("row", "doc_id", "text_key").join(lists, "row", "left").select("doc_id", "text_key", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, **options: float) -> DataFrame:
    """``df`` with a tag of its kind in place of each span, such as ``[EMAIL]``; overlapping spans share the first one's.

    Texts meet their spans by doc_id, which may be null, and hash, and only rows of texts with spans change. Texts in which
    nothing is searched stay where they are; so do null and empty ones. Repeated rows change alike; other columns stay.
    """
    found = spans(df, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    held = F.col("spans")
    merged = F.aggregate(held, F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) > s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_longer(F.try_element_at(acc, F.lit(-1)), s)))).otherwise(F.concat(acc, F.array(s))))
    found = materialize(found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), merged.alias("spans")))
    # The row is one column, so that none of its names can clash.
    keyed = df.select(F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    searched = F.coalesce(_searched(F.col("given.text").cast("string")), F.lit(False))
    s, given = F.col("spans"), F.col("given.text")
    last = lambda k: F.coalesce(F.get(s, k - 1)["end"], F.lit(0))
    parts = F.transform(s, lambda x, k: F.concat(F.substring(given, last(k) + 1, x["start"] - last(k)), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = F.substring(given, F.try_element_at(s, F.lit(-1))["end"] + 1, F.length(given))
    text = F.when(s.isNull(), given).otherwise(F.concat(F.array_join(parts, ""), rest))
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key"))
    met = keyed.where(searched).join(found, same, "left").select(*[text.alias(c) if c == "text" else F.col("given").getField(c).alias(c) for c in df.columns])
    return keyed.where(~searched).select("given.*").unionByName(met)


def _longer(first: Column, second: Column) -> Column:
    return F.struct(first["start"].alias("start"), first["order"].alias("order"), first["kind"].alias("kind"), F.greatest(first["end"], second["end"]).alias("end"))
