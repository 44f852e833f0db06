"""Quality rules on texts and on lines that many documents of a host share; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.session import materialize

_SPACE = "[ \\t-\\r]+"
_BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _normal(line: Column) -> Column:
    """A line without differences of case and blanks."""
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(_BLANKS))), _SPACE, " ")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base metrics of its texts and the lines of each text as (hash, words).

    Words in repeated windows: hashes show which texts have no window twice; only the others are compared by their
    words, sorted with their places, so the count is exact.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df.withColumn("_text", body).withColumn("_trim", F.btrim("_text", F.lit(_BLANKS)))
    out = out.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", _SPACE)))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))
    n = F.size("_words")
    at = lambda i: [F.col("_words")[i + k] for k in range(WINDOW)]
    out = out.withColumn("_hashes", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*at(i)))))
    out = out.withColumn("_again", F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)))
    window = lambda h, i: F.struct(F.struct(h.alias("h"), *[w.alias(f"w{k}") for k, w in enumerate(at(i))]).alias("w"), i.alias("i"))
    out = out.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_hashes", window))))
    s = F.col("_sorted")
    twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["w"] == x["w"]))
    places = F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
    out = out.withColumn("_places", F.when(F.col("_again"), places))
    p = F.col("_places")
    steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_again"), F.aggregate(steps, F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("long"))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "line_hashes": F.transform("_lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.size(F.split(F.btrim(x, F.lit(_BLANKS)), _SPACE)).alias("words"))),
    })
    return out.drop("_trim", "_words", "_lines", "_hashes", "_again", "_sorted", "_places")


def failed() -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def judge(df: DataFrame, host: str, keep: list[str] = (), least_documents: int = 50, most_share: float = 0.01, least_line_words: int = 3,
          most_removed: float = 0.7) -> DataFrame:
    """Base metrics, ``base_failed``, ``n_removed_words``, ``kept`` and ``common_lines`` of every row of ``df`` (doc_id, text, ``host``).

    A line (normalised, of ``least_line_words`` words or more) is common if over ``least_documents`` documents of a host
    have it and over ``most_share`` of the host's documents; equal texts count as one document. A common line is removed
    from all documents but the host's first that has it (smallest doc_id). A document is depleted, and not kept, if
    over ``most_removed`` of its words are removed.

    Texts are read once: a stage in the shared folder holds the metrics and line hashes (and the columns ``keep``).
    Counting groups first by host, line and text, which divides a line that a third of all documents have. A null text
    is empty and fails; a null host is a host of its own; repeated rows are judged each; an empty table gives no rows.
    """
    given = [F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("_host"), F.col("text").cast("string").alias("_given"), *[F.col(c).alias(f"_keep_{c}") for c in keep]]
    stage = measured(df.select(*given), "_given").withColumns({"_row": F.monotonically_increasing_id(), "_key": F.xxhash64("_text"), "_host": F.coalesce("_host", F.lit(""))})
    stage = materialize(stage.drop("_text", "_given"))
    lines = stage.select("_row", "doc_id", "_host", "_key", F.explode("line_hashes").alias("x")).select("_row", "doc_id", "_host", "_key", "x.line", "x.words").where(F.col("words") >= least_line_words)
    texts = lines.groupBy("_host", "line", "_key").agg(F.min("doc_id").alias("first"))
    counted = texts.groupBy("_host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") > least_documents)
    hosts = stage.groupBy("_host").agg(F.count("*").alias("docs"))
    common = materialize(counted.join(hosts, "_host").where(F.col("n") > F.col("docs") * F.lit(most_share)).select("_host", "line", "first"))
    hit = lines.join(common, ["_host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    removed = hit.groupBy("_row").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("common_lines"))
    out = stage.drop("line_hashes").join(removed, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", failed())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= F.col("n_words") * F.lit(most_removed)))
    return out.select("doc_id", *METRICS, "base_failed", "kept", "n_removed_words", "common_lines", *[F.col(f"_keep_{c}").alias(f"_{c}") for c in keep])


def cleaned(text: Column, common_lines: Column) -> Column:
    """A text without its common lines."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(common_lines, F.xxhash64(_normal(x))))
    return F.when(common_lines.isNull(), text).otherwise(F.array_join(kept, "\n"))
