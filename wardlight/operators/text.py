"""Text scoring over whole tables: category hints, urgency and polarity.

Keyword lists are parameters and become native `contains` columns, so a table is scored in
one narrow pass over whole texts, without a shuffle and without Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions.columns import clamp, count_char, has_text, map_value
from wardlight.functions.measures import n_rows
from wardlight.operators.lifecycle import URGENCY_PRIORITY
from wardlight.operators.windows import join_null_safe
from wardlight.session import materialize

# Category labels and the words that point to each.
CATEGORY_KEYWORDS = {
    "Pothole": ["pothole", "road", "crack", "cave-in"],
    "Garbage": ["garbage", "trash", "waste", "bin", "dirty"],
    "Water Supply": ["water", "no water", "pressure", "supply"],
    "Sewage": ["sewage", "drain", "toilet", "overflow", "smell"],
    "Street Light": ["street light", "light not working", "dark road"],
    "Electricity": ["electricity", "power", "outage", "voltage"],
    "Traffic Signal": ["signal", "traffic light", "junction"],
    "Stray Animals": ["stray", "dog", "animal", "cattle"],
    "Park Damage": ["park", "garden", "playground"],
    "Illegal Dumping": ["illegal dumping", "dumping", "dump yard"],
}

# Substrings of a label or hint, in order of precedence, and their category name.
CATEGORY_RULES = [
    (("pothole", "road"), "Pothole / Road Damage"),
    (("garbage",), "Garbage Not Collected"),
    (("water supply",), "Water Supply Issue"),
    (("sewage",), "Sewage Overflow"),
    (("street light", "light"), "Street Light Not Working"),
    (("electricity", "power"), "Electricity Outage"),
    (("traffic signal", "traffic"), "Traffic Signal Issue"),
    (("stray", "animal"), "Stray Animal Menace"),
    (("park",), "Park / Green Area Damage"),
    (("dump",), "Illegal Dumping"),
]

# Urgency words by level.
URGENCY_KEYWORDS = {
    "critical": ["emergency", "urgent", "immediate", "dangerous", "flooding", "sick", "fire"],
    "high": ["critical", "severe", "broken", "accident", "leak", "overflow"],
    "medium": ["issue", "problem", "delay"],
}

# Word lists of the second urgency rule set.
URGENCY_KEYWORDS_V2 = {
    "critical": ["emergency", "urgent", "immediate", "dangerous", "911"],
    "high": ["dangerous", "urgent", "emergency", "critical", "severe"],
    "medium": ["broken", "leaking", "flooding", "serious"],
    "low": ["small", "minor", "slow", "issue"],
}
EMOTION_WORDS = {
    "anger": ["!!!", "???", "damn", "bloody", "furious"],
    "concern": ["please", "urgent", "children", "family"],
    "frustration": ["again", "still", "another", "repeated"],
}
TOP_WORDS_V2 = ["emergency", "urgent"]


def hits(text, words: list[str]) -> Column:
    """How many of the words occur in the text as substrings, whatever the case."""
    return reduce(lambda a, b: a + b, [has_text(text, w).cast("int") for w in words], F.lit(0))


def any_of(text, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [has_text(text, w) for w in words], F.lit(False))


def _with_scores(docs: DataFrame, keywords: dict[str, list[str]], id_col: str, text: str) -> DataFrame:
    """(id, _text, _scores): labels with hits and score, best first, ties in label order.

    Lower-casing, counting and ranking are separate steps, so each text is lower-cased and
    searched once however often its counts are used.
    """
    lowered = docs.select(id_col, F.col(text).alias("_text"), F.lower(text).alias("_lower"))
    counts = [
        reduce(lambda a, b: a + b, [F.contains("_lower", F.lit(w.lower())).cast("int") for w in words], F.lit(0))
        for words in keywords.values()
    ]
    counted = lowered.select(id_col, "_text", *[c.alias(f"_h{n}") for n, c in enumerate(counts)])
    weights = [F.greatest(F.lit(0.1), F.col(f"_h{n}").cast("double")) for n in range(len(keywords))]
    weighed = counted.withColumn("_total", reduce(lambda a, b: a + b, weights))
    rows = [
        F.struct(
            (-F.col(f"_h{n}")).alias("neg"),
            F.lit(n).alias("pos"),
            F.lit(label).alias("label"),
            F.col(f"_h{n}").alias("hits"),
            (weights[n] / F.col("_total")).alias("score"),
        )
        for n, label in enumerate(keywords)
    ]
    return weighed.select(id_col, "_text", F.sort_array(F.array(*rows)).alias("_scores"))


def category_scores(docs: DataFrame, keywords: dict = CATEGORY_KEYWORDS, id_col="doc_id", text="text") -> DataFrame:
    """One row per document and label: hits, share of the summed weights, and rank."""
    scored = _with_scores(docs, keywords, id_col, text).select(id_col, F.posexplode("_scores").alias("_pos", "s"))
    return scored.select(id_col, "s.label", "s.hits", "s.score", (F.col("_pos") + 1).alias("rank"))


def keyword_hits(docs: DataFrame, keywords: DataFrame, id_col="doc_id", text="text") -> DataFrame:
    """id, label, hits: how many of a label's keywords each text holds as substrings, whatever the case.

    `keywords` is a table (label, keyword) of any size; texts without a hit have no row. Texts are
    read once into their distinct words. A keyword's longest part without a space must lie inside
    of a word, so words and parts meet on the part's first three characters, once for each word
    there is. Keywords with spaces are then looked for in the texts that hold this part. Keywords
    without a visible character are ignored, and so are repeats within a label.
    """
    lowered = docs.select(id_col, F.lower(text).alias("_text"))
    split = F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")
    words = materialize(lowered.select(id_col, split).filter("_word <> ''"), "words")
    longest = F.expr("element_at(array_sort(split(keyword, ' '), (a, b) -> length(b) - length(a)), 1)")
    listed = keywords.select("label", F.lower("keyword").alias("keyword")).distinct().withColumn("_part", longest).filter("_part <> ''")
    grams = F.expr(
        "array_distinct(flatten(transform(array(1, 2, 3), n -> transform(sequence(1, greatest(length(_word) - n + 1, 1)), i -> substring(_word, i, n)))))"
    )
    met = words.select("_word").distinct().withColumn("_gram", F.explode(grams))
    parts = listed.select("_part", F.substring("_part", 1, 3).alias("_gram")).distinct()
    inside = met.join(parts, "_gram").filter(F.contains("_word", F.col("_part"))).select("_word", "_part").distinct()
    near = words.join(inside, "_word").select(id_col, "_part").distinct().join(listed, "_part")
    spaced = F.col("keyword") != F.col("_part")
    unsure = near.filter(spaced).join(lowered, id_col).filter(F.contains("_text", F.col("keyword")))
    held = near.filter(~spaced).select(id_col, "label").unionByName(unsure.select(id_col, "label"))
    return held.groupBy(id_col, "label").agg(n_rows().alias("hits"))


def keyword_scores(docs: DataFrame, keywords: DataFrame, id_col="doc_id", text="text") -> DataFrame:
    """`category_scores` with a keyword table (label, label_no, keyword); labels rank by number at equal hits."""
    numbered = keywords.groupBy("label").agg(F.min("label_no").alias("label_no"))
    labels = numbered.agg(F.collect_list(F.struct("label", "label_no"))).scalar()  # one entry a label
    every = docs.select(id_col, F.explode(labels).alias("_l")).select(id_col, "_l.*")
    counted = every.join(keyword_hits(docs, keywords, id_col, text), [id_col, "label"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("int"))
    weight = F.greatest(F.lit(0.1), F.col("hits").cast("double"))
    of_text = W.partitionBy(id_col)  # one row a label
    best = of_text.orderBy(F.col("hits").desc(), "label_no")
    return counted.select(
        id_col, "label", "hits", (weight / F.sum(weight).over(of_text)).alias("score"), F.row_number().over(best).alias("rank")
    )


def normalize_label(label) -> Column:
    """Category name for a label or free hint; the first matching rule wins, else 'Other'."""
    text = F.lower(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")))
    out = None
    for words, name in CATEGORY_RULES:
        cond = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("Other")


def label_categories(cat: DataFrame, labels: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Label -> active category row, 'Other' where the mapped name does not exist. At most one row per label."""
    spark = cat.sparkSession
    base = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    name = map_value("label", rules, "Other") if rules else normalize_label("label")
    active = cat.filter("is_active").select("cat_id", "cat_name", "icon_class")
    own = F.struct("cat_id", "cat_name", "icon_class")
    other = active.filter("cat_name = 'Other'").agg(F.max(own)).scalar()
    found = base.withColumn("cat_name", name).join(active, "cat_name", "left")
    chosen = F.when(F.col("cat_id").isNotNull(), own).otherwise(other)
    return found.select("label", chosen.alias("c")).filter("c IS NOT NULL").select("label", "c.*")


def suggest_categories(
    docs: DataFrame, cat: DataFrame, keywords: dict = CATEGORY_KEYWORDS, rules=None, id_col="doc_id", text="text", k: int = 3
) -> DataFrame:
    """Up to k distinct categories per document, best first; texts under 5 characters get none.

    The label-to-category map has one entry per label and is read as a scalar subquery, so
    ranking, de-duplication and the cut to k are array expressions inside one scan.
    """
    routes = label_categories(cat, list(keywords), rules)
    entry = F.struct("label", F.struct("cat_id", "cat_name", F.coalesce("icon_class", F.lit("fa-exclamation-circle")).alias("icon")))
    lookup = routes.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    long_enough = docs.filter(F.length(F.trim(text)) >= 5)
    scored = _with_scores(long_enough, keywords, id_col, text).select(id_col, "_scores", lookup.alias("_map"))
    mapped = F.transform(
        "_scores",
        lambda s: F.struct(F.element_at(F.col("_map"), s["label"]).alias("c"), F.round(s["score"], 4).alias("confidence")),
    )
    listed = scored.select(id_col, F.filter(mapped, lambda x: x["c"].isNotNull()).alias("_l"))
    numbered = listed.withColumn("_ids", F.transform("_l", lambda x: x["c"]["cat_id"]))
    first = F.filter("_l", lambda x, i: F.array_position(F.col("_ids"), x["c"]["cat_id"]) == i + 1)
    exploded = numbered.select(id_col, F.posexplode(F.slice(first, 1, k)).alias("_pos", "x"))
    return exploded.select(
        id_col,
        (F.col("_pos") + 1).alias("rank"),
        F.col("x.c.cat_id").alias("cat_id"),
        F.col("x.c.cat_name").alias("cat_name"),
        F.col("x.c.icon").alias("icon"),
        F.col("x.confidence").alias("confidence"),
    )


def score_urgency(docs: DataFrame, keywords: dict = URGENCY_KEYWORDS, compound=None, text="text") -> DataFrame:
    """Anger, intensity, urgency level, words found, recommended priority and confidence.

    `compound` names a polarity column in -1..1 (see `polarity`); without it polarity is 0.
    """
    mood = F.lit(0.0) if compound is None else F.coalesce(F.col(compound).cast("double"), F.lit(0.0))
    words = [w for level in keywords.values() for w in level]
    found = F.array_compact(F.array(*[F.when(F.contains("_lower", F.lit(w.lower())), F.lit(w)) for w in words]))
    shouting = F.least(F.lit(2.0), count_char(text, "!") * 0.25)
    out = docs.withColumn("_lower", F.lower(F.coalesce(text, F.lit("")))).withColumn("_found", found).drop("_lower")
    n = F.size("_found")

    def listed(level):
        return F.arrays_overlap("_found", F.array(*[F.lit(w) for w in keywords.get(level, [])]).cast("array<string>"))

    anger = clamp(mood * -8.0 + F.coalesce(shouting, F.lit(0.0)) + F.when(n > 0, 1.5).otherwise(0.0), 0.0, 10.0)
    out = out.withColumns({"_anger": anger, "emotional_intensity": F.least(F.lit(1.0), F.abs(mood) + n * 0.1)})
    level = (
        F.when(listed("critical") | (F.col("_anger") >= 8.0), "critical")
        .when(listed("high") | (F.col("_anger") >= 6.0), "high")
        .when(F.col("_anger") >= 3.0, "medium")
        .otherwise("low")
    )
    return out.withColumns(
        {
            "anger_level": F.round("_anger", 2),
            "urgency_level": level,
            "keywords_found": F.array_sort(F.array_distinct("_found")),
            "confidence": F.round(F.least(F.lit(0.99), F.col("emotional_intensity") * 0.35 + 0.55), 2),
            "emotional_intensity": F.round("emotional_intensity", 3),
        }
    ).withColumn("priority_recommendation", map_value("urgency_level", URGENCY_PRIORITY)).drop("_found", "_anger")


def score_urgency_v2(
    docs: DataFrame, keywords=URGENCY_KEYWORDS_V2, emotions=EMOTION_WORDS, top_words=TOP_WORDS_V2, compound=None, text="text"
) -> DataFrame:
    """The second rule set: any keyword makes a text high, a top word critical, else by polarity."""
    mood = F.lit(0.0) if compound is None else F.coalesce(F.col(compound).cast("double"), F.lit(0.0))
    raw = F.greatest(F.lit(0.0), mood * -10)
    words = list(dict.fromkeys(w for level in keywords.values() for w in level))
    level = (
        F.when(any_of(text, top_words), "critical")
        .when(any_of(text, words), "high")
        .when(raw > 7, "high")
        .when(raw > 4, "medium")
        .otherwise("low")
    )
    feelings = [w for group in emotions.values() for w in group]
    return docs.withColumns(
        {
            "sentiment_score": F.least(F.lit(10.0), raw),
            "urgency_level": level,
            "emotional_intensity": F.round(F.least(F.lit(1.0), hits(text, feelings) / F.lit(3.0)), 4),
        }
    ).withColumn("priority_recommendation", map_value("urgency_level", URGENCY_PRIORITY))


def polarity(docs: DataFrame, lexicon: DataFrame, id_col="doc_id", text="text", alpha: float = 15.0) -> DataFrame:
    """Lexicon polarity per document: x / sqrt(x^2 + alpha) for the summed word values.

    Tokens meet the lexicon inside the scan's stage while the lexicon is small enough for
    Catalyst to broadcast it; only per-document partial sums are shuffled. Documents
    without a known word score 0. Word values are summed as decimals, so the result does not
    depend on the order in which partial sums meet.
    """
    tokens = docs.select(id_col, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}']+")).alias("token"))
    values = lexicon.select("token", F.col("value").cast("decimal(10,4)").alias("value"))
    summed = tokens.join(values, "token").groupBy(id_col).agg(F.sum("value").alias("_x"))
    x = F.coalesce(F.col("_x").cast("double"), F.lit(0.0))
    return docs.join(summed, id_col, "left").withColumn("compound", F.round(x / F.sqrt(x * x + alpha), 4)).drop("_x")


def score_distinct(docs: DataFrame, scorer, id_col="doc_id", text="text") -> DataFrame:
    """Run a scorer once per distinct text and join its columns back by content hash.

    Copies collapse map-side, so a text that fills a third of the table is moved once per
    partition; the join back carries only ids, hashes and scores.
    """
    hashed = docs.withColumn("_hash", F.md5(text))
    distinct = hashed.groupBy("_hash").agg(F.first(text).alias(text))
    scored = scorer(distinct).drop(text)
    return join_null_safe(hashed.select(id_col, "_hash"), scored, ["_hash"]).drop("_hash")


def issue_from_hint(df: DataFrame, hint: str, out: str = "ai_detected_issue") -> DataFrame:
    """Issue type of a photo from its caption, with the fixed confidence of hinted and bare photos."""
    said = F.col(hint).isNotNull() & (F.col(hint) != "")
    return df.withColumns({out: normalize_label(hint), "confidence": F.when(said, 0.87).otherwise(0.61)})
